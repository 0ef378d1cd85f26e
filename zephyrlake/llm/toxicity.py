"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams of each distinct word with its ends marked, present or not in a document.
Their log-count ratios between the classes come from the labelled rows; the strongest features by
chi-square, each scaled by its ratio, go to a logistic regression with a ridge penalty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.llm.pretokens import chunks
from zephyrlake.llm.storage import cache_of, cut, tidy, turn_to

BITS = 18
NOTHING = np.zeros(0, np.int32)
#: Longer words are cut into parts of 48 characters, which bounds the features of one word.
WORD = re.compile(r"[^\W\d_]{1,48}")
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A worker's word cache is emptied at this size (most words have none of the kept features, and cost little then); results do not depend on it.
CACHE_WORDS = {True: 400_000, False: 60_000}


@dataclass(frozen=True)
class Settings:
    """max_labels: labelled rows that the fit takes at most, those of least hash of doc_id; it bounds all else the driver holds."""

    n_min: int = 3
    n_max: int = 6
    max_labels: int = 20_000
    max_features: int = 2_000
    least_docs: int = 3
    smoothing: float = 0.5
    ridge: float = 1.0
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """features: hashed n-grams, ascending; weights: learned weight times ratio."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    settings: Settings


class Features:
    """Hashed n-grams of words, cached; keep: the only features wanted, ascending, as their places."""

    def __init__(self, settings: Settings, keep: np.ndarray | None = None):
        self.s, self.cache, self.place = settings, {}, None
        if keep is not None:
            self.place = np.full(1 << BITS, -1, np.int32)
            self.place[keep] = np.arange(len(keep), dtype=np.int32)

    def learn(self, words: list[str]) -> None:
        """Caches the features of new words, all at once: n-grams are hashed along the words set in single spaces."""
        if not words:
            return
        text = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
        spaces = np.flatnonzero(text == 32)
        at = np.arange(len(text))
        word = np.searchsorted(spaces, at, side="right") - 1  # a space opens the word after it
        end = np.append(spaces[1:], len(text))[word] + 1
        hashed, ids, owners = np.zeros(len(text), np.uint64), [], []
        with np.errstate(over="ignore"):
            for n in range(1, self.s.n_max + 1):
                ahead = text[n - 1 :].astype(np.uint64)
                hashed = (hashed[: len(ahead)] + ahead) * ODD
                hashed ^= hashed >> np.uint64(31)
                if n >= self.s.n_min:
                    fits = np.flatnonzero(at[: len(hashed)] + n <= end[: len(hashed)])
                    ids.append((hashed[fits] * ODD >> np.uint64(64 - BITS)).astype(np.int32))
                    owners.append(word[fits])
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        if self.place is not None:
            ids = self.place[ids]
            owners, ids = owners[ids >= 0], ids[ids >= 0]
        self.cache.update(dict.fromkeys(words, NOTHING))
        if not len(owners):
            return
        order = np.argsort(owners, kind="stable")
        owners, ids = owners[order], ids[order]
        starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        for i, j in zip(starts, np.append(starts[1:], len(owners)), strict=True):
            self.cache[words[owners[i]]] = np.unique(ids[i:j])

    def of_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Distinct features of each whole text, ascending."""
        for run in chunks(texts):
            words = [set(WORD.findall(t.lower())) for t in run]
            if len(self.cache) > CACHE_WORDS[self.place is not None]:
                self.cache = {}
            cache = self.cache
            self.learn(list(set().union(*words).difference(cache)))
            for own in words:
                found = [ids for w in own if (ids := cache[w]) is not NOTHING]
                yield np.unique(np.concatenate(found)) if found else NOTHING


@lru_cache(maxsize=1)
def _kept(settings: Settings, keep: bytes | None) -> Features:
    return Features(settings, None if keep is None else np.frombuffer(keep, np.int64))


cache_of("toxicity", _kept.cache_clear)


def features_for(settings: Settings, keep: np.ndarray | None = None) -> Features:
    """The worker's features, whose cache outlives a task."""
    turn_to("toxicity")
    return _kept(settings, None if keep is None else keep.tobytes())


def held_out(doc_id: Column) -> Column:
    """Rows never trained on: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(text, toxic) of at most max_labels labelled rows that are not held out; labels at odds count as toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    chosen = known.orderBy(F.crc32(F.concat(F.lit("fit:"), F.col("__id").cast("string"))), "__id").limit(settings.max_labels)
    # At most max_labels rows of two numbers.
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("text"), F.col("__toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic); without both classes the score is the smoothed share of label 1."""
    rows = training_rows(docs, labels, settings)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = features_for(settings)
        tally = np.zeros((2, 1 << BITS), np.int64)
        size = [0, 0]
        for batch in batches:
            for ids, toxic in zip(made.of_texts(batch["text"].tolist()), batch["toxic"], strict=True):
                tally[toxic, ids] += 1
                size[toxic] += 1
        seen = np.flatnonzero(tally.sum(axis=0))
        yield pd.DataFrame({"feature": np.append(seen, -1), "n0": np.append(tally[0, seen], size[0]), "n1": np.append(tally[1, seen], size[1])})

    counts = cut(rows.mapInPandas(tidy(counted), "feature bigint, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    sizes = counts.where("feature = -1").first()
    n0, n1 = (sizes["n0"], sizes["n1"]) if sizes else (0, 0)
    if not n0 or not n1:
        share = (n1 + settings.smoothing) / (n0 + n1 + 2 * settings.smoothing)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))), settings)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d = F.lit(float(n1)) - a, F.lit(float(n0)) - b
    chi = (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d + F.lit(1e-9)))
    # At most max_features rows.
    best = counts.where((F.col("feature") >= 0) & (F.col("n0") + F.col("n1") >= settings.least_docs)).withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(settings.max_features).toPandas().sort_values("feature")
    features = best["feature"].to_numpy(np.int64)
    p, q = best["n1"].to_numpy(float) + settings.smoothing, best["n0"].to_numpy(float) + settings.smoothing
    ratio = np.log(p / (n1 + 2 * settings.smoothing)) - np.log(q / (n0 + 2 * settings.smoothing))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = features_for(settings, features)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "at": [x.astype("<i2").tobytes() for x in made.of_texts(batch["text"].tolist())]})

    # At most max_labels rows of a few bytes for each of at most max_features features.
    data = rows.mapInPandas(tidy(encoded), "toxic int, at binary").toPandas().sort_values(["toxic", "at"])
    weights, bias = logistic([np.frombuffer(x, "<i2") for x in data["at"]], data["toxic"].to_numpy(float), ratio, settings.ridge)
    return Model(features, weights * ratio, bias, settings)


def logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, ridge: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on present features of value ``ratio``, by accelerated gradient steps."""
    at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value, n, k = ratio[at], len(rows), len(ratio)
    w, bias = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    # A step for each weight by the curvature that its own column allows; momentum restarts when it points uphill.
    curve = 0.25 * np.bincount(at, value * value * np.bincount(owner, np.abs(value), n)[owner] / np.maximum(np.abs(value), 1e-9), k) + ridge
    v, vb, look, look_b = w.copy(), bias, w.copy(), bias
    for t in range(rounds):
        z = np.bincount(owner, value * look[at], n) + look_b
        error = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        grad = np.bincount(at, value * error[owner], k) + ridge * look
        new, new_b = look - grad / curve, look_b - error.sum() / (0.5 * n)
        m = t / (t + 3) if grad @ (new - w) <= 0 else 0.0
        look, look_b = new + m * (new - w), new_b + m * (new_b - bias)
        w, bias = new, new_b
    return w, bias


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold, else 0) to every row.

    Whole texts are scored; a null or empty text has the score of no features. Columns named like a result
    are replaced; all others, and repeated rows, stay.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])
    features, weights, bias = model.features, model.weights, model.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = features_for(model.settings, features)
        for batch in batches:
            z = np.array([weights[x].sum() for x in made.of_texts(batch.column("__text").to_pylist())], float) + bias
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], [*keep, "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    return rows.mapInArrow(tidy(score), schema).withColumn("predicted", (F.col("score") >= model.settings.threshold).cast("int"))
