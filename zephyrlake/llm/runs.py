"""Periodic runs of words by block convolution.

At the scale b = 1, 2, 4, ... a text is cut into blocks of b words. A run of period q, b <= q < 2b, that holds its
period four times contains two blocks side by side which occur again q words later, so each block is convolved
with the 2b words that follow it: the sum of squared differences at a distance is the block's own squares, plus
those of the words it lies against, less twice their products, all worked out in integers modulo a prime by a
number-theoretic transform. Distances with a sum of zero at two neighbouring blocks are seeds; comparing words
outwards from a seed gives the whole run. A sum that is only zero modulo the prime falls in that comparison, and a
true match is always zero, so nothing is lost and nothing is guessed.

Blocks that can hold no seed are left out beforehand, by two exact rules: a word that doesn't come again within 2b
words rules its block out, and so does a known run of a smaller period that covers the block and all it is held
against.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime with transforms of up to 2**23 places, and its least primitive root.
PRIME, ROOT = 998_244_353, 3
#: Words that one transform holds at most; longer series of blocks are taken in parts.
PART = 1 << 19
#: Bytes of text that are searched together, about; a longer text is searched alone.
CHUNK = 3_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: A run holds its period at least so often, and so many words.
LEAST_TIMES, LEAST_WORDS = 4, 6


@lru_cache(maxsize=64)
def twiddles(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. half-1 of a root of unity of order 2 * half, or of its inverse."""
    step = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    step = pow(step, PRIME - 2, PRIME) if inverse else step
    out, have = np.ones(half, np.int64), 1
    while have < half:
        more = min(have, half - have)
        out[have : have + more] = out[:more] * pow(step, have, PRIME) % PRIME
        have += more
    return out


def transformed(rows: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row, its places in bit-reversed order."""
    out, half = rows % PRIME, rows.shape[1] // 2
    while half:
        pairs = out.reshape(len(rows), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack(((a + b) % PRIME, (a - b) % PRIME * twiddles(half, False) % PRIME), 2).reshape(rows.shape)
        half //= 2
    return out


def restored(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transformed``."""
    out, half, size = rows, 1, rows.shape[1]
    while half < size:
        pairs = out.reshape(len(rows), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * twiddles(half, True) % PRIME
        out = np.stack(((a + b) % PRIME, (a - b) % PRIME), 2).reshape(rows.shape)
        half *= 2
    return out * pow(size, PRIME - 2, PRIME) % PRIME


def matches(words: np.ndarray, starts: np.ndarray, b: int) -> np.ndarray:
    """[i, j]: whether the sum of squared differences of block i and the words b + j behind it is zero modulo the prime."""
    out = np.zeros((len(starts), b), bool)
    most = max(1, PART // (2 * b))
    for i in range(0, len(starts), most):
        at = starts[i : i + most, None]
        block, window = words[at + np.arange(b)] % PRIME, words[at + np.arange(b, 3 * b)] % PRIME
        mirrored = np.zeros_like(window)
        mirrored[:, :b] = block[:, ::-1]
        products = restored(transformed(mirrored) * transformed(window) % PRIME)[:, b - 1 : 2 * b - 1]
        squares = np.cumsum(np.concatenate([np.zeros((len(at), 1), np.int64), window * window % PRIME], 1), 1)
        own = (block * block % PRIME).sum(1)[:, None]
        out[i : i + most] = (own + squares[:, b : 2 * b] - squares[:, :b] - 2 * products) % PRIME == 0
    return out


def stretch(words: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The largest [a, z) around a place in which words d apart are identical; a = z where they differ at the place itself."""
    n, right, step = len(words), at, 64
    while right + d < n:
        m = min(step, n - d - right)
        bad = np.flatnonzero(words[right : right + m] != words[right + d : right + d + m])
        if len(bad):
            right += int(bad[0])
            break
        right, step = right + m, 2 * step
    left, step = at, 64
    while left > 0:
        m = min(step, left)
        bad = np.flatnonzero(words[left - m : left] != words[left - m + d : left + d])
        if len(bad):
            left += int(bad[-1]) + 1 - m
            break
        left, step = left - m, 2 * step
    return left, right + d if right > at else left


def found_runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, length, period) of all runs of a series of integers that stand for words, by start and period.

    longest: the most words that a run can have, by default all; several texts may lie side by side if none shares
    an integer with another.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    again = np.full(n, np.iinfo(np.int64).max)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    reach, found, b = np.zeros(n + 1, np.int64), {}, 1
    longest = n if longest is None else longest
    fill = -1 - np.arange(4 * max(1, longest), dtype=np.int64)  # stands behind the last word and equals none
    padded = np.concatenate([words, fill])
    while LEAST_TIMES * b <= longest:
        far = np.concatenate([[0], np.cumsum(again >= 2 * b)])
        starts = np.arange(0, n - b + 1, b)
        live = far[starts + b] == far[starts]
        first = np.flatnonzero(live[:-1] & live[1:])
        covered = np.maximum.accumulate(reach)
        first = first[starts[first] + 3 * b > covered[starts[first]]]
        if len(first):
            asked = np.unique(np.concatenate([first, first + 1]))
            hit = matches(padded, starts[asked], b)
            at = np.searchsorted(asked, first)
            row, j = np.nonzero(hit[at] & hit[at + 1])
            s, d = starts[first[row]], b + j
            new = s + d + b > covered[s]
            s, d = s[new], d[new]
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            cuts = [*np.flatnonzero(np.diff(d, prepend=-1)).tolist(), len(d)]
            for i, z in zip(cuts, cuts[1:], strict=False):
                period = int(d[i])
                while i < z:
                    a, end = stretch(words, int(s[i]), period)
                    if end - a >= max(LEAST_WORDS, LEAST_TIMES * period):
                        found.setdefault((a, end), period)  # a stretch known by a smaller period has that one
                        reach[a] = max(reach[a], end)
                    i = max(i + 1, int(np.searchsorted(s[i:z], end - period)) + i)
        b *= 2
    return np.array(sorted((a, end - a, q) for (a, end), q in found.items()), np.int64).reshape(-1, 3)


def searched(texts: list[bytes]) -> tuple[list[list[tuple]], list[bytes]]:
    """Runs and collapsed text of each text."""
    split = [t.split() for t in texts]  # of bytes: at the six ASCII white spaces alone
    sizes = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(sizes)
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int64, int(sizes.sum()))
    code = np.repeat(np.arange(len(texts)), sizes) * max(1, len(numbers)) + code
    runs = found_runs(code, int(sizes.max(initial=0)))
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    drop = np.zeros(len(code) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(drop)[:-1] == 0
    out: list[list[tuple]] = [[] for _ in texts]
    for k, (a, length, q) in zip(owner.tolist(), runs.tolist(), strict=True):
        out[k].append((a - int(ends[k] - sizes[k]), length, q))
    whole, left = [], ends - sizes
    for k, words in enumerate(split):
        whole.append(b" ".join(words if not out[k] else [w for w, kept in zip(words, keep[left[k] : ends[k]].tolist(), strict=True) if kept]))
    return out, whole


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, runs (start, length, period, by start and then period) and collapsed (the kept words, joined by one space); the text goes.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch with the smallest period q of at least
    max(6, 4q) words that no neighbouring word extends; its words behind the first q are not kept. Null and
    empty texts have no words, no runs and an empty collapsed text. Texts of any length are searched whole; repeated
    rows stay; an empty table gives no rows. Other columns pass through, but for those named like a result.
    """
    made = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c != text and c not in made]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_words bigint", f"runs {RUNS}", "collapsed string"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, i = pc.binary_length(batch.column("__text")).to_numpy(zero_copy_only=False).astype(np.int64), 0
            while i < len(batch):
                z = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), CHUNK)))
                part = batch.slice(i, z - i)
                texts = part.column("__text").to_pylist()
                runs, whole = searched(texts)
                n = [len(t.split()) for t in texts]
                rows = pa.array([[{"start": a, "length": m, "period": q} for a, m, q in r] for r in runs], kind)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(n, pa.int64()), rows, pa.array(whole, pa.binary()).cast(pa.string())], [*keep, *made])
                i = z

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("__text"))
    return rows.mapInArrow(search, schema)
