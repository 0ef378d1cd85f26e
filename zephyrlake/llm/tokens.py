"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch are held as one flat array of symbols with their sequence numbers. In
each round all occurrences of the lowest-ranked pair of every unfinished sequence merge at once, and the
ranks of pairs with a new symbol are looked up; what is left when no pair has a rank are its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.llm.pretokens import NONE, Cache, Vocabulary, chunks, vocabulary


def merged_ids(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that survive merging, of one byte string after the other, and their number in each."""
    text = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    symbols, rank = vocab.byte_ids[text], np.full(len(text), NONE)
    rank[:-1] = np.where(owner[:-1] == owner[1:], vocab.byte_ranks[text[:-1].astype(np.int64) << 8 | text[1:]], NONE)
    owners, ends = [owner[:0]], [symbols[:0]]
    while len(symbols):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
        live = lowest != NONE
        if not live.all():
            owners.append(owner[~live])
            ends.append(symbols[~live])
        hits = np.flatnonzero((rank == lowest) & live)
        # Of overlapping occurrences (a a a) every second one counts, from the left; a sequence's last symbol has no rank.
        if (np.diff(hits) == 1).any():
            new_run = np.append(True, np.diff(hits) != 1)
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - first) % 2 == 0]
        symbols[hits] = vocab.made[rank[hits]]
        live[hits + 1] = False
        at, kept = np.cumsum(live)[hits] - 1, np.flatnonzero(live)
        symbols, owner, rank = symbols[kept], owner[kept], rank[kept]
        # Only pairs that hold a new symbol have new ranks.
        rank[at] = NONE
        pairs = np.concatenate([at, at[at > 0] - 1])
        pairs = pairs[pairs < len(symbols) - 1]
        pairs = pairs[owner[pairs] == owner[pairs + 1]]
        rank[pairs] = vocab.pair_ranks(symbols[pairs], symbols[pairs + 1])
    owner = np.concatenate(owners)
    return np.concatenate(ends)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def merged_lengths(words: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """Number of symbols that survive merging, for each byte string."""
    return merged_ids(words, vocab)[1]


@lru_cache(maxsize=4)
def lengths(path: str | None) -> Cache:
    """The worker's token counts of pre-tokens, which outlive a task."""
    vocab = vocabulary(path)
    return Cache(lambda words: merged_lengths([w.encode("utf-8") for w in words], vocab).tolist())


def token_counts(docs: DataFrame, text: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``) to every row; the text itself goes.

    path: a byte-level BPE vocabulary (.json), None for the default. Null and empty texts have 0 bytes and
    0 tokens. Texts are never truncated; a text of any length is handled within its own chunk. Rows, also
    repeated ones, stay as they are; columns other than the text pass through, but for those named like a result.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c != text and c not in made]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes bigint", "n_tokens bigint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = vocabulary(path), lengths(path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for run in chunks(batch.column("__text").to_pylist()):
                parts = [vocab.parts(t) for t in run]
                known = cache.values([words for words, _ in parts])
                n_bytes += [len(t.encode("utf-8")) for t in run]
                n_tokens += [sum(counts) + len(special) for counts, (_, special) in zip(known, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], [*keep, "n_bytes", "n_tokens"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
