"""Packing token sequences by bin completion.

Only lengths matter for the plan, and there are no more than ``capacity`` of them: Spark counts the pieces
of each length, branch and bound works on that table, and the plan (fillings with multiplicities) is dealt
back to the pieces by their number within their length. Neither the plan nor the search grows with the rows.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.llm.pretokens import CACHE_CHARS, Cache, chunks, vocabulary, vocabulary_path
from zephyrlake.llm.storage import cache_of, cut, tidy, turn_to
from zephyrlake.llm.tokens import merged_ids

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces of one length are numbered in this many independent parts.
SALTS = 128
#: Pre-tokens that a worker keeps.
ENTRIES = 150_000
#: Texts of a batch that are worked on at a time; their pre-tokens take several times their own memory, and few stay in a CPU's cache.
TEXTS = 128


@lru_cache(maxsize=4)
def library(path: str | None):
    """The worker's tokenizer, for the few words that need it."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    return Tokenizer.from_file(vocabulary_path(path))


@lru_cache(maxsize=4)
def encodings(path: str | None) -> Cache:
    """The worker's ids of pre-tokens as bytes, which outlive a task."""
    vocab = vocabulary(path)

    def encoded(words: list[str]) -> list[bytes]:
        # Merging takes a round for nearly each merge of the longest word; long ones, and special strings, are the library's.
        alone = dict.fromkeys(w for w in words if len(w) > CACHE_CHARS or w in vocab.special)
        for w in alone:
            alone[w] = np.array(library(path).encode_batch_fast([w], add_special_tokens=False)[0].ids, "<u4").tobytes()
        ids, counts = merged_ids([b"" if w in alone else w.encode("utf-8") for w in words], vocab)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [alone[w] if w in alone else data[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)]

    return Cache(encoded, ENTRIES)


cache_of("packing", encodings.cache_clear)


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Token ids of each whole text (null: empty) and ``end_id``, cut into pieces of at most ``capacity`` tokens.

    Only longer documents are cut; their first piece holds the remainder, all others are full. Rows: doc_id,
    piece (from 0), start, length, ids_crc32 of the piece's little-endian unsigned 32-bit ids. path: a byte-level
    BPE vocabulary (.json) whose ids follow from its merges alone, None for the default.
    """

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("packing")
        vocab, cache = vocabulary(path), encodings(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                some = batch.slice(first, TEXTS)
                out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
                ids = iter(some.column("doc_id").to_pylist())
                for run in chunks(some.column("__text").to_pylist()):
                    for parts in cache.values([vocab.ordered(t) for t in run]):
                        doc_id = next(ids)
                        data = b"".join(parts) + end
                        total = len(data) // 4
                        at, size = 0, (total - 1) % capacity + 1
                        for piece in range(-(-total // capacity)):
                            for name, x in zip(out, (doc_id, piece, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])), strict=True):
                                out[name].append(x)
                            at, size = at + size, capacity
                yield pa.RecordBatch.from_pydict(out, pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in out]))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"))
    return rows.mapInArrow(tidy(cut_texts), PIECES)


def fillings(counts: dict[int, int], gap: int, most: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill a gap with up to three of the lengths at hand, fullest first, then of fewest and largest items."""
    sizes = sorted((s for s, n in counts.items() if n and s <= gap), reverse=True)
    have, found = set(sizes), {}

    def add(*items: int) -> None:
        if all(counts[s] >= k for s, k in Counter(items).items()):
            found.setdefault(sum(items), items)  # the first of a sum has the fewest, largest items: it dominates the others

    for s in sizes:
        add(s)
    # The largest sum of two items for each first item, by stepping down from what would fill the gap.
    for a in sizes:
        b = gap - a
        while b > 0 and (b not in have or b == a and counts[a] < 2):
            b -= 1
        if 0 < b <= a:
            add(a, b)
        if gap in found:
            break
    if gap not in found:
        for a in sizes[:64]:
            for b in (x for x in sizes if x <= min(a, gap - a)):
                if (c := gap - a - b) in have and c <= b:
                    add(a, b, c)
                    break
            if gap in found:
                break
    return [found[t] for t in sorted(found, reverse=True)[:most]]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing fillings with multiplicities: the first incumbent."""
    left, plan = dict(counts), []
    for s in sorted(counts, reverse=True):
        while left.get(s):
            items, room = [s], capacity - s
            taken = Counter(items)
            while fit := next((x for x in range(min(room, s), 0, -1) if left.get(x, 0) > taken[x]), 0):
                items.append(fit)
                taken[fit] += 1
                room -= fit
            times = min(left[x] // k for x, k in taken.items())
            for x, k in taken.items():
                left[x] -= k * times
            plan.append((tuple(items), times))
    return plan


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """The Martello-Toth bound: lengths that can't share a bin, and what of the others their bins can't hold."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = {s: n for s, n in counts.items() if capacity - k >= s and 2 * s > capacity}
        room = sum((capacity - s) * n for s, n in large.items())
        small = sum(s * n for s, n in counts.items() if 2 * s <= capacity and s >= k)
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best


def completion_plan(counts: dict[int, int], capacity: int, nodes: int = 2_000, branch: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, largest first) with multiplicities that hold every piece, in as few bins as were found.

    The largest length left is completed by its undominated fillings in order of waste; a filling is used as
    often as the counts allow. A branch ends when its bins plus the least bins for what is left reach the
    incumbent, which starts as best fit; the search ends at the lower bound or after ``nodes`` steps.
    """
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    floor = least_bins(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    stack, steps = [(counts, total, 0, None)], 0
    while stack and fewest > floor and steps < nodes:
        left, rest, used, path = stack.pop()
        steps += 1
        if not left:
            if used < fewest:
                plan, node = [], path
                while node:
                    plan.append(node[0])
                    node = node[1]
                best, fewest = plan[::-1], used
            continue
        if used + -(-rest // capacity) >= fewest:
            continue
        top = max(left)
        after = dict(left)
        after[top] -= 1
        options = fillings(after, capacity - top, branch) or [()]
        for extra in reversed(options):
            items = (top, *extra)
            need = Counter(items)
            times = min(left[s] // k for s, k in need.items())
            then = dict(left)
            for s, k in need.items():
                then[s] -= k * times
                if not then[s]:
                    del then[s]
            stack.append((then, rest - sum(items) * times, used + times, ((items, times), path)))
    return best


def placed(pieces: DataFrame, plan: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """Adds sequence_id and offset to pieces by a plan that has as many places of each length as there are pieces."""
    spark = pieces.sparkSession
    runs: dict[int, list] = {}
    dealt: Counter = Counter()
    bins = 0
    for items, times in plan:
        offset = 0
        for s, k in Counter(items).items():
            runs.setdefault(s, []).append((dealt[s], k, bins, offset))
            dealt[s] += k * times
            offset += k * s
        bins += times
    table = spark.createDataFrame([(s, r) for s, r in runs.items()], "length bigint, runs array<struct<first:bigint,per_bin:bigint,bin:bigint,at:bigint>>")
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("__k", F.row_number().over(own) - 1).join(sizes, ["length", "__salt"])
    numbered = numbered.withColumn("__k", F.col("__k") + F.col("__base"))
    # At most ``capacity`` rows, one for each length.
    run = F.expr("array_max(filter(runs, r -> r.first <= __k))")
    out = numbered.join(F.broadcast(table), "length").withColumn("__run", run).withColumn("__k", F.col("__k") - F.col("__run.first"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("__run.bin") + F.floor(F.col("__k") / F.col("__run.per_bin"))).cast("bigint").alias("sequence_id"),
        (F.col("__run.at") + F.col("__k") % F.col("__run.per_bin") * F.col("length")).cast("bigint").alias("offset"),
    )


def packed(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, nodes: int = 2_000) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most ``capacity`` tokens: one row per piece.

    A null text is an empty one and yields the end id alone; an empty table yields no rows; repeated rows
    are packed as often as they occur; other columns are left out. nodes bounds the search, not the rows.
    """
    parts = cut(pieces(docs, capacity, end_id, path))  # texts are tokenised once
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return placed(parts, completion_plan(counts, capacity, nodes))
