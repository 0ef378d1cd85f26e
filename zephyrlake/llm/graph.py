"""Connected components of an edge table, and parts that split groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.llm.storage import cut

#: Edges that a task contracts at once; those it holds from before count.
AT_ONCE = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each node that edges connect to a lesser one with the least id it is connected to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(ids))
    return ids[label[moved]], ids[moved]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, of which stars stand for all that connects the same; no more than came, in bounded memory."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(x) for x, _ in held) > AT_ONCE:
            held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
            if len(held[0][0]) > AT_ONCE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["a", "b"])
                held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held, strict=True)))], ["a", "b"])


def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large star, of rows (u, v) of both ends of all edges, sorted: a node's larger neighbours move to its least neighbour (itself included).

    open says where a node has more than one lesser neighbour, or lesser and larger ones: edges without such nodes
    are stars. A node without lesser ones is linked to itself.
    """
    last = (None, None)  # the row that the batch before ended with,
    least, below = None, 0  # its node's least neighbour or itself, and how many lesser neighbours that has had
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        fresh = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
        if len(u):
            fresh[0] = (u[0], v[0]) != last
        u, v = u[fresh], v[fresh]
        if not len(u):
            continue
        starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        sizes = np.diff(np.append(starts, len(u)))
        root, lesser = np.minimum(u[starts], v[starts]), np.add.reduceat((v < u).astype(np.int64), starts)
        again = u[0] == last[0]
        if again:
            root[0], lesser[0] = least, lesser[0] + below
        larger = v > u
        open_ = np.repeat(lesser > 0, sizes)[larger]
        new = root == u[starts]
        new[0] &= not again
        a, b = [np.repeat(root, sizes)[larger], u[starts][new]], [v[larger], u[starts][new]]
        # Several lesser neighbours: those edges move in the groups of their other ends, so a row of the group's own says that it is open.
        several = lesser > 1
        a, b = [*a, root[several]], [*b, u[starts][several]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate([open_, np.zeros(int(new.sum()), bool), np.ones(int(several.sum()), bool)]))], ["a", "b", "open"])
        last, least, below = (u[-1], v[-1]), root[-1], lesser[-1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): every node of undirected edges (a, b) with the least id it is connected to.

    Alternates small-star and large-star steps until only stars are left; each round's edges are checkpointed.
    Tasks contract what they hold before it is dealt out: by larger ends, then by both. No step makes more edges than
    it takes, rounds grow as the logarithm of the longest path, and no component meets in one task's memory.
    """
    now = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    for _ in range(rounds):
        own = now.where("a < b").select("a", "b").mapInArrow(contracted, "a bigint, b bigint").repartition("b").mapInArrow(contracted, "a bigint, b bigint")
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        both = own.select(ends.alias("e")).select("e.u", "e.v").repartition("u").sortWithinPartitions("u", "v")
        now = cut(both.mapInArrow(moved, "a bigint, b bigint, open boolean"))
        if not now.where("open").take(1):
            return now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def main_and_others(rows: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """Adds cell and part to rows with a column class: each row goes to one part of its key's, of about ``size`` rows; those outside the key's largest class to all parts.

    So rows of different classes of a key meet, and a key of one class costs no more than its rows. part is the
    own part of a row that goes to all, else -1: two of the former are in all cells, and need to be compared in one.
    """
    by_class = rows.groupBy(key, "class").agg(F.count(F.lit(1)).alias("n"))
    keys = by_class.groupBy(key).agg(F.max_by("class", F.struct("n", "class")).alias("__main"), F.ceil(F.sum("n") / size).cast("int").alias("__parts"))
    rows = rows.join(keys, key)
    own, main = F.pmod(F.xxhash64(member), F.col("__parts")).cast("int"), F.col("class") == F.col("__main")
    rows = rows.withColumn("part", F.when(main, F.lit(-1)).otherwise(own))
    cells = F.when(main, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1))
    return rows.withColumn("cell", F.explode(cells)).drop("__main", "__parts")


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by ``keys``, one at a time, however batches cut them."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for i, j in zip(new, new[1:], strict=False):
            if j - i > 1:
                yield batch.iloc[i:j]
        held = batch.iloc[new[-1] :]
    if held is not None and len(held) > 1:
        yield held


def whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The batches, cut so that no group of rows, which come sorted by ``keys``, is divided."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        last = (batch[keys] != batch[keys].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        end = int(last[-1]) + 1 if len(last) else 0
        held = batch.iloc[end:]
        if end:
            yield batch.iloc[:end].reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)
