"""Hard negatives by zone maps over blocks in Hilbert order.

Vectors are ordered by label and by their place on a Hilbert curve over quartile codes of all dimensions, cut into
blocks of one label, and written as Parquet with a zone map beside each block: the least and the largest value of
every dimension. For an anchor the zone map bounds the products with all rows of a block by interval arithmetic, each
dimension giving its lower or upper corner by the sign of the anchor's component. A block is read for an anchor only
where these bounds meet one of its windows of scores; a block that lies in a window altogether and has enough rows
raises the window's floor for all others. What is read is multiplied exactly.

Two searches run this way: the positives are the best rows of the anchor's label, the negatives the best rows of
other labels between two shares of the positive's score.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.llm.storage import checkpoint_dir
from zephyrlake.llm.topk import products, quantised

#: Rows of one block, and rows of the blocks that one task multiplies at once, about.
BLOCK_ROWS, CELL_ROWS = 256, 4096
#: Anchors of one group, about, and zone maps that it is held against at once, about.
GROUP_ANCHORS, ZONES = 1024, 4096
#: Rows (those of least hash) that give the quartiles of the curve and the edges of anchor groups; results don't depend on them.
SAMPLE = 16_384
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCKS = "block bigint, dims int, label bigint, n int, lo binary, hi binary, ids binary, v binary"
FOUND = "anchor_id bigint, ask bigint, vec_id bigint, score bigint"


def hilbert_keys(codes: np.ndarray, bits: int = 2) -> list[bytes]:
    """The place on a Hilbert curve of each row of codes (0 .. 2**bits - 1 in every dimension), as bytes that sort like it."""
    x, n = codes.astype(np.uint8).T.copy(), codes.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrors of each level, from the coarsest
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint8)
            x[0] ^= np.where(high, q - 1, swap).astype(np.uint8)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0).astype(np.uint8)
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # level, dimension, row
    packed = np.packbits(planes.reshape(bits * n, -1), axis=0).T
    return [k.tobytes() for k in np.ascontiguousarray(packed)]


def matrix(cells: list[bytes]) -> np.ndarray:
    """Rows of integers from their bytes."""
    return np.frombuffer(b"".join(cells), "<i8").reshape(len(cells), -1)


class Curve:
    """Quartiles by vector size, and the edges of anchor groups in the order of (dims, label, key)."""

    def __init__(self, sample: pa.Table, groups: int):
        self.edges, order = {}, []
        dims, labels = (sample.column(c).to_numpy() for c in ("dims", "label"))
        flat, ends = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
        for size in set(dims.tolist()):
            at = np.flatnonzero(dims == size)
            v = np.stack([flat[ends[i] - size : ends[i]] for i in at])
            self.edges[size] = np.quantile(v, [0.25, 0.5, 0.75], axis=0)
            order += [(size, label, key) for label, key in zip(labels[at].tolist(), self.keys(v), strict=True)]
        order.sort()
        self.cuts = [order[len(order) * g // groups] for g in range(1, groups)] if order else []

    def keys(self, v: np.ndarray) -> list[bytes]:
        """Curve places of rows of one size; sizes that the sample doesn't have lie in one place each."""
        edges = self.edges.get(v.shape[1])
        if edges is None or not v.shape[1]:
            return [b""] * len(v)
        return hilbert_keys((v[None] > edges[:, None]).sum(0))

    def group(self, dims: int, label: int, key: bytes) -> int:
        """The group of an anchor."""
        return bisect_right(self.cuts, (dims, label, key))


def keyed(rows: DataFrame, curve: Curve) -> DataFrame:
    """vec_id, label, dims, key, grp, and v as bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_pylist()
            labels, keys, raw = batch.column("label").to_pylist(), [b""] * len(dims), [b""] * len(dims)
            flat, offsets = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i8"), np.concatenate([[0], np.cumsum(dims)]).astype(int)
            for size in set(dims):
                at = [i for i, d in enumerate(dims) if d == size]
                v = np.stack([flat[offsets[i] : offsets[i + 1]] for i in at])
                for i, key, row in zip(at, curve.keys(v), v, strict=True):
                    keys[i], raw[i] = key, row.tobytes()
            groups = [curve.group(*x) for x in zip(dims, labels, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("dims"), pa.array(keys, pa.binary()), pa.array(groups, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "dims", "key", "grp", "v"])

    return rows.select("vec_id", "label", "dims", "v").mapInArrow(add, "vec_id bigint, label bigint, dims int, key binary, grp int, v binary")


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK_ROWS rows of one size and label in the order of the curve, with their zone maps."""
    order = ["dims", "label", "key", "vec_id"]

    def made(number: int, dims: int, label: int, ids: list[int], cells: list[bytes]) -> tuple:
        v = matrix(cells) if dims else np.zeros((len(ids), 0), "<i8")
        return (number, dims, label, len(ids), v.min(0).tobytes(), v.max(0).tobytes(), np.array(ids, "<i8").tobytes(), v.tobytes())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, at, ids, cells = TaskContext.get().partitionId() << 32, 0, None, [], []
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for batch in batches:
            out = []
            for dims, label, vec_id, v in zip(*(batch.column(c).to_pylist() for c in ("dims", "label", "vec_id", "v")), strict=True):
                if ids and (at != (dims, label) or len(ids) >= BLOCK_ROWS):
                    out.append(made(base + count, *at, ids, cells))
                    count, ids, cells = count + 1, [], []
                at = (dims, label)
                ids.append(vec_id)
                cells.append(v)
            if out:
                yield batch_of(out)
        if ids:
            yield batch_of([made(base + count, *at, ids, cells)])

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, BLOCKS)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[anchor, block]: what the products with a block's rows can't fall below and can't pass, with room for rounding."""
    a, low, high = anchors.astype(float), lo.astype(float).T, hi.astype(float).T
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high))) + 1e-6
    return up @ low + down @ high - slack, up @ high + down @ low + slack


def spread(asks: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner (row of the anchor), ask, low, high of every window."""
    flat = [(i, x["ask"], x["low"], x["high"]) for i, own in enumerate(asks) for x in own]
    return tuple(np.array(c, np.int64) for c in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 4


def chosen(zones: pd.DataFrame, anchors: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """(grp, block) of the blocks that some window of the group must read."""
    if not len(zones) or not len(anchors):
        return pd.DataFrame({"grp": [], "block": []})
    need = np.zeros(len(zones), bool)
    for dims in set(zones["dims"]) & set(anchors["dims"]):
        z, a = np.flatnonzero(zones["dims"] == dims), anchors[anchors["dims"] == dims]
        if not dims:
            need[z] = True
            continue
        v, (owner, _, low, high) = matrix(a["v"].tolist()), spread(a["asks"])
        least, most = bounds(v, matrix(zones["lo"].iloc[z].tolist()), matrix(zones["hi"].iloc[z].tolist()))
        fits = (a["label"].to_numpy()[:, None] == zones["label"].to_numpy()[z]) == same
        many = zones["n"].to_numpy()[z] > k  # one of the rows may be the anchor itself
        for i in range(0, len(owner), 1024):
            own, at, top = owner[i : i + 1024], low[i : i + 1024, None].astype(float), high[i : i + 1024, None].astype(float)
            inside = fits[own] & (least[own] >= at) & (most[own] <= top) & many
            floor = np.maximum(at[:, 0], np.where(inside, least[own], -np.inf).max(1, initial=-np.inf))[:, None]
            need[z] |= (fits[own] & (most[own] >= floor) & (least[own] <= top)).any(0)
    return pd.DataFrame({"grp": anchors["grp"].iloc[0], "block": zones["block"].to_numpy()[need]})


def best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each owner, ties to smaller ids."""
    order = np.lexsort((ids, -scores, owner))
    own = owner[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


def read(blocks: pd.DataFrame, anchors: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best rows of these blocks in each window, by exact products; a window's floor rises from block to block."""
    out = []
    for dims in set(blocks["dims"]) & set(anchors["dims"]):
        own, part = blocks[blocks["dims"] == dims], anchors[anchors["dims"] == dims].reset_index(drop=True)
        ids_of, labels = part["anchor_id"].to_numpy(), part["label"].to_numpy()
        v = matrix(part["v"].tolist()) if dims else np.zeros((len(part), 0), np.int64)
        owner, ask, low, high = spread(part["asks"])
        if not len(owner):
            continue
        least, most = bounds(v, matrix(own["lo"].tolist()), matrix(own["hi"].tolist())) if dims else (np.full((len(part), len(own)), -np.inf), np.full((len(part), len(own)), np.inf))
        floor = low.copy()
        kept = [np.zeros(0, np.int64)] * 3  # window, row, score
        for b in np.argsort(-most.max(0), kind="stable").tolist():
            block = own.iloc[b]
            want = ((labels[owner] == block["label"]) == same) & (most[owner, b] >= floor) & (least[owner, b] <= high)
            live = np.unique(owner[want])
            if not len(live):
                continue
            ids, rows = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["v"], "<i8").reshape(block["n"], -1)
            scores, place = products(v[live], rows), np.zeros(len(part), int)
            place[live] = np.arange(len(live))
            asked = np.flatnonzero(want)
            for i in range(0, len(asked), 2048):
                w = asked[i : i + 2048]
                s = scores[place[owner[w]]]
                r, c = np.nonzero((s >= floor[w, None]) & (s <= high[w, None]) & (ids != ids_of[owner[w], None]))
                kept = [np.concatenate([x, y]) for x, y in zip(kept, (w[r], ids[c], s[r, c]), strict=True)]
            at = best(*kept, k)
            kept = [x[at] for x in kept]
            # Of a window with k rows, the worst of them is the floor from now on.
            count = np.bincount(kept[0], minlength=len(floor))
            worst = np.full(len(floor), HIGHEST)
            np.minimum.at(worst, kept[0], kept[2])
            floor = np.where(count >= k, np.maximum(floor, worst), floor)
        out.append(pd.DataFrame({"anchor_id": ids_of[owner[kept[0]]], "ask": ask[kept[0]], "vec_id": kept[1], "score": kept[2]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "ask", "vec_id", "score")})


def searched(blocks: DataFrame, asks: DataFrame, groups: int, k: int, same: bool, sizes: tuple[int, int]) -> DataFrame:
    """anchor_id, ask, vec_id, score, rank: the k best rows of the same or of other labels in each window.

    asks: grp, anchor_id, dims, label, v, asks (ask, low, high). sizes: number of blocks and of their rows. Zone maps and
    groups of anchors meet in parts; so do the blocks that are needed and the groups that need them.
    """
    parts, cells = max(1, -(-sizes[0] // ZONES)), max(1, -(-sizes[1] // CELL_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    zones = blocks.select("block", "dims", "label", "n", "lo", "hi", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")).withColumn("grp", every(groups))
    near = zones.groupBy("grp", "part").cogroup(asks.withColumn("part", every(parts)).groupBy("grp", "part"))
    pairs = near.applyInPandas(lambda z, a: chosen(z, a, k, same), "grp int, block bigint")
    needed = blocks.join(pairs, "block").withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    met = needed.groupBy("grp", "cell").cogroup(asks.withColumn("cell", every(cells)).groupBy("grp", "cell"))
    found = met.applyInPandas(lambda b, a: read(b, a, k, same), FOUND)
    order = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90), factor: int = 256, vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; scores are inner products of floor(factor * x). An
    anchor's positives are its best rows of the same label, its negatives for a positive the best rows of other labels
    whose score lies between ``shares`` per cent of the positive's; ties go to smaller ids, and where there are fewer, all
    are given. Labels are whole numbers. Rows with a null vec_id, label or vector, or with null or non-finite
    components, take no part; vectors of another size than the anchor's neither. Rows of the anchor's own vec_id are never
    its positives or negatives; other repeated rows count each; scores must fit a long; of repeated anchors the least row (by label and
    vector) asks. A positive of negative score has no window. Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), quantised(F.col(f"`{vector}`"), factor).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).withColumn("dims", F.size("v"))
    is_anchor = F.col("vec_id") % every == 0
    asked = rows.where(is_anchor).select("vec_id").distinct().count()
    groups = max(1, -(-asked // GROUP_ANCHORS))
    curve = Curve(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE).toArrow(), groups)
    base, ordered = f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}", keyed(rows, curve)
    blocks_of(ordered).write.parquet(f"{base}/blocks")
    blocks = spark.read.parquet(f"{base}/blocks")
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    ordered.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "dims", "v", "grp")).alias("x")).select("anchor_id", "x.*").write.parquet(f"{base}/anchors")
    anchors = spark.read.parquet(f"{base}/anchors")
    window = lambda ask, low, high: F.struct(ask.cast("bigint").alias("ask"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    whole = F.array(window(F.lit(0), F.lit(int(LOWEST)), F.lit(int(HIGHEST))))
    found = searched(blocks, anchors.withColumn("asks", whole), groups, positives, True, tuple(size))
    found.select("anchor_id", F.col("rank").cast("bigint").alias("ask"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).write.parquet(f"{base}/positives")
    pairs = spark.read.parquet(f"{base}/positives")
    # Whole scores s with low * p <= 100 * s <= high * p, without products that could wrap.
    low = F.expr(f"positive_score div 100 * {shares[0]} + (positive_score % 100 * {shares[0]} + 99) div 100")
    high = F.expr(f"positive_score div 100 * {shares[1]} + (positive_score % 100 * {shares[1]}) div 100")
    windows = pairs.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(window(F.col("ask"), low, high)).alias("asks"))  # at most ``positives`` each
    met = searched(blocks, anchors.join(windows, "anchor_id"), groups, negatives, False, tuple(size))
    out = met.join(pairs, ["anchor_id", "ask"]).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
