"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length: a bucket holds lengths within five per cent of each other. A first pass over a
few of the longest vectors gives every query a floor under its k-th score; a query then visits only buckets
whose length can reach that floor. Within a bucket the floor becomes a cosine threshold: where it is high,
candidates are pruned by one coordinate (the query's largest), else by their own length; products of what is
left are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket's longest length over its shortest.
GROWTH = 1.05
#: Rows of one block of a bucket, about, and of one block of queries.
BLOCK_ROWS = 4096
#: The longest vectors that all queries see first.
PILOTS = 2048
#: From this cosine on, candidates are pruned by coordinate, else by length.
COORDINATE_FROM = 0.6
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as long; null where the vector is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda v: F.floor(v * factor)))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all pairs, exact: in floating point where no sum can pass 2**53, else in integers."""
    most = max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(rows).max(initial=0))) * max(1, rows.shape[1])
    if most < 2.0**53:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def searched(block: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query, without those that can't reach the query's floor."""
    out = []
    if len(block) and len(queries):
        ids, rows, lengths = block["vec_id"].to_numpy(), np.array(block["v"].tolist(), np.int64), block["length"].to_numpy(float)
        order = np.lexsort((ids, -lengths))
        ids, rows, lengths = ids[order], rows[order], lengths[order]
        unit = rows / np.maximum(lengths, 1e-300)[:, None]
        for qid, q, q_length, floor in zip(queries["query_id"], queries["v"], queries["length"], queries["floor"], strict=True):
            q = np.asarray(q, np.int64)
            live = slice(None)
            if not np.isnan(floor) and q_length > 0 and floor > 0:
                cosine = floor / (q_length * lengths[0]) * (1 - 1e-9) if lengths[0] > 0 else 2.0
                if cosine > 1:
                    continue
                if cosine >= COORDINATE_FROM:
                    # With cosine c between unit vectors, a coordinate x of the query bounds that of the candidate.
                    f = int(np.abs(q).argmax())
                    x = q[f] / q_length
                    slack = np.sqrt(max(0.0, 1 - cosine**2) * max(0.0, 1 - x * x)) + 1e-9
                    live = np.flatnonzero(np.abs(unit[:, f] - cosine * x) <= slack) if abs(x) <= cosine else np.flatnonzero((unit[:, f] * np.sign(x)) >= cosine * abs(x) - slack)
                else:
                    live = slice(0, int(np.searchsorted(-lengths, -floor / q_length * (1 - 1e-9), side="right")))
            here = ids[live]
            scores = products(q[None, :], rows[live])[0] if len(here) else np.zeros(0, np.int64)
            other = here != qid
            here, scores = here[other], scores[other]
            for i in best_of(scores, here, k):
                out.append((qid, here[i], scores[i]))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, factor: int = 256, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own. Rows
    with a null vec_id, a null vector or one with null or non-finite components take no part; vectors of
    another size than the query's neither (sizes are searched apart). With fewer than k candidates all are
    returned. Repeated rows count each, but for those of the query's own id. Other columns are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col(vector), factor).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.withColumn("dims", F.size("v")).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    rows = rows.withColumn("bucket", F.when(F.col("length") > 0, F.floor(F.log("length") / F.log(F.lit(GROWTH)))).otherwise(-1_000_000))
    sizes = rows.groupBy("dims", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "dims", "length")

    # First pass: the longest vectors, at most PILOTS rows, lie beside every block of queries.
    pilots = rows.orderBy(F.desc("length"), "vec_id").limit(PILOTS).toPandas()

    def floored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floors = np.full(len(batch), np.nan)
            for dims, own in pilots.groupby("dims"):
                at = np.flatnonzero(batch["dims"] == dims)
                if len(at):
                    scores = products(np.array(batch["v"].iloc[at].tolist(), np.int64), np.array(own["v"].tolist(), np.int64))
                    same = batch["query_id"].to_numpy()[at][:, None] == own["vec_id"].to_numpy()[None, :]
                    for i, s, other in zip(at, scores, ~same, strict=True):
                        s = s[other]
                        if len(s) >= k:
                            floors[i] = np.partition(s, len(s) - k)[len(s) - k]
            yield batch.assign(floor=floors)

    asked = asked.mapInPandas(floored, "query_id bigint, v array<bigint>, dims int, length double, floor double")
    # A query goes to the blocks of those buckets whose longest length reaches its floor.
    reach = asked.join(sizes, "dims").where(F.isnan("floor") | (F.col("floor") <= 0) | (F.col("length") * F.col("top") >= F.col("floor") * (1 - 1e-9)))
    reach = reach.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    blocks = rows.join(sizes.select("dims", "bucket", "blocks"), ["dims", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # Blocks of queries: what one task holds of them is bounded as well.
    parts = F.broadcast(asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("query_parts")))  # one row per vector size
    reach = reach.join(parts, "dims").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int"))
    blocks = blocks.join(parts, "dims").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    keys = ["dims", "bucket", "block", "part"]
    found = blocks.select(*keys, "vec_id", "v", "length").groupBy(*keys).cogroup(reach.select(*keys, "query_id", "v", "length", "floor").groupBy(*keys))
    found = found.applyInPandas(lambda block, queries: searched(block, queries, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
