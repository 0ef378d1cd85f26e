"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Each document draws an exponential key scaled by its quality weight. A source's target is met by as many
complete epochs as fit, then by its documents in the order of their keys until the words left are taken.
The running sum within a source is taken in two levels (key ranges, then rows within one range), so that a
source of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.llm.storage import cut

#: Key ranges for each doubling of the key: whatever the quality weights, which stretch keys, one holds a few ten-thousandths of a source's rows.
RANGES = 1024
WEIGHTS = (5, 2, 1)
CAP = 3
SPACE = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A quality weight from 0.05 to 1: the share of letters among the characters that aren't white space."""
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.when(solid > 0, solid)), F.lit(0.05))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1), the same in every run, from the first 52 bits of an MD5 of seed and doc_id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, budget: float | None = None) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share ``budget`` words (None: all).
    A target stops at ``cap`` times its source's size; the excess goes to the others by weight until none is
    above. That ends where target = min(cap * size, rate * weight) with one rate: sources are capped in the
    order of cap * size / weight, and the rate is that of the first number of capped sources it leaves below.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("__cap", F.col("source_size").cast("double") * cap).withColumn("__at", F.col("__cap") / F.col("weight"))
    all_rows = Window.partitionBy()
    upto = Window.orderBy("__at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(all_rows).cast("double")
    below = F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))
    heavy = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    rows = rows.withColumn("__rate", F.greatest(F.lit(0.0), total - below) / heavy)
    # The rate if only the sources before this one are capped; it holds for the first source that it leaves at or below its cap.
    rate = F.min(F.when(F.col("__rate") <= F.col("__at"), F.struct("__at", "__rate"))).over(all_rows)["__rate"]
    return rows.withColumn("target", F.coalesce(F.least(F.col("__cap"), rate * F.col("weight")), F.col("__cap"))).drop("__cap", "__at", "__rate")


def mixed(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 17, budget: float | None = None) -> DataFrame:
    """The mix of documents (doc_id, text, source): doc_id, source, __h (a hash of the text), size, source_size, target, taken of every row.

    taken: words that the mix takes of the document, repeats counted: its size for every complete epoch of
    its source, and once more if it is drawn for the rest; the last document drawn gives only the words still
    needed, so that a source's taken words are its target rounded down. weight: a positive quality weight
    per row (None: the share of letters). Documents without words take nothing; a null source is a source
    of its own; documents of equal key are ordered by doc_id, then by the hash. Repeated rows are drawn each
    for itself; an empty table gives no rows; other columns are left out.
    """
    w = F.coalesce(weight if weight is not None else letter_share(F.col("text")), F.lit(0.0))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.greatest(w, F.lit(1e-9))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("__h"), words(F.col("text")).alias("size"), key.alias("__key"))
    rows = cut(rows)  # texts are read once; these rows are a few numbers each
    # An increasing function of the key that spreads the rows of any source.
    rows = rows.withColumn("__range", F.floor(F.log2("__key") * RANGES)).withColumn("__null", F.col("source").isNull()).withColumn("__source", F.coalesce("source", F.lit("")))
    parts = rows.groupBy("__null", "__source", "__range").agg(F.sum("size").alias("__words"))
    sizes = parts.groupBy("__null", "__source").agg(F.sum("__words").alias("source_size"))
    plan = targets(sizes.withColumn("source", F.when(~F.col("__null"), F.col("__source"))), weights, cap, budget).drop("source", "weight")
    before = Window.partitionBy("__null", "__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__base", F.coalesce(F.sum("__words").over(before), F.lit(0))).drop("__words")
    parts = parts.join(plan, ["__null", "__source"])
    own = Window.partitionBy("__null", "__source", "__range").orderBy("__key", "doc_id", "__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum("size").over(own)).join(parts, ["__null", "__source", "__range"])
    words_left = F.floor(F.col("target")) - F.col("__epochs") * F.col("source_size") - (F.col("__base") + F.col("__upto") - F.col("size"))
    rows = rows.withColumn("__epochs", F.coalesce(F.floor(F.floor(F.col("target")) / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    rows = rows.withColumn("taken", (F.col("__epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), words_left))).cast("long"))
    return rows.select("doc_id", "source", "__h", "size", "source_size", "target", "taken")


def mixed_corpus(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents themselves, all columns kept: each as often as it was taken; one taken in part gives its first words.

    Rows of equal doc_id, source and text are taken together; n_chars, if there, follows the text.
    """
    mix = mixed(docs, **settings).where("taken > 0").groupBy("doc_id", "source", "__h").agg(F.max("size").alias("__size"), F.sum("taken").alias("__taken"))
    m = mix.select(*[F.col(c).alias(f"__m{c}") for c in ("doc_id", "source", "__h")], "__size", "__taken")
    rows = docs.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "__h"])
    same = F.col("doc_id").eqNullSafe(F.col("__mdoc_id")) & F.col("source").eqNullSafe(F.col("__msource")) & (F.col("__h") == F.col("__m__h"))
    rows = rows.join(m, same).withColumn("__whole", F.floor(F.col("__taken") / F.col("__size")).cast("int"))
    rows = rows.withColumn("__pattern", F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), (F.col("__taken") % F.col("__size")).cast("string"), F.lit("}+")))
    part = F.expr("CASE WHEN __taken % __size > 0 THEN array(regexp_extract(text, __pattern, 0)) ELSE array() END")
    rows = rows.withColumn("__copies", F.concat(F.array_repeat(F.col("text"), F.col("__whole")), part)).withColumn("text", F.explode("__copies"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)
