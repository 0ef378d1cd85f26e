"""Document fingerprints by SpotSigs, in DataFrame operations alone.

A spot signature is a common word (the anchor) with the chain of the next content words, common words
skipped. Signatures survive changes around the running prose. Sets of signatures are split by size, since
sets of unlike size can't be alike, and compared by their Jaccard likeness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish, the anchors.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his if in is it its not of on or she that the their there they this to was were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für im ist mit nach nicht sich sie sind so um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "al como con cuando del donde el ella entre era esta este ha hay las lo los más me mi muy no para pero por se ser si sin sobre su sus también te una y ya"
)
CHAIN = 2
#: Every fingerprint holds so many least hashes of the text's words beside its signatures, so that texts with few common words are told apart as well.
LEAST = 64
#: In near_pairs, a text with fewer signatures than this is told by its runs of four characters as well.
FEW = 4
MARK = "\u0001"


def trie(words: list[str]) -> str:
    """A pattern for any of the words that reads each character once."""
    root: dict = {}
    for w in words:
        at = root
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        branches = [ch + pattern(below) for ch, below in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return f"(?:{body})?+" if "" in node else body

    return pattern(root)


def with_signatures(rows: DataFrame, columns: dict[str, str], chain: int = CHAIN, least: int = 0) -> DataFrame:
    """Adds for each (name, text column) the sorted, distinct 32-bit signatures of the whole text (null: empty), with its ``least`` smallest hashes of words.

    The steps are columns of their own, so that none is worked out twice.
    """
    step = rf"(?: {MARK}[^ ]++)*+ [^ {MARK}]++"
    spot = rf" (?=({MARK}[^ ]++(?:{step}){{{chain}}})(?: |$)){MARK}"
    for name, text in columns.items():
        plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " ")))
        # Common words are marked; immediate repeats of one add no signature.
        marked = F.regexp_replace(plain, rf" (?={trie(ANCHORS.split())}(?: |$))", f" {MARK}")
        marked = F.regexp_replace(marked, rf"( {MARK}[^ ]++)(?:\1(?= |$))++", "$1")
        rows = rows.withColumn("__marked", marked).withColumn("__spots", F.regexp_extract_all("__marked", F.lit(spot), F.lit(1)))
        hashes = F.transform("__spots", lambda s: F.hash(F.regexp_replace(s, rf" {MARK}[^ ]++", "")))
        if least:
            words = F.transform(F.filter(F.array_distinct(F.split(F.regexp_replace("__marked", MARK, ""), " ")), lambda w: w != ""), lambda w: F.hash(w))
            hashes = F.concat(hashes, F.slice(F.sort_array(words), 1, least))
        rows = rows.withColumn(name, F.sort_array(F.array_distinct(hashes))).drop("__marked", "__spots")
    return rows


def few(signatures: Column) -> Column:
    """Whether signatures alone are too few to tell a text by, as of one without common words."""
    return F.size(signatures) < FEW


def with_runs(signatures: Column, text: Column) -> Column:
    """Signatures and the hashed runs of four characters of a text, sorted and distinct; a text of one to three characters is its own run."""
    low = F.lower(F.coalesce(text, F.lit("")))
    grams = F.concat(F.regexp_extract_all(low, F.lit(r"(?s)(?=(.{4}))."), F.lit(1)), F.when(F.length(low).between(1, 3), F.array(low)).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(signatures, F.transform(grams, lambda w: F.hash(w)))))


def print_of(signatures: Column, text: Column) -> Column:
    """What near_pairs compares of a text."""
    return F.when(few(signatures), with_runs(signatures, text)).otherwise(signatures)


def fingerprint(signatures: Column) -> Column:
    """A printable fingerprint: the signatures in order; empty for a text without words."""
    return F.array_join(signatures.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature arrays, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] | None = None, derived: tuple[str, ...] = (), parts: int = 1024) -> DataFrame:
    """Adds next_<column> of the next document in descending doc_id (after the last: the first) for each given column.

    derive adds columns ``derived`` to the rows, next_<column> included, where they lie; their own next ones
    are then added as well, without dealing the rows anew.

    Rows are dealt to ``parts`` ranges of doc_id by approximate quantiles, which are values of the column:
    each range ends at one of them, so that the row which follows a range is known to sit at its upper
    neighbour's end, and goes to both. Null ids come last; rows of one id follow by a hash of the columns.
    A single row is its own next.
    """
    spark = docs.sparkSession
    ids = docs.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts)], 10 * parts).alias("q"), F.max("doc_id").alias("top")).first()
    # At most ``parts`` numbers, whatever the rows.
    ends = sorted({*(ids["q"] or ()), *([ids["top"]] if ids["top"] is not None else ())})
    step = max(1, int(len(ends) ** 0.5))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    tops = F.array(*[F.lit(g[-1]).cast(kind) for g in groups])
    rows = docs.withColumn("__g", F.size(F.filter(tops, lambda e: e < F.col("doc_id"))))
    inner = F.array(*[F.array(*[F.lit(x).cast(kind) for x in g]) for g in groups]) if groups else None
    if inner is None:
        rows = rows.withColumn("__part", F.lit(-1))
    else:
        place = F.col("__g") * step + F.size(F.filter(F.get(inner, F.col("__g")), lambda e: e < F.col("doc_id")))
        rows = rows.withColumn("__part", F.coalesce(place, F.lit(-1)).cast("int"))
    # -1: null ids, after the lowest range. A range's last row is followed by the first of the next lower one, the last of all by the first of all.
    chain = [*range(len(ends) - 1, -1, -1)]
    has_null = bool(docs.where(F.col("doc_id").isNull()).take(1))
    chain += [-1] if has_null else []
    above = {p: chain[i - 1] for i, p in enumerate(chain)}
    at_end = F.coalesce(F.get(F.flatten(inner), F.col("__part")) == F.col("doc_id"), F.lit(False)) if inner is not None else F.lit(False)
    to = F.get(F.array(*[F.lit(above.get(p, -2)) for p in range(-1, len(ends))]), F.col("__part") + 1)
    serves = at_end | F.col("doc_id").isNull() if has_null else at_end
    homes = F.when(serves, F.array(F.struct(F.col("__part").alias("p"), F.lit(0).alias("late")), F.struct(to.alias("p"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("__part").alias("p"), F.lit(0).alias("late"))))
    rows = rows.withColumn("__home", F.explode(homes)).withColumn("__tie", F.xxhash64(*columns))
    # Plain columns: windows over a nested one would each deal the rows anew.
    rows = rows.select("*", F.col("__home.p").alias("__p"), F.col("__home.late").alias("__late")).drop("__g", "__part", "__home")
    order = Window.partitionBy("__p").orderBy("__late", F.col("doc_id").desc_nulls_last(), "__tie")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    if derive is not None:
        rows = derive(rows)
        for c in derived:
            rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where("__late = 0").drop("__p", "__late", "__tie")


def edited_fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, text, edited, the prints own, changed (of edited), next_own (of the next document), and the likenesses near_edited and near_next (to the next document).

    edited is the text whose last third of characters is replaced by as many first ones of the next document,
    in descending doc_id and after the last the first. A print holds signatures and the least hashes of words, of every
    text alike; the likenesses are those of the prints told. Null texts are empty; repeated rows stay.
    """

    def derive(rows: DataFrame) -> DataFrame:
        third = F.floor(F.length("text") / 3).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
        return with_signatures(rows.withColumn("edited", edited), {"own": "text"}, chain, LEAST)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_signatures(with_next(rows, ["text"], derive, ("own",)), {"changed": "edited"}, chain, LEAST)
    own, changed, after = (F.col(x) for x in ("own", "changed", "next_own"))
    return rows.select("doc_id", "text", "edited", "own", "changed", "next_own", likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """Pairs (a < b, likeness) of fingerprints of at least ``threshold`` likeness, with the least doc_id of each fingerprint.

    Equal fingerprints are one member. Sets are split by size into ranges that grow by 1 / threshold: alike sets
    lie in one range or in two neighbours. Of a set, ordered by signature, the first size - ceil(threshold * size) + 1
    signatures suffice to find every alike set (prefix filter); sizes prune before sets are compared.
    """
    sets = with_signatures(docs.select("doc_id", "text"), {"sig": "text"}, chain).withColumn("sig", print_of(F.col("sig"), F.col("text"))).drop("text")
    sets = sets.where(F.size("sig") > 0).groupBy(F.sha2(fingerprint(F.col("sig")), 256).alias("key")).agg(F.min(F.struct("doc_id", "sig")).alias("m")).select(F.col("m.doc_id").alias("id"), F.col("m.sig").alias("sig"))
    n = F.size("sig")
    sets = sets.withColumn("n", n).withColumn("range", F.floor(F.log(n.cast("double")) / -F.log(F.lit(threshold)) + 1e-9))
    prefix = F.slice("sig", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    tokens = sets.select("id", "n", "range", F.explode(prefix).alias("token"))
    probes = tokens.withColumn("range", F.explode(F.array(F.col("range"), F.col("range") - 1)))
    left, right = tokens.alias("l"), probes.alias("r")
    pairs = left.join(right, ["token", "range"]).where((F.col("l.id") != F.col("r.id")) & (F.col("l.n") >= threshold * F.col("r.n")) & (F.col("r.n") >= threshold * F.col("l.n")))
    pairs = pairs.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
