"""Personal data: fixed patterns, then bootstrapped contextual extraction, in DataFrame operations alone.

Identifiers that the fixed patterns find are seeds. The words before them are lexical patterns; patterns and
identifier-like strings form a graph on which scores go back and forth: a pattern is as good as the strings
that it introduces, a string as good as the best patterns that introduce it. Patterns of high confidence
then add the strings which the fixed patterns miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.llm.storage import cut

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the fixed patterns, which match the same strings without backtracking; a match starts a run of its characters, or where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Digits in groups: set apart by single spaces, points or hyphens, a group may stand in brackets.
GROUPED = r"(?<![A-Za-z0-9._%+@/-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{2,5}[\x20.-]\(?)[0-9]{2,5}\)?(?:[\x20.-]\(?[0-9]{2,5}\)?){0,5}(?![A-Za-z0-9_%+@/-])"
#: An identifier-like string: digits in groups, or a run of these characters with a digit or @ in it.
CANDIDATE = GROUPED + r"|(?<![A-Za-z0-9._%+@/-])(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9._%+@/-]++"
LEAST_CHARS = 5
CONTEXT_CHARS = 48


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.when((F.length(digits) - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "email":
        return F.lit(True)
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, F.concat(F.lit("0"), p)).cast("int"), F.lit(999)) <= 255))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def located(text: Column, pattern: str, hint: str) -> Column:
    """All matches as array<struct<start, end, text>> in code points, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("text")))
    kind = "array<struct<start:int,end:int,text:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["text"].alias("text")))).cast(kind).alias("out"))
    return F.when(text.rlike(hint), F.aggregate(sizes, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base: array<struct<start, kind_no, end, kind>> of what the fixed patterns find, by start, then kind."""
    kind = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
    def kept(i: int, k: str) -> Column:
        sound = F.filter(f"__{k}", lambda s: valid(k, s["text"]))
        return F.transform(sound, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind_no"), s["end"].alias("end"), F.lit(k).alias("kind")))

    for i, k in enumerate(KINDS):
        docs = docs.withColumn(f"__{k}", located(F.col(text), PATTERNS[k], HINTS[k]))
        docs = docs.withColumn(f"__{k}", kept(i, k).cast(kind))
    return docs.withColumn("base", F.array_sort(F.concat(*[F.col(f"__{k}") for k in KINDS]))).drop(*[f"__{k}" for k in KINDS])


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds mentions: array<struct<start, end, instance, left>> of base spans, whole, and of identifier-like strings of at least five characters outside them, with up to two words before each."""
    docs = docs.withColumn("__found", located(F.col(text), CANDIDATE, "[0-9@]"))
    outside = F.filter("__found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    whole = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.substring(F.col(text), b["start"] + 1, b["end"] - b["start"]).alias("text")))
    docs = docs.withColumn("__found", F.concat(whole, outside))
    left = lambda s: F.substring(F.col(text), F.greatest(F.lit(1), s["start"] - (CONTEXT_CHARS - 1)), F.least(s["start"], F.lit(CONTEXT_CHARS)))
    words = lambda s: F.regexp_extract(F.concat(F.lit(" "), F.lower(left(s))), r"[\s\"'(<\[|]((?:[^\s\"'(<\[|]+[\s\"'(<\[|]+)?[^\s\"'(<\[|]+)[\s\"'(<\[|]*$", 1)
    named = F.transform("__found", lambda s: F.struct(s["start"].alias("start"), (s["end"] - F.length(s["text"]) + F.length(F.rtrim(s["text"], F.lit("./-")))).alias("end"), F.lower(F.rtrim(s["text"], F.lit("./-"))).alias("instance"), F.regexp_replace(words(s), r"[\s\"'(<\[|]+", " ").alias("left")))
    return docs.withColumn("mentions", F.filter(named, lambda m: (F.length(m["instance"]) >= LEAST_CHARS) & (m["left"] != ""))).drop("__found")


def fits(kind: Column, instance: Column) -> Column:
    """Whether a string can be an identifier of a kind."""
    return F.when(kind == "email", instance.contains("@")).otherwise(F.length(F.regexp_replace(instance, "[^0-9]", "")) >= LEAST_CHARS)


def confident(edges: DataFrame, rounds: int, confidence: float, least_seeds: int) -> DataFrame:
    """(pattern, kind, score) of the patterns that reach ``confidence`` after seeds and patterns have gone round the graph.

    edges: distinct (pattern, instance, kind of a seed or null). In each round a pattern's score for a kind is the belief
    in its seeds of that kind over its strings, with half a string of doubt, and at least ``least_seeds`` different
    seeds must stand behind it. A string that is no seed is believed to be of a kind by 1 - product(1 - score) over its
    confident patterns; from ``confidence`` on, and if it can be of that kind, it is a seed of the next round, with its
    belief as its weight.
    """
    size = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    given = edges.where("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("weight"))
    loose = edges.where("kind is null").select("pattern", "instance")
    seeds = given
    for k in range(rounds):
        known = seeds.groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("good"), F.sum("weight").alias("mass")).where(F.col("good") >= least_seeds)
        patterns = known.join(size, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + 0.5)).alias("score")).where(F.col("score") >= confidence)
        if k < rounds - 1:
            beliefs = loose.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("weight"))
            best = beliefs.where((F.col("weight") >= confidence) & fits(F.col("kind"), F.col("instance"))).groupBy("instance").agg(F.max(F.struct("weight", "kind")).alias("m"))
            seeds = given.unionByName(loose.join(best, "instance").select("pattern", "instance", "m.kind", "m.weight"))
    return patterns.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("m")).select("pattern", F.col("m.kind").alias("kind"), F.col("m.score").alias("score"))


def personal_data(docs: DataFrame, rounds: int = 3, confidence: float = 0.5, least_seeds: int = 3) -> DataFrame:
    """doc_id, base and found: spans of the fixed patterns and those that confident contexts add, for every row.

    Spans are array<struct<start, kind_no, end, kind>> in code points, end exclusive, by start, then kind. A
    null or empty text has none; repeated rows get the same spans each; an empty table gives no rows; other
    columns are left out. What contexts add never overlaps a base span. Whole texts are read, once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = mentions(base_spans(rows))
    rows = cut(rows.select("doc_id", F.xxhash64("text").alias("__h"), F.length("text").alias("__n"), "base", "mentions"))
    each = rows.where(F.size("mentions") > 0).select("doc_id", "__h", "__n", "base", F.explode(F.array_distinct("mentions")).alias("m"))
    hit = F.filter("base", lambda b: (b["start"] < F.col("m.end")) & (b["end"] > F.col("m.start")))
    each = each.select("doc_id", "__h", "__n", "m", F.get(hit, F.lit(0))["kind"].alias("kind"))
    each = each.withColumn("pattern", F.explode(F.array_distinct(F.array(F.col("m.left"), F.element_at(F.split("m.left", " "), -1)))))
    edges = each.groupBy("pattern", F.col("m.instance").alias("instance")).agg(F.max("kind").alias("kind"))
    good = confident(edges, rounds, confidence, least_seeds)
    added = each.where("kind is null").drop("kind").join(good, "pattern")
    added = added.where(fits(F.col("kind"), F.col("m.instance"))).groupBy("doc_id", "__h", "__n", "m.start", "m.end").agg(F.max(F.struct("score", "kind")).alias("best"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("best.kind")).cast("int") - 1
    span = F.struct("start", number.alias("kind_no"), "end", F.col("best.kind").alias("kind"))
    added = added.groupBy(F.col("doc_id").alias("__id"), F.col("__h").alias("__h2"), F.col("__n").alias("__n2")).agg(F.array_sort(F.collect_list(span)).alias("found"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__h2")) & (F.col("__n") == F.col("__n2"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    return rows.join(added, same, "left").select("doc_id", "base", F.coalesce("found", empty).alias("found"))


def count_of(spans: str, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
