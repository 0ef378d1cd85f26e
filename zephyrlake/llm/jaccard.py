"""Near duplicates by a chosen-path join on word shingles.

A document's set of five-word shingles is embedded by min-hashes, so that two sets agree at a place with the
probability of their Jaccard similarity. In each run a set is sent to the buckets of those (place, value) pairs
that a random choice of the run picks, about 1 / similarity of them; large buckets are split again by further
choices along the path, small ones are compared in full. A pair of the wanted similarity survives a level with
the chance of a branching process, and runs are repeated until the wanted recall. What stays large after the
last level is compared in cells of bounded size, so nothing is dropped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrlake.llm import graph
from zephyrlake.llm.lines import FILTER_BITS, bit_filter
from zephyrlake.llm.storage import cut, tidy, turn_to

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Places of the embedding.
PLACES = 64
LEVELS = 3
#: Buckets of more sets than this are dealt to parts of this size, and split again if they hold several components.
SMALL = 128
#: One node in so many is worked on first.
FIRST = 4
#: Sets that are compared in full in one cell, about.
CELL = 512
#: Leaders of a larger component in the first round, eight times as many in each round after it.
LEADERS = 512
#: A set counts as one more of its cell for every so many shingles, which bounds what a cell holds.
CELL_SHINGLES = 1024
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of 64-bit shingle hashes; hashes of words are kept for the next texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def of(self, text: str) -> np.ndarray:
        """Distinct shingles of a whole text, ascending: runs of lower-case words, or all words of a shorter text; empty without words."""
        import xxhash

        if len(self.known) > 200_000:
            self.known = {}
        known = self.known
        words = text.lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, np.uint64(n))
            for i in range(n):
                out = (out + h[i : len(h) - n + 1 + i]) * ODD
                out ^= out >> np.uint64(29)
        return np.unique(mixed(out))


def min_hashes(shingles: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The embedding: for each place the least value of the shingles under a hash of its own."""
    out = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        odd = mixed(np.arange(1, places + 1, dtype=np.uint64)) | np.uint64(1)
        for i in range(0, len(shingles), 4096):
            part = shingles[i : i + 4096, None] * odd[None, :]
            part ^= part >> np.uint64(32)
            np.minimum(out, (part * MIX[0]).min(axis=0), out=out)
    return out


def sketch(embedded: np.ndarray) -> bytes:
    """One byte of each place: two sets agree at a place as their min-hashes do, or by a chance of 1 in 256.

    Least values have few high bits set, so they are scrambled before a byte is taken.
    """
    return (mixed(embedded) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_agreement(similarity: float) -> float:
    """Places at which sketches of similar sets agree at least: three and a quarter deviations below the mean (all but 6 in 10,000)."""
    return similarity * PLACES - 3.25 * math.sqrt(PLACES * similarity * (1 - similarity))


def likely_edges(key: np.ndarray, ids: np.ndarray, sketches: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """(a, b): edges that connect what likely pairs of one key connect; rows come sorted by key, and those of one id are connected from the start.

    All rows are compared with those d places on, for every d up to the largest key.
    """
    order = np.lexsort((ids, key))
    first = np.append(True, (key[order][1:] != key[order][:-1]) | (ids[order][1:] != ids[order][:-1]))[: len(key)]
    label = np.arange(len(key))
    label[order] = order[first][np.cumsum(first) - 1]

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for d in range(1, len(key)):
        at = np.flatnonzero(key[d:] == key[:-d])
        if not len(at):
            break
        for part in np.array_split(at, max(1, len(at) // 100_000)):
            # What is connected already needs no look.
            part = part[label[part] != label[part + d]]
            hit = part[(sketches[part] == sketches[part + d]).sum(axis=1) >= least_agreement(similarity)]
            for i in hit.tolist():
                label[find(i)] = find(i + d)
            if len(hit):
                while (label != label[label]).any():
                    label = label[label]
    low = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    low = low[label]
    # An edge for each id, however many rows it has.
    new = order[first & (low != ids)[order]]
    return low[new].tolist(), ids[new].tolist()


def chosen(node: np.ndarray, embedded: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the children of each node that its set's places choose; node and embedded have a row per set and node."""
    places = embedded.shape[1]
    with np.errstate(over="ignore"):
        at = np.arange(1, places + 1, dtype=np.uint64) * ODD
        child = mixed(mixed(node[:, None] + at[None, :]) ^ embedded)
        draw = mixed(child + np.uint64(0x632BE59BD9B4E019))
    picked = draw < np.uint64(min(1.0, 1 / (similarity * places)) * 2.0**64 * (1 - 1e-12))
    rows, cols = np.nonzero(picked)
    return rows, child[rows, cols]


def survival(levels: int) -> float:
    """The chance that a pair of just the wanted similarity, which shares one child of a node on average, meets after so many levels, each of which splits."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, levels: int) -> int:
    """Runs after which a pair has met with the wanted chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def shingle_sets(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, runs: int = 0) -> DataFrame:
    """doc_id, __h (hash of the text), set_id, size, nodes, sketch: the id of each document's shingle set (null without words), its number of shingles, its first-level nodes of all runs, and its sketch."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("jaccard")
        shingles = Shingles(words)
        starts = mixed(np.arange(1, runs + 1, dtype=np.uint64) * ODD)
        for batch in batches:
            ids, sizes, nodes, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles.of(text)
                ids.append(set_id(s))
                sizes.append(len(s))
                embedded = min_hashes(s)
                nodes.append(np.unique(chosen(starts, np.broadcast_to(embedded, (runs, PLACES)), similarity)[1]).view(np.int64) if len(s) else None)
                sketches.append(sketch(embedded))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__h"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(nodes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "__h", "set_id", "size", "nodes", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(made), f"doc_id {kind}, __h bigint, set_id bigint, size int, nodes array<bigint>, sketch binary")


def set_id(shingles: np.ndarray) -> int | None:
    """A 63-bit id of a set; equal texts have equal ids."""
    if not len(shingles):
        return None
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def near(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Square matrix of which sets are at least so similar, by counting common shingles all at once; those of one set alone only count in sizes."""
    sizes = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    met = times[place] > 1
    place, owner, values = (np.cumsum(times > 1) - 1)[place[met]], owner[met], int((times > 1).sum())
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, 8_000_000 // max(1, len(sets)))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, values, step):
        i, j = np.searchsorted(place, [low, low + step])
        table = np.zeros((len(sets), min(step, values - low)), np.float32)
        table[owner[i:j], place[i:j] - low] = 1
        common += table @ table.T
    return common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-4


def forest(ids: np.ndarray, close: np.ndarray) -> pd.DataFrame:
    """Edges that connect what a symmetric matrix connects, one less than each component has members."""
    label = np.full(len(ids), -1)
    out = []
    for start in range(len(ids)):
        if label[start] >= 0:
            continue
        label[start], front = start, [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(close[i] & (label < 0))
            label[new] = start
            out += [(ids[i], ids[j]) for j in new]
            front += new.tolist()
    return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def shingles_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set_id, shingles (as bytes) of the wanted sets; wanted: (id), hashes of one text of each.

    A bit table of fixed size says which texts are wanted, so that those of others aren't worked on; what it lets
    through besides does no harm.
    """
    table = bit_filter(wanted)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("h").to_numpy() >> 7 & ((1 << FILTER_BITS) - 1)
            hits = np.flatnonzero(table[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1))
            for part in np.array_split(hits, max(1, len(hits) // 256)):
                ids, sets = [], []
                for text in batch.column("text").take(pa.array(part, pa.int64())).to_pylist():
                    x = shingles.of(text)
                    i = set_id(x)
                    if i is not None and i not in seen:
                        ids.append(i)
                        sets.append(x)
                        if len(seen) < 100_000:
                            seen.add(i)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["set_id", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(tidy(made), "set_id bigint, shingles binary")
    return rows.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def crowded(nodes: DataFrame) -> DataFrame:
    """Rows of nodes with two sets or more, with n, the number of sets; a lone set has nothing to meet."""
    counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return nodes.join(counts, "node")


def linked_by_sketches(nodes: DataFrame, similarity: float, small: int) -> DataFrame:
    """Edges (a, b) between the classes that likely pairs of a node (node, set_id, class, sketch, n) connect; a node of more than ``small`` sets is dealt to parts."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, PLACES), np.uint8))
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, PLACES)
                held = tuple(np.concatenate(x) for x in zip(held, (batch.column("node").to_numpy(), batch.column("class").to_numpy(), rows), strict=True))
            # The last key of a batch may go on in the next.
            end = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            a, b = likely_edges(*(x[:end] for x in held), similarity)
            held = tuple(x[end:] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    part = F.pmod(F.xxhash64("node", "set_id"), F.ceil(F.col("n") / small))
    rows = nodes.select(F.when(F.col("n") > small, F.xxhash64("node", part)).otherwise(F.col("node")).alias("node"), "class", "sketch")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(tidy(grouped), "a bigint, b bigint")


def candidate_classes(sets: DataFrame, similarity: float, levels: int, small: int = SMALL) -> DataFrame:
    """(id, component) of every set that a bucket shows to be likely near another, by sketches; components are compared in full later.

    sets: (set_id, nodes, sketch), each set once.
    """
    nodes = crowded(sets.select("set_id", F.explode("nodes").alias("node")))
    nodes = cut(nodes.join(sets.select("set_id", "sketch"), "set_id").select("node", "set_id", "sketch", "n"))
    large = nodes.where(F.col("n") > small)
    # A large node is split by one place that its path chooses, a very large one again, while levels last.
    below = F.col("node")
    for level in range(1, levels):
        child = F.xxhash64(below, F.substring("sketch", F.pmod(F.xxhash64(below), F.lit(PLACES)).cast("int") + 1, F.lit(1)))
        below = F.when(F.col("n") > small * 16 ** (level - 1), child).otherwise(below)
    large = cut(crowded(large.select(below.alias("node"), "set_id", "sketch")))
    rows = nodes.where(F.col("n") <= small).union(large.select(nodes.columns))

    # Members of a large group meet in most of their nodes: where the first nodes have connected them, the others need only tell what connects different classes.
    early = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(FIRST)) == 0
    classes = graph.components(cut(linked_by_sketches(rows.where(early).withColumn("class", F.col("set_id")), similarity, small)))
    # Large ones of the first nodes were dealt to parts. Where a node holds several classes, sets outside its main one meet all its parts.
    left = rows.where(~early | (F.col("n") > small)).drop("n").join(classes.select(F.col("id").alias("set_id"), F.col("component").alias("class")), "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
    mixed_ = left.groupBy("node").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("node")
    left = cut(left.join(mixed_, "node"))
    if not left.take(1):
        return classes
    cells = graph.main_and_others(left, "node", "set_id", small).select(F.xxhash64("node", "cell").alias("node"), "set_id", "class", "sketch", F.lit(0).alias("n"))
    edges = cut(linked_by_sketches(cells, similarity, small))
    return graph.components(classes.select(F.col("component").alias("a"), F.col("id").alias("b")).union(edges)) if edges.take(1) else classes


def parts_of(cell: int) -> Column:
    """Cells that the sets of a group fill, by their sizes."""
    return F.ceil(F.sum(1 + F.floor(F.col("size") / CELL_SHINGLES)) / cell).cast("int").alias("parts")


def link_counts(classed: DataFrame, shingles: DataFrame, similarity: float, cell: int = CELL) -> DataFrame:
    """(set_id, n): how many other sets of its class (set_id, class, size) each set is near.

    All sets near a set are of its class, so a class is compared with itself, part by part: a cell holds two parts at
    most. That is exact and, in one class, quadratic in its number of different sets.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in graph.groups(batches, ["class", "cell"]):
            close = near([np.frombuffer(x, np.uint64) for x in group["shingles"]], similarity)
            np.fill_diagonal(close, False)
            part = group["part"].to_numpy()
            if (part != part[0]).any():
                close &= part[:, None] != part[None, :]
            elif group["other"].iloc[0] != part[0]:
                continue  # The other part is empty: this one is compared in a cell of its own.
            yield pd.DataFrame({"set_id": group["set_id"], "n": close.sum(axis=1).astype(np.int64)})

    parts = classed.groupBy("class").agg(parts_of(cell))
    rows = classed.join(parts, "class").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("cell", F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other"))
    rows = rows.select("class", "cell", "part", "other", "set_id").join(shingles, "set_id").repartition("class", "cell").sortWithinPartitions("class", "cell", "set_id")
    counts = rows.select("class", "cell", "part", "other", "set_id", "shingles").mapInPandas(tidy(count), "set_id bigint, n bigint")
    return counts.groupBy("set_id").agg(F.sum("n").alias("n"))


def verified(candidates: DataFrame, shingles: DataFrame, similarity: float, cell: int = CELL, leaders: int = LEADERS) -> DataFrame:
    """Edges (a, b) of near sets that connect all that near pairs of a component connect, and rows (a, a, n) of each set's number of near ones where its component fits a cell; n is 0 on edges.

    candidates: (set_id, component, size). A component that fits a cell is compared there. Of a larger one, leaders
    meet all sets; those that come next are drawn from the sets outside its largest class that have not led yet, so
    that in the end every pair of two classes has been compared.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in graph.groups(batches, ["component", "cell"]):
            close = near([np.frombuffer(x, np.uint64) for x in group["shingles"]], similarity)
            lead, ids = group["leads"].to_numpy(), group["set_id"].to_numpy()
            close &= lead[:, None] | lead[None, :]
            np.fill_diagonal(close, False)
            yield forest(ids, close).assign(n=0)
            if lead.all():
                yield pd.DataFrame({"a": ids, "b": ids, "n": close.sum(axis=1).astype(np.int64)})

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.join(shingles, "set_id").repartition("component", "cell").sortWithinPartitions("component", "cell", "set_id")
        return rows.select("component", "cell", "set_id", "leads", "shingles").mapInPandas(tidy(compare), "a bigint, b bigint, n bigint")

    parts = candidates.groupBy("component").agg(parts_of(cell))
    rows = cut(candidates.join(parts, "component"))
    edges = cut(compared(rows.where("parts = 1").withColumn("cell", F.lit(0)).withColumn("leads", F.lit(True))))
    large, led = rows.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")), None
    found, n = None, leaders
    while True:
        state = large.withColumn("class", F.col("set_id"))
        if found is not None:
            classes = graph.components(found)
            state = large.join(classes.select(F.col("id").alias("set_id"), F.col("component").alias("found")), "set_id", "left").withColumn("class", F.coalesce("found", "set_id")).drop("found")
            sizes = state.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"))
            main = sizes.groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("main"))
            state = state.join(main, "component").where("class <> main").join(led, "set_id", "left_anti")
        state = cut(state.select("component", "set_id"))
        open_ = state.groupBy("component").agg(F.count(F.lit(1)).alias("open"))
        # About n leaders of each component; all that are left where they are few.
        chance = F.when(F.col("open") <= 2 * n, F.lit(1.0)).otherwise(n / F.col("open"))
        draw = F.pmod(F.xxhash64("set_id", F.lit(n)), F.lit(1 << 30)) / float(1 << 30)
        new = cut(state.join(open_, "component").where(draw < chance).select("component", "set_id"))
        if not new.take(1):
            return edges if found is None else edges.union(found)
        lead = new.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("lead_parts"))
        own = large.join(lead, "component").join(new.select("set_id", F.lit(True).alias("leads")), "set_id", "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
        # Leaders are dealt to parts of their own, each of which meets each part of the component.
        lead_part = F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("lead_parts"))
        to = F.when(F.col("leads"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(x.alias("p"), lead_part.cast("int").alias("l"))))
        to = F.array_union(F.transform(F.sequence(F.lit(0), F.col("lead_parts") - 1), lambda x: F.struct(F.col("part").alias("p"), x.alias("l"))), F.coalesce(to, F.array().cast("array<struct<p:int,l:int>>")))
        cells = own.withColumn("to", F.explode(to)).withColumn("cell", F.col("to.p") * F.col("lead_parts") + F.col("to.l"))
        more = compared(cells.select("component", "cell", "set_id", "leads")).where("a <> b")
        found = cut(more if found is None else found.union(more))
        led = new.select("set_id") if led is None else cut(led.union(new.select("set_id")))
        n *= 8


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, levels: int = LEVELS, small: int = SMALL, cell: int = CELL, leaders: int = LEADERS, links: bool = True) -> DataFrame:
    """doc_id, __h (a hash of the text), class_id, n_links of every row of docs (doc_id, text).

    class_id: the same for all documents linked by a Jaccard similarity of at least ``similarity`` of their
    sets of ``words`` lower-case words in a row, directly or through others; equal texts are always linked. A
    text with fewer words is one shingle; texts without words are of the class null and have no links. n_links:
    how many different sets of that similarity there are besides the document's own, all of them; left out unless
    ``links``. Whole texts are read. Repeated rows, null ids and null texts (empty) are rows like others; other columns are left out.
    """
    runs = runs_for(recall, levels)
    sets = cut(shingle_sets(docs, words, similarity, runs))
    each = sets.where("set_id is not null").groupBy("set_id").agg(F.min("__h").alias("h"), F.first("size").alias("size"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"))
    each = cut(each)

    candidates = candidate_classes(each, similarity, levels, small)
    near_some = cut(each.select("set_id", "h", "size").join(candidates, each["set_id"] == candidates["id"]).select("set_id", "h", "size", "component"))
    shingles = cut(shingles_of(docs, near_some.select(F.col("h").alias("id")), words))
    found = cut(verified(near_some.drop("h"), shingles, similarity, cell, leaders))
    classes = graph.components(found.where("a <> b").select("a", "b")).select(F.col("id").alias("set_id"), F.col("component").alias("class"))
    if not links:
        rows = sets.join(classes, "set_id", "left")
        return rows.select("doc_id", "__h", F.coalesce("class", "set_id").alias("class_id"))
    counts = found.where("a = b").select(F.col("a").alias("set_id"), "n")
    # Sets of components that no cell holds have no number yet.
    left = cut(classes.join(counts, "set_id", "left_anti").join(near_some.select("set_id", "size"), "set_id"))
    if left.take(1):
        counts = counts.union(link_counts(left, shingles, similarity, cell))
    rows = sets.join(classes, "set_id", "left").join(counts, "set_id", "left")
    return rows.select("doc_id", "__h", F.coalesce("class", "set_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one of each class: the one of least doc_id (null last), of equal ones that of the least hash of text.

    Texts without words stay; rows of the same doc_id and text are kept once. All columns stay as they are.
    """
    classes = near_duplicates(docs, links=False, **settings)
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__h").alias("h"))
    first = classes.where("class_id is not null").groupBy("class_id").agg(F.min(at).alias("m"))
    kept = first.select(F.col("m.d").alias("__id"), F.col("m.h").alias("__k"), F.lit(True).alias("__first"))
    kept = kept.union(classes.where("class_id is null").select("doc_id", "__h", F.lit(False)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k"))
    rows = docs.join(kept, same)
    wordless = rows.where("not __first").select(docs.columns)
    # Repeated rows of a kept document: one is enough.
    return rows.where("__first").withColumn("__n", F.col("doc_id")).dropDuplicates(["doc_id", "__k"]).select(docs.columns).union(wordless)
