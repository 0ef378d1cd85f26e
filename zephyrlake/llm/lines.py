"""Line dedup by a segment-partition edit join.

A line within ``edits`` edits of another leaves at least one of the other's edits + 1 segments intact. Lengths are
cut into bands; the segments of a band are at fixed places of its least length, so that a line indexes its band
once for all lengths in it, and a longer line probes the few places at which an alignment within the threshold can
bring a segment. Lines that share a key are verified by banded bit-parallel edit distance; lines so linked are a
class, of which the first is kept. No pair within the threshold is missed, whatever the length of its lines.

With ``share`` and ``most`` the threshold is that share of the shorter line, ``most`` edits at most; this is the
form of the query and the pipeline. With ``share`` alone the threshold grows without end, and that join is not
exact: lines under LONG have segments, longer ones go by a fixed number of seeds, the substrings that are least in
some window. A pair is verified under the least key it shares. Lines of a key beyond CELL are dealt to parts: what
is linked within parts is one class, and only lines outside the key's largest class meet all parts, so that a large
group of close lines costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.llm import graph
from zephyrlake.llm.storage import cache_of, cut, tidy, turn_to

EDITS = 2
#: Production: edits by length of the shorter line, and at most; every line of any length is found when repeated exactly.
SHARE, MOST = 0.1, 4
#: A band of lengths ends at this multiple of its least length, or where the threshold changes.
BAND = 1.25
#: (least length of the shorter line, characters in a row): longer lines meet when they have such a run in common.
RUNS = ((60, 19), (128, 31))
#: A line goes by so many of its seeds, those of least hash, whatever its length: two lines that have a share j of their seeds in common miss each other with a chance of about (1 - j) ** SEEDS.
SEEDS = 24
LONG = RUNS[0][0]
#: Groups of a seed beyond this size go on to cells without a look at lengths and places.
LOOK = 2048
#: Shorter lines (headings, list marks) are not within edits of one another.
MIN_CHARS = 16
#: Lines of a key in one part, at most about; and when lines of different classes meet.
CELL, MEET = 256, 1024
#: Bits of a key that are kept: keys that agree by chance only bring candidates, one in 100,000 of three billion keys.
KEY_BITS = 48
#: Fewer pairs than this, and bands of more words, are compared one by one.
FEW, WIDE = 32, 8
#: log2 of the bits of the filter that says which lines are candidates at all; past its room it only lets more lines through.
FILTER_BITS = 24
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def banded(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, or most + 1 if it is larger: the deltas of the rows around the diagonal as bits, 64 at least."""
    n, m = len(a), len(b)
    top = max(63, 2 * most + 1)
    full = (1 << (top + 1)) - 1
    if abs(n - m) > most:
        return most + 1
    if min(n, m) <= most:
        row = list(range(m + 1))
        for i, x in enumerate(a, 1):
            left, diagonal = i, row[0]
            row[0] = i
            for j, y in enumerate(b, 1):
                left = min(row[j] + 1, left + 1, diagonal + (x != y))
                diagonal, row[j] = row[j], left
        return min(row[m], most + 1)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down, distance, edge = (full << (top - most)) & full, 0, most, 1 << (top - 1)
    limit = 2 * most + m - n
    for j, y in enumerate(b):
        start = most + j - top
        at = places.get(y, 0)
        match = (at << -start if start < 0 else at >> start) & full
        zero = ((((match & up) + up) & full) ^ up) | match | down
        plus, minus = (down | ~(zero | up)) & full, zero & up
        if j < n - most:
            distance += not zero >> top & 1
        else:
            distance += bool(plus & edge) - bool(minus & edge)
            edge >>= 1
        if distance > limit:
            return most + 1
        shifted = zero >> 1
        up, down = (minus | ~(shifted | plus)) & full, shifted & plus
    return min(distance, most + 1)


def few_changes(a: str, b: str, most: int) -> bool:
    """Whether a plain walk along both strings, which meets again after each change at the next eight equal characters, shows at most ``most`` edits."""
    i = j = cost = 0
    while True:
        n, step = min(len(a) - i, len(b) - j), 64
        while n > 0:
            if a[i : i + min(step, n)] == b[j : j + min(step, n)]:
                i, j, n = i + min(step, n), j + min(step, n), n - min(step, n)
            elif step == 1:
                break
            else:
                step //= 4 if step > 4 else step
                step = max(step, 1)
        rest = max(len(a) - i, len(b) - j)
        if cost + rest <= most:
            return True
        if n == 0:
            return False
        reach, best = most - cost, None
        for d in range(min(reach, len(a) - i - 8) + 1):
            at = b.find(a[i + d : i + d + 8], j, j + reach + 8)
            if at >= 0 and (best is None or max(d, at - j) < max(best[0], best[1] - j)):
                best = (d, at)
            if best is not None and d >= max(best[0], best[1] - j):
                break
        if best is None:
            return False
        cost += max(best[0], best[1] - j)
        i, j = i + best[0], best[1]
        if cost > most:
            return False


def missing(a: str, b: str) -> int:
    """Disjoint runs of four characters of ``a`` that are nowhere in ``b``: as many edits at least lie between the two."""
    known = {b[i : i + 4] for i in range(len(b) - 3)}
    return sum(a[i : i + 4] not in known for i in range(0, len(a) - 3, 4))


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs of strings are within so many edits each: ``banded`` for many pairs at once, one 64-bit word or more of the band for each.

    Lengths of a pair differ by ``most`` at most, and both are longer than that.
    """
    out = np.zeros(len(a), bool)
    size = np.array([len(x) for x in b], np.int64)
    words = (2 * np.asarray(most) + 1) // 64 + 1
    order = np.lexsort((-size, words))
    begin = 0
    while begin < len(order):
        first, end = order[begin], begin
        room = max(1, 4_000_000 // (size[first] + 64 * words[first]))
        while end < len(order) and end - begin < room and words[order[end]] == words[first]:
            end += 1
        own = order[begin:end]
        if len(own) < FEW or words[first] > WIDE:
            out[own] = [close(a[i], b[i], int(most[i])) for i in own]
        else:
            out[own] = _within([a[i] for i in own], [b[i] for i in own], np.asarray(most)[own], int(words[first]))
        begin = end
    return out


def _within(a: list[str], b: list[str], most: np.ndarray, words: int) -> np.ndarray:
    """``within`` for pairs whose bands have the same number of words; the longest ``b`` come first."""
    n, m, bits, top = np.array([len(x) for x in a]), np.array([len(x) for x in b]), 64 * words, 64 * words - 1
    # Characters are numbered from 1, in one byte where they can be; row i of the band at step j is column i + j.
    kinds, codes = np.unique(np.frombuffer("".join(a + b).encode("utf-32-le"), np.uint32), return_inverse=True)
    codes = (codes + 1).astype(np.uint8 if len(kinds) < 255 else np.uint32)
    rows, columns = np.zeros((len(a), m[0] + bits + 1), codes.dtype), np.zeros((m[0], len(b)), codes.dtype)
    ends_a, ends_b = np.cumsum(n), n.sum() + np.cumsum(m)
    for i in range(len(a)):
        start = top - most[i]
        code = codes[ends_a[i] - n[i] : ends_a[i]][: rows.shape[1] - start]
        rows[i, start : start + len(code)] = code
        columns[: m[i], i] = codes[ends_b[i] - m[i] : ends_b[i]]
    packed = lambda x: np.ascontiguousarray(np.packbits(x, axis=1, bitorder="little").view(np.uint64).T)
    up, one = packed(np.arange(bits) >= (top - most)[:, None]), np.uint64(1)
    down, distance, out, number = np.zeros_like(up), most.copy(), np.zeros(len(a), bool), np.arange(len(a))
    live = len(a)
    first_late, last = int((n - most).min()), int(m[-1])
    for j in range(m[0] + 1):
        if j >= last and (going := int((m[:live] > j).sum())) < live:
            out[number[going:live]] = distance[going:] <= most[going:live]
            live = going
            up, down, distance = up[:, :live], down[:, :live], distance[:live]
            if not live:
                break
            last = int(m[live - 1])
        if j % 64 == 63:
            # The last row can only grow by what the lengths allow.
            keep = distance <= 2 * most[:live] + m[:live] - n[:live]
            if not keep.all():
                rows, columns, up, down, distance = rows[:live][keep], columns[:, :live][:, keep], up[:, keep], down[:, keep], distance[keep]
                n, m, most, number = (x[:live][keep] for x in (n, m, most, number))
                live = len(number)
                if not live:
                    break
                last = int(m[-1])
        match = packed(rows[:live, j : j + bits] == columns[j, :live, None])
        zero, carry = np.empty_like(match), None
        for w in range(words):
            part = match[w] & up[w]
            total = part + up[w]
            if words > 1:
                over = total < part
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            zero[w] = (total ^ up[w]) | match[w] | down[w]
        plus, minus = down | ~(zero | up), zero & up
        step = (zero[-1] >> np.uint64(63) ^ one).view(np.int64)
        if j >= first_late and (after := np.flatnonzero(j >= n[:live] - most[:live])).size:
            edge = top - 1 - (j - (n[after] - most[after]))
            word, bit = edge >> 6, (edge & 63).astype(np.uint64)
            step[after] = (plus[word, after] >> bit & one).astype(np.int64) - (minus[word, after] >> bit & one).astype(np.int64)
        distance += step
        shifted = zero >> one
        if words > 1:
            shifted[:-1] |= zero[1:] << np.uint64(63)
        up, down = minus | ~(shifted | plus), shifted & plus
    return out


def close(a: str, b: str, most: int) -> bool:
    """Whether two strings are within ``most`` edits; common ends are cut off first."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    if a[: n // 2] == b[: n // 2]:
        a, b, n = a[n // 2 :], b[n // 2 :], n - n // 2
    if n > 1 and a[-(n // 2) :] == b[-(n // 2) :]:
        a, b = a[: -(n // 2)], b[: -(n // 2)]
    return banded(a, b, most) <= most


def line_id(line: str) -> int:
    """63-bit id of a line, shifted left by one."""
    return xxhash.xxh64_intdigest(line.encode("utf-8")) & ~1


def lines_of(text: str) -> list[str]:
    """The lines of a text without white space at their ends."""
    return [x.strip() for x in text.split("\n")]


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x)]), dtype=np.uint64) for x in (BASE, INVERSE))


cache_of("lines", _powers.cache_clear)


def bands_of(longest: int, edits: int, share: float | None = None, within: tuple[int, int] = (0, 1 << 62)) -> np.ndarray:
    """Rows (least length, end, threshold) of the bands of lengths that are indexed, up to ``longest``; lengths no greater than their threshold are in none."""
    limit = lambda n: edits if share is None else min(edits, allowed(n, share))
    low, out = max(within[0], edits + 1 if share is None else 1), []
    while low <= longest and low < within[1]:
        end = min(within[1], max(low + 1, int(low * BAND)))
        most = limit(low)
        if share is not None:
            end = next((n for n in range(low + 1, end) if limit(n) != most), end) if most < edits else end
        if 0 < most < low:
            out.append((low, end, most))
        low = end
    return np.array(out, np.int64).reshape(-1, 3)


def keys_of(lines: list[str], edits: int, share: float | None = None, within: tuple[int, int] = (0, 1 << 62)) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner): the keys of all lines; owner is twice the number of the line, plus 1 where the key indexes it.

    A pair's threshold is ``edits`` or, if less, ``share`` of its shorter line. The shorter line is indexed by the
    threshold + 1 segments of its band, which divide the band's least length; the other probes that band, its own or
    an earlier one. Of the segments, one has as many edits before it as segments, so it lies shifted by no more than
    its number, and by no more than what the edits behind it allow. A key at its own place indexes and probes.
    ``within`` bounds the lengths of indexed lines. Substrings are hashed from running sums of characters times
    powers of an odd base, modulo 2**64; all lines are worked on at once for each place.
    """
    text = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(x) for x in lines], np.int64)
    offsets = np.cumsum(lengths) - lengths
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    bands = bands_of(int(lengths.max(initial=0)), edits, share, within)
    if not len(bands):
        return keys[0], owners[0]
    # A line meets the bands from the first that reaches it within the threshold to its own.
    first = np.searchsorted(bands[:, 1] + bands[:, 2], lengths, side="right")
    last = np.searchsorted(bands[:, 0], lengths, side="right")
    times = np.maximum(last - first, 0)
    number = np.repeat(np.arange(len(lines)), times)
    band = np.arange(len(number)) - np.repeat(np.cumsum(times) - times, times) + first[number]
    (low, end, most), size, offset = bands[band].T, lengths[number], offsets[number]
    base, longer = low // (most + 1), low % (most + 1)
    # By how much the line can be longer than one of the band.
    least, greatest = np.maximum(0, size - end + 1), np.minimum(most, size - low)
    power, back = _powers(1 << max(20, int(len(text)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(text * power[: len(text)], dtype=np.uint64, out=sums[1:])
        for i in range(int(bands[:, 2].max()) + 1):
            at = i * base + np.maximum(0, i - (most + 1 - longer))
            run = base + (i >= most + 1 - longer)
            for shift in range(-i, i + 1):
                start = at + shift
                fits = np.flatnonzero((i <= most) & (shift >= least - (most - i)) & (shift <= greatest + most - i) & (start >= 0) & (start + run <= size))
                begin = (offset + start)[fits]
                h = (sums[begin + run[fits]] - sums[begin]) * back[begin]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h += (low[fits] * 4096 + i).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
                keys.append(h ^ (h >> np.uint64(32)))
                owners.append(number[fits] * 2 + ((size < end)[fits] & (shift == 0)))
    return np.concatenate(keys), np.concatenate(owners)


def seeds_of(lines: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, owner, place): hashed substrings that are least in some window of ``run`` characters of their line; ties count each."""
    size = run // 2 + 1
    width = run - size + 1
    none = np.zeros(0, np.int64)
    text = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(text) < run:
        return none.astype(np.uint64), none, none
    lengths = np.array([len(x) for x in lines], np.int64)
    owner = np.repeat(np.arange(len(lines)), lengths)
    power, back = _powers(1 << max(20, int(len(text)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * power[: len(text)], dtype=np.uint64)])
        h = (sums[size:] - sums[:-size]) * back[: len(text) - size + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)

    def windows(x: np.ndarray, best: np.ufunc) -> np.ndarray:
        done = 1
        while done < width:
            step = min(done, width - done)
            x = best(x[: len(x) - step], x[step:])
            done += step
        return x

    least = windows(h, np.minimum)
    least[owner[: len(least)] != owner[run - 1 :]] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero((windows(np.concatenate([pad, least, pad]), np.maximum) == h) & (h > 0))
    return h[at], owner[at], at - (np.cumsum(lengths) - lengths)[owner[at]]


def growing_keys(lines: list[str], share: float, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner) as keys_of, for a threshold of ``share`` of the shorter line.

    A key's upper 32 bits are the hash; for seeds the lower ones are the line's length and the seed's place, 16 bits each.
    """
    upper, half = np.uint64(0xFFFFFFFF << 32), np.int64(0xFFFF)
    lengths = np.array([len(x) for x in lines], np.int64)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    k, o = keys_of(lines, allowed(LONG - 1, share), share, (min_chars, LONG))
    keys.append(k & upper)
    owners.append(o)
    for (low, run), (high, _) in zip(RUNS, [*RUNS[1:], (1 << 40, 0)], strict=True):
        own = np.flatnonzero((lengths >= low) & (lengths <= high + allowed(high, share)))
        if len(own):
            k, o, at = seeds_of([lines[i] for i in own], run)
            order = np.lexsort((k, o))
            first = np.flatnonzero(np.append(True, o[order][1:] != o[order][:-1]))
            order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < SEEDS]
            k, o, at = k[order], o[order], at[order]
            with np.errstate(over="ignore"):
                k = (k ^ (k >> np.uint64(31))) * BASE  # least values have few high bits
            own = own[o]
            keys.append(k & upper | (np.minimum(lengths[own], half) << 16 | np.minimum(at, half)).astype(np.uint64))
            owners.append(own * 2 + 1)
    return np.concatenate(keys), np.concatenate(owners)


def allowed(length: int, share: float) -> int:
    """Edits that a pair may have whose shorter line is of this length."""
    return int(share * length + 1e-9)


def meeting(batch: pd.DataFrame, share: float) -> pd.DataFrame:
    """Of whole, sorted groups of growing_keys, the rows with a partner of fit length and place; key becomes a hash of the group's lines.

    Groups of the same lines so become one.
    """
    key, line, indexed = batch["key"].to_numpy(), batch["id"].to_numpy() & ~1, batch["id"].to_numpy() & 1
    group, size, place, n = key >> 32, key >> 16 & 0xFFFF, key & 0xFFFF, len(key)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    large = np.repeat(np.diff(np.append(starts, n)) > LOOK, np.diff(np.append(starts, n)))
    keep, live, d = large.copy(), np.flatnonzero(~large), 1
    most = np.floor(share * size + 1e-9).astype(np.int64)
    most[size == 0xFFFF] = 1 << 30
    while len(live):
        live = live[live + d < n]
        live = live[group[live + d] == group[live]]
        live = live[(size[live + d] - size[live] <= most[live]) | (size[live + d] == 0xFFFF)]
        other = live + d
        good = (line[live] != line[other]) & ((np.abs(place[live] - place[other]) <= most[live]) | (np.maximum(place[live], place[other]) == 0xFFFF)) & ((indexed[live] | indexed[other]) > 0)
        keep[live[good]] = keep[other[good]] = True
        d += 1
    return by_lines(batch[keep], group[keep])


def by_lines(batch: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
    """Whole groups, whose rows come sorted by id: key becomes a hash of the group's lines, so that groups of the same lines become one; adds n, their number."""
    if not len(batch):
        return batch.assign(n=np.zeros(0, np.int64))
    line = batch["id"].to_numpy() & ~1
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    distinct = np.append(True, (group[1:] != group[:-1]) | (line[1:] != line[:-1]))
    mixed = line.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.add.reduceat(np.where(distinct, mixed ^ (mixed >> np.uint64(32)), np.uint64(0)), starts)
    sizes = np.diff(np.append(starts, len(batch)))
    return batch.assign(key=np.repeat(sums, sizes).view(np.int64), n=np.repeat(np.add.reduceat(distinct.astype(np.int64), starts), sizes))


def bit_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit table of a fixed size, set at the places of the given ids (column id): what is not in it is none of them."""
    at = F.pmod(F.shiftright("id", 7), F.lit(1 << bits))
    words = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int)))").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return table


def without_covered(rows: DataFrame, cell: int) -> DataFrame:
    """Rows (key, id, indexed, and n, the key's number of lines, where it is known) without the keys of more than ``cell`` lines whose lines all stand under one larger key too, or an equal one of less number.

    The seeds of a passage that many lines share are such: a line goes by its least seeds, so that lines with any
    seed of the passage have its least ones. Every pair of such a key meets under the other, where all are indexed.
    """
    sized = rows if "n" in rows.columns else rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    each = sized.where(F.col("n") > cell).groupBy("id").agg(F.collect_list(F.struct("n", "key", "indexed")).alias("a")).where(F.size("a") > 1)
    pairs = each.select(F.explode("a").alias("x"), "a").select("x", F.explode("a").alias("y"))
    larger = (F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.key") < F.col("x.key")))
    pairs = pairs.where(larger & (F.col("y.indexed") > 0)).groupBy("x.key", F.col("y.key").alias("by"), "x.n").agg(F.count(F.lit(1)).alias("both"))
    covered = cut(pairs.where("both = n").select("key").distinct())
    return cut(rows.join(covered, "key", "left_anti")) if covered.take(1) else rows


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, share: float | None = None, most: int | None = None, cell: int = CELL, meet: int = MEET) -> DataFrame:
    """(id, component) of every line of docs (text) that is within ``edits`` edits (or ``share`` of the shorter line, ``most`` at most) of a different line; ids are those of line_id."""
    growing = share is not None and most is None
    if most is not None:
        edits = most
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("lines")
        for batch in batches:
            all_texts = batch["text"].tolist()
            for i in range(0, len(all_texts), 200):
                lines = list({x for t in all_texts[i : i + 200] for x in lines_of(t) if len(x) >= min_chars})
                if lines:
                    keys, owners = growing_keys(lines, share, min_chars) if growing else keys_of(lines, edits, share, (min_chars, 1 << 62))
                    ids = np.array([line_id(x) for x in lines], np.uint64)
                    # 48 bits of a key are enough; with the empty bytes last, rows are smaller where they are shuffled.
                    keys = keys if growing else keys >> np.uint64(64 - KEY_BITS)
                    yield pd.DataFrame({"id": (ids[owners >> 1] | (owners & 1).astype(np.uint64)).view(np.int64), "key": keys.view(np.int64)})

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of a key's rows, which come sorted by id, only different ones matter; a key needs two lines, one of them indexed.
        for batch in different(batches, 32 if growing else 0):
            if growing:
                if len(batch):
                    yield meeting(batch, share)
                continue
            key, line, indexed = batch["key"].to_numpy(), batch["id"].to_numpy() & ~1, batch["id"].to_numpy() & 1
            if len(key):
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                sizes = np.diff(np.append(starts, len(key)))
                several = (np.maximum.reduceat(line, starts) != np.minimum.reduceat(line, starts)) & (np.maximum.reduceat(indexed, starts) > 0)
                several = np.repeat(several, sizes)
                yield by_lines(batch[several], key[several])

    rows = texts.mapInPandas(tidy(keyed), "id bigint, key bigint").repartition(F.shiftright("key", 32) if growing else F.col("key")).sortWithinPartitions("key", "id")
    # A line that indexes a key also probes it: one row of the two is enough.
    rows = cut(rows.mapInPandas(tidy(shared), "key bigint, id bigint, n bigint").groupBy("key", F.expr("id & -2").alias("id")).agg(F.max(F.expr("id & 1")).alias("indexed"), F.max("n").alias("n")))
    rows = without_covered(rows, cell)
    table = bit_filter(rows.select("id"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << FILTER_BITS) - 1
        for batch in batches:
            found = {}
            for text in batch.column("text").to_pylist():
                for x in lines_of(text):
                    if len(x) >= min_chars:
                        i = line_id(x)
                        at = (i >> 7) & mask
                        if table[at >> 5] >> np.uint32(at & 31) & 1:
                            found[i - (1 << 64) if i >> 63 else i] = x
            yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int64()), pa.array(list(found.values()), pa.string())], ["id", "line"])

    lines = texts.mapInArrow(tidy(wanted), "id bigint, line string").groupBy("id").agg(F.first("line").alias("line"))
    # One row a line, with the keys that it stands under; they become rows only where they are dealt out.
    each = cut(rows.groupBy("id").agg(F.collect_list(F.struct("key", "indexed", "n")).alias("found")).join(lines, "id"))
    keys = (F.col("found.key").alias("keys"), F.expr("transform(filter(found, x -> x.indexed > 0), x -> x.key)").alias("own"))
    # Powers of two: lines that share several keys so share parts, and a pair is looked at under one key only.
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.col("at.n") / cell)))).cast("int")
    kept = each.select("id", "line", *keys, F.explode("found").alias("at"), F.col("id").alias("class"), F.lit(-1).alias("part"))
    kept = kept.select("id", "line", "keys", "own", "at.key", "at.indexed", F.pmod(F.xxhash64("id"), parts).cast("int").alias("cell"), "class", "part")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in graph.whole(batches, ["key", "cell"]):
            yield linked(batch, edits, share, growing)

    def within_cells(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "id").mapInPandas(tidy(verified), "a bigint, b bigint")

    # First each line of a large group meets those of its part; then the lines outside the group's largest class meet all parts.
    edges = cut(within_cells(kept))
    classes = graph.components(edges)
    large = each.select("id", "line", "found", F.expr(f"filter(found, x -> x.n > {int(cell)})").alias("large")).where(F.size("large") > 0)
    if not large.take(1):
        return classes
    large = large.join(classes, "id", "left").select("id", "line", *keys, F.coalesce("component", "id").alias("class"), F.explode("large").alias("at")).select("id", "line", "keys", "own", "at.key", "at.indexed", "class")
    sizes = large.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    large = large.join(sizes.select("key"), "key")
    more = within_cells(graph.main_and_others(large, "key", "id", meet).select(kept.columns))
    return graph.components(edges.union(more))


def different(batches: Iterator[pd.DataFrame], shift: int = 0) -> Iterator[pd.DataFrame]:
    """Batches of whole keys (without their lowest ``shift`` bits) without repeated rows, which come sorted by key and id; a key's rows that fill batch after batch lose their repeats on the way."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key, line = batch["key"].to_numpy(), batch["id"].to_numpy()
        batch = batch[np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))[: len(batch)]]
        last = batch["key"].to_numpy() >> shift == batch["key"].iloc[-1] >> shift if len(batch) else np.zeros(0, bool)
        held = batch[last]
        yield batch[~last]
    if held is not None:
        yield held


def profile(codes: np.ndarray, owner: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each line's characters and of its pairs of them, both hashed: an edit changes the former by two at most, the latter by four."""
    single = np.bincount(owner * 64 + (codes & 63), minlength=lines * 64).reshape(lines, 64)
    inside = owner[1:] == owner[:-1]
    pairs = (codes[1:] * 31 + codes[:-1] & 255)[inside]
    return single.astype(np.int32), np.bincount(owner[1:][inside] * 256 + pairs, minlength=lines * 256).reshape(lines, 256).astype(np.int32)


def linked(batch: pd.DataFrame, edits: int, share: float | None = None, growing: bool = False) -> pd.DataFrame:
    """Edges that link the close lines of each cell (key, cell) of a batch of whole, sorted ones; pairs already linked are not looked at again.

    All cells are worked on at once: lines d places apart, for every d.
    """
    none = pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    if len(batch) < 2:
        return none
    cell = np.cumsum(np.append(0, (batch["key"].to_numpy()[1:] != batch["key"].to_numpy()[:-1]) | (batch["cell"].to_numpy()[1:] != batch["cell"].to_numpy()[:-1])))
    ids, marks = batch["id"].to_numpy(), batch["indexed"].to_numpy() > 0
    # A line may stand in several cells; it is decoded and counted once.
    known, line = np.unique(ids, return_inverse=True)
    texts = [""] * len(known)
    for i, x in zip(line.tolist(), batch["line"].tolist(), strict=True):
        texts[i] = x
    lengths = np.array([len(x) for x in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    single, double = profile(codes, np.repeat(np.arange(len(texts)), lengths), len(texts))
    found, own = ([frozenset(x) for x in batch[c].iloc[np.unique(line, return_index=True)[1]]] for c in ("keys", "own"))
    keys = batch["key"].to_numpy()
    own_part, at_cell = batch["part"].to_numpy(), batch["cell"].to_numpy()
    # Lines of one class are linked already.
    label = np.unique(batch["class"].to_numpy()[np.unique(line, return_index=True)[1]], return_inverse=True)[1]
    out, open_, live, d = [], [], np.arange(len(ids)), 1

    def link(x: int, y: int) -> None:
        if label[x] != label[y]:
            label[label == label[y]] = label[x]
            out.append((known[x], known[y]))

    while True:
        live = live[live + d < len(ids)]
        live = live[cell[live] == cell[live + d]]
        if not len(live):
            break
        at = live[marks[live] | marks[live + d]]
        at = at[label[line[at]] != label[line[at + d]]]
        # Two lines that both go to all parts meet in one of them: that of either, by turns.
        p, q = own_part[at], own_part[at + d]
        at = at[(p < 0) | (q < 0) | (np.where((p + q) % 2 == 0, np.minimum(p, q), np.maximum(p, q)) == at_cell[at])]
        i, j = line[at], line[at + d]
        most = np.full(len(i), edits) if share is None else np.floor(share * np.minimum(lengths[i], lengths[j]) + 1e-9).astype(np.int64)
        most = most if growing else np.minimum(most, edits)
        able = np.abs(lengths[i] - lengths[j]) <= most
        at, i, j, most = at[able], i[able], j[able], most[able]
        for counts, times in ((single, 2), (double, 4)):
            apart = np.concatenate([np.abs(counts[x] - counts[y]).sum(axis=1) for x, y in zip(np.array_split(i, len(i) // 4096 + 1), np.array_split(j, len(j) // 4096 + 1), strict=True)])
            able = apart <= times * most
            at, i, j, most, apart = at[able], i[able], j[able], most[able], apart[able]
        for k, x, y, n, far in zip(keys[at].tolist(), i.tolist(), j.tolist(), most.tolist(), (apart > 2 * most).tolist(), strict=True):
            # A pair is looked at under the least of its keys only.
            if label[x] != label[y] and min((own[x] & found[y]) | (found[x] & own[y])) == k:
                if not far and few_changes(texts[x], texts[y], n):
                    link(x, y)
                elif not far or missing(texts[x], texts[y]) <= n:
                    open_.append((x, y, n))
        d += 1
    open_.sort(key=lambda x: (x[2], x[0], x[1]))
    for begin in range(0, len(open_), 2048):
        part = [x for x in open_[begin : begin + 2048] if label[x[0]] != label[x[1]]]
        for (x, y, _), hit in zip(part, within([texts[x] for x, _, _ in part], [texts[y] for _, y, _ in part], np.array([n for _, _, n in part], np.int64)).tolist(), strict=True):
            if hit:
                link(x, y)
    return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64) if out else none


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, share: float | None = None, most: int | None = None) -> DataFrame:
    """doc_id, __key, n_lines, n_repeated and drop (their numbers, from 0): the lines of each document that repeat an earlier one.

    Equal lines and lines linked by at most ``edits`` edits, also through others, are one class; its first line by
    doc_id (null last), then by line number, is kept. __key is a hash of the text: rows of equal doc_id and
    text get the same answer, each its own row. Ids may be of any type. Lines shorter than ``min_chars`` are never repeats; with ``share``, which takes the
    place of ``edits`` and is exact if ``most`` bounds it, they are where another line that is not empty equals them.
    """
    classes = line_classes(docs, edits, min_chars, share, most)
    least = min_chars if share is None else 1

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__key", "text")), strict=True):
                lines = lines_of(text)
                seen = set()
                for n, x in enumerate(lines):
                    if len(x) >= least:
                        i = line_id(x)
                        # Within a document only the first of equal lines can be the first of its class.
                        rows.append((doc_id, key, n, i - (1 << 64) if i >> 63 else i, i in seen))
                        seen.add(i)
                rows.append((doc_id, key, len(lines), None, False))
            kinds = zip(("doc_id", "__key", "line_no", "id", "again"), (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.bool_()), strict=True)
            yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("__key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(tidy(numbered), f"doc_id {kind}, __key bigint, line_no int, id bigint, again boolean")
    rows = cut(rows.join(classes, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component", "id"))
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__key").alias("k"), F.col("line_no").alias("l"))
    first = rows.where(F.col("class").isNotNull() & ~F.col("again")).groupBy("class").agg(F.min(at).alias("first"))
    marked = rows.where(F.col("class").isNotNull()).join(first, "class").withColumn("late", ~at.eqNullSafe(F.col("first"))).where("late")
    late = marked.groupBy("doc_id", "__key").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))
    every = rows.where(F.col("class").isNull()).select("doc_id", "__key", F.col("line_no").alias("n_lines"))
    a, b = every.alias("a"), late.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__key") == F.col("b.__key"))
    return a.join(b, same, "left").select("a.doc_id", "a.__key", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("b.drop"), F.lit(0)).cast("long").alias("n_repeated"), F.coalesce("b.drop", F.array().cast("array<int>")).alias("drop"))


def without_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, share: float | None = None, most: int | None = None) -> DataFrame:
    """The documents without the lines that repeat an earlier line; n_chars, if there, follows the text.

    A document that had text and has none left goes; null and empty texts, repeated rows and all other columns
    stay as they are.
    """
    found = repeated_lines(docs, edits, min_chars, share, most).where("n_repeated > 0").select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), F.col("drop").alias("__drop")).dropDuplicates(["__id", "__k"])
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k"))
    rows = docs.join(found, same, "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.withColumn("__new", text).where(F.col("__drop").isNull() | (F.trim("__new") != ""))
    out = {"text": F.col("__new")} | ({"n_chars": F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.length("__new").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return rows.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
