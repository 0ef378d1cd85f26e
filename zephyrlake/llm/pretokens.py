"""Byte-level pre-tokens and per-worker token caches, shared by token counting and packing.

A text is cut at the vocabulary's special strings, then by the byte-level pattern; merges never cross
a pre-token, so every distinct pre-token is worked out once per worker and reused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern where all characters are Latin-1, in the faster module; letters come first as no other branch begins with one.
LATIN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xff]")
#: Characters of all other ranges go to the library's own cutter, whose Unicode tables may differ from those of ``regex``.
FAMILIAR = regex.compile("[^\\x00-\u0500\u1e00-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: A worker's cache is emptied when it holds this many pre-tokens; results do not depend on it.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are worked out anew each time, so that the cache stays small.
CACHE_CHARS = 64
#: The rank of pairs that don't merge.
NONE = np.int64(1) << 40
#: Pairs are looked up in so many slots (as a power of 2), by their keys times an odd number that spreads them.
SLOT_BITS, SPREAD = 18, np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(path: str | None = None) -> str:
    """The given path, or that of the default vocabulary of the installed tokenizer files."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256 up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Vocabulary:
    """Merge ranks as sorted arrays, the symbols they make by rank, special strings and the byte table of one vocabulary file."""

    def __init__(self, path: str | None = None):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        left, right, made = (np.array([ids[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.byte_ids = np.array([ids[s] for s in byte_symbols()], np.int64)
        slots = self.slots(self.keys)
        self.one_of, self.crowded = np.zeros(1 << SLOT_BITS, np.int64), np.bincount(slots, minlength=1 << SLOT_BITS) > 1
        self.one_of[slots] = np.arange(len(slots))
        self.byte_ranks = self.pair_ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)

    @staticmethod
    def slots(key: np.ndarray) -> np.ndarray:
        """Where a pair's key is looked for first."""
        return (key.view(np.uint64) * SPREAD >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE where they don't merge."""
        key = left << 32 | right
        slots = self.slots(key)
        at = self.one_of[slots]
        ranks = np.where(self.keys[at] == key, self.ranks[at], NONE)
        # A slot tells of one pair; where several share one, the others are searched for.
        others = np.flatnonzero(self.crowded[slots] & (ranks == NONE))
        at = np.minimum(np.searchsorted(self.keys, key[others]), len(self.keys) - 1)
        ranks[others] = np.where(self.keys[at] == key[others], self.ranks[at], NONE)
        return ranks

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if not NOT_LATIN.search(text):
            return LATIN.findall(text)
        if FAMILIAR.search(text):
            from tokenizers.pre_tokenizers import ByteLevel

            return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens of a text, and the ids of the special strings found in it."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text), []
        words, special = [], []
        for x in self.cut.split(text):
            if x in self.special:
                special.append(self.special[x])
            else:
                words += self.words(x)
        return words, special

    def ordered(self, text: str) -> list[str]:
        """Pre-tokens and special strings in the order of the text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        return [y for x in self.cut.split(text) for y in ([x] if x in self.special else self.words(x))]


@lru_cache(maxsize=4)
def vocabulary(path: str | None = None) -> Vocabulary:
    """One vocabulary per worker and path."""
    return Vocabulary(path)


class Cache:
    """pre-token -> value, filled in batches by ``make`` (list of distinct pre-tokens -> list of values)."""

    def __init__(self, make: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        self.make, self.entries, self.kept = make, entries, {}

    def values(self, lists: list[list[str]]) -> Iterator[Iterator]:
        """The values of every pre-token of every list, one list after the other; new ones are made together beforehand."""
        if len(self.kept) > self.entries:
            self.kept = {}
        kept = self.kept
        new = list(set().union(*lists).difference(kept))
        kept.update(zip(new, self.make(new), strict=True))
        for words in lists:
            yield map(kept.__getitem__, words)
        for w in new:
            if len(w) > CACHE_CHARS:
                del kept[w]


def chunks(texts: list[str], most: int = 2_000_000) -> Iterable[list[str]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run
