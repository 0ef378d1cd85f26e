"""Ids of new words in packing: merged for a whole batch at once, as the library has them."""

import random

import numpy as np
import pytest

from zephyrlake.llm import packing, tokens
from zephyrlake.llm.pretokens import vocabulary, vocabulary_path


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    letters = "aeinstrhAEZéßÖøÿ"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(4000)] + [str(r.randrange(10**12)) for _ in range(500)]
    out = sorted({w for x in made for w in (x, " " + x)} | {" ", "  ", "\n", "\n\n", "'s", " '", "!?", "<|endoftext|>", "μέ", " 日本", "²", " ¾", "ªº", "\t", "a" * 999, "a" * 1000, "ab" * 500, " " * 77, "😀" * 9})
    r.shuffle(out)
    return out


def test_new_words_have_the_ids_of_the_library(words, monkeypatch):
    """New words went to the library, three fifths of the seconds where many words come but once."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    want = [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    sent = []

    class Noting:
        def __getattr__(self, name):
            return lambda texts, **named: sent.extend([texts] if isinstance(texts, str) else texts) or getattr(library, name)(texts, **named)

    packing.encodings.cache_clear()
    monkeypatch.setattr(Tokenizer, "from_file", lambda path: Noting())
    make = packing.encodings(None).make
    try:
        assert make(words) == want
    finally:
        packing.encodings.cache_clear()
        getattr(packing, "library", packing.encodings).cache_clear()
    # Long words and special strings are the library's: merging takes a round for nearly each merge of the longest.
    assert sorted(sent) == sorted(w for w in words if len(w) > 64 or w == "<|endoftext|>")
    assert make([]) == [] and make([""]) == [b""] and make(["<|endoftext|>"]) == [np.array([50256], "<u4").tobytes()]


def test_only_pairs_of_new_symbols_are_looked_up(words, monkeypatch):
    """Every pair of every unfinished word was looked up again in each round."""
    vocab, looked = vocabulary(), []
    data = [w.encode() for w in words]
    monkeypatch.setattr(type(vocab), "pair_ranks", lambda self, left, right, ranks=type(vocab).pair_ranks: looked.append(len(left)) or ranks(self, left, right))
    ids, counts = tokens.merged_ids(data, vocab)
    assert len(ids) == counts.sum() and sum(looked) <= 2 * (sum(map(len, data)) - len(ids))


def test_pairs_that_share_a_slot_are_found():
    vocab = vocabulary()
    assert vocab.crowded.any()
    left, right = vocab.keys >> 32, vocab.keys & (2**32 - 1)
    assert (vocab.pair_ranks(left, right) == vocab.ranks).all()
    r = np.random.default_rng(1)
    left, right = r.integers(0, 50257, (2, 200_000))
    want = {int(k): int(x) for k, x in zip(vocab.keys, vocab.ranks)}
    assert vocab.pair_ranks(left, right).tolist() == [want.get(int(a) << 32 | int(b), int(tokens.NONE)) for a, b in zip(left, right)]
