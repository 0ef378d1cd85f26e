"""What a task leaves in its worker: idle workers stay beside those of the next stage, in the same executor."""

import random

import pyarrow as pa

from zephyrlake.llm import packing, pretokens, storage


def test_a_task_gives_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(storage, "give_back", lambda: given.append(1))
    assert list(storage.tidy(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3]
    assert given == [1]


def test_packing_holds_few_texts_and_words(spark, monkeypatch):
    """A batch's texts were cut into pre-tokens all at once, 2 million characters of them, and 400,000 were kept."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(20)) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []

    class Same:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            seen.append(work)
            return self

    packing.pieces(Same())
    held = []
    monkeypatch.setattr(pretokens.Cache, "values", lambda self, lists, values=pretokens.Cache.values: held.append(len(lists)) or values(self, lists))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "__text": texts})
    got = [row for x in seen[0](iter([batch])) for row in x.to_pylist()]
    assert max(held) <= 512 and packing.encodings(None).entries <= 150_000
    key = lambda x: (x["doc_id"], x["piece"])
    assert sorted(got, key=key) == sorted((x.asDict() for x in packing.pieces(docs).collect()), key=key)
