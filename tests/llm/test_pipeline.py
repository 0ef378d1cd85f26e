"""The pipeline's stages over a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        words = [f"w{r.randrange(300)}" for _ in range(60)] + (["dreadful"] if bad else [])
        r.shuffle(words)
        rows.append((i, "\n".join(" ".join(words[k : k + 20]) for k in range(0, len(words), 20)), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    near = rows[1][1].split()
    near[30] = "changed"
    rows += [(1001, rows[1][1], "en", "s1", 0), (1002, " ".join(near), "en", "s1", 0), (1003, None, None, None, None), (1004, "", "en", "s0", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {x.doc_id for x in docs.select("doc_id").collect()}
    clean = {i for i in range(400) if i % 8}
    assert clean <= kept["toxicity"] and not any(i % 8 == 0 and i < 400 for i in kept["toxicity"])
    assert clean <= kept["line_dedup"] and 1001 not in kept["line_dedup"]
    assert clean <= kept["near_duplicates"] and 1002 not in kept["near_duplicates"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(kept["source_mix"])
