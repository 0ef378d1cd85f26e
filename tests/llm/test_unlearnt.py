"""The pipeline's first stage without anything to learn from."""

import corpus_pipeline
from zephyrlake.llm import toxicity


def test_nothing_learnt_keeps_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} stone river") for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    held = [x.doc_id for x in docs.where(toxicity.held_out(docs.doc_id)).collect()]
    cases = {"none": [], "toxic": [(i, 1) for i in range(40)], "clean": [(i, 0) for i in range(40)], "others": [(900, 1), (901, 0)], "held": [(i, i % 2) for i in held], "rare": [(0, 1), (1, 0)]}
    for name, rows in cases.items():
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path / name)).count() == 42, name
