"""The corpus pipeline: toxic documents go, repeated lines go, near duplicates go, sources are mixed, sequences are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zephyrlake.llm import jaccard, lines, mixing, packing, toxicity
from zephyrlake.llm.storage import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject; all of them where nothing was learnt."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.features):
        return docs
    return toxicity.scored(docs, model).where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one."""
    return lines.without_repeats(docs, share=lines.SHARE, most=lines.MOST)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; columns are those of documents."""
    return mixing.mixed_corpus(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their places in sequences."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("source_mix", mix_sources), ("packing", pack)]
#: Hashes, a learned model and a search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again by the next."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}-{name}")
        docs = spark.read.parquet(f"{base}/{n}-{name}")
    return docs
