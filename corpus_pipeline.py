"""From raw documents to a training mix: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from fleetlens.llm.registry import QUALITY_FLOOR, quality_model
from fleetlens.llm.text import bounded_batches
from fleetlens.plans.fixpoint import cut_lineage
from fleetlens.sources.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and their labels, doesn't reject."""
    model = quality_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out="__score")
    return scored.filter(F.col("__score") >= QUALITY_FLOOR).drop("__score")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share; `n_chars` follows the text."""
    found = line_dedup.dedupe_lines(docs, counts=("__lines", "__removed"))
    if "n_chars" in docs.columns:
        shorter = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        found = found.withColumn("n_chars", F.when(F.col("__removed") > 0, shorter).otherwise(F.col("n_chars")))
    return found.drop("__lines", "__removed")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    leaks = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    keys = cut_lineage(leaks.select(F.col("tkey").alias("__tkey")).distinct())
    return docs.withColumn("__tkey", F.xxhash64("text")).join(keys, "__tkey", "left_anti").drop("__tkey")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its source's target, its rate, and how often the mix takes it, which may be 0."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
