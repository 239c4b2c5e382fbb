"""A corpus pipeline: language, quality, near-duplicates, personal data, packing; each stage is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, neardup, packing, pii, quality
from tessera.llm.common import new_path
from tessera.llm.queries import tokenizer_file

#: Least share of a text's letters in its language; below it the text is a mixture without a main language.
LEAST_LANGUAGE = 0.4
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a main language."""
    got = langid.with_language(docs, langid.fit(docs), out="_language")
    return got.filter((F.col("_language.lang_pred") != langid.UNKNOWN) & (F.col("_language.score") >= LEAST_LANGUAGE)).drop("_language")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality; fitted on the labels of documents that are still there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.with_quality(docs, quality.fit(docs, labels), out="_quality")
    return got.filter(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return neardup.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.masked(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", good), ("near-duplicates", distinct), ("personal data", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
