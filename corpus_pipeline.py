"""The corpus pipeline: quality classifier, line dedup, near-dedup, packing. Each stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import line_dedup, packing, quality_crf, simhash_dedup
from lapwing.llm.common import scratch, table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labelled rows of the tables in sf_dir."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = quality_crf.train(table(spark, sf_dir, "documents"), labels)
    scored = quality_crf.score(docs, model, score_col="__score")
    return scored.where(F.col("__score") >= 0.5).drop("__score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that have no word left, but had one, go."""
    out = line_dedup.dedup_lines(docs)
    kept = out.where(F.col("text").rlike(r"\S") | ((F.col("n_exact") == 0) & (F.col("n_near") == 0)))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: five-word shingles, exact Jaccard similarity of 0.8 or more."""
    return simhash_dedup.drop_near_duplicates(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents left, with its ids and its place in a sequence."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=1)


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the classifier nor the near-duplicate stages; tests hold run() against a brute-force version.
ORACLE_SQL = None
