"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents`` they were given. Each is
written as Parquet below the shared checkpoint folder and read again as the next one's documents.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridpulse.llm import jaccard, leaks, packing, quality, substrings  # noqa: E402
from gridpulse.llm.arrays import NULL_ID  # noqa: E402
from gridpulse.llm.spark import shared_folder  # noqa: E402
from gridpulse.llm.workload import table, tokenizer_path  # noqa: E402


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Scores of one id and text are equal, so repeated rows stay or go together. A null id or text is scored like others.
    """
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return quality.with_prediction(scored).where("predicted = 1").select(*[F.col(f"carried.{c}").alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; repeated rows of it count as one.

    A null id is the smallest. Of unlike texts with the smallest id of their group, the one with the smallest text hash
    stays. Documents without words are one group.
    """
    names = ["_key", "_t1", "_t2"]
    row = F.struct(*[F.col(n[1:]).alias(n) for n in names]).alias("row")
    found = jaccard.near_duplicate_rows(docs).select("class_node", row)
    kept = found.groupBy("class_node").agg(F.min("row").alias("row")).select("row.*")
    return jaccard.with_row_key(docs, "_").join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated passages taken out; those left without a word go, as do documents that had none.

    A text that loses nothing stays as it is, white space included; others are their kept words joined by blanks.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carry = ["_text", *others]
    done = substrings.substring_dedup(docs.withColumn("_text", F.col("text")), carry=carry)
    text = F.when(F.col("n_removed") == 0, F.col("_text")).otherwise(F.col("kept"))
    done = done.where(F.length("kept") > 0).withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done.select(*docs.columns)


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Ids, which may be null or shared, don't matter: a text goes for its own leak."""
    names = ["_key", "_t1", "_t2"]
    found = leaks.leaking_texts(docs, table(spark, sf_dir, "benchmark"))
    held = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_key"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    return jaccard.with_row_key(docs, "_").join(held, names, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark_leaks),
    ("packing", packed),
]

# No SQL: the classifier, the latent space and best-fit packing are not SQL-expressible; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
