"""A training corpus from ``documents`` in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import bpe, minhash, mixing, pii, quality
from assaykit.llm.common import bounded, saved


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.assess(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), "_text", keep=["_row"])
    return judged.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Rows without a doc_id are not compared and stay.

    Rows are told apart by doc_id and text, so a doc_id may stand for several texts; of rows equal in both,
    one that any order may pick stays.
    """
    found = saved(minhash.grouped(docs.select("doc_id", "text")), "near-groups")
    key = [F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    gone = saved(found.where(~F.col("first")).select("id", "hash").distinct(), "near-gone")
    many = saved(found.where(F.col("first") & F.col("id").isNotNull()).groupBy("id", "hash").count().where("count > 1").select("id", "hash"), "near-many")
    left = rows.join(bounded(gone), ["id", "hash"], "left_anti")
    if not many.isEmpty():
        again = left.join(bounded(many), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
        left = left.join(bounded(many), ["id", "hash"], "left_anti").unionByName(again)
    return left.select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, by output shard in shuffled order: a row for each document, pass and shard, with the words taken."""
    out = mixing.mixed_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality rules", rules), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixture", mixture), ("byte-level BPE", tokens)]

#: Compression, the random field, the drawn blocks and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
