"""A corpus pipeline over `documents`, one stage after the other, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, decontam, near_dup, suffix_dedup, toxicity
from loomline.llm.spool import Spool


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "_".join(["score", *docs.columns])  # the name of no column
    return toxicity.score(docs, model, score_col=score).where(F.col(f"`{score}`") < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    found = near_dup.classes(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("class_id")).alias("stays"))
    return docs.join(found.where("not stays").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages that a document with a smaller id has."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they stand for."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages hold a trained model and suffix arrays over bytes: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    spool = Spool(spark, "pipeline")
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = spool.table(name, stage(spark, docs, sf_dir))
        spool.drop(*done)
        done = [name]
    return docs
