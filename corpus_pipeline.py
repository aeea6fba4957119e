"""The corpus pipeline: quality, near duplicates, repeated passages, mix and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.frames import stored
from tilewright.llm.mixing import mixed_documents
from tilewright.llm.packing import pack_sequences
from tilewright.llm.quality import labelled_rows, score, train
from tilewright.llm.setjoin import ngram_components
from tilewright.llm.suffixes import remove_repeats
from tilewright.shipping import ship

REJECT_BELOW = 0.5  # probability of good quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    model = train(labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(False)))
    return score(docs, model, "quality_score").where(F.col("quality_score") >= REJECT_BELOW).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    ship(spark)
    # A null id is in no group; an id that is not its group's smallest goes.
    gone = ngram_components(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes that start earlier; a character cut in two leaves a mark."""
    ship(spark)
    left = remove_repeats(docs)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    left = left.withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of tokens."""
    ship(spark)
    return pack_sequences(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("mix", mix), ("pack", pack)]
ORACLE_SQL = None  # a trained model and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
