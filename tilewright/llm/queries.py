"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.chosenpath import near_duplicates
from tilewright.llm.frames import fold
from tilewright.llm.idfile import token_digests, token_file
from tilewright.llm.language import language_scores, train as language_model
from tilewright.llm.licenses import scan_licenses
from tilewright.llm.mixing import MIX_SQL, mix_sources, word_count
from tilewright.llm.negatives import NEGATIVES_SQL, hard_negatives
from tilewright.llm.packing import pack_sequences
from tilewright.llm.quality import quality_scores
from tilewright.llm.setjoin import ngram_components
from tilewright.llm.registry import ORACLES, QUERIES, query, table
from tilewright.llm.runs import run_digests, word_runs
from tilewright.llm.spots import fingerprints
from tilewright.llm.suffixes import remove_repeats
from tilewright.llm.topk import TOP_SQL, top_scores

__all__ = ["ORACLES", "QUERIES"]


@query("op9_packing")
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_sequences(table(spark, sf, "documents"))


@query("op4_token_file")
def op4_token_file(spark: SparkSession, sf: str) -> DataFrame:
    return token_digests(spark, token_file(table(spark, sf, "documents")))


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix_sources(docs, size=F.col("size")).select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_components(table(spark, sf, "documents"), words=4, numer=85)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_topk", TOP_SQL)
def op8_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return top_scores(vectors, vectors.where("vec_id % 100 = 0"))


@query("op6_language")
def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = fold(7) == 2
    return language_scores(docs, language_model(docs.where(~held_out)), held_out)


@query("op7_spots")
def op7_spots(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(table(spark, sf, "documents"))


@query("op2_licenses")
def op2_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


@query("op12_runs")
def op12_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_digests(word_runs(table(spark, sf, "documents"), unrolled=True))


@query("op13_negatives", NEGATIVES_SQL)
def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query("op11_neardup")
def op11_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), words=5, numer=85)
