"""Queries with models that are learned from the tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm import language, quality, toxicity
from larder.llm.registry import query


@query("op1_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, network)


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.trained(docs.filter(~quality.held_out("doc_id")).select("text", "lang"))
    told = language.with_languages(docs.select("doc_id", "text"), model)
    return told.select("doc_id", quality.held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


@query("op7_toxicity")
def toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.graded(docs, model)
