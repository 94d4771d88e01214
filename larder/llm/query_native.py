"""Queries that use DataFrame functions only."""

from pyspark.sql import DataFrame, SparkSession

from larder.llm.fingerprints import fingerprints as document_fingerprints
from larder.llm.mixing import mixed
from larder.llm.registry import query


@query("op6_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query("op8_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
