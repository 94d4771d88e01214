"""Approximate nearest neighbours of the embeddings."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm.curves import near_neighbours
from larder.llm.registry import query


@query("op12_neighbours")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_neighbours(vectors, F.col("vec_id") % 100 == 0, k=10)
