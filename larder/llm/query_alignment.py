"""Tokens of two public tokenizers aligned over whole documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm.alignment import aligned
from larder.llm.registry import query

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op13_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return aligned(docs, public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))
