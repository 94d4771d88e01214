"""Token counts and SentencePiece digests of whole documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm.registry import query
from larder.llm.sentencepieces import piece_digests
from larder.llm.tokens import with_token_counts


@query("op5_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
