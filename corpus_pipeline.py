"""A corpus from raw documents: clear language, no near-copies, no repeated passages, mixed sources, piece ids.

Each stage gets what its predecessor kept. All but the last return the columns of ``documents``.
Spark reads files by size and not by name, so the last stage reads each document's place in the mixture from its
file and row, writes it beside the document, and ``run`` sorts by it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm.language import in_known_language
from larder.llm.mixing import in_mixed_order, with_stored_places
from larder.llm.neardup import one_of_each
from larder.llm.sentencepieces import coded
from larder.llm.substrings import repeats_removed
from larder.session import checkpoint_root

#: Model file of the last stage.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Of the mixture: weights as the square root of a source's documents.
MIXTURE = {"temperature": 0.5}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of which no language has half of the letters."""
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 20 words and more out of all documents but the first that has them."""
    return repeats_removed(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts documents in the order of the mixture."""
    return in_mixed_order(docs, **MIXTURE)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and place in the mixture, piece ids and their number, in the order of the mixture; the text is what the ids decode to.

    The order is the one in which ``mixing`` has written the documents.
    """
    return coded(with_stored_places(docs, slot="slot", place="place"), PIECES).withColumn("n_pieces", F.size("ids"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Language ID and piece ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` in the order of the mixture; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs.orderBy("slot", "place")
