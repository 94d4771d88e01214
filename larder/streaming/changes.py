"""Raw change records onto a stored generation, in one batch or as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators import runs
from larder.operators.latest import latest_per_key


def apply_changes(base: DataFrame, records: DataFrame, countries: list[str], key: str = "barcode", order: list[str] = ("file",)) -> DataFrame:
    """For each record and country: upsert where it is sold and has a name, delete elsewhere.

    ``records`` has ``countries`` (array) and the base's columns but the country; ``order`` says
    which record of a key is the later one. Rows of keys that no record names stay as they are.
    """
    last = latest_per_key(records, [key], list(order))
    fresh = spoken(last, countries).filter("NOT _gone").select(*base.columns)
    untouched = base.join(last.select(key), key, "left_anti").unionByName(
        base.filter(~F.col("country").isin(countries)).join(last.select(key), key, "left_semi"))
    return untouched.select(*base.columns).unionByName(fresh)


def spoken(last: DataFrame, countries: list[str]) -> DataFrame:
    """What each record says about every country: a row there, or, ``_gone``, that there is none.

    The explode is a fixed factor, not data dependent.
    """
    spread = last.withColumn("country", F.explode(F.array(*[F.lit(c) for c in countries])))
    sold = F.array_contains("countries", F.col("country")) & F.col("name").isNotNull()
    return spread.withColumn("_gone", ~F.coalesce(sold, F.lit(False)))


# ---------------------------------------------------------------- generations on disk

def read_current(spark: SparkSession, root: str, key: str = "barcode") -> DataFrame | None:
    """The current generation; None before the first one."""
    return runs.read_rows(spark, root, ["country", key])


def commit(df: DataFrame, root: str, batch: int, countries: list[str], key: str, order: list[str]) -> None:
    """Add a batch of records to the stored generation as a run of changes; nothing else of it is read or written,
    unless runs have become alike in size and are merged."""
    said = spoken(latest_per_key(df, [key], order), countries).drop("countries", *order)
    # Of a row that is gone only the key is kept.
    rest = [c for c in said.columns if c not in ("country", key, "_gone")]
    rows = said.select("country", key, "_gone", *[F.when(~F.col("_gone"), F.col(c)).alias(c) for c in rest])
    runs.append(df.sparkSession, root, batch, rows, ["country", key])


def stream_changes(spark: SparkSession, landing: str, root: str, checkpoint: str, schema: str, countries: list[str],
                   key: str = "barcode", order: list[str] = ("file",), prepare: Callable[[DataFrame], DataFrame] | None = None,
                   files_per_batch: int = 1000) -> StreamingQuery:
    """Apply change files as they land; a batch writes what it changes, and the store merges its runs by size.

    ``availableNow`` drains what has landed in batches of at most ``files_per_batch`` files and stops, so a
    nightly job and a live one share the code. Records without a key are left out.
    """
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landing)

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        commit(rows.filter(F.col(key).isNotNull()), root, batch_id, countries, key, list(order))

    return (records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
