"""Delta interchange files: a header line, then one JSON line per change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


FORMAT = 1


def change_lines(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Change rows as text: values for upserts, the key alone for deletes. NULL columns are written
    out, so that a reader can tell them from columns the file does not have."""
    keys = [c for c in changes.columns if c not in ("op", "fts", "country", "part", *columns)]
    whole = F.to_json(F.struct("op", "fts", *keys, *columns), {"ignoreNullFields": "false"})
    short = F.to_json(F.struct("op", *keys))
    return changes.select("country", "part", F.when(F.col("op") == "u", whole).otherwise(short).alias("value"))


def header_lines(manifest: DataFrame, columns: list[str]) -> DataFrame:
    head = F.struct(F.lit(FORMAT).alias("format"), "country", "part", "from", "to", "upserts", "deletes",
                    F.array(*[F.lit(c) for c in columns]).alias("columns"))
    return manifest.filter(F.col("reason") == "delta").select("country", "part", F.to_json(head).alias("value"))


def write_delta(changes: DataFrame, manifest: DataFrame, columns: list[str], path: str) -> None:
    """One folder per country and part. A hot part is written by many tasks, so the header is a line
    of its own wherever it lands rather than the first line of a single file."""
    lines = change_lines(changes, columns).unionByName(header_lines(manifest, columns))
    lines.write.mode("overwrite").partitionBy("country", "part").option("compression", "gzip").text(path)


def _field(name: str, kind: str = "string") -> Column:
    return F.get_json_object("value", f"$.{name}").cast(kind)


def read_delta(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(headers with ``status``, changes of the accepted deltas).

    A delta whose format is unknown or whose counts differ from its header is refused whole: half of
    it would leave a generation that is no version at all.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    is_head = _field("format").isNotNull()
    found = lines.groupBy("country", "part").agg(
        F.count_if(_field("op") == "u").alias("found_upserts"), F.count_if(_field("op") == "d").alias("found_deletes"),
        F.max(F.when(is_head, F.col("value"))).alias("value"))
    status = (F.when(F.col("value").isNull(), "no-header").when(_field("format", "int") != FORMAT, "unknown-format")
              .when((F.col("found_upserts") != _field("upserts", "long")) | (F.col("found_deletes") != _field("deletes", "long")), "incomplete")
              .otherwise("ok"))
    headers = found.select("country", "part", _field("from").alias("from"), _field("to").alias("to"), "found_upserts", "found_deletes", status.alias("status"))
    accepted = headers.filter(F.col("status") == "ok").select("country", "part")
    rows = lines.filter(~is_head).join(accepted, ["country", "part"], "left_semi")
    return headers, rows.select("country", "part", F.from_json("value", schema).alias("r")).select("country", "part", "r.*")


NAME = r"_(\d+)_(\d+)\.json\.gz$"


def pending_files(listing: DataFrame, since: int) -> DataFrame:
    """Change files that end after the previous generation, oldest first to be applied in order.

    Fails where the previous generation is older than the history: a gap cannot be closed by deltas.
    """
    named = listing.filter(F.col("path").rlike(NAME)).select(
        "path", F.regexp_extract("path", NAME, 1).cast("long").alias("from"), F.regexp_extract("path", NAME, 2).cast("long").alias("to"))
    # One row: how many names there are and how many of them are change files.
    seen = listing.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("path").rlike(NAME)).alias("_known"))
    checked = seen.filter(F.assert_true((F.col("_all") == 0) | (F.col("_known") > 0), F.lit("no file name is that of a change file")).isNull())
    named = named.crossJoin(F.broadcast(checked)).drop("_all", "_known")
    oldest = named.agg(F.min("from").alias("oldest"))
    return (named.crossJoin(F.broadcast(oldest))
            .filter(F.assert_true(F.coalesce(F.col("oldest") <= since, F.lit(True)), F.lit("previous generation is older than the history")).isNull())
            .filter(F.col("to") > since).drop("oldest"))


def pending(spark: SparkSession, folder: str, since: int) -> DataFrame:
    """The pending change files of a landing folder, oldest first."""
    return pending_files(list_files(spark, folder), since).orderBy("from", "to")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File names of a landing folder, without reading their content."""
    return spark.read.format("binaryFile").load(path).select("path")
