"""A keyed table that takes changes without rewriting itself: Parquet runs, merged when they are read.

Every batch of changes is written once, as a run of its own, sorted by key: the rows that are new or changed
and, marked as gone, the keys that were deleted. Reading takes of each key the newest run that speaks about it.
A run that has grown to a fixed share of the one before it is merged with it, so there are few runs (their
number follows the logarithm of the rows) and a row is written again only as often; the oldest run is the base,
where deleted keys are dropped. A run may hold details, tables of rows that belong to its keys and are replaced
with them.

A manifest of a few lines a batch says which runs are live. Data is written before its manifest and both are
named by the batch, so a batch that runs again after a failure leaves what it would have left the first time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from larder.operators.diff import drop_keys
from larder.operators.latest import latest_per_key
from larder.session import discard

#: A run is merged into the one before it once that is less than so many times as large.
RATIO = 4
_MANIFEST = "no int, path string, rows long, totals map<string,bigint>"


def manifest(spark: SparkSession, root: str, before: int | None = None) -> list[Row]:
    """Live runs of the last batch (before the one given), oldest first: no, path, rows, totals. As many as there are runs."""
    try:
        lines = spark.read.schema(f"{_MANIFEST}, batch long").option("basePath", f"{root}/manifest").json(f"{root}/manifest/batch=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    if before is not None:
        lines = lines.filter(F.col("batch") < before)
    last = lines.agg(F.max("batch").alias("_last"))
    return lines.join(F.broadcast(last), F.col("batch") == F.col("_last")).select("no", "path", "rows", "totals", "batch").orderBy("no").collect()


def _table(spark: SparkSession, runs: list[Row], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{r.path}/{name}").withColumn("_run", F.lit(r.no)) for r in runs])


def newest(spark: SparkSession, runs: list[Row], keys: list[str]) -> DataFrame:
    """Rows of the newest run of each key, gone ones included, with ``_run``.

    The oldest run is by far the largest: what the others say is settled among them, and takes its keys away.
    """
    base = _table(spark, runs[:1], "rows")
    if len(runs) == 1:
        return base
    later = latest_per_key(_table(spark, runs[1:], "rows"), keys, ["_run"])
    return drop_keys(base, later, keys).unionByName(later)


def read_rows(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """The table as it is now; None before the first batch."""
    runs = manifest(spark, root)
    return newest(spark, runs, keys).filter("NOT _gone").drop("_gone", "_run") if runs else None


def _detail(spark: SparkSession, runs: list[Row], keys: list[str], name: str) -> DataFrame:
    base = _table(spark, runs[:1], name)
    if len(runs) == 1:
        return base
    # Keys only: the columns of the rows stay unread.
    later = latest_per_key(_table(spark, runs[1:], "rows").select(*keys, "_run"), keys, ["_run"])
    return drop_keys(base, later, keys).unionByName(_table(spark, runs[1:], name).join(later, [*keys, "_run"], "left_semi"))


def read_detail(spark: SparkSession, root: str, keys: list[str], name: str) -> DataFrame | None:
    """Detail rows of the keys as they are now."""
    runs = manifest(spark, root)
    return _detail(spark, runs, keys, name).drop("_run") if runs else None


def _write(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> int:
    """Writes the tables of a run, each sorted; gives the number of its rows."""
    for name, (df, order) in tables.items():
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")
    return tables["rows"][0].sparkSession.read.parquet(f"{path}/rows").count()  # from the files' footers


def append(spark: SparkSession, root: str, batch: int, rows: DataFrame, keys: list[str], details: dict[str, tuple[DataFrame, list[str]]] | None = None,
           totals: dict[str, int] | None = None, ratio: int = RATIO, keep: int = 2) -> list[Row]:
    """Adds a batch of changes and merges the runs that have become alike in size; gives the live runs.

    ``rows`` holds each key at most once, keys aren't NULL, ``_gone`` marks deleted ones. ``details`` names
    further tables and the order each is stored in. ``totals`` are a few numbers about the whole table that its
    owner keeps up. Runs that none of the last ``keep`` manifests names are removed.
    """
    details = details or {}
    before = manifest(spark, root, before=batch)
    no = max((r.no for r in before), default=-1) + 1
    path = f"{root}/runs/batch={batch:010d}"
    fresh = _write({"rows": (rows, keys), **details}, path)
    runs = [*before, Row(no=no, path=path, rows=fresh, totals=totals, batch=batch)]
    # How many of the newest runs become one.
    size, count = fresh, 1
    while count < len(runs) and runs[-count - 1].rows < ratio * size:
        size, count = size + runs[-count - 1].rows, count + 1
    if count > 1:
        merged, oldest = runs[-count:], count == len(runs)
        both = newest(spark, merged, keys).drop("_run")
        parts = {"rows": (both.filter("NOT _gone") if oldest else both, keys)}
        for name, (_, order) in details.items():
            parts[name] = (_detail(spark, merged, keys, name).drop("_run"), order)
        path = f"{root}/runs/batch={batch:010d}-merged"
        runs = [*runs[:-count], Row(no=merged[0].no, path=path, rows=_write(parts, path), totals=totals, batch=batch)]
    lines = spark.createDataFrame([(r.no, r.path, r.rows, totals) for r in runs], _MANIFEST)
    lines.coalesce(1).write.mode("overwrite").json(f"{root}/manifest/batch={batch:010d}")
    if count > 1:  # no manifest ever named it
        discard(spark, f"{root}/runs/batch={batch:010d}")
    _forget(spark, root, keep)
    return runs


def _forget(spark: SparkSession, root: str, keep: int) -> None:
    """Removes manifests but for the last ones, and the runs that only those named."""
    lines = spark.read.schema(f"{_MANIFEST}, batch long").option("basePath", f"{root}/manifest").json(f"{root}/manifest/batch=*")
    named = lines.select("batch", "path").distinct().collect()  # a few lines a batch, of keep + 1 batches
    kept = set(sorted({r.batch for r in named}, reverse=True)[:keep])
    alive = {r.path for r in named if r.batch in kept}
    gone = {r.batch for r in named} - kept
    discard(spark, *[f"{root}/manifest/batch={b:010d}" for b in sorted(gone)], *sorted({r.path for r in named} - alive))


def read_totals(spark: SparkSession, root: str) -> dict[str, int]:
    return next((dict(r.totals) for r in manifest(spark, root) if r.totals), {})
