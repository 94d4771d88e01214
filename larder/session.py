"""Session defaults and the few environment decisions the operators rely on."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "larder", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and hand-over tables.

    A cluster names it in ``spark.checkpoint.dir``. Only on one machine, where that is unset (tests), a
    folder is made up, and removed when Python ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so a lost executor never recomputes a different answer."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keep later filters on computed columns above this point.

    The optimizer pushes a filter through projections by writing the column's expression into it;
    over a chain of rules that multiplies the plan. A generator of one row stops that, while filters
    on ``keys`` still reach the scan.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.inline(F.array(F.struct(*rest)))).select(*df.columns)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes folders or files, wherever they are stored."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def files_stamp(spark: SparkSession, path: str) -> str:
    """Changes whenever the files below a path do: their names, sizes and times, hashed."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    held, seen = list(found or []), []
    while held:
        one = held.pop()
        if one.isDirectory():
            held += list(one.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(one.getPath()))
        else:
            seen.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
