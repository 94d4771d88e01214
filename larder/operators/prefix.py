"""Running totals, ranks and cuts without a single-partition window.

A window over a whole group puts the group in one task. Here rows are range-partitioned over
(group, order), which splits even a group with a third of all rows; sums of the buckets give each
bucket its offset, and only the inside of a bucket is windowed. Buckets hold a bounded number of rows, whatever
the shuffle setting: there are more of them where a table needs more.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.session import cut_lineage


def _ordered(names: list[str], descending: set[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_first() for c in names]


#: Rows of a bucket, but for the error of the sampled bounds.
BUCKET_ROWS = 2_000_000


def _placed(df: DataFrame, group: list[str], sort: list[Column], buckets: int) -> tuple[DataFrame, int]:
    """Rows with ``_bucket``, a range of (group, order), on reliable storage, and how many there are.

    Range bounds are sampled, so a recomputed stage could cut elsewhere: the buckets are fixed first.
    """
    ranged = df.repartitionByRange(buckets, *[F.col(g) for g in group], *sort).withColumn("_bucket", F.spark_partition_id())
    placed = cut_lineage(ranged)
    return placed, placed.count()


def _bounded(df: DataFrame, group: list[str], sort: list[Column], buckets: int) -> DataFrame:
    """As ``_placed``, in as many buckets as the rows need."""
    placed, rows = _placed(df, group, sort, buckets)
    if rows > buckets * BUCKET_ROWS:
        # The setting is too small for this table: a bucket is windowed in one task, so its size is bounded.
        placed, _ = _placed(placed.drop("_bucket"), group, sort, math.ceil(rows / BUCKET_ROWS))
    return placed


def with_last_mark(rows: DataFrame, marks: DataFrame, group: list[str], key: str, mark: str, no: str, buckets: int | None = None) -> DataFrame:
    """Adds ``mark``, that of the last of ``marks`` (group, key, mark, no) at or before the row's key in its group, and
    ``last_no``, the highest number of the group's marks; both NULL where there is none.

    Rows and marks are sorted together, in buckets as in ``with_running``, and a bucket starts with the last mark of
    those before it: no list of marks is ever held beside a row. A NULL key comes first, of equal keys the highest ``no``
    counts, and rows of a NULL group meet no marks.
    """
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = marks.select(*group, key, mark, F.col(no).cast("long").alias("_no")).dropna(subset=group).withColumn("_row", F.lit(False))
    # Rows have numbers as well, so that those of one key are spread like others.
    both = known.unionByName(rows.withColumns({"_no": F.monotonically_increasing_id(), "_row": F.lit(True)}), allowMissingColumns=True)
    sort = _ordered([key, "_row", "_no"], set())
    placed = _bounded(both, group, sort, buckets)
    heads = placed.groupBy(*group, "_bucket").agg(
        F.max_by(mark, F.when(~F.col("_row"), F.struct(key, "_no"))).alias("_head"), F.max(F.when(~F.col("_row"), F.col("_no"))).alias("_most"))
    # At most one row per group and bucket: small enough for a plain window.
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*group, "_bucket", F.last("_head", ignorenulls=True).over(before).alias("_before"), F.max("_most").over(Window.partitionBy(*group)).alias("last_no"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_here", F.last(mark, ignorenulls=True).over(inside)).filter("_row")
    same = reduce(lambda a, b: a & b, [local[g].eqNullSafe(heads[g]) for g in group] + [local["_bucket"] == heads["_bucket"]])
    joined = local.join(heads, same).select(local["*"], heads["_before"], heads["last_no"])
    return joined.select(*rows.columns, F.coalesce("_here", "_before").alias(mark), "last_no")


def ranges_from(keys: DataFrame, group: list[str], key: str) -> DataFrame:
    """A part from each of a group's distinct keys on, and part 1 before all: (group, part, from_key, to_key), for any number of keys."""
    ranked = with_running(keys.select(*group, key), group, [key])
    ends = ranked.select(*group, F.inline(F.array(
        F.struct((F.col("rank") + 1).alias("part"), F.col(key).alias("from_key"), F.lit(None).cast("string").alias("to_key")),
        F.struct(F.col("rank").alias("part"), F.lit(None).cast("string").alias("from_key"), F.col(key).alias("to_key")))))
    return ends.groupBy(*group, F.col("part").cast("int").alias("part")).agg(F.max("from_key").alias("from_key"), F.max("to_key").alias("to_key"))


def with_running(df: DataFrame, group: list[str], order: list[str], measures: dict[str, str] | None = None,
                 descending: set[str] = frozenset(), buckets: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based), ``group_rows`` and, per measure, its running and group total.

    ``order`` must be unique within a group. ``measures`` maps an output name to a column: outputs
    are ``<name>`` (running, inclusive) and ``<name>_total``.
    """
    measures = measures or {}
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = _ordered(order, set(descending))
    placed = _bounded(df, group, sort, buckets)
    sums = placed.groupBy(*group, "_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in measures.items()])
    # At most one row per group and bucket: small enough for a plain window.
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = sums.select(
        *group, "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_offset"),
        F.sum("_rows").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in measures],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in measures])
    inside = Window.partitionBy(*group, "_bucket").orderBy(*sort)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_rn", F.row_number().over(inside)).withColumns(
        {f"_run_{n}": F.sum(c).over(running) for n, c in measures.items()})
    same = reduce(lambda a, b: a & b, [local[g].eqNullSafe(offsets[g]) for g in group] + [local["_bucket"] == offsets["_bucket"]])
    joined = local.join(offsets, same).select(local["*"], *[offsets[c] for c in offsets.columns if c not in (*group, "_bucket")])
    return joined.select(
        *df.columns, (F.col("_rn") + F.col("_row_offset")).alias("rank"), "group_rows",
        *[(F.col(f"_run_{n}") + F.col(f"_offset_{n}")).alias(n) for n in measures], *[f"{n}_total" for n in measures])


def weight_cuts(df: DataFrame, group: list[str], key: str, weight: str, parts: int) -> DataFrame:
    """Keys that cut each group into ``parts`` pieces of equal weight: (group, cut_no, cut_key)."""
    per_key = df.groupBy(*group, key).agg(F.sum(weight).alias(weight), F.lit(parts).alias("_parts"))
    return weight_cuts_by(per_key, group, key, weight, "_parts")


def weight_cuts_by(per_key: DataFrame, group: list[str], key: str, weight: str, parts: str) -> DataFrame:
    """As ``weight_cuts``, from one row per key and with the number of parts as a column.

    The k-th cut is the first key whose running weight reaches k/parts of the total; a key is used
    for one cut only, so a very heavy key pushes the next cut to the key after it.
    """
    ranked = with_running(per_key.select(*group, key, F.col(weight).alias("_w"), F.col(parts).alias("_parts")),
                          group, [key], {"cum": "_w"})
    # Targets a row is the first to reach: those above the sum before it and up to its own.
    step = F.col("cum_total") / F.col("_parts")
    low = F.floor((F.col("cum") - F.col("_w")) / step) + 1
    high = F.least(F.floor(F.col("cum") / step), F.col("_parts") - 1)
    reached = ranked.filter(high >= low).select(
        *group, F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("cut_no"), F.col("rank").alias("first"))
    # parts - 1 rows per group from here on.
    w = Window.partitionBy(*group).orderBy("cut_no").rowsBetween(Window.unboundedPreceding, 0)
    at = reached.select(*group, "cut_no", (F.max(F.col("first") - F.col("cut_no")).over(w) + F.col("cut_no")).alias("rank"))
    return at.join(ranked.select(*group, "rank", F.col(key).alias("cut_key")), [*group, "rank"]).select(*group, "cut_no", "cut_key")


def part_ranges(cuts: DataFrame, group: list[str]) -> DataFrame:
    """Cuts to half-open ranges (group, part, from_key, to_key); the ends are NULL."""
    w = Window.partitionBy(*group).orderBy("cut_no")
    ends = cuts.select(*group, (F.col("cut_no") + 1).alias("part"), F.col("cut_key").alias("from_key"),
                       F.lead("cut_key").over(w).alias("to_key"))
    first = cuts.filter(F.col("cut_no") == 1).select(
        *group, F.lit(1).alias("part"), F.lit(None).cast("string").alias("from_key"), F.col("cut_key").alias("to_key"))
    return first.unionByName(ends)


#: Spark pushes a row-number limit below the shuffle up to this many rows per group.
GROUP_LIMIT = 1000


def top_n_per_group(df: DataFrame, group: list[str], order: list[str], n: int, descending: set[str] = frozenset()) -> DataFrame:
    """First ``n`` rows of each group; adds ``rank``. ``order`` must be unique within a group."""
    if n <= GROUP_LIMIT:
        w = Window.partitionBy(*group).orderBy(*_ordered(order, set(descending)))
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return with_running(df, group, order, descending=descending).filter(F.col("rank") <= n).drop("group_rows")


def position_in_group(df: DataFrame, group: list[str], value: str, digits: int = 2) -> DataFrame:
    """Rank of ``value`` in its group over rows - 1: 0 is the smallest; ties share the first place.

    NULL values have no place, nor has a group with fewer than two values. Adds ``position``,
    ``group_min`` and ``group_max``.
    """
    from larder.functions.numeric import half_up

    distinct = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    run = with_running(distinct, group, [value], {"_cum": "_n"})
    place = (F.col("_cum") - F.col("_n")) / (F.col("_cum_total") - 1)
    ends = distinct.groupBy(*group).agg(F.min(value).alias("group_min"), F.max(value).alias("group_max"))
    places = run.filter(F.col("_cum_total") >= 2).select(*group, value, half_up(place, digits).alias("position"))
    return df.join(places.join(ends, group), [*group, value], "left")
