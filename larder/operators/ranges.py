"""Range joins: code to part, prefix to rule, number to interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.codes import GS1_NOTES, GS1_RULES, UNRESOLVABLE, catalog_priority, only_digits
from larder.operators.prefix import with_last_mark


def in_range(key: Column, low: Column, high: Column) -> Column:
    """Half-open [low, high); NULL ends are open. Codes are compared as text."""
    return (low.isNull() | (key >= low)) & (high.isNull() | (key < high))


#: Tasks over which the rows of one group are dealt when they meet the group's few lines.
DEAL = 64


def join_lines(rows: DataFrame, lines: DataFrame, group: list[str], key: str, how: str = "left") -> DataFrame:
    """Joins rows with a small table of lines a group, without gathering a group in one task.

    Rows are dealt by a hash of ``key`` beside their group, and the lines repeated for each of the deals,
    so a group with a third of all rows is spread like the others.
    """
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(DEAL)).cast("int"))
    repeated = lines.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    return dealt.join(repeated, [*group, "_deal"], how).drop("_deal")


#: Rows of a group from which on they are dealt over several tasks, and the share of all rows that one task may get.
DEAL_ROWS, DEAL_SHARE = 100_000, 500


def join_lines_by_size(rows: DataFrame, lines: DataFrame, group: list[str], key: str, how: str = "left") -> DataFrame:
    """As ``join_lines``, with as many deals as a group's rows need: one for most, so long lines aren't repeated.

    The groups with more than one deal are at most DEAL_SHARE, whatever the tables, and travel as a list.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.greatest(F.lit(DEAL_ROWS).cast("double"), F.sum("_n") / DEAL_SHARE).alias("_most"))
    hot = sizes.crossJoin(F.broadcast(most)).filter("_n > _most").select(*group, F.ceil(F.col("_n") / F.col("_most")).cast("int").alias("_deals"))
    dealt = rows.join(F.broadcast(hot), group, "left").withColumn("_deal", F.pmod(F.xxhash64(key), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
    repeated = lines.join(F.broadcast(hot), group, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    return dealt.join(repeated, [*group, "_deal"], how).drop("_deal")


def part_for(rows: DataFrame, parts: DataFrame, group: list[str], key: str, fallback_last: bool = False) -> DataFrame:
    """Adds ``part``. ``parts`` holds the ranges of each group, which don't overlap; there may be as many as rows.

    A row's range is the last one that starts at or before its key, found by sorting rows and starts together.
    Without ranges everything belongs to part 1.
    """
    starts = parts.select(*group, F.col("from_key").alias(key), F.struct("from_key", "to_key", "part").alias("_range"), "part")
    found = with_last_mark(rows, starts, group, key, "_range", "part")
    at = F.col("_range")
    hit = F.when(F.col(key).isNotNull() & in_range(F.col(key), at["from_key"], at["to_key"]), at["part"])
    if fallback_last:
        hit = F.coalesce(hit, F.col("last_no").cast("int"))
    return found.withColumn("part", F.when(F.col("last_no").isNull(), 1).otherwise(hit)).select(*rows.columns, "part")


def parts_of(entries: DataFrame) -> DataFrame:
    """Catalogue entries to part ranges; an entry without parts is one unbounded part."""
    single = F.array(F.struct(
        F.lit(1).alias("part"), F.lit(None).cast("string").alias("from_key"), F.lit(None).cast("string").alias("to_key")))
    listed = F.when(F.size("parts") > 0, F.col("parts")).otherwise(single)
    return entries.select("country", F.inline(listed))


def gs1_rules(spark, order: str = "as_published") -> DataFrame:
    """The rule list as data. ``most_specific`` tries three-digit prefixes before two-digit ones."""
    rows = []
    for no, (low, high, region, country, kind) in enumerate(GS1_RULES):
        digits = 2 if high <= 99 else 3
        priority = no if order == "as_published" else no + (1000 if digits == 2 else 0)
        rows.append((priority, digits, low, high, region, country, kind or "product"))
    return spark.createDataFrame(
        rows, "rule int, digits int, low int, high int, region string, country string, kind string")


def classify_barcodes(df: DataFrame, code: str, order: str = "as_published") -> DataFrame:
    """Adds ``kind``, ``region`` and ``country`` of the first matching rule, and ``note`` where it is no product.

    The rules only look at two or three digits, so they are joined with the 1000 possible prefixes
    once; codes then take an equi join with that 1000-row table.
    """
    spark = df.sparkSession
    prefixes = spark.range(1000).select(F.col("id").cast("int").alias("p3"), F.floor(F.col("id") / 10).cast("int").alias("p2"))
    rules = gs1_rules(spark, order)
    value = F.when(F.col("digits") == 2, F.col("p2")).otherwise(F.col("p3"))
    table = (prefixes.join(F.broadcast(rules), value.between(F.col("low"), F.col("high")))
             .groupBy("p3").agg(F.min_by(F.struct("kind", "region", "country"), "rule").alias("gs1")))
    digits = only_digits(F.col(code))
    # An eight-digit code has no usable prefix and a shorter one is no code at all.
    prefix = F.when(F.length(digits) > 8, F.left(digits, F.lit(3)).cast("int"))
    kind = F.when(F.length(digits) < 8, "unknown").otherwise(F.coalesce(F.col("gs1.kind"), F.lit("product")))
    return (df.withColumn("_p3", prefix).join(F.broadcast(table), F.col("_p3") == F.col("p3"), "left")
            .select(*df.columns, kind.alias("kind"), F.col("gs1.region").alias("region"), F.col("gs1.country").alias("country"))
            .withColumn("note", gs1_note(F.col("kind"))))


def gs1_note(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in GS1_NOTES.items() for x in pair]), kind)


def unresolvable(kind: Column) -> Column:
    return kind.isin(UNRESOLVABLE)


def with_catalog_order(classified: DataFrame, held: Column) -> DataFrame:
    return classified.withColumn("catalog_order", catalog_priority(F.col("country"), held))
