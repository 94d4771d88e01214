"""Incremental publishing: deltas per part, chains between versions and sync plans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from larder.operators.diff import changes
from larder.operators.prefix import top_n_per_group
from larder.session import cut_lineage

# Share of the catalogue above which a full download is cheaper; deltas kept per part.
DELTA_SHARE = 0.35
KEEP = 14


def delta_reasons(old_parts: DataFrame, new_parts: DataFrame, lacking: DataFrame) -> DataFrame:
    """Per country and part: ``delta`` or why there is none. Parts carry ``from_key``, ``to_key``, ``version``.

    ``lacking`` names stored parts without some column of the new generation.
    """
    old = old_parts.select("country", "part", F.col("from_key").alias("of"), F.col("to_key").alias("ot"),
                           F.col("version").alias("from_version"), F.lit(True).alias("known"))
    both = new_parts.join(old, ["country", "part"], "full_outer").withColumn("current", F.col("version"))
    same_cut = F.col("of").eqNullSafe(F.col("from_key")) & F.col("ot").eqNullSafe(F.col("to_key"))
    whole = Window.partitionBy("country")  # a country has few parts
    changed = lacking.select("country", F.col("part").cast("int").alias("part"), F.lit(True).alias("_lacks"))
    rows = both.withColumn("_present", F.col("products").isNotNull()).join(changed, ["country", "part"], "left")
    rows = (rows.withColumn("any_old", F.max(F.coalesce("known", F.lit(False))).over(whole))
            .withColumn("recut", F.max(~(F.coalesce("known", F.lit(False)) & F.col("_present") & same_cut)).over(whole)))
    reason = (F.when(~F.col("any_old"), "no-previous").when(F.col("recut"), "recut")
              .when(F.coalesce("_lacks", F.lit(False)), "schema-changed")
              .when(F.col("from_version").isNull() | F.col("current").isNull(), "no-version")
              .when(F.col("from_version") == F.col("current"), "same-version").otherwise("delta"))
    return rows.filter("_present").select("country", "part", "from_version", F.col("current").alias("to_version"), reason.alias("reason"))


def build_deltas(old: DataFrame, new: DataFrame, reasons: DataFrame, columns: list[str], index_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """All deltas in one job: the part is a column, not a loop. Returns changes and manifest."""
    allowed = reasons.filter(F.col("reason") == "delta").select("country", "part")
    key = ["country", "part", "barcode"]
    pick = lambda df: df.join(allowed, ["country", "part"], "left_semi")
    found = changes(pick(new), pick(old), key, columns, index_columns)
    counted = found.groupBy("country", "part").agg(
        F.count_if(F.col("op") == "u").alias("upserts"), F.count_if(F.col("op") == "d").alias("deletes"))
    manifest = reasons.join(counted, ["country", "part"], "left").select(
        "country", "part", F.col("from_version").alias("from"), F.col("to_version").alias("to"), "reason",
        *[F.when(F.col("reason") == "delta", F.coalesce(c, F.lit(0))).alias(c) for c in ("upserts", "deletes")])
    return found, manifest


def keep_last(deltas: DataFrame, n: int = KEEP) -> DataFrame:
    return top_n_per_group(deltas, ["country", "part"], ["to"], n, descending={"to"}).drop("rank")


def one_per_start(deltas: DataFrame) -> DataFrame:
    """One link for each start of a part: of republished ones the last, by its target and then its size."""
    return deltas.groupBy("country", "part", "from").agg(F.max(F.struct("to", "bytes")).alias("_last")).select(
        "country", "part", "from", "_last.to", "_last.bytes")


def walk_chains(starts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Follow ``from`` to ``to`` from the local to the published version of each part.

    ``starts``: country, part, local, published. Adds ``steps`` and ``bytes``, and ``complete``:
    false where a link is missing or the chain bites its tail.

    Pointer doubling: each round makes every link twice as long, so a chain of n links takes log2(n)
    rounds. The published version has no way out, so every whole chain ends there; a cycle never does.
    """
    key = ["country", "part"]
    deltas = one_per_start(deltas)
    goal = starts.select(*key, F.col("published").alias("at"))
    jump = deltas.select(*key, F.col("from").alias("at"), F.col("to").alias("next"), F.col("bytes").cast("double").alias("bytes"),
                         F.lit(1).alias("steps")).join(goal, [*key, "at"], "left_anti")
    longest = jump.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        ahead = jump.select(*key, F.col("at").alias("next"), F.col("next").alias("next2"), F.col("bytes").alias("bytes2"), F.col("steps").alias("steps2"))
        jump = cut_lineage(jump.join(ahead, [*key, "next"], "left").select(
            *key, "at", F.coalesce("next2", "next").alias("next"),
            (F.col("bytes") + F.coalesce("bytes2", F.lit(0.0))).alias("bytes"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")))
    reached = starts.join(jump.withColumnRenamed("at", "local"), [*key, "local"], "left")
    return reached.select(
        *key, "local", "published", F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("bytes", F.lit(0.0)).alias("bytes"),
        F.coalesce(F.coalesce("next", "local") == F.col("published"), F.lit(False)).alias("complete"))


def plan_sync(parts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Per part: up to date, a delta chain, or the whole catalogue and why.

    ``parts``: country, part, local, published, bytes. Every part has its own version.
    """
    open_parts = parts.filter(F.col("local").isNotNull() & F.col("published").isNotNull())
    walked = walk_chains(open_parts.select("country", "part", "local", "published"), deltas).select(
        "country", "part", "steps", F.col("bytes").alias("chain_bytes"), "complete")
    rows = parts.join(walked, ["country", "part"], "left")
    heavy = (F.col("bytes") > 0) & (F.col("chain_bytes") > F.col("bytes") * DELTA_SHARE)
    reason = (F.when(F.col("local").isNull(), "no-local-version").when(F.col("published").isNull(), "no-published-version")
              .when(F.col("local") == F.col("published"), None).when(~F.col("complete"), "broken-chain").when(heavy, "delta-too-large"))
    kind = F.when(F.col("reason").isNotNull(), "full").when(F.col("local") == F.col("published"), "up-to-date").otherwise("deltas")
    return rows.withColumn("reason", reason).withColumn("kind", kind).select(
        "country", "part", "kind", "reason",
        F.when(F.col("kind") == "deltas", F.col("steps")).otherwise(0).alias("steps"),
        F.when(F.col("kind") == "deltas", F.col("chain_bytes")).when(F.col("kind") == "full", F.col("bytes").cast("double")).otherwise(0.0).alias("transfer"))


def combine_plans(plans: DataFrame) -> DataFrame:
    """A country is up to date only if every part is; one full part makes the country a full download."""
    return plans.groupBy("country").agg(
        F.when(F.bool_and(F.col("kind") == "up-to-date"), "up-to-date").when(F.bool_or(F.col("kind") == "full"), "full")
        .otherwise("deltas").alias("kind"),
        F.count_if(F.col("kind") != "up-to-date").alias("stale_parts"), F.sum("transfer").alias("transfer"))


def sync_cost(plans: DataFrame) -> DataFrame:
    """Bytes to move per kind of plan. Without a published version nothing is known to be new."""
    known = plans.filter(~F.coalesce(F.col("reason") == "no-published-version", F.lit(False)))
    return known.filter(F.col("kind") != "up-to-date").groupBy("kind").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("transfer").alias("transfer"), F.max("steps").alias("longest_chain"))
