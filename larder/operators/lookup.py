"""Lookup through ordered tiers, and what a cache still vouches for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.operators.latest import first_per_key

# Cached rows expire after 30 days or when the mapping changes.
CACHE_DAYS = 30
CACHE_SCHEMA = 2


def tiered_lookup(keys: DataFrame, tiers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """First tier that has a key answers for it. All tiers are read in one pass and reduced per key."""
    rows = None
    for no, (name, tier) in enumerate(tiers):
        tagged = tier.withColumn("source", F.lit(name)).withColumn("_tier", F.lit(no))
        rows = tagged if rows is None else rows.unionByName(tagged)
    wanted = rows.join(keys.select(key).distinct(), key, "left_semi")
    return first_per_key(wanted, [key], ["_tier"]).drop("_tier")


def is_stale(cached_at: Column, schema: Column, now: Column) -> Column:
    return (now - cached_at > F.expr(f"INTERVAL {CACHE_DAYS} DAYS")) | ~schema.eqNullSafe(F.lit(CACHE_SCHEMA))


def cache_get(cache: DataFrame, now: Column) -> DataFrame:
    """Rows that are neither too old nor written by another mapping."""
    return cache.filter(~is_stale(F.col("cached_at"), F.col("schema"), now))
