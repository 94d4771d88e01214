"""One row per key: latest, first, best. Aggregations instead of windows, so that a key with a
third of all rows is reduced before the shuffle and never gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: list[str], order: Column, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_"))
    chosen = (F.max_by if last else F.min_by)(row, order).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins. ``order`` columns must break every tie for a stable answer."""
    return _pick(df, keys, F.struct(*order), last=True)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First write wins, as in insert-or-ignore."""
    return _pick(df, keys, F.struct(*order), last=False)


def best_per_key(df: DataFrame, keys: list[str], points: Column, position: str) -> DataFrame:
    """Most points wins whole; on a tie the earlier row stays."""
    return _pick(df, keys, F.struct((-points).alias("p"), F.col(position).alias("q")), last=False)
