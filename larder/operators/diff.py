"""Differences between two generations, and applying them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.operators.latest import latest_per_key
from larder.schema import shared_columns


def row_changed(new: str, old: str, columns: list[str]) -> Column:
    """Null-safe: NULL to value is a change, NULL to NULL is none."""
    return reduce(or_, [~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}")) for c in columns], F.lit(False))


def changes(new: DataFrame, old: DataFrame, key: list[str], columns: list[str], index_columns: list[str]) -> DataFrame:
    """Upserts (``op`` u, with the new values) and deletes (``op`` d) from one full outer join.

    ``fts`` tells whether the columns of the text index changed. Both sides are shuffled on the key
    once; where they are bucketed by it, not at all.
    """
    on = reduce(lambda a, b: a & b, [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key])
    n = new.select(*key, *columns, F.lit(True).alias("_in")).alias("n")
    o = old.select(*key, *columns, F.lit(True).alias("_in")).alias("o")
    added, gone = F.col("o._in").isNull(), F.col("n._in").isNull()
    return n.join(o, on, "full_outer").filter(added | gone | row_changed("n", "o", columns)).select(
        F.when(gone, "d").otherwise("u").alias("op"),
        F.when(gone, None).when(added | row_changed("n", "o", index_columns), 1).otherwise(0).alias("fts"),
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key], *[F.col(f"n.{c}").alias(c) for c in columns])


def upserts(new: DataFrame, old: DataFrame, key: list[str], columns: list[str], index_columns: list[str]) -> DataFrame:
    """New or changed rows only: left join with null-safe residual."""
    on = reduce(lambda a, b: a & b, [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key])
    o = old.select(*key, *columns, F.lit(True).alias("_in")).alias("o")
    added = F.col("o._in").isNull()
    return new.alias("n").join(o, on, "left").filter(added | row_changed("n", "o", columns)).select(
        *[F.col(f"n.{c}") for c in (*key, *columns)], (added | row_changed("n", "o", index_columns)).cast("int").alias("fts"))


def deletes(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    return old.select(*key).join(new.select(*key), key, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return df.join(keys.select(*key), key, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return df.join(keys.select(*key), key, "left_anti")


def apply_delta(base: DataFrame, delta: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The next generation. Only columns both sides know are written; others of the base become
    NULL in changed rows, as in a row replacement."""
    known = shared_columns(base, columns)
    fresh = delta.filter(F.col("op") == "u").select(*key, *[c for c in known if c in delta.columns])
    return drop_keys(base, delta, key).unionByName(fresh, allowMissingColumns=True).select(*base.columns)


def _prints(df: DataFrame, part: list[str], columns: list[str], sign: int) -> DataFrame:
    """Per part two sums of row hashes and the number of rows: equal for equal multisets of rows, in whatever order."""
    # A hash passes NULLs over, so that they are NULL is hashed as well.
    cells = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    hashed = [F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)") for seed in (1, 2)]
    return df.groupBy(*part).agg(*[(F.sum(h) * sign).cast("decimal(38,0)").alias(f"_h{i}") for i, h in enumerate(hashed)], (F.count(F.lit(1)) * sign).alias("_n"))


def differing_parts(old: DataFrame, delta: DataFrame, new: DataFrame, key: list[str], columns: list[str], part: list[str]) -> DataFrame:
    """Parts in which old + delta isn't new, found by sums alone.

    Sums are taken where the rows lie; only the few rows that the delta touches are joined, and only one row a
    part is shuffled. Sums are 128 bits together, so parts that differ don't agree by chance.
    """
    cols = [*key, *columns]
    kept = old.select(*cols)
    touched = keep_keys(kept, delta, key)
    fresh = apply_delta(kept.filter(F.lit(False)), delta, key, columns).select(*cols)
    sides = [(kept, 1), (touched, -1), (fresh, 1), (new.select(*cols), -1)]
    every = reduce(DataFrame.unionByName, [_prints(df, part, cols, sign) for df, sign in sides])
    sums = every.groupBy(*part).agg(*[F.sum(c).alias(c) for c in ("_h0", "_h1", "_n")])
    return sums.filter("_h0 <> 0 OR _h1 <> 0 OR _n <> 0").select(*part)


def violations(old: DataFrame, delta: DataFrame, new: DataFrame, key: list[str], columns: list[str], part: list[str] | None = None) -> DataFrame:
    """Rows in which old + delta and new differ, and on which side; empty for a right delta.

    Both directions are tested: one alone would miss a forgotten delete. Rows are compared one by one only in the
    parts whose sums differ; ``part`` are columns of the key (country and part, if it has them).
    """
    part = [c for c in ("country", "part") if c in key] if part is None else part
    cols = [*key, *columns]
    if part:
        odd = differing_parts(old, delta, new, key, columns, part)
        old, delta, new = (df.join(odd, part, "left_semi") for df in (old, delta, new))
    got, want = apply_delta(old.select(*cols), delta, key, columns), new.select(*cols)
    return (got.exceptAll(want).withColumn("side", F.lit("unexpected"))
            .unionByName(want.exceptAll(got).withColumn("side", F.lit("missing"))))


def compact_chain(deltas: DataFrame, key: list[str], step: str) -> DataFrame:
    """Several deltas as one: the last change of each key, indexed again if any step asks for it."""
    asked = deltas.groupBy(*key).agg(F.max(F.coalesce("fts", F.lit(1))).alias("_fts"))
    last = latest_per_key(deltas, key, [step])
    return last.join(asked, key).withColumn("fts", F.when(F.col("op") == "u", F.col("_fts"))).drop("_fts")


def check_links(links: DataFrame, bases: DataFrame) -> DataFrame:
    """Links that must not be applied, with the reason.

    ``links``: country, part, step, from, to; ``bases``: country, part, version that is held. A link needs a
    base of its own country and part, and starts where the step before it ended, the first one at the base.
    """
    key = ["country", "part"]
    before = Window.partitionBy(*key).orderBy("step")  # a part keeps few deltas
    ahead = links.withColumn("_before", F.lag("to").over(before)).withColumn("_first", F.row_number().over(before) == 1)
    held = ahead.join(bases.select(*key, "version", F.lit(True).alias("_held")), key, "left")
    start = F.when(F.col("_first"), F.col("version")).otherwise(F.col("_before"))
    reason = F.when(F.col("_held").isNull(), "no-base").when(~F.col("from").eqNullSafe(start), "wrong-start")
    return held.withColumn("reason", reason).filter("reason IS NOT NULL").select(*key, "step", "from", "to", "reason")


def applicable_links(links: DataFrame, bases: DataFrame) -> DataFrame:
    """Links up to the first one of each part that must not be applied."""
    key = ["country", "part"]
    broken = check_links(links, bases).groupBy(*key).agg(F.min("step").alias("_stop"))
    return links.join(broken, key, "left").filter(F.col("_stop").isNull() | (F.col("step") < F.col("_stop"))).select(*links.columns)


def apply_chain(base: DataFrame, deltas: DataFrame, cache: DataFrame, key: list[str], columns: list[str], step: str,
                links: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base after all deltas, and the cache without the keys they touched. One pass, not one per delta.

    ``links`` names each delta's country, part, step, from and to, ``bases`` the version held of each part.
    A delta whose link doesn't fit is refused, and so are those after it.
    """
    fits = applicable_links(links, bases).select("country", "part", F.col("step").alias(step))
    merged = compact_chain(deltas.join(fits, ["country", "part", step], "left_semi"), key, step)
    return apply_delta(base, merged, key, columns), drop_keys(cache, merged, key)
