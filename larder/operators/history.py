"""Scan history, recent searches, cache and contribution queue as views over append logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from larder.operators.latest import first_per_key
from larder.operators.prefix import top_n_per_group, with_running


def history_view(scans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per code: the last scan, and the star if any scan ever set it."""
    rest = [c for c in scans.columns if c not in (*keys, "starred")]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return scans.groupBy(*keys).agg(last, F.bool_or(F.coalesce("starred", F.lit(False))).alias("starred")).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in rest], "starred")


def history_page(history: DataFrame, n: int = 100, tie: str = "barcode") -> DataFrame:
    return history.orderBy(F.col("scanned_at").desc(), F.col(tie).asc()).limit(n)


def starred(history: DataFrame) -> DataFrame:
    return history.filter("starred")


def clear_recent(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): starred entries stay; the rest is handed back so it can be restored."""
    keep = F.coalesce("starred", F.lit(False))
    return history.filter(keep), history.filter(~keep)


def restore(history: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Put removed entries back; one that has come back by itself meanwhile is not doubled."""
    both = history.withColumn("_order", F.lit(0)).unionByName(removed.withColumn("_order", F.lit(1)))
    return first_per_key(both, keys, ["_order"]).drop("_order")


def recent_searches(searches: DataFrame, n: int = 6) -> DataFrame:
    """Distinct terms of each user, newest first."""
    last = searches.groupBy("user_id", "term").agg(F.max("at").alias("at"))
    return top_n_per_group(last, ["user_id"], ["at", "term"], n, descending={"at"})


def pending(contributions: DataFrame) -> DataFrame:
    return contributions.filter(F.col("status") == "pending")


def export_queue(contributions: DataFrame) -> DataFrame:
    """One JSON text per contribution: code, time and the payload's own fields."""
    return contributions.select(F.to_json(F.struct("barcode", "created_at", "payload.*")).alias("value"))


# ---------------------------------------------------------------- debounce

def keep_first_after(rows: Iterator[pd.DataFrame], user: str, seconds: float) -> Iterator[pd.DataFrame]:
    """Greedy emission over rows sorted by (user, run, at): the first of a run, then each row at
    least ``seconds`` after the last one kept. State is one row, whatever the length of a run."""
    run, last = None, None
    for batch in rows:
        keep = []
        for u, r, at in zip(batch[user], batch["_run"], batch["_at"]):
            emit = (u, r) != run or at - last >= seconds
            keep.append(emit)
            if emit:
                run, last = (u, r), at
        yield batch[keep]


def debounce(scans: DataFrame, user: str, code: str, at: str, tie: str, seconds: float) -> DataFrame:
    """Drop a scan that repeats the code emitted just before, less than ``seconds`` ago.

    A row certainly emits where the code changes or where the row before it is at least ``seconds``
    older, so those rows cut a user's scans into runs that do not depend on each other. The row
    before comes from a join on (user, rank), so one busy user is spread over many tasks; only runs
    of close repeats need the sequential rule.
    """
    ranked = with_running(scans, [user], [at, tie]).drop("group_rows").withColumnRenamed("rank", "_rank")
    before = ranked.select(user, (F.col("_rank") + 1).alias("_rank"), F.col(code).alias("_code"), F.col(at).alias("_before"))
    joined = ranked.join(before, [user, "_rank"], "left")
    gap = F.col(at).cast("double") - F.col("_before").cast("double")
    starts = ~F.col("_code").eqNullSafe(F.col(code)) | F.coalesce(gap >= seconds, F.lit(True))
    runs = with_running(joined.withColumn("_start", starts.cast("int")).drop("_code", "_before"), [user], ["_rank"], {"_run": "_start"})
    runs = runs.select(*scans.columns, "_run", F.col(at).cast("double").alias("_at"))
    sizes = runs.groupBy(user, "_run").agg(F.count(F.lit(1)).alias("_n"))
    sized = runs.join(sizes, [user, "_run"])
    single = sized.filter(F.col("_n") == 1).drop("_n")
    several = sized.filter(F.col("_n") > 1).drop("_n").select(*runs.columns)
    schema = several.schema
    kept = (several.repartition(user, "_run").sortWithinPartitions(user, "_run", at, tie)
            .mapInPandas(lambda it: keep_first_after(it, user, seconds), schema))
    return single.select(*scans.columns).unionByName(kept.select(*scans.columns))


def sample_docs(docs: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """A repeatable random sample of ``n`` rows: the smallest MD5 hashes of key and seed, which any engine has."""
    return docs.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), key).limit(n)
