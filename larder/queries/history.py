"""History, cache and queue queries over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.binding import load
from larder.operators import history, lookup
from larder.queries.registry import query
from larder.session import checkpoint_root

_SCANS = """s AS (SELECT event_id, user_id, event_type AS barcode, ts AS scanned_at, value AS score, CAST(json_extract(props, '$.k') AS INT) % 25 = 0 AS starred FROM events)"""


def scans(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf, "events").select(
        "event_id", "user_id", F.col("event_type").alias("barcode"), F.col("ts").alias("scanned_at"), F.col("value").alias("score"), (k % 25 == 0).alias("starred"))


_VIEW = f"""{_SCANS}, h AS (SELECT user_id, barcode, arg_max(event_id, {{'a': scanned_at, 'b': event_id}}) AS event_id, max(scanned_at) AS scanned_at,
   arg_max(score, {{'a': scanned_at, 'b': event_id}}) AS score, bool_or(starred) AS starred FROM s GROUP BY ALL)"""


def _view(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_view(scans(spark, sf), ["user_id", "barcode"], ["scanned_at", "event_id"])


@query("history_view", f"WITH {_VIEW} SELECT user_id, barcode, event_id, score, starred FROM h")
def history_view(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf).select("user_id", "barcode", "event_id", "score", "starred")


@query("history_page", f"WITH {_VIEW} SELECT user_id, barcode, event_id FROM h ORDER BY scanned_at DESC, event_id LIMIT 100")
def history_page(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_page(_view(spark, sf), 100, tie="event_id").select("user_id", "barcode", "event_id")


@query("starred_history", f"WITH {_VIEW} SELECT user_id, barcode, event_id FROM h WHERE starred")
def starred_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.starred(_view(spark, sf)).select("user_id", "barcode", "event_id")


@query("restored_history", f"WITH {_VIEW} SELECT user_id, barcode, event_id FROM h")
def restored_history(spark: SparkSession, sf: str) -> DataFrame:
    """Recents are cleared and put back: nothing is lost, nothing doubled."""
    kept, gone = history.clear_recent(_view(spark, sf))
    return history.restore(kept, gone, ["user_id", "barcode"]).select("user_id", "barcode", "event_id")


@query("recent_searches", """WITH l AS (SELECT user_id, event_type || (event_id % 4)::VARCHAR AS term, max(ts) AS seen FROM events GROUP BY ALL)
SELECT user_id, term, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, term) AS rank FROM l) WHERE rank <= 6""")
def recent_searches(spark: SparkSession, sf: str) -> DataFrame:
    term = F.concat("event_type", (F.col("event_id") % 4).cast("string"))
    rows = load(spark, sf, "events").select("user_id", term.alias("term"), F.col("ts").alias("at"))
    return history.recent_searches(rows).select("user_id", "term", "rank")


@query("fresh_cache", """SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAY AND event_id % 3 <> 0""")
def fresh_cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select(
        "event_id", "event_type", F.col("ts").alias("cached_at"), F.when(F.col("event_id") % 3 != 0, lookup.CACHE_SCHEMA).alias("schema"))
    now = F.lit("2024-02-05 00:00:00").cast("timestamp").cast(dict(rows.dtypes)["cached_at"])
    return lookup.cache_get(rows, now).select("event_id", "event_type")


@query("contribution_queue", """SELECT '{"barcode":"' || event_type || '","created_at":' || event_id::VARCHAR || ',"name":"n' || user_id::VARCHAR || '"' ||
   CASE WHEN event_id % 2 = 0 THEN ',"quantity":"' || (event_id % 9)::VARCHAR || ' g"' ELSE '' END || '}' AS value FROM events WHERE event_id % 4 < 2""")
def contribution_queue(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    rows = load(spark, sf, "events").select(
        F.col("event_type").alias("barcode"), e.alias("created_at"), F.when(e % 4 < 2, "pending").otherwise("submitted").alias("status"),
        F.struct(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("name"),
                 F.when(e % 2 == 0, F.concat((e % 9).cast("string"), F.lit(" g"))).alias("quantity")).alias("payload"))
    return history.export_queue(history.pending(rows))


_DEBOUNCED = """WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
d AS (SELECT event_id, user_id, rn, event_type AS code, t AS last, true AS emit FROM r WHERE rn = 1
  UNION ALL SELECT r.event_id, r.user_id, r.rn, CASE WHEN r.event_type <> d.code OR r.t - d.last >= 43200000000 THEN r.event_type ELSE d.code END,
    CASE WHEN r.event_type <> d.code OR r.t - d.last >= 43200000000 THEN r.t ELSE d.last END, r.event_type <> d.code OR r.t - d.last >= 43200000000
  FROM d JOIN r ON r.user_id = d.user_id AND r.rn = d.rn + 1)
SELECT user_id, event_id FROM d WHERE emit"""


@query("debounced_scans", _DEBOUNCED)
def debounced_scans(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return history.debounce(rows, "user_id", "event_type", "ts", "event_id", 12 * 3600).select("user_id", "event_id")


@query("streamed_scans", _DEBOUNCED)
def streamed_scans(spark: SparkSession, sf: str) -> DataFrame:
    """The same rule as a stream: the earlier half of the time lands first, state carries over to the later one."""
    from larder.streaming.scans import debounce_exact

    root = f"{checkpoint_root(spark)}/scans-{uuid.uuid4().hex}"
    rows = load(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    ends = rows.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b"))
    late = F.col("ts").cast("double") >= (F.col("a") + F.col("b")) / 2
    dealt = rows.crossJoin(F.broadcast(ends)).withColumn("late", late)  # one row of ends
    for half in (~F.col("late"), F.col("late")):
        dealt.filter(half).select(*rows.columns).write.mode("append").parquet(f"{root}/landing")
        scans = spark.readStream.schema(rows.schema).parquet(f"{root}/landing")
        kept = debounce_exact(scans, "user_id", "event_type", "ts", 12 * 3600)
        (kept.writeStream.format("parquet").option("path", f"{root}/kept").option("checkpointLocation", f"{root}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/kept").select("user_id", "event_id")


@query("sampled_documents", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY md5(doc_id::VARCHAR || '|0'), doc_id LIMIT 50")
def sampled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return history.sample_docs(load(spark, sf, "documents"), F.col("doc_id"), 50).select("doc_id", "lang", "source", "n_chars")


@query("streamed_changes", """WITH r AS (
  SELECT p_partkey AS k, 0 AS batch, CASE WHEN p_partkey % 10 <> 3 THEN p_name || ' s' END AS name,
         CASE p_partkey % 3 WHEN 0 THEN ['c0', 'c1'] WHEN 1 THEN ['c1'] ELSE ['c2'] END AS countries FROM part
  UNION ALL SELECT p_partkey, 1, p_name || ' t', ['c1', 'c9'] FROM part WHERE p_partkey % 20 = 1
  UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 8 <> 1 THEN p_name || ' u' END, ['c0'] FROM part WHERE p_partkey % 4 = 1),
last AS (SELECT k, arg_max(countries, batch) AS countries, arg_max({'n': name}, batch).n AS name FROM r GROUP BY k)
SELECT k, country, name FROM (SELECT k, name, unnest(countries) AS country FROM last) WHERE country IN ('c0', 'c1') AND name IS NOT NULL""")
def streamed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change files through the streaming path in three batches: all products, a few, and so many that the runs are merged."""
    from larder.streaming.changes import read_current, stream_changes

    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    k = F.col("p_partkey")
    part = load(spark, sf, "part")
    countries = lambda *names: F.array(*[F.lit(n) for n in names])
    batches = [
        part.select(k.alias("k"), k.alias("file"), F.when(k % 10 != 3, F.concat("p_name", F.lit(" s"))).alias("name"),
                    F.when(k % 3 == 0, countries("c0", "c1")).when(k % 3 == 1, countries("c1")).otherwise(countries("c2")).alias("countries")),
        part.filter(k % 20 == 1).select(k.alias("k"), k.alias("file"), F.concat("p_name", F.lit(" t")).alias("name"), countries("c1", "c9").alias("countries")),
        part.filter(k % 4 == 1).select(k.alias("k"), k.alias("file"), F.when(k % 8 != 1, F.concat("p_name", F.lit(" u"))).alias("name"), countries("c0").alias("countries"))]
    for rows in batches:
        rows.write.mode("append").json(f"{root}/landing")
        stream_changes(spark, f"{root}/landing", f"{root}/catalog", f"{root}/checkpoint", "k long, file long, name string, countries array<string>",
                       ["c0", "c1"], key="k").awaitTermination()
    return read_current(spark, f"{root}/catalog", "k").select("k", "country", "name")
