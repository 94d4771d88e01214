"""Generations, deltas and sync plans over ``orders``, ``customer`` and ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import schema
from larder.binding import load
from larder.operators import diff
from larder.plans import sync
from larder.queries.registry import query
from larder.session import checkpoint_root
from larder.sources import delta_files

COLUMNS = ["name", "price", "brands"]
INDEX = ["name", "brands"]
KEY = ["country", "part", "barcode"]
_CUT = "0000000000000000700"

# Two generations of a catalogue: the old one lacks every 20th key and has other prices and names
# here and there, the new one has lost every 17th key.
_GENERATIONS = """base AS (SELECT o_orderpriority AS country, lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS barcode, o_orderkey AS k,
    o_orderstatus AS brands, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'order ' || o_orderstatus END AS name, o_totalprice AS price FROM orders),
parted AS (SELECT *, CASE WHEN barcode < '0000000000000000700' THEN 1 ELSE 2 END AS part FROM base),
n AS (SELECT country, part, barcode, name, price, brands FROM parted WHERE k % 17 <> 0),
o AS (SELECT country, part, barcode, CASE WHEN k % 11 = 0 THEN 'old' ELSE name END AS name, CASE WHEN k % 13 = 0 THEN price + 1 ELSE price END AS price, brands
  FROM parted WHERE k % 20 <> 0),
ch AS (SELECT CASE WHEN n.barcode IS NULL THEN 'd' ELSE 'u' END AS op,
    CASE WHEN n.barcode IS NULL THEN NULL WHEN o.barcode IS NULL OR n.name IS DISTINCT FROM o.name OR n.brands IS DISTINCT FROM o.brands THEN 1 ELSE 0 END AS fts,
    coalesce(n.country, o.country) AS country, coalesce(n.part, o.part) AS part, coalesce(n.barcode, o.barcode) AS barcode, n.name, n.price, n.brands
  FROM n FULL JOIN o ON n.country = o.country AND n.part = o.part AND n.barcode = o.barcode
  WHERE n.barcode IS NULL OR o.barcode IS NULL OR n.name IS DISTINCT FROM o.name OR n.price IS DISTINCT FROM o.price OR n.brands IS DISTINCT FROM o.brands)"""


def generations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    base = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("country"), F.lpad(k.cast("string"), 19, "0").alias("barcode"), k.alias("k"),
        F.when(k % 29 != 0, F.concat(F.lit("order "), "o_orderstatus")).alias("name"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("brands")).withColumn("part", F.when(F.col("barcode") < _CUT, 1).otherwise(2))
    new = base.filter(F.col("k") % 17 != 0).select(*KEY, *COLUMNS)
    old = base.filter(F.col("k") % 20 != 0).select(
        *KEY, F.when(F.col("k") % 11 == 0, "old").otherwise(F.col("name")).alias("name"),
        F.when(F.col("k") % 13 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), "brands")
    return old, new


@query("generation_changes", f"WITH {_GENERATIONS} SELECT op, fts::INT AS fts, country, part::INT AS part, barcode, name, price, brands FROM ch")
def generation_changes(spark: SparkSession, sf: str) -> DataFrame:
    old, new = generations(spark, sf)
    return diff.changes(new, old, KEY, COLUMNS, INDEX)


@query("generation_upserts", f"WITH {_GENERATIONS} SELECT barcode, name, price, brands, fts::INT AS fts FROM ch WHERE op = 'u'")
def generation_upserts(spark: SparkSession, sf: str) -> DataFrame:
    old, new = generations(spark, sf)
    return diff.upserts(new, old, ["barcode"], COLUMNS, INDEX)


@query("generation_deletes", f"WITH {_GENERATIONS} SELECT barcode FROM ch WHERE op = 'd'")
def generation_deletes(spark: SparkSession, sf: str) -> DataFrame:
    old, new = generations(spark, sf)
    return diff.deletes(new, old, ["barcode"])


@query("delta_applied", f"WITH {_GENERATIONS} SELECT country, part::INT AS part, barcode, name, price, brands FROM n")
def delta_applied(spark: SparkSession, sf: str) -> DataFrame:
    old, new = generations(spark, sf)
    return diff.apply_delta(old, diff.changes(new, old, KEY, COLUMNS, INDEX), KEY, COLUMNS)


@query("differing_parts", f"""WITH {_GENERATIONS} SELECT DISTINCT o.country, o.part::INT AS part FROM o JOIN ch ON ch.barcode = o.barcode AND op = 'd' WHERE o.barcode LIKE '%51'""")
def differing_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The parts in which a delta that forgot a few deletes is wrong, found without comparing rows."""
    old, new = generations(spark, sf)
    broken = diff.changes(new, old, KEY, COLUMNS, INDEX).filter(~((F.col("op") == "d") & F.col("barcode").endswith("51")))
    return diff.differing_parts(old, broken, new, KEY, COLUMNS, ["country", "part"])


@query("stored_schemas", f"""WITH {_GENERATIONS}, p AS (SELECT DISTINCT country, part FROM o)
SELECT country, part::VARCHAR AS part, c AS "column" FROM p, (VALUES ('barcode'), ('name'), ('price'), ('brands')) AS x(c) WHERE NOT (country = '1-URGENT' AND part = 2 AND c = 'brands')""")
def stored_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of every stored part, from its files' footers."""
    return schema.stored_columns(spark, _stored_old(spark, generations(spark, sf)[0])).select("country", "part", "column").distinct()


@query("delta_violations", f"""WITH {_GENERATIONS} SELECT o.country, o.part::INT AS part, o.barcode, 'unexpected' AS side FROM o
  JOIN ch ON ch.barcode = o.barcode AND op = 'd' WHERE o.barcode LIKE '%1'""")
def delta_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A delta that forgot some deletes: the check names exactly those rows."""
    old, new = generations(spark, sf)
    broken = diff.changes(new, old, KEY, COLUMNS, INDEX).filter(~((F.col("op") == "d") & F.col("barcode").endswith("1")))
    return diff.violations(old, broken, new, KEY, COLUMNS).select(*KEY, "side")


def _parts(rows: DataFrame, version: str) -> DataFrame:
    first = F.col("part") == 1
    return rows.groupBy("country", "part").agg(F.count(F.lit(1)).alias("products")).select(
        "country", "part", "products", F.when(~first, F.lit(_CUT)).alias("from_key"), F.when(first, F.lit(_CUT)).alias("to_key"),
        F.when(F.col("country") != "3-MEDIUM", F.lit(version)).alias("version"))


def _stored_old(spark: SparkSession, old: DataFrame) -> str:
    """The old generation as it was stored: one part of one country is from before there were brands."""
    path = f"{checkpoint_root(spark)}/generation-{uuid.uuid4().hex}"
    early = (F.col("country") == "1-URGENT") & (F.col("part") == 2)
    for rows in (old.filter(~early), old.filter(early).drop("brands")):
        rows.write.mode("append").partitionBy("country", "part").parquet(path)
    return path


def _deltas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old, new = generations(spark, sf)
    path = _stored_old(spark, old)
    lacking = schema.lacking_columns(schema.stored_columns(spark, path), ["barcode", *COLUMNS])
    held = spark.read.option("mergeSchema", "true").parquet(path).withColumn("part", F.col("part").cast("int"))
    before = _parts(held, "v1").withColumn("to_key", F.when(F.col("country") == "5-LOW", F.lit("x")).otherwise(F.col("to_key")))
    reasons = sync.delta_reasons(before.filter(F.col("country") != "2-HIGH"), _parts(new, "v2"), lacking)
    return sync.build_deltas(held, new, reasons, COLUMNS, INDEX)


@query("delta_manifest", f"""WITH {_GENERATIONS}, r AS (SELECT DISTINCT country, part, CASE country WHEN '2-HIGH' THEN 'no-previous' WHEN '5-LOW' THEN 'recut' WHEN '3-MEDIUM' THEN 'no-version' ELSE CASE WHEN country = '1-URGENT' AND part = 2 THEN 'schema-changed' ELSE 'delta' END END AS reason FROM n)
SELECT r.country, r.part::INT AS part, CASE WHEN r.country NOT IN ('2-HIGH', '3-MEDIUM') THEN 'v1' END AS "from", CASE WHEN r.country <> '3-MEDIUM' THEN 'v2' END AS "to", reason,
  CASE WHEN reason = 'delta' THEN u END AS upserts, CASE WHEN reason = 'delta' THEN d END AS deletes
FROM r LEFT JOIN (SELECT country, part, count(*) FILTER (op = 'u') AS u, count(*) FILTER (op = 'd') AS d FROM ch GROUP BY country, part) x ON x.country = r.country AND x.part = r.part""")
def delta_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _deltas(spark, sf)[1]


_SCHEMA = "op string, fts int, barcode string, name string, price double, brands string"


@query("delta_files", f"""WITH {_GENERATIONS} SELECT country, part::INT AS part, op, fts::INT AS fts, barcode, name, price, brands FROM ch
  WHERE country = '4-NOT SPECIFIED' OR (country = '1-URGENT' AND part = 1)""")
def delta_interchange(spark: SparkSession, sf: str) -> DataFrame:
    """Written as interchange files and read back; counts are checked against the headers."""
    path = f"{checkpoint_root(spark)}/delta-{uuid.uuid4().hex}"
    found, manifest = _deltas(spark, sf)
    delta_files.write_delta(found, manifest, COLUMNS, path)
    return delta_files.read_delta(spark, path, _SCHEMA)[1]


_CHAIN = """steps AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
entries AS (SELECT 'c' || c AS country, CASE c % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v' || lpad(max(i)::VARCHAR, 12, '0') ELSE 'v000000000001' END AS local,
    CASE WHEN c % 7 <> 0 THEN 'v' || lpad(max(i)::VARCHAR, 12, '0') END AS published, sum(price) * 3 AS bytes FROM steps GROUP BY c),
links AS (SELECT 'c' || c AS country, 'v' || lpad((i - 1)::VARCHAR, 12, '0') AS f, 'v' || lpad(i::VARCHAR, 12, '0') AS t, price AS bytes FROM steps WHERE i > 1 AND k % 31 <> 0)"""
_WALK = """RECURSIVE {chain}, walk AS (SELECT country, local AS at, published, 0 AS steps, 0.0::DOUBLE AS b FROM entries WHERE local IS NOT NULL AND published IS NOT NULL
  UNION ALL SELECT w.country, l.t, w.published, steps + 1, b + l.bytes FROM walk w JOIN links l ON l.country = w.country AND l.f = w.at WHERE w.at <> w.published),
plans AS (SELECT e.country, 1 AS part, CASE WHEN e.local IS NULL THEN 'no-local-version' WHEN e.published IS NULL THEN 'no-published-version' WHEN e.local = e.published THEN NULL
    WHEN w.country IS NULL THEN 'broken-chain' WHEN w.b > e.bytes * 0.35::DOUBLE THEN 'delta-too-large' END AS reason, e.local = e.published AS same, steps, b, e.bytes
  FROM entries e LEFT JOIN walk w ON w.country = e.country AND w.at = w.published),
p AS (SELECT country, part, CASE WHEN reason IS NOT NULL THEN 'full' WHEN same THEN 'up-to-date' ELSE 'deltas' END AS kind, reason, steps, b, bytes FROM plans),
q AS (SELECT country, part, kind, reason, CASE WHEN kind = 'deltas' THEN steps ELSE 0 END::INT AS steps, CASE kind WHEN 'deltas' THEN b WHEN 'full' THEN bytes ELSE 0.0 END AS transfer FROM p)""".replace("{chain}", _CHAIN)


def _chain_tables(spark: SparkSession, sf: str, *flags: str) -> tuple[DataFrame, DataFrame]:
    """Each customer is a catalogue and each order a version of it; some links are missing."""
    from larder.operators.prefix import with_running

    rows = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    steps = with_running(rows, ["o_custkey"], ["o_orderkey"])
    name = lambda c: F.concat(F.lit("v"), F.lpad(c.cast("string"), 12, "0"))
    country = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("country")
    links = steps.filter((F.col("rank") > 1) & (F.col("o_orderkey") % 31 != 0)).select(
        country, F.lit(1).alias("part"), name(F.col("rank") - 1).alias("from"), name(F.col("rank")).alias("to"), F.col("o_totalprice").alias("bytes"),
        *[(F.col("o_orderkey") % 4 == 0).alias(f) for f in flags])
    last = name(F.max("rank"))
    c = F.col("o_custkey")
    entries = steps.groupBy("o_custkey").agg(last.alias("last"), F.sum("o_totalprice").alias("total")).select(
        country, F.lit(1).alias("part"), F.when(c % 5 == 1, F.col("last")).when(c % 5 != 0, F.lit("v000000000001")).alias("local"),
        F.when(c % 7 != 0, F.col("last")).alias("published"), (F.col("total") * 3).alias("bytes"))
    return entries, links


@query("sync_plans", f"WITH {_WALK} SELECT country, part, kind, reason, steps, round(transfer, 4) AS transfer FROM q")
def sync_plans(spark: SparkSession, sf: str) -> DataFrame:
    return sync.plan_sync(*_chain_tables(spark, sf)).withColumn("transfer", F.round("transfer", 4))


@query("republished_plans", f"WITH {_WALK} SELECT country, part, kind, reason, steps, round(transfer, 4) AS transfer FROM q".replace(
    "price AS bytes FROM steps", "price + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS bytes FROM steps"))
def republished_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth link was published twice; the last one counts, once."""
    entries, links = _chain_tables(spark, sf, "again")
    twice = links.filter("again").withColumn("bytes", F.col("bytes") + 1)
    return sync.plan_sync(entries, links.unionByName(twice).drop("again")).withColumn("transfer", F.round("transfer", 4))


@query("sync_cost", f"""WITH {_WALK} SELECT kind, count(*) AS parts, round(sum(transfer), 3) AS transfer, max(steps) AS longest_chain FROM q
  WHERE kind <> 'up-to-date' AND reason IS DISTINCT FROM 'no-published-version' GROUP BY kind""")
def sync_cost(spark: SparkSession, sf: str) -> DataFrame:
    return sync.sync_cost(sync.plan_sync(*_chain_tables(spark, sf))).withColumn("transfer", F.round("transfer", 3))


@query("country_plans", f"""WITH {_WALK} SELECT 'r' || (substr(country, 2)::INT % 9)::VARCHAR AS country,
  CASE WHEN bool_and(kind = 'up-to-date') THEN 'up-to-date' WHEN bool_or(kind = 'full') THEN 'full' ELSE 'deltas' END AS kind,
  count(*) FILTER (kind <> 'up-to-date') AS stale_parts, round(sum(transfer), 3) AS transfer FROM q GROUP BY 1""")
def country_plans(spark: SparkSession, sf: str) -> DataFrame:
    plans = sync.plan_sync(*_chain_tables(spark, sf))
    grouped = plans.withColumn("country", F.concat(F.lit("r"), (F.substring("country", 2, 20).cast("int") % 9).cast("string")))
    return sync.combine_plans(grouped).withColumn("transfer", F.round("transfer", 3))


@query("kept_deltas", f"""WITH {_CHAIN} SELECT country, t AS "to", bytes FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY t DESC) AS rn FROM links) WHERE rn <= 3""")
def kept_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return sync.keep_last(_chain_tables(spark, sf)[1], 3).select("country", "to", "bytes")


@query("chain_applied", f"""WITH {_GENERATIONS}, later AS (SELECT * FROM n WHERE barcode NOT LIKE '%7')
SELECT barcode, CASE WHEN barcode LIKE '%3' THEN name || ' x' ELSE name END AS name, price FROM later""")
def chain_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Two deltas in a row, applied in one pass."""
    old, new = generations(spark, sf)
    third = new.filter(~F.col("barcode").endswith("7")).withColumn(
        "name", F.when(F.col("barcode").endswith("3"), F.concat("name", F.lit(" x"))).otherwise(F.col("name")))
    first = diff.changes(new, old, KEY, COLUMNS, INDEX).withColumn("step", F.lit(1))
    second = diff.changes(third, new, KEY, COLUMNS, INDEX).withColumn("step", F.lit(2))
    return diff.apply_chain(old, first.unionByName(second), old.limit(0), KEY, COLUMNS, "step", *_links(new, 2))[0].select("barcode", "name", "price")


def _links(rows: DataFrame, steps: int, start: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Links v1 to v2, v2 to v3 ... of every part, and v1 as the version that is held."""
    parts = rows.select("country", "part").distinct()
    number = lambda k: F.concat(F.lit("v"), (F.col("step") + k).cast("string"))
    links = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return links.select("country", "part", "step", F.coalesce(start, number(0)) if start is not None else number(0).alias("from"), number(1).alias("to")).toDF(
        "country", "part", "step", "from", "to"), parts.withColumn("version", F.lit("v1"))


@query("chain_refused", f"""WITH {_GENERATIONS}, later AS (SELECT * FROM n WHERE barcode NOT LIKE '%7'), third AS (SELECT country, part, barcode, CASE WHEN barcode LIKE '%3' THEN name || ' x' ELSE name END AS name, price FROM later)
SELECT country, barcode, name, price FROM third WHERE country NOT IN ('2-HIGH', '5-LOW')
UNION ALL SELECT country, barcode, name, price FROM n WHERE country = '2-HIGH' UNION ALL SELECT country, barcode, name, price FROM o WHERE country = '5-LOW'""")
def chain_refused(spark: SparkSession, sf: str) -> DataFrame:
    """The second delta of one country starts elsewhere, another country's base isn't held."""
    old, new = generations(spark, sf)
    third = new.filter(~F.col("barcode").endswith("7")).withColumn(
        "name", F.when(F.col("barcode").endswith("3"), F.concat("name", F.lit(" x"))).otherwise(F.col("name")))
    deltas = diff.changes(new, old, KEY, COLUMNS, INDEX).withColumn("step", F.lit(1)).unionByName(
        diff.changes(third, new, KEY, COLUMNS, INDEX).withColumn("step", F.lit(2)))
    links, bases = _links(new, 2, F.when((F.col("country") == "2-HIGH") & (F.col("step") == 2), "v9"))
    return diff.apply_chain(old, deltas, old.limit(0), KEY, COLUMNS, "step", links, bases.filter("country <> '5-LOW'"))[0].select("country", "barcode", "name", "price")


@query("cache_after_delta", f"WITH {_GENERATIONS} SELECT barcode FROM o WHERE barcode NOT IN (SELECT barcode FROM ch)")
def cache_after_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Cached rows that a delta did not touch stay valid."""
    old, new = generations(spark, sf)
    delta = diff.changes(new, old, KEY, COLUMNS, INDEX).withColumn("step", F.lit(1))
    return diff.apply_chain(old, delta, old.select(*KEY), KEY, COLUMNS, "step", *_links(old.unionByName(new), 1))[1].select("barcode")


@query("pending_changes", """SELECT 'changes_' || f::VARCHAR || '_' || t::VARCHAR || '.json.gz' AS path, f AS "from", t AS "to"
FROM (SELECT epoch(date_trunc('day', ts))::BIGINT AS f, epoch(date_trunc('day', ts))::BIGINT + 86400 AS t FROM events GROUP BY 1) WHERE t > 1705276800""")
def pending_changes(spark: SparkSession, sf: str) -> DataFrame:
    day = F.unix_timestamp(F.date_trunc("day", "ts"))
    days = load(spark, sf, "events").select(day.alias("f")).distinct()
    text = F.concat(F.lit("changes_"), F.col("f").cast("string"), F.lit("_"), (F.col("f") + 86400).cast("string"), F.lit(".json.gz"))
    return delta_files.pending_files(days.select(text.alias("path")), 1705276800)


@query("pruned_index", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def pruned_index(spark: SparkSession, sf: str) -> DataFrame:
    kept = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return diff.keep_keys(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), kept, ["l_orderkey"])


# Change records of two files over a base: sold in a country means upsert, not sold any more or
# without a name means delete, and a later file wins.
_APPLY = """base AS (SELECT p_partkey AS k, 'c' || (p_partkey % 3)::VARCHAR AS country, p_name AS name FROM part WHERE p_partkey % 4 <> 0),
rec AS (SELECT p_partkey AS k, 1 AS file, CASE WHEN p_partkey % 10 = 1 THEN NULL ELSE p_name || ' 1' END AS name, ['c' || ((p_partkey + 1) % 3)::VARCHAR, 'c' || (p_partkey % 3)::VARCHAR] AS cs FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, 2, p_name || ' 2', ['c2'] FROM part WHERE p_partkey % 6 = 5),
x AS (SELECT k, c.country, file, name, list_contains(cs, c.country) AND name IS NOT NULL AS sold FROM rec, (SELECT unnest(['c0', 'c1', 'c2']) AS country) c),
last AS (SELECT k, country, arg_max(sold, file) AS sold, max_by({'n': name}, file).n AS name FROM x GROUP BY k, country)"""


@query("changes_applied", f"""WITH {_APPLY} SELECT k, country, name FROM last WHERE sold UNION ALL
  SELECT b.k, b.country, b.name FROM base b LEFT JOIN last l ON l.k = b.k AND l.country = b.country WHERE l.k IS NULL""")
def changes_applied(spark: SparkSession, sf: str) -> DataFrame:
    from larder.streaming.changes import apply_changes

    part = load(spark, sf, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    c = lambda n: F.concat(F.lit("c"), (n % 3).cast("string"))
    base = part.filter(k % 4 != 0).select(k.alias("k"), c(k).alias("country"), name.alias("name"))
    one = part.filter(k % 2 == 1).select(k.alias("k"), F.lit(1).alias("file"), F.when(k % 10 != 1, F.concat(name, F.lit(" 1"))).alias("name"),
                                         F.array(c(k + 1), c(k)).alias("countries"))
    two = part.filter(k % 6 == 5).select(k.alias("k"), F.lit(2).alias("file"), F.concat(name, F.lit(" 2")).alias("name"), F.array(F.lit("c2")).alias("countries"))
    return apply_changes(base, one.unionByName(two), ["c0", "c1", "c2"], key="k", order=["file"])
