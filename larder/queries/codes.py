"""Barcode, routing and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.binding import load
from larder.functions import codes
from larder.functions.codes import GS1_RULES
from larder.operators import prefix, ranges
from larder.operators.lookup import tiered_lookup
from larder.queries.registry import query

# Codes of 6 to 14 digits from the keys of lineitem, with every GS1 prefix among them.
_CODES = """codes AS (SELECT DISTINCT CASE k % 7 WHEN 0 THEN lpad(CAST(k * 7919 % 100000000 AS VARCHAR), 8, '0') WHEN 1 THEN lpad(CAST(k * 104729 % 1000000000000 AS VARCHAR), 12, '0')
   WHEN 2 THEN CAST(k AS VARCHAR) WHEN 3 THEN ' ' || lpad(CAST(k * 15485863 % 10000000000000 AS VARCHAR), 13, '0') || ' '
   ELSE lpad(CAST((k * 7919 % 1000) * 10000000000 + k * 31 AS VARCHAR), 13, '0') END AS code FROM (SELECT l_orderkey AS k FROM lineitem))"""


def code_list(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    code = (F.when(k % 7 == 0, pad(k * 7919 % 100000000, 8)).when(k % 7 == 1, pad(k * 104729 % 1000000000000, 12))
            .when(k % 7 == 2, k.cast("string"))
            .when(k % 7 == 3, F.concat(F.lit(" "), pad(k * 15485863 % 10000000000000, 13), F.lit(" ")))
            .otherwise(pad((k * 7919 % 1000) * 10000000000 + k * 31, 13)))
    return load(spark, sf, "lineitem").select(code.alias("code")).distinct()


_NORMAL = "n AS (SELECT code, CASE WHEN length(trim(code)) = 12 THEN '0' || trim(code) ELSE trim(code) END AS normalized FROM codes)"
_DIGIT = " + ".join(f"substr(p, {i}, 1)::INT * {3 if i % 2 else 1}" for i in range(1, 14))


@query("barcode_checks", f"""WITH {_CODES}, {_NORMAL}
SELECT code, normalized, regexp_matches(normalized, '^([0-9]{{8}}|[0-9]{{12,14}})$') AND (10 - ({_DIGIT}) % 10) % 10 = substr(p, 14, 1)::INT AS valid
FROM (SELECT *, lpad(normalized, 14, '0') AS p FROM n)""")
def barcode_checks(spark: SparkSession, sf: str) -> DataFrame:
    normalized = codes.normalize_barcode(F.col("code"))
    return code_list(spark, sf).select("code", normalized.alias("normalized"), codes.is_valid_ean(normalized).alias("valid"))


def _rules(specific: bool) -> str:
    rows = []
    for no, (low, high, region, country, kind) in enumerate(GS1_RULES):
        two = high <= 99
        q = lambda v: "NULL" if v is None else f"'{v}'"
        rows.append(f"({no + (1000 if specific and two else 0)}, {2 if two else 3}, {low}, {high}, {q(region)}, {q(country)}, '{kind or 'product'}')")
    return "rules(rule, digits, low, high, region, country, kind) AS (VALUES " + ", ".join(rows) + ")"


def _classified(specific: bool = False) -> str:
    return f"""{_CODES}, {_NORMAL}, {_rules(specific)},
d AS (SELECT normalized AS code, regexp_replace(normalized, '[^0-9]', '', 'g') AS digits FROM n),
m AS (SELECT d.code, arg_min(r.kind, rule) AS kind, arg_min(region, rule) AS region, arg_min({{'c': country}}, rule).c AS country FROM d JOIN rules r ON length(d.digits) > 8
   AND CASE WHEN r.digits = 2 THEN substr(d.digits, 1, 2)::INT ELSE substr(d.digits, 1, 3)::INT END BETWEEN low AND high GROUP BY d.code),
c AS (SELECT DISTINCT d.code, CASE WHEN length(digits) < 8 THEN 'unknown' ELSE coalesce(m.kind, 'product') END AS kind, region, country FROM d LEFT JOIN m ON m.code = d.code)"""


def _classify(spark: SparkSession, sf: str, order: str = "as_published") -> DataFrame:
    normal = code_list(spark, sf).select(codes.normalize_barcode(F.col("code")).alias("code")).distinct()
    return ranges.classify_barcodes(normal, "code", order)


@query("gs1_classes", f"WITH {_classified()} SELECT code, kind, region, country, CASE kind WHEN 'store-internal' THEN 'not-unique-worldwide' WHEN 'book' THEN 'isbn-of-a-book' WHEN 'magazine' THEN 'issn-of-a-periodical' WHEN 'coupon' THEN 'coupon-not-a-product' WHEN 'refund' THEN 'refund-not-a-product' END AS note FROM c")
def gs1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _classify(spark, sf)


@query("gs1_most_specific", f"WITH {_classified(True)} SELECT kind, region, country, count(*) AS codes FROM c GROUP BY ALL")
def gs1_most_specific(spark: SparkSession, sf: str) -> DataFrame:
    return _classify(spark, sf, "most_specific").groupBy("kind", "region", "country").agg(F.count(F.lit(1)).alias("codes"))


@query("unresolvable_codes", f"WITH {_classified()} SELECT kind, kind IN ('store-internal', 'coupon', 'refund') AS unresolvable, count(*) AS codes FROM c GROUP BY ALL")
def unresolvable_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _classify(spark, sf).withColumn("unresolvable", ranges.unresolvable(F.col("kind")))
    return rows.groupBy("kind", "unresolvable").agg(F.count(F.lit(1)).alias("codes"))


@query("catalog_order", f"""WITH {_classified()}
SELECT code, CASE WHEN country IS NULL THEN 'mexico,spain' WHEN country = 'mexico' THEN 'mexico,spain' WHEN country = 'spain' THEN 'spain,mexico' ELSE 'mexico,spain,' || country END AS catalogs FROM c""")
def catalog_order(spark: SparkSession, sf: str) -> DataFrame:
    held = F.array(F.lit("mexico"), F.lit("spain"))
    return ranges.with_catalog_order(_classify(spark, sf), held).select("code", F.array_join("catalog_order", ",").alias("catalogs"))


# Three catalogues by key; two of them are split, at text cuts, the third is one file.
_ENTRIES = """ranges(country, part, f, t) AS (VALUES ('c0', 1, NULL, '3'), ('c0', 2, '3', '7'), ('c0', 3, '7', NULL), ('c1', 1, NULL, '5'), ('c1', 2, '5', '8'), ('c2', 1, NULL, NULL)),
r AS (SELECT DISTINCT 'c' || (l_orderkey % 3)::VARCHAR AS country, l_orderkey::VARCHAR AS code FROM lineitem)"""


def _entries(spark: SparkSession) -> DataFrame:
    piece = "array<struct<part:int,from_key:string,to_key:string>>"
    return spark.createDataFrame(
        [("c0", [(1, None, "3"), (2, "3", "7"), (3, "7", None)]), ("c1", [(1, None, "5"), (2, "5", "8")]), ("c2", None)],
        f"country string, parts {piece}")


@query("part_routing", f"""WITH {_ENTRIES} SELECT r.country, code, p.part::INT AS part, coalesce(p.part, last)::INT AS part_or_last FROM r
  LEFT JOIN ranges p ON p.country = r.country AND (f IS NULL OR code >= f) AND (t IS NULL OR code < t)
  JOIN (SELECT country, max(part) AS last FROM ranges GROUP BY country) l ON l.country = r.country""")
def part_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Codes compare as text: 10 sorts before 3. Code 9 of a catalogue that ends at 8 has no part."""
    k = F.col("l_orderkey")
    rows = load(spark, sf, "lineitem").select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("country"), k.cast("string").alias("code")).distinct()
    parts = ranges.parts_of(_entries(spark))
    strict = ranges.part_for(rows, parts, ["country"], "code")
    loose = ranges.part_for(rows.select("country", "code"), parts, ["country"], "code", fallback_last=True)
    return strict.join(loose.withColumnRenamed("part", "part_or_last"), ["country", "code"])


@query("fine_part_routing", """WITH cuts AS (SELECT 'c' || (o_orderkey % 3)::VARCHAR AS country, o_orderkey::VARCHAR AS cut, 1 + row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey::VARCHAR) AS part FROM orders WHERE o_orderkey % 4 <> 1),
r AS (SELECT 'c' || (l_orderkey % 3)::VARCHAR AS country, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS code FROM lineitem)
SELECT r.country, code, coalesce(part, 1)::INT AS part FROM r ASOF LEFT JOIN cuts ON cuts.country = r.country AND r.code >= cuts.cut""")
def fine_part_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of parts a catalogue: a cut at most orders, and every order line finds its part."""
    k = F.col("o_orderkey")
    cuts = load(spark, sf, "orders").filter(k % 4 != 1).select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("country"), k.cast("string").alias("cut_key"))
    parts = prefix.ranges_from(cuts, ["country"], "cut_key")
    lines = load(spark, sf, "lineitem").select(F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")).alias("country"),
                                               F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("code"))
    return ranges.part_for(lines, parts, ["country"], "code")


@query("image_urls", """SELECT code, CASE WHEN length(code) <= 8 THEN code ELSE rtrim(substr(code, 1, 3) || '/' || substr(code, 4, 3) || '/' || substr(code, 7, 3) || '/' || substr(code, 10), '/') END AS path,
   CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN NULL ELSE 'https://images.openfoodfacts.org/images/products/' ||
     CASE WHEN length(code) <= 8 THEN code ELSE rtrim(substr(code, 1, 3) || '/' || substr(code, 4, 3) || '/' || substr(code, 7, 3) || '/' || substr(code, 10), '/') END
     || '/front_es.' || k::VARCHAR || '.200.jpg' END AS url
FROM (SELECT DISTINCT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN lpad(o_orderkey::VARCHAR, 8, '0') WHEN 1 THEN lpad(o_orderkey::VARCHAR, 9, '0') ELSE lpad(o_orderkey::VARCHAR, 13, '0') END AS code FROM orders)""")
def image_urls(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.lpad(k.cast("string"), F.when(k % 3 == 0, 8).when(k % 3 == 1, 9).otherwise(13), F.lit("0"))
    ref = F.when(k % 4 == 1, "broken").when(k % 4 != 0, F.concat(F.lit("ES."), k.cast("string")))
    return load(spark, sf, "orders").select(code.alias("code"), codes.code_path(code).alias("path"), codes.image_url(code, ref).alias("url"))


@query("tiered_lookup", """WITH t AS (SELECT c_custkey AS key, 1 AS tier, 'cache' AS source, c_acctbal AS value FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 2, 'held', c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, 3, 'other', max(o_totalprice) FROM orders GROUP BY o_custkey)
SELECT k.c_custkey AS key, arg_min(source, tier) AS source, arg_min(value, tier) AS value FROM customer k JOIN t ON t.key = k.c_custkey GROUP BY k.c_custkey""")
def tiered(spark: SparkSession, sf: str) -> DataFrame:
    customer = load(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    orders = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("value"))
    tiers = [("cache", customer.filter(F.col("key") % 5 == 0)),
             ("held", customer.filter(F.col("key") % 3 == 0).withColumn("value", F.col("value") + 1)), ("other", orders)]
    return tiered_lookup(customer.select("key"), tiers, "key").select("key", "source", "value")
