"""Catalogue queries over documents rendered from ``part``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder import schema
from larder.functions.text import label_badges
from larder.operators import prefix, ranges
from larder.operators.latest import latest_per_key
from larder.plans import catalog, scoring
from larder.queries.registry import query
from larder.queries.scoring import nutri_sql
from larder.rawdocs import RAW_SQL, dump_lines
from larder.session import checkpoint_root, cut_lineage
from larder.sources import dump

WANTED = ["spain", "mexico", "united-states"]


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return dump.documents(dump_lines(spark, sf))


# ---------------------------------------------------------------- the same rows in SQL

_CANDIDATES = [
    # nutrient, order, origin, value, scaled by serving, mark, bound
    ("energy_kj", 1, "100g", "ekj_100g", False, None),
    ("energy_kj", 2, "aggregated_set", "CASE WHEN v3_energy_unit = 'kcal' THEN v3_energy * 4.184::DOUBLE ELSE coalesce(v3_energy, v3_energy_computed) END", False,
     "CASE WHEN v3_energy IS NULL THEN 'computed' END"),
    ("energy_kj", 3, "sin-sufijo", "CASE WHEN p100 THEN energy_plain END", False, None),
    ("energy_kj", 4, "value", "CASE WHEN p100 THEN energy_value * 4.184::DOUBLE END", False, None),
    ("energy_kj", 5, "nutriscore", "comp_energy", False, None),
    ("energy_kj", 6, "serving", "ekj_serving * scale", True, None),
    ("energy_kj", 7, "value-racion", "CASE WHEN NOT p100 THEN energy_value * 4.184::DOUBLE * scale END", True, None),
    ("energy_kj", 8, "sin-sufijo-racion", "CASE WHEN NOT p100 THEN energy_plain * scale END", True, None),
    ("energy_kcal", 1, "100g", "ekcal_100g", False, None),
    ("fat", 1, "100g", "fat_100g", False, None),
    ("fat", 2, "aggregated_set", "v3_fat", False, None),
    ("fat", 3, "sin-sufijo", "CASE WHEN p100 THEN fat_plain END", False, None),
    ("fat", 4, "value", "CASE WHEN p100 THEN fat_value * 0.001::DOUBLE END", False, None),
    ("fat", 5, "sin-sufijo-racion", "CASE WHEN NOT p100 THEN fat_plain * scale END", True, None),
    ("fat", 6, "value-racion", "CASE WHEN NOT p100 THEN fat_value * 0.001::DOUBLE * scale END", True, None),
    ("saturated_fat", 1, "aggregated_set", "v3_sat * 0.001::DOUBLE", False, "'estimate'"),
    ("saturated_fat", 2, "nutriscore", "comp_sat", False, None),
    ("sugars", 1, "100g", "try_cast(sugars_text AS DOUBLE)", False, None),
    ("proteins", 1, "sin-sufijo", "CASE WHEN p100 THEN proteins_plain END", False, None),
    ("proteins", 2, "sin-sufijo-racion", "CASE WHEN NOT p100 THEN proteins_plain * scale END", True, None),
    ("fiber", 1, "serving", "fiber_serving * scale", True, None),
    ("salt", 1, "100g", "salt_100g", False, None),
    ("sodium", 1, "100g", "sodium_100g", False, None),
    ("sodium", 2, "aggregated_set", "v3_sodium", False, "'approx'"),
    ("alcohol", 1, "100g", "alcohol_100g", False, None),
    ("fvl", 1, "aggregated_set", "v3_fvl", False, "'estimate'"),
    ("fvl", 2, "sin-sufijo", "CASE WHEN p100 THEN nuts_plain END", False, None),
    ("fvl", 3, "sin-sufijo-racion", "CASE WHEN NOT p100 THEN nuts_plain * scale END", True, None),
]
_UNITS = {"energy_kj": ("kJ", 4000), "energy_kcal": ("kcal", 960), "fvl": ("%", 100), "alcohol": ("%", 100)}


def _cand_sql() -> str:
    rows = []
    for key, no, origin, value, scaled, mark in _CANDIDATES:
        unit, bound = _UNITS.get(key, ("g", 100))
        rows.append(f"SELECT k, '{key}' AS n, {no} AS no, '{origin}' AS origin, {value} AS v, {'trusted' if scaled else 'true'} AS ok, "
                    f"{mark or 'CAST(NULL AS VARCHAR)'} AS mark, {bound} AS bound, '{unit}' AS u FROM scaled")
    return "\nUNION ALL ".join(rows)


_LADDER = f"""raw AS ({RAW_SQL}),
base AS (SELECT *, per IS DISTINCT FROM 'serving' AS p100, 100.0::DOUBLE / try_cast(serving AS DOUBLE) AS scale FROM raw),
scaled AS (SELECT *, coalesce(scale IS NOT NULL AND coalesce(coalesce(CASE WHEN NOT p100 THEN energy_plain END, ekj_serving) * scale <= 4000, true), false) AS trusted FROM base),
cand AS (SELECT * FROM ({_cand_sql()}) WHERE v IS NOT NULL),
firsts AS (SELECT k, n, arg_min(v, no) AS v, arg_min(u, no) AS u, arg_min(v <= bound AND ok, no) AS good, arg_min(v <= bound, no) AS fits FROM cand GROUP BY k, n),
wins AS (SELECT k, n, arg_min(v, no) AS v, arg_min(origin, no) AS origin, min_by({{'m': mark}}, no).m AS mark FROM cand WHERE v <= bound AND ok GROUP BY k, n),
piv AS (SELECT k, {", ".join(f"max(v) FILTER (n = '{n}') AS v_{n}, max(origin) FILTER (n = '{n}') AS o_{n}" for n in ("energy_kj", "energy_kcal", "fat", "saturated_fat", "sugars", "fiber", "proteins", "salt", "sodium", "fvl", "alcohol"))}
  FROM wins GROUP BY k),
der AS (SELECT k, kj, CASE WHEN v_energy_kcal IS NOT NULL THEN v_energy_kcal WHEN kj * (1 / 4.184::DOUBLE) <= 960 THEN kj * (1 / 4.184::DOUBLE) END AS kcal,
    fat, sat, sugars, fiber, proteins, salt1 AS salt, coalesce(v_sodium, CASE WHEN salt1 * (1 / 2.5::DOUBLE) <= 100 THEN salt1 * (1 / 2.5::DOUBLE) END) AS sodium, fvl, alcohol,
    okj, CASE WHEN v_energy_kcal IS NOT NULL THEN o_energy_kcal WHEN kj * (1 / 4.184::DOUBLE) <= 960 THEN okj || ':kj' END AS okcal,
    osalt, CASE WHEN v_sodium IS NOT NULL THEN o_sodium WHEN salt1 * (1 / 2.5::DOUBLE) <= 100 THEN osalt || ':sal' END AS osodium,
    o_fat, o_saturated_fat, o_sugars, o_fiber, o_proteins, o_fvl, o_alcohol
  FROM (SELECT *, coalesce(v_energy_kj, CASE WHEN v_energy_kcal * 4.184::DOUBLE <= 4000 THEN v_energy_kcal * 4.184::DOUBLE END) AS kj,
      CASE WHEN v_energy_kj IS NOT NULL THEN o_energy_kj WHEN v_energy_kcal * 4.184::DOUBLE <= 4000 THEN o_energy_kcal || ':kcal' END AS okj,
      v_fat AS fat, v_saturated_fat AS sat, v_sugars AS sugars, v_fiber AS fiber, v_proteins AS proteins, v_fvl AS fvl, v_alcohol AS alcohol,
      coalesce(v_salt, CASE WHEN v_sodium * 2.5::DOUBLE <= 100 THEN v_sodium * 2.5::DOUBLE END) AS salt1,
      CASE WHEN v_salt IS NOT NULL THEN o_salt WHEN v_sodium * 2.5::DOUBLE <= 100 THEN o_sodium || ':sodio' END AS osalt FROM piv)),
named AS (SELECT *, CASE WHEN k % 3 = 0 THEN name WHEN k % 3 = 1 THEN trim(pn_own) WHEN k % 5 < 3 THEN trim(coalesce(pn_ca, pn_it)) WHEN k % 5 = 3 THEN gn END AS pname,
    [x FOR x IN string_split(replace(countries, 'en:', ''), ',') IF x IN ('spain', 'mexico', 'united-states')] AS matched FROM raw),
kept AS (SELECT * FROM named WHERE code IS NOT NULL AND pname IS NOT NULL AND len(matched) > 0),
flagged AS (SELECT *, CASE WHEN flag_source = '2023' THEN 'nutriscore_2023' WHEN flag_source = '2021' THEN 'nutriscore_2021' WHEN flag_source = 'legacy' THEN 'nutriscore_data'
      WHEN categories IS NOT NULL THEN 'categories_tags' END AS origin FROM kept),
flags AS (SELECT *, CASE WHEN origin IS NULL THEN NULL WHEN origin = 'categories_tags' THEN k % 6 = 3 ELSE f_drink END AS is_beverage,
    CASE WHEN origin IS NULL THEN NULL WHEN origin = 'categories_tags' THEN false ELSE f_water END AS is_water,
    CASE WHEN origin IS NULL THEN NULL WHEN origin = 'categories_tags' THEN k % 6 = 4 ELSE f_cheese END AS is_cheese,
    CASE WHEN origin IS NULL THEN NULL WHEN origin = 'categories_tags' THEN false ELSE f_fats END AS is_fat_oil_nuts_seeds,
    CASE WHEN origin IS NULL THEN NULL WHEN origin = 'categories_tags' THEN false ELSE f_red END AS is_red_meat FROM flagged),
imp AS (SELECT k, string_agg(f.n || ':' || CAST(floor(f.v * 100 + 0.5) / 100.0::DOUBLE AS VARCHAR) || ':' || f.u || ':' || CASE WHEN fits THEN 'racion' ELSE 'max' END || ':' || coalesce(w.origin, '-'), ',' ORDER BY f.n) AS implausible
   FROM firsts f LEFT JOIN wins w USING (k, n) WHERE NOT good GROUP BY k),
marks AS (SELECT k, string_agg(n || ':' || mark, ',' ORDER BY n) AS estimated FROM wins WHERE mark IS NOT NULL AND origin = 'aggregated_set' GROUP BY k),
img AS (SELECT k, CASE WHEN image_lang IS NOT NULL AND image_rev <> 'x1' THEN CASE WHEN image_lang = 'own' THEN lang ELSE image_lang END || '.' || image_rev END AS image_ref FROM raw),
cat AS (SELECT f.k, f.code AS barcode, pname AS name, brand AS brands, CAST(f.k % 10 AS VARCHAR) || '00 g' AS quantity, image_ref,
    ing_text AS ingredients_text, nullif(additives, '') AS additives, allergens, labels, CAST(nova_raw AS INT) AS nova_group, grade AS nutriscore_grade,
    CAST(f.k % 40 - 10 AS INT) AS nutriscore_score, kj AS energy_kj, kcal AS energy_kcal, fat, sat AS saturated_fat, sugars, fiber, proteins, salt, sodium * 1000 AS sodium, fvl, alcohol,
    CASE WHEN product_quantity > 0 THEN product_quantity::DOUBLE * CASE quantity_unit WHEN 'l' THEN 1000 WHEN 'kg' THEN 1000 WHEN 'CL' THEN 10 ELSE 1 END END AS quantity_ml,
    CASE WHEN alcohol > 1.2 THEN CASE f.k % 6 WHEN 3 THEN 'vino' WHEN 4 THEN 'cerveza' END END AS drink_type,
    is_beverage, is_water, is_cheese, is_fat_oil_nuts_seeds, is_red_meat, f.origin AS flag_source, modified * 1000 AS last_modified, popularity,
    implausible, estimated, no_data IS NOT NULL AS declared_absent, matched, categories, lang
  FROM flags f LEFT JOIN der d USING (k) LEFT JOIN imp USING (k) LEFT JOIN marks USING (k) LEFT JOIN img USING (k))"""


def _flat(rows: DataFrame) -> DataFrame:
    """Nested columns as sorted text, for comparing."""
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("estimated"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    impossible = F.array_join(F.array_sort(F.transform("implausible", lambda x: F.concat_ws(
        ":", x["n"], x["v"].cast("string"), x["u"], x["m"], F.coalesce(x["s"], F.lit("-"))))), ",")
    joined = {c: F.array_join(c, ",") for c in ("additives", "allergens", "labels")}
    return rows.withColumns(joined | {"estimated": F.nullif(pairs, F.lit("")), "implausible": F.nullif(impossible, F.lit(""))})


_ROUND = {"energy_kj", "energy_kcal", "fat", "saturated_fat", "sugars", "fiber", "proteins", "salt", "sodium", "fvl", "alcohol"}
_CATALOG = [c for c in schema.PRODUCT_COLUMNS if c not in ("trans_fat", "carbohydrates")]


def catalog_products(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.mapped(dump.in_countries(docs(spark, sf), WANTED))


@query("catalog_rows", f"WITH {_LADDER} SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in _ROUND else c for c in _CATALOG) + " FROM cat")
def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _flat(catalog_products(spark, sf))
    return rows.select(*[F.round(c, 6).alias(c) if c in _ROUND else F.col(c) for c in _CATALOG])


@query("dump_lines", "SELECT (count(*) + count(*) FILTER (p_partkey % 200 = 0)) AS lines, count(*) AS documents, count(*) FILTER (p_partkey % 200 = 0) AS rejected FROM part")
def dump_lines_read(spark: SparkSession, sf: str) -> DataFrame:
    return dump.rejected(dump_lines(spark, sf))


@query("nutrient_coverage", f"""WITH {_LADDER},
o AS (SELECT unnest([okj, okcal, o_fat, o_saturated_fat, o_sugars, o_fiber, o_proteins, osalt, osodium, o_fvl, o_alcohol]) AS origin FROM der JOIN cat USING (k))
SELECT 'origin:' || origin AS measure, count(*) AS n FROM o WHERE origin IS NOT NULL GROUP BY origin
UNION ALL SELECT 'products', count(*) FROM cat UNION ALL SELECT 'with-energy', count(energy_kj) FROM cat
UNION ALL SELECT 'without-energy', count(*) - count(energy_kj) FROM cat UNION ALL SELECT 'declared-absent', count(*) FILTER (declared_absent) FROM cat
UNION ALL SELECT 'products-with-impossible', count(implausible) FROM cat
UNION ALL SELECT 'impossible-values', coalesce(sum(len(string_split(implausible, ','))), 0)::BIGINT FROM cat""")
def nutrient_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.coverage(catalog_products(spark, sf))


@query("implausible_report", f"""WITH {_LADDER}
SELECT c.barcode, f.n AS nutrient, floor(f.v * 100 + 0.5) / 100.0::DOUBLE AS value, f.u AS unit, CASE WHEN fits THEN 'racion' ELSE 'max' END AS reason
FROM firsts f JOIN cat c USING (k) LEFT JOIN wins w USING (k, n) WHERE NOT good AND w.origin IS NULL""")
def implausible_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog_products(spark, sf).select("barcode", F.inline(F.filter("implausible", lambda x: x["s"].isNull())))
    return rows.select("barcode", F.col("n").alias("nutrient"), F.col("v").alias("value"), F.col("u").alias("unit"), F.col("m").alias("reason"))


@query("products_by_language", f"""WITH {_LADDER}
SELECT lang, count(*) AS products, count(*) FILTER (es_name LIKE 'own%') AS own_names FROM (
  SELECT lang, CASE WHEN k % 3 = 0 THEN name WHEN k % 3 = 1 THEN trim(pn_own) WHEN k % 5 < 3 THEN trim(pn_it) ELSE gn END AS es_name FROM named
  WHERE code IS NOT NULL) WHERE es_name IS NOT NULL GROUP BY lang""")
def products_by_language(spark: SparkSession, sf: str) -> DataFrame:
    from larder.functions.text import product_name

    rows = dump.typed_view(docs(spark, sf)).filter(F.col("code").isNotNull())
    named = rows.select("lang", product_name(F.col("texts"), F.col("lang"), "it").alias("chosen")).filter(F.col("chosen").isNotNull())
    return named.groupBy("lang").agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("chosen").startswith("own")).alias("own_names"))


@query("domain_products", f"""WITH {_LADDER}
SELECT barcode, name, CASE WHEN coalesce(is_beverage, false) THEN 'beverage' ELSE 'food' END AS kind,
   'https://images.openfoodfacts.org/images/products/' || substr(barcode, 1, 3) || '/' || substr(barcode, 4, 3) || '/' || substr(barcode, 7, 3) || '/' || substr(barcode, 10)
     || '/front_' || replace(image_ref, '.', '.') || '.400.jpg' AS image_url,
   CASE WHEN nova_group BETWEEN 1 AND 4 THEN nova_group END AS nova_group, CASE WHEN nutriscore_grade IN ('a', 'b', 'c', 'd', 'e') THEN nutriscore_grade END AS grade,
   coalesce(is_cheese, false) AS is_cheese, flag_source, round(energy_kj, 6) AS energy_kj, quantity_ml, drink_type FROM cat""")
def domain_products(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.to_product(dump.in_countries(docs(spark, sf), WANTED)).select(
        "barcode", "name", "kind", "image_url", "nova_group", "grade", F.col("category_flags.is_cheese").alias("is_cheese"),
        "flag_source", F.round("nutriments.energy_kj", 6).alias("energy_kj"), "quantity_ml", "drink_type")


@query("snapshot_products", f"""WITH {_LADDER}
SELECT barcode, brands AS brand, CASE WHEN is_beverage IS NOT NULL THEN 'snapshot' END AS flag_source, round(salt, 6) AS salt,
  CASE WHEN implausible IS NULL THEN 0 ELSE len(string_split(implausible, ',')) END::INT AS implausible,
  CASE WHEN labels IS NOT NULL THEN 'organic|denominacion de origen' ELSE '' END AS badges FROM cat""")
def snapshot_products(spark: SparkSession, sf: str) -> DataFrame:
    stored = catalog_products(spark, sf).select(*schema.PRODUCT_COLUMNS)
    return catalog.row_to_product(stored).select(
        "barcode", F.array_join("brands", ",").alias("brand"), "flag_source", F.round("nutriments.salt", 6).alias("salt"),
        F.size("implausible").alias("implausible"),
        F.coalesce(F.array_join(label_badges(F.col("labels")), "|"), F.lit("")).alias("badges"))


# Published components where there are any, else computed from nutrients.
_SCORED = f"""WITH {_LADDER},
i AS (SELECT k, barcode, is_beverage, is_water, is_cheese, is_fat_oil_nuts_seeds, is_red_meat, kj AS energy_kj, sugars, fat, sat AS saturated_fat, salt, fvl, fiber, proteins
  FROM (SELECT f.k, f.code AS barcode, is_beverage, is_water, is_cheese, is_fat_oil_nuts_seeds, is_red_meat,
    CASE WHEN pub THEN comp_energy ELSE d.kj END AS kj, CASE WHEN NOT pub THEN d.sugars END AS sugars, CASE WHEN NOT pub THEN d.fat END AS fat,
    -- what the fats category takes instead of energy and saturated fat isn't published here
    CASE WHEN NOT pub THEN d.sat WHEN NOT coalesce(is_fat_oil_nuts_seeds, false) THEN comp_sat END AS sat, CASE WHEN NOT pub THEN d.salt END AS salt, CASE WHEN NOT pub THEN d.fvl END AS fvl,
    CASE WHEN NOT pub THEN d.fiber END AS fiber, CASE WHEN NOT pub THEN d.proteins END AS proteins, pub
    FROM (SELECT *, comp_energy IS NOT NULL OR comp_sat IS NOT NULL AS pub FROM flags) f LEFT JOIN der d USING (k))),
s AS ({nutri_sql('i')}),
t AS (SELECT barcode, score, grade, neg FROM s)
SELECT barcode, score::INT AS score, grade, neg::INT AS negative_points FROM t"""


@query("published_nutriscore", _SCORED)
def published_nutriscore(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.with_published_components(dump.in_countries(docs(spark, sf), WANTED))
    scored = scoring.with_score(scoring.with_point_struct(rows))
    return scored.select("barcode", F.col("nutri_score").alias("score"), F.col("nutri_grade").alias("grade"), "negative_points")


@query("domain_nutriscore", _SCORED.replace("comp_energy IS NOT NULL OR comp_sat IS NOT NULL AS pub", "false AS pub"))
def domain_nutriscore(spark: SparkSession, sf: str) -> DataFrame:
    """Domain products turned back to the source's vocabulary: they score as the raw documents do without published components."""
    return scoring.domain_nutriscore(catalog.to_product(dump.in_countries(docs(spark, sf), WANTED)))


# ---------------------------------------------------------------- countries, parts, index

def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    """One narrow row per product and country. Written once: cuts, weights and index all read it."""
    rows = catalog.by_country(catalog_products(spark, sf))
    return cut_lineage(rows.select("country", "barcode", "name", "brands", "popularity", catalog.row_weight(rows).cast("long").alias("weight")))


_WEIGHTED = """spread AS (SELECT unnest(matched) AS country, * FROM cat),
jimp AS (SELECT k, sum(length('{"n":"' || f.n || '","v":' || js || ',"u":"' || f.u || '","m":"' || CASE WHEN fits THEN 'racion' ELSE 'max' END || '"' || coalesce(',"s":"' || w.origin || '"', '') || '}') + 1) + 1 AS size
   FROM (SELECT *, CAST(floor(v * 100 + 0.5) / 100.0::DOUBLE AS VARCHAR) AS js FROM firsts) f LEFT JOIN wins w USING (k, n) WHERE NOT good GROUP BY k),
weighted AS (SELECT country, barcode, name, brands, popularity, (length(name) + length(brands) + length(quantity) + coalesce(length(image_ref), 0) + coalesce(length(ingredients_text), 0)
   + coalesce(length(additives), 0) + coalesce(length(allergens), 0) + coalesce(length(labels), 0) + coalesce(length(nutriscore_grade), 0) + coalesce(size, 0)
   + coalesce(length(estimated), 0) + coalesce(length(drink_type), 0) + 120)::BIGINT AS weight FROM spread LEFT JOIN jimp USING (k))"""


@query("catalog_weights", f"WITH {_LADDER}, {_WEIGHTED} SELECT country, barcode, weight FROM weighted")
def catalog_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted(spark, sf).select("country", "barcode", "weight")


@query("catalog_sizes", f"""WITH {_LADDER}, {_WEIGHTED}
SELECT coalesce(country, '(all)') AS country, count(*) AS products, sum(weight)::BIGINT AS bytes, round(sum(weight)::DOUBLE / count(*), 6) AS bytes_per_product
FROM weighted GROUP BY ROLLUP (country)""")
def catalog_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_sizes(_weighted(spark, sf))


_CUTS = """tot AS (SELECT country, sum(weight) AS total FROM weighted GROUP BY country),
run AS (SELECT country, barcode, weight, sum(weight) OVER w AS cum, row_number() OVER w AS rn FROM weighted WINDOW w AS (PARTITION BY country ORDER BY barcode)),
tgt AS (SELECT country, unnest(range(1, 4)) AS cut_no, total FROM tot),
hit AS (SELECT t.country, cut_no, min(rn) AS rn FROM tgt t JOIN run r ON r.country = t.country AND r.cum * 4 >= t.total * cut_no GROUP BY t.country, cut_no),
adj AS (SELECT country, cut_no, max(rn - cut_no) OVER (PARTITION BY country ORDER BY cut_no) + cut_no AS rn FROM hit),
cuts AS (SELECT a.country, cut_no, barcode AS cut_key FROM adj a JOIN run r ON r.country = a.country AND r.rn = a.rn)"""


@query("weight_cuts", f"WITH {_LADDER}, {_WEIGHTED}, {_CUTS} SELECT country, cut_no::INT AS cut_no, cut_key FROM cuts")
def weight_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return prefix.weight_cuts(_weighted(spark, sf), ["country"], "barcode", "weight", 4)


_PARTS = """ranges AS (SELECT country, cut_no + 1 AS part, cut_key AS from_key, lead(cut_key) OVER (PARTITION BY country ORDER BY cut_no) AS to_key FROM cuts
   UNION ALL SELECT country, 1, NULL, cut_key FROM cuts WHERE cut_no = 1),
placed AS (SELECT w.*, part FROM weighted w JOIN ranges r ON r.country = w.country AND (from_key IS NULL OR barcode >= from_key) AND (to_key IS NULL OR barcode < to_key))"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _weighted(spark, sf)
    cuts = prefix.weight_cuts(rows, ["country"], "barcode", "weight", 4)
    return catalog.split_parts(rows, prefix.part_ranges(cuts, ["country"]))


@query("catalog_parts", f"""WITH {_LADDER}, {_WEIGHTED}, {_CUTS}, {_PARTS}
SELECT country, part::INT AS part, count(*) AS products, min(barcode) AS from_key, max(barcode) AS to_key, sum(weight)::BIGINT AS bytes FROM placed GROUP BY ALL""")
def catalog_parts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_index(_placed(spark, sf))


@query("catalog_index", f"""WITH {_LADDER}, {_WEIGHTED}, {_CUTS}, {_PARTS},
p AS (SELECT country, part, count(*) AS products, min(barcode) AS f, max(barcode) AS t, sum(weight)::BIGINT AS bytes FROM placed GROUP BY ALL)
SELECT country, '{{"products":' || sum(products)::VARCHAR || ',"bytes":' || sum(bytes)::BIGINT::VARCHAR || ',"version":"v1","parts":[' ||
  string_agg('{{"part":' || part::VARCHAR || ',"from_key":"' || f || '","to_key":"' || t || '","products":' || products::VARCHAR || ',"bytes":' || bytes::VARCHAR || '}}', ',' ORDER BY part) || ']}}' AS entry
FROM p GROUP BY country""")
def catalog_index(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.index_json(catalog.catalog_index(_placed(spark, sf)), "v1")


@query("stored_catalog", f"WITH {_LADDER}, {_WEIGHTED}, {_CUTS}, {_PARTS} SELECT country, part::INT AS part, barcode, weight FROM placed")
def stored_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Written by country and part in one pass, and read back by folder."""
    path = f"{checkpoint_root(spark)}/catalog-{uuid.uuid4().hex}"
    catalog.write_catalog(_placed(spark, sf), path, "v1")
    return spark.read.parquet(f"{path}/version=v1").select("country", F.col("part").cast("int").alias("part"), "barcode", "weight")


@query("reused_cuts", f"""WITH {_LADDER}, {_WEIGHTED}, tot AS (SELECT country, sum(weight) AS total FROM weighted GROUP BY country),
old AS (SELECT w.country, '8410008' AS cut FROM tot w),
piece AS (SELECT w.country, sum(weight) FILTER (barcode < cut) AS a, sum(weight) FILTER (barcode >= cut) AS b FROM weighted w JOIN old USING (country) GROUP BY w.country),
cap AS (SELECT max(greatest(a, b)) - 1 AS cap FROM piece)
SELECT country, greatest(a, b) <= cap AS reused, CASE WHEN greatest(a, b) <= cap THEN 2 ELSE greatest(2, ceil(total::DOUBLE / cap))::INT END AS parts
FROM piece JOIN tot USING (country), cap""")
def reused_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Two frozen parts per country; the cap is just below the largest one, so one country is cut anew."""
    rows = _weighted(spark, sf)
    old = rows.select("country").distinct().crossJoin(F.broadcast(spark.createDataFrame(
        [(1, None, "8410008"), (2, "8410008", None)], "part int, from_key string, to_key string")))
    cap = catalog.part_weights(rows, old, ["country"], "barcode", "weight").agg(F.max("weight")).first()[0] - 1
    ranges_df = catalog.reuse_ranges(rows, old, ["country"], "barcode", "weight", cap)
    return ranges_df.groupBy("country").agg(F.bool_and("reused").alias("reused"), F.count(F.lit(1)).cast("int").alias("parts"))


@query("popular_products", f"""WITH {_LADDER}, {_WEIGHTED}
SELECT country, barcode, popularity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY popularity DESC, barcode) AS rank FROM weighted) WHERE rank <= 50""")
def popular_products(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.keep_popular(_weighted(spark, sf), 50).select("country", "barcode", "popularity", "rank")


@query("trimmed_catalog", """SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 5000""")
def trimmed_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A large cap per group: ranks come from the running-count operator, not from one task per group."""
    from larder.binding import load

    rows = load(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kept = prefix.top_n_per_group(rows, ["l_returnflag"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5000,
                                  descending={"l_extendedprice"})
    return kept.select("l_returnflag", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("catalog_versions", """SELECT n_name AS country, CASE WHEN n_nationkey % 3 = 0 THEN 'v' || n_nationkey::VARCHAR
  ELSE '202409' || lpad((1 + n_nationkey)::VARCHAR, 2, '0') || 'T031439Z' END AS version FROM nation""")
def catalog_versions(spark: SparkSession, sf: str) -> DataFrame:
    from larder.binding import load

    n = load(spark, sf, "nation")
    key = F.col("n_nationkey")
    built = n.select(F.col("n_name").alias("country"), F.lit("built_at").alias("key"),
                     F.concat(F.lit("2024-09-"), F.lpad((key + 1).cast("string"), 2, "0"), F.lit("T03:14:39.123Z")).alias("value"))
    stated = n.filter(key % 3 == 0).select(F.col("n_name").alias("country"), F.lit("version").alias("key"), F.concat(F.lit("v"), key.cast("string")).alias("value"))
    return catalog.version_of(built.unionByName(stated))


@query("last_writes", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_writes(spark: SparkSession, sf: str) -> DataFrame:
    from larder.binding import load

    rows = load(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")
