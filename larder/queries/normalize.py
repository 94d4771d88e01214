"""Normalisation and profiling queries over documents rendered from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.plans import normalize as nz
from larder.queries.registry import query
from larder.rawdocs import RAW_SQL, dump_lines
from larder.sources import dump

_RAW = f"raw AS ({RAW_SQL}), d AS (SELECT * FROM raw WHERE code IS NOT NULL)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return nz.with_code(dump.documents(dump_lines(spark, sf)))


_TEXT = """t AS (SELECT code, 'product_name' AS field, '' AS lang, trim(pn) AS value FROM d UNION ALL SELECT code, 'product_name', lang, trim(pn_own) FROM d
  UNION ALL SELECT code, 'product_name', 'it', trim(pn_it) FROM d UNION ALL SELECT code, 'product_name', 'ca', trim(pn_ca) FROM d
  UNION ALL SELECT code, 'generic_name', '', trim(gn) FROM d UNION ALL SELECT code, 'ingredients_text', lang, trim(ing_text) FROM d)"""


@query("text_variants", f"WITH {_RAW}, {_TEXT} SELECT code, field, lang, value FROM t WHERE value <> ''")
def text_variants(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_text(docs(spark, sf))


@query("normalized_products", f"""WITH {_RAW}
SELECT code, lang, coalesce(nullif(trim(pn), ''), trim(pn_own), trim(coalesce(pn_ca, pn_it)), gn) AS name,
  CASE WHEN k % 3 < 2 THEN lang WHEN pn_ca IS NOT NULL THEN 'ca' WHEN pn_it IS NOT NULL THEN 'it' WHEN gn IS NOT NULL THEN lang END AS name_lang,
  ing_text AS ingredients, CASE WHEN ing_text IS NOT NULL THEN lang END AS ingredients_lang, brand AS brands, (k % 10)::VARCHAR || '00 g' AS quantity, product_quantity::DOUBLE AS quantity_g, serving::DOUBLE AS serving_g,
  per AS nutrition_base, no_data IS NOT NULL AS no_table, CASE WHEN nova_raw BETWEEN 1 AND 4 THEN nova_raw::INT END AS nova_group, CASE WHEN grade <> 'unknown' THEN grade END AS nutriscore_grade,
  CASE WHEN k % 9 = 0 THEN NULL ELSE (modified - 1000) * 1000 END AS created, modified * 1000 AS modified, popularity::DOUBLE AS popularity FROM d""")
def normalized_products(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_product(docs(spark, sf))


@query("ocr_runs", f"""WITH {_RAW} SELECT code, 'ingredients_text' AS field, 'es' AS lang, ocr_time * 1000 AS ran_at, 'scan ' || name AS text, CASE WHEN k % 6 = 0 THEN 'read' END AS result FROM d WHERE k % 3 = 0""")
def ocr_runs(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_ocr(docs(spark, sf))


@query("tag_lists", f"""WITH {_RAW}, l AS (SELECT code, 'countries' AS type, countries AS v FROM d UNION ALL SELECT code, 'categories', categories FROM d UNION ALL SELECT code, 'additives', additives FROM d
   UNION ALL SELECT code, 'allergens', allergens FROM d UNION ALL SELECT code, 'labels', labels FROM d)
SELECT code, type, (generate_subscripts(string_split(v, ','), 1) - 1)::INT AS pos, unnest(string_split(v, ',')) AS tag FROM l WHERE v <> ''""")
def tag_lists(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_tags(docs(spark, sf))


@query("nutrient_values", f"""WITH {_RAW}, b AS (SELECT *, coalesce(per, '100g') AS base FROM d),
n AS (SELECT code, 'energy-kj' AS nid, coalesce(v3_energy, v3_energy_computed) AS value, v3_energy_unit AS unit, '100g' AS base, 'aggregated_set' AS origin, 'packaging' AS source FROM b
 UNION ALL SELECT code, 'fat', v3_fat, 'g', '100g', 'aggregated_set', 'packaging' FROM b UNION ALL SELECT code, 'saturated-fat', v3_sat, 'mg', '100g', 'aggregated_set', 'estimate' FROM b
 UNION ALL SELECT code, 'sodium', v3_sodium, 'g', '100g', 'aggregated_set', 'packaging' FROM b UNION ALL SELECT code, 'fruits-vegetables-legumes', v3_fvl, '%', '100g', 'aggregated_set', 'estimate' FROM b
 UNION ALL SELECT code, 'energy-kj', ekj_100g, NULL, '100g', 'nutriments_100g', NULL FROM b UNION ALL SELECT code, 'energy-kcal', ekcal_100g, NULL, '100g', 'nutriments_100g', NULL FROM b
 UNION ALL SELECT code, 'energy', energy_plain, NULL, base, 'nutriments_base', NULL FROM b UNION ALL SELECT code, 'energy-kj', energy_value, 'kcal', 'declared', 'nutriments_base', NULL FROM b
 UNION ALL SELECT code, 'energy-kj', ekj_serving, NULL, 'serving', 'nutriments_base', NULL FROM b UNION ALL SELECT code, 'fat', fat_100g, NULL, '100g', 'nutriments_100g', NULL FROM b
 UNION ALL SELECT code, 'fat', fat_plain, NULL, base, 'nutriments_base', NULL FROM b UNION ALL SELECT code, 'fat', fat_value, 'mg', 'declared', 'nutriments_base', NULL FROM b
 UNION ALL SELECT code, 'sugars', try_cast(sugars_text AS DOUBLE), NULL, '100g', 'nutriments_100g', NULL FROM b UNION ALL SELECT code, 'salt', salt_100g, NULL, '100g', 'nutriments_100g', NULL FROM b
 UNION ALL SELECT code, 'sodium', sodium_100g, NULL, '100g', 'nutriments_100g', NULL FROM b UNION ALL SELECT code, 'fruits-vegetables-nuts', nuts_plain, NULL, base, 'nutriments_base', NULL FROM b
 UNION ALL SELECT code, 'alcohol', alcohol_100g, NULL, '100g', 'nutriments_100g', NULL FROM b UNION ALL SELECT code, 'fiber', fiber_serving, NULL, 'serving', 'nutriments_base', NULL FROM b
 UNION ALL SELECT code, 'proteins', proteins_plain, NULL, base, 'nutriments_base', NULL FROM b
 UNION ALL SELECT code, 'energy', comp_energy, 'kJ', '100g', 'nutriscore_data', NULL FROM b UNION ALL SELECT code, 'saturated-fat', comp_sat, 'g', '100g', 'nutriscore_data', NULL FROM b)
SELECT code, nid, value, unit, base, origin, source, false AS prepared FROM n WHERE value IS NOT NULL""")
def nutrient_values(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_nutrients(docs(spark, sf))


@query("nutrient_levels", f"""WITH {_RAW} SELECT code, 'salt' AS nid, 'low' AS level FROM d UNION ALL SELECT code, 'fat', 'high' FROM d WHERE k % 3 = 0""")
def nutrient_levels(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_levels(docs(spark, sf))


@query("score_versions", f"""WITH {_RAW} SELECT code, flag_source AS version, (k % 40 - 10)::DOUBLE AS score, grade, true AS applicable, f_drink AS is_beverage, f_water AS is_water, f_cheese AS is_cheese,
  f_fats AS is_fat_oil_nuts_seeds, f_red AS is_red_meat_product, (k % 20)::DOUBLE AS negative_points, (k % 6)::DOUBLE AS positive_points FROM d WHERE flag_source IN ('2023', '2021')""")
def score_versions(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_scores(docs(spark, sf))[0]


@query("score_components", f"""WITH {_RAW} SELECT code, flag_source AS version, 'negative' AS side, 'energy' AS id, comp_energy AS value, 'kJ' AS unit, (k % 10)::DOUBLE AS points FROM d WHERE flag_source IN ('2023', '2021') AND comp_energy IS NOT NULL
  UNION ALL SELECT code, flag_source, 'negative', 'saturated_fat', comp_sat, 'g', (k % 10)::DOUBLE FROM d WHERE flag_source IN ('2023', '2021') AND comp_sat IS NOT NULL""")
def score_components(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_scores(docs(spark, sf))[1]


_INGREDIENTS = """w AS (SELECT code, k, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM (SELECT code, k, string_split(ing_text, ', ') AS l FROM d WHERE ing_text IS NOT NULL)),
ing AS (SELECT code, pos::VARCHAR AS path, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, pos::INT AS pos, 'en:' || lower(word) AS id, word AS text, CAST(NULL AS DOUBLE) AS percent, (k % 50 + pos)::DOUBLE AS percent_estimate, 'maybe' AS vegan, CASE WHEN pos = 1 THEN 'yes' END AS vegetarian FROM w
  UNION ALL SELECT code, '0.0', '0', 1, 0, 'en:part', 'part', NULL, NULL, NULL, NULL FROM w WHERE pos = 0 AND k % 2 = 0
  UNION ALL SELECT code, '0.0.0', '0.0', 2, 0, 'en:minor', 'minor', (k % 7)::DOUBLE, NULL, NULL, NULL FROM w WHERE pos = 0 AND k % 4 = 0
  UNION ALL SELECT code, '0.0.0' || repeat('.0', i), '0.0.0' || repeat('.0', i - 1), 2 + i, 0, NULL, 'deep' || i::VARCHAR, NULL, NULL, NULL, NULL FROM w, range(1, 15) t(i) WHERE pos = 0 AND k % 40 = 0)"""


@query("ingredient_rows", f"WITH {_RAW}, {_INGREDIENTS} SELECT code, path, parent, depth::INT AS depth, pos, id, text, percent, percent_estimate, vegan, vegetarian FROM ing")
def ingredient_rows(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_ingredients(docs(spark, sf))


@query("ingredient_trees", f"""WITH {_RAW}, {_INGREDIENTS} SELECT code, path, repeat('  ', depth) || text AS label,
  (row_number() OVER (PARTITION BY code ORDER BY split_part(path, '.', 1)::INT, depth))::INT AS line FROM ing""")
def ingredient_trees(spark: SparkSession, sf: str) -> DataFrame:
    from larder.operators.prefix import with_running

    rows = nz.ingredient_tree(nz.docs_ingredients(docs(spark, sf))).select("code", "order", "path", "label")
    return with_running(rows, ["code"], ["order"]).select("code", "path", "label", F.col("rank").cast("int").alias("line"))


@query("nova_marker_rows", f"""WITH {_RAW} SELECT code, 4 AS nova_group, unnest(['additives', 'ingredients']) AS kind, unnest(['en:e100', 'en:sugar']) AS value FROM d WHERE k % 4 = 3""")
def nova_marker_rows(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_nova(docs(spark, sf))


@query("image_rows", f"""WITH {_RAW} SELECT code, 'selected' AS class, 'front' AS type, CASE WHEN image_lang = 'own' THEN lang ELSE image_lang END AS lang, k::VARCHAR AS imgid, image_rev AS rev, CAST(NULL AS BIGINT) AS uploaded,
   CAST(NULL AS VARCHAR) AS uploader FROM d WHERE image_lang IS NOT NULL UNION ALL SELECT code, 'uploaded', (k % 3)::VARCHAR, '', (k % 3)::VARCHAR, NULL, modified * 1000, 'someone' FROM d""")
def image_rows(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_images(docs(spark, sf))[0]


@query("image_sizes", f"""WITH {_RAW} SELECT code, 'selected' AS class, 'front' AS type, CASE WHEN image_lang = 'own' THEN lang ELSE image_lang END AS lang, '100' AS size, 100 AS width, (k % 100)::INT AS height FROM d WHERE image_lang IS NOT NULL
  UNION ALL SELECT code, 'selected', 'front', CASE WHEN image_lang = 'own' THEN lang ELSE image_lang END, 'full', (k % 3000)::INT, 4000 FROM d WHERE image_lang IS NOT NULL""")
def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_images(docs(spark, sf))[1]


@query("package_rows", f"WITH {_RAW} SELECT code, 0 AS pos, 'en:bottle' AS shape, 'en:glass' AS material, 'en:recycle' AS recycling, k % 10 = 0 AS food_contact, 1.0::DOUBLE AS units, (k % 9)::DOUBLE + 0.5 AS weight FROM d WHERE k % 5 = 0")
def package_rows(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_packages(docs(spark, sf))


@query("source_rows", f"WITH {_RAW} SELECT code, 0 AS pos, 'maker' AS id, brand AS name, 'http://maker/' || k::VARCHAR AS url, true AS manufacturer, modified * 1000 AS imported, 'open' AS licence FROM d WHERE k % 6 = 0")
def source_rows(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_sources(docs(spark, sf))[0]


@query("source_fields", f"WITH {_RAW} SELECT code, 0 AS pos, unnest(['brands', 'quantity']) AS field FROM d WHERE k % 6 = 0")
def source_fields(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_sources(docs(spark, sf))[1]


@query("product_languages", f"WITH {_RAW} SELECT code, lang, true AS is_code, (k % 4 + 1)::INT AS fields FROM d")
def product_languages(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_languages(docs(spark, sf))


@query("properties", f"""WITH {_RAW}, c AS (SELECT code, k, unnest(range(1, 10)) AS i FROM d),
p AS (SELECT code, '' AS scope, 'product_quantity_unit' AS key, quantity_unit AS value FROM d UNION ALL SELECT code, '', 'owner', CASE WHEN k % 2 = 0 THEN 'org' END FROM d
  UNION ALL SELECT code, 'cells', '*', 'same' FROM d UNION ALL SELECT code, 'cells', 'cell_' || i::VARCHAR, 'v' || i::VARCHAR FROM c WHERE i <= k % 5
  UNION ALL SELECT code, 'misc.depth', 'note', 'n' || (k % 4)::VARCHAR FROM d UNION ALL SELECT code, 'misc', 'list', (k % 3)::VARCHAR || ',7' FROM d)
SELECT code, scope, key, value, try_cast(replace(value, ',', '.') AS DOUBLE) AS number FROM p WHERE value IS NOT NULL""")
def properties(spark: SparkSession, sf: str) -> DataFrame:
    return nz.docs_properties(docs(spark, sf))


@query("vocabulary", f"""WITH {_RAW}, {_TEXT} SELECT DISTINCT 'field' AS class, field AS value FROM t WHERE value <> '' UNION SELECT DISTINCT 'language', lang FROM t WHERE value <> ''""")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return nz.vocabulary(nz.docs_text(docs(spark, sf)), {"field": "field", "lang": "language"}).drop("id")


@query("load_audit", f"""WITH {_RAW} SELECT 'language' AS "table", count(*) AS rows FROM d UNION ALL SELECT 'package', count(*) FILTER (k % 5 = 0) FROM d
  UNION ALL SELECT 'level', (count(*) + count(*) FILTER (k % 3 = 0)) FROM d UNION ALL SELECT 'image', (count(*) + count(image_lang)) FROM d""")
def load_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return nz.load_audit({"language": nz.docs_languages(d), "package": nz.docs_packages(d), "level": nz.docs_levels(d), "image": nz.docs_images(d)[0]})


_PRESENCE = """f AS (SELECT unnest(['code', 'lang', 'brands', 'quantity', 'nutriments', 'nutrition', 'nutriscore_data', 'images', 'nova_group', 'last_modified_t', 'created_t', 'popularity_key', 'nutrient_levels', 'languages_codes', 'cells', 'misc']) AS key,
   unnest(['string', 'string', 'string', 'string', 'object', 'object', 'object', 'object', 'int', 'string', 'int', 'int', 'object', 'object', 'object', 'object']) AS kind),
census AS (SELECT f.key, n.n, f.kind FROM f, (SELECT count(*) AS n FROM d) n
  UNION ALL SELECT 'product_name', count(*) FILTER (pn IS NOT NULL), 'string' FROM d UNION ALL SELECT 'product_name_' || lang, count(*), 'string' FROM d WHERE k % 3 = 1 GROUP BY lang
  UNION ALL SELECT 'product_name_it', count(pn_it), 'string' FROM d UNION ALL SELECT 'product_name_ca', count(pn_ca), 'string' FROM d UNION ALL SELECT 'product_name_debug_tags', count(pn_debug), 'string' FROM d
  UNION ALL SELECT 'generic_name', count(gn), 'string' FROM d UNION ALL SELECT 'ingredients_text_' || lang, count(*), 'string' FROM d WHERE ing_text IS NOT NULL GROUP BY lang
  UNION ALL SELECT 'product_quantity', count(product_quantity), 'int' FROM d UNION ALL SELECT 'product_quantity_unit', count(quantity_unit), 'string' FROM d
  UNION ALL SELECT 'countries_tags', count(*) FILTER (countries <> ''), 'array' FROM d UNION ALL SELECT 'nutrition_data_per', count(per), 'string' FROM d UNION ALL SELECT 'serving_quantity', count(serving), 'string' FROM d
  UNION ALL SELECT 'nutriscore', count(*) FILTER (flag_source IN ('2023', '2021')), 'object' FROM d UNION ALL SELECT 'nutriscore_grade', count(grade), 'string' FROM d UNION ALL SELECT 'categories_tags', count(categories), 'array' FROM d
  UNION ALL SELECT 'additives_tags', count(*) FILTER (additives <> ''), 'array' FROM d UNION ALL SELECT 'allergens_tags', count(allergens), 'array' FROM d UNION ALL SELECT 'labels_tags', count(labels), 'array' FROM d
  UNION ALL SELECT 'labels_hierarchy', count(labels), 'array' FROM d UNION ALL SELECT 'no_nutrition_data', count(no_data), 'string' FROM d UNION ALL SELECT 'nova_groups_markers', count(*) FILTER (k % 4 = 3), 'object' FROM d
  UNION ALL SELECT 'ingredients', count(ing_text), 'array' FROM d UNION ALL SELECT 'packagings', count(*) FILTER (k % 5 = 0), 'array' FROM d UNION ALL SELECT 'sources', count(*) FILTER (k % 6 = 0), 'array' FROM d
  UNION ALL SELECT 'owner', count(*) FILTER (k % 2 = 0), 'string' FROM d)"""


@query("field_census", f"WITH {_RAW}, {_PRESENCE} SELECT key, n, kind AS kinds, kind AS dominant FROM census WHERE n > 0")
def field_census(spark: SparkSession, sf: str) -> DataFrame:
    return nz.field_census(docs(spark, sf)).withColumn("kinds", F.array_join("kinds", ","))


def _total(d: DataFrame) -> DataFrame:
    return d.agg(F.count(F.lit(1)).alias("documents"))


@query("presence_bands", f"""WITH {_RAW}, {_PRESENCE}, s AS (SELECT n * 100.0::DOUBLE / (SELECT count(*) FROM d) AS share FROM census WHERE n > 0)
SELECT CASE WHEN share >= 99.9 THEN '>=99.9' WHEN share >= 99 THEN '>=99.0' WHEN share >= 90 THEN '>=90.0' WHEN share >= 50 THEN '>=50.0' WHEN share >= 10 THEN '>=10.0' WHEN share >= 1 THEN '>=1.0'
  WHEN share >= 0.1 THEN '>=0.1' WHEN share >= 0.01 THEN '>=0.01' ELSE '<0.01' END AS band, count(*) AS fields FROM s GROUP BY 1""")
def presence_bands(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return nz.presence_bands(nz.field_census(d), _total(d))


# Fields of half the documents count as common here, so that some documents lack one.
@query("nonconforming_documents", f"""WITH {_RAW}, m AS (SELECT code, (product_quantity IS NULL)::INT + (quantity_unit IS NULL)::INT + (per IS NULL)::INT + (serving IS NULL)::INT + (ing_text IS NULL)::INT + (ing_text IS NULL)::INT * 0
   + (additives = '')::INT + (countries = '')::INT + (grade IS NULL)::INT AS missing FROM d)
SELECT code, missing::INT AS missing, 0 AS other_kind FROM m WHERE missing > 0""")
def nonconforming_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return nz.nonconforming(d, nz.field_census(d), _total(d), share=0.7)


@query("nutrient_inventory", f"""WITH {_RAW}, l AS (SELECT 'energy-kj' AS key, v3_energy_unit AS unit, 'packaging' AS source FROM d WHERE coalesce(v3_energy, v3_energy_computed) IS NOT NULL
  UNION ALL SELECT 'fat', 'g', 'packaging' FROM d WHERE v3_fat IS NOT NULL UNION ALL SELECT 'saturated-fat', 'mg', 'estimate' FROM d WHERE v3_sat IS NOT NULL
  UNION ALL SELECT 'sodium', 'g', 'packaging' FROM d WHERE v3_sodium IS NOT NULL UNION ALL SELECT 'fruits-vegetables-legumes', '%', 'estimate' FROM d WHERE v3_fvl IS NOT NULL)
SELECT key, 'unit' AS part, unit AS item, count(*) AS n FROM l WHERE unit IS NOT NULL GROUP BY ALL UNION ALL SELECT key, 'source', source, count(*) FROM l GROUP BY ALL""")
def nutrient_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return nz.map_inventory(docs(spark, sf), "$.nutrition.aggregated_set.nutrients", ["unit", "source"])


@query("event_property_census", "SELECT event_type AS code, 'k' AS key, count(*) AS n FROM events GROUP BY event_type")
def event_property_census(spark: SparkSession, sf: str) -> DataFrame:
    from larder.binding import load

    rows = load(spark, sf, "events").select(F.col("event_type").alias("code"), F.try_parse_json("props").alias("raw"))
    return nz.entries(rows).groupBy("code", "key").agg(F.count(F.lit(1)).alias("n"))
