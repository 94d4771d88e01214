"""Raw nested documents rendered from ``part``: what the catalogue and normalisation jobs read.

``RAW_SQL`` states every value as a column and runs in both engines; ``raw_documents`` renders the
columns as irregular JSON text (dynamic names, mixed number types, missing fields). The jobs read
only that text; the oracles start from the columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.binding import LABEL_TEXTS, _ADDITIVES, _pick, dealt, load
from larder.session import checkpoint_root, files_stamp
from larder.sources.dump import read_dump

RAW_SQL = f"""
SELECT k, name, brand, barcode,
  CASE WHEN k % 97 = 0 THEN NULL ELSE barcode END AS code,
  {_pick("k % 4", ["es", "en", "fr", "de"])} AS lang,
  CASE WHEN k % 3 = 0 THEN name WHEN k % 3 = 1 THEN '   ' END AS pn,
  CASE WHEN k % 3 = 1 THEN ' own ' || name || ' ' END AS pn_own,
  CASE WHEN k % 3 = 2 AND k % 5 < 3 THEN 'it ' || name END AS pn_it,
  CASE WHEN k % 3 = 2 AND k % 10 = 2 THEN 'ca ' || name END AS pn_ca,
  CASE WHEN k % 3 = 2 THEN 'zz ' || name END AS pn_debug,
  CASE WHEN k % 3 = 2 AND k % 5 = 3 THEN 'generic ' || name END AS gn,
  CASE WHEN k % 8 = 0 THEN NULL ELSE {_pick("k % 12", LABEL_TEXTS)} END AS ing_text,
  CASE WHEN k % 7 = 0 THEN NULL ELSE (k % 10) * 100 END AS product_quantity,
  CASE k % 6 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'l' WHEN 3 THEN 'CL' WHEN 4 THEN 'kg' END AS quantity_unit,
  concat_ws(',', CASE WHEN k % 3 <> 2 THEN 'en:spain' END, CASE WHEN k % 4 = 0 THEN 'en:mexico' END,
            CASE WHEN k % 2 = 0 THEN 'en:united-states' END, CASE WHEN k % 5 = 0 THEN 'en:france' END) AS countries,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'serving' ELSE '100g' END AS per,
  CASE k % 4 WHEN 1 THEN '30' WHEN 2 THEN '50' WHEN 3 THEN '0.9' END AS serving,
  CASE WHEN k % 7 = 0 THEN CAST(k * 37 % 6000 AS DOUBLE) END AS ekj_100g,
  CASE WHEN k % 14 = 0 THEN CAST(k * 7 % 1000 AS DOUBLE) WHEN k % 7 = 2 THEN CAST(k % 900 AS DOUBLE) END AS v3_energy,
  CASE WHEN k % 14 = 0 THEN 'kJ' WHEN k % 7 = 2 THEN 'kcal' END AS v3_energy_unit,
  CASE WHEN k % 7 = 3 THEN CAST(k % 3000 AS DOUBLE) END AS v3_energy_computed,
  CASE WHEN k % 7 = 1 THEN CAST(k * 11 % 1200 AS DOUBLE) END AS ekcal_100g,
  CASE WHEN k % 7 = 4 THEN CAST(k * 13 % 3000 AS DOUBLE) END AS energy_plain,
  CASE WHEN k % 7 = 5 THEN CAST(k % 800 AS DOUBLE) END AS energy_value,
  CASE WHEN k % 7 = 6 AND k % 2 = 0 THEN CAST(k * 3 % 3500 AS DOUBLE) END AS comp_energy,
  CASE WHEN k % 7 = 6 AND k % 2 = 1 THEN CAST(k % 500 AS DOUBLE) END AS ekj_serving,
  CASE WHEN k % 3 = 0 THEN CAST(k * 29 % 1100 AS DOUBLE) / 10 END AS fat_100g,
  CASE WHEN k % 9 = 0 THEN CAST(k % 90 AS DOUBLE) END AS v3_fat,
  CASE WHEN k % 3 = 1 THEN CAST(k % 90 AS DOUBLE) END AS fat_plain,
  CASE WHEN k % 3 = 2 THEN CAST(k % 5000 AS DOUBLE) END AS fat_value,
  CASE WHEN k % 2 = 0 THEN CAST(k * 17 % 30000 AS DOUBLE) END AS v3_sat,
  CASE WHEN k % 2 = 1 THEN CAST(k % 30 AS DOUBLE) END AS comp_sat,
  CASE WHEN k % 13 = 0 THEN 'unknown' ELSE CAST(k * 53 % 80 AS STRING) END AS sugars_text,
  CASE WHEN k % 4 = 0 THEN CAST(k % 300 AS DOUBLE) / 100 END AS salt_100g,
  CASE WHEN k % 4 = 1 THEN CAST(k % 400 AS DOUBLE) / 100 END AS sodium_100g,
  CASE WHEN k % 4 = 2 THEN CAST(k % 200 AS DOUBLE) / 100 END AS v3_sodium,
  CASE WHEN k % 6 = 0 THEN CAST(k % 101 AS DOUBLE) END AS nuts_plain,
  CASE WHEN k % 6 = 1 THEN CAST(k % 101 AS DOUBLE) END AS v3_fvl,
  CASE WHEN k % 19 = 0 THEN CAST(k % 15 AS DOUBLE) END AS alcohol_100g,
  CASE WHEN k % 5 = 2 THEN CAST(k % 10 AS DOUBLE) END AS fiber_serving,
  CASE WHEN k % 3 <> 1 THEN CAST(k % 30 AS DOUBLE) END AS proteins_plain,
  CASE WHEN k % 6 = 0 THEN '2023' WHEN k % 6 = 1 THEN '2021' WHEN k % 6 = 2 THEN 'legacy' END AS flag_source,
  k % 5 = 0 AS f_drink, k % 35 = 0 AS f_water, k % 7 = 1 AS f_cheese, k % 9 = 2 AS f_fats, k % 10 = 3 AS f_red,
  CASE k % 6 WHEN 3 THEN 'en:beverages,en:alcoholic-beverages,en:wines' WHEN 4 THEN 'en:cheeses,en:beers' END AS categories,
  concat_ws(',', {_ADDITIVES}) AS additives, CASE WHEN k % 2 = 0 THEN 'en:gluten' END AS allergens,
  CASE WHEN k % 3 = 0 THEN 'en:organic,es:denominacion-de-origen' END AS labels,
  CASE WHEN k % 3 = 0 THEN 'own' WHEN k % 3 = 1 THEN 'it' END AS image_lang,
  CASE WHEN k % 11 = 0 THEN 'x1' ELSE CAST(k AS STRING) END AS image_rev,
  CASE WHEN k % 50 = 0 THEN 'on' END AS no_data, k % 6 AS nova_raw,
  CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'unknown' WHEN 2 THEN 'e' END AS grade,
  1700000000 + k AS modified, k * 101 % 10007 AS popularity,
  1600000000 + k % 7 AS ocr_time
FROM (SELECT p_partkey AS k, p_name AS name, p_brand AS brand,
        CASE WHEN length(CAST(p_partkey * 7919 + 8410000000000 AS STRING)) >= 13 THEN CAST(p_partkey * 7919 + 8410000000000 AS STRING) ELSE lpad(CAST(p_partkey * 7919 + 8410000000000 AS STRING), 13, '0') END AS barcode FROM part) source
"""


#: Documents that one task renders, and that lie in one file of the dump.
FILE_DOCUMENTS = 5_000


def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of ``part`` is short and a document long, so rows are dealt out by their number before they grow."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return spark.sql(RAW_SQL.replace("FROM part)", "FROM {part})"), part=dealt(part, FILE_DOCUMENTS))


def _object(fields: dict):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per part in column ``value``, plus a broken line for every 200th part."""
    r = raw_columns(spark, sf_dir)
    c, k, none = F.col, F.col("k"), F.lit(None).cast("string")
    own = lambda name: F.concat(F.lit(f"{name}_"), c("lang"))
    text = c("ing_text")
    texts = F.map_filter(F.map_from_arrays(
        F.array(F.lit("product_name"), own("product_name"), F.lit("product_name_it"), F.lit("product_name_ca"),
                F.lit("product_name_debug_tags"), F.lit("generic_name"), own("ingredients_text"),
                F.concat(F.lit("ingredients_text_es_ocr_"), c("ocr_time").cast("string")),
                F.concat(F.lit("ingredients_text_es_ocr_"), c("ocr_time").cast("string"), F.lit("_result"))),
        F.array(c("pn"), c("pn_own"), c("pn_it"), c("pn_ca"), c("pn_debug"), c("gn"), text,
                F.when(k % 3 == 0, F.concat(F.lit("scan "), c("name"))), F.when(k % 6 == 0, F.lit("read")))),
        lambda _, v: v.isNotNull())
    flags = _object({
        "is_beverage": c("f_drink").cast("int"), "is_water": c("f_water").cast("int").cast("string"),
        "is_cheese": c("f_cheese"), "is_fat_oil_nuts_seeds": c("f_fats").cast("int"), "is_red_meat_product": c("f_red").cast("int")})
    comps = F.array_compact(F.array(
        F.when(c("comp_energy").isNotNull(), _object({"id": F.lit("energy"), "value": c("comp_energy"), "unit": F.lit("kJ"), "points": (k % 10).cast("int")})),
        F.when(c("comp_sat").isNotNull(), _object({"id": F.lit("saturated_fat"), "value": c("comp_sat"), "unit": F.lit("g"), "points": (k % 10).cast("int")}))))
    legacy = lambda name: F.when(c("flag_source") == "legacy", flags[name])
    nutriscore_data = _object({"score": (k % 40 - 10).cast("int"), "components": _object({"negative": comps}),
                               **{n: legacy(n) for n in ("is_beverage", "is_water", "is_cheese", "is_fat_oil_nuts_seeds", "is_red_meat_product")}})
    edition = F.when(c("flag_source").isin("2023", "2021"), F.map_from_arrays(F.array(c("flag_source")), F.array(_object({
        "grade": c("grade"), "score": (k % 40 - 10).cast("int"), "nutriscore_applicable": F.lit(1),
        "data": _object({"is_beverage": flags["is_beverage"], "is_water": flags["is_water"], "is_cheese": flags["is_cheese"],
                         "is_fat_oil_nuts_seeds": flags["is_fat_oil_nuts_seeds"], "is_red_meat_product": flags["is_red_meat_product"],
                         "negative_points": (k % 20).cast("int"), "positive_points": (k % 6).cast("int"), "components": _object({"negative": comps})})}))))
    v3_leaf = lambda v, computed, unit, source, modifier: F.when(F.coalesce(v, computed).isNotNull(), _object(
        {"value": v, "value_computed": computed, "unit": unit, "source": source, "modifier": modifier}))
    nd = F.lit(None).cast("double")
    v3 = _object({
        "energy-kj": v3_leaf(c("v3_energy"), c("v3_energy_computed"), c("v3_energy_unit"), F.lit("packaging"), none),
        "fat": v3_leaf(c("v3_fat"), nd, F.lit("g"), F.lit("packaging"), none),
        "saturated-fat": v3_leaf(c("v3_sat"), nd, F.lit("mg"), F.lit("estimate"), none),
        "sodium": v3_leaf(c("v3_sodium"), nd, F.lit("g"), F.lit("packaging"), F.lit("~")),
        "fruits-vegetables-legumes": v3_leaf(c("v3_fvl"), nd, F.lit("%"), F.lit("estimate"), none)})
    nutriments = _object({
        "energy-kj_100g": c("ekj_100g"), "energy-kcal_100g": c("ekcal_100g"), "energy": c("energy_plain"),
        "energy-kj_value": c("energy_value"), "energy-kj_unit": F.when(c("energy_value").isNotNull(), "kcal"),
        "energy-kj_serving": c("ekj_serving"), "fat_100g": c("fat_100g"), "fat": c("fat_plain"), "fat_value": c("fat_value"),
        "fat_unit": F.when(c("fat_value").isNotNull(), "mg"), "sugars_100g": c("sugars_text"), "salt_100g": c("salt_100g"),
        "sodium_100g": c("sodium_100g"), "fruits-vegetables-nuts": c("nuts_plain"), "alcohol_100g": c("alcohol_100g"),
        "fiber_serving": c("fiber_serving"), "proteins": c("proteins_plain").cast("long")})
    tags = lambda name: F.when(c(name) != "", F.split(c(name), ","))
    lang = F.when(c("image_lang") == "own", c("lang")).otherwise(c("image_lang"))
    front = F.when(lang.isNotNull(), F.map_from_arrays(F.array(lang), F.array(_object({
        "imgid": k.cast("string"), "rev": c("image_rev"),
        "sizes": _object({"100": _object({"w": F.lit(100), "h": (k % 100).cast("int")}), "full": _object({"w": (k % 3000).cast("int"), "h": F.lit(4000)})})}))))
    words = F.transform(F.split(F.coalesce(text, F.lit("")), ", "), lambda w: F.trim(w))
    # Some trees are much deeper than most.
    deep = None
    for i in range(14, 0, -1):
        deep = F.array(_object({"text": F.lit(f"deep{i}"), **({"ingredients": deep} if deep is not None else {})}))
    leaf = F.when(k % 4 == 0, F.array(_object({"id": F.lit("en:minor"), "text": F.lit("minor"), "percent": k % 7, "ingredients": F.when(k % 40 == 0, deep)})))
    tree = F.when(text.isNotNull(), F.transform(words, lambda w, i: _object({
        "id": F.concat(F.lit("en:"), F.lower(w)), "text": w, "percent_estimate": (k % 50 + i).cast("double"), "vegan": F.lit("maybe"), "vegetarian": F.when(i == 1, "yes"),
        "ingredients": F.when((i == 0) & (k % 2 == 0), F.array(_object({
            "id": F.lit("en:part"), "text": F.lit("part"), "vegan": F.lit("sometimes"), "ingredients": leaf})))})))
    uniform = F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("cell_"), i.cast("string"))),
        F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.when(i <= k % 5, F.concat(F.lit("v"), i.cast("string"))).otherwise("same")))
    body = _object({
        "code": c("code"), "lang": c("lang"), "brands": c("brand"), "quantity": F.concat((k % 10).cast("string"), F.lit("00 g")),
        "product_quantity": c("product_quantity"), "product_quantity_unit": c("quantity_unit"), "countries_tags": tags("countries"),
        "nutrition_data_per": c("per"), "serving_quantity": c("serving"), "nutriments": nutriments,
        "nutrition": _object({"aggregated_set": _object({"nutrients": v3})}), "nutriscore": edition, "nutriscore_data": nutriscore_data,
        "nutriscore_grade": c("grade"), "categories_tags": tags("categories"), "additives_tags": tags("additives"),
        "allergens_tags": tags("allergens"), "labels_tags": tags("labels"), "labels_hierarchy": tags("labels"),
        "images": _object({"selected": _object({"front": front}), "uploaded": F.map_from_arrays(
            F.array((k % 3).cast("string")), F.array(_object({"uploaded_t": c("modified"), "uploader": F.lit("someone")})))}),
        "no_nutrition_data": c("no_data"), "nova_group": c("nova_raw"), "last_modified_t": c("modified").cast("string"),
        "created_t": F.when(k % 9 == 0, F.lit(99999999999)).otherwise(c("modified") - 1000), "popularity_key": c("popularity"),
        "nutrient_levels": _object({"fat": F.when(k % 3 == 0, "high").when(k % 3 == 1, "weird"), "salt": F.lit("low")}),
        "nova_groups_markers": F.when(k % 4 == 3, F.create_map(F.lit("4"), F.array(
            F.array(F.lit("additives"), F.lit("en:e100")), F.array(F.lit("additives"), F.lit("en:e100")), F.array(F.lit("ingredients"), F.lit("en:sugar"))))),
        "ingredients": tree, "packagings": F.when(k % 5 == 0, F.array(_object({
            "shape": F.lit("en:bottle"), "material": F.lit("en:glass"), "recycling": F.lit("en:recycle"), "food_contact": F.when(k % 10 == 0, "1").otherwise("0"), "number_of_units": F.lit("1"), "weight_measured": F.concat((k % 9).cast("string"), F.lit(",5"))}))),
        "sources": F.when(k % 6 == 0, F.array(_object({"id": F.lit("maker"), "name": c("brand"), "url": F.concat(F.lit("http://maker/"), k.cast("string")), "source_licence": F.lit("open"), "manufacturer": F.lit("1"),
            "import_t": c("modified"), "fields": F.array(F.lit("brands"), F.lit("brands"), F.lit("quantity"))}))),
        "languages_codes": F.map_from_arrays(F.array(c("lang")), F.array((k % 4 + 1).cast("int"))),
        "cells": uniform, "misc": _object({"depth": _object({"note": F.concat(F.lit("n"), (k % 4).cast("string"))}),
                                          "list": F.array((k % 3).cast("int"), F.lit(7))}),
        "owner": F.when(k % 2 == 0, F.lit("org"))})
    rendered = r.select("k", F.to_json(texts).alias("head"), F.to_json(body).alias("tail"))
    whole = F.when(F.col("head") == "{}", F.col("tail")).otherwise(
        F.concat(F.left("head", F.length("head") - 1), F.lit(","), F.substr("tail", F.lit(2))))
    lines = rendered.select("k", whole.alias("value"))
    return lines.select("k", F.explode(F.when(k % 200 == 0, F.array("value", F.lit("{broken"), F.lit(""))).otherwise(F.array("value"))).alias("value"))


_WRITTEN: dict[tuple[str, str, str], str] = {}


def dump_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the rendered documents as gzip text, written once per application for what the table holds."""
    key = (spark.sparkContext.applicationId, sf_dir, files_stamp(spark, f"{sf_dir}/part.parquet"))
    if key not in _WRITTEN:
        path = f"{checkpoint_root(spark)}/dump-{uuid.uuid4().hex}"
        # Gzip can't be split, so it is written in files of bounded size and then read as it lies.
        raw_documents(spark, sf_dir).select("value").write.option("compression", "gzip").text(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_dump(spark, dump_path(spark, sf_dir))
