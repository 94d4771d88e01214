"""Facts tables derived from the catalogue: nutrition facts, grade scale, markers, usability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.functions import nova, nutriscore as ns
from larder.plans import scoring

FACT_UNITS = {
    "energy_kj": "kJ", "energy_kcal": "kcal", "fat": "g", "saturated_fat": "g", "trans_fat": "g",
    "carbohydrates": "g", "sugars": "g", "fiber": "g", "proteins": "g", "salt": "g", "sodium": "mg",
    "fvl": "%", "alcohol": "%",
}


def nutrition_facts(products: DataFrame) -> DataFrame:
    """Long form: one row per known nutrient, with the mark of values not taken from the label."""
    rows = F.array_compact(F.array(*[
        F.when(F.col(name).isNotNull(), F.struct(
            F.lit(name).alias("label"), F.col(name).alias("value"), F.lit(unit).alias("unit"),
            F.try_element_at("estimated", F.lit(name)).alias("mark")))
        for name, unit in FACT_UNITS.items()]))
    return products.select("barcode", F.inline(rows))


def usable(products: DataFrame) -> DataFrame:
    measured = F.coalesce("energy_kj", "energy_kcal", "sugars", "fat", "proteins").isNotNull()
    described = F.coalesce(F.trim("ingredients_text") != "", F.lit(False))
    named = F.coalesce(F.trim("name") != "", F.lit(False))
    return products.select("barcode", (named & (measured | described)).alias("usable"))


def grade_scale(spark) -> DataFrame:
    """Score interval of each grade per category. Water is always a and has no interval."""
    rows = []
    for category, cuts in ns.GRADE_CUTS.items():
        low, high = ns.SCORE_LIMITS[category]
        start = low
        for letter, cut in zip("abcde", [*cuts, high]):
            if cut is None:
                continue
            rows.append((category, letter, start, cut))
            start = cut + 1
    return spark.createDataFrame(rows, "category string, grade string, score_from int, score_to int")


def grade_scale_usage(products: DataFrame) -> DataFrame:
    """Products per interval; every interval adds a zero, so empty ones show without a join."""
    counted = (scoring.with_nutriscore(products).filter("NOT (is.beverage AND is.water)")
               .select(ns.category().alias("category"), F.col("nutri_grade").alias("grade"),
                       F.lit(None).cast("int").alias("score_from"), F.lit(None).cast("int").alias("score_to"), F.lit(1).alias("one")))
    scale = grade_scale(products.sparkSession).withColumn("one", F.lit(0))
    return counted.unionByName(scale).groupBy("category", "grade").agg(
        F.max("score_from").alias("score_from"), F.max("score_to").alias("score_to"), F.sum("one").alias("products"))


def nova_markers(products: DataFrame, dim: DataFrame) -> DataFrame:
    """Every marker of every product, also where the group is declared: they explain it."""
    words = products.select("barcode", F.explode(nova.text_markers(F.col("ingredients_text"))).alias("value"))
    tags = scoring.assess_additives(products, dim).filter(F.col("marker_class").isNotNull())
    return words.select("barcode", F.lit("ingredient").alias("kind"), "value", F.lit(None).cast("string").alias("class")).unionByName(
        tags.select("barcode", F.lit("additive").alias("kind"), F.col("tag").alias("value"), F.col("marker_class").alias("class")))
