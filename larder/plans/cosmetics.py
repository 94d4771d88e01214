"""Cosmetic assessment: regulatory flags and allergens instead of a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions import cosmetics as cos
from larder.functions.text import inci_list

_FLAG = "struct<pos:int,ingredient:string,severity:string,annex:string>"


def _lookup(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def with_flags(products: DataFrame) -> DataFrame:
    """Adds ``ingredients`` and ``flags``. Both lists are literals of a few dozen entries, so each
    ingredient is looked up in place: no join, no shuffle. A regulated substance wins over an
    allergen of the same name."""
    annex = _lookup([(i, a) for i, a, _ in cos.REGULATED])
    allergen = F.array(*[F.lit(a) for a in cos.FRAGRANCE_ALLERGENS])

    def flag(s: Column, i: Column) -> Column:
        a = F.try_element_at(annex, s)
        severity = F.when(a == "II", "prohibited").when(a.isNotNull(), "restricted").when(F.array_contains(allergen, s), "allergen")
        return F.struct(i.alias("pos"), s.alias("ingredient"), severity.alias("severity"), a.alias("annex"))

    return (products.withColumn("ingredients", inci_list(F.col("ingredients_text")))
            .withColumn("flags", F.filter(F.transform("ingredients", flag), lambda f: f["severity"].isNotNull())))


def sort_flags(flags: Column) -> Column:
    """Gravest first, label order within one severity."""
    order = F.array(*[F.lit(s) for s in cos.SEVERITY_ORDER])
    keyed = F.transform(flags, lambda f: F.struct(
        F.array_position(order, f["severity"]).alias("rank"), f["pos"].alias("pos"), f.alias("flag")))
    return F.transform(F.array_sort(keyed), lambda k: k["flag"])


def flag_rows(products: DataFrame) -> DataFrame:
    rows = with_flags(products).select("barcode", F.posexplode(sort_flags(F.col("flags"))).alias("at", "flag"))
    return rows.select("barcode", (F.col("at") + 1).alias("rank"), "flag.ingredient", "flag.severity", "flag.annex")


def assess(products: DataFrame) -> DataFrame:
    tally = lambda s: F.size(F.filter("flags", lambda f: f["severity"] == s))
    total = F.size("ingredients")
    full = total >= cos.FULL_LIST
    return with_flags(products).select(
        "barcode", total.alias("total_ingredients"), F.size("flags").alias("recognized"),
        *[tally(s).alias(n) for s, n in (("prohibited", "prohibited"), ("restricted", "restricted"), ("allergen", "allergens"))],
        full.alias("has_full_list"), F.when(full, "medium").otherwise("insufficient").alias("confidence"),
        F.when(full, 0.6).otherwise(0.1).alias("ratio"))


def with_kind(products: DataFrame) -> DataFrame:
    return products.withColumn("kind", F.when(F.col("source") == "openbeautyfacts", "cosmetic")
                               .when(F.coalesce("is_beverage", F.lit(False)), "beverage").otherwise("food"))


def route(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = with_kind(products)
    return rows.filter(F.col("kind") != "cosmetic"), rows.filter(F.col("kind") == "cosmetic")
