"""Scans of raw product documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.functions import categories, nutrients
from larder.functions.codes import strip_prefix


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Line JSON as text. ``partitions`` spreads the rows of a single gzip file, which cannot be split."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def parse(lines: DataFrame) -> DataFrame:
    """Adds ``raw`` (VARIANT); blank lines are skipped, broken ones stay with a NULL document."""
    return lines.filter(F.trim("value") != "").withColumn("raw", F.try_parse_json("value"))


def documents(lines: DataFrame) -> DataFrame:
    return parse(lines).filter(F.col("raw").isNotNull())


def rejected(lines: DataFrame) -> DataFrame:
    """How many lines were read, used and dropped: dropped lines are counted, not silent."""
    return parse(lines).agg(
        F.count(F.lit(1)).alias("lines"), F.count("raw").alias("documents"),
        F.count_if(F.col("raw").isNull()).alias("rejected"))


def read_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Document collection; ``limit`` bounds how many documents a trial load takes."""
    docs = documents(spark.read.text(path))
    return docs.limit(limit) if limit else docs


def variant(path: str, kind: str = "string"):
    return F.try_variant_get("raw", path, kind)


def in_countries(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Adds ``countries`` and keeps documents sold in a wanted one; runs before anything else."""
    tags = F.transform(variant("$.countries_tags", "array<string>"), strip_prefix)
    # Repeats are kept out here, so that no product enters a country twice.
    return docs.withColumn("countries", F.array_intersect(tags, F.array(*[F.lit(c) for c in wanted]))).filter(
        F.size("countries") > 0)


_FLAG_STRUCT = "struct<" + ",".join(
    f"{n}:string" for n in (*categories.FLAG_NAMES, "is_red_meat_product")) + ">"
_TEXT_MAP = "map<string,string>"


def typed_view(docs: DataFrame) -> DataFrame:
    """The parts of the document that the catalogue reads, with text leaves.

    ``texts`` keeps only the multilingual fields, so that the rest of the document is not copied.
    """
    keys = F.map_filter(
        variant("$", "map<string,variant>"),
        lambda k, v: k.startswith("product_name") | k.startswith("generic_name") | k.startswith("ingredients_text"))
    texts = F.map_filter(F.transform_values(keys, lambda k, v: F.try_variant_get(v, "$", "string")),
                         lambda k, v: v.isNotNull())
    revisions = F.transform_values(variant("$.images.selected.front", "map<string,struct<rev:string>>"), lambda k, v: v["rev"])
    side = lambda name: variant(f"$.nutriscore_data.components.{name}", nutrients.COMPONENT_SCHEMA)
    return docs.select(
        *[c for c in docs.columns if c not in ("value", "raw")],
        variant("$.code").alias("code"), variant("$.lang").alias("lang"), variant("$.lc").alias("lc"), texts.alias("texts"),
        *[variant(f"$.{n}").alias(n) for n in (
            "brands", "quantity", "product_quantity", "product_quantity_unit", "nova_group", "nutriscore_grade",
            "no_nutrition_data", "last_modified_t", "popularity_key")],
        variant("$.nutriscore_data.grade").alias("data_grade"), variant("$.nutriscore_data.score").alias("data_score"),
        variant("$.nutrition_data_per").alias("per"), variant("$.serving_quantity").alias("serving"),
        *[variant(f"$.{n}_tags", "array<string>").alias(n) for n in ("additives", "allergens", "labels", "categories")],
        revisions.alias("revisions"), variant("$.nutriments", _TEXT_MAP).alias("nutriments"),
        variant("$.nutrition.aggregated_set.nutrients", nutrients.V3_SCHEMA).alias("v3"),
        nutrients.components_map(side("negative"), side("positive")).alias("components"),
        variant("$.nutriscore['2023'].data", _FLAG_STRUCT).alias("flags_2023"),
        variant("$.nutriscore['2021'].data", _FLAG_STRUCT).alias("flags_2021"),
        variant("$.nutriscore_data", _FLAG_STRUCT).alias("flags_legacy"))
