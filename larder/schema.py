"""Declared schemas and column lists; one list feeds builder, delta maker and applier."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TEXT_COLUMNS = [
    "barcode", "name", "brands", "quantity", "image_ref", "ingredients_text", "nutriscore_grade", "drink_type",
]
NUTRIENT_COLUMNS = [
    "energy_kj", "energy_kcal", "fat", "saturated_fat", "trans_fat", "carbohydrates", "sugars", "fiber",
    "proteins", "salt", "sodium", "fvl", "alcohol",
]
FLAG_COLUMNS = ["is_beverage", "is_water", "is_cheese", "is_fat_oil_nuts_seeds", "is_red_meat"]

PRODUCT_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in TEXT_COLUMNS[:6]],
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("additives", "allergens", "labels")],
    T.StructField("nova_group", T.IntegerType()), T.StructField("nutriscore_grade", T.StringType()),
    T.StructField("nutriscore_score", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in NUTRIENT_COLUMNS],
    T.StructField("quantity_ml", T.DoubleType()), T.StructField("drink_type", T.StringType()),
    *[T.StructField(c, T.BooleanType()) for c in FLAG_COLUMNS],
    T.StructField("last_modified", T.LongType()), T.StructField("popularity", T.LongType()),
    T.StructField("implausible", T.ArrayType(T.StructType([
        T.StructField("n", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("u", T.StringType()),
        T.StructField("m", T.StringType()), T.StructField("s", T.StringType())]))),
    T.StructField("estimated", T.MapType(T.StringType(), T.StringType())),
])
PRODUCT_COLUMNS = [f.name for f in PRODUCT_SCHEMA.fields]
#: Columns of the text index; only a change in these makes a row be indexed again.
INDEX_COLUMNS = ["name", "brands"]
#: Columns whose text length estimates the size of a stored row, and the rest of the row in bytes.
WEIGHT_COLUMNS = ["name", "brands", "quantity", "image_ref", "ingredients_text", "additives", "allergens",
                  "labels", "nutriscore_grade", "implausible", "estimated", "drink_type"]
FIXED_BYTES = 120


def columns_of(df: DataFrame) -> set[str]:
    return set(df.columns)


def stored_columns(spark: SparkSession, path: str, by: list[str] = ("country", "part")) -> DataFrame:
    """(by..., file, column): the columns that every file of a stored table has, from the files' footers alone.

    ``by`` are its folder columns, as text. A catalogue has few files a part, so their list fits the driver.
    """
    files = [unquote(file) for file in spark.read.parquet(path).inputFiles()]
    folder = lambda file: [unquote(re.search(rf"/{re.escape(c)}=([^/]*)/", file).group(1)) for c in by]
    # Footers of several files are read at the same time; a file is read alone, so its schema is its own.
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda file: (*folder(file), file, spark.read.parquet(file).columns), files))
    rows = spark.createDataFrame(found, T.StructType([*[T.StructField(c, T.StringType()) for c in (*by, "file")], T.StructField("columns", T.ArrayType(T.StringType()))]))
    return rows.select(*by, "file", F.explode_outer("columns").alias("column"))


def lacking_columns(stored: DataFrame, columns: list[str], by: list[str] = ("country", "part")) -> DataFrame:
    """(by..., lacking): stored parts of which some file lacks columns that the new generation has; any rules out a delta."""
    held = stored.groupBy(*by, "file").agg(F.collect_set("column").alias("_held"))
    gaps = held.select(*by, F.explode(F.array_except(F.array(*[F.lit(c) for c in columns]), "_held")).alias("column"))
    return gaps.groupBy(*by).agg(F.sort_array(F.collect_set("column")).alias("lacking"))


def shared_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Only what both sides know, in the order of ``columns``."""
    known = columns_of(df)
    return [c for c in columns if c in known]
