"""Product-shaped views over the driver's tables.

The view definitions are SQL text that Spark and DuckDB both run, so that an oracle starts from
the same input rows; every operator under test is then expressed twice, once per engine.
Integer arithmetic only, and every row comes from a table row, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

LABEL_TEXTS = [
    "Harina de trigo, azúcar, jarabe de glucosa, sal",
    "Wheat flour, Modified Starch, natural flavor, salt",
    "Farine de blé, arômes naturels, sel",
    "Weizenmehl, gehärtetes Pflanzenfett, Hefeextrakt",
    "Farinha de trigo, xarope de milho, sal",
    "Farina di frumento, zucchero, sale",
    "Agua, PROTEÍNA vegetal TEXTURIZADA, sal",
    "Milk, Sodium Caseinate, cultures",
    "Lait entier, ferments",
    "Maltodextrina, caseinato, dextrosa",
    "Kakaobutter, Sojalecithin, Vanille",
    "Óleo vegetal hidrogenado, açúcar invertido",
]

INCI_TEXTS = [
    "Ingredients: Aqua, Glycerin, Linalool, Limonene",
    "Aqua; Butylphenyl Methylpropional; Citral",
    "AQUA, TALC*, Parfum (Geraniol), Triclosan",
    "Aqua",
    "Aqua, Benzophenone-3, Homosalate, Eugenol, Coumarin",
    "Aqua, Formaldehyde, Propylparaben, Alpha-Isomethyl Ionone",
]


def _pick(expr: str, options: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(options))
    return f"CASE {expr} {arms} END"


def _flag(rule: str) -> str:
    return f"CASE WHEN k % 23 = 0 THEN NULL ELSE {rule} END"


_ADDITIVES = ", ".join(
    f"CASE WHEN k % 5 >= {j} THEN 'en:e' || CAST(100 + (k * {j}) % 40 AS STRING) END" for j in range(1, 5))

PRODUCTS_SQL = f"""
SELECT k, barcode, name, brand,
       energy_kj, CAST(NULL AS DOUBLE) AS energy_kcal,
       fat, saturated_fat, trans_fat, CAST(NULL AS DOUBLE) AS carbohydrates,
       sugars, fiber, proteins, salt, salt * 400 AS sodium, fvl, alcohol,
       {_flag("k % 5 = 0")} AS is_beverage, {_flag("k % 35 = 0")} AS is_water,
       {_flag("k % 7 = 1")} AS is_cheese, {_flag("k % 9 = 2")} AS is_fat_oil_nuts_seeds,
       {_flag("k % 10 = 3")} AS is_red_meat,
       CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(1 + k % 4 AS INT) END AS nova_group,
       CASE WHEN k % 29 = 7 THEN NULL ELSE concat_ws(',', {_ADDITIVES}) END AS additives_text,
       CASE WHEN k % 8 = 0 THEN NULL ELSE {_pick("k % 12", LABEL_TEXTS)} END AS ingredients_text,
       {_pick("k % 6", INCI_TEXTS)} AS inci_text,
       k * 101 % 10007 AS popularity, 1700000000 + k AS last_modified
FROM (
  SELECT p_partkey AS k, p_name AS name, p_brand AS brand,
    CASE WHEN length(CAST(p_partkey * 7919 + 8410000000000 AS STRING)) >= 13 THEN CAST(p_partkey * 7919 + 8410000000000 AS STRING) ELSE lpad(CAST(p_partkey * 7919 + 8410000000000 AS STRING), 13, '0') END AS barcode,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 3900 AS DOUBLE) END AS energy_kj,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey * 53 % 800 AS DOUBLE) / 10 END AS sugars,
    CAST(p_partkey * 29 % 900 AS DOUBLE) / 10 AS fat,
    CAST(p_partkey * 17 % 400 AS DOUBLE) / 10 AS saturated_fat,
    CAST(p_partkey * 7 % 500 AS DOUBLE) / 100 AS salt,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey * 3 % 120 AS DOUBLE) / 10 END AS fiber,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey * 5 % 300 AS DOUBLE) / 10 END AS proteins,
    CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST(p_partkey * 31 % 101 AS DOUBLE) END AS fvl,
    CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 30 AS DOUBLE) / 10 END AS trans_fat,
    CASE WHEN p_partkey % 19 = 0 THEN CAST(p_partkey % 150 AS DOUBLE) / 10 END AS alcohol
  FROM part) source
"""

CLASSES = [
    "en:colour", "en:preservative", "en:antioxidant", "en:emulsifier", "en:acid",
    "en:sweetener", "en:thickener", "en:acidity-regulator", "en:raising-agent", "en:glazing-agent",
]

# Additive dimension of 37 tags: e100 to e136 (e137-e139 stay unknown on purpose).
ADDITIVE_DIM_SQL = f"""
SELECT 'en:e' || CAST(n AS STRING) AS tag, CAST(n AS STRING) AS e, 'Additive ' || CAST(n AS STRING) AS name,
       {_pick("n % 10", CLASSES)} AS class_a,
       CASE WHEN n % 3 = 0 THEN {_pick("(n + 3) % 10", CLASSES)} END AS class_b,
       CASE n % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'no' END AS risk,
       CASE WHEN n % 5 = 0 THEN 'en:children' WHEN n % 7 = 0 THEN 'en:adults' ELSE 'en:elderly' END AS group_over,
       n % 6 = 0 AS watched, n % 9 = 0 AS sweetener, n % 13 = 0 AS banned, n % 11 = 0 AS no_margin,
       CASE WHEN n % 13 = 0 THEN CASE WHEN n % 2 = 0 THEN 'United States' ELSE 'European Union' END END AS jurisdiction,
       CASE WHEN n % 10 = 0 THEN NULL ELSE CAST(1 + n % 8 AS INT) END AS level,
       CASE n % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'possible' WHEN 3 THEN 'established' END
         AS certainty,
       CASE WHEN n % 4 = 3 THEN NULL ELSE CAST(n % 8 AS DOUBLE) / 8 END AS position,
       CASE WHEN n % 10 = 0 THEN 'not-needed' END AS no_dose
FROM numbers
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, task_rows: int) -> DataFrame:
    """Rows that are short as they lie and grow when they are worked on, dealt out by their number.

    Splits follow bytes, so a small file is one task however many rows it holds.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // task_rows + 1)  # from the files' footers
    return df.repartition(tasks)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue-shaped rows, one per part; ``additives`` is an array of tags."""
    from larder.functions.text import split_tags

    view = spark.sql(PRODUCTS_SQL.replace("FROM part)", "FROM {part})"), part=load(spark, sf_dir, "part"))
    return view.withColumn("additives", F.when(F.col("additives_text").isNotNull(), split_tags(F.col("additives_text")))).drop("additives_text")


def additive_dim(spark: SparkSession) -> DataFrame:
    """Literal dimension: 37 rows by construction, so a broadcast of it is always safe."""
    numbers = spark.range(100, 137).withColumnRenamed("id", "n").coalesce(1)
    raw = spark.sql(ADDITIVE_DIM_SQL.replace("FROM numbers", "FROM {numbers}"), numbers=numbers)
    return (raw.withColumn("classes", F.array_compact(F.array("class_a", "class_b")))
            .withColumn("mean_over", F.array("group_over"))
            .withColumn("jurisdictions", F.array_compact(F.array("jurisdiction")))
            .drop("class_a", "class_b", "group_over", "jurisdiction"))


def duck(sql: str, *views: str) -> str:
    """Oracle text: ``sql`` with the named shared views in front of it."""
    known = {
        "products": f"products AS ({PRODUCTS_SQL})",
        "dim": f"dim AS ({ADDITIVE_DIM_SQL.replace('FROM numbers', 'FROM (SELECT range AS n FROM range(100, 137)) numbers')})",
    }
    head = ",\n".join(known[v] for v in views)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[4:].lstrip()}"
    return f"WITH {head}\n{body}"
