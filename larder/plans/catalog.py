"""Catalogue build: raw documents to typed rows, countries, parts and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder import schema
from larder.functions import categories, codes, nutrients, text, units
from larder.functions.health import ABV_LIMIT
from larder.functions.numeric import num_signed
from larder.operators import prefix, ranges
from larder.operators.latest import latest_per_key
from larder.session import settle
from larder.sources.dump import typed_view


def mapped(docs: DataFrame) -> DataFrame:
    """Typed catalogue columns plus ``origins`` and ``sin_datos``; rows without code or name go."""
    view = typed_view(docs)
    view = view.withColumn("name", text.product_name(F.col("texts"), F.col("lang"))).filter(
        F.col("code").isNotNull() & (F.col("code") != "") & F.col("name").isNotNull())
    rows = nutrients.read_nutrients(view)
    flags = categories.category_flags(F.col("flags_2023"), F.col("flags_2021"), F.col("flags_legacy"), F.col("categories"))
    rows = rows.withColumn("flags", flags)
    return rows.select(
        *[c for c in docs.columns if c not in ("value", "raw")],
        F.col("code").alias("barcode"), "name", "brands", "quantity",
        codes.image_ref(F.col("revisions"), F.col("lang"), F.col("lc")).alias("image_ref"),
        text.ingredients_text(F.col("texts"), F.col("lang")).alias("ingredients_text"),
        "additives", "allergens", "labels",
        num_signed(F.col("nova_group")).cast("int").alias("nova_group"),
        F.coalesce("data_grade", "nutriscore_grade").alias("nutriscore_grade"),
        num_signed(F.col("data_score")).cast("int").alias("nutriscore_score"),
        *[c for c in schema.NUTRIENT_COLUMNS if c not in ("sodium", "fvl", "alcohol")],
        (F.col("sodium") * 1000).alias("sodium"), "fvl", "alcohol",
        units.volume_ml(num_signed(F.col("product_quantity")), F.col("product_quantity_unit")).alias("quantity_ml"),
        F.when(F.col("alcohol") > ABV_LIMIT, categories.drink_type(F.col("categories"))).alias("drink_type"),
        *[F.col(f"flags.{n}").alias(n) for n in schema.FLAG_COLUMNS],
        (num_signed(F.col("last_modified_t")) * 1000).cast("long").alias("last_modified"),
        F.coalesce(num_signed(F.col("popularity_key")), F.lit(0.0)).cast("long").alias("popularity"),
        "implausible", "estimated", "origins", F.col("flags.origin").alias("flag_source"),
        nutrients.declared_absent(F.col("no_nutrition_data")).alias("declared_absent"))


def catalog_rows(docs: DataFrame) -> DataFrame:
    return settle(mapped(docs).select(*schema.PRODUCT_COLUMNS), ["barcode"])


def implausible_text(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.to_json(c))


def estimated_text(c: Column) -> Column:
    """``key:mark`` pairs in the order of the nutrient table."""
    pairs = F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return F.when(F.size(c) > 0, F.array_join(pairs, ","))


def text_form(rows: DataFrame) -> DataFrame:
    """Catalogue rows with lists as text: the form the delta files carry."""
    joined = {c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in ("additives", "allergens", "labels")}
    return rows.withColumns(joined | {
        "implausible": implausible_text(F.col("implausible")), "estimated": estimated_text(F.col("estimated"))})


# ---------------------------------------------------------------- coverage

def coverage(rows: DataFrame) -> DataFrame:
    """How many values each rung resolved, and the totals, in one pass of partial aggregates."""
    has_energy = F.map_contains_key("origins", "energy_kj")
    impossible = F.size("implausible")
    totals = {
        "products": F.lit(1), "with-energy": has_energy.cast("int"), "without-energy": (~has_energy).cast("int"),
        "declared-absent": F.col("declared_absent").cast("int"), "impossible-values": impossible,
        "products-with-impossible": (impossible > 0).cast("int")}
    counted = F.map_from_arrays(F.array(*[F.lit(n) for n in totals]), F.array(*totals.values()))
    rungs = F.transform(F.map_values("origins"), lambda o: F.struct(F.concat(F.lit("origin:"), o).alias("measure"), F.lit(1).alias("n")))
    rest = F.transform(F.map_entries(counted), lambda e: F.struct(e["key"].alias("measure"), e["value"].alias("n")))
    return rows.select(F.inline(F.concat(rungs, rest))).groupBy("measure").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- countries, parts, index

def by_country(rows: DataFrame) -> DataFrame:
    """One row per product and country, the last write of each product kept."""
    spread = rows.withColumn("country", F.explode("countries")).drop("countries")
    stamp = F.xxhash64(*[F.to_json(F.struct(c)) if dict(spread.dtypes)[c].startswith(("array", "map")) else F.col(c)
                         for c in schema.PRODUCT_COLUMNS])
    return latest_per_key(spread.withColumn("_stamp", stamp), ["country", "barcode"], ["last_modified", "_stamp"]).drop("_stamp")


def row_weight(df: DataFrame) -> Column:
    """Estimated bytes of a stored row: text lengths plus a constant for the numbers."""
    def size(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        if c == "estimated":
            return F.coalesce(F.length(estimated_text(F.col(c))), F.lit(0))
        if c == "implausible":
            return F.coalesce(F.length(implausible_text(F.col(c))), F.lit(0))
        if kind.startswith("array"):
            return F.coalesce(F.length(F.array_join(c, ",")), F.lit(0))
        return F.coalesce(F.length(c), F.lit(0))

    return sum((size(c) for c in schema.WEIGHT_COLUMNS if c in df.columns), F.lit(schema.FIXED_BYTES))


def part_weights(rows: DataFrame, ranges_df: DataFrame, group: list[str], key: str, weight: str) -> DataFrame:
    placed = ranges.part_for(rows, ranges_df, group, key)
    return placed.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("products"), F.sum(weight).alias("weight"))


def new_ranges(rows: DataFrame, group: list[str], key: str, weight: str, cap: int) -> DataFrame:
    """Ranges of groups above ``cap``, cut in at least two; smaller groups stay whole."""
    totals = rows.groupBy(*group).agg(F.sum(weight).alias("_total"))
    big = totals.filter(F.col("_total") > cap).withColumn(
        "_parts", F.greatest(F.lit(2), F.ceil(F.col("_total") / F.lit(cap)).cast("int")))
    # One row per group: bounded by the number of catalogues.
    per_key = ranges.join_lines(rows.groupBy(*group, key).agg(F.sum(weight).alias(weight)), big, group, key, "inner")
    cuts = prefix.weight_cuts_by(per_key, group, key, weight, "_parts")
    whole = totals.filter(F.col("_total") <= cap).select(
        *group, F.lit(1).alias("part"), F.lit(None).cast("string").alias("from_key"), F.lit(None).cast("string").alias("to_key"))
    return prefix.part_ranges(cuts, group).unionByName(whole)


def reuse_ranges(rows: DataFrame, previous: DataFrame, group: list[str], key: str, weight: str, cap: int) -> DataFrame:
    """Previous ranges where no part has outgrown the cap, new ones elsewhere.

    Frozen cuts keep rows in their file, which is what lets a delta be a row diff.
    """
    grown = part_weights(rows, previous, group, key, weight).groupBy(*group).agg(F.max("weight").alias("_max"))
    stale = grown.filter(F.col("_max") > cap).select(*group)
    unknown = rows.select(*group).distinct().join(previous.select(*group).distinct(), group, "left_anti")
    redo = stale.unionByName(unknown)
    kept = previous.join(grown.select(*group), group, "left_semi").join(stale, group, "left_anti")
    return kept.withColumn("reused", F.lit(True)).unionByName(
        new_ranges(ranges.join_lines(rows, redo, group, key, "left_semi"), group, key, weight, cap).withColumn("reused", F.lit(False)))


def split_parts(rows: DataFrame, ranges_df: DataFrame, group: list[str] = ("country",), key: str = "barcode") -> DataFrame:
    return ranges.part_for(rows, ranges_df, list(group), key)


def catalog_index(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """One line per catalogue part: products, key range and size."""
    return rows.groupBy("country", "part").agg(
        F.count(F.lit(1)).alias("products"), F.min("barcode").alias("from_key"), F.max("barcode").alias("to_key"),
        F.sum(weight).alias("bytes"))


def index_json(parts: DataFrame, version: str) -> DataFrame:
    """The published index: one JSON text per country. Parts of a country are few by construction."""
    entry = F.struct("part", "from_key", "to_key", "products", "bytes")
    return parts.groupBy("country").agg(
        F.array_sort(F.collect_list(entry)).alias("parts"), F.sum("products").alias("products"), F.sum("bytes").alias("bytes")
    ).select("country", F.to_json(F.struct("products", "bytes", F.lit(version).alias("version"), "parts")).alias("entry"))


def catalog_sizes(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Products, bytes and bytes per product of each catalogue, and the total line."""
    return rows.rollup("country").agg(F.count(F.lit(1)).alias("products"), F.sum(weight).alias("bytes")).select(
        F.coalesce("country", F.lit("(all)")).alias("country"), "products", "bytes",
        F.round(F.col("bytes") / F.col("products"), 6).alias("bytes_per_product"))


def keep_popular(rows: DataFrame, n: int, group: list[str] = ("country",)) -> DataFrame:
    """Most scanned products of each catalogue; ties by code."""
    return prefix.top_n_per_group(rows, list(group), ["popularity", "barcode"], n, descending={"popularity"})


def write_catalog(rows: DataFrame, path: str, version: str) -> None:
    """A new version directory per build; sorted by key inside files so that lookups prune row groups."""
    (rows.repartitionByRange("country", "part", "barcode").sortWithinPartitions("country", "part", "barcode")
     .write.mode("overwrite").partitionBy("country", "part").parquet(f"{path}/version={version}"))


def version_of(meta: DataFrame) -> DataFrame:
    """Version per catalogue; older ones without it derive it from when they were built."""
    return meta.groupBy("country").agg(
        F.max(F.when(F.col("key") == "version", F.col("value"))).alias("v"),
        F.max(F.when(F.col("key") == "built_at", F.col("value"))).alias("b")
    ).select("country", F.coalesce("v", codes.version_id(F.try_to_timestamp("b"))).alias("version"))


# ---------------------------------------------------------------- domain products

def to_product(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """API-shaped nested record of a raw document. Drink kind and volume follow the catalogue's rule."""
    rows = mapped(docs)
    return nested_product(rows, F.col("flag_source"))


def row_to_product(rows: DataFrame) -> DataFrame:
    """Catalogue row to the same nested record; an unknown category has no source."""
    return nested_product(rows, F.when(F.col("is_beverage").isNotNull(), "snapshot"))


def nested_product(rows: DataFrame, flag_source: Column) -> DataFrame:
    no = F.lit(False)
    return rows.select(
        "barcode", "name", text.split_tags(F.col("brands")).alias("brands"),
        F.when(F.coalesce("is_beverage", no), "beverage").otherwise("food").alias("kind"),
        codes.image_url(F.col("barcode"), F.col("image_ref"), 400).alias("image_url"),
        codes.image_url(F.col("barcode"), F.col("image_ref"), 200).alias("thumb_url"),
        "ingredients_text", "additives", "allergens", "labels",
        F.struct(*schema.NUTRIENT_COLUMNS).alias("nutriments"),
        F.when(F.col("nova_group").between(1, 4), F.col("nova_group")).alias("nova_group"),
        F.when(F.col("nutriscore_grade").rlike("^[abcde]$"), F.col("nutriscore_grade")).alias("grade"),
        F.struct(*[F.coalesce(F.col(c), no).alias(c) for c in schema.FLAG_COLUMNS]).alias("category_flags"),
        flag_source.alias("flag_source"), "quantity_ml", "drink_type", "implausible", "estimated", "last_modified")


def with_published_components(docs: DataFrame) -> DataFrame:
    """Nutri-Score inputs of raw documents: published component values where there are any (they
    carry estimates nobody else can repeat), else computed from the ladder."""
    from larder.functions import nutriscore as ns

    view = typed_view(docs)
    view = view.withColumn("name", text.product_name(F.col("texts"), F.col("lang"))).filter(
        F.col("code").isNotNull() & F.col("name").isNotNull()).withColumn("published", F.col("components"))
    rows = nutrients.read_nutrients(view)
    flags = categories.category_flags(F.col("flags_2023"), F.col("flags_2021"), F.col("flags_legacy"), F.col("categories"))
    rows = rows.withColumn("flags", flags).select(
        F.col("code").alias("barcode"), "published", "additives", *schema.NUTRIENT_COLUMNS,
        *[F.col(f"flags.{n}").alias(n) for n in schema.FLAG_COLUMNS])
    has = F.size("published") > 0
    stated = lambda name: num_signed(F.try_element_at("published", F.lit(name))["value"])
    sweet = F.when(has, num_signed(F.try_element_at("published", F.lit("non_nutritive_sweeteners"))["points"]) > 0).otherwise(
        F.exists(F.coalesce("additives", F.array().cast("array<string>")), lambda t: F.lower(t).isin(ns.NON_NUTRITIVE_SWEETENERS)))
    computed = ns.with_inputs(rows, F.col("energy_kj"), F.col("salt"), {n: F.col(n) for n in ns.COMPUTED_FROM}, sweet)
    names = {"energy": "energy", "energy_from_saturated_fat": "energy_from_saturated_fat", "sugars": "sugars",
             "saturated_fat": "saturated_fat", "saturated_fat_ratio": "saturated_fat_ratio", "salt": "salt",
             "fvl": "fruits_vegetables_legumes", "fiber": "fiber", "proteins": "proteins"}
    return computed.withColumn("ns", F.struct(
        *[F.when(has, stated(theirs)).otherwise(F.col(f"ns.{ours}")).alias(ours) for ours, theirs in names.items()],
        F.col("ns.sweetened").alias("sweetened")))
