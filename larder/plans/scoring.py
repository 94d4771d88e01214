"""Scoring a whole catalogue: one projection, no shuffle, the additive dimension as a small map.

Columns needed: the catalogue row of ``larder.schema.PRODUCT_COLUMNS`` with ``additives`` as an
array of tags. Each step adds columns, so that generated methods stay below the JVM's size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder import schema
from larder.functions import additives as add, health, nova, nutriscore as ns, paho
from larder.functions.numeric import KJ_PER_KCAL, bounded, half_up
from larder.functions.nutrients import NUTRIENTS
from larder.session import settle

# ---------------------------------------------------------------- additives

def additive_steps(dim: DataFrame) -> DataFrame:
    """Penalty of each additive on its own: depends on the dimension only, so it is computed there."""
    why = add.reason(F.col("banned"), F.col("level"))
    base = add.base_points(F.col("banned"), F.col("level"), F.col("certainty"))
    extra = add.surcharges(F.col("risk"), F.col("watched"), F.col("mean_over"), F.col("no_margin"))
    return (dim.withColumn("penalty_reason", why)
            .withColumn("base_points", base)
            .withColumn("modulated_points", add.modulated(base, why, F.col("position")))
            .withColumn("surcharge_points", extra)
            .withColumn("penalty", add.rounded_points(F.col("modulated_points") + F.col("surcharge_points")))
            .withColumn("marker_class", nova.first_marker_class(F.col("classes"))))


def assess_additives(products: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per product and additive; a tag outside the dimension gets the no-data step."""
    tags = products.select("barcode", F.posexplode("additives").alias("pos", "tag"))
    known = additive_steps(dim).withColumnRenamed("tag", "key")
    joined = tags.join(F.broadcast(known), F.lower("tag") == F.col("key"), "left")
    return joined.select(
        "barcode", "pos", "tag",
        F.coalesce("name", F.upper(F.regexp_replace("tag", "^en:", ""))).alias("name"),
        F.coalesce(F.when(F.col("risk") == "no", "none").otherwise(F.col("risk")), F.lit("unknown")).alias("risk"),
        F.coalesce("banned", F.lit(False)).alias("banned"),
        F.coalesce("sweetener", F.lit(False)).alias("sweetener"),
        F.coalesce("penalty_reason", F.lit("no-data")).alias("penalty_reason"),
        F.coalesce("penalty", F.lit(add.NO_DATA_POINTS)).alias("penalty"),
        "level", "certainty", "jurisdictions", "no_dose", "marker_class")


def _entry() -> Column:
    return F.struct("penalty", (F.col("risk") == "high").alias("high"), "banned", "sweetener",
                    F.col("marker_class").isNotNull().alias("marker"))


def listed() -> Column:
    """The tags of a product; a missing list means no additives."""
    return F.coalesce(F.col("additives"), F.array().cast("array<string>"))


def with_additive_summary(products: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds ``points`` (penalty per tag), ``high_risk``, ``banned``, ``sweetened``, ``additive_marker``.

    The dimension has one row an E number, so it is bounded by the numbering scheme and travels as one
    map: rows are neither shuffled nor regrouped, and a barcode may occur more than once.
    """
    packed = additive_steps(dim).agg(F.map_from_entries(F.collect_list(F.struct(F.col("tag"), _entry().alias("v")))).alias("known"))
    rows = products.crossJoin(F.broadcast(packed)).withColumn("additives", listed())
    hits = F.transform("additives", lambda t: F.try_element_at(F.col("known"), F.lower(t)))
    rows = rows.withColumn("hits", hits).drop("known")
    tally = lambda name: F.size(F.filter("hits", lambda h: h[name]))
    return (rows.withColumn("points", F.transform("hits", lambda h: F.coalesce(h["penalty"], F.lit(add.NO_DATA_POINTS))))
            .withColumn("high_risk", tally("high")).withColumn("banned", tally("banned"))
            .withColumn("sweetened", tally("sweetener") > 0)
            .withColumn("additive_marker", tally("marker") > 0)
            .drop("hits"))


def with_additive_block(products: DataFrame, dim: DataFrame) -> DataFrame:
    total = add.diminishing_sum(F.col("points"))
    return (with_additive_summary(products, dim)
            .withColumn("additive_total", total)
            .withColumn("additive_score", add.block_score(F.col("additive_total"))))


# ---------------------------------------------------------------- nutrition

def with_points(products: DataFrame) -> DataFrame:
    """Adds ``is`` and ``ns`` (flags and inputs) and ``pts``, the points of each component.

    Impossible values are not used; energy and salt complete each other as in the ladder.
    """
    g = lambda name: bounded(F.col(name), "g")
    energy = F.coalesce(bounded(F.col("energy_kj"), "kJ"), bounded(bounded(F.col("energy_kcal"), "kcal") * KJ_PER_KCAL, "kJ"))
    salt = F.coalesce(g("salt"), bounded(bounded(F.col("sodium") / 1000, "g") * 2.5, "g"))
    values = {name: bounded(F.col(name), unit) for name, unit in ns.COMPUTED_FROM.items()}
    sweet = F.exists(listed(), lambda t: F.lower(t).isin(ns.NON_NUTRITIVE_SWEETENERS))
    return with_point_struct(ns.with_inputs(products, energy, salt, values, sweet))


def with_point_struct(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pts", F.struct(*[c.alias(n) for n, c in ns.component_points().items()]))


def with_score(rows: DataFrame) -> DataFrame:
    """From points to score, grade and 0-100 value."""
    negative = " + ".join(f"pts.{n}" for n in ns.NEGATIVE)
    return (rows.withColumn("negative_points", F.expr(negative))
            .withColumn("count_proteins", ns.proteins_count("negative_points"))
            .withColumn("positive_points", F.expr("IF(count_proteins, pts.proteins, 0) + pts.fiber + pts.fvl"))
            .withColumn("nutri_score", F.col("negative_points") - F.col("positive_points"))
            .withColumn("nutri_grade", ns.nutri_grade("nutri_score"))
            .withColumn("nutri_hundred", ns.nutri_hundred("nutri_score")))


def with_nutriscore(products: DataFrame) -> DataFrame:
    return with_score(with_points(products))


def nutriscore_columns(rows: DataFrame) -> DataFrame:
    return settle(rows.select(
        "barcode", ns.category().alias("category"), "negative_points", "positive_points",
        F.col("nutri_score").alias("score"), F.col("nutri_grade").alias("grade"),
        F.round("nutri_hundred", 6).alias("hundred"), "count_proteins",
        ns.proteins_reason("negative_points").alias("count_proteins_reason"),
        F.array_join(ns.missing_inputs(), ",").alias("missing_inputs")), ["barcode"])


def raw_documents(products: DataFrame) -> DataFrame:
    """(value): domain products as documents in the vocabulary of the source, so that one way of reading serves both.

    Nutrients carry the source's names per 100 g, sodium in grams again; what is unknown is left out, and category
    flags stand only where something said them.
    """
    amount = lambda name: F.col(f"nutriments.{name}") / 1000 if name == "sodium" else F.col(f"nutriments.{name}")
    values = F.struct(*[amount(name).alias(f"{NUTRIENTS[name].nid}_100g") for name in schema.NUTRIENT_COLUMNS])
    flags = F.when(F.col("flag_source").isNotNull(), F.struct(F.struct(F.struct(*[F.col(f"category_flags.{c}").alias(c) for c in schema.FLAG_COLUMNS]).alias("data")).alias("2023")))
    document = F.struct(F.col("barcode").alias("code"), F.col("name").alias("product_name"), F.col("additives").alias("additives_tags"),
                        F.lit("100g").alias("nutrition_data_per"), values.alias("nutriments"), flags.alias("nutriscore"))
    return products.select(F.to_json(document).alias("value"))


def domain_nutriscore(products: DataFrame) -> DataFrame:
    """(barcode, score, grade, negative_points) of domain products, read through the ladder like raw documents."""
    from larder.plans.catalog import with_published_components
    from larder.sources.dump import documents

    # Text between the two readings: neither is written into the other.
    lines = settle(raw_documents(settle(products, ["barcode"])), [])
    rows = with_score(with_point_struct(with_published_components(documents(lines))))
    return rows.select("barcode", F.col("nutri_score").alias("score"), F.col("nutri_grade").alias("grade"), "negative_points")


def nutriscore(products: DataFrame) -> DataFrame:
    return nutriscore_columns(with_nutriscore(products))


def nutriscore_components(products: DataFrame) -> DataFrame:
    """Points per component in long form."""
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.col("pts")[n].alias("points"))
                     for n in [*ns.NEGATIVE, "fvl", "fiber", "proteins"]])
    return with_points(products).select("barcode", F.inline(rows))


# ---------------------------------------------------------------- seals and whole score

def _kcal() -> Column:
    return paho.kcal_of(F.col("energy_kj"), F.col("energy_kcal"))


def with_nova(products: DataFrame) -> DataFrame:
    """``nova`` is the declared group or the inferred one; needs ``additive_marker``."""
    marker = F.col("additive_marker") | nova.has_text_marker(F.col("ingredients_text"))
    declared = F.when(F.col("nova_group").between(1, 4), F.col("nova_group"))
    return (products.withColumn("declared_nova", declared)
            .withColumn("nova", F.when(F.col("declared_nova").isNull(), nova.infer_group(F.lit(None).cast("int"), marker))
                        .otherwise(F.col("declared_nova"))))


def seal_rows(products: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per product and seal, with the share that was measured."""
    rows = with_nova(with_additive_summary(products, dim))
    free = paho.free_sugars(F.col("sugars"), F.col("fvl"))
    sealed = paho.seals(_kcal(), F.col("sodium"), free, F.col("fat"), F.col("saturated_fat"), F.col("trans_fat"),
                        F.col("sweetened"), F.col("sugars").isNotNull())
    return rows.select("barcode", paho.applicable(F.col("nova")).alias("applicable"), F.inline(sealed))


def with_seal_count(products: DataFrame) -> DataFrame:
    usable = F.when(_kcal() > 0, _kcal())
    rows = products.withColumn("kcal", usable)
    free = paho.free_sugars(F.col("sugars"), F.col("fvl"))
    rows = rows.withColumn("sugar_seal", F.coalesce(paho.energy_seal("free-sugars", free, F.col("kcal")), F.lit(False)))
    count = F.col("sugar_seal").cast("int") + paho.other_seals(
        F.col("kcal"), F.col("sodium"), F.col("fat"), F.col("saturated_fat"), F.col("trans_fat"), F.col("sweetened"))
    return rows.withColumn("raw_seals", count).withColumn(
        "seals", F.when(paho.applicable(F.col("nova")), F.col("raw_seals")).otherwise(0))


def _bound(side: str) -> Column:
    """Score with unknown fruit, fiber and NOVA at one end of their range.

    Only three parts move: positive points, NOVA value and whether seals apply. The rest of the
    columns is shared with the plain score, so the three scores cost little more than one.
    """
    best = side == "best"
    value = 100.0 if best else 0.0
    fvl = (f"IF(ns.fvl IS NULL, IF(is.beverage, {ns.points_of(value, 'fvl', True)}, {ns.points_of(value, 'fvl', False)}), pts.fvl)")
    fiber = f"IF(ns.fiber IS NULL, {ns.points_of(value, 'fiber', False)}, pts.fiber)"
    score = f"(negative_points - (IF(count_proteins, pts.proteins, 0) + {fiber} + {fvl}))"
    group = F.coalesce("declared_nova", F.lit(1 if best else 4))
    # Fruit at 100 % means no free sugars, so an estimated sugar seal falls away at the best end.
    seals = F.col("raw_seals") - F.when(F.col("fvl").isNull() & F.col("sugar_seal"), 1).otherwise(0) if best else F.col("raw_seals")
    penalty = health.seal_penalty(F.when(paho.applicable(group), seals).otherwise(0), F.col("alcoholic"))
    return health.health_score(ns.nutri_hundred(score), nova.nova_hundred(group),
                               F.col("additive_score"), penalty, F.col("alcoholic"))


def with_health(products: DataFrame, dim: DataFrame) -> DataFrame:
    rows = with_seal_count(with_nova(with_nutriscore(with_additive_block(products, dim))))
    rows = (rows.withColumn("alcoholic", health.is_alcoholic(F.col("alcohol")))
            .withColumn("processing_hundred", nova.nova_hundred(F.col("nova")))
            .withColumn("seal_penalty", health.seal_penalty(F.col("seals"), F.col("alcoholic"))))
    rows = rows.withColumn("health", health.health_score(
        F.col("nutri_hundred"), F.col("processing_hundred"), F.col("additive_score"), F.col("seal_penalty"), F.col("alcoholic")))
    return rows.withColumn("worst", _bound("worst")).withColumn("best", _bound("best"))


def health_scores(products: DataFrame, dim: DataFrame) -> DataFrame:
    differs = F.col("worst") != F.col("best")
    return settle(with_health(products, dim).select(
        "barcode", F.col("health").cast("int").alias("score"), health.band(F.col("health")).alias("band"),
        F.when(~F.col("alcoholic"), F.col("nutri_grade")).alias("grade"), F.col("nova").cast("int").alias("nova"),
        F.when(~F.col("alcoholic"), F.col("seals")).cast("int").alias("seals"), F.round("additive_score", 6).alias("additive_score"),
        "high_risk", "banned", "alcoholic", F.when(F.col("alcoholic"), F.col("alcohol")).alias("abv"),
        F.when(differs, F.least("worst", "health")).cast("int").alias("range_min"),
        F.when(differs, F.greatest("best", "health")).cast("int").alias("range_max")), ["barcode"])


def score_breakdown(products: DataFrame, dim: DataFrame) -> DataFrame:
    """Contribution of each block that applies, one row each."""
    w = health.WEIGHTS
    part = lambda name, value, applies: F.when(applies, F.struct(
        F.lit(name).alias("block"), F.round(value * w[name], 6).alias("contribution"), F.lit(w[name]).alias("weight")))
    food, always = ~F.col("alcoholic"), F.lit(True)
    blocks = F.array_compact(F.array(
        part("nutrition", F.col("nutri_hundred"), food),
        part("processing", F.col("processing_hundred"), always),
        part("additives", F.col("additive_score"), always),
        part("regulatory", health.regulatory_hundred(F.col("seal_penalty")), food)))
    return with_health(products, dim).select("barcode", F.inline(blocks))


def confidence(products: DataFrame, dim: DataFrame) -> DataFrame:
    """How much the score rests on: weighted presence, missing items and notes."""
    rows = with_nova(with_additive_summary(products, dim)).withColumn("alcoholic", health.is_alcoholic(F.col("alcohol")))
    has = lambda name: F.col(name).isNotNull()
    present = {
        "energy": has("energy_kj") | has("energy_kcal"), "sugars": has("sugars"),
        "saturated_fat": has("saturated_fat"), "salt": has("salt") | has("sodium"),
        "proteins": has("proteins"), "fiber": has("fiber"), "fat": has("fat"),
        "ingredients": F.coalesce(F.col("ingredients_text") != "", F.lit(False)), "nova": has("nova"),
    }
    extra = [F.when(has("fvl"), None).otherwise("fvl-unknown"), F.when(has("fiber"), None).otherwise("fiber-unknown"),
             F.when(has("nova"), None).otherwise("nova-unknown")]
    if "estimated" in products.columns:
        kinds = F.map_values("estimated")
        extra += [F.when(F.array_contains(kinds, "estimate"), "estimated-values"),
                  F.when(F.array_contains(kinds, "computed"), "computed-values")]
    extra.append(F.when(F.col("is_beverage").isNull(), "category-unknown"))
    notes = F.array_compact(F.array(*extra))
    if "implausible" in products.columns:
        unreplaced = F.filter("implausible", lambda x: x["s"].isNull())
        notes = F.concat(notes, F.transform(unreplaced, lambda x: F.concat(F.lit("impossible-"), x["n"])))
    rows = rows.withColumn("ratio", health.presence_ratio(present)).withColumn("notes", notes)
    drink = F.col("alcoholic")
    return rows.select(
        "barcode",
        F.when(drink, "medium").otherwise(health.confidence_level(F.col("ratio"), F.col("notes"))).alias("level"),
        F.when(drink, 1.0).otherwise(half_up(F.col("ratio"), 2)).alias("ratio"),
        F.when(drink, "").otherwise(F.array_join(health.missing_labels(present), ",")).alias("missing"),
        F.when(drink, "alcohol-is-carcinogenic").otherwise(F.array_join("notes", ",")).alias("notes"))
