"""Relational normalisation of raw documents: one table per shape, and profiling.

All tables start from ``documents`` (VARIANT column ``raw``) and carry ``code``. Nested shapes are
opened in the document's row, so a table is one narrow pass without a shuffle; only OCR halves, NOVA markers and
distinct lists are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.numeric import epoch_millis, num_tolerant, truthy, truthy_null
from larder.sources.dump import variant

# Fields that exist in one variant per language.
TEXT_FIELDS = [
    "product_name", "generic_name", "ingredients_text", "abbreviated_product_name", "conservation_conditions",
    "preparation", "recycling_instructions", "warning", "customer_service", "origin", "packaging_text",
    "serving_size", "other_information", "ingredients_text_with_allergens", "obsolete_since_date",
    "producer_version_id", "nutrition_data_per", "link", "no_nutrition_data",
]
# Scalars with a column of their own in the product table.
PRODUCT_FIELDS = [
    "_id", "code", "id", "lang", "lc", "product_type", "brands", "quantity", "product_quantity", "serving_size",
    "serving_quantity", "nutrition_data_per", "nutrition_data_prepared_per", "no_nutrition_data", "nova_group",
    "nutriscore_grade", "nutriscore_score", "nutriscore_version", "nutrition_grade_fr", "pnns_groups_1",
    "pnns_groups_2", "ecoscore_grade", "ecoscore_score", "created_t", "last_modified_t", "last_updated_t", "rev",
    "creator", "last_editor", "unique_scans_n", "popularity_key", "completeness", "complete", "additives_n",
    "ingredients_n", "unknown_ingredients_n", "product_name", "generic_name", "ingredients_text",
    "image_front_url", "image_front_small_url",
]
# Sub-objects and arrays with tables of their own.
OWN_TABLES = [
    "images", "nutriments", "nutrition", "nutriscore", "nutriscore_data", "nutrient_levels", "nova_groups_markers",
    "languages", "languages_codes", "nutriments_estimated", "ingredients", "packagings", "sources",
]
# Derived or duplicated fields, left out unless everything is asked for.
DERIVED_SUFFIX = "(_hierarchy|_original_tags|_prev_tags|_old_tags|_debug_tags)$"
DERIVED_FIELDS = [
    "_keywords", "ecoscore_data", "ecoscore_extended_data", "ingredients_debug", "ingredients_ids_debug",
    "debug_param_sorted_langs", "nova_group_debug", "nutrition_score_debug", "ingredients_text_debug",
    "ingredients_percent_analysis", "ingredients_original_tags",
]
OCR_KEY = "^(.+?)_((?i:[a-z]{2,3}(?:_[a-z]{2,4})?))_ocr_([0-9]+)(_result)?$"
LANG_SUFFIX = "^(?i:[a-z]{2,3}(_[a-z]{2,4})?)$"
UNIFORM_MIN = 8
MAX_DEPTH = 4


def is_ocr_key(key: Column) -> Column:
    return key.rlike(OCR_KEY)


def ocr_key(key: Column) -> Column:
    part = lambda i: F.regexp_extract(key, OCR_KEY, i)
    return F.when(is_ocr_key(key), F.struct(part(1).alias("field"), F.lower(part(2)).alias("lang"),
                                            part(3).alias("run"), (part(4) != "").alias("is_result")))


def is_derived_key(key: Column, keep_all: bool = False) -> Column:
    return F.lit(False) if keep_all else key.isin(DERIVED_FIELDS) | key.rlike(DERIVED_SUFFIX)


def text_of(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def as_text(v: Column) -> Column:
    return text_of(F.try_variant_get(v, "$", "string"))


def with_code(docs: DataFrame) -> DataFrame:
    return docs.withColumn("code", text_of(variant("$.code"))).filter(F.col("code").isNotNull()).select("code", "raw")


def entries(docs: DataFrame, path: str = "$") -> DataFrame:
    """(code, key, value) of an object's fields."""
    pairs = F.map_entries(F.try_variant_get("raw", path, "map<string,variant>"))
    return docs.select("code", F.inline(pairs))


def inline_firsts(docs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Opens the structs of ``rows``; of several with the same keys in a document the first by ``order`` stays.

    The keys live inside one document, so the row is sorted and nothing is shuffled.
    """
    names = [f.name for f in docs.schema["rows"].dataType.elementType]
    first = [*keys, *order, *[n for n in names if n not in (*keys, *order)]]
    ranked = docs.withColumn("rows", F.array_sort(F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in first]))))
    same = lambda r, i: F.forall(F.array(*[r[k].eqNullSafe(F.get(F.col("rows"), i - 1)[k]) for k in keys]), lambda x: x)
    kept = F.filter("rows", lambda r, i: (i == 0) | ~same(r, i))
    return ranked.select(*[c for c in docs.columns if c != "rows"], F.inline(kept)).select(*[c for c in docs.columns if c != "rows"], *names)


def scalar_entries(docs: DataFrame) -> DataFrame:
    """Top-level scalars with text, OCR residue and derived fields left out."""
    rows = entries(docs).filter(~is_ocr_key(F.col("key")) & ~is_derived_key(F.col("key")))
    return rows.filter(~is_object(F.col("value")) & ~is_array(F.col("value"))).select("code", "key", as_text(F.col("value")).alias("text")).filter("text IS NOT NULL")


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def has_nested(v: Column, null_counts: bool = True) -> Column:
    """A list with anything but scalars in it."""
    nested = lambda x: is_object(x) | is_array(x) | ((F.schema_of_variant(x) == "VOID") if null_counts else F.lit(False))
    return F.exists(F.try_variant_get(v, "$", "array<variant>"), nested)


# ---------------------------------------------------------------- texts and product

def text_key(key: Column) -> Column:
    """Field and language of a text key; the first listed field that fits wins."""
    found = F.lit(None).cast("struct<field:string,lang:string>")
    for name in reversed(TEXT_FIELDS):
        suffix = F.substring(key, F.lit(len(name) + 2), F.length(key))
        found = F.when(key == name, F.struct(F.lit(name).alias("field"), F.lit("").alias("lang"))).when(
            key.startswith(name + "_") & suffix.rlike(LANG_SUFFIX), F.struct(F.lit(name).alias("field"), F.lower(suffix).alias("lang"))).when(
            key.startswith(name + "_"), F.lit(None)).otherwise(found)
    return found


def docs_text(docs: DataFrame) -> DataFrame:
    base = F.col("key").isin("product_name", "generic_name", "ingredients_text")
    rows = scalar_entries(docs).filter(base | ~F.col("key").isin(PRODUCT_FIELDS)).withColumn("k", text_key(F.col("key")))
    return rows.filter("k IS NOT NULL").select("code", F.col("k.field").alias("field"), F.col("k.lang").alias("lang"), F.col("text").alias("value"))


def best_text(texts: Column, field: str, lang: Column) -> Column:
    """Plain text, then the product's language, then the first language by name; with its language."""
    of_field = F.filter(texts, lambda t: t["field"] == field)
    pick = lambda test: F.try_element_at(F.filter(of_field, test), F.lit(1))
    first = F.try_element_at(F.array_sort(F.transform(of_field, lambda t: F.struct(t["lang"].alias("lang"), t["value"].alias("value")))), F.lit(1))
    exact = F.coalesce(pick(lambda t: t["lang"] == ""), pick(lambda t: t["lang"] == F.lower(lang)))
    return F.struct(F.coalesce(exact["value"], first["value"]).alias("value"),
                    F.coalesce(F.nullif(F.coalesce(exact["lang"], first["lang"]), F.lit("")), lang).alias("lang"))


def docs_product(docs: DataFrame) -> DataFrame:
    """Scalars of a product with their domains enforced; the best text variant resolved in the row."""
    keys = F.map_filter(F.try_variant_get("raw", "$", "map<string,variant>"),
                        lambda k, v: k.startswith("product_name") | k.startswith("generic_name") | k.startswith("ingredients_text"))
    options = F.transform(F.map_entries(keys), lambda e: F.struct(text_key(e["key"]).alias("k"), as_text(e["value"]).alias("value")))
    texts = F.transform(F.filter(options, lambda o: o["k"].isNotNull() & o["value"].isNotNull()),
                        lambda o: F.struct(o["k"]["field"].alias("field"), o["k"]["lang"].alias("lang"), o["value"].alias("value")))
    lang = text_of(variant("$.lang"))
    grade = variant("$.nutriscore_grade")
    nova = num_tolerant(variant("$.nova_group"))
    rows = docs.withColumn("texts", texts).withColumn("lang", lang)
    name, generic = best_text(F.col("texts"), "product_name", F.col("lang")), best_text(F.col("texts"), "generic_name", F.col("lang"))
    rows = rows.withColumn("n", name).withColumn("g", generic).withColumn("i", best_text(F.col("texts"), "ingredients_text", F.col("lang")))
    named = F.col("n.value").isNotNull()
    per = variant("$.nutrition_data_per")
    return rows.select(
        "code", "lang", F.coalesce("n.value", "g.value").alias("name"),
        F.when(named, F.col("n.lang")).when(F.col("g.value").isNotNull(), F.col("g.lang")).alias("name_lang"),
        F.col("i.value").alias("ingredients"), F.when(F.col("i.value").isNotNull(), F.col("i.lang")).alias("ingredients_lang"),
        text_of(variant("$.brands")).alias("brands"), text_of(variant("$.quantity")).alias("quantity"),
        num_tolerant(variant("$.product_quantity")).alias("quantity_g"), num_tolerant(variant("$.serving_quantity")).alias("serving_g"),
        F.when(per.isin("100g", "serving"), per).alias("nutrition_base"), truthy(variant("$.no_nutrition_data")).alias("no_table"),
        F.when(nova.isin(1, 2, 3, 4), nova.cast("int")).alias("nova_group"), F.when(grade.rlike("^[abcde]$"), grade).alias("nutriscore_grade"),
        epoch_millis(variant("$.created_t")).alias("created"), epoch_millis(variant("$.last_modified_t")).alias("modified"),
        num_tolerant(variant("$.popularity_key")).alias("popularity"))


def docs_ocr(docs: DataFrame) -> DataFrame:
    """Time out of the field name and into a column; text and result of one run become one row."""
    rows = entries(docs).withColumn("k", ocr_key(F.col("key"))).filter("k IS NOT NULL").select("code", "k.*", as_text(F.col("value")).alias("text"))
    # Both halves of a run are fields of the same document.
    return rows.groupBy("code", "field", "lang", "run").agg(
        F.max(F.when(~F.col("is_result"), F.col("text"))).alias("text"), F.max(F.when(F.col("is_result"), F.col("text"))).alias("result")
    ).withColumn("ran_at", epoch_millis(F.col("run"))).filter("ran_at IS NOT NULL").select("code", "field", "lang", "ran_at", "text", "result")


def docs_tags(docs: DataFrame) -> DataFrame:
    """Flat lists: (type, position, value)."""
    key = F.col("key")
    pairs = F.filter(F.map_entries(F.try_variant_get("raw", "$", "map<string,variant>")),
                     lambda e: is_array(e["value"]) & ~e["key"].isin(OWN_TABLES) & ~is_derived_key(e["key"]) & ~has_nested(e["value"], null_counts=False))
    listed = F.flatten(F.transform(pairs, lambda e: F.transform(
        F.try_variant_get(e["value"], "$", "array<string>"),
        lambda x, i: F.struct(F.regexp_replace(e["key"], "_tags$", "").alias("type"), i.alias("pos"), text_of(x).alias("tag")))))
    # ``x`` and ``x_tags`` are one type, so a position may occur twice.
    return inline_firsts(docs.select("code", F.filter(listed, lambda t: t["tag"].isNotNull()).alias("rows")), ["type", "pos"], ["tag"])


# ---------------------------------------------------------------- nutrients and scores

def docs_nutrients(docs: DataFrame) -> DataFrame:
    """Nutrient values of four places in long form; the first one of each natural key stays.

    All places are opened in the document's row: one scan, no shuffle.
    """
    none, no = F.lit(None).cast("string"), F.lit(False)
    row = lambda nid, value, unit, base, origin, source, prepared: F.struct(
        nid.alias("nid"), value.alias("value"), unit.alias("unit"), base.alias("base"), origin.alias("origin"), source.alias("source"), prepared.alias("prepared"))
    entries_of = lambda path, kind: F.coalesce(F.map_entries(F.try_variant_get("raw", path, kind)), F.map_entries(F.create_map().cast(kind)))
    v3 = F.transform(
        entries_of("$.nutrition.aggregated_set.nutrients", "map<string,struct<value:string,value_computed:string,unit:string,source:string>>"),
        lambda e: row(e["key"], num_tolerant(F.coalesce(e["value"]["value"], e["value"]["value_computed"])), text_of(e["value"]["unit"]),
                      F.lit("100g"), F.lit("aggregated_set"), text_of(e["value"]["source"]), no))

    def plain(e: Column) -> Column:
        clean = F.regexp_replace(e["key"], "_prepared", "")
        ends = lambda s: clean.endswith(s)
        nid = F.regexp_replace(clean, "_(100g|serving|value)$", "")
        base = F.when(ends("_100g"), "100g").when(ends("_serving"), "serving").when(ends("_value"), "declared").otherwise(F.col("per"))
        unit = F.when(~ends("_100g") & ~ends("_serving"), text_of(F.try_element_at("n", F.concat(nid, F.lit("_unit")))))
        return row(nid, num_tolerant(e["value"]), unit, base, F.when(ends("_100g"), "nutriments_100g").otherwise("nutriments_base"), none, e["key"].contains("_prepared"))

    stated = F.transform(F.filter(F.map_entries("n"), lambda e: ~e["key"].rlike("_(unit|label)$")), plain)
    estimate = F.transform(entries_of("$.nutriments_estimated", "map<string,string>"), lambda e: row(
        F.regexp_replace(e["key"], "_100g$", ""), num_tolerant(e["value"]), none, F.lit("100g"), F.lit("estimated"), F.lit("estimate"), no))
    comps = F.transform(F.filter(component_list("$.nutriscore_data"), lambda c: c["c"]["id"].isNotNull()), lambda c: row(
        F.regexp_replace(c["c"]["id"], "_", "-"), num_tolerant(c["c"]["value"]), text_of(c["c"]["unit"]), F.lit("100g"), F.lit("nutriscore_data"), none, no))
    kind = "array<struct<nid:string,value:double,unit:string,base:string,origin:string,source:string,prepared:boolean>>"
    opened = docs.select("code", "raw", F.coalesce(F.try_variant_get("raw", "$.nutriments", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("n"),
                         F.when(variant("$.nutrition_data_per") == "serving", "serving").otherwise("100g").alias("per"))
    rows = F.concat(*[x.cast(kind) for x in (v3, stated, estimate, comps)])
    rows = F.filter(rows, lambda r: r["value"].isNotNull() & (r["nid"] != ""))
    return inline_firsts(opened.select("code", rows.alias("rows")), ["nid", "base", "origin", "prepared"], ["unit", "value"]).select(
        "code", "nid", "value", "unit", "base", "origin", "source", "prepared")


_COMPONENT = "array<struct<id:string,value:string,unit:string,points:string,points_max:string>>"


def component_list(path: str) -> Column:
    """Components of both sides as (side, c)."""
    side = lambda s: F.transform(F.coalesce(F.try_variant_get("raw", f"{path}.components.{s}", _COMPONENT), F.array().cast(_COMPONENT)),
                                 lambda c: F.struct(F.lit(s).alias("side"), c.alias("c")))
    return F.concat(side("negative"), side("positive"))


def components(docs: DataFrame, path: str) -> DataFrame:
    rows = docs.select("code", F.inline(component_list(path))).filter("c.id IS NOT NULL")
    return rows.select("code", "side", "c.id", num_tolerant(F.col("c.value")).alias("value"), text_of(F.col("c.unit")).alias("unit"),
                       num_tolerant(F.col("c.points")).alias("points"), num_tolerant(F.col("c.points_max")).alias("points_max"))


def docs_levels(docs: DataFrame) -> DataFrame:
    rows = docs.select("code", F.explode(F.try_variant_get("raw", "$.nutrient_levels", "map<string,string>")).alias("nid", "level"))
    return rows.filter(F.col("level").isin("low", "moderate", "high"))


_VERSION = ("map<string,struct<score:string,grade:string,nutriscore_applicable:string,data:struct<is_beverage:string,is_water:string,is_cheese:string,"
            "is_fat_oil_nuts_seeds:string,is_red_meat_product:string,negative_points:string,positive_points:string,components:struct<negative:"
            + _COMPONENT + ",positive:" + _COMPONENT + ">>>>")


def docs_scores(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Published score versions, and their components."""
    rows = docs.select("code", F.explode(F.try_variant_get("raw", "$.nutriscore", _VERSION)).alias("version", "d")).filter("d IS NOT NULL")
    data = lambda n: F.col(f"d.data.{n}")
    versions = rows.select(
        "code", "version", num_tolerant(F.col("d.score")).alias("score"), text_of(F.col("d.grade")).alias("grade"),
        truthy_null(F.col("d.nutriscore_applicable")).alias("applicable"),
        *[truthy_null(data(n)).alias(n) for n in ("is_beverage", "is_water", "is_cheese", "is_fat_oil_nuts_seeds", "is_red_meat_product")],
        num_tolerant(data("negative_points")).alias("negative_points"), num_tolerant(data("positive_points")).alias("positive_points"))
    tagged = lambda s: F.transform(F.coalesce(data(f"components.{s}"), F.array().cast(_COMPONENT)), lambda c: F.struct(F.lit(s).alias("side"), c.alias("c")))
    parts = rows.select("code", "version", F.inline(F.concat(tagged("positive"), tagged("negative")))).filter("c.id IS NOT NULL").select(
        "code", "version", "side", "c.id", num_tolerant(F.col("c.value")).alias("value"), text_of(F.col("c.unit")).alias("unit"), num_tolerant(F.col("c.points")).alias("points"))
    return versions, parts


# ---------------------------------------------------------------- trees, images, packages

_INGREDIENTS = "array<struct<id:string,text:string,percent:string,percent_estimate:string,vegan:string,vegetarian:string,ingredients:variant>>"
_LEVEL = ("array<struct<path:string,parent:string,depth:int,pos:int,x:struct<id:string,text:string,percent:string,percent_estimate:string,"
          "vegan:string,vegetarian:string,ingredients:variant>>>")


def docs_ingredients(docs: DataFrame) -> DataFrame:
    """Ingredient tree of any depth as rows with their path, opened level by level inside the row: one scan.

    A tree can't be deeper than the number of lists its text names, which bounds the levels of that row.
    """
    node = lambda path, parent, depth, i, x: F.struct(path.alias("path"), parent.alias("parent"), depth.alias("depth"), i.alias("pos"), x.alias("x"))
    empty = F.array().cast(_INGREDIENTS)
    top = F.transform(F.coalesce(variant("$.ingredients", _INGREDIENTS), empty),
                      lambda x, i: node(i.cast("string"), F.lit(None).cast("string"), F.lit(0), i, x)).cast(_LEVEL)

    def below(n: Column) -> Column:
        return F.transform(F.coalesce(F.try_variant_get(n["x"]["ingredients"], "$", _INGREDIENTS), empty),
                           lambda x, i: node(F.concat_ws(".", n["path"], i.cast("string")), n["path"], n["depth"] + 1, i, x))

    state = f"struct<level:{_LEVEL},out:{_LEVEL}>"
    grown = lambda s, level: F.struct(level.alias("level"), F.concat(s["out"], level).alias("out")).cast(state)

    def step(s: Column, _: Column) -> Column:
        under = F.flatten(F.transform(s["level"], below)).cast(_LEVEL)
        # The lambda binds the next level, which is needed twice.
        return F.when(F.size(s["level"]) == 0, s).otherwise(F.get(F.transform(F.array(under), lambda level: grown(s, level)), 0))

    lists = F.size(F.split(F.coalesce(variant("$.ingredients"), F.lit("")), '"ingredients"'))
    rows = docs.select("code", top.alias("top"), lists.alias("lists"))
    whole = F.aggregate(F.sequence(F.lit(1), F.col("lists")), F.struct(F.col("top").alias("level"), F.col("top").alias("out")).cast(state), step, lambda s: s["out"])
    opened = rows.select("code", F.inline(whole)).filter("x IS NOT NULL")
    return opened.select(
        "code", "path", "parent", "depth", "pos", text_of(F.col("x.id")).alias("id"), text_of(F.col("x.text")).alias("text"),
        num_tolerant(F.col("x.percent")).alias("percent"), num_tolerant(F.col("x.percent_estimate")).alias("percent_estimate"),
        *[F.when(F.col(f"x.{n}").isin("yes", "no", "maybe"), F.col(f"x.{n}")).alias(n) for n in ("vegan", "vegetarian")])


def ingredient_tree(rows: DataFrame) -> DataFrame:
    """Rows of each product in label order: paths compare as numbers, not as text."""
    order = F.transform(F.split("path", r"\."), lambda p: p.cast("int"))
    return rows.withColumn("order", order).withColumn("label", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("text")))


def docs_nova(docs: DataFrame) -> DataFrame:
    rows = docs.select("code", F.explode(F.try_variant_get("raw", "$.nova_groups_markers", "map<string,array<array<string>>>")).alias("g", "list"))
    marks = rows.select("code", num_tolerant(F.col("g")).cast("int").alias("nova_group"), F.explode("list").alias("m")).filter("nova_group IS NOT NULL AND size(m) >= 2")
    return marks.select("code", "nova_group", F.col("m")[0].alias("kind"), F.col("m")[1].alias("value")).distinct()


_IMAGE = "struct<imgid:string,rev:string,uploaded_t:string,uploader:string,sizes:map<string,struct<w:string,h:string>>>"


_IMAGES = f"array<struct<class:string,type:string,lang:string,d:{_IMAGE}>>"


def _images(docs: DataFrame) -> DataFrame:
    image = lambda cls, kind, lang, d: F.struct(F.lit(cls).alias("class"), kind.alias("type"), lang.alias("lang"), d.alias("d"))
    none = F.array().cast(_IMAGES)
    chosen = F.flatten(F.transform(
        F.map_entries(F.try_variant_get("raw", "$.images.selected", f"map<string,map<string,{_IMAGE}>>")),
        lambda t: F.transform(F.map_entries(t["value"]), lambda e: image("selected", t["key"], e["key"], e["value"]))))
    sent = F.transform(F.map_entries(F.try_variant_get("raw", "$.images.uploaded", f"map<string,{_IMAGE}>")), lambda e: image("uploaded", e["key"], F.lit(""), e["value"]))
    return docs.select("code", F.inline(F.concat(F.coalesce(chosen.cast(_IMAGES), none), F.coalesce(sent.cast(_IMAGES), none)))).filter("d IS NOT NULL")


def docs_images(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _images(docs)
    selected = F.col("class") == "selected"
    images = rows.select("code", "class", "type", "lang", F.when(selected, text_of(F.col("d.imgid"))).otherwise(F.col("type")).alias("imgid"),
                         F.when(selected, text_of(F.col("d.rev"))).alias("rev"), F.when(~selected, epoch_millis(F.col("d.uploaded_t"))).alias("uploaded"),
                         F.when(~selected, text_of(F.col("d.uploader"))).alias("uploader"))
    sizes = rows.select("code", "class", "type", "lang", F.explode("d.sizes").alias("size", "s")).select(
        "code", "class", "type", "lang", "size", num_tolerant(F.col("s.w")).cast("int").alias("width"), num_tolerant(F.col("s.h")).cast("int").alias("height"))
    return images, sizes


def docs_packages(docs: DataFrame) -> DataFrame:
    kind = "array<struct<shape:string,material:string,recycling:string,food_contact:string,number_of_units:string,weight_measured:string>>"
    rows = docs.select("code", F.posexplode(F.try_variant_get("raw", "$.packagings", kind)).alias("pos", "p")).filter("p IS NOT NULL")
    return rows.select("code", "pos", text_of(F.col("p.shape")).alias("shape"), text_of(F.col("p.material")).alias("material"), text_of(F.col("p.recycling")).alias("recycling"),
                       truthy_null(F.col("p.food_contact")).alias("food_contact"), num_tolerant(F.col("p.number_of_units")).alias("units"), num_tolerant(F.col("p.weight_measured")).alias("weight"))


def docs_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = "array<struct<id:string,name:string,url:string,manufacturer:string,import_t:string,source_licence:string,fields:array<string>>>"
    rows = docs.select("code", F.posexplode(F.try_variant_get("raw", "$.sources", kind)).alias("pos", "s")).filter("s IS NOT NULL")
    sources = rows.select("code", "pos", text_of(F.col("s.id")).alias("id"), text_of(F.col("s.name")).alias("name"), text_of(F.col("s.url")).alias("url"),
                          truthy_null(F.col("s.manufacturer")).alias("manufacturer"), epoch_millis(F.col("s.import_t")).alias("imported"), text_of(F.col("s.source_licence")).alias("licence"))
    fields = rows.select("code", "pos", F.explode(F.array_distinct(F.col("s.fields"))).alias("field")).withColumn("field", text_of(F.col("field"))).filter("field IS NOT NULL")
    return sources, fields


def docs_languages(docs: DataFrame) -> DataFrame:
    kind = "array<struct<lang:string,is_code:boolean,fields:int>>"
    part = lambda path, is_code: F.coalesce(F.transform(
        F.map_entries(F.try_variant_get("raw", path, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("lang"), F.lit(is_code).alias("is_code"), num_tolerant(e["value"]).cast("int").alias("fields"))).cast(kind), F.array().cast(kind))
    return docs.select("code", F.inline(F.concat(part("$.languages", False), part("$.languages_codes", True)))).filter("fields IS NOT NULL")


# ---------------------------------------------------------------- generic properties

_NODE = "array<struct<scope:string,m:map<string,variant>,listed:boolean>>"


def collapse_uniform(values: Column) -> Column:
    """Modal value of a map of texts if more than half share it, else NULL. One sorted pass."""
    run = F.aggregate(
        F.array_sort(F.map_values(values)),
        F.struct(F.lit("").alias("v"), F.lit(0).alias("n"), F.lit("").alias("best"), F.lit(0).alias("top")),
        lambda a, v: F.struct(
            v.alias("v"), F.when(a["v"] == v, a["n"] + 1).otherwise(1).alias("n"),
            F.when(F.when(a["v"] == v, a["n"] + 1).otherwise(1) > a["top"], v).otherwise(a["best"]).alias("best"),
            F.greatest(a["top"], F.when(a["v"] == v, a["n"] + 1).otherwise(1)).alias("top")))
    return F.when(run["top"] > F.size(values) / 2, run["best"])


_ROWS = "array<struct<scope:string,key:string,value:string>>"
_MAP = "map<string,variant>"


def _row(scope: Column, key: Column, value: Column) -> Column:
    return F.struct(scope.alias("scope"), key.alias("key"), value.alias("value"))


def _below(scope: Column, key: Column) -> Column:
    return F.concat(scope, F.lit("."), key)


def _node(scope: Column, v: Column) -> Column:
    """An object, or a list read as an object whose keys are the positions."""
    whole = F.try_variant_get(v, "$", "array<variant>")
    by_place = F.map_from_entries(F.transform(whole, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))
    return F.struct(scope.alias("scope"), F.coalesce(F.try_variant_get(v, "$", _MAP), by_place).alias("m"), is_array(v).alias("listed"))


def _node_rows(n: Column) -> Column:
    """Rows of one object: its scalars and scalar lists, or a default and its exceptions."""
    entry_row = lambda e: _row(n["scope"], e["key"], e["value"])
    plain = F.map_entries(n["plain"])
    exceptions = F.transform(F.filter(plain, lambda e: e["value"] != n["modal"]), entry_row)
    uniform = F.concat(F.array(_row(n["scope"], F.lit("*"), n["modal"])), exceptions)
    lists = F.filter(F.map_entries(n["m"]), lambda e: is_array(e["value"]) & ~has_nested(e["value"]))
    joined = F.transform(lists, lambda e: _row(n["scope"], e["key"], F.array_join(F.try_variant_get(e["value"], "$", "array<string>"), ",")))
    mixed = F.filter(F.map_entries(n["m"]), lambda e: is_array(e["value"]) & has_nested(e["value"]))
    items = F.flatten(F.transform(mixed, lambda e: F.transform(
        F.try_variant_get(e["value"], "$", "array<variant>"),
        lambda x, i: F.when(~is_object(x) & ~is_array(x), _row(_below(n["scope"], e["key"]), i.cast("string"), F.try_variant_get(x, "$", "string"))))))
    some = lambda rows: F.filter(rows, lambda r: r.isNotNull() & (r["value"] != ""))
    own = some(F.transform(plain, entry_row))
    return F.when(n["modal"].isNotNull(), uniform).otherwise(F.concat(own, some(joined), some(items))).cast(_ROWS)


def _node_children(n: Column) -> Column:
    """Objects below one object, directly or as list items; a uniform map has none."""
    def open_entry(e: Column) -> Column:
        scope = _below(n["scope"], e["key"])
        items = F.transform(F.try_variant_get(e["value"], "$", "array<variant>"),
                            lambda x, i: _node(F.concat(scope, F.lit("["), i.cast("string"), F.lit("]")), x))
        return F.when(is_object(e["value"]), F.array(_node(scope, e["value"]))).when(
            is_array(e["value"]), F.filter(items, lambda c: c["m"].isNotNull())).otherwise(F.array().cast(_NODE))

    return F.when(n["modal"].isNotNull(), F.array().cast(_NODE)).otherwise(F.flatten(F.transform(F.map_entries(n["m"]), open_entry)))


def docs_properties(docs: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Everything without a table of its own as (scope, key, value, number).

    Objects open level by level inside the row, so the documents are read once. Lists of scalars
    become one text; a map of at least eight scalars most of which are equal becomes ``*`` and its
    exceptions. Levels below ``depth`` are left out, which is the operator's definition.
    """
    fields = F.map_filter(F.try_variant_get("raw", "$", _MAP), lambda k, v: ~is_ocr_key(k) & ~is_derived_key(k)
                          & ~k.isin(PRODUCT_FIELDS) & ~k.isin(OWN_TABLES))
    pairs = F.map_entries("fields")
    scalars = F.filter(pairs, lambda e: ~is_object(e["value"]) & ~is_array(e["value"]) & text_key(e["key"]).isNull())
    root = F.filter(F.transform(scalars, lambda e: _row(F.lit(""), e["key"], as_text(e["value"]))), lambda r: r["value"].isNotNull())
    objects = F.transform(F.filter(pairs, lambda e: is_object(e["value"])), lambda e: _node(e["key"], e["value"]))
    listed = F.flatten(F.transform(F.filter(pairs, lambda e: is_array(e["value"]) & has_nested(e["value"], null_counts=False)), lambda e: F.filter(
        F.transform(F.try_variant_get(e["value"], "$", "array<variant>"),
                    lambda x, i: _node(F.concat(e["key"], F.lit("["), i.cast("string"), F.lit("]")), x)),
        lambda c: c["m"].isNotNull())))

    def described(n: Column) -> Column:
        plain = F.transform_values(
            F.map_filter(n["m"], lambda k, v: ~is_object(v) & ~is_array(v) & (F.schema_of_variant(v) != "VOID")),
            lambda k, v: F.try_variant_get(v, "$", "string"))
        return F.struct(n["scope"].alias("scope"), n["m"].alias("m"), n["listed"].alias("listed"), plain.alias("plain"))

    def judged(n: Column) -> Column:
        uniform = ~n["listed"] & (F.size(n["plain"]) >= UNIFORM_MIN) & (F.size(n["plain"]) == F.size(n["m"]))
        return F.struct(n["scope"].alias("scope"), n["m"].alias("m"), n["plain"].alias("plain"), F.when(uniform, collapse_uniform(n["plain"])).alias("modal"))

    rows = docs.select("code", fields.alias("fields")).select("code", root.cast(_ROWS).alias("out"), F.concat(objects, listed).cast(_NODE).alias("level"))
    for _ in range(depth + 1):
        rows = rows.withColumn("level", F.transform("level", described)).withColumn("level", F.transform("level", judged))
        rows = rows.withColumn("out", F.concat("out", F.flatten(F.transform("level", _node_rows)))).withColumn(
            "level", F.flatten(F.transform("level", _node_children)).cast(_NODE))
    return rows.select("code", F.inline("out")).withColumn("number", num_tolerant(F.col("value")))


# ---------------------------------------------------------------- vocabulary, audit, census

def vocabulary(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct (class, value) with a stable id; a table that does not depend on load order."""
    pairs = F.array(*[F.struct(F.lit(cls).alias("class"), F.col(c).alias("value")) for c, cls in columns.items()])
    rows = df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
    return rows.withColumn("id", F.xxhash64("class", "value"))


def load_audit(tables: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def kind_of(v: Column) -> Column:
    """Kind of a value in one word; all whole numbers count as one kind."""
    s = F.schema_of_variant(v)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
            .when(s == "BIGINT", "int").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("double"))


def field_census(docs: DataFrame, path: str = "$") -> DataFrame:
    """How often each field occurs and as which kinds; OCR residue is left out.

    The kinds are counted per (field, kind) first, so the set per field has at most seven members.
    """
    rows = entries(docs, path).filter(~is_ocr_key(F.col("key"))).select("key", kind_of(F.col("value")).alias("kind"))
    counted = rows.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"),
                                      F.max_by("kind", F.struct("n", "kind")).alias("dominant"))


def map_inventory(docs: DataFrame, path: str, parts: list[str]) -> DataFrame:
    """Keys of a map sub-object with every value of the named parts and how often each occurs.

    Long form: a key may have any number of values, so they are rows and not a collected set.
    """
    shape = ",".join(f"{p}:string" for p in parts)
    rows = docs.select(F.inline(F.map_entries(F.try_variant_get("raw", path, f"map<string,struct<{shape}>>"))))
    long = rows.select("key", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"value.{p}").alias("item")) for p in parts])))
    return long.filter("item IS NOT NULL").groupBy("key", "part", "item").agg(F.count(F.lit(1)).alias("n"))


# Lower edge of each presence band in percent.
BANDS = [99.9, 99.0, 90.0, 50.0, 10.0, 1.0, 0.1, 0.01]


def presence_bands(census: DataFrame, documents: DataFrame) -> DataFrame:
    """Fields per band of presence. ``documents`` is the one-row total."""
    share = F.col("n") * 100.0 / F.col("documents")
    band = None
    for low in BANDS:
        band = (F if band is None else band).when(share >= low, f">={low}")
    return census.crossJoin(F.broadcast(documents)).groupBy(band.otherwise("<0.01").alias("band")).agg(F.count(F.lit(1)).alias("fields"))


def nonconforming(docs: DataFrame, census: DataFrame, documents: DataFrame, share: float = 0.999) -> DataFrame:
    """Documents that lack a field nearly all have, or hold one as another kind than usual.

    The nearly universal fields are few (tens) whatever the number of names, so they travel as one
    array; the test itself reads each document once.
    """
    common = census.crossJoin(F.broadcast(documents)).filter(F.col("n") >= F.col("documents") * share)
    wanted = common.agg(F.collect_list(F.struct("key", "dominant")).alias("wanted"))
    kinds = F.transform_values(F.try_variant_get("raw", "$", "map<string,variant>"), lambda k, v: kind_of(v))
    rows = docs.select("code", kinds.alias("kinds")).crossJoin(F.broadcast(wanted))
    missing = F.filter("wanted", lambda w: ~F.map_contains_key("kinds", w["key"]))
    other = F.filter("wanted", lambda w: F.try_element_at("kinds", w["key"]) != w["dominant"])
    return rows.select("code", F.size(missing).alias("missing"), F.size(other).alias("other_kind")).filter("missing > 0 OR other_kind > 0")
