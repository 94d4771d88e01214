"""Evidence on additives: links between sources, families, severity and the published tables.

Sources stay separate frames keyed by item, substance or tag; a rebuild is a pure function of them,
so running it again gives the same tables. Fixed vocabularies are literals.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.codes import e_from_tag, e_mentions, e_number, tag_parts, year_parts
from larder.functions.text import names_alike
from larder.operators.latest import best_per_key, first_per_key
from larder.operators.prefix import position_in_group
from larder.session import stored_bytes

# Weight of a link by how it was found.
LINK_WEIGHT = {"cas": 2, "e-in-name": 1, "manual-group": 1, "family": 0}
# Level of harm by critical effect, certainty by source category, and its strength.
EFFECT_LEVEL = {
    "teratogenic": 2, "reproductive": 2, "developmental": 2, "endocrine": 3, "neurotoxicity": 4,
    "hepatotoxicity": 5, "nephrotoxicity": 5, "pulmonary and cardiac": 5,
    "immunotoxicity": 6, "hemopoietic": 6, "musclo-skeletal": 6, "systemic": 7, "irritation": 8,
}
NO_EFFECT = "not reported"
IARC_CERTAINTY = {"1": "confirmed", "2A": "probable", "2B": "possible"}
CLP_CERTAINTY = {"1A": "confirmed", "1B": "probable", "2": "possible"}
STRENGTH = {"confirmed": 3, "probable": 2, "possible": 1, "established": 0}
LEVELS = [
    (1, "genotoxic or carcinogenic"), (2, "development or reproduction"), (3, "endocrine"), (4, "neurotoxic"),
    (5, "target organ"), (6, "immune system or blood"), (7, "systemic, reversible"), (8, "local or digestive"),
]
CERTAINTIES = [("confirmed", "suspicion-of-cancer", 3), ("probable", "suspicion-of-cancer", 2),
               ("possible", "suspicion-of-cancer", 1), ("established", "measured-effect", 0)]
# Groups that count as vulnerable in the evidence.
VULNERABLE = ["en:infants", "en:toddlers", "en:children", "en:pregnant-women"]


def _map(table: dict, c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


# ---------------------------------------------------------------- links

def link_tags(items: DataFrame, tags: DataFrame) -> DataFrame:
    """(item, tag, via): by the item a tag names, then by E number where not yet linked."""
    by_item = items.select("item").join(tags.select(F.col("item_ref").alias("item"), "tag"), "item").withColumn("via", F.lit("item"))
    numbers = items.select("item", F.explode("e_numbers").alias("e"))
    by_number = numbers.join(tags.select(e_number(F.col("e_raw")).alias("e"), "tag"), "e").select("item", "tag", F.lit("e-number").alias("via"))
    rank = F.when(F.col("via") == "item", 0).otherwise(1)
    return first_per_key(by_item.unionByName(by_number).withColumn("_rank", rank), ["item", "tag"], ["_rank"]).drop("_rank")


def link_substances(items: DataFrame, links: DataFrame, subs: DataFrame, groups: DataFrame) -> DataFrame:
    """(item, uuid, via): by CAS, then by the E numbers a substance's name covers, then by curated
    groups of tags. Each pair once, by its best way."""
    by_cas = items.select("item", F.explode("cas").alias("cas")).join(subs.filter("cas IS NOT NULL").select("cas", "uuid"), "cas").select("item", "uuid", F.lit("cas").alias("via"))
    roots = items.select("item", F.explode(F.array_distinct(F.transform("e_numbers", lambda e: F.regexp_extract(e, r"^(\d{3,4})", 1)))).alias("e"))
    covers = subs.select("uuid", F.explode(e_mentions(F.col("name"))).alias("e"))
    by_name = roots.join(covers, "e").select("item", "uuid", F.lit("e-in-name").alias("via"))
    grouped = groups.join(subs.select(F.trim("name").alias("name"), "uuid"), "name").select("tag", "uuid")
    by_hand = links.join(grouped, "tag").select("item", "uuid", F.lit("manual-group").alias("via"))
    order = F.array_position(F.array(F.lit("cas"), F.lit("e-in-name"), F.lit("manual-group")), F.col("via"))
    rows = by_cas.unionByName(by_name).unionByName(by_hand).withColumn("_rank", order)
    return first_per_key(rows, ["item", "uuid"], ["_rank"]).drop("_rank")


def review_flags(items: DataFrame, links: DataFrame, tags: DataFrame, substances: DataFrame, subs: DataFrame) -> DataFrame:
    """What to look at by hand: numbers that differ, several substances, no CAS, names unlike."""
    named = links.join(tags.select("tag", e_number(F.col("e_raw")).alias("tag_e"), "name_en"), "tag")
    lead = first_per_key(named.withColumn("_rank", F.when(F.col("via") == "item", 0).otherwise(1)), ["item"], ["_rank", "tag"]).select("item", F.col("name_en").alias("tag_name"))
    known = items.select("item", "e_numbers")
    differs = named.filter("via = 'item' AND tag_e IS NOT NULL").join(known, "item").groupBy("item").agg(
        F.bool_or((F.size("e_numbers") > 0) & ~F.array_contains("e_numbers", F.col("tag_e"))).alias("differs"))
    names = substances.join(subs.select("uuid", "name"), "uuid").join(lead, "item", "left")
    per_item = names.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("tag_name").isNull() | names_alike(F.col("tag_name"), F.col("name"))).alias("alike"))
    rows = items.join(differs, "item", "left").join(per_item, "item", "left")
    flags = F.array_compact(F.array(
        F.when(F.size("cas") == 0, "no-cas"), F.when(~F.coalesce("alike", F.lit(True)), "names-differ"),
        F.when(F.coalesce("differs", F.lit(False)), "number-differs"), F.when(F.coalesce("n", F.lit(0)) > 1, "several-substances")))
    return rows.select("item", F.array_join(flags, ",").alias("review")).filter("review <> ''")


def best_links(substances: DataFrame, oft: DataFrame) -> DataFrame:
    """Per item, each kind of data from the link that serves it best, chosen independently.

    Value: most specific link, then lowest intake; a stated absence only where no link has a number.
    Critical study: labelled before unlabelled. Finding: studied before not. One aggregation.
    """
    rows = substances.join(oft, "uuid").withColumn("w", _map({k: str(v) for k, v in LINK_WEIGHT.items()}, F.col("via")).cast("int"))
    best = lambda value, test, *order: F.min_by(value, F.when(test, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])))
    lighter, tie = -F.col("w"), F.col("uuid")
    value = F.struct("adi", "no_adi_reason", "uncertainty", F.col("uuid").alias("of"), "via", "name")
    has_value = F.col("adi").isNotNull() | F.col("no_adi_reason").isNotNull()
    out = rows.groupBy("item").agg(
        best(value, has_value, F.col("adi").isNull(), lighter, F.col("adi"), tie).alias("v"),
        best(F.struct("toxicity", "via", "uuid"), F.col("has_study"), F.col("toxicity").isNull(), lighter, tie).alias("c"),
        best(F.struct("finding", "via"), F.col("finding").isNotNull(), F.col("finding") == "no-data", lighter, tie).alias("g"),
        best(F.col("no_dose_reason"), F.col("no_dose_reason").isNotNull(), lighter, tie).alias("no_dose_reason"))
    return out.select("item", "v.adi", "v.no_adi_reason", "v.uncertainty", F.col("v.of").alias("value_of"), F.col("v.via").alias("value_via"),
                      F.col("c.toxicity").alias("toxicity"), F.col("c.uuid").alias("study_of"), F.col("c.via").alias("study_via"),
                      F.col("g.finding").alias("finding"), F.col("g.via").alias("finding_via"), "no_dose_reason")


def identity_bridge(tags: DataFrame, items: DataFrame) -> DataFrame:
    """Per E number: the item its tag names if that has a CAS, else the first item by number, exact
    or root; and whether both ways disagree."""
    numbered = tags.withColumn("e", e_number(F.col("e_raw"))).filter("e IS NOT NULL")
    per_e = numbered.groupBy("e").agg(F.min_by("item_ref", F.when(F.col("item_ref").isNotNull(), F.col("tag"))).alias("own"), F.count(F.lit(1)).alias("tags"))
    by_number = items.select("item", "pos", F.explode("e_numbers").alias("e")).groupBy("e").agg(F.min_by("item", "pos").alias("found"))
    root = F.regexp_extract("e", r"^(\d+)", 1)
    exact = by_number.select("e", F.col("found").alias("exact"))
    near = by_number.select(F.col("e").alias("root"), F.col("found").alias("near"))
    chem = items.select(F.col("item").alias("own"), (F.size("cas") > 0).alias("own_cas"))
    rows = per_e.withColumn("root", root).join(exact, "e", "left").join(near, "root", "left").join(chem, "own", "left")
    number = F.coalesce("exact", "near")
    has = F.coalesce("own_cas", F.lit(False))
    return rows.select("e", "tags", F.when(has, F.col("own")).otherwise(number).alias("item"), F.when(has, "tag").when(number.isNotNull(), "e-number").alias("via"),
                       F.coalesce(F.col("own") != number, F.lit(False)).alias("differs"))


# ---------------------------------------------------------------- families

def families(tags: DataFrame) -> DataFrame:
    """(number, family, member): tags with a roman suffix are members of the number's plain tag."""
    parts = tags.select("tag", tag_parts(F.col("tag")).alias("p")).filter("p.number IS NOT NULL")
    heads = parts.filter("p.roman = ''").groupBy(F.col("p.number").alias("number")).agg(F.min("tag").alias("family"))
    members = parts.filter("p.roman <> ''").select(F.col("p.number").alias("number"), F.col("tag").alias("member"))
    return members.join(heads, "number", "left")


def tag_values(links: DataFrame, best: DataFrame) -> DataFrame:
    """Data of each tag: from the item it names before one that shares its number."""
    rank = F.when(F.col("via") == "item", 0).otherwise(1)
    lead = first_per_key(links.withColumn("_rank", rank), ["tag"], ["_rank", "item"]).select("tag", "item")
    return lead.join(best.select("item", "adi", "toxicity"), "item", "left").withColumn("has_data", F.col("adi").isNotNull() | F.col("toxicity").isNotNull())


def family_stats(fams: DataFrame, values: DataFrame) -> DataFrame:
    """Members with data, their distinct intakes and effects, and whether they disagree. Distinct
    values are counted, not collected."""
    rows = fams.join(values.select(F.col("tag").alias("member"), "adi", "toxicity", "has_data"), "member", "left")
    stats = rows.groupBy("number", "family").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.coalesce("has_data", F.lit(False))).alias("with_data"),
        F.count_distinct("adi").alias("intakes"), F.count_distinct("toxicity").alias("effects"))
    own = values.select(F.col("tag").alias("family"), F.col("has_data").alias("own_data"))
    return stats.join(own, "family", "left").withColumn("own_data", F.coalesce("own_data", F.lit(False))).withColumn(
        "disagree", ~F.col("own_data") & ((F.col("intakes") > 1) | (F.col("effects") > 1)))


def inherit_family(fams: DataFrame, values: DataFrame) -> DataFrame:
    """A family without a value of its own takes the first member's, marked as inherited."""
    own = values.filter("has_data").select(F.col("tag").alias("family"))
    bare = fams.filter("family IS NOT NULL").join(own, "family", "left_anti")
    given = bare.join(values.filter("adi IS NOT NULL").select(F.col("tag").alias("member"), "adi"), "member")
    return first_per_key(given.select("family", "member", "adi"), ["family"], ["member"]).withColumnRenamed("member", "inherited_from")


# ---------------------------------------------------------------- attaching sources

def lead_tag(links: DataFrame) -> DataFrame:
    rank = F.when(F.col("via") == "item", 0).otherwise(1)
    return first_per_key(links.withColumn("_rank", rank), ["item"], ["_rank", "tag"]).select("item", "tag")


def attach_legal(links: DataFrame, law: DataFrame) -> DataFrame:
    """Legal state by the number of the lead tag. Not being listed is its own state, not a withdrawal."""
    numbered = lead_tag(links).withColumn("e", e_from_tag(F.col("tag"))).filter("e IS NOT NULL")
    rows = numbered.join(law.withColumn("known", F.lit(True)), "e", "left")
    no = F.lit(False)
    return rows.select("item", "e", F.coalesce("authorised", no).alias("authorised"), F.coalesce("withdrawn", no).alias("withdrawn"),
                       F.coalesce("listed", no).alias("listed"), F.col("known").isNull().alias("absent"))


def attach_classifications(items: DataFrame, links: DataFrame, iarc: DataFrame, clp: DataFrame, manual: DataFrame) -> DataFrame:
    """IARC and CLP by any CAS of the item; a manual IARC entry only where no CAS matched.

    Of several matches the first by name or CAS counts.
    """
    numbers = items.select("item", F.explode("cas").alias("cas"))
    by_cas = numbers.join(iarc.select(F.explode("cas").alias("cas"), "name", "group"), "cas").groupBy("item").agg(F.min(F.struct("name", "group")).alias("i"))
    rules = numbers.join(clp.select("cas", "classes", "worst"), "cas").groupBy("item").agg(F.min_by(F.struct("cas", "classes", "worst"), "cas").alias("c"))
    by_hand = links.join(manual, "tag").groupBy("item").agg(F.min(F.struct("name", "group")).alias("m"))
    rows = by_cas.join(rules, "item", "full_outer").join(by_hand, "item", "full_outer")
    return rows.select("item", F.coalesce("i.group", "m.group").alias("iarc_group"), F.coalesce("i.name", "m.name").alias("iarc_name"),
                       F.when(F.col("i").isNotNull(), "cas").when(F.col("m").isNotNull(), "manual").alias("iarc_via"),
                       F.col("c.cas").alias("clp_cas"), F.col("c.classes").alias("clp_classes"), F.col("c.worst").alias("clp_worst"))


def attach_exposure(links: DataFrame, exposure: DataFrame) -> DataFrame:
    return lead_tag(links).join(exposure, "tag").drop("tag")


def exposure_rows(taxonomy: DataFrame) -> DataFrame:
    """Exposure facts of the taxonomy; groups over the intake that are vulnerable are set apart."""
    both = F.array_union("mean_over", "p95_over")
    rows = taxonomy.withColumn("vulnerable", F.array_sort(F.array_intersect(both, F.array(*[F.lit(v) for v in VULNERABLE]))))
    some = F.col("risk").isNotNull() | F.col("opinion_date").isNotNull() | (F.size(both) > 0) | F.col("watched")
    return rows.filter(some).select("tag", F.coalesce("e", e_from_tag(F.col("tag"))).alias("e"), "risk", "mean_over", "p95_over", "vulnerable", "watched", "opinion_date")


def opinions_by_year(exposure: DataFrame) -> DataFrame:
    return exposure.filter("opinion_date IS NOT NULL").groupBy(F.left("opinion_date", F.lit(4)).alias("year")).agg(
        F.count(F.lit(1)).alias("opinions"), F.count_if(F.size("vulnerable") > 0).alias("with_vulnerable"))


def covers(ban_covers: Column, tag: Column) -> Column:
    """A ban covers the tags it names, or just its own where it names none."""
    return F.when(F.size(ban_covers) > 0, ban_covers).otherwise(F.array(tag))


def attach_bans(links: DataFrame, bans: DataFrame) -> DataFrame:
    """(item, tag, kind, jurisdiction, covers, not_covers, penalises): a ban goes to the item that
    holds its tag; other tags of the item that it does not name are other substances."""
    held = links.groupBy("item").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    named = bans.withColumn("covers", covers(F.col("covers"), F.col("tag")))
    rows = links.select("item", "tag").join(named, "tag").join(held, "item")
    return rows.select("item", "tag", "kind", "jurisdiction", F.array_sort("covers").alias("covers"), F.array_except("tags", "covers").alias("not_covers"),
                       (F.col("kind") == "ban").alias("penalises"))


def penalising(bans: DataFrame) -> DataFrame:
    """Bans only: a withdrawn authorisation is no verdict on the substance."""
    return bans.filter(F.col("kind") == "ban")


def flatten_jurisdictions(bans: DataFrame) -> DataFrame:
    """Main and further jurisdictions as rows of one table."""
    main = bans.select("tag", "kind", "jurisdiction", F.lit(True).alias("main"))
    also = bans.select("tag", "kind", F.explode("also").alias("jurisdiction"), F.lit(False).alias("main"))
    return main.unionByName(also)


def missing_withdrawals(us: DataFrame, mapping: DataFrame, bans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections nobody has mapped to a tag, mapped tags without a recorded ban): two alarms."""
    food = us.filter("food")
    unmapped = food.join(mapping.select("section"), "section", "left_anti").select("section", "name")
    recorded = bans.filter("jurisdiction = 'United States'").select("tag").distinct()
    tags = food.join(mapping, "section").select("section", F.explode("applies_to").alias("tag"))
    return unmapped, tags.join(recorded, "tag", "left_anti").select("section", "tag")


def us_law(part_189: DataFrame, part_81: DataFrame) -> DataFrame:
    a = part_189.select("section", "name", F.lit(189).alias("part"), F.lit(True).alias("food"), F.lit(None).cast("string").alias("reason"))
    b = part_81.select("section", "name", F.lit(81).alias("part"), "food", "reason")
    return a.unionByName(b)


# ---------------------------------------------------------------- severity

def severity(evidence: DataFrame, order: str = "as_published") -> DataFrame:
    """Level, certainty and origin per item, from CLP, IARC, the reason for no intake and the
    critical effect, in that order of precedence; items nothing speaks about have no row.

    ``as_published`` takes the first class in alphabetical order and lets a surer CLP class replace
    an IARC one of a graver level, and reads an intake of 0 as none. ``strict`` takes the gravest
    class, never gives up a graver level, and keeps the 0.
    """
    strict = order == "strict"
    kinds = F.coalesce("clp_classes", F.array().cast("array<struct<kind:string,category:string,code:string>>"))
    cmr = F.filter(kinds, lambda c: c["kind"].isin("Carc", "Muta"))
    repro = F.filter(kinds, lambda c: c["kind"] == "Repr")
    if strict:
        worst = lambda cs: F.try_element_at(F.array_sort(F.transform(cs, lambda c: F.struct(c["category"], c["kind"], c["code"]))), F.lit(1))
        chosen = lambda cs: F.struct(worst(cs)["kind"].alias("kind"), worst(cs)["category"].alias("category"))
    else:
        chosen = lambda cs: F.struct(F.try_element_at(cs, F.lit(1))["kind"].alias("kind"), F.try_element_at(cs, F.lit(1))["category"].alias("category"))
    pick = F.when(F.size(cmr) > 0, chosen(cmr)).when(F.size(repro) > 0, chosen(repro))
    strength = lambda c: _map({k: str(v) for k, v in STRENGTH.items()}, c).cast("int")
    rows = (evidence.withColumn("pick", pick)
            .withColumn("effect_level", _map({k: str(v) for k, v in EFFECT_LEVEL.items()}, F.col("toxicity")).cast("int"))
            .withColumn("clp_level", F.when(F.col("pick.kind") == "Repr", 2).when(F.col("pick").isNotNull(), 1))
            .withColumn("clp_certainty", _map(CLP_CERTAINTY, F.col("pick.category")))
            .withColumn("iarc_certainty", _map(IARC_CERTAINTY, F.col("iarc_group")))
            .withColumn("clp_detail", F.concat(F.lit("CLP "), F.array_join(F.transform(kinds, lambda c: c["code"]), ", "))))
    iarc, clp = F.col("iarc_certainty").isNotNull(), F.col("clp_level").isNotNull()
    surer = strength(F.col("clp_certainty")) > strength(F.col("iarc_certainty"))
    clp_wins = clp & (~iarc | ((F.col("clp_level") == 1) & surer if strict else surer))
    genotoxic = F.coalesce(F.col("no_adi_reason") == "genotoxicity", F.lit(False))
    effect = F.col("effect_level").isNotNull()
    via = F.when(clp_wins, "clp").when(iarc, "iarc").when(genotoxic, "no-intake-genotoxicity").when(effect, "critical-effect")
    spoke = F.col("iarc_group").isNotNull()
    differ = strength(F.col("clp_certainty")) != strength(F.col("iarc_certainty"))
    rows = rows.withColumn("via", via).filter("via IS NOT NULL")
    by = lambda a, b, c, d: F.when(F.col("via") == "clp", a).when(F.col("via") == "iarc", b).when(F.col("via") == "no-intake-genotoxicity", c).otherwise(d)
    iarc_text = F.concat(F.lit("IARC group "), "iarc_group")
    return rows.select(
        "item", by(F.col("clp_level"), F.lit(1), F.lit(1), F.col("effect_level")).alias("level"),
        by(F.col("clp_certainty"), F.col("iarc_certainty"), F.lit("probable"), F.lit("established")).alias("certainty"), "via",
        by(F.col("clp_detail"), iarc_text, F.lit("genotoxicity"), F.col("toxicity")).alias("detail"),
        by(F.col("clp_cas"), F.col("iarc_name"), F.col("value_of"), F.coalesce("study_of", "value_of")).alias("origin"),
        F.when(F.col("via") != "critical-effect", F.col("effect_level")).alias("also_level"),
        F.when(clp & ((iarc & differ) | (spoke & ~iarc)), F.concat_ws(" vs ", iarc_text, "clp_detail")).alias("disagreement"),
        F.when(iarc & ~clp, "iarc-only").when(clp & ~spoke, "clp-only").alias("single_source"),
        (F.col("adi") if strict else F.when(F.col("adi") != 0, F.col("adi"))).alias("adi"))


def positioned(severities: DataFrame) -> DataFrame:
    """Place of the intake within its level: 0 is the most potent."""
    return position_in_group(severities, ["level"], "adi").withColumnRenamed("group_min", "level_min").withColumnRenamed("group_max", "level_max")


def unmapped_effects(evidence: DataFrame) -> DataFrame:
    """Labels without a level: a new one must be looked at, not filed under a default."""
    known = [*EFFECT_LEVEL, NO_EFFECT]
    return evidence.filter(F.col("toxicity").isNotNull() & ~F.col("toxicity").isin(known)).groupBy("toxicity").agg(F.count(F.lit(1)).alias("items"))


def severity_report(severities: DataFrame) -> DataFrame:
    """Items per level and certainty, with the line of each level and the total."""
    return severities.rollup("level", "certainty").agg(
        F.count(F.lit(1)).alias("items"), F.count("disagreement").alias("disagreements"), F.count("single_source").alias("single_source"))


# ---------------------------------------------------------------- published tables

def claims_per_tag(links: DataFrame) -> DataFrame:
    """Adds how many items claim each tag. Counted apart and joined back: a window over a popular
    tag would gather all its rows."""
    counts = links.groupBy("tag").agg(F.count(F.lit(1)).cast("int").alias("claims"))
    return links.join(counts, "tag")


def completeness(df: DataFrame) -> Column:
    """Points of an item's evidence. Being absent from the law is no finding and earns nothing."""
    some = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    c = F.col
    return (some(c("level").isNotNull(), 8) + some(c("banned"), 8) + some(c("adi").isNotNull() | c("no_adi_reason").isNotNull(), 2)
            + some(c("toxicity").isNotNull(), 1) + some(c("iarc_group").isNotNull(), 2) + some(c("clp_worst").isNotNull(), 2)
            + some(c("authorised") | c("withdrawn") | c("listed"), 2) + some(c("risk").isNotNull(), 1) + some(F.size("vulnerable") > 0, 1))


def item_evidence(items: DataFrame, best: DataFrame, classes: DataFrame, legal: DataFrame, exposure: DataFrame, bans: DataFrame) -> DataFrame:
    """All evidence of an item side by side: the row severity and publishing start from."""
    banned = bans.groupBy("item").agg(F.bool_or("penalises").alias("banned"))
    wide = items.select("item", "pos").join(best, "item", "left").join(classes, "item", "left").join(legal.drop("e"), "item", "left")
    return wide.join(exposure.select("item", "risk", "vulnerable", "watched"), "item", "left").join(banned, "item", "left")


def best_per_tag(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """The most complete item of each tag, taken whole: mixing items would mix substances."""
    rows = links.select("tag", "item").join(evidence, "item")
    return best_per_key(rows, ["tag"], completeness(rows), "pos")


def resolved_slice(links: DataFrame, evidence: DataFrame, bans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per tag, its bans in every jurisdiction): what scoring reads."""
    rows = best_per_tag(links, evidence)
    legal = F.when(F.col("absent"), "absent").when(F.col("authorised"), "yes").when(F.col("absent").isNotNull(), "no")
    slice_ = rows.select(
        "tag", "item", "level", "certainty", "via", "adi", "position", F.coalesce(F.col("uncertainty") <= 1, F.lit(False)).alias("no_margin"), "toxicity", "no_dose_reason",
        F.col("iarc_group").alias("iarc"), F.col("clp_worst").alias("clp"), legal.alias("legal"), F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"), "risk",
        F.coalesce("watched", F.lit(False)).alias("watched"), F.coalesce("banned", F.lit(False)).alias("banned"))
    named = bans.withColumn("covered", F.explode(covers(F.col("covers"), F.col("tag"))))
    flat = named.select(F.col("covered").alias("tag"), "kind", F.explode(F.concat(F.array("jurisdiction"), F.coalesce("also", F.array().cast("array<string>")))).alias("jurisdiction"))
    return slice_, flat.join(slice_.select("tag"), "tag", "left_semi").withColumn("penalises", F.col("kind") == "ban")


def enrich_taxonomy(taxonomy: DataFrame, slice_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taxonomy with hazard data, tags the hazard base knows and the taxonomy does not)."""
    known = slice_.drop("item", "risk", "watched")
    return taxonomy.join(known, "tag", "left"), slice_.join(taxonomy.select("tag"), "tag", "left_anti").select("tag")


def collect_bans(taxonomy: DataFrame, tag_bans: DataFrame) -> DataFrame:
    """Penalising jurisdictions of each taxonomy tag: a tag has a handful."""
    named = tag_bans.filter("penalises").groupBy("tag").agg(F.array_sort(F.collect_set("jurisdiction")).alias("jurisdictions"))
    return taxonomy.select("tag").join(named, "tag", "left").withColumn("banned", F.col("jurisdictions").isNotNull())


def compact_taxonomy(entries: DataFrame) -> DataFrame:
    """Taxonomy entry to the columns scoring needs, picked by language."""
    from larder.functions.text import pick_language, risk_word, split_tags

    pick = lambda name: pick_language(F.try_element_at("fields", F.lit(name)))
    e = pick("e_number")
    yes = lambda name: F.coalesce(pick(name) == "yes", F.lit(False))
    return entries.select(
        F.lower("tag").alias("tag"), e.alias("e"), F.coalesce(pick("name"), F.concat(F.lit("E"), e), F.regexp_replace("tag", "^en:", "")).alias("name"),
        split_tags(pick("additives_classes")).alias("classes"), risk_word(pick("efsa_evaluation_overexposure_risk")).alias("risk"),
        split_tags(pick("efsa_evaluation_exposure_mean_greater_than_adi")).alias("mean_over"),
        split_tags(pick("efsa_evaluation_exposure_95th_greater_than_adi")).alias("p95_over"),
        yes("anses_additives_of_interest").alias("watched"), yes("sweetener").alias("sweetener"), yes("non_nutritive_sweetener").alias("non_nutritive"),
        pick("efsa_evaluation_date").alias("opinion_date"))


def star_schema(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The 17 published tables from the evidence frames, each with declared columns."""
    spark = src["items"].sparkSession
    sev, links, ev = src["severity"], src["links"], src["evidence"]
    has = F.col("level").isNotNull() | F.col("iarc_group").isNotNull() | F.col("clp_worst").isNotNull() | F.col("adi").isNotNull() | F.col("toxicity").isNotNull()
    numbers = src["items"].select("item", "e_numbers")
    claims = claims_per_tag(links).join(ev.select("item", has.alias("has_evidence")), "item").join(numbers, "item")
    levels = spark.createDataFrame(LEVELS, "level int, label string")
    used = sev.select("level").distinct().withColumn("used", F.lit(True))
    return {
        "additives": src["items"].select("item", "name_en", F.array_join("cas", "|").alias("cas"), F.array_join("e_numbers", "|").alias("e_numbers")),
        "additive_tags": claims.select("item", "tag", "via", "claims", "has_evidence", F.array_contains("e_numbers", e_from_tag(F.col("tag"))).alias("declares_number")),
        "severity": sev.select("item", "level", "certainty", "via", "detail", "adi", "position", "disagreement", "single_source"),
        "levels": levels.join(F.broadcast(used), "level", "left").withColumn("used", F.coalesce("used", F.lit(False))),
        "certainties": spark.createDataFrame(CERTAINTIES, "certainty string, axis string, rank int"),
        "severity_origin": sev.join(ev.select("item", "iarc_via", "value_via", "study_via"), "item").select(
            "item", F.col("via").alias("source"), F.col("origin").alias("key"),
            F.when(F.col("via") == "iarc", F.col("iarc_via")).when(F.col("via") == "clp", "cas").otherwise(F.coalesce("value_via", "study_via")).alias("link_via")),
        "bans": flatten_jurisdictions(src["bans"]),
        "toxicology": src["toxicology"], "opinion_history": src["history"],
        "iarc": src["iarc"].select("name", "group", F.array_join("cas", "|").alias("cas"), year_parts(F.col("year")).alias("y")).select("name", "group", "cas", "y.year", F.col("y.note").alias("year_note")),
        "clp": src["clp"].select("cas", F.array_join(F.transform("classes", lambda c: c["code"]), "|").alias("codes"), "worst"),
        "eu_law": src["law"], "us_law": src["us_law"],
        "exposure": src["exposure"].select("tag", "e", "risk", F.array_join("mean_over", "|").alias("mean_over"), F.array_join("vulnerable", "|").alias("vulnerable"), "watched", "opinion_date"),
        "families": src["family_stats"], "family_members": src["families"], "withdrawal_reasons": src["reasons"],
    }


def row_number_of(df: DataFrame) -> Column:
    """60 bits of a row's content: of its columns in the order of their names, written as text, NULL as ``~``.

    Doubles count to six places, so that engines which write them differently agree.
    """
    def shown(name: str) -> Column:
        kind, c = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
        return F.coalesce(F.round(c * 1_000_000).cast("long").cast("string") if kind == "double" else c.cast("string"), F.lit("~"))

    return F.conv(F.left(F.md5(F.concat_ws("|", *[shown(c) for c in sorted(df.columns)])), F.lit(15)), 16, 10).cast("decimal(38,0)")


def publish(tables: dict[str, DataFrame], path: str, at_once: int = 4) -> DataFrame:
    """Writes every table as Parquet and gives the manifest: rows, bytes, column names and a digest a table, and a line of totals.

    Rows and digest (the sum of all rows' numbers: the same for the same rows in whatever order and files) are
    those of what was written; ``at_once`` tables are written at a time. What several tables are made from should
    be stored before, as it is computed for each of them.
    """
    spark = next(iter(tables.values())).sparkSession

    def write(name: str) -> tuple:
        df = tables[name]
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        stored = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        seen = stored.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_number_of(stored)).cast("string").alias("digest")).first()
        return name, seen["rows"], stored_bytes(spark, f"{path}/{name}"), df.columns, seen["digest"] or "0"

    with ThreadPoolExecutor(at_once) as pool:
        lines = list(pool.map(write, tables))
    lines.append(("(all)", sum(x[1] for x in lines), sum(x[2] for x in lines), [], ""))
    return spark.createDataFrame(lines, "`table` string, rows bigint, bytes bigint, columns array<string>, digest string")


# ---------------------------------------------------------------- audits

def source_coverage(items: DataFrame, universe: DataFrame, linked: DataFrame) -> DataFrame:
    """(item, has_cas, held, linked): whether a source holds an item's CAS numbers and whether it was linked."""
    held = items.select("item", F.explode("cas").alias("cas")).join(universe.select("cas").distinct(), "cas", "left_semi").select("item").distinct().withColumn("held", F.lit(True))
    return items.select("item", (F.size("cas") > 0).alias("has_cas")).join(held, "item", "left").join(
        linked.select("item").distinct().withColumn("linked", F.lit(True)), "item", "left").fillna(False, ["held", "linked"])


def lost_items(items: DataFrame, universe: DataFrame, linked: DataFrame) -> DataFrame:
    """Items whose CAS number a source holds though no link was made: the list behind the count."""
    return source_coverage(items, universe, linked).filter(F.col("held") & ~F.col("linked")).select("item")


def audit_source(items: DataFrame, universe: DataFrame, linked: DataFrame) -> DataFrame:
    """Coverage of one source: how many items' CAS numbers it holds, how many are linked, how many are lost."""
    rows = source_coverage(items, universe, linked)
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count_if("has_cas").alias("with_cas"), F.count_if("held").alias("in_source"),
                    F.count_if(F.col("has_cas") & ~F.col("held")).alias("not_in_source"), F.count_if("linked").alias("linked"),
                    F.count_if(F.col("held") & ~F.col("linked")).alias("lost"), F.count_if(F.col("linked") & ~F.col("held")).alias("linked_otherwise"))


def audit_without_cas(items: DataFrame, subs: DataFrame) -> DataFrame:
    """Items without CAS by the ways that reach a substance: E number in its name, a family sibling
    with a known CAS, the same name. Reads the CAS column the linker reads."""
    from larder.functions.text import norm_name_key

    root = lambda e: F.regexp_extract(e, r"^(\d{3,4})", 1)
    bare = items.filter(F.size("cas") == 0)
    roots = bare.select("item", F.explode("e_numbers").alias("e")).select("item", root(F.col("e")).alias("e")).distinct()
    covers_ = subs.select(F.explode(e_mentions(F.col("name"))).alias("e")).distinct()
    by_e = roots.join(covers_, "e", "left_semi").select("item").distinct().withColumn("by_e", F.lit(True))
    reach = items.filter(F.size("cas") > 0).select("item", "e_numbers", F.explode("cas").alias("cas")).join(subs.select("cas").distinct(), "cas", "left_semi")
    siblings = reach.select(F.explode("e_numbers").alias("e")).select(root(F.col("e")).alias("e")).distinct()
    by_family = roots.join(siblings, "e", "left_semi").select("item").distinct().withColumn("by_family", F.lit(True))
    keys = subs.select(norm_name_key(F.col("name")).alias("key")).filter("key IS NOT NULL").distinct()
    by_name = bare.select("item", norm_name_key(F.col("name_en")).alias("key")).join(keys, "key", "left_semi").select("item").withColumn("by_name", F.lit(True))
    rows = bare.select("item").join(by_e, "item", "left").join(by_family, "item", "left").join(by_name, "item", "left").fillna(False)
    return rows.agg(F.count(F.lit(1)).alias("without_cas"), F.count_if("by_e").alias("by_e"), F.count_if("by_family").alias("by_family"),
                    F.count_if("by_name").alias("by_name"), F.count_if(~F.col("by_e") & ~F.col("by_family") & F.col("by_name")).alias("only_by_name"),
                    F.count_if(~F.col("by_e") & ~F.col("by_family") & ~F.col("by_name")).alias("by_none"))
