"""Toxicology records per substance: reference values, critical studies and opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.text import doi
from larder.operators.latest import first_per_key

# Why no daily intake was set, by the source's justification.
NO_ADI = {
    "genotoxic concern": "genotoxicity", "not set, genotoxicity inconclusive": "genotoxicity",
    "not deemed necessary": "not-needed", "not deemed necessary.": "not-needed",
    "no safety concern under current conditions (refined exposure scenario)": "not-needed",
    "incomplete dataset": "missing-data", "incomplete dataset; not deemed necessary.": "missing-data",
    "out of scope": "out-of-scope",
}
# Descriptors that are no dose but the reason there is none, by how they start.
NO_DOSE = {
    "incomplete dataset": "incomplete-data", "critical study not identified": "no-critical-study",
    "not deemed necessary": "not-needed", "margin of safety": "margin-of-safety",
}
# The panel's conclusion and how adverse it is.
ASSESSMENTS = {
    "some concern": ("some-concern", 5), "low concern": ("low-concern", 4), "no concern": ("no-concern", 3),
    "insufficient data": ("insufficient-data", 2), "additional data required": ("missing-data", 2), "low-quality data": ("low-quality-data", 1),
}
# Canonical terms of a finding and how much each says.
TERMS = {"Not determined": 0, "Not applicable": 1, "No data": 0, "Positive": 4, "Negative": 2, "Ambiguous": 3, "Other": 1}
FINDINGS = ["genotoxic", "mutagenic", "carcinogenic"]
# Labels that say nothing useful.
EMPTY_LABELS = ["systemic", "not reported"]


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def no_adi_reason(justification: Column) -> Column:
    return F.when(justification.isNotNull() & (justification != ""), F.coalesce(_lookup(NO_ADI, F.lower(F.trim(justification))), F.lit("other")))


def no_dose_reason(descriptor: Column) -> Column:
    low = F.lower(F.trim(descriptor))
    out = None
    for start, name in NO_DOSE.items():
        out = (F if out is None else out).when(low.startswith(start), name)
    return out


def panel_assessment(text: Column) -> Column:
    label = F.lower(F.trim(F.regexp_extract(text, r"(?i)^\s*Assessment\s*:\s*([^;.]+)", 1)))
    return _lookup({k: v[0] for k, v in ASSESSMENTS.items()}, label)


def assessment_weight(name: Column) -> Column:
    return F.coalesce(_lookup({v[0]: str(v[1]) for v in ASSESSMENTS.values()}, name).cast("int"), F.lit(0))


def finding_terms(text: Column) -> Column:
    """``key: value`` statements of the three kinds to (kind, term, note); other terms stay as written."""
    statements = F.filter(F.split(text, "[;\n]"), lambda s: s.contains(":"))
    pair = lambda s: F.struct(F.lower(F.trim(F.split(s, ":", 2)[0])).alias("kind"), F.trim(F.split(s, ":", 2)[1]).alias("said"))
    known = F.filter(F.transform(statements, pair), lambda p: p["kind"].isin(FINDINGS) & (p["said"] != ""))

    def term(p: Column) -> Column:
        name = None
        for t in TERMS:
            name = (F if name is None else name).when(F.lower(p["said"]).startswith(t.lower()), t)
        canonical = name
        note = F.btrim(F.substring(p["said"], F.length(canonical) + 1, F.length(p["said"])), F.lit(" .:;"))
        return F.struct(p["kind"].alias("kind"), F.coalesce(canonical, p["said"]).alias("term"), F.nullif(note, F.lit("")).alias("note"))

    return F.transform(known, term)


def term_weight(term: Column) -> Column:
    return F.coalesce(_lookup({k.lower(): str(v) for k, v in TERMS.items()}, F.lower(term)).cast("int"), F.lit(0))


# ---------------------------------------------------------------- dimensions

def substances(sub: DataFrame, ref: DataFrame) -> DataFrame:
    """Substance with the chemical identity of its reference substance."""
    chem = ref.select(F.col("uuid").alias("ref"), F.nullif(F.trim("cas"), F.lit("")).alias("cas"), "param_code")
    return sub.join(chem, "ref", "left").select("uuid", "name", "cas", "param_code")


def opinions(dossier: DataFrame) -> DataFrame:
    """Opinion with its date (stated, or the first ISO date of a remark), DOI and feed flag."""
    remark = F.nullif(F.regexp_extract("remark", r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return dossier.select("opinion", F.left(F.coalesce("date", remark), F.lit(10)).alias("date"), "title", doi(F.col("link")).alias("doi"),
                          "panel", F.coalesce(F.upper("panel").contains("FEEDAP"), F.lit(False)).alias("feed"))


# ---------------------------------------------------------------- reference values

def reference_values(flex: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(daily intakes, other values, conclusions per opinion).

    A row with an intake or a statement that there is none is of the first kind; else what its other
    branch holds is of the second. Inside one opinion the first stated intake and reason count, and
    the most adverse assessment of any branch.
    """
    rows = flex.withColumn("no_adi_reason", no_adi_reason(F.col("justification"))).withColumn(
        "no_adi", F.when(F.coalesce("no_allocated", F.lit("")) != "", True))
    has_adi = F.coalesce(F.col("adi") != 0, F.lit(False)) | F.col("no_adi").isNotNull()
    intakes = rows.filter(has_adi).select("substance", "doc", "pos", "adi", "unit", "no_adi", "justification", "no_adi_reason", "uncertainty", "critical_id")
    other = rows.filter(~has_adi & F.coalesce(F.col("other_type"), F.col("other_value").cast("string"), F.col("other_comments"), F.col("other_critical")).isNotNull()).select(
        "substance", "doc", "pos", F.col("other_type").alias("type"), no_dose_reason(F.col("other_type")).alias("no_dose_reason"), F.col("other_value").alias("value"),
        F.col("other_critical").alias("critical_id"))
    said = rows.select("substance", "opinion", "pos", "adi", "no_adi_reason", F.explode(F.array("comments", "other_comments")).alias("comment")).withColumn(
        "assessment", panel_assessment(F.col("comment")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    weight = F.struct(assessment_weight(F.col("assessment")).alias("w"), (-F.col("pos")).alias("p"))
    conclusions = said.filter("opinion IS NOT NULL").groupBy("substance", "opinion").agg(
        first("adi").alias("adi"), first("no_adi_reason").alias("no_adi_reason"),
        F.max_by("assessment", F.when(F.col("assessment").isNotNull(), weight)).alias("assessment"))
    return intakes, other, conclusions


def most_protective(intakes: DataFrame) -> DataFrame:
    """Lowest intake of each substance; a number beats none, the earlier row beats a tie."""
    order = ["_none", "adi", "pos"]
    return first_per_key(intakes.withColumn("_none", F.col("adi").isNull()), ["substance"], order).drop("_none")


def no_margin(values: DataFrame) -> DataFrame:
    """Intakes derived with an uncertainty factor of one or less."""
    return values.select("substance", F.coalesce(F.col("uncertainty") <= 1, F.lit(False)).alias("no_margin"))


def critical_studies(studies: DataFrame, values: DataFrame) -> DataFrame:
    """Study that a reference value names as critical, with toxicity label and effect.

    ``remarks`` is the array of a study's remark columns; the first labelled one counts.
    """
    shape = r"^\s*Toxicity:\s*([^;]+?)\s*(?:;|$)"
    label = F.try_element_at(F.filter("remarks", lambda r: r.rlike(shape)), F.lit(1))
    named = values.filter("critical_id IS NOT NULL").select(F.col("critical_id").alias("study"), "substance", F.col("pos").alias("_pos"))
    rows = studies.join(named, "study").withColumn("label", label).select(
        "substance", "study", "_pos", F.nullif(F.regexp_extract("label", shape, 1), F.lit("")).alias("toxicity"),
        F.nullif(F.trim(F.regexp_extract("label", r"Effect desc\.?:\s*(.+)", 1)), F.lit("")).alias("effect"), "species", "dose")
    rows = rows.withColumn("useful", F.coalesce(~F.col("toxicity").isin(EMPTY_LABELS), F.lit(False)))
    return first_per_key(rows, ["substance"], ["_pos", "study"]).drop("_pos")


# ---------------------------------------------------------------- opinions

def finding_class(terms: Column) -> Column:
    """What the studies of one opinion found, from the lower-case terms."""
    return (F.when(F.array_contains(terms, "positive"), "positive").when(F.array_contains(terms, "ambiguous"), "ambiguous")
            .when(F.array_contains(terms, "negative"), "negative").otherwise("no-data"))


def opinion_findings(summaries: DataFrame) -> DataFrame:
    """One row per substance and opinion: halves of one opinion are merged, the more telling answer
    of each kind counts."""
    said = summaries.select("substance", "opinion", "pos", F.inline(finding_terms(F.col("information"))))
    best = lambda kind: F.max_by("term", F.when(F.col("kind") == kind, F.struct(term_weight(F.col("term")).alias("w"), (-F.col("pos")).alias("p"))))
    rows = said.groupBy("substance", "opinion").agg(*[best(k).alias(k) for k in FINDINGS])
    terms = F.transform(F.array_compact(F.array(*FINDINGS)), lambda t: F.lower(t))
    return rows.withColumn("finding", finding_class(terms))


def resolve_opinions(findings: DataFrame, dims: DataFrame, conclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, history). Current is the most recent opinion that says something, food before feed;
    history holds every candidate, with the current one marked.

    Aggregated per substance before the shuffle; the history is joined back, not collected.
    """
    rows = findings.join(dims, "opinion", "left").join(
        conclusions.withColumnRenamed("adi", "opinion_adi").withColumnRenamed("no_adi_reason", "opinion_reason"), ["substance", "opinion"], "left")
    says = F.col("finding") != "no-data"
    food = ~F.coalesce("feed", F.lit(False))
    rows = rows.withColumn("_date", F.coalesce("date", F.lit("")))
    rank = F.struct(says.alias("says"), food.alias("food"), F.col("_date"))
    best = rows.groupBy("substance").agg(
        F.max(rank).alias("_want"), F.count(F.lit(1)).alias("opinions"), F.bool_or(says).alias("studied"),
        F.collect_set(F.when(says, F.col("finding"))).alias("_found"))
    top = rows.join(best.select("substance", "_want"), "substance").filter(rank == F.col("_want")).drop("_want", "_date")
    rows = rows.drop("_date")
    # Opinions of the same day: the smaller id is taken, so that reruns agree.
    cited = first_per_key(top, ["substance"], ["opinion"])
    current = cited.join(best.select("substance", "opinions", "studied", "_found"), "substance").withColumn(
        "disagree", F.array_sort(F.array_except("_found", F.array("finding")))).drop("_found")
    studied = best.select("substance", "studied")
    history = rows.join(studied, "substance").filter(~F.col("studied") | says).drop("studied").join(
        cited.select("substance", "opinion", F.lit(True).alias("cited")), ["substance", "opinion"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return current, history
