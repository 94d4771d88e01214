"""Scoring queries over the product view of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.binding import additive_dim, duck, products
from larder.functions import additives as add, cosmetics as cos, nova, nutriscore as ns, paho, units
from larder.plans import cosmetics, facts, scoring
from larder.queries.registry import query


def _cuts(values: list[float], v: str, op: str = ">") -> str:
    return "(" + " + ".join(f"CASE WHEN {v} {op} {t} THEN 1 ELSE 0 END" for t in values) + ")"


def _by_drink(name: str, v: str) -> str:
    return f"CASE WHEN b THEN {_cuts(ns.CUTS[name + '_beverages'], v)} ELSE {_cuts(ns.CUTS[name], v)} END"


# Nutri-Score in SQL: flags, points, sums, grade and 0-100 value. ``src`` has the product columns.
def nutri_sql(src: str, fvl: str = "fvl", fiber: str = "fiber") -> str:
    return f"""
    SELECT *, CASE WHEN b THEN CASE WHEN w THEN 'a' WHEN score <= 2 THEN 'b' WHEN score <= 6 THEN 'c' WHEN score <= 9 THEN 'd' ELSE 'e' END
                WHEN f THEN CASE WHEN score <= -6 THEN 'a' WHEN score <= 2 THEN 'b' WHEN score <= 10 THEN 'c' WHEN score <= 18 THEN 'd' ELSE 'e' END
                ELSE CASE WHEN score <= 0 THEN 'a' WHEN score <= 2 THEN 'b' WHEN score <= 10 THEN 'c' WHEN score <= 18 THEN 'd' ELSE 'e' END END AS grade,
           CASE WHEN b THEN CASE WHEN w THEN 100.0 ELSE (14 - greatest(-15, least(14, score))::DOUBLE) / 29 * 100 END
                WHEN f THEN (30 - greatest(-17, least(30, score))::DOUBLE) / 47 * 100
                ELSE (40 - greatest(-17, least(40, score))::DOUBLE) / 57 * 100 END AS hundred
    FROM (SELECT *, neg - (CASE WHEN cp THEN p_prot ELSE 0 END + p_fiber + p_fvl) AS score FROM (
      SELECT *, b OR c OR (CASE WHEN f THEN neg < 7 ELSE neg < 11 END) AS cp FROM (
        SELECT *, p_energy + p_sugars + p_sat + p_salt AS neg FROM (
          SELECT *,
            CASE WHEN f THEN {_cuts(ns.CUTS['energy_from_saturated_fat'], 'saturated_fat * 37.0')} ELSE {_by_drink('energy', 'energy_kj')} END AS p_energy,
            {_by_drink('sugars', 'sugars')} AS p_sugars,
            CASE WHEN f THEN {_cuts(ns.CUTS['saturated_fat_ratio'], '(CASE WHEN fat > 0 THEN saturated_fat / fat * 100 END)', '>=')} ELSE {_cuts(ns.CUTS['saturated_fat'], 'saturated_fat')} END AS p_sat,
            {_cuts(ns.CUTS['salt'], 'salt')} AS p_salt,
            {_by_drink('fvl', fvl)} AS p_fvl,
            {_cuts(ns.CUTS['fiber'], fiber)} AS p_fiber,
            CASE WHEN r THEN least(2, {_by_drink('proteins', 'proteins')}) ELSE {_by_drink('proteins', 'proteins')} END AS p_prot
          FROM (SELECT *, coalesce(is_beverage, false) AS b, coalesce(is_water, false) AS w, coalesce(is_cheese, false) AS c,
                       coalesce(is_fat_oil_nuts_seeds, false) AS f, coalesce(is_red_meat, false) AS r FROM {src}))))) """


_REASON = """CASE WHEN b THEN 'beverage' WHEN c THEN 'cheese'
    WHEN f THEN CASE WHEN neg < 7 THEN 'negative_points_less_than_7' ELSE 'negative_points_greater_than_or_equal_to_7' END
    ELSE CASE WHEN neg < 11 THEN 'negative_points_less_than_11' ELSE 'negative_points_greater_than_or_equal_to_11' END END"""
_MISSING = """concat_ws(',', CASE WHEN f THEN CASE WHEN saturated_fat IS NULL THEN 'energy_from_saturated_fat' END
        ELSE CASE WHEN energy_kj IS NULL THEN 'energy' END END,
    CASE WHEN sugars IS NULL THEN 'sugars' END,
    CASE WHEN f THEN CASE WHEN NOT (fat > 0) THEN 'saturated_fat_ratio' END ELSE NULL END,
    CASE WHEN salt IS NULL THEN 'salt' END, CASE WHEN fvl IS NULL THEN 'fruits_vegetables_legumes' END,
    CASE WHEN fiber IS NULL THEN 'fiber' END, CASE WHEN proteins IS NULL THEN 'proteins' END)"""


@query("nutriscore", duck(f"""
SELECT barcode, CASE WHEN b THEN 'beverages' WHEN f THEN 'fats' ELSE 'general' END AS category,
       neg::INT AS negative_points, (neg - score)::INT AS positive_points, score::INT AS score, grade,
       round(hundred, 6) AS hundred, cp AS count_proteins, {_REASON} AS count_proteins_reason, {_MISSING} AS missing_inputs
FROM ({nutri_sql('products')})""", "products"))
def nutriscore(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.nutriscore(products(spark, sf))


@query("nutriscore_by_brand", duck(f"""
SELECT brand, grade, count(*) AS products, round(avg(score), 6) AS mean_score, round(avg(hundred), 6) AS mean_hundred
FROM ({nutri_sql('products')}) GROUP BY brand, grade""", "products"))
def nutriscore_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.with_nutriscore(products(spark, sf))
    return rows.groupBy("brand", F.col("nutri_grade").alias("grade")).agg(
        F.count(F.lit(1)).alias("products"), F.round(F.avg("nutri_score"), 6).alias("mean_score"),
        F.round(F.avg("nutri_hundred"), 6).alias("mean_hundred"))


@query("nutriscore_components", duck(f"""
WITH s AS ({nutri_sql('products')})
SELECT barcode, component, points::INT AS points FROM (
  SELECT barcode, 'energy' AS component, p_energy AS points FROM s UNION ALL SELECT barcode, 'sugars', p_sugars FROM s
  UNION ALL SELECT barcode, 'saturated_fat', p_sat FROM s UNION ALL SELECT barcode, 'salt', p_salt FROM s
  UNION ALL SELECT barcode, 'sweeteners', 0 FROM s UNION ALL SELECT barcode, 'fvl', p_fvl FROM s
  UNION ALL SELECT barcode, 'fiber', p_fiber FROM s UNION ALL SELECT barcode, 'proteins', p_prot FROM s)""", "products"))
def nutriscore_components(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.nutriscore_components(products(spark, sf))


@query("grade_scale", duck(f"""
WITH scale(category, grade, score_from, score_to) AS (VALUES
  ('general','a',-17,0),('general','b',1,2),('general','c',3,10),('general','d',11,18),('general','e',19,40),
  ('fats','a',-17,-6),('fats','b',-5,2),('fats','c',3,10),('fats','d',11,18),('fats','e',19,30),
  ('beverages','b',-15,2),('beverages','c',3,6),('beverages','d',7,9),('beverages','e',10,14)),
s AS (SELECT CASE WHEN b THEN 'beverages' WHEN f THEN 'fats' ELSE 'general' END AS category, grade
      FROM ({nutri_sql('products')}) WHERE NOT (b AND w))
SELECT scale.category, scale.grade, score_from, score_to, count(s.grade) AS products
FROM scale LEFT JOIN s ON s.category = scale.category AND s.grade = scale.grade GROUP BY ALL""", "products"))
def grade_scale(spark: SparkSession, sf: str) -> DataFrame:
    return facts.grade_scale_usage(products(spark, sf))


_FREE = "(sugars * (1.0 - greatest(0.0, least(100.0, coalesce(fvl, 0.0))) / 100))"


@query("free_sugars", duck(f"""
SELECT barcode, round({_FREE}, 6) AS free_sugars, sugars IS NOT NULL AS estimated,
       CASE WHEN {_FREE} > 0 THEN floor({_FREE} / 50.0 * 100 + 0.5) END AS daily_pct FROM products""", "products"))
def free_sugars(spark: SparkSession, sf: str) -> DataFrame:
    free = paho.free_sugars(F.col("sugars"), F.col("fvl"))
    return products(spark, sf).select(
        "barcode", F.round(free, 6).alias("free_sugars"), F.col("sugars").isNotNull().alias("estimated"),
        paho.sugar_day_pct(free).alias("daily_pct"))


@query("high_in", duck("""
SELECT barcode, concat_ws(',', CASE WHEN fat > CASE WHEN b THEN 8.75 ELSE 17.5 END THEN 'fat' END,
   CASE WHEN saturated_fat > CASE WHEN b THEN 2.5 ELSE 5.0 END THEN 'saturated_fat' END,
   CASE WHEN sugars > CASE WHEN b THEN 11.25 ELSE 22.5 END THEN 'sugars' END,
   CASE WHEN salt > CASE WHEN b THEN 0.75 ELSE 1.5 END THEN 'salt' END) AS high_in
FROM (SELECT *, coalesce(is_beverage, false) AS b FROM products)""", "products"))
def high_in(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf)
    values = {name: F.col(name) for name, _, _ in paho.HIGH_IN}
    return rows.select("barcode", F.array_join(
        paho.high_in(values, F.coalesce("is_beverage", F.lit(False))), ",").alias("high_in"))


# Additive steps in SQL, over the shared dimension.
_MARKERS = ", ".join(f"'{c}'" for c in nova.MARKER_CLASSES)
_STEPS = f"""steps AS (
  SELECT *, floor((CASE WHEN penalty_reason = 'hazard' AND position IS NOT NULL THEN base_points * (1.25 - 0.5 * position) ELSE base_points END
      + CASE risk WHEN 'high' THEN 10.0 WHEN 'moderate' THEN 5.0 ELSE 0.0 END + CASE WHEN watched THEN 4.0 ELSE 0.0 END
      + CASE WHEN group_over IN ('en:infants', 'en:toddlers', 'en:children') THEN 5.0 ELSE 0.0 END
      + CASE WHEN no_margin THEN 3.0 ELSE 0.0 END) * 10.0 + 0.5) / 10.0 AS penalty
  FROM (SELECT *, CASE WHEN class_a IN ({_MARKERS}) THEN class_a WHEN class_b IN ({_MARKERS}) THEN class_b END AS marker_class,
      CASE WHEN banned THEN 'banned' WHEN level BETWEEN 1 AND 8 THEN 'hazard' ELSE 'no-data' END AS penalty_reason,
      CASE WHEN banned THEN 60.0
        WHEN level = 1 THEN CASE certainty WHEN 'confirmed' THEN 40.0 WHEN 'probable' THEN 30.0 ELSE 20.0 END
        WHEN level = 2 THEN 12.0 WHEN level = 3 THEN 10.0 WHEN level = 4 THEN 8.0 WHEN level = 5 THEN 7.0
        WHEN level = 6 THEN 6.0 WHEN level = 7 THEN 5.0 WHEN level = 8 THEN 4.0 ELSE 3.0 END AS base_points FROM dim)),
tags AS (SELECT barcode, tag, pos FROM (SELECT barcode, unnest(string_split(additives_text, ',')) AS tag,
      generate_subscripts(string_split(additives_text, ','), 1) - 1 AS pos FROM products WHERE additives_text <> '')),
assessed AS (SELECT t.barcode, t.pos, t.tag, coalesce(s.penalty, 3.0) AS penalty, coalesce(s.banned, false) AS banned,
      coalesce(s.sweetener, false) AS sweetener, coalesce(CASE WHEN risk = 'no' THEN 'none' ELSE risk END, 'unknown') AS risk,
      s.marker_class, coalesce(penalty_reason, 'no-data') AS penalty_reason, s.name, s.level, s.certainty, s.jurisdiction, s.no_dose
   FROM tags t LEFT JOIN steps s ON s.tag = t.tag)"""


@query("additive_assessments", duck(f"""
WITH {_STEPS}
SELECT barcode, pos::INT AS pos, tag, coalesce(name, upper(replace(tag, 'en:', ''))) AS name, risk, banned, sweetener, penalty_reason, penalty,
  CASE WHEN penalty_reason = 'banned' THEN 'banned in ' || jurisdiction
       WHEN penalty_reason = 'hazard' THEN concat_ws(' ', 'hazard', certainty, 'level ' || level::VARCHAR)
       ELSE coalesce('no dose: ' || no_dose, 'no hazard data') END AS explanation,
  CASE WHEN banned THEN 'banned' WHEN level IS NOT NULL THEN concat_ws(' ', 'level ' || level::VARCHAR, certainty) ELSE 'no data' END AS chip
FROM assessed""", "products", "dim"))
def additive_assessments(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.assess_additives(products(spark, sf), additive_dim(spark))
    hazard = F.concat(F.lit("level "), F.col("level").cast("string"))
    return rows.select(
        "barcode", "pos", "tag", "name", "risk", "banned", "sweetener", "penalty_reason", "penalty",
        add.explain_points(F.col("penalty_reason"), F.col("jurisdictions"), F.col("certainty"), hazard, F.col("no_dose")).alias("explanation"),
        add.hazard_chip(F.col("banned"), F.col("level"), F.col("certainty")).alias("chip"))


_BLOCK = """block AS (SELECT barcode, sum(penalty * pow(0.72, rk)) AS total,
     count(*) FILTER (risk = 'high') AS high_risk, count(*) FILTER (banned) AS banned, bool_or(sweetener) AS sweetened,
     bool_or(marker_class IS NOT NULL) AS marker
   FROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY penalty DESC, pos) - 1 AS rk FROM assessed) GROUP BY barcode),
scored AS (SELECT p.*, coalesce(total, 0.0) AS additive_total, greatest(0.0, least(100.0, 100.0 - coalesce(total, 0.0))) AS additive_score,
     coalesce(high_risk, 0)::INT AS high_risk, coalesce(banned, 0)::INT AS banned, coalesce(sweetened, false) AS sweetened,
     coalesce(marker, false) AS additive_marker FROM products p LEFT JOIN block USING (barcode))"""


@query("additive_block", duck(f"""
WITH {_STEPS}, {_BLOCK}
SELECT barcode, round(additive_total, 6) AS total, round(additive_score, 6) AS score, high_risk, banned, sweetened FROM scored""", "products", "dim"))
def additive_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.with_additive_block(products(spark, sf), additive_dim(spark))
    return rows.select("barcode", F.round("additive_total", 6).alias("total"), F.round("additive_score", 6).alias("score"),
                       "high_risk", "banned", "sweetened")


@query("additive_usage", duck(f"""
WITH {_STEPS}
SELECT tag, count(*) AS uses, count(DISTINCT barcode) AS products, max(penalty) AS penalty FROM assessed GROUP BY tag""", "products", "dim"))
def additive_usage(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.assess_additives(products(spark, sf), additive_dim(spark))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("barcode").alias("products"),
                                   F.max("penalty").alias("penalty"))


_FOLDED = "strip_accents(ingredients_text)"
_ANY = "(" + " OR ".join(f"regexp_matches({_FOLDED}, '(?i){p}')" for p in nova.PATTERNS) + ")"
_PATTERN_ROWS = ", ".join(f"({i}, '(?i){p}')" for i, p in enumerate(nova.PATTERNS))


@query("nova_markers", duck(f"""
WITH {_STEPS}, pats(i, p) AS (VALUES {_PATTERN_ROWS}),
m AS (SELECT barcode, i, ingredients_text AS t, strip_accents(ingredients_text) AS f, regexp_extract(strip_accents(ingredients_text), p, 0) AS hit
      FROM products, pats WHERE ingredients_text IS NOT NULL AND regexp_matches(strip_accents(ingredients_text), p)),
q AS (SELECT barcode, i, substring(t, strpos(f, hit)::INT, length(hit)::INT) AS value FROM m)
SELECT barcode, 'ingredient' AS kind, arg_min(value, i) AS value, CAST(NULL AS VARCHAR) AS class FROM q GROUP BY barcode, lower(value)
UNION ALL SELECT barcode, 'additive', tag, marker_class FROM assessed WHERE marker_class IS NOT NULL""", "products", "dim"))
def nova_markers(spark: SparkSession, sf: str) -> DataFrame:
    return facts.nova_markers(products(spark, sf), additive_dim(spark))


_NOVA = f"""sealed AS (SELECT *, coalesce(nova_group, CASE WHEN additive_marker OR coalesce({_ANY}, false) THEN 4 END) AS nova FROM scored)"""


@query("nova_groups", duck(f"""
WITH {_STEPS}, {_BLOCK}, {_NOVA}
SELECT barcode, nova::INT AS nova, CASE WHEN nova_group IS NOT NULL THEN 'source' WHEN nova IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS origin,
   CASE nova WHEN 1 THEN 100.0 WHEN 2 THEN 80.0 WHEN 4 THEN 25.0 ELSE 55.0 END::DOUBLE AS value FROM sealed""", "products", "dim"))
def nova_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.with_nova(scoring.with_additive_summary(products(spark, sf), additive_dim(spark)))
    origin = F.when(F.col("declared_nova").isNotNull(), "source").when(F.col("nova").isNotNull(), "inferred").otherwise("unknown")
    return rows.select("barcode", F.col("nova").cast("int").alias("nova"), origin.alias("origin"),
                       nova.nova_hundred(F.col("nova")).alias("value"))


def _seals_sql(free: str) -> str:
    share = lambda g, per: f"{g} * {per} / kc * 100"
    return (f"(CASE WHEN sodium / kc >= 1 THEN 1 ELSE 0 END + CASE WHEN {share(free, '4.0')} >= 10 THEN 1 ELSE 0 END"
            f" + CASE WHEN {share('fat', '9.0')} >= 30 THEN 1 ELSE 0 END + CASE WHEN {share('saturated_fat', '9.0')} >= 10 THEN 1 ELSE 0 END"
            f" + CASE WHEN {share('trans_fat', '9.0')} >= 1 THEN 1 ELSE 0 END + CASE WHEN sweetened THEN 1 ELSE 0 END)")


_KC = "CASE WHEN energy_kj / 4.184 > 0 THEN energy_kj / 4.184 END AS kc"


@query("paho_seals", duck(f"""
WITH {_STEPS}, {_BLOCK}, {_NOVA}, k AS (SELECT *, {_KC} FROM sealed),
s AS (SELECT barcode, nova, 'sodium' AS id, sodium / kc AS v, 1.0 AS threshold, 2 AS d, false AS estimated FROM k
  UNION ALL SELECT barcode, nova, 'free-sugars', {_FREE} * 4.0 / kc * 100, 10.0, 1, sugars IS NOT NULL FROM k
  UNION ALL SELECT barcode, nova, 'total-fat', fat * 9.0 / kc * 100, 30.0, 1, false FROM k
  UNION ALL SELECT barcode, nova, 'saturated-fat', saturated_fat * 9.0 / kc * 100, 10.0, 1, false FROM k
  UNION ALL SELECT barcode, nova, 'trans-fat', trans_fat * 9.0 / kc * 100, 1.0, 1, false FROM k)
SELECT barcode, coalesce(nova >= 3, true) AS applicable, id, coalesce(v >= threshold, false) AS exceeded,
   CASE WHEN d = 2 THEN floor(v * 100.0 + 0.5) / 100.0 ELSE floor(v * 10.0 + 0.5) / 10.0 END AS actual, threshold::DOUBLE AS threshold, estimated FROM s
UNION ALL SELECT barcode, coalesce(nova >= 3, true), 'sweeteners', sweetened, NULL, 0.0, false FROM k""", "products", "dim"))
def paho_seals(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.seal_rows(products(spark, sf), additive_dim(spark))


def _value_sql(hundred: str, group: str, seals: str) -> str:
    pen = f"CASE WHEN alco THEN 0.0 ELSE least(CASE WHEN coalesce({group} >= 3, true) THEN {seals} ELSE 0 END * 4.0, 16.0) END"
    proc = f"CASE {group} WHEN 1 THEN 100.0 WHEN 2 THEN 80.0 WHEN 4 THEN 25.0 ELSE 55.0 END"
    return f"""greatest(0.0, least(100.0, floor(CASE WHEN alco THEN ({proc} * 0.2::DOUBLE + additive_score * 0.2::DOUBLE) / (0.2::DOUBLE + 0.2::DOUBLE)
      ELSE {hundred} * 0.55::DOUBLE + {proc} * 0.2::DOUBLE + additive_score * 0.2::DOUBLE + (100.0::DOUBLE - ({pen}) / 16.0::DOUBLE * 100) * 0.05::DOUBLE END - ({pen}) * 0.5 + 0.5)))"""


_FREE_BEST = "(sugars * (1.0 - greatest(0.0, least(100.0, coalesce(fvl, 100.0))) / 100))"
_HEALTH = f"""n0 AS (SELECT barcode, hundred AS h0, grade FROM ({nutri_sql('sealed')})),
n1 AS (SELECT barcode, hundred AS h1 FROM ({nutri_sql('sealed', 'coalesce(fvl, 100.0)', 'coalesce(fiber, 100.0)')})),
n2 AS (SELECT barcode, hundred AS h2 FROM ({nutri_sql('sealed', 'coalesce(fvl, 0.0)', 'coalesce(fiber, 0.0)')})),
a AS (SELECT *, coalesce(alcohol > 1.2, false) AS alco, {_KC} FROM sealed JOIN n0 USING (barcode) JOIN n1 USING (barcode) JOIN n2 USING (barcode)),
v AS (SELECT *, CASE WHEN coalesce(nova >= 3, true) THEN {_seals_sql(_FREE)} ELSE 0 END AS seals,
    {_value_sql('h0', 'nova', _seals_sql(_FREE))} AS health,
    {_value_sql('h1', 'coalesce(nova_group, 1)', _seals_sql(_FREE_BEST))} AS best,
    {_value_sql('h2', 'coalesce(nova_group, 4)', _seals_sql(_FREE))} AS worst FROM a)"""


@query("health_scores", duck(f"""
WITH {_STEPS}, {_BLOCK}, {_NOVA}, {_HEALTH}
SELECT barcode, health::INT AS score,
  CASE WHEN health >= 75 THEN 'excellent' WHEN health >= 50 THEN 'good' WHEN health >= 25 THEN 'mediocre' WHEN health >= 10 THEN 'poor' ELSE 'bad' END AS band,
  CASE WHEN NOT alco THEN grade END AS grade, nova::INT AS nova, CASE WHEN NOT alco THEN seals::INT END AS seals,
  round(additive_score, 6) AS additive_score, high_risk, banned, alco AS alcoholic, CASE WHEN alco THEN alcohol END AS abv,
  CASE WHEN worst <> best THEN least(worst, health)::INT END AS range_min, CASE WHEN worst <> best THEN greatest(best, health)::INT END AS range_max
FROM v""", "products", "dim"))
def health_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.health_scores(products(spark, sf), additive_dim(spark))


@query("health_by_band", duck(f"""
WITH {_STEPS}, {_BLOCK}, {_NOVA}, {_HEALTH}
SELECT brand, CASE WHEN health >= 75 THEN 'excellent' WHEN health >= 50 THEN 'good' WHEN health >= 25 THEN 'mediocre' WHEN health >= 10 THEN 'poor' ELSE 'bad' END AS band,
  count(*) AS products, min(health)::INT AS lowest, max(health)::INT AS highest FROM v GROUP BY ALL""", "products", "dim"))
def health_by_band(spark: SparkSession, sf: str) -> DataFrame:
    from larder.functions.health import band

    rows = scoring.with_health(products(spark, sf), additive_dim(spark))
    return rows.groupBy("brand", band(F.col("health")).alias("band")).agg(
        F.count(F.lit(1)).alias("products"), F.min("health").cast("int").alias("lowest"), F.max("health").cast("int").alias("highest"))


@query("score_breakdown", duck(f"""
WITH {_STEPS}, {_BLOCK}, {_NOVA}, {_HEALTH}
SELECT barcode, 'nutrition' AS block, round(h0 * 0.55, 6) AS contribution, 0.55::DOUBLE AS weight FROM v WHERE NOT alco
UNION ALL SELECT barcode, 'processing', round(CASE nova WHEN 1 THEN 100.0 WHEN 2 THEN 80.0 WHEN 4 THEN 25.0 ELSE 55.0 END * 0.2, 6), 0.2 FROM v
UNION ALL SELECT barcode, 'additives', round(additive_score * 0.2, 6), 0.2 FROM v
UNION ALL SELECT barcode, 'regulatory', round((100.0 - least(seals * 4.0, 16.0) / 16.0 * 100) * 0.05, 6), 0.05 FROM v WHERE NOT alco""", "products", "dim"))
def score_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_breakdown(products(spark, sf), additive_dim(spark))


@query("confidence", duck(f"""
WITH {_STEPS}, {_BLOCK}, {_NOVA},
c AS (SELECT *, coalesce(alcohol > 1.2, false) AS alco,
  (CASE WHEN energy_kj IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN sugars IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN saturated_fat IS NOT NULL THEN 2 ELSE 0 END
   + CASE WHEN salt IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN proteins IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN fiber IS NOT NULL THEN 1 ELSE 0 END
   + CASE WHEN fat IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ingredients_text IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN nova IS NOT NULL THEN 2 ELSE 0 END) / 16.0 AS ratio,
  concat_ws(',', CASE WHEN energy_kj IS NULL THEN 'energy' END, CASE WHEN sugars IS NULL THEN 'sugars' END, CASE WHEN proteins IS NULL THEN 'proteins' END,
    CASE WHEN fiber IS NULL THEN 'fiber' END, CASE WHEN ingredients_text IS NULL THEN 'ingredients' END, CASE WHEN nova IS NULL THEN 'nova' END) AS missing,
  concat_ws(',', CASE WHEN fvl IS NULL THEN 'fvl-unknown' END, CASE WHEN fiber IS NULL THEN 'fiber-unknown' END, CASE WHEN nova IS NULL THEN 'nova-unknown' END,
    CASE WHEN is_beverage IS NULL THEN 'category-unknown' END) AS notes FROM sealed)
SELECT barcode, CASE WHEN alco THEN 'medium' WHEN ratio >= 0.85 THEN CASE WHEN notes <> '' THEN 'medium' ELSE 'high' END
    WHEN ratio >= 0.6 THEN 'medium' WHEN ratio >= 0.35 THEN 'low' ELSE 'insufficient' END AS level,
  CASE WHEN alco THEN 1.0 ELSE floor(ratio * 100.0 + 0.5) / 100.0 END::DOUBLE AS ratio, CASE WHEN alco THEN '' ELSE missing END AS missing,
  CASE WHEN alco THEN 'alcohol-is-carcinogenic' ELSE notes END AS notes FROM c""", "products", "dim"))
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.confidence(products(spark, sf), additive_dim(spark))


@query("usable_products", duck("""
SELECT barcode, trim(name) <> '' AND (energy_kj IS NOT NULL OR sugars IS NOT NULL OR fat IS NOT NULL OR proteins IS NOT NULL
   OR coalesce(trim(ingredients_text) <> '', false)) AS usable FROM products""", "products"))
def usable_products(spark: SparkSession, sf: str) -> DataFrame:
    return facts.usable(products(spark, sf))


@query("alcohol_content", duck("""
SELECT barcode, round(grams, 6) AS grams, round(grams / 10.0, 6) AS drinks_who, round(grams / 14.0, 6) AS drinks_us, sweetness
FROM (SELECT barcode, CASE WHEN alcohol > 0 AND ml > 0 THEN ml * alcohol / 100 * 0.789 END AS grams,
   CASE WHEN sugars * 10 <= 3 THEN 'Brut Nature' WHEN sugars * 10 <= 6 THEN 'Extra Brut' WHEN sugars * 10 <= 12 THEN 'Brut' WHEN sugars * 10 <= 17 THEN 'Extra Seco'
        WHEN sugars * 10 <= 32 THEN 'Seco' WHEN sugars * 10 <= 50 THEN 'Semiseco' WHEN sugars IS NOT NULL THEN 'Dulce' END AS sweetness
  FROM (SELECT barcode, alcohol, sugars, CASE WHEN k % 10 > 0 THEN (k % 10)::DOUBLE * CASE k % 5 WHEN 0 THEN 1000 WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 1 END END AS ml FROM products))""", "products"))
def alcohol_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).withColumn("quantity", F.col("k") % 10)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("l", " CL", "dl", "ml", "")]), (F.col("k") % 5 + 1).cast("int"))
    ml = units.volume_ml(F.col("quantity").cast("double"), unit)
    rows = rows.withColumn("ml", ml).withColumn("grams", units.ethanol_g(F.col("alcohol"), F.col("ml")))
    return rows.select("barcode", F.round("grams", 6).alias("grams"),
                       F.round(units.standard_drinks(F.col("grams")), 6).alias("drinks_who"),
                       F.round(units.standard_drinks(F.col("grams"), "us"), 6).alias("drinks_us"),
                       units.sweetness_class(F.col("sugars")).alias("sweetness"))


@query("nutrition_facts", duck("""
SELECT barcode, label, value, unit, mark FROM (
  SELECT barcode, unnest(['energy_kj','fat','saturated_fat','trans_fat','sugars','fiber','proteins','salt','sodium','fvl','alcohol']) AS label,
    unnest([energy_kj, fat, saturated_fat, trans_fat, sugars, fiber, proteins, salt, sodium, fvl, alcohol]) AS value,
    unnest(['kJ','g','g','g','g','g','g','g','mg','%','%']) AS unit,
    unnest([CASE WHEN k % 3 = 0 THEN 'approx' END, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'computed' END, NULL, 'estimate', NULL]) AS mark
  FROM products) WHERE value IS NOT NULL""", "products"))
def nutrition_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    marks = F.map_filter(F.create_map(
        F.lit("energy_kj"), F.when(k % 3 == 0, "approx"), F.lit("salt"), F.when(k % 2 == 0, "computed"),
        F.lit("fvl"), F.lit("estimate")), lambda _, v: v.isNotNull())
    return facts.nutrition_facts(products(spark, sf).withColumn("estimated", marks))


_INCI = """i AS (SELECT barcode, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw FROM
   (SELECT barcode, regexp_split_to_array(regexp_replace(inci_text, '(?i)^ingredients?\\s*:', ''), '[,;]') AS l FROM products)),
n AS (SELECT barcode, pos, trim(regexp_replace(regexp_replace(strip_accents(lower(raw)), '[*+()\\[\\]{}.]', ' ', 'g'), '\\s+', ' ', 'g')) AS ingredient FROM i),
w AS (SELECT * FROM n WHERE length(ingredient) > 1)"""
_COSING = ", ".join(f"('{i}', '{a}')" for i, a, _ in cos.REGULATED)
_ALLERGENS = ", ".join(f"('{i}')" for i in cos.FRAGRANCE_ALLERGENS)


@query("cosmetic_flags", duck(f"""
WITH {_INCI}, reg(inci, annex) AS (VALUES {_COSING}), alg(inci) AS (VALUES {_ALLERGENS}),
f AS (SELECT barcode, pos, ingredient, CASE WHEN annex = 'II' THEN 'prohibited' WHEN annex IS NOT NULL THEN 'restricted' ELSE 'allergen' END AS severity, annex
  FROM w LEFT JOIN reg ON reg.inci = ingredient LEFT JOIN alg ON alg.inci = ingredient WHERE reg.inci IS NOT NULL OR alg.inci IS NOT NULL)
SELECT barcode, (row_number() OVER (PARTITION BY barcode ORDER BY CASE severity WHEN 'prohibited' THEN 0 WHEN 'restricted' THEN 1 ELSE 2 END, pos))::INT AS rank,
  ingredient, severity, annex FROM f""", "products"))
def cosmetic_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).select("barcode", F.col("inci_text").alias("ingredients_text"))
    return cosmetics.flag_rows(rows)


@query("cosmetic_assessments", duck(f"""
WITH {_INCI}, reg(inci, annex) AS (VALUES {_COSING}), alg(inci) AS (VALUES {_ALLERGENS})
SELECT barcode, count(*)::INT AS total_ingredients, (count(*) FILTER (reg.inci IS NOT NULL OR alg.inci IS NOT NULL))::INT AS recognized,
  (count(*) FILTER (annex = 'II'))::INT AS prohibited, (count(*) FILTER (annex <> 'II'))::INT AS restricted,
  (count(*) FILTER (reg.inci IS NULL AND alg.inci IS NOT NULL))::INT AS allergens, count(*) >= 3 AS has_full_list,
  CASE WHEN count(*) >= 3 THEN 'medium' ELSE 'insufficient' END AS confidence, CASE WHEN count(*) >= 3 THEN 0.6 ELSE 0.1 END::DOUBLE AS ratio
FROM w LEFT JOIN reg ON reg.inci = ingredient LEFT JOIN alg ON alg.inci = ingredient GROUP BY barcode""", "products"))
def cosmetic_assessments(spark: SparkSession, sf: str) -> DataFrame:
    rows = products(spark, sf).select("barcode", F.col("inci_text").alias("ingredients_text"))
    return cosmetics.assess(rows)


@query("assessment_routing", duck("""
SELECT kind, count(*) AS products, count(*) FILTER (kind <> 'cosmetic' AND energy_kj IS NOT NULL) AS with_energy FROM (
  SELECT *, CASE WHEN k % 29 = 0 THEN 'cosmetic' WHEN coalesce(is_beverage, false) THEN 'beverage' ELSE 'food' END AS kind FROM products) GROUP BY kind""", "products"))
def assessment_routing(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("k") % 29 == 0, "openbeautyfacts").otherwise("openfoodfacts")
    food, cosmetic = cosmetics.route(products(spark, sf).withColumn("source", source))
    both = food.select("kind", "energy_kj").unionByName(cosmetic.select("kind", "energy_kj"))
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if((F.col("kind") != "cosmetic") & F.col("energy_kj").isNotNull()).alias("with_energy"))
