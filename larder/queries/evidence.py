"""Evidence queries. Items come from ``part``, substances from ``customer``, group opinions and bans
from ``nation``, classifications from ``supplier``, opinions from ``orders``; the views are SQL text
that both engines run, everything after them is expressed twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.binding import dealt, load
from larder.functions import codes
from larder.plans import evidence as ev, toxicology as tox
from larder.queries.registry import query
from larder.session import checkpoint_root, cut_lineage
from larder.sources import regulation as reg

#: Items that one task reads their numbers from.
ITEM_ROWS = 50_000

_CASNO = "CAST({n} AS STRING) || '-' || lpad(CAST({n} % 100 AS STRING), 2, '0') || '-' || CAST({n} % 10 AS STRING)"


def _cas(n: str) -> str:
    return _CASNO.replace("{n}", f"({n})")


VIEWS = {
    "items_v": f"""SELECT p_partkey AS k, 'Q' || CAST(p_partkey AS STRING) AS item, 'Substance ' || CAST(p_partkey AS STRING) || ' of ' || p_name AS name_en,
        CAST(100 + p_partkey % 400 AS STRING) AS n,
        CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'E ' || CAST(100 + p_partkey % 400 AS STRING) WHEN 2 THEN 'E' || CAST(100 + p_partkey % 400 AS STRING) || '(i)'
          WHEN 3 THEN CAST(100 + p_partkey % 400 AS STRING) WHEN 4 THEN 'E14XX' ELSE 'E' || CAST(100 + p_partkey % 400 AS STRING) END AS e_raw,
        CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '00' || {_cas('p_partkey + 50')} WHEN 2 THEN CAST(p_partkey + 50 AS STRING) || ' – ' || lpad(CAST((p_partkey + 50) % 100 AS STRING), 2, '0') || '-' || CAST((p_partkey + 50) % 10 AS STRING)
          ELSE {_cas('p_partkey + 50')} END AS cas_raw FROM part""",
    "tags_v": """SELECT 'en:e' || CAST(n AS STRING) || s AS tag, 'E' || CAST(n AS STRING) || CASE WHEN s = 'i' THEN '(i)' ELSE '' END AS e_raw, n, CAST(n AS STRING) || CASE WHEN s = 'i' THEN 'i' ELSE '' END AS e, 'Tag ' || CAST(n AS STRING) AS name_en,
        CASE WHEN n % 9 = 0 THEN 'Q' || CAST(n - 99 AS STRING) WHEN n % 3 = 0 THEN 'Q' || CAST(n - 100 AS STRING) END AS item_ref
      FROM (SELECT DISTINCT 100 + p_partkey % 400 AS n FROM part) t, (SELECT '' AS s UNION ALL SELECT 'i' UNION ALL SELECT 'ii') x
      WHERE s = '' OR (s = 'i' AND n % 7 = 0) OR (s = 'ii' AND n % 14 = 0)""",
    "subs_v": f"""SELECT 'S' || CAST(c_custkey AS STRING) AS uuid, 'substance ' || CAST(c_custkey AS STRING) AS name, {_cas('c_custkey + 50')} AS cas FROM customer
      UNION ALL SELECT 'G' || CAST(n_nationkey AS STRING), 'Group ' || CAST(n_nationkey AS STRING) || ' (E ' || CAST(100 + n_nationkey * 10 AS STRING) || '-' || CAST(103 + n_nationkey * 10 AS STRING) || ', E ' || CAST(400 + n_nationkey AS STRING) || ')', NULL FROM nation""",
    "groups_v": """SELECT 'Group ' || CAST(n_nationkey AS STRING) || ' (E ' || CAST(100 + n_nationkey * 10 AS STRING) || '-' || CAST(103 + n_nationkey * 10 AS STRING) || ', E ' || CAST(400 + n_nationkey AS STRING) || ')' AS name,
        'en:e' || CAST(150 + n_nationkey AS STRING) AS tag FROM nation""",
    "oft_v": """SELECT 'S' || CAST(c_custkey AS STRING) AS uuid, 'substance ' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 50 AS DOUBLE) / 10 END AS adi,
        CASE WHEN c_custkey % 8 = 0 THEN 'genotoxicity' WHEN c_custkey % 8 = 4 THEN 'not-needed' END AS no_adi_reason, CAST(CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 100 END AS DOUBLE) AS uncertainty,
        CASE c_custkey % 6 WHEN 1 THEN 'developmental' WHEN 2 THEN 'hepatotoxicity' WHEN 3 THEN 'systemic' WHEN 4 THEN 'not reported' WHEN 5 THEN 'novel effect' END AS toxicity,
        c_custkey % 7 <> 0 AS has_study, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no-data' WHEN 2 THEN 'positive' ELSE 'negative' END AS finding,
        CASE WHEN c_custkey % 10 = 0 THEN 'margin-of-safety' END AS no_dose_reason FROM customer
      UNION ALL SELECT 'G' || CAST(n_nationkey AS STRING), 'group', CAST(n_nationkey + 1 AS DOUBLE), NULL, CAST(100 AS DOUBLE), CASE WHEN n_nationkey % 2 = 0 THEN 'neurotoxicity' END, n_nationkey % 3 <> 0, 'negative', NULL FROM nation""",
    "iarc_v": f"""SELECT 'Agent <i>' || s_name || '</i>' AS name, CASE s_suppkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2A' WHEN 2 THEN '2B' WHEN 3 THEN '3' END AS grp, {_cas('s_suppkey * 3 + 50')} AS cas_a,
        CASE WHEN s_suppkey % 4 = 0 THEN {_cas('s_suppkey * 3 + 51')} END AS cas_b, CASE WHEN s_suppkey % 6 = 0 THEN '2025 online' ELSE CAST(1990 + s_suppkey % 30 AS STRING) END AS year FROM supplier""",
    "clp_v": f"""SELECT {_cas('s_suppkey * 5 + 51')} AS cas, CASE s_suppkey % 5 WHEN 0 THEN 'Muta. 1B Carc. 2' WHEN 1 THEN 'Repr. 1A H360' WHEN 2 THEN 'Carc 1A' WHEN 3 THEN 'Flam. Liq. 2' ELSE 'Repr. 2, Carc. 1B' END AS txt FROM supplier""",
    "manual_v": "SELECT 'en:e' || CAST(100 + n_nationkey * 3 AS STRING) AS tag, 'Manual ' || n_name AS name, '2A' AS grp FROM nation",
    "law_v": """SELECT CAST(n AS STRING) AS e, n % 3 <> 1 AS authorised, n % 3 = 1 AND n % 2 = 0 AS withdrawn, n % 4 <> 0 AS listed FROM (SELECT DISTINCT 100 + p_partkey % 400 AS n FROM part) t WHERE n % 10 <> 9""",
    "expo_v": """SELECT tag, n, CASE n % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' END AS risk, CASE WHEN n % 5 = 0 THEN 'en:children' ELSE 'en:adults' END AS mean_over,
        CASE WHEN n % 6 = 0 THEN 'en:infants' ELSE 'en:adults' END AS p95_over, n % 11 = 0 AS watched, CASE WHEN n % 3 = 0 THEN CAST(2005 + n % 15 AS STRING) || '-03-0' || CAST(1 + n % 9 AS STRING) END AS opinion_date FROM tags_v""",
    "bans_v": """SELECT 'en:e' || CAST(100 + n_nationkey * 4 AS STRING) AS tag, n_name AS jurisdiction, CASE WHEN n_nationkey % 2 = 0 THEN 'ban' ELSE 'withdrawal' END AS kind, n_nationkey % 3 = 0 AS wide, n_nationkey % 5 = 0 AS more FROM nation""",
}
_CTES = ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A source view, over the driver's tables that its text names."""
    import re

    sql, frames = VIEWS[name], {}
    for table in ("part", "customer", "nation", "supplier", "tags_v"):
        if re.search(rf"\bFROM {table}\b", sql):
            frames[table] = view(spark, sf, table) if table == "tags_v" else load(spark, sf, table)
            if (name, table) == ("items_v", "part"):
                frames[table] = dealt(frames[table], ITEM_ROWS)
            sql = re.sub(rf"\bFROM {table}\b", f"FROM {{{table}}}", sql)
    return spark.sql(sql, **frames)


def items(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c: F.array_compact(F.array(c))
    return view(spark, sf, "items_v").select(
        "item", F.col("k").alias("pos"), "name_en", one(codes.e_number(F.col("e_raw"))).alias("e_numbers"), one(codes.cas(F.col("cas_raw"))).alias("cas"))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "groups_v")


def bans(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return view(spark, sf, "bans_v").select(
        "tag", "kind", "jurisdiction", F.when(F.col("wide"), F.array("tag", F.concat("tag", F.lit("i")))).otherwise(none).alias("covers"),
        F.when(F.col("more"), F.array(F.lit("Other A"), F.lit("Other B"))).otherwise(none).alias("also"))


def iarc(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "iarc_v").select("name", F.col("grp").alias("group"), F.array_compact(F.array("cas_a", "cas_b")).alias("cas"), "year")
    return reg.iarc_records(rows)


def clp(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "clp_v").select("cas", reg.clp_classes(F.col("txt")).alias("classes")).filter(F.size("classes") > 0)
    return rows.withColumn("worst", F.array_min(F.transform("classes", lambda c: c["category"])))


def exposure(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "expo_v").select("tag", F.lit(None).cast("string").alias("e"), "risk", F.array("mean_over").alias("mean_over"), F.array("p95_over").alias("p95_over"), "watched", "opinion_date")
    return ev.exposure_rows(raw)


class Chain:
    """The evidence build up to severity, each step once per query."""

    def __init__(self, spark: SparkSession, sf: str):
        self.items, self.tags, self.subs = items(spark, sf), view(spark, sf, "tags_v"), view(spark, sf, "subs_v")
        self.links = ev.link_tags(self.items, self.tags)
        self.substances = ev.link_substances(self.items, self.links, self.subs, groups(spark, sf))
        self.oft, self.spark, self.sf = view(spark, sf, "oft_v"), spark, sf

    def wide(self) -> DataFrame:
        s, sf = self.spark, self.sf
        self.links = cut_lineage(self.links)
        self.best = ev.best_links(self.substances, self.oft)
        manual = view(s, sf, "manual_v").select("tag", "name", F.col("grp").alias("group"))
        self.classes = ev.attach_classifications(self.items, self.links, iarc(s, sf), clp(s, sf), manual)
        self.legal = ev.attach_legal(self.links, view(s, sf, "law_v"))
        self.exposed = ev.attach_exposure(self.links, exposure(s, sf))
        self.bans = bans(s, sf)
        self.item_bans = ev.attach_bans(self.links, self.bans)
        self.evidence = cut_lineage(ev.item_evidence(self.items, self.best, self.classes, self.legal, self.exposed, self.item_bans))
        return self.evidence

    def severities(self, order: str = "as_published") -> DataFrame:
        return ev.severity(self.wide(), order)

    def full(self) -> DataFrame:
        """Evidence with severity and place: what is published per item."""
        self.severity = cut_lineage(ev.positioned(self.severities()))
        return self.evidence.drop("adi").join(
            self.severity.select("item", "level", "certainty", "via", "adi", "position"), "item", "left")


# ---------------------------------------------------------------- the same chain in SQL

_LINKS = f"""{_CTES},
it AS (SELECT k, item, name_en, n, CASE k % 6 WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN n || 'i' ELSE n END AS e, CASE WHEN k % 5 <> 0 THEN {_cas('k + 50')} END AS cas FROM items_v),
lk AS (SELECT item, tag, min(r) AS r FROM (SELECT i.item, t.tag, 0 AS r FROM it i JOIN tags_v t ON t.item_ref = i.item
   UNION ALL SELECT i.item, t.tag, 1 FROM it i JOIN tags_v t ON t.e = i.e) GROUP BY item, tag)"""
_SUBS = f"""{_LINKS},
gm AS (SELECT 'G' || n_nationkey::VARCHAR AS uuid, unnest([100 + n_nationkey * 10, 101 + n_nationkey * 10, 102 + n_nationkey * 10, 103 + n_nationkey * 10, 400 + n_nationkey])::VARCHAR AS e FROM nation),
sl AS (SELECT item, uuid, min(r) AS r FROM (SELECT i.item, s.uuid, 1 AS r FROM it i JOIN subs_v s ON s.cas = i.cas
   UNION ALL SELECT i.item, g.uuid, 2 FROM it i JOIN gm g ON g.e = regexp_extract(i.e, '^([0-9]+)', 1) WHERE i.e IS NOT NULL
   UNION ALL SELECT l.item, s.uuid, 3 FROM lk l JOIN groups_v g ON g.tag = l.tag JOIN subs_v s ON s.name = g.name) GROUP BY item, uuid)"""
_BEST = f"""{_SUBS},
so AS (SELECT sl.item, CASE r WHEN 1 THEN 2 ELSE 1 END AS w, CASE r WHEN 1 THEN 'cas' WHEN 2 THEN 'e-in-name' ELSE 'manual-group' END AS via, o.* FROM sl JOIN oft_v o ON o.uuid = sl.uuid),
bv AS (SELECT * FROM (SELECT item, adi, no_adi_reason, uncertainty, uuid AS value_of, via AS value_via, row_number() OVER (PARTITION BY item ORDER BY adi IS NULL, w DESC, adi, uuid) AS rn
   FROM so WHERE adi IS NOT NULL OR no_adi_reason IS NOT NULL) WHERE rn = 1),
bc AS (SELECT * FROM (SELECT item, toxicity, uuid AS study_of, via AS study_via, row_number() OVER (PARTITION BY item ORDER BY toxicity IS NULL, w DESC, uuid) AS rn FROM so WHERE has_study) WHERE rn = 1),
bg AS (SELECT * FROM (SELECT item, finding, row_number() OVER (PARTITION BY item ORDER BY finding = 'no-data', w DESC, uuid) AS rn FROM so WHERE finding IS NOT NULL) WHERE rn = 1),
bd AS (SELECT * FROM (SELECT item, no_dose_reason, row_number() OVER (PARTITION BY item ORDER BY w DESC, uuid) AS rn FROM so WHERE no_dose_reason IS NOT NULL) WHERE rn = 1),
best AS (SELECT s.item, adi, no_adi_reason, uncertainty, value_of, value_via, toxicity, study_of, study_via, finding, no_dose_reason FROM (SELECT DISTINCT item FROM so) s
   LEFT JOIN bv ON bv.item = s.item LEFT JOIN bc ON bc.item = s.item LEFT JOIN bg ON bg.item = s.item LEFT JOIN bd ON bd.item = s.item)"""
_CLASSES = f"""{_BEST},
ir AS (SELECT regexp_replace(name, '<[^>]+>', '', 'g') AS name, grp, unnest([cas_a, cas_b]) AS cas FROM iarc_v WHERE grp IS NOT NULL),
ic AS (SELECT * FROM (SELECT i.item, ir.name, ir.grp, row_number() OVER (PARTITION BY i.item ORDER BY ir.name, ir.grp) AS rn FROM it i JOIN ir ON ir.cas = i.cas) WHERE rn = 1),
im AS (SELECT * FROM (SELECT l.item, m.name, m.grp, row_number() OVER (PARTITION BY l.item ORDER BY m.name) AS rn FROM lk l JOIN manual_v m ON m.tag = l.tag) WHERE rn = 1),
cp AS (SELECT cas, CASE substr(txt, 1, 6) WHEN 'Muta. ' THEN 'Carc. 2, Muta. 1B' WHEN 'Repr. ' THEN CASE WHEN txt LIKE '%360' THEN 'Repr. 1A' ELSE 'Carc. 1B, Repr. 2' END WHEN 'Carc 1' THEN 'Carc. 1A' END AS codes FROM clp_v WHERE txt NOT LIKE 'Flam%'),
cc AS (SELECT i.item, cp.cas AS clp_cas, codes FROM it i JOIN cp ON cp.cas = i.cas),
cl AS (SELECT i.item, coalesce(ic.grp, im.grp) AS iarc_group, coalesce(ic.name, im.name) AS iarc_name, CASE WHEN ic.item IS NOT NULL THEN 'cas' WHEN im.item IS NOT NULL THEN 'manual' END AS iarc_via, clp_cas, codes,
   CASE WHEN codes LIKE '%1A%' THEN '1A' WHEN codes LIKE '%1B%' THEN '1B' WHEN codes IS NOT NULL THEN '2' END AS clp_worst FROM it i LEFT JOIN ic ON ic.item = i.item LEFT JOIN im ON im.item = i.item LEFT JOIN cc ON cc.item = i.item
   WHERE ic.item IS NOT NULL OR im.item IS NOT NULL OR cc.item IS NOT NULL),
lt AS (SELECT * FROM (SELECT item, tag, row_number() OVER (PARTITION BY item ORDER BY r, tag) AS rn FROM lk) WHERE rn = 1),
lg AS (SELECT lt.item, substr(lt.tag, 5) AS e, coalesce(authorised, false) AS authorised, coalesce(withdrawn, false) AS withdrawn, coalesce(listed, false) AS listed, l.e IS NULL AS absent FROM lt LEFT JOIN law_v l ON l.e = substr(lt.tag, 5)),
ex AS (SELECT tag, substr(tag, 5) AS e, risk, mean_over, concat_ws('|', CASE WHEN n % 5 = 0 THEN 'en:children' END, CASE WHEN n % 6 = 0 THEN 'en:infants' END) AS vulnerable, watched, opinion_date FROM expo_v),
ib AS (SELECT l.item, b.tag, b.kind, b.jurisdiction, b.wide, b.more FROM lk l JOIN bans_v b ON b.tag = l.tag)"""


def _severity_sql(strict: bool) -> str:
    """Class chosen per code list, then the order of precedence."""
    first = ("CASE codes WHEN 'Carc. 2, Muta. 1B' THEN '1B' ELSE" if strict else "CASE codes WHEN 'Carc. 2, Muta. 1B' THEN '2' ELSE")
    beats = "(clv = 1 AND cs > isg)" if strict else "cs > isg"
    adi = "adi" if strict else "nullif(adi, 0)"
    return f"""{_CLASSES},
w1 AS (SELECT i.item, i.k AS pos, b.* EXCLUDE (item), c.* EXCLUDE (item), CASE WHEN codes = 'Repr. 1A' THEN 2 WHEN codes IS NOT NULL THEN 1 END AS clv,
   {first} CASE codes WHEN 'Repr. 1A' THEN '1A' WHEN 'Carc. 1A' THEN '1A' WHEN 'Carc. 1B, Repr. 2' THEN '1B' END END AS ccat,
   CASE iarc_group WHEN '1' THEN 'confirmed' WHEN '2A' THEN 'probable' WHEN '2B' THEN 'possible' END AS icert,
   CASE toxicity WHEN 'developmental' THEN 2 WHEN 'neurotoxicity' THEN 4 WHEN 'hepatotoxicity' THEN 5 WHEN 'systemic' THEN 7 END AS elv FROM it i LEFT JOIN best b ON b.item = i.item LEFT JOIN cl c ON c.item = i.item),
w2 AS (SELECT *, CASE ccat WHEN '1A' THEN 'confirmed' WHEN '1B' THEN 'probable' WHEN '2' THEN 'possible' END AS ccert, CASE ccat WHEN '1A' THEN 3 WHEN '1B' THEN 2 WHEN '2' THEN 1 END AS cs,
   CASE icert WHEN 'confirmed' THEN 3 WHEN 'probable' THEN 2 WHEN 'possible' THEN 1 END AS isg FROM w1),
w3 AS (SELECT *, CASE WHEN clv IS NOT NULL AND (icert IS NULL OR {beats}) THEN 'clp' WHEN icert IS NOT NULL THEN 'iarc' WHEN no_adi_reason = 'genotoxicity' THEN 'no-intake-genotoxicity' WHEN elv IS NOT NULL THEN 'critical-effect' END AS sev_via FROM w2),
sv AS (SELECT item, pos, CASE sev_via WHEN 'clp' THEN clv WHEN 'critical-effect' THEN elv ELSE 1 END AS level, CASE sev_via WHEN 'clp' THEN ccert WHEN 'iarc' THEN icert WHEN 'critical-effect' THEN 'established' ELSE 'probable' END AS certainty, sev_via AS via,
   CASE sev_via WHEN 'clp' THEN 'CLP ' || codes WHEN 'iarc' THEN 'IARC group ' || iarc_group WHEN 'critical-effect' THEN toxicity ELSE 'genotoxicity' END AS detail,
   CASE sev_via WHEN 'clp' THEN clp_cas WHEN 'iarc' THEN iarc_name WHEN 'critical-effect' THEN coalesce(study_of, value_of) ELSE value_of END AS origin, CASE WHEN sev_via <> 'critical-effect' THEN elv END AS also_level,
   CASE WHEN clv IS NOT NULL AND ((icert IS NOT NULL AND cs <> isg) OR (iarc_group IS NOT NULL AND icert IS NULL)) THEN 'IARC group ' || iarc_group || ' vs CLP ' || codes END AS disagreement,
   CASE WHEN icert IS NOT NULL AND clv IS NULL THEN 'iarc-only' WHEN clv IS NOT NULL AND iarc_group IS NULL THEN 'clp-only' END AS single_source, {adi} AS adi FROM w3 WHERE sev_via IS NOT NULL)"""


_SEVERITY = _severity_sql(False)
_POSITION = f"""{_SEVERITY},
ps AS (SELECT item, floor(100 * (rank() OVER (PARTITION BY level ORDER BY adi) - 1)::DOUBLE / (count(*) OVER (PARTITION BY level) - 1) + 0.5) / 100 AS position, min(adi) OVER (PARTITION BY level) AS level_min, max(adi) OVER (PARTITION BY level) AS level_max
   FROM sv WHERE adi IS NOT NULL QUALIFY count(*) OVER (PARTITION BY level) > 1)"""
_SLICE = f"""{_POSITION},
xp AS (SELECT lt.item, x.risk, x.vulnerable, x.watched FROM lt JOIN ex x ON x.tag = lt.tag),
bn AS (SELECT item, bool_or(kind = 'ban') AS banned FROM ib GROUP BY item),
ew AS (SELECT i.item, i.k AS pos, sv.level, sv.certainty, sv.via, sv.adi, ps.position, b.uncertainty, b.no_adi_reason, b.toxicity, b.no_dose_reason, c.iarc_group, c.iarc_via, c.clp_worst, b.value_via, b.study_via, l.authorised, l.withdrawn, l.listed, l.absent, x.risk, x.vulnerable, x.watched, coalesce(n.banned, false) AS banned
  FROM it i LEFT JOIN sv ON sv.item = i.item LEFT JOIN ps ON ps.item = i.item LEFT JOIN best b ON b.item = i.item LEFT JOIN cl c ON c.item = i.item LEFT JOIN lg l ON l.item = i.item LEFT JOIN xp x ON x.item = i.item LEFT JOIN bn n ON n.item = i.item),
pt AS (SELECT *, (level IS NOT NULL)::INT * 8 + banned::INT * 8 + (adi IS NOT NULL OR no_adi_reason IS NOT NULL)::INT * 2 + (toxicity IS NOT NULL)::INT + (iarc_group IS NOT NULL)::INT * 2 + (clp_worst IS NOT NULL)::INT * 2
   + coalesce(authorised OR withdrawn OR listed, false)::INT * 2 + (risk IS NOT NULL)::INT + coalesce(vulnerable <> '', false)::INT AS points FROM ew),
sc AS (SELECT * FROM (SELECT l.tag, pt.*, row_number() OVER (PARTITION BY l.tag ORDER BY points DESC, pos) AS rn FROM lk l JOIN pt ON pt.item = l.item) WHERE rn = 1),
tb AS (SELECT DISTINCT tag, kind, jurisdiction FROM (SELECT t AS tag, kind, unnest(CASE WHEN more THEN [jurisdiction, 'Other A', 'Other B'] ELSE [jurisdiction] END) AS jurisdiction
   FROM (SELECT *, unnest(CASE WHEN wide THEN [tag, tag || 'i'] ELSE [tag] END) AS t FROM bans_v)) WHERE tag IN (SELECT tag FROM sc))"""


# ---------------------------------------------------------------- queries

@query("item_tag_links", f"WITH {_LINKS} SELECT item, tag, CASE r WHEN 0 THEN 'item' ELSE 'e-number' END AS via FROM lk")
def item_tag_links(spark: SparkSession, sf: str) -> DataFrame:
    return ev.link_tags(items(spark, sf), view(spark, sf, "tags_v"))


@query("item_substance_links", f"WITH {_SUBS} SELECT item, uuid, CASE r WHEN 1 THEN 'cas' WHEN 2 THEN 'e-in-name' ELSE 'manual-group' END AS via FROM sl")
def item_substance_links(spark: SparkSession, sf: str) -> DataFrame:
    return Chain(spark, sf).substances


@query("link_reviews", f"""WITH {_SUBS}, nt AS (SELECT l.item, l.tag, l.r, t.e AS te, t.name_en FROM lk l JOIN tags_v t ON t.tag = l.tag),
lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY r, tag) AS rn FROM nt) WHERE rn = 1),
df AS (SELECT nt.item, bool_or(i.e IS NOT NULL AND i.e <> te) AS differs FROM nt JOIN it i ON i.item = nt.item WHERE r = 0 GROUP BY nt.item),
al AS (SELECT sl.item, count(*) AS n, bool_or(lead.item IS NULL OR list_has_any(string_split(lower(lead.name_en), ' '), string_split(regexp_replace(lower(s.name), '[^a-z0-9]+', ' ', 'g'), ' '))) AS alike
   FROM sl JOIN subs_v s ON s.uuid = sl.uuid LEFT JOIN lead ON lead.item = sl.item GROUP BY sl.item),
f AS (SELECT i.item, concat_ws(',', CASE WHEN i.cas IS NULL THEN 'no-cas' END, CASE WHEN NOT coalesce(alike, true) THEN 'names-differ' END, CASE WHEN coalesce(differs, false) THEN 'number-differs' END, CASE WHEN coalesce(al.n, 0) > 1 THEN 'several-substances' END) AS review
  FROM it i LEFT JOIN df ON df.item = i.item LEFT JOIN al ON al.item = i.item)
SELECT item, review FROM f WHERE review <> ''""")
def link_reviews(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    return ev.review_flags(c.items, c.links, c.tags, c.substances, c.subs)


@query("best_links", f"WITH {_BEST} SELECT item, adi, no_adi_reason, value_of, value_via, toxicity, study_of, finding, no_dose_reason FROM best")
def best_links(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    return ev.best_links(c.substances, c.oft).select("item", "adi", "no_adi_reason", "value_of", "value_via", "toxicity", "study_of", "finding", "no_dose_reason")


@query("identity_bridge", f"""WITH {_LINKS}, pe AS (SELECT e, arg_min(item_ref, tag) FILTER (item_ref IS NOT NULL) AS own, count(*) AS tags FROM tags_v GROUP BY e),
b0 AS (SELECT e, arg_min(item, k) AS found FROM it WHERE e IS NOT NULL GROUP BY e),
bn AS (SELECT pe.e, coalesce(x.found, y.found) AS found FROM pe LEFT JOIN b0 x ON x.e = pe.e LEFT JOIN b0 y ON y.e = regexp_extract(pe.e, '^([0-9]+)', 1))
SELECT pe.e, tags, CASE WHEN i.cas IS NOT NULL THEN own ELSE found END AS item, CASE WHEN i.cas IS NOT NULL THEN 'tag' WHEN found IS NOT NULL THEN 'e-number' END AS via, coalesce(own <> found, false) AS differs
FROM pe LEFT JOIN bn ON bn.e = pe.e LEFT JOIN it i ON i.item = pe.own""")
def identity_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return ev.identity_bridge(view(spark, sf, "tags_v"), items(spark, sf))


_FAMILIES = f"""{_BEST},
fm AS (SELECT n::VARCHAR AS number, 'en:e' || n::VARCHAR AS family, tag AS member FROM tags_v WHERE tag LIKE '%i'),
tv AS (SELECT x.tag, b.adi, b.toxicity, (b.adi IS NOT NULL OR b.toxicity IS NOT NULL) AS has_data FROM (SELECT * FROM (SELECT tag, item, row_number() OVER (PARTITION BY tag ORDER BY r, item) AS rn FROM lk) WHERE rn = 1) x LEFT JOIN best b ON b.item = x.item)"""


@query("family_stats", f"""WITH {_FAMILIES} SELECT number, fm.family, count(*) AS members, count(*) FILTER (m.has_data) AS with_data, count(DISTINCT m.adi) AS intakes, count(DISTINCT m.toxicity) AS effects,
  coalesce(bool_or(o.has_data), false) AS own_data, NOT coalesce(bool_or(o.has_data), false) AND (count(DISTINCT m.adi) > 1 OR count(DISTINCT m.toxicity) > 1) AS disagree
FROM fm LEFT JOIN tv m ON m.tag = fm.member LEFT JOIN tv o ON o.tag = fm.family GROUP BY number, fm.family""")
def family_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    values = ev.tag_values(c.links, ev.best_links(c.substances, c.oft))
    return ev.family_stats(ev.families(c.tags), values)


@query("inherited_values", f"""WITH {_FAMILIES} SELECT family, arg_min(member, member) AS inherited_from, arg_min(m.adi, member) AS adi FROM fm JOIN tv m ON m.tag = fm.member
  WHERE m.adi IS NOT NULL AND family NOT IN (SELECT tag FROM tv WHERE has_data) GROUP BY family""")
def inherited_values(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    return ev.inherit_family(ev.families(c.tags), ev.tag_values(c.links, ev.best_links(c.substances, c.oft)))


@query("legal_states", f"WITH {_CLASSES} SELECT item, e, authorised, withdrawn, listed, absent FROM lg")
def legal_states(spark: SparkSession, sf: str) -> DataFrame:
    return ev.attach_legal(Chain(spark, sf).links, view(spark, sf, "law_v"))


@query("classifications", f"WITH {_CLASSES} SELECT item, iarc_group, iarc_name, iarc_via, clp_cas, codes, clp_worst FROM cl")
def classifications(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    c.wide()
    return c.classes.withColumn("codes", F.array_join(F.transform("clp_classes", lambda x: x["code"]), ", ")).drop("clp_classes")


@query("exposure_facts", f"""WITH {_CLASSES} SELECT tag, e, risk, mean_over, vulnerable, watched, opinion_date FROM ex""")
def exposure_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = exposure(spark, sf)
    return rows.select("tag", "e", "risk", F.array_join("mean_over", "|").alias("mean_over"), F.array_join("vulnerable", "|").alias("vulnerable"), "watched", "opinion_date")


@query("opinions_by_year", f"WITH {_CLASSES} SELECT substr(opinion_date, 1, 4) AS year, count(*) AS opinions, count(*) FILTER (vulnerable <> '') AS with_vulnerable FROM ex WHERE opinion_date IS NOT NULL GROUP BY 1")
def opinions_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return ev.opinions_by_year(exposure(spark, sf))


@query("item_bans", f"""WITH {_CLASSES}, t AS (SELECT item, list_sort(list(tag)) AS tags FROM lk GROUP BY item)
SELECT ib.item, ib.tag, kind, jurisdiction, CASE WHEN wide THEN ib.tag || ',' || ib.tag || 'i' ELSE ib.tag END AS covers,
  array_to_string([x FOR x IN tags IF x <> ib.tag AND NOT (wide AND x = ib.tag || 'i')], ',') AS not_covers, kind = 'ban' AS penalises FROM ib JOIN t ON t.item = ib.item""")
def item_bans(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.attach_bans(Chain(spark, sf).links, bans(spark, sf))
    return rows.withColumn("covers", F.array_join("covers", ",")).withColumn("not_covers", F.array_join("not_covers", ","))


@query("penalising_bans", f"WITH {_CTES} SELECT tag, jurisdiction FROM bans_v WHERE kind = 'ban'")
def penalising_bans(spark: SparkSession, sf: str) -> DataFrame:
    return ev.penalising(bans(spark, sf)).select("tag", "jurisdiction")


@query("ban_jurisdictions", f"""WITH {_CTES} SELECT tag, kind, jurisdiction, true AS main FROM bans_v UNION ALL SELECT tag, kind, unnest(['Other A', 'Other B']), false FROM bans_v WHERE more""")
def ban_jurisdictions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.flatten_jurisdictions(bans(spark, sf))


_SEV = ["item", "level", "certainty", "via", "detail", "origin", "also_level", "disagreement", "single_source", "adi"]


@query("severity", f"WITH {_SEVERITY} SELECT {', '.join(_SEV)} FROM sv")
def severity(spark: SparkSession, sf: str) -> DataFrame:
    return Chain(spark, sf).severities().select(*_SEV)


@query("severity_strict", f"WITH {_severity_sql(True)} SELECT {', '.join(_SEV)} FROM sv")
def severity_strict(spark: SparkSession, sf: str) -> DataFrame:
    return Chain(spark, sf).severities("strict").select(*_SEV)


@query("severity_positions", f"WITH {_POSITION} SELECT sv.item, level, adi, position, level_min, level_max FROM sv LEFT JOIN ps ON ps.item = sv.item")
def severity_positions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.positioned(Chain(spark, sf).severities()).select("item", "level", "adi", "position", "level_min", "level_max")


@query("severity_report", f"WITH {_SEVERITY} SELECT level, certainty, count(*) AS items, count(disagreement) AS disagreements, count(single_source) AS single_source FROM sv GROUP BY ROLLUP (level, certainty)")
def severity_report(spark: SparkSession, sf: str) -> DataFrame:
    return ev.severity_report(Chain(spark, sf).severities())


@query("unmapped_effects", f"WITH {_BEST} SELECT toxicity, count(*) AS items FROM best WHERE toxicity = 'novel effect' GROUP BY toxicity")
def unmapped_effects(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    return ev.unmapped_effects(ev.best_links(c.substances, c.oft))


@query("tag_claims", f"WITH {_LINKS} SELECT item, tag, (count(*) OVER (PARTITION BY tag))::INT AS claims FROM lk")
def tag_claims(spark: SparkSession, sf: str) -> DataFrame:
    return ev.claims_per_tag(Chain(spark, sf).links).select("item", "tag", "claims")


_SLICE_COLUMNS = ["tag", "item", "level", "certainty", "via", "adi", "position", "no_margin", "toxicity", "no_dose_reason", "iarc", "clp", "legal", "withdrawn", "risk", "watched", "banned"]


@query("resolved_additives", f"""WITH {_SLICE} SELECT tag, item, level, certainty, via, adi, position, coalesce(uncertainty <= 1, false) AS no_margin, toxicity, no_dose_reason, iarc_group AS iarc, clp_worst AS clp,
  CASE WHEN absent THEN 'absent' WHEN authorised THEN 'yes' WHEN absent IS NOT NULL THEN 'no' END AS legal, coalesce(withdrawn, false) AS withdrawn, risk, coalesce(watched, false) AS watched, banned FROM sc""")
def resolved_additives(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    full = c.full()
    return ev.resolved_slice(c.links, full, c.bans)[0].select(*_SLICE_COLUMNS)


@query("resolved_bans", f"WITH {_SLICE} SELECT tag, kind, jurisdiction, kind = 'ban' AS penalises FROM tb")
def resolved_bans(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    return ev.resolved_slice(c.links, c.full(), c.bans)[1].distinct()


@query("enriched_taxonomy", f"""WITH {_SLICE}, tx AS (SELECT DISTINCT tag, name_en FROM tags_v WHERE n % 5 <> 0)
SELECT tx.tag, name_en AS name, sc.level, sc.adi, coalesce(j.js, '') AS jurisdictions, coalesce(j.js, '') <> '' AS banned FROM tx LEFT JOIN sc ON sc.tag = tx.tag
LEFT JOIN (SELECT tag, string_agg(jurisdiction, ',' ORDER BY jurisdiction) AS js FROM tb WHERE kind = 'ban' GROUP BY tag) j ON j.tag = tx.tag""")
def enriched_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    slice_, tag_bans = ev.resolved_slice(c.links, c.full(), c.bans)
    taxonomy = c.tags.filter(F.col("n") % 5 != 0).select("tag", F.col("name_en").alias("name")).distinct()
    rows, _ = ev.enrich_taxonomy(taxonomy, slice_.drop("banned"))
    named = ev.collect_bans(taxonomy, tag_bans)
    return rows.join(named, "tag").select("tag", "name", "level", "adi", F.coalesce(F.array_join("jurisdictions", ","), F.lit("")).alias("jurisdictions"), "banned")


@query("unknown_hazard_tags", f"WITH {_SLICE} SELECT sc.tag FROM sc WHERE tag NOT IN (SELECT tag FROM tags_v WHERE n % 5 <> 0)")
def unknown_hazard_tags(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    slice_, _ = ev.resolved_slice(c.links, c.full(), c.bans)
    return ev.enrich_taxonomy(c.tags.filter(F.col("n") % 5 != 0).select("tag").distinct(), slice_)[1]


@query("compacted_taxonomy", f"""WITH {_CTES} SELECT tag, n::VARCHAR AS e, CASE WHEN n % 2 = 0 THEN 'Aditivo ' ELSE 'Additive ' END || n::VARCHAR AS name, 'en:colour,en:acid' AS classes,
  CASE n % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'no' END AS risk, n % 6 = 0 AS watched FROM tags_v""")
def compacted_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Taxonomy as multilingual JSON objects keyed by tag, read back and compacted."""
    n, s = F.col("n"), F.col("n").cast("string")
    leaf = lambda c, lang="en": F.create_map(F.lit(lang), c)
    entry = F.create_map(
        F.lit("e_number"), leaf(s), F.lit("name"), F.when(n % 2 == 0, F.create_map(F.lit("en"), F.concat(F.lit("Additive "), s), F.lit("es"), F.concat(F.lit("Aditivo "), s)))
        .otherwise(leaf(F.concat(F.lit("Additive "), s))), F.lit("additives_classes"), leaf(F.lit("en:colour, en:acid")),
        F.lit("efsa_evaluation_overexposure_risk"), leaf(F.when(n % 4 == 0, "en:high").when(n % 4 == 1, "en:moderate").when(n % 4 == 2, "en:no").otherwise("en:other"), "xx"),
        F.lit("anses_additives_of_interest"), leaf(F.when(n % 6 == 0, "yes").otherwise("no")))
    lines = view(spark, sf, "tags_v").select(F.to_json(F.create_map("tag", entry)).alias("value"))
    rows = ev.compact_taxonomy(reg.taxonomy_entries(lines))
    return rows.select("tag", "e", "name", F.array_join("classes", ",").alias("classes"), "risk", "watched")


@query("taxonomy_file", """SELECT 'en:p' || p_partkey::VARCHAR AS tag, 'E' || (p_partkey % 900)::VARCHAR AS e, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' }"{[' ELSE p_name END AS name,
   'en:colour,en:acid' AS classes, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'no' END AS risk, p_partkey % 6 = 0 AS watched FROM part""")
def taxonomy_file(spark: SparkSession, sf: str) -> DataFrame:
    """A taxonomy that is one large JSON object in one file, read in parts; names hold quotes and brackets."""
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    leaf = lambda c, lang="en": F.create_map(F.lit(lang), c)
    name = F.when(k % 2 == 0, F.concat("p_name", F.lit(' }"{['))).otherwise(F.col("p_name"))
    entry = F.create_map(
        F.lit("e_number"), leaf(F.concat(F.lit("E"), (k % 900).cast("string"))), F.lit("name"), F.create_map(F.lit("es"), name, F.lit("en"), F.lit("other {")),
        F.lit("additives_classes"), leaf(F.lit("en:colour, en:acid")),
        F.lit("efsa_evaluation_overexposure_risk"), leaf(F.when(k % 4 == 0, "en:high").when(k % 4 == 1, "en:moderate").when(k % 4 == 2, "en:no").otherwise("en:other"), "xx"),
        F.lit("anses_additives_of_interest"), leaf(F.when(k % 6 == 0, "yes").otherwise("no")))
    body = F.to_json(F.create_map(F.concat(F.lit("en:p"), s), entry))
    part = load(spark, sf, "part")
    first = part.agg(F.min(k).alias("_first"))
    # Entry lines of one object: the first opens it, the others go on, a last line closes it.
    lines = part.crossJoin(F.broadcast(first)).select(k.alias("n"), F.concat(F.when(k == F.col("_first"), "{").otherwise(", "), F.substring(body, 2, 1 << 30)).alias("value"))
    lines = lines.withColumn("value", F.expr("left(value, length(value) - 1)")).unionByName(first.select(F.lit(1 << 60).alias("n"), F.lit("}").alias("value")))
    path = f"{checkpoint_root(spark)}/taxonomy-{uuid.uuid4().hex}"
    lines.orderBy("n").coalesce(1).select("value").write.text(path)
    rows = ev.compact_taxonomy(reg.read_taxonomy(spark, path))
    return rows.select("tag", "e", "name", F.array_join("classes", ",").alias("classes"), "risk", "watched")


@query("source_audit", f"""WITH {_CLASSES}, u AS (SELECT cas FROM cp UNION SELECT cas FROM clp_v), h AS (SELECT i.item, i.cas IS NOT NULL AS has_cas, i.cas IN (SELECT cas FROM u) AS held, i.item IN (SELECT item FROM cl WHERE clp_cas IS NOT NULL) AS linked FROM it i),
g AS (SELECT has_cas, coalesce(held, false) AS held, linked FROM h)
SELECT count(*) AS items, count(*) FILTER (has_cas) AS with_cas, count(*) FILTER (held) AS in_source, count(*) FILTER (has_cas AND NOT held) AS not_in_source, count(*) FILTER (linked) AS linked,
  count(*) FILTER (held AND NOT linked) AS lost, count(*) FILTER (linked AND NOT held) AS linked_otherwise FROM g""")
def source_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = Chain(spark, sf)
    c.wide()
    return ev.audit_source(c.items, view(spark, sf, "clp_v"), c.classes.filter("clp_cas IS NOT NULL"))


@query("lost_items", f"""WITH {_CLASSES}, u AS (SELECT cas FROM cp UNION SELECT cas FROM clp_v)
SELECT DISTINCT i.item FROM it i WHERE i.cas IN (SELECT cas FROM u) AND i.item NOT IN (SELECT item FROM cl WHERE clp_cas IS NOT NULL AND item::VARCHAR NOT LIKE '%3')""")
def lost_items(spark: SparkSession, sf: str) -> DataFrame:
    """As if the links of some items had been forgotten."""
    c = Chain(spark, sf)
    c.wide()
    linked = c.classes.filter("clp_cas IS NOT NULL AND CAST(item AS STRING) NOT LIKE '%3'")
    return ev.lost_items(c.items, view(spark, sf, "clp_v"), linked)


@query("audit_without_cas", f"""WITH {_SUBS}, b AS (SELECT * FROM it WHERE cas IS NULL), rt AS (SELECT item, regexp_extract(e, '^([0-9]+)', 1) AS e FROM b WHERE e IS NOT NULL),
sib AS (SELECT DISTINCT regexp_extract(e, '^([0-9]+)', 1) AS e FROM it WHERE cas IN (SELECT cas FROM subs_v) AND e IS NOT NULL),
f AS (SELECT b.item, b.item IN (SELECT item FROM rt JOIN gm ON gm.e = rt.e) AS by_e, b.item IN (SELECT item FROM rt JOIN sib ON sib.e = rt.e) AS by_family FROM b)
SELECT count(*) AS without_cas, count(*) FILTER (by_e) AS by_e, count(*) FILTER (by_family) AS by_family, 0::BIGINT AS by_name, 0::BIGINT AS only_by_name, count(*) FILTER (NOT by_e AND NOT by_family) AS by_none FROM f""")
def audit_without_cas(spark: SparkSession, sf: str) -> DataFrame:
    return ev.audit_without_cas(items(spark, sf), view(spark, sf, "subs_v"))


_OPINIONS = """fx AS (SELECT o_orderkey AS pos, 'S' || o_custkey::VARCHAR AS substance, 'D' || o_custkey::VARCHAR || '-' || (o_orderkey % 3)::VARCHAR AS opinion, o_orderkey AS k FROM orders)"""


def flex(spark: SparkSession, sf: str) -> DataFrame:
    """One reference-value sheet per order: the customer is the substance, three opinions each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = lambda *arms: F.coalesce(*[F.when(test, F.lit(v)) for test, v in arms])
    return load(spark, sf, "orders").select(
        k.alias("pos"), F.concat(F.lit("S"), c).alias("substance"), F.concat(F.lit("D"), c, F.lit("-"), (k % 3).cast("string")).alias("opinion"),
        F.concat(F.lit("doc"), k.cast("string")).alias("doc"), F.when(k % 4 == 0, (k % 90) / 10.0).alias("adi"), F.lit("mg/kg").alias("unit"),
        F.when(k % 4 == 1, "1").alias("no_allocated"), text((k % 8 == 1, "Genotoxic concern"), (k % 8 == 5, "Not deemed necessary.")).alias("justification"),
        text((k % 6 == 0, "Assessment: no concern; Remarks: x"), (k % 6 == 1, "Assessment: Some concern. More")).alias("comments"), F.when(k % 5 == 0, 1.0).otherwise(100.0).alias("uncertainty"),
        F.when(k % 4 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("critical_id"), F.when(k % 4 == 2, "Margin of safety (x)").alias("other_type"),
        F.when(k % 4 == 2, (k % 70).cast("double")).alias("other_value"), text((k % 9 == 0, "Assessment: low concern; y")).alias("other_comments"), F.lit(None).cast("string").alias("other_critical"))


@query("substance_dimension", """SELECT 'S' || c_custkey::VARCHAR AS uuid, c_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey + 50)::VARCHAR || '-00-0' END AS cas, 'P' || s_suppkey::VARCHAR AS param_code
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 97""")
def substance_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Substances with the identity of their reference substance, where it has one."""
    k, r = F.col("c_custkey"), F.col("s_suppkey")
    subs = load(spark, sf, "customer").select(F.concat(F.lit("S"), k.cast("string")).alias("uuid"), F.col("c_name").alias("name"), F.concat(F.lit("R"), (k % 97).cast("string")).alias("ref"))
    refs = load(spark, sf, "supplier").select(F.concat(F.lit("R"), r.cast("string")).alias("uuid"), F.concat(F.lit("P"), r.cast("string")).alias("param_code"),
                                              F.when(r % 3 == 0, " ").otherwise(F.concat(F.lit(" "), (r + 50).cast("string"), F.lit("-00-0 "))).alias("cas"))
    return tox.substances(subs, refs)


@query("landed_collections", """SELECT 'supplier' AS collection, s_suppkey::VARCHAR AS key, s_name AS name, round(s_acctbal, 2) AS amount FROM supplier
UNION ALL SELECT 'customer', c_custkey::VARCHAR, CASE WHEN c_custkey % 5 <> 0 THEN c_name END, NULL FROM customer""")
def landed_collections(spark: SparkSession, sf: str) -> DataFrame:
    """Collections that landed as JSON lines, each read with its own schema."""
    folder = f"{checkpoint_root(spark)}/collections-{uuid.uuid4().hex}"
    load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"), F.lit("x").alias("other")).write.json(f"{folder}/supplier.jsonl")
    load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name")).write.json(f"{folder}/customer.jsonl")
    found = reg.read_jsonl(spark, folder, {"supplier": "id string, name string, balance double", "customer": "id string, name string, balance double"})
    parts = [df.select(F.lit(name).alias("collection"), F.col("id").alias("key"), "name", F.col("balance").alias("amount")) for name, df in found.items()]
    return parts[0].unionByName(parts[1])


@query("manual_decisions", "SELECT s_suppkey::VARCHAR AS tag, 'checked ' || s_name AS reason FROM supplier")
def manual_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Curated files, one a nation, each one JSON object over several lines with its list of decisions."""
    folder = f"{checkpoint_root(spark)}/manual-{uuid.uuid4().hex}"
    rows = F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("tag"), F.concat(F.lit("checked "), "s_name").alias("reason")))
    files = load(spark, sf, "supplier").groupBy("s_nationkey").agg(rows.alias("decisions")).withColumn("why", F.lit("by hand"))
    text = F.to_json(F.struct("why", "decisions"), {"pretty": "true"})
    files.select("s_nationkey", text.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(folder)
    return reg.read_manual(spark, f"{folder}/*", "decisions").select("tag", "reason")


@query("protective_intakes", f"""WITH {_OPINIONS}, i AS (SELECT *, CASE WHEN k % 4 = 0 THEN (k % 90) / 10.0::DOUBLE END AS adi FROM fx WHERE (k % 4 = 0 AND k % 90 <> 0) OR k % 4 = 1)
SELECT substance, adi, CASE WHEN k % 8 = 1 THEN 'genotoxicity' WHEN k % 8 = 5 THEN 'not-needed' END AS no_adi_reason, k % 5 = 0 AS no_margin FROM i QUALIFY row_number() OVER (PARTITION BY substance ORDER BY adi IS NULL, adi, pos) = 1""")
def protective_intakes(spark: SparkSession, sf: str) -> DataFrame:
    best = tox.most_protective(tox.reference_values(flex(spark, sf))[0])
    return best.select("substance", "adi", "no_adi_reason").join(tox.no_margin(best), "substance")


@query("other_values", f"WITH {_OPINIONS} SELECT substance, pos, 'margin-of-safety' AS no_dose_reason, (k % 70)::DOUBLE AS value FROM fx WHERE k % 4 = 2 UNION ALL SELECT substance, pos, NULL, NULL FROM fx WHERE k % 4 IN (0, 3) AND k % 9 = 0 AND (k % 4 = 3 OR k % 90 = 0)")
def other_values(spark: SparkSession, sf: str) -> DataFrame:
    return tox.reference_values(flex(spark, sf))[1].select("substance", "pos", "no_dose_reason", "value")


_CONCLUSIONS = f"""{_OPINIONS}, cx AS (SELECT substance, opinion, arg_min(CASE WHEN k % 4 = 0 THEN (k % 90) / 10.0::DOUBLE END, pos) AS adi, arg_min(CASE WHEN k % 8 = 1 THEN 'genotoxicity' WHEN k % 8 = 5 THEN 'not-needed' END, pos) AS no_adi_reason,
   CASE max(CASE WHEN k % 6 = 1 THEN 5 WHEN k % 9 = 0 THEN 4 WHEN k % 6 = 0 THEN 3 END) WHEN 5 THEN 'some-concern' WHEN 4 THEN 'low-concern' WHEN 3 THEN 'no-concern' END AS assessment FROM fx GROUP BY substance, opinion)"""


@query("opinion_conclusions", f"WITH {_CONCLUSIONS} SELECT substance, opinion, adi, no_adi_reason, assessment FROM cx")
def opinion_conclusions(spark: SparkSession, sf: str) -> DataFrame:
    return tox.reference_values(flex(spark, sf))[2]


@query("critical_studies", f"""WITH {_OPINIONS} SELECT substance, 'T' || k::VARCHAR AS study, CASE k % 3 WHEN 0 THEN 'hepatotoxicity' WHEN 1 THEN 'systemic' END AS toxicity, CASE WHEN k % 3 = 0 THEN 'liver weight' END AS effect, k % 3 = 0 AS useful
FROM fx WHERE k % 4 = 0 AND k % 90 <> 0 QUALIFY row_number() OVER (PARTITION BY substance ORDER BY pos) = 1""")
def critical_studies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    studies = load(spark, sf, "orders").select(
        F.concat(F.lit("T"), k.cast("string")).alias("study"), F.lit("rat").alias("species"), (k % 10).cast("double").alias("dose"),
        F.array_compact(F.array(F.lit("nothing"), F.when(k % 3 == 0, "Toxicity: hepatotoxicity; Effect desc.: liver weight").when(k % 3 == 1, " Toxicity: systemic"))).alias("remarks"))
    values = tox.reference_values(flex(spark, sf))[0]
    return tox.critical_studies(studies, values).select("substance", "study", "toxicity", "effect", "useful")


def _findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("pos")
    said = (F.when(k % 7 == 0, "Genotoxic: Positive in vitro; Mutagenic: Negative").when(k % 7 == 1, "Carcinogenic: Ambiguous")
            .when(k % 7 == 2, "Genotoxic: No data\nCarcinogenic: Not determined QSAR").when(k % 7 == 3, "Mutagenic: Negative; Other: Positive"))
    rows = flex(spark, sf).withColumn("information", said)
    dims = tox.opinions(load(spark, sf, "orders").select(
        F.concat(F.lit("D"), F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 3).cast("string")).alias("opinion"), F.col("o_orderkey").alias("k"), F.col("o_custkey")
    ).groupBy("opinion").agg(F.min("k").alias("k")).select(
        "opinion", F.when(F.col("k") % 3 != 0, F.concat(F.lit("20"), F.lpad((F.col("k") % 20).cast("string"), 2, "0"), F.lit("-05-01T00:00"))).alias("date"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("sent on 19"), F.lpad((F.col("k") % 90 + 10).cast("string"), 2, "0"), F.lit("-01-02."))).alias("remark"), F.lit("t").alias("title"),
        F.concat(F.lit("https://doi.org/10.2903/j."), F.col("k").cast("string")).alias("link"), F.when(F.col("k") % 5 == 0, "EFSA FEEDAP panel").otherwise("ANS").alias("panel")))
    return tox.opinion_findings(rows.filter("information IS NOT NULL")), dims


_FINDINGS = f"""{_CONCLUSIONS},
tm AS (SELECT substance, opinion, pos, unnest(CASE k % 7 WHEN 0 THEN ['genotoxic', 'mutagenic'] WHEN 1 THEN ['carcinogenic'] WHEN 2 THEN ['genotoxic', 'carcinogenic'] WHEN 3 THEN ['mutagenic'] ELSE [] END) AS kind,
   unnest(CASE k % 7 WHEN 0 THEN ['Positive', 'Negative'] WHEN 1 THEN ['Ambiguous'] WHEN 2 THEN ['No data', 'Not determined'] WHEN 3 THEN ['Negative'] ELSE [] END) AS term FROM fx),
tw AS (SELECT *, CASE term WHEN 'Positive' THEN 4 WHEN 'Ambiguous' THEN 3 WHEN 'Negative' THEN 2 ELSE 0 END AS w FROM tm),
fo AS (SELECT substance, opinion, CASE WHEN bool_or(term = 'Positive') THEN 'positive' WHEN bool_or(term = 'Ambiguous') THEN 'ambiguous' WHEN bool_or(term = 'Negative') THEN 'negative' ELSE 'no-data' END AS finding
   FROM (SELECT substance, opinion, kind, arg_max(term, w) AS term FROM (SELECT substance, opinion, kind, term, w::BIGINT * 1000000000 - pos AS w FROM tw) GROUP BY ALL) GROUP BY ALL),
dm AS (SELECT opinion, CASE WHEN k % 3 <> 0 THEN '20' || lpad((k % 20)::VARCHAR, 2, '0') || '-05-01' WHEN k % 2 = 0 THEN '19' || lpad((k % 90 + 10)::VARCHAR, 2, '0') || '-01-02' END AS date, '10.2903/j.' || k::VARCHAR AS doi, k % 5 = 0 AS feed
   FROM (SELECT opinion, min(k) AS k FROM fx GROUP BY opinion)),
al AS (SELECT fo.substance, fo.opinion, finding, date, doi, feed, cx.assessment, cx.adi, bool_or(finding <> 'no-data') OVER (PARTITION BY fo.substance) AS studied, count(*) OVER (PARTITION BY fo.substance) AS opinions,
   row_number() OVER (PARTITION BY fo.substance ORDER BY finding = 'no-data', feed, coalesce(date, '') DESC, fo.opinion) AS rn
  FROM fo JOIN dm USING (opinion) LEFT JOIN cx ON cx.substance = fo.substance AND cx.opinion = fo.opinion)"""


@query("current_opinions", f"""WITH {_FINDINGS}, o AS (SELECT substance, list_sort(list(DISTINCT finding) FILTER (finding <> 'no-data')) AS fs FROM al GROUP BY substance)
SELECT al.substance, opinion, finding, date, doi, assessment, opinions, studied, coalesce(array_to_string([x FOR x IN fs IF x <> finding], ','), '') AS disagree FROM al JOIN o ON o.substance = al.substance WHERE rn = 1""")
def current_opinions(spark: SparkSession, sf: str) -> DataFrame:
    findings, dims = _findings(spark, sf)
    current, _ = tox.resolve_opinions(findings, dims, tox.reference_values(flex(spark, sf))[2])
    return current.select("substance", "opinion", "finding", "date", "doi", "assessment", "opinions", "studied", F.array_join("disagree", ",").alias("disagree"))


@query("opinion_history", f"WITH {_FINDINGS} SELECT substance, opinion, finding, date, adi AS opinion_adi, rn = 1 AS cited FROM al WHERE NOT studied OR finding <> 'no-data'")
def opinion_history(spark: SparkSession, sf: str) -> DataFrame:
    findings, dims = _findings(spark, sf)
    _, history = tox.resolve_opinions(findings, dims, tox.reference_values(flex(spark, sf))[2])
    return history.select("substance", "opinion", "finding", "date", "opinion_adi", "cited")


@query("substance_slice", """WITH c AS (SELECT c_custkey AS k, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT 'S' || k::VARCHAR AS id, (SELECT count(*) FROM orders WHERE o_custkey = k) AS values FROM c WHERE r = 1 OR r = 3""")
def substance_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Substances hang below nations and regions; those of two regions are the domain asked for."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    nodes = (load(spark, sf, "customer").select(name("S", "c_custkey").alias("id"), name("N", "c_nationkey").alias("parent"), none.alias("domain"))
             .unionByName(load(spark, sf, "nation").select(name("N", "n_nationkey").alias("id"), name("R", "n_regionkey").alias("parent"), none.alias("domain")))
             .unionByName(load(spark, sf, "region").select(name("R", "r_regionkey").alias("id"), none.alias("parent"), F.when(F.col("r_regionkey").isin(1, 3), "food additives").alias("domain"))))
    subs = load(spark, sf, "customer").select(name("S", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    values = load(spark, sf, "orders").select(name("S", "o_custkey").alias("parent"), "o_totalprice")
    chosen, found, _ = reg.oft_slice(subs, nodes, values, values, "food additives")
    return chosen.select("id").join(found.groupBy(F.col("substance").alias("id")).agg(F.count(F.lit(1)).alias("values")), "id", "left").fillna(0, ["values"])


def _digest(columns: str, source: str) -> str:
    """SQL for the digest of a table's content; ``columns`` in the order of their names."""
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns.split())
    return f"(SELECT CAST(coalesce(sum(CAST(CAST('0x' || left(md5(concat_ws('|', {cells})), 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR) FROM {source})"


# Rows, columns and, where the content is one of the views, its digest.
_PUBLISHED = [
    ("severity", "count(*) FROM sv", "item level certainty via detail adi position disagreement single_source", None),
    ("additives", "count(*) FROM it", "item name_en cas e_numbers", None),
    ("additive_tags", "count(*) FROM lk", "item tag via claims has_evidence declares_number", None),
    ("levels", "8", "level label used", None), ("certainties", "4", "certainty axis rank", None),
    ("severity_origin", "count(*) FROM sv", "item source key link_via", None),
    ("bans", "count(*) + 2 * count(*) FILTER (more) FROM bans_v", "tag kind jurisdiction main",
     _digest("jurisdiction kind main tag", "(SELECT tag, kind, jurisdiction, true AS main FROM bans_v UNION ALL SELECT tag, kind, unnest(['Other A', 'Other B']), false FROM bans_v WHERE more)")),
    ("exposure", "count(*) FROM ex", "tag e risk mean_over vulnerable watched opinion_date", None),
    ("iarc", "count(*) FROM iarc_v WHERE grp IS NOT NULL", "name group cas year year_note", None), ("clp", "count(*) FROM cp", "cas codes worst", None),
    ("eu_law", "count(*) FROM law_v", "e authorised withdrawn listed", _digest("authorised e listed withdrawn", "law_v")),
    ("toxicology", "count(*) FROM oft_v", "uuid name adi no_adi_reason uncertainty toxicity has_study finding no_dose_reason",
     _digest("adi finding has_study name no_adi_reason no_dose_reason toxicity uncertainty uuid",
             "(SELECT * REPLACE (CAST(round(adi * 1000000) AS BIGINT) AS adi, CAST(round(uncertainty * 1000000) AS BIGINT) AS uncertainty) FROM oft_v)")),
    ("family_members", "count(*) FROM tags_v WHERE tag LIKE '%i'", "number member family",
     _digest("family member number", "(SELECT n AS number, 'en:e' || n AS family, tag AS member FROM tags_v WHERE tag LIKE '%i')")),
    ("families", "count(DISTINCT n) FROM tags_v WHERE tag LIKE '%i'", "", None),
    ("us_law", "3 * count(*) FROM documents", "", None), ("withdrawal_reasons", "count(*) FROM documents", "", None),
    ("opinion_history", "count(*) FROM al WHERE NOT studied OR finding <> 'no-data'", "substance opinion finding date opinion_adi cited", None),
]
_MANIFEST = " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", (SELECT {rows}) AS rows, '{columns.replace(' ', ',')}' AS columns, {digest or "''"} AS digest""" for name, rows, columns, digest in _PUBLISHED)


@query("published_tables", f"""WITH {_SLICE}, {_FINDINGS}, m AS ({_MANIFEST})
SELECT "table", CAST(rows AS BIGINT) AS rows, columns, digest, true AS sized FROM m UNION ALL SELECT '(all)', CAST(sum(rows) AS BIGINT), '', '', true FROM m""")
def published_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The 17 tables of the star schema written as parquet, and their manifest."""
    from larder.queries.regulation import acts, us_code

    c = Chain(spark, sf)
    full = c.full()
    tag_data = ev.tag_values(c.links, c.best)
    fams = ev.families(c.tags)
    findings, dims = _findings(spark, sf)
    _, history = tox.resolve_opinions(findings, dims, tox.reference_values(flex(spark, sf))[2])
    code = us_code(spark, sf)
    part_81 = reg.us_withdrawals(reg.us_colour_paragraphs(code)).withColumn("section", F.concat(F.lit("21 CFR 81.10("), "letter", F.lit(")")))
    reasons = reg.withdrawal_reason(reg.text_signals(acts(spark, sf)))
    src = {"items": c.items, "links": c.links, "evidence": full, "severity": c.severity, "bans": c.bans, "toxicology": c.oft, "history": history.select("substance", "opinion", "finding", "date", "opinion_adi", "cited"),
           "iarc": iarc(spark, sf), "clp": clp(spark, sf), "law": view(spark, sf, "law_v"), "us_law": ev.us_law(reg.us_banned(code), part_81), "exposure": exposure(spark, sf),
           "families": fams, "family_stats": ev.family_stats(fams, tag_data), "reasons": reasons}
    tables = ev.star_schema(src)
    manifest = ev.publish(tables, f"{checkpoint_root(spark)}/published-{uuid.uuid4().hex}")
    stated = {name: columns for name, _, columns, _ in _PUBLISHED if columns}
    compared = [name for name, _, _, digest in _PUBLISHED if digest]
    return manifest.select(
        "table", "rows", F.when(F.col("table").isin(list(stated)), F.array_join("columns", ",")).otherwise("").alias("columns"),
        F.when(F.col("table").isin(compared), F.col("digest")).otherwise("").alias("digest"), (F.col("bytes") > 0).alias("sized"))
