"""Legal-text queries: every document of ``documents`` or ``pages`` carries a rendered legal text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.binding import load
from larder.functions import text
from larder.plans import evidence as ev
from larder.queries.registry import query
from larder.sources import regulation as reg

D = lambda: F.col("doc_id")
_num = lambda c: c.cast("string")


def annex(spark: SparkSession, sf: str) -> DataFrame:
    """One annex per document: its own text as preamble, then five sections."""
    n = lambda base: _num(F.lit(base) + D() % 50)
    lit = F.lit
    body = F.concat(
        lit("<p>PARTE A "), F.col("text"), lit("</p> PARTE B E "), n(100), lit(" Silicato ( 2 ) E "), n(200), lit("a Bentonita E "), n(300),
        lit(" Goma ( 3 ) E 535 Sal E 537 Otra ( 2 ) Autorizado hasta el 31 de enero de "), _num(lit(2010) + D() % 30), lit(". ( 3 ) Periodo: desde el 6 de febrero de 2013. PARTE C Grupo E "), n(100),
        lit(", E 535-538 PARTE D nada PARTE E uso E "), n(300), lit(" y E "), n(200), lit("a(ii) fin"))
    return load(spark, sf, "documents").select(D().alias("doc"), body.alias("text"))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return reg.split_parts(annex(spark, sf))


_N = "d AS (SELECT doc_id AS doc, doc_id % 50 AS r, 2010 + doc_id % 30 AS y FROM documents)"


@query("annex_sections", """WITH body AS (SELECT doc_id AS doc, '<p>PARTE A ' || text || '</p> PARTE B E ' || (100 + doc_id % 50)::VARCHAR || ' Silicato ( 2 ) E ' || (200 + doc_id % 50)::VARCHAR || 'a Bentonita E ' || (300 + doc_id % 50)::VARCHAR
   || ' Goma ( 3 ) E 535 Sal E 537 Otra ( 2 ) Autorizado hasta el 31 de enero de ' || (2010 + doc_id % 30)::VARCHAR || '. ( 3 ) Periodo: desde el 6 de febrero de 2013. PARTE C Grupo E ' || (100 + doc_id % 50)::VARCHAR
   || ', E 535-538 PARTE D nada PARTE E uso E ' || (300 + doc_id % 50)::VARCHAR || ' y E ' || (200 + doc_id % 50)::VARCHAR || 'a(ii) fin' AS t FROM documents),
flat AS (SELECT doc, regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM body),
at AS (SELECT doc, t, strpos(t, 'PARTE A') AS a, strpos(t, 'PARTE B') AS b, strpos(t, 'PARTE C') AS c, strpos(t, 'PARTE D') AS d, strpos(t, 'PARTE E') AS e FROM flat)
SELECT doc, 'A' AS part, substring(t, a, b - a) AS text FROM places UNION ALL SELECT doc, 'B', substring(t, b, c - b) FROM places UNION ALL SELECT doc, 'C', substring(t, c, d - c) FROM places
UNION ALL SELECT doc, 'D', substring(t, d, e - d) FROM places UNION ALL SELECT doc, 'E', substring(t, e) FROM places""".replace("at AS (SELECT doc, t,", "places AS (SELECT doc, t,"))
def annex_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _sections(spark, sf)


_AUTH = f"""{_N}, ls AS (SELECT doc, unnest([(100 + r)::VARCHAR, (200 + r)::VARCHAR || 'a', (300 + r)::VARCHAR, '535', '537']) AS e FROM d),
au AS (SELECT doc, e, max(via) AS via FROM (SELECT doc, (100 + r)::VARCHAR AS e, 'group-part-c' AS via FROM d UNION ALL SELECT doc, unnest(['535', '537']), 'group-part-c' FROM d
   UNION ALL SELECT doc, (300 + r)::VARCHAR, 'part-e' FROM d UNION ALL SELECT doc, (200 + r)::VARCHAR || 'a', 'part-e' FROM d) GROUP BY doc, e),
xp AS (SELECT doc, unnest([(100 + r)::VARCHAR, '537']) AS e, make_date(y, 1, 31) AS until FROM d WHERE make_date(y, 1, 31) < DATE '2026-01-01')"""
_TODAY = "2026-01-01"


@query("authorised_numbers", f"WITH {_AUTH} SELECT doc, e, via FROM au")
def authorised_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return reg.authorised(_sections(spark, sf))


@query("expired_numbers", f"WITH {_AUTH} SELECT doc, e, strftime(until, '%Y-%m-%d') AS until FROM xp")
def expired_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = reg.expired(_sections(spark, sf), F.lit(_TODAY).cast("date"))
    return rows.withColumn("until", F.date_format("until", "yyyy-MM-dd"))


@query("withdrawn_numbers", """WITH o AS (SELECT DISTINCT CASE WHEN l_partkey % 9 = 0 THEN (100 + l_partkey)::VARCHAR || 'a' ELSE (100 + l_partkey)::VARCHAR END AS e FROM lineitem WHERE l_quantity > 10),
n AS (SELECT DISTINCT CASE WHEN l_partkey % 5 = 0 THEN (100 + l_partkey)::VARCHAR || 'b' ELSE (100 + l_partkey)::VARCHAR END AS e FROM lineitem WHERE l_partkey % 4 <> 0)
SELECT e FROM (SELECT e FROM o EXCEPT SELECT e FROM n) WHERE try_cast(regexp_extract(e, '^([0-9]{3,4})[a-z]*$', 1) AS INT) BETWEEN 100 AND 1599
  AND e || 'b' NOT IN (SELECT e FROM n) AND NOT EXISTS (SELECT 1 FROM n WHERE n.e <> e AND length(n.e) > length(o2) AND starts_with(n.e, o2))""".replace("SELECT e FROM (SELECT e FROM o EXCEPT SELECT e FROM n) WHERE", "SELECT e FROM (SELECT e, e AS o2 FROM (SELECT e FROM o EXCEPT SELECT e FROM n)) x WHERE").replace("n.e <> e AND ", ""))
def withdrawn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a list of numbers; those that live on with a suffix were renumbered."""
    k = F.col("l_partkey")
    line = load(spark, sf, "lineitem")
    e = lambda mod, suffix: F.concat(_num(k + 100), F.when(k % mod == 0, suffix).otherwise(""))
    old = line.filter("l_quantity > 10").select(e(9, "a").alias("e"))
    new = line.filter(k % 4 != 0).select(e(5, "b").alias("e"))
    return reg.withdrawn(old, new)


@query("law_rows", f"""WITH {_AUTH}, gone AS (SELECT '300' AS e UNION ALL SELECT '310'),
j AS (SELECT coalesce(ls.doc, au.doc) AS doc, coalesce(ls.e, au.e) AS e, via, ls.e IS NOT NULL AS listed FROM ls FULL JOIN au ON au.doc = ls.doc AND au.e = ls.e),
w AS (SELECT j.*, until, j.e IN (SELECT e FROM gone) OR until IS NOT NULL AS withdrawn FROM j LEFT JOIN xp ON xp.doc = j.doc AND xp.e = j.e)
SELECT doc, e, via, via IS NOT NULL AND NOT withdrawn AS authorised, listed, withdrawn, strftime(until, '%Y-%m-%d') AS expired_on,
  CASE WHEN via IS NOT NULL AND NOT withdrawn THEN 'authorised' WHEN withdrawn THEN 'withdrawn' WHEN listed THEN 'listed-no-use' ELSE 'absent' END AS state FROM w""")
def law_rows(spark: SparkSession, sf: str) -> DataFrame:
    gone = spark.createDataFrame([("300",), ("310",)], "e string")
    return reg.legal_rows(_sections(spark, sf), gone, F.lit(_TODAY).cast("date"))


def annex_html(spark: SparkSession, sf: str) -> DataFrame:
    """A page with its own markup, a short table and the annex table with two rows."""
    p = F.col("page_id")
    cas = lambda n: F.concat(_num(p * 2 + 100 + n), F.lit("-"), F.lpad(_num(p % 100), 2, "0"), F.lit("-"), _num(p % 10))
    row = lambda n, classes: F.concat(F.lit("<tr><td>6"), _num(p % 10), F.lit("</td><td>Substance <b>"), _num(p), F.lit("</b></td><td>"), cas(n), F.lit("</td><td>"), classes, F.lit("</td><td>x &amp; y</td></tr>"))
    table = F.concat(F.lit("<table class='a'>"), row(0, F.when(p % 3 == 0, "Carc. 1B, Muta. 2").when(p % 3 == 1, "Repr 1A").otherwise("Flam. Liq. 2")),
                     row(1, F.lit("Carc. 2")), F.lit("<tr><td>header</td></tr></table>"))
    small = F.concat(F.lit("<table><tr><td>"), cas(5), F.lit("</td></tr></table>"))
    return load(spark, sf, "pages").select(p.alias("doc"), F.concat("html", small, table).alias("text"))


_CAS = "(page_id * 2 + {n})::VARCHAR || '-' || lpad((page_id % 100)::VARCHAR, 2, '0') || '-' || (page_id % 10)::VARCHAR"


@query("annex_rows", f"""SELECT page_id AS doc, 0 AS row, '6' || (page_id % 10)::VARCHAR || '|Substance ' || page_id::VARCHAR || '|' || {_CAS.replace('{n}', '100')} || '|' || CASE page_id % 3 WHEN 0 THEN 'Carc. 1B, Muta. 2' WHEN 1 THEN 'Repr 1A' ELSE 'Flam. Liq. 2' END || '|x &amp; y' AS cells FROM pages
UNION ALL SELECT page_id, 1, '6' || (page_id % 10)::VARCHAR || '|Substance ' || page_id::VARCHAR || '|' || {_CAS.replace('{n}', '101')} || '|Carc. 2|x &amp; y' FROM pages UNION ALL SELECT page_id, 2, 'header' FROM pages""")
def annex_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reg.html_rows(annex_html(spark, sf)).withColumn("cells", F.array_join("cells", "|"))


@query("annex_classes", f"""WITH r AS (SELECT page_id AS doc, 0 AS row, page_id, {_CAS.replace('{n}', '100')} AS cas, CASE page_id % 3 WHEN 0 THEN 'Carc. 1B|Muta. 2' WHEN 1 THEN 'Repr. 1A' END AS classes FROM pages
  UNION ALL SELECT page_id, 1, page_id, {_CAS.replace('{n}', '101')}, 'Carc. 2' FROM pages)
SELECT cas, 'Substance ' || page_id::VARCHAR AS name, classes, CASE WHEN classes LIKE '%1A%' THEN '1A' WHEN classes LIKE '%1B%' THEN '1B' ELSE '2' END AS worst, classes LIKE '%Carc%' AS carcinogenic, classes LIKE '%Muta%' AS mutagenic, classes LIKE '%Repr%' AS reprotoxic
FROM r WHERE classes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cas ORDER BY doc, row) = 1""")
def annex_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = reg.clp_records(reg.html_rows(annex_html(spark, sf)))
    return rows.withColumn("classes", F.array_join(F.transform("classes", lambda c: c["code"]), "|"))


@query("page_texts", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("digest"))


def us_code(spark: SparkSession, sf: str) -> DataFrame:
    """Part 189 headings and § 81.10 paragraphs after each document's own text."""
    lit, n = F.lit, _num(D())
    heads = F.concat(lit("<HEAD>§ 189."), _num(D() % 300 + 100), lit(" Agent &#x3B2;-"), n, lit(" &amp; salts.</HEAD><HEAD>§ 189.1 General.</HEAD><HEAD>Other</HEAD>"))
    lakes = F.when(D() % 3 == 0, " and the provisional listing of the lakes of Red " ).otherwise(" and the provisional listing of Blue ")
    para = F.concat(
        lit("<P>(a)<I>Red "), n, lit(".</I> It "), F.when(D() % 4 == 0, "causes cancer in rats").when(D() % 4 == 1, "rests on insufficient data").when(D() % 4 == 2, "had a notice, in the absence of a petition").otherwise("was listed"),
        lit(". The agency terminates the provisional listing of Red "), n, lit(" for use in "), F.when(D() % 2 == 0, "foods and drugs").otherwise("cosmetics"), lakes, n,
        lit(" for use in food, effective 1990.</P><P>(b)(1) <I>Green.</I> Nothing ends here.</P>"))
    return load(spark, sf, "documents").select(D().alias("doc"), F.concat("text", heads, para).alias("text"))


@query("us_banned", "SELECT doc_id AS doc, '21 CFR 189.' || (doc_id % 300 + 100)::VARCHAR AS section, 'Agent β-' || doc_id::VARCHAR || ' & salts' AS name FROM documents")
def us_banned(spark: SparkSession, sf: str) -> DataFrame:
    return reg.us_banned(us_code(spark, sf))


@query("us_paragraphs", """SELECT doc_id AS doc, 'a' AS letter, 'Red ' || doc_id::VARCHAR AS name, '(a) Red ' || doc_id::VARCHAR || '. It ' || CASE doc_id % 4 WHEN 0 THEN 'causes cancer in rats' WHEN 1 THEN 'rests on insufficient data' WHEN 2 THEN 'had a notice, in the absence of a petition' ELSE 'was listed' END
  || '. The agency terminates the provisional listing of Red ' || doc_id::VARCHAR || ' for use in ' || CASE WHEN doc_id % 2 = 0 THEN 'foods and drugs' ELSE 'cosmetics' END
  || CASE WHEN doc_id % 3 = 0 THEN ' and the provisional listing of the lakes of Red ' ELSE ' and the provisional listing of Blue ' END || doc_id::VARCHAR || ' for use in food, effective 1990.' AS text FROM documents
UNION ALL SELECT doc_id, 'b', 'Green', '(b)(1) Green. Nothing ends here.' FROM documents""")
def us_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return reg.us_colour_paragraphs(us_code(spark, sf))


@query("us_scope", """SELECT doc_id AS doc, 'a' AS letter, 'Red ' || doc_id::VARCHAR AS substance, CASE WHEN doc_id % 2 = 0 THEN 'foods and drugs' ELSE 'cosmetics' END AS uses, doc_id % 2 = 0 AS food, false AS lake FROM documents
UNION ALL SELECT doc_id, 'a', CASE WHEN doc_id % 3 = 0 THEN 'the lakes of Red ' ELSE 'Blue ' END || doc_id::VARCHAR, 'food', true, doc_id % 3 = 0 FROM documents""")
def us_scope(spark: SparkSession, sf: str) -> DataFrame:
    return reg.us_scope(reg.us_colour_paragraphs(us_code(spark, sf)))


_US = """us AS (SELECT doc_id AS doc, 'a' AS letter, 'Red ' || doc_id::VARCHAR AS name, doc_id % 2 = 0 OR doc_id % 3 <> 0 AS food,
  CASE doc_id % 4 WHEN 0 THEN 'risk-identified' WHEN 1 THEN 'safety-not-confirmed' WHEN 2 THEN 'no-petition' ELSE 'not-stated' END AS reason, CASE WHEN doc_id % 6 = 3 THEN 'only-lakes' ELSE '' END AS review FROM documents
  UNION ALL SELECT doc_id, 'b', 'Green', false, 'not-stated', 'no-clause' FROM documents)"""


@query("us_withdrawals", f"WITH {_US} SELECT * FROM us")
def us_withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    return reg.us_withdrawals(reg.us_colour_paragraphs(us_code(spark, sf)))


@query("us_law", f"""WITH {_US} SELECT '21 CFR 189.' || (doc_id % 300 + 100)::VARCHAR AS section, 189 AS part, true AS food, CAST(NULL AS VARCHAR) AS reason, count(*) AS entries FROM documents GROUP BY ALL
  UNION ALL SELECT '21 CFR 81.10(' || letter || ')', 81, food, reason, count(*) FROM us GROUP BY ALL""")
def us_law(spark: SparkSession, sf: str) -> DataFrame:
    code = us_code(spark, sf)
    part_81 = reg.us_withdrawals(reg.us_colour_paragraphs(code)).withColumn("section", F.concat(F.lit("21 CFR 81.10("), "letter", F.lit(")")))
    return ev.us_law(reg.us_banned(code), part_81).groupBy("section", "part", "food", "reason").agg(F.count(F.lit(1)).alias("entries"))


def _alarms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    us = reg.us_withdrawals(reg.us_colour_paragraphs(us_code(spark, sf))).withColumn("section", F.concat(F.lit("s"), _num(F.col("doc"))))
    mapping = load(spark, sf, "documents").filter(D() % 5 != 0).select(F.concat(F.lit("s"), _num(D())).alias("section"), F.array(F.concat(F.lit("en:e"), _num(D() % 90 + 100))).alias("applies_to"))
    bans = load(spark, sf, "nation").select(F.concat(F.lit("en:e"), _num(F.col("n_nationkey") + 100)).alias("tag"), F.lit("United States").alias("jurisdiction"))
    return ev.missing_withdrawals(us, mapping, bans)


@query("unmapped_withdrawals", f"WITH {_US} SELECT 's' || doc::VARCHAR AS section, name FROM us WHERE food AND doc % 5 = 0")
def unmapped_withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    return _alarms(spark, sf)[0]


@query("unrecorded_withdrawals", f"WITH {_US} SELECT 's' || doc::VARCHAR AS section, 'en:e' || (doc % 90 + 100)::VARCHAR AS tag FROM us WHERE food AND doc % 5 <> 0 AND doc % 90 >= 25")
def unrecorded_withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    return _alarms(spark, sf)[1]


def acts(spark: SparkSession, sf: str) -> DataFrame:
    """Recitals in front of each document's text, far enough apart not to share a context."""
    gap = F.repeat(F.lit("filler words "), F.lit(14))
    said = (F.when(D() % 5 == 0, "It can no longer be considered safe when used as an additive.").when(D() % 5 == 1, "There is a lack of toxicity data and genotoxicity data were requested.")
            .when(D() % 5 == 2, "The substance was found to be carcinogenic in mice.").when(D() % 5 == 3, "Available studies on carcinogenic effects, genotoxicity and others were limited.").otherwise("Nothing is said."))
    return load(spark, sf, "documents").select(D().alias("doc"), F.concat(said, F.lit(" "), gap, "text").alias("text"))


@query("withdrawal_reasons", """SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS verdicts, CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS hazards, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS no_data, 0 AS nobody,
  CASE doc_id % 5 WHEN 0 THEN 'risk-identified' WHEN 1 THEN 'safety-not-confirmed' WHEN 2 THEN 'risk-identified' END AS reason FROM documents""")
def withdrawal_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reg.withdrawal_reason(reg.text_signals(acts(spark, sf)))


@query("source_floor", "SELECT count(*) AS rows FROM documents")
def source_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Structural floor: as many headings as documents, or the job stops."""
    return reg.require_min_rows(reg.us_banned(us_code(spark, sf)), 10, "part 189")


@query("curated_bans", """SELECT 'en:e' || c_custkey::VARCHAR AS tag, CASE WHEN c_custkey % 3 = 0 THEN 'ban' ELSE 'withdrawal' END AS kind, c_mktsegment AS scope FROM customer""")
def curated_bans(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = load(spark, sf, "customer").select(F.concat(F.lit("en:e"), _num(k)).alias("tag"), F.col("c_mktsegment").alias("scope"), k.alias("k"))
    return reg.stamp_bans(rows.filter("k % 3 = 0").drop("k"), rows.filter("k % 3 <> 0").drop("k")).select("tag", "kind", "scope")
