"""Full-text search: postings, prefix queries, BM25, and an index that is stored in segments and kept up by changes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.functions.text import fold
from larder.operators import runs
from larder.operators.latest import first_per_key
from larder.session import cut_lineage

# BM25 constants of the index, and the floor of a term's weight.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def tokens(c: Column) -> Column:
    """Words of a text, lower case and without diacritics."""
    return F.filter(F.split(fold(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(token, key, tf, length): one row per word and document, length being the words of all columns.

    A document's words are in its row, so they are counted there: sorted, a word's count is the distance
    from where its run begins to where the next one does. Nothing is shuffled.
    """
    words = F.sort_array(F.concat(*[tokens(F.col(c)) for c in columns]))
    rows = df.select(key, words.alias("_words")).filter(F.size("_words") > 0)
    run = lambda i: (i == 0) | (F.get(F.col("_words"), i) != F.get(F.col("_words"), i - 1))
    rows = rows.select(key, "_words", F.size("_words").alias("length"), F.filter(F.sequence(F.lit(0), F.size("_words") - 1), run).alias("_starts"))
    counted = F.transform("_starts", lambda at, i: F.struct(
        F.get(F.col("_words"), at).alias("token"), (F.coalesce(F.get(F.col("_starts"), i + 1), F.col("length")) - at).alias("tf")))
    return rows.select(key, "length", F.inline(counted)).select("token", key, "tf", "length")


def _documents(rows: DataFrame, key: str) -> DataFrame:
    """Length of each document in the postings."""
    return rows.groupBy(key).agg(F.max("length").alias("length"))


def write_index(rows: DataFrame, key: str, path: str) -> None:
    """Stores postings as the base of an index, sorted by word inside files, so that a query reads only the row
    groups of its words. Range partitioning on (word, key) splits a word that is everywhere over many files."""
    docs = _documents(rows, key).withColumn("_gone", F.lit(False))
    seen = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    runs.append(rows.sparkSession, path, 0, docs, [key], {"postings": (rows, ["token", key])}, seen.asDict())


def read_index(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Postings as they are now, and in one row what a ranking needs to know of the whole collection."""
    totals = runs.read_totals(spark, path)
    stats = spark.range(1).select(*[F.lit(totals[c]).alias(c) for c in ("documents", "words")])
    return runs.read_detail(spark, path, [key], "postings"), stats


def update_index(spark: SparkSession, path: str, batch: int, changes: DataFrame, key: str, columns: list[str]) -> None:
    """Brings a stored index up to date: one segment with the words of what changed and marks of what went.

    Touched are deleted keys and those whose indexed columns changed. The numbers of documents and words follow
    from what the touched documents were and are; nothing is counted anew. A batch that runs again does no harm.
    """
    touched = changes.filter((F.col("op") == "d") | (F.col("fts") == 1))
    fresh = postings(touched.filter((F.col("op") == "u") & F.col(columns[0]).isNotNull()), key, columns)
    now = _documents(fresh, key)
    segment = touched.select(key).join(now, key, "left").withColumn("_gone", F.col("length").isNull())
    before = runs.manifest(spark, path, before=batch)
    was = runs.newest(spark, before, [key]).filter("NOT _gone").join(touched.select(key), key, "left_semi")
    # One row for what was and one for what is.
    moved = was.select(F.lit(-1).alias("sign"), "length").unionByName(now.select(F.lit(1).alias("sign"), "length"))
    change = moved.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("words")).first()
    totals = {c: before[0].totals[c] + change[c] for c in ("documents", "words")}
    runs.append(spark, path, batch, segment, [key], {"postings": (fresh, ["token", key])}, totals)


def parse_query(text: str) -> list[tuple[str, bool]]:
    """Query words, and whether each is a prefix: only the last one is. Quotes are dropped."""
    import re
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFD", text.replace('"', "").replace("'", "").lower()) if not 0x300 <= ord(c) <= 0x36F)
    words = [w for w in re.split(r"[^\w]+|_", folded) if w]
    return [(w, i == len(words) - 1) for i, w in enumerate(words)]


def matching(rows: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """Postings of the query's words with the number of the term; the filter reaches the scan."""
    test = lambda w, prefix: F.col("token").startswith(w) if prefix else F.col("token") == w
    kept = rows.filter(reduce(or_, [test(w, p) for w, p in terms]))
    numbers = F.array_compact(F.array(*[F.when(test(w, p), F.lit(i)) for i, (w, p) in enumerate(terms)]))
    return kept.withColumn("term", F.explode(numbers))


def prefix_search(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Documents that hold every word of the query; (key, term, tf, length) per matched term."""
    terms = parse_query(text)
    if not terms:
        return rows.limit(0).select(key, F.lit(0).alias("term"), "tf", "length")
    per_term = matching(rows, terms).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    if len(terms) == 1:
        return per_term
    complete = per_term.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(terms))
    return per_term.join(complete, key, "left_semi")


def collection_stats(rows: DataFrame, key: str) -> DataFrame:
    """Documents and words in the index: one row."""
    return rows.groupBy(key).agg(F.max("length").alias("l")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("l").alias("words"))


def bm25(rows: DataFrame, key: str, text: str, stats: DataFrame | None = None) -> DataFrame:
    """(key, score) of the documents that match; a higher score is better.

    A term's document frequency counts every document with the word, matching or not.
    """
    terms = parse_query(text)
    hits = prefix_search(rows, key, text)
    if not terms:
        return hits.select(key, F.lit(0.0).alias("score"))
    frequency = matching(rows, terms).select("term", key).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = F.broadcast(collection_stats(rows, key) if stats is None else stats)
    idf = F.greatest(F.log((F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    # One row per query word: a broadcast of a handful of rows.
    weights = frequency.crossJoin(total).select("term", idf.alias("idf"), (F.col("words") / F.col("documents")).alias("mean"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(weights), "term").groupBy(key).agg(F.sum(part).alias("score"))


def scan(df: DataFrame, key: str, columns: list[str], text: str) -> DataFrame:
    """(key, length, tf): words of each document and, per term of the query, how many of them match it; without an index.

    A query that is asked once needs no index of all words: texts are read once, only the numbers leave a row, and they
    are stored, as a ranking reads them twice.
    """
    test = lambda w, prefix: lambda t: t.startswith(w) if prefix else t == w
    words = df.select(key, F.concat(*[tokens(F.col(c)) for c in columns]).alias("_words"))
    counts = [F.size(F.filter("_words", test(w, p))).cast("long").alias(f"_tf{i}") for i, (w, p) in enumerate(parse_query(text))]
    rows = words.select(key, F.size("_words").alias("length"), *counts).filter("length > 0")
    sums = rows.groupBy(key).agg(F.sum("length").cast("int").alias("length"), *[F.sum(f"_tf{i}").alias(f"_tf{i}") for i in range(len(counts))])
    tf = F.array(*[f"_tf{i}" for i in range(len(counts))]).cast("array<bigint>")
    return cut_lineage(sums.select(key, "length", tf.alias("tf")))


def scan_hits(scanned: DataFrame, key: str) -> DataFrame:
    """As ``prefix_search``, from what ``scan`` counted."""
    full = scanned.filter((F.size("tf") > 0) & F.forall("tf", lambda n: n > 0))
    return full.select(key, "length", F.posexplode("tf").alias("term", "tf")).select(key, "term", "tf", "length")


def scan_bm25(scanned: DataFrame, key: str, text: str) -> DataFrame:
    """As ``bm25``, from what ``scan`` counted."""
    terms = range(len(parse_query(text)))
    if not terms:
        return scanned.select(key, F.lit(0.0).alias("score")).limit(0)
    total = scanned.agg(F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_all"), *[F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"_df{i}") for i in terms])
    hits = scanned.filter(F.forall("tf", lambda n: n > 0)).crossJoin(F.broadcast(total))

    def part(i: int) -> Column:
        df, tf = F.col(f"_df{i}"), F.get("tf", F.lit(i))
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / (F.col("_all") / F.col("_n"))))

    return hits.select(key, sum((part(i) for i in terms), F.lit(0.0)).alias("score"))


def attach(hits: DataFrame, products: DataFrame, key: str) -> DataFrame:
    return hits.join(products, key)


def top_k(hits: DataFrame, key: str, k: int, popularity: str | None = "popularity") -> DataFrame:
    """Best text match first, then the most scanned; the key makes the order total."""
    order = [F.col("score").desc()]
    if popularity:
        order.append(F.coalesce(popularity, F.lit(0)).desc())
    return hits.orderBy(*order, F.col(key).asc()).limit(k)


def merge_hits(hits: DataFrame, key: str, k: int) -> DataFrame:
    """Hits of several catalogues: catalogue order, then rank inside it; a code counts once."""
    return first_per_key(hits, [key], ["catalog_no", "rank"]).orderBy("catalog_no", "rank").limit(k)


def dedupe_index(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One index entry per key: the one inserted last."""
    latest = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(latest, [key, order], "left_semi")
