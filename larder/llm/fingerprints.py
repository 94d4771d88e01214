"""Document fingerprints by one-permutation MinHash, with DataFrame operations only.

Every shingle of five words is hashed once. The top bits of the hash name one of 128 bins, a bin keeps
its smallest hash. An empty bin takes its value from another one, found by a probe sequence of its
own that reaches all bins (optimal densification). The low four bits of each bin are packed into
eight longs. Two fingerprints agree by chance in one bin of 16, which the likeness is corrected for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN_BITS, LOW_BITS, SHINGLE = 7, 4, 5
BINS = 1 << BIN_BITS
PER_LONG = 64 // LOW_BITS
_CHANCE = 1.0 / (1 << LOW_BITS)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def word_hashes(text: Column) -> Column:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``; NULL has none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_bins(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds ``out``: the packed bins of the text as eight longs, empty where the text has no word."""
    w, s, m, b, v = (f"{out}_{x}" for x in ("words", "sorted", "least", "bins", "low"))
    df = df.withColumn(w, word_hashes(text))
    some = F.size(w) >= SHINGLE
    shingles = F.transform(
        F.when(some, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(SHINGLE)]))
    short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(s, F.sort_array(F.when(some, shingles).otherwise(short)))
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS)
    # In sorted order a bin's hashes stand together, its smallest first.
    df = df.withColumn(m, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1)))))
    df = df.withColumn(b, F.transform(m, lambda x: bin_of(x)))
    # Columns that a lambda reads are named twice, or the optimizer would write their expression into it.
    df = df.withColumn(v, F.when(F.size(b) > 0, F.transform(
        F.sequence(_long(0), _long(BINS - 1)), lambda i: F.get(F.col(m), F.array_position(F.col(b), i).cast("int") - 1))))

    def densified(i: Column) -> Column:
        # Offset and odd step of bin i's probes: the steps reach every bin once.
        start = F.xxhash64(i, F.lit(1)).bitwiseAND(_long(BINS - 1))
        step = F.xxhash64(i, F.lit(2)).bitwiseAND(_long(BINS - 2)) + 1
        probes = [F.get(F.col(v), (start + step * t).bitwiseAND(_long(BINS - 1)).cast("int")) for t in range(BINS)]
        return F.coalesce(F.get(F.col(v), i.cast("int")), *probes).bitwiseAND(_long((1 << LOW_BITS) - 1))

    packed = F.array(*[F.aggregate(F.slice(F.col(f"{v}_all"), k * PER_LONG + 1, PER_LONG), _long(0), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x))
                       for k in range(BINS // PER_LONG)])
    df = df.withColumn(f"{v}_all", F.when(F.size(m) > 0, F.transform(F.sequence(_long(0), _long(BINS - 1)), densified)))
    df = df.withColumn(out, F.when(F.size(m) > 0, packed).otherwise(F.array().cast("array<bigint>")))
    return df.drop(w, s, m, b, v, f"{v}_all")


def as_text(packed: Column) -> Column:
    """Hexadecimal digits, one a bin; the empty string where there is no word."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles. Two texts without words are alike, one is not."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(_long(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    estimate = F.greatest(F.lit(0.0), ((1.0 - differ / F.lit(float(BINS))) - _CHANCE) / (1.0 - _CHANCE))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def with_next(plain: DataFrame, id_column: str, taken: str, made: str, make: Callable[[DataFrame], DataFrame], bucket_rows: int = 1024) -> DataFrame:
    """``make(plain)`` with next_<taken> and next_<made>: their values in the next row by descending id, after the last the first.

    ``make`` adds the column ``made``, which follows from ``taken``; for the few rows at the edges of buckets
    it is made again.

    Ids are dealt to buckets by equal steps of their range; a window runs inside a bucket only, and the
    last row of a bucket gets the first of the next one that has rows, found over buckets of buckets.
    Rows without an id come last. Rows with the same id follow each other by the column taken.
    """
    span = plain.agg(F.min(id_column).alias("lo"), F.max(id_column).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    step = max(1, -(-(hi - lo + 1) * bucket_rows // max(span["n"], 1)))
    bucket = F.coalesce(F.floor((F.col(id_column).cast("decimal(20,0)") - lo) / step).cast("long"), _long(-1))
    rows = make(plain).withColumn("_bucket", bucket)
    run = Window.partitionBy("_bucket").orderBy(F.col(id_column).desc_nulls_last(), F.col(taken).desc_nulls_last())
    inner = rows.withColumns({f"_in_{c}": F.lead(F.struct(c)).over(run) for c in (taken, made)})

    heads = plain.groupBy(bucket.alias("_bucket")).agg(F.max(F.struct(id_column, taken)).alias("_head"))
    places = heads.select("_bucket", F.floor(F.col("_bucket") / 1024).alias("_super"))
    outer = Window.partitionBy("_super").orderBy(F.desc("_bucket"))
    top = Window.orderBy(F.desc("_super"))
    supers = places.groupBy("_super").agg(F.max("_bucket").alias("_most"))
    supers = supers.select("_super", F.coalesce(F.lead("_most").over(top), F.max("_most").over(Window.partitionBy())).alias("_after"))
    follows = places.withColumn("_next", F.lead("_bucket").over(outer)).join(supers, "_super").select(
        F.col("_bucket").alias("_of"), F.coalesce("_next", "_after").alias("_next"))
    heads = make(follows.join(heads.withColumnRenamed("_bucket", "_next"), "_next").select("_of", F.col("_head")[taken].alias(taken)))
    heads = heads.select("_of", F.struct(taken, made).alias("_head"))
    last = F.col(f"_in_{taken}").isNull()
    out = inner.join(heads, (F.col("_bucket") == F.col("_of")) & last, "left")
    return out.select(*[c for c in rows.columns if c != "_bucket"], *[
        F.when(last, F.col("_head")[c]).otherwise(F.col(f"_in_{c}")[c]).alias(f"next_{c}") for c in (taken, made)])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of every document and of its edited text, whose last half is the next one's beginning.

    NULL counts as an empty text; a text without words has an empty fingerprint. A table of one document
    is followed by itself; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    rows = with_next(rows, "_id", "_text", "_bins", lambda df: with_bins(df, F.col("_text"), "_bins"))
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("next__text"), F.lit(1), half))
    rows = with_bins(rows.withColumn("_edited", edited), F.col("_edited"), "_edited_bins")
    return rows.select(
        F.col("_id").alias(id_column), n.cast("long").alias("n_chars"), F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("_bins")).alias("fingerprint"), as_text(F.col("_edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited"), likeness(F.col("_bins"), F.col("next__bins")).alias("near_next"))
