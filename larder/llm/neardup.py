"""Near-duplicates by b-bit MinHash.

A document's set are its distinct five-word shingles. 240 minima of multiplied shingle hashes make 48
bands of five; equal bands make candidates. Of 128 minima the two low bits are kept, packed into four
longs: the share of equal bit pairs, less those that agree by chance, estimates the similarity of a
candidate pair, and only pairs well below the threshold are let go (0.5 for 0.75: more than five standard
deviations). The others are confirmed on their full sets.

Copies of one set are one representative. Inside a bucket of a band pairs aren't listed: each document
meets two of the hubs of its buckets, links give components, and most groups are then whole. What the hubs
leave apart is compared in full, in blocks: buckets with the same smallest member are a circle, a circle's
documents are dealt to blocks of bounded size, and two blocks at a time meet in one task, which counts the
shared shingles of all its pairs and returns a forest of links. So every two documents of a bucket that
aren't joined yet are still compared. At the threshold a pair misses all bands with a chance of 2e-6.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larder.llm.arrays import Words, give_back, mix, pieces, window_hashes, window_starts
from larder.operators.ranges import join_lines
from larder.session import checkpoint_root, cut_lineage

SHINGLE = 5
BANDS, ROWS = 48, 5
SAMPLES, LOW_BITS = 128, 2
LONGS = SAMPLES * LOW_BITS // 64
#: Bounds of a block of a circle: documents and shingles. Two blocks meet in one task.
CELL_DOCS, CELL_SHINGLES = 512, 200_000
_CHANCE = 1 / (1 << LOW_BITS)

# Odd multipliers and offsets of the minima, from the mixer of consecutive numbers.
_KEYS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = (_KEYS[:BANDS * ROWS] | np.uint64(1)).astype(np.uint32)
_PLUS = _KEYS[BANDS * ROWS:].astype(np.uint32)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each text, and the offsets of the texts."""
    words = Words(texts, lower=True)
    hashes, counts = words.hashes(), words.counts
    at, text = window_starts(words.first, SHINGLE)
    # A text of fewer words has its whole sequence as its only shingle.
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    values = np.concatenate([window_hashes(hashes, at, SHINGLE), window_hashes(hashes, words.first[short], counts[short])])
    owner = np.concatenate([text, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands as one long each, and packed low bits, of every set that isn't empty."""
    some = np.flatnonzero(np.diff(offsets))
    low = (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty((BANDS * ROWS, len(some)), np.uint32)
    starts = offsets[:-1][some]
    for i in range(BANDS * ROWS):
        least[i] = np.minimum.reduceat(low * _TIMES[i] + _PLUS[i], starts) if len(some) else 0
    bands = np.zeros((BANDS, len(some)), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(some), b + 1, np.uint64)
        for r in range(ROWS):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + least[b * ROWS + r])
        bands[b] = acc
    # The lowest bits of a product are weak; take those of the mixed minimum.
    bits = mix(least[:SAMPLES].astype(np.uint64)) & np.uint64((1 << LOW_BITS) - 1)
    packed = np.zeros((LONGS, len(some)), np.uint64)
    per = 64 // LOW_BITS
    for i in range(SAMPLES):
        packed[i // per] |= bits[i] << np.uint64(LOW_BITS * (i % per))
    return bands.T.view(np.int64), packed.T.view(np.int64)


def _signed(batches):
    for batch in pieces(batches, "text"):
        values, offsets = shingle_sets(batch.column(1))
        n = np.diff(offsets)
        some = n > 0
        bands, packed = signatures(values, offsets)
        # Two sums over the set name it: 128 bits that don't depend on an order.
        first, second = (np.add.reduceat(x, offsets[:-1][some]).view(np.int64) if some.any() else np.zeros(0, np.int64) for x in (values, mix(values ^ np.uint64(0x5555555555555555))))
        fill = np.full(len(n), -1)
        fill[some] = np.arange(some.sum())
        take = lambda x: pa.array(x, pa.int64()).take(pa.array(fill, mask=fill < 0))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.int64())).take(pa.array(fill, mask=fill < 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), take(first), take(second), lists(bands), lists(packed)], ["id", "n", "k1", "k2", "bands", "bits"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, less the agreement by chance."""
    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555).cast("long")))

    differ = sum((differing(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(LONGS)), F.lit(0))
    return ((1 - differ / SAMPLES) - _CHANCE) / (1 - _CHANCE)


def _confirm(percent: int):
    def run(batches):
        for batch in pieces(batches, "text_a"):
            sets = [shingle_sets(batch.column(c)) for c in (2, 3)]
            (a, oa), (b, ob) = sets
            n = batch.num_rows
            # Intersections of all pairs at once: hashes that occur twice under the same row.
            rows = np.concatenate([np.repeat(np.arange(n), np.diff(oa)), np.repeat(np.arange(n), np.diff(ob))])
            values = np.concatenate([a, b])
            order = np.lexsort((values, rows))
            rows, values = rows[order], values[order]
            same = (values[1:] == values[:-1]) & (rows[1:] == rows[:-1])
            both = np.bincount(rows[1:][same], minlength=n)
            union = np.diff(oa) + np.diff(ob) - both
            linked = pa.array((100 * both >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(linked)
    return run


def _cell(percent: int):
    """Links between the documents of two blocks of a circle, as a forest: enough to join what belongs together."""
    def run(table: pa.Table) -> pa.Table:
        ids, labels, own = (table.column(c).to_numpy() for c in ("id", "label", "own"))
        parts = [shingle_sets(b.column(b.schema.get_field_index("text"))) for b in pieces(iter(table.combine_chunks().to_batches()), "text")]
        sizes = np.concatenate([np.diff(o) for _, o in parts])
        owner = np.repeat(np.arange(len(ids)), sizes)
        _, which, counts = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True, return_counts=True)
        # Shingles of one document alone meet nobody. The others are columns, a stretch of them at a time.
        column = np.cumsum(counts > 1) - 1
        useful = counts[which] > 1
        owner, column = owner[useful], column[which[useful]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        width, has = 2048, None
        cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            has = np.zeros((len(ids), width), np.float32)
            has[owner[lo:hi], column[lo:hi] - k * width] = 1
            both += has @ has.T
        linked = (100 * both >= percent * (sizes[:, None] + sizes[None] - both)) & (labels[:, None] != labels[None])
        # Pairs inside a block belong to the cell of that block with itself.
        if own.min() != own.max():
            linked &= own[:, None] != own[None]
        root = {x: x for x in labels.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for x in range(len(ids)):
            others = x + 1 + np.flatnonzero(linked[x, x + 1:])
            # One link to each label is enough.
            names, first = np.unique(labels[others], return_index=True)
            for name, y in zip(names.tolist(), others[first].tolist()):
                p, q = top(int(labels[x])), top(name)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((int(ids[x]), int(ids[y])))
        del has, both, linked
        give_back()
        return pa.table({"a": pa.array([max(f) for f in found], pa.int64()), "b": pa.array([min(f) for f in found], pa.int64())})
    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a bigint, b bigint")


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again; columns of texts take less room there than in a checkpoint."""
    folder = f"{checkpoint_root(df.sparkSession).rstrip('/')}/texts-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of a link can reach.

    Labels spread over links and then jump to their label's label, until nothing changes; the number of
    rounds grows with the logarithm of the longest chain. Each round is cut off on shared storage.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        spread = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("_near")).withColumnRenamed("a", "id")
        near = labels.join(spread, "id").select("id", "label", F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("label").alias("_far"))
        after = cut_lineage(near.join(jump, "_new", "left").select("id", "label", F.least("_new", F.coalesce("_far", "_new")).alias("_to")))
        if after.filter(F.col("_to") != F.col("label")).isEmpty():
            return labels
        labels = after.select("id", F.col("_to").alias("label"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents are linked where 100 * intersection >= percent * union of their shingles. NULL, empty and
    blank texts have no shingles and are linked with nothing. Rows with the same id are one document: each
    keeps its own count, their links are joined. Rows without an id stay on their own, with no component.
    An empty table gives no rows; other columns don't matter.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    signed = cut_lineage(rows.mapInArrow(_signed, "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, bits array<bigint>"))
    sets = signed.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "bands", "bits")).alias("s")).select("k1", "k2", "s.*")
    sets = cut_lineage(sets)
    # Different sets under one id are linked by that id.
    members = sets.select("id", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    shared = cut_lineage(members.join(hubs, "band"))
    # Texts of whatever stands in a bucket with others; both rounds of links read them.
    texts = _stored(rows.join(shared.select("id").distinct(), "id", "left_semi"))
    bits = sets.select("id", "bits")
    least = (percent / 100) * 2 / 3

    # Two hubs a document are enough here: the one it shares most bands with, and the smallest. What they
    # leave apart is compared below.
    hub = shared.select("id", F.col("low").alias("hub")).union(shared.select("id", F.col("high").alias("hub"))).filter("id <> hub")
    votes = hub.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.max(F.struct("n", -F.col("hub"))).alias("most"), F.min("hub").alias("least"))
    met = votes.select("id", (-F.col("most").getField("col2")).alias("hub")).union(votes.select("id", "least"))
    met = met.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    likely = (met.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a")
              .join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b")
              .filter(estimate(F.col("bits_a"), F.col("bits_b")) >= least).select("a", "b"))
    links = cut_lineage(_links(likely, texts, percent))
    labels = components(links)

    # Circles (buckets with the same smallest member) in which more than one component is left.
    circles = shared.select("low", "id").distinct().join(sets.select("id", "n").groupBy("id").agg(F.max("n").alias("n")), "id")
    circles = circles.join(labels, "id", "left").select("low", "id", "n", F.coalesce("label", "id").alias("label"))
    open_ = circles.groupBy("low").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).filter("l0 < l1")
    blocks = F.ceil(F.greatest(F.col("docs") / CELL_DOCS, F.col("shingles") / CELL_SHINGLES)).cast("int")
    placed = join_lines(circles, open_.select("low", blocks.alias("blocks")), ["low"], "id", "inner").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.join(texts, "id").select("low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "text")
    later = cut_lineage(cells.groupBy("low", "i", "j").applyInArrow(_cell(percent), "a bigint, b bigint"))
    if not later.isEmpty():
        labels = components(links.union(later))

    named = sets.select("k1", "k2", "id").join(labels, "id", "left").select("k1", "k2", F.coalesce("label", "id").alias("component_id"))
    done = signed.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the smallest id.

    Rows without an id stay. Of rows that share an id and the text one is kept; those that share only the id
    are one document and stay or go together. NULL and empty texts are no copies of each other; an empty
    table gives no rows; other columns don't matter.
    """
    gone = near_duplicates(docs, id_column, text_column, percent).filter("NOT kept").select(F.col(id_column).alias("_gone"))
    left = docs.join(gone, docs[id_column] == gone["_gone"], "left_anti")
    # Rows without an id are told apart by where they are read, so they aren't taken for repeated ones.
    apart = F.when(F.col(id_column).isNull(), F.monotonically_increasing_id())
    return left.withColumns({"_text_print": F.xxhash64(text_column), "_apart": apart}).dropDuplicates([id_column, "_text_print", "_apart"]).select(*docs.columns)
