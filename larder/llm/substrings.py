"""Removal of repeated passages, by difference-cover anchors.

A window is 20 consecutive words. Anchors of 8 words are hashed only where the place in the text modulo
13 lies in the cover {0, 1, 3, 9}: every difference modulo 13 is one of two of its members, so two equal
windows have an anchor at the same distance from their starts, wherever they stand. Anchors that occur
once can't lie in a repeated window; windows around the others are extended to their 20 words and hashed
whole, twice, and one that isn't the first of its kind is removed. Two windows are the same if 124 bits agree.

Documents are dealt to blocks of about the same size. A block asks about each distinct hash once, in
packed rows to the bucket of the hash, and gets one bit back. So a passage that stands in a third of all
documents is one entry a block, and no list of its places is ever made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larder.llm.arrays import WINDOWS_AGAIN, Words, give_back, ragged, window_hashes, window_starts

#: A perfect difference cover (fixed values).
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Text of a block, and hashes of a bucket.
BLOCK_BYTES, BUCKET_HASHES = 2 << 20, 500_000

_ASKED = "block bigint, bucket bigint, hashes binary, again binary, owners binary"
_TOLD = "block bigint, bucket bigint, bits binary"


class _Block:
    """Words, anchors and windows of a block's texts, in the order of their ids."""

    def __init__(self, table: pa.Table, text: str, id_column: str, window: int):
        self.ids = pc.fill_null(table.column(id_column).combine_chunks().cast(pa.int64()), -2 ** 63).to_numpy(zero_copy_only=False)
        order = np.argsort(self.ids, kind="stable")
        if len(np.unique(self.ids)) < len(self.ids):
            order = pc.sort_indices(table.select([id_column, text]), [(id_column, "ascending"), (text, "ascending")], null_placement="at_start").to_numpy()
        self.table, self.ids, self.window = table.take(order), self.ids[order], window
        self.words = Words(self.table.column(text))
        self.hashes = self.words.hashes()
        give_back()

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors."""
        at, text = window_starts(self.words.first, size)
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        at = at[in_cover[(at - self.words.first[text]) % PERIOD]]
        return at, window_hashes(self.hashes, at, size)

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a repeated anchor: their places, two hashes and ids, in the order of the text."""
        at, text = window_starts(self.words.first, self.window)
        marks = np.zeros(len(self.hashes) + PERIOD + 1, np.int32)
        marks[repeated + 1] = 1
        sums = np.cumsum(marks)
        some = sums[at + PERIOD] > sums[at]
        at, text = at[some], text[some]
        return at, window_hashes(self.hashes, at, self.window), window_hashes(self.hashes, at, self.window, WINDOWS_AGAIN), self.ids[text]


def _packed(block: int, bucket: np.ndarray, hashes: np.ndarray, again: np.ndarray | None, owners: np.ndarray | None) -> pa.Table:
    """One row a bucket, from entries sorted by bucket."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    bounds = list(zip(cuts, np.append(cuts[1:], len(bucket))))
    return pa.table({
        "block": pa.array([block] * len(cuts), pa.int64()), "bucket": pa.array(bucket[cuts].astype(np.int64)),
        "hashes": pa.array([hashes[a:b].tobytes() for a, b in bounds], pa.binary()),
        **{name: pa.array([x[a:b].tobytes() if x is not None else b"" for a, b in bounds], pa.binary()) for name, x in (("again", again), ("owners", owners))}})


def _bits(table: pa.Table, kind: int | None = None) -> dict[int, bytes]:
    if kind is not None:
        table = table.filter(pc.equal(table.column("kind"), kind))
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))


def _answers(bits: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    """The bits for entries sorted by bucket."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(bucket)))
    parts = [np.unpackbits(np.frombuffer(bits[int(bucket[c])], np.uint8), count=n) for c, n in zip(cuts, sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _split(hashes: np.ndarray, bucket_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bucket_bits)).astype(np.int64)


def _anchor_entries(block: _Block, size: int, bucket_bits: int):
    """Distinct anchors by bucket with 32 more bits of each; the entry of every anchor; places; counts."""
    at, hashes = block.anchors(size)
    # Anchors that agree in these bits by chance only give windows that are then found to be single.
    short = hashes >> np.uint64(32 - bucket_bits)
    distinct, which, counts = np.unique(short, return_inverse=True, return_counts=True)
    return at, which, counts, (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _window_entries(block: _Block, repeated: np.ndarray, bucket_bits: int):
    """First of each distinct window by bucket; and for every window whether it is that one."""
    at, hashes, again, owners = block.candidates(repeated)
    # A stable sort: the first of equal windows leads them.
    by_hash = np.lexsort((again, hashes))
    lead = np.ones(len(by_hash), bool)
    lead[1:] = (hashes[by_hash][1:] != hashes[by_hash][:-1]) | (again[by_hash][1:] != again[by_hash][:-1])
    first = by_hash[lead]
    bucket = _split(hashes[first], bucket_bits)
    # In a bucket the order of the text, in which owners repeat.
    order = np.lexsort((first, bucket))
    return at, hashes, again, owners, first[order], bucket[order]


def _ask_anchors(id_column: str, text: str, window: int, bucket_bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(table, text, id_column, window)
        _, _, _, bucket, rest = _anchor_entries(block, window - PERIOD + 1, bucket_bits)
        return _packed(key[0].as_py(), bucket, rest, None, None)
    return run


def _tell(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "bits": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _tell_repeated(table: pa.Table) -> pa.Table:
    """Which hashes of a bucket come from two blocks or more."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    every = np.concatenate(parts)
    _, which, counts = np.unique(every, return_inverse=True, return_counts=True)
    return _tell(table, counts[which] > 1, [len(p) for p in parts])


def _tell_first(table: pa.Table) -> pa.Table:
    """Which entries of a bucket are the first of their window: the smallest id."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    hashes = np.concatenate(parts)
    again, owners = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("again", np.uint64), ("owners", np.int64)))
    order = np.lexsort((owners, again, hashes))
    lead = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (again[order][1:] != again[order][:-1])])
    flags = np.zeros(len(hashes), bool)
    flags[order[lead]] = True
    return _tell(table, flags, [len(p) for p in parts])


def _repeated(block: _Block, told: dict[int, bytes], bucket_bits: int) -> np.ndarray:
    at, which, counts, bucket, _ = _anchor_entries(block, block.window - PERIOD + 1, bucket_bits)
    return at[((counts > 1) | _answers(told, bucket))[which]]


def _ask_windows(id_column: str, text: str, window: int, bucket_bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _packed(0, np.zeros(0, np.int64), np.zeros(0, np.uint64), None, None)
        block = _Block(table, text, id_column, window)
        _, hashes, again, owners, first, bucket = _window_entries(block, _repeated(block, _bits(told), bucket_bits), bucket_bits)
        return _packed(key[0].as_py(), bucket, hashes[first], again[first], owners[first])
    return run


def _remove(id_column: str, text: str, window: int, bucket_bits: int, columns: list[str]):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(table, text, id_column, window)
        words, n = block.words, len(block.hashes)
        gone = np.zeros(n + 1, np.int32)
        if told.num_rows:
            repeated = _repeated(block, _bits(told, 0), bucket_bits)
            at, _, _, _, first, bucket = _window_entries(block, repeated, bucket_bits)
            again = np.ones(len(at), bool)
            again[first[_answers(_bits(told, 1), bucket)]] = False
            np.add.at(gone, at[again], 1)
            np.add.at(gone, at[again] + window, -1)
        kept = np.cumsum(gone)[:n] == 0
        sums = np.concatenate([[0], np.cumsum(kept)])
        counts, left = words.counts, np.diff(sums[words.first])
        # Kept words with a space after each; the last one of a text is cut off.
        starts, sizes = words.starts[kept], (words.ends - words.starts)[kept]
        out = np.full(int(sizes.sum() + len(sizes)), 0x20, np.uint8)
        spot = np.cumsum(sizes + 1) - (sizes + 1)
        out[ragged(spot, sizes)] = words.data[ragged(starts, sizes)]
        edges = np.concatenate([[0], np.cumsum(sizes + 1)])[sums[words.first]]
        texts = [out[a:max(a, b - 1)].tobytes() for a, b in zip(edges, edges[1:])]
        result = {c: block.table.column(c) for c in columns}
        return pa.table(result | {"kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(counts - left, pa.int64())})
    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20) -> DataFrame:
    """``docs`` with kept_text, n_words and n_removed added.

    A word goes if a window of ``window`` words covers it whose sequence also starts earlier: in a document
    with a smaller id, or earlier in the same one. Windows are judged on the input. Kept words are joined by
    one space. NULL and empty texts have no words. Rows without an id come before all others, rows with the
    same id follow each other by their text; columns named like the added ones are replaced. An empty table
    gives no rows.
    """
    if window < 2 * PERIOD - 7:
        raise ValueError(f"a window has {2 * PERIOD - 7} words or more")
    added = ["kept_text", "n_words", "n_removed"]
    columns = [c for c in docs.columns if c not in added]
    size = docs.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    blocks = max(64, math.ceil(size / BLOCK_BYTES))
    # About 21 bytes of text an anchor.
    bucket_bits = max(6, math.ceil(math.log2(max(1, size / 21 / BUCKET_HASHES))))
    # Under a name that no column has.
    name = next(n for n in (f"_block{'_' * k}" for k in range(len(columns) + 1)) if n not in {c.lower() for c in columns})
    rows = docs.select(*columns, F.pmod(F.xxhash64(id_column), F.lit(blocks)).alias(name))
    grouped = rows.groupBy(name)
    settings = (id_column, text_column, window, bucket_bits)
    anchors = grouped.applyInArrow(_ask_anchors(*settings), _ASKED)
    repeated = anchors.groupBy("bucket").applyInArrow(_tell_repeated, _TOLD)
    windows = grouped.cogroup(repeated.groupBy("block")).applyInArrow(_ask_windows(*settings), _ASKED)
    firsts = windows.groupBy("bucket").applyInArrow(_tell_first, _TOLD)
    told = repeated.withColumn("kind", F.lit(0)).unionByName(firsts.withColumn("kind", F.lit(1)))
    schema = docs.select(*columns).schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return grouped.cogroup(told.groupBy("block")).applyInArrow(_remove(*settings, columns), schema)


def repeats_removed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars", window: int = 20) -> DataFrame:
    """``docs`` with repeated passages taken out of the text, and its length put right.

    Texts without a repeat stay as they are, white space included. A document of which nothing is left is
    dropped; one that had no words stays.
    """
    done = without_repeats(docs, id_column, text_column, window).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col(text_column))
    new = {text_column: text}
    if length_column in docs.columns:
        new[length_column] = F.when(changed, F.length("kept_text").cast(docs.schema[length_column].dataType)).otherwise(F.col(length_column))
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
