"""Alignment of the tokens of two tokenizers over the same bytes, by galloping intersection of their ends.

Both token lists of a text cover the same bytes, so a token is known by its end. The shorter list of ends
drives: each of its ends is looked for in the longer one by doubling steps from a guess and by halving the
interval that they leave. Ends in both lists cut the tokens into groups; the difference of two neighbouring
ranks is the range of tokens that a token overlaps.

How often an id pair is linked is a sum over the corpus. A text keeps its distinct pairs with their numbers
in a stored table; the sums are sent back to it in ranges of pairs of bounded size, one after the other. There
are at most as many pairs as the product of the two vocabularies, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from larder.llm.arrays import byte_column, give_back, pieces, ragged
from larder.session import checkpoint_root, cut_lineage

#: Pairs that a task gathers before it hands their counts on, and pairs of a range that is broadcast.
HELD_PAIRS, RANGE_PAIRS = 4 << 20, 4 << 20


# ---------------------------------------------------------------- tokenizers

class _Side:
    """A tokenizer with the bytes of each of its ids; ids without bytes of their own have none."""

    def __init__(self, encode, surface: list[bytes]):
        self.encode, self.size = encode, len(surface)
        self.length = np.array([len(x) for x in surface], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(surface), np.uint8)
        width = len(str(self.size))
        #: Decimal digits of every id, left in their row, with room for a sign after them.
        self.digits = np.zeros((self.size, width + 1), np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(self.size)], np.int64)
        for i in range(self.size):
            self.digits[i, :self.n_digits[i]] = np.frombuffer(str(i).encode(), np.uint8)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text."""
        lists = self.encode(texts)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum())), counts


def _signs() -> dict[str, int]:
    """Of a byte-level vocabulary the sign of each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(path: str) -> _Side:
    """Byte-level merges, run over the vocabulary as ranks, which is the same if merges make ids in their order."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
    signs = _signs()
    raw = {bytes(signs[c] for c in token): i for token, i in vocabulary.items()}
    made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
    before = told.get("pre_tokenizer") or {}
    if made != sorted(made) or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or told.get("normalizer"):
        raise ValueError("only byte-level merges in the order of their ids, with the usual cut into words, are run")
    # Fixed form: the pattern of the byte-level cut into words.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    machine = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=raw, special_tokens={})
    surface = [b""] * (max(raw.values()) + 1)
    for token, i in raw.items():
        surface[i] = token
    return _Side(lambda texts: [machine.encode_ordinary(" " + t) for t in texts], surface)


def _pieces(path: str) -> _Side:
    """Pieces of a model that puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    surface = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
    return _Side(lambda texts: model.encode(texts, num_threads=1), surface)


@lru_cache(4)
def side(path: str) -> _Side:
    return _pieces(path) if path.endswith(".model") else _byte_level(path)


# ---------------------------------------------------------------- galloping

def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each end of ``short`` how many of ``long`` are smaller; both ascend, ``guess`` is where to start."""
    if not len(long):
        return np.zeros(len(short), np.int64)
    low, high = np.zeros(len(short), np.int64), np.full(len(short), len(long), np.int64)
    at = np.clip(guess, 0, len(long) - 1)
    smaller = long[at] < short
    for up, live in ((True, np.flatnonzero(smaller)), (False, np.flatnonzero(~smaller))):
        step = 1
        place = at[live]
        while len(live):
            (low if up else high)[live] = place + 1 if up else place
            to = place + step if up else place - step
            inside = (to < len(long)) if up else (to >= 0)
            live, to = live[inside], to[inside]
            past = (long[to] >= short[live]) if up else (long[to] < short[live])
            (high if up else low)[live[past]] = to[past] if up else to[past] + 1
            live, place = live[~past], to[~past]
            step *= 2
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        less = long[middle] < short[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
        live = live[low[live] < high[live]]
    return low


class Aligned:
    """Tokens of some texts on both sides with their groups and links. Texts that either side doesn't give back have none."""

    def __init__(self, texts: list[str], a: _Side, b: _Side):
        self.a_side, self.b_side = a, b
        lead = [" " + t if t else "" for t in texts]
        data, offsets = byte_column(pa.array([x.encode("utf-8", "surrogatepass") for x in lead], pa.large_binary()))
        self.a, self.n_a = self._true(a, texts, data, offsets)
        self.b, self.n_b = self._true(b, texts, data, offsets)
        both = (self.n_a > 0) & (self.n_b > 0)
        for name in "ab":
            n = getattr(self, f"n_{name}")
            setattr(self, name, getattr(self, name)[np.repeat(both, n)])
            setattr(self, f"n_{name}", np.where(both, n, 0))
        self.first_a, self.first_b = (np.cumsum(n) - n for n in (self.n_a, self.n_b))
        self._align(np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b]))

    @staticmethod
    def _true(s: _Side, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of the texts whose tokens join to their bytes."""
        ids, counts = s.tokens([t for t in texts if t])
        n = np.zeros(len(texts), np.int64)
        n[[i for i, t in enumerate(texts) if t]] = counts
        length = s.length[ids]
        edges = np.concatenate([[0], np.cumsum(length)])
        spans = np.concatenate([[0], np.cumsum(n)])
        sizes = np.diff(edges[spans])
        good = (sizes == np.diff(offsets)) & (n > 0)
        keep = np.repeat(good, n)
        ids, n = ids[keep], np.where(good, n, 0)
        joined = s.data[ragged(s.first[ids], s.length[ids])]
        meant = data[ragged(offsets[:-1][good], np.diff(offsets)[good])]
        wrong = np.concatenate([[0], np.cumsum(joined != meant)])
        ends = np.cumsum(sizes[good])
        same = np.zeros(len(texts), bool)
        same[good] = wrong[ends] == wrong[ends - sizes[good]]
        keep = np.repeat(same, n)
        return ids[keep], np.where(same, n, 0)

    def _align(self, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        common_a, common_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
        links = []
        a_drives = self.n_a <= self.n_b
        for texts, swap in ((np.flatnonzero(a_drives & (self.n_a > 0)), False), (np.flatnonzero(~a_drives), True)):
            one, two = ("b", "a") if swap else ("a", "b")
            n_short, n_long = getattr(self, f"n_{one}")[texts], getattr(self, f"n_{two}")[texts]
            short = ragged(getattr(self, f"first_{one}")[texts], n_short)
            long = ragged(getattr(self, f"first_{two}")[texts], n_long)
            s, t = (ends_b[short], ends_a[long]) if swap else (ends_a[short], ends_b[long])
            # Both lists of a text run over the same bytes: start at the same share of the way.
            nth = np.arange(len(short)) - np.repeat(np.cumsum(n_short) - n_short, n_short)
            guess = np.repeat(np.cumsum(n_long) - n_long, n_short) + nth * np.repeat(n_long, n_short) // np.maximum(np.repeat(n_short, n_short), 1)
            rank = gallop(s, t, guess)
            common = t[np.minimum(rank, max(len(t) - 1, 0))] == s if len(t) else np.zeros(0, bool)
            begin = np.concatenate([[0], (rank + common)[:-1]]).astype(np.int64)[:len(rank)]
            overlap = rank - begin + 1
            pair = np.repeat(short, overlap), long[ragged(begin, overlap)]
            links.append(pair[::-1] if swap else pair)
            (common_b if swap else common_a)[short[common]] = True
            (common_a if swap else common_b)[long[rank[common]]] = True
        self.common_a, self.common_b = common_a, common_b
        self.link_a, self.link_b = (np.concatenate([x[k] for x in links]).astype(np.int64) for k in (0, 1))

    def per_text(self, of: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of)])
        return sums[first + n] - sums[first]

    def n_groups(self) -> np.ndarray:
        return self.per_text(self.common_a, self.first_a, self.n_a)

    def groups(self) -> list[bytes]:
        """Of every text ``a1,a2|b1;a3|b2,b3``: the ids of its groups."""
        number_a, number_b = (np.cumsum(c) - c for c in (self.common_a, self.common_b))
        # Tokens of the other side that come before: all of earlier groups, and of the same one if they are of side a.
        a_at = np.arange(len(self.a)) + np.searchsorted(number_b, number_a, "left")
        b_at = np.arange(len(self.b)) + np.searchsorted(number_a, number_b, "right")
        n = len(self.a) + len(self.b)
        width = max(self.a_side.digits.shape[1], self.b_side.digits.shape[1])
        rows, size = np.zeros((n, width), np.uint8), np.empty(n, np.int64)
        for s, ids, at, common, last in ((self.a_side, self.a, a_at, self.common_a, b"|"), (self.b_side, self.b, b_at, self.common_b, b";")):
            rows[at, :s.digits.shape[1]] = s.digits[ids]
            size[at] = s.n_digits[ids]
            rows[at, s.n_digits[ids]] = np.where(common, last[0], b","[0])
        flat = rows[np.arange(width) <= size[:, None]].tobytes()
        edges = np.concatenate([[0], np.cumsum(size + 1)])
        begin, end = edges[self.first_a + self.first_b], edges[self.first_a + self.n_a + self.first_b + self.n_b]
        return [flat[x:max(x, y - 1)] for x, y in zip(begin.tolist(), end.tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs text by text, how often each is linked there, where each text's pairs begin, and its links."""
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.link_a]
        every = self.a_side.size * self.b_side.size
        pair = self.a[self.link_a] * self.b_side.size + self.b[self.link_b]
        key, times = np.unique(text * every + pair, return_counts=True)
        edges = np.searchsorted(key, np.arange(len(self.n_a) + 1) * every)
        return key % every, times, edges, np.bincount(text, minlength=len(self.n_a))


# ---------------------------------------------------------------- stored pairs

def _packed(pairs: np.ndarray, times: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Ascending pairs as differences, and their numbers, byte place by byte place."""
    planes = [np.diff(pairs, prepend=0).astype("<u8"), times.astype("<u8")]
    return press.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in planes))


def _unpacked(raw: bytes, n: int, press: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(press.decompress(raw, 16 * n), np.uint8).reshape(2, 8, n)
    back = lambda x: np.ascontiguousarray(x.T).view("<i8").ravel()
    return np.cumsum(back(both[0])), back(both[1])


def _align(path_a: str, path_b: str, kept: list[str], with_groups: bool):
    def run(batches):
        a, b, press = side(path_a), side(path_b), zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "_text"):
            found = Aligned([t or "" for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()], a, b)
            pairs, times, edges, links = found.pairs()
            groups = found.groups()
            new = {"n_a": pa.array(found.n_a, pa.int64()), "n_b": pa.array(found.n_b, pa.int64()), "n_groups": pa.array(found.n_groups(), pa.int64()), "n_links": pa.array(links, pa.int64()),
                   "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())}
            if with_groups:
                new["groups"] = pa.array([g.decode() for g in groups], pa.string())
            new["_n"] = pa.array(np.diff(edges), pa.int64())
            new["_pairs"] = pa.array([_packed(pairs[x:y], times[x:y], press) if y > x else b"" for x, y in zip(edges, edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *new.values()], [*kept, *new])
            give_back()
    return run


def _lists(batch: pa.RecordBatch):
    """Pairs and numbers of all rows one after the other, and the row of each."""
    press = zstandard.ZstdDecompressor()
    sizes = np.asarray(batch.column(batch.schema.get_field_index("_n")))
    raws = batch.column(batch.schema.get_field_index("_pairs")).to_pylist()
    found = [_unpacked(x, n, press) for x, n in zip(raws, sizes) if n]
    join = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
    return join(0), join(1), np.repeat(np.arange(len(sizes)), sizes)


def _sum_pairs(batches):
    """Rows (pair, links): sums of a task."""
    held, n = [], 0

    def rows():
        pair, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = np.bincount(which, weights=np.concatenate([h[1] for h in held]).astype(float), minlength=len(pair)).astype(np.int64)  # exact below 2 ** 53
        for x in range(0, len(pair), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pair[x:x + (1 << 16)]), pa.array(sums[x:x + (1 << 16)])], ["pair", "links"])
        give_back()

    for batch in batches:
        pairs, times, _ = _lists(batch)
        held.append((pairs, times))
        n += len(pairs)
        if n >= HELD_PAIRS:
            yield from rows()
            held, n = [], 0
    if n:
        yield from rows()


def _add(known):
    """Rows (row, n_best, count_sum): what the links of a range of pairs add to each text."""
    def run(batches):
        pair, links, best = known.value
        for batch in batches:
            pairs, times, row = _lists(batch)
            inside = (pairs >= pair[0]) & (pairs <= pair[-1])
            pairs, times, row = pairs[inside], times[inside], row[inside]
            at = np.searchsorted(pair, pairs)
            n_best, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, row, times * best[at])
            np.add.at(sums, row, times * links[at])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_row")), pa.array(n_best), pa.array(sums)], ["_row", "n_best", "count_sum"])
    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, text_column: str = "text", groups: bool = False, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 added.

    Side a is a byte-level vocabulary (.json) that gets a space and the text, side b a piece model (.model) that
    puts that space itself. Two tokens are linked if their byte ranges overlap. An id pair's count is the number
    of links in the whole corpus that hold it; n_best counts the links whose count is the highest of their b id,
    count_sum adds the counts up. ``groups`` also adds the groups as text. NULL and empty texts and those that
    either side doesn't give back byte by byte have no tokens: zeros and ''. Rows stay as they are, repeated ones
    count each time; columns named like the added ones are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    kept = [c for c in docs.columns if c != text_column and c not in added]
    source = docs.select(*kept, F.monotonically_increasing_id().alias("_row"), F.col(text_column).cast("string").alias("_text"))
    schema = docs.select(*kept).schema.add("_row", "long")
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")
    if groups:
        schema = schema.add("groups", "string")
    folder = f"{checkpoint_root(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    (source.mapInArrow(_align(path_a, path_b, [*kept, "_row"], groups), schema.add("_n", "long").add("_pairs", "binary"))
     .write.option("compression", "none").parquet(folder))
    stored = spark.read.parquet(folder)
    links = stored.select("_n", "_pairs").mapInArrow(_sum_pairs, "pair bigint, links bigint").groupBy("pair").agg(F.sum("links").alias("links"))
    links = cut_lineage(links.withColumn("b", F.col("pair") % side(path_b).size))
    highest = links.groupBy("b").agg(F.max("links").alias("_most"))
    judged = links.join(highest, "b").select("pair", "links", (F.col("links") == F.col("_most")).alias("best"))
    n = links.count()
    ranges = max(1, math.ceil(n / range_pairs))
    cuts = links.agg(F.percentile_approx("pair", [i / ranges for i in range(1, ranges)], 100_000).alias("c")).first()["c"] if ranges > 1 else []
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = judged.filter((F.lit(True) if low is None else F.col("pair") > low) & (F.lit(True) if high is None else F.col("pair") <= high))
        table = inside.toArrow().sort_by("pair")
        if not table.num_rows:
            continue
        known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "links", "best")))
        parts.append(cut_lineage(stored.select("_row", "_n", "_pairs").mapInArrow(_add(known), "_row bigint, n_best bigint, count_sum bigint")))
        known.destroy()
    if not parts:
        sums = spark.createDataFrame([], "_row bigint, n_best bigint, count_sum bigint")
    else:
        sums = reduce(DataFrame.unionAll, parts).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    order = [c for c in added if c != "groups" or groups]
    return (stored.drop("_n", "_pairs").join(sums, "_row", "left")
            .select(*kept, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) if c in ("n_best", "count_sum") else F.col(c) for c in order]))
