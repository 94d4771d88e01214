"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled into three machines: the normaliser (a mark for each space, one more before the
text), the pieces (a trie over characters whose final nodes write a piece) and the byte fallback (a
character that no piece holds writes its bytes). Composing them with an input gives a lattice whose arcs
are pieces. The piece model merges pairs by rank, so an arc's weight depends on the piece before it: 0
if merging would leave this pair standing, infinite if some merge would go across their border first.
The tropical shortest path is then the path of weight 0, and there is one for every prefix. The weights
of scores alone would give another segmentation than the library's.

The lattice falls apart where no piece goes across: before a space mark that a sign follows, and around
signs that stand in no piece of two or more. Paths are searched for the distinct parts of a piece of
text, all side by side; a worker remembers up to ``REMEMBERED`` parts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from larder.llm.arrays import Lookup, distinct_spans, equal_spans, pieces, ragged, span_hashes

MARK = 0x2581
REMEMBERED = 400_000
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


class Machines:
    """Compiled model. ``ids`` of pieces are those of the file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        told = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or told.name != "identity" or told.remove_extra_whitespaces or not told.add_dummy_prefix:
            raise ValueError("only merge models with the identity normaliser, kept spaces and a space put before are compiled")
        self.surface = [self._bytes(p) for p in model.pieces]
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN), -1)
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[3:-1], 16)] = i
        mark = chr(MARK)
        text = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        #: A run of marks is merged from its left end after all else: as often as it goes the longest
        #: piece, then the pieces of the rest.
        self.longest = max(len(t) for t in text if not t.strip(mark))
        self.longest_id = text[mark * self.longest]
        rests = [_run(n, {len(t) for t in text if not t.strip(mark)}) for n in range(self.longest)]
        self.rest_size = np.array([len(r) for r in rests])
        self.rest_begin = np.cumsum(self.rest_size) - self.rest_size
        self.rest_ids = np.array([text[mark * k] for r in rests for k in r], np.int64)
        self.mark_id = text[mark]
        words = {t: i for t, i in text.items() if mark not in t[1:] or t == mark}
        self._merges(model, words)
        self._trie(words)

    @staticmethod
    def _bytes(p) -> bytes:
        if p.type == _BYTE:
            return bytes([int(p.piece[3:-1], 16)])
        if p.type == _NORMAL:
            return p.piece.replace(chr(MARK), " ").encode()
        return " ⁇ ".encode() if p.type == _UNKNOWN else b""

    def _merges(self, model, words: dict[str, int]) -> None:
        """Rank of each piece, the pair it is merged from, and what each pair merges to."""
        n = len(model.pieces)
        # Single signs come before all merges, in no order that matters.
        made = sorted((t for t in words if len(t) > 1), key=lambda t: -model.pieces[words[t]].score)
        self.rank = np.full(n, -1, np.int64)
        self.rank[[words[t] for t in made]] = np.arange(len(made))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys, values = [], []
        order = {t: k for k, t in enumerate(made)}
        for t in made:
            for cut in range(1, len(t)):
                a, b = words.get(t[:cut]), words.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(order[t])
            pair = _last_merge(t, order)
            if pair:
                self.left[words[t]], self.right[words[t]] = words[pair[0]], words[pair[1]]
        self.pairs = Lookup(np.array(keys, np.int64), np.array(values, np.int64))

    def _trie(self, words: dict[str, int]) -> None:
        nodes, arcs, final = 1, {}, {0: -1}
        inner = set()
        for t, i in words.items():
            if len(t) > 1:
                inner.update(map(ord, t))
                if self.left[i] < 0:
                    continue  # merging never makes it
            node = 0
            for c in map(ord, t):
                key = node << 21 | c
                if key not in arcs:
                    arcs[key], nodes = nodes, nodes + 1
                node = arcs[key]
            final[node] = i
        self.arcs = Lookup(np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int64))
        self.final = np.full(nodes, -1, np.int64)
        self.final[list(final)] = list(final.values())
        self.length = np.zeros(len(self.left), np.int64)
        for t, i in words.items():
            self.length[i] = len(t)
        self.alone = np.ones(0x110000, bool)
        self.alone[list(inner)] = False

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece a before piece b.

        Merges are undone from the last one on. Between the merge that made a piece at the border and the
        next one that takes it in, the two pieces at the border must not merge; of equal ranks the one
        further left goes first.
        """
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until = np.full(len(a), 1 << 40)  # a merge across the border of a lower rank would have come first
        while len(live):
            across = self.pairs.get(a << 20 | b, 1 << 41)
            bad = across < until
            out[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & (np.maximum(ra, rb) >= 0)
            undo_left = ra > rb
            until = np.where(undo_left, ra, rb + 1)[go]
            a, b = np.where(undo_left, self.right[a], a)[go], np.where(undo_left, b, self.left[b])[go]
            live = live[go]
        return out

    def paths(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest path of each part points[start:end]: all pieces one after the other, and their numbers."""
        lengths = ends - starts
        part = np.repeat(np.arange(len(starts)), lengths)
        signs = points[ragged(starts, lengths)].astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        stop = (begin + lengths)[part]
        # Arcs of the lattice: the trie is walked from every place at once.
        at, node, depth = np.arange(len(signs)), np.zeros(len(signs), np.int64), 0
        arc_from, arc_piece = [], []
        while len(at):
            node = self.arcs.get(node << 21 | signs[at + depth])
            ok = node >= 0
            at, node, depth = at[ok], node[ok], depth + 1
            piece = self.final[node]
            hit = piece >= 0
            arc_from.append(at[hit])
            arc_piece.append(piece[hit])
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        frm, piece = np.concatenate(arc_from), np.concatenate(arc_piece)
        step = frm - begin[part[frm]]
        order = np.argsort(step, kind="stable")
        frm, piece, step = frm[order], piece[order], step[order]
        # The only piece of weight 0 that ends before each place; a part has one place more than signs.
        last = np.full(len(signs) + len(starts), -1, np.int64)
        source, target = frm + part[frm], frm + part[frm] + self.length[piece]
        bounds = np.searchsorted(step, np.arange((step[-1] if len(step) else 0) + 2))
        for lo, hi in zip(bounds, bounds[1:]):
            before = last[source[lo:hi]]
            fine = self.stands(before, piece[lo:hi]) if lo else np.ones(hi - lo, bool)
            last[target[lo:hi][fine]] = piece[lo:hi][fine]
        # Back from the ends of all parts at once.
        place, who, found, owner = begin + lengths + np.arange(len(starts)), np.arange(len(starts)), [], []
        first = begin + np.arange(len(starts))
        while len(who):
            p = last[place]
            found.append(p)
            owner.append(who)
            place = place - np.where(p >= 0, self.length[p], 1)
            more = place > first[who]
            place, who = place[more], who[more]
        found, owner = np.concatenate(found)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        return found[order], np.bincount(owner, minlength=len(starts))


def _run(n: int, lengths: set[int]) -> list[int]:
    """Lengths of the pieces that merging the leftmost pair first leaves of n marks."""
    parts = [1] * n
    while (i := next((i for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in lengths), None)) is not None:
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def _last_merge(piece: str, order: dict[str, int]) -> tuple[str, str] | None:
    """The pair that merging makes the piece from; None if merging its signs ends elsewhere."""
    parts = list(piece)
    while len(parts) > 2:
        ranks = [order.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        i = ranks.index(min(ranks))
        if ranks[i] == 1 << 40:
            return None
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if parts[0] + parts[1] in order else None


class Encoder:
    """Encodes whole texts; remembers the paths of frequent parts between calls."""

    def __init__(self, path: str):
        self.machines = Machines(path)
        self._keys, self._at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._begin, self._size, self._pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._lead = np.zeros(0, bool)
        # The signs of each part: a part is known by them, its hash only says where to look.
        self._signs, self._sign_from, self._sign_to = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _solve(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each part without a lone leading mark, their numbers, and whether there was one."""
        m = self.machines
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        found, sizes = m.paths(points, starts, ends)
        begin = np.cumsum(sizes) - sizes
        lead = (found[begin] == m.mark_id) if len(sizes) else np.zeros(0, bool)
        keep = np.ones(len(found), bool)
        keep[begin[lead]] = False
        owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
        found = found[keep]
        # Byte fallback: such a sign is a part of its own.
        width = np.ones(len(found), np.int64)
        for i in np.flatnonzero(found < 0):
            width[i] = len(chr(points[starts[owner[i]]]).encode())
        out = np.repeat(found, width)
        edge = np.cumsum(width) - width
        for i in np.flatnonzero(found < 0):
            out[edge[i]:edge[i] + width[i]] = m.byte_id[list(chr(points[starts[owner[i]]]).encode())]
        return out.astype(np.int32), np.bincount(owner, weights=width, minlength=len(sizes)).astype(np.int64), lead

    def _known(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Pool of ids, and each distinct part's begin, size and lead in it."""
        at = np.searchsorted(self._keys, keys)
        old = (at < len(self._keys)) & (self._keys[np.minimum(at, max(len(self._keys) - 1, 0))] == keys) if len(self._keys) else np.zeros(len(keys), bool)
        same = np.flatnonzero(old)
        entry = self._at[at[same]]
        old[same] = equal_spans(points, starts[same], ends[same], self._signs, self._sign_from[entry], self._sign_to[entry])
        ids, sizes, leads = self._solve(points, starts[~old], ends[~old])
        begin, size, lead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        entry = self._at[at[old]]
        begin[old], size[old], lead[old] = self._begin[entry], self._size[entry], self._lead[entry]
        begin[~old], size[~old], lead[~old] = len(self._pool) + np.cumsum(sizes) - sizes, sizes, leads
        pool = np.concatenate([self._pool, ids])
        if len(self._keys) + len(sizes) <= REMEMBERED:
            fresh = len(self._begin) + np.arange(len(sizes))
            length = (ends - starts)[~old]
            self._sign_from = np.concatenate([self._sign_from, len(self._signs) + np.cumsum(length) - length])
            self._sign_to = np.concatenate([self._sign_to, len(self._signs) + np.cumsum(length)])
            self._signs = np.concatenate([self._signs, points[ragged(starts[~old], length)]])
            merged = np.concatenate([self._keys, keys[~old]])
            order = np.argsort(merged, kind="stable")
            self._keys, self._at = merged[order], np.concatenate([self._at, fresh])[order]
            self._begin, self._size = np.concatenate([self._begin, begin[~old]]), np.concatenate([self._size, sizes])
            self._lead, self._pool = np.concatenate([self._lead, leads]), pool
        return pool, begin, size, lead

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and len + 1 offsets."""
        m = self.machines
        mark = chr(MARK)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer("".join(mark + t for t in texts if t).replace(" ", mark).encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        solid, alone = points != MARK, m.alone[points]
        alone &= solid
        border = np.zeros(n + 1, bool)
        border[edges] = True
        prev_solid = np.concatenate([[False], solid[:-1]])
        prev_alone = np.concatenate([[False], alone[:-1]])
        begins = np.flatnonzero(solid & (~prev_solid | alone | prev_alone))
        # Marks before a place, back to the last solid sign or the text's edge.
        index = np.arange(n + 1)
        stop = np.zeros(n + 1, np.int64)
        stop[1:][solid] = index[1:][solid]
        stop[border] = np.maximum(stop[border], index[border])
        stop = np.maximum.accumulate(stop)
        gap = begins - stop[begins]
        # A text's edge itself begins with marks, so the run that starts there is counted from it.
        taken = (gap > 0) & ~alone[begins]
        starts = begins - taken
        closed = np.concatenate([~solid | alone | border[:-1], [True]])
        stops = np.flatnonzero(closed)
        ends = np.where(alone[begins], begins + 1, stops[np.searchsorted(stops, begins + 1)])
        runs = gap - taken
        # Marks at the end of a text stand for themselves.
        last = edges[1:][lengths > 0]
        tail = np.where(solid[last - 1], 0, last - np.maximum.accumulate(np.where(solid | border[:-1], index[:-1] + solid, 0))[last - 1])
        texts_of = np.flatnonzero(lengths)[tail > 0]
        tail_at, tail = last[tail > 0], tail[tail > 0]

        key = span_hashes(points.astype(np.uint64) + np.uint64(1), starts, ends)
        first, which = distinct_spans(points, starts, ends, key)
        pool, begin, size, lead = self._known(key[first], points, starts[first], ends[first])
        # Parts and trailing runs in the order of the text.
        place = np.concatenate([begins, tail_at - 1])
        run = np.concatenate([runs + lead[which], tail])
        begin, size = np.concatenate([begin[which], np.zeros(len(tail), np.int64)]), np.concatenate([size[which], np.zeros(len(tail), np.int64)])
        if len(tail):
            order = np.argsort(place, kind="stable")
            place, run, begin, size = place[order], run[order], begin[order], size[order]
        full, rest = run // m.longest, run % m.longest
        tails = m.rest_size[rest]
        marks = full + tails
        total = marks + size
        out = np.empty(int(total.sum()), np.int32)
        spot = np.cumsum(total) - total
        out[ragged(spot + marks, size)] = pool[ragged(begin, size)]
        some = np.flatnonzero(marks)
        out[ragged(spot[some], full[some])] = m.longest_id
        out[ragged((spot + full)[some], tails[some])] = m.rest_ids[ragged(m.rest_begin[rest[some]], tails[some])]
        sums = np.concatenate([[0], np.cumsum(total)])
        return out, sums[np.searchsorted(place, edges)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD, control pieces nothing."""
        raw = b"".join(map(self.machines.surface.__getitem__, ids.tolist()))
        if len(ids) and raw[:1] == b" " and self.machines.surface[ids[0]][:1] == b" " and ids[0] != self.machines.unknown:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str, text_column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of piece ids added; a column of that name is replaced.

    NULL and empty texts have no ids. Rows stay as they are, repeated ones too; texts of any length are
    encoded whole.
    """
    kept = [c for c in docs.columns if c != ids]

    def run(batches):
        worker = encoder(path)
        for batch in pieces(batches, text_column):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_column)).to_pylist()]
            flat, offsets = worker.encode(texts)
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], column], [*kept, ids])

    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids added; a NULL list is an empty text."""
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        worker = encoder(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [worker.decode(np.array(x or [], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.string())], [*kept, text])

    return rows.mapInArrow(run, rows.select(*kept).schema.add(text, "string"))


def coded(docs: DataFrame, path: str, text_column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with piece ids added and the text decoded from them again, in one pass; else as ``encoded``."""
    kept = [c for c in docs.columns if c != ids]

    def run(batches):
        worker = encoder(path)
        for batch in pieces(batches, text_column):
            flat, offsets = worker.encode([t or "" for t in batch.column(batch.schema.get_field_index(text_column)).to_pylist()])
            back = pa.array([worker.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[back if c == text_column else batch.column(batch.schema.get_field_index(c)) for c in kept], column], [*kept, ids])

    return docs.mapInArrow(run, docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType())))


def piece_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_pieces, ids_sha256, decoded_sha256, round_trip): encoding and decoding in one pass.

    ids_sha256 is over the ids as little-endian 32-bit numbers; round_trip says that decoding gives the
    text back.
    """
    rows = docs.selectExpr(f"`{id_column}` AS `{id_column}`", f"`{text_column}` AS text")

    def run(batches):
        worker = encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            flat, offsets = worker.encode(texts)
            parts = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
            back = [worker.decode(x) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(np.diff(offsets), pa.int64()),
                 pa.array([sha(x.astype("<i4").tobytes()) for x in parts]), pa.array([sha(t.encode()) for t in back]), pa.array([a == b for a, b in zip(texts, back)], pa.bool_())],
                [id_column, "n_bytes", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, n_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
