"""Phrases of words that stand together more often than their parts would, counted through tries.

Candidates are Apriori-safe: none that occurs ``least`` times is missed, and so none of its parts either, as
they occur at least as often. They are found by their hashes, whose counts are summed over the corpus in buckets
that grow with it; equal hashes only let a phrase through that is then counted and found too rare, so no result
depends on a hash.

Phrases are counted by double-array tries: symbols are bytes of word codes, and the state after one is
``base[state] + symbol`` where ``check`` names the state before. If the safe hashes are few, the texts are read for
the phrases that have one, and the trie of these is broadcast; every task moves the states of all its text positions
one word further at a time, counts the accepting states in one array, and the arrays of all tasks are summed.

Many safe hashes would take many such tries, and a pass over the texts each. Then the texts are sent to the tries, in
one pass for all: from every word on, its walk is as many words as have safe hashes, and the walks of every few
megabytes of text go, each once with how often it occurs, to a shard by their hash. A shard's trie takes its walks word
by word, adds their numbers up in the states behind each word, and the counts of all shards are summed. All
that is broadcast is a bitmap of the safe hashes, of bounded size: a fuller one sends longer walks, no other counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.llm.arrays import Lookup, _LOWER, byte_column, equal_spans, give_back, mix, pieces, quick_hashes, ragged
from larder.operators.prefix import top_n_per_group
from larder.session import cut_lineage

#: Bytes of text worked on at once, hashes a task gathers before it hands them on, hashes a bucket is made for.
BATCH_BYTES, HELD_HASHES, BUCKET_HASHES = 4 << 20, 4 << 20, 1 << 20
#: Phrases of a trie: bounds what is broadcast and, with the bytes of text whose walks a shard is made for, what one task builds.
SHARD_PHRASES, SHARD_BYTES = 1 << 17, 16 << 20
#: Of the bitmap of safe hashes, at the most: 32 MB.
MAP_BITS = 28
#: Cuts that ask for the same part are dealt over several tasks from this share of all cuts on.
HOT_SHARE = 500

_NO_LANGUAGE = "und"
#: Of bytes: 1 parts words, 2 parts pieces.
_PARTS = np.zeros(256, np.uint8)
_PARTS[[0x20, 0x09]], _PARTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1, 2
_TURN = np.uint64(0x9E3779B97F4A7C15)


class Texts:
    """Words of many texts: byte spans, the text of each, and how many words follow in the same piece."""

    def __init__(self, column: pa.Array, languages: list[str | None]):
        data, offsets = byte_column(column)
        self.data = _LOWER[data]
        self.languages, self.language_of = _coded([x if x is not None else _NO_LANGUAGE for x in languages])
        parts = _PARTS[data]
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = self.solid = parts == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(self.starts, offsets)))
        self.next = np.zeros(len(self.starts), bool)
        if len(self.starts) > 1:
            between = np.maximum.reduceat(parts, np.stack([self.ends[:-1], self.starts[1:]], axis=1).ravel())[::2]
            self.next[:-1] = (between < 2) & (self.text[1:] == self.text[:-1])

    @cached_property
    def vocabulary(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word among the distinct words, and these."""
        edges = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(edges), pa.py_buffer(self.data[self.solid])])
        encoded = words.dictionary_encode()
        return np.asarray(encoded.indices).astype(np.int64), encoded.dictionary

    @cached_property
    def word_hashes(self) -> np.ndarray:
        code, words = self.vocabulary
        data, edges = byte_column(words)
        return quick_hashes(data.astype(np.uint64) + np.uint64(1), edges[:-1], edges[1:])[code]

    def word_languages(self) -> np.ndarray:
        return self.language_of[self.text]

    def places(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words within one piece."""
        n = max(0, len(self.starts) - size + 1)
        inside = np.ones(n, bool)
        for k in range(size - 1):
            inside &= self.next[k:k + n]
        return np.flatnonzero(inside)

    def hashes(self, longest: int) -> list[np.ndarray]:
        """Per size from 1 on the hashes of the phrases at ``places``; a language has hashes of its own."""
        words = self.word_hashes
        names = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.languages] or [0], np.uint64)
        run = names[self.word_languages()] if len(words) else words
        out = []
        with np.errstate(over="ignore"):
            for size in range(1, longest + 1):
                at = self.places(size)
                run = mix(run[:len(words) - size + 1] * _TURN + words[size - 1:]) if len(words) >= size else np.zeros(0, np.uint64)
                out.append(run[at])
        return out


def _first(kind: np.ndarray, kinds: int) -> np.ndarray:
    """Where each kind stands first."""
    first = np.empty(kinds, np.int64)
    first[kind[::-1]] = np.arange(len(kind))[::-1]  # of several the first one stays
    return first


def _coded(values: list) -> tuple[list, np.ndarray]:
    """Distinct values and the code of each."""
    names: dict = {}
    codes = np.fromiter((names.setdefault(v, len(names)) for v in values), np.int64, len(values))
    return list(names), codes


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    for batch in pieces(batches, "text", BATCH_BYTES):
        yield Texts(batch.column(0), batch.column(1).to_pylist())


# ---------------------------------------------------------------- Apriori-safe hashes

def _hash_counts(longest: int, least: int, bucket_bits: int):
    """Rows (bucket, hashes, counts): all hashes of a task with their counts, cut off at ``least``."""
    shift = np.uint64(64 - bucket_bits)

    def rows(hashes: np.ndarray) -> pa.RecordBatch:
        # A bucket's number and 32 more bits name a hash; counts only matter up to ``least``.
        short, counts = np.unique(hashes >> np.uint64(32 - bucket_bits), return_counts=True)
        bucket = (short >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        bounds = list(zip(cuts, np.append(cuts[1:], len(short))))
        rest, few = (short & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts, least).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts]), pa.array([rest[a:b].tobytes() for a, b in bounds], pa.binary()), pa.array([few[a:b].tobytes() for a, b in bounds], pa.binary())],
            ["bucket", "hashes", "counts"])

    def run(batches):
        held, n = [], 0
        for texts in _texts(batches):
            for found in texts.hashes(longest):
                held.append(found)
                n += len(found)
            if n >= HELD_HASHES:
                yield rows(np.concatenate(held))
                held, n = [], 0
                give_back()
        if n:
            yield rows(np.concatenate(held))
        give_back()
    assert least < 256 and shift
    return run


def _safe_hashes(least: int):
    """Of a bucket the hashes that occur at least so often."""
    def run(table: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()])
        few = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        order = np.argsort(every, kind="stable")
        every, sums = every[order], np.concatenate([[0], np.cumsum(few[order], dtype=np.int64)])
        cuts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        ends = np.append(cuts[1:], len(every))
        good = every[cuts[sums[ends] - sums[cuts] >= least]]
        return pa.table({"bucket": table.column("bucket")[:1], "n": pa.array([len(good)], pa.int64()), "hashes": pa.array([good.tobytes()], pa.binary())})
    return run


# ---------------------------------------------------------------- phrases of a shard

class Safe:
    """Whether hashes are among those of a shard: a bitmap first, then the sorted hashes."""

    def __init__(self, short: np.ndarray, bucket_bits: int):
        self.short, self.shift = np.sort(short), np.uint64(32 - bucket_bits)
        self.bits = max(10, (16 * len(short)).bit_length())
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._spot(self.short)] = True

    def _spot(self, short: np.ndarray) -> np.ndarray:
        return ((short * _TURN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        if not len(self.short):
            return out
        short = hashes >> self.shift
        with np.errstate(over="ignore"):
            near = np.flatnonzero(self.map[self._spot(short)])
        at = np.minimum(np.searchsorted(self.short, short[near]), len(self.short) - 1)
        out[near[self.short[at] == short[near]]] = True
        return out


def _phrases(longest: int, safe, bucket_bits: int):
    """Rows (lang, phrase): the distinct phrases with a safe hash of every few megabytes of text."""
    def run(batches):
        short = [np.frombuffer(x, np.uint32).astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)) for bucket, x in safe.value]
        known = Safe(np.concatenate(short) if short else np.zeros(0, np.uint64), bucket_bits)
        del short
        for texts in _texts(batches):
            code, words = texts.vocabulary
            lead, languages, bits = _first(code, len(words)), texts.word_languages(), len(words).bit_length()
            for size, hashes in enumerate(texts.hashes(longest), 1):
                at = texts.places(size)[known.holds(hashes)]
                if not len(at):
                    continue
                # Numbers of equal words are equal, so a key of them tells phrases apart; one too long for a number is built in two steps.
                key, short = languages[at], size * bits + len(texts.languages).bit_length() < 63
                for k in range(size):
                    key = (key if short else pd.factorize(key)[0]) << bits | code[at + k]
                if short:
                    key = pd.unique(key)
                    words = np.stack([lead[key >> bits * (size - 1 - k) & (1 << bits) - 1] for k in range(size)], axis=1)
                    language = key >> bits * size
                else:
                    at = at[np.unique(key, return_index=True)[1]]
                    words, language = at[:, None] + np.arange(size), languages[at]
                yield pa.RecordBatch.from_arrays([pa.array(texts.languages, pa.string()).take(pa.array(language)), _joined(texts, words)], ["lang", "phrase"])
            give_back()
    return run


def _joined(texts: Texts, words: np.ndarray) -> pa.Array:
    """Of each row of word numbers the words, joined by one space."""
    n, size = words.shape
    words = words.ravel()
    starts, sizes = texts.starts[words], (texts.ends - texts.starts)[words]
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    spot = np.cumsum(sizes + 1) - (sizes + 1)
    out[ragged(spot, sizes)] = texts.data[ragged(starts, sizes)]
    begin = spot[::size]
    end = np.append(begin[1:], len(out)) - 1
    # Without the space after each phrase's last word.
    out = out[ragged(begin, end - begin)]
    edges = np.concatenate([[0], np.cumsum(end - begin)])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


# ---------------------------------------------------------------- double-array trie

class Trie:
    """Double array over the bytes of word codes. ``phrase`` of a state is the number of the phrase that ends there, or -1."""

    def __init__(self, languages: list[str], words: pa.Array, base: np.ndarray, check: np.ndarray, phrase: np.ndarray):
        self.base, self.check, self.phrase, self.languages = base, check, phrase, languages
        self.root = {x: i for i, x in enumerate(languages)}
        self.data, offsets = byte_column(words)
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self.shifts = _shifts(len(self.starts))
        hashes = quick_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        first = np.flatnonzero(np.concatenate([[True], self.hashes[1:] != self.hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        #: Where words with a hash begin; of hashes that agree in 62 bits the smallest one's.
        self.where = Lookup((self.hashes[first] >> np.uint64(2)).astype(np.int64)[::-1], first[::-1])

    @staticmethod
    def build(languages: pa.Array, phrases: pa.Array) -> Trie:
        """Trie of phrases whose number is their place in the arrays; they must be distinct within a language."""
        names, language = _coded(languages.to_pylist())
        sizes, code, known, _ = _spelt(phrases)
        (base, check), behind = _grown(len(names), language, sizes, code, len(known))
        phrase = np.full(len(check), -1, np.int32)
        phrase[behind[np.cumsum(sizes) - 1]] = np.arange(len(sizes))
        return Trie(names, known, base, check, phrase)

    def codes(self, texts: Texts) -> np.ndarray:
        """Code of every word of the texts, -1 where the trie has no such word."""
        out = np.full(len(texts.starts), -1, np.int64)
        if not len(self.hashes):
            return out
        hashes = texts.word_hashes
        at = self.where.get((hashes >> np.uint64(2)).astype(np.int64))
        open_ = np.flatnonzero(at >= 0)
        at = at[open_]
        while len(open_):  # once, unless several words share a hash
            near = np.flatnonzero(at < len(self.hashes))
            near = near[self.hashes[at[near]] >> np.uint64(2) == hashes[open_[near]] >> np.uint64(2)]
            open_, at = open_[near], at[near]
            word = self.order[at]
            same = equal_spans(texts.data, texts.starts[open_], texts.ends[open_], self.data, self.starts[word], self.ends[word])
            out[open_[same]] = word[same]
            open_, at = open_[~same], at[~same] + 1
        return out

    def count(self, texts: Texts, longest: int, into: np.ndarray) -> None:
        """Adds the occurrences of every phrase in the texts."""
        code = self.codes(texts)
        roots = np.array([self.root.get(x, -1) for x in texts.languages] or [-1], np.int64)
        at = np.arange(len(code))
        state = roots[texts.word_languages()] if len(code) else code
        for word in range(longest):
            on = (state >= 0) & (code[np.minimum(at + word, len(code) - 1)] >= 0) if len(at) else np.zeros(0, bool)
            if word:
                on &= texts.next[at + word - 1]
            at, state = at[on], state[on]
            for shift in self.shifts:
                to = self.base[state] + (code[at + word] >> shift & 255)
                good = (to >= 0) & (to < len(self.check))
                good[good] = self.check[to[good]] == state[good]
                at, state = at[good], to[good]
            ended = self.phrase[state]
            into += np.bincount(ended[ended >= 0], minlength=len(into))


def _spelt(phrases: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of each phrase, their codes one after the other, the words in the order of their codes, bytes of each word that has a code."""
    lists = pc.split_pattern(phrases.cast(pa.large_string()), " ")
    flat = lists.flatten()
    encoded = flat.dictionary_encode()
    symbol = np.asarray(encoded.indices).astype(np.int64)
    # Frequent words get small codes, which share their first bytes.
    by_use = np.argsort(-np.bincount(symbol, minlength=len(encoded.dictionary)), kind="stable")
    code = np.empty(len(by_use), np.int64)
    code[by_use] = np.arange(len(by_use))
    return np.asarray(pc.list_value_length(lists)).astype(np.int64), code[symbol], encoded.dictionary.take(pa.array(by_use)), np.asarray(pc.binary_length(flat)).astype(np.int64)


def _grown(roots: int, root: np.ndarray, sizes: np.ndarray, code: np.ndarray, words: int, apart: bool = False) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Base and check of the trie of phrases of so many words each, and the state behind every word of them."""
    place, behind = _Placement(roots, apart), np.empty(len(code), np.int64)
    start, live, state = np.cumsum(sizes) - sizes, np.arange(len(sizes)), root
    word = 0
    while len(live):
        for shift in _shifts(words):
            state = place.children(state, code[start[live] + word] >> shift & 255)
        behind[start[live] + word] = state
        word += 1
        on = sizes[live] > word
        live, state = live[on], state[on]
    return place.arrays(), behind


def _shifts(words: int) -> range:
    """Of the bytes of a code, the first one first."""
    return range(8 * (max(1, (max(words - 1, 1).bit_length() + 7) // 8) - 1), -1, -8)


class _Placement:
    """Finds room in the double array for the children of one level after the other.

    Siblings share gaps with others, so that a trie to be sent is small; ``apart``, they get all states from the first
    to the last, which needs no search.
    """

    def __init__(self, roots: int, apart: bool = False):
        self.apart, size = apart, max(1024, 2 * roots)
        self.used, self.base, self.check = np.zeros(size, bool), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.used[:roots] = True
        #: Behind it nothing is taken; before ``low`` nearly everything.
        self.end, self.low = roots, 0

    def _grow(self, size: int) -> None:
        if size > len(self.used):
            more = max(size, 2 * len(self.used)) - len(self.used)
            self.used = np.concatenate([self.used, np.zeros(more, bool)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def children(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """State of each (parent, symbol); equal ones share one."""
        keys, which = np.unique(parent << 8 | symbol, return_inverse=True)
        parents, symbols = keys >> 8, keys & 255
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        states = np.empty(len(keys), np.int64)
        order = np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes > 1)]
        if self.apart:
            self._side_by_side(states, parents, symbols, first[order], sizes[order])
        for i in order if not self.apart else ():
            mine = symbols[first[i]:first[i] + sizes[i]]
            base = self._room(mine)
            states[first[i]:first[i] + sizes[i]] = base + mine
            self.used[base + mine] = True
            self.end = max(self.end, base + int(mine[-1]) + 1)
            self.base[parents[first[i]]] = base
        # An only child fits wherever a place is free.
        lone = first[sizes == 1]
        self._grow(self.end + len(lone))
        states[lone] = np.flatnonzero(~self.used[:self.end + len(lone)])[:len(lone)]
        self.used[states[lone]] = True
        self.end = max(self.end, int(states[lone].max(initial=-1)) + 1)
        self.base[parents[lone]] = states[lone] - symbols[lone]
        self.check[states] = parents
        return states[which]

    def _side_by_side(self, states: np.ndarray, parents: np.ndarray, symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        least = symbols[first]
        ends = self.end + np.cumsum(symbols[first + sizes - 1] - least + 1)
        base = np.concatenate([[self.end], ends])[:-1] - least
        at = ragged(first, sizes)
        states[at] = np.repeat(base, sizes) + symbols[at]
        self.end = int(ends[-1]) if len(ends) else self.end
        self._grow(self.end)
        self.used[states[at]] = True
        self.base[parents[first]] = base

    def _room(self, symbols: np.ndarray) -> int:
        """The first base of some near ``low`` where all children fit, else behind everything."""
        while self.low + 4096 < self.end and np.count_nonzero(self.used[self.low:self.low + 1024]) > 900:
            self.low += 1024
        self._grow(self.end + 4096)
        free = self.low + np.flatnonzero(~self.used[self.low:min(self.low + 4096, self.end)])[:max(64, 8192 // len(symbols))]
        bases = free - symbols[0]
        fits = np.flatnonzero(~self.used[bases[:, None] + symbols].any(axis=1))
        return int(bases[fits[0]]) if len(fits) else self.end - int(symbols[0])

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self.base[:self.end], self.check[:self.end]


_NUMBERED = "shard int, id bigint, lang string, phrase string"
_TRIE = "name string, value binary"
_ARRAYS = ("languages", "words", "base", "check", "phrase")


def _ipc(columns: dict[str, pa.Array]) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all().combine_chunks()


def _numbered(table: pa.Table) -> pa.Table:
    """Phrases of a shard with their numbers from 0 on."""
    table = table.sort_by([("lang", "ascending"), ("phrase", "ascending")])
    return pa.table({"shard": table.column("shard"), "id": pa.array(np.arange(table.num_rows)), "lang": table.column("lang"), "phrase": table.column("phrase")})


def _build(table: pa.Table) -> pa.Table:
    """The arrays of a shard's trie, a row each."""
    table = table.sort_by("id")
    trie = Trie.build(*(table.column(c).combine_chunks() for c in ("lang", "phrase")))
    words = pa.Array.from_buffers(pa.large_binary(), len(trie.starts), [None, pa.py_buffer(np.append(trie.starts, trie.ends[-1:]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(trie.data))])
    packed = {"languages": _ipc({"x": pa.array(trie.languages, pa.string())}), "words": _ipc({"x": words}),
              "base": trie.base.tobytes(), "check": trie.check.tobytes(), "phrase": trie.phrase.tobytes()}
    return pa.table({"name": pa.array(list(packed), pa.string()), "value": pa.array(list(packed.values()), pa.binary())})


def _sent(trie: DataFrame) -> dict:
    """Broadcasts a stored trie, one array at a time: the driver never holds more than one."""
    out = {}
    for name in _ARRAYS:
        out[name] = trie.sparkSession.sparkContext.broadcast(trie.filter(F.col("name") == name).first()["value"])
        give_back()
    return out


def _opened(sent: dict) -> Trie:
    words = _from_ipc(sent["words"].value).column("x").combine_chunks()
    arrays = (np.frombuffer(sent[c].value, np.int32) for c in ("base", "check", "phrase"))
    return Trie(_from_ipc(sent["languages"].value).column("x").to_pylist(), words, *arrays)


def _counts(longest: int, n: int, packed):
    """Rows (lang, id, f): a task's occurrences of the trie's phrases; id -1 holds a language's words."""
    def run(batches):
        machine, sums, words = _opened(packed), np.zeros(n, np.int64), {}
        for texts in _texts(batches):
            machine.count(texts, longest, sums)
            for name, k in zip(texts.languages, np.bincount(texts.word_languages(), minlength=len(texts.languages))):
                words[name] = words.get(name, 0) + int(k)
            give_back()
        some = np.flatnonzero(sums)
        for a in range(0, len(some), 1 << 16):
            part = some[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(part, pa.int64()), pa.array(sums[part], pa.int64())], ["lang", "id", "f"])
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([-1] * len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["lang", "id", "f"])
    return run


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text_column: str = "text", language_column: str = "lang",
                  shard_phrases: int = SHARD_PHRASES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, and (lang, n).

    A-Z are lower-cased; the signs ``.,;:!?`` and line ends part pieces, blanks and tabs part words. Occurrences
    lie within a piece and may overlap; n counts all words. A NULL text has no words, a NULL language is
    ``und``, repeated rows count each time, other columns don't matter. Both results are stored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_column).alias("text"), F.coalesce(F.col(language_column).cast("string"), F.lit(_NO_LANGUAGE)).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    # About three bytes of text a distinct phrase, at the most.
    bucket_bits = min(MAP_BITS - 3, max(6, math.ceil(math.log2(max(1, size / 3 / BUCKET_HASHES)))))
    safe = cut_lineage(texts.mapInArrow(_hash_counts(longest, least, bucket_bits), "bucket bigint, hashes binary, counts binary")
                       .groupBy("bucket").applyInArrow(_safe_hashes(least), "bucket bigint, n bigint, hashes binary"))
    total = safe.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total > shard_phrases:
        return _counted_by_shard(texts, longest, least, safe, total, bucket_bits, max(math.ceil(total / shard_phrases), math.ceil(size / SHARD_BYTES)))
    known = spark.sparkContext.broadcast([(r["bucket"], bytes(r["hashes"])) for r in safe.filter("n > 0").collect()])
    numbered = cut_lineage(texts.mapInArrow(_phrases(longest, known, bucket_bits), "lang string, phrase string").distinct()
                           .withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(_numbered, _NUMBERED))
    known.destroy()
    n = numbered.count()
    if not n:
        return spark.createDataFrame([], "lang string, phrase string, words int, f bigint"), spark.createDataFrame([], "lang string, n bigint")
    sent = _sent(cut_lineage(numbered.groupBy("shard").applyInArrow(_build, _TRIE)))  # of bounded size
    sums = cut_lineage(texts.mapInArrow(_counts(longest, n, sent), "lang string, id bigint, f bigint").groupBy("lang", "id").agg(F.sum("f").alias("f")))
    common = sums.filter((F.col("id") >= 0) & (F.col("f") >= least)).select("id", "f")
    found = cut_lineage(numbered.join(common, "id").select("lang", "phrase", (F.length(F.regexp_replace("phrase", "[^ ]", "")) + 1).alias("words"), "f"))
    for array in sent.values():
        array.destroy()
    return found, sums.filter("id = -1").select("lang", F.col("f").alias("n"))


# ---------------------------------------------------------------- walks of all shards

_WALKS = "shard int, langs array<string>, lines array<int>, walks binary, times binary"
_SUMS = "lang string, phrase string, words int, f bigint"


def _counted_by_shard(texts: DataFrame, longest: int, least: int, safe: DataFrame, total: int, bucket_bits: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """As ``phrase_counts``, in one pass over the texts for any number of shards."""
    map_bits = min(MAP_BITS, max(bucket_bits + 3, (16 * total).bit_length()))
    whole, part = bytearray(1 << map_bits - 3), 1 << map_bits - bucket_bits - 3
    for r in safe.filter("n > 0").mapInArrow(_bitmaps(map_bits - bucket_bits), "bucket bigint, bits binary").collect():
        whole[r["bucket"] * part:(r["bucket"] + 1) * part] = r["bits"]
    known = texts.sparkSession.sparkContext.broadcast(bytes(whole))
    del whole
    sums = texts.mapInArrow(_walks(longest, shards, known, map_bits), _WALKS).groupBy("shard").applyInArrow(_shard_counts(longest, least), _SUMS)
    sums = sums.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))
    sums = cut_lineage(sums)
    known.destroy()
    return sums.filter("words > 0"), sums.filter("words = 0").select("lang", F.col("f").alias("n"))


def _bitmaps(bits: int):
    """Of each bucket its part of the bitmap of safe hashes."""
    def run(batches):
        for batch in batches:
            parts = []
            for raw in batch.column(batch.schema.get_field_index("hashes")).to_pylist():
                part = np.zeros(1 << bits, bool)
                part[np.frombuffer(raw, np.uint32) >> np.uint32(32 - bits)] = True
                parts.append(np.packbits(part, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("bucket")), pa.array(parts, pa.binary())], ["bucket", "bits"])
    return run


def _walks(longest: int, shards: int, safe, map_bits: int):
    """Rows (shard, langs, lines, walks, times): the walks of every few megabytes of text, a line each, so many lines of each language."""
    def run(batches):
        bits, shift = np.frombuffer(safe.value, np.uint8), np.uint64(64 - map_bits)
        for texts in _texts(batches):
            n = len(texts.starts)
            if not n:
                continue
            sizes, names = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            for size, hashes in enumerate(texts.hashes(longest), 1):
                at, spot = texts.places(size), (hashes >> shift).astype(np.int64)
                on = (sizes[at] == size - 1) & (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
                sizes[at[on]], names[at[on]] = size, hashes[on]
            language = texts.word_languages()
            kind, kinds = _walk_kinds(texts, language, sizes, longest)
            first, times = _first(kind, kinds), np.bincount(kind, minlength=kinds).astype(np.uint32)
            shard = ((names[first] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard * len(texts.languages) + language[first], kind="stable")
            first, times, shard, language = first[order], times[order], shard[order], language[first[order]]
            data, edges = _lines(texts, first, sizes[first])
            cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
            runs = np.append(np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (language[1:] != language[:-1])])), len(shard))
            lists = pa.array(np.searchsorted(runs, cuts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[cuts[:-1]].astype(np.int32)),
                pa.ListArray.from_arrays(lists, pa.array(texts.languages, pa.string()).take(pa.array(language[runs[:-1]]))),
                pa.ListArray.from_arrays(lists, pa.array(np.diff(runs).astype(np.int32))),
                pa.array([data[edges[a]:edges[b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                pa.array([times[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["shard", "langs", "lines", "walks", "times"])
            give_back()
    return run


def _walk_kinds(texts: Texts, language: np.ndarray, sizes: np.ndarray, longest: int) -> tuple[np.ndarray, int]:
    """The kind of every word's walk, and how many kinds there are; walks are of one kind only if they are equal."""
    code, words = texts.vocabulary
    n, bits, key, used = len(code), len(words).bit_length(), language, len(texts.languages).bit_length()
    for k in range(longest):
        if used + bits > 62:
            key, used = pd.factorize(key)[0], n.bit_length()
        word = np.zeros(n, np.int64)
        word[:n - k] = np.where(sizes[:n - k] > k, code[k:] + 1, 0)
        key, used = key << bits | word, used + bits
    kind, kinds = pd.factorize(key)
    return kind, len(kinds)


def _lines(texts: Texts, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of so many words each, parted by one space, and where they begin and the last one ends."""
    some = np.maximum(sizes, 1)
    words = ragged(at, some)
    starts, long = texts.starts[words], np.where(np.repeat(sizes, some) > 0, texts.ends[words] - texts.starts[words], 0)
    ends = np.cumsum(long + 1)
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    out[ragged(ends - long - 1, long)] = texts.data[ragged(starts, long)]
    edges = np.concatenate([[0], ends[np.cumsum(some) - 1]])
    out[edges[1:] - 1] = 0x0A
    return out, edges


def _shard_counts(longest: int, least: int):
    """Rows (lang, phrase, words, f) of a shard: its occurrences of all phrases that its walks begin with; the empty phrase holds a language's words."""
    def run(table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(table.column("walks").to_pylist()), np.uint8)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint32).astype(np.int64)
        names, language = _coded(table.column("langs").combine_chunks().flatten().to_pylist())
        language = np.repeat(language, np.asarray(table.column("lines").combine_chunks().flatten()))
        line = data == 0x0A
        edges = np.concatenate([[0], np.flatnonzero(line) - np.arange(len(times))])
        walks = pa.Array.from_buffers(pa.large_string(), len(times), [None, pa.py_buffer(edges), pa.py_buffer(data[~line])])
        words = np.bincount(language, times, len(names)).astype(np.int64)
        once = pa.table({"lang": language, "walk": walks, "times": times}).filter(pc.not_equal(pc.binary_length(walks), 0)).group_by(["lang", "walk"], use_threads=False).aggregate([("times", "sum")])
        out = [(pa.array(names, pa.string()), pa.array([""] * len(names)), pa.array([0] * len(names), pa.int32()), pa.array(words))]
        if once.num_rows:
            walks, language, times = once.column("walk").combine_chunks(), np.asarray(once.column("lang")), np.asarray(once.column("times_sum"))
            sizes, code, known, long = _spelt(walks)
            _, behind = _grown(len(names), language, sizes, code, len(known), apart=True)
            f = np.bincount(behind, np.repeat(times, sizes)).astype(np.int64)
            state, at = np.unique(behind, return_index=True)
            start = np.cumsum(sizes) - sizes
            walk = np.searchsorted(start, at, "right") - 1
            size, f = at - start[walk] + 1, f[state]
            # A walk of all words is its longest phrase, and equal walks are in one shard.
            full = (size < longest) | (f >= least)
            at, walk, size, f = at[full], walk[full], size[full], f[full]
            data, edges = byte_column(walks)
            ends = np.cumsum(long + 1)
            long = ends[at] - np.concatenate([[0], ends])[start[walk]] - 1
            phrases = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(long)])), pa.py_buffer(data[ragged(edges[walk], long)])])
            out.append((pa.array(names, pa.string()).take(pa.array(language[walk])), phrases.cast(pa.string()), pa.array(size.astype(np.int32)), pa.array(f)))
        give_back()
        return pa.concat_tables([pa.table(list(x), ["lang", "phrase", "words", "f"]) for x in out])
    return run


# ---------------------------------------------------------------- scores

def _with_counts(asked: DataFrame, counts: DataFrame, hot_from: int) -> DataFrame:
    """Adds the count of each part that is asked for. Parts that very many cuts ask for are dealt over several tasks."""
    # As all parts together are asked for twice a cut, these are few, whatever the table.
    hot = F.broadcast(asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_from).select("lang", "part", F.lit(True).alias("_hot")))
    deals = 16
    left = asked.join(hot, ["lang", "part"], "left").withColumn("_deal", F.when(F.col("_hot"), F.pmod(F.xxhash64("phrase"), F.lit(deals))).otherwise(0).cast("int"))
    right = counts.select("lang", F.col("phrase").alias("part"), "f").join(hot, ["lang", "part"], "left")
    right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), deals - 1).otherwise(0))))
    return left.drop("_hot").join(right.drop("_hot"), ["lang", "part", "_deal"])


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact up to counts of 10 ** 15."""
    wide = [x.cast("decimal(15,0)") for x in (a, left, right)]
    return F.call_function("div", (wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)"))


def _cut(k: int) -> Column:
    """Score of the cut after ``k`` words with what it is of; NULL where the phrase is too short."""
    left, right = F.col(f"l{k}"), F.col(f"r{k}")
    return F.when(left.isNotNull(), F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is cut after each of its words into
    parts that occur l and r times; the cut with the lowest floor(1,000,000 a a / (l r)) counts, of equal ones
    the first. Phrases inside a longer one that occurs at least ``covered`` percent as often are left out. The
    ``top`` best of each language by score, then a, then phrase. An empty table gives no rows; see
    ``phrase_counts`` for NULLs and repeated rows.
    """
    counts, words = phrase_counts(docs, longest, least, **settings)
    several = counts.filter("words > 1")
    parts = F.split("phrase", " ", -1)
    cuts = several.select("lang", "phrase", F.col("f").alias("a"), parts.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    piece = lambda side, start, size: F.struct(F.lit(side).alias("side"), F.array_join(F.slice("_w", start, size), " ").alias("part"))
    asked = cuts.select("lang", "phrase", "a", "k", F.inline(F.array(piece("l", F.lit(1), F.col("k")), piece("r", F.col("k") + 1, F.size("_w")))))
    n = several.agg(F.sum(2 * (F.col("words") - 1)).alias("n")).first()["n"] or 0
    met = _with_counts(asked, counts, max(1000, n // HOT_SHARE))
    scored = met.groupBy("lang", "phrase").agg(F.first("a").alias("a"), *[
        F.max(F.when((F.col("k") == k) & (F.col("side") == x), F.col("f"))).alias(f"{x}{k}") for k in range(1, max(longest, 2)) for x in "lr"])
    lowest = scored.select("lang", "phrase", "a", F.array_min(F.array(*[_cut(k) for k in range(1, max(longest, 2))])).alias("_cut"))
    # A phrase lies in a longer one if it lies in a chain of phrases that are one word longer each; counts only fall along it.
    inner = several.filter("words > 2").select("lang", "f", F.explode(_inner(parts, longest)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a")))
    best = _near_the_top(cut_lineage(left.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")), top)
    ranked = top_n_per_group(best, ["lang"], ["score", "a", "phrase"], top, descending={"score", "a"})
    return ranked.join(F.broadcast(words), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _near_the_top(best: DataFrame, top: int) -> DataFrame:
    """The rows whose score's sixteenth of a power of two, or a higher one, holds each language's ``top`` best: few are left to be ranked."""
    step = F.floor(F.log2(F.col("score") + 1) * 16)
    # Some hundred rows a language.
    above = Window.partitionBy("lang").orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = best.groupBy("lang", step.alias("_step")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    lowest = held.filter(F.col("_above") < top).groupBy("lang").agg(F.min("_step").alias("_lowest"))
    return best.join(F.broadcast(lowest), "lang").filter(step >= F.col("_lowest")).drop("_lowest")


def _inner(parts: Column, longest: int) -> Column:
    """All shorter runs of two words or more."""
    def runs(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(parts) - size + 1), lambda i: F.array_join(F.slice(parts, i, size), " "))
        return F.when(F.size(parts) > size, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(size) for size in range(2, longest)])) if longest > 2 else F.array().cast("array<string>")
