"""Token counts: words by a compiled finite-state transducer, their tokens by merging.

The transducer is compiled by hand. It reads character classes of the normalised text and marks where
words begin; its transitions carry the marks, no counts. A text is cut into chunks that are run from all
states at once, which gives each chunk a map from states to states; the maps are composed by a parallel
prefix scan, after which the true first state of each chunk is known. The distinct words of a piece of
text are then counted by iterative merging, all words side by side: each step merges the earliest pair of
every word, and the symbols that are left are its tokens. A text's count is the difference of the running
sum of its words' counts.

Fixed forms of the vocabulary: composed (NFC) and lower-cased text, white space dropped, word pattern
``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``, bytes as symbols, the last one of a
word marked as its end. The two special strings count as one token each.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm.arrays import Lookup, distinct_spans, pieces, ragged, span_hashes

# Classes of characters.
_SPACE, _LETTER, _DIGIT, _OTHER, _QUOTE, _R, _V, _L, _E, _ONE = range(10)
# States: at a boundary, in letters, in other signs, after a quote that began a word, after its r, v or l.
_EDGE, _IN, _SIGNS, _QUOTED, _QR, _QV, _QL = range(7)
# Marks: a word begins at this character, at the one before.
_HERE, _BEFORE = 1, 2
CHUNK = 128


def _outer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks of every state and class."""
    step, mark = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (_LETTER, _R, _V, _L, _E, _ONE)
    fresh = {_SPACE: (_EDGE, 0), _DIGIT: (_EDGE, _HERE), _OTHER: (_SIGNS, _HERE), _QUOTE: (_QUOTED, _HERE), **{c: (_IN, _HERE) for c in letters}}
    for state in range(7):
        row = dict(fresh)
        if state == _IN:
            row |= {c: (_IN, 0) for c in letters}
        if state in (_SIGNS, _QUOTED):
            row |= {_OTHER: (_SIGNS, 0), _QUOTE: (_SIGNS, 0)}
        if state == _QUOTED:
            row |= {_ONE: (_EDGE, 0), _R: (_QR, 0), _V: (_QV, 0), _L: (_QL, 0)}
        if state in (_QR, _QV, _QL):
            # The letter after the quote begins a word of letters, unless the contraction is completed.
            row = {c: (s, m | _BEFORE) for c, (s, m) in row.items()} | {c: (_IN, _BEFORE) for c in letters}
            row[_L if state == _QL else _E] = (_EDGE, 0)
        for c, (s, m) in row.items():
            step[state, c], mark[state, c] = s, m
    return step, mark


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point."""
    kinds, lower = np.full(sys.maxunicode + 1, _OTHER, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for point in range(sys.maxunicode + 1):
        sign = chr(point)
        kind = unicodedata.category(sign)
        if kind[0] == "L":
            kinds[point] = _LETTER
        elif kind[0] == "N":
            kinds[point] = _DIGIT
        elif kind[0] == "Z" or 0x09 <= point <= 0x0D or point == 0x85:
            kinds[point] = _SPACE
        small = sign.lower()
        if len(small) == 1:
            lower[point] = ord(small)
    for signs, kind in (("'", _QUOTE), ("r", _R), ("v", _V), ("l", _L), ("e", _E), ("stmd", _ONE)):
        kinds[[ord(c) for c in signs]] = kind
    return kinds, lower


class WordCounter:
    """Merges of byte symbols, with the mark of a word's end on the last one, until no pair is left."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, self.special = told["model"], [x["content"] for x in told["added_tokens"]]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        signs = _byte_signs()
        self.plain = np.array([vocabulary[signs[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[signs[b] + end] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in merges], np.int64)
        self.ranks = Lookup(pairs, np.arange(len(pairs)))
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.never = len(merges)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks.get(left << 20 | right, self.never)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of tokens of each word data[start:end]; words aren't empty."""
        lengths = ends - starts
        word = np.repeat(np.arange(len(starts)), lengths)
        symbols = self.plain[data[ragged(starts, lengths)]]
        symbols[np.cumsum(lengths) - 1] = self.last[data[ends - 1]]
        left = lengths.copy()
        # rank[i] belongs to the pair (i, i + 1).
        rank = np.full(len(symbols), self.never)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(word):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(word)))
            going = least < self.never
            here = (rank == np.repeat(least, size)) & np.repeat(going, size)
            # Of overlapping equal pairs (aaa) the left one is merged; the rest is looked at again.
            here[1:] &= ~here[:-1]
            merge = np.flatnonzero(here)
            symbols[merge] = self.made[rank[merge]]
            left -= np.bincount(word[merge], minlength=len(left))
            keep = np.repeat(going, size)
            keep[merge + 1] = False
            place = (np.cumsum(keep) - 1)[merge]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            touched = np.zeros(len(word) + 1, bool)
            touched[place], touched[place - 1] = True, True  # place - 1 of the first is the spare last one
            near = np.flatnonzero(touched[:-1])
            pair = (near + 1 < len(word)) & (word[np.minimum(near + 1, len(word) - 1)] == word[near]) if len(word) else np.zeros(0, bool)
            rank[near] = self.never
            near = near[pair]
            rank[near] = self.rank(symbols[near], symbols[near + 1])
        return left


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself, or from U+0100 on for those without one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def _prefix_states(classes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first state of every chunk, and the classes as one row a chunk (filled up with spaces)."""
    chunks = -(-len(classes) // CHUNK)
    rows = np.full(chunks * CHUNK, _SPACE, np.uint8)
    rows[:len(classes)] = classes
    rows = rows.reshape(chunks, CHUNK)
    maps = np.tile(np.arange(len(step), dtype=np.uint8), (chunks, 1))
    flat = step.ravel()
    for column in np.ascontiguousarray(rows.T):
        maps = flat.take(maps * np.uint8(10) + column[:, None])
    # Hillis-Steele scan: after it map k leads from the state before chunk 0 to the one after chunk k.
    width = 1
    while width < chunks:
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].copy(), axis=1)
        width *= 2
    return np.concatenate([[_EDGE], maps[:-1, _EDGE]]).astype(np.uint8), rows


def _word_starts(classes: np.ndarray) -> np.ndarray:
    step, mark = _outer()
    state, rows = _prefix_states(classes, step)
    marks = np.zeros((CHUNK, len(rows)), np.uint8)
    for i, column in enumerate(np.ascontiguousarray(rows.T)):
        at = state * np.uint8(10) + column
        marks[i], state = mark.ravel().take(at), step.ravel().take(at)
    marks = marks.T.ravel()[:len(classes)]
    begins = (marks & _HERE).astype(bool)
    begins[:-1] |= (marks[1:] & _BEFORE).astype(bool)
    return np.flatnonzero(begins)


def token_counts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    counter, (kinds, lower) = _counter(path), _classes()
    extra = np.zeros(len(texts), np.int64)
    ready = []
    for i, text in enumerate(texts):
        if "<|" in text:
            for special in counter.special:
                extra[i] += text.count(special)
                text = text.replace(special, " ")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("İ", "i̇")
        ready.append(text)
    lengths = np.array([len(t) + 1 for t in ready])
    # The space after each text leads to the boundary state, so texts don't touch.
    points = lower[np.frombuffer((" ".join(ready) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    classes = kinds[points]
    starts = _word_starts(classes)
    if not len(starts):
        return extra
    data = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=place[1:])
    # A word ends where the next one begins or where a space is.
    spaces = np.flatnonzero(classes == _SPACE)
    ends = np.minimum(np.append(starts[1:], len(points)), spaces[np.searchsorted(spaces, starts)])
    key = span_hashes(data.astype(np.uint64) + np.uint64(1), place[starts], place[ends])
    first, which = distinct_spans(data, place[starts], place[ends], key)
    emitted = counter.counts(data, place[starts[first]], place[ends[first]])[which]
    run = np.concatenate([[0], np.cumsum(emitted)])
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return np.diff(run[edges]) + extra


def with_token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    NULL and empty texts have no tokens. Repeated rows give repeated results; an empty table gives
    none; other columns don't matter. A text of any length is counted whole.
    """
    def run(batches):
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = token_counts(texts, path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                [id_column, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"`{id_column}` AS `{id_column}`", f"`{text_column}` AS text")
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
