"""Ragged byte arrays: whole Arrow columns of texts as numpy arrays, without a loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands freed memory back to the system: a worker idles between stages, while others need the room."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Odd multipliers modulo 2**64, and the finaliser's constants.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and len + 1 offsets; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_column(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        give_back()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def quick_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every span, by a running polynomial modulo 2 ** 64.

    Long spans can be made that share it, so it is for uses where equal hashes do no harm.
    """
    with np.errstate(over="ignore"):
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * _powers(_BASE, len(values)), out=run[1:])
        back = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), len(values) + 1)
        return mix((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64))


#: Modulus of the hashes that tell texts apart, and their bases: two for spans, two for windows, two for windows once more.
_PRIME = (1 << 31) - 1
SPANS, WINDOWS, WINDOWS_AGAIN = (0x2545F491, 0x6C62272E), (0x4F6CDD1D, 0x1B873593), (0x5851F42D, 0x7FEB352D)
_REMEMBERED_POWERS: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """The same modulo the prime, below 2 ** 32 for products of two remainders."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _powers_modulo(base: int, n: int) -> np.ndarray:
    known = _REMEMBERED_POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        while len(known) < n:
            known = np.concatenate([known, known * np.uint64(pow(base, len(known), _PRIME)) % np.uint64(_PRIME)])
        if n <= 8 * PIECE_BYTES:
            _REMEMBERED_POWERS[base] = known
    return known[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases: tuple[int, int] = SPANS) -> np.ndarray:
    """64-bit hash of values[start:end] for every span: two running polynomials modulo a prime, with 62 bits together."""
    values = values.astype(np.uint64, copy=False)
    large = bool(len(values)) and int(values.max()) >= _PRIME
    parts = []
    for i, base in enumerate(bases):
        # Different bits of a large value for each polynomial.
        v = values if not large else values % np.uint64(_PRIME) if i == 0 else (mix(values) >> np.uint64(33)) % np.uint64(_PRIME)
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(_fold(v * _powers_modulo(base, len(values))), out=run[1:])
        part = (run[ends] - run[starts]) % np.uint64(_PRIME)
        parts.append(part * _powers_modulo(pow(base, -1, _PRIME), len(values) + 1)[starts] % np.uint64(_PRIME))
    with np.errstate(over="ignore"):
        return mix((parts[0] << np.uint64(31) | parts[1]) ^ (ends - starts).astype(np.uint64) * _BASE)


def equal_spans(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Whether a[from:to] equals b[from:to], span by span."""
    size = a_to - a_from
    same = size == b_to - b_from
    some = np.flatnonzero(same & (size > 0))
    differ = a[ragged(a_from[some], size[some])] != b[ragged(b_from[some], size[some])]
    sums = np.concatenate([[0], np.cumsum(differ)])
    ends = np.cumsum(size[some])
    same[some] = sums[ends] == sums[ends - size[some]]
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First span of each kind, and the kind of every span; spans are of one kind only if they are equal."""
    kind, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[kind[::-1]] = np.arange(len(kind))[::-1]  # of several the first one stays
    lead = first[kind]
    names: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(~equal_spans(data, starts, ends, data, starts[lead], ends[lead])):  # they share a hash with another one
        name = data[starts[i]:ends[i]].tobytes()
        if name not in names:
            names[name] = len(first) + len(more)
            more.append(i)
        kind[i] = names[name]
    return np.concatenate([first, np.array(more, first.dtype)]), kind


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = byte_column(column)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        #: Index of the first word of each text; one more entry than texts.
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends)


def window_hashes(words: np.ndarray, at: np.ndarray, size: int | np.ndarray, bases: tuple[int, int] = WINDOWS) -> np.ndarray:
    """Hash of ``size`` consecutive word hashes from each place of ``at`` on."""
    return span_hashes(words, at, at + size, bases)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of ``size`` words that lie inside one text, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][text], text


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of start, start + 1, ... for every span, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Lookup:
    """Values by non-negative 62-bit keys: open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        at = self._at(keys)
        while len(keys):
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[free]  # of several the last one stays
            won = self._keys[at] == keys
            self._values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self._last

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _BASE) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        at = self._at(keys)
        found = self._keys.take(at)
        out = np.where(found == keys, self._values.take(at), missing)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & self._last
            found = self._keys.take(at[rest])
            hit = found == keys[rest]
            out[rest[hit]] = self._values.take(at[rest[hit]])
            rest = rest[~hit & (found != -1)]
        return out
