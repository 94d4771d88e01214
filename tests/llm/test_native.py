"""Fingerprints and mixing against plain Python."""

import hashlib
import re
import struct
from fractions import Fraction
from math import ceil

import pytest
import xxhash

from larder.llm.fingerprints import BINS, fingerprints
from larder.llm.mixing import in_mixed_order, mixed

from conftest_llm import odd_rows


def _hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<Q", v & (1 << 64) - 1), seed)
    return seed


def brute_bins(text):
    w = [_hash([x.encode()]) for x in re.findall("[^\x20\x09-\x0D]+", text)]
    if not w:
        return None
    shingles = {_hash(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {_hash(w)}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    bins = {}
    for h in shingles:
        b = h >> 57
        if b not in bins or signed(h) < signed(bins[b]):
            bins[b] = h
    out = []
    for i in range(BINS):
        start, step = _hash([i, b"\x01\x00\x00\x00"]) & 127, (_hash([i, b"\x02\x00\x00\x00"]) & 126) + 1
        out.append(next(bins[x] for x in (i, *((start + t * step) & 127 for t in range(BINS))) if x in bins) & 15)
    return out


def brute_likeness(a, b):
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / BINS - 1 / 16) / (15 / 16))


def test_fingerprints_match_plain_python(clashing):
    rows = [(i, t or "") for i, t, *_ in odd_rows()]
    order = sorted(rows, key=lambda r: (-r[0], [-ord(c) for c in r[1]]))
    got = {r.doc_id: r for r in fingerprints(clashing).collect()}
    assert fingerprints(clashing).count() == len(rows)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        if i in (20, 21):
            continue  # two equal rows: the first is followed by the second
        a, b, c = brute_bins(text), brute_bins(edited), brute_bins(after)
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == ("" if a is None else "".join(f"{x:x}" for x in a))
        assert r.edited_fingerprint == ("" if b is None else "".join(f"{x:x}" for x in b))
        assert r.near_edited == pytest.approx(brute_likeness(a, b)) and r.near_next == pytest.approx(brute_likeness(a, c))


def test_fingerprint_likeness_follows_similarity(spark):
    base = [f"w{i}" for i in range(2000)]
    rows = [(2, " ".join(base)), (1, " ".join(base[:1800] + [f"x{i}" for i in range(200)]))]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 2").first()
    assert abs(got.near_next - 1800 / 2200) < 0.15


def test_fingerprints_of_few_rows(spark, empty):
    assert fingerprints(empty).collect() == []
    one = fingerprints(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    far = spark.createDataFrame([(i, f"a b c d e {i}") for i in (0, 5, 10 ** 12, 10 ** 15)], "doc_id long, text string")
    assert fingerprints(far).count() == 4


def _check(rows, block_rows, period, weights=None, temperature=0.5):
    """Every source is less than a block from its share inside each cycle; blocks stand in order; none is lost."""
    source_of = {}
    for r in rows:
        source_of.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(v) == 1 for v in source_of.values())
    order = [next(iter(source_of[s])) for s in sorted(source_of)]
    assert sorted(source_of) == list(range(len(order)))
    sizes, counts = {}, {}
    for r in rows:
        counts[r.source] = counts.get(r.source, 0) + 1
    blocks = {s: ceil(n / block_rows) for s, n in counts.items()}
    raw = {s: (max(0.0, weights.get(s, 0)) if weights else n ** temperature) for s, n in counts.items()}
    total = sum(raw.values())
    share = {s: max(1, int(period * raw[s] / total + 0.5)) if total else 1 for s in counts}
    done, place, cycle = dict.fromkeys(counts, 0), 0, 0
    while place < len(order):
        given = {s: max(0, min(share[s], blocks[s] - cycle * share[s])) for s in counts}
        d = sum(given.values())
        served = dict.fromkeys(counts, 0)
        for t in range(d):
            s, block = order[place + t]
            assert block == done[s]
            done[s] += 1
            served[s] += 1
            for x in counts:
                assert abs(Fraction(given[x] * (t + 1), d) - served[x]) < 1
        place, cycle = place + d, cycle + 1
    assert done == blocks
    return sizes


@pytest.mark.parametrize("weights", [None, {"big": 5, "mid": 3, "absent": 4, "one": -1}])
def test_mixing_stays_within_a_block(spark, weights):
    rows = [(i, "big") for i in range(400)] + [(1000 + i, "mid") for i in range(90)] + [(2000 + i, f"s{i % 7}") for i in range(60)] + [(3000, "one"), (3001, None)]
    got = mixed(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4, period=20).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    assert max(r.place for r in got) == 3
    _check(got, 4, 20, weights)


def test_mixing_of_odd_rows(clashing, empty, spark):
    assert mixed(empty).collect() == []
    got = mixed(clashing, block_rows=3).collect()
    assert len(got) == len(odd_rows())
    out = in_mixed_order(clashing, block_rows=3)
    assert out.columns == clashing.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, clashing.collect()))
    nulls = spark.createDataFrame([(None, None), (None, "b"), (1, None)], "doc_id long, source string")
    assert in_mixed_order(nulls).count() == 3


def test_repeated_and_missing_ids_keep_their_rows(spark):
    rows = [(i % 20, "a" if i % 3 else "b", f"t{i % 4}", 1, 2) for i in range(90)] + [(None, "a", None, 1, 2)] * 25 + [(None, None, "x", 3, 4)] * 3 + [(7, "b", "same", 0, 0)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int, place int").repartition(5)
    got = mixed(docs, block_rows=4, period=20).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.source) for r in got), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    _check(got, 4, 20)
    out = in_mixed_order(docs, slot="slot", place="place", block_rows=4, period=20)
    assert out.columns == ["doc_id", "source", "text", "slot", "place"]
    found = out.collect()
    assert sorted((tuple(r)[:3] for r in found), key=key) == sorted((r[:3] for r in rows), key=key)
    assert len({(r.slot, r.place) for r in found}) == len(rows)
