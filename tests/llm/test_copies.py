"""Near-duplicates and repeated passages against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from larder.llm.neardup import near_duplicates, one_of_each
from larder.llm.substrings import repeats_removed, without_repeats

from conftest_llm import odd_rows

SPLIT = re.compile("[^\x20\x09-\x0D]+")


def brute_components(rows, percent=75):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, text, *_ in rows:
        w = SPLIT.findall((text or "").translate(lower))
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def brute_repeats(rows, window=20):
    seen, out = set(), []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        w = SPLIT.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_near_duplicates_match_brute_force(clashing):
    got = sorted(tuple(r) for r in near_duplicates(clashing).collect())
    assert got == brute_components(odd_rows())


@pytest.mark.parametrize("seed", [11, 12])
def test_near_duplicates_of_chains(spark, seed):
    """Each copy differs from the one before, so the ends of a chain aren't alike but belong together."""
    import random

    r = random.Random(seed)
    rows, text = [], [f"t{r.randrange(900)}" for _ in range(100)]
    for i in range(60):
        rows.append((1000 - i, " ".join(text)))
        if i % 20 == 19:
            text = [f"t{r.randrange(900)}" for _ in range(100)]
        text = list(text)
        text[r.randrange(100)] = f"new{i}"
    got = sorted(tuple(x) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_near_duplicates_of_nothing(empty, spark):
    assert near_duplicates(empty).collect() == []
    lone = spark.createDataFrame([(None, "a b c d e f"), (5, None)], "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(lone).collect()} == {(None, 2, None, None), (5, 0, 5, True)}
    assert one_of_each(lone).count() == 2


def test_one_of_each_keeps_columns(clashing):
    kept = one_of_each(clashing)
    assert kept.columns == clashing.columns
    want = {i for i, _, _, k in brute_components(odd_rows()) if k}
    assert {r.doc_id for r in kept.collect()} == want


def test_repeats_match_brute_force(clashing):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in without_repeats(clashing).collect())
    assert got == brute_repeats(odd_rows())


def test_repeats_of_every_phase(spark):
    """A passage of exactly 20 words at all distances from the starts of both texts is found."""
    passage = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(i % 13)] + passage + [f"b{i}_{k}" for k in range(i // 13)])) for i in range(1, 80)]
    rows += [(500, " ".join([f"c{k}" for k in range(7)] + passage[:19] + ["d"]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def test_repeats_of_nothing(empty, clashing):
    assert without_repeats(empty).collect() == []
    out = repeats_removed(clashing)
    assert out.columns == clashing.columns
    want = {i: (n, gone, text) for i, n, gone, text in brute_repeats(odd_rows())}
    for r in out.collect():
        n, gone, text = want[r.doc_id]
        if r.doc_id not in (20, 21):  # rows that occur twice: the first stays, the second goes
            assert gone < n or n == 0
            assert gone == 0 or r.text == text


def twins(size, one, two):
    """Two words that a polynomial modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join((one, two)[b] for b in bits), "".join((two, one)[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_made_to_share_a_hash(spark, size):
    rows = []
    for i, (one, two) in enumerate(("ab", "er", "xq")):
        a, b = twins(size, one, two)
        rows += [(10 * i, a), (10 * i + 1, b), (10 * i + 2, " ".join([a, b] * 13)), (10 * i + 3, " ".join((a, b)[bin(k).count("1") & 1] for k in range(64)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in near_duplicates(docs).collect()) == brute_components(rows)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in without_repeats(docs).collect()) == brute_repeats(rows)


def test_copies_with_clashing_columns_and_without_ids(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 1), (3, "a b c d e f", 2), (4, "a b c d e f", 2), (3, "a b c d e f", 2), (5, "", 0), (5, "", 0), (5, "x", 0), (6, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block int").withColumns({c: F.lit(1) for c in ("_gone", "kept", "id", "label")})
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([(None, "a b c d e f")] * 2 + [(3, "a b c d e f"), (5, ""), (5, "x"), (6, None)], key=key)
    assert without_repeats(docs).count() == repeats_removed(docs, length_column="label").count() == len(rows)
