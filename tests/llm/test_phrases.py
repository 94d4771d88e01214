"""Collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larder.llm import phrases
from larder.llm.arrays import distinct_spans
from larder.llm.phrases import Texts, Trie, collocations, phrase_counts

from conftest_llm import odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, covered=50, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    good = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = Counter()
    for p, a in good.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) - 1:
                    inside[p[0], *p[i:j]] = max(inside[p[0], *p[i:j]], a)
    out = []
    for lang in n:
        found = []
        for p, a in good.items():
            if p[0] == lang and not (p in inside and 100 * inside[p] >= covered * a):
                cuts = [(1000000 * a * a // (f[p[:k + 1]] * f[lang, *p[k + 1:]]), k) for k in range(1, len(p) - 1)]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p[1:]).encode(), f[p[:k + 1]], f[lang, *p[k + 1:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_with_odd_signs(seed):
    r = random.Random(seed)
    signs = ["a", "b", "C", "é", "中", "a.b", " ", "  ", "\t", ",", "\n", "\x0b", "!x", " ", "tie", "tie tie"]
    return [("".join(r.choice(signs) + r.choice(["", " "]) for _ in range(r.randrange(60))), r.choice(["x", "y", None, "und"])) for _ in range(300)]


def got(spark, rows, **settings):
    df = spark.createDataFrame([(t, g, 1, "s") for t, g in rows], "text string, lang string, n long, phrase string").repartition(4)
    return sorted(tuple(r) for r in collocations(df, **settings).collect())


def test_collocations_match_brute_force(spark):
    rows = rows_with_odd_signs(5)
    want = brute(rows)
    assert want and got(spark, rows) == want


def test_several_shards_and_longer_phrases_change_nothing(spark):
    rows = rows_with_odd_signs(6)
    assert got(spark, rows, shard_phrases=40, longest=4, least=5, top=7) == brute(rows, 4, 5, 50, 7)


def test_collocations_of_odd_rows(spark, clashing, empty):
    table = clashing.withColumn("lang", F.col("source"))
    assert sorted(tuple(r) for r in collocations(table).collect()) == brute([(t, s) for _, t, s, *_ in odd_rows()])
    assert collocations(empty.withColumn("lang", F.col("source"))).collect() == []


def test_rare_phrases_alone_give_no_rows(spark):
    assert got(spark, [("one two three", "x"), (None, None)]) == []
    counts, words = phrase_counts(spark.createDataFrame([("a a a", None)], "text string, lang string"), least=2)
    assert sorted(map(tuple, counts.collect())) == [("und", "a", 1, 3), ("und", "a a", 2, 2)]
    assert [tuple(r) for r in words.collect()] == [("und", 3)]


def thue_morse(n, one, two):
    return "".join((one, two)[bin(i).count("1") & 1] for i in range(n))


def test_words_with_equal_hashes_are_told_apart(spark):
    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    texts = Texts(pa.array([f"{a} {b} {a}"]), ["x"])
    assert texts.word_hashes[0] == texts.word_hashes[1]
    assert distinct_spans(texts.data, texts.starts, texts.ends, texts.word_hashes)[1].tolist() == [0, 1, 0]
    rows = [(f"{a} x", "l")] * 12 + [(f"{b} x", "l")] * 15
    assert got(spark, rows) == brute(rows)


def test_trie_finds_all_its_phrases():
    r = random.Random(2)
    phrases = sorted({" ".join(r.choice("abcdefghij") * r.randrange(1, 4) + str(r.randrange(90)) for _ in range(r.randrange(1, 4))) for _ in range(4000)})
    trie = Trie.build(pa.array(["x"] * len(phrases)), pa.array(phrases))
    sums = np.zeros(len(phrases), np.int64)
    trie.count(Texts(pa.array([p + "." for p in phrases] + ["no such words here"]), ["x"] * (len(phrases) + 1)), 3, sums)
    known, want = {p: i for i, p in enumerate(phrases)}, Counter()
    for p in phrases:
        words = p.split()
        want.update(known[q] for i in range(len(words)) for j in range(i + 1, len(words) + 1) if (q := " ".join(words[i:j])) in known)
    assert sums.tolist() == [want[i] for i in range(len(phrases))]


def test_the_driver_sends_a_trie_array_by_array(spark, monkeypatch):
    """A trie as one value took the driver several times its size."""
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    rows = rows_with_odd_signs(5)
    assert got(spark, rows) == brute(rows)
    arrays = [x for x in sent if isinstance(x, bytes)]
    assert len(arrays) % 5 == 0 and len(arrays) > 0 and not any(isinstance(x, dict) for x in sent)


def test_many_shards_take_one_pass_and_one_bitmap(spark, monkeypatch):
    """A pass over the texts and a trie to send for each shard made the time grow with the square of the table."""
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    rows = rows_with_odd_signs(7) + [("a\0 a\0b a\0 " * 6 + "x" * 300 + " tie", "x")] * 12
    want = brute(rows)
    assert want and got(spark, rows, shard_phrases=3) == want
    assert [type(x) for x in sent] == [bytes] and len(sent[0]) <= 1 << phrases.MAP_BITS - 3


def test_only_rows_near_the_top_are_left_to_rank(spark):
    rows = [(lang, f"p{i}", (i * i * 7919 + len(lang)) % 10 ** (1 + i % 6)) for lang in ("x", "yy") for i in range(900)] + [("z", f"p{i}", 5) for i in range(30)] + [("w", "p", 0)]
    kept = [tuple(r) for r in phrases._near_the_top(spark.createDataFrame(rows, "lang string, phrase string, score long"), 20).collect()]
    for lang in ("x", "yy", "z", "w"):
        scores = sorted((s for g, _, s in rows if g == lang), reverse=True)
        least = scores[min(20, len(scores)) - 1]
        assert {r for r in rows if r[0] == lang and r[2] >= least} <= set(kept)
        assert sum(r[0] == lang for r in kept) <= (30 if lang == "z" else 60)


def test_a_full_bitmap_changes_no_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", 9)
    rows = rows_with_odd_signs(8)
    assert got(spark, rows, shard_phrases=5) == brute(rows)


def test_walks_are_of_one_kind_only_if_equal():
    r = random.Random(3)
    texts = Texts(pa.array([" ".join(r.choice("abc") for _ in range(400)), "a b c. a b c", None]), ["x", "y", "x"])
    sizes = np.array([min(r.randrange(40), len(texts.starts) - i) for i in range(len(texts.starts))])
    words = [bytes(texts.data[a:b]) for a, b in zip(texts.starts, texts.ends)]
    walks = [(texts.text[i], *words[i:i + n]) for i, n in enumerate(sizes)]
    kind, kinds = phrases._walk_kinds(texts, texts.text, sizes, 40)
    assert len(set(zip(kind.tolist(), walks))) == kinds == len(set(walks))
