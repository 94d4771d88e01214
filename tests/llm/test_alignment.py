"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larder.llm.alignment import Aligned, aligned, gallop, side

from conftest_llm import odd_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["the", " ", "  ", "ing", "tion", "a", "b", "\n", "é", "中", "🙂", "1", "...", "aaa", "▁", "<s>", "<|endoftext|>", "er", "(", "//", "\t", "'s", " ", "\x00"]


def texts_of(seed, n, size):
    r = random.Random(seed)
    return ["", " ", "a", "<0x41>", "<unk>", "x" * 3000] + ["".join(r.choice(SIGNS) for _ in range(r.randrange(size))) for _ in range(n)]


class Plain:
    """Token lists of the libraries, and their groups and links by comparing all with all."""

    def __init__(self, texts):
        one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        one.encode_special_tokens = True
        self.size = two.vocab_size()
        surface = lambda i: bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
        signs = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        signs |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in signs)}
        self.rows = []
        for t in texts:
            a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
            raw_a, raw_b = [bytes(signs[c] for c in one.id_to_token(i)) for i in a], [surface(i) for i in b]
            if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                self.rows.append(([], [], "", 0, []))
                continue
            ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
            groups, i, j = [], 0, 0
            for e in sorted(set(ends_a) & set(ends_b)):
                x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
                groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                i, j = x, y
            links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ends_a[i] - len(raw_a[i]), ends_b[j] - len(raw_b[j])) < min(ends_a[i], ends_b[j])]
            self.rows.append((a, b, ";".join(groups), len(groups), links))
        self.counts = Counter(p for r in self.rows for p in r[4])
        self.best = {}
        for (_, b), n in self.counts.items():
            self.best[b] = max(self.best.get(b, 0), n)

    def digest(self, k):
        a, b, groups, n, links = self.rows[k]
        return (len(a), len(b), n, len(links), sum(self.counts[p] == self.best[p[1]] for p in links), sum(self.counts[p] for p in links),
                hashlib.sha256(groups.encode()).hexdigest() if a else "")


def test_groups_and_links_are_those_of_plain_loops():
    texts = texts_of(1, 500, 25)
    plain, found = Plain(texts), Aligned(texts, side(A), side(B))
    assert [g.decode() for g in found.groups()] == [r[2] for r in plain.rows]
    pairs, times, edges, links = found.pairs()
    for x, y, n, row in zip(edges, edges[1:], links, plain.rows):
        want = Counter(a * plain.size + b for a, b in row[4])
        assert dict(zip(pairs[x:y].tolist(), times[x:y].tolist())) == want and n == len(row[4])


def test_galloping_finds_the_lower_bound():
    r = np.random.default_rng(3)
    for n, m in ((0, 0), (5, 0), (1, 1), (40, 3), (3, 400), (500, 500)):
        short, long = np.unique(r.integers(0, 900, n)), np.unique(r.integers(0, 900, m))
        for guess in (np.zeros(len(short), np.int64), r.integers(-5, 1000, len(short))):
            assert gallop(short, long, guess).tolist() == np.searchsorted(long, short).tolist()


@pytest.mark.parametrize("range_pairs", [1 << 22, 200])
def test_rows_are_judged_by_the_whole_corpus(spark, range_pairs):
    texts = texts_of(2, 120, 20)
    plain = Plain(texts)
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_links long, links string").repartition(4)
    out = aligned(docs, A, B, range_pairs=range_pairs)
    assert out.columns == ["doc_id", "links", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r)[2:] for r in sorted(out.collect())] == [plain.digest(i) for i in range(len(texts))]


def test_odd_rows(spark, clashing, empty):
    assert aligned(empty, A, B).collect() == []
    rows = odd_rows()
    # Loops over all pairs of tokens are for short texts; of the others the tokens are compared.
    got = sorted(aligned(clashing, A, B, groups=True).collect(), key=lambda r: r.doc_id)
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda x: x[0])):
        a = [x for g in r.groups.split(";") if g for x in g.split("|")[0].split(",")]
        b = [x for g in r.groups.split(";") if g for x in g.split("|")[1].split(",")]
        assert r.doc_id == i and a == [str(x) for x in (one.encode(" " + t, add_special_tokens=False).ids if t else [])] and b == [str(x) for x in (two.encode(t) if t else [])]
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if t else "") and (r.n_a, r.n_b) == (len(a), len(b))
    assert sum(r.n_links for r in got) >= max(sum(r.n_a for r in got), sum(r.n_b for r in got))
