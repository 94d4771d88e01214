"""Token counts and piece ids against the libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from larder.llm.sentencepieces import coded, decoded, encoded, encoder, piece_digests
from larder.llm.tokens import token_counts, with_token_counts

from conftest_llm import odd_rows

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "<|endoftext|>x<|startoftext|>y<|ENDOFTEXT|>", "it's we're they'rx 'r 'v 'l 'll' 'll''s ''s", "a" * 3000, "!!!!!!!! ........ ----",
        "'s's't", "ÅÁ ΣΑΣ İ ǆ ﬁ ½ ²", "\n\n a", " " * 57 + "x" + " " * 33, "中 中文", "▁x ▁▁", "<s> </s> <0x41>", "🙂‍🙂", "\x00\x01"]


def _random(seed, alphabet, n, size):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(size))) for _ in range(n)]


def test_token_counts_are_the_librarys():
    library = Tokenizer.from_file(WORDS)
    texts = HARD + _random(1, list("abserdtvmlls'''  !?.12ÅéßΣİ<|>\n\t ø中あ🙂") + ["the", "ing", "́"], 3000, 60)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts(texts, WORDS).tolist() == want


def _twins(size, one, two):
    """Two words that a polynomial modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join((one, two)[b] for b in bits), "".join((two, one)[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_made_to_share_a_hash(size):
    words, model = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for one, two in ("ab", "er", "xq", "st", "ng"):
        texts = list(_twins(size, one, two))
        texts.append(" ".join(texts))
        assert token_counts(texts, WORDS).tolist() == [len(e.ids) for e in words.encode_batch(texts, add_special_tokens=False)]
        flat, offsets = encoder(PIECES).encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == model.encode(texts)


def test_token_counts_of_rows(clashing, empty):
    assert with_token_counts(empty, WORDS).collect() == []
    library = Tokenizer.from_file(WORDS)
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows())
    got = with_token_counts(clashing, WORDS, limit=100).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_pieces_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = HARD + _random(2, ["the", " ", "  ", "ing", "tion", "a", "b", "\n", "é", "中", "🙂", "1", "...", "aaa", "▁", "<s>", "er", "(", "//", "====", "----"], 4000, 25)
    flat, offsets = encoder(PIECES).encode(texts)
    for text, a, b, want in zip(texts, offsets, offsets[1:], library.encode(texts)):
        assert flat[a:b].tolist() == want, text
        assert encoder(PIECES).decode(flat[a:b]) == library.decode(want)


def test_pieces_round_trip(clashing, empty):
    assert encoded(empty, PIECES).collect() == [] and piece_digests(empty, PIECES).collect() == []
    out = decoded(encoded(clashing, PIECES), PIECES)
    assert out.columns == [*clashing.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in out.collect())
    both = coded(clashing, PIECES)
    assert both.columns == [*clashing.columns, "ids"]
    assert sorted((r.text, r.ids) for r in both.collect()) == sorted((r.decoded, r.ids) for r in out.collect())
    assert all(r.round_trip for r in piece_digests(clashing, PIECES).collect())


def test_decoding_odd_ids():
    worker = encoder(PIECES)
    assert worker.decode(np.array([1, 2])) == "" and worker.decode(np.zeros(0, int)) == ""
    assert worker.decode(np.array([0, 0])) == sentencepiece.SentencePieceProcessor(model_file=PIECES).decode([0, 0])


def test_another_kind_of_model_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        encoder(str(tmp_path / "m"))
