"""Language spans of mixed texts.

A word is a run of letters. Its script leaves only the languages that use that script; each of those
scores the word by its trigrams (with the word's edges), from counts over all training documents. Viterbi
then picks one language a word, a switch costing a fixed penalty, and runs of words of one language are a
span. The document's language is that of most letters.

The recursion runs in blocks of 32 words: for every block, all at once, the best way from each language
before it to each one after it; then over the blocks of a text; then back inside all blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larder.llm.arrays import pieces
from larder.llm.letters import SCRIPT_NAMES, LetterRuns, tables
from larder.llm.quality import held_out

#: Trigrams are counted in so many buckets a language.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Cost of a switch in nats, share of a language's letters from which it uses a script, words of a block.
PENALTY, SCRIPT_SHARE, BLOCK = 12.0, 0.01, 32
UNKNOWN = "und"
_FAR = np.float32(-1e6)


def _buckets(runs: LetterRuns) -> np.ndarray:
    left, right = runs.neighbours()
    with np.errstate(over="ignore"):
        h = left * np.uint32(0x9E3779B1) + runs.letters * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray    # BUCKETS x languages: log probability of a trigram
    uses: np.ndarray      # scripts x languages

    def emissions(self, runs: LetterRuns) -> np.ndarray:
        """Score of every word in every language; one that doesn't use the word's script is far off."""
        out = np.add.reduceat(self.scores.take(_buckets(runs), axis=0), runs.first_letter, axis=0)
        _, _, script = tables()
        fits = self.uses[script[runs.letters[runs.first_letter]]]
        # A script that no language uses tells nothing.
        none = ~fits.any(axis=1)
        out[none] = 0
        return np.where(fits | none[:, None], out, out + _FAR)


def viterbi(emissions: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; ``first`` holds where texts begin, and the end."""
    words, langs = emissions.shape
    counts = np.diff(first)
    if not words:
        return np.zeros(0, np.int64)
    blocks = -(-counts // BLOCK)
    begin = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(words) - first[:-1][text]
    slot = (begin[text] + inside // BLOCK) * BLOCK + inside % BLOCK
    e = np.zeros((total * BLOCK, langs), np.float32)
    e[slot] = emissions
    e = e.reshape(total, BLOCK, langs)

    def step(v: np.ndarray, t: int) -> np.ndarray:
        return np.maximum(v, v.max(axis=-1, keepdims=True) - penalty) + (e[:, t, None, :] if v.ndim == 3 else e[:, t])

    # From each language before a block (axis 1) to each one after it (axis 2).
    ways = np.full((total, langs, langs), 2 * _FAR * BLOCK, np.float32)
    ways[:, np.arange(langs), np.arange(langs)] = 0
    for t in range(BLOCK):
        ways = step(ways, t)
    # Over the blocks of all texts side by side; the texts with most blocks first.
    order = np.argsort(-blocks, kind="stable")
    most = int(blocks.max())
    live = np.searchsorted(-blocks[order], -np.arange(1, most + 1), "right")
    value = np.zeros((len(counts), langs), np.float32)
    back = np.zeros((total, langs), np.int64)
    for k, n in enumerate(live):
        at = begin[order[:n]] + k
        paths = value[:n, :, None] + ways[at]
        back[at] = paths.argmax(axis=1)
        value[:n] = paths.max(axis=1)
        value[:n] -= value[:n].max(axis=1, keepdims=True)
    last = np.zeros(len(counts), np.int64)
    last[:] = value.argmax(axis=1)
    entry, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for k in range(most - 1, -1, -1):
        n = live[k]
        at = begin[order[:n]] + k
        leave[at] = last[:n]
        last[:n] = back[at, last[:n]]
        entry[at] = last[:n]
    # Inside all blocks from the language before to the one after.
    v = np.full((total, langs), 2 * _FAR * BLOCK, np.float32)
    v[np.arange(total), entry] = 0
    stay, best = np.zeros((BLOCK, total, langs), bool), np.zeros((BLOCK, total), np.int64)
    for t in range(BLOCK):
        best[t] = v.argmax(axis=1)
        stay[t] = v >= v.max(axis=1, keepdims=True) - penalty
        v = step(v, t)
    path = np.zeros((total, BLOCK), np.int64)
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        path[:, t] = now
        now = np.where(stay[t, np.arange(total), now], now, best[t])
    return path.ravel()[slot]


def trained(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", smoothing: float = 0.5) -> Model:
    """Model from all rows whose language is not NULL.

    What comes to the driver is at most a count for each language and bucket. ``docs`` holds training rows
    only. Without any there are no languages.
    """
    rows = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))

    def count(batches):
        """Counts of a task; buckets from BUCKETS on are letters by script."""
        _, _, script = tables()
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                runs = LetterRuns([t for t, x in zip(texts, langs) if x == lang])
                sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                sums[lang][:BUCKETS] += np.bincount(_buckets(runs), minlength=BUCKETS)
                sums[lang][BUCKETS:] += np.bincount(script[runs.letters], minlength=len(SCRIPT_NAMES))
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    told = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(told.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    index = {x: i for i, x in enumerate(langs)}
    counts[told.column("bucket").to_numpy(), [index[x] for x in told.column("lang").to_pylist()]] = told.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS] + smoothing, counts[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return Model(langs, np.log(grams / grams.sum(axis=0, keepdims=True)).astype(np.float32), share >= SCRIPT_SHARE)


def identify(texts: list[str], model: Model, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, share of letters in it, and spans of each text."""
    runs = LetterRuns(texts)
    n = len(texts)
    if not model.languages or not len(runs.starts):
        return [UNKNOWN] * n, np.zeros(n), [[] for _ in texts]
    path = viterbi(model.emissions(runs), runs.first, penalty)
    text = runs.of_text()
    letters = np.bincount(text * len(model.languages) + path, weights=runs.sizes, minlength=n * len(model.languages)).reshape(n, -1)
    whole = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    share = letters.max(axis=1) / np.maximum(whole, 1)
    cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])]))
    end = np.append(cut[1:], len(path)) - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for a, b in zip(cut, end):
        edge = runs.edges[text[a]]
        spans[text[a]].append({"start": int(runs.starts[a] - edge), "end": int(runs.ends[b] - edge), "lang": model.languages[path[a]]})
    return [model.languages[b] if w else UNKNOWN for b, w in zip(best, whole)], share, spans


def with_languages(docs: DataFrame, model: Model, text_column: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_spans added; columns of these names are replaced.

    lang_spans holds code point ranges and their language. A text that is NULL or has no letter is ``und``
    with score 0 and no spans. Of languages with as many letters the first by name is taken. Repeated rows
    stay; an empty table stays empty.
    """
    added = ["lang_pred", "lang_score", "lang_spans"]
    kept = [c for c in docs.columns if c not in added]
    limit = max(1 << 16, (8 << 20) // max(len(model.languages), 4))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in pieces(batches, text_column, limit):
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
            lang, score, spans = identify([t or "" for t in at[text_column].to_pylist()], model, penalty)
            yield pa.RecordBatch.from_arrays([*at.values(), pa.array(lang, pa.string()), pa.array(score), pa.array(spans, span)], [*kept, *added])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("lang", "string")))
    return docs.select(*kept).mapInArrow(run, schema)


def in_known_language(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", least: float = 0.5) -> DataFrame:
    """``docs`` without texts of no language or of no clear one (most letters, but under ``least`` of all)."""
    model = trained(docs.filter(~held_out(id_column)), text_column, lang_column)
    told = with_languages(docs, model, text_column)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)).select(*docs.columns)
