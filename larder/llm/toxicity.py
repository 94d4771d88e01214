"""Toxicity by cumulative-link ordinal regression.

Grades run from 0 (not toxic) to 3. The chance of a grade above k is logistic(w x - theta_k): one weight
vector for all thresholds, which stay in order because each is the one before plus a positive step. x are
sparse counts of words, log(1 + n). Words are chosen by how far their document frequencies among toxic and
other documents of the labelled sample differ. The expected grade is the severity.

Labels are only toxic or not. A toxic document's grade is the number of the chosen words of the toxic side
that it holds: 1 for none or one, 2 for two, 3 for more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm.arrays import pieces, quick_hashes
from larder.llm.letters import LetterRuns
from larder.llm.quality import drawn_labels, held_out

#: Words are told apart by so many hash bits when they are counted; so many are features.
WORD_BITS, FEATURES, GRADES = 20, 512, 4
#: Bounds of the labelled sample: documents in which words are counted, and those the weights are fitted on.
COUNT_ROWS, SAMPLE_ROWS = 20_000, 4000
#: Bytes of text that are worked on at once.
PIECE = 1 << 20


def word_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word bucket, count) of the distinct words of each text."""
    runs = LetterRuns(texts)
    if not len(runs.starts):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    h = quick_hashes(runs.letters.astype(np.uint64) + np.uint64(1), runs.first_letter, runs.first_letter + runs.sizes)
    key = runs.of_text() << WORD_BITS | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    return key >> WORD_BITS, key & ((1 << WORD_BITS) - 1), n


@dataclass
class Severity:
    words: np.ndarray       # sorted buckets of the features
    weights: np.ndarray
    thresholds: np.ndarray  # GRADES - 1, rising

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, word, n = word_counts(texts)
        at = np.minimum(np.searchsorted(self.words, word), max(len(self.words) - 1, 0))
        hit = self.words[at] == word if len(self.words) else np.zeros(len(word), bool)
        return text[hit], at[hit], np.log1p(n[hit])

    def above(self, texts: list[str]) -> np.ndarray:
        """Chance of a grade above 0, 1 and 2 of each text."""
        text, at, x = self.features(texts)
        score = np.bincount(text, weights=self.weights[at] * x, minlength=len(texts)) if len(text) else np.zeros(len(texts))
        return _logistic(score[:, None] - self.thresholds[None])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, grades: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that make the grades most likely, by Adam on all rows at once."""
    top = GRADES - 1
    # One parameter vector: weights, first threshold, logarithms of the steps to the others.
    p = np.concatenate([np.zeros(x.shape[1]), [2.0], np.zeros(top - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(len(x))
    for t in range(1, steps + 1):
        w, rise = p[:x.shape[1]], np.exp(p[x.shape[1] + 1:])
        theta = p[x.shape[1]] + np.concatenate([[0], np.cumsum(rise)])
        # Chances of more than -1 (1), 0, 1, 2 and 3 (0).
        chance = np.column_stack([np.ones(len(x)), _logistic((x @ w)[:, None] - theta[None]), np.zeros(len(x))])
        slope = chance * (1 - chance)
        own = np.maximum(chance[rows, grades] - chance[rows, grades + 1], 1e-9)
        d_score = -(slope[rows, grades] - slope[rows, grades + 1]) / own / len(x)
        d_theta = np.zeros(top)
        np.add.at(d_theta, grades[grades > 0] - 1, (slope[rows, grades] / own / len(x))[grades > 0])
        np.add.at(d_theta, grades[grades < top], (-slope[rows, grades + 1] / own / len(x))[grades < top])
        later = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([x.T @ d_score + decay * w, [later[0]], later[1:] * rise])
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return p[:x.shape[1]], p[x.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(p[x.shape[1] + 1:]))])


def trained(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
            counted: int = COUNT_ROWS, rows: int = SAMPLE_ROWS, features: int = FEATURES, seed: int = 7) -> Severity:
    """Model from labels of rows that aren't held out.

    Word frequencies are counted over at most ``counted`` labelled documents, drawn by a hash of the id. What
    comes to the driver is the ``features`` words that differ most and, for the fit, their counts in at most
    ``rows`` of these documents, toxic ones and others in equal parts as far as there are. NULL labels don't count. Without
    both classes nothing is toxic.
    """
    known = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(
        drawn_labels(labels, id_column, label_column, counted, seed), "_id").withColumnRenamed("_label", "y")

    def count(batches):
        sums = np.zeros((2, 1 << WORD_BITS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in pieces(batches, "text", PIECE):
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            text, word, _ = word_counts(batch.column(batch.schema.get_field_index("text")).to_pylist())
            for k in (0, 1):
                sums[k] += np.bincount(word[y[text] == k], minlength=1 << WORD_BITS)
                n[k] += (y == k).sum()
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(sums[0, at], n[0])), pa.array(np.append(sums[1, at], n[1]))], ["word", "clean", "toxic"])

    # At most one row a bucket comes to the driver.
    told = known.select("text", "y").mapInArrow(count, "word bigint, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    word, clean, toxic = (told.column(c).to_numpy() for c in ("word", "clean", "toxic"))
    n0, n1 = (int(x[word == -1].sum()) for x in (clean, toxic))
    if not n0 or not n1:
        return Severity(np.zeros(0, np.int64), np.zeros(0), np.array([20.0, 21.0, 22.0]))
    # Two-proportion score of a word's document frequencies.
    word, clean, toxic = (x[word >= 0] for x in (word, clean, toxic))
    mean = (clean + toxic) / (n0 + n1)
    z = (toxic / n1 - clean / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-9)
    chosen = np.lexsort((word, -np.abs(z)))[:features]
    chosen = chosen[np.argsort(word[chosen])]
    words, z = word[chosen], z[chosen]
    # Words far beyond chance on the toxic side grade the toxic documents.
    strong = z > 6
    model = Severity(words, np.zeros(len(words)), np.zeros(GRADES - 1))

    def measured(batches):
        for batch in pieces(batches, "text"):
            text, at, x = model.features(batch.column(batch.schema.get_field_index("text")).to_pylist())
            lists = [[] for _ in range(batch.num_rows)]
            for t, a, v in zip(text, at, x):
                lists[t].append({"at": int(a), "x": float(v)})
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.array(lists, pa.list_(pa.struct([("at", pa.int32()), ("x", pa.float64())])))], ["y", "features"])

    # Equal parts of both classes, as far as there are, by the same hash.
    place = F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64("_id", F.lit(seed)), "_id"))
    some = F.broadcast(drawn_labels(labels, id_column, label_column, counted, seed).withColumn("_place", place).filter(F.col("_place") <= rows // 2).select("_id"))
    drawn = known.join(some, "_id").select("text", "y").mapInArrow(measured, "y int, features array<struct<at:int,x:double>>").toArrow()
    x = np.zeros((drawn.num_rows, len(words)))
    for i, entries in enumerate(drawn.column("features").to_pylist()):
        for e in entries:
            x[i, e["at"]] = e["x"]
    y = drawn.column("y").to_numpy()
    grades = np.where(y == 1, np.clip((x[:, strong] > 0).sum(axis=1), 1, GRADES - 1), 0)
    model.weights, model.thresholds = fit(x, grades)
    return model


def graded(docs: DataFrame, model: Severity, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.25) -> DataFrame:
    """(id, held_out, severity, grade, p_toxic, toxic) of every row, from whole texts.

    severity is the expected grade (0 to 3), grade the likeliest one (the smaller of equals), toxic whether
    p_toxic reaches ``threshold``. NULL and empty texts are graded as texts without words. Repeated rows
    give repeated results; an empty table gives none; other columns don't matter.
    """
    rows = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "text", PIECE):
            above = model.above([t or "" for t in batch.column(2).to_pylist()])
            chance = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(above.sum(axis=1)), pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(np.ascontiguousarray(above[:, 0])), pa.array(above[:, 0] >= threshold)],
                [id_column, "held_out", "severity", "grade", "p_toxic", "toxic"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, severity double, grade int, p_toxic double, toxic boolean")
