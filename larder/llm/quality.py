"""Quality scores by a byte-level convolutional network in numpy.

Each byte of the whole text has a learned vector. Filters look at chunks of 16 bytes that begin every 8
bytes, so chunks overlap and cover the text; the largest response of each filter over the text goes
through one hidden layer into one probability. The network is fitted on the driver on a bounded sample
of labelled documents; scoring needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larder.llm.arrays import byte_column, pieces, ragged

STEP, PAD = 8, 256
#: Bounds of the sample a network is fitted on: documents, and bytes of one (longer ones aren't drawn).
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 1 << 16


def held_out(id_column: str) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte values in steps of 8, each text filled up with one step more, and the first step of each text."""
    sizes = np.diff(offsets)
    steps = np.maximum(-(-sizes // STEP), 1) + 1
    first = np.cumsum(steps) - steps
    out = np.full(int(steps.sum()) * STEP, PAD, np.int16)
    out[ragged(first * STEP, sizes)] = data
    return out, first


@dataclass
class Network:
    embed: np.ndarray     # 257 x e, the last row (filling) stays 0
    filters: np.ndarray   # 16 * e x f
    bias: np.ndarray      # f
    hidden: np.ndarray    # f x h
    hidden_bias: np.ndarray
    out: np.ndarray       # h
    out_bias: np.ndarray  # 1

    @staticmethod
    def fresh(seed: int, e: int = 6, f: int = 32, h: int = 16) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        embed = n(257, e, scale=0.5)
        embed[PAD] = 0
        return Network(embed, n(2 * STEP * e, f, scale=0.15), np.zeros(f, np.float32), n(f, h, scale=0.25), np.zeros(h, np.float32), n(h, scale=0.25), np.zeros(1, np.float32))

    def responses(self, values: np.ndarray) -> np.ndarray:
        """Filter responses of the chunk that begins at each step but the last."""
        half = STEP * self.embed.shape[1]
        steps = self.embed.take(values, axis=0).reshape(-1, half)
        return steps[:-1] @ self.filters[:half] + steps[1:] @ self.filters[half:] + self.bias

    def pooled(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest response of each text; a chunk that reaches into the next text doesn't count."""
        r = self.responses(values)
        r[first[1:] - 1] = -np.inf
        return np.maximum.reduceat(r, first, axis=0)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.maximum(pooled, 0)
        b = np.tanh(a @ self.hidden + self.hidden_bias)
        z = b @ self.out + self.out_bias
        return a, b, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, column: pa.Array) -> np.ndarray:
        values, first = _laid_out(*byte_column(column))
        return self.head(self.pooled(values, first))[2].astype(np.float64)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, steps: int = 900, batch: int = 32, rate: float = 4e-3) -> Network:
    """Network fitted by Adam on whole texts; classes weigh the same. Without both classes it answers their share."""
    net = Network.fresh(seed)
    labels = np.asarray(labels, np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.out[:] = 0
        net.out_bias[:] = np.log((share + 1e-2) / (1 - share + 1e-2))
        return net
    r = np.random.default_rng(seed)
    by_class = [np.flatnonzero(labels == k) for k in (0, 1)]
    names = list(net.__dataclass_fields__)
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    mean = {k: np.zeros_like(getattr(net, k)) for k in names}
    tail = steps // 3
    for t in range(1, steps + 1):
        rows = np.concatenate([r.choice(by_class[0], batch // 2), r.choice(by_class[1], batch // 2)])
        for k, g in _gradients(net, [texts[i] for i in rows], labels[rows]).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            speed = rate * min(1.0, 2 * (1 - t / steps) + 0.05)
            w = getattr(net, k)
            w -= speed * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7) + speed * 1e-3 * w
            if t > steps - tail:
                mean[k] += w / tail
        net.embed[PAD] = 0
    # The mean of the last weights wavers less; the odds are brought back to the share of the labels.
    for k in names:
        setattr(net, k, mean[k])
    net.embed[PAD] = 0
    net.out_bias = net.out_bias + np.float32(np.log(share / (1 - share)))
    return net


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    values, first = _laid_out(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    r = net.responses(values)
    r[first[1:] - 1] = -np.inf
    bounds = np.append(first[1:], len(r))
    best = np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(first, bounds)])
    pooled = r[best, np.arange(r.shape[1])]
    a, b, p = net.head(pooled)
    dz = (p - labels) / len(labels)
    db = np.outer(dz, net.out) * (1 - b * b)
    da = (db @ net.hidden.T) * (pooled > 0)
    # Only the chunk with the largest response of a filter has a gradient.
    chunk = values.reshape(-1, STEP)
    at = np.concatenate([chunk[best], chunk[best + 1]], axis=2)
    seen = net.embed[at].reshape(*best.shape, -1)
    d_filters = np.einsum("bf,bfk->kf", da, seen)
    d_seen = (da[:, :, None] * net.filters.T[None]).reshape(-1, net.embed.shape[1])
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, at.ravel(), d_seen)
    d_embed[PAD] = 0
    return {"embed": d_embed, "filters": d_filters, "bias": da.sum(0), "hidden": a.T @ db, "hidden_bias": db.sum(0), "out": b.T @ dz, "out_bias": np.array([dz.sum()], np.float32)}


def drawn_labels(labels: DataFrame, id_column: str, label_column: str, rows: int, seed: int) -> DataFrame:
    """(_id, _label) of at most ``rows`` labelled ids that aren't held out, drawn by a hash of the id.

    The bound makes it safe to broadcast, so texts aren't shuffled to find the sample.
    """
    some = labels.filter(~held_out(id_column) & F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label"))
    return F.broadcast(some.orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "_label").limit(rows))


def fitted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
           rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, seed: int = 7) -> Network:
    """Network of at most ``rows`` labelled documents of at most ``size`` bytes, drawn by a hash of the id.

    Held-out ids, NULL labels and labels other than 0 and 1 aren't drawn.
    """
    drawn = (docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).filter(F.octet_length("_text") <= size)
             .join(drawn_labels(labels, id_column, label_column, rows, seed), "_id").toArrow())
    # The fit depends on the order of its rows, so it is fixed.
    drawn = drawn.sort_by([("_id", "ascending"), ("_label", "ascending"), ("_text", "ascending")])
    return fit([t.encode() for t in drawn.column("_text").to_pylist()], drawn.column("_label").to_numpy(), seed)


def scored(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    NULL and empty texts are scored as texts without a byte. Repeated rows give repeated results; an empty
    table gives none; other columns don't matter.
    """
    rows = docs.select(F.col(id_column), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "text"):
            score = network.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_column, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, score double, predicted int")
