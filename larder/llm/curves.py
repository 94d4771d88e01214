"""Approximate nearest neighbours by shifted space-filling curves.

Every ordering turns the vectors by a random rotation, keeps a few of the turned components, shifts them and
follows a Hilbert curve through the cells of a grid: vectors with close keys lie close together. Spark
range-partitions the keys of all orderings and gives each vector its rank; a query takes the window of ranks
around its own in every ordering, windows are merged, and the nearest of them by coarse codes are ranked
again by the exact distance of the original vectors.

Equal vectors are one class with its few smallest ids, so a vector that very many rows share is searched for
and found once. Ranks are cut into blocks of a fixed number of rows, so no task grows with the table or with
keys that are alike. How wide windows must be is measured: for a bounded number of queries the true neighbours
are found by comparing them with all rows, and the window is the one that holds the wanted share of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.operators.prefix import with_running
from larder.operators.ranges import join_lines
from larder.session import cut_lineage

#: Rows that rotations are scaled by, and queries that windows are measured with; both are drawn by a hash of the vector.
SAMPLE_ROWS, MEASURED = 4096, 96
#: Rows of a block, and queries that meet it at once.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


# ---------------------------------------------------------------- classes of equal vectors

def classes(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(class_id, v, ids, asked): distinct vectors with their k + 1 smallest ids; (vec_id, class_id) of the queries.

    Vectors that are NULL, empty, zero or hold a NULL or non-finite component take no part, nor do rows without
    an id. Rows that repeat an id count once, with the smallest vector.
    """
    x = F.col(vector_column)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf))) & F.exists(x, lambda c: c != 0)
    rows = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    rows = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("v"), is_query.alias("asked"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    # Spark keeps the few first rows of a group before it moves rows.
    first = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_nth") <= k + 1)
    ids = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    wanted = rows.filter("asked").groupBy("v").agg(F.lit(True).alias("asked"))
    found = cut_lineage(ids.join(wanted, "v", "left").select(F.get("ids", F.lit(0)).alias("class_id"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    # A class with very many queries meets its one line in several tasks.
    mine = join_lines(rows.filter("asked").select("vec_id", "v"), found.filter("asked").select("v", "class_id"), ["v"], "vec_id", "inner").select("vec_id", "class_id")
    return found, mine


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row."""
    return np.sqrt(np.square(a - b).sum(axis=1))


# ---------------------------------------------------------------- orderings

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of coordinates below 2 ** bits) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    # From the coarsest bit on, undo the turns and flips of the quarter that each cell lies in.
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(len(x)):
            flip = (x[axis] >> bit & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    # Gray code of the coordinates.
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = key << 1 | (x[axis] >> bit & 1)
    return key


class Orderings:
    """Rotations, shifts and the scale of the codes, drawn from a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, orderings: int, axes: int, bits: int, seed: int):
        r = np.random.default_rng(seed)
        width = sample.shape[1]
        axes = min(axes, width)
        self.bits, self.width = bits, width
        self.turns = np.stack([np.linalg.qr(r.standard_normal((width, width)))[0][:, :axes] for _ in range(orderings)])
        self.middle = sample.mean(axis=0)
        turned = np.einsum("nd,odk->onk", sample - self.middle, self.turns)
        self.spread = np.maximum(turned.std(axis=1), 1e-300)
        self.shift = r.uniform(0, 1, self.spread.shape)
        self.scale = 127 / max(float(np.abs(sample).max()), 1e-300)

    def keys(self, v: np.ndarray) -> np.ndarray:
        """(rows, orderings): six deviations a side fill half of the grid, shifts move it by up to a deviation."""
        out = np.empty((len(v), len(self.turns)), np.int64)
        for i, turn in enumerate(self.turns):
            cells = ((v - self.middle) @ turn / self.spread[i] + self.shift[i]) / 8 + 0.5
            out[:, i] = hilbert_keys(np.clip(np.nan_to_num(cells) * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64), self.bits)
        return out

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(v * self.scale), -127, 127).astype(np.int8)


def _ranked(model: Orderings):
    """Rows (ordering, key, class_id, asked): one for each ordering."""
    def run(batches):
        for batch in batches:
            keys = model.keys(_matrix(batch.column(1), model.width))
            n, m = keys.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(m, dtype=np.int16), n)), pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), m)), batch.column(2).take(pa.array(np.repeat(np.arange(n), m)))],
                ["ordering", "key", "class_id", "asked"])
    return run


def _coded(model: Orderings):
    def run(batches):
        for batch in batches:
            codes = model.codes(_matrix(batch.column(1), model.width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["class_id", "code"])
    return run


# ---------------------------------------------------------------- search

def _nearest_of_all(model: Orderings, queries: tuple[np.ndarray, np.ndarray], k: int):
    """Rows (query, class_id, d): of each task the k + 1 classes nearest to each measured query."""
    ids, q = queries

    def run(batches):
        best = []
        for batch in batches:
            v, row = _matrix(batch.column(1), model.width), batch.column(0).to_numpy()
            for i, x in enumerate(q):
                d = distances(v, x)
                near = np.argsort(d, kind="stable")[:k + 1]
                best.append((np.full(len(near), ids[i]), row[near], d[near]))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([b[j] for b in best])) for j in range(3)], ["query", "class_id", "d"])
    return run


def _window(rows: DataFrame, ranked: DataFrame, model: Orderings, k: int, wanted: float, measured: int, n: int) -> int:
    """Ranks on either side that hold the wanted share of the true neighbours of the measured queries."""
    drawn = rows.orderBy(F.xxhash64("class_id"), "class_id").limit(measured).select("class_id", "v").toArrow()
    queries = drawn.column("class_id").to_numpy(), _matrix(drawn.column("v"), model.width)
    near = (rows.select("class_id", "v").mapInArrow(_nearest_of_all(model, queries, k), "query bigint, class_id bigint, d double")
            .filter("query <> class_id").withColumn("_nth", F.row_number().over(Window.partitionBy("query").orderBy("d", "class_id"))).filter(F.col("_nth") <= k))
    # At most measured x (k + 1) classes.
    pairs = cut_lineage(near.select("query", "class_id"))
    place = ranked.select("ordering", "class_id", "rank")
    one = place.join(F.broadcast(pairs), "class_id").select("query", F.col("class_id").alias("other"), "ordering", F.col("rank").alias("_there"))
    here = place.join(F.broadcast(pairs.select(F.col("query").alias("class_id")).distinct()), "class_id").select(F.col("class_id").alias("query"), "ordering", F.col("rank").alias("_here"))
    away = one.join(here, ["query", "ordering"]).groupBy("query", "other").agg(F.min(F.abs(F.col("_here") - F.col("_there"))).alias("away")).select("away").toArrow()
    gaps = np.sort(away.column("away").to_numpy())
    return int(gaps[min(len(gaps) - 1, math.ceil(wanted * len(gaps)) - 1)]) if len(gaps) else n


def _meet(window: int, keep: int):
    """Rows (query, class_id, far): of a block the nearest by their codes within the windows of the queries."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and rows.num_rows:
            q, c = (np.frombuffer(b"".join(t.column(f"{m}_code").to_pylist()), np.int8).reshape(t.num_rows, -1).astype(np.float32) for t, m in ((queries, "q"), (rows, "r")))
            qid, cid = queries.column("q_class_id").to_numpy(), rows.column("r_class_id").to_numpy()
            qr, cr = queries.column("q_rank").to_numpy(), rows.column("r_rank").to_numpy()
            square = (c * c).sum(axis=1)
            for i in range(0, len(q), 256):
                far = square - 2 * (q[i:i + 256] @ c.T)
                far[(np.abs(cr - qr[i:i + 256, None]) > window) | (cid == qid[i:i + 256, None])] = np.inf
                near = np.argpartition(far, min(keep, len(c)) - 1, axis=1)[:, :keep]
                at = np.repeat(np.arange(len(near)), near.shape[1])
                d = far[at, near.ravel()]
                some = np.isfinite(d)
                own = (q[i:i + 256] * q[i:i + 256]).sum(axis=1)
                for got, x in zip(out, (qid[i + at[some]], cid[near.ravel()[some]], d[some] + own[at[some]])):
                    got.append(x)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({"query": join(out[0], np.int64), "class_id": join(out[1], np.int64), "far": join(out[2], np.float64)})
    return run


def _exact(width: int, columns: list[str]):
    def run(batches):
        for batch in batches:
            at = {f.name: i for i, f in enumerate(batch.schema)}
            d = distances(_matrix(batch.column(at["v"]), width), _matrix(batch.column(at["x"]), width))
            yield pa.RecordBatch.from_arrays([*[batch.column(at[c]) for c in columns], pa.array(d)], [*columns, "score"])
    return run


def near_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", wanted: float = 0.96,
                    orderings: int = 16, axes: int = 8, bits: int = 7, keep: int = 64, measured: int = MEASURED, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest other rows of each query by Euclidean distance, nearest first.

    ``is_query`` picks the queries. Scores are exact, ties go to the smaller vec_id; what is approximate is which
    rows are found: windows are set to hold the share ``wanted`` of the true neighbours of ``measured`` rows, and
    the ``keep`` nearest by codes of one byte a component are ranked by their exact distance. A query with no
    more than k other rows gets all of them. See ``classes`` for the rows that take no part.
    """
    spark = vectors.sparkSession
    rows, queries = classes(vectors, is_query, k, id_column, vector_column)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.count_if("asked").alias("q")).first()
    if not told["q"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n, keep = told["n"], max(keep, 2 * k + 2)
    sample = rows.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE_ROWS).select("v").toArrow()
    model = Orderings(_matrix(sample.column("v"), told["width"]), orderings, axes, min(bits, 62 // min(axes, told["width"])), seed)
    keys = rows.select("class_id", "v", "asked").mapInArrow(_ranked(model), "ordering smallint, key bigint, class_id bigint, asked boolean")
    ranked = cut_lineage(with_running(keys, ["ordering"], ["key", "class_id"]).select("ordering", "class_id", "asked", "rank"))
    # Rows in no more places than the windows of keep rows need: small tables are searched whole.
    window = max(keep, _window(rows, ranked, model, k, wanted, measured, n))
    codes = rows.select("class_id", "v").mapInArrow(_coded(model), "class_id bigint, code binary")
    placed = ranked.join(codes, "class_id")
    block = lambda x: F.floor(x / block_rows).cast("long")
    parts = max(1, math.ceil(told["q"] * min(1, (2 * window + block_rows) / n) / BLOCK_QUERIES))
    deal = F.pmod(F.xxhash64("class_id"), F.lit(parts)).cast("int")
    asked = placed.filter("asked").withColumn("_block", F.explode(F.sequence(block(F.greatest(F.lit(1), F.col("rank") - window)), block(F.least(F.lit(n), F.col("rank") + window))))).withColumn("_deal", deal)
    held = placed.withColumn("_block", block(F.col("rank"))).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # The two sides come from one table: fresh names keep their columns apart.
    names = ("ordering", "_block", "_deal", "class_id", "rank", "code")
    sides = [x.select(*[F.col(c).alias(f"{m}_{c.strip('_')}") for c in names]).groupBy(f"{m}_ordering", f"{m}_block", f"{m}_deal") for x, m in ((asked, "q"), (held, "r"))]
    met = sides[0].cogroup(sides[1]).applyInArrow(_meet(window, keep), "query bigint, class_id bigint, far double")
    merged = met.groupBy("query", "class_id").agg(F.min("far").alias("far"))
    nearest = merged.withColumn("_nth", F.row_number().over(Window.partitionBy("query").orderBy("far", "class_id"))).filter(F.col("_nth") <= keep).select("query", "class_id")
    # A query's own class holds its copies.
    nearest = nearest.unionAll(rows.filter("asked").select(F.col("class_id").alias("query"), "class_id"))
    pairs = nearest.join(rows.select("class_id", "v", "ids"), "class_id").join(rows.filter("asked").select(F.col("class_id").alias("query"), F.col("v").alias("x")), "query")
    exact = pairs.select("query", "ids", "v", "x").mapInArrow(_exact(told["width"], ["query", "ids"]), "query bigint, ids array<bigint>, score double")
    best = Window.partitionBy("query").orderBy("score", F.get("ids", F.lit(0)))
    few = exact.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= k + 1)
    # At most (k + 1) x (k + 1) ids a class of queries.
    lists = few.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("vec_id")))))), 1, k + 1).alias("_near"))
    own = join_lines(queries.withColumnRenamed("class_id", "query"), lists, ["query"], "vec_id", "inner")
    others = F.slice(F.filter("_near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (own.select(F.col("vec_id").alias("query_id"), "_near").select("query_id", F.posexplode(others).alias("_at", "_n"))
            .select("query_id", (F.col("_at") + 1).alias("rank"), "_n.vec_id", "_n.score"))
