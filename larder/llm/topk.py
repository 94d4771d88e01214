"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt to ``slices``; each slice scores a candidate by its own part of the
inner product. Phase one gathers the k best partial scores of every slice and block and takes their
exact totals: the k-th best of those is a bound no true result lies below. Phase two sends each query
its cutoff bound / slices: a total of at least the bound needs one slice at or above the cutoff (the
largest part is at least the mean), so entries below it in every slice can't be results. Phase three
resolves the totals of the rest exactly.

Queries and candidates meet in blocks; a block holds a fixed number of rows, so memory doesn't grow
with the tables. Each task returns at most k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x) in doubles.

    Vectors that are NULL, empty or hold a NULL or non-finite component take no part, nor do rows
    without an id. Rows that repeat an id count once, with the smallest vector.
    """
    x = F.col(vector_column)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    rows = vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    rows = rows.select(F.col(id_column).cast("bigint").alias("vec_id"),
                       F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as a matrix; a shorter vector is filled with zeros, which add nothing to a product."""
    column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _cell(queries: pa.Table, rows: pa.Table, slices: int):
    width = max(np.asarray(x.combine_chunks().value_lengths()).max() for x in (queries.column("v"), rows.column("row")))
    q, c = _matrix(queries.column("v"), width), _matrix(rows.column("row"), width)
    if width * np.abs(q).max() * np.abs(c).max() >= 2 ** 53:  # beyond it doubles aren't exact
        q, c = q.astype(np.int64), c.astype(np.int64)
    qid, cid = queries.column("vec_id").to_numpy(), rows.column("row_id").to_numpy()
    order = np.argsort(cid)
    cuts = np.linspace(0, width, slices + 1).astype(int)
    return qid, cid[order], q, c[order], list(zip(cuts, cuts[1:]))


def _found(qid: np.ndarray, cid: np.ndarray, query: list, row: list, score: list) -> pa.Table:
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    q, r = join(query, np.int64), join(row, np.int64)
    return pa.table({"query_id": qid[q], "vec_id": cid[r], "score": join(score, np.int64)})


def _gather(k: int, slices: int):
    """Phase one: exact totals of the k best entries of every slice; at most k a query."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], [])
        qid, cid, q, c, cuts = _cell(queries, rows, slices)
        take = min(k + 1, len(cid))
        out = ([], [], [])
        for i in range(0, len(qid), 256):
            part = q[i:i + 256]
            near = np.unique(np.concatenate([
                (np.argpartition(-(part[:, a:b] @ c[:, a:b].T), take - 1, axis=1)[:, :take] + np.arange(len(part))[:, None] * len(cid)).ravel()
                for a, b in cuts if b > a]))
            at, row = near // len(cid), near % len(cid)
            own = qid[i + at] == cid[row]
            at, row = at[~own], row[~own]
            _best(k, i, at, row, np.einsum("ij,ij->i", part[at], c[row]), out)
        return _found(qid, cid, *out)
    return run


def _best(k: int, base: int, at: np.ndarray, row: np.ndarray, score: np.ndarray, out) -> None:
    """Adds the k best of each query; rows are in the order of their ids, which breaks ties."""
    order = np.lexsort((row, -score, at))
    at, row, score = at[order], row[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    for got, x in zip(out, (base + at, row, score)):
        got.append(x[place < k])


def _resolve(k: int, slices: int):
    """Phases two and three: entries at or above the cutoff in some slice, with exact totals."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], [])
        qid, cid, q, c, cuts = _cell(queries, rows, slices)
        bound = queries.column("bound").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        out = ([], [], [])
        for i in range(0, len(qid), 256):
            part, least = q[i:i + 256], bound[i:i + 256, None]
            kept = np.zeros((len(part), len(cid)), bool)
            for a, b in cuts:
                kept |= part[:, a:b] @ c[:, a:b].T >= np.floor(least / slices)
            at, row = np.nonzero(kept & (qid[i:i + 256, None] != cid))
            total = np.concatenate([np.einsum("ij,ij->i", part[at[j:j + 65536]], c[row[j:j + 65536]]) for j in range(0, max(len(at), 1), 65536)])
            good = total >= least[at, 0]
            _best(k, i, at[good], row[good], total[good], out)
        return _found(qid, cid, *out)
    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, slices: int = 4, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query among all other rows.

    ``vectors`` has vec_id and v, as ``quantised`` gives them; ``is_query`` picks the queries. Ties go
    to the smaller vec_id. A query with fewer than k other rows gets all of them; a table of one row
    or none gives no rows.
    """
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    columns, lines = (max(1, math.ceil(sizes[x] / block_rows)) for x in ("n", "q"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    fan = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(F.col("vec_id").alias("row_id"), F.col("v").alias("row"), deal(columns).alias("_rc"), fan(lines).alias("_rl"))
    asked = vectors.filter(is_query)

    def meet(queries: DataFrame, work) -> DataFrame:
        cells = queries.withColumn("_l", deal(lines)).withColumn("_c", fan(columns))
        return cells.groupBy("_l", "_c").cogroup(rows.groupBy("_rl", "_rc")).applyInArrow(work, _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = (meet(asked, _gather(k, slices)).withColumn("rank", F.row_number().over(best))
              .filter(F.col("rank") <= k).groupBy(F.col("query_id").alias("vec_id"))
              .agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("bound")))
    known = asked.join(bounds, "vec_id", "left").select("vec_id", "v", "bound")
    return (meet(known, _resolve(k, slices)).withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
