"""Approximate neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm.curves import hilbert_keys, near_neighbours


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    width = max(map(len, good.values()), default=0)
    ids = np.array(sorted(good))
    x = np.array([good[i] + [0.0] * (width - len(good[i])) for i in ids]).reshape(len(ids), width)
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(np.square(x - v).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def run(spark, rows, k, every, **settings):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, ids string").repartition(5)
    found = {}
    for q, rank, i, d in sorted(near_neighbours(df, F.col("vec_id") % every == 0, k, **settings).collect()):
        found.setdefault(q, []).append((i, d))
        assert rank == len(found[q])
    return found


def floats(x):
    return [[float(c) for c in v] for v in np.asarray(x, np.float32)]


def test_small_tables_are_searched_whole(spark):
    r = np.random.default_rng(1)
    rows = list(enumerate(floats(r.standard_normal((60, 7)))))
    rows += [(100 + i, rows[4][1]) for i in range(30)]  # copies: ties go to the smaller id
    rows += [(200, None), (204, []), (208, [float("nan")] * 7), (212, [None] * 7), (216, [0.0] * 7), (220, [float("inf")] * 7), (None, [1.0] * 7), (8, rows[8][1])]
    assert run(spark, rows, 10, 4) == brute(rows, 10, 4)


def test_few_and_no_rows(spark):
    assert run(spark, [], 3, 1) == {} and run(spark, [(0, [0.0])], 3, 1) == {}
    assert run(spark, [(0, [1.0, 2.0])], 3, 1) == {}
    few = [(0, [1.0]), (1, [-2.0]), (2, [0.5]), (3, [0.5])]
    assert run(spark, few, 10, 1) == brute(few, 10, 1)


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_recall_against_brute_force(spark, spread):
    r = np.random.default_rng(2)
    middles = r.standard_normal((12, 24))
    rows = list(enumerate(floats(middles[r.integers(0, 12, 3000)] + spread * r.standard_normal((3000, 24)))))
    rows += [(5000 + i, rows[0][1]) for i in range(1500)]  # a third of all rows is one vector
    want, got = brute(rows, 10, 50), run(spark, rows, 10, 50, block_rows=500, keep=32)
    assert set(want) == set(got) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    true = {i: v for i, v in rows}
    assert all(d == float(np.sqrt(np.square(np.array(true[q]) - np.array(true[i])).sum())) for q in got for i, d in got[q])


def test_curve_goes_through_all_cells_step_by_step():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
