"""Exact search against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from larder.llm.topk import exact_top_k, quantised


def brute(rows, k):
    good = {i: np.floor(256 * np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good.items():
        if q % 3 == 0:
            ranked = sorted(((-int(a @ b), i) for i, b in good.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


def run(spark, rows, k, **settings):
    df = spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id long, embedding array<float>, v string")
    return sorted(tuple(r) for r in exact_top_k(quantised(df, "vec_id", "embedding"), F.col("vec_id") % 3 == 0, k, **settings).collect())


def test_top_k_matches_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = r.standard_normal((150, 16)).astype(np.float32).round(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # ties at the cut
    rows += [(300, None), (301, []), (303, [float("nan")] * 16), (306, [None] * 16), (309, [float("inf")] * 16)]
    want = brute(rows, 5)
    assert run(spark, rows, 5) == want
    assert run(spark, rows, 5, block_rows=20, slices=3) == want


def test_top_k_of_few_rows(spark):
    assert run(spark, [(3, [1.0, 2.0])], 5) == []
    assert run(spark, [], 5) == []
    few = [(0, [1.0]), (1, [-2.0]), (2, [0.5])]
    assert run(spark, few, 5) == brute(few, 5)
