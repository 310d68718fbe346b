"""Exact search against brute force."""

import math
import random

from pyspark.sql import functions as F

from spendscope.llm.pivot_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score int, row string"


def brute(rows, k):
    quantized = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(quantized):
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(quantized) if b != a)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, k=20, pivots=64):
    df = spark.createDataFrame([(i, v, 1, 2, "r") for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0, k=k, pivots=pivots).collect()))


def single(values):
    """As 32-bit floats are."""
    import numpy as np

    return [None if x is None else float(np.float32(x)) for x in values]


def test_against_brute_force(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, single([c + rng.gauss(0, 0.2) for c in rng.choice(centres)])) for i in range(400)]
    hot = single([0.5] * 8)
    rows += [(1000 + i, hot) for i in range(250)]  # ties and one crowded place
    rows += [(2000, None), (2020, []), (2040, single([1.0, None, 2, 3, 4, 5, 6, 7])), (2060, single([float("nan")] * 8)), (2080, single([float("inf")] * 8))]
    rng.shuffle(rows)
    expected = brute(rows, 20)
    assert found(spark, rows) == expected
    assert found(spark, rows, pivots=1) == expected


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [-1.0, 0.5]), (3, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 20)
    assert found(spark, []) == [] and found(spark, [(20, None)]) == []
    assert found(spark, [(20, [1.0])]) == []
    assert found(spark, [(20, [1.0]), (20, [1.0]), (21, [0.5, 9.0])]) == sorted(2 * [(20, 1, 20, 4096), (20, 2, 21, 2048)])


def test_shares_grow_with_the_blocks(spark):
    from spendscope.llm.pivot_search import SHARE, shares_of

    for blocks in (0, 1, 100, 10_000, 1_000_000):
        shares = shares_of(blocks, 8)
        assert shares >= 8 and blocks <= SHARE * shares
