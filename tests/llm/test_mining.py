"""Hard negatives: exact products modulo primes, and the operator against a plain search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from premisa.llm import residue_mining as mining
from premisa.llm.common import session

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, row int, x int, `a.b` int"


@pytest.mark.parametrize("width", [1, 63, 64, 65, 700])
@pytest.mark.parametrize("size", [3, 2_000, 1 << 22])
def test_products_are_exact(width, size):
    r = np.random.default_rng(width)
    a, b = (r.integers(-size, size + 1, (n, width)) for n in (9, 13))
    a[0], b[0] = size, -size
    bound = width * size * size
    primes = mining.primes_for(bound)
    assert math.prod(primes) > 2 * bound + 1 and len(primes) >= 2
    assert all(64 * ((p - 1) // 2) ** 2 < 2**24 for p in primes)
    assert (mining.scores(a, b, primes) == a @ b.T).all()


def test_best_takes_the_first_of_equal_scores():
    rows = np.array([[5, 7, 7, 1, 7], [mining.NONE, 2, mining.NONE, mining.NONE, mining.NONE], [mining.NONE] * 5])
    i, j = mining.best(rows, 2)
    assert list(zip(i, j, strict=True)) == [(0, 1), (0, 2), (1, 1)]


def plain(rows, anchors, positives=5, negatives=3):
    rows = [r for r in rows if r[2] is not None and r[1] is not None]
    rows = [r for r in rows if all(c is not None and math.isfinite(c) for c in r[1])]
    xs = [[math.floor(256 * float(np.float32(c))) for c in r[1]] for r in rows]
    out = []
    for i, a in enumerate(rows):
        if not anchors(a[0]):
            continue

        def worth(j, i=i):
            return sum(p * q for p, q in zip(xs[i], xs[j], strict=True))

        def order(j):
            return -worth(j), rows[j][0] is None, rows[j][0] or 0

        own = sorted((j for j in range(len(rows)) if j != i and rows[j][2] == a[2]), key=order)
        for p in own[:positives]:
            rest = [j for j in range(len(rows)) if rows[j][2] != a[2]]
            rest = [j for j in rest if 50 * worth(p) <= 100 * worth(j) <= 95 * worth(p)]
            for k, j in enumerate(sorted(rest, key=order)[:negatives]):
                out.append((a[0], rows[p][0], k + 1, rows[j][0], worth(p), worth(j)))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(2, 3), (5, 1000), (2048, 4096)])
def test_hard_negatives_equal_a_plain_search(spark, blocks):
    """A hot label, ties, repeated rows and ids, NULLs and non-finite numbers in any column."""
    session(spark)
    r = random.Random(4)
    rows = []
    for i in range(90):
        v = [r.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) + r.choice([0, 0, 0.1]) for _ in range(5)]
        rows.append((i, v, r.choice([0, 0, 0, 1, 2, 3])))
    rows += [rows[0], rows[0], rows[10], (10, rows[11][1], 2), (None, rows[3][1], 0), (None, rows[4][1], 1)]
    rows += [(100, None, 1), (100, rows[1][1], None), (101, [0.1, None, 0.1, 0.1, 0.1], 1), (110, rows[2][1], 77)]
    rows += [(102, [0.1, float("nan"), 0.1, 0.1, 0.1], 1), (103, [float("inf")] * 5, 1), (None, None, None)]
    df = spark.createDataFrame([(*x, "i", 1, 2, 3) for x in rows], SCHEMA)
    a, b = blocks
    got = mining.hard_negatives(df, F.col("id") % 10 == 0, anchor_block=a, row_block=b).collect()
    want = plain(rows, lambda i: i is not None and i % 10 == 0)
    assert sorted((tuple(x) for x in got), key=str) == want and len(want) > 50


def test_hard_negatives_of_odd_tables(spark):
    session(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert mining.hard_negatives(none, F.col("id") % 10 == 0).count() == 0
    ones = spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 0)], "vec_id long, embedding array<float>, label int")
    got = mining.hard_negatives(ones, F.col("id") == 0).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 2, 0, 0)]
    long = spark.createDataFrame([(i, [1.0] * 5000, i % 2) for i in range(4)], ones.schema)
    got = mining.hard_negatives(long, F.col("id") == 0, least=50, most=100).collect()
    assert [(x.positive_id, x.negative_id, x.negative_score) for x in got] == [(2, 1, 5000 << 16), (2, 3, 5000 << 16)]
    with pytest.raises(ValueError, match="differ in length"):
        mining.hard_negatives(long.union(ones), F.col("id") == 0)
    huge = spark.createDataFrame([(0, [1e30], 1)], ones.schema)
    with pytest.raises(ValueError, match="too large"):
        mining.hard_negatives(huge, F.col("id") == 0)
