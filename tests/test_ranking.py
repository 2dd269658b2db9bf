"""Ranks and order statistics against numpy, with skew, ties, NaN and infinity."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from premisa.functions.exprs import order_key
from premisa.operators import ranking as R
from premisa.sources import staging

INF, NAN = float("inf"), float("nan")


def expected(values, trim=0.2):
    x = np.sort(np.array(values, dtype=float))
    n, k = len(x), int(trim * len(x))
    with np.errstate(invalid="ignore"):
        kept = x[k : n - k].mean()
        mean = x.mean()
    if np.isnan(x).any():
        return n, mean, NAN, NAN, NAN, kept
    return n, mean, *np.percentile(x, [20, 50, 80]), kept


def run(spark, groups, **kwargs):
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    out = R.order_statistics(
        df, ["g"], "v", {"p20": 0.2, "median": 0.5, "p80": 0.8}, trim=0.2, **kwargs
    )
    return {
        r["g"]: (r["n"], r["mean"], r["p20"], r["median"], r["p80"], r["trim_mean"])
        for r in out.collect()
    }


GROUPS = {
    "one": [3.0],
    "four": [4.0, 1.0, 3.0, 2.0],
    "five": [5.0, 1.0, 2.0, 4.0, 3.0],
    "six": [6.0, 1.0, 2.0, 4.0, 3.0, 5.0],
    "ten": [float(i) for i in range(10)],
    "signs": [-3.5, -0.25, 0.0, 0.0, 1e-9, -1e-9, 7.0, 7.0],
    "ties": [0.0] * 50 + [1.0] * 30 + [2.0],
    "nan": [1.0, NAN, 2.0, 3.0, 4.0],
    "mostly_nan": [NAN, NAN, 1.0],
    "close": [1.0 + i * 1e-6 for i in range(101)],
}


@pytest.mark.parametrize("bucket_rows,limit", [(10**9, 1 << 25), (1, 1 << 25), (10**9, 0), (1, 0)])
def test_matches_numpy(spark, bucket_rows, limit):
    rng = np.random.default_rng(0)
    groups = dict(GROUPS)
    groups["hot"] = rng.lognormal(0, 2, 3000).tolist() + [0.0] * 700
    groups["normal"] = rng.normal(0, 1, 999).tolist()
    got = run(spark, groups, bucket_rows=bucket_rows, limit=limit)
    for g, values in groups.items():
        np.testing.assert_allclose(got[g], expected(values), rtol=1e-10, atol=1e-12, err_msg=g)


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_null_keys_and_a_value_that_fills_half_a_group(spark, limit):
    values = {None: [1.0, 2.0, 3.0], "half": [5.0] * 2000 + np.arange(2000.0).tolist()}
    got = run(spark, values, limit=limit, bucket_rows=50)
    for g, x in values.items():
        np.testing.assert_allclose(got[g], expected(x), rtol=1e-12, err_msg=str(g))


def test_a_bucket_that_needs_two_cuts(spark):
    """Nearly all values of a bucket lie in one of its slices."""
    x = [1.0, 1.08] + [1.0 + i * 1e-9 for i in range(1, 400)]
    got = run(spark, {"a": x}, bucket_rows=20)
    np.testing.assert_allclose(got["a"], expected(x), rtol=1e-12)


def test_infinity(spark):
    got = run(spark, {"a": [1.0, 2.0, INF, 3.0, 4.0], "b": [INF, INF, 1.0], "c": [-INF, 1.0, 2.0]})
    assert got["a"][1] == INF and got["a"][3] == 3.0 and got["a"][5] == 3.0
    assert got["b"][3] == INF
    assert got["c"][3] == 1.0 and got["c"][1] == -INF


def test_nulls_are_left_out_and_no_keys_work(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    row = R.order_statistics(df, [], "v", {"median": 0.5}).first()
    assert (row["n"], row["mean"], row["median"]) == (2, 2.0, 2.0)


def test_value_bucket_never_decreases(spark):
    values = sorted(
        [0.0, 1e-300, 5e-324, 1.0, 1.0000001, 1e300, -1e-300, -1.0, -1e300, 0.1, 0.2, 3.7]
        + [INF, -INF]
    ) + [NAN]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in df.select("i", R.value_bucket("v").alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("parts", [1, 7])
def test_hash_rank(spark, parts):
    ids = list(range(500))
    df = spark.range(500).withColumn("g", (F.col("id") < 400).cast("string")).repartition(parts)
    got = R.hash_rank(df, ["g"], order_key(1, "id"), ["id"], "r").collect()
    for g, members in (("true", ids[:400]), ("false", ids[400:])):
        order = sorted(members, key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])] == order


def test_number_rank_on_clumped_ids(spark):
    """Half of the ids lie close together, the others far apart."""
    ids = list(range(300)) + [2**40 + 7 * i for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = {r["id"]: r["r"] for r in R.number_rank(df, [], "id", "r").collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("limit", [10**9, 0])
def test_attach_is_the_same_join_with_and_without_broadcast(spark, limit):
    big = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, s string")
    got = staging.attach(big, staging.settle(small, "t"), ["k"], ["id"], limit=limit)
    want = big.join(small, "k")
    assert sorted(got.select("id", "k", "s").collect()) == sorted(want.select("id", "k", "s").collect())


@pytest.mark.parametrize("limit", [10**9, 0])
def test_attach_joins_null_keys(spark, limit):
    big = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id int, k int")
    small = staging.settle(spark.createDataFrame([(None, "n"), (5, "f")], "k int, s string"), "t")
    got = staging.attach(big, small, ["k"], ["id"], "left", limit=limit)
    assert sorted((r["id"], r["s"] or "") for r in got.collect()) == [(1, "n"), (2, "f"), (3, "")]


def test_salted_join_spreads_a_hot_key(spark):
    big = spark.range(1000).withColumn("k", F.lit(0).cast("long"))
    small = staging.settle(spark.createDataFrame([(0, "a")], "k long, s string"), "t")
    plan = staging.attach(big, small, ["k"], ["id"], limit=0)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_work_dir_is_the_configured_one(spark):
    assert staging.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
