"""Golden rows for the numeric rules."""

import math

import pytest
from pyspark.sql import functions as F

from premisa.functions import exprs as X

NAN, INF = float("nan"), float("inf")


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "a, b, want",
    [(1.0, 0.0, INF), (-2.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (6.0, 3.0, 2.0),
     (None, 0.0, None), (1.0, None, None), (NAN, 2.0, NAN), (1.0, INF, 0.0)],
)
def test_safe_div(spark, a, b, want):
    got = one(spark, "a double, b double", (a, b), X.safe_div("a", "b"))
    assert got == want or (want is not None and math.isnan(want) and math.isnan(got))


@pytest.mark.parametrize("x, want", [(-1.0, 0.0), (2.0, 2.0), (None, None), (INF, INF)])
def test_clip_zero(spark, x, want):
    assert one(spark, "x double", (x,), X.clip_zero("x")) == want


def test_clip_zero_keeps_nan_and_drops_negative_zero(spark):
    assert math.isnan(one(spark, "x double", (NAN,), X.clip_zero("x")))
    assert math.copysign(1, one(spark, "x double", (-0.0,), X.clip_zero("x"))) == 1


def test_nan_is_not_above_half(spark):
    assert one(spark, "x double", (NAN,), X.above_half("x")) is False
    assert one(spark, "x double", (0.5,), X.above_half("x")) is False
    assert one(spark, "x double", (0.51,), X.above_half("x")) is True


def test_logit_is_clamped(spark):
    top = math.log((1 - 1e-6) / 1e-6)
    assert one(spark, "x double", (1.0,), X.logit("x")) == pytest.approx(top)
    assert one(spark, "x double", (0.0,), X.logit("x")) == pytest.approx(-top)
    assert one(spark, "x double", (0.75,), X.logit("x")) == pytest.approx(math.log(3))


def test_vectors(spark):
    row = ([3.0, 4.0], [4.0, 3.0])
    schema = "a array<double>, b array<double>"
    assert one(spark, schema, row, X.dot("a", "b")) == 24.0
    assert one(spark, schema, row, X.norm("a")) == 5.0
    assert one(spark, schema, row, X.unit("a")) == [0.6, 0.8]
    assert one(spark, schema, row, X.cosine("a", "b")) == pytest.approx(0.96)
    assert one(spark, schema, row, X.minus("a", "b")) == [-1.0, 1.0]
    assert one(spark, schema, row, X.scaled("a", F.lit(2.0))) == [6.0, 8.0]


def test_zero_vector(spark):
    row = ([0.0, 0.0], [1.0, 0.0])
    schema = "a array<double>, b array<double>"
    assert one(spark, schema, row, X.unit("a")) == [0.0, 0.0]
    assert math.isnan(one(spark, schema, row, X.cosine("a", "b")))


def test_cosine_rejects_other_width(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, "a array<double>, b array<double>", ([1.0], [1.0, 2.0]), X.cosine("a", "b"))


def test_log_ratio(spark):
    assert one(spark, "a double, b double", (0.0, 2.0), X.log_ratio("a", "b")) == -INF
    assert one(spark, "a double, b double", (2.0, 2.0), X.log_ratio("a", "b")) == 0.0
    assert math.isnan(one(spark, "a double, b double", (0.0, 0.0), X.log_ratio("a", "b")))


def test_mean_skipping_nan(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (3.0,), (None,)], "x double")
    assert df.agg(X.mean_skipping_nan("x")).first()[0] == 2.0


def test_float_rounding(spark):
    got = one(spark, "a array<double>", ([0.1, None],), X.doubles("a", through_float=True))
    assert got[0] == pytest.approx(0.10000000149, abs=1e-11) and got[1] is None


def test_order_key_is_md5_of_seed_and_id(spark):
    import hashlib

    got = one(spark, "id long", (17,), X.order_key(3, "id"))
    assert got == hashlib.md5(b"3:17").hexdigest()


def test_text_id_separates_values(spark):
    schema = "a string, b string"
    assert one(spark, schema, ("ab", "c"), X.text_id("a", "b")) != one(
        spark, schema, ("a", "bc"), X.text_id("a", "b")
    )
    assert one(spark, schema, ("ab", "c"), X.text_id("a", "b", separator="")) == one(
        spark, schema, ("a", "bc"), X.text_id("a", "b", separator="")
    )


@pytest.mark.parametrize("digits", [3, 6])
def test_rounded_is_round(spark, digits):
    """Ties, neighbours of ties, signs, zeros, numbers without a fraction and what is no number."""
    ties = [k / 2 / 10**digits for k in range(-9, 10)]
    near = [math.nextafter(x, to) for x in ties for to in (INF, -INF)]
    rest = [NAN, INF, -INF, 0.0, -0.0, None, 1e300, -1e-300, 2.0**52, 123456789.1234565, 0.1 + 0.2, -2 / 3]
    df = spark.createDataFrame([(x,) for x in ties + near + rest], "x double")
    rows = df.select(X.rounded("x", digits).alias("a"), F.round("x", digits).alias("b")).collect()
    assert [str(r["a"]) for r in rows] == [str(r["b"]) for r in rows]
