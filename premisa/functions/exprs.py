"""Numeric, vector and hashing expressions with pinned-down NULL / NaN / zero rules.

All of them are built-in Spark expressions, so they stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")
LOGIT_EPS = 1e-6
NORM_FLOOR = 1e-12


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain sub-expression inside a higher-order lambda is evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# --- scalars -------------------------------------------------------------------------------


def safe_div(a: Column | str, b: Column | str) -> Column:
    """IEEE division: x/0 is signed infinity, 0/0 and NaN/0 are NaN, NULL stays NULL."""
    a, b = as_col(a), as_col(b)
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, by_zero).otherwise(a / b)


def is_finite(x: Column | str) -> Column:
    x = as_col(x)
    return ~F.isnan(x) & (F.abs(x) < INF)


def rounded(x: Column | str, digits: int) -> Column:
    """``round(x, digits)`` of a double; decimal arithmetic is done near a half and for large numbers only.

    Elsewhere the whole number is certain, and its division gives the double next to the decimal, as ``round`` does.
    """
    x, scale = as_col(x), F.lit(float(10**digits))
    whole = F.rint(x * scale)
    sure = (F.abs(x * scale - whole) < 0.499) & (F.abs(x) < 2.0**40 / 10**digits)
    # a zero has no sign
    return F.when(sure, (whole + 0.0) / scale).otherwise(F.round(x, digits))


def clip_zero(x: Column | str) -> Column:
    """Values below zero become zero; NaN stays NaN and NULL stays NULL."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


def above_half(p: Column | str) -> Column:
    """``p > 0.5`` where a NaN is not above anything (Spark orders NaN last)."""
    p = as_col(p)
    return (p > 0.5) & ~F.isnan(p)


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def logit(p: Column | str, eps: float = LOGIT_EPS) -> Column:
    q = F.least(F.greatest(as_col(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(q / (F.lit(1.0) - q))


def pair_probability(neg: Column | str, pos: Column | str) -> Column:
    """Mean of the positive side's probability and the negative side's complement."""
    return (as_col(pos) + (F.lit(1.0) - as_col(neg))) / F.lit(2.0)


def log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln(a/b) with ln(0) = -inf; a negative ratio has no logarithm (NaN)."""
    q = safe_div(a, b)
    return F.when(q == 0, F.lit(-INF)).when(q < 0, F.lit(NAN)).otherwise(F.ln(q))


def mean_skipping_nan(x: Column | str) -> Column:
    x = as_col(x)
    return F.avg(F.when(~F.isnan(x), x))


# --- vectors -------------------------------------------------------------------------------


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column | str, factor: Column) -> Column:
    return bind(factor, lambda s: F.transform(as_col(a), lambda x: x * s))


def unit(a: Column | str) -> Column:
    """Vector over its length; the zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(NORM_FLOOR))
    return bind(length, lambda s: F.transform(as_col(a), lambda x: x / s))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; vectors of different length are an error, zero gives NaN."""
    a, b = as_col(a), as_col(b)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(same.isNull(), safe_div(dot(a, b), norm(a) * norm(b)))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x - y)


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x + y)


def doubles(a: Column | str, through_float: bool = False) -> Column:
    """Cast to ``array<double>``; ``through_float`` rounds to 32 bits first."""
    a = as_col(a)
    return (a.cast("array<float>") if through_float else a).cast("array<double>")


def has_nan(a: Column | str) -> Column:
    return F.exists(as_col(a), lambda x: F.isnan(x))


# --- text ----------------------------------------------------------------------------------


def strip(text: Column | str) -> Column:
    """Without white space (line ends included) at both ends."""
    return F.regexp_replace(as_col(text), r"^\s+|\s+$", "")


# --- hashing -------------------------------------------------------------------------------


def order_key(seed: int, *ids: Column | str) -> Column:
    """Hex string whose ascending order is a reproducible random permutation of the ids.

    It depends on the row's identity only, never on partitioning.
    """
    parts = [as_col(c).cast("string") for c in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def hash_number(key: Column) -> Column:
    """First eight hex digits of an order key as an integer."""
    return hex_number(F.substring(key, 1, 8))


def text_id(*cols: Column | str, separator: str = "\u0001") -> Column:
    """SHA-256 of the values' texts joined with a separator no value contains."""
    return F.sha2(F.concat_ws(separator, *[as_col(c).cast("string") for c in cols]), 256)
