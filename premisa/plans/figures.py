"""Tables behind the box plots and the E3/E4 plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premisa.functions.exprs import log_ratio
from premisa.operators.ranking import order_statistics, value_buckets, value_rows
from premisa.plans.metrics import with_subgroups
from premisa.plans.rank import KEY
from premisa.sources.catalog import VARIANTS
from premisa.sources.staging import attach, settle


def e3_e4_series(aggr: DataFrame, aggregate: str = "trim_mean") -> DataFrame:
    e3, e4 = f"{aggregate}_error_3", f"{aggregate}_error_4"
    return aggr.select(
        *KEY, F.col(e3).alias("e3"), F.col(e4).alias("e4"), log_ratio(e3, e4).alias("log_ratio")
    )


def premise_flags(run_name: str = "variant"):
    """(origin, asserted) of a variant name such as ``random_neg_prem``.

    The names of the catalogue are looked up, others are cut by a regular expression.
    """
    name = F.col(run_name)
    origin = F.regexp_extract(F.concat(F.lit("x-"), name), r"\w-([a-z]*)_.*", 1)
    for variant in VARIANTS:
        origin = F.when(name == variant, variant.split("_")[0]).otherwise(origin)
    return origin.alias("premise_origin"), (~name.endswith("neg_prem")).alias("premise_asserted")


def strip_data(predictions: DataFrame) -> DataFrame:
    """Long rows of the strip plot: one per prediction and subgroup."""
    return with_subgroups(predictions).select(
        "dataset", "model", "layer", "method", "subgroup", "label", *premise_flags(), "sample_id",
        "prediction",
    )


def box_summary(strip: DataFrame) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 interquartile ranges.

    The ends of the value buckets give the whiskers, but for buckets that a bound cuts: only their rows are
    looked at again. The rows are read two or three times and never staged, as they are many.
    """
    keys = [
        "dataset", "model", "layer", "method", "subgroup", "label", "premise_origin",
        "premise_asserted",
    ]
    rows = value_rows(strip, keys, "prediction")
    buckets = settle(value_buckets(rows, keys), "value-buckets")
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    stats = order_statistics(strip, keys, "prediction", quartiles, buckets=buckets)
    stats = settle(stats, "quartiles")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    bounds = stats.select(*keys, (F.col("q1") - reach).alias("_from"), (F.col("q3") + reach).alias("_to"))
    placed = attach(buckets, settle(bounds, "bounds"), keys, ["_b"])
    whole = (F.col("_low") >= F.col("_from")) & (F.col("_high") <= F.col("_to"))
    met = (F.col("_high") >= F.col("_from")) & (F.col("_low") <= F.col("_to"))
    found = [placed.filter(whole).select(*keys, "_low", "_high")]
    cut = settle(placed.filter(met & ~whole).select(*keys, "_b", "_from", "_to"), "cut-buckets")
    if not cut.isEmpty():
        inside = F.col("_v").between(F.col("_from"), F.col("_to"))
        again = attach(rows, cut, [*keys, "_b"], ["_v"]).filter(inside)
        found.append(again.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    ends = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(
        F.min("_low").alias("low"), F.max("_high").alias("high")
    )
    return stats.drop("mean").join(ends, keys)
