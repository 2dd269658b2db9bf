"""Predictions before and after an intervention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premisa.operators.ranking import order_statistics

RUN = ["dataset", "model", "layer", "method"]


def align(results: DataFrame) -> DataFrame:
    """One row per run and sample with the original and the intervened prediction."""
    p = F.col("prediction")
    return results.groupBy(*RUN, "sample_id", "label").agg(
        F.max(F.when(F.col("setting") == "original", p)).alias("original"),
        F.max(F.when(F.col("setting") == "intervened", p)).alias("intervened"),
    )


def effects(results: DataFrame) -> DataFrame:
    return align(results).withColumn("difference", F.col("intervened") - F.col("original"))


def before_after(results: DataFrame) -> DataFrame:
    """Per run and label: means before and after, mean and median difference, side by side."""
    rows = effects(results)
    means = rows.groupBy(*RUN).agg(
        *[
            F.avg(F.when(F.col("label") == label, F.col(column))).alias(f"mean_{column}_{label}")
            for label in (0, 1)
            for column in ("original", "intervened", "difference")
        ]
    )
    stats = order_statistics(rows, [*RUN, "label"], "difference", {"median": 0.5})
    medians = stats.groupBy(*RUN).agg(
        *[
            F.max(F.when(F.col("label") == label, F.col("median"))).alias(
                f"median_difference_{label}"
            )
            for label in (0, 1)
        ]
    )
    return means.join(medians, RUN)


def setting_arrays(results: DataFrame) -> DataFrame:
    """Per run and sample the settings met and the first and last prediction by setting."""
    p = F.col("prediction")
    return results.groupBy(*RUN, "sample_id").agg(
        F.any_value("label", True).alias("label"),
        F.array_join(F.array_sort(F.collect_set("setting")), ",").alias("settings"),
        F.min_by(p, "setting").alias("intervened"),
        F.max_by(p, "setting").alias("original"),
    )
