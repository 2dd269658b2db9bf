"""Ranking probes by their error scores and picking the best layer.

``aggr_stats`` has one row per probe and subgroup; a partition of these windows holds at most
layers x methods x subgroups rows, a number given by the catalogues and not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premisa.plans.metrics import AGGREGATES
from premisa.sources.catalog import METHOD_NAMES
from premisa.sources.staging import new_path

L2 = ["dataset", "model"]
RANKED = ["error_1", "error_2", "error_3", "error_4"]  # and the supervised error, mean only
LM_HEAD = {"lm_head", "lm_head_baseline", METHOD_NAMES["lm_head_baseline"]}
KEY = [*L2, "layer", "method", "subgroup"]
SHOWN = [
    "layer",
    "accuracy_pos_prem",
    "trim_mean_avg_rank",
    "p_h_p_e",
    "p_h_np_e",
    "p_h",
    "p_h_np_c",
    "p_h_p_c",
    "trim_mean_error_1",
    "trim_mean_error_2",
    "trim_mean_error_3",
    "trim_mean_error_4",
]


def scores_long(aggr: DataFrame) -> DataFrame:
    """``(key, score, value)`` for the ranked scores; the logit baseline counts for layer 1 only."""
    names = [f"{a}_{e}" for a in AGGREGATES for e in RANKED] + ["mean_error_sv"]
    kept = aggr.filter(~F.col("method").isin(list(LM_HEAD)) | (F.col("layer") == 1))
    return kept.unpivot(KEY, names, "score", "value")


def metric_ranks(aggr: DataFrame) -> DataFrame:
    """Rank of every probe for every score among the probes of its dataset and model.

    All scores are ranked by one window. Missing scores rank last; ties, judged on nine decimals,
    go by layer, method and subgroup.
    """
    order = Window.partitionBy(*L2, "score").orderBy(
        F.round("value", 9).asc_nulls_last(), "layer", "method", "subgroup"
    )
    return scores_long(aggr).withColumn("rank", F.row_number().over(order))


def with_ranks(aggr: DataFrame) -> DataFrame:
    """Add ``<aggregate>_<error>_rank`` and ``<aggregate>_avg_rank`` columns."""
    names = [f"{a}_{e}" for a in AGGREGATES for e in RANKED] + ["mean_error_sv"]
    columns = [
        F.max(F.when(F.col("score") == n, F.col("rank"))).alias(f"{n}_rank") for n in names
    ]
    ranked = aggr.join(metric_ranks(aggr).groupBy(*KEY).agg(*columns), KEY, "left")
    for a in AGGREGATES:
        total = sum((F.col(f"{a}_{e}_rank") for e in RANKED), F.col("mean_error_sv_rank"))
        ranked = ranked.withColumn(f"{a}_avg_rank", total / F.lit(5.0))
    return ranked


def best_layer(ranked: DataFrame, criterion: str) -> DataFrame:
    """The row at the best layer per dataset, model, method and subgroup.

    Rows without the criterion are skipped; all shown values come from the same row.
    """
    by = {
        "accuracy": -F.round("accuracy_pos_prem", 9),
        "avg_rank": F.col("trim_mean_avg_rank"),
    }[criterion]
    row = F.min_by(F.struct(*SHOWN), F.struct(by.alias("by"), "layer"))
    return (
        ranked.filter(by.isNotNull() & ~F.isnan(by))
        .groupBy(*L2, "method", "subgroup")
        .agg(row.alias("_row"))
        .select(F.lit(criterion).alias("criterion"), *L2, "method", "subgroup", "_row.*")
    )


def final_table(aggr: DataFrame) -> DataFrame:
    """Best layer by accuracy and by average rank, both in one table."""
    ranked = with_ranks(aggr)
    return best_layer(ranked, "accuracy").unionByName(best_layer(ranked, "avg_rank"))


def write_final_tables(final: DataFrame, path: str | None = None) -> str:
    """One CSV file per dataset and model, sorted by subgroup and method."""
    path = path or new_path(final.sparkSession, "final-table")
    (
        final.repartition(*L2)
        .sortWithinPartitions(*L2, "subgroup", "method", "criterion")
        .write.partitionBy(*L2)
        .option("header", True)
        .csv(path)
    )
    return path


# --- tables behind the figures -------------------------------------------------------------


def metric_series(aggr: DataFrame) -> DataFrame:
    """Long table of the metrics drawn over layers."""
    metrics = ["accuracy_no_prem", "accuracy_pos_prem", "premise_sensitivity", "rel_error_sv"]
    errors = [f"{a}_{e}" for e in [*RANKED, "error_3_4"] for a in ("mean", "trim_mean", "median")]
    return aggr.unpivot(KEY, [*metrics, *errors, "mean_error_sv"], "metric", "value")


def median_bands(aggr: DataFrame) -> DataFrame:
    """20th percentile, median and 80th percentile of every error by layer."""
    bands = [
        F.struct(
            F.lit(e).alias("error"),
            F.col(f"p20_{e}").alias("low"),
            F.col(f"median_{e}").alias("middle"),
            F.col(f"p80_{e}").alias("high"),
        )
        for e in [*RANKED, "error_3_4"]
    ]
    return aggr.select(*KEY, F.inline(F.array(*bands)))
