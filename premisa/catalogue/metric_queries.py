"""Queries over predictions: error metrics, ranks, best layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premisa.catalogue.registry import query, r6
from premisa.functions import exprs
from premisa.functions.exprs import above_half, clip_zero, safe_div
from premisa.operators.ranking import order_statistics
from premisa.plans import causal, figures, metrics, rank
from premisa.sources import fixtures as fx
from premisa.sources import io

GROUP = metrics.GROUP
G = "dataset, model, layer, method, subgroup"


def all_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return fx.all_predictions(spark, sf)


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Every prediction in each of its subgroups."""
    return metrics.with_subgroups(all_predictions(spark, sf))


def errors(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_errors(metrics.wide_predictions(tagged(spark, sf)))


def staged_errors(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.staged_errors(tagged(spark, sf))


def aggr_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.scores_of(tagged(spark, sf))


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    values = [
        exprs.rounded(c, 6).alias(c) if kind == "double" else r6(c)
        for c, kind in df.dtypes
        if c not in keys
    ]
    return df.select(*keys, *values)


def sql_rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


WIDE = "o n sp sn rp rn h"
WIDE_NAMES = {
    "o": "original_pos_prem", "n": "original_neg_prem", "sp": "shuffle_pos_prem",
    "sn": "shuffle_neg_prem", "rp": "random_pos_prem", "rn": "random_neg_prem", "h": "no_prem",
}


@query(
    "j15_variant_pivot",
    f"SELECT {G}, sample_id, label, "
    + ", ".join(f"round({a}, 6) AS {b}" for a, b in WIDE_NAMES.items())
    + " FROM wide",
    "wide",
)
def j15(spark, sf):
    df = metrics.variant_pivot(tagged(spark, sf))
    return rounded(df, [*GROUP, "sample_id", "label"])


@query(
    "x1_premise_effect",
    f"SELECT {G}, sample_id, round(pe, 6) AS pe FROM errs",
    "errs",
)
def x1(spark, sf):
    return errors(spark, sf).select(*GROUP, "sample_id", r6("pe"))


def error_query(name: str, columns: list[str]) -> None:
    sql = (
        f"SELECT {G}, sample_id, " + sql_rounded(" ".join(columns)) + " FROM errs"
    )

    @query(name, sql, "errs")
    def run(spark, sf):
        return errors(spark, sf).select(*GROUP, "sample_id", *[r6(c) for c in columns])


error_query("x2_error_1", ["error_1_pos", "error_1_neg"])
error_query("x3_error_2", ["error_2_pos", "error_2_neg"])
error_query("x4_error_3", ["error_3"])
error_query("x5_error_4", ["error_4"])
error_query("x6_error_3_4", ["error_3_4"])
error_query("x7_supervised_error", ["error_sv", "error_sv_0", "error_sv_1"])


@query(
    "x8_error_aggregates",
    f"SELECT {G}, "
    + sql_rounded(
        " ".join(f"{a}_{e}" for a in metrics.AGGREGATES for e in metrics.RATIO_ERRORS)
    )
    + " FROM pooled",
    "pooled",
)
def x8(spark, sf):
    cells = metrics.cell_aggregates(staged_errors(spark, sf))
    return rounded(metrics.error_aggregates(cells), GROUP)


@query(
    "x9_cell_uniqueness",
    f"""SELECT {G}, variant, count(*) AS rows, count(DISTINCT sample_id) AS samples
FROM tagged GROUP BY ALL""",
    "tagged",
)
def x9(spark, sf):
    """Rows per cell next to its samples; they differ where a cell is filled twice."""
    per_sample = tagged(spark, sf).groupBy(*GROUP, "variant", "sample_id").agg(
        F.count("*").alias("_n")
    )
    return per_sample.groupBy(*GROUP, "variant").agg(
        F.sum("_n").alias("rows"), F.count("*").alias("samples")
    )


@query(
    "x10_probabilities",
    f"SELECT {G}, " + sql_rounded("p_h_p_e p_h_p_c p_h_np_e p_h_np_c p_h") + " FROM aggr",
    "aggr",
)
def x10(spark, sf):
    names = ["p_h_p_e", "p_h_p_c", "p_h_np_e", "p_h_np_c", "p_h"]
    return metrics.probability_means(errors(spark, sf)).select(*GROUP, *[r6(n) for n in names])


X11 = (
    "accuracy_pos_prem accuracy_no_prem premise_sensitivity mean_premise_effect error_sv_0 "
    "error_sv_1 mean_error_sv rel_error_sv"
)


@query("x11_metrics", f"SELECT {G}, " + sql_rounded(X11) + " FROM aggr", "aggr")
def x11(spark, sf):
    df = metrics.probability_means(errors(spark, sf))
    return df.select(*GROUP, *[r6(n) for n in X11.split()])


@query(
    "x12_subgroups",
    f"SELECT {G}, count(*) AS rows, round(avg(prediction), 6) AS mean FROM tagged GROUP BY ALL",
    "tagged",
)
def x12(spark, sf):
    return tagged(spark, sf).groupBy(*GROUP).agg(
        F.count("*").alias("rows"), r6(F.avg("prediction"), "mean")
    )


STATS = (
    "samples p_h_p_e p_h_p_c p_h_np_e p_h_np_c p_h " + X11 + " "
    + " ".join(f"{a}_{e}" for a in metrics.AGGREGATES for e in metrics.RATIO_ERRORS)
)


@query("x13_error_scores", f"SELECT {G}, " + sql_rounded(STATS) + " FROM stats", "stats")
def x13(spark, sf):
    return rounded(aggr_stats(spark, sf), GROUP)


BEST = " ".join(c for c in rank.SHOWN if c != "layer")


@query(
    "x14_final_table",
    "SELECT criterion, dataset, model, method, subgroup, layer, " + sql_rounded(BEST)
    + " FROM best",
    "best",
)
def x14(spark, sf):
    final = rank.final_table(aggr_stats(spark, sf))
    return rounded(final, ["criterion", "dataset", "model", "method", "subgroup", "layer"])


@query(
    "s8_grouped_csv",
    "SELECT criterion, dataset, model, method, subgroup, layer, " + sql_rounded(BEST)
    + " FROM best",
    "best",
)
def s8(spark, sf):
    path = rank.write_final_tables(rank.final_table(aggr_stats(spark, sf)))
    keys = ["criterion", "dataset", "model", "method", "subgroup"]
    schema = ", ".join(
        ["criterion string", "method string", "subgroup string", "layer int"]
        + [f"{c} double" for c in BEST.split()]
        + ["dataset string", "model string"]
    )
    back = spark.read.schema(schema).option("header", True).csv(path)
    return rounded(back, [*keys, "layer"])


@query(
    "w1_metric_rank",
    f"SELECT {G}, score, round(value, 6) AS value, rank FROM ranks",
    "ranks",
)
def w1(spark, sf):
    ranked = rank.metric_ranks(aggr_stats(spark, sf))
    return ranked.select(*GROUP, "score", r6("value"), F.col("rank").cast("bigint"))


AVG_RANKS = [f"{a}_avg_rank" for a in metrics.AGGREGATES]


@query("w2_average_rank", f"SELECT {G}, " + sql_rounded(" ".join(AVG_RANKS)) + " FROM ranked", "ranked")
def w2(spark, sf):
    return rank.with_ranks(aggr_stats(spark, sf)).select(*GROUP, *[r6(c) for c in AVG_RANKS])


def best_query(name: str, criterion: str) -> None:
    sql = (
        "SELECT dataset, model, method, subgroup, layer, " + sql_rounded(BEST)
        + f" FROM best WHERE criterion = '{criterion}'"
    )

    @query(name, sql, "best")
    def run(spark, sf):
        found = rank.best_layer(rank.with_ranks(aggr_stats(spark, sf)), criterion)
        return rounded(found.drop("criterion"), ["dataset", "model", "method", "subgroup", "layer"])


best_query("a15_best_layer_by_accuracy", "accuracy")
best_query("k6_best_layer_by_rank", "avg_rank")


@query(
    "u1_union_criteria",
    "SELECT criterion, count(*) AS rows, CAST(sum(layer) AS BIGINT) AS layers FROM best GROUP BY ALL",
    "best",
)
def u1(spark, sf):
    final = rank.final_table(aggr_stats(spark, sf))
    return final.groupBy("criterion").agg(
        F.count("*").alias("rows"), F.sum("layer").alias("layers")
    )


# --- order statistics ----------------------------------------------------------------------


def cell_query(name: str, columns: list[str]) -> None:
    sql = f"SELECT {G}, cell, " + sql_rounded(" ".join(columns)) + " FROM cells"

    @query(name, sql, "cells")
    def run(spark, sf):
        cells = metrics.cell_aggregates(staged_errors(spark, sf))
        return cells.select(*GROUP, "cell", *[r6(c) for c in columns])


cell_query("a8_median", ["median"])
cell_query("a9_percentiles", ["p20", "p80"])
cell_query("a10_trimmed_mean", ["trim_mean"])
cell_query("a11_error_mean", ["mean"])
cell_query("w7_order_statistics", ["n", "mean", "median", "trim_mean", "p20", "p80"])


@query(
    "a12_mean_over_cells",
    f"SELECT {G}, "
    + sql_rounded(" ".join(f"mean_{e}" for e in metrics.RATIO_ERRORS))
    + " FROM pooled",
    "pooled",
)
def a12(spark, sf):
    pooled = metrics.error_aggregates(metrics.cell_aggregates(staged_errors(spark, sf)))
    return pooled.select(*GROUP, *[r6(f"mean_{e}") for e in metrics.RATIO_ERRORS])


@query(
    "a6_accuracy",
    """SELECT dataset, layer, method, train_variant, variant,
  round(avg(CAST((prediction > 0.5) = (label = 1) AS INT)), 6) AS accuracy
FROM pred GROUP BY ALL""",
    "pred",
)
def a6(spark, sf):
    hit = (above_half("prediction") == (F.col("label") == 1)).cast("double")
    return fx.predictions(spark, sf).groupBy(
        "dataset", "layer", "method", "train_variant", "variant"
    ).agg(r6(F.avg(hit), "accuracy"))


@query(
    "a13_conditional_means",
    f"SELECT {G}, " + sql_rounded("p_h_p_e p_h_p_c") + " FROM aggr",
    "aggr",
)
def a13(spark, sf):
    df = metrics.probability_means(errors(spark, sf))
    return df.select(*GROUP, r6("p_h_p_e"), r6("p_h_p_c"))


@query(
    "a14_premise_sensitivity",
    f"SELECT {G}, "
    + sql_rounded("premise_sensitivity mean_premise_effect error_sv_0 error_sv_1 rel_error_sv")
    + " FROM aggr",
    "aggr",
)
def a14(spark, sf):
    names = [
        "premise_sensitivity", "mean_premise_effect", "error_sv_0", "error_sv_1", "rel_error_sv",
    ]
    return metrics.probability_means(errors(spark, sf)).select(*GROUP, *[r6(n) for n in names])


@query(
    "a18_label_agreement",
    """SELECT dataset, count(*) AS samples, CAST(sum(CAST(labels > 1 AS INT)) AS BIGINT) AS conflicts
FROM (SELECT dataset, sample_id, count(DISTINCT label) AS labels FROM pred GROUP BY ALL)
GROUP BY ALL""",
    "pred",
)
def a18(spark, sf):
    per_sample = fx.predictions(spark, sf).groupBy("dataset", "sample_id").agg(
        (F.min("label") < F.max("label")).cast("int").alias("_conflict")
    )
    return per_sample.groupBy("dataset").agg(
        F.count("*").alias("samples"), F.sum("_conflict").alias("conflicts")
    )


@query(
    "a23_nested_groups",
    """SELECT dataset, model, layer, method, count(*) AS rows,
  count(DISTINCT train_variant) AS train_variants, round(sum(prediction), 3) AS total
FROM pred GROUP BY ALL""",
    "pred",
)
def a23(spark, sf):
    """Both nested loops of the analysis as one grouping by composite keys."""
    inner = fx.predictions(spark, sf).groupBy(*metrics.RUN, "train_variant").agg(
        F.count("*").alias("_n"), F.sum("prediction").alias("_s")
    )
    return inner.groupBy(*metrics.RUN).agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("train_variants"),
        F.round(F.sum("_s"), 3).alias("total"),
    )


# --- scalar functions on metrics -----------------------------------------------------------


@query(
    "f8_clip",
    f"SELECT {G}, round(avg(greatest(-pe, 0e0)), 6) AS below, "
    "round(avg(greatest(pe, 0e0)), 6) AS above FROM errs GROUP BY ALL",
    "errs",
)
def f8(spark, sf):
    return errors(spark, sf).groupBy(*GROUP).agg(
        r6(F.avg(clip_zero(-F.col("pe"))), "below"), r6(F.avg(clip_zero("pe")), "above")
    )


@query(
    "f9_safe_ratio",
    f"""SELECT {G}, CAST(sum(CAST(isnan(q) AS INT)) AS BIGINT) AS nans,
  CAST(sum(CAST(isinf(q) AS INT)) AS BIGINT) AS infs,
  count(*) AS rows FROM (SELECT *, abs(n - o) / abs(pe) AS q FROM errs) GROUP BY ALL""",
    "errs",
)
def f9(spark, sf):
    q = safe_div(
        F.abs(F.col("original_neg_prem") - F.col("original_pos_prem")), F.abs(F.col("pe"))
    )
    return errors(spark, sf).withColumn("q", q).groupBy(*GROUP).agg(
        F.sum(F.isnan("q").cast("int")).alias("nans"),
        F.sum((F.abs("q") == float("inf")).cast("int")).alias("infs"),
        F.count("*").alias("rows"),
    )


# --- tables behind figures -----------------------------------------------------------------

SERIES = (
    ["accuracy_no_prem", "accuracy_pos_prem", "premise_sensitivity", "rel_error_sv"]
    + [
        f"{a}_error_{e}"
        for e in ("1", "2", "3", "4", "3_4")
        for a in ("mean", "trim_mean", "median")
    ]
    + ["mean_error_sv"]
)


@query(
    "x16_metric_series",
    f"SELECT {G}, metric, round(value, 6) AS value FROM (SELECT {G}, unnest(["
    + ", ".join(f"{{'metric': '{m}', 'value': {m}}}" for m in SERIES)
    + "], recursive := true) FROM stats)",
    "stats",
)
def x16(spark, sf):
    return rounded(rank.metric_series(aggr_stats(spark, sf)), [*GROUP, "metric"])


@query(
    "x17_e3_e4",
    f"""SELECT {G}, round(e3, 6) AS e3, round(e4, 6) AS e4, round(CASE WHEN e3 / e4 = 0
  THEN '-inf'::DOUBLE ELSE ln(e3 / e4) END, 6) AS log_ratio
FROM (SELECT *, trim_mean_error_3 AS e3, trim_mean_error_4 AS e4 FROM stats)""",
    "stats",
)
def x17(spark, sf):
    return rounded(figures.e3_e4_series(aggr_stats(spark, sf)), GROUP)


@query(
    "f10_log_ratio",
    f"SELECT {G}, round(ln(mean_error_sv / premise_sensitivity), 6) AS log_ratio FROM aggr",
    "aggr",
)
def f10(spark, sf):
    from premisa.functions.exprs import log_ratio

    df = metrics.probability_means(errors(spark, sf))
    return df.select(*GROUP, r6(log_ratio("mean_error_sv", "premise_sensitivity"), "log_ratio"))


STRIP_SQL = f"""SELECT {G}, label, split_part(variant, '_', 1) AS premise_origin,
  variant NOT LIKE '%neg$_prem' ESCAPE '$' AS premise_asserted, sample_id, prediction
FROM tagged"""


@query(
    "x18_strip_data",
    f"""SELECT {G}, label, premise_origin, premise_asserted, count(*) AS rows,
  round(sum(prediction), 3) AS total FROM ({STRIP_SQL}) GROUP BY ALL""",
    "tagged",
)
def x18(spark, sf):
    strip = strip_rows(spark, sf)
    return strip.groupBy(*GROUP, "label", "premise_origin", "premise_asserted").agg(
        F.count("*").alias("rows"), F.round(F.sum("prediction"), 3).alias("total")
    )


def strip_rows(spark, sf):
    return figures.strip_data(all_predictions(spark, sf))


@query(
    "a25_box_summary",
    f"""SELECT {G}, label, premise_origin, premise_asserted, n, round(q1, 6) AS q1,
  round(median, 6) AS median, round(q3, 6) AS q3,
  round(list_min(list_filter(s, lambda x: x >= q1 - 1.5e0 * (q3 - q1))), 6) AS low,
  round(list_max(list_filter(s, lambda x: x <= q3 + 1.5e0 * (q3 - q1))), 6) AS high
FROM (SELECT {G}, label, premise_origin, premise_asserted, count(*) AS n,
  quantile_cont(prediction, 0.25) AS q1, median(prediction) AS median,
  quantile_cont(prediction, 0.75) AS q3, list(prediction) AS s
 FROM ({STRIP_SQL}) GROUP BY ALL)""",
    "tagged",
)
def a25(spark, sf):
    keys = [*GROUP, "label", "premise_origin", "premise_asserted"]
    return rounded(figures.box_summary(strip_rows(spark, sf)), keys)


@query(
    "a26_median_bands",
    f"SELECT {G}, error, round(low, 6) AS low, round(middle, 6) AS middle, round(high, 6) AS high "
    f"FROM (SELECT {G}, unnest(["
    + ", ".join(
        f"{{'error': '{e}', 'low': p20_{e}, 'middle': median_{e}, 'high': p80_{e}}}"
        for e in metrics.RATIO_ERRORS
    )
    + "], recursive := true) FROM stats)",
    "stats",
)
def a26(spark, sf):
    return rounded(rank.median_bands(aggr_stats(spark, sf)), [*GROUP, "error"])


@query(
    "k1_sorted_final_table",
    "SELECT dataset, model, criterion, subgroup, method, layer, row_number() OVER "
    "(PARTITION BY dataset, model ORDER BY subgroup, method, criterion) AS place FROM best",
    "best",
)
def k1(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("dataset", "model").orderBy("subgroup", "method", "criterion")
    final = rank.final_table(aggr_stats(spark, sf))
    return final.select(
        "dataset", "model", "criterion", "subgroup", "method", "layer",
        F.row_number().over(order).cast("bigint").alias("place"),
    ).orderBy("dataset", "subgroup", "method", "criterion")


# --- before / after ------------------------------------------------------------------------

C = "dataset, model, layer, method"
CAUSAL = "dataset model layer method".split()
DIFF = """aligned AS (SELECT dataset, model, layer, method, sample_id, label,
  max(prediction) FILTER (setting = 'original') AS original,
  max(prediction) FILTER (setting = 'intervened') AS intervened FROM caus GROUP BY ALL)"""


@query(
    "j16_before_after_align",
    f"""SELECT {C}, sample_id, label,
  round(max(prediction) FILTER (setting = 'original'), 6) AS original,
  round(max(prediction) FILTER (setting = 'intervened'), 6) AS intervened
FROM caus GROUP BY ALL""",
    "caus",
)
def j16(spark, sf):
    return rounded(causal.align(fx.causal(spark, sf)), [*CAUSAL, "sample_id", "label"])


SETTINGS_SQL = f"""SELECT {C}, sample_id, any_value(label) AS label,
  string_agg(setting, ',' ORDER BY setting) AS settings,
  round(arg_min(prediction, setting), 6) AS intervened,
  round(arg_max(prediction, setting), 6) AS original FROM caus GROUP BY ALL"""


@query("a16_first_last_by_setting", SETTINGS_SQL, "caus")
def a16(spark, sf):
    df = causal.setting_arrays(fx.causal(spark, sf))
    return df.select(*CAUSAL, "sample_id", "label", "settings", r6("intervened"), r6("original"))


@query(
    "w3_ordered_first_last",
    f"""SELECT {C}, round(sum(f), 3) AS first_total, round(sum(l), 3) AS last_total FROM (
 SELECT {C}, sample_id, arg_min(prediction, setting) AS f, arg_max(prediction, setting) AS l
 FROM caus GROUP BY ALL) GROUP BY ALL""",
    "caus",
)
def w3(spark, sf):
    df = causal.setting_arrays(fx.causal(spark, sf))
    return df.groupBy(*CAUSAL).agg(
        F.round(F.sum("intervened"), 3).alias("first_total"),
        F.round(F.sum("original"), 3).alias("last_total"),
    )


BEFORE_AFTER = (
    "mean_original_0 mean_intervened_0 mean_difference_0 mean_original_1 mean_intervened_1 "
    "mean_difference_1 median_difference_0 median_difference_1"
)


@query(
    "x19_before_after",
    f"SELECT {C}, "
    + ", ".join(
        f"round({f}({x}) FILTER (label = {label}), 6) AS {name}"
        for name in BEFORE_AFTER.split()
        for f, column, label in [name.replace("mean", "avg").rsplit("_", 2)]
        for x in ["intervened - original" if column == "difference" else column]
    )
    + f""" FROM (SELECT {C}, sample_id, label,
  max(prediction) FILTER (setting = 'original') AS original,
  max(prediction) FILTER (setting = 'intervened') AS intervened FROM caus GROUP BY ALL)
GROUP BY ALL""",
    "caus",
)
def x19(spark, sf):
    df = causal.before_after(fx.causal(spark, sf))
    return df.select(*CAUSAL, *[r6(c) for c in BEFORE_AFTER.split()])


@query(
    "a17_difference_by_label",
    f"""SELECT {C}, label, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median
FROM (SELECT {C}, sample_id, label, max(prediction) FILTER (setting = 'intervened')
  - max(prediction) FILTER (setting = 'original') AS d FROM caus GROUP BY ALL) GROUP BY ALL""",
    "caus",
)
def a17(spark, sf):
    rows = causal.effects(fx.causal(spark, sf))
    stats = order_statistics(rows, [*CAUSAL, "label"], "difference", {"median": 0.5})
    return stats.select(*CAUSAL, "label", "n", r6("mean"), r6("median"))


@query(
    "f16_masked_select",
    f"""SELECT {C}, sample_id, round(max(prediction) FILTER (setting = 'intervened')
  - max(prediction) FILTER (setting = 'original'), 6) AS difference_1
FROM caus WHERE label = 1 GROUP BY ALL""",
    "caus",
)
def f16(spark, sf):
    """Differences of the true samples; the mask is a filter that reaches the scan."""
    true_only = fx.causal(spark, sf).filter("label = 1")
    return causal.effects(true_only).select(*CAUSAL, "sample_id", r6("difference", "difference_1"))


@query(
    "s10_register_table",
    "SELECT variant, count(*) AS rows, round(avg(prediction), 6) AS mean FROM pred GROUP BY ALL",
    "pred",
)
def s10(spark, sf):
    fx.predictions(spark, sf).createOrReplaceTempView("premisa_results")
    return spark.sql(
        "SELECT variant, count(*) AS rows, round(avg(prediction), 6) AS mean "
        "FROM premisa_results GROUP BY variant"
    )


@query(
    "s11_table_read_back",
    f"SELECT {G}, " + sql_rounded("p_h accuracy_pos_prem") + " FROM aggr",
    "aggr",
)
def s11(spark, sf):
    stats = metrics.probability_means(errors(spark, sf))
    return io.register(stats, "premisa_aggr_stats").select(
        *GROUP, r6("p_h"), r6("accuracy_pos_prem")
    )
