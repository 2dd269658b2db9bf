"""Error scores of probes against the effect of a premise (one row per probe and subgroup).

Per sample: h = prediction without premise, o = with the original premise, n = original negated,
r = random letters, s = shuffled premise (r and s asserted or negated), pe = o - h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premisa.functions.exprs import above_half, clip_zero, safe_div
from premisa.operators.ranking import order_statistics
from premisa.sources.catalog import VARIANTS
from premisa.sources.staging import BROADCAST_BYTES, attach, matches, settle, table_bytes

RUN = ["dataset", "model", "layer", "method"]
GROUP = [*RUN, "subgroup"]
AGGREGATES = ["mean", "median", "trim_mean", "p20", "p80"]
RATIO_ERRORS = ["error_1", "error_2", "error_3", "error_4", "error_3_4"]
# error -> its cells; error_1 and error_2 are measured on an asserted and a negated variant
CELLS = {
    "error_1": ["error_1_pos", "error_1_neg"],
    "error_2": ["error_2_pos", "error_2_neg"],
    "error_3": ["error_3"],
    "error_4": ["error_4"],
    "error_3_4": ["error_3_4"],
}
SAME_RUNS = 2
SUBGROUPS = {"combined": "combined", "no_prem": "no-prem", "original_pos_prem": "pos-prem"}


def self_trained(predictions: DataFrame) -> DataFrame:
    """Probes that were scored on more than two of the variants they were trained on."""
    own = predictions.filter(F.col("train_variant") == F.col("variant"))
    runs = own.select(*RUN, "variant").distinct().groupBy(*RUN).agg(F.count("*").alias("_runs"))
    return runs.filter(F.col("_runs") > SAME_RUNS).select(*RUN, F.lit(True).alias("_own"))


def with_subgroups(predictions: DataFrame) -> DataFrame:
    """Tag each prediction with its subgroups: by training set, and ``same`` if trained on itself.

    A probe has a ``same`` subgroup only with more than two runs, i.e. evaluated variants. Counting
    them takes a pass over the predictions' keys; it is done while the plan is built. Only a row scored on
    its own training set has a key to look up, and its subgroups are one of a few constant lists.
    """

    def names(*more: str) -> Column:
        found = F.lit(list(more)).cast("array<string>")
        for train, name in SUBGROUPS.items():
            found = F.when(F.col("train_variant") == train, F.lit([name, *more])).otherwise(found)
        return found

    runs = settle(self_trained(predictions), "self-trained")
    if table_bytes(runs) <= BROADCAST_BYTES:
        probes = runs.select(F.xxhash64(*RUN).alias("_run"), *(F.col(k).alias(f"_{k}") for k in RUN), "_own")
        own = F.when(F.col("train_variant") == F.col("variant"), F.xxhash64(*RUN))
        # one number is the join's key; the columns are compared where it is met
        equal = (F.col(k).eqNullSafe(F.col(f"_{k}")).cast("int") for k in RUN)
        met = (own == F.col("_run")) & (sum(equal, F.lit(0)) == len(RUN))
        flagged = predictions.join(F.broadcast(probes), met, "left")
        same = F.col("_own").isNotNull()
    else:
        flagged = attach(predictions, runs, RUN, ["sample_id"], "left")
        same = F.col("_own").isNotNull() & (F.col("train_variant") == F.col("variant"))
    listed = F.when(same, names("same")).otherwise(names())
    return flagged.select(*predictions.columns, F.explode(listed).alias("subgroup"))


def variant_pivot(predictions: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """One row per group and sample with the seven variants' predictions as columns.

    The variants are a fixed list, so this is one aggregation: one shuffle, spread by sample.
    A variant met twice for a sample is an error.
    """
    columns = [
        F.max(F.when(F.col("variant") == v, F.col("prediction"))).alias(v) for v in VARIANTS
    ]
    met = sum((F.col(v).isNotNull().cast("int") for v in VARIANTS), F.lit(0))
    return (
        predictions.groupBy(*keys, "sample_id", "label")
        .agg(*columns, F.count("prediction").alias("_rows"))
        .filter(F.assert_true(F.col("_rows") == met, F.lit("variant met twice")).isNull())
        .drop("_rows")
    )


def wide_predictions(predictions: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """The pivot, failing on a sample that lacks the prediction of a variant."""
    wide = variant_pivot(predictions, keys)
    missing = F.concat_ws(", ", *[F.when(F.col(v).isNull(), v) for v in VARIANTS])
    text = F.concat(F.lit("variants missing: "), missing)
    return wide.filter(F.assert_true(missing == "", text).isNull())


def premise_effect() -> Column:
    return F.col("original_pos_prem") - F.col("no_prem")


def with_errors(wide: DataFrame) -> DataFrame:
    """Add the premise effect and every error as row-local expressions."""
    h, pe = F.col("no_prem"), F.col("pe")
    n, o = F.col("original_neg_prem"), F.col("original_pos_prem")
    is_true = F.col("label") == 1
    columns = {
        f"{error}_{side}": safe_div(F.abs(F.col(f"{origin}_{side}_prem") - h), F.abs(pe))
        for error, origin in (("error_1", "random"), ("error_2", "shuffle"))
        for side in ("pos", "neg")
    }
    columns["error_3"] = clip_zero(safe_div(n - h, pe))
    columns["error_4"] = safe_div(F.abs(n - o), F.abs(pe))
    columns["error_sv_1"] = F.when(is_true, clip_zero(-pe)).otherwise(F.lit(0.0))
    columns["error_sv_0"] = F.when(~is_true, clip_zero(pe)).otherwise(F.lit(0.0))
    sums = {
        "error_3_4": F.col("error_3") + F.col("error_4"),
        "error_sv": F.col("error_sv_1") + F.col("error_sv_0"),
    }
    return wide.withColumn("pe", premise_effect()).withColumns(columns).withColumns(sums)


def cells_long(errors: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """``(keys, cell, value)``: all error cells of a row by one unpivot, not one scan each."""
    names = [c for cells in CELLS.values() for c in cells]
    return errors.unpivot(keys, names, "cell", "value")


def cell_aggregates(
    errors: DataFrame, keys: list[str] = GROUP, groups: DataFrame | None = None
) -> DataFrame:
    """Exact mean, median, trimmed mean, 20th and 80th percentile of every error cell.

    The rows are read three times, so they are best staged. Groups are numbered while their rows are still
    wide: the cells' values carry one number, unless there are too many groups to send to the tasks.
    ``groups`` is a staged table with one row per group, if the caller has one; else a pass finds them.
    """
    asked = {"median": 0.5, "p20": 0.2, "p80": 0.8}
    names = [c for cells in CELLS.values() for c in cells]
    number = F.monotonically_increasing_id()
    found = errors.select(*keys).distinct() if groups is None else groups.select(*keys)
    groups = settle(found.withColumn("_group", number), "groups")
    if table_bytes(groups) > BROADCAST_BYTES:
        return order_statistics(cells_long(errors, keys), [*keys, "cell"], "value", asked, trim=0.2)
    known = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), "_group")
    met = matches([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys])
    rows = errors.join(F.broadcast(known), met).select("_group", *names)
    values = rows.select("_group", F.posexplode(F.array(*names)).alias("_c", "value"))
    # negative numbers of groups do not occur, so a cell's number is unique
    cells = values.select((F.col("_group") * len(names) + F.col("_c")).alias("_cell"), "value")
    stats = order_statistics(cells, ["_cell"], "value", asked, trim=0.2)
    place = (F.pmod("_cell", F.lit(len(names))) + 1).cast("int")
    cell = F.element_at(F.array(*map(F.lit, names)), place).alias("cell")
    stats = stats.select(F.expr(f"_cell div {len(names)}").alias("_group"), cell, *stats.columns[1:])
    return stats.join(F.broadcast(groups), "_group").select(*keys, *stats.columns[1:])


def error_aggregates(cells: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Average each aggregate over an error's cells, skipping NaN; one column per pair."""
    out = []
    for aggregate in AGGREGATES:
        for error, names in CELLS.items():
            x = F.when(F.col("cell").isin(names) & ~F.isnan(aggregate), F.col(aggregate))
            out.append(F.avg(x).alias(f"{aggregate}_{error}"))
    return cells.groupBy(*keys).agg(*out)


def probability_means(errors: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Mean predictions by label, accuracies, sensitivity and supervised errors per group.

    e = samples whose hypothesis is true, c = the others.
    """
    is_true = F.col("label") == 1

    def mean(column: str, condition: Column) -> Column:
        return F.avg(F.when(condition, F.col(column)))

    def accuracy(column: str) -> Column:
        return F.avg((above_half(column) == is_true).cast("double"))

    sensitivity = F.avg(F.abs("pe"))
    return errors.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        mean("original_pos_prem", is_true).alias("p_h_p_e"),
        mean("original_pos_prem", ~is_true).alias("p_h_p_c"),
        mean("original_neg_prem", is_true).alias("p_h_np_e"),
        mean("original_neg_prem", ~is_true).alias("p_h_np_c"),
        F.avg("no_prem").alias("p_h"),
        accuracy("original_pos_prem").alias("accuracy_pos_prem"),
        accuracy("no_prem").alias("accuracy_no_prem"),
        sensitivity.alias("premise_sensitivity"),
        F.avg("pe").alias("mean_premise_effect"),
        F.avg("error_sv_0").alias("error_sv_0"),
        F.avg("error_sv_1").alias("error_sv_1"),
        F.avg("error_sv").alias("mean_error_sv"),
        safe_div(F.avg("error_sv"), sensitivity).alias("rel_error_sv"),
    )


def staged_errors(tagged: DataFrame) -> DataFrame:
    """The errors of predictions that carry their ``subgroup``, to be read more than once.

    Staged are the pivoted predictions; the errors are worked out from them whenever they are read, as they are
    twice as many numbers and compress worse.
    """
    return with_errors(settle(wide_predictions(tagged).drop("sample_id"), "wide"))


def scores_of(tagged: DataFrame) -> DataFrame:
    """Aggregates, probabilities and metrics of predictions that carry their ``subgroup``.

    The result is staged, as the ranks and the best layers read it several times.
    """
    errors = staged_errors(tagged)
    means = settle(probability_means(errors), "means")
    aggregates = error_aggregates(cell_aggregates(errors, groups=means))
    return settle(attach(means, settle(aggregates, "aggregates"), GROUP, GROUP, "left"), "aggr-stats")


def error_scores(predictions: DataFrame) -> DataFrame:
    """The ``aggr_stats`` table: one row per probe (dataset, model, layer, method) and subgroup."""
    return scores_of(with_subgroups(predictions))
