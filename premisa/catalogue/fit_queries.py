"""Queries that fit probes iteratively.

A direction found by iteration has no closed form in SQL. Each query therefore states what holds for
a right result only, as recomputed from the data with DataFrame functions: the optimality conditions,
the loss of the returned direction against the reported one and against that of the start, or the
lowest of several trials. Where planted data give the exact result, DuckDB computes it. The composed
runs use the mean difference, so the whole chain is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premisa.catalogue.analysis_queries import X20_SQL
from premisa.catalogue.metric_queries import BEFORE_AFTER, BEST, CAUSAL, G, GROUP, STATS
from premisa.catalogue.registry import long_vector, query, r6
from premisa.catalogue.vector_queries import RUN, centred
from premisa.functions.exprs import dot, minus, norm, scaled, sigmoid
from premisa.operators import fit, vectors
from premisa.operators.vectors import combine, gram
from premisa.plans import compare, experiment
from premisa.sources import fixtures as fx
from premisa.sources.catalog import COMBINE_QUOTAS
from premisa.sources.staging import attach, settle

WIDTH = 16
SHOWN = "layer, train_variant"


def _train_states(spark, sf):
    return centred(spark, sf).filter("split = 'train'")


def _joined(states: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs of vectors next to the direction fitted on them."""
    directions = probes.withColumnRenamed("train_variant", "variant")
    directions = settle(directions.select(*RUN, "seed", "direction", "train_loss"), "fitted")
    return attach(vectors.sides(states), directions, RUN, ["sample_id"])


def _literal(vector: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


# --- optimality ----------------------------------------------------------------------------


@query(
    "m2_mass_mean_iid",
    "SELECT layer, train_variant, i, round(d, 5) AS value FROM mm",
    "mm",
)
def m2(spark, sf):
    """The covariance times the tilted direction gives the mean difference back."""
    states = _train_states(spark, sf)
    probes = settle(fit.train(states, "mass_mean_iid", RUN), "tilted")
    directions = probes.withColumnRenamed("train_variant", "variant").select(*RUN, "direction")
    rows = attach(vectors.class_covariance(states, RUN), settle(directions, "tilted"), RUN, ["i"])
    return rows.select(
        "layer",
        F.col("variant").alias("train_variant"),
        "i",
        F.round(dot("row", "direction"), 5).alias("value"),
    )


@query(
    "m3_logistic",
    f"""SELECT {SHOWN}, i, 0e0 AS gradient, true AS better_than_start FROM mm""",
    "mm",
)
def m3(spark, sf):
    """The gradient of the penalised, class-balanced loss is zero in every coordinate."""
    states = _train_states(spark, sf)
    rows = _joined(states, fit.train(states, "lr_sklearn", RUN)).filter("y is not null")
    x = minus("x0", "x1")
    z = dot("_x", "direction")
    per_class = rows.groupBy(*RUN, "y").agg(F.count("*").alias("_n"))
    sizes = per_class.groupBy(*RUN).agg(F.sum("_n").alias("_all"))
    weights = settle(
        per_class.join(sizes, RUN).select(
            *RUN, "y", (F.col("_all") / (2 * F.col("_n"))).alias("_weight")
        ),
        "weights",
    )
    rows = attach(rows.withColumn("_x", x), weights, [*RUN, "y"], ["sample_id"])
    rows = rows.withColumn("_z", z)
    own = F.col("_weight") * (F.log1p(F.exp("_z")) - F.col("y") * F.col("_z"))
    losses = rows.groupBy(*RUN).agg(
        (F.sum(own) + F.first(dot("direction", "direction")) / 2).alias("_l"),
        (F.sum("_weight") * float(np.log(2.0))).alias("_start"),
    )
    push = F.col("_weight") * (sigmoid("_z") - F.col("y"))
    cells = rows.select(*RUN, "direction", push.alias("_p"), F.posexplode("_x").alias("i", "_v"))
    sums = cells.groupBy(*RUN, "i").agg(
        (F.sum(F.col("_p") * F.col("_v")) + F.first(F.get("direction", "i"))).alias("_g")
    )
    found = sums.join(losses, RUN)
    return found.select(
        "layer",
        F.col("variant").alias("train_variant"),
        "i",
        (F.round("_g", 4) + 0.0).alias("gradient"),
        (F.col("_l") <= F.col("_start")).alias("better_than_start"),
    )


# --- losses --------------------------------------------------------------------------------


def _descent_loss(w: str | Column) -> Column:
    z = dot(minus("x0", "x1"), w)
    return F.log1p(F.exp(z)) - F.col("y") * z


def _consistency_loss(w: str | Column, kind: str = "min_sq") -> Column:
    p0, p1 = sigmoid(dot("x0", w)), sigmoid(dot("x1", w))
    if kind == "min_sq":
        low = F.least(p0, p1)
        informative = low * low
    else:
        informative = -p0 * F.ln(p0) - p1 * F.ln(p1)
    return informative + (p0 + p1 - 1) * (p0 + p1 - 1)


def _reflection_loss(w: str | Column) -> Column:
    d, length = minus("x1", "x0"), norm(w)
    square = dot(d, d) + 4 * (dot("x0", w) / length) * (dot("x1", w) / length)
    return F.sqrt(F.greatest(square, F.lit(0.0)))


_LOSS_SQL = f"""SELECT DISTINCT {SHOWN}, 16 AS width, true AS loss_as_reported,
  true AS better_than_start FROM mm"""


def _loss_facts(states: DataFrame, probes: DataFrame, method, loss) -> DataFrame:
    """Per group: is the reported loss that of the direction, and is it below that at the start?"""
    rows = _joined(states, probes)
    start = _literal(method.start(WIDTH, np.zeros(WIDTH), 1)["w"][0])
    sums = rows.groupBy(*RUN).agg(
        F.avg(loss("direction")).alias("_loss"),
        F.avg(loss(start)).alias("_start"),
        F.first("train_loss").alias("_told"),
        F.first(F.size("direction")).alias("width"),
    )
    return sums.select(
        "layer",
        F.col("variant").alias("train_variant"),
        "width",
        (F.abs(F.col("_told") - F.col("_loss")) <= 1e-3 * (1 + F.col("_loss"))).alias(
            "loss_as_reported"
        ),
        (F.col("_loss") <= F.col("_start")).alias("better_than_start"),
    )


def _loss_query(name: str, method: str, loss, **params) -> None:
    @query(name, _LOSS_SQL, "mm")
    def run(spark, sf):
        states = _train_states(spark, sf)
        probes = fit.train(states, method, RUN, **params)
        return _loss_facts(states, probes, fit.METHODS[method](**params), loss)


_loss_query("m4_logistic_descent", "lr_gd", _descent_loss)
_loss_query("m5_contrast_consistency", "ccs_gd", _consistency_loss)
_loss_query(
    "m5_contrast_consistency_entropy",
    "ccs_gd",
    lambda w: _consistency_loss(w, "entropy"),
    informative_loss="entropy",
)
_loss_query("m7_reflection", "ccr", _reflection_loss)


@query(
    "m7_reflection_on_combined",
    """SELECT DISTINCT layer, 'combined' AS train_variant, 16 AS width, true AS loss_as_reported,
  true AS better_than_start FROM mm""",
    "mm",
)
def m7_combined(spark, sf):
    """The unsupervised fit on the mixed training set."""
    mixed = combine(centred(spark, sf), COMBINE_QUOTAS)
    ids = F.concat_ws("-", "variant", F.col("sample_id").cast("string"))
    one = mixed.withColumn("sample_id", ids).withColumn("variant", F.lit("combined"))
    one = settle(one, "combined")
    return _loss_facts(one, fit.train(one, "ccr", RUN), fit.Reflection(), _reflection_loss)


# --- trials --------------------------------------------------------------------------------


def _trials(spark, sf, seeds: tuple[int, ...]) -> DataFrame:
    """Per group: the trials, and whether the chosen one has the lowest loss and then seed."""
    states = _train_states(spark, sf)
    trials = settle(fit.fit(states, RUN, "ccs_gd", seeds=seeds), "trials")
    chosen = fit.select_best(trials, RUN)
    best = trials.groupBy(*RUN).agg(
        F.count("*").alias("trials"),
        F.count_distinct("direction").alias("different"),
        F.min(F.struct("train_loss", "seed")).alias("_best"),
    )
    both = best.join(chosen, RUN)
    return both.select(
        "layer",
        F.col("variant").alias("train_variant"),
        "trials",
        "different",
        (F.struct("train_loss", "seed") == F.col("_best")).alias("chosen_is_lowest"),
    )


def _trials_sql(n: int) -> str:
    return (
        f"SELECT DISTINCT {SHOWN}, {n} AS trials, {n} AS different, true AS chosen_is_lowest FROM mm"
    )


@query("m6_best_of_ten_seeds", _trials_sql(10), "mm")
def m6(spark, sf):
    return _trials(spark, sf, tuple(range(10)))


@query("k5_lowest_loss", _trials_sql(5), "mm")
def k5(spark, sf):
    return _trials(spark, sf, (0, 1, 2, 3, 4))


# --- planted data --------------------------------------------------------------------------

_TURN = "CASE WHEN sample_id % 3 = 0 THEN -1 ELSE 1 END"


@query(
    "m8_two_clusters",
    f"""SELECT layer, variant AS train_variant, i, round(value, 6) AS value FROM (
  SELECT layer, variant, i, (avg(d) FILTER (turn = 1) - avg(d) FILTER (turn = -1)) / 2 AS value
  FROM (SELECT layer, variant, sample_id, i, {_TURN} AS turn,
          max(x) FILTER (side = 1) - max(x) FILTER (side = 0)
          + CASE WHEN i = 0 THEN 40e0 * ({_TURN}) ELSE 0e0 END AS d
        FROM sp WHERE split = 'train' GROUP BY layer, variant, sample_id, i)
  GROUP BY layer, variant, i)""",
    "sp",
)
def m8(spark, sf):
    """Two clusters, planted far apart along the first coordinate, so the exact halves are known.

    The direction is turned so that its first coordinate is positive.
    """
    states = vectors.half_split(fx.states(spark, sf)).filter("split = 'train'")
    turn = F.when(F.col("sample_id") % 3 == 0, -1.0).otherwise(1.0)
    moved = F.transform("vec", lambda x, i: F.when(i == 0, x + 40.0 * turn).otherwise(x))
    planted = states.withColumn("vec", F.when(F.col("side") == 1, moved).otherwise(F.col("vec")))
    probes = fit.train(settle(planted, "planted"), "unsupervised_mass_mean", RUN)
    up = F.signum(F.get("direction", F.lit(0)))
    found = probes.select("layer", "train_variant", scaled("direction", up).alias("direction"))
    return long_vector(found, ["layer", "train_variant"], "direction")


@query(
    "m10_linear_consistency",
    f"SELECT DISTINCT {SHOWN}, 16 AS width, true AS feasible, true AS optimal FROM mm",
    "mm",
)
def m10(spark, sf):
    """The coefficients are at least one, and the objective falls in none of the allowed moves.

    The objective is built anew here, from sums of products of the rows and their eigenvectors.
    """
    states = _train_states(spark, sf)
    pairs = vectors.sides(states).withColumn("_d", minus("x1", "x0"))
    probes = fit.train(states, "ccs_linear", RUN).withColumnRenamed("train_variant", "variant")
    products = gram(pairs, RUN, "_d", "x0").withColumnRenamed("row", "r0").join(
        gram(pairs, RUN, "_d", "x1").select(*RUN, "i", F.col("row").alias("r1")), [*RUN, "i"]
    )
    rows = attach(products, settle(probes.select(*RUN, "direction"), "linear"), RUN, ["i"])
    schema = T.StructType(
        [rows.schema[k] for k in RUN]
        + [T.StructField("width", T.IntegerType())]
        + [T.StructField(n, T.BooleanType()) for n in ("feasible", "optimal")]
    )

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        m0, m1 = (np.stack(group[c].to_list()) for c in ("r0", "r1"))
        square = m1 - m0  # the products of x1 - x0 with itself
        values, v = np.linalg.eigh((square + square.T) / 2)
        v = v[:, values > values.max() * (len(values) * np.finfo(np.float32).eps) ** 2]
        one, other = ((v.T @ m @ v) / np.sqrt((v.T @ square @ v).diagonal())[:, None] for m in (m1, m0))
        lengths = np.sqrt((one**2).sum(1)) + np.sqrt((other**2).sum(1))
        angle = (one * other).sum(1) / (np.sqrt((one**2).sum(1)) * np.sqrt((other**2).sum(1)))
        form = (one + other) * (lengths ** (-5.0 * angle))[:, None]
        h = form.T @ form
        direction = np.asarray(group["direction"].iloc[0])
        z = direction @ v
        turn = np.sign(z)  # a basis vector may come out turned round
        slope = turn * (h @ z)
        scale = max(1.0, np.abs(h).max() * np.abs(z).max())
        inner = np.abs(z) > 1 + 1e-6
        out = group[RUN].head(1).copy()
        out["width"] = np.int32(len(direction))
        out["feasible"] = bool((np.abs(z) >= 1 - 1e-6).all())
        out["optimal"] = bool((slope >= -1e-5 * scale).all() and (slope[inner] <= 1e-5 * scale).all())
        return out

    found = rows.groupBy(*RUN).applyInPandas(judge, schema)
    return found.select("layer", F.col("variant").alias("train_variant"), "width", "feasible", "optimal")


# --- composed runs -------------------------------------------------------------------------

_MEAN_ONLY = {"supervised": {"mass_mean": {}}, "unsupervised": {}}
_ON = "('original_pos_prem', 'no_prem')"
_TAGGED = {
    "tagged": (
        "lgs scales",
        f"""SELECT 'emb' AS dataset, 'm1' AS model, layer, 'mass_mean' AS method,
  CASE train_variant WHEN 'no_prem' THEN 'no-prem' ELSE 'pos-prem' END AS subgroup, variant,
  sample_id, CAST(y AS INT) AS label, 1e0 / (1e0 + exp(-(lg * scale))) AS prediction
FROM lgs JOIN scales USING (layer, train_variant)
WHERE split = 'eval' AND train_variant IN {_ON}""",
    )
}


def _r4(names: str, keys: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({c}, 4) AS {c}" for c in names.split())


def _rounded(df: DataFrame, keys: list[str], names: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in names.split()])


# means of ratios near a pole are left to the queries on rational input
_STEADY = " ".join(c for c in STATS.split() if not c.startswith("mean_error") or c == "mean_error_sv")
_FINAL_KEYS = "criterion, dataset, model, method, subgroup, layer"


def _experiment(spark, sf):
    return experiment.error_experiment(fx.states(spark, sf), **_MEAN_ONLY)


@query(
    "x13_experiment_errors", _r4(_STEADY, G) + " FROM stats", "stats", _TAGGED
)
def x13_experiment(spark, sf):
    """States in, error scores out: split, centre, fit, calibrate, score, measure."""
    return _rounded(_experiment(spark, sf)["aggr_stats"], GROUP, _STEADY)


@query(
    "x14_experiment_final_table", _r4(BEST, _FINAL_KEYS) + " FROM best", "best", _TAGGED
)
def x14_experiment(spark, sf):
    return _rounded(_experiment(spark, sf)["final"], _FINAL_KEYS.split(", "), BEST)


_MOVED = {
    "moved": (
        "sp mm",
        """SELECT sp.* REPLACE (x - CASE WHEN y = 1 OR side = 1 THEN d ELSE 0e0 END AS x)
FROM sp JOIN mm USING (layer, i) WHERE train_variant = 'original_pos_prem'""",
    ),
    "moved_cen": (
        "moved",
        """SELECT * REPLACE (x - avg(x) FILTER (isfinite(x)) OVER
  (PARTITION BY variant, layer, split, side, i) AS x) FROM moved""",
    ),
    "caus": (
        "moved_cen cen mm mm_len scales",
        """SELECT 'emb' AS dataset, 'm1' AS model, layer, 'mass_mean' AS method, setting, sample_id,
  CAST(y AS INT) AS label, 1e0 / (1e0 + exp(-(ln(q / (1 - q)) * scale))) AS prediction
FROM (SELECT layer, setting, sample_id, y, least(greatest(
        (1e0 / (1e0 + exp(-max(z) FILTER (side = 1)))
         + 1e0 - 1e0 / (1e0 + exp(-max(z) FILTER (side = 0)))) / 2e0, 1e-6), 1 - 1e-6) AS q
      FROM (SELECT c.layer, setting, sample_id, y, side, sum(x * d) / greatest(any_value(length),
              1e-12) AS z
            FROM (SELECT layer, sample_id, y, side, i, x, 'original' AS setting FROM cen
                  WHERE split = 'eval' AND variant = 'original_pos_prem'
                  UNION ALL SELECT layer, sample_id, y, side, i, x, 'intervened' FROM moved_cen
                  WHERE split = 'eval' AND variant = 'original_pos_prem') c
            JOIN mm USING (layer, i) JOIN mm_len USING (train_variant, layer)
            WHERE train_variant = 'original_pos_prem' GROUP BY ALL)
      GROUP BY ALL)
JOIN scales USING (layer) WHERE train_variant = 'original_pos_prem'""",
    ),
}


@query(
    "x19_experiment_intervention",
    "SELECT dataset, model, layer, method, "
    + ", ".join(
        f"round({f}({x}) FILTER (label = {label}), 6) AS {name}"
        for name in BEFORE_AFTER.split()
        for f, column, label in [name.replace("mean", "avg").rsplit("_", 2)]
        for x in ["intervened - original" if column == "difference" else column]
    )
    + """ FROM (SELECT dataset, model, layer, method, sample_id, label,
  max(prediction) FILTER (setting = 'original') AS original,
  max(prediction) FILTER (setting = 'intervened') AS intervened FROM caus GROUP BY ALL)
GROUP BY ALL""",
    "caus",
    _MOVED,
)
def x19_experiment(spark, sf):
    """The answers of true statements are steered against the mean difference."""
    flagged = fx.states(spark, sf).withColumn("is_answer", F.col("y") == 1).withColumn(
        "is_period", F.col("side") == 1
    )
    effects = experiment.intervention_experiment(flagged, "mass_mean")["effects"]
    return effects.select(*CAUSAL, *[r6(c) for c in BEFORE_AFTER.split()])


@query(
    "x20_experiment_directions",
    X20_SQL,
    "cmp",
    {
        "dirs": (
            "mm",
            f"""SELECT 'm1' AS model, 'emb' AS dataset, train_variant AS data_variant, layer,
  'mass_mean' AS probe_method, 1 AS sign, list(d ORDER BY i) AS direction
FROM mm WHERE train_variant IN {_ON} GROUP BY ALL""",
        )
    },
)
def x20_experiment(spark, sf):
    ready = experiment.prepared(fx.states(spark, sf))
    views = experiment.direction_experiment(experiment.fit_all(ready, **_MEAN_ONLY))
    return compare.all_views(views).withColumn("similarity", F.round("similarity", 6))
