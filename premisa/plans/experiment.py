"""The three experiments from end to end: tables in, tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premisa.operators import fit, score, vectors
from premisa.plans import causal, compare, metrics, rank
from premisa.sources.catalog import COMBINE_QUOTAS
from premisa.sources.staging import settle

SUPERVISED = {"lr_sklearn": {}, "mass_mean": {}}
UNSUPERVISED = {"ccr": {}}
SUPERVISED_ON = ["original_pos_prem", "no_prem"]
LOGIT_BASELINE = "lm_head"


def prepared(states: DataFrame) -> DataFrame:
    """Split and centred states, staged because fitting, calibration and scoring read them.

    Stored by sample from the start: no later step but the gathering of a group for its fit moves a vector.
    """
    stored = vectors.cluster(states)
    return vectors.cluster(vectors.center(vectors.half_split(stored)), "prepared", spread=False)


def combined_set(states: DataFrame, quotas: dict[str, tuple[int, bool]], seed: int = 0) -> DataFrame:
    """The mixed training set as one more training variant; its samples get ids of their own."""
    mixed = vectors.combine(states, quotas, seed)
    own = F.concat_ws("-", "variant", F.col("sample_id").cast("string"))
    return mixed.withColumn("sample_id", own).withColumn("variant", F.lit("combined"))


def fit_all(
    states: DataFrame,
    supervised: dict[str, dict] = SUPERVISED,
    unsupervised: dict[str, dict] = UNSUPERVISED,
    quotas: dict[str, tuple[int, bool]] = COMBINE_QUOTAS,
) -> DataFrame:
    """Calibrated probes: unsupervised methods on every variant and on the mixed set, supervised
    ones on the original premises and without premises. ``states`` come from ``prepared``."""
    train = states.filter("split = 'train'")
    mixed = settle(combined_set(states, quotas), "combined")
    named = train.withColumn("sample_id", F.col("sample_id").cast("string"))
    every = named.unionByName(mixed.select(*named.columns))
    found = [fit.train(every, m, vectors.RUN, **params) for m, params in unsupervised.items()]
    plain = named.filter(F.col("variant").isin(SUPERVISED_ON))
    found += [fit.train(plain, m, vectors.RUN, **params) for m, params in supervised.items()]
    columns = [*score.PROBE, "direction", "train_loss"]
    probes = settle(reduce(DataFrame.unionByName, [p.select(*columns) for p in found]), "probes")
    training = every.withColumnRenamed("variant", "train_variant")
    without = train.filter("variant = 'no_prem'")
    return settle(score.calibration_params(probes, training, without), "calibrated")


def _predictions(scored: DataFrame) -> DataFrame:
    return scored.select(
        "dataset", "model", "layer", "method", "train_variant", "variant", "sample_id",
        F.col("y").alias("label"), "prediction",
    )


def error_experiment(
    states: DataFrame, logits: DataFrame | None = None, **fits
) -> dict[str, DataFrame]:
    """Fit, score on all variants, measure the errors, rank: probes, predictions, aggr_stats, final.

    The logit baseline does not depend on the layer and is listed under layer 1.
    """
    ready = prepared(states)
    probes = fit_all(ready, **fits)
    predictions = _predictions(score.evaluate(ready, probes))
    if logits is not None:
        baseline = score.evaluate_logit_baseline(vectors.half_split(logits))
        named = baseline.withColumn("layer", F.lit(1)).withColumn("method", F.lit(LOGIT_BASELINE))
        predictions = predictions.unionByName(_predictions(named))
    predictions = settle(predictions, "predictions")
    aggr = metrics.error_scores(predictions)
    return {
        "probes": probes,
        "predictions": predictions,
        "aggr_stats": aggr,
        "final": rank.final_table(aggr),
    }


def intervention_experiment(
    states: DataFrame,
    method: str,
    sign: int = -1,
    on_answer: bool = True,
    on_period: bool = True,
    train_variant: str = "original_pos_prem",
    probe_layer: int | None = None,
    **params,
) -> dict[str, DataFrame]:
    """Steer the flagged vectors along fitted directions and compare predictions before and after.

    ``probe_layer`` uses that layer's probe for steering every layer.
    """
    flags = ["is_answer", "is_period"]
    ready = prepared(states.drop(*flags))
    train = ready.filter("split = 'train'")
    own = train.filter(F.col("variant") == train_variant)
    probes = settle(fit.train(own, method, vectors.RUN, **params), "probes")
    training = own.withColumnRenamed("variant", "train_variant")
    without = train.filter("variant = 'no_prem'")
    probes = settle(score.calibration_params(probes, training, without), "calibrated")
    used = probes
    if probe_layer is not None:
        one = probes.filter(F.col("layer") == probe_layer).drop("layer")
        used = settle(one.join(probes.select("dataset", "model", "layer"), ["dataset", "model"]), "one")
    moved = vectors.steer(states, used, sign, on_answer, on_period).drop(*flags)
    before = _predictions(score.evaluate(ready, probes))
    after = _predictions(score.evaluate(prepared(moved), probes))
    results = before.withColumn("setting", F.lit("original")).unionByName(
        after.withColumn("setting", F.lit("intervened"))
    )
    evaluated = results.filter(F.col("variant") == train_variant)
    results = settle(evaluated.drop("variant", "train_variant"), "results")
    return {"probes": probes, "results": results, "effects": causal.before_after(results)}


def direction_experiment(probes: DataFrame) -> dict[str, DataFrame]:
    """Similarity views over the calibrated probes of one or more models and datasets."""
    named = probes.withColumnRenamed("train_variant", "data_variant").withColumnRenamed(
        "method", "probe_method"
    )
    return compare.similarity_report(named)
