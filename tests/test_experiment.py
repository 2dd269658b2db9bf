"""The experiments from end to end on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from premisa.plans import experiment
from premisa.sources.catalog import VARIANTS

N, D = 60, 4


@pytest.fixture(scope="module")
def states(spark):
    """The true side lies along one direction; a negated premise turns it round."""
    rng = np.random.default_rng(3)
    direction = np.array([0.6, -0.8, 0.0, 0.0])
    rows = []
    for i in range(N):
        y = int(rng.integers(2))
        for variant in VARIANTS:
            strength = {"original_pos_prem": 2.0, "original_neg_prem": 0.4}.get(variant, 1.0)
            for side in (0, 1):
                sign = 1.0 if side == y else -1.0
                vec = sign * strength * direction + rng.normal(0, 0.2, D)
                rows.append(("ds", "m", variant, 1, i, side, y, vec.tolist()))
    return spark.createDataFrame(
        rows, "dataset string, model string, variant string, layer int, sample_id long, side int, "
        "y int, vec array<double>"
    ).cache()


QUOTAS = {v: (5, v != "original_neg_prem") for v in VARIANTS}
FITS = {
    "supervised": {"mass_mean": {}},
    "unsupervised": {"unsupervised_mass_mean": {}},
    "quotas": QUOTAS,
}


def test_error_experiment(spark, states):
    logits = states.select(
        "dataset", "model", "variant", "sample_id", "side", "y",
        F.when(F.col("side") == F.col("y"), 1.0).otherwise(-1.0).alias("logit"),
    ).withColumn("logit", F.col("logit") + F.col("sample_id") / 1000)
    out = experiment.error_experiment(states, logits, **FITS)
    probes = out["probes"].collect()
    assert len(probes) == 2 + 8  # supervised on two sets; unsupervised on seven and the mix
    groups = {(r["method"], r["subgroup"]) for r in out["aggr_stats"].collect()}
    assert groups == {
        ("mass_mean", "pos-prem"), ("mass_mean", "no-prem"),
        ("unsupervised_mass_mean", "pos-prem"), ("unsupervised_mass_mean", "no-prem"),
        ("unsupervised_mass_mean", "combined"), ("unsupervised_mass_mean", "same"),
        ("lm_head", "pos-prem"), ("lm_head", "no-prem"), ("lm_head", "same"),
    }
    by = {(r["method"], r["subgroup"]): r for r in out["aggr_stats"].collect()}
    assert by[("mass_mean", "no-prem")]["accuracy_pos_prem"] > 0.95
    assert by[("mass_mean", "no-prem")]["samples"] == N // 2
    counts = out["predictions"].groupBy("method", "train_variant").count().collect()
    runs = {(r["method"], r["train_variant"]): r["count"] // (N // 2) for r in counts}
    assert runs[("mass_mean", "no_prem")] == 7 and runs[("unsupervised_mass_mean", "combined")] == 7
    assert runs[("unsupervised_mass_mean", "shuffle_pos_prem")] == 1
    assert {r["criterion"] for r in out["final"].collect()} == {"accuracy", "avg_rank"}


def test_intervention_lowers_belief_in_true_statements(spark, states):
    """Only the true sides of true statements are steered, so their two sides move together."""
    flagged = states.withColumn("is_answer", (F.col("y") == 1) & (F.col("side") == 1)).withColumn(
        "is_period", F.lit(False)
    )
    out = experiment.intervention_experiment(flagged, "mass_mean", sign=-1)
    row = out["effects"].first()
    assert row["mean_difference_1"] < 0
    assert out["results"].count() == 2 * (N // 2)


def test_one_layer_steers_all(spark, states):
    two = states.unionByName(states.withColumn("layer", F.lit(2)))
    flagged = two.withColumn("is_answer", F.lit(True)).withColumn("is_period", F.lit(False))
    out = experiment.intervention_experiment(flagged, "mass_mean", probe_layer=2)
    assert {r["layer"] for r in out["effects"].collect()} == {1, 2}


def test_direction_experiment(spark, states):
    probes = experiment.fit_all(experiment.prepared(states), **FITS)
    views = experiment.direction_experiment(probes)
    methods = views["methods"].collect()
    assert {r["data_variant"] for r in methods} == {"original_pos_prem", "no_prem"}
    assert all(r["similarity"] > 0.9 for r in methods)  # the sign makes them point the same way
