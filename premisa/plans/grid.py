"""The grid of probes to fit and evaluations to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premisa.operators.score import TO_ALL, eligible
from premisa.sources.catalog import VARIANTS

# Unsupervised methods are fitted on every variant and on the combined set,
# supervised ones on these two.
UNSUPERVISED = ["lm_head_baseline", "ccr"]
SUPERVISED = ["logistic_baseline", "massmean-iid=false"]
SUPERVISED_ON = ["original_pos_prem", "no_prem"]


def probe_grid(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Every probe to fit: ``dataset, model, layer, train_variant, method``.

    ``models`` (a catalogue of a few rows) is folded into one array that is exploded per dataset.
    """
    catalogue = [(r["model"], r["layers"]) for r in models.collect()]
    model = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(n).alias("_layers")) for m, n in catalogue]
    )
    methods = F.array(
        *[
            F.struct(F.lit(t).alias("train_variant"), F.lit(m).alias("method"))
            for m in [*UNSUPERVISED, *SUPERVISED]
            for t in (SUPERVISED_ON if m in SUPERVISED else [*VARIANTS, "combined"])
        ]
    )
    return (
        datasets.select("*", F.inline(model))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_layers"))).alias("layer"))
        .drop("_layers")
        .select("*", F.inline(methods))
    )


def run_grid(datasets: DataFrame, models: DataFrame) -> DataFrame:
    """Every evaluation: a probe on all variants if its training set allows, else on its own."""
    probes = probe_grid(datasets, models)
    on = F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("variant")
    return probes.select("*", on).filter(eligible())


def eval_name(
    dataset: str = "dataset", train: str = "train_variant", variant: str = "variant"
):
    """Name of an evaluation run."""
    on_all = F.col(train).isin(TO_ALL)
    middle = F.when(
        on_all, F.concat(F.lit("eval@"), F.col(dataset), F.lit("-"), F.col(variant))
    ).otherwise("eval")
    return F.concat_ws(
        "|",
        F.concat(F.col(dataset), F.lit("-"), F.col(train)),
        F.col("model"),
        F.concat(F.lit("layer"), F.col("layer").cast("string")),
        middle,
        F.col("method"),
    )
