"""Scoring probes on states, and their calibration."""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premisa.functions.exprs import (
    INF,
    NORM_FLOOR,
    above_half,
    dot,
    logit,
    norm,
    pair_probability,
    safe_div,
    sigmoid,
)
from premisa.operators.ranking import order_statistics
from premisa.operators.vectors import mean_difference, sides
from premisa.sources.staging import BROADCAST_BYTES, attach, bytes_column, settle, table_bytes

PLACE = ["dataset", "model", "layer"]
NAMES = ["train_variant", "method", "seed"]
PROBE = [*PLACE, *NAMES]
BLOCK_ROWS = 4096  # pairs of a place that are scored together
TO_ALL = ["original_pos_prem", "no_prem", "combined"]  # training sets scored on every variant


def eligible():
    """A probe is scored on every variant if its training set is one of ``TO_ALL``, else on its own."""
    return F.col("train_variant").isin(TO_ALL) | (F.col("train_variant") == F.col("variant"))


def pair_scores(
    pairs: DataFrame,
    probes: DataFrame,
    any_variant: bool = False,
    limit: int = BROADCAST_BYTES,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Probability of every probe for every sample of the same dataset, model and layer.

    ``pairs`` holds both vectors of a sample in one row, so a score is row-local. ``probes`` is a
    staged table. Its directions are sent to the tasks as one matrix per dataset, model and layer,
    and a batch of rows is scored by two matrix products; the vectors are neither shuffled nor
    repeated per probe. Directions beyond ``limit`` bytes are not sent: the rows of a place are dealt into
    blocks of about ``block``, and its directions meet each block. So the vectors are read once, whatever
    the number of probes, and a task holds a block and at most ``limit`` bytes of directions.
    """
    slim = probes.filter("direction is not null").select(
        *PROBE, "direction", F.greatest(norm("direction"), F.lit(NORM_FLOOR)).alias("_norm")
    )
    kept = [c for c in pairs.columns if c not in ("x0", "x1")]
    schema = T.StructType(
        [pairs.schema[c] for c in kept]
        + [slim.schema[k] for k in NAMES]
        + [T.StructField("p", T.DoubleType())]
    )
    if table_bytes(slim) <= limit:
        return _scores_by_matrix(pairs, slim, kept, schema, any_variant)
    return _scores_by_block(pairs, slim, kept, schema, any_variant, limit, block)


def _scored(
    rows: pa.RecordBatch | pa.Table,
    theta: np.ndarray,
    names: dict[str, pa.Array],
    kept: list[str],
    any_variant: bool,
) -> list[pa.Array]:
    """Columns of the result for rows of one place and the unit directions of that place."""

    def probability(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-x))

    x0, x1 = (matrix_of(rows.column(c)) for c in ("x0", "x1"))
    p = (probability(x1 @ theta.T) + (1.0 - probability(x0 @ theta.T))) / 2.0
    variant = np.array(rows.column("variant").to_pylist(), object)[:, None]
    trained = np.array(names["train_variant"].to_pylist(), object)[None, :]
    scored = np.isin(trained.astype(str), TO_ALL) | (trained == variant) | any_variant
    row, probe = (pa.array(i) for i in np.nonzero(scored))
    columns = [rows.column(c).take(row) for c in kept]
    columns += [names[k].take(probe) for k in NAMES]
    return [*columns, pa.array(p[scored])]


def _scores_by_matrix(
    pairs: DataFrame, slim: DataFrame, kept: list[str], schema: T.StructType, any_variant: bool
) -> DataFrame:
    spark = pairs.sparkSession
    found: dict[tuple, list] = {}
    for r in slim.collect():
        found.setdefault(tuple(r[k] for k in PLACE), []).append(r)
    kinds = {f.name: f.type for f in to_arrow_schema(slim.schema)}
    matrices = spark.sparkContext.broadcast(
        {
            place: (
                np.array([r["direction"] for r in rows]) / np.array([[r["_norm"]] for r in rows]),
                {k: pa.array([r[k] for r in rows], kinds[k]) for k in NAMES},
            )
            for place, rows in found.items()
        }
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pd.DataFrame({k: batch.column(k).to_pylist() for k in PLACE})
            for place, index in places.groupby(PLACE, sort=False).indices.items():
                if place in matrices.value:
                    rows = batch.take(pa.array(index))
                    columns = _scored(rows, *matrices.value[place], kept, any_variant)
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return pairs.select(*kept, "x0", "x1").mapInArrow(score, schema)


def _scores_by_block(
    pairs: DataFrame,
    slim: DataFrame,
    kept: list[str],
    schema: T.StructType,
    any_variant: bool,
    limit: int,
    block: int,
) -> DataFrame:
    """Blocks of a place's rows meet lots of its directions, each of at most ``limit`` bytes."""
    own = pairs.groupBy(*PLACE).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    size = F.ceil(bytes_column(slim) / max(limit, 1))
    lots = slim.groupBy(*PLACE).agg(F.least(size, F.count("*")).cast("int").alias("_lots"))
    places = settle(own.join(lots, PLACE), "places")

    def dealt(df: DataFrame, name: str, count: str, by: list[str], other: str, copies: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*by), F.col(count)).cast("int").alias(name)
        copy = F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(other)
        return attach(df, places, PLACE, by).select(*df.columns, place, copy)

    rows = dealt(pairs, "_block", "_blocks", ["variant", "sample_id"], "_lot", "_lots")
    probes = dealt(slim, "_lot", "_lots", [*NAMES], "_block", "_blocks")
    arrow = to_arrow_schema(schema)

    def score(rows: pa.Table, probes: pa.Table) -> pa.Table:
        if not (len(rows) and len(probes)):
            return arrow.empty_table()
        theta = matrix_of(probes.column("direction")) / probes.column("_norm").to_numpy()[:, None]
        names = {k: probes.column(k) for k in NAMES}
        return pa.table(_scored(rows, theta, names, kept, any_variant), schema=arrow)

    by = [*PLACE, "_block", "_lot"]
    columns = list(dict.fromkeys([*kept, *PLACE]))
    return (
        rows.select(*columns, "x0", "x1", "_block", "_lot")
        .groupBy(*by)
        .cogroup(probes.select(*PROBE, "direction", "_norm", "_block", "_lot").groupBy(*by))
        .applyInArrow(score, schema)
    )


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as one matrix; all must have the same width."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    width = len(column[0]) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size != width * len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), width)


def accuracy(p: str = "p", y: str = "y"):
    hit = (above_half(p) == (F.col(y) == 1)).cast("double")
    return F.avg(F.when(F.col(y).isNotNull(), hit))


def logit_scale(scores: DataFrame, keys: list[str] = PROBE, scale: float = 1.0) -> DataFrame:
    """Factor that brings one standard deviation of the logits to a probability of 0.75."""
    std = F.stddev_samp(logit("p"))
    return scores.groupBy(*keys).agg(
        safe_div(F.lit(float(scale)) * logit(F.lit(0.75)), std).alias("scale")
    )


def sign_by_accuracy(scores: DataFrame, keys: list[str] = PROBE) -> DataFrame:
    """-1 for a probe that is right on less than half of its training data."""
    return scores.groupBy(*keys).agg(
        F.when(accuracy() < 0.5, -1).otherwise(1).alias("sign_by_accuracy")
    )


def calibration_params(
    probes: DataFrame, train: DataFrame, calibration: DataFrame, keys: list[str] = PROBE
) -> DataFrame:
    """Add ``length``, ``sign`` and ``scale`` to the probes.

    Length and sign come from the mean difference of the probe's own training set; the scale from
    the spread of its logits on the calibration set (the same dataset without premises). A zero
    dot product has no sign and is an error.
    """
    by = [*PLACE, "train_variant"]
    difference = mean_difference(train, by).withColumnRenamed("direction", "_mm")
    scales = logit_scale(pair_scores(sides(calibration), probes, any_variant=True))
    agree = F.signum(dot("_mm", "direction"))
    sign = F.when(agree != 0, agree.cast("int")).otherwise(
        F.raise_error(F.lit("direction is orthogonal to the mean difference")).cast("int")
    )
    return (
        probes.join(difference, by, "left")
        .join(scales, keys, "left")
        .withColumn("sign", sign)
        .drop("_mm")
    )


def calibrate(scores: DataFrame) -> DataFrame:
    """Flip by the probe's sign and stretch by its scale where that is finite."""
    finite = F.col("scale").isNotNull() & ~F.isnan("scale") & (F.abs("scale") < INF)
    factor = F.when(finite, F.col("scale")).otherwise(F.lit(1.0))
    prediction = sigmoid(F.col("sign") * logit("p") * factor)
    valid = F.assert_true(~F.isnan("p"), F.lit("a probe gave a NaN probability"))
    return scores.filter(valid.isNull()).withColumn("prediction", prediction)


def evaluate(states: DataFrame, probes: DataFrame) -> DataFrame:
    """Calibrated predictions of all probes on the eval split of all eligible variants."""
    scores = pair_scores(sides(states.filter("split = 'eval'")).drop("split"), probes)
    factors = probes.select(*PROBE, "sign", "scale")
    return calibrate(attach(scores, settle(factors, "calibration"), PROBE, ["sample_id"]))


def logit_baseline(logits: DataFrame, keys: list[str], with_calibration: bool) -> DataFrame:
    """Predictions straight from the answer logits, scaled into [0, 1] by the largest difference.

    Calibrated, the median of neg - pos is first taken off the negative side.
    """
    by = [*keys, "sample_id", "y"]
    pairs = logits.groupBy(*by).agg(
        F.max(F.when(F.col("side") == 0, F.col("logit"))).alias("neg"),
        F.max(F.when(F.col("side") == 1, F.col("logit"))).alias("pos"),
    )
    if with_calibration:
        gaps = pairs.withColumn("_gap", F.col("neg") - F.col("pos"))
        middle = order_statistics(gaps, keys, "_gap", {"median": 0.5}).select(*keys, "median")
        pairs = attach(pairs, settle(middle, "gap-medians"), keys, ["sample_id"])
        pairs = pairs.withColumn("neg", F.col("neg") - F.col("median")).drop("median")
    pairs = pairs.withColumn("_d", F.col("pos") - F.col("neg"))
    extent = pairs.groupBy(*keys).agg(F.greatest(-F.min("_d"), F.max("_d")).alias("_f"))
    scaled_pairs = attach(pairs, settle(extent, "gap-extents"), keys, ["sample_id"])
    p = F.lit(0.5) + safe_div(F.lit(0.5) * F.col("_d"), "_f")
    return scaled_pairs.withColumn("p", p).drop("_d", "_f")


def evaluate_logit_baseline(logits: DataFrame, with_calibration: bool = True) -> DataFrame:
    """Calibrated predictions of the logit baseline on the eval split of all eligible variants.

    ``logits`` carries ``variant`` and ``split``. Without a direction the sign comes from the
    accuracy on the training set; the scale from the no-premise training logits.
    """
    run = ["dataset", "model"]
    by = [*run, "variant", "split"]
    scores = settle(logit_baseline(logits, by, with_calibration), "baseline")
    trained = scores.filter("split = 'train'")
    signs = sign_by_accuracy(trained, [*run, "variant"]).select(
        *run, F.col("variant").alias("train_variant"), F.col("sign_by_accuracy").alias("sign")
    )
    params = signs.join(logit_scale(trained.filter("variant = 'no_prem'"), run), run)
    evaluated = scores.filter("split = 'eval'").drop("split", "neg", "pos")
    joined = attach(evaluated, settle(params, "baseline-params"), run, ["sample_id"])
    return calibrate(joined.filter(eligible()))
