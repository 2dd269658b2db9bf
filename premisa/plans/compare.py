"""Cosine similarity between probe directions.

The table of all pairs is never formed: the four views below are its only readers, and each groups the
directions by the keys its pairs share. A direction is unique in (model, dataset, data_variant,
layer, probe_method), so a group is bounded by the number of datasets, layers, methods or
variants, whatever the number of models and runs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premisa.functions.exprs import doubles, norm, scaled
from premisa.operators.score import matrix_of
from premisa.sources.staging import attach, settle

BLOCK = 2048  # directions of a group that meet in one task
DIMENSIONS = ["dataset", "data_variant", "layer", "probe_method"]
KEY = ["model", *DIMENSIONS]


def signed_directions(probes: DataFrame) -> DataFrame:
    """Directions times their sign with their length; probes without one are left out.

    Lengths are computed once per direction, not once per pair. Two directions under one key, or
    of different width within a model, are an error.
    """
    rows = probes.filter("direction is not null").withColumn(
        "direction", scaled(doubles("direction"), F.col("sign").cast("double"))
    )
    single = rows.groupBy(*KEY).agg(F.count("*").alias("_n"), F.first("direction").alias("direction"))
    valid = F.assert_true(F.col("_n") == 1, F.lit("two directions under one key"))
    return (
        single.filter(valid.isNull()).drop("_n").withColumn("length", norm("direction"))
    )


def pairs(
    directions: DataFrame, shared: list[str], condition: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """Pairs of directions of one model that agree on ``shared`` and meet ``condition``.

    The directions of a group meet in one task, and one matrix product gives the similarities of all their
    pairs: no vector is repeated per pair. A group of more than ``block`` directions is dealt into blocks, and
    each two blocks meet. Directions of different width are an error.
    """
    own = [k for k in DIMENSIONS if k not in shared]
    group = ["model", *shared]
    sizes = directions.groupBy(*group).agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= block:
        rows = directions.withColumn("_blocks", F.lit(1))
    else:
        rows = attach(directions, settle(sizes.select(*group, blocks.alias("_blocks")), "groups"), group, own)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*own), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
    names = [f"{k}{i}" for k in own for i in (1, 2)]
    schema = T.StructType([directions.schema[k] for k in group])
    for name in names:
        schema = schema.add(name, directions.schema[name[:-1]].dataType)
    schema = schema.add("similarity", T.DoubleType())
    arrow = to_arrow_schema(schema)

    def products(part: pa.Table) -> pa.Table:
        first, second = part.column("_i")[0].as_py(), part.column("_j")[0].as_py()
        at = part.column("_b").to_numpy()
        x = matrix_of(pa.concat_arrays(part.column("direction").chunks))
        length = part.column("length").to_numpy()
        left, right = np.flatnonzero(at == first), np.flatnonzero(at == second)
        out = []
        for a, b in [(left, right)] if first == second else [(left, right), (right, left)]:
            with np.errstate(divide="ignore", invalid="ignore"):
                found = (x[a] @ x[b].T) / np.outer(length[a], length[b])
            sides = pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a)))
            columns = [part.column(k).take(sides[0]) for k in group]
            columns += [part.column(n[:-1]).take(sides[int(n[-1]) - 1]) for n in names]
            out.append(pa.table([*columns, pa.array(found.ravel())], schema=arrow))
        return pa.concat_tables(out)

    needed = rows.select(*group, *own, "direction", "length", "_b", "_i", "_j")
    found = needed.groupBy(*group, "_i", "_j").applyInArrow(products, schema)
    return found if condition is None else found.filter(condition)


def across_datasets(directions: DataFrame) -> DataFrame:
    """Same variant, layer and method; different datasets."""
    found = pairs(
        directions,
        ["data_variant", "layer", "probe_method"],
        F.col("dataset1") != F.col("dataset2"),
    )
    return found


def across_layers(directions: DataFrame) -> DataFrame:
    """Same dataset, variant and method; every pair of layers."""
    return pairs(directions, ["dataset", "data_variant", "probe_method"])


def across_methods(directions: DataFrame) -> DataFrame:
    """Same dataset, variant and layer; each pair of methods once, with its name."""
    found = pairs(
        directions,
        ["dataset", "data_variant", "layer"],
        F.col("probe_method1") > F.col("probe_method2"),
    )
    return found.withColumn("method_pair", F.concat_ws("-", "probe_method1", "probe_method2"))


def across_variants(directions: DataFrame) -> DataFrame:
    """Same dataset, layer and method; each pair of variants once, with its name."""
    found = pairs(
        directions,
        ["dataset", "layer", "probe_method"],
        F.col("data_variant1") > F.col("data_variant2"),
    )
    return found.withColumn("variant_pair", F.concat_ws("-", "data_variant1", "data_variant2"))


def layer_matrix(layer_pairs: DataFrame, layers: list[int], keys: list[str]) -> DataFrame:
    """Layer x layer matrix of (mean) similarity per ``keys``: one row per second layer."""
    return layer_pairs.groupBy(*keys, "layer2").pivot("layer1", layers).agg(F.avg("similarity"))


def similarity_report(probes: DataFrame) -> dict[str, DataFrame]:
    """The four views over one staged table of signed directions."""
    directions = settle(signed_directions(probes), "directions")
    return {
        "datasets": across_datasets(directions),
        "layers": across_layers(directions),
        "methods": across_methods(directions),
        "variants": across_variants(directions),
    }


def all_views(report: dict[str, DataFrame]) -> DataFrame:
    """All pairs of all views with the view's name and two side labels."""

    def flat(name: str, df: DataFrame) -> DataFrame:
        sides = [
            F.concat_ws(
                "|", *[F.col(f"{k}{i}" if f"{k}{i}" in df.columns else k) for k in DIMENSIONS]
            ).alias(f"side{i}")
            for i in (1, 2)
        ]
        return df.select(F.lit(name).alias("view"), "model", *sides, "similarity")

    return reduce(DataFrame.unionByName, [flat(n, df) for n, df in report.items()])
