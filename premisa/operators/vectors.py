"""Operators on the vector table: statistics, splits, centring, mixing, steering, Gram matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premisa.functions.exprs import (
    INF,
    as_col,
    doubles,
    has_nan,
    is_finite,
    minus,
    norm,
    order_key,
    plus,
    scaled,
    unit,
)
from premisa.operators.prompts import WINDOW_LIMIT
from premisa.operators.ranking import hash_rank, number_rank
from premisa.sources.staging import attach, in_waves, settle, settle_clustered

SAMPLES = ["dataset", "model", "variant"]
RUN = [*SAMPLES, "layer"]
PARTIAL_CELLS = 4_000_000  # numbers a task keeps before it hands its partial sums on
LOTS = 256  # groups of tasks whose partial sums are merged first


# --- ingest --------------------------------------------------------------------------------


def ingest_states(batches: list[DataFrame], layer: int | None = None) -> DataFrame:
    """Concatenate vector batches, round to 32 bits as stored, compute in doubles."""
    df = batches[0]
    for more in batches[1:]:
        df = df.unionByName(more)
    if layer is not None:
        df = df.filter(F.col("layer") == layer)
    return df.withColumn("vec", doubles("vec", through_float=True))


def cluster(
    states: DataFrame, name: str = "states", buckets: int | None = None, spread: bool = True
) -> DataFrame:
    """The vector table stored by sample: whatever brings a sample's rows together, ``sides``, ``half_split``,
    ``center`` and ``combine`` among it, then leaves the vectors where they are. ``spread`` is for rows
    that do not come from such a table."""
    by = [*SAMPLES, "sample_id"]
    return settle_clustered(states, name, by, ["dataset", "model", "layer"], buckets, spread)


def split_clean(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows): a missing vector, or one with a NaN or a missing number, is set aside."""
    bad = F.coalesce(has_nan("vec") | F.exists("vec", lambda x: x.isNull()), F.lit(True))
    return states.filter(~bad), states.filter(bad)


def first_pad(mask: Column | str, shift: bool = False) -> Column:
    """0-based place of the first 0 in a mask, or its length; ``shift`` ignores the first entry."""
    mask = as_col(mask)
    if shift:
        mask = F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0)))
    place = F.array_position(mask, 0)
    return F.when(place > 0, place - 1).otherwise(F.size(mask)).cast("int")


def token_vector(tokens: Column | str, mask: Column | str, token_idx: int = -1) -> Column:
    """The vector ``token_idx`` places before the first pad, or the first one for 0."""
    if token_idx > 0:
        raise ValueError("token_idx must be 0 or negative")
    if token_idx == 0:
        return F.element_at(as_col(tokens), 1)
    place = first_pad(mask) + token_idx
    return F.when(place >= 0, F.element_at(as_col(tokens), place + 1))


def masked_tokens(tokens: Column | str, mask: Column | str) -> Column:
    """All token vectors, those at padded positions turned to -infinity."""
    return F.zip_with(
        as_col(tokens),
        as_col(mask),
        lambda v, m: F.when(m == 0, F.transform(v, lambda x: F.lit(-INF))).otherwise(v),
    )


def answer_logits(
    values: DataFrame, answers: DataFrame, keys: list[str], left_to_right: bool = True
) -> DataFrame:
    """Mean value an answer's own tokens got.

    ``values`` holds ``keys, pos, token, value``; ``answers`` holds ``keys, pos, token``. A model
    reading left to right predicts the token at the place before it.
    """
    off = -1 if left_to_right else 0
    wanted = answers.withColumn("pos", F.col("pos") + off)
    found = wanted.join(values, [*keys, "pos", "token"])
    return found.groupBy(*keys).agg(F.avg("value").alias("logit"))


# --- sides ---------------------------------------------------------------------------------


def sides(states: DataFrame) -> DataFrame:
    """One row per sample with both vectors: ``x0`` negative, ``x1`` positive.

    One aggregation, without an exchange on a clustered table. Samples that lack a side or its vector are left
    out, as after ``split_clean``. A side met twice is an error.
    """
    keys = [c for c in states.columns if c not in ("side", "vec", "y")]
    vec = F.col("vec")
    found = [F.max(F.when(F.col("side") == i, vec)).alias(f"x{i}") for i in (0, 1)]
    y = [F.max(F.when(F.col("side") == 0, F.col("y"))).alias("y")] if "y" in states.columns else []
    most = F.greatest(*(F.count_if(F.col("side") == i) for i in (0, 1))).alias("_most")
    pairs = states.groupBy(*keys).agg(*y, *found, most)
    once = F.assert_true(F.col("_most") <= 1, F.lit("side met twice")).isNull()
    both = F.col("x0").isNotNull() & F.col("x1").isNotNull()
    return pairs.filter(once & both).drop("_most")


def true_side(states: DataFrame) -> DataFrame:
    return states.filter(F.col("side") == F.col("y"))


def false_side(states: DataFrame) -> DataFrame:
    return states.filter(F.col("side") == 1 - F.col("y"))


def side_combination(pairs: DataFrame, kind: str) -> DataFrame:
    """Add ``vec`` = neg-pos, neg+pos or pos-neg."""
    forms = {
        "neg-pos": minus("x0", "x1"),
        "neg+pos": plus("x0", "x1"),
        "pos-neg": minus("x1", "x0"),
    }
    return pairs.withColumn("vec", forms[kind])


# --- statistics ----------------------------------------------------------------------------


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row numbers of each key of a batch; a NULL key is a group like any other."""
    if not batch.num_rows:
        return
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        column = batch.column(k).dictionary_encode("encode")
        # codes stay dense, so their products can't overflow
        code = code * (len(column.dictionary) + 1) + column.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield tuple(batch.column(k)[int(rows[0])].as_py() for k in keys), rows


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a column, of any widths."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as a matrix, NULL numbers as NaN."""
    offsets = column.offsets.to_numpy()
    widths = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)[offsets[0] : offsets[-1]]
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(widths), -1)


def _typed_rows(keys: list[tuple], columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    n = len(schema) - len(columns)
    heads = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(n)]
    return pa.RecordBatch.from_arrays([*heads, *columns], schema=schema)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def moments(states: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    """Per group and task: number of rows, and per coordinate the finite values' count and sum, the
    mean and the squared deviations of all values. Partial rows are merged by ``merged_moments``.

    A task keeps one open group at least and hands its sums on when they hold ``PARTIAL_CELLS``.
    """
    key_schema = to_arrow_schema(T.StructType([states.schema[k] for k in keys]))
    lists = [pa.field(n, pa.list_(pa.float64())) for n in ("count", "sum", "mean", "squares")]
    schema = pa.schema([*key_schema, pa.field("n", pa.int64()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def drain() -> pa.RecordBatch:
            found = list(held.values())
            columns = [pa.array([f[0] for f in found], pa.int64())]
            columns += [_lists([f[i] for f in found]) for i in range(1, 5)]
            out = _typed_rows(list(held), columns, schema)
            held.clear()
            return out

        for batch in batches:
            vectors = batch.column(len(keys))
            for key, rows in _groups(batch, keys):
                part = moments_of(_matrix(vectors.take(pa.array(rows))))
                held[key] = add_moments(held[key], part) if key in held else part
            if len(held) > 1 and sum(4 * len(h[1]) for h in held.values()) > PARTIAL_CELLS:
                yield drain()
        if held:
            yield drain()

    rows = states.filter(F.col(vector).isNotNull()).select(*keys, vector)
    kinds = [T.StructField("n", T.LongType())]
    kinds += [T.StructField(f.name, T.ArrayType(T.DoubleType())) for f in lists]
    return rows.mapInArrow(run, T.StructType([states.schema[k] for k in keys] + kinds))


def moments_of(x: np.ndarray) -> tuple:
    finite = np.isfinite(x)
    with np.errstate(invalid="ignore", over="ignore"):
        mean = x.mean(axis=0)
        squares = ((x - mean) ** 2).sum(axis=0)
    return (
        len(x), finite.sum(axis=0).astype(float), np.where(finite, x, 0.0).sum(axis=0), mean, squares
    )


def add_moments(a: tuple, b: tuple) -> tuple:
    """Moments of two parts together."""
    if len(a[1]) != len(b[1]):
        raise ValueError("vectors differ in length")
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", over="ignore"):
        gap = b[3] - a[3]
        mean = a[3] + gap * (b[0] / n)
        squares = a[4] + b[4] + gap * gap * (a[0] * b[0] / n)
    return n, a[1] + b[1], a[2] + b[2], mean, squares


def merge_partials(
    parts: DataFrame,
    keys: list[str],
    lists: list[str],
    add: Callable[[tuple, tuple], tuple],
    finish: Callable[[tuple], list[pa.Array]],
    kind: T.StructType,
) -> DataFrame:
    """One row per group from partial rows ``(keys, n, lists)`` of all tasks, whatever their number.

    In two levels: first the partials of a group and a lot of tasks, then those of a group. Tasks read
    partials as they come and keep a sum per group, up to ``PARTIAL_CELLS`` numbers or one group; the
    second level reads group after group. ``add`` joins two partials, ``finish`` gives the columns of
    ``kind`` behind the keys.
    """
    heads = T.StructType([parts.schema[k] for k in keys])
    between = T.StructType([*heads.fields, parts.schema["n"], *(parts.schema[c] for c in lists)])
    between_arrow, final = to_arrow_schema(between), to_arrow_schema(kind)

    def summed(held: dict[tuple, tuple], batch: pa.RecordBatch) -> tuple | None:
        """Adds a batch's partials and returns the key of its last row."""
        last = None
        n = batch.column("n").to_pylist()
        columns = [_vectors(batch.column(c)) for c in lists]
        for key, rows in _groups(batch, keys):
            for i in rows.tolist():
                part = (n[i], *(c[i] for c in columns))
                held[key] = add(held[key], part) if key in held else part
            if rows[-1] == batch.num_rows - 1:
                last = key
        return last

    def lot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def drain() -> pa.RecordBatch:
            found = list(held.values())
            columns = [pa.array([f[0] for f in found], pa.int64())]
            columns += [_lists([f[i + 1] for f in found]) for i in range(len(lists))]
            out = _typed_rows(list(held), columns, between_arrow)
            held.clear()
            return out

        for batch in batches:
            summed(held, batch)
            if len(held) > 1 and sum(len(h[1]) * len(lists) for h in held.values()) > PARTIAL_CELLS:
                yield drain()
        if held:
            yield drain()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def close(but: tuple | None) -> Iterator[pa.RecordBatch]:
            done = [k for k in held if k != but]
            if done:
                found = [finish(held.pop(k)) for k in done]
                columns = [pa.concat_arrays(c) for c in zip(*found, strict=True)]
                yield _typed_rows(done, columns, final)

        for batch in batches:
            last = summed(held, batch)
            yield from close(last)
        yield from close(None)

    numbered = parts.withColumn("_lot", F.pmod(F.spark_partition_id(), F.lit(LOTS)))
    dealt = numbered.repartition(*keys, "_lot").drop("_lot").mapInArrow(lot, between)
    # without keys all lots meet in one task, which still reads them one after the other
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys) if keys else dealt.coalesce(1)
    return ordered.mapInArrow(whole, kind)


def merged_moments(
    parts: DataFrame, keys: list[str], fields: list[str], finish: Callable[[tuple], list[pa.Array]]
) -> DataFrame:
    """One row per group from the partial moments of all tasks: ``finish`` gives its vectors."""
    kind = T.StructType([parts.schema[k] for k in keys])
    for field in fields:
        kind = kind.add(field, T.ArrayType(T.DoubleType()))

    def columns(state: tuple) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in finish(state)]

    lists = ["count", "sum", "mean", "squares"]
    return merge_partials(parts, keys, lists, add_moments, columns, kind)


def finite_mean(m: tuple) -> pa.Array:
    """Means of the finite values; NULL where there is none."""
    means = np.divide(m[2], m[1], out=np.zeros(len(m[1])), where=m[1] > 0)
    return pa.array(means, mask=m[1] == 0)


def vector_stats(states: DataFrame, keys: list[str], std: bool = False) -> DataFrame:
    """Mean per coordinate over the finite values, and on demand the (n-1) deviation.

    Tasks add up whole vectors and send one partial row per group, so neither vectors nor
    coordinates are shuffled; the rows are merged in two levels (see ``merge_partials``). The deviation is
    that of the centred data, so one non-finite value makes it NaN; of one vector it is NULL. A
    coordinate without a finite value has no mean.
    """

    def finish(m: tuple) -> list[pa.Array]:
        found = [finite_mean(m)]
        if std:
            spread = np.sqrt(m[4] / max(m[0] - 1, 1))
            found.append(pa.array(spread, mask=np.full(len(spread), m[0] < 2)))
        return found

    names = ["mean", "std"] if std else ["mean"]
    return merged_moments(moments(states, keys), keys, names, finish)


def mean_difference(states: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the true sides minus mean of the false sides, and its length."""
    labelled = states.filter(F.col("y").isNotNull())
    tagged = labelled.withColumn("_true", F.col("side") == F.col("y"))
    means = vector_stats(tagged, [*keys, "_true"])
    both = means.groupBy(*keys).agg(
        F.max(F.when(F.col("_true"), F.col("mean"))).alias("_t"),
        F.max(F.when(~F.col("_true"), F.col("mean"))).alias("_f"),
    )
    direction = F.zip_with("_t", "_f", lambda t, f: t - f)
    found = both.select(*keys, direction.alias("direction"))
    return found.withColumn("length", norm("direction"))


def gram(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Rows ``(keys, i, row)`` of the matrix leftᵀ·right summed over each group, plus ``n``.

    Tasks add up outer products in numpy and emit one partial matrix per group, row by row; equal
    rows of the partials are merged in two levels, one owner each, so neither a group nor a matrix passes
    through one task whole. A task holds ``PARTIAL_CELLS`` numbers or one matrix. Rows of one group should
    lie together, or open matrices alternate.
    """
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("i", T.IntegerType()),
            T.StructField("row", T.ArrayType(T.DoubleType())),
        ]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        counts: dict[tuple, int] = {}

        def drain() -> Iterator[pd.DataFrame]:
            for key, matrix in sums.items():
                frame = pd.DataFrame([key] * len(matrix), columns=keys)
                frame["n"] = counts[key]
                frame["i"] = np.arange(len(matrix), dtype=np.int32)
                frame["row"] = list(matrix)
                yield frame
            sums.clear()
            counts.clear()

        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                a, b = np.stack(part[left].to_list()), np.stack(part[right].to_list())
                product = a.T @ b
                if key in sums:
                    sums[key] += product
                else:
                    if sums and sum(m.size for m in sums.values()) + product.size > PARTIAL_CELLS:
                        yield from drain()
                    sums[key] = product
                counts[key] = counts.get(key, 0) + len(part)
        yield from drain()

    wanted = list(dict.fromkeys([left, right]))
    parts = rows.select(*keys, *wanted).mapInPandas(partial, schema)

    def add(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    def line(state: tuple) -> list[pa.Array]:
        return [pa.array([state[0]], pa.int64()), _lists([state[1]])]

    kind = T.StructType([*(schema[c] for c in (*keys, "i", "n", "row"))])
    return merge_partials(parts, [*keys, "i"], ["row"], add, line, kind)


def triangular_factor(
    rows: DataFrame,
    keys: list[str],
    vector: str,
    finish: Callable[[int, np.ndarray], list[pa.Array]],
    kind: T.StructType,
) -> DataFrame:
    """One row per group from the triangular factor R of the matrix of its vectors: QR of a tall matrix.

    A task reduces the rows of a group to its own factor, at most ``width`` rows, as soon as it holds twice as
    many. Factors are rows again, so the same step merges them, first those of a lot of tasks, then all.
    A task holds ``PARTIAL_CELLS`` numbers or the rows of one factor twice. RᵀR is the Gram matrix, but the small
    singular values of R keep the digits that the Gram matrix loses. ``finish`` gets the number of vectors
    and R and gives the columns of ``kind`` behind the keys. NULL vectors are left out.
    """
    heads = [rows.schema[k] for k in keys]
    listed = T.ArrayType(T.DoubleType())
    between = T.StructType([*heads, T.StructField("n", T.LongType()), T.StructField("row", listed)])
    between_arrow, final = to_arrow_schema(between), to_arrow_schema(kind)

    def reduced(blocks: list[np.ndarray]) -> np.ndarray:
        whole = np.concatenate(blocks)
        return np.linalg.qr(whole, mode="r") if len(whole) > whole.shape[1] else whole

    def read(held: dict[tuple, list], batch: pa.RecordBatch) -> tuple | None:
        """Adds a batch's rows and returns the key of its last one."""
        last = None
        counts = batch.column("n").to_numpy()
        for key, at in _groups(batch, keys):
            block = _matrix(batch.column("row").take(pa.array(at)))
            state = held.setdefault(key, [0, [], 0])
            if state[1] and state[1][0].shape[1] != block.shape[1]:
                raise ValueError("vectors differ in length")
            state[0] += int(counts[at].sum())
            state[1].append(block)
            state[2] += len(block)
            if state[2] > 2 * block.shape[1]:
                state[1] = [reduced(state[1])]
                state[2] = len(state[1][0])
            if at[-1] == batch.num_rows - 1:
                last = key
        return last

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for key, (n, blocks, _) in held.items():
                factor = reduced(blocks)
                counts = np.zeros(len(factor), np.int64)
                counts[0] = n  # the first row of a factor carries the number of vectors behind it
                columns = [pa.array(counts), _lists(list(factor))]
                yield _typed_rows([key] * len(factor), columns, between_arrow)
            held.clear()

        for batch in batches:
            read(held, batch)
            cells = sum(state[2] * state[1][0].shape[1] for state in held.values())
            if len(held) > 1 and cells > PARTIAL_CELLS:
                yield from drain()
        yield from drain()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def close(but: tuple | None) -> Iterator[pa.RecordBatch]:
            for key in [k for k in held if k != but]:
                n, blocks, _ = held.pop(key)
                yield _typed_rows([key], finish(n, reduced(blocks)), final)

        for batch in batches:
            last = read(held, batch)
            yield from close(last)
        yield from close(None)

    given = rows.filter(F.col(vector).isNotNull())
    one = F.lit(1).cast("bigint")
    given = given.select(*keys, one.alias("n"), F.col(vector).cast(listed).alias("row"))
    numbered = given.mapInArrow(partial, between).withColumn(
        "_lot", F.pmod(F.spark_partition_id(), F.lit(LOTS))
    )
    lots = numbered.repartition(*keys, "_lot").drop("_lot").mapInArrow(partial, between)
    return lots.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(whole, kind)


def class_centred(states: DataFrame, keys: list[str]) -> DataFrame:
    """True and false vectors, each less the mean of its class."""
    tagged = states.filter("y is not null").withColumn("_true", F.col("side") == F.col("y"))
    means = settle(vector_stats(tagged, [*keys, "_true"]), "class-means")
    joined = in_waves(tagged, means, [*keys, "_true"], keys)
    return joined.withColumn("vec", minus("vec", "mean")).drop("mean")


def class_covariance(states: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled covariance (n-1) of the true and false vectors, each centred on its class mean."""
    matrix = gram(class_centred(states, keys), keys, "vec", "vec")
    return matrix.withColumn(
        "row", F.transform("row", lambda x: x / (F.col("n") - 1).cast("double"))
    )


def matrix_ranks(states: DataFrame, keys: list[str]) -> DataFrame:
    """Numerical rank of the neg, pos, neg+pos and neg-pos matrices of each group.

    It is the rank of the triangular factor, from its singular values as for the matrix itself.
    Tolerance: largest singular value x max(n, d) x 32-bit epsilon.
    """
    pairs = sides(states)
    forms = F.array(
        F.struct(F.lit("neg").alias("matrix"), F.col("x0").alias("vec")),
        F.struct(F.lit("pos").alias("matrix"), F.col("x1").alias("vec")),
        F.struct(F.lit("neg+pos").alias("matrix"), plus("x0", "x1").alias("vec")),
        F.struct(F.lit("neg-pos").alias("matrix"), minus("x0", "x1").alias("vec")),
    )
    rows = pairs.select(*keys, F.inline(forms))
    by = [*keys, "matrix"]
    schema = T.StructType([rows.schema[k] for k in by] + [T.StructField("rank", T.IntegerType())])

    def rank(n: int, factor: np.ndarray) -> list[pa.Array]:
        values = np.linalg.svd(factor, compute_uv=False)
        floor = values.max() * max(n, factor.shape[1]) * np.finfo(np.float32).eps
        return [pa.array([int((values > floor).sum())], pa.int32())]

    return triangular_factor(rows, by, "vec", rank, schema)


# --- preparation ---------------------------------------------------------------------------


def half_split(states: DataFrame, keys: list[str] = SAMPLES) -> DataFrame:
    """First half of each group's samples (by id) is ``train``, the rest ``eval``.

    Samples are ranked once per dataset, model and variant: their layers and sides share the
    split. Only the id columns are read for it.
    """
    samples = states.select(*keys, "sample_id").distinct()
    return states.join(split_of(samples, keys), [*keys, "sample_id"])


def split_of(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``split`` per sample: positions below ⌊n/2⌋ are train."""
    ranked = number_rank(samples, keys, "sample_id", "_rank", total="_n")
    half = F.floor(F.col("_n") / 2)
    return ranked.withColumn(
        "split", F.when(F.col("_rank") <= half, "train").otherwise("eval")
    ).drop("_rank", "_n")


def center(
    states: DataFrame, scale: bool = False, fit_on: str = "own", keys: list[str] = RUN
) -> DataFrame:
    """Subtract the mean per group, split and side; divide by the deviation if ``scale``.

    ``fit_on='own'`` uses each split's own statistics, ``'train'`` the train split's for both. The statistics
    go to the vectors, in waves if they are many (see ``in_waves``); the vectors are not moved.
    """
    by = [*keys, "split", "side"]
    source = states if fit_on == "own" else states.filter("split = 'train'")
    stats = vector_stats(source, by, std=scale)
    if fit_on != "own":
        by = [k for k in by if k != "split"]
        stats = stats.drop("split")
    joined = in_waves(states, settle(stats, "vector-stats"), by, ["dataset", "model", "layer"])
    vec = minus("vec", "mean")
    if scale:
        vec = F.zip_with(vec, "std", lambda x, s: _ieee(x, s))
    return joined.withColumn("vec", vec).drop("mean", "std")


def _ieee(a: Column, b: Column) -> Column:
    """Division of centred data by a deviation of zero: the data is zero too, so NaN."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)


def quota_sample(
    df: DataFrame, keys: list[str], part: str, quotas: dict[str, int], ids: list[str], seed: int
) -> DataFrame:
    """A random ``quotas[p]`` rows of every part p of each group; other parts are left out."""
    limit = F.lit(None).cast("bigint")
    for name, size in quotas.items():
        limit = F.when(F.col(part) == name, F.lit(size).cast("bigint")).otherwise(limit)
    rows = df.withColumn("_quota", limit).filter("_quota is not null")
    most = max(quotas.values())
    by = [*keys, part]
    key = order_key(seed, part, *ids)
    if most <= WINDOW_LIMIT:
        order = Window.partitionBy(*by).orderBy("_k", *ids)
        ranked = rows.withColumn("_k", key).withColumn("_rank", F.row_number().over(order))
        ranked = ranked.filter(F.col("_rank") <= most).drop("_k")
    else:
        ranked = hash_rank(rows, by, key, ids, "_rank")
    return ranked.filter("_rank <= _quota").drop("_rank", "_quota")


def combine(
    states: DataFrame, quotas: dict[str, tuple[int, bool]], seed: int = 0
) -> DataFrame:
    """Mixed training set: a quota of train samples per variant; unsupervised parts lose labels.

    Samples are drawn once per variant and layer, then both sides are fetched by an equi-join.
    """
    train = states.filter("split = 'train'")
    samples = train.filter("side = 0").select(*RUN, "sample_id")
    sizes = {name: size for name, (size, _) in quotas.items()}
    drawn = quota_sample(
        samples, ["dataset", "model", "layer"], "variant", sizes, ["sample_id"], seed
    )
    supervised = [name for name, (_, keep) in quotas.items() if keep]
    # a sample's layers in one row: the join is on what the vectors are clustered by
    by = [*SAMPLES, "sample_id"]
    layers = drawn.groupBy(*by).agg(F.collect_set("layer").alias("_layers"))
    chosen = train.join(layers, by).filter(F.array_contains("_layers", F.col("layer")))
    y = F.when(F.col("variant").isin(supervised), F.col("y"))
    return chosen.select(*train.columns).withColumn("y", y)


def steer(
    states: DataFrame,
    probes: DataFrame,
    sign: int,
    on_answer: bool = False,
    on_period: bool = False,
) -> DataFrame:
    """Add ``sign · probe sign · length · unit(direction)`` to the vectors at flagged positions.

    ``states`` carries ``is_answer`` and ``is_period`` flags; ``probes`` holds one staged probe
    per dataset, model and layer.
    """
    if not (on_answer or on_period):
        raise ValueError("steer needs a target: on_answer, on_period or both")
    flag = F.lit(False)
    if on_answer:
        flag = flag | F.col("is_answer")
    if on_period:
        flag = flag | F.col("is_period")
    shift = probes.select(
        "dataset",
        "model",
        "layer",
        scaled(unit("direction"), F.lit(float(sign)) * F.col("sign") * F.col("length")).alias(
            "_shift"
        ),
    )
    joined = attach(states, shift, ["dataset", "model", "layer"], ["sample_id"], "left")
    moved = F.when(flag & F.col("_shift").isNotNull(), plus("vec", "_shift"))
    return joined.withColumn("vec", F.coalesce(moved, F.col("vec"))).drop("_shift")


# --- checks --------------------------------------------------------------------------------


def check_labels(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: number of samples, and whether every sample has one label in all variants."""
    per_sample = labelled.groupBy(*keys, "sample_id").agg(
        (F.min("label") == F.max("label")).alias("_same")
    )
    return per_sample.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.bool_and("_same").alias("consistent")
    )
