"""Whitening of vectors by an eigendecomposition that grows row by row.

A task keeps the spectrum of what it has read. A new row changes it by one centred rank-one update, whose
eigenvalues are the roots of a secular equation. Spectra of tasks are combined by the same updates in a
tree; Rayleigh-Ritz steps over all rows refine the leading components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premisa.llm.common import finite_entries, quoted
from premisa.sources.staging import settle

EPS = float(np.finfo(float).eps)
FAN = 16  # partial results that meet in a task
GUARD = 16  # further vectors a Rayleigh-Ritz step carries along
PASSES = 8
RESIDUAL = 1e-14  # of the largest eigenvalue: then a component is refined
FLOOR = 1e-12  # of the largest eigenvalue: smaller ones count as zero
WIDEST = 1 << 52  # integers below this are exact in double arithmetic

# number of rows, their mean, eigenvalues of the centred scatter, eigenvectors as columns
Spectrum = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots x of 1 + rho * sum(z² / (d - x)) = 0, and the differences d_i - x_j.

    ``d`` ascends strictly, ``z`` has no zero and length one, ``rho`` is positive. Each root is searched from
    its nearer pole, so its differences keep all their digits. The steps solve for a rational function
    with the two neighbouring poles; a bracket is halved where a step would leave it.
    """
    k = len(d)
    each = np.arange(k)
    square = z * z
    width = np.append(d[1:], d[-1] + rho) - d
    middle = 1 / rho + (square[:, None] / (d[:, None] - d - width / 2)).sum(axis=0)
    left = (middle > 0) | (each == k - 1)
    origin = np.where(left, each, each + 1)
    delta = d[:, None] - d[origin]
    low = np.where(left, 0.0, -width / 2)
    high = np.where(left, width / 2, 0.0)
    if middle[-1] <= 0:
        low[-1], high[-1] = width[-1] / 2, width[-1]
    below = each[:, None] <= each
    after = np.minimum(each + 1, k - 1)
    tau, done = (low + high) / 2, np.zeros(k, bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            gap = delta - tau
            part = square[:, None] / gap
            f = 1 / rho + part.sum(axis=0)
            size = 1 / rho + np.abs(part).sum(axis=0)
            up = f > 0
            high, low = np.where(up, tau, high), np.where(up, low, tau)
            done |= (np.abs(f) <= 8 * EPS * size) | (high - low <= 2 * EPS * np.abs(tau))
            if done.all():
                break
            slope = part / gap
            psi = np.where(below, slope, 0.0).sum(axis=0)
            phi = slope.sum(axis=0) - psi
            one, two = gap[each, each], gap[after, each]
            c = f - one * psi - two * phi
            a = (one + two) * f - one * two * (psi + phi)
            b = one * two * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = one[-1] + one[-1] ** 2 * psi[-1] / (f[-1] - one[-1] * psi[-1])
            new = tau + step
            done |= np.abs(step) <= EPS * np.abs(tau)
            inside = np.isfinite(new) & (new > low) & (new < high)
            new = np.where(inside, new, (low + high) / 2)
            tau = np.where(done, tau, new)
    return d[origin] + tau, delta - tau


def rank_one(
    values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float
) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors after ``rho * v vᵀ`` (rho > 0) is added.

    A part of ``v`` outside the known vectors becomes a new one. An entry too small to matter, and one of
    two eigenvalues too close to tell apart after a rotation, keep their pairs (deflation).
    """
    length = float(np.sqrt(v @ v))
    if length == 0 or rho <= 0:
        return values, vectors
    z = vectors.T @ v
    rest = v - vectors @ z
    again = vectors.T @ rest
    z, rest = z + again, rest - vectors @ again
    out = float(np.sqrt(rest @ rest))
    if vectors.shape[1] < len(v) and out > 64 * EPS * length:
        values, z = np.append(0.0, values), np.append(out, z)
        vectors = np.column_stack([rest / out, vectors])
    order = np.argsort(values, kind="stable")
    values, vectors, z = values[order], vectors[:, order], z[order]
    norm = float(np.sqrt(z @ z))
    z, rho = z / norm, rho * norm * norm
    least = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    kept = np.nonzero(rho * np.abs(z) > least)[0]
    if len(kept) > 1:
        d, w = values[kept], z[kept]
        near = np.abs(np.diff(d) * w[1:] * w[:-1]) <= least * (w[1:] ** 2 + w[:-1] ** 2)
        if near.any():
            values, vectors, z = values.copy(), vectors.copy(), z.copy()
            lasting, at = [], kept[0]
            for j in kept[1:]:
                both = float(np.hypot(z[at], z[j]))
                c, s = z[j] / both, z[at] / both
                if abs((values[j] - values[at]) * c * s) <= least:
                    x, y = vectors[:, at].copy(), vectors[:, j].copy()
                    vectors[:, at], vectors[:, j] = c * x - s * y, s * x + c * y
                    p, q = values[at], values[j]
                    values[at], values[j] = c * c * p + s * s * q, s * s * p + c * c * q
                    z[at], z[j] = 0.0, both
                else:
                    lasting.append(at)
                at = j
            kept = np.array([*lasting, at])
            kept = kept[np.argsort(values[kept], kind="stable")]
            # equal poles after rounding: the later one stays
            kept = kept[np.append(np.diff(values[kept]) > 0, True)]
    if len(kept) == 0:
        return values, vectors
    d, w = values[kept], z[kept]
    w = w / np.sqrt(w @ w)
    found, gap = secular_roots(d, w, rho)
    # entries that belong to these roots exactly: eigenvectors stay orthogonal
    ratio = np.abs(gap)
    apart = np.abs(d[:, None] - d)
    np.fill_diagonal(apart, 1.0)
    w = np.copysign(np.exp(0.5 * (np.log(ratio) - np.log(apart)).sum(axis=1)), w)
    turn = w[:, None] / gap
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[kept], vectors[:, kept] = found, vectors[:, kept] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def with_row(spectrum: Spectrum | None, x: np.ndarray) -> Spectrum:
    """The spectrum of the rows so far and ``x``."""
    if spectrum is None:
        return 1, x.copy(), np.zeros(0), np.zeros((len(x), 0))
    n, mean, values, vectors = spectrum
    v = x - mean
    values, vectors = rank_one(values, vectors, v, n / (n + 1))
    return n + 1, mean + v / (n + 1), values, vectors


def combined(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of the rows of both: one update per pair of ``b``, and one for the two means."""
    n, mean, values, vectors = a
    for value, vector in zip(b[2], b[3].T, strict=True):
        values, vectors = rank_one(values, vectors, vector, float(value))
    gap = b[1] - mean
    total = n + b[0]
    values, vectors = rank_one(values, vectors, gap, n * b[0] / total)
    return total, mean + gap * (b[0] / total), values, np.linalg.qr(vectors)[0]


def tree(parts: DataFrame, add: Callable[[list[dict]], dict], kind: str, fan: int) -> dict | None:
    """One row of all partial rows: ``fan`` of them meet in a task, level after level."""

    def run(group: pa.Table) -> pa.Table:
        found = add(group.to_pylist())
        found["node"] = group.column("node")[0].as_py()
        return pa.Table.from_pylist([found], schema=group.schema)

    now = settle(parts.select(F.spark_partition_id().cast("bigint").alias("node"), "*"), "parts")
    while (count := now.count()) > 1:
        up = now.withColumn("node", F.floor(F.col("node") / fan))
        now = settle(up.groupBy("node").applyInArrow(run, f"node bigint, {kind}"), "parts")
    return now.first().asDict() if count else None


def integer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The last column of each batch as an integer matrix."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        if len(lists):
            yield lists.flatten().to_numpy().reshape(len(lists), -1)


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spectrum, total = None, 0
    for x in integer_rows(batches):
        total = total + x.sum(axis=0)
        for row in x.astype(float):
            spectrum = with_row(spectrum, row)
    if spectrum is not None:
        n, mean, values, vectors = spectrum
        row = {"n": n, "total": total, "mean": mean, "vals": values, "vecs": vectors.ravel()}
        yield pa.RecordBatch.from_pylist([row])


def _join_spectra(rows: list[dict]) -> dict:
    def read(row: dict) -> Spectrum:
        mean = np.array(row["mean"])
        return row["n"], mean, np.array(row["vals"]), np.array(row["vecs"]).reshape(len(mean), -1)

    whole, total = read(rows[0]), np.array(rows[0]["total"], np.int64)
    for row in rows[1:]:
        whole, total = combined(whole, read(row)), total + np.array(row["total"], np.int64)
    n, mean, values, vectors = whole
    return {"n": n, "total": total, "mean": mean, "vals": values, "vecs": vectors.ravel()}


def _sums(rows: list[dict]) -> dict:
    return {name: np.sum([row[name] for row in rows], axis=0) for name in rows[0] if name != "node"}


def refined(
    x: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray, k: int, fan: int = FAN
) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues and their vectors, and the trace of the covariance.

    Each pass multiplies the covariance of all rows with the basis, solves the small projected problem and, if
    a residual is left, adds it to the next basis.
    """
    best = np.inf
    for _ in range(PASSES):

        def run(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            image, square = 0.0, 0.0
            for part in integer_rows(batches):
                y = part - mean
                image, square = image + y.T @ (y @ basis), square + float((y * y).sum())
            if isinstance(image, np.ndarray):
                yield pa.RecordBatch.from_pylist([{"image": image.ravel(), "square": square}])

        kind = "image array<double>, square double"
        found = tree(x.mapInArrow(run, kind), _sums, kind, fan)
        image = np.array(found["image"]).reshape(basis.shape) / n
        trace = found["square"] / n
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1][:, : k + GUARD]
        values = values[::-1][: k + GUARD]
        vectors = basis @ turn
        rest = (image @ turn - vectors * values)[:, :k]
        rest -= vectors @ (vectors.T @ rest)
        error = float(np.sqrt((rest * rest).sum(axis=0)).max()) / max(values[0], 1e-300)
        done = error <= RESIDUAL or error > best / 4 or basis.shape[1] == len(basis)
        if error <= best:
            best, kept = error, (values[:k], vectors[:, :k])
        if done:
            break
        basis = np.linalg.qr(np.column_stack([vectors, rest]))[0][:, : len(basis)]
    values, vectors = kept
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(largest < 0, -1.0, 1.0), trace


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> pa.Array:
    """Sums of (n * x - total)², exact."""
    kind = pa.decimal128(38, 0)
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(total).max(initial=0))
    if most**2 * x.shape[1] < 1 << 63:
        gap = n * x - total
        return pa.array((gap * gap).sum(axis=1)).cast(kind)
    gap = n * x.astype(object) - total.astype(object)
    return pa.array([Decimal(int(s)) for s in (gap * gap).sum(axis=1)], kind)


def _join_moments(rows: list[dict]) -> dict:
    n, mean, scatter = rows[0]["n"], np.array(rows[0]["mean"]), np.array(rows[0]["scatter"])
    for row in rows[1:]:
        gap, total = np.array(row["mean"]) - mean, n + row["n"]
        scatter = scatter + np.array(row["scatter"]) + np.outer(gap, gap).ravel() * (n * row["n"] / total)
        mean, n = mean + gap * (row["n"] / total), total
    return {"n": n, "mean": mean, "scatter": scatter}


def whiten(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    components: int = 8,
    scale: int = 1024,
    shift: int = 100_000,
    fan: int = FAN,
) -> DataFrame:
    """Whitened leading components of all vectors, one row per vector and component: ``vec_id``,
    ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``.

    An entry c counts as floor(scale * c) + shift. ``deviation`` is the exact sum of (n * x - sums)², ``whitened``
    the centred vector's projection on the component over the root of its eigenvalue, ``explained`` the
    eigenvalue's share of the trace, ``identity_error`` the largest entry of the whitened rows' covariance minus
    the identity, measured over all rows. A component's sign makes its largest entry positive.

    Rows with a NULL vector or a NULL or non-finite entry are dropped; a NULL id, repeated ids and equal rows
    stay rows of their own. Components with an eigenvalue of zero (to ``FLOOR``) can't be whitened and are left
    out, so one row, equal rows and an empty table give an empty result. Vectors of different lengths and
    entries beyond 2^52 are errors. Other columns are not carried.

    A task holds a spectrum of width x width numbers whatever it reads, ``fan`` spectra meet in a task of the
    tree, and the driver gets the last one: sizes depend on the width only.
    """
    name = vec_id.replace("`", "")
    kind = rows.schema[vec_id].dataType.simpleString()
    entry = quoted(vector)
    taken = rows.where(entry.isNotNull()).where(finite_entries(entry))
    taken = taken.select(
        quoted(vec_id).alias("id"), F.transform(entry, lambda c: c.cast("double") * scale).alias("x")
    )
    sizes = taken.agg(
        F.min(F.size("x")).alias("narrow"),
        F.max(F.size("x")).alias("wide"),
        F.max(F.aggregate("x", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c)))).alias("most"),
    ).first()
    if sizes["narrow"] != sizes["wide"]:
        raise ValueError("vectors differ in length")
    if (sizes["most"] or 0) + abs(shift) >= WIDEST:
        raise ValueError("entries are too large for exact sums")
    whole = F.transform("x", lambda c: F.floor(c) + F.lit(shift).cast("bigint"))
    taken = settle(taken.select("id", whole.alias("x")), "vectors")
    x = taken.select("x")
    schema = f"{name} {kind}, component int, n bigint, deviation decimal(38,0), whitened double, "
    empty = rows.sparkSession.createDataFrame([], schema + "explained double, identity_error double")
    if not sizes["wide"]:
        return empty

    kinds = "n bigint, total array<bigint>, mean array<double>, vals array<double>, vecs array<double>"
    first = tree(x.mapInArrow(_spectra, kinds), _join_spectra, kinds, fan)
    n, total = first["n"], np.array(first["total"], np.int64)
    mean = np.array([int(s) / n for s in total])
    vectors = np.array(first["vecs"]).reshape(len(mean), -1)
    if not vectors.shape[1]:
        return empty
    basis = np.linalg.qr(vectors[:, ::-1][:, : components + GUARD])[0]
    values, vectors, trace = refined(x, mean, n, basis, components, fan)
    sound = values > FLOOR * max(values[0], 0)
    values, vectors = values[sound], vectors[:, sound]
    if not len(values):
        return empty
    turn = vectors / np.sqrt(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in integer_rows(batches):
            w = (part - mean) @ turn
            middle = w.mean(axis=0)
            own = {"n": len(w), "mean": middle, "scatter": ((w - middle).T @ (w - middle)).ravel()}
            held = [_join_moments([*held, own])]
        if held:
            yield pa.RecordBatch.from_pylist(held)

    kinds = "n bigint, mean array<double>, scatter array<double>"
    found = tree(x.mapInArrow(moments, kinds), _join_moments, kinds, fan)
    covariance = np.array(found["scatter"]).reshape(len(values), -1) / n
    error = float(np.abs(covariance - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in integer_rows(iter([batch])):
                w = (part - mean) @ turn
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
                columns = [batch.column(0), _deviations(part, n, total), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "deviation", "w"])

    out = taken.mapInArrow(project, f"id {kind}, deviation decimal(38,0), w array<double>")
    out = out.select("id", "deviation", F.posexplode("w").alias("place", "whitened"))
    share = F.array(*(F.lit(float(v)) for v in values / trace))
    return out.select(
        F.col("id").alias(name),
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
