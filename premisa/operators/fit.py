"""Fitting probe directions: one direction per group of training pairs.

Every iterative method is written as sums over rows (``totals``) plus a small update (``step``).
A group whose pairs fit a fixed number of cells is fitted inside one task, many groups side by
side. A larger group is never gathered: each iteration adds up ``totals`` over all its
partitions, and only the sums, whose size depends on the width of a vector, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premisa.functions.exprs import minus, order_key
from premisa.operators.ranking import hash_rank
from premisa.operators.vectors import class_centred, mean_difference, sides, triangular_factor
from premisa.sources.staging import attach, settle

TASK_CELLS = 8_000_000  # numbers of one side that a task may hold: 64 MB
CHUNK_CELLS = 65_536  # numbers of a sum that travel in one row
WAVE_CELLS = 4_000_000  # parameters of large groups that are fitted at the same time
PLANES = 8  # random planes whose signs sum up a group too large for linkage
SMALL_EIGENVALUE = 1e-3  # smaller ones of the class covariance are not inverted

Sums = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


class Method:
    """What every iterative method has: seeds, a batch size (-1 = all rows), a start.

    A group of at most ``task_rows`` rows is fitted inside a task, however wide its vectors are.
    """

    name = ""
    supervised = False
    task_rows = 0
    seeds: tuple[int, ...] = (0,)
    batch_size = -1

    def cells(self, d: int) -> int:
        """Numbers that a step sums up for vectors of width d."""
        return 2 * d * len(self.seeds)

    def batches(self, n: int) -> int:
        """Batches per epoch; rows that do not fill the last one are dropped."""
        return 1 if self.batch_size < 0 else max(n // self.batch_size, 1)


class GradientMethod(Method):
    """AdamW on a direction per seed; subclasses give the loss and its gradient.

    ``w`` has one row per seed, so all seeds share one pass over the data. The reported loss is
    that of the last batch before its step.
    """

    def __init__(
        self,
        seeds: tuple[int, ...] = (0,),
        epochs: int = 1000,
        lr: float = 1e-3,
        decay: float = 0.01,
        batch_size: int = -1,
    ):
        self.seeds, self.epochs, self.lr, self.decay = seeds, epochs, lr, decay
        self.batch_size = batch_size

    def start(self, d: int, anchor: np.ndarray, n: int) -> dict[str, Any]:
        bound = 1.0 / np.sqrt(d)
        w = np.stack([np.random.default_rng(s).uniform(-bound, bound, d) for s in self.seeds])
        zeros = {"m": np.zeros_like(w), "v": np.zeros_like(w)}
        return {"w": w, **zeros, "t": 0, "steps": self.epochs * self.batches(n), "done": False}

    def totals(self, w: np.ndarray, x0: np.ndarray, x1: np.ndarray, y: np.ndarray) -> Sums:
        raise NotImplementedError

    def step(self, state: dict[str, Any], sums: Sums) -> dict[str, Any]:
        n = sums["n"][0]
        g = sums["g"].reshape(state["w"].shape) / n
        t = state["t"] + 1
        m = 0.9 * state["m"] + 0.1 * g
        v = 0.999 * state["v"] + 0.001 * g * g
        w = state["w"] * (1 - self.lr * self.decay)
        w = w - self.lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        done = t >= state["steps"]
        return {**state, "w": w, "m": m, "v": v, "t": t, "loss": sums["loss"] / n, "done": done}

    def result(self, state: dict[str, Any]) -> list[tuple[int, np.ndarray, float, bool]]:
        """A fixed number of steps is all there is to do."""
        return [(s, state["w"][i], float(state["loss"][i]), True) for i, s in enumerate(self.seeds)]


class LogisticDescent(GradientMethod):
    """Cross-entropy of sigmoid((x0 - x1)·w) against the label."""

    name, supervised = "lr_gd", True

    def totals(self, w, x0, x1, y):
        x = x0 - x1
        z = x @ w.T
        loss = np.logaddexp(0, z) - y[:, None] * z
        g = (_sigmoid(z) - y[:, None]).T @ x
        return {"n": np.array([len(x)]), "loss": loss.sum(0), "g": g.ravel()}


class ContrastConsistency(GradientMethod):
    """Two sides' probabilities should add up to one and not both be one half."""

    name = "ccs_gd"

    def __init__(self, informative_loss: str = "min_sq", **kwargs):
        super().__init__(**kwargs)
        if informative_loss not in ("min_sq", "entropy"):
            raise ValueError("informative_loss is min_sq or entropy")
        self.informative_loss = informative_loss

    def totals(self, w, x0, x1, y):
        p0, p1 = _sigmoid(x0 @ w.T), _sigmoid(x1 @ w.T)
        d0, d1 = p0 * (1 - p0), p1 * (1 - p1)
        gap = p0 + p1 - 1
        if self.informative_loss == "min_sq":
            low = np.minimum(p0, p1)
            informative = low**2
            a0 = 2 * low * d0 * (p0 < p1)
            a1 = 2 * low * d1 * (p0 >= p1)
        else:
            l0, l1 = np.log(np.maximum(p0, 1e-300)), np.log(np.maximum(p1, 1e-300))
            informative = -p0 * l0 - p1 * l1
            a0, a1 = -(l0 + 1) * d0, -(l1 + 1) * d1
        g = (a0 + 2 * gap * d0).T @ x0 + (a1 + 2 * gap * d1).T @ x1
        return {
            "n": np.array([len(x0)]),
            "loss": (informative + gap**2).sum(0),
            "g": g.ravel(),
        }


class Reflection(GradientMethod):
    """Mirroring x0 on the plane normal to w should give x1.

    With z = unit(w): |x1 - H x0|² = |x1 - x0|² + 4 (x0·z)(x1·z), so no d x d matrix is formed.
    """

    name = "ccr"

    def totals(self, w, x0, x1, y):
        length = np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        z = w / length
        a, b = x0 @ z.T, x1 @ z.T
        square = ((x1 - x0) ** 2).sum(1, keepdims=True) + 4 * a * b
        dist = np.sqrt(np.maximum(square, 0))
        inverse = np.divide(1.0, dist, out=np.zeros_like(dist), where=dist > 0)
        gz = 2 * ((b * inverse).T @ x0 + (a * inverse).T @ x1)
        g = (gz - z * (z * gz).sum(1, keepdims=True)) / length
        return {"n": np.array([len(x0)]), "loss": dist.sum(0), "g": g.ravel()}


class BalancedLogistic(Method):
    """L2-regularised logistic regression on x0 - x1, classes weighed alike: Newton steps by conjugate gradients.

    Objective: |w|²/2 + C · sum of weighted losses, weight n / (2 · class size), no intercept. A pass over the
    rows gives the loss and gradient at ``w`` and the Hessian's product with ``v``, so what is summed is linear
    in the width. A Newton step takes a pass for the gradient and one per conjugate direction; the
    residual allowed shrinks with the gradient, which keeps the last steps quadratic.
    """

    name, supervised = "lr_sklearn", True

    def __init__(self, balanced: bool = True, c: float = 1.0, steps: int = 100, tol: float = 1e-8):
        self.balanced, self.c, self.steps, self.tol = balanced, c, steps, tol

    def cells(self, d):
        return 4 * d

    def start(self, d, anchor, n):
        return {"w": np.zeros((2, d)), "t": 0, "newton": 0, "done": False}

    def totals(self, w, x0, x1, y):
        x = x0 - x1
        out: Sums = {}
        for k in (0, 1):  # per class, because the weights need both class sizes first
            part = x[y == k]
            z = part @ w[0]
            p = _sigmoid(z)
            out[f"n{k}"] = np.array([len(part)])
            out[f"l{k}"] = np.array([(np.logaddexp(0, z) - k * z).sum()])
            out[f"g{k}"] = (p - k) @ part
            out[f"h{k}"] = (p * (1 - p) * (part @ w[1])) @ part
        return out

    def step(self, state, sums):
        w, v = state["w"]
        n0, n1 = sums["n0"][0], sums["n1"][0]
        weights = [1.0, 1.0]
        if self.balanced:
            weights = [(n0 + n1) / (2 * max(n0, 1)), (n0 + n1) / (2 * max(n1, 1))]
        weights = [self.c * x for x in weights]
        if "residual" in state:
            curved = v + sum(weights[k] * sums[f"h{k}"] for k in (0, 1))
            return self._conjugate(state, w, v, curved)
        loss = w @ w / 2 + sum(weights[k] * sums[f"l{k}"][0] for k in (0, 1))
        g = w + sum(weights[k] * sums[f"g{k}"] for k in (0, 1))
        if "loss" in state and loss > state["loss"] + 1e-12 * abs(loss):  # overshoot: go half way
            half = np.stack([(w + state["best"]) / 2, v])
            return self._next({**state, "w": half})
        size = float(g @ g)
        state = {**state, "loss": loss, "best": w}
        if size == 0:
            return {**state, "t": state["t"] + 1, "done": True, "converged": True}
        return {
            **state,
            "w": np.stack([w, -g]),
            "move": np.zeros_like(w),
            "residual": -g,
            "size": size,
            "enough": size * min(0.01, size) ** 2,
            "left": 2 * len(w) + 10,
            "t": state["t"] + 1,
        }

    def _conjugate(self, state, w, v, curved):
        """One conjugate direction; the Newton step is made when the residual is small enough."""
        rate = state["size"] / float(v @ curved)
        move = state["move"] + rate * v
        residual = state["residual"] - rate * curved
        size = float(residual @ residual)
        if size > state["enough"] and state["left"] > 1 and size > 1e-30 * float(move @ move):
            more = residual + size / state["size"] * v
            found = {"move": move, "residual": residual, "size": size, "left": state["left"] - 1}
            return {**state, **found, "w": np.stack([w, more]), "t": state["t"] + 1}
        rest = {k: x for k, x in state.items() if k not in ("residual", "move", "size")}
        small = bool(np.abs(move).max() < self.tol)
        return self._next({**rest, "w": np.stack([w + move, v]), "converged": small})

    def _next(self, state):
        newton = state["newton"] + 1
        done = state.get("converged", False) or newton > self.steps
        return {**state, "newton": newton, "t": state["t"] + 1, "done": done}

    def result(self, state):
        return [(0, state["w"][0], float(state["loss"]), state.get("converged", False))]


class Agglomeration(Method):
    """Two clusters of x1 - x0 by linkage on cosine distances; the direction is half their means' difference.

    Merges nearest clusters until two are left: exactly, by nearest-neighbour chains, for a group of at most
    ``exact`` rows, which always fits a task. A larger group is first summed up by the signs of its unit vectors
    on ``PLANES`` fixed random planes, and the cells' means are merged instead of rows: one pass over the rows,
    whose sums depend on the width only. The second cluster is the one without the first row in hash
    order (without the fullest cell). A zero difference is at distance one from all others.
    """

    name = "unsupervised_mass_mean"
    task_rows = 2048

    def __init__(self, linkage: str = "complete", exact: int = 2048):
        if linkage not in ("complete", "average", "single"):
            raise ValueError("linkage is complete, average or single")
        if exact < 2:
            raise ValueError("exact is 2 or more")
        self.linkage, self.exact = linkage, exact
        self.task_rows = exact

    def cells(self, d):
        return 2**PLANES * (2 * d + 1)

    def start(self, d, anchor, n):
        planes = np.zeros((0, d))
        if n > self.exact:
            planes = np.random.default_rng(0).normal(size=(PLANES, d))
        return {"w": planes, "t": 0, "done": False}

    def totals(self, w, x0, x1, y):
        delta = x1 - x0
        length = np.linalg.norm(delta, axis=1, keepdims=True)
        u = np.divide(delta, length, out=np.zeros_like(delta), where=length > 0)
        if len(w):
            place, cells = (u @ w.T > 0) @ (1 << np.arange(len(w))), 1 << len(w)
        else:
            place, cells = two_clusters(u, np.ones(len(u)), self.linkage).astype(int), 2
        n = np.bincount(place, minlength=cells)
        sums = {"n": n}
        for name, rows in (("u", u), ("delta", delta)):
            total = np.zeros((cells, rows.shape[1]))
            np.add.at(total, place, rows)
            sums[name] = total.ravel()
        return sums

    def step(self, state, sums):
        n = sums["n"]
        u, delta = (sums[k].reshape(len(n), -1) for k in ("u", "delta"))
        met = np.flatnonzero(n)
        u, delta, n = u[met], delta[met], n[met]
        side = np.arange(len(n)).astype(bool)
        if len(state["w"]):
            order = np.argsort(-n, kind="stable")  # the fullest cell counts as the first
            u, delta, n = u[order], delta[order], n[order]
            length = np.linalg.norm(u, axis=1, keepdims=True)
            units = np.divide(u, length, out=np.zeros_like(u), where=length > 0)
            side = two_clusters(units, n, self.linkage)
        halves = [~side, side] if side.any() else [~side, ~side]
        means = [delta[h].sum(0) / n[h].sum() for h in halves]
        # one minus the mean cosine to the own cluster's mean unit vector
        loss = 1 - sum(np.linalg.norm(u[h].sum(0)) for h in halves[: 1 + side.any()]) / n.sum()
        theta = (means[1] - means[0]) / 2
        return {**state, "theta": theta, "loss": float(loss), "t": state["t"] + 1, "done": True}

    def result(self, state):
        return [(0, state["theta"], state["loss"], True)]


def two_clusters(units: np.ndarray, sizes: np.ndarray, linkage: str) -> np.ndarray:
    """Which of the unit vectors are not in the cluster of the first, when two clusters are left.

    Follows chains of nearest neighbours; two clusters that are nearest to each other are merged, which for
    these linkages gives the same tree as always merging the nearest two. Ties go to the earlier row.
    """
    n = len(units)
    if n < 2:
        return np.zeros(n, bool)
    far = 1 - units @ units.T
    np.fill_diagonal(far, np.inf)
    sizes = sizes.astype(float).copy()
    owner = np.arange(n)
    alive = np.ones(n, bool)
    chain: list[int] = []
    for _ in range(n - 2):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            x = chain[-1]
            y = int(np.argmin(far[x]))
            if len(chain) > 1 and far[x, chain[-2]] <= far[x, y]:
                y = chain[-2]
                break
            chain.append(y)
        del chain[-2:]
        a, b = min(x, y), max(x, y)
        if linkage == "complete":
            new = np.maximum(far[a], far[b])
        elif linkage == "single":
            new = np.minimum(far[a], far[b])
        else:
            new = (sizes[a] * far[a] + sizes[b] * far[b]) / (sizes[a] + sizes[b])
        alive[b] = False
        new[~alive] = new[a] = np.inf
        far[a], far[:, a] = new, new
        far[b], far[:, b] = np.inf, np.inf
        sizes[a] += sizes[b]
        owner[owner == b] = a
    return owner != owner[0]


class TwoClusters(Method):
    """Two opposite clusters of x1 - x0 by cosine; the direction is half their means' difference.

    Starts from the first pair in hash order and its opposite, then alternates between assigning
    rows and averaging unit vectors until no row changes.
    """

    name = "two_means"

    def __init__(self, rounds: int = 100):
        self.rounds = rounds

    def start(self, d, anchor, n):
        return {"w": np.stack([-anchor, anchor]), "t": 0, "done": False}

    def totals(self, w, x0, x1, y):
        delta = x1 - x0
        length = np.linalg.norm(delta, axis=1, keepdims=True)
        u = np.divide(delta, length, out=np.zeros_like(delta), where=length > 0)
        centres = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        score = u @ centres.T
        second = score[:, 1] > score[:, 0]
        return {
            "n": np.array([(~second).sum(), second.sum()]),
            "u": np.concatenate([u[~second].sum(0), u[second].sum(0)]),
            "delta": np.concatenate([delta[~second].sum(0), delta[second].sum(0)]),
            "fit": np.array([(1 - score.max(1)).sum()]),
        }

    def step(self, state, sums):
        n = np.maximum(sums["n"], 1)[:, None]
        shape = state["w"].shape
        means = sums["delta"].reshape(shape) / n
        w = sums["u"].reshape(shape) / n
        empty = sums["n"] == 0
        w[empty] = state["w"][empty]
        same = np.allclose(w, state["w"], rtol=0, atol=1e-12)
        return {
            "w": w,
            "theta": (means[1] - means[0]) / 2,
            "loss": float(sums["fit"][0] / sums["n"].sum()),
            "t": state["t"] + 1,
            "done": bool(same or state["t"] + 1 >= self.rounds),
            "converged": bool(same),
        }

    def result(self, state):
        return [(0, state["theta"], state["loss"], state["converged"])]


# Extension point: a method is added by giving it a name here.
METHODS = {
    "lr_sklearn": BalancedLogistic,
    "lr_gd": LogisticDescent,
    "ccs_gd": ContrastConsistency,
    "ccr": Reflection,
    "unsupervised_mass_mean": Agglomeration,
    "two_means": TwoClusters,
}


# --- running a method ----------------------------------------------------------------------


def _schema(pairs: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [pairs.schema[k] for k in keys]
        + [
            T.StructField("seed", T.LongType()),
            T.StructField("direction", T.ArrayType(T.DoubleType())),
            T.StructField("train_loss", T.DoubleType()),
            T.StructField("converged", T.BooleanType()),
        ]
    )


def _fit_in_tasks(pairs: DataFrame, keys: list[str], method) -> DataFrame:
    """One task per small group: the group's matrices are in memory while it iterates."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_k", kind="stable")
        x0, x1 = np.stack(group["x0"].to_list()), np.stack(group["x1"].to_list())
        y = group["y"].to_numpy(dtype=float)
        state = method.start(x0.shape[1], x1[0] - x0[0], len(y))
        batches = method.batches(len(y))
        size = len(y) if batches == 1 and method.batch_size < 0 else min(method.batch_size, len(y))
        while not state["done"]:
            at = state["t"] % batches * size
            part = slice(at, at + size)
            state = method.step(state, method.totals(state["w"], x0[part], x1[part], y[part]))
        rows = method.result(state)
        out = pd.concat([group[keys].head(1)] * len(rows), ignore_index=True)
        out["seed"] = [r[0] for r in rows]
        out["direction"] = [r[1] for r in rows]
        out["train_loss"] = [r[2] for r in rows]
        out["converged"] = [r[3] for r in rows]
        return out

    return pairs.groupBy(*keys).applyInPandas(fit, _schema(pairs, keys))


def _spread_totals(data: DataFrame, method, weights: dict[int, np.ndarray]) -> dict[int, Sums]:
    """Sums of one iteration, added up by Spark over all partitions of all groups in the wave.

    They travel as arrays of ``CHUNK_CELLS`` numbers, a row per task and chunk.
    """
    shared = data.sparkSession.sparkContext.broadcast(weights)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Sums] = {}
        for batch in batches:
            for g, part in batch.groupby("_g", sort=False):
                got = method.totals(
                    shared.value[g],
                    np.stack(part["x0"].to_list()),
                    np.stack(part["x1"].to_list()),
                    part["y"].to_numpy(dtype=float),
                )
                if g in sums:
                    got = {k: sums[g][k] + v for k, v in got.items()}
                sums[g] = got
        for g, entry in sums.items():
            for name, cells in entry.items():
                for at in range(0, len(cells), CHUNK_CELLS):
                    part = cells[at : at + CHUNK_CELLS].astype(float)
                    yield pd.DataFrame({"_g": [g], "name": [name], "at": [at], "cells": [part]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = group.head(1).copy()
        out["cells"] = [np.sum(np.stack(group["cells"].to_list()), axis=0)]
        return out

    kind = "_g long, name string, at long, cells array<double>"
    parts = data.mapInPandas(partial, kind)
    cells = parts.groupBy("_g", "name", "at").applyInPandas(add, kind).toPandas()
    shared.unpersist()
    out: dict[int, Sums] = {}
    for (g, name), part in cells.groupby(["_g", "name"]):
        out.setdefault(int(g), {})[name] = np.concatenate(part.sort_values("at")["cells"].to_list())
    return out


def _fit_spread(
    pairs: DataFrame, large: list[dict[str, Any]], keys: list[str], method
) -> DataFrame:
    """Large groups in waves: their rows stay distributed, only per-iteration sums are collected."""
    spark = pairs.sparkSession
    schema = _schema(pairs, keys)
    width = max(w["_d"] for w in large)
    per_wave = max(1, WAVE_CELLS // max(method.cells(width), 1))
    fitted: list[DataFrame] = []
    for at in range(0, len(large), per_wave):
        wave = large[at : at + per_wave]
        ids = spark.createDataFrame(
            [(*[w[k] for k in keys], g) for g, w in enumerate(wave)],
            T.StructType([pairs.schema[k] for k in keys] + [T.StructField("_g", T.LongType())]),
        )
        rows = pairs.join(F.broadcast(ids), keys).select("_g", "_k", "y", "x0", "x1")
        if method.batch_size > 0:
            rows = hash_rank(rows, ["_g"], F.col("_k"), [], "_place")
            rows = rows.withColumn("_batch", F.floor((F.col("_place") - 1) / method.batch_size))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        first = rows.groupBy("_g").agg(F.min_by(minus("x1", "x0"), "_k").alias("anchor"))
        states = {
            r["_g"]: method.start(wave[r["_g"]]["_d"], np.array(r["anchor"]), wave[r["_g"]]["_n"])
            for r in first.collect()
        }
        while True:
            open_groups = {g: s["w"] for g, s in states.items() if not s["done"]}
            if not open_groups:
                break
            live = rows.filter(F.col("_g").isin(list(open_groups)))
            if method.batch_size > 0:
                now = [
                    (g, states[g]["t"] % method.batches(wave[g]["_n"])) for g in open_groups
                ]
                batch = F.create_map(*[F.lit(x) for pair in now for x in pair])
                live = live.filter(F.col("_batch") == batch[F.col("_g").cast("int")])
            for g, sums in _spread_totals(live, method, open_groups).items():
                states[g] = method.step(states[g], sums)
        rows.unpersist()
        done = [
            (*[wave[g][k] for k in keys], seed, [float(x) for x in w], loss, converged)
            for g, s in states.items()
            for seed, w, loss, converged in method.result(s)
        ]
        fitted.append(settle(spark.createDataFrame(done, schema), "fitted"))
    out = fitted[0]
    for more in fitted[1:]:
        out = out.unionByName(more)
    return out


def fit_pairs(
    pairs: DataFrame, keys: list[str], method, task_cells: int = TASK_CELLS
) -> DataFrame:
    """``keys, seed, direction, train_loss, converged`` for every group of ``(sample_id, y, x0, x1)`` rows.

    Both ways run the same steps, so a group's size decides nothing but where it is fitted.
    ``converged`` tells whether a method with a stop rule met it before its last round.
    """
    if method.supervised:
        pairs = pairs.filter("y is not null")
    rows = pairs.select(
        *keys, order_key(0, "sample_id").alias("_k"), F.col("y").cast("double"), "x0", "x1"
    )
    sizes = settle(
        rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.size("x0")).alias("_d")),
        "group-sizes",
    )
    is_large = (F.col("_n") * F.col("_d") > task_cells) & (F.col("_n") > method.task_rows)
    large = [r.asDict() for r in sizes.filter(is_large).collect()]
    if not large:
        return _fit_in_tasks(rows, keys, method)
    small = attach(rows, sizes.filter(~is_large).select(*keys), keys, ["_k"])
    spread = _fit_spread(rows, large, keys, method)
    return _fit_in_tasks(small, keys, method).unionByName(spread)


# --- methods -------------------------------------------------------------------------------


def fit(states: DataFrame, keys: list[str], method: str, **params) -> DataFrame:
    """Fit a registered iterative method on the states' pairs."""
    task_cells = params.pop("task_cells", TASK_CELLS)
    return fit_pairs(sides(states), keys, METHODS[method](**params), task_cells)


def fit_mass_mean(states: DataFrame, keys: list[str], iid: bool = False) -> DataFrame:
    """Mean difference; with ``iid`` tilted by the pseudo-inverse of the class covariance.

    The covariance is RᵀR / (n - 1) of the centred vectors' triangular factor, so its eigenvectors and the roots
    of its eigenvalues are R's singular vectors and values; no covariance is formed.
    """
    difference = mean_difference(states, keys).select(*keys, "direction")
    if not iid:
        return difference
    listed = T.ArrayType(T.DoubleType())
    heads = [states.schema[k] for k in keys]
    factor = T.StructType([*heads, T.StructField("values", listed), T.StructField("basis", listed)])

    def spectrum(n: int, r: np.ndarray) -> list[pa.Array]:
        _, s, v = np.linalg.svd(r, full_matrices=False)
        values = s * s / max(n - 1, 1)
        kept = values > SMALL_EIGENVALUE
        return [pa.array([x], pa.list_(pa.float64())) for x in (values[kept], v[kept].ravel())]

    spectra = triangular_factor(class_centred(states, keys), keys, "vec", spectrum, factor)
    schema = T.StructType([*heads, T.StructField("direction", listed)])

    def tilt(key: tuple, found: pd.DataFrame, mean: pd.DataFrame) -> pd.DataFrame:
        if not len(mean) or not len(found):
            return pd.DataFrame(columns=[*keys, "direction"])
        values, m = np.asarray(found["values"].iloc[0]), np.asarray(mean["direction"].iloc[0])
        basis = np.asarray(found["basis"].iloc[0]).reshape(len(values), len(m))
        out = mean[keys].head(1).copy()
        out["direction"] = [((basis @ m) / values) @ basis]
        return out

    return spectra.groupBy(*keys).cogroup(difference.groupBy(*keys)).applyInPandas(tilt, schema)


def fit_ccs_linear(states: DataFrame, keys: list[str], priority: float = 5.0) -> DataFrame:
    """Linearised contrast consistency from one triangular factor, never an n x n one.

    With the factor of the rows (D, x0), D = x1 - x0: its upper left block has D's singular values and right
    vectors, and its upper right block is the projection of x0 on D's column space.
    """
    rows = sides(states).select(*keys, F.concat(minus("x1", "x0"), "x0").alias("_both"))
    schema = T.StructType([rows.schema[k] for k in keys])
    schema = schema.add("direction", T.ArrayType(T.DoubleType())).add("converged", T.BooleanType())

    def solve(n: int, r: np.ndarray) -> list[pa.Array]:
        h, v = consistency_form(r, priority)
        z, converged = _smallest_above_one(h)
        return [pa.array([z @ v.T], pa.list_(pa.float64())), pa.array([converged])]

    return triangular_factor(rows, keys, "_both", solve, schema)


def consistency_form(r: np.ndarray, priority: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """The quadratic form over the coefficients of a direction, and the basis they refer to.

    ``r`` has the rows (D, x0), or those of their triangular factor.
    """
    d = r.shape[1] // 2
    u, s, vt = np.linalg.svd(r[:, :d], full_matrices=False)
    kept = s >= s.max() * d * np.finfo(np.float32).eps
    u, v = u[:, kept], vt[kept].T
    b = u.T @ r[:, d:] @ v
    a = b + u.T @ r[:, :d] @ v
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    closeness = (a * b).sum(1) / (na * nb)
    c = (a + b) / ((na + nb) ** (priority * closeness))[:, None]
    return c.T @ c, v


def _smallest_above_one(h: np.ndarray, rounds: int = 2000) -> tuple[np.ndarray, bool]:
    """Coordinate descent for the least z·H·z with every z at least one, and whether it settled."""
    z = np.ones(len(h))
    for _ in range(rounds):
        before = z.copy()
        for i in range(len(h)):
            if h[i, i] > 0:
                z[i] = max(1.0, z[i] - (h[i] @ z) / h[i, i])
        if np.abs(z - before).max() < 1e-12:
            return z, True
    return z, False


def select_best(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the probe with the lowest training loss (lowest seed on a tie)."""
    rest = [c for c in probes.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("train_loss", "seed"))
    return probes.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def train(states: DataFrame, method: str, keys: list[str], **params) -> DataFrame:
    """Probes table of one method; a direction with a NaN is an error.

    ``keys`` are the training groups, with ``variant`` renamed to ``train_variant`` in the result.
    """
    if method.startswith("mass_mean"):
        found = fit_mass_mean(states, keys, iid=method.endswith("iid"))
        found = found.withColumn("seed", F.lit(0).cast("bigint")).withColumn(
            "train_loss", F.lit(None).cast("double")
        )
        found = found.withColumn("converged", F.lit(True))
    elif method == "ccs_linear":
        found = fit_ccs_linear(states, keys, **params)
        found = found.withColumn("seed", F.lit(0).cast("bigint")).withColumn(
            "train_loss", F.lit(None).cast("double")
        )
    else:
        found = fit(states, keys, method, **params)
        if len(METHODS[method](**{k: v for k, v in params.items() if k != "task_cells"}).seeds) > 1:
            found = select_best(found, keys)
    bad = F.exists("direction", lambda x: F.isnan(x))
    valid = F.assert_true(~bad, F.lit("a direction holds a NaN"))
    return (
        found.filter(valid.isNull())
        .withColumn("method", F.lit(method))
        .withColumnRenamed("variant", "train_variant")
    )
