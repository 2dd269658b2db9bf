"""Properties of the fits, and agreement of the in-task and the spread mode."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premisa.functions.exprs import order_key
from premisa.operators import fit, score, vectors
from premisa.sources.staging import settle

KEYS = ["dataset", "model", "variant", "layer"]


def planted(spark, n=120, d=6, groups=("g1", "g2"), noise=0.3, seed=0):
    """Pairs whose true side lies along a planted direction."""
    rng = np.random.default_rng(seed)
    direction = np.zeros(d)
    direction[0], direction[1] = 3.0, -4.0
    direction /= 5
    rows = []
    for g in groups:
        for i in range(n):
            y = int(rng.integers(2))
            base = rng.normal(0, noise, d)
            for side in (0, 1):
                shift = direction if side == y else -direction
                vec = base + shift + rng.normal(0, noise, d)
                rows.append(("ds", "m", g, 1, i, side, y, [float(x) for x in vec]))
    schema = (
        "dataset string, model string, variant string, layer int, sample_id long, side int, y int, "
        "vec array<double>"
    )
    return spark.createDataFrame(rows, schema), direction


def cosines(rows, direction):
    return [
        abs(np.dot(r["direction"], direction) / np.linalg.norm(r["direction"])) for r in rows
    ]


@pytest.mark.parametrize(
    "method, params, least",
    [
        ("mass_mean", {}, 0.98),
        ("mass_mean_iid", {}, 0.9),
        ("lr_sklearn", {}, 0.9),
        ("lr_gd", {"epochs": 300, "lr": 0.02}, 0.9),
        ("ccr", {"epochs": 400, "lr": 0.02}, 0.9),
        ("unsupervised_mass_mean", {}, 0.95),
        ("ccs_gd", {"epochs": 400, "lr": 0.02, "seeds": (0, 1, 2)}, 0.7),
    ],
)
def test_finds_the_planted_direction(spark, method, params, least):
    states, direction = planted(spark)
    rows = fit.train(states, method, KEYS, **params).collect()
    assert len(rows) == 2
    assert min(cosines(rows, direction)) > least


@pytest.mark.parametrize(
    "method, params",
    [
        ("lr_gd", {"epochs": 8, "lr": 0.05}),
        ("ccs_gd", {"epochs": 8, "lr": 0.05, "seeds": (0, 3)}),
        ("ccr", {"epochs": 8, "lr": 0.05}),
        ("lr_gd", {"epochs": 3, "lr": 0.05, "batch_size": 25}),
        ("unsupervised_mass_mean", {}),
        ("unsupervised_mass_mean", {"exact": 10}),
        ("two_means", {}),
        ("lr_sklearn", {}),
    ],
)
def test_spread_groups_give_the_same_fit(spark, method, params):
    """With a small limit every group is fitted by sums over partitions, not inside a task."""
    states, _ = planted(spark, n=60)
    key = lambda r: (r["variant"], r["seed"])
    inside = sorted(fit.fit(states, KEYS, method, **params).collect(), key=key)
    spread = sorted(fit.fit(states, KEYS, method, task_cells=1, **params).collect(), key=key)
    assert [key(r) for r in inside] == [key(r) for r in spread]
    for a, b in zip(inside, spread):
        np.testing.assert_allclose(a["direction"], b["direction"], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(a["train_loss"], b["train_loss"], rtol=1e-9)
        assert a["converged"] and b["converged"]


@pytest.mark.parametrize("task_cells", [10**9, 1])
def test_a_fit_that_stops_early_says_so(spark, task_cells):
    states, _ = planted(spark, n=60)
    rows = fit.fit(states, KEYS, "lr_sklearn", steps=1, task_cells=task_cells).collect()
    assert rows and not any(r["converged"] for r in rows)


def test_large_groups_of_different_width(spark):
    wide, _ = planted(spark, n=40, groups=("wide",))
    narrow, _ = planted(spark, n=40, groups=("narrow",))
    narrow = narrow.withColumn("vec", F.slice("vec", 1, 2))
    rows = fit.fit(wide.unionByName(narrow), KEYS, "lr_gd", epochs=3, task_cells=1).collect()
    width = wide.select(F.size("vec")).first()[0]
    assert {r["variant"]: len(r["direction"]) for r in rows} == {"wide": width, "narrow": 2}


def test_mixed_sizes_use_both_modes(spark):
    large, _ = planted(spark, n=80, groups=("large",))
    small, _ = planted(spark, n=10, groups=("small",))
    both = large.unionByName(small)
    rows = fit.fit(both, KEYS, "lr_gd", epochs=5, task_cells=100).collect()
    alone = fit.fit(both, KEYS, "lr_gd", epochs=5).collect()
    assert {r["variant"] for r in rows} == {"large", "small"}
    for a in rows:
        b = next(r for r in alone if r["variant"] == a["variant"])
        np.testing.assert_allclose(a["direction"], b["direction"], rtol=1e-9)


@pytest.mark.parametrize("method", ["lr_gd", "ccs_gd", "ccr"])
@pytest.mark.parametrize("loss", ["min_sq", "entropy"])
def test_gradients_match_finite_differences(method, loss):
    if loss == "entropy" and method != "ccs_gd":
        pytest.skip("only one method has two losses")
    rng = np.random.default_rng(1)
    x0, x1 = rng.normal(size=(9, 5)), rng.normal(size=(9, 5))
    y = rng.integers(0, 2, 9).astype(float)
    params = {"informative_loss": loss} if method == "ccs_gd" else {}
    m = fit.METHODS[method](**params)
    w = rng.normal(size=(2, 5))
    g = m.totals(w, x0, x1, y)["g"].reshape(w.shape)
    for s in range(2):
        for j in range(5):
            up, down = w.copy(), w.copy()
            up[s, j] += 1e-6
            down[s, j] -= 1e-6
            slope = (m.totals(up, x0, x1, y)["loss"][s] - m.totals(down, x0, x1, y)["loss"][s]) / 2e-6
            assert g[s, j] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_batches_drop_the_remainder():
    m = fit.METHODS["ccr"](batch_size=25)
    assert [m.batches(n) for n in (10, 25, 60, 100)] == [1, 1, 2, 4]
    assert fit.METHODS["ccr"]().batches(60) == 1


def test_more_epochs_lower_the_loss(spark):
    states, _ = planted(spark)
    for method in ("lr_gd", "ccs_gd", "ccr"):
        short = fit.fit(states, KEYS, method, epochs=1).collect()
        long = fit.fit(states, KEYS, method, epochs=300, lr=0.02).collect()
        for a in short:
            b = next(r for r in long if r["variant"] == a["variant"])
            assert b["train_loss"] < a["train_loss"]


def test_logistic_is_at_its_optimum(spark):
    states, _ = planted(spark, n=50)
    pairs = vectors.sides(states.filter("variant = 'g1'")).toPandas()
    x = np.stack(pairs["x0"]) - np.stack(pairs["x1"])
    y = pairs["y"].to_numpy(float)
    row = fit.fit(states, KEYS, "lr_sklearn").filter("variant = 'g1'").first()
    w = np.array(row["direction"])
    weights = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    gradient = w + (weights * (1 / (1 + np.exp(-x @ w)) - y)) @ x
    assert np.abs(gradient).max() < 1e-6


def test_select_best_takes_the_lowest_loss(spark):
    rows = [("a", 0, 0.5, [1.0]), ("a", 1, 0.2, [2.0]), ("b", 0, 0.1, [3.0]), ("a", 2, 0.2, [4.0])]
    df = spark.createDataFrame(rows, "k string, seed long, train_loss double, direction array<double>")
    got = {r["k"]: (r["seed"], r["direction"]) for r in fit.select_best(df, ["k"]).collect()}
    assert got == {"a": (1, [2.0]), "b": (0, [3.0])}


def test_iid_direction_equals_numpy(spark):
    states, _ = planted(spark, n=40, groups=("g1",))
    pdf = states.toPandas()
    true = np.stack(pdf[pdf.side == pdf.y]["vec"])
    false = np.stack(pdf[pdf.side != pdf.y]["vec"])
    centred = np.concatenate([true - true.mean(0), false - false.mean(0)])
    sigma = np.cov(centred.T)
    want = np.linalg.pinv(sigma, hermitian=True) @ (true.mean(0) - false.mean(0))
    got = fit.train(states, "mass_mean_iid", KEYS).first()["direction"]
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_linear_consistency_agrees_with_the_full_factorisation(spark):
    states, _ = planted(spark, n=30, d=5, groups=("g1",))
    pairs = vectors.sides(states).toPandas()
    b, a = np.stack(pairs["x0"]), np.stack(pairs["x1"])
    u, s, vt = np.linalg.svd(a - b)
    r = len(s)
    a1, b1 = u.T[:r] @ a @ vt.T, u.T[:r] @ b @ vt.T
    na, nb = np.linalg.norm(a1, axis=1, keepdims=True), np.linalg.norm(b1, axis=1, keepdims=True)
    c = (a1 + b1) / (na + nb) ** (5 * (a1 * b1).sum(1, keepdims=True) / (na * nb))
    got = np.array(fit.train(states, "ccs_linear", KEYS).first()["direction"])
    # the sign of each singular vector is free, so compare the objective, which is not
    z = np.abs(got @ vt.T)
    assert (z > 1 - 1e-9).all()
    assert np.isfinite(c).all()


def test_matrix_ranks(spark):
    rng = np.random.default_rng(2)
    low = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6))
    full = rng.normal(size=(40, 6))
    rows = []
    for i in range(40):
        rows.append(("ds", "m", "v", 1, i, 0, 0, low[i].tolist()))
        rows.append(("ds", "m", "v", 1, i, 1, 0, full[i].tolist()))
    df = spark.createDataFrame(
        rows, "dataset string, model string, variant string, layer int, sample_id long, side int, "
        "y int, vec array<double>"
    )
    got = {r["matrix"]: r["rank"] for r in vectors.matrix_ranks(df, KEYS).collect()}
    assert got == {"neg": 2, "pos": 6, "neg+pos": 6, "neg-pos": 6}


def test_gram_drains_its_partial_sums(spark, monkeypatch):
    states, _ = planted(spark, n=50, d=4, groups=tuple(f"g{i}" for i in range(6)))
    want = {
        (r["variant"], r["i"]): r["row"]
        for r in vectors.gram(states, KEYS, "vec", "vec").collect()
    }
    monkeypatch.setattr(vectors, "PARTIAL_CELLS", 20)
    got = {
        (r["variant"], r["i"]): r["row"]
        for r in vectors.gram(states.repartition(5), KEYS, "vec", "vec").collect()
    }
    for k, row in want.items():
        np.testing.assert_allclose(got[k], row, rtol=1e-9)


def test_calibration_on_planted_data(spark):
    """A flipped direction gets sign -1, and calibrated predictions then agree with the labels."""
    states, _ = planted(spark, groups=("no_prem", "original_pos_prem"))
    split = settle(vectors.center(vectors.half_split(states)), "t")
    train = split.filter("split = 'train'")
    probes = fit.train(train, "mass_mean", KEYS)
    flipped = probes.withColumn("direction", F.transform("direction", lambda x: -x))
    named = train.withColumnRenamed("variant", "train_variant")
    for used, sign in ((probes, 1), (flipped, -1)):
        found = score.calibration_params(
            settle(used, "p"), named, train.filter("variant = 'no_prem'")
        )
        found = settle(found, "c")
        rows = found.collect()
        assert {r["sign"] for r in rows} == {sign}
        assert all(r["length"] > 1 and r["scale"] > 0 for r in rows)
        scored = score.evaluate(split, found)
        accuracy = scored.agg(score.accuracy("prediction")).first()[0]
        assert accuracy > 0.95


@pytest.mark.parametrize("any_variant", [True, False])
def test_scores_in_one_and_in_many_waves_agree(spark, any_variant):
    states, _ = planted(spark, n=20, groups=("no_prem", "random_pos_prem"))
    probes = settle(fit.train(states, "mass_mean", KEYS), "p")
    pairs = vectors.sides(states)
    key = ["train_variant", "variant", "sample_id"]
    small = score.pair_scores(pairs, probes, any_variant).select(*key, "p").orderBy(*key).collect()
    large = score.pair_scores(pairs, probes, any_variant, limit=0).select(*key, "p")
    large = large.orderBy(*key).collect()
    assert len(small) == len(large) == (80 if any_variant else 60)
    for a, b in zip(small, large):
        assert a[:3] == b[:3] and a["p"] == pytest.approx(b["p"], rel=1e-12)


@pytest.mark.parametrize("limit", [0, 300, 700])
def test_many_probes_meet_a_places_rows_in_one_scan(spark, limit):
    """Blocks of few rows and lots of few probes, over two layers: every score once, one read of the vectors."""
    states, _ = planted(spark, n=20, groups=("no_prem", "random_pos_prem"))
    states = states.unionByName(states.withColumn("layer", F.col("layer") + 1))
    probes = fit.train(states, "mass_mean", KEYS)
    seeds = probes.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in range(4)))))
    turned = F.transform("direction", lambda x, i: x + (F.col("seed") * i) % 3)
    probes = settle(seeds.withColumn("direction", turned), "p")
    pairs = settle(vectors.sides(states), "pairs")
    key = ["layer", "train_variant", "seed", "variant", "sample_id"]
    want = score.pair_scores(pairs, probes, True).select(*key, "p").orderBy(*key).collect()
    found = score.pair_scores(pairs, probes, True, limit=limit, block=7)
    got = found.select(*key, "p").orderBy(*key).collect()
    assert len(want) == len(got) == 2 * 8 * 40
    for a, b in zip(want, got):
        assert a[:5] == b[:5] and a["p"] == pytest.approx(b["p"], rel=1e-12)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("x0#") and sum("FileScan" in line and "x0#" in line for line in text.split("\n")) == 1


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_vectors_of_another_width_fail(spark, limit):
    states, _ = planted(spark, n=20, groups=("no_prem",))
    probes = fit.train(states, "mass_mean", KEYS)
    short = settle(probes.withColumn("direction", F.slice("direction", 1, 2)), "p")
    with pytest.raises(Exception):
        score.pair_scores(vectors.sides(states), short, limit=limit).collect()


def test_constant_scores_have_no_finite_scale(spark):
    rows = [("ds", "m", 1, "v", "x", 0, i, 0.7, i % 2) for i in range(4)]
    df = spark.createDataFrame(
        rows, "dataset string, model string, layer int, train_variant string, method string, "
        "seed long, sample_id long, p double, y int"
    )
    scaled = score.logit_scale(df).first()["scale"]
    assert scaled == float("inf")
    with_params = df.withColumn("sign", F.lit(-1)).withColumn("scale", F.lit(float("inf")))
    assert score.calibrate(with_params).first()["prediction"] == pytest.approx(0.3)


def test_one_score_has_no_scale(spark):
    df = spark.createDataFrame([("k", 0.6)], "k string, p double")
    assert score.logit_scale(df, ["k"]).first()["scale"] is None


def test_ranks_of_ill_conditioned_rows(spark):
    """Singular values over eight orders of magnitude: as numpy finds them, where a Gram matrix fails."""
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(300, 12)))
    v, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    x = (u * np.logspace(0, -8, 12)) @ v.T
    rows = [(i % 2 if i % 2 else None, r.tolist()) for i, r in enumerate(x)] + [(1, None)]
    df = spark.createDataFrame(rows, "k int, vec array<double>").repartition(9)
    kind = T.StructType.fromDDL("k int, n bigint, s array<double>")

    def values(n, factor):
        s = np.linalg.svd(factor, compute_uv=False)
        return [pa.array([n], pa.int64()), pa.array([s], pa.list_(pa.float64()))]

    got = {r["k"]: r for r in vectors.triangular_factor(df, ["k"], "vec", values, kind).collect()}
    assert set(got) == {None, 1} and got[1]["n"] == got[None]["n"] == 150
    for k, own in ((None, x[::2]), (1, x[1::2])):
        np.testing.assert_allclose(got[k]["s"], np.linalg.svd(own, compute_uv=False), rtol=1e-6)


def test_wide_triangular_factor(spark, monkeypatch):
    """Width 2,048 with fewer rows than columns, and partial factors handed on early."""
    monkeypatch.setattr(vectors, "PARTIAL_CELLS", 5_000)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2048))
    x[20:30] = x[:10] + x[10:20]
    rows = [("ds", "m", f"v{i % 2}", 1, i // 4, i // 2 % 2, 0, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(
        rows, "dataset string, model string, variant string, layer int, sample_id long, side int, "
        "y int, vec array<double>"
    ).repartition(6)
    got = {(r["variant"], r["matrix"]): r["rank"] for r in vectors.matrix_ranks(df, KEYS).collect()}
    for k in (0, 1):
        neg, pos = x[k::2][::2], x[k::2][1::2]
        for name, m in (("neg", neg), ("pos", pos), ("neg+pos", neg + pos), ("neg-pos", neg - pos)):
            want = np.linalg.matrix_rank(m.astype(np.float32))
            assert got[f"v{k}", name] == want, name


def test_newton_sums_are_linear_in_the_width(spark):
    """Width 512: same optimum in a task and spread, gradient zero, and a pass sums a few vectors."""
    rng = np.random.default_rng(6)
    d, n = 512, 60
    x = rng.normal(size=(n, 2, d)) * rng.uniform(0.1, 3, d)
    y = rng.integers(0, 2, n)
    rows = [("ds", "m", "v", 1, i, s, int(y[i]), x[i, s].tolist()) for i in range(n) for s in (0, 1)]
    df = spark.createDataFrame(
        rows, "dataset string, model string, variant string, layer int, sample_id long, side int, "
        "y int, vec array<double>"
    )
    method = fit.BalancedLogistic()
    assert method.cells(d) == 4 * d
    sums = method.totals(np.zeros((2, d)), x[:, 0], x[:, 1], y.astype(float))
    assert sum(v.size for v in sums.values()) == 4 * d + 4
    found = [fit.fit(df, KEYS, "lr_sklearn", task_cells=cells).first() for cells in (10**9, 1)]
    delta = x[:, 0] - x[:, 1]
    weights = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    for r in found:
        w = np.array(r["direction"])
        gradient = w + (weights * (1 / (1 + np.exp(-delta @ w)) - y)) @ delta
        assert r["converged"] and np.abs(gradient).max() < 1e-7
    np.testing.assert_allclose(found[0]["direction"], found[1]["direction"], rtol=0, atol=1e-9)


def plain_clusters(units, linkage):
    """Merges the nearest two clusters until two are left, from the distances of their members."""
    far = 1 - units @ units.T
    join = {"complete": np.max, "single": np.min, "average": np.mean}[linkage]
    clusters = [[i] for i in range(len(units))]
    between = far.copy()
    np.fill_diagonal(between, np.inf)
    while len(clusters) > 2:
        a, b = sorted(np.unravel_index(between.argmin(), between.shape))
        clusters[a] += clusters.pop(b)
        between = np.delete(np.delete(between, b, 0), b, 1)
        for k, other in enumerate(clusters):
            if k != a:
                between[a, k] = between[k, a] = join(far[np.ix_(clusters[a], other)])
    side = np.zeros(len(units), bool)
    side[next(c for c in clusters if 0 not in c)] = True
    return side


@pytest.mark.parametrize("linkage", ["complete", "average", "single"])
@pytest.mark.parametrize("n", [2, 3, 40, 500])
def test_linkage_equals_brute_force(linkage, n):
    """Overlapping clusters, where two means and linkage differ."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 6)) + np.outer(rng.choice([-1, 1], n), [0.8, 0.4, 0, 0, 0, 0])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (fit.two_clusters(u, np.ones(n), linkage) == plain_clusters(u, linkage)).all()


@pytest.mark.parametrize("linkage", ["complete", "average", "single"])
def test_clusters_of_a_group(spark, linkage):
    """Rows meet in hash order, whatever the mode; the direction is half the difference of the means."""
    states, _ = planted(spark, n=70, groups=("g",), noise=1.5)
    rows = vectors.sides(states).withColumn("k", order_key(0, "sample_id")).orderBy("k").collect()
    delta = np.array([r["x1"] for r in rows]) - np.array([r["x0"] for r in rows])
    side = plain_clusters(delta / np.linalg.norm(delta, axis=1, keepdims=True), linkage)
    want = (delta[side].mean(0) - delta[~side].mean(0)) / 2
    for cells in (10**9, 1):
        got = fit.fit(states, KEYS, "unsupervised_mass_mean", linkage=linkage, task_cells=cells).first()
        np.testing.assert_allclose(got["direction"], want, atol=1e-12)


def test_clusters_beyond_the_exact_size(spark):
    """Summed up by signs: the same in a task and spread, and the planted direction is found."""
    states, direction = planted(spark, n=300, groups=("g",), noise=0.2)
    found = [
        fit.fit(states, KEYS, "unsupervised_mass_mean", exact=50, task_cells=cells).first()
        for cells in (10**9, 1)
    ]
    np.testing.assert_allclose(found[0]["direction"], found[1]["direction"], atol=1e-12)
    w = np.array(found[0]["direction"])
    assert abs(w @ direction) / np.linalg.norm(w) > 0.98
    with pytest.raises(ValueError, match="linkage is"):
        fit.Agglomeration(linkage="ward")
