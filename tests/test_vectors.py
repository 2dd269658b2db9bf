"""Vector-table operators on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from premisa.operators import fit, score, vectors
from premisa.sources.staging import settle

NAN, INF = float("nan"), float("inf")
SCHEMA = (
    "dataset string, model string, variant string, layer int, sample_id long, side int, y int, "
    "vec array<double>"
)
KEYS = ["dataset", "model", "variant", "layer"]


def make(spark, n, variants=("a",), layers=(1,), first=0):
    rows = [
        ("d", "m", v, layer, first + i, side, i % 2, [float(i + side), float(i * layer)])
        for v in variants for layer in layers for i in range(n) for side in (0, 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_half_split(spark, n):
    got = vectors.half_split(make(spark, n, ("a", "b"), (1, 2))).collect()
    assert len(got) == n * 8
    for r in got:
        assert r["split"] == ("train" if r["sample_id"] < n // 2 else "eval")


def test_centre_ignores_non_finite_but_keeps_it(spark):
    rows = [("d", "m", "a", 1, i, s, 0, [x]) for i, x in enumerate([1.0, INF, 3.0, NAN]) for s in (0, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("split", F.lit("train"))
    got = vectors.center(df).filter("side = 0").orderBy("sample_id").collect()
    values = [r["vec"][0] for r in got]
    assert values[0] == -1.0 and values[1] == INF and values[2] == 1.0 and np.isnan(values[3])


def test_centre_and_scale(spark):
    df = vectors.half_split(make(spark, 8))
    for scale in (False, True):
        pdf = vectors.center(df, scale=scale).toPandas()
        for _, part in pdf.groupby(["split", "side"]):
            x = np.stack(part["vec"])
            np.testing.assert_allclose(x.mean(0), 0, atol=1e-12)
            if scale:
                np.testing.assert_allclose(x.std(0, ddof=1), 1)


def test_centre_fitted_on_train(spark):
    df = vectors.half_split(make(spark, 8))
    pdf = vectors.center(df, fit_on="train").toPandas()
    train = np.stack(pdf[(pdf.split == "train") & (pdf.side == 0)]["vec"])
    other = np.stack(pdf[(pdf.split == "eval") & (pdf.side == 0)]["vec"])
    np.testing.assert_allclose(train.mean(0), 0, atol=1e-12)
    assert (other.mean(0) > 1).all()


def test_centre_the_same_when_the_statistics_are_not_broadcast(spark, monkeypatch):
    df = vectors.half_split(make(spark, 10, ("a", "b"), (1, 2, 3)))
    order = ["variant", "layer", "sample_id", "side"]
    want = vectors.center(df).orderBy(*order).collect()
    real = vectors.in_waves
    for limit in (0, 500):  # a wave per layer, then fewer
        monkeypatch.setattr(vectors, "in_waves", lambda *a, limit=limit: real(*a, limit=limit))
        assert vectors.center(df).select(*want[0].asDict()).orderBy(*order).collect() == want


def test_quota(spark):
    quotas = {"a": 3, "b": 10**6}
    df = make(spark, 20, ("a", "b", "c")).filter("side = 0")
    got = vectors.quota_sample(df, [], "variant", quotas, ["sample_id"], 0).collect()
    assert sum(r["variant"] == "a" for r in got) == 3
    assert sum(r["variant"] == "b" for r in got) == 20
    assert not any(r["variant"] == "c" for r in got)
    small = vectors.quota_sample(df, [], "variant", {"a": 3, "b": 20}, ["sample_id"], 0).collect()
    key = lambda r: (r["variant"], r["sample_id"])
    assert sorted(map(key, got)) == sorted(map(key, small))


def test_combine_drops_labels_of_unsupervised_parts(spark):
    df = vectors.half_split(make(spark, 20, ("a", "b")))
    got = vectors.combine(df, {"a": (4, True), "b": (4, False)}).collect()
    assert len(got) == 16
    assert all(r["y"] is None for r in got if r["variant"] == "b")
    assert all(r["y"] is not None for r in got if r["variant"] == "a")
    per_sample = {}
    for r in got:
        per_sample.setdefault((r["variant"], r["sample_id"]), set()).add(r["side"])
    assert all(s == {0, 1} for s in per_sample.values())


@pytest.mark.parametrize(
    "mask, shift, want",
    [([1, 1, 0, 0], False, 2), ([1, 1], False, 2), ([0, 1], False, 0), ([1, 1, 0], True, 1), ([1, 1], True, 1)],
)
def test_first_pad(spark, mask, shift, want):
    df = spark.createDataFrame([(mask,)], "m array<int>")
    assert df.select(vectors.first_pad("m", shift)).first()[0] == want


def test_token_vector(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert df.select(vectors.token_vector("t", "m", -1)).first()[0] == [2.0]
    assert df.select(vectors.token_vector("t", "m", -2)).first()[0] == [1.0]
    assert df.select(vectors.token_vector("t", "m", 0)).first()[0] == [1.0]
    assert df.select(vectors.token_vector("t", "m", -3)).first()[0] is None
    with pytest.raises(ValueError):
        vectors.token_vector("t", "m", 1)
    masked = df.select(vectors.masked_tokens("t", "m")).first()[0]
    assert masked == [[1.0], [2.0], [-INF]]


def test_quarantine(spark):
    rows = [("d", "m", "a", 1, 1, 0, 0, [1.0]), ("d", "m", "a", 1, 2, 0, 0, [NAN]), ("d", "m", "a", 1, 3, 0, 0, None)]
    clean, bad = vectors.split_clean(spark.createDataFrame(rows, SCHEMA))
    assert [r["sample_id"] for r in clean.collect()] == [1]
    assert sorted(r["sample_id"] for r in bad.collect()) == [2, 3]


def test_ingest_rounds_to_32_bits_and_picks_a_layer(spark):
    rows = [("d", "m", "a", layer, 1, 0, 0, [0.1]) for layer in (0, 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = vectors.ingest_states([df.filter("layer < 2"), df.filter("layer = 2")], layer=2).collect()
    assert len(got) == 1 and got[0]["vec"][0] == float(np.float32(0.1))


def test_steer(spark):
    states = make(spark, 2).withColumn("is_answer", F.col("sample_id") == 0).withColumn("is_period", F.col("side") == 1)
    probes = spark.createDataFrame([("d", "m", 1, [3.0, 4.0], -1, 10.0)], "dataset string, model string, layer int, direction array<double>, sign int, length double")
    probes = settle(probes, "p")
    moved = {(r["sample_id"], r["side"]): r["vec"] for r in vectors.steer(states, probes, -1, on_answer=True).collect()}
    assert moved[(0, 0)] == pytest.approx([6.0, 8.0])  # -1 · -1 · 10 · (0.6, 0.8)
    assert moved[(1, 0)] == [1.0, 1.0]
    both = {(r["sample_id"], r["side"]): r["vec"] for r in vectors.steer(states, probes, 1, True, True).collect()}
    assert both[(1, 1)] == pytest.approx([2.0 - 6.0, 1.0 - 8.0]) and both[(1, 0)] == [1.0, 1.0]
    with pytest.raises(ValueError):
        vectors.steer(states, probes, 1)


def test_answer_logits(spark):
    values = spark.createDataFrame([(1, 0, "x", 2.0), (1, 1, "y", 4.0), (1, 1, "z", 9.0)], "id long, pos int, token string, value double")
    answers = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "id long, pos int, token string")
    assert vectors.answer_logits(values, answers, ["id"]).first()["logit"] == 3.0


def test_check_labels(spark):
    rows = [("d", 1, 0), ("d", 1, 0), ("d", 2, 1), ("e", 1, 0), ("e", 1, 1)]
    df = spark.createDataFrame(rows, "dataset string, sample_id long, label int")
    got = {r["dataset"]: (r["samples"], r["consistent"]) for r in vectors.check_labels(df, ["dataset"]).collect()}
    assert got == {"d": (2, True), "e": (1, False)}


def test_wide_vectors_are_summed_without_exploding(spark):
    """Width 2,048 on few rows: equal to numpy, and neither vectors nor coordinates are shuffled."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (12, 2048))
    rows = [("d", "m", "v", 1, i // 2, i % 2, (i // 4) % 2, "train", x[i].tolist()) for i in range(12)]
    states = spark.createDataFrame(
        rows,
        "dataset string, model string, variant string, layer int, sample_id long, side int, y int, "
        "split string, vec array<double>",
    ).repartition(3)
    centred = vectors.center(states)
    text = centred._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in text
    got = {(r["sample_id"], r["side"]): r["vec"] for r in centred.collect()}
    for side in (0, 1):
        want = x[side::2] - x[side::2].mean(axis=0)
        for s in range(6):
            np.testing.assert_allclose(got[s, side], want[s], atol=1e-12)
    stats = vectors.vector_stats(states, ["layer"], std=True).first()
    np.testing.assert_allclose(stats["std"], x.std(axis=0, ddof=1), rtol=1e-10)
    y, side = np.array([(i // 4) % 2 for i in range(12)]), np.arange(12) % 2
    difference = vectors.mean_difference(states, ["layer"]).first()
    want = x[side == y].mean(axis=0) - x[side != y].mean(axis=0)
    np.testing.assert_allclose(difference["direction"], want, atol=1e-12)
    gram = vectors.gram(states, ["layer"], "vec", "vec").orderBy("i").collect()
    np.testing.assert_allclose([r["row"][:5] for r in gram[:5]], (x.T @ x)[:5, :5], atol=1e-10)
    assert gram[0]["n"] == 12 and len(gram) == 2048


def test_moments_with_nulls_and_infinity(spark):
    rows = [(None, [1.0, float("inf")]), (None, [3.0, 4.0]), ("b", [5.0, NAN])]
    states = spark.createDataFrame(rows, "k string, vec array<double>")
    got = {r["k"]: r["mean"] for r in vectors.vector_stats(states, ["k"]).collect()}
    assert got == {None: [2.0, 4.0], "b": [5.0, None]}
    two = spark.createDataFrame([("b", [5.0, NAN]), ("b", [7.0, 1.0])], "k string, vec array<double>")
    std = vectors.vector_stats(two, ["k"], std=True).first()["std"]
    assert std[0] == pytest.approx(2**0.5) and np.isnan(std[1])


def test_a_side_met_twice_fails(spark):
    rows = [("v", 1, 0, 1, [1.0]), ("v", 1, 1, 1, [2.0]), ("v", 1, 1, 1, [3.0])]
    states = spark.createDataFrame(rows, "variant string, sample_id int, side int, y int, vec array<double>")
    with pytest.raises(Exception, match="side met twice"):
        vectors.sides(states).collect()


def moved_columns(df):
    """Columns of all shuffles of a plan, with their types."""
    plan = df._jdf.queryExecution().executedPlan()
    found, open_ = [], [plan.initialPlan() if hasattr(plan, "initialPlan") else plan]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            out = node.output()
            found += [(out.apply(i).name(), out.apply(i).dataType().catalogString()) for i in range(out.size())]
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return found


def moves_vectors(df):
    return any(kind == "array<double>" for _, kind in moved_columns(df))


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_a_clustered_table_leaves_its_vectors_where_they_are(spark, broadcast):
    """From ingest on, no exchange of split, centring, sides, evaluation or mixing carries a vector."""
    plain = make(spark, 40, ("a", "b"), (1, 2))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert moves_vectors(vectors.sides(plain)) and moves_vectors(vectors.half_split(plain).repartition(2))
        stored = vectors.cluster(plain)
        split = vectors.half_split(stored)
        centred = vectors.center(split)
        again = vectors.cluster(centred, "centred", spread=False)
        pairs = vectors.sides(again.filter("split = 'eval'"))
        mixed = vectors.combine(again, {"a": (9, True), "b": (9, False)})
        assert not any(moves_vectors(x) for x in (split, centred, pairs, mixed))
        assert broadcast == "10MB" or "sample_id" in dict(moved_columns(split))
        want = vectors.sides(vectors.center(vectors.half_split(plain)).filter("split = 'eval'"))
        order = ["variant", "layer", "sample_id"]
        assert pairs.orderBy(*order).collect() == want.select(*pairs.columns).orderBy(*order).collect()
        assert mixed.count() == 9 * 2 * 2 * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_lone_side_is_left_out(spark):
    """As after a quarantine: the whole chain goes on with the samples that are left."""
    rng = np.random.default_rng(3)
    rows = [r.asDict() for r in make(spark, 12, ("original_pos_prem", "no_prem")).collect()]
    for r in rows:
        r["vec"] = (rng.normal(0, 1, 2) + [3.0 * (r["side"] == r["y"]), 0.0]).tolist()
    rows[3]["vec"] = [NAN, 1.0]  # sample 1, positive
    rows[8]["vec"] = None  # sample 4, negative
    clean, bad = vectors.split_clean(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA))
    assert bad.count() == 2
    pairs = vectors.sides(clean).filter("variant = 'original_pos_prem'").collect()
    assert sorted(r["sample_id"] for r in pairs) == [0, 2, 3, *range(5, 12)]
    split = settle(vectors.center(vectors.half_split(clean)), "clean")
    train = split.filter("split = 'train'")
    probes = settle(fit.train(train, "lr_sklearn", KEYS), "probes")
    params = score.calibration_params(
        probes, train.withColumnRenamed("variant", "train_variant"), train.filter("variant = 'no_prem'")
    )
    scored = score.evaluate(split, settle(params, "params"))
    assert {r["sample_id"] for r in scored.collect()} == set(range(6, 12))
    assert all(0 <= r["prediction"] <= 1 for r in scored.collect())


def test_partial_sums_of_many_tasks(spark, monkeypatch):
    """2,000 partitions and few open groups: the merged moments and products are those of all rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(3, 1, (400, 5))
    rows = [(i % 3 if i % 3 else None, x[i].tolist()) for i in range(400)]
    states = spark.createDataFrame(rows, "k int, vec array<double>").repartition(2000)
    monkeypatch.setattr(vectors, "PARTIAL_CELLS", 30)
    stats = {r["k"]: r for r in vectors.vector_stats(states, ["k"], std=True).collect()}
    products = {}
    for r in vectors.gram(states.coalesce(100), ["k"], "vec", "vec").collect():
        products.setdefault(r["k"], {})[r["i"]] = (r["n"], r["row"])
    assert set(stats) == set(products) == {None, 1, 2}
    for k in stats:
        own = x[[i for i in range(400) if (i % 3 or None) == k]]
        np.testing.assert_allclose(stats[k]["mean"], own.mean(0), rtol=1e-12)
        np.testing.assert_allclose(stats[k]["std"], own.std(0, ddof=1), rtol=1e-12)
        np.testing.assert_allclose([products[k][i][1] for i in range(5)], own.T @ own, rtol=1e-12)
        assert {n for n, _ in products[k].values()} == {len(own)}


def test_partial_sums_without_keys(spark):
    states = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "vec array<double>").repartition(2)
    assert vectors.vector_stats(states, []).first()["mean"] == [2.0, 3.0]
