"""Golden rows for the metrics and checks of the physical plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from premisa.catalogue import QUERIES
from premisa.catalogue import metric_queries as mq
from premisa.plans import causal, compare, grid, metrics, rank, results
from premisa.sources import fixtures as fx
from premisa.sources.catalog import MODELS, VARIANTS, model_catalog
from premisa.sources.staging import new_path

INF, NAN = float("inf"), float("nan")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def predictions(spark, rows, train="no_prem", method="ccr", layer=1):
    """rows: sample -> (label, {variant: prediction})"""
    data = [
        ("d", "m", s, label, v, train, layer, method, p)
        for s, (label, by) in rows.items()
        for v, p in by.items()
    ]
    return spark.createDataFrame(
        data, "dataset string, model string, sample_id long, label int, variant string, "
        "train_variant string, layer int, method string, prediction double"
    )


def variants(o, n, h, rp=0.5, rn=0.5, sp=0.5, sn=0.5):
    return dict(zip(VARIANTS, [o, n, sp, sn, rp, rn, h]))


def errors_of(spark, label, **kwargs):
    df = metrics.with_subgroups(predictions(spark, {1: (label, variants(**kwargs))}))
    return metrics.with_errors(metrics.wide_predictions(df.filter("subgroup = 'no-prem'"))).first()


def test_errors_of_one_sample(spark):
    e = errors_of(spark, 1, o=0.75, n=0.25, h=0.5, rp=0.625, rn=0.375, sp=0.5, sn=0.75)
    assert (e["error_1_pos"], e["error_1_neg"]) == (0.5, 0.5)
    assert (e["error_2_pos"], e["error_2_neg"]) == (0.0, 1.0)
    assert (e["error_3"], e["error_4"], e["error_3_4"]) == (0.0, 2.0, 2.0)
    assert (e["error_sv"], e["error_sv_0"], e["error_sv_1"]) == (0.0, 0.0, 0.0)


def test_supervised_error(spark):
    e = errors_of(spark, 0, o=0.75, n=0.25, h=0.5)
    assert (e["error_sv"], e["error_sv_0"], e["error_sv_1"]) == (0.25, 0.25, 0.0)
    e = errors_of(spark, 1, o=0.25, n=0.25, h=0.5)
    assert (e["error_sv"], e["error_sv_1"]) == (0.25, 0.25)


def test_no_premise_effect(spark):
    e = errors_of(spark, 1, o=0.5, n=0.25, h=0.5, rp=0.5, rn=0.6)
    assert math.isnan(e["error_1_pos"]) and e["error_1_neg"] == INF
    assert e["error_3"] == 0.0 and e["error_4"] == INF  # (n - h)/0 = -inf, clipped


def test_variant_met_twice_fails(spark):
    df = predictions(spark, {1: (1, variants(0.7, 0.2, 0.5))}).withColumn("subgroup", F.lit("x"))
    with pytest.raises(Exception, match="variant met twice"):
        metrics.variant_pivot(df.unionByName(df.filter("variant = 'no_prem'"))).collect()


def test_subgroups(spark):
    rows = {1: (1, variants(0.7, 0.2, 0.5))}
    own = predictions(spark, rows).withColumn("train_variant", F.col("variant"))
    got = metrics.with_subgroups(own).groupBy("subgroup").count().collect()
    assert {r["subgroup"]: r["count"] for r in got} == {"same": 7, "pos-prem": 1, "no-prem": 1}
    mixed = metrics.with_subgroups(predictions(spark, rows, train="combined"))
    assert {r["subgroup"] for r in mixed.collect()} == {"combined"}


def test_same_needs_more_than_two_runs(spark):
    """Two self-trained variants make no group, three make one, and then no cell may lack."""
    rows = {1: (1, variants(0.7, 0.2, 0.5)), 2: (0, variants(0.6, 0.1, 0.4))}
    base = predictions(spark, rows)
    own = base.withColumn("train_variant", F.col("variant"))
    two = base.unionByName(own.filter("variant = 'original_pos_prem'"))
    two = two.unionByName(base.withColumn("train_variant", F.lit("original_pos_prem")).filter(
        "variant <> 'original_pos_prem'"))
    got = metrics.error_scores(two).collect()
    assert sorted(r["subgroup"] for r in got) == ["no-prem", "pos-prem"]
    assert all(r["samples"] == 2 for r in got)
    three = two.unionByName(own.filter("variant = 'random_pos_prem'"))
    assert "same" in {r["subgroup"] for r in metrics.with_subgroups(three).collect()}
    with pytest.raises(Exception, match="variants missing: original_neg_prem, shuffle_pos_prem"):
        metrics.wide_predictions(metrics.with_subgroups(three)).collect()


@pytest.mark.parametrize("lost", VARIANTS)
def test_a_missing_cell_fails(spark, lost):
    rows = {s: (s % 2, variants(0.5 + s / 100, 0.3, 0.4)) for s in range(1, 5)}
    part = predictions(spark, rows).filter(f"variant <> '{lost}' or sample_id < 3")
    part = part.withColumn("subgroup", F.lit("no-prem"))
    with pytest.raises(Exception, match=f"variants missing: {lost}"):
        metrics.wide_predictions(part).collect()


def test_error_scores_end_to_end(spark):
    rows = {s: (s % 2, variants(0.5 + s / 100, 0.3, 0.4)) for s in range(1, 11)}
    got = metrics.error_scores(predictions(spark, rows)).collect()
    assert [r["subgroup"] for r in got] == ["no-prem"]  # one self-trained variant is not a group
    r = got[0]
    pe = [0.1 + s / 100 for s in range(1, 11)]
    assert r["premise_sensitivity"] == pytest.approx(sum(pe) / 10)
    e4 = sorted((0.2 + s / 100) / (0.1 + s / 100) for s in range(1, 11))
    assert r["trim_mean_error_4"] == pytest.approx(sum(e4[2:8]) / 6)
    assert r["median_error_4"] == pytest.approx((e4[4] + e4[5]) / 2)


def stats(spark, rows):
    """rows: (layer, method, error_1, accuracy); the other scores are constant."""
    names = [f"{a}_{e}" for a in metrics.AGGREGATES for e in metrics.RATIO_ERRORS]
    others = ["mean_error_sv", *[c for c in rank.SHOWN if c.startswith("p_h")]]
    data = [
        ("d", "m", layer, method, "same", acc, *[e1 if n.endswith("error_1") else 1.0 for n in names], *[0.5] * len(others))
        for layer, method, e1, acc in rows
    ]
    columns = ["accuracy_pos_prem", *names, *others]
    schema = "dataset string, model string, layer int, method string, subgroup string, " + ", ".join(
        f"{c} double" for c in columns
    )
    return spark.createDataFrame(data, schema)


def test_ranks_put_missing_last_and_break_ties(spark):
    df = stats(spark, [(1, "a", 2.0, 0.5), (2, "a", None, 0.6), (3, "a", 1.0, 0.7), (3, "b", 1.0, 0.7)])
    got = {
        (r["layer"], r["method"]): r["rank"]
        for r in rank.metric_ranks(df).filter("score = 'mean_error_1'").collect()
    }
    assert got == {(3, "a"): 1, (3, "b"): 2, (1, "a"): 3, (2, "a"): 4}


def test_logit_baseline_is_ranked_for_layer_one_only(spark):
    df = stats(spark, [(1, "lm_head", 2.0, 0.5), (2, "lm_head", 1.0, 0.9), (1, "ccr", 1.5, 0.5)])
    ranked = {(r["layer"], r["method"]): r["mean_error_1_rank"] for r in rank.with_ranks(df).collect()}
    assert ranked == {(1, "lm_head"): 2, (2, "lm_head"): None, (1, "ccr"): 1}
    best = {r["method"]: r["layer"] for r in rank.best_layer(rank.with_ranks(df), "avg_rank").collect()}
    assert best["lm_head"] == 1
    best = {r["method"]: r["layer"] for r in rank.best_layer(rank.with_ranks(df), "accuracy").collect()}
    assert best["lm_head"] == 2


def test_one_window_ranks_all_scores(spark, sf):
    text = plan(rank.metric_ranks(stats(spark, [(1, "a", 1.0, 0.5)])))
    assert text.count("Window [") == 1


def test_final_tables_are_written_per_group(spark, tmp_path):
    final = rank.final_table(stats(spark, [(1, "a", 1.0, 0.5), (2, "a", 0.5, 0.4)]))
    path = rank.write_final_tables(final, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(path)
    assert {(r["criterion"], r["layer"]) for r in back.collect()} == {
        ("accuracy", "1"),
        ("avg_rank", "1"),  # the ties of the other four scores go to the lower layer
    }


def test_pivot_needs_no_shuffle_of_the_predictions(spark, sf):
    """Samples are spread once, before they are multiplied by variants, layers and methods."""
    text = plan(metrics.variant_pivot(metrics.with_subgroups(fx.predictions(spark, sf))))
    shuffles = text.count("Exchange") - text.count("BroadcastExchange")
    assert shuffles == 1 and "REPARTITION_BY_NUM" in text


def test_columns_are_pruned_at_the_scan(spark, sf):
    text = plan(metrics.variant_pivot(metrics.with_subgroups(fx.predictions(spark, sf))))
    assert "o_totalprice" not in text and "o_custkey" not in text


@pytest.mark.parametrize("name", ["j4_similarity_across_datasets", "j5_similarity_across_layers",
                                  "j6_similarity_across_methods", "j7_similarity_across_variants"])
def test_pairs_are_equi_joins(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_query_plans_a_cartesian_product(spark, sf):
    for name in ("x13_error_scores", "p27_length_cap", "x23_run_grid", "e7_calibrated", "x19_before_after"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_layer_filter_prunes_partitions(spark, sf):
    path = new_path(spark, "states")
    fx.states(spark, sf).write.partitionBy("layer").parquet(path)
    text = plan(spark.read.parquet(path).filter("layer = 2"))
    assert "PartitionFilters: [isnotnull(layer" in text


def test_first_kept_is_cut_before_the_shuffle(spark):
    from premisa.functions.exprs import order_key
    from premisa.operators import prompts

    df = spark.range(100).withColumn("g", F.col("id") % 2)
    text = plan(prompts.first_kept(df, ["g"], order_key(0, "id"), ["id"], 5))
    assert text.count("WindowGroupLimit") == 2


def test_similarity_rejects_a_doubled_key(spark):
    rows = [("m", "d", "v", 1, "p", 1, [1.0, 0.0])] * 2
    df = spark.createDataFrame(rows, "model string, dataset string, data_variant string, layer int, probe_method string, sign int, direction array<double>")
    with pytest.raises(Exception, match="two directions under one key"):
        compare.signed_directions(df).collect()


def test_similarity_uses_the_sign(spark):
    rows = [("m", "d1", "v", 1, "p", 1, [1.0, 0.0]), ("m", "d2", "v", 1, "p", -1, [2.0, 0.0]), ("m", "d3", "v", 1, "p", 1, None)]
    df = spark.createDataFrame(rows, "model string, dataset string, data_variant string, layer int, probe_method string, sign int, direction array<double>")
    got = compare.across_datasets(compare.signed_directions(df)).collect()
    assert {(r["dataset1"], r["dataset2"]): r["similarity"] for r in got} == {("d1", "d2"): -1.0, ("d2", "d1"): -1.0}


def test_before_after(spark):
    rows = [
        ("d", "m", 1, "ccr", s, label, setting, p)
        for s, label, o, i in [(1, 1, 0.5, 0.25), (2, 1, 0.75, 0.0), (3, 0, 0.25, 0.5)]
        for setting, p in (("original", o), ("intervened", i))
    ]
    df = spark.createDataFrame(rows, "dataset string, model string, layer int, method string, sample_id long, label int, setting string, prediction double")
    r = causal.before_after(df).first()
    assert r["mean_original_1"] == 0.625 and r["mean_intervened_1"] == 0.125
    assert r["mean_difference_1"] == -0.5 and r["median_difference_1"] == -0.5
    assert r["mean_difference_0"] == 0.25


def test_run_names(spark):
    df = spark.createDataFrame([("snli-no_prem|m1|layer12|eval@snli-random_neg_prem|ccr",)], "n string")
    r = df.select(*[c.alias(k) for k, c in results.parse_eval_name("n").items()]).first()
    assert (r["train_step"], r["model"], r["layer"], r["eval_step"], r["method"]) == ("snli-no_prem", "m1", 12, "snli-random_neg_prem", "ccr")
    flags = {**results.premise_flags(F.lit("snli-random_neg_prem"))}
    f = df.select(*[c.alias(k) for k, c in flags.items()]).first()
    assert (f["premise_asserted"], f["premise_origin"]) == (False, "random")
    no = df.select(*[c.alias(k) for k, c in results.premise_flags(F.lit("snli-no_prem")).items()]).first()
    assert (no["premise_asserted"], no["premise_origin"]) == (True, "no")


def test_intervened_names(spark):
    name = "INTERVENED_on[snli-no_prem,x]_with[snli-original_pos_prem,m1,layer14,train,ccr]|layer9|eval"
    df = spark.createDataFrame([(name,), ("snli-no_prem|m1|layer9|eval@x|ccr",)], "n string")
    got = df.select(*[c.alias(k) for k, c in results.parse_causal_name("n").items()]).collect()
    assert tuple(got[0]) == ("snli-original_pos_prem", "m1", 9, "ccr", "intervened")
    assert tuple(got[1]) == ("snli-no_prem", "m1", 9, "ccr", "original")


def test_later_parameters_win_and_objects_are_dropped(spark):
    df = spark.range(1)
    m = F.create_map(F.lit("a"), F.lit("int:1"), F.lit("b"), F.lit("object:z"))
    got = df.select(results.primitive_params(m, "eval")).first()[0]
    assert got == {"eval_a": "1"}
    merged = results.merge_params(F.create_map(F.lit("k"), F.lit("x")), F.create_map(F.lit("k"), F.lit("y")))
    assert df.select(merged).first()[0] == {"k": "y"}


def test_group_levels(spark):
    p = F.create_map(*[F.lit(x) for pair in {"TRAIN_STEP_NAME.0": "d-a", "TRAIN_STEP_NAME.1": "m", "TRAIN_STEP_NAME.2": "layer1", "TRAIN_STEP_NAME.4": "ccr", "PROBE_type": "ccr", "EVAL_STEP_NAME": "n"}.items() for x in pair])
    got = spark.range(1).select(*[results.group_keys(p, n) for n in (0, 1, 2)]).first()
    assert got[0] == ["TRAIN_STEP_NAME.1", "TRAIN_STEP_NAME.2", "TRAIN_STEP_NAME.4"]
    assert got[1] == ["TRAIN_STEP_NAME.1", "TRAIN_STEP_NAME.2"]
    assert got[2] == ["TRAIN_STEP_NAME.1"]


def test_grid_sizes(spark):
    """Per layer and dataset: 20 probes and 80 evaluations."""
    one = spark.createDataFrame([("d",)], "dataset string")
    layers = sum(MODELS.values())
    assert grid.probe_grid(one, model_catalog(spark)).count() == 20 * layers
    runs = grid.run_grid(one, model_catalog(spark))
    assert runs.count() == 80 * layers
    assert runs.select(grid.eval_name()).distinct().count() == 80 * layers


def test_flagship_columns(spark, sf):
    final = QUERIES["x14_final_table"](spark, sf)
    assert final.columns[:6] == ["criterion", "dataset", "model", "method", "subgroup", "layer"]
    assert mq.BEST.split()[0] == "accuracy_pos_prem"


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_similarity_by_matrix_products_in_blocks(spark, block):
    """All four views as pair by pair, with a zero direction and groups of several blocks."""
    rng = np.random.default_rng(2)
    keys = [(m, d, v, layer, p) for m in "ab" for d in "xyz" for v in "uv" for layer in range(5) for p in "pq"]
    rows = [(*k, 1 if i % 3 else -1, rng.normal(size=4).tolist()) for i, k in enumerate(keys)]
    rows[5] = (*keys[5], 1, [0.0] * 4)
    df = spark.createDataFrame(rows, "model string, dataset string, data_variant string, layer int, probe_method string, sign int, direction array<double>")
    directions = compare.signed_directions(df)
    vec = {r[:5]: np.array(r[6]) * r[5] for r in rows}
    views = {
        ("data_variant", "layer", "probe_method"): lambda a, b: a[1] != b[1],
        ("dataset", "data_variant", "probe_method"): lambda a, b: True,
        ("dataset", "data_variant", "layer"): lambda a, b: a[4] > b[4],
    }
    conditions = [F.col("dataset1") != F.col("dataset2"), None, F.col("probe_method1") > F.col("probe_method2")]
    names = ["model", *compare.DIMENSIONS]
    for (shared, chosen), condition in zip(views.items(), conditions):
        got = compare.pairs(directions, list(shared), condition, block=block).collect()
        want = {}
        for a in keys:
            for b in keys:
                same = all(a[names.index(k)] == b[names.index(k)] for k in ("model", *shared))
                if same and chosen(a, b):
                    with np.errstate(invalid="ignore"):
                        size = np.linalg.norm(vec[a]) * np.linalg.norm(vec[b])
                        want[a, b] = vec[a] @ vec[b] / size if size else float("nan")
        found = {}
        for r in got:
            side = [tuple(r[k] if k in ("model", *shared) else r[f"{k}{i}"] for k in names) for i in (1, 2)]
            found[side[0], side[1]] = r["similarity"]
        assert len(got) == len(found) and set(found) == set(want)
        np.testing.assert_allclose([found[k] for k in want], list(want.values()), atol=1e-12)
    assert plan(compare.across_layers(directions)).count("Join") == 0


def test_similarity_rejects_widths_that_differ(spark):
    rows = [("m", "d", "v", 1, "p", 1, [1.0, 0.0]), ("m", "d", "v", 2, "p", 1, [1.0])]
    df = spark.createDataFrame(rows, "model string, dataset string, data_variant string, layer int, probe_method string, sign int, direction array<double>")
    with pytest.raises(Exception, match="vectors differ in length"):
        compare.across_layers(compare.signed_directions(df)).collect()
