"""What must not grow with the input: broadcasts, partitions, staged rows and join keys."""

import time

import numpy as np
from pyspark.sql import functions as F

from premisa.catalogue import metric_queries, text_queries
from premisa.operators import ranking
from premisa.plans import figures, metrics
from premisa.sources import fixtures as fx
from premisa.sources.staging import settle


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_spread_and_never_broadcast(spark, sf):
    records = text_queries._records(spark, sf)
    assert "BroadcastHashJoin" not in plan(records)
    assert fx.parts(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fx, "SPREAD_ROWS", 10)
    assert fx.spread(spark.range(1000), "id").rdd.getNumPartitions() == 100


def test_subgroups_are_joined_by_one_number(spark, sf):
    text = plan(metrics.with_subgroups(fx.predictions(spark, sf)))
    join = next(line for line in text.splitlines() if "BroadcastHashJoin" in line)
    assert "coalesce" not in join.split("],")[0]


def test_cells_carry_one_integer_key(spark, monkeypatch):
    seen, inner = [], ranking.order_statistics

    def spy(df, keys, *more, **named):
        seen.append([df.schema[k].dataType.typeName() for k in keys])
        return inner(df, keys, *more, **named)

    monkeypatch.setattr(metrics, "order_statistics", spy)
    names = [c for cells in metrics.CELLS.values() for c in cells]
    rows = [(d, "m", i % 2, "x", "s", *(float(i * (c + 1)) for c in range(len(names))))
            for d in ("a", None) for i in range(20)]
    kinds = "dataset string, model string, layer int, method string, subgroup string, "
    df = spark.createDataFrame(rows, kinds + ", ".join(f"{c} double" for c in names))
    got = {(r["dataset"], r["layer"], r["cell"]): r for r in metrics.cell_aggregates(df).collect()}
    assert seen == [["long"]]
    assert len(got) == 2 * 2 * len(names)
    for (d, layer, cell), r in got.items():
        want = [i * (names.index(cell) + 1.0) for i in range(20) if i % 2 == layer]
        assert r["n"] == 10 and np.isclose(r["mean"], np.mean(want))
        assert np.isclose(r["median"], np.median(want)) and np.isclose(r["p20"], np.quantile(want, 0.2))
        assert np.isclose(r["trim_mean"], np.mean(want[2:-2]))


def test_box_stages_no_rows_and_cuts_buckets(spark, monkeypatch):
    """A bound inside a bucket: its values on both sides are told apart."""
    staged, inner = [], figures.settle

    def spy(df, name):
        staged.append(name)
        return inner(df, name)

    monkeypatch.setattr(figures, "settle", spy)
    values = [100.0 + i for i in range(40)] + [171.0 + i / 4 for i in range(40)] + [20.0, 1000.0]
    rows = spark.createDataFrame([(v,) for v in values], "prediction double")
    consts = dict(dataset="d", model="m", layer=1, method="x", subgroup="s", label=1,
                  premise_origin="no", premise_asserted=True)
    strip = rows.select(*(F.lit(v).alias(k) for k, v in consts.items()), F.lit(1).alias("sample_id"), "prediction")
    for shift in (0.0, 25.0, 60.0):
        values_ = [v + shift if v > 150 else v for v in values]
        moved = strip.withColumn("prediction", F.when(F.col("prediction") > 150, F.col("prediction") + shift)
                                 .otherwise(F.col("prediction")))
        more = [240.0 + i for i in range(60)]
        extra = spark.createDataFrame([(v,) for v in more], "prediction double")
        extra = extra.select(*(F.lit(v).alias(k) for k, v in consts.items()), F.lit(1).alias("sample_id"), "prediction")
        for df, all_ in ((moved, values_), (moved.unionByName(extra), values_ + more)):
            got = figures.box_summary(df).first()
            q1, q3 = np.quantile(all_, [0.25, 0.75])
            kept = [v for v in all_ if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
            assert (got["low"], got["high"], got["n"]) == (min(kept), max(kept), len(all_))
            assert np.isclose(got["median"], np.median(all_))
    assert "strip" not in staged


def test_all_predictions_are_made_in_one_pass(spark, sf):
    every = metric_queries.all_predictions(spark, sf)
    apart = fx.predictions(spark, sf).unionByName(fx.predictions_same(spark, sf))
    assert "Union" not in plan(every)
    assert every.columns == apart.columns
    assert every.exceptAll(apart).isEmpty() and apart.exceptAll(every).isEmpty()


def test_a_task_pivots_what_the_fast_hash_map_holds():
    groups = 3 * 2 * 3 + 2  # training sets x layers x methods, and two probes trained on themselves
    assert fx.SPREAD_ROWS * groups <= 2**16


def test_cells_take_the_groups_of_the_means(spark, sf):
    errors = metric_queries.staged_errors(spark, sf)
    means = settle(metrics.probability_means(errors), "means")
    alone, given = metrics.cell_aggregates(errors), metrics.cell_aggregates(errors, groups=means)
    keys = [*metrics.GROUP, "cell", "n", "median", "p20", "p80"]
    assert sorted(alone.select(keys).collect()) == sorted(given.select(keys).collect())


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_a_staged_table_go_when_it_is_written(spark):
    df = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()
    before = shuffle_files(spark)
    staged = settle(df, "once")
    left = shuffle_files(spark) - before
    for _ in range(100):  # they are removed in the background
        if not left:
            break
        time.sleep(0.1)
        left = shuffle_files(spark) - before
    assert not left
    assert staged.count() == df.count() == settle(df, "again").count() == 10
