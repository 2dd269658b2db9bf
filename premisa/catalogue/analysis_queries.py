"""Queries over run names, parameters, direction pairs and the run grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premisa.catalogue.registry import query, r6
from premisa.functions.exprs import text_id
from premisa.plans import compare, grid, results
from premisa.sources import fixtures as fx
from premisa.sources.catalog import MODELS, model_catalog
from premisa.sources.staging import settle

# --- run names -----------------------------------------------------------------------------

_NAME = """dataset || '-' || train_variant || '|' || model || '|layer' || layer || '|eval@'
  || dataset || '-' || variant || '|' || method"""
RUN_COLUMNS = ["dataset", "model", "variant", "train_variant", "layer", "method"]


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run met in the predictions with its name, size and mean prediction.

    The table is staged: what is derived from a run is then computed per run, not per prediction.
    """
    name = F.concat_ws(
        "|",
        F.concat_ws("-", "dataset", "train_variant"),
        "model",
        F.concat(F.lit("layer"), F.col("layer").cast("string")),
        F.concat(F.lit("eval@"), F.concat_ws("-", "dataset", "variant")),
        "method",
    )
    grouped = fx.predictions(spark, sf).groupBy(*RUN_COLUMNS).agg(
        F.count("*").alias("n"), F.avg("prediction").alias("mean")
    )
    return settle(grouped.withColumn("run_id", name), "runs")


_RUNS = f"""SELECT dataset, model, variant, train_variant, layer, method, count(*) AS n,
  avg(prediction) AS mean, {_NAME} AS run_id FROM pred GROUP BY ALL"""


@query(
    "p35_parse_run_name",
    f"""SELECT run_id, dataset || '-' || train_variant AS train_step, model, layer,
  dataset || '-' || variant AS eval_step, method, n FROM ({_RUNS})""",
    "pred",
)
def p35(spark, sf):
    parts = [c.alias(k) for k, c in results.parse_eval_name("run_id").items()]
    return runs(spark, sf).select("run_id", "n", *parts)


@query(
    "p35_parse_probe_name",
    """SELECT dataset, train_variant AS data_variant, model, layer, method AS probe_method,
  count(*) AS n FROM pred GROUP BY ALL""",
    "pred",
)
def p35_probe(spark, sf):
    name = F.concat_ws(
        "|", F.concat_ws("-", "dataset", "train_variant"), "model",
        F.concat(F.lit("layer"), F.col("layer").cast("string")), F.lit("train"), "method",
    )
    grouped = fx.predictions(spark, sf).groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return grouped.select("n", *[c.alias(k) for k, c in results.parse_probe_name("name").items()])


@query(
    "p33_conditional_flags",
    f"""SELECT run_id, variant NOT LIKE '%neg$_prem' ESCAPE '$' AS premise_asserted,
  split_part(variant, '_', 1) AS premise_origin, train_variant = 'combined' AS combined_grp,
  train_variant = 'original_pos_prem' AS pos_prem_grp, train_variant = 'no_prem' AS no_prem_grp,
  train_variant = variant AS same_variant_grp FROM ({_RUNS})""",
    "pred",
)
def p33(spark, sf):
    parts = results.parse_eval_name("run_id")
    df = runs(spark, sf).select(
        "run_id", parts["train_step"].alias("t"), parts["eval_step"].alias("e")
    )
    flags = results.premise_flags("e") | results.subgroup_flags("t", "e")
    return df.select("run_id", *[c.alias(k) for k, c in flags.items()])


@query(
    "p34_display_names",
    """SELECT CASE method WHEN 'mass_mean' THEN 'MMP' WHEN 'ccr' THEN 'CCR' ELSE method END AS method,
  count(*) AS n FROM pred GROUP BY 1""",
    "pred",
)
def p34(spark, sf):
    df = fx.predictions(spark, sf).withColumn("method", results.display_name("method"))
    return df.groupBy("method").agg(F.count("*").alias("n"))


@query(
    "p36_runs_with_direction",
    """SELECT 'with' AS kind, count(*) AS rows FROM embeddings WHERE label <> 0""",
)
def p36(spark, sf):
    """Directions of label 0 are made absent; absent directions are skipped."""
    df = fx.table(spark, sf, "embeddings").select(
        F.when(F.col("label") != 0, F.col("embedding")).alias("direction")
    )
    kept = df.filter(F.col("direction").isNotNull())
    return kept.agg(F.count("*").alias("rows")).select(F.lit("with").alias("kind"), "rows")


def params(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the typed parameters of their evaluation and training lineage."""
    evaluated = F.create_map(
        F.lit("LoadData_prompt_name"), F.concat(F.lit("str:"), F.col("variant")),
        F.lit("CreateSplits_layer_index"), F.concat(F.lit("int:"), F.col("layer").cast("string")),
        F.lit("Normalize_var_normalize"), F.lit("bool:False"),
        F.lit("Generate_model"), F.lit("object:a model"),
    )
    trained = F.create_map(
        F.lit("LoadData_prompt_name"), F.concat(F.lit("str:"), F.col("train_variant")),
        F.lit("CreateSplits_layer_index"), F.concat(F.lit("int:"), F.col("layer").cast("string")),
        F.lit("Normalize_var_normalize"), F.lit("bool:False"),
    )
    named = F.create_map(
        F.lit("PROBE_type"), F.col("method"),
        F.lit("TRAIN_STEP_NAME.0"), F.concat_ws("-", "dataset", "train_variant"),
        F.lit("TRAIN_STEP_NAME.1"), F.col("model"),
        F.lit("TRAIN_STEP_NAME.2"), F.concat(F.lit("layer"), F.col("layer").cast("string")),
        F.lit("TRAIN_STEP_NAME.4"), F.col("method"),
        F.lit("EVAL_STEP_NAME"), F.col("run_id"),
    )
    merged = results.merge_params(
        results.primitive_params(evaluated, "eval"),
        results.primitive_params(trained, "train"),
        named,
    )
    return runs(spark, sf).withColumn("params", merged)


@query(
    "p37_primitive_params",
    f"""SELECT run_id, 12 AS params, variant AS eval_prompt, train_variant AS train_prompt,
  CAST(layer AS VARCHAR) AS layer, false AS has_object FROM ({_RUNS})""",
    "pred",
)
def p37(spark, sf):
    p = F.col("params")
    return params(spark, sf).select(
        "run_id",
        F.size(p).alias("params"),
        p["eval_LoadData_prompt_name"].alias("eval_prompt"),
        p["train_LoadData_prompt_name"].alias("train_prompt"),
        p["eval_CreateSplits_layer_index"].alias("layer"),
        F.map_contains_key(p, "eval_Generate_model").alias("has_object"),
    )


@query(
    "p38_constant_params",
    """SELECT dataset, method, layer, '12-5' AS kept_of, 'm1' AS model, method AS probe
FROM (SELECT DISTINCT dataset, method, layer FROM pred)""",
    "pred",
)
def p38(spark, sf):
    keys = ["dataset", "method", "layer"]
    kept = results.constant_params(params(spark, sf), keys)
    p = F.col("params")
    varying = F.lit(12) - F.size(p)
    return kept.select(
        *keys, F.concat_ws("-", F.lit("12"), (varying + 1).cast("string")).alias("kept_of"),
        p["TRAIN_STEP_NAME.1"].alias("model"), p["PROBE_type"].alias("probe"),
    )



@query(
    "e10_group_ids",
    f"""SELECT run_id,
  sha256(concat_ws(chr(1), model, 'layer' || layer, method, CAST(layer AS VARCHAR), 'False',
    CAST(layer AS VARCHAR), 'False')) AS l0_id,
  sha256(concat_ws(chr(1), model, 'layer' || layer, CAST(layer AS VARCHAR),
    CAST(layer AS VARCHAR))) AS l1_id,
  sha256(model) AS l2_id FROM ({_RUNS})""",
    "pred",
)
def e10(spark, sf):
    ids = [results.group_id(F.col("params"), n).alias(f"l{n}_id") for n in (0, 1, 2)]
    return params(spark, sf).select("run_id", *ids)


@query(
    "u3_group_keys",
    f"""SELECT run_id, 7 + CAST(layer = 2 AS INT) AS l0_keys, 4 + CAST(layer = 2 AS INT) AS l1_keys,
  1 + CAST(layer = 2 AS INT) AS l2_keys FROM ({_RUNS})""",
    "pred",
)
def u3(spark, sf):
    """Runs of layer 2 have one more parameter, all others one that never counts."""
    p = F.col("params")
    more = F.create_map(F.lit("eval_Other_option"), F.lit("1"))
    probe = F.create_map(F.lit("PROBE_option"), F.lit("1"))
    second = p["eval_CreateSplits_layer_index"] == "2"
    p = F.when(second, F.map_concat(p, more)).otherwise(F.map_concat(p, probe))
    sizes = [F.size(results.group_keys(p, n)).alias(f"l{n}_keys") for n in (0, 1, 2)]
    return params(spark, sf).select("run_id", *sizes)


@query(
    "f12_text_hash",
    """SELECT doc_id, sha256(concat_ws(chr(1), source, lang, CAST(n_chars AS VARCHAR))) AS id,
  sha256(source || lang || n_chars) AS legacy_id FROM documents""",
)
def f12(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        text_id("source", "lang", "n_chars").alias("id"),
        text_id("source", "lang", "n_chars", separator="").alias("legacy_id"),
    )


@query(
    "j9_predictions_with_runs",
    """SELECT dataset || '-' || variant AS eval_step, method, layer, count(*) AS n,
  round(avg(prediction), 6) AS mean FROM pred GROUP BY ALL""",
    "pred",
)
def j9(spark, sf):
    joined = _built(spark, sf)
    return joined.groupBy("eval_step", "method", "layer").agg(
        F.count("*").alias("n"), r6(F.avg("prediction"), "mean")
    )


def _built(spark, sf) -> DataFrame:
    """Predictions that know only their run's name, joined with what the run table says."""
    name = F.concat_ws(
        "|",
        F.concat_ws("-", "dataset", "train_variant"),
        "model",
        F.concat(F.lit("layer"), F.col("layer").cast("string")),
        F.concat(F.lit("eval@"), F.concat_ws("-", "dataset", "variant")),
        "method",
    )
    slim = fx.predictions(spark, sf).select(
        name.alias("run_id"), "dataset", "sample_id", "label", "prediction"
    )
    described = settle(params(spark, sf).select("run_id", "params"), "runs")
    return results.build_results(slim, described)


@query(
    "e9_build_results",
    f"""SELECT run_id, train_step, eval_step, method, layer, l2_id, count(*) AS n FROM (
  SELECT {_NAME} AS run_id, dataset || '-' || train_variant AS train_step,
    dataset || '-' || variant AS eval_step, method, layer, sha256(model) AS l2_id FROM pred)
GROUP BY ALL""",
    "pred",
)
def e9(spark, sf):
    return _built(spark, sf).groupBy(
        "run_id", "train_step", "eval_step", "method", "layer", "l2_id"
    ).agg(F.count("*").alias("n"))


@query(
    "x15_prepare",
    """SELECT CASE method WHEN 'mass_mean' THEN 'MMP' WHEN 'ccr' THEN 'CCR' ELSE method END AS method,
  split_part(variant, '_', 1) AS premise_origin,
  variant NOT LIKE '%neg$_prem' ESCAPE '$' AS premise_asserted,
  train_variant = 'combined' AS combined_grp, train_variant = variant AS same_variant_grp,
  count(*) AS n FROM pred GROUP BY ALL""",
    "pred",
)
def x15(spark, sf):
    keys = ["method", "premise_origin", "premise_asserted", "combined_grp", "same_variant_grp"]
    return results.prepare(_built(spark, sf)).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "x15_label_conflicts",
    """SELECT event_type AS dataset, user_id AS sample_id, min(l) AS lowest, max(l) AS highest
FROM (SELECT *, CASE WHEN value > 20 THEN 1 ELSE 0 END AS l FROM events)
GROUP BY ALL HAVING min(l) <> max(l)""",
)
def x15_conflicts(spark, sf):
    """Events as samples whose label differs from one event to the next."""
    rows = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"),
        F.col("user_id").alias("sample_id"),
        F.when(F.col("value") > 20, 1).otherwise(0).alias("label"),
    )
    return results.label_conflicts(rows)


@query(
    "e11_causal_results",
    """SELECT dataset || '-no_prem' AS data, model, layer, method AS probe_method, setting, label,
  count(*) AS n, round(avg(prediction), 6) AS mean FROM caus GROUP BY ALL""",
    "caus",
)
def e11(spark, sf):
    df = fx.causal(spark, sf)
    data = F.concat_ws("-", "dataset", F.lit("no_prem"))
    layer = F.concat(F.lit("layer"), F.col("layer").cast("string"))
    plain = F.concat_ws("|", data, "model", layer, F.lit("eval"), "method")
    changed = F.concat_ws(
        "|",
        F.concat(
            F.lit("INTERVENED_on["), data, F.lit("]_with["),
            F.concat_ws(",", data, "model", layer, F.lit("train"), "method"), F.lit("]"),
        ),
        layer,
        F.lit("eval"),
    )
    name = F.when(F.col("setting") == "intervened", changed).otherwise(plain)
    built = results.build_causal_results(
        df.select("sample_id", "label", name.alias("run_id"), "prediction")
    )
    return built.groupBy("data", "model", "layer", "probe_method", "setting", "label").agg(
        F.count("*").alias("n"), r6(F.avg("prediction"), "mean")
    )


# --- directions ----------------------------------------------------------------------------


def signed(spark, sf) -> DataFrame:
    return settle(compare.signed_directions(fx.directions(spark, sf)), "directions")


@query(
    "j4_similarity_across_datasets",
    """SELECT model, data_variant1 AS data_variant, layer1 AS layer, probe_method1 AS probe_method,
  dataset1, dataset2, round(similarity, 6) AS similarity FROM cmp
WHERE data_variant1 = data_variant2 AND layer1 = layer2 AND probe_method1 = probe_method2
  AND dataset1 <> dataset2""",
    "cmp",
)
def j4(spark, sf):
    df = compare.across_datasets(signed(spark, sf))
    return df.withColumn("similarity", F.round("similarity", 6))


@query(
    "j5_similarity_across_layers",
    """SELECT model, dataset1 AS dataset, data_variant1 AS data_variant,
  probe_method1 AS probe_method, layer1, layer2, round(similarity, 6) AS similarity FROM cmp
WHERE data_variant1 = data_variant2 AND dataset1 = dataset2 AND probe_method1 = probe_method2""",
    "cmp",
)
def j5(spark, sf):
    df = compare.across_layers(signed(spark, sf))
    return df.withColumn("similarity", F.round("similarity", 6))


@query(
    "j6_similarity_across_methods",
    """SELECT model, dataset1 AS dataset, data_variant1 AS data_variant, layer1 AS layer,
  probe_method1, probe_method2, probe_method1 || '-' || probe_method2 AS method_pair,
  round(similarity, 6) AS similarity FROM cmp
WHERE data_variant1 = data_variant2 AND dataset1 = dataset2 AND layer1 = layer2
  AND probe_method1 > probe_method2""",
    "cmp",
)
def j6(spark, sf):
    df = compare.across_methods(signed(spark, sf))
    return df.withColumn("similarity", F.round("similarity", 6))


@query(
    "j7_similarity_across_variants",
    """SELECT model, dataset1 AS dataset, layer1 AS layer, probe_method1 AS probe_method,
  data_variant1, data_variant2, data_variant1 || '-' || data_variant2 AS variant_pair,
  round(similarity, 6) AS similarity FROM cmp
WHERE dataset1 = dataset2 AND layer1 = layer2 AND probe_method1 = probe_method2
  AND data_variant1 > data_variant2""",
    "cmp",
)
def j7(spark, sf):
    df = compare.across_variants(signed(spark, sf))
    return df.withColumn("similarity", F.round("similarity", 6))


_SIDE = "dataset{0} || '|' || data_variant{0} || '|' || layer{0} || '|' || probe_method{0} AS side{0}"
_SIDES = f"model, {_SIDE.format(1)}, {_SIDE.format(2)}, round(similarity, 6) AS similarity"


X20_SQL = f"""SELECT 'datasets' AS view, {_SIDES} FROM cmp WHERE data_variant1 = data_variant2
  AND layer1 = layer2 AND probe_method1 = probe_method2 AND dataset1 <> dataset2
UNION ALL SELECT 'layers', {_SIDES} FROM cmp WHERE data_variant1 = data_variant2
  AND dataset1 = dataset2 AND probe_method1 = probe_method2
UNION ALL SELECT 'methods', {_SIDES} FROM cmp WHERE data_variant1 = data_variant2
  AND dataset1 = dataset2 AND layer1 = layer2 AND probe_method1 > probe_method2
UNION ALL SELECT 'variants', {_SIDES} FROM cmp WHERE dataset1 = dataset2
  AND layer1 = layer2 AND probe_method1 = probe_method2 AND data_variant1 > data_variant2"""


@query("x20_direction_similarity", X20_SQL, "cmp")
def x20(spark, sf):
    views = compare.similarity_report(fx.directions(spark, sf))
    return compare.all_views(views).withColumn("similarity", F.round("similarity", 6))


_MATRIX = ", ".join(
    f'round(avg(similarity) FILTER (layer1 = {n}), 6) AS "{n}"' for n in (1, 2, 3, 4)
)
_SAME = """WHERE data_variant1 = data_variant2 AND dataset1 = dataset2
  AND probe_method1 = probe_method2"""


@query(
    "x21_layer_matrices",
    f"""SELECT model, dataset1 AS dataset, data_variant1 AS data_variant,
  probe_method1 AS probe_method, layer2, {_MATRIX} FROM cmp {_SAME} GROUP BY ALL""",
    "cmp",
)
def x21(spark, sf):
    keys = ["model", "dataset", "data_variant", "probe_method"]
    layers = compare.across_layers(signed(spark, sf))
    matrix = compare.layer_matrix(layers, [1, 2, 3, 4], keys)
    return matrix.select(*keys, "layer2", *[r6(str(n)) for n in (1, 2, 3, 4)])


@query(
    "x22_mean_layer_matrix",
    f"SELECT layer2, {_MATRIX} FROM cmp {_SAME} GROUP BY ALL",
    "cmp",
)
def x22(spark, sf):
    layers = compare.across_layers(signed(spark, sf))
    matrix = compare.layer_matrix(layers, [1, 2, 3, 4], [])
    return matrix.select("layer2", *[r6(str(n)) for n in (1, 2, 3, 4)])


@query(
    "a20_pivot_mean",
    f"SELECT model, layer2, {_MATRIX} FROM cmp {_SAME} GROUP BY ALL",
    "cmp",
)
def a20(spark, sf):
    layers = compare.across_layers(signed(spark, sf))
    matrix = compare.layer_matrix(layers, [1, 2, 3, 4], ["model"])
    return matrix.select("model", "layer2", *[r6(str(n)) for n in (1, 2, 3, 4)])


# --- grid ----------------------------------------------------------------------------------

_MODELS = ", ".join(f"('{m}', {n})" for m, n in MODELS.items())
_GRID = f"""SELECT s.source AS dataset, s.n, m.model, CAST(l.layer AS INT) AS layer, t.train_variant,
  p.method FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) s,
  (VALUES {_MODELS}) AS m(model, layers), (SELECT unnest(range(1, 41)) AS layer) l,
  (VALUES ('lm_head_baseline', false), ('ccr', false), ('logistic_baseline', true),
   ('massmean-iid=false', true)) AS p(method, supervised),
  (VALUES ('original_pos_prem'), ('original_neg_prem'), ('shuffle_pos_prem'),
   ('shuffle_neg_prem'), ('random_pos_prem'), ('random_neg_prem'), ('no_prem'), ('combined'))
   AS t(train_variant)
WHERE l.layer <= m.layers AND (NOT supervised OR train_variant IN ('original_pos_prem', 'no_prem'))"""


@query("x23_probe_grid", _GRID)
def x23_probes(spark, sf):
    """Every probe to fit on every source of the documents, with the source's size."""
    return grid.probe_grid(_sources(spark, sf), model_catalog(spark))


def _sources(spark, sf) -> DataFrame:
    return (
        fx.table(spark, sf, "documents")
        .groupBy(F.col("source").alias("dataset"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "x23_run_grid",
    f"""SELECT dataset, model, layer, method, train_variant, count(*) AS runs,
  CAST(sum(n) AS BIGINT) AS rows
FROM ({_GRID}) g, (VALUES ('original_pos_prem'), ('original_neg_prem'), ('shuffle_pos_prem'),
   ('shuffle_neg_prem'), ('random_pos_prem'), ('random_neg_prem'), ('no_prem')) AS v(variant)
WHERE train_variant IN ('original_pos_prem', 'no_prem', 'combined') OR train_variant = variant
GROUP BY ALL""",
)
def x23_runs(spark, sf):
    runs_ = grid.run_grid(_sources(spark, sf), model_catalog(spark))
    return runs_.groupBy("dataset", "model", "layer", "method", "train_variant").agg(
        F.count("*").alias("runs"), F.sum("n").alias("rows")
    )


@query(
    "x23_run_names",
    f"""SELECT CASE WHEN train_variant IN ('original_pos_prem', 'no_prem', 'combined')
  THEN dataset || '-' || train_variant || '|' || model || '|layer' || layer || '|eval@' || dataset
    || '-' || variant || '|' || method
  ELSE dataset || '-' || train_variant || '|' || model || '|layer' || layer || '|eval|' || method
  END AS run_id, n
FROM ({_GRID}) g, (VALUES ('original_pos_prem'), ('original_neg_prem'), ('shuffle_pos_prem'),
   ('shuffle_neg_prem'), ('random_pos_prem'), ('random_neg_prem'), ('no_prem')) AS v(variant)
WHERE train_variant IN ('original_pos_prem', 'no_prem', 'combined') OR train_variant = variant""",
)
def x23_names(spark, sf):
    runs_ = grid.run_grid(_sources(spark, sf), model_catalog(spark))
    return runs_.select(grid.eval_name().alias("run_id"), "n")


