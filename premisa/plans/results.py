"""Result tables: run names, parameters, groups and labels of the evaluated probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premisa.functions.exprs import as_col, text_id
from premisa.sources.catalog import METHOD_NAMES

# Parameters that tell variants (and probe details), then also methods, then also
# layers apart; leaving them out gives the ids of the three group levels.
LEVEL_0 = [
    "train_LoadData_prompt_name",
    "train_LoadData_dataset_config_name",
    "TRAIN_STEP_NAME.0",
    "eval_LoadData_prompt_name",
    "eval_LoadData_dataset_config_name",
]
LEVEL_1 = ["TRAIN_STEP_NAME.4", "train_Normalize_var_normalize", "eval_Normalize_var_normalize"]
LEVEL_2 = [
    "TRAIN_STEP_NAME.2",
    "eval_CreateSplits_layer_index",
    "train_CreateSplits_layer_index",
]
STEP_NAMES = ["EVAL_STEP_NAME", "EVAL_STEP_NAME_@.0"]
PRIMITIVES = "^(bool|str|int|float):"


def display_name(method: Column | str) -> Column:
    method = as_col(method)
    names = F.create_map(*[F.lit(x) for pair in METHOD_NAMES.items() for x in pair])
    return F.coalesce(names[method], method)


def parse_eval_name(name: Column | str) -> dict[str, Column]:
    """Parts of ``train|model|layerL|eval@data|method``."""
    parts = F.split(as_col(name), r"\|")
    at = F.element_at(F.split(as_col(name), "@"), -1)
    return {
        "train_step": parts[0],
        "model": parts[1],
        "layer": F.regexp_replace(parts[2], "layer", "").cast("int"),
        "eval_step": F.split(at, r"\|")[0],
        "method": parts[4],
    }


def parse_causal_name(name: Column | str) -> dict[str, Column]:
    """Parts of a plain name, or of ``INTERVENED_on[..]_with[data,model,..]|layerL|..``."""
    name = as_col(name)
    changed = name.contains("INTERVENED")
    parts = F.split(name, r"\|")
    probe = F.split(F.regexp_extract(name, r"^INTERVENED_on\[.*\]_with\[(.*)\]", 1), ",")
    layer = F.when(changed, parts[1]).otherwise(parts[2])
    return {
        "data": F.when(changed, probe[0]).otherwise(parts[0]),
        "model": F.when(changed, probe[1]).otherwise(parts[1]),
        "layer": F.regexp_replace(layer, "layer", "").cast("int"),
        "probe_method": F.when(changed, F.get(probe, F.lit(4))).otherwise(F.get(parts, F.lit(4))),
        "setting": F.when(changed, "intervened").otherwise("original"),
    }


def parse_probe_name(name: Column | str) -> dict[str, Column]:
    """Parts of ``dataset-variant|model|layerL|train|method``."""
    parts = F.split(as_col(name), r"\|")
    data = F.split(parts[0], "-")
    return {
        "dataset": data[0],
        "data_variant": data[1],
        "model": parts[1],
        "layer": F.regexp_replace(parts[2], "layer", "").cast("int"),
        "probe_method": parts[4],
    }


def premise_flags(eval_step: Column | str) -> dict[str, Column]:
    step = as_col(eval_step)
    return {
        "premise_asserted": ~step.endswith("neg_prem"),
        "premise_origin": F.regexp_extract(step, r"\w-([a-z]*)_.*", 1),
    }


def subgroup_flags(train_step: Column | str, eval_step: Column | str) -> dict[str, Column]:
    train_step, eval_step = as_col(train_step), as_col(eval_step)
    return {
        "combined_grp": train_step.endswith("-combined"),
        "pos_prem_grp": train_step.endswith("-original_pos_prem"),
        "no_prem_grp": train_step.endswith("-no_prem"),
        "same_variant_grp": train_step == eval_step,
    }


def primitive_params(params: Column | str, prefix: str) -> Column:
    """Keep ``type:value`` entries of scalar type and prefix their names."""
    kept = F.map_filter(as_col(params), lambda _, v: v.rlike(PRIMITIVES))
    named = F.transform_keys(kept, lambda k, _: F.concat(F.lit(prefix + "_"), k))
    return F.transform_values(named, lambda _, v: F.regexp_replace(v, PRIMITIVES, ""))


def merge_params(*maps: Column) -> Column:
    """One map; a later map wins (LAST_WIN session setting)."""
    return F.map_concat(*maps)


def group_keys(params: Column, level: int) -> Column:
    """Sorted parameter names that define a group of the level."""
    left_out = STEP_NAMES + LEVEL_0 + (LEVEL_1 if level > 0 else []) + (LEVEL_2 if level > 1 else [])
    names = F.array_except(F.map_keys(params), F.array(*[F.lit(k) for k in left_out]))
    return F.array_sort(F.filter(names, lambda k: ~k.startswith("PROBE")))


def group_id(params: Column, level: int, separator: str = "\u0001") -> Column:
    """SHA-256 over the group's parameter values; ``separator=''`` is the legacy form."""
    values = F.transform(group_keys(params, level), lambda k: params[k])
    return text_id(F.array_join(values, separator))


def constant_params(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters with a single value within each group, as a map.

    The distinct (group, name, value) triples are counted, so rows are combined map-side.
    """
    long = runs.select(*keys, F.explode("params").alias("name", "value"))
    single = (
        long.groupBy(*keys, "name")
        .agg(F.min("value").alias("value"), F.max("value").alias("_most"))
        .filter("value = _most")
    )
    entries = F.array_sort(F.collect_list(F.struct("name", "value")))
    return single.groupBy(*keys).agg(F.map_from_entries(entries).alias("params"))


def build_results(predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """Predictions with the parameters, parsed names and group ids of their run (equi-join)."""
    described = runs.select(
        "run_id",
        *[c.alias(k) for k, c in parse_eval_name("run_id").items()],
        "params",
        *[group_id(F.col("params"), level).alias(f"l{level}_id") for level in (0, 1, 2)],
    )
    return predictions.join(described, "run_id")


def build_causal_results(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "sample_id",
        "label",
        *[c.alias(k) for k, c in parse_causal_name("run_id").items()],
        "prediction",
    )


def prepare(results: DataFrame) -> DataFrame:
    """Add display names, premise flags and subgroup flags."""
    out = results.withColumn("method", display_name("method"))
    flags = premise_flags("eval_step") | subgroup_flags("train_step", "eval_step")
    for name, column in flags.items():
        out = out.withColumn(name, column)
    return out


def label_conflicts(results: DataFrame) -> DataFrame:
    """Samples that carry different labels in different runs; empty if results are comparable."""
    return (
        results.groupBy("dataset", "sample_id")
        .agg(F.min("label").alias("lowest"), F.max("label").alias("highest"))
        .filter("lowest <> highest")
    )
