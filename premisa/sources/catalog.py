"""Fixed catalogues: dataset variants, models, methods and prompt templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The seven premise variants, in order.
VARIANTS = [
    "original_pos_prem",
    "original_neg_prem",
    "shuffle_pos_prem",
    "shuffle_neg_prem",
    "random_pos_prem",
    "random_neg_prem",
    "no_prem",
]

# Per dataset the source name, split, and per variant (builder config, prompt).
DATASETS = {
    "snli": {
        "name": "snli_pairs",
        "split": "train",
        "variants": {
            "original_pos_prem": ("no_neutral", "pic-full"),
            "original_neg_prem": ("no_neutral", "pic-premise_negated"),
            "shuffle_pos_prem": ("no_neutral_shuffle_premises", "pic-full"),
            "shuffle_neg_prem": ("no_neutral_shuffle_premises", "pic-premise_negated"),
            "random_pos_prem": ("no_neutral_random_bits", "pic-full"),
            "random_neg_prem": ("no_neutral_random_bits", "pic-premise_negated"),
            "no_prem": ("no_neutral", "pic-hypothesis_only"),
        },
    },
    "entbank": {
        "name": "proof_questions",
        "split": "train",
        "variants": {
            "original_pos_prem": ("v3_base_all_true", "truth-question-v3"),
            "original_neg_prem": ("v3_base_all_false", "truth-question-v3"),
            "shuffle_pos_prem": ("v3_distract_all_true", "truth-question-v3"),
            "shuffle_neg_prem": ("v3_distract_all_false", "truth-question-v3"),
            "random_pos_prem": ("v3_random_all_true", "truth-question-v3"),
            "random_neg_prem": ("v3_random_all_false", "truth-question-v3"),
            "no_prem": ("v3_none", "truth-question-v3"),
        },
    },
}

# Model, number of layers (layer 0 is the embedding layer and is not probed).
MODELS = {"llama2-7b": 32, "llama2-13b": 40, "olmo-7b": 32, "olmo-7b-instruct": 32}

# Display names of the probe methods; other names pass through.
METHOD_NAMES = {
    "lr_sklearn": "LR",
    "lm_head_baseline": "LM-head",
    "mass_mean": "MMP",
    "ccs_gd": "CCS",
    "ccr": "CCR",
}

# Rows taken per variant for the combined training set, and whether labels are kept.
COMBINE_QUOTAS = {
    "original_pos_prem": (250, True),
    "original_neg_prem": (250, False),
    "shuffle_pos_prem": (75, True),
    "shuffle_neg_prem": (75, True),
    "random_pos_prem": (75, True),
    "random_neg_prem": (75, True),
    "no_prem": (200, True),
}

# Prompt templates with {column} places: name -> (question, answer if label 0, answer if label 1).
TEMPLATES = {
    "pic-full": (
        'Consider the following premise: "{premise}" '
        'The statement "{hypothesis}" is',
        "incorrect",
        "correct",
    ),
    "pic-premise_negated": (
        'Consider that the following premise is false: "{premise}" '
        'The statement "{hypothesis}" is',
        "incorrect",
        "correct",
    ),
    "pic-hypothesis_only": ('The statement "{hypothesis}" is', "incorrect", "correct"),
    # every premise with its mark, see ``premisa.operators.prompts.marked``
    "truth-question-v3": (
        '{marked_premises}Question: "{question}" The answer "{answer}" is',
        "incorrect",
        "correct",
    ),
    "question-answer": ('Question: "{question}" Is "{answer}" right?', "No", "Yes"),
}


def variant_catalog(spark: SparkSession) -> DataFrame:
    """One row per dataset and variant: source name, builder config, prompt, split."""
    rows = [
        (dataset, variant, spec["name"], config, prompt, spec["split"])
        for dataset, spec in DATASETS.items()
        for variant, (config, prompt) in spec["variants"].items()
    ]
    return spark.createDataFrame(
        rows, "dataset string, variant string, name string, config string, prompt string, split string"
    )


def model_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS.items()), "model string, layers int")
