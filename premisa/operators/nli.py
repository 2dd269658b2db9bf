"""Sentence-pair examples: aliasing, premise randomisation, label filter and coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premisa.functions.exprs import as_col, bind, hex_number, order_key
from premisa.operators.ranking import hash_rank, number_rank

# The known gold labels.
LABELS = ["contradiction", "entailment", "neutral"]
PREMISE_MODES = ["none", "shuffle_premises", "random_bits"]
OTHER = {"entailment": "other", "neutral": "neutral", "contradiction": "other"}

# The five named builder configurations.
PRESETS = {
    "no_neutral": {"skip_labels": ["neutral"]},
    "no_neutral_shuffle_premises": {
        "skip_labels": ["neutral"],
        "premise_mode": "shuffle_premises",
    },
    "no_neutral_random_bits": {"skip_labels": ["neutral"], "premise_mode": "random_bits"},
    "no_contradiction": {"skip_labels": ["contradiction"]},
    "neutral_vs_other": {"label_map": OTHER},
}

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
LETTERS_PER_HASH = 16
HASH_PARTS = (1, 9, 17, 25)  # where the four numbers of an md5 start


def alias_sentences(raw: DataFrame) -> DataFrame:
    """Add ``premise`` and ``hypothesis`` next to the raw sentence columns."""
    return raw.withColumn("premise", F.col("sentence1")).withColumn(
        "hypothesis", F.col("sentence2")
    )


def keep_labels(df: DataFrame, skip_labels: list[str]) -> DataFrame:
    kept = [label for label in LABELS if label not in skip_labels]
    return df.filter(F.col("gold_label").isin(kept))


def label_code(label_map: dict[str, str], skip_labels: list[str]) -> Column:
    """Position of the mapped label among the sorted distinct labels that can occur."""
    names = sorted({new for old, new in label_map.items() if old not in skip_labels})
    code = F.lit(None).cast("int")
    for old, new in label_map.items():
        if new in names:
            code = F.when(F.col("gold_label") == old, names.index(new)).otherwise(code)
    return code


def shuffle_column(df: DataFrame, id_col: str, column: str, seed: int) -> DataFrame:
    """Replace ``column`` by the value of a partner row; the partners form a permutation.

    The row at hash rank r gets the value of the row at id rank r. Only ids are ranked, bucket by
    bucket; partners meet by an equi-join, and the values are fetched by the partner's id.
    """
    ids = df.select(id_col)
    givers = number_rank(ids.select(F.col(id_col).alias("_giver")), [], "_giver", "_rank")
    takers = hash_rank(ids, [], order_key(seed, id_col), [id_col], "_rank")
    partners = takers.join(givers, "_rank").drop("_rank")
    values = df.select(F.col(id_col).alias("_giver"), column)
    return df.drop(column).join(partners, id_col).join(values, "_giver").drop("_giver")


def letter_noise(text: Column | str, seed: int, *ids: Column | str) -> Column:
    """Each ASCII letter becomes a random letter of the same case; other characters stay.

    One md5 serves sixteen characters: its four groups of eight hex digits are numbers whose
    last four base-26 digits choose a letter each.
    """
    text = as_col(text)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(text) / LETTERS_PER_HASH).cast("int")),
        lambda b: order_key(seed, *ids, b),
    )
    numbers = F.flatten(
        F.transform(
            blocks,
            lambda h: F.array(*[hex_number(F.substr(h, F.lit(at), F.lit(8))) for at in HASH_PARTS]),
        )
    )
    powers = F.array(*[F.lit(26**k) for k in range(4)])

    def noisy(c: Column, i: Column, numbers: Column) -> Column:
        number = F.get(numbers, F.floor(i / 4).cast("int"))
        divisor = F.get(powers, i % 4)
        place = (F.floor(number / divisor) % 26 + 1).cast("int")
        code = F.ascii(c)
        return (
            F.when(code.between(97, 122), F.substr(F.lit(LOWER), place, F.lit(1)))
            .when(code.between(65, 90), F.substr(F.lit(UPPER), place, F.lit(1)))
            .otherwise(c)
        )

    return bind(
        numbers,
        lambda n: F.array_join(F.transform(F.split(text, ""), lambda c, i: noisy(c, i, n)), ""),
    )


def build_nli(
    raw: DataFrame,
    skip_labels: list[str] | None = None,
    label_map: dict[str, str] | None = None,
    premise_mode: str = "none",
    seed: int = 0,
    features: tuple[str, ...] = ("premise", "hypothesis", "label"),
) -> DataFrame:
    """Raw sentence pairs to ``pair_id`` + features; premises are randomised before filtering."""
    if premise_mode not in PREMISE_MODES:
        raise ValueError(f"premise_mode must be one of {PREMISE_MODES}")
    skip = ["contradiction"] if skip_labels is None else skip_labels
    mapping = label_map or {label: label for label in LABELS}
    df = alias_sentences(raw)
    if premise_mode == "shuffle_premises":
        df = shuffle_column(df, "pair_id", "premise", seed)
    df = keep_labels(df, skip).withColumn("label", label_code(mapping, skip))
    if premise_mode == "random_bits":
        df = df.withColumn("premise", letter_noise("premise", seed, "pair_id"))
    return df.select("pair_id", *features)
