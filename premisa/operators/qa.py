"""Question-answer examples with premises taken from proof records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premisa.functions.exprs import as_col, hash_number, order_key, strip
from premisa.operators.nli import letter_noise
from premisa.operators.ranking import number_rank

PREMISE_MODES = ["support", "distract", "random", "none"]

# The seven named builder configurations (premise source, share of true premises).
PRESETS = {
    "v3_base_all_true": ("support", 1.0),
    "v3_base_all_false": ("support", 0.0),
    "v3_distract_all_true": ("distract", 1.0),
    "v3_distract_all_false": ("distract", 0.0),
    "v3_random_all_true": ("random", 1.0),
    "v3_random_all_false": ("random", 0.0),
    "v3_none": ("none", 1.0),
}

# Columns of the choices CSV that are not used.
UNUSED_CSV = [
    "totalPossiblePoint",
    "includesDiagram",
    "isMultipleChoiceQuestion",
    "originalQuestionID",
]


def two_way_split(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Each row goes to ``train`` or ``test`` with equal chance, whatever the partitioning."""
    heads = F.pmod(hash_number(order_key(seed, id_col)), F.lit(2)) == 0
    return df.withColumn("split", F.when(heads, "train").otherwise("test"))


def clean_choices_csv(csv: DataFrame) -> DataFrame:
    """Drop what is not used; the answer key is taken from the JSON side."""
    return csv.drop(*UNUSED_CSV, "AnswerKey").withColumnRenamed(
        "question", "question_and_answers"
    )


def join_choice_parts(parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """For each part, the JSON choices equi-joined with their CSV twin; parts concatenated."""

    def one(part: str, nested: DataFrame, csv: DataFrame) -> DataFrame:
        nested = nested.withColumnRenamed("question", "question_json")
        flat = clean_choices_csv(csv)
        return nested.join(flat, nested["id"] == flat["questionID"]).withColumn(
            "part", F.lit(part)
        )

    frames = [one(part, nested, csv) for part, (nested, csv) in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_proofs_choices(proofs: DataFrame, choices: DataFrame, seed: int = 0) -> DataFrame:
    """Proof records with a random split, left-joined with their choices on ``id``."""
    return two_way_split(proofs, "id", seed).join(choices, "id", "left")


def last_step_keys(proof: Column | str) -> Column:
    """Premise keys of the proof's last complete step."""
    step = F.element_at(F.split(strip(proof), ";"), -2)
    return F.transform(F.split(F.replace(step, F.lit("-> hypothesis")), "&"), strip)


def merged_facts(triples: Column, conclusions: Column) -> Column:
    """Both maps as one; for a shared key the conclusion wins (LAST_WIN session setting)."""
    return F.map_concat(triples, conclusions)


def look_up(keys: Column, facts: Column) -> Column:
    """Texts of the keys; a missing key is an error."""

    def one(key: Column) -> Column:
        missing = F.raise_error(F.concat(F.lit("no fact named "), key)).cast("string")
        return F.coalesce(facts[key], missing)

    return F.transform(keys, one)


def as_sentence(text: Column) -> Column:
    """First letter upper case, the rest lower case, and a full stop."""
    head = F.upper(F.substr(text, F.lit(1), F.lit(1)))
    return F.concat(head, F.lower(F.substr(text, F.lit(2))), F.lit("."))


def premises(mode: str, seed: int, id_col: str = "item_id") -> Column:
    """Premise sentences of a proof record for one premise source."""
    if mode not in PREMISE_MODES:
        raise ValueError(f"mode must be one of {PREMISE_MODES}")
    if mode == "none":
        return F.array().cast("array<string>")
    meta = F.col("meta")
    facts = merged_facts(meta["triples"], meta["intermediate_conclusions"])
    if mode == "distract":
        keys = F.slice(meta["distractors"], 1, 3)
    else:
        keys = last_step_keys("proof")
    sentences = F.transform(look_up(keys, facts), as_sentence)
    if mode == "random":
        return F.transform(sentences, lambda s, i: letter_noise(s, seed, F.col(id_col), i))
    return sentences


def true_marks(size: Column, share: float, seed: int, id_col: str = "item_id") -> Column:
    """Boolean array with ``round(share * size)`` randomly placed trues (half goes to even)."""
    wanted = F.bround(F.lit(float(share)) * size).cast("int")
    indexes = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )
    keyed = F.transform(
        indexes,
        lambda i: F.struct(order_key(seed, F.col(id_col), i).alias("k"), i.alias("i")),
    )
    chosen = F.transform(F.slice(F.array_sort(keyed), 1, wanted), lambda s: s["i"])
    return F.transform(indexes, lambda i: F.array_contains(chosen, i))


def wrong_choices(choices: Column | str, answer_key: Column | str) -> Column:
    """The choices that are not the answer, full stops removed from their texts."""
    others = F.filter(as_col(choices), lambda c: c["label"] != as_col(answer_key))
    return F.transform(
        others,
        lambda c: F.struct(
            c["label"].alias("label"),
            F.replace(c["text"], F.lit("."), F.lit("")).alias("text"),
        ),
    )


def two_answers(seed: int, id_col: str = "item_id") -> Column:
    """The right answer and one random wrong one, in random order, lettered (A) and (B)."""
    number = hash_number(order_key(seed, id_col))
    wrong = wrong_choices("choices", "answer_key")
    pick = F.element_at(wrong, (F.pmod(number, F.size(wrong)) + 1).cast("int"))

    def answer(letter: str, key: Column, text: Column, label: int) -> Column:
        return F.struct(
            key.alias("key"),
            F.concat(F.lit(f"({letter}) "), text).alias("text"),
            F.lit(label).alias("label"),
        )

    key, text = F.col("answer_key"), F.col("answer")
    right_first = F.array(answer("A", key, text, 1), answer("B", pick["label"], pick["text"], 0))
    wrong_first = F.array(answer("A", pick["label"], pick["text"], 0), answer("B", key, text, 1))
    coin = F.pmod(hash_number(order_key(seed + 1, id_col)), F.lit(2))
    return F.when(coin == 0, right_first).otherwise(wrong_first)


def with_options(question: Column | str, answers: Column | str) -> Column:
    texts = F.transform(as_col(answers), lambda a: a["text"])
    return F.concat_ws(" ", as_col(question), F.array_join(texts, " "))


def build_qa(
    records: DataFrame,
    premise_mode: str = "support",
    true_proportion: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Two rows per record, one per answer, with premises and their true/false marks.

    ``records`` holds ``item_id, proof, meta, hypothesis, choices, answer_key, answer``. The
    generated key is ``label * N + index`` with the record's 0-based position by ``item_id``, which
    must be unique. A record without choices or without an answer is an error.
    """
    total = records.count()
    given = (F.size("choices") > 1) & F.col("answer_key").isNotNull() & F.col("answer").isNotNull()
    text = F.concat(F.lit("no choices for record "), F.col("item_id").cast("string"))
    checked = records.filter(F.assert_true(F.coalesce(given, F.lit(False)), text).isNull())
    # only ids are ranked; the records' texts are joined by id
    rows = checked.join(number_rank(records.select("item_id"), [], "item_id", "_rank"), "item_id")
    rows = rows.withColumn("premises", premises(premise_mode, seed))
    rows = rows.withColumn("truths", true_marks(F.size("premises"), true_proportion, seed))
    rows = rows.withColumn("_answers", two_answers(seed))
    rows = rows.withColumn("question", with_options(F.col("meta.question_text"), "_answers"))
    sides = rows.withColumn("_a", F.explode("_answers"))
    return sides.select(
        (F.col("_a.label") * F.lit(total) + F.col("_rank") - 1).alias("key"),
        F.col("_a.label").alias("label"),
        "question",
        "premises",
        "hypothesis",
        F.col("_a.key").alias("answer_key"),
        F.col("_a.text").alias("answer"),
        "truths",
    )
