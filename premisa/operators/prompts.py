"""Contrast pairs: prompt rendering, guards, answer positions and the length filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premisa.functions.exprs import as_col, bind, order_key
from premisa.operators.ranking import hash_rank
from premisa.sources.catalog import TEMPLATES
from premisa.sources.staging import attach, settle

NO_TOKEN = -100
ANSWER_SLOTS = 5
WINDOW_LIMIT = 1000  # up to here Spark cuts each group map-side before ranking it


def template_name(name: str | None = None, ordinal: int | None = None) -> str:
    """A template by its name or by its position in the table."""
    return list(TEMPLATES)[ordinal] if ordinal is not None else name


def render(text: str, columns: list[str]) -> Column:
    """Fill the ``{column}`` places of a template in one go, so values are never re-scanned."""
    parts: list[Column] = []
    rest = text
    while rest:
        places = [(rest.find("{" + c + "}"), c) for c in columns if "{" + c + "}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, column = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.col(column))
        rest = rest[at + len(column) + 2 :]
    return F.concat(*parts)


def marked(premises: Column | str, truths: Column | str) -> Column:
    """All premises as sentences that say whether each is true; no premises give no text."""
    sentences = F.zip_with(
        as_col(premises),
        as_col(truths),
        lambda p, t: F.concat(
            F.lit('The statement "'), p, F.when(t, F.lit('" is true. ')).otherwise('" is false. ')
        ),
    )
    return F.array_join(sentences, "")


def contrast_pairs(examples: DataFrame, name: str | None = None, ordinal: int | None = None):
    """One row per example with the prompt answered as if its label were 0 and 1."""
    question, no, yes = TEMPLATES[template_name(name, ordinal)]
    if "{marked_premises}" in question:
        examples = examples.withColumn("marked_premises", marked("premises", "truths"))
    columns = [c for c in examples.columns if c != "label"]
    return (
        examples.withColumn("neg_question", render(question, columns))
        .withColumn("pos_question", render(question, columns))
        .withColumn("neg_answer", render(no, columns))
        .withColumn("pos_answer", render(yes, columns))
    )


def choice_violations(examples: DataFrame, choices: str) -> DataFrame:
    """Rows that do not have exactly two answer choices."""
    return examples.filter(F.size(choices) != 2)


def prefix_violations(pairs: DataFrame) -> DataFrame:
    """Pairs whose two sides start with different questions."""
    return pairs.filter(F.col("neg_question") != F.col("pos_question"))


def same_side_violations(pairs: DataFrame) -> DataFrame:
    """Pairs whose two sides are equal token by token."""
    same = F.split("neg_answer", " ") == F.split("pos_answer", " ")
    return pairs.filter(same & (F.col("neg_question") == F.col("pos_question")))


def guarded(pairs: DataFrame) -> DataFrame:
    """The pairs, failing on the first one that breaks a guard."""
    equal = F.assert_true(
        F.col("neg_question") == F.col("pos_question"), F.lit("questions differ")
    )
    differ = F.assert_true(F.col("neg_answer") != F.col("pos_answer"), F.lit("sides are equal"))
    return pairs.filter(equal.isNull() & differ.isNull())


def input_text(question: Column | str, answer: Column | str, period: bool = False) -> Column:
    text = F.concat_ws(" ", as_col(question), as_col(answer))
    return F.concat(text, F.lit(".")) if period else text


def model_inputs(
    question: Column | str, answer: Column | str, model_type: str, use_decoder: bool = False
) -> tuple[Column, Column]:
    """(input, decoder input): the answer goes to the decoder only for that kind of model."""
    if model_type == "encoder_decoder" and use_decoder:
        return as_col(question), as_col(answer)
    return input_text(question, answer), F.lit("")


def token_count(text: Column | str) -> Column:
    """Tokens are the pieces between single blanks."""
    return F.size(F.split(as_col(text), " "))


def token_spans(text: Column | str) -> Column:
    """Array of (lo, hi) character offsets of the blank-separated tokens, end exclusive."""
    start = F.lit(0).cast("int")
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    spans = F.aggregate(
        F.split(as_col(text), " "),
        F.struct(start.alias("at"), empty.alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t) + 1).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(acc["at"].alias("lo"), (acc["at"] + F.length(t)).alias("hi"))
                ),
            ).alias("out"),
        ),
    )
    return spans["out"]


def find_all(text: Column | str, sub: Column | str) -> Column:
    """Non-overlapping occurrences as (lo, hi), end inclusive; the last character never matches.

    Any characters may be looked for; an empty substring occurs nowhere.

    The text without its last character is cut at the substring; piece lengths give positions.
    """
    text, sub = as_col(text), as_col(sub)
    body = F.substr(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))
    # an end of quotation inside the substring is itself quoted
    inside = F.replace(sub, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    quoted = F.concat(F.lit("\\Q"), inside, F.lit("\\E"))
    lengths = F.transform(F.split(body, quoted, -1), lambda p: F.length(p))
    pieces = F.slice(lengths, 1, F.when(F.length(sub) > 0, F.size(lengths) - 1).otherwise(0))
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    return bind(
        F.length(sub),
        lambda n: F.aggregate(
            pieces,
            F.struct(F.lit(0).cast("int").alias("at"), empty.alias("out")),
            lambda acc, piece: F.struct(
                (acc["at"] + piece + n).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + piece).alias("lo"),
                            (acc["at"] + piece + n - 1).alias("hi"),
                        )
                    ),
                ).alias("out"),
            ),
        )["out"],
    )


def overlapping_tokens(spans: Column | str, ranges: Column | str) -> Column:
    """Positions of the tokens that touch any of the ranges (bounds inclusive on both sides)."""
    touched = F.transform(
        as_col(spans),
        lambda t, i: F.when(
            F.exists(as_col(ranges), lambda r: (r["lo"] <= t["hi"]) & (t["lo"] <= r["hi"])), i
        ),
    )
    return F.filter(touched, lambda i: i.isNotNull())


def answer_range(question: Column | str, answer: Column | str) -> Column:
    """The answer's own (lo, hi) in ``question + ' ' + answer``."""
    start = F.length(as_col(question)) + 1
    return F.struct(start.alias("lo"), (start + F.length(as_col(answer))).alias("hi"))


def padded(positions: Column | str, slots: int = ANSWER_SLOTS) -> Column:
    positions = as_col(positions)
    missing = F.greatest(F.lit(slots) - F.size(positions), F.lit(0))
    return F.concat(positions, F.array_repeat(F.lit(NO_TOKEN), missing))


def unpadded(positions: Column | str) -> Column:
    return F.filter(as_col(positions), lambda p: p != NO_TOKEN)


def pair_positions(pairs: DataFrame) -> DataFrame:
    """Add the token positions of each side's answer and of its other mentions in the question."""
    question = F.col("neg_question")
    mentions = F.concat(find_all(question, "neg_answer"), find_all(question, "pos_answer"))
    rows = pairs.withColumn("_neg", token_spans(input_text(question, "neg_answer"))).withColumn(
        "_pos", token_spans(input_text("pos_question", "pos_answer"))
    )
    rows = rows.withColumn(
        "other_answer_idx", padded(overlapping_tokens("_neg", mentions))
    )
    for side in ("neg", "pos"):
        own = F.array(answer_range(f"{side}_question", f"{side}_answer"))
        rows = rows.withColumn(f"{side}_answer_idx", overlapping_tokens(f"_{side}", own))
    return rows.drop("_neg", "_pos")


def first_kept(
    df: DataFrame, keys: list[str], key: Column, ids: list[str], wanted: int
) -> DataFrame:
    """The first ``wanted`` rows of each group in hash order, with their position.

    Up to ``WINDOW_LIMIT`` Spark cuts every group to ``wanted`` rows per task before the shuffle;
    above that, ranks are counted bucket by bucket.
    """
    if wanted > WINDOW_LIMIT:
        return hash_rank(df, keys, key, ids, "position").filter(F.col("position") <= wanted)
    order = Window.partitionBy(*keys).orderBy("_k", *ids)
    position = F.row_number().over(order).cast("bigint")
    ranked = df.withColumn("_k", key).withColumn("position", position)
    return ranked.filter(F.col("position") <= wanted).drop("_k")


def sample_short(
    df: DataFrame, keys: list[str], ids: list[str], length: str, limit: int, wanted: int, seed: int
) -> DataFrame:
    """First ``wanted`` rows of a random permutation among those shorter than ``limit - 2``."""
    fitting = df.filter(F.col(length) < limit - 2)
    return first_kept(fitting, keys, order_key(seed, *ids), ids, wanted)


def length_cap(
    df: DataFrame, keys: list[str], ids: list[str], length: str, limit: int, wanted: int, seed: int
) -> DataFrame:
    """Longest row met before ``wanted`` rows were kept, rejected rows included, plus two."""
    kept = sample_short(df, keys, ids, length, limit, wanted, seed)
    here = F.struct(order_key(seed, *ids).alias("k"), *ids)
    last = kept.filter(F.col("position") == wanted).select(*keys, here.alias("_last"))
    if keys:
        scanned = attach(df, settle(last, "last-kept"), keys, ids, "left")
        scanned = scanned.filter(F.col("_last").isNull() | (here <= F.col("_last")))
    else:  # a single row, so it becomes a constant of the filter
        found = last.select("_last.*").first()
        bound = [] if found is None else [F.lit(v).alias(n) for n, v in found.asDict().items()]
        scanned = df.filter(here <= F.struct(*bound)) if bound else df
    return scanned.groupBy(*keys).agg((F.max(length) + 2).cast("int").alias("max_length"))


def rendered(examples: DataFrame, prompt_name: str, add_period: bool = False) -> DataFrame:
    """Contrast pairs with the token count of the true side; a pair whose questions differ or whose
    answers agree is an error."""
    pairs = guarded(contrast_pairs(examples, prompt_name))
    own = F.when(F.col("label") == 1, F.col("pos_answer")).otherwise(F.col("neg_answer"))
    return pairs.withColumn("_n", token_count(input_text("neg_question", own, add_period)))


def sample_pairs(
    pairs: DataFrame, ids: list[str], keys: list[str], num_examples: int, max_len: int, seed: int
) -> DataFrame:
    """Drop what is too long and keep a random ``num_examples`` per group, with ``position`` and the
    group's ``max_length``.

    ``ids`` name an example within its group. The order is found on ids and lengths alone; texts are
    only joined to what is kept.
    """
    kept = sampled_ids(pairs, ids, keys, num_examples, max_len, seed)
    return attach(pairs.drop("_n"), kept, [*keys, *ids], ids)


def sampled_ids(
    pairs: DataFrame, ids: list[str], keys: list[str], num_examples: int, max_len: int, seed: int
) -> DataFrame:
    """The kept ids of ``sample_pairs``, staged; only ids and lengths of the pairs are read."""
    narrow = settle(pairs.select(*keys, *ids, "_n"), "lengths")
    kept = sample_short(narrow, keys, ids, "_n", max_len, num_examples, seed).drop("_n")
    cap = length_cap(narrow, keys, ids, "_n", max_len, num_examples, seed)
    if keys:
        kept = attach(kept, settle(cap, "length-caps"), keys, ids)
    else:
        kept = kept.withColumn("max_length", F.lit(cap.first()["max_length"]).cast("int"))
    return settle(kept, "kept")


def load_pairs(
    examples: DataFrame,
    prompt_name: str,
    ids: list[str],
    keys: list[str] | None = None,
    add_period: bool = False,
    num_examples: int = 1000,
    max_len: int = 2048,
    seed: int = 0,
) -> DataFrame:
    """Render, drop what is too long, keep a random ``num_examples`` per group, and pair up.

    All examples are rendered once, for the guards and their lengths; after that only the kept ones.
    """
    by, pairs = keys or [], rendered(examples, prompt_name, add_period)
    kept = sampled_ids(pairs, ids, by, num_examples, max_len, seed)
    chosen = contrast_pairs(attach(examples, kept, [*by, *ids], ids), prompt_name)
    return chosen.select(*(c for c in pairs.columns if c != "_n"), "position", "max_length")


def sample_listing(pairs: DataFrame, id_col: str, rows: int = 10) -> DataFrame:
    """The first ten rendered negatives, as the reporting step lists them."""
    return (
        pairs.orderBy(id_col)
        .limit(rows)
        .select(id_col, input_text("neg_question", "neg_answer").alias("sample"))
    )
