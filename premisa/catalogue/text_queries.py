"""Queries that build text datasets and contrast pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from premisa.catalogue.registry import query
from premisa.functions.exprs import hash_number, order_key, strip
from premisa.operators import nli, prompts, qa
from premisa.operators.ranking import hash_rank
from premisa.plans import datasets, results
from premisa.sources import fixtures as fx
from premisa.sources import io
from premisa.sources.catalog import DATASETS, TEMPLATES, VARIANTS, variant_catalog
from premisa.sources.staging import new_path

# --- sources and sinks ---------------------------------------------------------------------


@query(
    "s1_nli_scan",
    """SELECT CAST(pair_id AS VARCHAR) AS pair_id, length(sentence1) AS n1, length(sentence2) AS n2,
  md5(sentence1) AS h1, md5(sentence2) AS h2, gold_label FROM nli""",
    "nli",
)
def s1(spark, sf):
    path = new_path(spark, "nli")
    raw = fx.nli(spark, sf).withColumnRenamed("pair_id", "pairID")
    raw.withColumn("pairID", F.col("pairID").cast("string")).write.json(path)
    return io.read_nli(spark, path).select(
        F.col("pairID").alias("pair_id"),
        F.length("sentence1").alias("n1"),
        F.length("sentence2").alias("n2"),
        F.md5("sentence1").alias("h1"),
        F.md5("sentence2").alias("h2"),
        "gold_label",
    )


def _proof_files(spark, sf) -> str:
    """Proof records of all parts as three files, one per original split."""
    folder = new_path(spark, "proofs")
    records = fx.proofs(spark, sf).join(fx.choices(spark, sf).select("item_id", "answer"), "item_id")
    number = F.pmod(hash_number(order_key(7, "item_id")), F.lit(3))
    for i, split in enumerate(io.SPLITS):
        part = records.filter(number == i).withColumn("id", F.col("item_id").cast("string"))
        part.select("id", "hypothesis", "proof", "answer", "meta").write.json(
            f"{folder}/{split}.jsonl"
        )
    return folder


@query(
    "s2_proof_scan",
    """SELECT CAST(p.p_partkey AS VARCHAR) AS id,
  ['train', 'dev', 'test'][CAST('0x' || substr(md5('7:' || p.p_partkey), 1, 8) AS BIGINT) % 3 + 1]
    AS original_split,
  'the part is ' || p_name AS hypothesis, p_name AS sent1,
  CASE WHEN p_size % 2 = 0 THEN 'an Even size' END AS redefined,
  CAST(p_partkey % 4 + 1 AS INT) AS distractors FROM part p""",
)
def s2(spark, sf):
    df = io.read_proofs(spark, _proof_files(spark, sf))
    return df.select(
        "id",
        "original_split",
        "hypothesis",
        F.col("meta.triples")["sent1"].alias("sent1"),
        F.col("meta.intermediate_conclusions")["sent4"].alias("redefined"),
        F.size("meta.distractors").alias("distractors"),
    )


def _choice_files(spark, sf) -> tuple[str, str]:
    nested, flat = new_path(spark, "choices"), new_path(spark, "choices-csv")
    rows = fx.choices(spark, sf).withColumn("id", F.col("item_id").cast("string"))
    rows.select(
        "id",
        F.col("answer_key").alias("answerKey"),
        F.struct(F.col("choices").alias("choices")).alias("question"),
    ).write.json(nested)
    texts = F.array_join(F.transform("choices", lambda c: c["text"]), ' "or", ')
    rows.select(
        F.col("id").alias("questionID"),
        F.col("id").alias("originalQuestionID"),
        F.lit("1").alias("totalPossiblePoint"),
        F.col("answer_key").alias("AnswerKey"),
        F.lit("1").alias("isMultipleChoiceQuestion"),
        F.lit("0").alias("includesDiagram"),
        F.concat(F.lit("Pick: "), texts).alias("question"),
    ).write.option("header", True).option("escape", '"').csv(flat)
    return nested, flat


@query(
    "s1_bad_lines",
    """SELECT CAST(pair_id AS VARCHAR) AS pair_id,
  CASE pair_id % 5 WHEN 1 THEN 'cut' WHEN 2 THEN 'list' WHEN 3 THEN 'text' ELSE 'sound' END AS kind,
  pair_id % 5 NOT IN (1, 2, 3) AS taken FROM nli""",
    "nli",
)
def s1_bad(spark, sf):
    """Lines cut short, lists and lines without braces are set aside; all others are read."""
    path = new_path(spark, "nli-bad")
    raw = fx.nli(spark, sf).withColumn("pairID", F.col("pair_id").cast("string"))
    line = F.to_json(F.struct("pairID", "sentence1", "sentence2", "gold_label"))
    own = F.concat(F.lit('"pairID":"'), "pairID", F.lit('"'))
    turn = F.col("pair_id") % 5
    broken = F.when(turn == 1, F.substring(line, F.lit(1), F.length(line) - 1))
    broken = broken.when(turn == 2, F.concat(F.lit("["), line, F.lit("]"))).when(turn == 3, own)
    raw.select(broken.otherwise(line).alias("value")).write.text(path)
    taken = io.read_nli(spark, path, on_bad="skip").select(
        F.col("pairID").alias("pair_id"), F.lit("sound").alias("kind"), F.lit(True).alias("taken")
    )
    text = F.col("line")
    kind = F.when(F.startswith(text, F.lit("[")), "list").when(F.startswith(text, F.lit('"')), "text")
    aside = io.bad_lines(spark, path, io.NLI_SCHEMA).select(
        F.regexp_extract(text, '"pairID":"([0-9]+)"', 1).alias("pair_id"),
        kind.otherwise("cut").alias("kind"),
        F.lit(False).alias("taken"),
    )
    return taken.unionByName(aside)


@query(
    "s3_choices_scan",
    """SELECT CAST(item_id AS VARCHAR) AS id, answer_key, label, text FROM chs""",
    "chs",
)
def s3(spark, sf):
    df = io.read_choices(spark, [_choice_files(spark, sf)[0]])
    return df.select(
        "id", F.col("answerKey").alias("answer_key"), F.inline("question.choices")
    )


PICK = """'Pick: ' || p_name || '. "or", ' || p_brand || '. "or", ' || p_type || '. "or", '
  || p_size || '.'"""


@query(
    "s4_choices_csv_scan",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS id, substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1)
  AS answer_key, {PICK} AS question FROM part""",
)
def s4(spark, sf):
    df = io.read_choices_csv(spark, [_choice_files(spark, sf)[1]])
    return df.select(
        F.col("questionID").alias("id"), F.col("AnswerKey").alias("answer_key"), "question"
    )


@query(
    "s5_split_sink",
    """SELECT pair_id, gold_label, length(sentence1) AS n1,
  CASE WHEN CAST('0x' || substr(md5('0:' || pair_id), 1, 8) AS BIGINT) % 2 = 0 THEN 'train'
  ELSE 'test' END AS split FROM nli""",
    "nli",
)
def s5(spark, sf):
    path = io.write_splits(
        qa.two_way_split(fx.nli(spark, sf), "pair_id", 0), new_path(spark, "splits")
    )
    schema = "pair_id bigint, sentence1 string, gold_label string, split string"
    return spark.read.schema(schema).json(path).select(
        "pair_id", "gold_label", F.length("sentence1").alias("n1"), "split"
    )


@query(
    "s6_save_load_tables",
    """SELECT p.p_partkey AS item_id, p_name AS name, o.n
FROM part p JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) o
 ON o.l_partkey = p.p_partkey""",
)
def s6(spark, sf):
    tables = {
        "parts": fx.table(spark, sf, "part").select(
            F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")
        ),
        "uses": fx.table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("item_id"))
        .agg(F.count("*").alias("n")),
    }
    folder = io.save_tables(tables, new_path(spark, "database"))
    back = io.load_tables(spark, folder, list(tables))
    return back["parts"].join(back["uses"], "item_id")


@query(
    "s7_save_load_tuple",
    "SELECT item_id, answer_key, 4 AS choices FROM (SELECT DISTINCT item_id, answer_key FROM chs)",
    "chs",
)
def s7(spark, sf):
    rows = fx.choices(spark, sf)
    elements = {
        "elem_0": rows.select("item_id", "answer_key"),
        "elem_1": rows.select("item_id", F.size("choices").alias("choices")),
    }
    folder = io.save_tables(elements, new_path(spark, "tuple"))
    first, second = io.load_tables(spark, folder, list(elements)).values()
    return first.join(second, "item_id")


_CATALOG_ROWS = ", ".join(
    f"('{d}','{v}','{s['name']}','{c}','{p}','{s['split']}')"
    for d, s in DATASETS.items()
    for v, (c, p) in s["variants"].items()
)


@query(
    "s9_variant_catalog",
    f"""SELECT c.dataset, c.variant, c.name, c.config, c.prompt, c.split, p.rows
FROM (VALUES {_CATALOG_ROWS}) AS c(dataset, variant, name, config, prompt, split)
JOIN (SELECT variant, count(*) AS rows FROM pred GROUP BY 1) p USING (variant)""",
    "pred",
)
def s9(spark, sf):
    rows = fx.predictions(spark, sf).groupBy("variant").agg(F.count("*").alias("rows"))
    return variant_catalog(spark).join(rows, "variant")


# --- sentence pairs ------------------------------------------------------------------------


@query(
    "p1_alias_sentences",
    "SELECT pair_id, md5(sentence1) AS premise, md5(sentence2) AS hypothesis FROM nli",
    "nli",
)
def p1(spark, sf):
    df = nli.alias_sentences(fx.nli(spark, sf))
    return df.select(
        "pair_id", F.md5("premise").alias("premise"), F.md5("hypothesis").alias("hypothesis")
    )


@query(
    "p2_label_filter",
    "SELECT pair_id, gold_label FROM nli WHERE gold_label IN ('contradiction', 'entailment')",
    "nli",
)
def p2(spark, sf):
    return nli.keep_labels(fx.nli(spark, sf), ["neutral"]).select("pair_id", "gold_label")


def _preset_query(preset: str, sql: str) -> None:
    @query(f"p3_label_code_{preset}", sql, "nli")
    def run(spark, sf):
        spec = nli.PRESETS[preset]
        return nli.build_nli(
            fx.nli(spark, sf), features=("label",), **{k: v for k, v in spec.items()}
        )


_preset_query(
    "no_neutral",
    """SELECT pair_id, CASE gold_label WHEN 'contradiction' THEN 0 ELSE 1 END AS label
FROM nli WHERE gold_label IN ('contradiction', 'entailment')""",
)
_preset_query(
    "no_contradiction",
    """SELECT pair_id, CASE gold_label WHEN 'entailment' THEN 0 ELSE 1 END AS label
FROM nli WHERE gold_label IN ('entailment', 'neutral')""",
)
_preset_query(
    "neutral_vs_other",
    """SELECT pair_id, CASE gold_label WHEN 'neutral' THEN 0 ELSE 1 END AS label
FROM nli WHERE gold_label IN ('entailment', 'neutral')""",
)


@query(
    "p4_feature_subset",
    """SELECT pair_id, md5(sentence2) AS hypothesis,
  CASE gold_label WHEN 'contradiction' THEN 0 ELSE 1 END AS label
FROM nli WHERE gold_label IN ('contradiction', 'entailment')""",
    "nli",
)
def p4(spark, sf):
    df = nli.build_nli(fx.nli(spark, sf), ["neutral"], features=("hypothesis", "label"))
    return df.withColumn("hypothesis", F.md5("hypothesis"))


@query(
    "p5_shuffle_premise",
    """SELECT t.pair_id, md5(g.sentence1) AS premise, md5(t.sentence2) AS hypothesis
FROM (SELECT *, row_number() OVER (ORDER BY md5('0:' || pair_id), pair_id) AS r FROM nli) t
JOIN (SELECT *, row_number() OVER (ORDER BY pair_id) AS r FROM nli) g USING (r)""",
    "nli",
)
def p5(spark, sf):
    df = nli.shuffle_column(nli.alias_sentences(fx.nli(spark, sf)), "pair_id", "premise", 0)
    return df.select(
        "pair_id", F.md5("premise").alias("premise"), F.md5("hypothesis").alias("hypothesis")
    )


_LETTER = """substr('{letters}', CAST(CAST('0x' || substr(md5('{seed}:' || {id} || ':' ||
  ((i - 1) // 16)), CAST(((i - 1) % 16) // 4 * 8 + 1 AS BIGINT), 8) AS BIGINT)
  // [1, 26, 676, 17576][(i - 1) % 4 + 1] % 26 + 1 AS BIGINT), 1)"""
_NOISE = (
    "list_aggregate(list_transform(str_split({text}, ''), lambda c, i: "
    "CASE WHEN regexp_matches(c, '^[a-z]$') THEN "
    + _LETTER.replace("{letters}", nli.LOWER)
    + " WHEN regexp_matches(c, '^[A-Z]$') THEN "
    + _LETTER.replace("{letters}", nli.UPPER)
    + " ELSE c END), 'string_agg', '')"
)


@query(
    "p6_letter_noise",
    "SELECT pair_id, length(noisy) AS n, md5(noisy) AS premise FROM (SELECT pair_id, "
    + _NOISE.format(text="sentence1", seed=0, id="pair_id")
    + " AS noisy FROM nli)",
    "nli",
)
def p6(spark, sf):
    noisy = fx.nli(spark, sf).select("pair_id", nli.letter_noise("sentence1", 0, "pair_id").alias("noisy"))
    return noisy.select("pair_id", F.length("noisy").alias("n"), F.md5("noisy").alias("premise"))


# --- proofs and answers --------------------------------------------------------------------


@query("p7_last_step_keys", "SELECT item_id, i, key FROM keyed", "keyed")
def p7(spark, sf):
    df = fx.proofs(spark, sf)
    return df.select("item_id", F.posexplode(qa.last_step_keys("proof")).alias("i", "key"))


@query("p8_merge_and_look_up", "SELECT item_id, i, fact FROM keyed JOIN facts USING (item_id, key)", "keyed facts")
def p8(spark, sf):
    meta = F.col("meta")
    facts = qa.merged_facts(meta["triples"], meta["intermediate_conclusions"])
    found = qa.look_up(qa.last_step_keys("proof"), facts)
    return fx.proofs(spark, sf).select("item_id", F.posexplode(found).alias("i", "fact"))


@query(
    "p9_sentence_case",
    "SELECT p_partkey AS item_id, upper(p_type[1]) || lower(p_type[2:]) || '.' AS sentence FROM part",
)
def p9(spark, sf):
    df = fx.table(spark, sf, "part")
    return df.select(
        F.col("p_partkey").alias("item_id"), qa.as_sentence(F.col("p_type")).alias("sentence")
    )


def _premises_query(name: str, mode: str, sql: str, views: str) -> None:
    @query(name, sql, views)
    def run(spark, sf):
        found = F.posexplode(qa.premises(mode, 0)).alias("i", "premise")
        return fx.proofs(spark, sf).select("item_id", found)


_premises_query(
    "p10_distractors",
    "distract",
    """SELECT item_id, i, upper(fact[1]) || lower(fact[2:]) || '.' AS premise
FROM (SELECT item_id, unnest(range(len(d))) AS i, unnest(d) AS key
      FROM (SELECT item_id, list_slice(distractors, 1, 3) AS d FROM prf))
JOIN facts USING (item_id, key)""",
    "prf facts",
)
_premises_query(
    "p11_support_premises", "support", "SELECT item_id, i, premise FROM support", "support"
)
_premises_query(
    "p11_random_premises",
    "random",
    "SELECT item_id, i, " + _NOISE.format(text="premise", seed=0, id="item_id || ':' || j")
    + " AS premise FROM (SELECT *, i AS j FROM support)",
    "support",
)


@query("p12_wrong_choices", "SELECT item_id, label, text FROM wrong", "wrong")
def p12(spark, sf):
    wrong = qa.wrong_choices("choices", "answer_key")
    return fx.choices(spark, sf).select("item_id", F.inline(wrong))


@query(
    "p13_true_marks",
    """SELECT item_id, i, row_number() OVER (PARTITION BY item_id
  ORDER BY md5('0:' || item_id || ':' || i)) <= round_even(0.5 * n, 0) AS mark
FROM (SELECT item_id, len(distractors) AS n, unnest(range(len(distractors))) AS i FROM prf)""",
    "prf",
)
def p13(spark, sf):
    marks = qa.true_marks(F.size("meta.distractors"), 0.5, 0)
    return fx.proofs(spark, sf).select("item_id", F.posexplode(marks).alias("i", "mark"))


@query(
    "p14_two_answers",
    """SELECT item_id, right_key AS key, right_answer AS text, 1 AS label FROM asked
UNION ALL SELECT item_id, wrong_key, wrong_answer, 0 FROM asked""",
    "asked",
)
def p14(spark, sf):
    return fx.choices(spark, sf).select("item_id", F.inline(qa.two_answers(0)))


def _records(spark, sf):
    # sizes are estimated from compressed files, so without the hint the choices may be broadcast
    return fx.proofs(spark, sf).join(fx.choices(spark, sf).hint("merge"), "item_id")


@query("p15_question_with_options", "SELECT item_id, question FROM asked", "asked")
def p15(spark, sf):
    rows = _records(spark, sf).withColumn("_answers", qa.two_answers(0))
    question = qa.with_options(F.col("meta.question_text"), "_answers")
    return rows.select("item_id", question.alias("question"))


@query(
    "p16_build_qa",
    """SELECT a.side * count(*) OVER (PARTITION BY a.side) + r AS key, a.side AS label, question,
  premises, 'the part is ' || p.p_name AS hypothesis,
  CASE a.side WHEN 1 THEN right_key ELSE wrong_key END AS answer_key,
  CASE a.side WHEN 1 THEN right_answer ELSE wrong_answer END AS answer, 2 AS marks
FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS r FROM asked)
JOIN (SELECT item_id, string_agg(premise, '|' ORDER BY i) AS premises FROM support
      GROUP BY 1) USING (item_id)
JOIN part p ON p.p_partkey = item_id, (VALUES (0), (1)) AS a(side)""",
    "asked support",
)
def p16(spark, sf):
    df = qa.build_qa(_records(spark, sf), "support", 1.0, 0)
    marks = F.size(F.filter("truths", lambda t: t))
    return df.select(
        "key", "label", "question", F.array_join("premises", "|").alias("premises"), "hypothesis",
        "answer_key", "answer", marks.alias("marks"),
    )


@query(
    "p17_clean_choice_columns",
    f"SELECT CAST(p_partkey AS VARCHAR) AS id, {PICK} AS question_and_answers, 'easy' AS part FROM part",
)
def p17(spark, sf):
    csv = io.read_choices_csv(spark, [_choice_files(spark, sf)[1]])
    cleaned = qa.clean_choices_csv(csv).withColumn("part", F.lit("easy"))
    return cleaned.select(F.col("questionID").alias("id"), "question_and_answers", "part")


_SPLIT_SQL = """SELECT p_partkey AS id, CASE WHEN CAST('0x' || substr(md5('3:' || p_partkey), 1, 8)
  AS BIGINT) % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM part"""


@query("p18_two_way_split", _SPLIT_SQL)
def p18(spark, sf):
    rows = fx.proofs(spark, sf).select(F.col("item_id").alias("id"))
    return qa.two_way_split(rows, "id", 3)


@query("p19_split_filter", f"SELECT * FROM ({_SPLIT_SQL}) WHERE split = 'train'")
def p19(spark, sf):
    return p18(spark, sf).filter(F.col("split") == "train")


@query(
    "j1_choices_with_csv",
    f"""SELECT CAST(item_id AS VARCHAR) AS id, answer_key, label, text,
  {PICK} AS question_and_answers, 'easy' AS part
FROM chs JOIN part ON p_partkey = item_id""",
    "chs",
)
def j1(spark, sf):
    nested, flat = _choice_files(spark, sf)
    joined = qa.join_choice_parts(
        {"easy": (io.read_choices(spark, [nested]), io.read_choices_csv(spark, [flat]))}
    )
    return joined.select(
        "id", F.col("answerKey").alias("answer_key"), F.inline("question_json.choices"),
        "question_and_answers", "part",
    )


@query(
    "j2_proofs_with_choices",
    """SELECT p.p_partkey AS id, c.answer_key, CASE WHEN CAST('0x' || substr(md5('0:' ||
  p.p_partkey), 1, 8) AS BIGINT) % 2 = 0 THEN 'train' ELSE 'test' END AS split
FROM part p LEFT JOIN (SELECT DISTINCT item_id, answer_key FROM chs WHERE answer_key <> 'D') c
 ON c.item_id = p.p_partkey""",
    "chs",
)
def j2(spark, sf):
    """Parts answered by D have no choice record, so the left join keeps them without one."""
    choices = fx.choices(spark, sf).filter("answer_key <> 'D'")
    merged = qa.merge_proofs_choices(
        fx.proofs(spark, sf).withColumnRenamed("item_id", "id"),
        choices.withColumnRenamed("item_id", "id"),
    )
    return merged.select("id", "answer_key", "split")


# --- prompts and positions -----------------------------------------------------------------


def coded(spark, sf):
    return nli.build_nli(fx.nli(spark, sf), ["neutral"])


@query(
    "p20_prompt_render",
    "SELECT pair_id, md5(question) AS question, 'incorrect' AS neg, 'correct' AS pos FROM rendered",
    "rendered",
)
def p20(spark, sf):
    df = prompts.contrast_pairs(coded(spark, sf), "pic-full")
    return df.select(
        "pair_id",
        F.md5("neg_question").alias("question"),
        F.col("neg_answer").alias("neg"),
        F.col("pos_answer").alias("pos"),
    )


QA_QUESTION = """'Question: "' || question || '" Is "' || answer || '" right?'"""


@query(
    "p21_contrast_pair",
    f"""SELECT conv_id, turn, md5({QA_QUESTION} || ' No') AS neg, md5({QA_QUESTION} || ' Yes') AS pos
FROM qas""",
    "qas",
)
def p21(spark, sf):
    df = prompts.contrast_pairs(fx.qa(spark, sf), ordinal=list(TEMPLATES).index("question-answer"))
    return df.select(
        "conv_id",
        "turn",
        F.md5(prompts.input_text("neg_question", "neg_answer")).alias("neg"),
        F.md5(prompts.input_text("pos_question", "pos_answer")).alias("pos"),
    )


@query(
    "p22_choice_guard",
    "SELECT item_id, CAST(count(*) AS INT) AS choices FROM wrong GROUP BY 1 HAVING count(*) <> 2",
    "wrong",
)
def p22(spark, sf):
    """Items whose wrong choices alone are not two, as every item of four choices."""
    rows = fx.choices(spark, sf).withColumn("_w", qa.wrong_choices("choices", "answer_key"))
    return prompts.choice_violations(rows, "_w").select("item_id", F.size("_w").alias("choices"))


@query(
    "p23_prefix_guard",
    "SELECT item_id FROM asked WHERE right_answer <> wrong_answer",
    "asked",
)
def p23(spark, sf):
    """A pair whose questions are its answers breaks the guard in every row."""
    rows = fx.choices(spark, sf).withColumn("_a", qa.two_answers(0))
    pairs = rows.select(
        "item_id", F.col("_a")[0]["text"].alias("neg_question"),
        F.col("_a")[1]["text"].alias("pos_question"),
    )
    return prompts.prefix_violations(pairs).select("item_id")


@query(
    "p24_distinct_guard",
    "SELECT p_partkey AS item_id FROM part WHERE p_brand = 'Brand#' || p_size",
)
def p24(spark, sf):
    """A part's brand against its size written as a brand: equal texts cannot form a pair."""
    pairs = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("neg_question"),
        F.col("p_name").alias("pos_question"),
        F.col("p_brand").alias("neg_answer"),
        F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("pos_answer"),
    )
    return prompts.same_side_violations(pairs).select("item_id")


@query(
    "p25_input_text",
    f"""SELECT conv_id, turn, md5({QA_QUESTION} || ' Yes.') AS plain, md5({QA_QUESTION}) AS encoder,
  'Yes' AS decoder FROM qas""",
    "qas",
)
def p25(spark, sf):
    df = prompts.contrast_pairs(fx.qa(spark, sf), "question-answer")
    encoder, decoder = prompts.model_inputs("pos_question", "pos_answer", "encoder_decoder", True)
    return df.select(
        "conv_id",
        "turn",
        F.md5(prompts.input_text("pos_question", "pos_answer", period=True)).alias("plain"),
        F.md5(encoder).alias("encoder"),
        decoder.alias("decoder"),
    )


def sized(spark, sf):
    pairs = prompts.contrast_pairs(coded(spark, sf), "pic-full")
    own = F.when(F.col("label") == 1, F.col("pos_answer")).otherwise(F.col("neg_answer"))
    count = prompts.token_count(prompts.input_text("neg_question", own))
    return pairs.withColumn("n", count)


@query("p26_length_filter", "SELECT pair_id, n FROM sized WHERE n < 400 - 2", "sized")
def p26(spark, sf):
    return sized(spark, sf).filter(F.col("n") < 400 - 2).select("pair_id", "n")


@query(
    "p27_length_cap",
    """SELECT CAST(max(n) + 2 AS INT) AS max_length FROM sized
WHERE k <= coalesce((SELECT k FROM sized WHERE n < 400 - 2 ORDER BY k LIMIT 1 OFFSET 99), 'z')""",
    "sized",
)
def p27(spark, sf):
    return prompts.length_cap(sized(spark, sf), [], ["pair_id"], "n", 400, 100, 0)


@query(
    "w4_first_kept",
    """SELECT pair_id, label, row_number() OVER (PARTITION BY label ORDER BY k) AS position
FROM sized WHERE n < 400 - 2
QUALIFY row_number() OVER (PARTITION BY label ORDER BY k) <= 50""",
    "sized",
)
def w4(spark, sf):
    kept = prompts.sample_short(sized(spark, sf), ["label"], ["pair_id"], "n", 400, 50, 0)
    return kept.select("pair_id", "label", F.col("position").cast("bigint").alias("position"))


@query(
    "d7_load_pairs",
    """SELECT pair_id, label, md5(question) AS question, row_number() OVER (ORDER BY k) AS position
FROM sized WHERE n < 2048 - 2 QUALIFY row_number() OVER (ORDER BY k) <= 1000""",
    "sized",
)
def d7(spark, sf):
    df = prompts.load_pairs(coded(spark, sf), "pic-full", ["pair_id"])
    return df.select(
        "pair_id", "label", F.md5("neg_question").alias("question"),
        F.col("position").cast("bigint").alias("position"),
    )


_MARK = "coalesce(string_agg('The statement \"' || premise || '\" is ' || mark || '. ', '' ORDER BY pi), '')"


@query(
    "d7_load_catalogue",
    f"""SELECT dataset, variant, sample_id, label, md5(question) AS question, position, max_length
FROM (SELECT *, max(n) FILTER (f - fit < 1000) OVER (PARTITION BY dataset, variant) + 2 AS max_length
 FROM (SELECT *, CAST(sum(fit) OVER (PARTITION BY dataset, variant ORDER BY k, sample_id) AS BIGINT)
         AS f,
       row_number() OVER (PARTITION BY dataset, variant, fit ORDER BY k, sample_id) AS position
  FROM (SELECT *, md5('0:' || sample_id) AS k, CAST(n < 2046 AS INT) AS fit
   FROM (SELECT *, length(txt) - length(replace(txt, ' ', '')) + 1 AS n
    FROM (SELECT *, question || ' ' || CASE label WHEN 1 THEN 'correct' ELSE 'incorrect' END AS txt
     FROM (
      SELECT 'snli' AS dataset, variant, pair_id AS sample_id, label, CASE prompt
        WHEN 1 THEN 'Consider the following premise: "' || premise || '" '
        WHEN 2 THEN 'Consider that the following premise is false: "' || premise || '" '
        ELSE '' END || 'The statement "' || hypothesis || '" is' AS question
      FROM (SELECT 0 AS kind, pair_id, premise, hypothesis, label FROM coded
        UNION ALL SELECT 1, c.pair_id, g.sentence1, c.hypothesis, c.label FROM coded c
        JOIN (SELECT pair_id, row_number() OVER (ORDER BY md5('0:' || pair_id), pair_id) AS r
              FROM nli) t USING (pair_id)
        JOIN (SELECT sentence1, row_number() OVER (ORDER BY pair_id) AS r FROM nli) g USING (r)
        UNION ALL SELECT 2, pair_id, {_NOISE.format(text="premise", seed=0, id="pair_id")},
          hypothesis, label FROM coded)
      JOIN (VALUES ('original_pos_prem', 0, 1), ('original_neg_prem', 0, 2),
        ('shuffle_pos_prem', 1, 1), ('shuffle_neg_prem', 1, 2), ('random_pos_prem', 2, 1),
        ('random_neg_prem', 2, 2), ('no_prem', 0, 0)) AS v(variant, kind, prompt) USING (kind)
      UNION ALL
      SELECT 'entbank', variant, side * count(*) OVER (PARTITION BY variant, side) + r, side,
        told || 'Question: "' || question || '" The answer "'
        || CASE side WHEN 1 THEN right_answer ELSE wrong_answer END || '" is'
      FROM (SELECT variant, item_id, {_MARK} AS told
        FROM (SELECT item_id FROM asked) CROSS JOIN (VALUES ('original_pos_prem', 0, 'true'),
          ('original_neg_prem', 0, 'false'), ('shuffle_pos_prem', 1, 'true'),
          ('shuffle_neg_prem', 1, 'false'), ('random_pos_prem', 2, 'true'),
          ('random_neg_prem', 2, 'false'), ('no_prem', 3, '')) AS v(variant, kind, mark)
        LEFT JOIN (SELECT 0 AS kind, item_id, i AS pi, premise FROM support
          UNION ALL SELECT 1, item_id, pi, upper(fact[1]) || lower(fact[2:]) || '.'
          FROM (SELECT item_id, unnest(range(len(d))) AS pi, unnest(d) AS key
                FROM (SELECT item_id, list_slice(distractors, 1, 3) AS d FROM prf))
          JOIN facts USING (item_id, key)
          UNION ALL SELECT 2, item_id, pi,
            {_NOISE.format(text="premise", seed=0, id="item_id || ':' || pi")}
          FROM (SELECT item_id, i AS pi, premise FROM support)) USING (kind, item_id)
        GROUP BY variant, item_id)
      JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS r FROM asked) USING (item_id)
      CROSS JOIN (VALUES (0), (1)) AS a(side)))))))
WHERE fit = 1 AND position <= 1000""",
    "coded nli asked support prf facts",
)
def d7_catalogue(spark, sf):
    """Both datasets in all seven variants, from the raw tables to sampled prompts."""
    sources = {"snli_pairs": fx.nli(spark, sf), "proof_questions": _records(spark, sf)}
    found = datasets.load_all(sources)
    return found.select(
        "dataset", "variant", "sample_id", "label", F.md5("neg_question").alias("question"),
        "position", "max_length",
    )


@query(
    "k3_random_permutation",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) AS position FROM documents",
)
def k3(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id")
    return hash_rank(rows, [], order_key(5, "doc_id"), ["doc_id"], "position")


@query(
    "k4_limit",
    "SELECT pair_id FROM coded ORDER BY md5('0:' || pair_id) LIMIT 27",
    "coded",
)
def k4(spark, sf):
    return coded(spark, sf).orderBy(order_key(0, "pair_id")).limit(27).select("pair_id")


@query(
    "p32_sample_listing",
    """SELECT pair_id, md5(question || ' incorrect') AS sample FROM rendered
ORDER BY pair_id LIMIT 10""",
    "rendered",
)
def p32(spark, sf):
    pairs = prompts.contrast_pairs(coded(spark, sf), "pic-full")
    listed = prompts.sample_listing(pairs, "pair_id")
    return listed.withColumn("sample", F.md5("sample"))


@query(
    "d6_data_samples",
    """SELECT conv_id * 1000 + turn AS id, md5(question || ' No') AS sample FROM (
  SELECT conv_id, turn, 'Question: "' || question || '" Is "' || answer || '" right?' AS question
  FROM qas) ORDER BY id LIMIT 10""",
    "qas",
)
def d6(spark, sf):
    rows = fx.qa(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    listed = prompts.sample_listing(prompts.contrast_pairs(rows, "question-answer"), "id")
    return listed.withColumn("sample", F.md5("sample"))


_FIND = """list_filter(list_transform(range(1, length({t}) + 1), lambda i:
  CASE WHEN substr({t}[1:length({t}) - 1], i, length({s})) = {s} THEN i - 1 END),
  lambda i: i IS NOT NULL)"""


def qa_pairs(spark, sf):
    """Questions that quote both answers, so that an answer's other mentions can be found."""
    rows = _records(spark, sf).withColumn("_a", qa.two_answers(0))
    question = qa.with_options(F.col("meta.question_text"), "_a")
    wrong = F.filter("_a", lambda a: a["label"] == 0)[0]["text"]
    right = F.filter("_a", lambda a: a["label"] == 1)[0]["text"]
    return rows.select(
        "item_id",
        question.alias("neg_question"),
        question.alias("pos_question"),
        wrong.alias("neg_answer"),
        right.alias("pos_answer"),
    )


@query(
    "p28_substring_positions",
    """SELECT doc_id, len(p) AS pieces, len(p) - 1 AS found,
  CAST(list_sum(list_transform(p, lambda x: length(x))) + 3 * (len(p) - 1) AS BIGINT) AS chars,
  CASE WHEN len(p) > 1 THEN length(p[1]) ELSE -1 END AS first_lo,
  CASE WHEN len(p) > 1 THEN length(text) - 1 - length(p[len(p)]) - 1 ELSE -1 END AS last_hi
FROM (SELECT doc_id, text, str_split(text[1:length(text) - 1], 'the') AS p FROM documents)""",
)
def p28(spark, sf):
    df = fx.documents(spark, sf).select(
        "doc_id", "text", prompts.find_all("text", F.lit("the")).alias("at")
    )
    last = F.element_at("at", -1)
    return df.select(
        "doc_id",
        (F.size("at") + 1).alias("pieces"),
        F.size("at").alias("found"),
        F.greatest(F.length("text") - 1, F.lit(0)).alias("chars"),
        F.when(F.size("at") > 0, F.col("at")[0]["lo"]).otherwise(-1).alias("first_lo"),
        F.when(F.size("at") > 0, last["hi"]).otherwise(-1).alias("last_hi"),
    )


_TOKENS = """toks AS (SELECT item_id, ans, question, unnest(range(len(w))) AS pos,
    list_transform(range(1, len(w) + 1), lambda j: CAST(coalesce(list_sum(list_transform(
      w[1:j - 1], lambda x: length(x) + 1)), 0) AS BIGINT)) AS starts, w
  FROM (SELECT item_id, wrong_answer AS ans, question,
          str_split(question || ' ' || wrong_answer, ' ') AS w FROM asked)),
spans AS (SELECT item_id, question, ans, pos, starts[pos + 1] AS lo,
  starts[pos + 1] + length(w[pos + 1]) AS hi FROM toks)"""


def _with(sql: str, body: str) -> str:
    return f"SELECT * FROM (WITH {sql} {body})"


@query(
    "p29_token_overlap",
    _with(
        _TOKENS,
        """SELECT DISTINCT s.item_id, s.pos FROM spans s JOIN (
  SELECT item_id, length(split_part(question, ans, 1)) AS rlo, length(ans) AS n FROM (
    SELECT DISTINCT item_id, question, wrong_answer AS ans FROM asked
    UNION SELECT item_id, question, right_answer FROM asked)
  WHERE contains(question[1:length(question) - 1], ans)) r
 ON r.item_id = s.item_id AND rlo <= s.hi AND s.lo <= rlo + n - 1""",
    ),
    "asked",
)
def p29(spark, sf):
    pairs = qa_pairs(spark, sf)
    question = F.col("neg_question")
    mentions = F.concat(
        prompts.find_all(question, "neg_answer"), prompts.find_all(question, "pos_answer")
    )
    spans = prompts.token_spans(prompts.input_text(question, "neg_answer"))
    found = pairs.select(
        "item_id", F.explode(prompts.overlapping_tokens(spans, mentions)).alias("pos")
    )
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "p30_padded_positions",
    _with(
        _TOKENS,
        """SELECT item_id, coalesce(n, 0) AS tokens, greatest(5, coalesce(n, 0)) AS slots
FROM (SELECT DISTINCT item_id FROM asked) LEFT JOIN (
 SELECT s.item_id, count(DISTINCT s.pos) AS n FROM spans s JOIN (
  SELECT item_id, length(split_part(question, ans, 1)) AS rlo, length(ans) AS n FROM (
    SELECT DISTINCT item_id, question, wrong_answer AS ans FROM asked
    UNION SELECT item_id, question, right_answer FROM asked)
  WHERE contains(question[1:length(question) - 1], ans)) r
 ON r.item_id = s.item_id AND rlo <= s.hi AND s.lo <= rlo + n - 1 GROUP BY 1) USING (item_id)""",
    ),
    "asked",
)
def p30(spark, sf):
    df = prompts.pair_positions(qa_pairs(spark, sf))
    return df.select(
        "item_id",
        F.size(prompts.unpadded("other_answer_idx")).cast("bigint").alias("tokens"),
        F.size("other_answer_idx").cast("bigint").alias("slots"),
    )


@query(
    "p31_answer_span",
    """SELECT item_id, length(question) + 1 AS lo, length(question) + 1 + length(wrong_answer) AS hi
FROM asked""",
    "asked",
)
def p31(spark, sf):
    span = prompts.answer_range("neg_question", "neg_answer")
    return qa_pairs(spark, sf).select("item_id", span["lo"].alias("lo"), span["hi"].alias("hi"))


# --- agreement of variants -----------------------------------------------------------------


def conflicting(rows):
    """The label of a third of the samples is turned round in one variant."""
    turned = (F.col("sample_id") % 3 == 1) & (F.col("variant") == "no_prem")
    return rows.withColumn("label", F.when(turned, 1 - F.col("label")).otherwise(F.col("label")))


def variant_rows(spark, sf):
    """Every sentence pair in each of its seven premise variants."""
    each = F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("variant")
    return coded(spark, sf).select(
        F.lit("snli").alias("dataset"), F.col("pair_id").alias("sample_id"), "label", each
    )


@query(
    "j10_variant_zip",
    """SELECT pair_id AS sample_id, 7 AS variants, CASE WHEN pair_id % 3 = 1 THEN 0 ELSE label END
  AS lowest, CASE WHEN pair_id % 3 = 1 THEN 1 ELSE label END AS highest FROM coded""",
    "coded",
)
def j10(spark, sf):
    return conflicting(variant_rows(spark, sf)).groupBy("sample_id").agg(
        F.count("*").cast("int").alias("variants"),
        F.min("label").alias("lowest"),
        F.max("label").alias("highest"),
    )


@query(
    "a19_label_agreement",
    """SELECT dataset, count(DISTINCT sample_id) AS samples,
  NOT bool_or(sample_id % 3 = 1 AND dataset = 'ds1') AS consistent FROM pred GROUP BY 1""",
    "pred",
)
def a19(spark, sf):
    """One dataset has samples whose label differs in one variant."""
    from premisa.operators.vectors import check_labels

    rows = fx.predictions(spark, sf)
    other = conflicting(rows).filter("dataset = 'ds1'")
    return check_labels(other.unionByName(rows.filter("dataset <> 'ds1'")), ["dataset"])


@query(
    "d5_check_labels",
    """SELECT 'snli-' || (pair_id % 3) AS dataset, count(*) AS samples,
  NOT bool_or(pair_id % 3 = 1) AS consistent FROM coded GROUP BY 1""",
    "coded",
)
def d5(spark, sf):
    """Three parts of the dataset, one of which has labels that differ between the variants."""
    from premisa.operators.vectors import check_labels

    part = F.concat(F.lit("snli-"), (F.col("sample_id") % 3).cast("string"))
    rows = conflicting(variant_rows(spark, sf)).withColumn("dataset", part)
    return check_labels(rows, ["dataset"])


@query(
    "u2_concatenate",
    """SELECT part, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT 'document' AS part, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
  UNION ALL SELECT 'turn', text FROM conversations) GROUP BY 1""",
)
def u2(spark, sf):
    parts = {"document": "documents", "benchmark": "benchmark", "turn": "conversations"}
    frames = [
        fx.table(spark, sf, t).select(F.lit(p).alias("part"), "text") for p, t in parts.items()
    ]
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return whole.groupBy("part").agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "f13_string_functions",
    """SELECT doc_id, ends_with(text, '.') AS ends, length(text) AS n, instr(text, 'the') AS found,
  md5(lower(text)) AS low, md5(replace(text, '.', '')) AS plain,
  len(str_split(text, ' ')) AS words FROM documents""",
)
def f13(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id",
        F.col("text").endswith(".").alias("ends"),
        F.length("text").alias("n"),
        F.instr("text", "the").cast("bigint").alias("found"),
        F.md5(F.lower("text")).alias("low"),
        F.md5(F.replace("text", F.lit("."), F.lit(""))).alias("plain"),
        F.size(F.split("text", " ")).alias("words"),
    )


@query(
    "f20_json_access",
    r"""SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events""",
)
def f20(spark, sf):
    parsed = F.from_json("props", "map<string,string>")["k"]
    return fx.table(spark, sf, "events").select("event_id", parsed.cast("bigint").alias("k"))


@query(
    "u4_map_union",
    """SELECT event_id, 'right' AS kept, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
FROM events""",
)
def u4(spark, sf):
    """Both maps define ``kept``; the right one wins."""
    parsed = F.from_json("props", "map<string,string>")
    left = F.map_concat(parsed, F.create_map(F.lit("kept"), F.lit("left")))
    merged = F.map_concat(left, F.create_map(F.lit("kept"), F.lit("right")))
    return fx.table(spark, sf, "events").select(
        "event_id", merged["kept"].alias("kept"), merged["k"].cast("bigint").alias("k")
    )


@query(
    "u4_merge_params",
    """SELECT event_id, event_id % 3 AS n, array_to_string(list_sort(map_keys(m)), ',') AS names, m['a'] AS a, m['b'] AS b
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN MAP {'a': 'step'} WHEN 1 THEN MAP {'a': 'own', 'b': 'run'}
  ELSE MAP {'a': 'own', 'b': 'own', 'c': 'own'} END AS m FROM events)""",
)
def u4_params(spark, sf):
    """Up to three maps with common names; the last one that has a name decides."""
    turn = F.col("event_id") % 3

    def some(*pairs: str):
        return F.create_map(*(F.lit(x) for x in pairs))

    none = F.create_map().cast("map<string,string>")
    run = F.when(turn >= 1, some("a", "run", "b", "run")).otherwise(none)
    own = F.when(turn == 1, some("a", "own"))
    own = own.when(turn == 2, some("a", "own", "b", "own", "c", "own")).otherwise(none)
    merged = results.merge_params(some("a", "step"), run, own)
    return fx.table(spark, sf, "events").select(
        "event_id",
        turn.alias("n"),
        F.array_join(F.array_sort(F.map_keys(merged)), ",").alias("names"),
        merged["a"].alias("a"),
        F.try_element_at(merged, F.lit("b")).alias("b"),
    )


@query(
    "p7_strip_documents",
    r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped FROM documents",
)
def p7_strip(spark, sf):
    return fx.documents(spark, sf).select("doc_id", F.md5(strip("text")).alias("stripped"))
