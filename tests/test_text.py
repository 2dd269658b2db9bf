"""Golden rows for the text operators."""

import string

import pytest
from pyspark.sql import functions as F

from premisa.operators import nli, prompts, qa
from premisa.sources import io


def proof(spark, proof_text, triples, conclusions=None, distractors=()):
    schema = (
        "item_id long, proof string, meta struct<triples: map<string,string>, "
        "intermediate_conclusions: map<string,string>, distractors: array<string>, "
        "question_text: string>"
    )
    return spark.createDataFrame(
        [(1, proof_text, (triples, conclusions or {}, list(distractors), "q"))], schema
    )


def test_last_step(spark):
    df = proof(spark, " a & b -> int1: x; c & int1 -> hypothesis; \n", {})
    assert df.select(qa.last_step_keys("proof")).first()[0] == ["c", "int1"]


def test_single_step(spark):
    df = proof(spark, "a & b -> hypothesis;", {})
    assert df.select(qa.last_step_keys("proof")).first()[0] == ["a", "b"]


def test_support_premises_and_right_wins(spark):
    df = proof(spark, "a & b -> hypothesis;", {"a": "the SUN", "b": "old"}, {"b": "new Fact"})
    assert df.select(qa.premises("support", 0)).first()[0] == ["The sun.", "New fact."]


def test_missing_key_fails(spark):
    df = proof(spark, "a & z -> hypothesis;", {"a": "x"})
    with pytest.raises(Exception, match="no fact named z"):
        df.select(qa.premises("support", 0)).collect()


def test_distractors_and_none(spark):
    facts = {k: k * 2 for k in "abcde"}
    df = proof(spark, "a -> hypothesis;", facts, {}, "abcde")
    assert df.select(qa.premises("distract", 0)).first()[0] == ["Aa.", "Bb.", "Cc."]
    short = proof(spark, "a -> hypothesis;", facts, {}, "ab")
    assert short.select(qa.premises("distract", 0)).first()[0] == ["Aa.", "Bb."]
    assert df.select(qa.premises("none", 0)).first()[0] == []
    with pytest.raises(ValueError):
        qa.premises("other", 0)


@pytest.mark.parametrize("size, share, want", [(3, 1.0, 3), (3, 0.0, 0), (5, 0.5, 2), (3, 0.5, 2), (0, 1.0, 0)])
def test_true_marks_round_half_to_even(spark, size, share, want):
    marks = qa.true_marks(F.lit(size), share, 0, "id")
    got = spark.range(20).select(marks).collect()
    assert all(len(r[0]) == size and sum(r[0]) == want for r in got)


def test_two_answers(spark):
    rows = [(i, [("A", "one."), ("B", "two."), ("C", "three.")], "B", "two") for i in range(200)]
    df = spark.createDataFrame(
        rows, "item_id long, choices array<struct<label:string,text:string>>, answer_key string, "
        "answer string",
    )
    got = df.select(qa.two_answers(0).alias("a")).collect()
    first = sum(r["a"][0]["label"] for r in got)
    assert 60 < first < 140
    assert {r["a"][0]["text"][:4] for r in got} == {"(A) "}
    wrong = {x["text"][4:] for r in got for x in r["a"] if x["label"] == 0}
    assert wrong == {"one", "three"}


def test_build_qa_keys_are_unique(spark):
    rows = [
        (i, "a -> hypothesis;", ({"a": "x"}, {}, [], "q?"), "h", [("A", "one"), ("B", "two")], "A", "one")
        for i in (5, 9, 30)
    ]
    df = spark.createDataFrame(
        rows,
        "item_id long, proof string, meta struct<triples: map<string,string>, "
        "intermediate_conclusions: map<string,string>, distractors: array<string>, "
        "question_text: string>, hypothesis string, choices array<struct<label:string,text:string>>, "
        "answer_key string, answer string",
    )
    got = qa.build_qa(df).collect()
    assert sorted(r["key"] for r in got) == [0, 1, 2, 3, 4, 5]
    assert all(r["label"] == r["key"] // 3 for r in got)


def test_letter_noise_keeps_shape(spark):
    texts = ["Hello, World! 42 éß", "", "abcXYZ" * 40, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = df.select("t", nli.letter_noise("t", 0, "id").alias("n")).collect()
    for row in got:
        assert len(row["t"]) == len(row["n"])
        for a, b in zip(row["t"], row["n"]):
            if a in string.ascii_lowercase:
                assert b in string.ascii_lowercase
            elif a in string.ascii_uppercase:
                assert b in string.ascii_uppercase
            else:
                assert a == b
    assert got[2]["t"] != got[2]["n"]


def test_shuffle_is_a_permutation_for_any_partitioning(spark):
    rows = [(i, f"p{i}", "h") for i in range(300)]
    results = []
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "pair_id long, premise string, h string").repartition(parts)
        got = nli.shuffle_column(df, "pair_id", "premise", 0).collect()
        results.append({r["pair_id"]: r["premise"] for r in got})
    assert results[0] == results[1]
    assert sorted(results[0].values()) == sorted(f"p{i}" for i in range(300))
    assert sum(results[0][i] == f"p{i}" for i in range(300)) < 20


def test_label_codes(spark):
    df = spark.createDataFrame([("entailment",), ("neutral",), ("contradiction",), ("-",)], "gold_label string")
    plain = {x: x for x in nli.LABELS}
    got = dict(nli.keep_labels(df, ["neutral"]).select("gold_label", nli.label_code(plain, ["neutral"])).collect())
    assert got == {"contradiction": 0, "entailment": 1}
    merged = dict(df.select("gold_label", nli.label_code(nli.OTHER, [])).collect())
    assert merged == {"entailment": 1, "contradiction": 1, "neutral": 0, "-": None}


def test_bad_premise_mode(spark):
    with pytest.raises(ValueError):
        nli.build_nli(spark.createDataFrame([], "pair_id long"), premise_mode="upside_down")


@pytest.mark.parametrize(
    "text, sub, want",
    [
        ("abcabcabcx", "abc", [(0, 2), (3, 5), (6, 8)]),
        ("xabc", "abc", []),  # the last character is never searched
        ("xabc.", "abc", [(1, 3)]),
        ("aaaaa", "aa", [(0, 1), (2, 3)]),
        ("none here", "zz", []),
        ("a.b+c a.b+c ", "a.b+c", [(0, 4), (6, 10)]),
        ("a\\Eb a\\Eb.", "a\\Eb", [(0, 3), (5, 8)]),
        ("\\Q\\E\\Q.", "\\E", [(2, 3)]),
        ("abc", "", []),
    ],
)
def test_find_all(spark, text, sub, want):
    df = spark.createDataFrame([(text, sub)], "t string, s string")
    got = df.select(prompts.find_all("t", F.col("s"))).first()[0]
    assert [(r["lo"], r["hi"]) for r in got] == want


def test_token_touching_a_boundary(spark):
    df = spark.createDataFrame([("ab cd ef",)], "t string")
    spans = prompts.token_spans("t")

    def at(lo, hi):
        ranges = F.array(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
        return df.select(prompts.overlapping_tokens(spans, ranges)).first()[0]

    assert at(3, 3) == [1]
    assert at(2, 2) == [0]  # a token's exclusive end still touches
    assert at(5, 6) == [1, 2]
    assert at(9, 12) == []


@pytest.mark.parametrize("n, want", [(0, 5), (5, 5), (6, 6)])
def test_padding(spark, n, want):
    positions = F.array(*[F.lit(i) for i in range(n)]).cast("array<int>")
    row = spark.range(1).select(prompts.padded(positions).alias("p")).first()["p"]
    assert len(row) == want and row[:n] == list(range(n)) and set(row[n:]) <= {-100}
    back = spark.range(1).select(prompts.unpadded(prompts.padded(positions))).first()[0]
    assert back == list(range(n))


def test_render_does_not_rescan_values(spark):
    df = spark.createDataFrame([("{hypothesis}", "x")], "premise string, hypothesis string")
    got = df.select(prompts.render("<{premise}|{hypothesis}>", df.columns)).first()[0]
    assert got == "<{hypothesis}|x>"


def test_guards(spark):
    schema = "id int, neg_question string, pos_question string, neg_answer string, pos_answer string"
    df = spark.createDataFrame([(1, "q", "q", "no", "yes"), (2, "q", "p", "no", "yes"), (3, "q", "q", "no", "no")], schema)
    assert [r["id"] for r in prompts.prefix_violations(df).collect()] == [2]
    assert [r["id"] for r in prompts.same_side_violations(df).collect()] == [3]
    assert prompts.guarded(df.filter("id = 1")).count() == 1
    with pytest.raises(Exception, match="questions differ"):
        prompts.guarded(df.filter("id = 2")).collect()
    with pytest.raises(Exception, match="sides are equal"):
        prompts.guarded(df.filter("id = 3")).collect()


@pytest.mark.parametrize("wanted", [5, 2000])
def test_sample_short_takes_the_first_fitting(spark, wanted):
    df = spark.range(3000).withColumn("n", (F.col("id") % 10).cast("int"))
    got = prompts.sample_short(df, [], ["id"], "n", 8, wanted, 0).collect()
    import hashlib

    order = sorted((i for i in range(3000) if i % 10 < 6), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == order[:wanted]


def test_length_cap_counts_rejected_rows_met_before_the_last_kept(spark):
    import hashlib

    ids = sorted(range(40), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
    lengths = {i: 3 for i in ids}
    lengths[ids[2]] = 50  # rejected, but met before three rows are kept
    lengths[ids[30]] = 90  # met later
    df = spark.createDataFrame(list(lengths.items()), "id long, n int")
    assert prompts.length_cap(df, [], ["id"], "n", 10, 3, 0).first()["max_length"] == 52
    assert prompts.length_cap(df, [], ["id"], "n", 10, 1000, 0).first()["max_length"] == 92


def test_model_inputs(spark):
    df = spark.createDataFrame([("q", "a")], "q string, a string")
    split = df.select(*prompts.model_inputs("q", "a", "encoder_decoder", True)).first()
    joined = df.select(*prompts.model_inputs("q", "a", "decoder")).first()
    assert tuple(split) == ("q", "a") and tuple(joined) == ("q a", "")


def test_split_is_stable_and_covers(spark):
    df = spark.range(1000)
    a = {r["id"]: r["split"] for r in qa.two_way_split(df.repartition(1), "id", 0).collect()}
    b = {r["id"]: r["split"] for r in qa.two_way_split(df.repartition(9), "id", 0).collect()}
    assert a == b and set(a.values()) == {"train", "test"}
    assert 400 < sum(v == "train" for v in a.values()) < 600


def test_tables_round_trip(spark, tmp_path):
    tables = {"a": spark.range(5), "b": spark.range(3).withColumn("x", F.lit("y"))}
    io.save_tables(tables, str(tmp_path / "db"))
    back = io.load_tables(spark, str(tmp_path / "db"), ["a", "b"])
    assert back["a"].count() == 5 and back["b"].columns == ["id", "x"]


def test_a_bad_line_fails_with_its_file_or_is_set_aside(spark, tmp_path):
    good = '{"pairID": "1", "sentence1": "a", "gold_label": "neutral", "more": 3}'
    lines = [good, "", "  ", '{"pairID": "2", "sentence1": ', "[1]", '{"pairID": "3", "sentence2": {"x": 1}}', "null", "{}"]
    (tmp_path / "a.jsonl").write_text("\n".join([good, good]))
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    assert io.read_nli(spark, paths[0]).count() == 2
    assert io.bad_lines(spark, paths[0], io.NLI_SCHEMA).count() == 0
    with pytest.raises(Exception, match="bad record in .*b.jsonl"):
        io.read_json(spark, paths, io.NLI_SCHEMA).collect()
    with pytest.raises(Exception, match="bad record in"):
        io.read_json(spark, paths, io.NLI_SCHEMA).select("pairID").filter("pairID = '1'").collect()
    kept = io.read_json(spark, paths, io.NLI_SCHEMA, on_bad="skip").collect()
    # an empty object is a record, and an object where text is expected is text
    assert sorted(str(r["pairID"]) for r in kept) == ["1", "1", "1", "3", "None"]
    bad = io.bad_lines(spark, paths, io.NLI_SCHEMA).collect()
    assert sorted(r["line"] for r in bad) == sorted([lines[3], lines[4], "null"]) and {r["file"][-7:] for r in bad} == {"b.jsonl"}
    with pytest.raises(ValueError, match="fail or skip"):
        io.read_nli(spark, paths[0], on_bad="drop")


def test_bad_records_in_proofs_and_choices(spark, tmp_path):
    for split in io.SPLITS:
        (tmp_path / f"{split}.jsonl").write_text('{"id": "x", "meta": {"distractors": ["d"]}}\n')
    assert io.read_proofs(spark, str(tmp_path)).count() == 3
    (tmp_path / "dev.jsonl").write_text('{"id": "x", "meta": {"distractors": "d"}}\n')
    with pytest.raises(Exception, match="bad record in .*dev.jsonl"):
        io.read_proofs(spark, str(tmp_path)).collect()
    assert io.read_proofs(spark, str(tmp_path), on_bad="skip").count() == 2
    (tmp_path / "c.jsonl").write_text('{"id": "x", "question": {"choices": [{"label": "A", "text": "t"}]}}\n{"id"\n')
    with pytest.raises(Exception, match="bad record in .*c.jsonl"):
        io.read_choices(spark, [str(tmp_path / "c.jsonl")]).collect()
    assert io.read_choices(spark, [str(tmp_path / "c.jsonl")], on_bad="skip").count() == 1


def test_csv_rows_with_too_few_or_too_many_values(spark, tmp_path):
    head = "questionID,originalQuestionID,totalPossiblePoint,AnswerKey,isMultipleChoiceQuestion,includesDiagram,question"
    good = 'q1,1,1,A,1,0,"two\nlines, ""quoted"""'
    path = tmp_path / "c.csv"
    path.write_text("\n".join([head, good, "q2,2,1"]) + "\n")
    with pytest.raises(Exception, match="bad record in .*c.csv: q2,2,1"):
        io.read_choices_csv(spark, [str(path)]).count()
    kept = io.read_choices_csv(spark, [str(path)], on_bad="skip").collect()
    assert [r["question"] for r in kept] == ['two\nlines, "quoted"']


def test_a_broken_save_is_refused_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "db")
    good = spark.range(5).withColumnRenamed("id", "a")
    broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("killed")).cast("long")).alias("b"))
    with pytest.raises(Exception, match="killed"):
        io.save_tables({"good": good, "broken": broken}, folder)
    with pytest.raises(FileNotFoundError, match="not written to its end"):
        io.load_tables(spark, folder, ["good"])
    io.save_tables({"good": good, "broken": spark.range(3)}, folder)
    back = io.load_tables(spark, folder, ["good", "broken"])
    assert back["good"].count() == 5 and back["broken"].count() == 3
    with pytest.raises(FileExistsError):
        io.save_tables({"good": good}, folder)
    with pytest.raises(KeyError):
        io.load_tables(spark, folder, ["other"])
    good.write.mode("append").parquet(f"{folder}/good")
    with pytest.raises(ValueError, match="manifest says 5"):
        io.load_tables(spark, folder, ["good"])
    with pytest.raises(ValueError, match="no table to save"):
        io.save_tables({}, folder)
