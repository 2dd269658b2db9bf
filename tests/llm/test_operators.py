"""The operators on small tables: brute force, planted cases and unusual input."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from premisa.llm import (
    bloom_lm,
    chaining,
    decontaminate,
    fuzzy_lines,
    packing,
    repetition,
    setsketch,
    toxicity,
    trie_counts,
    wrapper,
)
from premisa.llm.catalogue import QUERIES
from premisa.llm.common import components, remainder, session

CLASHING = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, `_id` string, key string, "
    "`_hints` int, shared int, lines int, gone int, verdict int, `a.b` array<int>, toxicity string, "
    "token_counts int, quality_rules int, band int, `_size` int, `_dropped` int, main_text int"
)


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, clashing columns."""
    session(spark)
    long = words(30_000, 1)
    texts = [None, "", " \n\t", "one", words(80, 2), words(80, 2), long, "\n".join([words(60, 3)] * 3)]
    texts += ["x " * 300, "Zeile\x00null   é", "日本語のテキスト" * 40]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, words(70, 5), None, None, None), (None, None, None, None, None)]
    rows += [(4, words(90, 6), None, "s", 3)]
    return spark.createDataFrame([(*r, "i", "k", 1, 2, 3, 4, 5, [1], "t", 6, 7, 8, 9, 10, 11) for r in rows], CLASHING)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, words(40, 2)), (2, None), (None, "one"), (3, ""), (3, "w1 w2"), (3, "w1 w2")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def operators(docs, bench, labels):
    lm, counts = bloom_lm.learn(docs, remainder("doc_id", 7) != 2)
    model = toxicity.learn(docs, labels, remainder("doc_id", 5) == 0)
    pages = docs.withColumn("url", F.lit("http://h/x")).withColumn("html", F.col("text"))
    return {
        "decontaminate": decontaminate.decontaminate(docs, bench),
        "lm": bloom_lm.score(docs, lm, counts),
        "toxicity": toxicity.score(docs, model),
        "rules": repetition.quality_rules(docs),
        "html": wrapper.main_text(pages),
        "near": setsketch.near_duplicates(docs),
        "lines": fuzzy_lines.dedupe_lines(docs),
        "passages": chaining.repeated_passages(docs),
        "pack": packing.pack(docs),
        "tokens": trie_counts.token_counts(docs),
    }


def test_unusual_rows(odd, bench, labels):
    n = odd.count()
    for name, got in operators(odd, bench, labels).items():
        rows = got.collect()
        if name == "passages":
            assert all(r.doc_id != r.other_id for r in rows)
        elif name == "pack":
            assert sum(r.piece == 0 for r in rows) == n
        else:
            assert len(rows) == n, name
    for name in ("decontaminate", "toxicity", "rules", "lines", "tokens"):
        got = operators(odd, bench, labels)[name]
        assert {"a.b", "_id", "doc_id"} <= set(got.columns) and len(got.columns) == len(odd.columns)


def test_empty_tables(odd, bench, labels, spark):
    none = odd.limit(0)
    for got in operators(none, bench.limit(0), labels.limit(0)).values():
        assert got.count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("shared.n_hit > 0").count() == 0


def test_pipeline_stages_on_unusual_rows(odd, bench, tmp_path, spark):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_shared_windows(spark, limit):
    """Against a plain search, with items shorter than a window and repeated grams."""
    r = random.Random(9)
    alphabet = ["a", "B", "cé", "d"]
    items = [(i, " ".join(r.choice(alphabet) for _ in range(r.choice([1, 3, 7, 13, 14, 30])))) for i in range(25)]
    items += [(90, "a " * 20), (91, "  ")]
    texts = [" ".join(r.choice([*alphabet, "q"]) for _ in range(r.randrange(80))) for _ in range(60)]
    texts += ["A " * 60, None, items[3][1]]
    for i in range(20):
        texts.append(f"{texts[i]} {r.choice(items)[1]}, {texts[i + 1]}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {x.doc_id: x.shared for x in decontaminate.decontaminate(docs, bench, limit=limit).collect()}

    def split(t):
        return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()

    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for item, x in items:
            v = split(x)
            n = min(13, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(item)
        assert (got[i].n_words, got[i].n_hit) == (len(w), len(hit)), t
        assert {x.item_id for x in got[i]["items"]} == found


def test_lm_counts_are_exact(spark):
    r = random.Random(2)
    texts = [" ".join(f"v{int(r.paretovariate(0.6))}" for _ in range(r.randrange(200))) for _ in range(120)]
    texts += [None, "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lm, counts = bloom_lm.learn(docs, remainder("doc_id", 7) != 2, hot=50, contexts=10)
    got = {x.doc_id: x for x in bloom_lm.score(docs, lm, counts).collect()}
    seen = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update([*(t or "").lower().split(), "\n"])
    total, types = sum(seen.values()), len(seen)
    for i, t in enumerate(texts):
        w = [*(t or "").lower().split(), "\n"]
        want = sum(math.log10((seen[x] + 1) / (total + types + 1)) for x in w)
        assert abs(got[i].base_score - want) < 1e-6
        assert got[i].n_known == sum(x in seen for x in w) and got[i].n_tokens == len(w)
        assert got[i].score <= 0


def test_lm_sums_to_one(spark):
    """After every context the probabilities of all known words and the unseen class make one."""
    texts = ["a b a b c", "a b c c a", "b a b d"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lm, counts = bloom_lm.learn(docs, F.lit(True), contexts=1000)
    vocabulary = ["a", "b", "c", "d"]
    ask = [*(f"{h} {w}" for h in vocabulary for w in [*vocabulary, "unheard"]), *vocabulary, ""]
    asked = spark.createDataFrame(list(enumerate(ask)), "doc_id bigint, text string")
    got = {ask[x.doc_id]: 10**x.score for x in bloom_lm.score(asked, lm, counts).collect()}
    # P(h w end) / P(h end) sums over w to a sum of P(w|h) P(end|w) / P(end|h): compare by hand
    assert all(0 < p < 1 for p in got.values())
    assert got["a b"] > got["a d"] > got["a unheard"]


def test_lm_filter_within_its_bound(spark):
    texts = [" ".join(f"z{i * 50 + j}" for j in range(50)) + " twice twice" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lm, counts = bloom_lm.learn(docs, F.lit(True), max_bits=1 << 16)
    assert len(lm.filter.cells) * 8 <= 1 << 16 and lm.filter.lowest == 1
    lm, counts = bloom_lm.learn(docs, F.lit(True), max_bits=1 << 12)
    assert lm.filter.lowest > 1
    assert bloom_lm.score(docs, lm, counts).where("score > 0 or isnan(score)").count() == 0


def jaccard_components(sets, percent):
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                at[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in keys}


def edited(w, k, r):
    w = list(w)
    for _ in range(k):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return w


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_near_duplicates_equal_all_pairs(spark, limit):
    r = random.Random(7)
    texts = []
    for g in range(12):
        base = words(r.randrange(4, 160), 100 + g).split()
        texts += [" ".join(edited(base, r.choice([0, 0, 1, 2, 5]), r)) for _ in range(12)]
    # a chain whose ends are not similar, and short texts
    chain = words(120, 5).split()
    for _ in range(10):
        texts.append(" ".join(chain))
        chain = edited(chain, 2, r)
    texts += ["a b", "A B", "a", None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = setsketch.near_duplicates(docs, limit=limit).collect()
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    want = jaccard_components(sets, 75)
    for x in got:
        assert x.component_id == want[x.doc_id] and x.n_shingles == len(sets[x.doc_id])
        assert x.kept == (x.doc_id == x.component_id)


def test_hot_group_of_near_copies(spark):
    """One group with a third of all rows, of which many pairs are not similar by themselves."""
    r = random.Random(8)
    base = words(100, 77).split()
    texts = [" ".join(edited(base, r.choice([1, 2]), r)) for _ in range(150)]
    texts += [words(100, 1000 + i) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in setsketch.near_duplicates(docs).collect()}
    sets = {i: set(zip(*[t.split()[j:] for j in range(5)], strict=False)) for i, t in enumerate(texts)}
    assert got == jaccard_components(sets, 75)


def char_shingles(line):
    line = " ".join(line.lower().split())
    if 12 * (line.count(" ") + 1) >= len(line):
        starts = [0, *(i + 1 for i, c in enumerate(line) if c == " ")]
    else:
        starts = range(len(line))
    return {line[i : i + 12] for i in starts}


def test_fuzzy_lines_equal_all_pairs(spark):
    r = random.Random(11)
    bases = [words(r.randrange(6, 50), 300 + i) for i in range(15)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(6)):
            line = " ".join(edited(r.choice(bases).split(), r.choice([0, 0, 1, 2]), r))
            lines.append(r.choice([line, line.upper(), f"  {line} ", words(12, r.random()), "", "ok"]))
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, "日本語の長い行" * 9), (102, "日本語の長い行" * 9 + "だ")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: x.lines for x in fuzzy_lines.dedupe_lines(frame).collect()}
    sets, copies = {}, {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                normal = " ".join(line.lower().split())
                copies[i, n] = copies.get(normal, (i, n))
                copies.setdefault(normal, (i, n))
                sets[i, n] = char_shingles(line)
    want = jaccard_components(sets, 75)
    for i, t in docs:
        lines = (t or "").split("\n")
        drop = [n for n in range(len(lines)) if (i, n) in want and want[i, n] != (i, n)]
        assert got[i].dropped == drop, (i, t)
        assert got[i].n_lines == (len(lines) if t is not None else 0)


def test_remaining_text(spark):
    frame = spark.createDataFrame(
        [(1, "a b c\nkeep me\n\na B  c\n"), (2, None), (3, "")], "doc_id bigint, text string"
    )
    marked = fuzzy_lines.dedupe_lines(frame)
    got = {x.doc_id: x.t for x in marked.select("doc_id", fuzzy_lines.remaining().alias("t")).collect()}
    assert got == {1: "a b c\nkeep me\n\n", 2: None, 3: ""}


def test_planted_passages_are_found(spark):
    """Every run of over 50 words shared with an earlier document lies in a reported region.

    Two words at an edge may lack: the first document with a passage may differ from this one there.
    """
    r = random.Random(12)
    passages = [words(r.randrange(51, 90), 500 + i).split() for i in range(12)]
    texts = []
    for i in range(90):
        w = [f"u{i}_{j}" for j in range(r.randrange(0, 120))]
        at = r.randrange(len(w) + 1)
        body = r.choice(passages)
        if i % 3 == 0:
            body = edited(body, 2, r)
        texts.append(w[:at] + (body if i % 4 else []) + w[at:])
    docs = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(passages[0]))],
        "doc_id bigint, text string",
    )
    got = chaining.repeated_passages(docs).collect()
    inside = defaultdict(set)
    for x in got:
        assert x.other_id < x.doc_id and x.identity >= 0.8
        same = set(texts[x.doc_id][x.start : x.end]) & set(texts[x.other_id][x.other_start : x.other_end])
        assert len(same) > 0
        inside[x.doc_id] |= set(range(x.start, x.end))
    known = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - 50):
            key = tuple(t[s : s + 51])
            if key in known and known[key] != i:
                assert set(range(s + 2, s + 49)) <= inside[i]
            known.setdefault(key, i)
    clean = [i for i in range(90) if i % 4 == 0]
    assert not any(inside[i] for i in clean)


def test_packing_round_trip(spark):
    texts = [words(n, n) for n in (0, 1, 5, 700, 1500, 4000, 9)] + [None, "Café £5"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(docs, group_rows=4).toPandas()
    e = packing.Encoder(packing.tokenizer_file("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        ids = np.array([*e.whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 2048))
        for x in own.itertuples():
            part = ids[x.start : x.start + x.length]
            assert zlib.crc32(part.tobytes()) == x.ids_crc32 and len(part) == x.length
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        ends = (own.offset + own.length).tolist()
        assert own.offset.iloc[0] == 0 and ends[-1] <= 2048
        assert all(a == b for a, b in zip(ends, own.offset.tolist()[1:], strict=False))
    assert (got.doc_id == 3).sum() == 2 * (got[got.doc_id == 3].piece.max() + 1)


def test_components_of_paths_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(200)] + [(5, 5), (400, 401)]
    edges += [(b, a) for a, b in edges[:30]]
    r.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == 61 + 200 + 2
    for x in got:
        assert x.component == (0 if x.id <= 60 else 100 if x.id < 300 else 400)


def held_out_auc(frame):
    p, q = (frame[frame.toxic == y].score.to_numpy() for y in (1, 0))
    return ((p[:, None] > q).mean() + 0.5 * (p[:, None] == q).mean()) if len(p) and len(q) else None


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op3_toxicity"](spark, folder).toPandas()
    known = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    frame = got.merge(known, on="doc_id")
    frame = frame[frame.held_out]
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert held_out_auc(frame) > 0.95
    assert ((frame.score >= 0.5) == frame.toxic).mean() > 0.95


def test_pages_give_their_article(spark, sf):
    got = QUERIES["op5_main_text"](spark, sf).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    for x in pages.itertuples():
        inner = x.html[x.html.index("<article>") : x.html.index("</article>")]
        plain = wrapper.visible(wrapper.parse(inner))
        assert got.loc[x.page_id, "text"] == plain and got.loc[x.page_id, "n_chars"] == len(plain)


def test_wrappers_joined_by_host(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    a = wrapper.main_text(pages).toPandas()
    b = wrapper.main_text(pages, limit=0).toPandas()
    key = ["page_id", "main_text"]
    pd.testing.assert_frame_equal(
        a[key].sort_values(key, ignore_index=True), b[key].sort_values(key, ignore_index=True)
    )


def test_pipeline_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf).cache())
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in pairwise(ids))
    judged = repetition.quality_rules(docs).where("quality_rules.kept").select("doc_id").collect()
    assert ids[1] == {r.doc_id for r in judged}
    text = " ".join(r.text for r in frames[2].collect())
    assert len(text) < sum(len(r.text) for r in frames[1].collect())
    assert ids[-1] == ids[-2]


def test_lm_keeps_every_pair_of_words(spark):
    """Pairs of rare words, also those met once, raise the score; so do rare contexts beyond `contexts`."""
    texts = [f"left{i} right{i}" for i in range(300)] + [f"twice{i} after{i}" for i in range(100)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lm, counts = bloom_lm.learn(docs, F.lit(True), contexts=2)
    ask = [x for i in range(100) for x in (texts[i], f"left{i} right{i + 1}", texts[300 + i], f"twice{i} after{(i + 1) % 100}")]
    asked = spark.createDataFrame(list(enumerate(ask)), "doc_id bigint, text string")
    got = {x.doc_id: x.score for x in bloom_lm.score(asked, lm, counts).collect()}
    gains = [got[i] - got[i + 1] for i in range(0, 400, 2)]
    assert sum(x > 1 for x in gains) >= 190
    # a count of one, discounted, and what is left to the unigram
    keys = np.array([bloom_lm.xxhash.xxh3_64_intdigest(w) for w in (b"left7", b"right7")], np.uint64)
    _, total, rest, *_ = bloom_lm.word_figures(lm, keys, bloom_lm.lookup(lm.hot, keys))
    assert total[0] == 1 and rest[0] == 0.75 and lm.bigram_mean[1] == 1


def test_lm_score_does_not_depend_on_the_filter_bound(spark):
    """What does not fit the filter is joined, so rare words and pairs count as they do within it."""
    r = random.Random(21)
    texts = [" ".join(f"v{int(r.paretovariate(0.5))}" for _ in range(r.randrange(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate([*texts, None, ""])], "doc_id bigint, text string")
    scores, lowest = [], []
    for bits in (1 << 28, 1 << 15, 1 << 12):
        lm, counts = bloom_lm.learn(docs, remainder("doc_id", 7) != 2, contexts=50, max_bits=bits)
        lowest.append(lm.filter.lowest)
        scores.append({x.doc_id: x.score for x in bloom_lm.score(docs, lm, counts).collect()})
    assert lowest[0] == 1 and 1 < lowest[1] < lowest[2] and lowest[2] > 2
    for other in scores[1:]:
        # a probe errs now and then, which moves a score a little
        assert np.mean([abs(other[i] - x) < 1e-9 for i, x in scores[0].items()]) > 0.8
        assert max(abs(other[i] - x) / max(1, abs(x)) for i, x in scores[0].items()) < 0.05


@pytest.mark.parametrize("step", [8, 9, 10, 11, 12])
def test_passages_with_regular_edits(spark, step):
    """Copies of 60 words with every 8th to 12th word replaced: brute force is that each is a passage."""
    r = random.Random(100 + step)
    rows = []
    for i in range(60):
        passage = [f"p{i}_{j}" for j in range(60)]
        copy = [f"e{r.random()}" if j % step == step - 1 else w for j, w in enumerate(passage)]
        for side, body in enumerate((passage, copy)):
            around = [[f"u{side}_{i}_{r.random()}" for _ in range(r.randrange(30))] for _ in range(2)]
            rows.append((2 * i + side, " ".join(around[0] + body + around[1])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = chaining.repeated_passages(docs).collect()
    assert all(x.other_id == x.doc_id - 1 and x.doc_id % 2 for x in got)
    assert len({x.doc_id for x in got}) >= 58


def test_near_lines_with_one_letter_changed(spark, tmp_path):
    """Short lines with one letter changed, against brute force on all 5-character shingles."""
    r = random.Random(31)
    rows = []
    for n in (6, 8, 10, 15):
        for i in range(40):
            line = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n))
            at = r.choice([j for j, c in enumerate(line) if c != " "])
            rows += [line, line[:at] + "z" + line[at + 1 :]]
    # on either side of one blank in twelve characters
    rows += ["aaaabbbbccccdddd eeeeffff gggg", "aaaabbbbccccddddxxeeeeffff gggg", "日本語の長い行です" * 5, "日本語の長い行です" * 5 + "ね"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op7_line_dedup"](spark, folder).collect()
    got = {x.doc_id: [int(n) for n in x.dropped.split(",") if n] for x in found}
    sets = {i: {t[j : j + 5] for j in range(max(1, len(t) - 4))} for i, t in enumerate(rows)}
    want = jaccard_components(sets, 75)
    linked = [i for i in range(1, 320, 2) if want[i] == i - 1]
    assert len(linked) > 130 and got == {i: [] if want[i] == i else [0] for i in want}


def test_shared_windows_with_capitals_beyond_ascii(spark):
    """A quote of one window and a short item, all of whose words hold capitals beyond A-Z."""
    r = random.Random(41)
    quote = " ".join(f"É{r.choice('ÑÜЖΩ')}x{i}" for i in range(13))
    short = "École ПРИВЕТ ΟΔΟΣ"
    bench = spark.createDataFrame([(1, quote), (2, short)], "item_id bigint, text string")
    rows = [(1, f"before {quote} after"), (2, f"so {short}.Β end"), (3, quote.lower()), (4, short.lower())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.shared for x in decontaminate.decontaminate(docs, bench).collect()}
    # only A-Z is compared without regard to case
    assert {i: [x.item_id for x in got[i]["items"]] for i in got} == {1: [1], 2: [2], 3: [], 4: []}
    assert (got[1].n_hit, got[2].n_hit) == (13, 3)


def test_template_is_counted_over_all_pages(spark):
    """A notice on most pages of a host that the reference page lacks, and a page repeated many times."""
    r = random.Random(51)

    def text(n):
        return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))

    bodies = [[text(r.randrange(20, 40)) for _ in range(r.randrange(2, 5))] for _ in range(200)]
    notice = "<div><b>Please read our rules</b></div>"
    pages = [
        f"<html><body><div><h1>T{i}</h1>{''.join(f'<p>{p}</p>' for p in b)}{notice if i % 20 else ''}</div></body></html>"
        for i, b in enumerate(bodies)
    ]
    want = [" ".join([f"T{i}", *b]) for i, b in enumerate(bodies)]
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(pages)]
    # a host each of whose pages has 40 equal rows and more
    rows += [(1000 + i, f"http://g/{i % 40}", p) for i, p in enumerate(pages[:40])]
    rows += [(2000 + 40 * i + k, f"http://g/{i}", pages[i]) for i in range(40) for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for limit in (0, 1 << 25):
        got = {x.page_id: x.main_text for x in wrapper.main_text(frame, per_host=1, limit=limit).collect()}
        assert [got[i] for i in range(200)] == want
        assert [got[1000 + i] for i in range(40)] == want[:40]


def test_passages_made_of_frequent_pieces(spark):
    """Two documents share a passage all of whose short pieces, and their joints, occur earlier one by one."""
    r = random.Random(61)
    rows = []
    for i in range(40):
        passage = [f"q{i}_{j}" for j in range(62)]
        # overlapping pieces of 18 words, each in an earlier document of its own
        pieces = [passage[at : at + 18] for at in range(0, 62, 4)]
        for body in [*pieces, passage, passage]:
            around = [[f"u{r.random()}" for _ in range(10)] for _ in range(2)]
            rows.append((len(rows), " ".join(around[0] + body + around[1])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = chaining.repeated_passages(docs).collect()
    last = set(range(17, len(rows), 18))
    assert {x.doc_id for x in got if x.other_id == x.doc_id - 1} == last == {x.doc_id for x in got}


def test_passages_do_not_depend_on_hot_seeds(spark, monkeypatch):
    """A passage in a third of all rows, with all of its seeds joined by broadcast and with none."""
    r = random.Random(71)
    passage = words(60, 900).split()
    rows = []
    for i in range(120):
        body = passage if i % 3 == 0 else [f"v{i // 2}_{j}" for j in range(55)] if i % 3 == 1 else []
        rows.append((i, " ".join([f"u{r.random()}" for _ in range(20)] + body)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    for hot in (1, 1000, 10**9):
        monkeypatch.setattr(chaining, "HOT", hot)
        found.append(sorted(map(tuple, chaining.repeated_passages(docs).collect())))
    assert found[0] == found[1] == found[2]
    assert {x[0] for x in found[0] if x[1] == 0} == set(range(3, 120, 3))


def test_lm_joins_words_apart_from_the_last_query(spark, monkeypatch):
    """What is joined per word is staged per text: the result itself joins and groups no words."""
    docs = spark.createDataFrame([(str(i), f"rare{i} word{i % 3} end") for i in range(60)], "doc_id string, text string")
    lm, counts = bloom_lm.learn(docs, F.lit(True), contexts=2, max_bits=1 << 8)
    staged, inner = [], bloom_lm.settle

    def spy(df, name):
        staged.append(name)
        return inner(df, name)

    monkeypatch.setattr(bloom_lm, "settle", spy)
    got = bloom_lm.score(docs, lm, counts)
    assert staged == ["scored", "tails"] + ["open"] * (lm.below is not None)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in text and "Generate" not in text
    assert got.count() == 60
