"""The linear suffix sorter against sorting, and removal of repeated bytes against a plain search."""

import random

import numpy as np
import pytest

from premisa.llm import suffix_dedup as sd
from premisa.llm.common import session
from premisa.llm.lyndon_groups import grouped, suffix_array

SCHEMA = "doc_id bigint, text string, t string, ranges int, text_id int, `a.b` int, repeats string"


def sample(r):
    k, n = r.choice([1, 2, 3, 5]), r.randrange(60)
    x = [r.randrange(1, k + 1) for _ in range(n)]
    if x and r.random() < 0.3:
        x = (x[: r.randrange(1, 5)] * 60)[:n]
    return np.array([*x, 0])


def test_suffix_array_equals_sorting():
    r = random.Random(1)
    for _ in range(2000):
        x = sample(r)
        assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def lyndon_end(x, i):
    return next((j for j in range(i + 1, len(x)) if x[j:].tolist() < x[i:].tolist()), len(x))


def test_groups_are_ordered_lyndon_words():
    r = random.Random(2)
    for _ in range(300):
        x = sample(r)
        order, group, _ = grouped(x)
        word = [x[i : lyndon_end(x, i)].tolist() for i in range(len(x))]
        keys = [word[i] for i in order]
        assert keys == sorted(keys)
        assert all((group[i] == group[j]) == (word[i] == word[j]) for i in order for j in order)


def test_sliding_least():
    r = np.random.default_rng(3)
    for n, w in [(1, 1), (10, 3), (10, 10), (100, 7), (99, 33)]:
        x = r.integers(0, 50, n).astype(np.uint64)
        assert sd.sliding_least(x, w).tolist() == [int(x[i : i + w].min()) for i in range(n - w + 1)]


def plain(texts, span):
    """Spans and kept bytes of each text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - span + 1):
            seen[b[i : i + span]] = seen.get(b[i : i + span], 0) + 1
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        edges = np.flatnonzero(np.diff([False, *gone, False])).tolist()
        out.append(([*zip(edges[::2], edges[1::2], strict=True)], bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def corpus():
    """Shared and repeated passages, copies, one passage in a third of all texts amid different text, a run of
    one letter, text that repeats itself, letters of several bytes, NULL and empty text."""
    r = random.Random(5)
    letters = "ab é日cdefgh\n"

    def words(n, alphabet=letters):
        return "".join(r.choice(alphabet) for _ in range(n))

    common, shared = words(60), [words(r.randrange(30, 120)) for _ in range(6)]
    texts = [None, "", "a", words(39), words(40), "x" * 300, "xy" * 200, words(50) * 5]
    for i in range(90):
        middle = common if i % 3 == 0 else r.choice([*shared, ""])
        texts.append(words(r.randrange(80)) + middle + words(r.randrange(80)) + r.choice(["", r.choice(shared)]))
    texts += [texts[20], texts[20], texts[20], texts[30], texts[31] + "q", "q" + texts[32], texts[33][:-1] + "z"]
    long = words(6000)
    texts += [long, words(10) + long[100:5900:1] + words(10), long[:3000] + "#" + long[3001:]]
    return texts


def test_key_blocks():
    keys, sizes = np.array([1, 1, 2, 3, 3, 3, 4]), [5, 5, 4, 9, 9, 9, 1]
    assert [list(x) for x in sd.key_blocks(keys, sizes, 14)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [list(x) for x in sd.key_blocks(keys, sizes, 100)] == [list(range(7))]
    assert list(sd.key_blocks(keys[:0], [], 14)) == []


@pytest.mark.parametrize(("bucket", "most"), [(1 << 18, 4096), (500, 4), (4000, 2)])
def test_repeated_bytes_equal_a_plain_search(spark, bucket, most):
    """With whole and crowded keys, one and many buckets."""
    session(spark)
    texts = corpus()
    rows = [(i if i != 9 else None, t, "t", 1, 2, 3, "r") for i, t in enumerate(texts)]
    rows[12] = (11, *rows[12][1:])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sd.repeated_bytes(docs, span=40, gram=16, bucket=bucket, most=most)
    assert sorted(got.columns) == sorted(docs.columns)
    got = got.select("text", "`a.b`", "repeats.*").collect()
    want = dict(zip(texts, plain(texts, 40), strict=True))
    assert len(got) == len(texts) and sum(len(x.spans) > 0 for x in got) > 40
    for x in got:
        spans, kept = want[x.text]
        assert [(s.start, s.end) for s in x.spans] == spans
        assert bytes(x.kept) == kept and x.n_bytes == len((x.text or "").encode()) and x["a.b"] == 3


def test_repeats_inside_one_text_and_at_its_ends(spark):
    session(spark)
    r = random.Random(8)
    a = "".join(r.choice("abcdefgh ") for _ in range(200))
    texts = [a + "1" + a, a[:199], "2" + a[1:], a[:199] + "3"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {x.doc_id: x.repeats for x in sd.repeated_bytes(docs).collect()}
    assert [(s.start, s.end) for s in got[0].spans] == [(0, 200), (201, 401)] and bytes(got[0].kept) == b"1"
    # 199 shared bytes are too few
    assert [len(got[i].spans) for i in (1, 2, 3)] == [0, 0, 0]


def test_no_rows(spark):
    session(spark)
    docs = spark.createDataFrame([(None, None), (1, "")], "doc_id bigint, text string")
    got = sd.repeated_bytes(docs).collect()
    assert [(x.repeats.n_bytes, x.repeats.spans, bytes(x.repeats.kept)) for x in got] == [(0, [], b"")] * 2
    assert sd.repeated_bytes(docs.limit(0)).count() == 0


def test_a_crowded_key_is_cut_until_it_fits(spark):
    """A gram amid hundreds of different surroundings; some share one side, some windows repeat."""
    session(spark)
    r = random.Random(6)
    middle = "".join(r.choice("abcdefgh") for _ in range(30))
    sides = ["".join(r.choice("ijklmnop") for _ in range(40)) for _ in range(30)]
    texts = [r.choice(sides) + middle + r.choice(sides) for _ in range(250)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    want = plain(texts, 40)
    for most in (2, 30, 4096):
        got = sd.repeated_bytes(docs, span=40, gram=20, most=most)
        got = {x.doc_id: [(s.start, s.end) for s in x.repeats.spans] for x in got.collect()}
        assert all(got[i] == spans for i, (spans, _) in enumerate(want))


def test_the_filter_loses_nothing(spark):
    h = [(-(1 << 63),), (-1,), (0,), (5,), (1 << 40,), ((1 << 63) - 1,)]
    words = sd.gram_filter(spark.createDataFrame(h, "h bigint"))
    assert sd.passing(np.array([x for (x,) in h]), words).all()
    assert not sd.passing(np.array([1, 2, 77777]), words).any()
    assert words.nbytes == 16 << 20
