"""The operators' parts against brute force, without Spark."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from premisa.llm import bloom_lm, chaining, packing, repetition, setsketch, toxicity, trie_counts, wrapper
from premisa.llm.common import tokenizer_file
from premisa.llm.shingles import WordHash, mixed, shingle_set, word_hashes


def longest_repeats(words):
    n = len(words)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_repeats_equal_brute_force(seed):
    r = random.Random(seed)
    texts = [
        [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randrange(25))]
        for _ in range(r.randrange(1, 5))
    ]
    flat = np.array([w for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts])
    got = repetition.repeats(flat, np.repeat(np.cumsum(sizes), sizes))
    assert got.tolist() == [x for t in texts for x in longest_repeats(t)]


def test_verdict_limits():
    fresh = " ".join(f"w{i}" for i in range(300))
    passage = " ".join(f"p{i}" for i in range(101))
    got = repetition.measure(
        [fresh, f"{passage} {fresh} {passage}", "a b c " * 40, "", "a\n\na\n b\na"], 10, 0.4, 100, 50
    )
    assert got["kept"] == [True, False, False, False, False]
    assert got["longest_repeat"][:3] == [0, 101, 117]
    assert got["n_dup_lines"] == [0, 0, 0, 0, 2]
    assert got["base_failed"] == [False, False, True, True, True]


def test_long_text_of_one_word():
    got = repetition.measure(["a " * 50_000], 10, 0.4, 100, 50)
    assert got["longest_repeat"] == [49_999] and got["n_repeat_words"] == [50_000]


def test_trie_equals_plain_search():
    vocabulary = trie_counts.Vocabulary.load(tokenizer_file("piece_bpe_32k.model"))
    counts = trie_counts.Counts(vocabulary)

    def plain(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            options = []
            for j in range(i):
                piece = word[j:i]
                if piece in vocabulary.scores:
                    options.append((best[j][0] + vocabulary.scores[piece], -best[j][1] - 1))
                elif j == i - 1:
                    n = len(piece.encode())
                    options.append((best[j][0] + vocabulary.byte * n, -best[j][1] - n))
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    r = random.Random(5)
    letters = "abcdeité日ß😀1.,"
    words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 150))) for _ in range(300)]
    words += ["the", "information", "Donau", "a" * 500]
    for w in words:
        assert counts[w] == plain("▁" + w)


def test_trie_is_emptied_without_a_change(monkeypatch):
    vocabulary = trie_counts.Vocabulary({"▁": -1.0, "▁a": -2.0, "ab": -1.5, "b": -2.0})
    words = ["abab", "ab", "ba", "aaab"]
    before = [trie_counts.Counts(vocabulary)[w] for w in words]
    monkeypatch.setattr(trie_counts, "TRIE_NODES", 7)
    one = trie_counts.Counts(vocabulary)
    assert [one[w] for w in words] == before


def test_words_encode_as_whole_texts():
    e = packing.Encoder(tokenizer_file("word_bpe_49k.json"))
    r = random.Random(1)
    letters = "aBé ÉΣσß'stİ́ \x1c \t\n12.,日本 ŉǅ—‍"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", "I'll don't 'Tis x'VE", "word, word. (Word)"]
    for t in texts:
        want = e.whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want, repr(t)


@pytest.mark.parametrize("docs,cost", [(2048, 2048.0**2), (3, 2048.0**2), (2048, 1.5e6)])
def test_best_fit_respects_every_capacity(docs, cost):
    sizes = np.random.default_rng(3).integers(1, 1200, 600)
    bins, places = packing.best_fit(sizes, 2048, docs, cost)
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(places[own])]
        assert len(own) and len(own) <= docs
        assert sizes[own].sum() <= 2048 and (sizes[own].astype(float) ** 2).sum() <= cost
        assert (np.cumsum(sizes[own]) - sizes[own] == places[own]).all()
    if docs > 3 and cost > 2e6:
        assert bins.max() + 1 <= math.ceil(sizes.sum() / 2048) + 2


def test_filter_misses_nothing_and_rarely_errs():
    keys = mixed(np.arange(1, 5001, dtype=np.uint64))
    levels = np.random.default_rng(1).integers(1, 8, 5000)
    bits = 1 << 11
    cells = np.zeros(bloom_lm.SEGMENTS * bits, bool)
    for turn in range(1, 8):
        own = keys[levels >= turn]
        for place in bloom_lm.bit_places(own, turn, bits):
            cells[place + bloom_lm.segment_of(own).astype(np.uint64) * np.uint64(bits)] = True
    f = bloom_lm.Filter(np.packbits(cells, bitorder="little"), bits, 1)
    got = bloom_lm.probe(f, keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    other = bloom_lm.probe(f, mixed(np.arange(10**6, 10**6 + 5000, dtype=np.uint64)))
    assert (other == 0).mean() > 0.97


def test_levels():
    assert bloom_lm.level(np.array([0, 1, 2, 3, 4, 7, 8, 1 << 40])).tolist() == [0, 1, 2, 2, 3, 3, 4, 41]


def test_noisy_or_finds_the_word():
    r = random.Random(0)
    texts, toxic = [], []
    for i in range(300):
        parts = [" ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(6)) for _ in range(8)]
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            parts[r.randrange(8)] += " vileness"
        texts.append(". ".join(parts))
    encoded = [
        [
            np.array(sorted({x for w in m.group().lower().split() for x in toxicity.features(w, 1 << 12)}))
            for m in toxicity.SENTENCE.finditer(t)
        ]
        for t in texts
    ]
    model = toxicity.fit(encoded, np.array(toxic), 0.25, 1 << 12)
    weight = toxicity.Weight(model.weights)
    for t, y in zip(texts, toxic, strict=True):
        odds = toxicity.sentence_odds(t, weight, model.offset)
        assert (toxicity.noisy_or([z for *_, z in odds]) >= 0.5) == y
        if y:
            a, b, _ = max(odds, key=lambda x: x[2])
            assert "vileness" in t[a:b]


@pytest.mark.parametrize("toxic", [[], [True, True], [False, False]])
def test_fit_without_both_classes(toxic):
    docs = [[np.array([1, 2])] for _ in toxic]
    model = toxicity.fit(docs, np.array(toxic, bool), float(bool(toxic and toxic[0])))
    assert np.isfinite(model.offset) and not model.weights.any()


def test_sketch_merges_and_estimates():
    r = np.random.default_rng(2)
    factor, summand = setsketch.seeds(180)
    for share in (0.2, 0.5, 0.75, 0.95):
        a = mixed(r.integers(1, 1 << 60, 900).astype(np.uint64))
        k = int(round(2 * 900 * share / (1 + share)))
        b = np.concatenate([a[:k], mixed(r.integers(1, 1 << 60, 900 - k).astype(np.uint64))])
        la, lb = (setsketch.smallest(x, factor, summand) for x in (a, b))
        union = setsketch.smallest(np.concatenate([a, b]), factor, summand)
        ra, rb = setsketch.registers(la), setsketch.registers(lb)
        assert (np.maximum(ra, rb) == setsketch.registers(union)).all()
        sizes = np.array([900.0])
        got = setsketch.estimate(ra[None], rb[None], sizes, sizes)[0]
        assert abs(got - share) < 0.15


def test_shingle_sets():
    known = WordHash()
    assert len(shingle_set(None, 5, known)) == len(shingle_set(" \n", 5, known)) == 0
    assert len(shingle_set("a b c", 5, known)) == 1
    assert set(shingle_set("A b c d e f", 5, known)) == set(shingle_set("a B c d e f", 5, known))
    assert len(shingle_set("x " * 100, 5, known)) == 1
    assert set(shingle_set("É b c d e", 5, known)) != set(shingle_set("é b c d e", 5, known))


def best_chain(x, y, k, gap):
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    score = {}
    for i in order:
        gains = [
            min(score[j] - gap * (x[i] - x[j] + y[i] - y[j] - 2 * k), score[j])
            for j in score
            if x[j] < x[i] and y[j] < y[i]
        ]
        score[i] = k + max([0.0, *gains])
    return max(score.values())


@pytest.mark.parametrize("seed", range(40))
def test_chains_rise_and_the_best_is_best_without_overlap(seed):
    r = random.Random(seed)
    n, k = r.randrange(1, 30), 6
    # anchors at least 2k apart, where the cap on the gain does not bind
    x = [r.randrange(40) * 2 * k for _ in range(n)]
    y = [r.randrange(40) * 2 * k for _ in range(n)]
    got = chaining.chains(x, y, k, 0.05)
    assert sorted(i for c in got for i in c) == list(range(n))
    for c in got:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
    top = got[0]
    total = k * len(top) - sum(
        0.05 * (x[b] - x[a] + y[b] - y[a] - 2 * k) for a, b in zip(top, top[1:], strict=False)
    )
    assert abs(total - best_chain(x, y, k, 0.05)) < 1e-9


def test_shared_runs_share_a_seed():
    r = random.Random(4)
    known = WordHash()
    for _ in range(200):
        run = [f"s{r.randrange(30)}".encode() for _ in range(chaining.K + chaining.WINDOW - 1)]
        found = []
        for _ in range(2):
            words = [f"t{r.random()}".encode() for _ in range(r.randrange(60))]
            at = r.randrange(len(words) + 1)
            hashes = word_hashes(words[:at] + run + words[at:], known)
            found.append(set(chaining.seeds_of(hashes, chaining.K, chaining.WINDOW)[1].tolist()))
        assert found[0] & found[1]


def page(title, paragraphs, ad, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body>"
        f"<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class='ad'>{ad}</div>"
        f"<div id=c1><h1>{title}</h1>{body}<div class=tag>Terms of this site apply</div>{extra}</div>"
        f"<div class='comments'><p>nice {ad}</p></div><footer>&copy; site</footer></body></html>"
    )


def test_wrapper_reads_the_varying_slot():
    r = random.Random(3)

    def text(n):
        return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))

    titles = [text(4) for _ in range(12)]
    bodies = [[text(r.randrange(20, 60)) for _ in range(r.randrange(1, 6))] for _ in range(12)]
    pages = [page(t, b, text(5)) for t, b in zip(titles, bodies, strict=True)]
    learnt = wrapper.load(wrapper.json.loads(wrapper.induce(pages[:10])))
    for t, b, p in zip(titles, bodies, pages, strict=True):
        assert wrapper.extract(p, learnt) == " ".join([t, *b])
    # the fixed line inside the slot is only known from the other pages
    assert "Terms of this site" in wrapper.extract(pages[0], None)


def test_pages_are_read_leniently():
    assert wrapper.extract("<p>a&amp;b &lt;<b>c</b>d<p>e\n f<br>g", None) == "a&b <cd e f g"
    for broken in ("<", "<p", "<a href='x>y", "</p></p>", "<!--", "<script>", "<div>" * 3000 + "x", "a < b"):
        wrapper.extract(broken, wrapper.load(wrapper.json.loads(wrapper.induce([broken, "<p>x"]))))


def test_tree_matching_size():
    a = wrapper.parse("<ul><li>1<li>2<li><b>3</b></ul>")
    b = wrapper.parse("<ul><li>1<li><b>3</b><li>4<li>5</ul>")
    size, _ = wrapper.match(a, b)
    # root, ul, the first li and its text, and the li with the b and its text
    assert size == len(list(wrapper.aligned(a, b)))
    assert size == 7


@pytest.mark.parametrize("window", [1, 2, 4, 16])
def test_seeds_are_the_last_least_of_each_window(window):
    r = random.Random(window)
    known = WordHash()
    for n in range(60):
        own = word_hashes([f"s{r.randrange(4)}".encode() for _ in range(n)], known)
        at, h = chaining.seeds_of(own, 3, window)
        grams = chaining.runs(own, 3) if n >= 3 else []
        want = set()
        for i in range(max(1, len(grams) - window + 1) if len(grams) else 0):
            view = list(grams[i : i + window])
            want.add(i + max(j for j, g in enumerate(view) if g == min(view)))
        assert at.tolist() == sorted(want) and all(h == [grams[i] for i in at])


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_words_of_many_texts_equal_splitting(chunk, monkeypatch):
    """Equal words, and only these, have equal hashes; texts are parted as ``bytes.split`` parts them."""
    monkeypatch.setattr(chaining, "CHUNK", chunk)
    r = random.Random(8)
    pieces = [" ", "\n", "\t\x0b", "a", "A", "b", "É", "é", "\u00a0", "\x00", "Zebra", "z" * 40]
    texts = ["".join(r.choices(pieces, k=r.randrange(12))) for _ in range(200)] + [None, "", " ", "x", None]
    want = [t.encode().lower().split() if t else [] for t in texts]
    names, hashes = {}, {}
    for column in (pa.array(texts), pa.array([None, *texts], pa.large_string())[1:]):
        got = chaining.Words().of_texts(column)
        assert [len(g) for g in got] == [len(w) for w in want]
        for own, words in zip(got, want, strict=True):
            for h, w in zip(own.tolist(), words, strict=True):
                assert names.setdefault(h, w) == w and hashes.setdefault(w, h) == h
    assert all(not len(x) for x in chaining.Words().of_texts(pa.array([None, "", None], pa.string())))
    assert chaining.Words().of_texts(pa.array([], pa.string())) == []


def test_sent_hashes_keep_their_lowest_bytes():
    r = random.Random(9)
    for n in (0, 1, 50):
        own = np.array([r.randrange(1 << 64) for _ in range(n)], np.uint64)
        got = chaining.unpacked(chaining.packed(own))
        assert got.tolist() == [x % (1 << 40) for x in own.tolist()]
