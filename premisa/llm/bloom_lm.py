"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premisa.llm.shingles import STEP, mixed
from premisa.llm.common import opened, ship
from premisa.sources.staging import settle

END = b"\n"  # no word holds a line feed
HOT = 1_000_000
CONTEXTS = 20_000
SEGMENTS = 256
MAX_BITS = 1 << 28
BITS_PER_KEY = 10
PROBES = 5
DISCOUNT = 0.75
FLUSH_WORDS = 400_000
FLUSH_PAIRS = 4_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and one end."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


def level(counts: np.ndarray) -> np.ndarray:
    """One plus the whole binary logarithm of each count; 0 for 0."""
    return np.frexp(np.asarray(counts, float))[1].astype(np.int64)


def unigram_key(words: np.ndarray) -> np.ndarray:
    return mixed(words + STEP)


def bigram_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first * STEP + np.uint64(7)) + second)


def context_key(words: np.ndarray) -> np.ndarray:
    return mixed(words * STEP + np.uint64(13))


def salt(turn: int) -> np.uint64:
    return np.uint64(turn * int(STEP) % (1 << 64))


def bit_places(keys: np.ndarray, turn: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of a key at one level, within its segment."""
    a = mixed(keys + salt(turn))
    step = (a >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * step) & np.uint64(bits - 1)


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(56)).astype(np.int64)


@dataclass
class Filter:
    """Bits of all segments, end to end. A key is present at every level up to that of its count."""

    cells: np.ndarray
    bits: int
    lowest: int


def probe(f: Filter, keys: np.ndarray) -> np.ndarray:
    """Levels of keys in the filter, 0 for those that miss at the lowest one."""
    found = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    offset = segment_of(keys).astype(np.uint64) * np.uint64(f.bits)
    turn = f.lowest
    while len(live):
        a = mixed(keys[live] + salt(turn))
        step = (a >> np.uint64(32)) | np.uint64(1)
        base = offset[live]
        for i in range(PROBES):
            at = ((a + np.uint64(i) * step) & np.uint64(f.bits - 1)) + base
            hit = ((f.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) > 0
            live, a, step, base = live[hit], a[hit], step[hit], base[hit]
        found[live] = turn
        turn += 1
    return found


@dataclass
class Model:
    """What the tasks get: bounded tables and the filter. ``counts`` stays a distributed table."""

    total: int
    types: int
    unseen: float
    hot: np.ndarray  # hashes of words with at least total / HOT tokens, sorted
    hot_counts: np.ndarray
    contexts: np.ndarray  # numbers of the hot words that are exact contexts, or -1
    context_total: np.ndarray
    context_rest: np.ndarray
    unigram_mean: np.ndarray  # mean count of each level
    bigram_mean: np.ndarray
    kinds_mean: np.ndarray  # mean number of different words after a context, of each level
    filter: Filter
    below: tuple[DataFrame, DataFrame] | None  # words and pairs below the filter's lowest level


class Words(dict):
    """Numbers words as they come; their hashes are looked up once per word."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(xxhash.xxh3_64_intdigest(word))
        number = self[word] = len(self)
        return number


def count_words(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
            counts = np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(counts)], ["h", "c"]
            )

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens(t))
                if len(seen) > FLUSH_WORDS:
                    yield rows()
        yield rows()

    partial = docs.select(text).mapInArrow(run, "h bigint, c bigint")
    return settle(partial.groupBy("h").agg(F.sum("c").alias("c")), "word-counts")


def lookup(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array, -1 where they are not in it."""
    if not len(sorted_):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def count_pairs(docs: DataFrame, text: str) -> DataFrame:
    """Counts of all neighbouring words: hash of the first, key of both, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashes = Words(), np.zeros(0, np.uint64)
        waiting, held = [], 0

        def rows() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(waiting), return_counts=True)
            first = hashes[codes >> 32]
            keys = bigram_key(first, hashes[codes & 0xFFFFFFFF])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(first.view(np.int64)),
                    pa.array(keys.view(np.int64)),
                    pa.array(counts.astype(np.int64)),
                ],
                ["a", "key", "c"],
            )

        for batch in batches:
            stream = [END]
            for t in batch.column(0).to_pylist():
                stream += tokens(t)
            ids = np.fromiter(map(words.__getitem__, stream), np.int64, len(stream))
            if words.new:
                hashes = np.concatenate([hashes, np.array(words.new, np.uint64)])
                words.new = []
            waiting.append((ids[:-1] << 32) | ids[1:])
            held += len(ids) - 1
            if held > FLUSH_PAIRS or len(words) > FLUSH_WORDS:
                yield rows()
                waiting, held = [], 0
            if len(words) > FLUSH_WORDS:
                words, hashes = Words(), np.zeros(0, np.uint64)
        if waiting:
            yield rows()

    partial = docs.select(text).mapInArrow(run, "a bigint, key bigint, c bigint")
    return settle(partial.groupBy("a", "key").agg(F.sum("c").alias("c")), "pair-counts")


def level_column(count: str = "c") -> Column:
    return (F.floor(F.log2(count) + 1e-12) + 1).cast("int")


def build_filter(entries: DataFrame, max_bits: int) -> Filter:
    """The filter of rows ``key`` (a hash) and ``q`` (the level of its count).

    A key is set at each level from the lowest kept one up to its own. The filter takes
    ``BITS_PER_KEY`` bits for each, up to ``max_bits``; if all do not fit, it starts at a higher level,
    and the n-grams below are joined (``settled``). Its segments are filled side by side.
    """
    histogram = {r["q"]: r["k"] for r in entries.groupBy("q").agg(F.count("*").alias("k")).collect()}
    lowest = 1

    def keys(low: int) -> int:
        return sum((q - low + 1) * k for q, k in histogram.items() if q >= low)

    while keys(lowest) * BITS_PER_KEY > max_bits:
        lowest += 1
    bits = 1 << 8
    while bits * SEGMENTS < min(max_bits, keys(lowest) * BITS_PER_KEY):
        bits *= 2

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(bits, bool)
        keys = group["key"].to_numpy().view(np.uint64)
        levels = group["q"].to_numpy()
        for turn in range(lowest, int(levels.max()) + 1):
            for place in bit_places(keys[levels >= turn], turn, bits):
                cells[place] = True
        packed = np.packbits(cells, bitorder="little").tobytes()
        return pd.DataFrame({"segment": [int(group["segment"].iloc[0])], "cells": [packed]})

    segment = F.shiftrightunsigned("key", 56).cast("int").alias("segment")
    parts = entries.where(F.col("q") >= lowest).select("key", "q", segment).groupBy("segment")
    cells = np.zeros(SEGMENTS * bits // 8, np.uint8)
    for row in parts.applyInPandas(fill, "segment int, cells binary").toLocalIterator():
        at = row["segment"] * bits // 8
        cells[at : at + bits // 8] = np.frombuffer(row["cells"], np.uint8)
    return Filter(cells, bits, lowest)


def mean_counts(counts: DataFrame) -> np.ndarray:
    """Mean count of each level; level 0 has 0."""
    rows = counts.groupBy(level_column().alias("q")).agg(F.avg("c").alias("m")).collect()
    means = np.zeros(66)
    for r in rows:
        means[r["q"]] = r["m"]
    return means


def learn(
    docs: DataFrame,
    training: Column,
    text: str = "text",
    hot: int = HOT,
    contexts: int = CONTEXTS,
    max_bits: int = MAX_BITS,
) -> tuple[Model, DataFrame]:
    """Count the training texts and build the model; also the table of word counts, ``h`` and ``c``.

    Words that make up a ``hot``-th of all tokens are at most ``hot`` many, so their exact counts can
    be sent to the tasks; in the same way what follows ``contexts`` words at most is sent. All words
    are contexts: the filter of ``max_bits`` at most holds the quantised counts of all words and all
    neighbouring words, and how many different words follow each word. What is too rare for the filter
    stays in distributed tables with the same quantised counts, so the bound moves no score.
    """
    chosen = docs.where(F.coalesce(training, F.lit(False)))
    counts = count_words(chosen, text)
    total, types, single = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1))
    ).first()
    frequent = counts.where(F.col("c") * hot >= total).toArrow()
    hashes = frequent.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, exact = hashes[order], frequent.column("c").to_numpy()[order]
    is_context = exact * contexts >= total
    size = max(1, int(is_context.sum()))
    pairs = count_pairs(chosen, text)
    kinds = settle(pairs.groupBy("a").agg(F.count("*").alias("c")), "context-kinds")

    def keyed(key: Callable[[np.ndarray], np.ndarray]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = key(b.column(0).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), b.column(1)], ["key", "q"]
                )

        return run

    q = level_column().alias("q")
    entries = counts.select("h", q).mapInArrow(keyed(unigram_key), "key bigint, q int")
    entries = entries.union(pairs.select("key", q))
    # a context that is not in the filter is followed by one kind of word
    several = kinds.where("c > 1").select("a", q)
    entries = entries.union(several.mapInArrow(keyed(context_key), "key bigint, q int"))
    filter_ = build_filter(entries, max_bits)
    unigram_mean, bigram_mean, kinds_mean = map(mean_counts, (counts, pairs, kinds))
    below = None
    if filter_.lowest > 1:
        few = 1 << (filter_.lowest - 1)
        figures = counts.join(kinds.select(F.col("a").alias("h"), F.col("c").alias("k")), "h", "left")
        rare = figures.where((F.col("c") < few) | (F.coalesce("k", F.lit(1)) < few))
        below = rare, pairs.where(F.col("c") < few).select("key", "c")

    # of each exact context: what its bigrams count together as quantised, and how many there are
    sent = F.broadcast(counts.where(F.col("c") * contexts >= total).select(F.col("h").alias("a")))
    kept = pairs.join(sent, "a", "left_semi").select("a", q)
    kept = kept.groupBy("a", "q").count().toArrow()
    mass, many = np.zeros(size), np.zeros(size)
    first = lookup(hashes[is_context], kept.column("a").to_numpy().view(np.uint64))
    n = kept.column("count").to_numpy().astype(float)
    np.add.at(mass, first, n * bigram_mean[kept.column("q").to_numpy()])
    np.add.at(many, first, n)
    number = np.full(len(hashes), -1, np.int64)
    number[is_context] = np.arange(is_context.sum())
    context_total = np.maximum(np.concatenate([exact[is_context], np.ones(size - is_context.sum())]), mass)
    rest = 1 - (mass - DISCOUNT * many) / context_total
    unseen = (single + 1) / (total + 2)
    model = Model(
        total, types, unseen, hashes, exact, number, context_total, rest,
        unigram_mean, bigram_mean, kinds_mean, filter_, below,
    )
    return model, counts


def word_figures(m: Model, words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of words by hash: probability as a unigram, count as a context, and the share left to unigrams.

    Words that are no exact context take both from quantised counts; a word not seen leaves all. The
    last two rows tell which words the filter has, and which are contexts with figures known for sure.
    """
    q = probe(m.filter, unigram_key(words))
    uni = np.where(q > 0, (1 - m.unseen) * m.unigram_mean[q] / max(1, m.total), m.unseen)
    total = np.where(q > 0, np.maximum(m.unigram_mean[q], 1.0), 1.0)
    k = probe(m.filter, context_key(words))
    rest = np.where(q > 0, np.minimum(DISCOUNT * np.maximum(m.kinds_mean[k], 1.0) / total, 1.0), 1.0)
    number = np.where(places >= 0, m.contexts[places] if len(m.contexts) else -1, -1)
    known = number >= 0
    total[known], rest[known] = m.context_total[number[known]], m.context_rest[number[known]]
    # a context with fewer kinds than the lowest level has one kind if that level starts at two
    sure = known | ((q > 0) & ((k > 0) | (m.filter.lowest <= 2)))
    return np.stack([uni, total, rest, q > 0, sure])


def settled(scored: DataFrame, m: Model) -> DataFrame:
    """The log10 probabilities, summed by ``_row``, of the places that the filter leaves open.

    Rare words and pairs are joined by hash, each place where it needs it; a place with both words
    known is moved once.
    """
    words, pairs = m.below

    def mean(means: np.ndarray, count: str) -> Column:
        return F.get(F.array(*map(F.lit, means.tolist())), F.coalesce(level_column(count), F.lit(0)))

    def found(rows: DataFrame, key: str, table: DataFrame, **new: Column) -> DataFrame:
        ready = rows.where(F.col(key).isNull())
        joined = rows.where(F.col(key).isNotNull()).join(table.withColumnRenamed(table.columns[0], key), key, "left")
        return joined.withColumns(new).select(*rows.columns).union(ready.select(*rows.columns))

    rows = scored.select("_row", F.inline("open"))
    seen = F.col("c").isNotNull()
    uni = F.lit(float((1 - m.unseen) / max(1, m.total))) * mean(m.unigram_mean, "c")
    rows = found(rows, "v", words, uni=F.when(seen, uni).otherwise(float(m.unseen)))
    whole = F.when(seen, F.greatest(mean(m.unigram_mean, "c"), F.lit(1.0))).otherwise(1.0)
    kinds = F.greatest(mean(m.kinds_mean, "k"), F.lit(1.0))
    rest = F.when(seen, F.least(DISCOUNT * kinds / whole, F.lit(1.0))).otherwise(1.0)
    rows = found(rows, "u", words, whole=whole, rest=rest)
    rows = rows.select("_row", "key", "gain", (F.col("uni") * F.col("rest")).alias("back"), "whole")
    rows = found(rows, "key", pairs, gain=F.greatest(mean(m.bigram_mean, "c") - DISCOUNT, F.lit(0.0)))
    p = F.col("back") + F.col("gain") / F.col("whole")
    p = F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))
    return rows.groupBy("_row").agg(F.sum(F.log10(p)).alias("_open"))


def score(
    docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    ``score`` is the log10 probability of the text and its end: bigram estimates with an absolute
    discount, interpolated with unigram estimates. Counts are what repeated probes of the filter
    tell, taken as the mean count of their level; unseen words share the Good-Turing mass. A text's
    first word follows an end. ``base_score`` and ``n_known`` use exact counts: those of frequent words are
    sent along, all other words are joined with the distributed table of counts.

    A NULL or empty text is its end alone. Repeated rows are scored each, a NULL id stays NULL.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = ship(docs.sparkSession, replace(model, below=None))
    unit = np.log10(model.total + model.types + 1)
    pairs = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
    open_type = pa.list_(
        pa.struct(
            [(c, pa.int64()) for c in ("key", "u", "v")]
            + [(c, pa.float64()) for c in ("gain", "uni", "whole", "rest")]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(sent)
        row = TaskContext.get().partitionId() << 40

        def empty() -> tuple:
            return Words(), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((5, 0))

        words, hashes, places, figures = empty()
        for batch in batches:
            stream, ends = [END], []
            for t in batch.column(1).to_pylist():
                stream += tokens(t)
                ends.append(len(stream) - 1)
            if not ends:
                continue
            ids = np.fromiter(map(words.__getitem__, stream), np.int64, len(stream))
            if words.new:
                new = np.array(words.new, np.uint64)
                words.new = []
                at = lookup(m.hot, new)
                hashes = np.concatenate([hashes, new])
                places = np.concatenate([places, at])
                figures = np.concatenate([figures, word_figures(m, new, at)], axis=1)
            at = places[ids]
            codes, back = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)
            before, after = codes >> 32, codes & 0xFFFFFFFF
            uni, (_, whole, rest, seen, sure) = figures[0][after], figures[:, before]
            p = uni * rest
            both = np.flatnonzero((seen > 0) & (figures[3][after] > 0))
            q = probe(m.filter, bigram_key(hashes[before[both]], hashes[after[both]]))
            gain = np.zeros(len(codes))
            gain[both] = np.where(q > 0, np.maximum(m.bigram_mean[q] - DISCOUNT, 0), 0.0)
            p += gain / whole
            if m.filter.lowest > 1:
                hit = np.zeros(len(codes), bool)
                hit[both] = q > 0
                v_open, u_open = figures[3][after] == 0, sure == 0
                left = v_open | u_open | ~hit
                p[left] = 1.0  # left to the joins
                at_open = np.flatnonzero(left[back])
                which = back[at_open]
                first, second = hashes[before[which]], hashes[after[which]]
                columns = [
                    pa.array(bigram_key(first, second).view(np.int64), mask=hit[which]),
                    pa.array(first.view(np.int64), mask=~u_open[which]),
                    pa.array(second.view(np.int64), mask=~v_open[which]),
                    *(pa.array(x[which]) for x in (gain, uni, whole, rest)),
                ]
            else:
                at_open, columns = np.zeros(0, np.int64), [pa.array([], f.type) for f in open_type.value_type]
            p = p[back]
            ends_ = np.array(ends)
            starts = np.concatenate([[0], ends_[:-1]])
            logs = np.add.reduceat(np.log10(np.clip(p, 1e-300, 1.0)), starts)
            at = at[1:]
            hot = at >= 0
            exact = np.where(hot, m.hot_counts[at] if len(m.hot_counts) else 0, 0)
            base = np.add.reduceat(np.where(hot, np.log10(exact + 1.0) - unit, 0.0), starts)
            n_hot = np.add.reduceat(hot.astype(np.int64), starts)
            n = ends_ - starts
            offsets = np.searchsorted(np.searchsorted(ends_, at_open + 1), np.arange(len(n) + 1))
            open_ = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays(columns, [f.name for f in open_type.value_type]),
            ).cast(open_type)
            rest = np.flatnonzero(~hot)
            doc = np.searchsorted(ends_, rest + 1)
            h = hashes[ids[1:][rest]]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            at_new = np.flatnonzero(new)
            times = np.diff(np.append(at_new, len(h)))
            offsets = np.searchsorted(doc[at_new], np.arange(len(n) + 1))
            tail = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(h[at_new].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "n"]
                ),
            ).cast(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(n))),
                    batch.column(0),
                    pa.array(n.astype(np.int64)),
                    pa.array(n_hot),
                    pa.array(base),
                    pa.array(logs),
                    tail,
                    open_,
                ],
                ["_row", "doc_id", "n_tokens", "n_hot", "base", "score", "tail", "open"],
            )
            row += len(n)
            if len(words) > FLUSH_WORDS:
                words, hashes, places, figures = empty()

    schema = (
        f"_row bigint, doc_id {kind}, n_tokens bigint, n_hot bigint, base double, score double, "
        "tail array<struct<h:bigint,n:int>>, open array<struct<key:bigint,u:bigint,v:bigint,gain:double,"
        "uni:double,whole:double,rest:double>>"
    )
    scored = settle(docs.select(doc_id, text).mapInArrow(run, schema), "scored")
    tails = scored.select("_row", F.inline("tail")).join(counts, "h")
    tails = tails.groupBy("_row").agg(
        F.sum("n").alias("_known"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - float(unit))).alias("_sum"),
    )
    # two numbers a text: staged one after the other, so the shuffles of their words are never there together
    tails = settle(tails, "tails")
    rest = scored.drop("tail", "open").join(tails, "_row", "left")
    total = F.col("score")
    if model.below is not None:
        rest = rest.join(settle(settled(scored, model), "open"), "_row", "left")
        total = total + F.coalesce("_open", F.lit(0.0))
    known = F.col("n_hot") + F.coalesce("_known", F.lit(0))
    return rest.select(
        "doc_id",
        "n_tokens",
        known.alias("n_known"),
        (
            F.col("base") + F.coalesce("_sum", F.lit(0.0)) - (F.col("n_tokens") - known) * float(unit)
        ).alias("base_score"),
        total.alias("score"),
    )
