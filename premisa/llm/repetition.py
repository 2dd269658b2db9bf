"""Quality rules with a suffix-array verdict on repetition inside a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from premisa.llm.common import with_result

BATCH_WORDS = 400_000


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each place the number of smaller keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    rank = np.empty(len(keys), np.int64)
    rank[order] = first
    return order, rank


def suffix_array(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of many texts laid end to end, and the ranks by 1, 2, 4, ... first words.

    ``words`` are numbers, ``ends`` has for each place the end of its text. A suffix ends with its
    text, and the text comes first in its key, so suffixes of different texts never share a prefix.
    Prefix doubling, with only the suffixes that still share a rank sorted again.
    """
    n = len(words)
    _, number = dense(words)
    order, rank = dense(ends * np.int64(n + 1) + number)
    levels, h = [rank.astype(np.int32)], 1
    places = np.arange(n)
    while True:
        tied = np.zeros(n, bool)
        in_order = rank[order]
        same = in_order[1:] == in_order[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = places[tied]
        if not len(where):
            return order, levels
        suffix = order[where]
        ahead = suffix + h
        inside = ahead < ends[suffix]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        part, position = dense(rank[suffix] * np.int64(n + 2) + second)
        order[where] = suffix[part]
        # the group's start among all suffixes: its start among the tied ones, at its place
        rank = rank.copy()
        rank[suffix] = where[position]
        levels.append(rank.astype(np.int32))
        h *= 2


def repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the longest run of words from there that occurs in its text again.

    Neighbours of the suffix array have the longest common prefixes; these are read off the ranks
    of the doubling, from the longest step down. A place's maximum over both neighbours bounds the
    intervals of common prefixes it belongs to.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order, levels = suffix_array(words, ends)
    a, b = order[:-1].copy(), order[1:].copy()
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    pa_, pb = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        ok = (pa_ < ends[a]) & (pb < ends[b])
        ok &= rank[np.minimum(pa_, n - 1)] == rank[np.minimum(pb, n - 1)]
        pa_ += ok * (1 << k)
        pb += ok * (1 << k)
    length = pa_ - a
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a run of ``least`` or more words that occurs again."""
    places = np.arange(len(best))
    return np.maximum.accumulate(np.where(best >= least, places + best, 0)) > places


SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("covered_words", T.LongType()),
        T.StructField("longest_repeat", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.strip(SPACES):
            seen.add(line)
    return repeated


def measure(
    texts: list[str], min_repeat: int, max_covered: float, max_repeat: int, min_words: int
) -> dict[str, list]:
    """The verdict's fields for some texts; the suffix arrays of all are built together."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    stops = np.cumsum(sizes)
    numbers: dict[bytes, int] = {}
    flat = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for words in split for w in words),
        np.int64,
        int(sizes.sum()),
    )
    best = repeats(flat, np.repeat(stops, sizes))
    zero = np.zeros(1, np.int64)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([zero, np.cumsum(flags)])
        return total[stops] - total[stops - sizes]

    windows, spans = per_text(covered(best, 3)), per_text(covered(best, min_repeat))
    longest = [int(best[e - s : e].max()) if s else 0 for s, e in zip(sizes, stops, strict=True)]
    failed = (sizes < min_words) | (100 * windows > 50 * sizes)
    kept = ~failed & (spans <= max_covered * sizes) & (np.array(longest, np.int64) <= max_repeat)
    return {
        "n_words": sizes.tolist(),
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [duplicate_lines(t) for t in texts],
        "n_repeat_words": windows.tolist(),
        "covered_words": spans.tolist(),
        "longest_repeat": longest,
        "base_failed": failed.tolist(),
        "kept": kept.tolist(),
    }


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_repeat: int = 10,
    max_covered: float = 0.4,
    max_repeat: int = 100,
    min_words: int = 50,
    into: str = "quality_rules",
) -> DataFrame:
    """Add the struct ``into`` of counts and the verdict ``kept`` to every row.

    Words are split at ASCII white space. Base rules: at least ``min_words`` words, and at most half
    of them in three-word windows that the text repeats. Beyond these, runs of ``min_repeat`` or more
    words that occur again in the text (maximal repeats, found by suffix array and common prefixes)
    may cover up to ``max_covered`` of the words, and none may be longer than ``max_repeat`` words.

    A NULL or empty text has no words and fails the base rules. A repeated row is judged each time.
    A column named like ``into`` is replaced; all others pass through. One text is worked on in one
    task, in memory that grows with its length; texts are grouped to at most ``BATCH_WORDS`` words.
    """

    def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) // 6
            if size > BATCH_WORDS:
                yield start, i + 1
                start, size = i + 1, 0
        if start < len(texts):
            yield start, len(texts)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for start, end in groups(texts):
                got = measure(texts[start:end], min_repeat, max_covered, max_repeat, min_words)
                fields = [pa.array(got[f.name]) for f in VERDICT.fields]
                verdict = pa.StructArray.from_arrays(fields, [f.name for f in VERDICT.fields])
                yield batch.slice(start, end - start), verdict

    return with_result(docs, into, VERDICT, judge)
