"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premisa.llm.common import opened, ship, with_result

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = ".,;:!?\"'()[]{}|<>*_-–—…«»¿¡"
BUCKETS = 1 << 18
CACHE_WORDS = 200_000


def features(word: str, buckets: int) -> tuple[int, ...]:
    """Hash numbers of a word and of its first four and five letters."""
    w = word.strip(EDGES)
    if not w:
        return ()
    found = {zlib.crc32(f"w {w}".encode("utf-8", "surrogatepass")) % buckets}
    for k in (4, 5):
        if len(w) > k:
            head = f"{k} {w[:k]}".encode("utf-8", "surrogatepass")
            found.add(zlib.crc32(head) % buckets)
    return tuple(sorted(found))


@dataclass
class Model:
    """Weights of the hashed features and the offset of a sentence's log-odds."""

    weights: np.ndarray
    offset: float


class Weight(dict):
    """The summed weight of a word's features, worked out once and kept within a bound."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = features(word, len(self.weights))
        value = float(sum(self.weights[i] for i in found))
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def sentence_odds(text: str, weight: Weight, offset: float) -> list[tuple[int, int, float]]:
    """Start, end and log-odds of each sentence."""
    get = weight.__getitem__
    return [
        (m.start(), m.end(), offset + sum(map(get, set(m.group().lower().split()))))
        for m in SENTENCE.finditer(text)
    ]


def noisy_or(odds: list[float]) -> float:
    """One minus the chance that no sentence is toxic; zero for none."""
    total = sum(
        math.exp(z) if z < -30 else (z if z > 30 else math.log1p(math.exp(z))) for z in odds
    )
    return -math.expm1(-total) if odds else 0.0


def fit(
    sentences: list[list[np.ndarray]],
    toxic: np.ndarray,
    share: float,
    buckets: int = BUCKETS,
    rounds: int = 150,
    rate: float = 0.15,
    penalty: float = 3e-3,
) -> Model:
    """Maximum likelihood of document labels under the noisy-or of their sentences.

    ``sentences``: per document the feature numbers of each sentence. ``share`` is the share of toxic
    documents among all labelled ones; the sample is weighted to it. Adam on the whole sample, with
    a squared penalty. Features met in one document only get no weight. Without both classes every
    sentence gets the same tiny chance.
    """
    counts = np.array([len(d) for d in sentences], np.int64)
    n = len(sentences)
    weights = np.zeros(buckets)
    prior = min(max(share, 1e-4), 0.5)
    mean = max(1.0, counts.mean()) if n else 1.0
    offset = math.log(math.expm1(-math.log1p(-prior) / mean))
    if n == 0 or not 0 < toxic.sum() < n:
        return Model(weights, offset if n == 0 or toxic.sum() else -30.0)
    flat = [s for d in sentences for s in d]
    sizes = np.array([len(s) for s in flat], np.int64)
    used = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    doc_of = np.repeat(np.arange(n), counts)
    sentence_of = np.repeat(np.arange(len(flat)), sizes)
    in_docs = np.bincount(np.unique(doc_of[sentence_of] * buckets + used) % buckets, minlength=buckets)
    keep = in_docs[used] > 1
    number = np.cumsum(in_docs > 1) - 1
    column, sentence_of = number[used[keep]].astype(np.int32), sentence_of[keep].astype(np.int32)
    width = int((in_docs > 1).sum())
    theta, b = np.zeros(width), offset
    m1, m2, b1, b2 = np.zeros(width), np.zeros(width), 0.0, 0.0
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean())) / n
    for step in range(1, rounds + 1):
        z = b + np.bincount(sentence_of, theta[column], len(flat))
        total = np.bincount(doc_of, np.logaddexp(0, z), n)
        push = np.where(toxic, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) * weight
        slope = push[doc_of] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.bincount(column, slope[sentence_of], width) + penalty * theta / n**0.5
        gb = slope.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb**2
        scale = rate * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        theta -= scale * m1 / (np.sqrt(m2) + 1e-10)
        b -= scale * b1 / (math.sqrt(b2) + 1e-10)
    weights[in_docs > 1] = theta
    return Model(weights, float(b))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_class: int = 3000,
    buckets: int = BUCKETS,
) -> Model:
    """Fit the model on a sample of labelled documents, ``per_class`` of each label at most.

    The sample is the rows first in the order of a hash of their id, so it does not depend on the
    layout. ``held_out`` is a condition on the labels table; its rows are never learnt from. Several
    labels of one id count as their largest; rows without id or label are skipped.
    """
    known = labels.where(~F.coalesce(held_out, F.lit(True)))
    known = known.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    totals = dict(known.groupBy(F.col("_y") > 0).count().collect())
    parts = [
        known.where((F.col("_y") > 0) == side).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        for side in (True, False)
    ]
    sample = parts[0].union(parts[1])
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(sample), "_id")  # 2 * per_class narrow rows at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [], []
            for t in batch.column("_text").to_pylist():
                own = [
                    sorted({i for w in m.group().lower().split() for i in features(w, buckets)})
                    for m in SENTENCE.finditer(t or "")
                ]
                ids.append([i for s in own for i in s])
                sizes.append([len(s) for s in own])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([y > 0 for y in batch.column("_y").to_pylist()], pa.bool_()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(sizes, pa.list_(pa.int32())),
                ],
                ["y", "ids", "sizes"],
            )

    got = rows.mapInArrow(encode, "y boolean, ids array<int>, sizes array<int>").toArrow()
    sentences = [
        np.split(np.asarray(i, np.int32), np.cumsum(s)[:-1]) if len(s) else []
        for i, s in zip(
            (x.values.to_numpy() for x in got.column("ids")),
            (x.values.to_numpy() for x in got.column("sizes")),
            strict=True,
        )
    ]
    toxic = np.array(got.column("y").to_pylist(), bool)
    share = totals.get(True, 0) / max(1, sum(totals.values()))
    return fit(sentences, toxic, share, buckets)


def score(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    offending: float = 0.5,
    into: str = "toxicity",
) -> DataFrame:
    """Add the struct ``into``: ``score`` of the whole text and its ``sentences``, as character spans
    with their chance, that reach ``offending``.

    The model has a fixed size, so it is sent to the tasks. A NULL or empty text has no sentence and
    scores 0. Repeated rows are scored each; a column named like ``into`` is replaced.
    """
    sent = ship(docs.sparkSession, model)
    span = [("start", T.IntegerType()), ("end", T.IntegerType()), ("p", T.DoubleType())]
    sentence = T.StructType([T.StructField(*f) for f in span])
    kind = T.StructType(
        [
            T.StructField("score", T.DoubleType()),
            T.StructField("sentences", T.ArrayType(sentence)),
        ]
    )
    spans = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        own = opened(sent)
        weight = Weight(own.weights)
        bound = math.log(offending / (1 - offending))
        for batch in batches:
            scores, found = [], []
            for t in batch.column(text).to_pylist():
                odds = sentence_odds(t or "", weight, own.offset)
                scores.append(noisy_or([z for _, _, z in odds]))
                found.append(
                    [
                        {"start": a, "end": b, "p": 1 / (1 + math.exp(-min(z, 500)))}
                        for a, b, z in odds
                        if z >= bound
                    ]
                )
            result = pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(found, spans)], ["score", "sentences"]
            )
            yield batch, result

    return with_result(docs, into, kind, judge)
