"""Token sequences for training: documents are tokenized, cut and packed by vector best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premisa.llm.common import per_worker, tokenizer_file
from premisa.sources.staging import settle

LENGTH = 2048
GROUP_ROWS = 16_384
CACHE_WORDS = 300_000
# Words of these characters need no normalization beyond lower case.
PLAIN = regex.compile(r"[!-~À-ɏ]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, word by word.

    Words between blanks and line ends are independent in this vocabulary. Each distinct word is
    encoded once and kept, up to ``CACHE_WORDS`` words; words outside ``PLAIN`` and those with a
    mark of a special token go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            seen = "".join([self.letters[b] for b in piece.encode()])
            found = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
            if len(self.parts) < CACHE_WORDS:
                self.parts[piece] = found
        return found

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            found = b"".join([self.part(p) for p in PIECES.findall(word.lower())])
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes()
        if len(self.words) < CACHE_WORDS:
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        get = self.words.get
        found = [get(w) for w in words]
        for i in [i for i, f in enumerate(found) if f is None]:
            again = get(words[i]) if words[i] else b""
            found[i] = self.word(words[i]) if again is None else again
        return b"".join(found)


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its words last over tasks."""
    return per_worker("encoder", path, lambda: Encoder(path))


def cut(
    docs: DataFrame, doc_id: str, text: str, path: str, length: int, end: int = 0
) -> DataFrame:
    """Tokenized documents, ``end`` after each, in pieces of ``length`` ids, the last shorter.

    ``_row`` numbers the pieces, apart even where rows are repeated.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_row"]
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, piece, start, size, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = own.encode(t or "") + closing
                for k in range(0, len(ids), 4 * length):
                    part = ids[k : k + 4 * length]
                    at.append(i)
                    piece.append(k // (4 * length))
                    start.append(k // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(range(row, row + len(at)), pa.int64()),
                ],
                names,
            )
            row += len(at)

    return docs.select(doc_id, text).mapInArrow(
        run,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _row bigint",
    )


def best_fit(
    sizes: np.ndarray, length: int, max_docs: int, max_cost: float, weights: tuple = (1.0, 0.05, 0.05)
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item, largest first.

    A bin has three capacities: tokens, documents and attention cost (the sum of squared sizes). An
    item goes to the open bin that has room in all three and would have the smallest weighted norm
    of what remains, in shares of the capacities; without one it opens a bin. Bins without room for
    the smallest item are closed.
    """
    n = len(sizes)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 0:
        return bins, places
    capacity = np.array([length, max_docs, max_cost], float)
    scale = np.array(weights) / capacity**2
    order = np.argsort(-sizes, kind="stable")
    least = int(sizes.min())
    rest = np.zeros((1024, 3))  # what open bins have left; doubled when full
    number = np.zeros(1024, np.int64)
    open_, made = 0, 0
    for k in order:
        need = np.array([sizes[k], 1.0, float(sizes[k]) ** 2])
        chosen = -1
        if open_:
            left = rest[:open_] - need
            score = (left * left) @ scale
            score[(left < 0).any(axis=1)] = np.inf
            chosen = int(score.argmin())
            if score[chosen] == np.inf:
                chosen = -1
        if chosen < 0:
            if open_ == len(rest):
                rest = np.concatenate([rest, np.zeros_like(rest)])
                number = np.concatenate([number, np.zeros_like(number)])
            rest[open_], number[open_] = capacity, made
            chosen, open_, made = open_, open_ + 1, made + 1
        bins[k] = number[chosen]
        places[k] = length - int(rest[chosen, 0])
        rest[chosen] -= need
        x = rest[chosen]
        if x[0] < least or x[1] < 1 or x[2] < float(least) ** 2:
            open_ -= 1
            rest[chosen], number[chosen] = rest[open_], number[open_]
    return bins, places


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    length: int = LENGTH,
    max_docs: int = LENGTH,
    max_cost: float | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Sequences of ``length`` tokens at most, filled with whole documents.

    Returns one row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and its
    place, ``sequence_id`` and ``offset``. Only documents longer than a sequence are cut. Besides
    tokens a sequence may hold ``max_docs`` pieces and an attention cost of ``max_cost`` (the sum of
    squared lengths, by default that of one full piece).

    Full pieces are sequences by themselves. The others are dealt at random into groups of about
    ``group_rows`` rows, each packed in a task of its own: a group leaves a few unfilled sequences,
    so larger groups pack closer. A NULL or empty text is its end mark alone; a NULL id stays NULL,
    and repeated rows are packed each. Other columns are not carried.
    """
    path = vocabulary or tokenizer_file("word_bpe_49k.json")
    cost = float(length) ** 2 if max_cost is None else float(max_cost)
    pieces = settle(cut(docs, doc_id, text, path, length), "pieces")
    full = F.col("length") == length
    rows = pieces.where(~full).count()
    groups = max(1, -(-rows // group_rows))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row")
        bins, places = best_fit(part["length"].to_numpy(), length, max_docs, cost)
        out = part[columns].copy()
        # numbers of groups lie above those of rows
        out["sequence_id"] = (-1 - (int(part["_group"].iloc[0]) << 32)) - bins
        out["offset"] = places
        return out

    schema = (
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint"
    )
    group = F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group")
    packed = pieces.where(~full).select("*", group).groupBy("_group").applyInPandas(fill, schema)
    alone = pieces.where(full).select(
        *columns, F.col("_row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return packed.union(alone)
