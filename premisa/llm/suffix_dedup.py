"""Exact removal of long byte strings that occur more than once in a corpus.

Windows of ``span`` bytes that are equal share their smallest gram, so windows are dealt out by the hash of
that gram: neighbouring windows with one gram travel as one stretch of text. Stretches whose gram occurs once
are out; equal stretches are counted; the different stretches of a gram meet in a bucket, whose suffix array
(see ``lyndon_groups``) shows which windows occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premisa.llm.common import fresh, quoted, with_result
from premisa.llm.lyndon_groups import suffix_array
from premisa.llm.shingles import STEP, mixed
from premisa.sources.staging import settle

SPAN = 200
GRAM = 64
CHUNK = 1 << 16  # windows looked at together: their hashes stay in a processor's cache
PLACE = np.uint64((1 << 17) - 1)  # bits of a place within a chunk
FILTER_WORDS = 1 << 21  # 64-bit words of the filter of repeated grams, 16 MB at any input size
BUCKET = 1 << 18  # bytes of the stretches of a group
SORTED = 1 << 14  # bytes of a group that are sorted together, if no key has more; the lists stay in the cache
LIMIT = 4096  # different stretches of one key that are sorted together
STRETCH = "key bigint, d bigint, w bigint, t binary, first int, last int, gram int, low int, high int, s binary"
FIELDS = [field.split()[0] for field in STRETCH.split(", ")]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's begin and end; NULL has none."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    known = ~column.is_null().to_numpy(zero_copy_only=False)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts = at[:-1] - at[0]
    return whole[at[0] : at[-1]], starts, np.where(known, at[1:] - at[0], starts)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    table = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Stretches:
    """Finds the stretches of neighbouring windows with one smallest gram."""

    def __init__(self, span: int, gram: int) -> None:
        self.span, self.gram = span, gram
        self.code = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            back = np.uint64(pow(int(STEP), -1, 1 << 64))
            for name, base in (("power", STEP), ("inverse", back)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the gram from each place on."""
        n, k = len(data), self.gram
        self._grow(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[data] * self.power[:n], out=total[1:])
        return mixed((total[k:] - total[:-k]) * self.inverse[: n - k + 1])

    def find(self, data: np.ndarray, sound: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gram's hash and place, first and last window of each stretch; only ``sound`` windows count."""
        out: list[tuple[np.ndarray, ...]] = []
        windows = len(data) - self.span + 1
        for base in range(0, windows, CHUNK):
            ok = sound[base : min(base + CHUNK, windows)]
            if not ok.any():
                continue
            part = data[base : base + CHUNK + self.span - 1]
            h = self.hashes(part)
            order = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
            at = (sliding_least(order, self.span - self.gram + 1) & PLACE).astype(np.int64)
            change = np.ones(len(at) + 1, bool)
            change[1:-1] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
            edge = np.flatnonzero(change)
            first, last = edge[:-1], edge[1:] - 1
            first, last = first[ok[first]], last[ok[first]]
            at = at[first]
            out.append((h[at].view(np.int64), at + base, first + base, last + base))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def of_rows(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """All stretches of the texts of a column: the bytes, and hash, place, first, last, row of each."""
        data, starts, ends = texts_of(column)
        sound = np.zeros(len(data) + 1, np.int64)
        long = ends - starts >= self.span
        np.add.at(sound, starts[long], 1)
        np.add.at(sound, ends[long] - self.span + 1, -1)
        h, at, first, last = self.find(data, np.cumsum(sound)[:-1] > 0)
        return data, starts, h, at, first, last, np.searchsorted(starts, first, "right") - 1

    def digests(self, data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Digest of each stretch's bytes and of its gram's place in them."""
        view = memoryview(data)
        ends = last + self.span
        found = [
            xxhash.xxh3_64_intdigest(view[a:b], g)
            for a, b, g in zip(first.tolist(), ends.tolist(), (at - first).tolist(), strict=True)
        ]
        return np.array(found, np.uint64).view(np.int64)


def gram_counts(docs: DataFrame, text: str, span: int, gram: int) -> DataFrame:
    """Per batch and gram: how many stretches it has, and the smallest and largest of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Stretches(span, gram)
        for batch in batches:
            data, _, h, at, first, last, _ = finder.of_rows(batch.column(0))
            if not len(h):
                continue
            d = finder.digests(data, at, first, last)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            columns = [
                h[new],
                np.diff(np.append(new, len(h))),
                np.minimum.reduceat(d, new),
                np.maximum.reduceat(d, new),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "n", "least", "most"])

    return docs.select(quoted(text)).mapInArrow(run, "h bigint, n bigint, least bigint, most bigint")


def gram_filter(keys: DataFrame) -> np.ndarray:
    """A bit for each repeated gram's hash. Its size is fixed: with more grams more bits are set, and more
    stretches pass that the join with the grams then takes out."""
    word = F.expr(f"cast(shiftright(h, 6) & {FILTER_WORDS - 1} as int)").alias("word")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")
    found = keys.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def passing(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (words[(h >> 6) & (len(words) - 1)] >> (h & 63)) & 1 == 1


def text_id(data: np.ndarray, start: int, end: int) -> bytes:
    return xxhash.xxh3_128_digest(memoryview(data)[start:end])


def stretch_rows(docs: DataFrame, text: str, span: int, gram: int, words: object) -> DataFrame:
    """The stretches whose gram passes the filter: gram's hash, digest, text's digest and places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Stretches(span, gram)
        bits = words.value
        for batch in batches:
            data, starts, h, at, first, last, row = finder.of_rows(batch.column(0))
            some = passing(h, bits)
            h, at, first, last, row = (c[some] for c in (h, at, first, last, row))
            if not len(h):
                continue
            _, _, ends = texts_of(batch.column(0))
            own, which = np.unique(row, return_inverse=True)
            ids = [text_id(data, starts[r], ends[r]) for r in own.tolist()]
            shift = starts[row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h),
                    pa.array(finder.digests(data, at, first, last)),
                    pa.array(ids, pa.binary()).take(pa.array(which)),
                    *(pa.array((c - shift).astype(np.int32)) for c in (first, last, at)),
                ],
                ["h", "d", "t", "first", "last", "gram"],
            )

    kind = "h bigint, d bigint, t binary, first int, last int, gram int"
    return docs.select(quoted(text)).mapInArrow(run, kind)


def with_text_id(docs: DataFrame, text: str, into: str) -> DataFrame:
    place = [f.name for f in docs.schema.fields if f.name.lower() != into.lower()].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in batches:
            data, starts, ends = texts_of(batch.column(place))
            ids = [text_id(data, a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield batch, pa.array(ids, pa.binary())

    return with_result(docs, into, T.BinaryType(), run)


def stretch_texts(docs: DataFrame, text: str, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """The wanted stretches with their bytes; a task takes a text's copies once."""
    fields = ["h", "d", "w", "first", "last", "gram"]
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct(*fields)).alias("x"))
    lists = settle(lists.select("t", *(F.col(f"x.{f}").alias(f) for f in fields)), "wanted")
    named = with_text_id(docs.select(quoted(text).alias("text")), "text", "t")
    rows = named.join(lists, "t").select("t", "text", *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            data, starts, _ = texts_of(batch.column(1))
            new = []
            for i, t in enumerate(batch.column(0).to_pylist()):
                if t not in met:
                    met.add(t)
                    new.append(i)
            if len(met) > 1_000_000:
                met.clear()
            lists = [batch.column(i).take(pa.array(new, pa.int64())) for i in range(2, 8)]
            row = np.repeat(np.array(new, np.int64), lists[0].value_lengths().to_numpy())
            h, d, w, first, last, at = (c.flatten() for c in lists)
            shift, view, n = starts[row], memoryview(data), len(row)
            begins, ends = first.to_numpy() + shift, last.to_numpy() + shift + span
            pieces = [bytes(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            whole = [pa.array(np.full(n, c, np.int32)) for c in (0, span - gram)]
            owner = batch.column(0).take(pa.array(row))
            columns = [h, d, w, owner, first, last, at, *whole, pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, FIELDS)

    return one_each(rows.mapInArrow(run, STRETCH))


def one_each(stretches: DataFrame) -> DataFrame:
    """One row for each different stretch of a key."""
    rest = [c for c in FIELDS if c not in ("key", "d", "w")]
    found = stretches.groupBy("key", "d").agg(
        F.max("w").alias("w"), F.min(F.struct(*rest)).alias("x")
    )
    return found.select("key", "d", "w", *(f"x.{c}" for c in rest))


def halves(stretches: DataFrame, span: int) -> DataFrame:
    """Each stretch cut in two by its gram's place in the windows, with a key for each half.

    The windows of a half have more bytes in common than the gram; their hash is the half's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                middle = (row["low"] + row["high"]) // 2
                first, last, gram, s = row["first"], row["last"], row["gram"], row["s"]
                for low, high in ((row["low"], middle), (middle + 1, row["high"])):
                    a, b = max(first, gram - high), min(last, gram - low)
                    if low <= high and a <= b:
                        common = s[gram - low - first : gram - high + span - first]
                        piece = s[a - first : b + span - first]
                        key = xxhash.xxh3_64_intdigest(common, low * span + high)
                        d = xxhash.xxh3_64_intdigest(piece, gram - a)
                        key, d = (x - (1 << 64) if x >> 63 else x for x in (key, d))
                        new = {"key": key, "d": d, "first": a, "last": b, "low": low, "high": high}
                        out.append(row | new | {"s": piece})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return stretches.mapInArrow(run, STRETCH)


def crowded_apart(stretches: DataFrame, span: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Stretches of which a key has ``most`` at the most, and the windows found to repeat on the way.

    A key with more is cut in halves until that holds: after a few rounds its windows are equal. Equal halves are
    counted, their places are repeats, and one of them goes on.
    """
    ready, found = [], []
    while True:
        sizes = stretches.groupBy("key").agg(F.count("*").alias("k"), F.min("w").alias("least"))
        # a key with one stretch, or with known repeats only, has nothing to show
        sizes = settle(sizes.where("k > 1 and least = 1").select("key", "k"), "sizes")
        open_ = stretches.join(sizes, "key")
        ready.append(open_.where(F.col("k") <= most).select(*FIELDS))
        crowd = sizes.where(F.col("k") > most)
        if crowd.isEmpty():
            break
        parts = settle(halves(open_.where(F.col("k") > most).select(*FIELDS), span), "halves")
        equal = parts.groupBy("key", "d").agg(F.sum("w").alias("sum"), F.count("*").alias("k"))
        equal = settle(equal.where("k > 1").select("key", "d", "sum"), "equal")
        again = parts.join(equal, ["key", "d"], "left")
        found.append(again.where("sum is not null and w = 1").select("t", "first", "last"))
        again = again.withColumn("w", F.coalesce("sum", "w")).select(*FIELDS)
        stretches = settle(one_each(again), "stretches")
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.union(more)
    return settle(whole, "stretches"), found


def repeated_starts(pieces: list[bytes], span: int) -> np.ndarray:
    """Marks each place of the joined pieces (a byte between them) at which a string of ``span`` bytes starts
    that starts at another place of some piece too."""
    joined = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    n = len(joined)
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes)
    symbols = np.empty(n + 1, np.int64)
    symbols[:n] = joined
    symbols[:n] += 2
    symbols[ends - 1] = 1
    symbols[n] = 0
    sound = np.zeros(n + 1, bool)
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        sound[end - size : max(end - span, end - size)] = True
    order = suffix_array(symbols)
    order = order[sound[order]]
    marks = np.zeros(n, bool)
    # neighbours in the array that agree in all bytes, eight at a time
    padded = np.append(joined, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    same = np.arange(len(order) - 1)
    for step in [*range(0, span - 7, 8), max(span - 8, 0)]:
        same = same[words[order[same] + step] == words[order[same + 1] + step]]
    marks[order[same]] = marks[order[same + 1]] = True
    return marks


def key_blocks(keys: np.ndarray, sizes: list[int], most: int) -> Iterator[range]:
    """Neighbouring rows of ``most`` bytes, or of one key; equal keys lie together."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and keys[i] != keys[i - 1] and total + size > most:
            yield range(start, i)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield range(start, len(sizes))


def sorted_buckets(stretches: DataFrame, span: int, bucket: int) -> DataFrame:
    """Runs of windows of lone stretches that occur in another stretch of the bucket: ``t``, ``first``, ``last``."""
    size = stretches.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]
    deal = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // bucket)))).alias("bucket")
    none = np.zeros(0, np.int64)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        pieces = group.column("s").to_pylist()
        key, lone = group.column("key").to_numpy(), group.column("w").to_numpy() == 1
        begin = group.column("first").to_numpy()
        row, first, last = [], [], []
        for some in key_blocks(key, [len(p) for p in pieces], SORTED):
            marks = repeated_starts([pieces[i] for i in some], span)
            at = 0
            for i in some:
                own = np.flatnonzero(marks[at : at + len(pieces[i])]) if lone[i] else none
                if len(own):
                    cut = np.flatnonzero(np.diff(own) > 1)
                    first.append(begin[i] + own[np.append(0, cut + 1)])
                    last.append(begin[i] + own[np.append(cut, len(own) - 1)])
                    row.append(np.full(len(cut) + 1, i))
                at += len(pieces[i]) + 1
        row, first, last = (np.concatenate(c) if c else none for c in (row, first, last))
        return pa.table(
            {
                "t": group.column("t").take(pa.array(row)),
                "first": first.astype(np.int32),
                "last": last.astype(np.int32),
            }
        )

    dealt = stretches.select(deal, "key", "w", "t", "first", "s")
    return dealt.groupBy("bucket").applyInArrow(run, "t binary, first int, last int")


def repeated_windows(
    docs: DataFrame, text: str, span: int, gram: int, bucket: int, most: int
) -> DataFrame:
    """Windows of ``span`` bytes that start elsewhere too: ``t``, a text's digest, ``first`` and ``last`` start."""
    spark = docs.sparkSession
    counts = gram_counts(docs, text, span, gram).groupBy("h").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    keys = counts.where("n > 1").select("h", (F.col("least") != F.col("most")).alias("several"))
    keys = settle(keys, "grams")
    words = spark.sparkContext.broadcast(gram_filter(keys))
    rows = settle(stretch_rows(docs, text, span, gram, words).join(keys, "h"), "stretches")
    place = ["t", "first", "last"]
    found = [rows.where("not several").select(*place)]

    several = rows.where("several")
    pairs = several.groupBy("h", "d").agg(
        F.count("*").alias("w"), F.min(F.struct(*place, "gram")).alias("x")
    )
    pairs = settle(pairs.select("h", "d", "w", "x.*"), "pairs")
    more = settle(pairs.where("w > 1").select("h", "d"), "equal")
    found.append(several.join(more, ["h", "d"]).select(*place))
    lone = settle(pairs.where("w = 1").select("h").distinct(), "lone")
    wanted = pairs.join(lone, "h")
    stretches = settle(stretch_texts(docs, text, wanted, span, gram), "stretches")
    ready, early = crowded_apart(stretches, span, most)
    found += [*early, sorted_buckets(ready, span, bucket)]
    whole = found[0]
    for part in found[1:]:
        whole = whole.union(part)
    return whole.distinct()


def repeated_bytes(
    docs: DataFrame,
    text: str = "text",
    into: str = "repeats",
    span: int = SPAN,
    gram: int = GRAM,
    bucket: int = BUCKET,
    most: int = LIMIT,
) -> DataFrame:
    """All rows and columns, and ``into``: ``n_bytes``, ``spans`` (``start`` and ``end``) and ``kept``, the other bytes.

    A text counts as its UTF-8 bytes. A byte is in a span if it lies in a string of ``span`` bytes that also
    starts at another place, in any row or in the same one, overlaps included. Spans do not touch. A NULL or
    empty text has no bytes, one shorter than ``span`` no spans. Rows with equal texts, repeated ids or a NULL
    id are rows of their own, so equal texts of ``span`` bytes or more are removed in whole.

    Windows are found by rolling hashes; a text is known by its 128-bit digest, equal stretches by two 64-bit
    ones. A gram met in many different stretches is cut apart (``crowded_apart``), so buckets stay bounded. All
    joins are equi-joins of tables that grow with the input; only the filter of a fixed size is broadcast.
    """
    own, one, two = (fresh(docs, name) for name in ("text_id", "firsts", "lasts"))
    windows = repeated_windows(docs, text, span, gram, bucket, most)
    lists = windows.groupBy("t").agg(F.collect_list(F.struct("first", "last")).alias("x"))
    lists = lists.select(F.col("t").alias(own), F.col("x.first").alias(one), F.col("x.last").alias(two))
    joined = with_text_id(docs, text, own).join(settle(lists, "ranges"), own, "left")
    rest = [f.name for f in joined.schema.fields if f.name.lower() != into.lower()]
    words, places = rest.index(text), (rest.index(one), rest.index(two))
    kind = T.StructType.fromDDL("n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for batch in batches:
            data, starts, ends = texts_of(batch.column(words))
            first, last = (batch.column(i).flatten().to_numpy() for i in places)
            size = batch.column(places[0]).value_lengths().fill_null(0).to_numpy()
            until = np.cumsum(size)
            kept, counts, start, end = [], [], [], []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                x, y = first[until[i] - size[i] : until[i]], last[until[i] - size[i] : until[i]]
                order = np.argsort(x)
                x, y = x[order], np.maximum.accumulate(y[order]) + span
                new = np.append(True, x[1:] > y[:-1]) if len(x) else np.zeros(0, bool)
                x, y = x[new], y[np.append(np.flatnonzero(new)[1:] - 1, len(y) - 1)] if len(x) else y
                start.append(x)
                end.append(y)
                counts.append(len(x))
                edges = np.append(0, np.column_stack([x, y]).ravel()).tolist() + [b - a]
                own = memoryview(data)[a:b]
                kept.append(b"".join(own[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True)))
            spans = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int32)) for c in (start, end)], ["start", "end"]
            )
            offsets = pa.array(np.cumsum([0, *counts]).astype(np.int32))
            columns = [
                pa.array(ends - starts),
                pa.ListArray.from_arrays(offsets, spans),
                pa.array(kept, pa.binary()),
            ]
            yield batch, pa.StructArray.from_arrays(columns, ["n_bytes", "spans", "kept"])

    return with_result(joined, into, kind, run).drop(own, one, two)
