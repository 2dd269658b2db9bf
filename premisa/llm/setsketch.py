"""Near-duplicate documents by SetSketch registers, banding, likelihood and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premisa.llm.common import BROADCAST_BYTES, components
from premisa.llm.shingles import WordHash, mixed, shingle_set
from premisa.sources.staging import settle

BANDS, ROWS = 36, 5
BASE = 1.02
TOP = 1200
SLACK = 0.12  # over three and a half standard errors of the estimate
BLOCK = 256


def seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the m hash functions."""
    x = mixed(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:m] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (
        x[m:] >> np.uint64(32)
    ).astype(np.uint32)


def smallest(items: np.ndarray, factor: np.ndarray, summand: np.ndarray) -> np.ndarray:
    """Per hash function the smallest value over the items; mergeable by minimum."""
    low = np.full(len(factor), np.iinfo(np.uint32).max, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(
            low, (short[i : i + 2048, None] * factor + summand).min(axis=0, initial=low.max()), out=low
        )
    return low


def registers(low: np.ndarray, base: float = BASE, top: int = TOP) -> np.ndarray:
    """SetSketch registers: the exponential variate behind each minimum, on an exponential scale.

    Register values are ``floor(1 - log_b x)`` cut off at 0 and ``top``. They fall as the minimum
    rises, so the maximum of two sketches is the sketch of the union.
    """
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(base)), 0, top).astype(np.uint16)


def estimate(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, base: float = BASE
) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes.

    The counts of registers that are larger, smaller and equal are jointly multinomial; the
    likelihood is searched on 101 values up to the largest similarity the sizes allow.
    """
    more = (a > b).sum(axis=1)[:, None]
    less = (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    p, q = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    fit = (
        more * np.log(np.maximum(p, tiny))
        + less * np.log(np.maximum(q, tiny))
        + same * np.log(np.maximum(1 - p - q, tiny))
    )
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], 1)[:, 0]


def set_key(items: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        first = mixed(items).sum(dtype=np.uint64)
        second = mixed(items * np.uint64(3) + np.uint64(len(items))).sum(dtype=np.uint64)
    return int(first).to_bytes(8, "little") + int(second).to_bytes(8, "little")


def sketches(docs: DataFrame, doc_id: str, text: str, words: int, m: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        factor, summand = seeds(m)
        for batch in batches:
            sizes, keys, lows = [], [], []
            for t in batch.column(1).to_pylist():
                items = shingle_set(t, words, known)
                sizes.append(len(items))
                keys.append(set_key(items) if len(items) else None)
                lows.append(smallest(items, factor, summand) if len(items) else None)
            regs = [None if x is None else registers(x).tobytes() for x in lows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(regs, pa.binary()),
                ],
                ["_id", "n", "key", "regs"],
            )

    return docs.select(doc_id, text).mapInArrow(
        run, f"_id {kind}, n bigint, key binary, regs binary"
    )


def band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per class and band: a hash of the band's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            joined = b"".join(batch.column(1).to_pylist())
            r = np.frombuffer(joined, np.uint16).reshape(n, bands, rows).astype(np.uint64)
            total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
            for i in range(rows):
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + r[:, :, i])
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(n), bands)))
            number = np.tile(np.arange(bands, dtype=np.int16), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(total.ravel().view(np.int64)), pa.array(number), keys],
                ["band", "number", "key"],
            )

    return classes.select("key", "regs").mapInArrow(
        run, "band bigint, number smallint, key binary"
    )


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sizes and registers do not rule the similarity out."""
    a = classes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = classes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    near = F.least("na", "nb") >= least * F.greatest("na", "nb")
    both = pairs.join(a, "a").join(b, "b").where(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            got = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1)
                for c in ("ra", "rb")
            ]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")]
            keep = estimate(*got, *sizes) >= least - SLACK
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a binary, b binary, na bigint, nb bigint")


def shingle_sets(
    docs: DataFrame, needed: DataFrame, text: str, words: int, limit: int
) -> DataFrame:
    """The whole sets of the classes in ``needed``, read from the texts once more."""
    some = needed.count()
    sent = None
    if 64 * some <= limit:
        keys = {bytes(r[0]) for r in needed.toLocalIterator()}
        sent = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            keys, sets = [], []
            for t in batch.column(0).to_pylist():
                items = shingle_set(t, words, known)
                key = set_key(items) if len(items) else None
                if key is not None and (sent is None or key in sent.value):
                    keys.append(key)
                    sets.append(items.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                ["key", "items"],
            )

    sets = docs.select(text).mapInArrow(run, "key binary, items array<bigint>")
    if sent is None:
        sets = sets.join(needed, "key", "left_semi")
    return settle(sets.groupBy("key").agg(F.first("items").alias("items")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("ia")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("items").alias("ib")), "b")
    size = F.size("ia") + F.size("ib")
    shared = both.select("a", "b", size.alias("n"), F.size(F.array_intersect("ia", "ib")).alias("i"))
    return shared.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def across(
    members: DataFrame, found: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, rows: int
) -> DataFrame:
    """Likely links between classes that share a bucket but are in different components.

    In every bucket that holds several components, all classes outside its largest component are
    compared with all of the bucket. Both sides are dealt into blocks of about ``BLOCK`` classes, and a
    task compares one block with another: their sizes, the first band they share (so that each pair
    is compared in one bucket only), their registers by likelihood, and at last their sets as 32-bit
    hashes. Pairs that the block has connected already are skipped. Only links leave the task.
    """
    at = found.select(F.col("id").alias("key"), "component")
    now = members.select("band", "number", "key").join(at, "key", "left")
    now = now.select("band", "number", "key", F.coalesce("component", "key").alias("c"))
    parts = now.groupBy("band", "c").agg(F.count("*").alias("k"))
    open_ = parts.groupBy("band").agg(
        F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("c", F.struct("k", "c")).alias("top")
    )
    open_ = open_.where("n > most").select(
        "band",
        "top",
        F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("nx"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("ny"),
    )
    left = settle(now.join(open_, "band"), "open-members")
    if left.isEmpty():
        return left.select(F.col("key").alias("a"), F.col("key").alias("b"))
    keys = left.select("key").distinct()
    short = F.transform("items", lambda x: F.shiftright(x, 32).cast("int")).alias("items")
    payload = classes.join(keys, "key", "left_semi").select("key", "n", "regs")
    payload = settle(payload.join(sets.select("key", short), "key"), "payload")
    place = F.xxhash64("key", F.lit(5))
    columns = ["band", "number", "key", "c", F.col("c") != F.col("top")]
    x = left.where("c <> top").select(
        *columns,
        F.lit(True).alias("asks"),
        F.pmod(place, "nx").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"),
    )
    y = left.select(
        *columns,
        F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"),
        F.pmod(place, "ny").cast("int").alias("j"),
    )
    dealt = x.union(y).toDF("band", "number", "key", "c", "outside", "asks", "i", "j")
    dealt = dealt.join(payload, "key")

    def compare(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        ours, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        keys, comp = block.column("key").to_pylist(), block.column("c").to_pylist()
        group = np.unique(np.array(comp), return_inverse=True)[1]
        rank = np.unique(np.array(keys), return_inverse=True)[1]
        outside = block.column("outside").to_numpy(zero_copy_only=False)
        size = block.column("n").to_numpy().astype(float)
        regs = np.frombuffer(b"".join(block.column("regs").to_pylist()), np.uint16)
        regs = regs.reshape(len(keys), -1)
        number = block.column("number")[0].as_py()
        items = block.column("items")
        sets = {}
        at: dict[bytes, bytes] = {}

        def root(c: bytes) -> bytes:
            while c in at:
                c = at[c]
            return c

        links = []
        for p in ours:
            once = ~outside[theirs] | (rank[theirs] > rank[p])
            q = theirs[once & (group[theirs] != group[p])]
            low, high = np.minimum(size[q], size[p]), np.maximum(size[q], size[p])
            q = q[100 * low >= percent * high]
            same = (regs[q] == regs[p]).reshape(len(q), regs.shape[1] // rows, rows).all(axis=2)
            q = q[same.argmax(axis=1) == number]
            if not len(q):
                continue
            a = np.broadcast_to(regs[p], (len(q), regs.shape[1]))
            likely_ = estimate(a, regs[q], np.full(len(q), size[p]), size[q])
            for t in q[likely_ >= percent / 100 - SLACK]:
                one, other = root(comp[p]), root(comp[t])
                if one == other:
                    continue
                for k in (p, t):
                    if k not in sets:
                        sets[k] = np.asarray(items[int(k)].values)
                shared = len(np.intersect1d(sets[p], sets[t]))
                total = size[p] + size[t]
                # hashes may collide by chance: the full ones decide, and only sure links connect
                if 100 * (shared + 1) >= percent * (total - shared - 1):
                    links.append((min(keys[p], keys[t]), max(keys[p], keys[t])))
                if 100 * (shared - 2) >= percent * (total - shared + 2):
                    at[one] = other
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("band", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Components of documents whose sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` % or more: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id) and
    ``kept`` (the document has that id), one row per input row.

    Equal sets form one class, and only classes are compared. Each has ``bands * rows`` SetSketch
    registers; classes that agree in a whole band are candidates. A bucket's classes are first compared
    with its first one, and links joined to components. Then, in buckets that hold several components,
    those outside the largest are compared with all, block by block (see ``across``). So every candidate
    pair is compared or connected already. Before shingle sets are compared, sizes and the joint
    likelihood of both sketches must allow the similarity. A pair at the threshold shares a band with a chance of
    1 - (1 - 0.75^5)^36, all but 6 in 100,000, and closer pairs more surely.

    A NULL or empty text, or one without words, is linked with nothing and kept. Fewer than ``words``
    words form one shingle. Rows with one id share its component; a NULL id counts for none, its
    row is kept only if no document with an id is connected to it. Other columns are not carried.
    """
    m = bands * rows
    rows_ = settle(sketches(docs, doc_id, text, words, m), "sketches")
    classes = (
        rows_.where("n > 0")
        .groupBy("key")
        .agg(F.min("_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    )
    classes = settle(classes, "classes")
    every = band_rows(classes, bands, rows)
    shared = every.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("end"))
    shared = settle(shared.where("first < end").select("band", "first"), "bands")
    members = settle(every.join(shared, "band").select("band", "number", "key", "first"), "members")
    sets = shingle_sets(docs, settle(members.select("key").distinct(), "needed"), text, words, limit)

    pairs = members.where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    near = likely(pairs.distinct(), classes, percent / 100)
    links = settle(verified(near.select("a", "b"), sets, percent), "links")
    found = settle(components(links), "components")
    more = across(members, found, classes, sets, percent, rows)
    links = links.union(settle(verified(more, sets, percent), "links"))
    found = settle(components(links), "components")

    at = found.select(F.col("id").alias("key"), "component")
    named = classes.select("key", "id").join(at, "key", "left")
    named = named.select("key", "id", F.coalesce("component", "key").alias("c"))
    lowest = named.groupBy("c").agg(F.min("id").alias("component_id"))
    named = settle(named.join(lowest, "c").select("key", "component_id"), "named")
    out = rows_.select("_id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
