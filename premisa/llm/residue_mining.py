"""Hard negatives of labelled vectors, by exact scores from products modulo small primes.

The inner product of two integer vectors is taken modulo several primes. A prime is so small that a
float32 matrix product of the residues is exact; the Chinese remainder theorem gives the signed score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premisa.llm.common import finite_entries, look_up, quoted
from premisa.sources.staging import settle

CHUNK = 64  # dimensions that one float32 product adds up
LARGEST = 1 << 56  # scores are below this, so that a hundred times a score fits 64 bits
NONE = np.int64(-(1 << 62))  # stands for a pair that takes no part
ANCHORS = 2048  # anchors of a block
ROWS = 4096  # rows of a block
TILE = 256  # anchors of a block that are scored together


def primes_for(bound: int, chunk: int = CHUNK) -> list[int]:
    """The largest primes whose ``chunk`` products of centred residues float32 adds exactly, as many as
    it takes to tell all numbers from -bound to bound apart, two at least."""
    found: list[int] = []
    product = 1
    p = 2 * int((2**24 / chunk) ** 0.5) - 1
    while len(found) < 2 or product <= 2 * bound + 1:
        if p < 3:
            raise ValueError(f"no primes left for scores up to {bound}")
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)) and chunk * ((p - 1) // 2) ** 2 < 2**24:
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of integers as float32, from -(p - 1) / 2 to (p - 1) / 2."""
    half = (p - 1) // 2
    return ((x + half) % p - half).astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int, chunk: int = CHUNK) -> np.ndarray:
    """Residues of ``a`` times the transpose of ``b``; both hold centred residues in float32."""
    total = np.zeros((len(a), len(b)), np.float32)
    inverse = np.float32(1 / p)
    for s in range(0, a.shape[1], chunk):
        part = a[:, s : s + chunk] @ b[:, s : s + chunk].T
        # every number here is an integer below 2^24, so rounding loses nothing
        part -= np.float32(p) * np.rint(part * inverse)
        total += part
        if (s // chunk) % 1024 == 1023:
            total -= np.float32(p) * np.rint(total * inverse)
    return total


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed integers from their residues, by mixed radix digits of the Chinese remainder theorem."""
    value = parts[0].astype(np.int64) % primes[0]
    product = primes[0]
    for part, p in zip(parts[1:], primes[1:], strict=True):
        digit = (part.astype(np.int64) - value) % p * pow(product, -1, p) % p
        value += product * digit
        product *= p
    value[value > product // 2] -= product
    return value


def scores(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """Exact inner products of the integer rows of ``a`` and ``b``."""
    parts = [product_modulo(residues(a, p), residues(b, p), p) for p in primes]
    return reconstruct(parts, primes)


def best(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` largest numbers of each row above ``NONE``; of equal ones the first count."""
    n = found.shape[1]
    if n > k:
        least = np.partition(found, n - k, axis=1)[:, n - k, None]
        i, j = np.nonzero((found >= least) & (found > NONE))
    else:
        i, j = np.nonzero(found > NONE)
    order = np.lexsort((j, -found[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def _matrix(table: pa.Table) -> np.ndarray:
    x = pa.concat_arrays(table.column("x").chunks)
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), -1)


def _by_id(table: pa.Table) -> pa.Table:
    """Rows by id, those without one last: among equal scores the first row is the one that counts."""
    return table.sort_by([("id", "ascending"), ("row", "ascending")])


def prepared(
    rows: DataFrame, vec_id: str, vector: str, label: str, scale: int
) -> tuple[DataFrame, list[int], int]:
    """The rows that take part as ``row``, ``id``, ``label`` and ``x``, the primes, and how many rows."""
    x = F.transform(quoted(vector), lambda c: c.cast("double") * scale)
    taken = rows.where(quoted(label).isNotNull() & quoted(vector).isNotNull()).where(finite_entries(x))
    taken = taken.select(quoted(vec_id).alias("id"), quoted(label).alias("label"), x.alias("x"))
    # a floor is at most one larger in size than its number
    size = F.aggregate("x", F.lit(0.0), lambda s, c: s + (F.abs(c) + 1) * (F.abs(c) + 1))
    found = taken.agg(
        F.max(size).alias("bound"),
        F.min(F.size("x")).alias("narrow"),
        F.max(F.size("x")).alias("wide"),
        F.count("*").alias("n"),
    ).first()
    if found["narrow"] != found["wide"]:
        raise ValueError("vectors differ in length")
    bound = found["bound"] or 0.0
    if bound >= LARGEST:
        raise ValueError(f"scores of up to {bound:g} are too large for exact comparisons in 64 bits")
    taken = taken.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "label",
        F.transform("x", lambda c: F.floor(c).cast("int")).alias("x"),
    )
    return settle(taken, "vectors"), primes_for(int(bound) + 1), found["n"]


def _dealt(df: DataFrame, own: str, blocks: str | int, seed: int, other: str, copies: str | int) -> DataFrame:
    """Rows dealt into ``blocks`` blocks by their number, one copy for each block of the other side."""
    count = F.col(blocks) if isinstance(blocks, str) else F.lit(blocks)
    times = F.col(copies) if isinstance(copies, str) else F.lit(copies)
    block = F.pmod(F.xxhash64("row", F.lit(seed)), count.cast("bigint")).cast("int")
    copy = F.explode(F.sequence(F.lit(0), times.cast("int") - 1))
    dealt = df.withColumn(own, block).withColumn(other, copy)
    return dealt.toDF(*dealt.columns)  # columns of its own: both sides come from one table


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    anchor_block: int = ANCHORS,
    row_block: int = ROWS,
) -> DataFrame:
    """Hard negatives for each anchor and positive: ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score`` and ``negative_score``.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor;
    higher scores come first, ties by smaller id, a row without an id last. ``anchors`` is a condition on
    columns ``id`` and ``label``. An anchor's positives are its first ``positives`` other rows of the same
    label; of the rows of other labels whose score is ``least`` to ``most`` % of the positive's, the first
    ``negatives`` are returned; a positive with a score below zero has none.

    Rows with a NULL label, a NULL vector or a NULL or non-finite component take no part, neither does
    an anchor without positives. Equal rows, and rows of one id, are different rows: each is an anchor of its
    own and a possible positive of the other. An empty table gives an empty result. Vectors of different
    lengths and scores of 2^56 or more are errors. Other columns are not carried.

    Anchors and rows are dealt into blocks of bounded size and every block of anchors meets every block
    of rows, for positives within each label only, so a label with any share of the rows is split. A
    pair of blocks hands on a few rows per anchor; a window over these, cut before the shuffle, gives the result.
    """
    vectors, primes, n = prepared(rows, vec_id, vector, label, scale)
    asked = vectors.where(anchors)
    number = T.LongType()
    kind = vectors.schema["id"].dataType
    one_schema = T.StructType(
        [
            T.StructField("row", number),
            T.StructField("positive_row", number),
            T.StructField("positive_id", kind),
            T.StructField("positive_score", number),
        ]
    )
    pair_schema = T.StructType(
        [
            T.StructField("row", number),
            T.StructField("anchor_id", kind),
            *one_schema.fields[1:],
            T.StructField("negative_id", kind),
            T.StructField("negative_score", number),
        ]
    )
    one_each, pairs_of = to_arrow_schema(one_schema), to_arrow_schema(pair_schema)

    # positives: blocks within a label
    sizes = vectors.groupBy("label").agg(
        F.count("*").alias("n"), F.count(F.when(anchors, 1)).alias("k")
    )
    sizes = sizes.where("k > 0").select(
        F.col("label").alias("of"),
        F.ceil(F.col("k") / anchor_block).alias("a_blocks"),
        F.ceil(F.col("n") / row_block).alias("r_blocks"),
    )
    sizes = settle(sizes, "labels")
    near = _dealt(look_up(asked, sizes, F.col("label") == F.col("of")), "i", "a_blocks", 1, "j", "r_blocks")
    far = _dealt(look_up(vectors, sizes, F.col("label") == F.col("of")), "j", "r_blocks", 2, "i", "a_blocks")

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):  # a block may be empty
            return one_each.empty_table()
        right = _by_id(right)
        a, b = _matrix(left), _matrix(right)
        names, others = left.column("row").to_numpy(), right.column("row").to_numpy()
        one, two, worth = [], [], []
        for s in range(0, len(a), TILE):
            found = scores(a[s : s + TILE], b, primes)
            found[names[s : s + TILE, None] == others] = NONE
            i, j = best(found, positives)
            one.append(i + s)
            two.append(j)
            worth.append(found[i, j])
        at = np.concatenate(two) if two else np.zeros(0, np.int64)
        return pa.table(
            {
                "row": names[np.concatenate(one)] if one else names[:0],
                "positive_row": others[at],
                "positive_id": right.column("id").take(pa.array(at)),
                "positive_score": np.concatenate(worth) if worth else at,
            }
        )

    keys = ["label", "i", "j"]
    pairs = (
        near.select(*keys, "row", "x")
        .groupBy(*keys)
        .cogroup(far.select(*keys, "row", "id", "x").groupBy(*keys))
        .applyInArrow(same, one_schema)
    )
    order = Window.partitionBy("row").orderBy(
        F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row"
    )
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    by_anchor = ranked.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_row", "positive_id", "positive_score"))).alias("p")
    )
    full = settle(asked.join(by_anchor, "row"), "anchors")

    # negatives: all rows, in blocks
    a_blocks = max(1, -(-full.count() // anchor_block))
    r_blocks = max(1, -(-n // row_block))
    near = _dealt(full, "i", a_blocks, 1, "j", r_blocks)
    far = _dealt(vectors, "j", r_blocks, 2, "i", a_blocks)

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pairs_of.empty_table()
        right = _by_id(right)
        a, b = _matrix(left), _matrix(right)
        labels = pa.concat_arrays([*left.column("label").chunks, *right.column("label").chunks])
        codes = labels.dictionary_encode().indices.to_numpy()
        own, theirs = codes[: len(a)], codes[len(a) :]
        lists = pa.concat_arrays(left.column("p").chunks)
        flat = lists.flatten()
        goal = flat.field("positive_score").to_numpy()
        start = np.cumsum([0, *lists.value_lengths().to_pylist()])
        number = np.diff(start)
        anchor, which, at, worth = [], [], [], []
        for s in range(0, len(a), TILE):
            found = scores(a[s : s + TILE], b, primes)
            found[own[s : s + TILE, None] == theirs] = NONE
            for k in range(positives):
                some = np.nonzero(number[s : s + TILE] > k)[0]
                if not len(some):
                    continue
                place = start[s + some] + k
                low, high = -(-least * goal[place] // 100), most * goal[place] // 100
                rest = found[some]
                rest[(rest < low[:, None]) | (rest > high[:, None])] = NONE
                i, j = best(rest, negatives)
                anchor.append(some[i] + s)
                which.append(place[i])
                at.append(j)
                worth.append(rest[i, j])
        none = np.zeros(0, np.int64)
        anchor, which, at, worth = (np.concatenate(c) if c else none for c in (anchor, which, at, worth))
        chosen = pa.array(which)
        return pa.table(
            {
                "row": left.column("row").take(pa.array(anchor)),
                "anchor_id": left.column("id").take(pa.array(anchor)),
                "positive_row": flat.field("positive_row").take(chosen),
                "positive_id": flat.field("positive_id").take(chosen),
                "positive_score": flat.field("positive_score").take(chosen),
                "negative_id": right.column("id").take(pa.array(at)),
                "negative_score": worth,
            }
        )

    keys = ["i", "j"]
    found = (
        near.select(*keys, "row", "id", "label", "x", "p")
        .groupBy(*keys)
        .cogroup(far.select(*keys, "row", "id", "label", "x").groupBy(*keys))
        .applyInArrow(other, pair_schema)
    )
    order = Window.partitionBy("row", "positive_row").orderBy(
        F.desc("negative_score"), F.asc_nulls_last("negative_id")
    )
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
