"""Exact ranks and order statistics that never bring one group into one task.

A window over a whole group sorts that group in a single task. Here a group is first cut into
ordered buckets; bucket counts (combined map-side) give each bucket's first rank, and only rows
of the same bucket are ordered against each other.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premisa.functions.exprs import INF, NAN, as_col, hex_number
from premisa.sources.staging import BROADCAST_BYTES, attach, bytes_column, matches, settle

HASH_DIGITS = 3  # 4096 equally likely buckets per group, at least
SPLITS = 256  # buckets per group when ordering by a number, at least
TASK_ROWS = 100_000  # rows of a bucket beyond which there are more buckets
STEPS = 8  # buckets per power of two when ordering real values
NAN_BUCKET = 2201 * STEPS
SLICES = 4096  # slices of a bucket that is still too large
BUCKET_ROWS = 2_000_000  # values of one bucket that a task may order


def _offset_rank(
    rows: DataFrame, keys: list[str], order: list[Column], rank: str, total: str | None = None
) -> DataFrame:
    """Rank inside the bucket column ``_b`` plus the size of all lower buckets.

    ``total`` names a column for the size of the group, which the bucket counts give as well.
    The windows over the counts see one row per bucket.
    """
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    starts = settle(
        counts.select(
            *keys,
            "_b",
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"),
            *([F.sum("_c").over(Window.partitionBy(*keys)).alias(total)] if total else []),
        ),
        "bucket-starts",
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(inside))
    joined = attach(ranked, starts, [*keys, "_b"], ["_r"])
    return joined.withColumn(rank, (F.col("_start") + F.col("_r")).cast("bigint")).drop(
        "_b", "_r", "_start"
    )


def hash_rank(df: DataFrame, keys: list[str], key: Column, ids: list[str], rank: str) -> DataFrame:
    """1-based position of each row in hash order (then ids) within its group.

    There are 16 times as many buckets for each factor of 16 that the rows are more than
    ``TASK_ROWS`` a bucket.
    """
    digits = HASH_DIGITS
    rows_ = df.count()
    while digits < 7 and rows_ > 16**digits * TASK_ROWS:
        digits += 1
    rows = df.withColumn("_hash", key).withColumn(
        "_b", hex_number(F.substring("_hash", 1, digits)).cast("int")
    )
    return _offset_rank(rows, keys, [F.col("_hash"), *map(F.col, ids)], rank).drop("_hash")


def number_rank(
    df: DataFrame, keys: list[str], number: str, rank: str, total: str | None = None
) -> DataFrame:
    """1-based position by an ascending integer column that is unique within its group.

    Bucket bounds are approximate quantiles (a sketch of bounded size), so buckets stay even for
    any distribution; the ranks are exact because buckets are counted, not estimated.
    """
    splits = max(SPLITS, -(-df.count() // TASK_ROWS))
    cuts = [i / splits for i in range(1, splits)]
    bounds = settle(
        df.groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx(number, cuts, F.lit(16 * splits))).alias("_cuts")
        ),
        "bucket-bounds",
    )
    if keys:
        rows = attach(df, bounds, keys, [number])
        cut_array = F.col("_cuts")
    else:
        rows, cut_array = df, F.array(*[F.lit(x) for x in bounds.first()["_cuts"] or []])
    bucket = F.size(F.filter(cut_array, lambda c: c < F.col(number)))
    rows = rows.withColumn("_b", bucket).drop("_cuts")
    return _offset_rank(rows, keys, [F.col(number)], rank, total)


def value_bucket(x: Column | str) -> Column:
    """Integer that never decreases as the double grows; NaN last, as Spark orders it."""
    x = as_col(x)
    # Spark's log2 works out a second logarithm for each row
    size = (F.floor(F.ln(F.abs(x)) * F.lit(STEPS / log(2))) + F.lit(1100 * STEPS)).cast("int")
    far = F.lit(2200 * STEPS)
    return (
        F.when(F.isnan(x), F.lit(NAN_BUCKET))
        .when(x == INF, far)
        .when(x == -INF, -far)
        .when(x > 0, size)
        .when(x < 0, -size)
        .otherwise(F.lit(0))
    )


def _in_edges(rows: DataFrame, edges: DataFrame, by: list[str], size: int, limit: int) -> DataFrame:
    """The values that fall into a marked bucket, with its number ``_e``."""
    if size > limit:
        found = attach(rows, edges.select(*by, "_e"), by, ["_v"], limit=limit, size=size)
    else:
        known = edges.select(*(F.col(k).alias(f"_{k}_of_edge") for k in by), "_e")
        met = matches([F.col(k) for k in by], [F.col(f"_{k}_of_edge") for k in by])
        found = rows.join(F.broadcast(known), met)
    return found.select("_e", "_v", "_w")


def value_rows(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys, value ``_v`` as a double and its bucket ``_b``; NULLs are left out."""
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    return base.withColumn("_b", value_bucket("_v"))


def value_buckets(base: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums and ends of the value buckets, with the first rank of each bucket."""
    hist = base.groupBy(*keys, "_b").agg(
        F.count("*").alias("_c"),
        F.sum("_v").alias("_s"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    ordered = Window.partitionBy(*keys).orderBy("_b")
    return hist.withColumn("_end", F.sum("_c").over(ordered)).withColumn(
        "_n", F.sum("_c").over(Window.partitionBy(*keys))
    )


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    percentiles: dict[str, float],
    trim: float | None = None,
    bucket_rows: int = BUCKET_ROWS,
    limit: int = BROADCAST_BYTES,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Exact n, mean, percentiles and trimmed mean of ``value`` per group, NULLs left out.

    Percentiles interpolate linearly, and are NaN as soon as the group holds a NaN. The trimmed
    mean drops ``int(trim * n)`` values at each end. One pass counts and sums the values per
    bucket; a second pass looks only at the few buckets the asked ranks fall into. While one of
    those holds more than ``bucket_rows`` values, it is cut again before its distinct values are
    ordered. Where rows must be shuffled, equal values of a bucket are first counted map-side, so a
    value that fills a group is one row per task. A NULL key is a group like any other. Keys are integers,
    texts or booleans. ``buckets`` are staged ``value_buckets`` of the same rows, if the caller has them.
    """
    base = value_rows(df, keys, value)
    n, start, end = F.col("_n"), F.col("_start"), F.col("_end")
    cut = F.floor(F.lit(float(trim)) * n) if trim is not None else None
    wanted: dict[str, Column] = {}
    for name, p in percentiles.items():
        low = F.floor((n - 1) * F.lit(float(p)))
        wanted[f"_lo_{name}"] = low
        wanted[f"_hi_{name}"] = F.least(low + 1, n - 1)
    touched = list(wanted.values())
    if cut is not None:
        touched += [cut, n - cut - 1]

    def with_edges(counts: DataFrame) -> DataFrame:
        """Mark the buckets that hold an asked rank."""
        edge = F.lit(False)
        for r in touched:
            edge = edge | ((r >= start) & (r < end))
        return settle(
            counts.withColumn("_start", end - F.col("_c")).withColumn("_edge", edge),
            "value-ranks",
        )

    def edges_of(counts: DataFrame, *more: str) -> DataFrame:
        """The marked buckets, each with a number that stands for its keys from here on."""
        found = counts.filter("_edge").withColumn("_e", F.monotonically_increasing_id())
        return settle(
            found.select("_e", *keys, *more, start.alias("_first"), "_n", "_c", "_low", "_high"),
            "edges",
        )

    def whole_buckets(counts: DataFrame, total: bool) -> DataFrame:
        """What the buckets between the two cuts, and on the first level all of them, add up to."""
        kept = F.lit(0.0)
        if cut is not None:
            kept = F.when(~F.col("_edge") & (start >= cut) & (end <= n - cut), F.col("_s"))
        return counts.groupBy(*keys).agg(
            F.max("_n").alias("_n"),
            F.sum(kept).alias("_kept"),
            *([F.sum("_s").alias("_sum")] if total else []),
            *([F.max(F.col("_b") == NAN_BUCKET).alias("_nan")] if total else []),
        )

    hist = with_edges(value_buckets(base, keys) if buckets is None else buckets)
    parts = [whole_buckets(hist, total=True)]
    edges = edges_of(hist, "_b")
    by = [*keys, "_b"]
    size, largest = edges.agg(bytes_column(edges), F.max("_c")).first()
    rows = base.withColumn("_w", F.lit(1).cast("bigint"))
    if size > limit:
        rows = base.groupBy(*by, "_v").agg(F.count("*").alias("_w"))
    rows = _in_edges(rows, edges, by, size, limit)
    while (largest or 0) > bucket_rows:
        rows = settle(rows.groupBy("_e", "_v").agg(F.sum("_w").alias("_w")), "edge-values")
        rows, slices = _slices(rows, edges, keys, limit)
        slices = with_edges(slices)
        parts.append(whole_buckets(slices, total=False))
        edges = edges_of(slices.withColumnRenamed("_e", "_up"), "_up", "_slice", "_d")
        by = ["_up", "_slice"]
        # a slice of one value needs no order
        wide = F.when(F.col("_low") < F.col("_high"), F.col("_d"))
        size, largest = edges.agg(bytes_column(edges), F.max(wide)).first()
        rows = _in_edges(rows.withColumnRenamed("_e", "_up"), edges, by, size, limit)

    counted = rows.groupBy("_e", "_v").agg(F.sum("_w").alias("_c"))
    inside = Window.partitionBy("_e").orderBy("_v")
    counted = counted.withColumn("_upto", F.sum("_c").over(inside))
    ends = edges.select("_e", "_first", "_n")
    near = attach(counted, ends, ["_e"], ["_v"], limit=limit, size=size)
    near = near.withColumn("_end", F.col("_first") + F.col("_upto"))
    near = near.withColumn("_start", end - F.col("_c"))
    kept = F.lit(0.0)
    if cut is not None:
        times = F.greatest(F.least(end, n - cut) - F.greatest(start, cut), F.lit(0))
        kept = F.when(times > 0, F.col("_v") * times)
    picked = near.groupBy("_e").agg(
        F.sum(kept).alias("_kept"),
        *[
            F.max(F.when((start <= r) & (r < end), F.col("_v"))).alias(name)
            for name, r in wanted.items()
        ],
    )
    parts.append(edges.select("_e", *keys).join(picked, "_e").drop("_e"))

    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = merged.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.max("_nan").alias("_nan"),
        F.sum("_sum").alias("_sum"),
        F.sum("_kept").alias("_kept"),
        *[F.max(name).alias(name) for name in wanted],
    )
    n = F.col("n")
    out = [F.col("n").cast("bigint"), (F.col("_sum") / n).alias("mean")]
    for name, p in percentiles.items():
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        part = (n - 1) * F.lit(float(p)) - F.floor((n - 1) * F.lit(float(p)))
        between = F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part)
        out.append(F.when(F.col("_nan"), F.lit(NAN)).otherwise(between).alias(name))
    if trim is not None:
        size = n - 2 * F.floor(F.lit(float(trim)) * n)
        out.append((F.col("_kept") / size).alias("trim_mean"))
    return merged.select(*keys, *out)


def _slices(
    rows: DataFrame, edges: DataFrame, keys: list[str], limit: int
) -> tuple[DataFrame, DataFrame]:
    """Cut every edge bucket into ``SLICES`` equal parts: its rows, and the parts' counts.

    ``rows`` has each value once with its weight ``_w``; ``_d`` counts the values of a part.
    """
    info = edges.select("_e", "_low", "_high")
    width = F.col("_high") - F.col("_low")
    share = (F.col("_v") - F.col("_low")) / width
    place = F.when(width > 0, F.least(F.floor(share * SLICES), F.lit(SLICES - 1))).otherwise(0)
    rows = attach(rows, info, ["_e"], ["_v"], limit=limit)
    rows = rows.select("_e", "_v", "_w", place.cast("int").alias("_slice"))
    counts = rows.groupBy("_e", "_slice").agg(
        F.sum("_w").alias("_c"),
        F.count("*").alias("_d"),
        F.sum(F.col("_v") * F.col("_w")).alias("_s"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    ordered = Window.partitionBy("_e").orderBy("_slice")
    counts = counts.withColumn("_upto", F.sum("_c").over(ordered))
    joined = counts.join(edges.select("_e", *keys, "_first", "_n"), "_e")
    return rows, joined.withColumn("_end", F.col("_first") + F.col("_upto"))
