"""Staged tables: intermediate results written to shared storage and read back.

A staged table cuts the lineage, survives the loss of an executor, and gives Catalyst the true
size of an aggregate, so a later join is broadcast only if the table really is small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="premisa-")
    return _local_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries of this block take their shuffle files with them when they end, not when the driver collects garbage.

    Only for writes: each is a query of its own, so nothing reads its shuffles again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table; its shuffles do not stay beside it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_clustered(
    df: DataFrame,
    name: str,
    by: list[str],
    order: list[str],
    buckets: int | None = None,
    spread: bool = True,
) -> DataFrame:
    """Write ``df`` in buckets of the columns ``by`` and return a scan that knows them.

    An aggregation on ``by`` and more columns, or a join on ``by``, then reads each bucket where it lies: only
    the other side of the join is exchanged. ``spread`` deals the rows out first, so that a bucket is one file;
    leave it out for rows read from such buckets. Files are sorted by ``order``: a filter on it skips row
    groups. As many buckets as the session has shuffle partitions, if ``buckets`` is not given; a bucket is
    read by one task, so large tables want more.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, *by) if spread else df
    table, path = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", new_path(spark, name)
    writer = df.write.bucketBy(n, *by).sortBy(*order).format("parquet").option("path", path)
    with shuffles_removed(spark):
        writer.saveAsTable(table)
    return spark.table(table)


def in_waves(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    place: list[str],
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a staged ``small`` table to ``big`` on ``keys`` without moving ``big``, whatever the sizes.

    Below ``limit`` it is one broadcast join. Beyond it ``small`` goes in waves of at most ``limit`` bytes (a
    place at least), and each wave reads the rows of its places only. ``place`` are some of the keys, and
    ``big`` is best clustered by them. A NULL key meets a NULL key.
    """
    if table_bytes(small) <= limit:
        return attach(big, small, keys, [], limit=limit, size=0)
    sizes = small.groupBy(*place).agg(bytes_column(small).alias("_bytes"))
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    # the sum runs over a row per place, not over the table
    wave = F.floor(F.coalesce(F.sum("_bytes").over(before), F.lit(0)) / max(limit, 1))
    parts = []
    waves = sizes.select(*place, wave.alias("_wave")).orderBy("_wave").collect()
    for number in dict.fromkeys(r["_wave"] for r in waves):
        own = [r for r in waves if r["_wave"] == number]
        here = reduce(
            or_, (reduce(and_, (F.col(k).eqNullSafe(F.lit(r[k])) for k in place)) for r in own)
        )
        parts.append(attach(big.filter(here), small.filter(here), keys, [], limit=limit, size=0))
    return reduce(DataFrame.unionByName, parts)


def bytes_column(df: DataFrame) -> Column:
    """In-memory size of a table as an aggregate: numbers by eight bytes, the rest by length.

    Maps, structs and arrays of other things than numbers count by four bytes a character of JSON.
    """
    size: Column = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * 8 + 16
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            text = F.length(F.to_json(F.struct(f.name)))
            size = size + F.coalesce(text, F.lit(0)) * 4 + 16
        elif isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.length(f.name), F.lit(0)) * 4 + 16
        else:
            size = size + 8
    return F.coalesce(F.sum(size.cast("bigint")), F.lit(0))


def table_bytes(df: DataFrame) -> int:
    return df.agg(bytes_column(df)).first()[0]


def matches(big: list[Column], small: list[Column]) -> Column:
    """Join condition: all columns equal, and NULL equals NULL. The join goes by one hash of them as its only key.

    The columns themselves are compared where hashes meet. For columns of integers, texts and booleans.
    """
    equal = (b.eqNullSafe(s).cast("int") for b, s in zip(big, small, strict=True))
    return (F.xxhash64(*big) == F.xxhash64(*small)) & (sum(equal, F.lit(0)) == len(big))


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Join a staged ``small`` table to ``big`` on ``keys``, whatever the sizes and the skew.

    Measured below ``limit`` the small side is broadcast and ``big`` is not moved. Beyond it, the
    rows of one key are spread over ``SALTS`` tasks by a hash of the ``spread`` columns and the
    small side is repeated per salt, so a key with a third of all rows does not fill one task.
    ``size`` is the measured size in bytes, if the caller has it already. A NULL key meets a NULL key.
    """
    own = {k: f"_{k}_of_small" for k in keys}
    small = small.withColumnsRenamed(own)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(c)) for k, c in own.items()))
    if (table_bytes(small) if size is None else size) <= limit:
        return big.join(F.broadcast(small), same, how).drop(*own.values())
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(repeated, same & (F.col("_salt") == F.col("_copy")), how)
    return joined.drop("_salt", "_copy", *own.values())
