"""Helpers the operators share: session settings, bounded broadcasts, connected components."""

from __future__ import annotations

import importlib.util
import os
import pickle
import re
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from premisa.session import prepare
from premisa.sources.staging import settle

ARROW_ROWS = 1024
ARROW_BYTES = 4 * 1024 * 1024
BROADCAST_BYTES = 32 * 1024 * 1024
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def session(spark: SparkSession) -> SparkSession:
    """The library's settings; batches of whole texts are kept short, in rows and in bytes."""
    conf = prepare(spark).conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; ``TOKENIZERS_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def others(df: DataFrame, into: str) -> list[T.StructField]:
    """The columns a result column of this name leaves in place."""
    return [f for f in df.schema.fields if f.name.lower() != into.lower()]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ship(spark: SparkSession, thing: Any) -> Broadcast:
    """A broadcast of something that holds classes of this package; ``opened`` reads it in a task.

    Its classes travel with it, as a plain broadcast's do not: executors need no copy of the package.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def opened(shipped: Broadcast) -> Any:
    return pickle.loads(shipped.value)


def per_worker(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once per Python worker and key and kept beyond the task, one of each kind.

    Functions that travel to a task have globals of their own there, so it is kept as a module.
    """
    kept = sys.modules.setdefault("_premisa_kept", ModuleType("_premisa_kept")).__dict__
    if kind not in kept or kept[kind][0] != key:
        kept[kind] = (key, make())
    return kept[kind][1]


def finite_entries(vector: Column) -> Column:
    """Is every entry of the list a finite number?"""

    def sound(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return F.forall(vector, sound)


def with_result(
    df: DataFrame,
    into: str,
    kind: T.DataType,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, pa.Array]]],
) -> DataFrame:
    """All rows and columns, and the column ``into`` that ``run`` gives for parts of Arrow batches.

    Spark's Arrow functions take no column names with dots, so these are renamed on the way.
    """
    rest = others(df, into)
    names = [f.name if re.fullmatch(r"\w+", f.name) else f"column_{i}_" for i, f in enumerate(rest)]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, result in run(batches):
            columns = [part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, result], [*names, into])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, rest, strict=True)]
    rows = df.select(*(quoted(f.name).alias(n) for n, f in zip(names, rest, strict=True)))
    out = rows.mapInArrow(mapped, T.StructType([*fields, T.StructField(into, kind)]))
    return out.toDF(*(f.name for f in rest), into)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a value as text, modulo a number; a NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(df: DataFrame) -> int:
    """Bytes of all rows written as JSON: a bound for what a broadcast of them would move."""
    size = F.sum(F.length(F.to_json(F.struct("*"))).cast("bigint"))
    return df.agg(F.coalesce(size, F.lit(0))).first()[0]


def look_up(
    big: DataFrame, small: DataFrame, on: Column, how: str = "inner", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Join with a staged table: broadcast if its measured size is below ``limit``.

    Beyond the limit it is a plain equi-join, whose skewed partitions Spark splits at run time.
    """
    return big.join(F.broadcast(small) if text_bytes(small) <= limit else small, on, how)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: ``id`` and ``component``, its smallest id.

    Alternates two star steps on staged edge tables: every node hands its smallest neighbour to
    its larger ones, then to its smaller ones. Each step is a minimum per node and an equi-join, so
    nothing of a component is ever gathered; the number of rounds grows with the logarithm of the
    longest path, and edges that are stars already need none. Loops and repeated edges are allowed;
    NULL ends are dropped.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = settle(now.where("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.where("u <> v").union(low.select("u", "m")).distinct(), "edges")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(ends.select(F.col("component").alias("id"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Has every node ``u`` one ``v``, which is no ``u`` itself?"""
    nodes = edges.groupBy("u").agg(F.count("*").alias("k"))
    onward = edges.join(nodes.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return nodes.where("k > 1").select("u").union(onward).isEmpty()
