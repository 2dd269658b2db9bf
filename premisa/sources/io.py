"""Readers and writers of the example files and the result tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from premisa.sources.staging import settle

SPLITS = ["train", "dev", "test"]
BAD = "_bad_record"
MANIFEST = "manifest"
MANIFEST_SCHEMA = "name string, kind string, rows bigint"

# Record formats of the input files.
NLI_SCHEMA = "pairID string, sentence1 string, sentence2 string, gold_label string"
PROOF_SCHEMA = (
    "id string, hypothesis string, proof string, answer string, "
    "meta struct<triples: map<string,string>, intermediate_conclusions: map<string,string>, "
    "distractors: array<string>, question_text: string>"
)
CHOICES_SCHEMA = (
    "id string, answerKey string, question struct<choices: array<struct<label: string, text: string>>>"
)
CHOICES_CSV_SCHEMA = (
    "questionID string, originalQuestionID string, totalPossiblePoint string, AnswerKey string, "
    "isMultipleChoiceQuestion string, includesDiagram string, question string"
)


def parsed_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Every non-blank line of JSON files as ``file``, ``line`` and its ``record``, which is NULL for a bad line.

    Bad are lines that are no JSON object and values that do not fit the schema. A missing or unknown field is
    neither, and where text is expected any value fits as its text.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    text = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")
    )
    found = text.filter(F.trim("line") != "").withColumn(
        "record", F.from_json("line", f"{schema}, {BAD} string", options)
    )
    fits = F.col(f"record.{BAD}").isNull() & F.startswith(F.ltrim("line"), F.lit("{"))
    return found.withColumn("record", F.when(fits, F.col("record").dropFields(BAD)))


def bad_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """The quarantine: ``file`` and ``line`` of all lines that ``read_json`` does not take."""
    return parsed_lines(spark, paths, schema).filter("record is null").select("file", "line")


def read_json(
    spark: SparkSession, paths: str | list[str], schema: str, on_bad: str = "fail"
) -> DataFrame:
    """Records of JSON files, one object per line.

    A bad line ends the read with its file and text (``on_bad="fail"``), or is left out
    (``"skip"``) and listed by ``bad_lines``. It never becomes a row of NULLs.
    """
    lines = parsed_lines(spark, paths, schema)
    return _sound(lines, F.col("record").isNull(), F.col("line"), on_bad).select("record.*")


def _sound(rows: DataFrame, bad: Column, line: Column, on_bad: str) -> DataFrame:
    if on_bad == "skip":
        return rows.filter(~bad)
    if on_bad != "fail":
        raise ValueError("on_bad is fail or skip")
    text = F.concat(F.lit("bad record in "), "file", F.lit(": "), F.left(line, F.lit(200)))
    return rows.filter(F.assert_true(~bad, text).isNull())


def read_nli(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """Sentence pairs, one JSON object per line."""
    return read_json(spark, path, NLI_SCHEMA, on_bad)


def read_proofs(spark: SparkSession, folder: str, on_bad: str = "fail") -> DataFrame:
    """Proof records of the three splits, tagged with the split they came from."""
    parts = [
        read_json(spark, f"{folder}/{split}.jsonl", PROOF_SCHEMA, on_bad).withColumn(
            "original_split", F.lit(split)
        )
        for split in SPLITS
    ]
    return reduce(DataFrame.unionByName, parts)


def read_choices(spark: SparkSession, paths: list[str], on_bad: str = "fail") -> DataFrame:
    """Choice records, one JSON object per line, of any number of files."""
    return read_json(spark, paths, CHOICES_SCHEMA, on_bad)


def parsed_csv(
    spark: SparkSession, paths: list[str], schema: str, multi_line: bool = True
) -> DataFrame:
    """Rows of CSV files with their ``file``; ``line`` is the text of a row with too few or too many
    values or one that does not fit, and NULL for a sound row.

    Staged, since Spark parses a row anew for each set of columns. Files whose values hold line breaks are read
    by one task each; ``multi_line=False`` splits the others.
    """
    reader = spark.read.schema(f"{schema}, {BAD} string").option("header", True)
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    rows = reader.csv(paths).select("*", F.col("_metadata.file_path").alias("file"))
    return settle(rows.withColumnRenamed(BAD, "line"), "csv")


def read_choices_csv(
    spark: SparkSession,
    paths: list[str],
    schema: str = CHOICES_CSV_SCHEMA,
    on_bad: str = "fail",
    multi_line: bool = True,
) -> DataFrame:
    """The CSV twin of the choice records; values may span lines."""
    rows = parsed_csv(spark, paths, schema, multi_line)
    return _sound(rows, F.col("line").isNotNull(), F.col("line"), on_bad).drop("file", "line")


def write_splits(df: DataFrame, path: str) -> str:
    """One folder per split, one JSON object per line."""
    df.write.partitionBy("split").json(path)
    return path


def save_tables(tables: dict[str, DataFrame], folder: str) -> str:
    """Write each table (or tuple element) to its own parquet folder, all or nothing.

    Last comes a manifest with every table's schema and number of rows; without it the folder counts as not
    written, and another save replaces what a broken one left. A finished folder is never overwritten.
    """
    if not tables:
        raise ValueError("there is no table to save")
    spark = next(iter(tables.values())).sparkSession
    if MANIFEST in tables:
        raise ValueError(f"a table may not be called {MANIFEST}")
    if _manifest(spark, folder) is not None:
        raise FileExistsError(f"{folder} holds saved tables")
    rows = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
        rows.append((name, back.schema.json(), back.count()))
    listed = spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
    listed.write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return folder


def _manifest(spark: SparkSession, folder: str) -> dict[str, tuple[str, int]] | None:
    """Schema and row count of each table of a finished folder, else None."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return {r["name"]: (r["kind"], r["rows"]) for r in rows} or None


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a finished folder. One that is half written, lacks a table or has other rows or columns than
    its manifest says is an error."""
    listed = _manifest(spark, folder)
    if listed is None:
        raise FileNotFoundError(f"{folder} was not written to its end")
    found = {}
    for name in names:
        if name not in listed:
            raise KeyError(f"{folder} has no table {name}")
        kind, rows = listed[name]
        df = spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{folder}/{name}")
        if df.count() != rows:
            raise ValueError(f"{folder}/{name} has {df.count()} rows, its manifest says {rows}")
        found[name] = df
    return found


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a table available to SQL under a name and read it back whole."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
