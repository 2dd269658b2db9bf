"""The analysis inputs, derived by Spark from the driver's whole tables.

Each function returns a lazy DataFrame. The DuckDB text of the same views is in
``premisa.catalogue.views``; the two are written independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premisa.functions.exprs import scaled
from premisa.sources.catalog import VARIANTS

METHODS = ["mass_mean", "ccr", "lm_head"]
TRAIN_VARIANTS = ["original_pos_prem", "no_prem", "combined"]
# Narrow rows of one partition that are multiplied, at most (on average): a task that groups 20 wide rows for
# each keeps them in the fast part of Spark's hash aggregate.
SPREAD_ROWS = 3000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, spread over the cores if their files give fewer splits than there are cores.

    Work per character is done next; a table of many files is left where it is.
    """
    df = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if df.rdd.getNumPartitions() < cores else df


def numbered(names: list, value: str, index: str) -> Column:
    """A small fixed list as an array of structs, to be exploded next to each row."""
    pairs = [F.struct(F.lit(n).alias(value), F.lit(i).alias(index)) for i, n in enumerate(names)]
    return F.inline(F.array(*pairs))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread narrow rows by key before they are multiplied.

    A multiplied row keeps its partition, so a later grouping that includes the keys needs no
    shuffle of the wide result. The number is given, or AQE would merge the still small parts; it grows
    with the rows, so what a task groups stays in memory at any size.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-df.count() // SPREAD_ROWS)
    return df.repartition(max(parts, spark.sparkContext.defaultParallelism, wanted), *keys)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "orders").select(
        F.concat(F.lit("ds"), F.substring("o_orderpriority", 1, 1)).alias("dataset"),
        F.lit("m1").alias("model"),
        F.col("o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    return spread(samples, "sample_id")


def _scored(spark: SparkSession, sf: str, probes: list[tuple[str, str, int, str, int, int]]) -> DataFrame:
    """Orders x probes, by one list next to each row; a probe's two numbers make its predictions.

    The rows are made and used in one stage, with no union and no copy per list between.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(variant).alias("variant"),
                F.lit(train).alias("train_variant"),
                F.lit(layer).alias("layer"),
                F.lit(method).alias("method"),
                F.lit(factor).cast("bigint").alias("_factor"),
                F.lit(shift).cast("bigint").alias("_shift"),
            )
            for variant, train, layer, method, factor, shift in probes
        ]
    )
    number = F.col("sample_id") * F.col("_factor") + F.col("_shift")
    value = (number % 997).cast("double") / F.lit(997.0)
    return _orders(spark, sf).select("*", F.inline(listed)).select(
        "dataset", "model", "sample_id", "label", "variant", "train_variant", "layer", "method",
        value.alias("prediction"),
    )


def _trained() -> list[tuple[str, str, int, str, int, int]]:
    """7 variants x 3 training sets x 2 layers x 3 methods."""
    return [
        (variant, train, layer, method, 17 + 2 * vi, 7 * vi * vi + 101 * layer + 37 * mi + 53 * ti)
        for vi, variant in enumerate(VARIANTS)
        for ti, train in enumerate(TRAIN_VARIANTS)
        for layer in (1, 2)
        for mi, method in enumerate(METHODS)
    ]


def _trained_on_itself() -> list[tuple[str, str, int, str, int, int]]:
    """5 variants x 2 layers, each variant scored by the probe trained on it.

    The two other variants are training sets of ``predictions``, which scores them on all variants.
    """
    return [
        (variant, variant, layer, "ccr", 19 + 2 * vi, 5 * vi * vi + 101 * layer)
        for vi, variant in enumerate(VARIANTS)
        if variant not in TRAIN_VARIANTS
        for layer in (1, 2)
    ]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders x 7 variants x 3 training sets x 2 layers x 3 methods."""
    return _scored(spark, sf, _trained())


def predictions_same(spark: SparkSession, sf: str) -> DataFrame:
    """Orders x 5 variants x 2 layers, each variant scored by the probe trained on it."""
    return _scored(spark, sf, _trained_on_itself())


def all_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``predictions`` and ``predictions_same``, made in one pass over the orders."""
    return _scored(spark, sf, _trained() + _trained_on_itself())


def causal(spark: SparkSession, sf: str) -> DataFrame:
    """Orders x 2 settings x 2 layers x 2 methods."""
    rows = (
        _orders(spark, sf)
        .select("*", numbered(["intervened", "original"], "setting", "si"))
        .select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("layer"))
        .select("*", numbered(["mass_mean", "ccr"], "method", "mi"))
    )
    number = (
        F.col("sample_id") * (29 + 4 * F.col("si")) + 11 * F.col("layer") + 37 * F.col("mi")
    )
    value = (number % 991).cast("double") / F.lit(991.0)
    return rows.withColumn("prediction", value).drop("si", "mi")


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings x 7 variants x 4 layers of 16 numbers: two sides per sample."""
    sample = F.floor(F.col("vec_id") / 2).cast("bigint")
    side = (F.col("vec_id") % 2).cast("int")
    own = Window.partitionBy("sample_id")
    rows = (
        table(spark, sf, "embeddings")
        .select(sample.alias("sample_id"), side.alias("side"), "label", "embedding")
        .withColumn("y", F.max(F.when(F.col("side") == 0, F.col("label") % 2)).over(own))
        .select("*", numbered(VARIANTS, "variant", "vi"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("layer"))
    )
    part = F.slice("embedding", (F.col("layer") - 1) * 16 + 1, 16).cast("array<double>")
    factor = F.lit(1.0) + F.col("vi") / F.lit(10.0)
    shift = F.col("vi") * F.lit(0.01)
    return rows.select(
        F.lit("emb").alias("dataset"),
        F.lit("m1").alias("model"),
        "variant",
        "layer",
        "sample_id",
        "side",
        F.col("y").cast("int").alias("y"),
        F.transform(scaled(part, factor), lambda x: x + shift).alias("vec"),
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """One answer logit per sample, side and variant."""
    return (
        states(spark, sf)
        .filter("layer = 1")
        .select(
            "dataset", "model", "variant", "sample_id", "side", "y",
            (F.lit(10.0) * F.element_at("vec", 1)).alias("logit"),
        )
    )


def directions(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a direction; each 72 form one model (2 x 3 x 4 x 3 keys)."""
    v = F.col("vec_id")

    def digit(step: int, base: int) -> Column:
        return F.floor(v / step) % base

    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("m"), F.floor(v / 72).cast("string")).alias("model"),
        F.concat(F.lit("ds"), digit(1, 2).cast("string")).alias("dataset"),
        F.concat(F.lit("v"), digit(2, 3).cast("string")).alias("data_variant"),
        (digit(6, 4) + 1).cast("int").alias("layer"),
        F.concat(F.lit("p"), digit(24, 3).cast("string")).alias("probe_method"),
        F.when(F.col("label") % 2 == 0, -1).otherwise(1).alias("sign"),
        F.col("embedding").alias("direction"),
    )


def nli(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut in two halves as sentence pair; labelled where labels exist, '-' elsewhere."""
    half = F.floor(F.length("text") / 2).cast("int")
    gold = (
        F.when(F.col("quality").isNull(), "-")
        .when(F.col("toxic") == 1, "contradiction")
        .when(F.col("quality") == 1, "entailment")
        .otherwise("neutral")
    )
    return (
        documents(spark, sf)
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("pair_id"),
            F.substr("text", F.lit(1), half).alias("sentence1"),
            F.substr("text", half + 1).alias("sentence2"),
            gold.alias("gold_label"),
        )
    )


def qa(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    turns = table(spark, sf, "conversations")
    user = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("next")
    )
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("answer")
    )
    return user.join(reply, ["conv_id", "next"]).drop("next")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """The parts, spread by key: a small file of them is much work."""
    return spread(table(spark, sf, "part"), "p_partkey")


def proofs(spark: SparkSession, sf: str) -> DataFrame:
    """One proof record per part: four facts, one or two conclusions, one to four distractors.

    Where a part's size is even, a conclusion redefines sent4, so merging must let it win.
    """
    facts = F.create_map(
        F.lit("sent1"), F.col("p_name"),
        F.lit("sent2"), F.col("p_brand"),
        F.lit("sent3"), F.col("p_type"),
        F.lit("sent4"), F.concat(F.lit("SIZE "), F.col("p_size").cast("string")),
    )
    derived = F.create_map(F.lit("int1"), F.lit("a Derived FACT"))
    redefined = F.create_map(
        F.lit("int1"), F.lit("a Derived FACT"), F.lit("sent4"), F.lit("an Even size")
    )
    keys = F.array(*[F.lit(k) for k in ("sent4", "sent2", "sent1", "sent3")])
    last = (F.col("p_partkey") % 2 + 3).cast("string")
    return parts(spark, sf).select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("the part is "), F.col("p_name")).alias("hypothesis"),
        F.concat(
            F.lit(" sent1 & sent2 -> int1: x; sent"), last, F.lit(" & int1 -> hypothesis; ")
        ).alias("proof"),
        F.struct(
            facts.alias("triples"),
            F.when(F.col("p_size") % 2 == 0, redefined)
            .otherwise(derived)
            .alias("intermediate_conclusions"),
            F.slice(keys, 1, (F.col("p_partkey") % 4 + 1).cast("int")).alias("distractors"),
            F.concat(
                F.lit("Which is part "), F.col("p_partkey").cast("string"), F.lit("?")
            ).alias("question_text"),
        ).alias("meta"),
    )


def choices(spark: SparkSession, sf: str) -> DataFrame:
    """Four answer choices per part, one of them correct."""
    text = F.array(
        F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    )
    letters = F.array(*[F.lit(c) for c in "ABCD"])
    pairs = F.zip_with(
        letters,
        text,
        lambda c, t: F.struct(c.alias("label"), F.concat(t, F.lit(".")).alias("text")),
    )
    key = F.element_at(letters, (F.col("p_partkey") % 4 + 1).cast("int"))
    return parts(spark, sf).select(
        F.col("p_partkey").alias("item_id"),
        pairs.alias("choices"),
        key.alias("answer_key"),
        F.element_at(text, (F.col("p_partkey") % 4 + 1).cast("int")).alias("answer"),
    )


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as (item, position, token)."""
    words = F.posexplode(F.split("text", " ")).alias("pos", "token")
    return table(spark, sf, "benchmark").select("item_id", words)
