"""Queries over vector states: statistics, splits, centring, scoring, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premisa.catalogue.registry import long_vector, query, r6
from premisa.catalogue.views import VARIANT_LIST
from premisa.functions.exprs import (
    dot,
    doubles,
    has_nan,
    is_finite,
    logit,
    minus,
    scaled,
    sigmoid,
    unit,
)
from premisa.operators import fit, score, vectors
from premisa.operators.ranking import order_statistics
from premisa.sources import fixtures as fx
from premisa.sources.catalog import VARIANTS
from premisa.sources.staging import settle

RUN = vectors.RUN
KEYS = ["dataset", "model", "layer", "train_variant"]


def split_states(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.half_split(vectors.cluster(fx.states(spark, sf)))


def centred(spark: SparkSession, sf: str) -> DataFrame:
    """Centred states, stored by sample because fitting, calibration and scoring all read them."""
    return vectors.cluster(vectors.center(split_states(spark, sf)), "centred", spread=False)


def train_rows(states: DataFrame) -> DataFrame:
    return states.filter("split = 'train'").withColumnRenamed("variant", "train_variant")


def mean_probes(states: DataFrame) -> DataFrame:
    return settle(fit.train(states.filter("split = 'train'"), "mass_mean", RUN), "probes")


def calibrated_probes(states: DataFrame, probes: DataFrame) -> DataFrame:
    without = states.filter("split = 'train' and variant = 'no_prem'")
    found = score.calibration_params(probes, train_rows(states), without)
    return settle(found, "calibrated")


# --- ingest --------------------------------------------------------------------------------


@query(
    "s12_vector_scan",
    "SELECT vec_id, label, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) "
    "AS total FROM embeddings",
)
def s12(spark, sf):
    df = fx.table(spark, sf, "embeddings")
    total = F.aggregate(doubles("embedding"), F.lit(0.0), lambda s, x: s + x)
    return df.select(
        "vec_id", "label", F.size("embedding").alias("width"), r6(total, "total")
    )


@query(
    "s13_batch_assembly",
    "SELECT variant, layer, sample_id, side, i, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS value FROM st",
    "st",
)
def s13(spark, sf):
    states = fx.states(spark, sf)
    batches = [states.filter("side = 1"), states.filter("side = 0")]
    df = vectors.ingest_states(batches)
    return long_vector(df, ["variant", "layer", "sample_id", "side"])


def padded_tokens(spark, sf) -> DataFrame:
    """Documents as padded token vectors (length, position) with their mask."""
    tokens = F.split("text", " ")
    pads = F.pmod("doc_id", F.lit(3)).cast("int")
    df = fx.documents(spark, sf).withColumn("_t", tokens)
    vecs = F.transform(
        "_t", lambda t, i: F.array(F.length(t).cast("double"), i.cast("double"))
    )
    pad = F.array(F.lit(-1.0), F.lit(-1.0))
    return df.select(
        "doc_id",
        F.concat(vecs, F.array_repeat(pad, pads)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), F.size("_t")), F.array_repeat(F.lit(0), pads)).alias(
            "mask"
        ),
    )


@query(
    "t1_first_pad",
    """SELECT doc_id, CAST(len(str_split(text, ' ')) AS INT) AS place,
  CAST(len(str_split(text, ' ')) - 1 AS INT) AS shifted FROM documents""",
)
def t1(spark, sf):
    return padded_tokens(spark, sf).select(
        "doc_id",
        vectors.first_pad("mask").alias("place"),
        vectors.first_pad("mask", shift=True).alias("shifted"),
    )


@query(
    "t2_token_vector",
    """SELECT doc_id, length(w[len(w)]) AS last_length, len(w) - 1 AS last_place,
  length(w[1]) AS first_length
FROM (SELECT doc_id, str_split(text, ' ') AS w FROM documents)""",
)
def t2(spark, sf):
    last = vectors.token_vector("tokens", "mask", -1)
    first = vectors.token_vector("tokens", "mask", 0)
    return padded_tokens(spark, sf).select(
        "doc_id",
        last[0].cast("bigint").alias("last_length"),
        last[1].cast("bigint").alias("last_place"),
        first[0].cast("bigint").alias("first_length"),
    )


@query(
    "t3_masked_tokens",
    """SELECT doc_id, len(str_split(text, ' ')) + doc_id % 3 AS tokens, doc_id % 3 AS masked
FROM documents""",
)
def t3(spark, sf):
    masked = vectors.masked_tokens("tokens", "mask")
    low = F.filter(masked, lambda v: F.forall(v, lambda x: x == float("-inf")))
    return padded_tokens(spark, sf).select(
        "doc_id", F.size(masked).cast("bigint").alias("tokens"),
        F.size(low).cast("bigint").alias("masked"),
    )


_WORDS = "SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, str_split(text, ' ') AS w FROM documents)"


def _answer_tokens(spark, sf):
    """Values for every token of a document; the answer tokens are those that end a sentence."""
    words = fx.documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token")
    )
    value = F.length("token") * F.lit(0.25) + F.col("pos") * F.lit(0.125)
    values = words.withColumn("value", value).withColumn("pos", F.col("pos") - 1)
    answers = words.filter(F.col("token").endswith("."))
    return values, answers


@query(
    "t4_answer_tokens",
    f"""SELECT doc_id, round(avg(length(token) * 0.25e0 + pos * 0.125e0), 6) AS logit
FROM ({_WORDS}) WHERE token LIKE '%.' GROUP BY 1""",
)
def t4(spark, sf):
    values, answers = _answer_tokens(spark, sf)
    return vectors.answer_logits(values, answers, ["doc_id"]).select("doc_id", r6("logit"))


@query(
    "a22_answer_logit_mean",
    f"""SELECT doc_id, round(avg(length(token) * 0.25e0), 6) AS logit
FROM ({_WORDS}) GROUP BY 1""",
)
def a22(spark, sf):
    """Every token is an answer token and is read at its own place."""
    values, _ = _answer_tokens(spark, sf)
    own = values.withColumn("value", F.length("token") * F.lit(0.25))
    answers = own.select("doc_id", "pos", "token")
    return vectors.answer_logits(own, answers, ["doc_id"], left_to_right=False).select(
        "doc_id", r6("logit")
    )


@query(
    "t5_layer_slice",
    "SELECT layer, variant, count(*) AS rows, round(sum(CAST(CAST(x AS FLOAT) AS DOUBLE)), 5) AS total "
    "FROM st GROUP BY ALL",
    "st",
)
def t5(spark, sf):
    """States written by layer; each layer is read back from its own partition."""
    from premisa.sources.staging import new_path

    path = new_path(spark, "states")
    fx.states(spark, sf).write.partitionBy("layer").parquet(path)
    stored = spark.read.parquet(path)
    out = None
    for layer in (1, 2, 3, 4):
        rows = vectors.ingest_states([stored], layer).select(
            "layer", "variant", F.explode("vec").alias("x")
        )
        part = rows.groupBy("layer", "variant").agg(
            F.count("*").alias("rows"), F.round(F.sum("x"), 5).alias("total")
        )
        out = part if out is None else out.unionByName(part)
    return out


_PAIR = """SELECT variant, layer, sample_id, i, max(x) FILTER (side = 0) AS x0,
  max(x) FILTER (side = 1) AS x1 FROM st GROUP BY ALL"""


def _combination_query(name: str, kind: str, sql: str) -> None:
    @query(
        name,
        f"SELECT variant, layer, sample_id, i, round({sql}, 6) AS value FROM ({_PAIR})",
        "st",
    )
    def run(spark, sf):
        pairs = vectors.side_combination(vectors.sides(fx.states(spark, sf)), kind)
        return long_vector(pairs, ["variant", "layer", "sample_id"])


_combination_query("t6_neg_minus_pos", "neg-pos", "x0 - x1")
_combination_query("t6_neg_plus_pos", "neg+pos", "x0 + x1")
_combination_query("j14_pos_minus_neg", "pos-neg", "x1 - x0")


@query(
    "j13_label_gather",
    """SELECT variant, layer, sample_id, i, round(max(x) FILTER (side = y)
  - max(x) FILTER (side = 1 - y), 6) AS value FROM st GROUP BY ALL""",
    "st",
)
def j13(spark, sf):
    states = fx.states(spark, sf)
    keys = ["dataset", "model", "variant", "layer", "sample_id"]
    right = vectors.true_side(states).select(*keys, F.col("vec").alias("a"))
    wrong = vectors.false_side(states).select(*keys, F.col("vec").alias("b"))
    both = right.join(wrong, keys).withColumn("vec", minus("a", "b"))
    return long_vector(both, ["variant", "layer", "sample_id"])


@query(
    "t8_quarantine",
    "SELECT 'clean' AS part, count(DISTINCT (variant, layer, sample_id, side)) AS rows FROM st",
    "st",
)
def t8(spark, sf):
    clean, bad = vectors.split_clean(fx.states(spark, sf))
    both = clean.withColumn("part", F.lit("clean")).unionByName(
        bad.withColumn("part", F.lit("quarantine"))
    )
    return both.groupBy("part").agg(F.count("*").alias("rows"))


_BAD_SIDE = "sample_id % 5 = 0 AND side = sample_id // 5 % 2"


@query(
    "t8_quarantine_then_pairs",
    f"""SELECT variant, layer, count(*) FILTER (NOT bad) AS clean, count(*) FILTER (bad) AS quarantine,
  count(DISTINCT sample_id) FILTER (whole) AS pairs
FROM (SELECT variant, layer, sample_id, side, {_BAD_SIDE} AS bad,
    sample_id % 5 <> 0 AND count(*) OVER (PARTITION BY variant, layer, sample_id) = 2 AS whole
  FROM (SELECT DISTINCT variant, layer, sample_id, side FROM st)) GROUP BY ALL""",
    "st",
)
def t8_pairs(spark, sf):
    """A NaN, an unknown number or no vector at all in one side of every fifth sample: that side is set aside
    and the sample makes no pair."""
    hurt = F.col("sample_id") % 3
    number = F.when(hurt == 0, F.lit(float("nan")))  # NULL otherwise
    broken = F.when(hurt < 2, F.transform("vec", lambda x, i: F.when(i == 3, number).otherwise(x)))
    vec = F.when(F.expr(_BAD_SIDE.replace("sample_id // 5", "sample_id div 5")), broken).otherwise(F.col("vec"))
    clean, bad = vectors.split_clean(fx.states(spark, sf).withColumn("vec", vec))
    keys = ["variant", "layer"]
    counts = clean.groupBy(*keys).agg(F.count("*").alias("clean"))
    counts = counts.join(bad.groupBy(*keys).agg(F.count("*").alias("quarantine")), keys)
    return counts.join(vectors.sides(clean).groupBy(*keys).agg(F.count("*").alias("pairs")), keys)


@query(
    "f19_nan_guard",
    """SELECT o_orderkey AS id, false AS before, o_totalprice > 400000 AS after FROM orders""",
)
def f19(spark, sf):
    """A vector per order, one number of which is made NaN for the dear ones."""
    price = F.col("o_totalprice")
    vec = F.array(price, F.when(price > 400000, F.lit(float("nan"))).otherwise(price))
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        has_nan(F.array(price)).alias("before"),
        has_nan(vec).alias("after"),
    )


@query(
    "f18_finite",
    """SELECT count(*) AS rows, CAST(sum(CAST(isfinite(q) AS INT)) AS BIGINT) AS finite
FROM (SELECT o_totalprice / (o_custkey % 2) AS q FROM orders)""",
)
def f18(spark, sf):
    from premisa.functions.exprs import safe_div

    q = safe_div(F.col("o_totalprice"), (F.col("o_custkey") % 2).cast("double"))
    rows = fx.table(spark, sf, "orders").withColumn("q", q)
    return rows.agg(
        F.count("*").alias("rows"), F.sum(is_finite("q").cast("int")).alias("finite")
    )


# --- scalar vector functions ---------------------------------------------------------------

_PAIRED = """SELECT n.vec_id // 2 AS sample_id, CAST(n.embedding AS DOUBLE[]) AS a,
  CAST(p.embedding AS DOUBLE[]) AS b FROM embeddings n JOIN embeddings p ON p.vec_id = n.vec_id + 1
WHERE n.vec_id % 2 = 0"""


def paired(spark, sf) -> DataFrame:
    rows = fx.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("sample_id"),
        (F.col("vec_id") % 2).alias("side"),
        doubles("embedding").alias("vec"),
    )
    a = rows.filter("side = 0").select("sample_id", F.col("vec").alias("a"))
    return a.join(rows.filter("side = 1").select("sample_id", F.col("vec").alias("b")), "sample_id")


@query("f1_dot", f"SELECT sample_id, round(list_dot_product(a, b), 6) AS value FROM ({_PAIRED})")
def f1(spark, sf):
    return paired(spark, sf).select("sample_id", r6(dot("a", "b"), "value"))


@query(
    "f2_unit",
    f"""SELECT sample_id, unnest(range(len(a))) AS i, round(unnest(list_transform(a,
  lambda x: x / sqrt(list_dot_product(a, a)))), 6) AS value FROM ({_PAIRED})""",
)
def f2(spark, sf):
    return long_vector(paired(spark, sf).withColumn("u", unit("a")), ["sample_id"], "u")


@query(
    "f3_sigmoid",
    f"SELECT sample_id, round(1e0 / (1e0 + exp(-list_dot_product(a, b))), 6) AS value FROM ({_PAIRED})",
)
def f3(spark, sf):
    return paired(spark, sf).select("sample_id", r6(sigmoid(dot("a", "b")), "value"))


@query(
    "f4_clamped_logit",
    """SELECT o_orderkey AS id, round(ln(q / (1 - q)), 6) AS value
FROM (SELECT o_orderkey, least(greatest(o_totalprice / 400000e0, 1e-6), 1 - 1e-6) AS q FROM orders)""",
)
def f4(spark, sf):
    p = F.col("o_totalprice") / F.lit(400000.0)
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), r6(logit(p), "value")
    )


@query(
    "f5_pair_probability",
    f"""SELECT sample_id, round((1e0 / (1e0 + exp(-b[1])) + 1e0 - 1e0 / (1e0 + exp(-a[1]))) / 2e0, 6)
  AS value FROM ({_PAIRED})""",
)
def f5(spark, sf):
    from premisa.functions.exprs import pair_probability

    p = pair_probability(sigmoid(F.col("a")[0]), sigmoid(F.col("b")[0]))
    return paired(spark, sf).select("sample_id", r6(p, "value"))


@query("f6_cosine", f"SELECT sample_id, round(list_cosine_similarity(a, b), 6) AS value FROM ({_PAIRED})")
def f6(spark, sf):
    from premisa.functions.exprs import cosine

    return paired(spark, sf).select("sample_id", r6(cosine("a", "b"), "value"))


@query(
    "f7_signed_scale",
    """SELECT vec_id, unnest(range(len(v))) AS i, round(unnest(list_transform(v,
  lambda x: x * CASE WHEN label % 2 = 0 THEN -1 ELSE 1 END)), 6) AS value
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
)
def f7(spark, sf):
    sign = F.when(F.col("label") % 2 == 0, -1.0).otherwise(1.0)
    df = fx.table(spark, sf, "embeddings").withColumn("v", scaled(doubles("embedding"), sign))
    return long_vector(df, ["vec_id"], "v")


@query(
    "f11_sign",
    f"SELECT sample_id, CAST(sign(list_dot_product(a, b)) AS INT) AS value FROM ({_PAIRED})",
)
def f11(spark, sf):
    value = F.signum(dot("a", "b")).cast("int")
    return paired(spark, sf).select("sample_id", value.alias("value"))


@query(
    "f14_multi_explode",
    f"SELECT sample_id, unnest(range(len(a))) AS i, round(unnest(a), 6) AS a, round(unnest(b), 6) AS b "
    f"FROM ({_PAIRED})",
)
def f14(spark, sf):
    rows = paired(spark, sf).select("sample_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z"))
    return rows.select("sample_id", "i", r6(F.col("z.a"), "a"), r6(F.col("z.b"), "b"))


@query(
    "f15_float_lists",
    """SELECT o_orderkey AS id, round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 2) AS value
FROM orders""",
)
def f15(spark, sf):
    vec = doubles(F.array("o_totalprice"), through_float=True)
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.round(vec[0], 2).alias("value")
    )


@query(
    "f17_boolean_labels",
    "SELECT sample_id, bool_or(y = 1 AND side = 0) AS label FROM st GROUP BY 1",
    "st",
)
def f17(spark, sf):
    flags = F.array(F.col("y"), F.lit(0)).cast("array<boolean>")
    return fx.states(spark, sf).filter("side = 0").groupBy("sample_id").agg(
        F.bool_or(flags[0]).alias("label")
    )


# --- statistics ----------------------------------------------------------------------------


@query(
    "a1_vector_mean",
    """SELECT variant, layer, split, side, i, round(avg(x) FILTER (isfinite(x)), 6) AS value
FROM sp GROUP BY ALL""",
    "sp",
)
def a1(spark, sf):
    stats = vectors.vector_stats(split_states(spark, sf), [*RUN, "split", "side"])
    return long_vector(stats, ["variant", "layer", "split", "side"], "mean")


@query(
    "a2_vector_std",
    "SELECT variant, layer, split, side, i, round(stddev_samp(x), 6) AS value FROM sp GROUP BY ALL",
    "sp",
)
def a2(spark, sf):
    stats = vectors.vector_stats(split_states(spark, sf), [*RUN, "split", "side"], std=True)
    return long_vector(stats, ["variant", "layer", "split", "side"], "std")


@query(
    "a3_mean_difference",
    """SELECT variant, layer, i, round(avg(x) FILTER (side = y) - avg(x) FILTER (side = 1 - y), 6)
  AS value FROM st GROUP BY ALL""",
    "st",
)
def a3(spark, sf):
    df = vectors.mean_difference(fx.states(spark, sf), RUN)
    return long_vector(df, ["variant", "layer"], "direction")


@query(
    "a4_difference_length",
    """SELECT variant, layer, round(sqrt(sum(d * d)), 6) AS length FROM (
  SELECT variant, layer, i, avg(x) FILTER (side = y) - avg(x) FILTER (side = 1 - y) AS d
  FROM st GROUP BY ALL) GROUP BY ALL""",
    "st",
)
def a4(spark, sf):
    df = vectors.mean_difference(fx.states(spark, sf), RUN)
    return df.select("variant", "layer", r6("length"))


@query(
    "a5_class_covariance",
    """SELECT variant, layer, a.i AS i, b.i AS j, round(sum(a.x * b.x) / (count(*) - 1), 6) AS value
FROM c a JOIN c b USING (variant, layer, sample_id, side) GROUP BY ALL""".replace(
        "FROM c a JOIN c b",
        "FROM (SELECT * REPLACE (x - avg(x) OVER (PARTITION BY variant, layer, side = y, i) AS x) "
        "FROM st) a JOIN (SELECT * REPLACE (x - avg(x) OVER (PARTITION BY variant, layer, side = y, "
        "i) AS x) FROM st) b",
    ),
    "st",
)
def a5(spark, sf):
    cov = vectors.class_covariance(fx.states(spark, sf), RUN)
    return cov.select("variant", "layer", "i", F.posexplode("row").alias("j", "_x")).select(
        "variant", "layer", "i", "j", r6("_x", "value")
    )


_MATRICES = "(VALUES ('neg'), ('pos'), ('neg+pos'), ('neg-pos')) AS f(matrix)"


@query(
    "a24_matrix_rank",
    f"""SELECT dataset, model, variant, layer, matrix,
  CAST(least(16, count(DISTINCT sample_id)) AS INT) AS rank FROM st, {_MATRICES} GROUP BY ALL""",
    "st",
)
def a24(spark, sf):
    """The vectors are in general position, so their rank is their width or their number."""
    return vectors.matrix_ranks(fx.states(spark, sf), RUN)


@query(
    "d4_rank_report",
    f"""SELECT layer, matrix, min(rank) AS lowest, max(rank) AS highest FROM (
  SELECT variant, layer, matrix, CAST(least(4 + vi % 3, count(DISTINCT sample_id)) AS INT) AS rank
  FROM st JOIN {VARIANT_LIST} USING (variant), {_MATRICES}
  GROUP BY variant, layer, matrix, vi) GROUP BY ALL""",
    "st",
)
def d4(spark, sf):
    """Vectors of known rank: the first 4, 5 or 6 numbers, by variant, repeated with a factor."""
    width = F.lit(0)
    for i, v in enumerate(VARIANTS):
        width = F.when(F.col("variant") == v, F.lit(4 + i % 3)).otherwise(width)
    rows = fx.states(spark, sf).withColumn("_w", width)
    vec = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.get("vec", i % F.col("_w")) * (1 + F.floor(i / F.col("_w"))),
    )
    ranks = vectors.matrix_ranks(rows.withColumn("vec", vec).drop("_w"), RUN)
    return ranks.groupBy("layer", "matrix").agg(
        F.min("rank").alias("lowest"), F.max("rank").alias("highest")
    )


# --- preparation ---------------------------------------------------------------------------


@query(
    "w5_half_split",
    "SELECT DISTINCT variant, layer, sample_id, split FROM sp",
    "sp",
)
def w5(spark, sf):
    samples = fx.states(spark, sf).filter("side = 0").select(*RUN, "sample_id")
    return vectors.split_of(samples, RUN).select("variant", "layer", "sample_id", "split")


@query(
    "d1_create_splits",
    """SELECT layer, variant, split, side, count(DISTINCT sample_id) AS samples,
  round(sum(x), 5) AS total FROM sp WHERE layer = 2 GROUP BY ALL""",
    "sp",
)
def d1(spark, sf):
    rows = vectors.half_split(fx.states(spark, sf).filter("layer = 2"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy("layer", "variant", "split", "side").agg(
        F.count("*").alias("samples"), F.round(F.sum(total), 5).alias("total")
    )


_SIDE = ["variant", "layer", "split", "sample_id", "side"]


@query(
    "d2_center",
    "SELECT variant, layer, split, sample_id, side, i, round(x, 6) AS value FROM cen",
    "cen",
)
def d2(spark, sf):
    return long_vector(vectors.center(split_states(spark, sf)), _SIDE)


@query(
    "d2_center_scale",
    """SELECT variant, layer, split, sample_id, side, i, round(x / stddev_samp(x) OVER
  (PARTITION BY variant, layer, split, side, i), 6) AS value FROM cen""",
    "cen",
)
def d2_scale(spark, sf):
    return long_vector(vectors.center(split_states(spark, sf), scale=True), _SIDE)


@query(
    "d2_center_on_train",
    """SELECT variant, layer, split, sample_id, side, i, round(x - avg(x) FILTER (split = 'train')
  OVER (PARTITION BY variant, layer, side, i), 6) AS value FROM sp""",
    "sp",
)
def d2_train(spark, sf):
    return long_vector(vectors.center(split_states(spark, sf), fit_on="train"), _SIDE)


QUOTAS = {
    "original_pos_prem": (50, True),
    "original_neg_prem": (50, False),
    "shuffle_pos_prem": (15, True),
    "shuffle_neg_prem": (15, True),
    "random_pos_prem": (15, True),
    "random_neg_prem": (15, True),
    "no_prem": (40, True),
}
_QUOTA_ROWS = ", ".join(f"('{v}', {n}, {k})" for v, (n, k) in QUOTAS.items())
_DRAWN = f"""SELECT s.*, q.keep FROM (SELECT DISTINCT layer, variant, sample_id FROM sp
  WHERE split = 'train') s JOIN (VALUES {_QUOTA_ROWS}) AS q(variant, n, keep) USING (variant)
QUALIFY row_number() OVER (PARTITION BY layer, variant
  ORDER BY md5('0:' || variant || ':' || sample_id)) <= n"""


@query("w6_quota_sample", f"SELECT layer, variant, sample_id FROM ({_DRAWN})", "sp")
def w6(spark, sf):
    samples = split_states(spark, sf).filter("split = 'train' and side = 0")
    drawn = vectors.quota_sample(
        samples, ["dataset", "model", "layer"], "variant",
        {v: n for v, (n, _) in QUOTAS.items()}, ["sample_id"], 0,
    )
    return drawn.select("layer", "variant", "sample_id")


@query(
    "d3_combine_train_data",
    f"""SELECT layer, variant, side, count(DISTINCT d.sample_id) AS samples,
  count(y) FILTER (keep) AS labelled, round(sum(x), 5) AS total
FROM sp JOIN ({_DRAWN}) d USING (layer, variant, sample_id) GROUP BY ALL""",
    "sp",
)
def d3(spark, sf):
    mixed = vectors.combine(split_states(spark, sf), QUOTAS)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return mixed.groupBy("layer", "variant", "side").agg(
        F.count("*").alias("samples"),
        (F.count("y") * 16).alias("labelled"),
        F.round(F.sum(total), 5).alias("total"),
    )


# --- probes and scores ---------------------------------------------------------------------


@query(
    "m1_mass_mean",
    "SELECT layer, train_variant, i, round(d, 6) AS value FROM mm",
    "mm",
)
def m1(spark, sf):
    probes = mean_probes(centred(spark, sf))
    return long_vector(probes, ["layer", "train_variant"], "direction")


@query(
    "j11_probe_by_variant",
    "SELECT layer, train_variant, variant, split, count(*) AS samples FROM eligible GROUP BY ALL",
    "eligible",
)
def j11(spark, sf):
    states = centred(spark, sf)
    scores = score.pair_scores(vectors.sides(states), mean_probes(states))
    return scores.groupBy("layer", "train_variant", "variant", "split").agg(
        F.count("*").alias("samples")
    )


@query(
    "e1_score",
    """SELECT layer, train_variant, variant, split, sample_id, round(p, 6) AS p FROM eligible""",
    "eligible",
)
def e1(spark, sf):
    states = centred(spark, sf)
    scores = score.pair_scores(vectors.sides(states), mean_probes(states))
    return scores.select("layer", "train_variant", "variant", "split", "sample_id", r6("p"))


@query(
    "e1_accuracy",
    """SELECT layer, train_variant, variant, split,
  round(avg(CAST((p > 0.5) = (y = 1) AS INT)), 6) AS accuracy FROM eligible GROUP BY ALL""",
    "eligible",
)
def e1_accuracy(spark, sf):
    states = centred(spark, sf)
    scores = score.pair_scores(vectors.sides(states), mean_probes(states))
    return scores.groupBy("layer", "train_variant", "variant", "split").agg(
        r6(score.accuracy(), "accuracy")
    )


def _calibration_scores(spark, sf) -> DataFrame:
    states = centred(spark, sf)
    without = states.filter("split = 'train' and variant = 'no_prem'")
    return score.pair_scores(vectors.sides(without), mean_probes(states), any_variant=True)


@query(
    "j12_calibration_lookup",
    """SELECT layer, train_variant, count(*) AS samples, round(avg(p), 6) AS mean
FROM scored WHERE variant = 'no_prem' AND split = 'train' GROUP BY ALL""",
    "scored",
)
def j12(spark, sf):
    return _calibration_scores(spark, sf).groupBy("layer", "train_variant").agg(
        F.count("*").alias("samples"), r6(F.avg("p"), "mean")
    )


@query(
    "a7_logit_std",
    """SELECT layer, train_variant, round(stddev_samp(lg), 6) AS std FROM lgs
WHERE variant = 'no_prem' AND split = 'train' GROUP BY ALL""",
    "lgs",
)
def a7(spark, sf):
    return _calibration_scores(spark, sf).groupBy("layer", "train_variant").agg(
        r6(F.stddev_samp(logit("p")), "std")
    )


@query("e2_scale", "SELECT layer, train_variant, round(scale, 6) AS scale FROM scales", "scales")
def e2(spark, sf):
    found = score.logit_scale(_calibration_scores(spark, sf))
    return found.select("layer", "train_variant", r6("scale"))


@query(
    "e3_sign_by_accuracy",
    """SELECT layer, train_variant, CASE WHEN avg(CAST((p > 0.5) = (y = 1) AS INT)) < 0.5
  THEN -1 ELSE 1 END AS sign FROM scored
WHERE variant = train_variant AND split = 'train' GROUP BY ALL""",
    "scored",
)
def e3(spark, sf):
    states = centred(spark, sf).filter("split = 'train'")
    probes = mean_probes(states)
    own = score.pair_scores(vectors.sides(states), probes).filter("variant = train_variant")
    found = score.sign_by_accuracy(own)
    return found.select("layer", "train_variant", F.col("sign_by_accuracy").alias("sign"))


@query(
    "e4_length",
    "SELECT layer, train_variant, round(length, 6) AS length FROM mm_len",
    "mm_len",
)
def e4(spark, sf):
    df = vectors.mean_difference(train_rows(centred(spark, sf)), KEYS)
    return df.select("layer", "train_variant", r6("length"))


# variants whose probe is turned round, so that both signs are met
_TURNED = VARIANTS[1::2]
_TURNED_SQL = "(" + ", ".join(f"'{v}'" for v in _TURNED) + ")"


def turned(probes: DataFrame) -> DataFrame:
    """Every second variant's direction turned round; the calibration must turn it back."""
    back = F.transform("direction", lambda x: -x)
    other = F.when(F.col("train_variant").isin(_TURNED), back).otherwise(F.col("direction"))
    return settle(probes.withColumn("direction", other), "turned")


def _fixed_probes(states: DataFrame) -> DataFrame:
    """The no-premise mean difference as the direction of every training set."""
    probes = mean_probes(states)
    fixed = probes.filter("train_variant = 'no_prem'").drop("train_variant")
    each = F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("train_variant")
    return settle(fixed.select("*", each), "fixed-probes")


@query(
    "e5_sign",
    f"""SELECT a.layer, a.train_variant, CAST(sign(sum(a.d * b.d)) AS INT)
  * CASE WHEN a.train_variant IN {_TURNED_SQL} THEN -1 ELSE 1 END AS sign
FROM mm a JOIN mm b ON a.layer = b.layer AND a.i = b.i AND b.train_variant = 'no_prem'
GROUP BY a.layer, a.train_variant""",
    "mm",
)
def e5(spark, sf):
    states = centred(spark, sf)
    probes = calibrated_probes(states, turned(_fixed_probes(states)))
    return probes.select("layer", "train_variant", "sign")


_CALIBRATED = """SELECT layer, train_variant, variant, sample_id, y,
  1e0 / (1e0 + exp(-(lg * scale))) AS prediction
FROM lgs JOIN scales USING (layer, train_variant)
WHERE split = 'eval' AND (train_variant IN ('original_pos_prem', 'no_prem')
  OR train_variant = variant)"""


@query(
    "e6_calibrate_logits",
    f"SELECT layer, train_variant, variant, round(avg(ln(prediction / (1 - prediction))), 6) AS logit "
    f"FROM ({_CALIBRATED}) GROUP BY ALL",
    "lgs scales",
)
def e6(spark, sf):
    states = centred(spark, sf)
    probes = calibrated_probes(states, turned(mean_probes(states)))
    predicted = score.evaluate(states, probes)
    p = F.col("prediction")
    return predicted.groupBy("layer", "train_variant", "variant").agg(
        r6(F.avg(F.ln(p / (1 - p))), "logit")
    )


@query(
    "e7_calibrated",
    "SELECT layer, train_variant, variant, sample_id, y, round(prediction, 6) AS prediction "
    f"FROM ({_CALIBRATED})",
    "lgs scales",
)
def e7(spark, sf):
    states = centred(spark, sf)
    probes = calibrated_probes(states, turned(mean_probes(states)))
    return score.evaluate(states, probes).select(
        "layer", "train_variant", "variant", "sample_id", "y", r6("prediction")
    )


@query(
    "e8_train_probes",
    f"""SELECT s.layer, s.train_variant, CASE WHEN s.train_variant IN {_TURNED_SQL} THEN -1 ELSE 1 END
  AS sign, round(scale, 6) AS scale, round(length, 6) AS length
FROM scales s JOIN mm_len USING (layer, train_variant)""",
    "scales mm_len",
)
def e8(spark, sf):
    states = centred(spark, sf)
    probes = calibrated_probes(states, turned(mean_probes(states)))
    return probes.select("layer", "train_variant", "sign", r6("scale"), r6("length"))


@query(
    "e8_metadata",
    """SELECT layer, train_variant, 'mass_mean' AS method,
  'emb-' || train_variant || '|m1|layer' || layer || '|train|mass_mean' AS step, count(*) AS width
FROM mm GROUP BY ALL""",
    "mm",
)
def e8_metadata(spark, sf):
    probes = mean_probes(centred(spark, sf))
    step = F.concat_ws(
        "|", F.concat_ws("-", "dataset", "train_variant"), "model",
        F.concat(F.lit("layer"), F.col("layer").cast("string")), F.lit("train"), "method",
    )
    return probes.select(
        "layer", "train_variant", "method", step.alias("step"), F.size("direction").alias("width")
    )


# --- steering ------------------------------------------------------------------------------

_UNIT = """SELECT layer, i, -1 * d / length * length AS shift FROM mm JOIN mm_len
USING (train_variant, layer) WHERE train_variant = 'original_pos_prem'"""


def _steer_query(name: str, on_answer: bool, on_period: bool, flag: str) -> None:
    @query(
        name,
        f"""SELECT variant, layer, split, sample_id, side, i,
  round(x + CASE WHEN {flag} THEN shift ELSE 0 END, 6) AS value
FROM cen JOIN ({_UNIT}) u USING (layer, i)""",
        "cen mm mm_len",
    )
    def run(spark, sf):
        states = centred(spark, sf)
        probes = calibrated_probes(states, mean_probes(states)).filter(
            "train_variant = 'original_pos_prem'"
        )
        flagged = states.withColumn("is_answer", F.col("y") == 1).withColumn(
            "is_period", F.col("side") == 1
        )
        moved = vectors.steer(flagged, probes, -1, on_answer, on_period)
        return long_vector(moved, _SIDE)


_steer_query("t7_steer_answer", True, False, "y = 1")
_steer_query("t7_steer_answer_and_period", True, True, "y = 1 OR side = 1")


# --- logit baseline ------------------------------------------------------------------------

_LP = """SELECT variant, sample_id, y, max(logit) FILTER (side = 0) AS neg,
  max(logit) FILTER (side = 1) AS pos FROM lgt GROUP BY ALL"""


@query(
    "m9_logit_baseline",
    f"""SELECT variant, sample_id, y, round(0.5e0 + 0.5e0 * d / greatest(-min(d) OVER w,
  max(d) OVER w), 6) AS p FROM (SELECT *, pos - neg AS d FROM ({_LP}))
WINDOW w AS (PARTITION BY variant)""",
    "lgt",
)
def m9(spark, sf):
    df = score.logit_baseline(fx.logits(spark, sf), ["dataset", "model", "variant"], False)
    return df.select("variant", "sample_id", "y", r6("p"))


@query(
    "m9_logit_baseline_calibrated",
    f"""SELECT variant, sample_id, y, round(0.5e0 + 0.5e0 * d / greatest(-min(d) OVER w,
  max(d) OVER w), 6) AS p FROM (SELECT *, pos - (neg - m) AS d
  FROM (SELECT *, median(neg - pos) OVER (PARTITION BY variant) AS m FROM ({_LP})))
WINDOW w AS (PARTITION BY variant)""",
    "lgt",
)
def m9_calibrated(spark, sf):
    df = score.logit_baseline(fx.logits(spark, sf), ["dataset", "model", "variant"], True)
    return df.select("variant", "sample_id", "y", r6("p"))


_BASE = f"""SELECT variant, split, sample_id, y, 0.5e0 + 0.5e0 * d / greatest(-min(d) OVER w,
  max(d) OVER w) AS p FROM (SELECT *, pos - (neg - m) AS d
  FROM (SELECT *, median(neg - pos) OVER (PARTITION BY variant, split) AS m
        FROM ({_LP}) JOIN halves USING (sample_id)))
WINDOW w AS (PARTITION BY variant, split)"""


@query(
    "m9_logit_baseline_evaluated",
    f"""SELECT t.train_variant, e.variant, e.sample_id, e.y,
  round(1e0 / (1e0 + exp(-(t.sign * t.scale * ln(q / (1 - q))))), 6) AS prediction
FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM ({_BASE}) WHERE split = 'eval') e
JOIN (SELECT variant AS train_variant, CASE WHEN avg(CAST((p > 0.5) = (y = 1) AS INT)) < 0.5
    THEN -1 ELSE 1 END AS sign, (SELECT ln(0.75e0 / 0.25e0) / stddev_samp(ln(q / (1 - q)))
    FROM (SELECT least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM ({_BASE})
      WHERE split = 'train' AND variant = 'no_prem')) AS scale
  FROM ({_BASE}) WHERE split = 'train' GROUP BY 1) t
ON t.train_variant IN ('original_pos_prem', 'no_prem') OR t.train_variant = e.variant""",
    "lgt halves",
)
def m9_evaluated(spark, sf):
    split = vectors.half_split(fx.logits(spark, sf))
    return score.evaluate_logit_baseline(split).select(
        "train_variant", "variant", "sample_id", "y", r6("prediction")
    )


@query(
    "a21_extent",
    f"""SELECT variant, round(greatest(-min(pos - neg), max(pos - neg)), 6) AS extent
FROM ({_LP}) GROUP BY 1""",
    "lgt",
)
def a21(spark, sf):
    side = F.when(F.col("side") == 1, F.col("logit")).otherwise(-F.col("logit"))
    gaps = fx.logits(spark, sf).groupBy("variant", "sample_id").agg(F.sum(side).alias("d"))
    return gaps.groupBy("variant").agg(
        r6(F.greatest(-F.min("d"), F.max("d")), "extent")
    )


@query(
    "a8_gap_median",
    f"SELECT variant, count(*) AS n, round(median(neg - pos), 6) AS median FROM ({_LP}) GROUP BY 1",
    "lgt",
)
def a8_gap(spark, sf):
    side = F.when(F.col("side") == 0, F.col("logit")).otherwise(-F.col("logit"))
    gaps = fx.logits(spark, sf).groupBy("variant", "sample_id").agg(F.sum(side).alias("d"))
    stats = order_statistics(gaps, ["variant"], "d", {"median": 0.5})
    return stats.select("variant", "n", r6("median"))


