"""The queries of this folder and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premisa.llm import (
    bloom_lm,
    chaining,
    fuzzy_lines,
    packing,
    repetition,
    residue_mining,
    setsketch,
    spectral_whitening,
    suffix_dedup,
    toxicity,
    trie_counts,
    wrapper,
)
from premisa.llm import decontaminate as dc
from premisa.llm.common import remainder, session, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf: function(session(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query(
    "op1_decontaminate",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    b AS (
      SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    wins AS (
      SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
      FROM (SELECT item_id, w, least(len(w), 13) AS n,
              unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i
            FROM b WHERE len(w) > 0)),
    grams AS (
      SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
      FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
            FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
    hits AS (SELECT r, i, n, item_id FROM grams JOIN wins USING (n, x)),
    places AS (
      SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
    found AS (
      SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
    """,
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    marked = dc.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.array_sort(
        F.transform(F.col("shared.items"), lambda x: x["item_id"].cast("string"))
    )
    return marked.select(
        "doc_id",
        "shared.n_words",
        "shared.n_hit",
        F.size("shared.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        dc.contaminated().alias("contaminated"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.learn(docs, labels, remainder("doc_id", 5) == 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.sentences").alias("n_offending"),
    )


@query(
    "op4_quality_rules",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    grams AS (
      SELECT r, n, i, hash(w[i:i + n - 1]) AS x
      FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
            FROM d, (VALUES (3), (10), (101)) AS v(n) WHERE len(w) >= n)),
    twice AS (
      SELECT r, n, i FROM grams
      JOIN (SELECT r, n, x FROM grams GROUP BY ALL HAVING count(*) > 1) USING (r, n, x)),
    inside AS (
      SELECT r, n, count(DISTINCT p) AS k
      FROM (SELECT r, n, unnest(generate_series(i, i + n - 1)) AS p FROM twice) GROUP BY r, n),
    dup AS (
      SELECT r, sum(k - 1) AS k
      FROM (SELECT r, l, count(*) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
            WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l)
      GROUP BY r),
    m AS (
      SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))
        AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dup.k, 0) AS n_dup_lines, coalesce(a.k, 0) AS n_repeat_words,
        coalesce(b.k, 0) AS covered, coalesce(c.k, 0) AS long
      FROM d LEFT JOIN dup USING (r)
      LEFT JOIN (FROM inside WHERE n = 3) a USING (r)
      LEFT JOIN (FROM inside WHERE n = 10) b USING (r)
      LEFT JOIN (FROM inside WHERE n = 101) c USING (r)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
      n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
      n_repeat_words::BIGINT AS n_repeat_words, base_failed,
      NOT base_failed AND covered <= 0.4 * n_words AND long = 0 AS kept
    FROM f
    """,
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    judged = repetition.quality_rules(table(spark, sf, "documents").select("doc_id", "text"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields += ["base_failed", "kept"]
    return judged.select("doc_id", *(f"quality_rules.{f}" for f in fields))


@query("op5_main_text")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return wrapper.main_text(pages, into="text").select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


@query("op9_pack")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query(
    "op6_near_duplicates",
    r"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    s AS (
      SELECT DISTINCT r, array_to_string(w[i:i + k - 1], ' ') AS x
      FROM (SELECT r, w, least(len(w), 5) AS k,
              unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i
            FROM d WHERE len(w) > 0)),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    shared AS (
      SELECT a.r AS a, b.r AS b, count(*) AS i
      FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
    links AS (
      SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b
      WHERE 100 * i >= 75 * (na.n + nb.n - i)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (
      SELECT r, r AS t FROM d
      UNION
      SELECT reach.r, b AS t FROM reach JOIN both_ways ON a = reach.t),
    c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = t GROUP BY reach.r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM d JOIN c USING (r) LEFT JOIN n USING (r)
    """,
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf, "documents"))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = fuzzy_lines.dedupe_lines(docs, width=fuzzy_lines.SHORT, every=True)
    return marked.select(
        "doc_id",
        "lines.n_lines",
        F.size("lines.dropped").cast("bigint").alias("n_dropped"),
        F.array_join(F.col("lines.dropped").cast("array<string>"), ",").alias("dropped"),
    )


@query("op2_lm_score")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model, counts = bloom_lm.learn(docs, remainder("doc_id", 7) != 2)
    return bloom_lm.score(docs, model, counts).select(
        "doc_id",
        (remainder("doc_id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    counted = trie_counts.token_counts(table(spark, sf, "documents").select("doc_id", "text"))
    fields = ["n_words", "n_tokens", "max_word_tokens"]
    return counted.select("doc_id", *(f"token_counts.{f}" for f in fields))


@query("op8_repeated_passages")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf, "documents"))


@query(
    "op11_hard_negatives",
    r"""
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (
      SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
        list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
    p AS (
      SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, br) <= 5),
    n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
        s.score AS negative_score, row_number() OVER (
          PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
      FROM p JOIN s ON s.ar = p.ar AND NOT s.same
        AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 3
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return residue_mining.hard_negatives(rows, F.col("id") % 50 == 0)


@query("op12_whiten")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    whitened = spectral_whitening.whiten(table(spark, sf, "embeddings"))
    return whitened.withColumn("deviation", F.col("deviation").cast("bigint"))


@query(
    "op13_repeated_bytes",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x,
        octet_length(encode(coalesce(text, ''))) AS n
      FROM documents),
    w AS (
      SELECT r, i, md5(array_slice(x, i + 1, i + 200)) AS m
      FROM (SELECT r, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
    twice AS (SELECT r, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
    cut AS (
      SELECT r, i, CASE WHEN i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END
        AS new FROM twice),
    spans AS (
      SELECT r, min(i) AS a, max(i) + 200 AS b
      FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM cut) GROUP BY r, k),
    kept AS (
      SELECT r, a, b, hex(array_slice(x, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) + 1, a)) AS piece
      FROM spans JOIN d USING (r)),
    s AS (
      SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS z,
        string_agg(piece, '' ORDER BY a) AS head FROM kept GROUP BY r)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
      coalesce(n_spans, 0)::BIGINT AS n_spans,
      sha256(unhex(coalesce(head, '') || hex(array_slice(x, coalesce(z, 0) + 1, n)))) AS kept_sha256
    FROM d LEFT JOIN s USING (r)
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = suffix_dedup.repeated_bytes(docs)
    removed = F.aggregate("repeats.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        "repeats.n_bytes",
        removed.alias("n_removed"),
        F.size("repeats.spans").cast("bigint").alias("n_spans"),
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )
