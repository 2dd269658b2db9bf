"""DuckDB text of the input views, written independently of ``premisa.sources.fixtures``."""

from __future__ import annotations

VARIANT_LIST = (
    "(VALUES ('original_pos_prem',0),('original_neg_prem',1),('shuffle_pos_prem',2),"
    "('shuffle_neg_prem',3),('random_pos_prem',4),('random_neg_prem',5),('no_prem',6))"
    " AS v(variant, vi)"
)
LAYERS = "(VALUES (1),(2)) AS l(layer)"

# name -> (views it reads, text)
VIEWS: dict[str, tuple[str, str]] = {
    "smp": (
        "",
        """SELECT 'ds' || substr(o_orderpriority, 1, 1) AS dataset, 'm1' AS model,
  o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
FROM orders""",
    ),
    "pred": (
        "smp",
        f"""SELECT smp.*, v.variant, t.train_variant, l.layer, m.method,
  CAST((sample_id * (17 + 2 * v.vi) + 7 * v.vi * v.vi + 101 * l.layer + 37 * m.mi
        + 53 * t.ti) % 997 AS DOUBLE) / 997e0 AS prediction
FROM smp, {VARIANT_LIST},
  (VALUES ('original_pos_prem',0),('no_prem',1),('combined',2)) AS t(train_variant, ti),
  {LAYERS}, (VALUES ('mass_mean',0),('ccr',1),('lm_head',2)) AS m(method, mi)""",
    ),
    "pred_same": (
        "smp",
        f"""SELECT smp.*, v.variant, v.variant AS train_variant, l.layer, 'ccr' AS method,
  CAST((sample_id * (19 + 2 * v.vi) + 5 * v.vi * v.vi + 101 * l.layer) % 997 AS DOUBLE)
    / 997e0 AS prediction
FROM smp, {VARIANT_LIST}, {LAYERS}
WHERE v.variant NOT IN ('original_pos_prem', 'no_prem')""",
    ),
    "caus": (
        "smp",
        f"""SELECT smp.*, s.setting, l.layer, m.method,
  CAST((sample_id * (29 + 4 * s.si) + 11 * l.layer + 37 * m.mi) % 991 AS DOUBLE)
    / 991e0 AS prediction
FROM smp, (VALUES ('intervened',0),('original',1)) AS s(setting, si), {LAYERS},
  (VALUES ('mass_mean',0),('ccr',1)) AS m(method, mi)""",
    ),
    # one row per coordinate of a state: i counts from 0
    "st": (
        "",
        f"""SELECT 'emb' AS dataset, 'm1' AS model, e.vec_id // 2 AS sample_id,
  CAST(e.vec_id % 2 AS INT) AS side, n.label % 2 AS y, v.variant, l.layer, i.i,
  CAST(e.embedding[(l.layer - 1) * 16 + i.i + 1] AS DOUBLE) * (1e0 + v.vi / 10e0)
    + v.vi * 0.01e0 AS x
FROM embeddings e
LEFT JOIN embeddings n ON n.vec_id = (e.vec_id // 2) * 2,
{VARIANT_LIST}, (SELECT unnest(range(1, 5)) AS layer) l, (SELECT unnest(range(16)) AS i) i""",
    ),
    "lgt": (
        "st",
        """SELECT dataset, model, variant, sample_id, side, y, 10e0 * x AS logit
FROM st WHERE layer = 1 AND i = 0""",
    ),
    "halves": (
        "st",
        """SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sample_id)
  <= count(*) OVER () // 2 THEN 'train' ELSE 'eval' END AS split
FROM (SELECT DISTINCT sample_id FROM st)""",
    ),
    "sp": ("st halves", "SELECT st.*, halves.split FROM st JOIN halves USING (sample_id)"),
    "cen": (
        "sp",
        """SELECT * REPLACE (x - avg(x) FILTER (isfinite(x)) OVER
  (PARTITION BY variant, layer, split, side, i) AS x) FROM sp""",
    ),
    "mm": (
        "cen",
        """SELECT dataset, model, variant AS train_variant, layer, i,
  avg(x) FILTER (side = y) - avg(x) FILTER (side = 1 - y) AS d
FROM cen WHERE split = 'train' GROUP BY ALL""",
    ),
    "mm_len": (
        "mm",
        "SELECT train_variant, layer, sqrt(sum(d * d)) AS length FROM mm GROUP BY ALL",
    ),
    # pair probabilities of every mean-difference probe on every variant and split
    "scored": (
        "cen mm mm_len",
        """SELECT layer, train_variant, variant, split, sample_id, y,
  (1e0 / (1e0 + exp(-max(z) FILTER (side = 1)))
   + 1e0 - 1e0 / (1e0 + exp(-max(z) FILTER (side = 0)))) / 2e0 AS p
FROM (SELECT cen.layer, train_variant, variant, split, sample_id, y, side,
        sum(x * d) / greatest(any_value(length), 1e-12) AS z
      FROM cen JOIN mm USING (layer, i) JOIN mm_len USING (train_variant, layer)
      GROUP BY ALL)
GROUP BY ALL""",
    ),
    "eligible": (
        "scored",
        """SELECT * FROM scored
WHERE train_variant IN ('original_pos_prem', 'no_prem') OR train_variant = variant""",
    ),
    "lgs": (
        "scored",
        """SELECT *, ln(q / (1 - q)) AS lg
FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM scored)""",
    ),
    "scales": (
        "lgs",
        """SELECT train_variant, layer, ln(0.75e0 / 0.25e0) / stddev_samp(lg) AS scale
FROM lgs WHERE variant = 'no_prem' AND split = 'train' GROUP BY ALL""",
    ),
    "dirs": (
        "",
        """SELECT 'm' || (vec_id // 72) AS model, 'ds' || (vec_id % 2) AS dataset,
  'v' || (vec_id // 2 % 3) AS data_variant, CAST(vec_id // 6 % 4 + 1 AS INT) AS layer,
  'p' || (vec_id // 24 % 3) AS probe_method,
  CASE WHEN label % 2 = 0 THEN -1 ELSE 1 END AS sign,
  CAST(embedding AS DOUBLE[]) AS direction
FROM embeddings""",
    ),
    "cmp": (
        "dirs",
        """SELECT a.model, a.dataset AS dataset1, b.dataset AS dataset2,
  a.data_variant AS data_variant1, b.data_variant AS data_variant2, a.layer AS layer1,
  b.layer AS layer2, a.probe_method AS probe_method1, b.probe_method AS probe_method2,
  a.sign * b.sign * list_cosine_similarity(a.direction, b.direction) AS similarity
FROM dirs a JOIN dirs b ON a.model = b.model""",
    ),
    "nli": (
        "",
        """SELECT d.doc_id AS pair_id, substr(d.text, 1, length(d.text) // 2) AS sentence1,
  substr(d.text, length(d.text) // 2 + 1) AS sentence2,
  CASE WHEN l.doc_id IS NULL THEN '-' WHEN l.toxic = 1 THEN 'contradiction'
       WHEN l.quality = 1 THEN 'entailment' ELSE 'neutral' END AS gold_label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "coded": (
        "nli",
        """SELECT pair_id, sentence1 AS premise, sentence2 AS hypothesis,
  CASE gold_label WHEN 'contradiction' THEN 0 ELSE 1 END AS label
FROM nli WHERE gold_label IN ('contradiction', 'entailment')""",
    ),
    "rendered": (
        "coded",
        """SELECT *, 'Consider the following premise: "' || premise || '" The statement "'
  || hypothesis || '" is' AS question FROM coded""",
    ),
    "sized": (
        "rendered",
        """SELECT *, md5('0:' || pair_id) AS k, length(txt) - length(replace(txt, ' ', '')) + 1 AS n
FROM (SELECT *, question || ' ' || CASE label WHEN 1 THEN 'correct' ELSE 'incorrect' END
        AS txt FROM rendered)""",
    ),
    "qas": (
        "",
        """SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    ),
    "prf": (
        "",
        """SELECT p_partkey AS item_id, 'the part is ' || p_name AS hypothesis,
  ' sent1 & sent2 -> int1: x; sent' || (p_partkey % 2 + 3) || ' & int1 -> hypothesis; ' AS proof,
  list_slice(['sent4', 'sent2', 'sent1', 'sent3'], 1, p_partkey % 4 + 1) AS distractors
FROM part""",
    ),
    "facts": (
        "",
        """SELECT p_partkey AS item_id, unnest([
  {'key': 'sent1', 'fact': p_name}, {'key': 'sent2', 'fact': p_brand},
  {'key': 'sent3', 'fact': p_type},
  {'key': 'sent4', 'fact': CASE WHEN p_size % 2 = 0 THEN 'an Even size'
     ELSE 'SIZE ' || p_size END},
  {'key': 'int1', 'fact': 'a Derived FACT'}], recursive := true) FROM part""",
    ),
    "keyed": (
        "prf",
        """SELECT item_id, unnest(range(len(keys))) AS i, trim(unnest(keys)) AS key
FROM (SELECT item_id,
        str_split(replace(str_split(trim(proof), ';')[-2], '-> hypothesis', ''), '&') AS keys
      FROM prf)""",
    ),
    "support": (
        "keyed facts",
        """SELECT item_id, i, upper(fact[1]) || lower(fact[2:]) || '.' AS premise
FROM keyed JOIN facts USING (item_id, key)""",
    ),
    "chs": (
        "",
        """SELECT p_partkey AS item_id, substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS answer_key,
  [p_name, p_brand, p_type, CAST(p_size AS VARCHAR)][p_partkey % 4 + 1] AS answer,
  unnest([{'label': 'A', 'text': p_name || '.'}, {'label': 'B', 'text': p_brand || '.'},
   {'label': 'C', 'text': p_type || '.'}, {'label': 'D', 'text': p_size || '.'}],
   recursive := true) FROM part""",
    ),
    "wrong": (
        "chs",
        """SELECT item_id, label, replace(text, '.', '') AS text,
  row_number() OVER (PARTITION BY item_id ORDER BY label) - 1 AS i,
  count(*) OVER (PARTITION BY item_id) AS n
FROM chs WHERE label <> answer_key""",
    ),
    "picked": (
        "chs wrong",
        """SELECT DISTINCT c.item_id, c.answer_key AS right_key, c.answer AS right_text,
  w.label AS wrong_key, w.text AS wrong_text,
  CAST('0x' || substr(md5('1:' || c.item_id), 1, 8) AS BIGINT) % 2 = 0 AS right_first
FROM chs c JOIN wrong w ON w.item_id = c.item_id
 AND w.i = CAST('0x' || substr(md5('0:' || c.item_id), 1, 8) AS BIGINT) % w.n""",
    ),
    "asked": (
        "picked",
        """SELECT *, 'Which is part ' || item_id || '?' || ' ' || CASE WHEN right_first
  THEN '(A) ' || right_text || ' (B) ' || wrong_text
  ELSE '(A) ' || wrong_text || ' (B) ' || right_text END AS question,
 CASE WHEN right_first THEN '(A) ' ELSE '(B) ' END || right_text AS right_answer,
 CASE WHEN right_first THEN '(B) ' ELSE '(A) ' END || wrong_text AS wrong_answer
FROM picked""",
    ),
    # --- error metrics
    "allpred": ("pred pred_same", "SELECT * FROM pred UNION ALL BY NAME SELECT * FROM pred_same"),
    "tagged": (
        "allpred",
        """SELECT a.*, s.subgroup FROM allpred a JOIN (VALUES ('combined', 'combined'),
  ('no_prem', 'no-prem'), ('original_pos_prem', 'pos-prem')) AS s(train_variant, subgroup)
  USING (train_variant)
UNION ALL SELECT *, 'same' FROM allpred
WHERE train_variant = variant AND (dataset, model, layer, method) IN (
  SELECT (dataset, model, layer, method) FROM allpred WHERE train_variant = variant
  GROUP BY ALL HAVING count(DISTINCT variant) > 2)""",
    ),
    "wide": (
        "tagged",
        """SELECT dataset, model, layer, method, subgroup, sample_id, label,
  max(prediction) FILTER (variant = 'original_pos_prem') AS o,
  max(prediction) FILTER (variant = 'original_neg_prem') AS n,
  max(prediction) FILTER (variant = 'shuffle_pos_prem') AS sp,
  max(prediction) FILTER (variant = 'shuffle_neg_prem') AS sn,
  max(prediction) FILTER (variant = 'random_pos_prem') AS rp,
  max(prediction) FILTER (variant = 'random_neg_prem') AS rn,
  max(prediction) FILTER (variant = 'no_prem') AS h
FROM tagged GROUP BY ALL""",
    ),
    "errs": (
        "wide",
        """SELECT *, abs(rp - h) / abs(pe) AS error_1_pos, abs(rn - h) / abs(pe) AS error_1_neg,
  abs(sp - h) / abs(pe) AS error_2_pos, abs(sn - h) / abs(pe) AS error_2_neg,
  greatest((n - h) / pe, 0e0) AS error_3, abs(n - o) / abs(pe) AS error_4,
  greatest((n - h) / pe, 0e0) + abs(n - o) / abs(pe) AS error_3_4,
  label * greatest(0e0 - pe, 0e0) AS error_sv_1, (1 - label) * greatest(pe, 0e0) AS error_sv_0,
  label * greatest(0e0 - pe, 0e0) + (1 - label) * greatest(pe, 0e0) AS error_sv
FROM (SELECT *, o - h AS pe FROM wide)""",
    ),
    "long": (
        "errs",
        """SELECT dataset, model, layer, method, subgroup, unnest([
  {'cell': 'error_1_pos', 'value': error_1_pos}, {'cell': 'error_1_neg', 'value': error_1_neg},
  {'cell': 'error_2_pos', 'value': error_2_pos}, {'cell': 'error_2_neg', 'value': error_2_neg},
  {'cell': 'error_3', 'value': error_3}, {'cell': 'error_4', 'value': error_4},
  {'cell': 'error_3_4', 'value': error_3_4}], recursive := true) FROM errs""",
    ),
    "cells": (
        "long",
        """SELECT dataset, model, layer, method, subgroup, cell, n, mean,
  CASE WHEN bad THEN 'nan'::DOUBLE ELSE (s[(n + 1) // 2] + s[n // 2 + 1]) / 2 END AS median,
  list_avg(s[CAST(floor(0.2e0 * n) AS BIGINT) + 1 : n - CAST(floor(0.2e0 * n) AS BIGINT)])
    AS trim_mean,
  CASE WHEN bad THEN 'nan'::DOUBLE WHEN t20 = 0 OR s[l20] = s[least(l20 + 1, n)] THEN s[l20]
    ELSE s[l20] + (s[least(l20 + 1, n)] - s[l20]) * t20 END AS p20,
  CASE WHEN bad THEN 'nan'::DOUBLE WHEN t80 = 0 OR s[l80] = s[least(l80 + 1, n)] THEN s[l80]
    ELSE s[l80] + (s[least(l80 + 1, n)] - s[l80]) * t80 END AS p80
FROM (SELECT *, CAST(floor((n - 1) * 0.2e0) AS BIGINT) + 1 AS l20,
        (n - 1) * 0.2e0 - floor((n - 1) * 0.2e0) AS t20,
        CAST(floor((n - 1) * 0.8e0) AS BIGINT) + 1 AS l80,
        (n - 1) * 0.8e0 - floor((n - 1) * 0.8e0) AS t80
      FROM (SELECT dataset, model, layer, method, subgroup, cell, count(*) AS n,
              avg(value) AS mean, list(value ORDER BY value) AS s, bool_or(isnan(value)) AS bad
            FROM long GROUP BY ALL))""",
    ),
    "aggr": (
        "errs cells",
        """SELECT dataset, model, layer, method, subgroup, count(*) AS samples,
  avg(o) FILTER (label = 1) AS p_h_p_e, avg(o) FILTER (label = 0) AS p_h_p_c,
  avg(n) FILTER (label = 1) AS p_h_np_e, avg(n) FILTER (label = 0) AS p_h_np_c,
  avg(h) AS p_h, avg(CAST((o > 0.5) = (label = 1) AS INT)) AS accuracy_pos_prem,
  avg(CAST((h > 0.5) = (label = 1) AS INT)) AS accuracy_no_prem,
  avg(abs(pe)) AS premise_sensitivity, avg(pe) AS mean_premise_effect,
  avg(error_sv_0) AS error_sv_0, avg(error_sv_1) AS error_sv_1, avg(error_sv) AS mean_error_sv,
  avg(error_sv) / avg(abs(pe)) AS rel_error_sv
FROM errs GROUP BY ALL""",
    ),
}

ERRORS = {
    "error_1": "error_1_%",
    "error_2": "error_2_%",
    "error_3": "error_3",
    "error_4": "error_4",
    "error_3_4": "error_3_4",
}
AGGREGATES = ["mean", "median", "trim_mean", "p20", "p80"]


def _cell_columns() -> str:
    return ",\n  ".join(
        f"avg({a}) FILTER (cell LIKE '{like}' ESCAPE '$' AND NOT isnan({a})) AS {a}_{e}"
        if "%" in like
        else f"avg({a}) FILTER (cell = '{like}' AND NOT isnan({a})) AS {a}_{e}"
        for a in AGGREGATES
        for e, like in ERRORS.items()
    )


VIEWS["pooled"] = (
    "cells",
    f"SELECT dataset, model, layer, method, subgroup,\n  {_cell_columns()}\nFROM cells GROUP BY ALL",
)
VIEWS["stats"] = (
    "aggr pooled",
    "SELECT * FROM aggr JOIN pooled USING (dataset, model, layer, method, subgroup)",
)
_RANKED = [f"{a}_error_{i}" for a in AGGREGATES for i in (1, 2, 3, 4)] + ["mean_error_sv"]
VIEWS["scores"] = (
    "stats",
    "SELECT dataset, model, layer, method, subgroup, unnest(["
    + ", ".join(f"{{'score': '{c}', 'value': {c}}}" for c in _RANKED)
    + "], recursive := true) FROM stats WHERE method <> 'lm_head' OR layer = 1",
)
VIEWS["ranks"] = (
    "scores",
    """SELECT *, row_number() OVER (PARTITION BY dataset, model, score
  ORDER BY round(value, 9) ASC NULLS LAST, layer, method, subgroup) AS rank FROM scores""",
)
VIEWS["ranked"] = (
    "stats ranks",
    "SELECT stats.*, "
    + ", ".join(f"{a}_avg_rank" for a in AGGREGATES)
    + " FROM stats LEFT JOIN (SELECT dataset, model, layer, method, subgroup, "
    + ", ".join(
        f"sum(rank) FILTER (score IN ("
        + ", ".join(f"'{a}_error_{i}'" for i in (1, 2, 3, 4))
        + f", 'mean_error_sv')) / 5e0 AS {a}_avg_rank"
        for a in AGGREGATES
    )
    + " FROM ranks GROUP BY ALL) USING (dataset, model, layer, method, subgroup)",
)
_BEST = (
    "layer, accuracy_pos_prem, trim_mean_avg_rank, p_h_p_e, p_h_np_e, p_h, p_h_np_c, p_h_p_c, "
    "trim_mean_error_1, trim_mean_error_2, trim_mean_error_3, trim_mean_error_4"
)
VIEWS["best"] = (
    "ranked",
    f"""SELECT 'accuracy' AS criterion, dataset, model, method, subgroup, {_BEST}
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, method, subgroup
        ORDER BY round(accuracy_pos_prem, 9) DESC, layer) AS place FROM ranked) WHERE place = 1
UNION ALL
SELECT 'avg_rank', dataset, model, method, subgroup, {_BEST}
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, method, subgroup
        ORDER BY trim_mean_avg_rank, layer) AS place
      FROM ranked WHERE trim_mean_avg_rank IS NOT NULL) WHERE place = 1""",
)


def with_views(names: list[str], body: str, instead: dict[str, tuple[str, str]] | None = None) -> str:
    """Put the views a query reads, and those they read, in front of it.

    ``instead`` has other definitions for some views, so that one chain can stand on other input.
    """
    ordered: list[str] = []
    views = VIEWS | (instead or {})

    def visit(name: str) -> None:
        for needed in views[name][0].split():
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    texts = [f"{name} AS MATERIALIZED (\n{views[name][1]}\n)" for name in ordered]
    return "WITH " + ",\n".join(texts) + "\n" + body
