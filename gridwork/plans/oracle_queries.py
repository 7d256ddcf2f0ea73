"""DuckDB twins of the registered queries (see :mod:`gridwork.plans.oracle_sql`)."""

from __future__ import annotations

from gridwork.plans.oracle_sql import GRID, NORMALIZE, NORMALIZE_NFKC, sentence_ctes, split_ctes, with_

ORACLE: dict[str, str] = {}

ORACLE["report_sentences"] = with_(
    GRID, NORMALIZE, split_ctes("norm"),
    "chosen AS (SELECT doc_id, table_id, row_split, col_split FROM best "
    "WHERE variant = 'probability_macro')",
    sentence_ctes("norm", "chosen"),
) + "\nSELECT doc_id, table_id, r, c, sentence, cell_id, data FROM sentences"

ORACLE["normalized_slots"] = with_(GRID, NORMALIZE_NFKC) + \
    "\nSELECT doc_id, table_id, r, c, text FROM norm"

ORACLE["table_status"] = with_(GRID, NORMALIZE) + \
    "\nSELECT doc_id, table_id, status, carried FROM walk"

ORACLE["best_splits"] = with_(GRID, NORMALIZE, split_ctes("norm")) + \
    "\nSELECT doc_id, table_id, variant, row_split, col_split FROM best"

from gridwork.plans.oracle_sql import EXPECTED_CONTEXT, EXPECTED_EXTRACT  # noqa: E402

ORACLE["extract_tables"] = with_(GRID, EXPECTED_EXTRACT) + \
    "\nSELECT doc_id, table_id, table_ord, r, c, cell_id, text FROM expected"

ORACLE["context_above"] = with_(GRID, EXPECTED_CONTEXT) + \
    "\nSELECT doc_id, table_id, sentence, cell_id, data FROM context"

from gridwork.plans.oracle_sql import (  # noqa: E402
    CONV, GOLD, NLI, clean_heading, is_float_text, needs_translation, norm_text, post_rules, q,
)
from gridwork.sources.fixtures import PROBE_PREFIXES, PROBE_SUFFIXES  # noqa: E402
from gridwork.sources.rules import APPEND_RULES  # noqa: E402


def _arr(xs):
    return "[" + ", ".join(q(x) for x in xs) + "]"


ORACLE["text_normalize"] = with_(GRID, f"""
probe AS (
  SELECT doc_id, table_id, r, c,
         {_arr(PROBE_PREFIXES)}[CAST((table_ord + r) % {len(PROBE_PREFIXES)} + 1 AS INTEGER)] || text ||
         {_arr(PROBE_SUFFIXES)}[CAST((table_ord + c * 3 + r) % {len(PROBE_SUFFIXES)} + 1 AS INTEGER)] AS text
  FROM slots WHERE text IS NOT NULL
)""") + f"\nSELECT doc_id, table_id, r, c, {norm_text('text')} AS text FROM probe"

_DATE = "(CAST(year(o_orderdate) AS VARCHAR) || '年' || CAST(month(o_orderdate) AS VARCHAR) || '月' || " \
        "CAST(day(o_orderdate) AS VARCHAR) || '日')"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)"
_DIG = "CAST(o_orderkey % 1000 AS VARCHAR)"
ORACLE["text_rules"] = f"""
WITH lit AS (
  SELECT 'S' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(7, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0')
           || '-0000000-tab' || CAST(o_orderkey AS VARCHAR) AS table_id,
         CASE o_orderkey % 8
           WHEN 0 THEN '設立' || {_DATE} || '、登記' || {_DATE}
           WHEN 1 THEN '代表取締役 ' || {_DATE} || '生'
           WHEN 2 THEN {_DATE} || 'から' || {_DATE} || '生'
           WHEN 3 THEN '※' || CAST(o_orderkey % 10 AS VARCHAR) || {_DIG} || '注記'
           WHEN 4 THEN {_PRICE} || '〔' || {_DIG} || '〕'
           WHEN 5 THEN '株式の状況(1単元の株式数' || {_DIG} || '株)'
           WHEN 6 THEN '1株当たり' || {_DIG} || '円' || CAST(o_orderkey % 100 AS VARCHAR) || '銭'
           ELSE '(' || CAST(o_orderkey % 9 AS VARCHAR) || ') 【沿革】' || {_DATE} || ' 概要　' END AS src
  FROM orders
)
SELECT table_id, {post_rules('src')} AS rules_text,
       regexp_matches(src, '[０-９0-9]{{4}}年[０-９0-9]{{1,2}}月[０-９0-9]{{1,2}}日') AS has_date,
       {clean_heading('src')} AS heading,
       TRY_CAST(nullif(regexp_extract(table_id, '-tab([0-9]+)', 1), '') AS BIGINT) AS tab_no,
       substr(table_id, 1, 8) AS doc_prefix,
       {needs_translation('src')} AS needs_translation,
       {is_float_text("regexp_extract(src, '[0-9.]+', 0)")} AS is_number
FROM lit"""


def _append_sql():
    keys = [(k, m) for k, m in APPEND_RULES if m]
    anchor = "(CASE " + " ".join(f"WHEN ends_with(text, {q(k)}) THEN {q(m)}" for k, m in keys) + " END)"
    pre = []
    for k, m in reversed(keys):
        rest = f"substr(t1, {len(k) + 1})"
        pre.append(f"WHEN starts_with(t1, {q(k)}) AND {is_float_text(rest)} THEN {rest} || {q(m)}")
    return with_(GRID, f"""
base AS (SELECT doc_id, table_id, r, c, {norm_text('text')} AS text FROM slots),
mk AS (SELECT *, {anchor} AS anchor, {is_float_text('text')} AND text <> '0' AS isnum FROM base),
cf AS (SELECT doc_id, table_id, c, min(r) AS ar, arg_min(anchor, r) AS am FROM mk WHERE anchor IS NOT NULL GROUP BY ALL),
rf AS (SELECT doc_id, table_id, r, min(c) AS ac, arg_min(anchor, c) AS am FROM mk WHERE anchor IS NOT NULL GROUP BY ALL),
lined AS (
  SELECT m.doc_id, m.table_id, m.r, m.c,
         CASE WHEN m.isnum AND cf.ar < m.r THEN m.text || cf.am
              WHEN m.isnum AND rf.ac < m.c THEN m.text || rf.am ELSE m.text END AS t1
  FROM mk m
  LEFT JOIN cf ON cf.doc_id = m.doc_id AND cf.table_id = m.table_id AND cf.c = m.c
  LEFT JOIN rf ON rf.doc_id = m.doc_id AND rf.table_id = m.table_id AND rf.r = m.r
)""") + f"\nSELECT doc_id, table_id, r, c, CASE {' '.join(pre)} ELSE t1 END AS text FROM lined"


ORACLE["append_scale"] = _append_sql()

ORACLE["split_variants_legacy"] = with_(GRID, NORMALIZE, split_ctes("norm", 1, True)) + \
    "\nSELECT doc_id, table_id, variant, row_split, col_split FROM best"

ORACLE["sentences_fixed"] = with_(
    GRID, NORMALIZE,
    "chosen AS (SELECT DISTINCT doc_id, table_id, 1 AS row_split, 1 AS col_split FROM norm)",
    sentence_ctes("norm", "chosen"),
) + "\nSELECT doc_id, table_id, r, c, sentence, cell_id, data FROM sentences"

ORACLE["sentences_keep_empty"] = with_(
    GRID, NORMALIZE, split_ctes("norm", 1, True),
    "chosen AS (SELECT doc_id, table_id, row_split, col_split FROM best WHERE variant = 'probability_macro')",
    sentence_ctes("norm", "chosen", keep_empty=True),
) + "\nSELECT doc_id, table_id, r, c, sentence, cell_id, data FROM sentences"

ORACLE["include_flag"] = with_(CONV, GOLD) + "\nSELECT doc_id, table_id, is_include FROM gold"

ORACLE["split_accuracy"] = with_(GRID, NORMALIZE, split_ctes("norm"), CONV, GOLD, """
pdocs AS (SELECT DISTINCT doc_id FROM best),
gv AS (
  SELECT g.*, v.variant FROM glab g JOIN pdocs USING (doc_id),
       (SELECT unnest(['argmax_micro', 'argmax_macro', 'probability_micro', 'probability_macro']) AS variant) v
),
per AS (
  SELECT gv.variant, sum(CASE WHEN b.row_split = gv.row_split AND b.col_split = gv.col_split THEN 1 ELSE 0 END)
           AS correct, count(*) AS total
  FROM gv LEFT JOIN best b ON b.doc_id = gv.doc_id AND b.table_id = gv.table_id AND b.variant = gv.variant
  GROUP BY gv.variant
)""") + """
SELECT v.variant, CAST(coalesce(correct, 0) AS BIGINT) AS correct, CAST(coalesce(total, 0) AS BIGINT) AS total,
       CASE WHEN coalesce(total, 0) > 0 THEN CAST(correct AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS accuracy
FROM (SELECT unnest(['argmax_micro', 'argmax_macro', 'probability_micro', 'probability_macro']) AS variant) v
LEFT JOIN per USING (variant)"""

ORACLE["split_matrix"] = with_(CONV, GOLD, """
cnt AS (SELECT row_split, col_split, count(*) AS n FROM glab GROUP BY ALL),
bnd AS (SELECT max(row_split) AS mr, max(col_split) AS mc FROM glab)""") + """
SELECT CAST(a.r AS INTEGER) AS row_split, CAST(b.c AS INTEGER) AS col_split, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM bnd, generate_series(0, bnd.mr) a(r), generate_series(0, bnd.mc) b(c)
LEFT JOIN cnt ON cnt.row_split = a.r AND cnt.col_split = b.c"""

ORACLE["split_runs"] = with_(CONV, GOLD, """
cnt AS (SELECT row_split, col_split, count(*) AS n FROM glab GROUP BY ALL),
bnd AS (SELECT max(row_split) AS mr, max(col_split) AS mc FROM glab),
inrow AS (SELECT *, lag(col_split, 1, -1) OVER w AS before, lead(col_split) OVER w AS after
          FROM cnt WINDOW w AS (PARTITION BY row_split ORDER BY col_split)),
rws AS (SELECT row_split, lag(row_split, 1, -1) OVER (ORDER BY row_split) AS above FROM (SELECT DISTINCT row_split FROM cnt)),
every AS (
  SELECT row_split AS row_from, row_split AS row_to, col_split AS col_from, col_split AS col_to, n FROM cnt
  UNION ALL SELECT row_split, row_split, before + 1, col_split - 1, 0 FROM inrow
  UNION ALL SELECT row_split, row_split, col_split + 1, mc, 0 FROM inrow, bnd WHERE after IS NULL
  UNION ALL SELECT above + 1, row_split - 1, 0, mc, 0 FROM rws, bnd)""") + """
SELECT CAST(row_from AS INTEGER) AS row_from, CAST(row_to AS INTEGER) AS row_to, CAST(col_from AS INTEGER) AS col_from,
       CAST(col_to AS INTEGER) AS col_to, n
FROM every WHERE row_from <= row_to AND col_from <= col_to"""

ORACLE["binary_metrics"] = """
WITH m AS (
  SELECT count(*) AS n, sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS ok,
         sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 ELSE 0 END) AS fn
  FROM labels
)
SELECT CAST(n AS BIGINT) AS n,
       CASE WHEN n > 0 THEN CAST(ok AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END AS accuracy,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END
         AS f1
FROM m"""

_PAIRS = """
pairs AS (
  SELECT DISTINCT CAST(coalesce(s.cell_id = q.cell_id, false) AS INTEGER) AS label, q.question, s.sentence
  FROM questions q JOIN csent s ON s.doc_id = q.doc_id AND s.table_id = q.table_id
)"""

ORACLE["qa_pairs"] = with_(CONV, _PAIRS) + "\nSELECT label, question, sentence FROM pairs"

ORACLE["qa_pairs_one_negative"] = with_(CONV, """
j AS (
  SELECT q.qid, q.question, s.sentence, s.cell_id, coalesce(s.cell_id = q.cell_id, false) AS pos
  FROM questions q JOIN csent s ON s.doc_id = q.doc_id AND s.table_id = q.table_id
),
-- every question draws one of the sentences of its table that aren't its own cell's
others AS (
  SELECT qid, question, sentence,
         row_number() OVER (PARTITION BY qid ORDER BY cell_id NULLS FIRST, sentence) - 1 AS n,
         ('0x' || substr(md5('0|' || qid), 1, 8))::BIGINT % count(*) OVER (PARTITION BY qid) AS drawn
  FROM j WHERE NOT pos
),
neg AS (SELECT question, sentence FROM others WHERE n = drawn)""") + """
SELECT DISTINCT * FROM (
  SELECT 1 AS label, question, sentence FROM j WHERE pos
  UNION ALL SELECT 0 AS label, question, sentence FROM neg)"""

ORACLE["balance_classes"] = with_(NLI) + \
    "\nSELECT label, s1, s2, row_number() OVER (ORDER BY k) AS shuffle_pos FROM bk"

ORACLE["train_eval_split"] = with_(NLI, """
bn AS (SELECT count(*) AS n FROM bk)""") + """
SELECT label, s1, s2,
       CASE WHEN row_number() OVER (ORDER BY k) <= (SELECT ceil(CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE)) FROM bn)
            THEN 'eval' ELSE 'train' END AS split
FROM bk"""

_RULE_TYPE = ("CASE WHEN regexp_matches(text, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN [0.1, 0.1, 0.1, 0.7]"
              " WHEN text = '' THEN [0.7, 0.1, 0.1, 0.1] WHEN length(text) <= 4 THEN [0.1, 0.6, 0.2, 0.1]"
              " ELSE [0.2, 0.2, 0.5, 0.1] END")
ORACLE["score_distinct_cells"] = with_(GRID, f"""
st AS (SELECT doc_id, table_id, r, c, CAST({_RULE_TYPE} AS DOUBLE[]) AS type FROM slots WHERE text IS NOT NULL)""") + \
    "\nSELECT doc_id, table_id, r, c, type, CAST(list_position(type, list_max(type)) - 1 AS INTEGER) AS label FROM st"

ORACLE["score_stored_cells"] = ORACLE["score_distinct_cells"]

ORACLE["softmax_label"] = with_(GRID, """
lg AS (SELECT doc_id, table_id, r, c, list_transform(type, lambda v: v * 10.0) AS l FROM slots WHERE type IS NOT NULL),
ex AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM lg),
sm AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS p FROM ex)""") + """
SELECT doc_id, table_id, r, c, list_transform(p, lambda v: round(v, 6)) AS probs,
       CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS label FROM sm"""

ORACLE["score_pairs"] = with_(CONV, _PAIRS) + """
SELECT label, question, sentence,
       CAST(CASE WHEN contains(question, split_part(sentence, ' ', 1)) THEN [0.1, 0.9] ELSE [0.8, 0.2] END
            AS DOUBLE[]) AS probs
FROM pairs"""

ORACLE["cosine_rank"] = """
WITH qv AS (SELECT label AS qid, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
sc AS (
  SELECT qv.qid, e.vec_id,
         round(list_cosine_similarity(CAST(qv.q AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
  FROM qv, embeddings e
)
SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sc"""

ORACLE["translation_volume"] = f"""
SELECT lang, count(*) AS n_texts,
       CAST(sum(CASE WHEN {needs_translation('text')} THEN 1 ELSE 0 END) AS BIGINT) AS n_translate,
       CAST(coalesce(sum(CASE WHEN {needs_translation('text')} THEN length(text) END), 0) AS BIGINT) AS chars
FROM documents GROUP BY lang"""

ORACLE["map_distinct_text"] = with_(GRID) + """
SELECT doc_id, table_id, r, c, text,
       CASE text WHEN '数量' THEN 'quantity' WHEN '金額' THEN 'amount' WHEN '割引' THEN 'discount'
                 WHEN '出荷日' THEN 'ship date' ELSE text END AS translated
FROM slots WHERE text IS NOT NULL"""

# ------------------------------------------------------ sources, sinks --
ORACLE["corpus_scan"] = with_(GRID, EXPECTED_EXTRACT) + \
    "\nSELECT doc_id, table_id, r, c, cell_id, text FROM expected"

ORACLE["slots_round_trip"] = with_(GRID) + \
    "\nSELECT doc_id, page_id, table_id, table_ord, r, c, cell_id, text FROM slots"

ORACLE["text_ids_round_trip"] = with_(GRID) + """
SELECT regexp_extract(doc_id, '([0-9]+)$', 1) AS doc_id, table_id, r, c, text AS sentence, cell_id, '' AS data
FROM slots WHERE text IS NOT NULL"""

ORACLE["rules_file"] = """
WITH lines AS (
  SELECT '(' || replace(p_brand || p_type, ' ', '') || ')' AS key, p_size, p_partkey FROM part WHERE p_partkey % 5 <> 0)
SELECT key, CAST(arg_max(p_size, p_partkey) AS VARCHAR) AS mult,
       CAST(row_number() OVER (ORDER BY min(p_partkey)) AS INTEGER) AS ord
FROM lines GROUP BY key"""

ORACLE["questions_json"] = with_(CONV) + "\nSELECT qid, question, doc_id, table_id, cell_id FROM questions"

ORACLE["json_one_object"] = ORACLE["questions_json"]

ORACLE["json_with_errors"] = with_(CONV, GOLD, """
placed AS (
  SELECT *, CAST(regexp_extract(doc_id, '([0-9]+)$', 1) AS BIGINT) % 10 = 3
         AND CAST(regexp_extract(table_id, 'tab([0-9]+)$', 1) AS BIGINT)
             = max(CAST(regexp_extract(table_id, 'tab([0-9]+)$', 1) AS BIGINT)) OVER (PARTITION BY doc_id) AS broken
  FROM gold0)""") + """
SELECT CASE WHEN broken THEN 'error' ELSE 'label' END AS kind, table_id,
       CAST(CASE WHEN NOT broken THEN row_split END AS INTEGER) AS row_split,
       CAST(CASE WHEN NOT broken THEN col_split END AS INTEGER) AS col_split
FROM placed"""

ORACLE["tsv_line_breaks"] = "SELECT doc_id, text, lang, source FROM documents"

ORACLE["json_round_trip"] = with_(CONV, GOLD) + """
SELECT doc_id, table_id, v AS variant, CAST(row_split + i - 1 AS INTEGER) AS row_split, CAST(col_split AS INTEGER) AS col_split
FROM gold0, (SELECT unnest(['argmax_micro', 'argmax_macro', 'probability_micro', 'probability_macro']) AS v,
                    generate_subscripts(['a', 'b', 'c', 'd'], 1) AS i)
WHERE row_split IS NOT NULL"""

ORACLE["gold_json"] = with_(CONV, GOLD) + """
SELECT doc_id, table_id, false AS is_include, CAST(row_split AS INTEGER) AS row_split, CAST(col_split AS INTEGER) AS col_split
FROM gold0"""

ORACLE["tsv_round_trip"] = with_(NLI) + "\nSELECT label, s1, s2 FROM nli"

ORACLE["sentences_with_context"] = with_(CONV, GOLD) + """
SELECT doc_id, table_id, 1 AS r, 2 AS c, sentence, cell_id, 'x' AS data FROM csent
UNION ALL
SELECT doc_id, table_id, -1, -1, '以下の文書は「' || table_id || '」について記述されています。', table_id || '-aboveparagraph', ''
FROM gold0"""

ORACLE["carry_per_file"] = with_(GRID, NORMALIZE) + """
SELECT page_id, count(*) AS n_tables, count(*) FILTER (carried) AS n_carried FROM walk GROUP BY page_id"""
