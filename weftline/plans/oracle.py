"""The registered queries once more, as SQL for another engine."""

from __future__ import annotations

from ..functions.text import NODE_LABELS, POSITIVE_LABELS, STOP_WORDS
from ..operators.gates import DEVELOPMENT, PROMOTION
from .queries import SIDES, WEIGHTS


def _bucket(seed: str, *key: str) -> str:
    return f"(CAST('0x' || substr(sha256('{seed}|' || {" || '|' || ".join(key)}), 1, 4) AS BIGINT) % 100)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _f1(tp: str, fp: str, fn: str) -> str:
    """2 tp / (2 tp + fp + fn), which is the harmonic mean of both ratios."""
    return _ratio(f"2 * ({tp})", f"2 * ({tp}) + ({fp}) + ({fn})")


_G, _P = _bucket("g", "new_id", "old_id"), _bucket("p", "new_id", "old_id")
_SIDE = "CASE speaker " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIDES.items()) + " END"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SCORES = ", ".join(f"({_bucket(k, 'new_id', 'old_id')} + CASE WHEN label = '{k}' THEN 60 ELSE 0 END) / 100.0::DOUBLE AS s_{k.lower()}" for k in ("NONE", *POSITIVE_LABELS))

_PRELUDE = f"""
WITH props AS (
  SELECT CAST(conv_id AS VARCHAR) AS dialogue_id, conv_id || ':' || turn AS prop_id, turn + 1 AS turn, role AS speaker, text FROM conversations
), pairs AS (
  SELECT n.dialogue_id, n.prop_id AS new_id, e.prop_id AS old_id, n.turn AS new_turn, e.turn AS old_turn, n.dialogue_id || '/' || n.prop_id AS update_id
  FROM props n JOIN props e ON n.dialogue_id = e.dialogue_id AND e.turn < n.turn
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY update_id ORDER BY old_turn, old_id) - 1) // 3 AS block_index FROM pairs
), decisions AS (
  SELECT *, update_id || ':b' || lpad(CAST(block_index AS VARCHAR), 2, '0') AS example_id,
    CASE WHEN {_G} < 5 THEN 'ATTACK' WHEN {_G} < 15 THEN 'REPHRASE' WHEN {_G} < 30 THEN 'SUPPORT' ELSE 'NONE' END AS label FROM ranked
), gold AS (
  SELECT example_id, update_id, new_id AS source, old_id AS target, label AS type FROM decisions WHERE label <> 'NONE'
), guess AS (
  SELECT *, {_P} AS b, CASE WHEN label <> 'NONE' THEN
      CASE WHEN {_P} < 60 THEN label WHEN {_P} < 75 THEN CASE label WHEN 'SUPPORT' THEN 'ATTACK' WHEN 'ATTACK' THEN 'REPHRASE' ELSE 'SUPPORT' END WHEN {_P} < 85 THEN label END
    WHEN {_P} < 3 THEN 'SUPPORT' WHEN {_P} < 5 THEN 'ATTACK' END AS type FROM decisions
), pred AS (
  SELECT example_id, update_id, CASE WHEN label <> 'NONE' AND b >= 75 THEN old_id ELSE new_id END AS source, CASE WHEN label <> 'NONE' AND b >= 75 THEN new_id ELSE old_id END AS target, type FROM guess WHERE type IS NOT NULL
), edges AS (
  SELECT example_id, update_id, source, target, type, max(g) = 1 AS in_gold, max(p) = 1 AS in_pred
  FROM (SELECT *, 1 AS g, 0 AS p FROM gold UNION ALL SELECT *, 0, 1 FROM pred) GROUP BY ALL
), block AS (
  SELECT example_id, update_id, dialogue_id, block_index, count(*) AS n_earlier, count(*) FILTER (label <> 'NONE') AS n_gold,
    CASE count(DISTINCT label) FILTER (label <> 'NONE') WHEN 0 THEN 'NONE' WHEN 1 THEN max(label) FILTER (label <> 'NONE') ELSE 'MIXED' END AS category
  FROM decisions GROUP BY ALL
), upd AS (
  SELECT dialogue_id, update_id, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_earlier) AS BIGINT) AS n_earlier, count(*) AS n_blocks FROM block GROUP BY ALL
), tok AS (
  SELECT prop_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS t FROM props
), feat0 AS (
  SELECT d.*, len(list_intersect(a.t, b.t)) AS shared, len(a.t) AS la, len(b.t) AS lb FROM decisions d JOIN tok a ON a.prop_id = new_id JOIN tok b ON b.prop_id = old_id
), feat AS (
  SELECT *, shared / CAST(greatest(1, least(la, lb)) AS DOUBLE) AS overlap, shared / CAST(greatest(1, la + lb - shared) AS DOUBLE) AS jaccard FROM feat0
), hard AS (
  SELECT example_id, update_id, dialogue_id, arg_max(shared, k) AS max_shared, arg_max(overlap, k) AS max_overlap, arg_max(jaccard, k) AS max_jaccard, min(new_turn - old_turn) AS turn_gap, count(*) FILTER (label <> 'NONE') AS n_gold
  FROM (SELECT *, row(CAST(shared >= 2 AS INT), overlap, shared, jaccard) AS k FROM feat) GROUP BY ALL
), links AS (
  SELECT dialogue_id, unnest(CASE WHEN {_bucket("e", "prop_id")} < 10 THEN ['L' || turn, 'YA' || turn, 'L' || turn, 'TA' || turn, 'L' || turn] ELSE ['L' || turn, 'YA' || turn, 'L' || turn, 'TA' || turn] END) AS src,
    unnest(CASE WHEN {_bucket("e", "prop_id")} < 10 THEN ['YA' || turn, 'I' || turn, 'TA' || turn, 'L' || (turn + 1), 'YA' || turn]
      WHEN {_bucket("e", "prop_id")} >= 95 THEN ['YA' || turn, 'I' || turn, 'TA' || turn, 'L' || turn] ELSE ['YA' || turn, 'I' || turn, 'TA' || turn, 'L' || (turn + 1)] END) AS dst FROM props
), grounds AS (
  SELECT a.dialogue_id, a.src AS from_id, b.dst AS to_id FROM links a JOIN links b ON a.dialogue_id = b.dialogue_id AND a.dst = b.src
  WHERE regexp_matches(a.src, '^L[0-9]') AND regexp_matches(a.dst, '^YA[0-9]') AND regexp_matches(b.dst, '^I[0-9]')
), sided AS (
  SELECT dialogue_id, prop_id, turn, {_SIDE} AS side FROM props WHERE {_SIDE} IS NOT NULL
), crossed AS (
  SELECT n.dialogue_id, n.prop_id AS new_id, e.prop_id AS old_id, n.side, e.side AS old_side FROM sided n JOIN sided e ON n.dialogue_id = e.dialogue_id AND e.turn < n.turn AND e.side <> n.side
), margins AS (SELECT unnest(range(61)) * 0.05::DOUBLE AS raw), margin AS (SELECT round(raw, 2) AS margin FROM margins),
scored AS (SELECT *, {_SCORES} FROM decisions),
taken AS (
  SELECT *, CASE WHEN greatest(s_support, s_attack, s_rephrase) - s_none > margin THEN
    CASE WHEN s_support >= s_attack AND s_support >= s_rephrase THEN 'SUPPORT' WHEN s_attack >= s_rephrase THEN 'ATTACK' ELSE 'REPHRASE' END ELSE 'NONE' END AS taken FROM scored, margin
), held AS (
  SELECT margin, example_id, update_id, {", ".join(f"count(*) FILTER (taken = label AND label = '{k}') AS tp_{k}, count(*) FILTER (taken <> label AND taken = '{k}') AS fp_{k}, count(*) FILTER (taken <> label AND label = '{k}') AS fn_{k}" for k in POSITIVE_LABELS)},
    count(*) FILTER (label <> 'NONE') AS gold, count(*) FILTER (taken <> 'NONE' AND taken <> label) AS fp, count(*) FILTER (taken <> label) AS wrong FROM taken GROUP BY ALL
), grid AS (
  SELECT margin, {_ratio("count(*) FILTER (wrong = 0)", "count(*)")} AS exact_patch_accuracy,
    {_f1(*("sum(" + " + ".join(f"{c}_{k}" for k in POSITIVE_LABELS) + ")" for c in ("tp", "fp", "fn")))} AS edge_f1,
    ({" + ".join(_f1(*(f"sum({c}_{k})" for c in ("tp", "fp", "fn"))) for k in POSITIVE_LABELS)}) / 3 AS relation_macro_f1,
    {_ratio("sum(fp)", "count(DISTINCT update_id)")} AS false_edges_per_update, count(*) FILTER (gold = 0 AND fp > 0) AS none_scenarios_with_false_edges,
    {_f1("sum(tp_ATTACK)", "sum(fp_ATTACK)", "sum(fn_ATTACK)")} AS attack_f1, 1.0::DOUBLE AS json_validity, 1.0::DOUBLE AS schema_validity
  FROM held GROUP BY margin
)
"""
_COUNTS = "count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (NOT in_gold AND in_pred) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn"
_PRF = f"round({_ratio('tp', 'tp + fp')}, 6) AS precision, round({_ratio('tp', 'tp + fn')}, 6) AS recall, round({_f1('tp', 'fp', 'fn')}, 6) AS f1"
_NULL_PRF = f"round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN round({_f1('tp', 'fp', 'fn')}, 6) END AS f1"
_HASH = "sha256('{}|' || {})".format
_POOL = f"pool AS (SELECT category, example_id, row_number() OVER (PARTITION BY category ORDER BY {_HASH('v4', 'example_id')}) AS rk, count(*) OVER (PARTITION BY category) AS n FROM block)"
_CYCLE = f"{_POOL}, cyc AS (SELECT category, i, i // n AS repetition, example_id FROM pool JOIN (VALUES ('ATTACK', 120), ('MIXED', 60), ('REPHRASE', 150), ('SUPPORT', 200), ('NONE', 400)) t(category, want) USING (category), LATERAL (SELECT unnest(range(want)) AS i) WHERE i % n + 1 = rk)"
_HARD_ORDER = "CAST({0}shared >= 2 AS INT) DESC, {0}overlap DESC, {0}shared DESC, {0}jaccard DESC".format
_CONTRAST = f"""pos0 AS (SELECT example_id, old_id AS positive_id, label, {_HASH("v5", "example_id || '|' || old_id || '|' || label")} AS h FROM decisions WHERE label <> 'NONE'),
neg AS (SELECT example_id, old_id AS negative_id, row_number() OVER (PARTITION BY example_id ORDER BY {_HARD_ORDER("")}, new_turn - old_turn, {_HASH("v5", "example_id || '|' || old_id")}) AS rk, count(*) OVER (PARTITION BY example_id) AS m FROM feat WHERE label = 'NONE'),
pos AS (SELECT *, row_number() OVER (ORDER BY h, positive_id) AS rk, count(*) OVER () AS n FROM pos0 WHERE example_id IN (SELECT example_id FROM neg)),
con AS (SELECT i, p.example_id, positive_id, label, negative_id, i // p.n AS repetition FROM pos p JOIN neg ON neg.example_id = p.example_id, LATERAL (SELECT unnest(range(500)) AS i) WHERE i % p.n + 1 = p.rk AND (i // p.n) % m + 1 = neg.rk)"""


def _checks(table: str, thresholds) -> str:
    """(margin, ord, check, value, bound, passed) of every threshold."""
    return " UNION ALL ".join(
        f"SELECT margin, {i} AS ord, '{m}' AS \"check\", CAST({m} AS DOUBLE) AS value, CAST({b!r} AS DOUBLE) AS bound, CASE WHEN {m} IS NULL THEN false ELSE {m} {'>=' if up else '<='} CAST({b!r} AS DOUBLE) END AS passed FROM {table}" for i, (m, up, b) in enumerate(thresholds)
    )


def _failed(thresholds) -> str:
    return f"SELECT margin, bool_and(passed) AS clears, coalesce(string_agg(\"check\", ',' ORDER BY ord) FILTER (NOT passed), '') AS failed FROM ({_checks('grid', thresholds)}) GROUP BY margin"


_SPLIT = "split AS (SELECT dialogue_id, CASE WHEN row_number() OVER (ORDER BY CAST(dialogue_id AS BIGINT) DESC) <= 6 THEN 'eval' ELSE 'train' END AS split FROM (SELECT DISTINCT dialogue_id FROM props))"
_DEV = f"dev AS (SELECT dialogue_id, CASE WHEN row_number() OVER (ORDER BY {_HASH('dev', 'dialogue_id')}) <= 4 THEN 'dev' ELSE 'train' END AS split FROM (SELECT DISTINCT dialogue_id FROM props))"
_QUOTA = f"quota AS (SELECT example_id, dialogue_id, category, row_number() OVER (PARTITION BY dialogue_id, category ORDER BY {_HASH('quota', 'example_id')}) AS rank FROM block QUALIFY rank <= CASE WHEN category = 'NONE' THEN 1 ELSE 2 END)"
_JSON_B = _bucket("json", "example_id")
_RESPONSES = f"""own AS (SELECT example_id, string_agg('{{"source": "' || source || '", "target": "' || target || '", "type": "' || type || '"}}', ', ' ORDER BY source, target, type) AS r FROM pred GROUP BY 1),
raw AS (SELECT example_id, r, '{{"relations": [' || coalesce(r, '') || ']' || CASE WHEN {_JSON_B} < 10 THEN '}} done' WHEN {_JSON_B} < 20 THEN ', "note": 1}}' ELSE '}}' END AS raw FROM (SELECT DISTINCT example_id FROM decisions) LEFT JOIN own USING (example_id)),
resp AS (SELECT example_id, CASE WHEN r IS NOT NULL AND {_JSON_B} BETWEEN 40 AND 49 THEN replace(raw, 'SUPPORT', 'AGREES') WHEN {_JSON_B} BETWEEN 20 AND 39 THEN '```json' || chr(10) || raw || chr(10) || '```' ELSE raw END AS response FROM raw)"""

_BODIES: dict[str, str] = {
    "prop_order": f"SELECT dialogue_id, prop_id, row_number() OVER (PARTITION BY dialogue_id ORDER BY CASE WHEN {_bucket('t', 'prop_id')} >= 10 THEN turn ELSE 1000000000 END, length(text), turn) AS position FROM props",
    "earlier_pairs": "SELECT update_id, new_id, old_id, new_turn, old_turn FROM pairs",
    "block_assign": "SELECT example_id, update_id, old_id, CAST(block_index AS BIGINT) AS block_index FROM decisions",
    "block_category": "SELECT example_id, n_earlier, n_gold, category FROM block",
    "lexical_hardness": "SELECT new_id, old_id, CAST(shared AS BIGINT) AS shared, round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard FROM feat",
    "block_hardness_argmax": "SELECT example_id, CAST(max_shared AS BIGINT) AS max_shared, round(max_overlap, 6) AS max_overlap, round(max_jaccard, 6) AS max_jaccard, turn_gap FROM hard",
    "hard_negatives_v2": "SELECT example_id, update_id, CAST(max_shared AS BIGINT) AS max_shared, turn_gap FROM (SELECT *, max(n_gold) OVER (PARTITION BY update_id) AS any_gold FROM hard) WHERE n_gold = 0 AND any_gold > 0 AND max_shared >= 1",
    "update_filter_anti": f"SELECT DISTINCT update_id, dialogue_id FROM decisions WHERE update_id NOT IN (SELECT update_id FROM decisions WHERE label <> 'NONE' AND {_bucket('n', 'new_id', 'old_id')} < 20)",
    "seeded_rank": f"SELECT example_id, row_number() OVER (ORDER BY {_HASH('rank', 'example_id')}, example_id) AS rank FROM block",
    "quota_topk_diagnostic": f", {_QUOTA} SELECT * FROM quota",
    "eval_backfill_topk": f""", own AS (SELECT *, n_gold > 0 AS pos, {_HASH("eval", "update_id")} AS h FROM upd), r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, pos ORDER BY h) AS o FROM own)
SELECT dialogue_id, update_id, row_number() OVER (PARTITION BY dialogue_id ORDER BY CASE WHEN (pos AND o <= 3) OR (NOT pos AND o <= 2) THEN 0 ELSE 1 END, h) AS rank FROM r QUALIFY rank <= 5""",
    "heldout_split": f", {_SPLIT} SELECT * FROM split",
    "dev_split": f", {_DEV} SELECT * FROM dev",
    "leakage_intersect": f", {_SPLIT}, {_DEV} SELECT dialogue_id FROM split WHERE split = 'eval' INTERSECT SELECT dialogue_id FROM dev WHERE split = 'train'",
    "pair_siblings_v3": f""", none AS (SELECT update_id, example_id AS negative_id FROM hard WHERE n_gold = 0 QUALIFY row_number() OVER (PARTITION BY update_id ORDER BY {_HARD_ORDER("max_")}, turn_gap, {_HASH("v3", "example_id")}) = 1),
pos AS (SELECT update_id, category, example_id AS positive_id FROM block WHERE n_gold > 0 QUALIFY row_number() OVER (PARTITION BY update_id, category ORDER BY {_HASH("v3", "example_id")}) = 1)
SELECT update_id, category, positive_id, negative_id, 'pair-' || substr({_HASH("v3", "positive_id || '|' || negative_id")}, 1, 20) AS pair_id FROM pos JOIN none USING (update_id)""",
    "oversample_cycle_v4": f", {_CYCLE} SELECT * FROM cyc",
    "repetition_index_v4": f", {_CYCLE} SELECT example_id, i, row_number() OVER (PARTITION BY example_id ORDER BY i) - 1 AS repetition, row_number() OVER (PARTITION BY example_id ORDER BY i) > 1 AS is_repeated FROM cyc",
    "pairwise_decisions": f"SELECT example_id, old_id, CASE WHEN label <> 'NONE' THEN label WHEN {_bucket('a', 'new_id', 'old_id')} < 5 THEN 'ATTACK' ELSE 'NONE' END AS decision FROM decisions WHERE NOT (label NOT IN ('NONE', 'ATTACK') AND {_bucket('a', 'new_id', 'old_id')} < 5)",
    "label_distribution": "SELECT label, count(*) AS n, count(DISTINCT update_id) AS updates FROM decisions GROUP BY label",
    "contrast_cycle_v5": f", {_CONTRAST} SELECT * FROM con",
    "pair_rows_v5": f", {_CONTRAST} SELECT i * 2 AS ord, example_id, 'POSITIVE' AS role, positive_id AS target, label FROM con UNION ALL SELECT i * 2 + 1, example_id, 'NONE', negative_id, 'NONE' FROM con",
    "prefix_slice_stats": f""", r AS (SELECT *, row_number() OVER (ORDER BY {_HASH("slice", "example_id")}) AS rk FROM block)
SELECT CAST(slice AS BIGINT) AS slice, count(*) AS n, count(*) FILTER (n_gold > 0) AS positive, count(DISTINCT dialogue_id) AS dialogues FROM r, (VALUES (32), (64), (128), (256)) t(slice) WHERE rk <= slice GROUP BY slice""",
    "edge_confusion": f"SELECT type, {_COUNTS} FROM edges GROUP BY type",
    "micro_prf": f"SELECT tp, fp, fn, {_PRF} FROM (SELECT {_COUNTS} FROM edges)",
    "label_macro_f1": f"SELECT round(sum({_f1('tp', 'fp', 'fn')}) / 3, 6) AS macro_f1 FROM (SELECT type, {_COUNTS} FROM edges GROUP BY type)",
    "label_scores": f"SELECT type, tp, fp, fn, {_PRF} FROM (SELECT t.type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES {', '.join(f"('{k}')" for k in POSITIVE_LABELS)}) t(type) LEFT JOIN (SELECT type, {_COUNTS} FROM edges GROUP BY type) USING (type))",
    "exact_block": f"SELECT count(*) AS n, count(*) FILTER (NOT wrong) AS n_exact, round({_ratio('count(*) FILTER (NOT wrong)', 'count(*)')}, 6) AS rate FROM (SELECT example_id, coalesce(bool_or(in_gold <> in_pred), false) AS wrong FROM (SELECT DISTINCT example_id FROM decisions) LEFT JOIN edges USING (example_id) GROUP BY 1)",
    "exact_update": f""", m AS (SELECT update_id, source, target, type, bool_or(in_gold) AS in_gold, bool_or(in_pred) AS in_pred FROM edges GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (NOT wrong) AS n_exact, round({_ratio("count(*) FILTER (NOT wrong)", "count(*)")}, 6) AS rate FROM (SELECT update_id, coalesce(bool_or(in_gold <> in_pred), false) AS wrong FROM (SELECT DISTINCT update_id FROM decisions) LEFT JOIN m USING (update_id) GROUP BY 1)""",
    "false_edges_per_update": f"SELECT updates, false_edges, round({_ratio('false_edges', 'updates')}, 6) AS rate FROM (SELECT count(DISTINCT update_id) AS updates FROM decisions), (SELECT count(*) AS false_edges FROM (SELECT DISTINCT update_id, source, target, type FROM edges WHERE in_pred AND NOT in_gold))",
    "direction_accuracy": "SELECT count(*) AS evaluable, count(*) FILTER (p.source = g.source) AS correct, round(count(*) FILTER (p.source = g.source) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS accuracy FROM pred p JOIN gold g ON p.example_id = g.example_id AND p.type = g.type AND least(p.source, p.target) = least(g.source, g.target) AND greatest(p.source, p.target) = greatest(g.source, g.target)",
    "invalid_ids": """, e AS (SELECT p.*, CAST(p.source <> n.new_id AS INT) + CAST(NOT EXISTS (SELECT 1 FROM decisions d WHERE d.example_id = p.example_id AND d.old_id = p.target) AS INT) AS invalid FROM pred p JOIN (SELECT DISTINCT example_id, new_id FROM decisions) n USING (example_id))
SELECT CAST(sum(invalid) AS BIGINT) AS invalid_id_count, count(*) FILTER (invalid > 0) AS invalid_relation_count FROM e""",
    "none_diagnostics": f"SELECT count(*) AS none_blocks, count(*) FILTER (hit) AS with_false_edges, round({_ratio('count(*) FILTER (hit)', 'count(*)')}, 6) AS rate FROM (SELECT example_id IN (SELECT example_id FROM pred) AS hit FROM block WHERE n_gold = 0)",
    "failure_listing": "SELECT example_id, coalesce(string_agg(source || '>' || target || '>' || type, ',' ORDER BY source || '>' || target || '>' || type) FILTER (in_pred AND NOT in_gold), '') AS false_positive, coalesce(string_agg(source || '>' || target || '>' || type, ',' ORDER BY source || '>' || target || '>' || type) FILTER (in_gold AND NOT in_pred), '') AS false_negative FROM edges GROUP BY example_id HAVING bool_or(in_gold <> in_pred)",
    "gen1_grouping_sets": f"SELECT scope, value, tp, fp, fn, {_NULL_PRF} FROM (SELECT 'overall' AS scope, 'all' AS value, {_COUNTS} FROM edges UNION ALL SELECT 'label', type, {_COUNTS} FROM edges GROUP BY type UNION ALL SELECT 'provider', 'm' || ({_bucket('prov', 'example_id')} % 3), {_COUNTS} FROM edges GROUP BY 2)",
    "hard_negative_fp": f"""SELECT phenomenon, count(*) AS n, count(*) FILTER (hit) AS false_positives, round({_ratio("count(*) FILTER (hit)", "count(*)")}, 6) AS rate
FROM (SELECT 'h' || ({_bucket("hn", "new_id", "old_id")} % 4) AS phenomenon, EXISTS (SELECT 1 FROM pred p WHERE p.source = new_id AND p.target = old_id) AS hit FROM decisions WHERE label = 'NONE') GROUP BY 1""",
    "margin_grid": "SELECT round(margin, 6) AS margin, round(exact_patch_accuracy, 6) AS exact_patch_accuracy, round(edge_f1, 6) AS edge_f1, round(relation_macro_f1, 6) AS relation_macro_f1, round(false_edges_per_update, 6) AS false_edges_per_update, none_scenarios_with_false_edges, round(attack_f1, 6) AS attack_f1, json_validity, schema_validity FROM grid",
    "margin_select": f", v AS ({_failed(DEVELOPMENT)}) SELECT margin, clears AS gate, round(edge_f1, 6) AS edge_f1 FROM grid JOIN v USING (margin) ORDER BY clears DESC, grid.edge_f1 DESC, exact_patch_accuracy DESC, relation_macro_f1 DESC, false_edges_per_update, none_scenarios_with_false_edges, margin DESC LIMIT 1",
    "gate_checks": _failed(DEVELOPMENT),
    "promotion_gate": f""", cell AS (SELECT example_id, provider, prompt FROM (SELECT DISTINCT example_id FROM decisions), (VALUES ('mini'), ('small')) p(provider), (VALUES ('zero'), ('few'), ('rules')) q(prompt)),
valid AS (SELECT {_ratio(f"count(*) FILTER ({_bucket('json', 'provider', 'prompt', 'example_id')} >= 3)", "count(*)")} AS json_validity, {_ratio(f"count(*) FILTER ({_bucket('json', 'provider', 'prompt', 'example_id')} >= 8)", "count(*)")} AS schema_validity FROM cell),
g1 AS (SELECT grid.*, json_validity, schema_validity, (SELECT avg(CAST({_bucket("rob", "provider", "prompt", "example_id")} % 5 AS DOUBLE)) FROM cell WHERE {_bucket("valid", "provider", "prompt", "example_id")} >= 8) AS judge_robustness FROM (SELECT * EXCLUDE (json_validity, schema_validity) FROM grid) grid, valid)
SELECT "check", round(value, 6) AS value, round(bound, 6) AS bound, passed FROM ({_checks("g1", PROMOTION)}) WHERE margin = 0""",
    "metric_deltas": "SELECT margin, round(edge_f1 - lag(edge_f1) OVER (ORDER BY margin), 6) AS d_edge_f1, round(exact_patch_accuracy - lag(exact_patch_accuracy) OVER (ORDER BY margin), 6) AS d_exact FROM grid",
    "prediction_alignment": f"SELECT example_id IN (SELECT example_id FROM pred) AND {_bucket('miss', 'example_id')} >= 20 AS found, count(*) AS n FROM block GROUP BY 1",
    "grounding_defects": "SELECT CASE WHEN k IS NULL THEN 'missing' WHEN k = 1 THEN 'one' ELSE 'ambiguous' END AS grounding, count(*) AS n FROM props LEFT JOIN (SELECT dialogue_id, to_id, count(*) AS k FROM grounds GROUP BY ALL) g ON props.dialogue_id = g.dialogue_id AND g.to_id = 'I' || turn GROUP BY 1",
    "grounding_two_hop": "SELECT * FROM grounds",
    "topological_order": "SELECT dialogue_id, 'L' || turn AS node_id, CAST(row_number() OVER (PARTITION BY dialogue_id ORDER BY turn) AS INT) AS turn, false AS in_cycle FROM props",
    "weighted_interleave": f""", q AS (SELECT category, example_id, row_number() OVER (PARTITION BY category ORDER BY {_HASH("mix", "example_id")}, example_id) AS rk FROM block),
z AS (SELECT list({{'c': c, 'w': w, 'size': coalesce(n, 0), 'taken': 0}}) AS state FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}) t(c, w) LEFT JOIN (SELECT category, count(*) AS n FROM block GROUP BY 1) ON category = c)
SELECT ord, category, example_id FROM (WITH RECURSIVE walk AS (
  SELECT 0 AS ord, CAST(NULL AS VARCHAR) AS c, CAST(0 AS BIGINT) AS rk, state FROM z UNION ALL
  SELECT ord + 1, p.c, list_filter(state, lambda x: x.c = p.c)[1].taken + 1, list_transform(state, lambda x: {{'c': x.c, 'w': x.w, 'size': x.size, 'taken': x.taken + CAST(x.c = p.c AS INT)}})
  FROM (SELECT *, list_max(list_transform(list_filter(state, lambda x: x.taken < x.size), lambda x: {{'lag': x.w * (ord + 1) - x.taken, 'w': x.w, 'c': x.c}})) AS p FROM walk WHERE ord < 300) WHERE p IS NOT NULL
) SELECT CAST(walk.ord AS BIGINT) AS ord, q.category, q.example_id FROM walk JOIN q ON q.category = walk.c AND q.rk = walk.rk)""",
    "strict_parse_rates": f""", {_RESPONSES}, rel AS (SELECT example_id, count(*) AS n, count(*) FILTER (type <> 'SUPPORT') AS others FROM pred GROUP BY 1), f AS (SELECT resp.example_id, {_JSON_B} AS b, coalesce(n, 0) AS n, coalesce(others, 0) AS others, r IS NOT NULL AS has FROM resp JOIN raw USING (example_id) LEFT JOIN rel USING (example_id))
SELECT count(*) AS n, count(*) FILTER (b NOT BETWEEN 0 AND 9 AND b NOT BETWEEN 20 AND 39) AS json_valid, count(*) FILTER (b >= 40 AND (b >= 50 OR others = n)) AS schema_valid, CAST(sum(CASE WHEN b < 10 OR b BETWEEN 20 AND 39 THEN 0 WHEN b BETWEEN 40 AND 49 THEN others ELSE n END) AS BIGINT) AS relations FROM f""",
    "transition_pairs": "SELECT DISTINCT a.dialogue_id, a.src AS from_id, b.dst AS to_id FROM links a JOIN links b ON a.dialogue_id = b.dialogue_id AND a.dst = b.src WHERE starts_with(a.dst, 'TA') AND a.src <> b.dst",
    "label_normalise": f"SELECT node, CASE node {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NODE_LABELS.items())} END AS label, count(*) AS n FROM (SELECT [{', '.join(f"'{k}'" for k in NODE_LABELS)}][{_bucket('k', 'prop_id')} % 3 + 1] AS node FROM props) GROUP BY 1",
    "canonical_direction": """, t AS (SELECT *, CAST(split_part(source, ':', 2) AS INT) AS a, CAST(split_part(target, ':', 2) AS INT) AS b FROM pred)
SELECT example_id, source, target, type, CASE WHEN a > b THEN 'later_to_earlier' WHEN a < b THEN 'earlier_to_later' ELSE 'same_turn' END AS direction, CASE WHEN a > b THEN source WHEN a < b THEN target END AS canonical_source, CASE WHEN a > b THEN target WHEN a < b THEN source END AS canonical_target FROM t""",
    "cross_side_pairs": "SELECT * FROM crossed",
    "window_ids": """, near AS (SELECT d.new_id, d.old_id, p.turn, abs(p.turn - d.new_turn) <= 1 OR abs(p.turn - d.old_turn) <= 1 AS c, abs(p.turn - (d.new_turn + d.old_turn) / 2.0) AS far FROM decisions d JOIN props p USING (dialogue_id) WHERE label = 'ATTACK'),
r AS (SELECT *, sum(CAST(c AS INT)) OVER (PARTITION BY new_id, old_id) AS nc, row_number() OVER (PARTITION BY new_id, old_id ORDER BY CAST(c AS INT), far, turn) AS k FROM near)
SELECT new_id, old_id, array_to_string(list_slice(list_sort(list_distinct(list(turn))), 1, 5), ',') AS turns FROM r WHERE c OR k <= 4 - nc GROUP BY ALL""",
    "transcript_render": "SELECT dialogue_id, md5(t) AS transcript_md5, length(t) AS n_chars FROM (SELECT dialogue_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn, prop_id) AS t FROM props GROUP BY 1)",
    "speaker_parse": "SELECT prop_id, speaker, CAST(NULL AS VARCHAR) AS none FROM props",
    "fence_normalize": f", {_RESPONSES} SELECT example_id, md5(CASE WHEN {_JSON_B} BETWEEN 20 AND 39 THEN raw ELSE response END) AS body_md5 FROM resp JOIN raw USING (example_id)",
    "assignment_matrix": f", {_QUOTA} SELECT provider || '__' || prompt || '__' || replace(example_id, ':', '_') AS assignment_id, provider, prompt FROM quota, (VALUES ('a'), ('b')) p(provider), (VALUES ('zero'), ('few'), ('rules')) q(prompt)",
    "violations_suite": """, ends AS (SELECT p.source, n.new_id FROM pred p JOIN (SELECT DISTINCT example_id, new_id FROM decisions) n USING (example_id))
SELECT 'blocks_not_contiguous' AS "check", count(*) AS violations FROM (SELECT update_id FROM block GROUP BY 1 HAVING max(block_index) + 1 <> count(*)) UNION ALL
SELECT 'early_block_not_full', count(*) FROM block b WHERE block_index < (SELECT max(block_index) FROM block c WHERE c.update_id = b.update_id) AND n_earlier <> 3 UNION ALL
SELECT 'edge_points_forward', count(*) FROM decisions WHERE old_turn >= new_turn UNION ALL
SELECT 'repeated_pair', count(*) FROM (SELECT new_id FROM decisions GROUP BY new_id, old_id HAVING count(*) > 1) UNION ALL
SELECT 'source_not_new', count(*) FROM ends WHERE source <> new_id""",
    "attachment_hardness": "SELECT d.update_id, count(*) FILTER (label <> 'NONE') * 100 + count(*) FILTER (label = 'NONE' AND c.new_id IS NOT NULL) AS score FROM decisions d LEFT JOIN crossed c ON c.new_id = d.new_id AND c.old_id = d.old_id GROUP BY 1",
    "curriculum_rows": "SELECT row_number() OVER (ORDER BY p_type) AS ord, 'Unit on ' || lower(p_type) AS text, CASE WHEN row_number() OVER (ORDER BY p_type) % 2 = 1 THEN 'AFF' ELSE 'NEG' END AS side FROM (SELECT DISTINCT p_type FROM part)",
    "distribution_stats": "SELECT category, round(min(max_overlap), 6) AS least, round(avg(max_overlap), 6) AS mean, round(max(max_overlap), 6) AS most, count(*) AS n FROM hard JOIN block USING (example_id) GROUP BY 1",
    "ledger_union": f""", c AS (SELECT {_COUNTS} FROM edges), x AS (SELECT example_id, coalesce(bool_or(in_gold <> in_pred), false) AS wrong FROM (SELECT DISTINCT example_id FROM decisions) LEFT JOIN edges USING (example_id) GROUP BY 1)
SELECT 'micro' AS scope, tp, round({_f1("tp", "fp", "fn")}, 6) AS f1, CAST(NULL AS DOUBLE) AS macro_f1, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS rate FROM c UNION ALL
SELECT 'macro', NULL, NULL, round(sum({_f1("tp", "fp", "fn")}) / 3, 6), NULL, NULL FROM (SELECT type, {_COUNTS} FROM edges GROUP BY type) UNION ALL
SELECT 'blocks', NULL, NULL, NULL, count(*), round({_ratio("count(*) FILTER (NOT wrong)", "count(*)")}, 6) FROM x""",
    "most_common_label": "SELECT dialogue_id, label, n FROM (SELECT dialogue_id, label, count(*) AS n, min(new_id) AS f FROM decisions WHERE label <> 'NONE' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY n DESC, f, label) = 1",
    "jury_outcome": f""", j AS (SELECT dialogue_id, coalesce(round(avg({_bucket("jury", "prop_id")}) FILTER (side = 'AFF'), 6), 0) AS a, coalesce(round(avg({_bucket("jury", "prop_id")}) FILTER (side = 'NEG'), 6), 0) AS n FROM sided GROUP BY 1)
SELECT dialogue_id, CASE WHEN a > n THEN 'AFF' WHEN n > a THEN 'NEG' ELSE 'TIE' END AS winner, round(abs(a - n), 4) AS margin FROM j""",
    "judge_means": f"SELECT category, round(avg({_bucket('judge', 'example_id')} % 5) FILTER ({_bucket('valid', 'example_id')} >= 10), 6) AS mean_score, round({_ratio(f'count(*) FILTER ({_bucket("valid", "example_id")} >= 10)', 'count(*)')}, 6) AS validity FROM block GROUP BY 1",
    "secret_scan": r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '\b(sk|hf|ghp|AKIA)[_-]?[A-Za-z0-9]{16,}', 'i')
  OR regexp_matches(text, '(api[_-]?key|access[_-]?key|private[_-]?key|[_-]?key|secret|token|password) *[:=] *["'']?[A-Za-z0-9_+/-]{16,}', 'i')""",
    "event_type_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1",
}


def with_prelude(body: str) -> str:
    return _PRELUDE.rstrip() + " " + body


SQL: dict[str, str] = {name: (body if name in ("secret_scan", "event_type_counts", "curriculum_rows") else with_prelude(body)) for name, body in _BODIES.items()}
