"""Queries that score recorded answers: combinations, gates, coverage, relabelling, reports; with SQL for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.parsing import judge_parse, strict_parse
from ..functions.text import POSITIVE_LABELS, calibrated_label, hash_bucket, ratio
from ..operators import gates, maps, metrics
from ..sources import tables as T
from .oracle import _HASH, _bucket, _f1, _ratio
from .queries import _block_table, _edges, query, r6

SQL: dict[str, str] = {}
BY = ["provider", "prompt"]
MARGIN = 0.35


def sql(name: str, body: str) -> None:
    SQL[name] = body


def _records(s, d):
    """Records with their answers parsed, and the edges of these."""
    r = T.records(s, d).select(*BY, "example_id", "update_id", strict_parse("raw_response").alias("p"), judge_parse("raw_judge").alias("j"), F.length("raw_response").alias("n_chars"))
    told = r.select(*BY, "example_id", "update_id", "p.json_valid", "p.schema_valid", "j.spec", "j.robustness", "n_chars")
    return told, r.select(*BY, "example_id", "update_id", F.inline("p.relations"))


def _combinations(s, d):
    told, edges = _records(s, d)
    at = T.decisions(s, d)
    return metrics.combination_metrics(told, edges, T.gold(at), at, BY)


def _rb(seed: str) -> str:
    return _bucket(seed, "provider", "prompt", "example_id")


RECORDS = f"""
rec AS (
  SELECT example_id, update_id, provider, prompt, {_rb("json")} >= 3 AS json_valid, {_rb("json")} >= 8 AS schema_valid, {_rb("json")} AS jb, {_rb("drop")} AS db,
    CASE WHEN {_rb("valid")} >= 8 THEN {_rb("spec")} % 5 END AS spec, CASE WHEN {_rb("valid")} >= 8 THEN {_rb("rob")} % 5 END AS robustness
  FROM (SELECT DISTINCT example_id, update_id FROM decisions), (VALUES ('mini'), ('small')) p(provider), (VALUES ('zero'), ('few'), ('rules')) q(prompt)
), rp AS (SELECT r.provider, r.prompt, p.* FROM pred p JOIN rec r USING (example_id) WHERE db >= 10 AND json_valid),
re AS (SELECT provider, prompt, example_id, update_id, source, target, type, max(g) = 1 AS in_gold, max(p) = 1 AS in_pred FROM (SELECT provider, prompt, example_id, gold.update_id, source, target, type, 1 AS g, 0 AS p FROM gold JOIN rec USING (example_id) UNION ALL SELECT *, 0, 1 FROM rp) GROUP BY ALL),
rl AS (SELECT provider, prompt, type, count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (NOT in_gold AND in_pred) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM re GROUP BY ALL),
ru AS (SELECT provider, prompt, update_id, count(*) FILTER (g <> p) AS wrong, count(*) FILTER (p AND NOT g) AS false_edges FROM (SELECT provider, prompt, update_id, source, target, type, bool_or(in_gold) AS g, bool_or(in_pred) AS p FROM re GROUP BY ALL) GROUP BY ALL),
rs AS (SELECT provider, prompt, count(*) AS update_count, {_ratio("count(*) FILTER (valid AND coalesce(wrong, 0) = 0)", "count(*)")} AS exact_scenario_patch_accuracy, {_ratio("sum(coalesce(false_edges, 0))", "count(*)")} AS false_edges_per_update
  FROM (SELECT provider, prompt, update_id, bool_and(schema_valid) AS valid FROM rec GROUP BY ALL) LEFT JOIN ru USING (provider, prompt, update_id) GROUP BY ALL),
rm AS (SELECT provider, prompt, {_f1("sum(tp)", "sum(fp)", "sum(fn)")} AS edge_f1, sum({_f1("tp", "fp", "fn")}) / 3 AS relation_macro_f1 FROM rl GROUP BY ALL),
rd AS (SELECT provider, prompt, count(*) FILTER (p.source = g.source) / CAST(count(*) AS DOUBLE) AS direction_accuracy FROM rp p JOIN gold g ON p.example_id = g.example_id AND p.type = g.type AND least(p.source, p.target) = least(g.source, g.target) AND greatest(p.source, p.target) = greatest(g.source, g.target) GROUP BY ALL),
rb AS (SELECT provider, prompt, sum(CAST(p.source <> n.new_id AS INT) + CAST(NOT EXISTS (SELECT 1 FROM decisions d WHERE d.example_id = p.example_id AND d.old_id = p.target) AS INT)) AS invalid_id_count FROM rp p JOIN (SELECT DISTINCT example_id, new_id FROM decisions) n USING (example_id) GROUP BY ALL),
rr AS (SELECT provider, prompt, {_ratio("count(*) FILTER (json_valid)", "count(*)")} AS json_validity_rate, {_ratio("count(*) FILTER (schema_valid)", "count(*)")} AS schema_validity_rate, {_ratio("count(spec)", "count(*)")} AS judge_validity_rate, coalesce(avg(spec), 0) AS judge_spec_adherence_mean, coalesce(avg(robustness), 0) AS judge_robustness_mean FROM rec GROUP BY ALL),
cm AS (SELECT rr.*, update_count, exact_scenario_patch_accuracy, false_edges_per_update, coalesce(edge_f1, 0) AS edge_f1, coalesce(relation_macro_f1, 0) AS relation_macro_f1, direction_accuracy, coalesce(invalid_id_count, 0) AS invalid_id_count
  FROM rr LEFT JOIN rs USING (provider, prompt) LEFT JOIN rm USING (provider, prompt) LEFT JOIN rd USING (provider, prompt) LEFT JOIN rb USING (provider, prompt))
"""
_METRICS = [m for m, _, _ in gates.RELIABILITY]


def _reliability_sql() -> str:
    return " UNION ALL ".join(f"SELECT provider, prompt, {i} AS ord, '{m}' AS \"check\", CAST({m} AS DOUBLE) AS value, CASE WHEN {m} IS NULL THEN false ELSE {m} {'>=' if up else '<='} {b!r} END AS passed FROM cm" for i, (m, up, b) in enumerate(gates.RELIABILITY))


@query
def combination_metrics(s, d):
    return _combinations(s, d).select(*BY, *[r6(F.col(m).cast("double")).alias(m) for m in _METRICS])


sql("combination_metrics", f", {RECORDS} SELECT provider, prompt, {', '.join(f'round(CAST({m} AS DOUBLE), 6) AS {m}' for m in _METRICS)} FROM cm")


@query
def reliability_checks(s, d):
    """The twelve checks of each combination."""
    return gates.check_thresholds(_combinations(s, d), gates.RELIABILITY, BY).select(*BY, F.col("ord").cast("long"), "check", r6("value").alias("value"), "passed")


sql("reliability_checks", f", {RECORDS} SELECT provider, prompt, CAST(ord AS BIGINT) AS ord, \"check\", round(value, 6) AS value, passed FROM ({_reliability_sql()})")


@query
def gate_verdict(s, d):
    m = _combinations(s, d)
    cells = gates.failures(gates.check_thresholds(m, gates.RELIABILITY, BY), BY).join(m.select(*BY, ((F.col("update_count") >= 30) & (F.col("judge_validity_rate") >= 1.0)).alias("complete")), BY)
    return gates.gate_verdict(cells, T.PROVIDERS, T.PROMPTS)


sql("gate_verdict", f""", {RECORDS}, v AS (SELECT provider, prompt, bool_and(passed) AS clears FROM ({_reliability_sql()}) GROUP BY ALL), c AS (SELECT v.*, update_count >= 30 AND judge_validity_rate >= 1 AS complete FROM v JOIN cm USING (provider, prompt))
SELECT count(*) AS cells, bool_and(complete) AND count(*) = 6 AS measurement_complete, coalesce(string_agg(provider || ':' || prompt, ',' ORDER BY provider || ':' || prompt) FILTER (clears), '') AS bar_clearing, CASE WHEN bool_and(complete) AND count(*) = 6 AND NOT bool_or(clears) THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")


@query
def best_cell(s, d):
    """The combination with the best (specification, robustness, exact) means, the first of equals."""
    order = [F.col(c).desc() for c in ("judge_spec_adherence_mean", "judge_robustness_mean", "exact_scenario_patch_accuracy")]
    return _combinations(s, d).orderBy(*order, *BY).limit(1).select(*BY, r6("judge_spec_adherence_mean").alias("spec"), r6("judge_robustness_mean").alias("robustness"))


sql("best_cell", f", {RECORDS} SELECT provider, prompt, round(judge_spec_adherence_mean, 6) AS spec, round(judge_robustness_mean, 6) AS robustness FROM cm ORDER BY judge_spec_adherence_mean DESC, judge_robustness_mean DESC, exact_scenario_patch_accuracy DESC, provider, prompt LIMIT 1")


@query
def development_gate(s, d):
    """Seven checks at every margin."""
    grid = metrics.margin_grid(T.scores(T.decisions(s, d)), gates.MARGINS)
    return gates.check_thresholds(grid, gates.DEVELOPMENT, ["margin"]).groupBy("margin").agg(F.bool_and("passed").alias("passed"), F.count_if("passed").alias("passed_check_count"))


_DEV_CHECKS = " + ".join(f"CAST(coalesce({m} {'>=' if up else '<='} {b!r}, false) AS INT)" for m, up, b in gates.DEVELOPMENT)
sql("development_gate", f"SELECT margin, ({_DEV_CHECKS}) = 7 AS passed, CAST({_DEV_CHECKS} AS BIGINT) AS passed_check_count FROM grid")


@query
def formatting_failures(s, d):
    """Answers that fail by their form alone: not of the schema, yet no edge wrong."""
    told, edges = _records(s, d)
    gold = T.gold(T.decisions(s, d)).select(*metrics.EDGE).distinct()
    e = gold.withColumn("g", F.lit(1)).join(told.select(*BY, "example_id"), "example_id").join(edges.select(*BY, *metrics.EDGE).distinct().withColumn("p", F.lit(1)), [*BY, *metrics.EDGE], "full")
    wrong = e.where("g IS NULL OR p IS NULL").select(*BY, "example_id").distinct()
    return told.where("NOT schema_valid").join(wrong, [*BY, "example_id"], "left_anti").select(*BY, "example_id", "json_valid")


sql("formatting_failures", f", {RECORDS} SELECT provider, prompt, example_id, json_valid FROM rec r WHERE NOT schema_valid AND NOT EXISTS (SELECT 1 FROM re WHERE re.provider = r.provider AND re.prompt = r.prompt AND re.example_id = r.example_id AND in_gold <> in_pred)")


@query
def prediction_coverage(s, d):
    """Errors of a prediction file against its blocks: one in ten missing, one in twenty repeated, some unknown."""
    b = _block_table(s, d).select("example_id")
    k = hash_bucket("cov", F.col("example_id"))
    ids = F.when(k < 10, F.array().cast("array<string>")).when(k < 15, F.array("example_id", "example_id")).when(k < 18, F.array("example_id", F.concat("example_id", F.lit("x")))).otherwise(F.array("example_id"))
    return metrics.coverage_errors(b.select(F.explode(ids).alias("example_id")), b)


_COV = _bucket("cov", "example_id")
sql("prediction_coverage", f"SELECT 'missing' AS error, example_id AS id FROM block WHERE {_COV} < 10 UNION ALL SELECT 'repeated', example_id FROM block WHERE {_COV} >= 10 AND {_COV} < 15 UNION ALL SELECT 'unknown', example_id || 'x' FROM block WHERE {_COV} >= 15 AND {_COV} < 18")


@query
def benchmark_alignment(s, d):
    """Scenarios and gold blueprints, one to one: which side lacks a partner."""
    u = T.decisions(s, d).select("update_id").distinct()
    k = hash_bucket("align", F.col("update_id"))
    scenarios, gold = u.where(k >= 5).withColumn("s", F.lit(True)), u.where(k < 95).withColumn("g", F.lit(True))
    side = F.when(F.col("s").isNull(), "no_scenario").when(F.col("g").isNull(), "no_gold").otherwise("aligned")
    return scenarios.join(gold, "update_id", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


sql("benchmark_alignment", f"SELECT CASE WHEN {_bucket('align', 'update_id')} < 5 THEN 'no_scenario' WHEN {_bucket('align', 'update_id')} >= 95 THEN 'no_gold' ELSE 'aligned' END AS side, count(*) AS n FROM (SELECT DISTINCT update_id FROM decisions) GROUP BY 1")


@query
def replay_join(s, d):
    """Recorded answers of one combination put back onto their blocks, accepted ones only."""
    told, _ = _records(s, d)
    accepted = told.where("provider = 'small' AND prompt = 'rules' AND schema_valid AND spec >= 3").select("example_id", "spec")
    return _block_table(s, d).join(accepted, "example_id").select("example_id", "category", "spec")


sql("replay_join", f", {RECORDS} SELECT example_id, category, spec FROM block JOIN rec USING (example_id) WHERE provider = 'small' AND prompt = 'rules' AND schema_valid AND spec >= 3")


@query
def judge_parse_rates(s, d):
    told, _ = _records(s, d)
    return told.groupBy(*BY).agg(F.count("spec").alias("valid"), F.count(F.lit(1)).alias("n"), F.sum("spec").alias("spec"), F.sum("robustness").alias("robustness"))


sql("judge_parse_rates", f", {RECORDS} SELECT provider, prompt, count(spec) AS valid, count(*) AS n, CAST(sum(spec) AS BIGINT) AS spec, CAST(sum(robustness) AS BIGINT) AS robustness FROM rec GROUP BY ALL")


def _scored(labels=POSITIVE_LABELS):
    return {k: F.col(f"s_{k.lower()}") for k in labels}


@query
def raw_argmax(s, d):
    """The label of the largest score, NONE first among equals."""
    best = F.greatest(*[F.struct(c.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("label")) for i, (k, c) in enumerate(_scored(("NONE", *POSITIVE_LABELS)).items())])
    return T.scores(T.decisions(s, d)).select("example_id", "old_id", best["label"].alias("label"))


sql("raw_argmax", "SELECT example_id, old_id, CASE greatest(s_none, s_support, s_attack, s_rephrase) WHEN s_none THEN 'NONE' WHEN s_support THEN 'SUPPORT' WHEN s_attack THEN 'ATTACK' ELSE 'REPHRASE' END AS label FROM scored")


@query
def relabel_at_margin(s, d):
    """Answers put together anew from calibrated decisions in block order, beside the raw ones."""
    at = T.scores(T.decisions(s, d)).withColumn("calibrated", calibrated_label(_scored(), F.col("s_none"), F.lit(MARGIN)))
    at = at.withColumn("raw", calibrated_label(_scored(), F.col("s_none"), F.lit(0.0)))
    rows = F.array_sort(F.collect_list(F.struct("rank", "old_id", "calibrated", "raw")))
    b = at.groupBy("example_id", "new_id").agg(rows.alias("rows"))
    of = lambda label: maps.pairwise_patch(F.col("new_id"), F.transform("rows", lambda x: F.struct(x["old_id"].alias("target"), x[label].alias("label"))))
    return b.select("example_id", of("calibrated").alias("raw_response"), of("raw").alias("uncalibrated_raw_response"), F.lit(MARGIN).alias("calibration_margin"))


def _patch_sql(margin: float) -> str:
    label = f"CASE WHEN greatest(s_support, s_attack, s_rephrase) - s_none > {margin!r}::DOUBLE THEN CASE WHEN s_support >= s_attack AND s_support >= s_rephrase THEN 'SUPPORT' WHEN s_attack >= s_rephrase THEN 'ATTACK' ELSE 'REPHRASE' END ELSE 'NONE' END"
    return f"""'{{"relations":[' || coalesce(string_agg('{{"source":"' || new_id || '","target":"' || old_id || '","type":"' || ({label}) || '"}}', ',' ORDER BY old_turn, old_id) FILTER (({label}) <> 'NONE'), '') || ']}}'"""


sql("relabel_at_margin", f"SELECT example_id, {_patch_sql(MARGIN)} AS raw_response, {_patch_sql(0.0)} AS uncalibrated_raw_response, {MARGIN!r}::DOUBLE AS calibration_margin FROM scored GROUP BY example_id")


@query
def example_diagnostics(s, d):
    """Five figures of each answer that a judge is shown: edges right, spurious, missed, wrong ends, exactness."""
    at = T.decisions(s, d)
    e = _edges(s, d).groupBy("example_id").agg(*metrics.counts())
    bad = metrics.invalid_ends(T.predicted(at), at).groupBy("example_id").agg(F.sum("invalid").alias("invalid"))
    out = at.select("example_id").distinct().join(e, "example_id", "left").join(bad, "example_id", "left").fillna(0)
    return out.select("example_id", "tp", "fp", "fn", F.col("invalid").cast("long").alias("invalid"), (F.col("fp") + F.col("fn") == 0).alias("exact"))


sql("example_diagnostics", """, e AS (SELECT example_id, count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (NOT in_gold AND in_pred) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM edges GROUP BY 1),
i AS (SELECT p.example_id, sum(CAST(p.source <> n.new_id AS INT) + CAST(NOT EXISTS (SELECT 1 FROM decisions d WHERE d.example_id = p.example_id AND d.old_id = p.target) AS INT)) AS invalid FROM pred p JOIN (SELECT DISTINCT example_id, new_id FROM decisions) n USING (example_id) GROUP BY 1)
SELECT example_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, CAST(coalesce(invalid, 0) AS BIGINT) AS invalid, coalesce(fp + fn, 0) = 0 AS exact FROM (SELECT DISTINCT example_id FROM decisions) LEFT JOIN e USING (example_id) LEFT JOIN i USING (example_id)""")


@query
def none_false_labels(s, d):
    """Labels of the edges predicted in blocks without gold."""
    none = _block_table(s, d).where("n_gold = 0").select("example_id")
    return T.predicted(T.decisions(s, d)).join(none, "example_id", "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("example_id").alias("blocks"))


sql("none_false_labels", "SELECT type, count(*) AS edges, count(DISTINCT example_id) AS blocks FROM pred WHERE example_id IN (SELECT example_id FROM block WHERE n_gold = 0) GROUP BY type")


@query
def output_length_ratio(s, d):
    """Characters of the answers of blocks with gold against those without."""
    r = relabel_at_margin(s, d).join(_block_table(s, d).select("example_id", "n_gold"), "example_id")
    n = F.length("raw_response")
    out = r.agg(F.sum(F.when(F.col("n_gold") > 0, n)).alias("positive_chars"), F.sum(F.when(F.col("n_gold") == 0, n)).alias("none_chars"))
    return out.withColumn("ratio", r6(ratio(F.col("positive_chars"), F.col("none_chars"))))


sql("output_length_ratio", f""", r AS (SELECT example_id, length({_patch_sql(MARGIN)}) AS n FROM scored GROUP BY example_id), t AS (SELECT CAST(sum(n) FILTER (n_gold > 0) AS BIGINT) AS positive_chars, CAST(sum(n) FILTER (n_gold = 0) AS BIGINT) AS none_chars FROM r JOIN block USING (example_id))
SELECT positive_chars, none_chars, round({_ratio("positive_chars", "none_chars")}, 6) AS ratio FROM t""")


@query
def dry_run_manifest(s, d):
    """What a run would ask: calls per provider, prompt and category."""
    return T.records(s, d).select(*BY, "example_id").join(_block_table(s, d).select("example_id", "category"), "example_id").groupBy(*BY, "category").agg(F.count(F.lit(1)).alias("candidate_calls"), (F.count(F.lit(1)) * 2).alias("calls_with_judge"))


sql("dry_run_manifest", f", {RECORDS} SELECT provider, prompt, category, count(*) AS candidate_calls, count(*) * 2 AS calls_with_judge FROM rec JOIN block USING (example_id) GROUP BY ALL")


@query
def efficiency_curve(s, d):
    """Scores over nested prefixes of the blocks in seeded order."""
    from ..operators.selection import seeded_rank

    ranked = seeded_rank(_block_table(s, d).select("example_id"), "curve", "example_id")
    cut = ranked.withColumn("n", F.explode(F.array(*map(F.lit, (12, 24, 48, 96))))).where("rank <= n").select("example_id", "n")
    e = _edges(s, d).join(cut, "example_id").groupBy("n").agg(*metrics.counts())
    return metrics.with_prf(e).select(F.col("n").cast("long"), "tp", "fp", "fn", r6("f1").alias("f1"))


sql("efficiency_curve", f""", r AS (SELECT example_id, row_number() OVER (ORDER BY {_HASH("curve", "example_id")}, example_id) AS rk FROM block), c AS (SELECT example_id, CAST(n AS BIGINT) AS n FROM r, (VALUES (12), (24), (48), (96)) t(n) WHERE rk <= n),
e AS (SELECT n, count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (NOT in_gold AND in_pred) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM edges JOIN c USING (example_id) GROUP BY n) SELECT n, tp, fp, fn, round({_f1("tp", "fp", "fn")}, 6) AS f1 FROM e""")


@query
def curve_deltas(s, d):
    """Each point of the curve against the one before it."""
    w = Window.orderBy("n")  # four rows
    return efficiency_curve(s, d).select("n", r6(F.col("f1") - F.lag("f1").over(w)).alias("d_f1"), (F.col("tp") - F.lag("tp").over(w)).alias("d_tp"))


sql("curve_deltas", SQL["efficiency_curve"].rpartition("SELECT n, tp")[0] + f", f AS (SELECT n, tp, round({_f1('tp', 'fp', 'fn')}, 6) AS f1 FROM e) SELECT n, round(f1 - lag(f1) OVER (ORDER BY n), 6) AS d_f1, tp - lag(tp) OVER (ORDER BY n) AS d_tp FROM f")
