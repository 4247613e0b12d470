"""Queries of the first generation's scores, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gen1
from ..sources import tables as T
from .oracle import _bucket, _f1
from .queries import query, r6

SQL: dict[str, str] = {}


def _facts(s, d):
    return gen1.record_facts(T.graph_records(s, d), T.excerpts(s, d))


_RATES = [
    *[f"{p}{n}" for p in ("", "normalized_") for n in ("valid_rate", "exact_rate", "precision", "recall", "f1", "agreement_rate", "diagnosis_rate")],
    "judge_valid_rate", "judge_correct_rate", "rubric_rate", "mean_spec", "mean_robustness",
]
_COUNTS = ["assignments", "tp", "fp", "fn", "normalized_tp", "normalized_fp", "normalized_fn", "judge_assignments", "rubric_scored"]


@query
def gen1_scores(s, d):
    """Scores of all answers overall, by category, split, model and prompt, and by phenomenon."""
    return gen1.graph_scores(_facts(s, d)).select("scope", "value", *_COUNTS, *[r6(c).alias(c) for c in _RATES])


@query
def gen1_hard_negatives(s, d):
    """How often answers link pairs marked as no response, by mark, in the same scopes."""
    return gen1.hard_negative_rates(_facts(s, d)).select("scope", "value", "kind", "pairs", "hits", "normalized_hits", r6("rate").alias("rate"), r6("normalized_rate").alias("normalized_rate"))


def _b(seed: str) -> str:
    return _bucket(seed, "provider", "prompt", "scenario_id")


def _unit(prop: str) -> str:
    return f"'U' || (CAST(split_part({prop}, ':', 2) AS BIGINT) + 1)"


_MARKS = ", ".join(f"CASE WHEN ({_bucket('ph', 'dialogue_id')} + {7 * i}) % 10 < 3 THEN '{p}' END" for i, p in enumerate(T.PHENOMENA))
_KIND = f"(['{"', '".join(T.HARD_NEGATIVES)}'])[{_bucket('hn', 'new_id', 'old_id')} % 4 + 1]"
_FACTS = f"""
ex AS (
  SELECT dialogue_id AS scenario_id, list_filter([{_MARKS}], lambda x: x IS NOT NULL) AS phenomena,
    CASE WHEN {_bucket("cat", "dialogue_id")} < 50 THEN 'vivesdebate_real' WHEN {_bucket("cat", "dialogue_id")} < 75 THEN 'synthetic_dropped_argument' ELSE 'synthetic_cross_application' END AS category,
    CASE WHEN {_bucket("split", "dialogue_id")} < 60 THEN 'development' ELSE 'heldout_test' END AS split,
    coalesce(list({_unit("new_id")} || '>' || {_unit("old_id")}) FILTER (label <> 'NONE'), []) AS gold,
    coalesce(list({{'kind': {_KIND}, 'pair': {_unit("new_id")} || '>' || {_unit("old_id")}}}) FILTER (label = 'NONE' AND {_bucket("hn", "new_id", "old_id")} < 40), []) AS hard
  FROM decisions GROUP BY dialogue_id
), tl AS (SELECT split_part(update_id, '/', 1) AS scenario_id, list(DISTINCT {_unit("source")} || '>' || {_unit("target")}) AS told FROM pred GROUP BY 1),
gr AS (
  SELECT ex.*, provider || ':' || prompt AS model_prompt, CASE WHEN {_b("drop1")} < 30 THEN gold WHEN {_b("drop1")} < 40 THEN [] ELSE coalesce(told, []) END AS said, {_b("form1")} AS f,
    {_b("asked1")} >= 10 AS asked, {_b("asked1")} >= 10 AND {_b("valid1")} >= 8 AS given, {_b("rubric1")} >= 30 AS rubric, {_b("spec1")} % 5 AS spec, {_b("rob1")} % 5 AS rob, {_b("turn1")} < 10 AS turned, {_b("blind1")} < 20 AS blind
  FROM ex LEFT JOIN tl USING (scenario_id), (VALUES ('mini'), ('small')) p(provider), (VALUES ('zero'), ('few'), ('rules')) q(prompt)
), gv AS (
  SELECT *, f >= 20 AS v, f >= 20 OR f BETWEEN 5 AND 14 AS nv, CASE WHEN f >= 20 THEN said ELSE [] END AS st, CASE WHEN f >= 20 OR f BETWEEN 5 AND 14 THEN said ELSE [] END AS nm FROM gr
), gd AS (
  SELECT *, list_filter(gold, lambda x: NOT list_contains(st, x)) AS miss, list_filter(st, lambda x: NOT list_contains(gold, x)) AS spur, list_filter(gold, lambda x: NOT list_contains(nm, x)) AS nmiss, list_filter(nm, lambda x: NOT list_contains(gold, x)) AS nspur FROM gv
), ge AS (
  SELECT *, v AND len(miss) = 0 AND len(spur) = 0 AS ok, nv AND len(nmiss) = 0 AND len(nspur) = 0 AS nok, CASE WHEN blind THEN [] ELSE nmiss END AS jmiss FROM gd
), gf AS (
  SELECT *, nok <> turned AS says FROM ge
), scoped AS (
  SELECT 'overall' AS scope, 'all' AS value, * FROM gf UNION ALL SELECT 'category', category, * FROM gf UNION ALL SELECT 'split', split, * FROM gf UNION ALL SELECT 'model_prompt', model_prompt, * FROM gf
  UNION ALL SELECT 'phenomenon', unnest(phenomena), * FROM gf
)"""


def _over(a: str, b: str) -> str:
    return f"round(({a}) / CAST(nullif({b}, 0) AS DOUBLE), 6)"


def _side(p: str, n: str) -> str:
    tp, fp, fn = (f"CAST(sum({x}) AS BIGINT)" for x in (f"len(gold) - len({n}miss)", f"len({n}spur)", f"len({n}miss)"))
    return f"""{tp} AS {p}tp, {fp} AS {p}fp, {fn} AS {p}fn, {_over(f"count(*) FILTER ({n}v)", "count(*)")} AS {p}valid_rate, {_over(f"count(*) FILTER ({n}ok)", "count(*)")} AS {p}exact_rate,
  {_over(tp, f"{tp} + {fp}")} AS {p}precision, {_over(tp, f"{tp} + {fn}")} AS {p}recall, CASE WHEN {tp} + {fp} > 0 AND {tp} + {fn} > 0 THEN round({_f1(tp, fp, fn)}, 6) END AS {p}f1,
  {_over(f"count(*) FILTER (given AND says = {n}ok)", "count(*) FILTER (asked)")} AS {p}agreement_rate,
  {_over(f"count(*) FILTER (given AND list_sort(jmiss) = list_sort({n}miss) AND list_sort(nspur) = list_sort({n}spur))", "count(*) FILTER (asked)")} AS {p}diagnosis_rate"""


SQL["gen1_scores"] = f""", {_FACTS} SELECT scope, value, count(*) AS assignments, {_side("", "")}, {_side("normalized_", "n")}, count(*) FILTER (asked) AS judge_assignments, count(*) FILTER (given AND rubric) AS rubric_scored,
  {_over("count(*) FILTER (given)", "count(*) FILTER (asked)")} AS judge_valid_rate, {_over("count(*) FILTER (given AND says)", "count(*) FILTER (asked)")} AS judge_correct_rate, {_over("count(*) FILTER (given AND rubric)", "count(*) FILTER (asked)")} AS rubric_rate,
  {_over("sum(spec) FILTER (given AND rubric)", "count(*) FILTER (given AND rubric)")} AS mean_spec, {_over("sum(rob) FILTER (given AND rubric)", "count(*) FILTER (given AND rubric)")} AS mean_robustness FROM scoped GROUP BY scope, value"""
SQL["gen1_hard_negatives"] = f""", {_FACTS} SELECT scope, value, h.kind AS kind, count(*) AS pairs, count(*) FILTER (list_contains(st, h.pair)) AS hits, count(*) FILTER (list_contains(nm, h.pair)) AS normalized_hits,
  round(count(*) FILTER (list_contains(st, h.pair)) / count(*), 6) AS rate, round(count(*) FILTER (list_contains(nm, h.pair)) / count(*), 6) AS normalized_rate FROM (SELECT scope, value, st, nm, unnest(hard) AS h FROM scoped) GROUP BY ALL"""
