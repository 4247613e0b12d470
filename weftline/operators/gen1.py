"""Scores of the first generation: which unit responds to which, answers as they stand and without their fence, and what a judge says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import diagnosis_parse, graph_parse
from ..functions.text import unfence

#: Groups that a record is in once; it may show several phenomena, or none.
ONCE = ("category", "split", "model_prompt")


def _same(a: Column, b: Column) -> Column:
    """Equal as sets; the lists hold no nulls."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def record_facts(records: DataFrame, excerpts: DataFrame) -> DataFrame:
    """One row per record with whole-number facts that any group adds up.

    ``records`` has (provider, prompt, scenario_id, raw_response, raw_judge),
    the last null where no judge was asked.  An answer that isn't valid has no
    edges.  The edges of an excerpt are few, so sets are compared within rows.
    """
    r = records.select("provider", "prompt", "scenario_id", graph_parse("raw_response").alias("strict"), graph_parse(unfence(F.col("raw_response"))).alias("normal"), F.col("raw_judge").isNotNull().alias("asked"), diagnosis_parse("raw_judge").alias("judge"))
    at = r.join(excerpts, "scenario_id")
    gold, number = F.col("gold"), lambda c: F.coalesce(c.cast("long"), F.lit(0))
    facts: dict[str, Column] = {"assignments": F.lit(1).cast("long"), "judge_assignments": number(F.col("asked"))}
    given = F.col("judge.correct").isNotNull()
    scored = F.col("judge.spec").isNotNull()
    facts |= {"judge_valid": number(given), "judge_says_correct": number(F.col("judge.correct")), "rubric_scored": number(scored), "spec_total": number(F.col("judge.spec")), "robustness_total": number(F.col("judge.robustness"))}
    for prefix, side in (("", "strict"), ("normalized_", "normal")):
        valid, told = F.col(f"{side}.valid"), F.col(f"{side}.edges")
        missed, spurious = F.array_except(gold, told), F.array_except(told, gold)
        exact = valid & (F.size(missed) == 0) & (F.size(spurious) == 0)
        diagnosed = _same(F.col("judge.missed"), missed) & _same(F.col("judge.spurious"), spurious)
        facts |= {
            f"{prefix}valid": number(valid), f"{prefix}exact": number(exact), f"{prefix}tp": F.size(F.array_intersect(gold, told)).cast("long"), f"{prefix}fp": F.size(spurious).cast("long"), f"{prefix}fn": F.size(missed).cast("long"),
            f"{prefix}agreement": number(given & (F.col("judge.correct") == exact)), f"{prefix}diagnosis": number(given & diagnosed),
        }
    hits = lambda side: F.transform("hard", lambda h: F.array_contains(F.col(f"{side}.edges"), F.struct(h["source"], h["target"])).cast("long"))
    pairs = F.zip_with(F.zip_with("hard", hits("strict"), lambda h, a: F.struct(h["phenomenon"].alias("kind"), a.alias("hits"))), hits("normal"), lambda x, b: F.struct(x["kind"], x["hits"], b.alias("normalized_hits")))
    return at.select("scenario_id", "category", "split", F.concat_ws(":", "provider", "prompt").alias("model_prompt"), "phenomena", pairs.alias("hard_pairs"), *[c.alias(k) for k, c in facts.items()])


def by_scope(facts: DataFrame, sums: list[Column], more: tuple[str, ...] = ()) -> DataFrame:
    """``sums`` overall, by each group of :data:`ONCE` and by phenomenon, as (scope, value, *more, ...).

    A record of several phenomena counts in each; that branch is apart, so it
    counts once in every other.
    """
    sets = [[*more], *([F.col(c), *more] for c in ONCE)]
    out = facts.groupingSets([[F.col(c) if isinstance(c, str) else c for c in x] for x in sets], *[F.col(c) for c in (*ONCE, *more)])
    out = out.agg(*sums, *[F.grouping(c).alias(f"no_{c}") for c in ONCE])
    scope = F.coalesce(*[F.when(F.col(f"no_{c}") == 0, F.lit(c)) for c in ONCE], F.lit("overall"))
    value = F.coalesce(*[F.when(F.col(f"no_{c}") == 0, F.col(c)) for c in ONCE], F.lit("all"))
    one = out.select(scope.alias("scope"), value.alias("value"), *[c for c in out.columns if c not in ONCE and not c.startswith("no_")])
    each = facts.withColumn("value", F.explode("phenomena")).groupBy(F.lit("phenomenon").alias("scope"), "value", *more).agg(*sums)
    return one.unionByName(each)


def _rate(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def graph_scores(facts: DataFrame) -> DataFrame:
    """All counts and rates of each scope; a rate without denominator is null, an F1 of nothing right is 0."""
    names = [c for c, t in facts.dtypes if t == "bigint"]
    out = by_scope(facts, [F.sum(c).alias(c) for c in names])
    rates: dict[str, Column] = {}
    for p in ("", "normalized_"):
        precision, recall = F.try_divide(F.col(f"{p}tp").cast("double"), F.col(f"{p}tp") + F.col(f"{p}fp")), F.try_divide(F.col(f"{p}tp").cast("double"), F.col(f"{p}tp") + F.col(f"{p}fn"))
        both = F.when(precision.isNotNull() & recall.isNotNull(), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
        rates |= {f"{p}valid_rate": _rate(f"{p}valid", "assignments"), f"{p}exact_rate": _rate(f"{p}exact", "assignments"), f"{p}precision": precision, f"{p}recall": recall, f"{p}f1": both}
        rates |= {f"{p}agreement_rate": _rate(f"{p}agreement", "judge_assignments"), f"{p}diagnosis_rate": _rate(f"{p}diagnosis", "judge_assignments")}
    rates |= {"judge_valid_rate": _rate("judge_valid", "judge_assignments"), "judge_correct_rate": _rate("judge_says_correct", "judge_assignments"), "rubric_rate": _rate("rubric_scored", "judge_assignments")}
    rates |= {"mean_spec": _rate("spec_total", "rubric_scored"), "mean_robustness": _rate("robustness_total", "rubric_scored")}
    return out.withColumns(rates)


def hard_negative_rates(facts: DataFrame) -> DataFrame:
    """(scope, value, kind, pairs, hits, normalized_hits, rate, normalized_rate): answers that link a pair marked as no response, by mark."""
    each = facts.withColumn("h", F.explode("hard_pairs")).select(*ONCE, "phenomena", "h.*")
    out = by_scope(each, [F.count(F.lit(1)).alias("pairs"), F.sum("hits").alias("hits"), F.sum("normalized_hits").alias("normalized_hits")], ("kind",))
    return out.withColumns({"rate": _rate("hits", "pairs"), "normalized_rate": _rate("normalized_hits", "pairs")})
