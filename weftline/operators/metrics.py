"""Set-based scoring of predicted edges. A ratio without denominator is 0 here, but direction accuracy is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import POSITIVE_LABELS, f1, ratio

EDGE = ["example_id", "update_id", "source", "target", "type"]


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Every edge of either side with in_gold and in_pred; sets, so repeated edges count once."""
    g = gold.select(*EDGE).distinct().withColumn("in_gold", F.lit(True))
    p = pred.select(*EDGE).distinct().withColumn("in_pred", F.lit(True))
    return g.join(p, EDGE, "full").fillna(False, ["in_gold", "in_pred"])


def counts() -> list:
    tp, fp, fn = (F.col("in_gold") & F.col("in_pred")), (~F.col("in_gold") & F.col("in_pred")), (F.col("in_gold") & ~F.col("in_pred"))
    return [F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn")]


def with_prf(df: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def label_scores(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and P/R/F1 of each of the three labels, also of those without edges."""
    found = edges.groupBy(*by, "type").agg(*counts())
    kinds = F.explode(F.array(*map(F.lit, POSITIVE_LABELS))).alias("type")
    every = edges.select(*by).distinct().select(*by, kinds) if by else edges.sparkSession.range(1).select(kinds)
    return with_prf(every.join(found, [*by, "type"], "left").fillna(0, ["tp", "fp", "fn"]))


def macro_f1(edges: DataFrame) -> DataFrame:
    return label_scores(edges).agg((F.sum("f1") / len(POSITIVE_LABELS)).alias("macro_f1"))


def exact(examples: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Whether each key's edges agree; keys without edges agree."""
    wrong = edges.groupBy(key).agg(F.count_if(F.col("in_gold") != F.col("in_pred")).alias("wrong"))
    return examples.select(key).distinct().join(wrong, key, "left").select(key, (F.coalesce("wrong", F.lit(0)) == 0).alias("exact"))


def exact_rate(examples: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    e = exact(examples, edges, key)
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact")).withColumn("rate", ratio(F.col("n_exact"), F.col("n")))


def merged_updates(edges: DataFrame) -> DataFrame:
    """Edges of all blocks of an update as one set."""
    key = ["update_id", "source", "target", "type"]
    return edges.groupBy(*key).agg(F.max("in_gold").alias("in_gold"), F.max("in_pred").alias("in_pred"))


def false_edges_per_update(examples: DataFrame, edges: DataFrame) -> DataFrame:
    n = examples.agg(F.count_distinct("update_id").alias("updates"))
    wrong = edges.where("in_pred AND NOT in_gold").select("update_id", "source", "target", "type").distinct().agg(F.count(F.lit(1)).alias("false_edges"))
    one = n.join(wrong, F.lit(True))  # one row each
    return one.withColumn("rate", ratio(F.col("false_edges"), F.col("updates")))


def direction_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Of predicted edges whose unordered pair and label are gold, those with the gold direction."""
    pair = lambda df: df.select(*EDGE).distinct().withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})
    g = pair(gold).select("example_id", "lo", "hi", "type", F.col("source").alias("gold_source"))
    both = pair(pred).join(g, ["example_id", "lo", "hi", "type"])
    out = both.agg(F.count(F.lit(1)).alias("evaluable"), F.count_if(F.col("source") == F.col("gold_source")).alias("correct"))
    return out.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("evaluable").cast("double")))


def invalid_ends(pred: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per predicted edge the ends that its block doesn't allow: a source other than the new proposition, a target not in the block."""
    new = decisions.select("example_id", "new_id").distinct()
    old = decisions.select("example_id", F.col("old_id").alias("target"), F.lit(0).alias("_ok"))
    at = pred.join(new, "example_id").join(old, ["example_id", "target"], "left")
    return at.withColumn("invalid", (F.col("source") != F.col("new_id")).cast("int") + F.coalesce("_ok", F.lit(1)))


def none_diagnostics(blocks: DataFrame, pred: DataFrame) -> DataFrame:
    """Blocks without gold: how many get an edge all the same."""
    per = pred.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_pred"))
    out = blocks.where("n_gold = 0").join(per, "example_id", "left").agg(F.count(F.lit(1)).alias("none_blocks"), F.count_if(F.col("n_pred") > 0).alias("with_false_edges"))
    return out.withColumn("rate", ratio(F.col("with_false_edges"), F.col("none_blocks")))


def grouped_scores(edges: DataFrame, groups: list[str]) -> DataFrame:
    """Scores overall and by each group column on its own, in one pass of grouping sets; a ratio without denominator is null."""
    sets = [[F.col(c)] for c in groups]
    out = edges.groupingSets([[], *sets], *[F.col(c) for c in groups]).agg(*counts(), F.grouping_id().alias("gid"))
    p, r = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    out = out.withColumns({"precision": p, "recall": r})
    both = F.when(F.col("precision").isNotNull() & F.col("recall").isNotNull(), f1(F.col("precision"), F.col("recall")))
    scope = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in groups], F.lit("overall"))
    return out.select(scope.alias("scope"), F.coalesce(*groups, F.lit("all")).alias("value"), "tp", "fp", "fn", "precision", "recall", both.alias("f1"))


def margin_grid(scored: DataFrame, margins: list[float]) -> DataFrame:
    """Scores at every margin, each decision and block counted once.

    A decision takes its best label at the first ``k`` margins and NONE after
    them.  So a block is exact on one range of margins, and a range or a
    histogram over ``k`` says all; only these counts, some thousand rows
    whatever the data, meet the margins.  Answers put together from decisions
    are always valid JSON of the schema.
    """
    n = len(margins)
    labels = {k: F.col(f"s_{k.lower()}") for k in POSITIVE_LABELS}
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("label")) for i, (k, s) in enumerate(labels.items())])
    k = F.size(F.filter(F.array(*map(F.lit, margins)), lambda m: F.col("best.s") - F.col("s_none") > m))
    at = scored.withColumn("best", best).select("example_id", "update_id", "label", F.col("best.label").alias("taken"), k.alias("k"))

    per = at.groupBy("taken", "label", "k").agg(F.count(F.lit(1)).alias("n"))
    right = (F.col("label") != "NONE") & (F.col("taken") == F.col("label"))
    block = at.groupBy("example_id").agg(
        F.coalesce(F.max(F.when(F.col("label") == "NONE", F.col("k"))), F.lit(0)).alias("low"), F.coalesce(F.min(F.when(right, F.col("k"))), F.lit(n)).alias("high"),
        F.bool_or((F.col("label") != "NONE") & ~right).alias("never"), F.bool_and(F.col("label") == "NONE").alias("empty"),
    )
    block = block.groupBy("low", "high", "never", "empty").agg(F.count(F.lit(1)).alias("n"))
    updates = at.agg(F.count_distinct("update_id").alias("updates"))

    grid = scored.sparkSession.createDataFrame(list(enumerate(margins)), "i int, margin double")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    given = F.col("k") > F.col("i")
    kinds = [x for lab in POSITIVE_LABELS for x in (total(given & right & (F.col("label") == lab)).alias(f"tp_{lab}"), total(given & ~right & (F.col("taken") == lab)).alias(f"fp_{lab}"), total((F.col("label") == lab) & ~(given & right)).alias(f"fn_{lab}"))]
    edges = F.broadcast(grid).join(per, F.lit(True)).groupBy("i", "margin").agg(*kinds)
    held = (F.col("i") >= F.col("low")) & (F.col("i") < F.col("high")) & ~F.col("never")
    blocks = F.broadcast(grid).join(block, F.lit(True)).groupBy("i").agg(F.sum("n").alias("blocks"), total(held).alias("n_exact"), total(F.col("empty") & (F.col("i") < F.col("low"))).alias("none_with_false"))
    out = edges.join(blocks, "i").join(updates, F.lit(True))  # a row per margin; one row
    whole = {c: sum((F.col(f"{c}_{lab}") for lab in POSITIVE_LABELS[1:]), F.col(f"{c}_{POSITIVE_LABELS[0]}")) for c in ("tp", "fp", "fn")}
    one = lambda tp, fp, fn: f1(ratio(tp, tp + fp), ratio(tp, tp + fn))
    each = {lab: one(*(F.col(f"{c}_{lab}") for c in ("tp", "fp", "fn"))) for lab in POSITIVE_LABELS}
    return out.select(
        "margin", ratio(F.col("n_exact"), F.col("blocks")).alias("exact_patch_accuracy"), one(whole["tp"], whole["fp"], whole["fn"]).alias("edge_f1"), (sum(each.values(), F.lit(0.0)) / len(each)).alias("relation_macro_f1"),
        ratio(whole["fp"], F.col("updates")).alias("false_edges_per_update"), F.col("none_with_false").alias("none_scenarios_with_false_edges"), each["ATTACK"].alias("attack_f1"), F.lit(1.0).alias("json_validity"), F.lit(1.0).alias("schema_validity"),
    )


def combination_metrics(records: DataFrame, parsed: DataFrame, gold: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """All metrics of each combination ``by`` of answering model and prompt, over the same blocks.

    ``records`` has (by, example_id, update_id, json_valid, schema_valid, spec,
    robustness), the last two null where the judge's answer is not valid;
    ``parsed`` the edges of the answers as they stand, ``gold`` those expected,
    ``members`` (example_id, new_id, old_id).  Blocks count as exact only if
    their answer is of the schema.
    """
    each = records.select(*by, "example_id")
    g = gold.select(*EDGE).distinct().withColumn("in_gold", F.lit(True)).join(each, "example_id")
    p = parsed.select(*by, *EDGE).distinct().withColumn("in_pred", F.lit(True))
    e = g.join(p, [*by, *EDGE], "full").fillna(False, ["in_gold", "in_pred"])
    labels = label_scores(e, tuple(by)).groupBy(*by).agg((F.sum("f1") / len(POSITIVE_LABELS)).alias("relation_macro_f1"))
    micro = with_prf(e.groupBy(*by).agg(*counts())).select(*by, F.col("f1").alias("edge_f1"))
    merged = e.groupBy(*by, "update_id", "source", "target", "type").agg(F.max("in_gold").alias("in_gold"), F.max("in_pred").alias("in_pred"))
    wrong = merged.groupBy(*by, "update_id").agg(F.count_if(F.col("in_gold") != F.col("in_pred")).alias("wrong"), F.count_if(F.expr("in_pred AND NOT in_gold")).alias("false_edges"))
    valid = records.groupBy(*by, "update_id").agg(F.bool_and("schema_valid").alias("valid"))
    update = valid.join(wrong, [*by, "update_id"], "left").fillna(0, ["wrong", "false_edges"])
    scenario = update.groupBy(*by).agg(F.count(F.lit(1)).alias("update_count"), ratio(F.count_if(F.col("valid") & (F.col("wrong") == 0)), F.count(F.lit(1))).alias("exact_scenario_patch_accuracy"), ratio(F.sum("false_edges"), F.count(F.lit(1))).alias("false_edges_per_update"))
    pair = lambda df, *more: df.select(*more, *EDGE).distinct().withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})
    both = pair(parsed, *by).join(pair(gold).select("example_id", "lo", "hi", "type", F.col("source").alias("gold_source")), ["example_id", "lo", "hi", "type"])
    direction = both.groupBy(*by).agg((F.count_if(F.col("source") == F.col("gold_source")) / F.count(F.lit(1))).alias("direction_accuracy"))
    bad = invalid_ends(parsed, members).groupBy(*by).agg(F.sum("invalid").alias("invalid_id_count"))
    n = F.count(F.lit(1))
    rates = records.groupBy(*by).agg(ratio(F.count_if("json_valid"), n).alias("json_validity_rate"), ratio(F.count_if("schema_valid"), n).alias("schema_validity_rate"), ratio(F.count("spec"), n).alias("judge_validity_rate"), F.coalesce(F.avg("spec"), F.lit(0.0)).alias("judge_spec_adherence_mean"), F.coalesce(F.avg("robustness"), F.lit(0.0)).alias("judge_robustness_mean"))
    out = rates
    for more in (scenario, micro, labels, direction, bad):
        out = out.join(more, by, "left")
    return out.fillna(0, ["edge_f1", "relation_macro_f1", "invalid_id_count"])


def coverage_errors(predictions: DataFrame, examples: DataFrame, key: str = "example_id") -> DataFrame:
    """(error, id): ids that are predicted twice, predicted but unknown, or without a prediction."""
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = p.withColumn("p", F.lit(True)).join(examples.select(key).distinct().withColumn("e", F.lit(True)), key, "full")
    error = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated"), F.when(F.col("e").isNull(), "unknown"), F.when(F.col("p").isNull(), "missing")))
    return both.select(F.explode(error).alias("error"), F.col(key).alias("id"))
