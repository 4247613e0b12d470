"""Registered queries of the reference's operators, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import judge_parse, strict_parse
from ..functions.text import NODE_LABELS, hash_bucket, ratio, seeded_hash, short_id, speaker_of, unfence
from ..operators import audit, blocks, gates, metrics, selection
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SECRETS = r"(?i)((api|access|private)?[_-]?key|secret|token|password) *[:=] *[\"']?[A-Za-z0-9_+/-]{16,}|\b(sk|hf|ghp|AKIA)[_-]?[A-Za-z0-9]{16,}"
WEIGHTS = {"NONE": 0.4, "SUPPORT": 0.25, "REPHRASE": 0.2, "ATTACK": 0.1, "MIXED": 0.05}
SIDES = {"user": "AFF", "assistant": "NEG"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _block_table(s: SparkSession, d: str) -> DataFrame:
    return blocks.block_table(T.decisions(s, d))


def _features(s: SparkSession, d: str) -> DataFrame:
    return blocks.pair_features(T.decisions(s, d), T.propositions(s, d))


def _hardness(s: SparkSession, d: str) -> DataFrame:
    return blocks.block_hardness(_features(s, d))


def _edges(s: SparkSession, d: str) -> DataFrame:
    at = T.decisions(s, d)
    return metrics.confusion(T.gold(at), T.predicted(at))


def _updates(s: SparkSession, d: str) -> DataFrame:
    return _block_table(s, d).groupBy("dialogue_id", "update_id").agg(F.sum("n_gold").alias("n_gold"), F.sum("n_earlier").alias("n_earlier"), F.count(F.lit(1)).alias("n_blocks"))


@query
def prop_order(s, d):
    p = T.propositions(s, d).withColumns({"node_index": F.length("text"), "prop_number": F.col("turn")})
    p = p.withColumn("turn", F.when(hash_bucket("t", F.col("prop_id")) >= 10, F.col("turn")))
    return blocks.order_propositions(p).select("dialogue_id", "prop_id", F.col("position").cast("long"))


@query
def earlier_pairs(s, d):
    return blocks.earlier_pairs(T.propositions(s, d)).select("update_id", "new_id", "old_id", "new_turn", "old_turn")


@query
def block_assign(s, d):
    return T.decisions(s, d).select("example_id", "update_id", "old_id", F.col("block_index").cast("long"))


@query
def block_category(s, d):
    return _block_table(s, d).select("example_id", "n_earlier", "n_gold", "category")


@query
def lexical_hardness(s, d):
    return _features(s, d).select("new_id", "old_id", F.col("shared").cast("long"), r6("overlap").alias("overlap"), r6("jaccard").alias("jaccard"))


@query
def block_hardness_argmax(s, d):
    return _hardness(s, d).select("example_id", F.col("max_shared").cast("long"), r6("max_overlap").alias("max_overlap"), r6("max_jaccard").alias("max_jaccard"), "turn_gap")


@query
def hard_negatives_v2(s, d):
    return blocks.hard_negatives(_hardness(s, d)).select("example_id", "update_id", F.col("max_shared").cast("long"), "turn_gap")


@query
def update_filter_anti(s, d):
    at = T.decisions(s, d)
    bad = at.where((F.col("label") != "NONE") & (hash_bucket("n", F.col("new_id"), F.col("old_id")) < 20)).select("update_id").distinct()
    return at.select("update_id", "dialogue_id").distinct().join(bad, "update_id", "left_anti")


@query
def seeded_rank(s, d):
    return selection.seeded_rank(_block_table(s, d), "rank", "example_id").select("example_id", "rank")


@query
def quota_topk_diagnostic(s, d):
    b = _block_table(s, d)
    quotas = b.select("dialogue_id", "category").distinct().withColumn("quota", F.when(F.col("category") == "NONE", 1).otherwise(2))
    return selection.quota_top(b, quotas, ["dialogue_id", "category"], "quota", "example_id").select("example_id", "dialogue_id", "category", F.col("rank").cast("long"))


@query
def eval_backfill_topk(s, d):
    return selection.backfilled_top(_updates(s, d), "dialogue_id", "eval", "update_id", F.col("n_gold") > 0, 3, 2).select("dialogue_id", "update_id", F.col("rank").cast("long"))


@query
def heldout_split(s, d):
    g = T.propositions(s, d).select("dialogue_id", F.col("dialogue_id").cast("long").alias("dialogue_order")).distinct()
    return selection.held_out(g, ["dialogue_order"], 6).select("dialogue_id", "split")


@query
def dev_split(s, d):
    g = T.propositions(s, d).select("dialogue_id").distinct()
    ranked = selection.seeded_rank(g, "dev", "dialogue_id")
    return ranked.select("dialogue_id", F.when(F.col("rank") <= 4, "dev").otherwise("train").alias("split"))


@query
def leakage_intersect(s, d):
    return heldout_split(s, d).where("split = 'eval'").select("dialogue_id").intersect(dev_split(s, d).where("split = 'train'").select("dialogue_id"))


@query
def pair_siblings_v3(s, d):
    h = _hardness(s, d)
    order = [(F.col("max_shared") >= 2).cast("int").desc(), F.col("max_overlap").desc(), F.col("max_shared").desc(), F.col("max_jaccard").desc(), F.col("turn_gap"), seeded_hash("v3", F.col("example_id"))]
    none = blocks.best_per_key(h.where("n_gold = 0"), ["update_id"], *order).select("update_id", F.col("example_id").alias("negative_id"))
    pos = blocks.best_per_key(_block_table(s, d).where("n_gold > 0"), ["update_id", "category"], seeded_hash("v3", F.col("example_id")))
    return pos.join(none, "update_id").select("update_id", "category", F.col("example_id").alias("positive_id"), "negative_id", short_id("pair", "v3", 20, F.col("example_id"), F.col("negative_id")).alias("pair_id"))


@query
def oversample_cycle_v4(s, d):
    pool = selection.seeded_rank(_block_table(s, d), "v4", "example_id", ["category"])
    out = selection.cycle_oversample(pool, {"ATTACK": 120, "MIXED": 60, "REPHRASE": 150, "SUPPORT": 200, "NONE": 400}, "category", "rank")
    return out.select("category", F.col("i").cast("long"), F.col("repetition").cast("long"), "example_id")


@query
def repetition_index_v4(s, d):
    rows = oversample_cycle_v4(s, d)
    w = Window.partitionBy("example_id").orderBy("i")
    return rows.select("example_id", "i", (F.row_number().over(w) - 1).cast("long").alias("repetition"), ((F.row_number().over(w) > 1)).alias("is_repeated"))


@query
def pairwise_decisions(s, d):
    at = T.decisions(s, d)
    second = F.when(hash_bucket("a", F.col("new_id"), F.col("old_id")) < 5, "ATTACK")
    labels = F.array_distinct(F.filter(F.array(F.when(F.col("label") != "NONE", F.col("label")), second), lambda x: x.isNotNull()))
    out = at.withColumn("labels", labels).where(F.size("labels") <= 1)
    return out.select("example_id", "old_id", F.coalesce(F.get("labels", F.lit(0)), F.lit("NONE")).alias("decision"))


@query
def label_distribution(s, d):
    return T.decisions(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("update_id").alias("updates"))


@query
def contrast_cycle_v5(s, d):
    f = _features(s, d)
    pos = f.where("label <> 'NONE'").select("example_id", F.col("old_id").alias("positive_id"), "label", seeded_hash("v5", F.col("example_id"), F.col("old_id"), F.col("label")).alias("h"), F.lit(0).alias("rank"))
    order = [(F.col("shared") >= 2).cast("int").desc(), F.col("overlap").desc(), F.col("shared").desc(), F.col("jaccard").desc(), (F.col("new_turn") - F.col("old_turn")), seeded_hash("v5", F.col("example_id"), F.col("old_id"))]
    neg = f.where("label = 'NONE'").withColumn("rank", F.row_number().over(Window.partitionBy("example_id").orderBy(*order))).select("example_id", "rank", F.col("old_id").alias("negative_id"))
    return selection.cycle_contrasts(pos, neg, "example_id", 500).select(F.col("i").cast("long"), "example_id", "positive_id", "label", "negative_id", F.col("repetition").cast("long"))


@query
def pair_rows_v5(s, d):
    """Each contrast as two adjacent rows, POSITIVE then NONE."""
    c = contrast_cycle_v5(s, d)
    two = F.array(F.struct(F.lit(0).alias("k"), F.lit("POSITIVE").alias("role"), F.col("positive_id").alias("target"), "label"), F.struct(F.lit(1).alias("k"), F.lit("NONE").alias("role"), F.col("negative_id").alias("target"), F.lit("NONE").alias("label")))
    return c.select("i", "example_id", F.explode(two).alias("x")).select((F.col("i") * 2 + F.col("x.k")).alias("ord"), "example_id", "x.role", "x.target", "x.label")


@query
def weighted_interleave(s, d):
    return selection.weighted_interleave(s, _block_table(s, d), WEIGHTS, 300, "mix", "example_id").select(F.col("ord").cast("long"), "category", "example_id")


@query
def prefix_slice_stats(s, d):
    ranked = selection.seeded_rank(_block_table(s, d), "slice", "example_id")
    cut = ranked.withColumn("slice", F.explode(F.array(*map(F.lit, (32, 64, 128, 256))))).where("rank <= slice")
    return cut.groupBy(F.col("slice").cast("long").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_gold") > 0).alias("positive"), F.count_distinct("dialogue_id").alias("dialogues"))


@query
def edge_confusion(s, d):
    return _edges(s, d).groupBy("type").agg(*metrics.counts())


@query
def micro_prf(s, d):
    out = metrics.with_prf(_edges(s, d).agg(*metrics.counts()))
    return out.select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def label_macro_f1(s, d):
    return metrics.macro_f1(_edges(s, d)).select(r6("macro_f1").alias("macro_f1"))


@query
def label_scores(s, d):
    return metrics.label_scores(_edges(s, d)).select("type", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def exact_block(s, d):
    return metrics.exact_rate(T.decisions(s, d), _edges(s, d), "example_id").select("n", "n_exact", r6("rate").alias("rate"))


@query
def exact_update(s, d):
    return metrics.exact_rate(T.decisions(s, d), metrics.merged_updates(_edges(s, d)), "update_id").select("n", "n_exact", r6("rate").alias("rate"))


@query
def false_edges_per_update(s, d):
    return metrics.false_edges_per_update(T.decisions(s, d), _edges(s, d)).select("updates", "false_edges", r6("rate").alias("rate"))


@query
def direction_accuracy(s, d):
    at = T.decisions(s, d)
    return metrics.direction_accuracy(T.gold(at), T.predicted(at)).select("evaluable", "correct", r6("accuracy").alias("accuracy"))


@query
def invalid_ids(s, d):
    at = T.decisions(s, d)
    bad = metrics.invalid_ends(T.predicted(at), at)
    return bad.agg(F.sum("invalid").alias("invalid_id_count"), F.count_if(F.col("invalid") > 0).alias("invalid_relation_count"))


@query
def none_diagnostics(s, d):
    return metrics.none_diagnostics(_block_table(s, d), T.predicted(T.decisions(s, d))).select("none_blocks", "with_false_edges", r6("rate").alias("rate"))


@query
def failure_listing(s, d):
    """Missed and spurious edges of each block that is not exact, sorted."""
    e = _edges(s, d).withColumn("edge", F.concat_ws(">", "source", "target", "type"))
    out = e.groupBy("example_id").agg(F.array_sort(F.collect_list(F.when(F.expr("in_pred AND NOT in_gold"), F.col("edge")))).alias("fp"), F.array_sort(F.collect_list(F.when(F.expr("in_gold AND NOT in_pred"), F.col("edge")))).alias("fn"))
    return out.where("size(fp) + size(fn) > 0").select("example_id", F.array_join("fp", ",").alias("false_positive"), F.array_join("fn", ",").alias("false_negative"))


@query
def gen1_grouping_sets(s, d):
    e = _edges(s, d).withColumns({"label": F.col("type"), "provider": F.concat(F.lit("m"), (hash_bucket("prov", F.col("example_id")) % 3).cast("string"))})
    return metrics.grouped_scores(e, ["label", "provider"]).select("scope", "value", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def hard_negative_fp(s, d):
    at = T.decisions(s, d)
    hard = at.where("label = 'NONE'").withColumn("phenomenon", F.concat(F.lit("h"), (hash_bucket("hn", F.col("new_id"), F.col("old_id")) % 4).cast("string")))
    hit = T.predicted(at).select(F.col("source").alias("new_id"), F.col("target").alias("old_id"), F.lit(1).alias("hit")).distinct()
    out = hard.join(hit, ["new_id", "old_id"], "left").groupBy("phenomenon").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("false_positives"))
    return out.withColumn("rate", r6(ratio(F.col("false_positives"), F.col("n"))))


def _grid(s, d):
    return metrics.margin_grid(T.scores(T.decisions(s, d)), gates.MARGINS)


@query
def margin_grid(s, d):
    g = _grid(s, d)
    return g.select(*[F.col(c) if c == "none_scenarios_with_false_edges" else r6(c).alias(c) for c in g.columns])


@query
def margin_select(s, d):
    return gates.select_margin(_grid(s, d), gates.DEVELOPMENT).select("margin", "gate", r6("edge_f1").alias("edge_f1"))


@query
def gate_checks(s, d):
    checks = gates.check_thresholds(_grid(s, d), gates.DEVELOPMENT, ["margin"])
    return gates.failures(checks, ["margin"])


@query
def promotion_gate(s, d):
    """Nine checks of the uncalibrated answers; validity and robustness are those of the recorded ones."""
    told = T.records(s, d).select(strict_parse("raw_response").alias("p"), judge_parse("raw_judge").alias("j"))
    n = F.count(F.lit(1))
    told = told.agg(F.avg("j.robustness").alias("judge_robustness"), ratio(F.count_if("p.json_valid"), n).alias("json_validity"), ratio(F.count_if("p.schema_valid"), n).alias("schema_validity"))
    g = _grid(s, d).where("margin = 0.0").drop("json_validity", "schema_validity").join(told, F.lit(True))  # one row each
    return gates.check_thresholds(g, gates.PROMOTION, []).select("check", r6("value").alias("value"), r6("bound").alias("bound"), "passed")


@query
def metric_deltas(s, d):
    g = _grid(s, d).select("margin", "edge_f1", "exact_patch_accuracy")
    w = Window.orderBy("margin")  # 61 rows
    return g.select("margin", r6(F.col("edge_f1") - F.lag("edge_f1").over(w)).alias("d_edge_f1"), r6(F.col("exact_patch_accuracy") - F.lag("exact_patch_accuracy").over(w)).alias("d_exact"))


@query
def prediction_alignment(s, d):
    """Each block with its prediction, none where it is missing; predictions of unknown blocks are counted apart."""
    b = _block_table(s, d).select("example_id")
    p = T.predicted(T.decisions(s, d)).select("example_id").distinct()
    answered = F.when(hash_bucket("miss", F.col("example_id")) >= 20, F.col("example_id"))
    p = p.select(answered.alias("example_id")).where("example_id IS NOT NULL").withColumn("found", F.lit(True))
    return b.join(p, "example_id", "left").groupBy(F.coalesce("found", F.lit(False)).alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query
def grounding_defects(s, d):
    """Propositions by how many locutions ground them."""
    g = blocks.two_hop(T.links(s, d), "L", "YA", "I", distinct=False).groupBy("dialogue_id", F.col("to_id").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))
    every = T.nodes(s, d).where("type = 'I'").join(g, ["dialogue_id", "node_id"], "left")
    return every.groupBy(F.when(F.col("k").isNull(), "missing").when(F.col("k") == 1, "one").otherwise("ambiguous").alias("grounding")).agg(F.count(F.lit(1)).alias("n"))


@query
def grounding_two_hop(s, d):
    return blocks.two_hop(T.links(s, d), "L", "YA", "I", distinct=False)


@query
def transition_pairs(s, d):
    return blocks.two_hop(T.links(s, d), "L", "TA", "L", distinct=True)


@query
def topological_order(s, d):
    n = T.nodes(s, d).where("type = 'L'").select("dialogue_id", "node_id", F.col("node_index").cast("long"))
    return audit.topological_order(n, blocks.two_hop(T.links(s, d), "L", "TA", "L", distinct=True))


@query
def label_normalise(s, d):
    kinds = F.element_at(F.array(*map(F.lit, NODE_LABELS)), (hash_bucket("k", F.col("prop_id")) % 3) + 1)
    p = T.propositions(s, d).withColumn("node", kinds)
    return p.groupBy("node", F.coalesce(*[F.when(F.col("node") == k, v) for k, v in NODE_LABELS.items()]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def canonical_direction(s, d):
    """Edges as they stand, turned so that the later end is the source; equal turns have no canonical pair."""
    at = T.predicted(T.decisions(s, d))
    turn = lambda c: F.split(c, ":")[1].cast("long")
    a, b = turn(F.col("source")), turn(F.col("target"))
    direction = F.when(a > b, "later_to_earlier").when(a < b, "earlier_to_later").otherwise("same_turn")
    return at.select("example_id", "source", "target", "type", direction.alias("direction"), F.when(a > b, F.col("source")).when(a < b, F.col("target")).alias("canonical_source"), F.when(a > b, F.col("target")).when(a < b, F.col("source")).alias("canonical_target"))


@query
def cross_side_pairs(s, d):
    return blocks.cross_side_pairs(T.propositions(s, d), SIDES)


@query
def window_ids(s, d):
    at = T.decisions(s, d).where("label = 'ATTACK'")
    return blocks.windows_around(at, T.propositions(s, d), reach=1, fill=4, most=5).select("new_id", "old_id", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


@query
def transcript_render(s, d):
    return blocks.transcript(T.propositions(s, d)).select("dialogue_id", F.md5("transcript").alias("transcript_md5"), F.length("transcript").cast("long").alias("n_chars"))


@query
def speaker_parse(s, d):
    joined = F.concat("speaker", F.when(hash_bucket("sp", F.col("prop_id")) < 50, " : ").otherwise(":"), "text")
    return T.propositions(s, d).select("prop_id", speaker_of(joined).alias("speaker"), speaker_of(F.regexp_replace("text", ":", "")).alias("none"))


def _responses(s, d):
    """JSON answers per block with injected faults: fences, extra keys, bad labels, trailing text, repeated edges."""
    at = T.decisions(s, d)
    own = T.predicted(at).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "type"))).alias("r"))
    body = at.select("example_id").distinct().join(own, "example_id", "left")
    item = lambda x: F.concat(F.lit('{"source": "'), x["source"], F.lit('", "target": "'), x["target"], F.lit('", "type": "'), x["type"], F.lit('"}'))
    text = F.concat(F.lit('{"relations": ['), F.coalesce(F.array_join(F.transform("r", item), ", "), F.lit("")), F.lit("]"))
    b = hash_bucket("json", F.col("example_id"))
    end = F.when(b < 10, "} done").when(b < 20, ', "note": 1}').otherwise("}")
    raw = F.concat(text, end)
    return body.select("example_id", F.when(F.col("r").isNotNull() & b.between(40, 49), F.replace(raw, F.lit("SUPPORT"), F.lit("AGREES"))).when(b.between(20, 39), F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(raw).alias("response"))


@query
def fence_normalize(s, d):
    return _responses(s, d).select("example_id", F.md5(unfence(F.col("response"))).alias("body_md5"))


@query
def strict_parse_rates(s, d):
    p = _responses(s, d).select("example_id", strict_parse(F.col("response")).alias("p"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if("p.json_valid").alias("json_valid"), F.count_if("p.schema_valid").alias("schema_valid"), F.sum(F.size("p.relations")).alias("relations"))


@query
def assignment_matrix(s, d):
    """Every (provider, prompt) cell with each evaluated block; the cells are a fixed list."""
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(q).alias("prompt")) for p in ("a", "b") for q in ("zero", "few", "rules")]))
    return quota_topk_diagnostic(s, d).select("example_id", cells.alias("c")).select(F.concat_ws("__", "c.provider", "c.prompt", F.replace(F.col("example_id"), F.lit(":"), F.lit("_"))).alias("assignment_id"), "c.provider", "c.prompt")


@query
def violations_suite(s, d):
    b, at = _block_table(s, d), T.decisions(s, d)
    shape = b.groupBy("update_id").agg(F.max("block_index").alias("last"), F.count(F.lit(1)).alias("k"))
    return audit.violations(
        {
            "blocks_not_contiguous": shape.where("last + 1 <> k"),
            "early_block_not_full": b.join(shape, "update_id").where("block_index < last AND n_earlier <> 3"),
            "edge_points_forward": at.where("old_turn >= new_turn"),
            "repeated_pair": at.groupBy("new_id", "old_id").count().where("count > 1"),
            "source_not_new": metrics.invalid_ends(T.predicted(at), at).where("source <> new_id"),
        }
    )


@query
def attachment_hardness(s, d):
    cross = blocks.cross_side_pairs(T.propositions(s, d), SIDES).select("new_id", "old_id", F.lit(1).alias("cross"))
    at = T.decisions(s, d).join(cross, ["new_id", "old_id"], "left")
    score = F.count_if(F.col("label") != "NONE") * 100 + F.count_if((F.col("label") == "NONE") & F.col("cross").isNotNull())
    return at.groupBy("update_id").agg(score.alias("score"))


@query
def curriculum_rows(s, d):
    """Template rows over topics that alternate sides; topics are the part types."""
    topics = T.table(s, d, "part").select("p_type").distinct()
    w = Window.orderBy("p_type")  # a row per part type
    return topics.select(F.row_number().over(w).cast("long").alias("ord"), F.concat(F.lit("Unit on "), F.lower("p_type")).alias("text"), F.when(F.row_number().over(w) % 2 == 1, "AFF").otherwise("NEG").alias("side"))


@query
def distribution_stats(s, d):
    h = _hardness(s, d).join(_block_table(s, d).select("example_id", "category"), "example_id")
    return audit.distribution(h, ["category"], "max_overlap").select("category", r6("least").alias("least"), r6("mean").alias("mean"), r6("most").alias("most"), "n")


@query
def ledger_union(s, d):
    return audit.ledger({"micro": micro_prf(s, d).select("tp", "f1"), "macro": label_macro_f1(s, d), "blocks": exact_block(s, d).select("n", "rate")}).select("scope", "tp", "f1", "macro_f1", "n", "rate")


@query
def most_common_label(s, d):
    at = T.decisions(s, d).where("label <> 'NONE'")
    return audit.most_common(at, ["dialogue_id"], "label", "new_id").select("dialogue_id", "label", "n")


@query
def jury_outcome(s, d):
    """Winner and margin of two sides by mean score; equal scores are a tie."""
    p = T.propositions(s, d)
    side = F.coalesce(*[F.when(F.col("speaker") == k, v) for k, v in SIDES.items()])
    j = p.withColumn("side", side).where("side IS NOT NULL").groupBy("dialogue_id").pivot("side", ["AFF", "NEG"]).agg(F.avg(hash_bucket("jury", F.col("prop_id"))))
    a, n = F.coalesce(r6("AFF"), F.lit(0.0)), F.coalesce(r6("NEG"), F.lit(0.0))
    return j.select("dialogue_id", F.when(a > n, "AFF").when(n > a, "NEG").otherwise("TIE").alias("winner"), F.round(F.abs(a - n), 4).alias("margin"))


@query
def judge_means(s, d):
    b = _block_table(s, d)
    score, ok = (hash_bucket("judge", F.col("example_id")) % 5), hash_bucket("valid", F.col("example_id")) >= 10
    return b.groupBy("category").agg(r6(F.avg(F.when(ok, score))).alias("mean_score"), r6(ratio(F.count_if(ok), F.count(F.lit(1)))).alias("validity"))


@query
def secret_scan(s, d):
    """Documents that hold what looks like a key, token or password: a known prefix, or a long value given to such a name."""
    return T.table(s, d, "documents").where(F.col("text").rlike(SECRETS)).select("doc_id")


@query
def event_type_counts(s, d):
    """Frequency counts and typed JSON access over the event log."""
    e = T.table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum("k").alias("k"))
