"""Relations of argument maps: their ends, arity, direction, defects and what of them training keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NODE_LABELS
from .blocks import best_per_key

RELATION = ["dialogue_id", "map_order", "relation_id"]


def relation_table(ends: DataFrame) -> DataFrame:
    """A row per relation node with the propositions that enter and leave it, in the order of their edges."""

    def listed(role: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("edge_index", "prop_id"))))
        return F.transform(own, lambda x: x["prop_id"])

    label = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in NODE_LABELS.items()])
    return ends.groupBy(*RELATION, "kind").agg(listed("source").alias("sources"), listed("target").alias("targets")).withColumn("label", label)


def arity(sources: Column, targets: Column) -> Column:
    n, m = F.size(sources), F.size(targets)
    return F.when((n == 0) | (m == 0), "incomplete").when((n == 1) & (m == 1), "binary").otherwise("n-ary")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with an equal identity the first by ``order``."""
    return best_per_key(rows, key, order)


def proposition_turns(props: DataFrame, groundings: DataFrame) -> DataFrame:
    """(dialogue_id, prop_id, n_groundings, turn): the least turn over all groundings, null where none has one."""
    found = groundings.groupBy("dialogue_id", "prop_id").agg(F.count(F.lit(1)).alias("n_groundings"), F.min("turn").alias("turn"))
    return props.select("dialogue_id", "prop_id").join(found, ["dialogue_id", "prop_id"], "left").fillna(0, ["n_groundings"])


def canonical(relations: DataFrame, turns: DataFrame) -> DataFrame:
    """Relations with arity, direction and, for binary ones, the canonical pair whose source is the later end.

    Equal turns give ``same_turn`` and an end without a turn ``unknown``; neither
    has a canonical pair.  Unambiguous are binary relations with a canonical
    pair whose ends are grounded exactly once.
    """
    end = lambda name: turns.select("dialogue_id", F.col("prop_id").alias(name), F.col("turn").alias(f"{name}_turn"), F.col("n_groundings").alias(f"{name}_n"))
    at = relations.withColumn("arity", arity(F.col("sources"), F.col("targets")))
    binary = F.col("arity") == "binary"
    at = at.withColumns({"a": F.when(binary, F.element_at("sources", 1)), "b": F.when(binary, F.element_at("targets", 1))})
    at = at.join(end("a"), ["dialogue_id", "a"], "left").join(end("b"), ["dialogue_id", "b"], "left")
    later, equal = F.col("a_turn") > F.col("b_turn"), F.col("a_turn") == F.col("b_turn")
    direction = F.when(~binary, F.lit(None)).when(F.col("a_turn").isNull() | F.col("b_turn").isNull(), "unknown").when(equal, "same_turn").when(later, "later_to_earlier").otherwise("earlier_to_later")
    pair = F.col("direction").isin("later_to_earlier", "earlier_to_later")
    at = at.withColumn("direction", direction)
    at = at.withColumns({"canonical_source": F.when(pair, F.when(later, F.col("a")).otherwise(F.col("b"))), "canonical_target": F.when(pair, F.when(later, F.col("b")).otherwise(F.col("a")))})
    return at.withColumn("unambiguous", F.coalesce(binary & pair & (F.col("a_n") == 1) & (F.col("b_n") == 1), F.lit(False)))


def usable_maps(turns: DataFrame) -> DataFrame:
    """Dialogues of two propositions or more, each grounded exactly once and with a turn."""
    fits = turns.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("n_groundings") == 1) & F.col("turn").isNotNull()).alias("ok"))
    return fits.where("n >= 2 AND ok").select("dialogue_id")


def candidates(relations: DataFrame, pairs: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates, gold edges): updates of usable maps that no ambiguous relation touches, and the relations that are their gold.

    A relation touches an update when its ends hold the new proposition and an
    earlier one.  Gold edges run from the new proposition to an earlier one.
    """
    own = pairs.join(maps, "dialogue_id", "left_semi")
    orders = relations.select("dialogue_id", "map_order").distinct()
    updates = own.groupBy("dialogue_id", "update_id", "new_id").agg(F.count(F.lit(1)).alias("n_earlier")).join(orders, "dialogue_id")
    ends = relations.where("NOT unambiguous").select(*RELATION, F.explode(F.concat("sources", "targets")).alias("end"))
    touched = ends.select(*RELATION, F.col("end").alias("new_id")).join(ends.select(*RELATION, F.col("end").alias("old_id")), RELATION).join(own.select("dialogue_id", "new_id", "old_id"), ["dialogue_id", "new_id", "old_id"], "left_semi")
    clean = updates.join(touched.select("dialogue_id", "map_order", "new_id").distinct(), ["dialogue_id", "map_order", "new_id"], "left_anti")
    edges = relations.where("unambiguous").select(*RELATION, "label", F.col("canonical_source").alias("new_id"), F.col("canonical_target").alias("old_id"))
    gold = edges.join(own.select("dialogue_id", "new_id", "old_id", "update_id"), ["dialogue_id", "new_id", "old_id"]).join(clean.select("dialogue_id", "map_order", "new_id"), ["dialogue_id", "map_order", "new_id"], "left_semi")
    return clean, gold


def one_map_per_update(updates: DataFrame, gold: DataFrame) -> DataFrame:
    """Of an update that several maps hold, the one with most gold edges, most earlier propositions, then the first map."""
    n = gold.groupBy("dialogue_id", "map_order", "new_id").agg(F.count_distinct("old_id", "label").alias("n_gold"))
    both = updates.join(n, ["dialogue_id", "map_order", "new_id"], "left").fillna(0, ["n_gold"])
    return best_per_key(both, ["dialogue_id", "new_id"], F.col("n_gold").desc(), F.col("n_earlier").desc(), F.col("map_order"))


def defects(relations: DataFrame, maps: DataFrame) -> DataFrame:
    """(kind, class, n): how the ends of binary relations are grounded, and how the turns of the singly grounded ones stand."""
    b = relations.where("arity = 'binary'").join(maps.withColumn("usable", F.lit(True)), "dialogue_id", "left")
    a, c = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    single = (a == 1) & (c == 1)
    grounding = F.when(single, "both_endpoints_exactly_one").when((a == 0) | (c == 0), "at_least_one_endpoint_missing").otherwise("ambiguous_only_no_missing_endpoint")
    chronology = F.when(~single, F.lit(None)).when(F.col("usable").isNull(), "excluded_unresolved_map").when(F.col("direction") == "same_turn", "excluded_same_turn").otherwise("resolvable")
    both = F.explode(F.array(F.struct(F.lit("grounding").alias("kind"), grounding.alias("class")), F.struct(F.lit("chronology").alias("kind"), chronology.alias("class")))).alias("x")
    return b.select(both).select("x.*").where("class IS NOT NULL").groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n"))


def labelled_funnel(rows: DataFrame, stages: dict[str, Column], label: str = "label") -> DataFrame:
    """(ord, stage, label, total, removed) of nested stages, per label and over all (label ``all``), in one pass."""
    passed, sums = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(passed).alias(name))
    one = rows.groupingSets([[], [F.col(label)]], F.col(label)).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("stage"), F.col(n).alias("total")) for i, n in enumerate(stages)])).alias("s")
    out = one.select(F.coalesce(label, F.lit("all")).alias("label"), each).select("label", "s.*")
    return out.withColumn("removed", F.coalesce(F.lag("total").over(Window.partitionBy("label").orderBy("ord")) - F.col("total"), F.lit(0)))


def issues(turns: DataFrame) -> DataFrame:
    """(dialogue_id, issue): what is wrong with the groundings of a map, with the sorted ids."""
    kind = F.when(F.col("n_groundings") == 0, "propositions without grounding").when(F.col("n_groundings") > 1, "propositions with several groundings").when(F.col("turn").isNull(), "propositions without turn")
    at = turns.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("dialogue_id", "kind").agg(F.array_sort(F.collect_list("prop_id")).alias("ids"))
    return at.select("dialogue_id", F.concat_ws(": ", "kind", F.array_join("ids", ",")).alias("issue"))


def block_rows(blocks: DataFrame, gold: DataFrame) -> DataFrame:
    """A row per block: earlier propositions in order, gold edges as a set by (target, label), and the relation that gave each first."""
    first = best_per_key(gold, ["new_id", "old_id", "label"], "map_order", "relation_id").select("new_id", "old_id", F.col("label").alias("gold"), "relation_id")
    at = blocks.join(first, ["new_id", "old_id"], "left")
    earlier = F.transform(F.array_sort(F.collect_set(F.struct("rank", "old_id"))), lambda x: x["old_id"])
    edges = F.array_sort(F.collect_list(F.when(F.col("gold").isNotNull(), F.struct(F.col("old_id").alias("target"), F.col("gold").alias("type"), "relation_id"))))
    return at.groupBy("dialogue_id", "update_id", "new_id", "example_id", "block_index").agg(earlier.alias("earlier"), edges.alias("gold"))


def pairwise_patch(source: Column, decisions: Column) -> Column:
    """Compact JSON of the edges from ``source`` to each decided target, in the order given; NONE gives none. Ids may hold any characters."""
    edge = lambda x: F.struct(source.alias("source"), x["target"].alias("target"), x["label"].alias("type"))
    return F.to_json(F.struct(F.transform(F.filter(decisions, lambda x: x["label"] != "NONE"), edge).alias("relations")))
