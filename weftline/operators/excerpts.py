"""Debate tables of the first generation: relation slots, conflicts and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import related_ids

# What a relation slot may say, in upper case.
SLOT_KINDS = {"RA": "inference", "CA": "conflict", "MA": "rephrase"}


def classify_slots(slots: DataFrame, units: DataFrame) -> DataFrame:
    """(id, slot, target, type, reason): an edge for each related unit, or why a slot or a target gives none.

    ``slots`` has (id, slot, related, kind), ``units`` (id).  Nothing is imputed:
    a slot with one half only is ``incomplete_pair``, with a kind of its own
    ``unknown_relation_type``, with ids that are no list of numbers
    ``unreadable_ids``; an id that no unit has is ``unknown_target``.
    """
    kind = F.coalesce(*[F.when(F.upper("kind") == k, v) for k, v in SLOT_KINDS.items()])
    at = slots.withColumns({"type": kind, "ids": related_ids(F.col("related"))})
    reason = F.when(F.col("related").isNull() | F.col("kind").isNull(), "incomplete_pair").when(F.col("type").isNull(), "unknown_relation_type").when(F.col("ids").isNull(), "unreadable_ids")
    at = at.withColumn("reason", reason)
    whole = at.where("reason IS NOT NULL").select("id", "slot", F.lit(None).cast("bigint").alias("target"), F.lit(None).cast("string").alias("type"), "reason")
    each = at.where("reason IS NULL").select("id", "slot", F.explode("ids").alias("target"), "type")
    known = units.select(F.col("id").cast("bigint").alias("target"), F.lit(True).alias("_known")).distinct()
    told = each.join(known, "target", "left")
    return whole.unionByName(told.select("id", "slot", "target", F.when(F.col("_known"), F.col("type")).alias("type"), F.when(F.col("_known").isNull(), "unknown_target").alias("reason")))


def cross_stance_conflicts(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(later, earlier) of conflicts between units of different sides, each pair once."""
    side = lambda name: units.select(F.col("id").alias(name), F.col("side").alias(f"{name}_side"))
    at = edges.where("type = 'conflict'").select(F.greatest("id", "target").alias("later"), F.least("id", "target").alias("earlier")).distinct()
    return at.join(side("later"), "later").join(side("earlier"), "earlier").where("later_side <> earlier_side").select("later", "earlier")


def accepted(rows: DataFrame, flags: list[str], expected: str, actual: str) -> DataFrame:
    """Rewritten examples that pass every flag (a null fails) and whose units kept their ids, order and sides."""
    passed: Column = F.lit(True)
    for f in flags:
        passed &= F.coalesce(F.col(f), F.lit(False))
    return rows.where(passed & (F.col(expected) == F.col(actual)))
