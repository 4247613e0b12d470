"""Propositions, earlier pairs and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import category, content_tokens, overlap_features


def order_propositions(nodes: DataFrame) -> DataFrame:
    """Position of each proposition in its map: by first turn (none: last), node index, numeric id."""
    w = Window.partitionBy("dialogue_id").orderBy(F.coalesce("turn", F.lit(10**9)), "node_index", F.col("prop_number"))
    return nodes.withColumn("position", F.row_number().over(w))


def earlier_pairs(props: DataFrame) -> DataFrame:
    """Each proposition with all strictly earlier ones of its dialogue: an equi-join with a residual range.

    Its size is the sum of squared dialogue lengths, which is what the operator means.
    """
    n = props.select("dialogue_id", F.col("prop_id").alias("new_id"), F.col("turn").alias("new_turn"))
    e = props.select(F.col("dialogue_id").alias("d"), F.col("prop_id").alias("old_id"), F.col("turn").alias("old_turn"))
    out = n.join(e, (F.col("dialogue_id") == F.col("d")) & (F.col("old_turn") < F.col("new_turn"))).drop("d")
    return out.withColumn("update_id", F.concat_ws("/", "dialogue_id", "new_id"))


def assign_blocks(pairs: DataFrame, block_size: int = 8) -> DataFrame:
    """Earlier propositions in turn order, cut into blocks of a fixed size."""
    w = Window.partitionBy("update_id").orderBy("old_turn", "old_id")
    at = pairs.withColumn("rank", F.row_number().over(w)).withColumn("block_index", F.floor((F.col("rank") - 1) / block_size).cast("int"))
    return at.withColumn("example_id", F.concat(F.col("update_id"), F.lit(":b"), F.lpad(F.col("block_index").cast("string"), 2, "0")))


def block_table(decisions: DataFrame) -> DataFrame:
    """A row per block: members, gold labels and category."""
    labels = F.array_sort(F.collect_set(F.when(F.col("label") != "NONE", F.col("label"))))
    out = decisions.groupBy("example_id", "update_id", "dialogue_id", "block_index").agg(F.count(F.lit(1)).alias("n_earlier"), F.count_if(F.col("label") != "NONE").alias("n_gold"), labels.alias("labels"))
    return out.withColumn("category", category(F.col("labels"))).drop("labels")


def pair_features(decisions: DataFrame, props: DataFrame) -> DataFrame:
    """Decisions with shared tokens, overlap and Jaccard of the two texts; tokens are made once a proposition."""
    tokens = props.select("prop_id", content_tokens(F.col("text")).alias("tokens"))
    both = decisions.join(tokens.select(F.col("prop_id").alias("new_id"), F.col("tokens").alias("a")), "new_id").join(tokens.select(F.col("prop_id").alias("old_id"), F.col("tokens").alias("b")), "old_id")
    return both.withColumns(overlap_features(F.col("a"), F.col("b"))).drop("a", "b")


def block_hardness(features: DataFrame) -> DataFrame:
    """Of each block the pair that is largest by (two shared or more, overlap, shared, Jaccard), and the least turn gap."""
    best = F.max(F.struct((F.col("shared") >= 2).cast("int").alias("two"), "overlap", "shared", "jaccard")).alias("m")
    out = features.groupBy("example_id", "update_id", "dialogue_id").agg(best, F.min(F.col("new_turn") - F.col("old_turn")).alias("turn_gap"), F.count_if(F.col("label") != "NONE").alias("n_gold"))
    return out.select("example_id", "update_id", "dialogue_id", F.col("m.shared").alias("max_shared"), F.col("m.overlap").alias("max_overlap"), F.col("m.jaccard").alias("max_jaccard"), "turn_gap", "n_gold")


def hard_negatives(hardness: DataFrame) -> DataFrame:
    """Blocks without gold whose update has a gold block, and that share a token with the new proposition."""
    w = Window.partitionBy("update_id")
    return hardness.withColumn("sibling", F.max(F.col("n_gold") > 0).over(w)).where("n_gold = 0 AND sibling AND max_shared >= 1").drop("sibling", "n_gold")


def best_per_key(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """One row per key, the first in the order given."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def two_hop(links: DataFrame, first: str, middle: str, last: str, distinct: bool) -> DataFrame:
    """Paths first -> middle -> last by node kind; as a bag, or as a set without loops."""
    a = links.where(F.col("src").rlike(f"^{first}[0-9]") & F.col("dst").rlike(f"^{middle}[0-9]")).select("dialogue_id", F.col("src").alias("from_id"), F.col("dst").alias("via"))
    b = links.where(F.col("src").rlike(f"^{middle}[0-9]") & F.col("dst").rlike(f"^{last}[0-9]")).select("dialogue_id", F.col("src").alias("via"), F.col("dst").alias("to_id"))
    out = a.join(b, ["dialogue_id", "via"]).select("dialogue_id", "from_id", "to_id")
    return out.where("from_id <> to_id").distinct() if distinct else out


def cross_side_pairs(props: DataFrame, sides: dict[str, str]) -> DataFrame:
    """Later units with earlier ones of the other side; speakers without a side take no part."""
    side = F.coalesce(*[F.when(F.col("speaker") == k, v) for k, v in sides.items()])
    s = props.withColumn("side", side).where("side IS NOT NULL").select("dialogue_id", "prop_id", "turn", "side")
    e = s.select(F.col("dialogue_id").alias("d"), F.col("prop_id").alias("old_id"), F.col("turn").alias("t"), F.col("side").alias("old_side"))
    return s.join(e, (F.col("dialogue_id") == F.col("d")) & (F.col("t") < F.col("turn")) & (F.col("side") != F.col("old_side"))).select("dialogue_id", F.col("prop_id").alias("new_id"), "old_id", "side", "old_side")


def windows_around(pairs: DataFrame, props: DataFrame, reach: int = 2, fill: int = 8, most: int = 10) -> DataFrame:
    """Positions near either end of a pair, filled up by distance to the midpoint, at most ``most`` of the lowest."""
    at = props.select("dialogue_id", "turn")
    w = Window.partitionBy("new_id", "old_id")
    near = pairs.select("dialogue_id", "new_id", "old_id", "new_turn", "old_turn").join(at, "dialogue_id")
    close = (F.abs(F.col("turn") - F.col("new_turn")) <= reach) | (F.abs(F.col("turn") - F.col("old_turn")) <= reach)
    middle = F.abs(F.col("turn") - (F.col("new_turn") + F.col("old_turn")) / 2)
    ranked = near.withColumn("close", close).withColumn("n_close", F.sum(F.col("close").cast("int")).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("close").cast("int"), middle, "turn")))
    chosen = ranked.where(F.col("close") | (F.col("r") <= F.lit(fill) - F.col("n_close")))
    return chosen.groupBy("dialogue_id", "new_id", "old_id").agg(F.slice(F.array_sort(F.collect_set("turn")), 1, most).alias("turns"))


def transcript(props: DataFrame) -> DataFrame:
    """Dialogues as lines ``speaker: text`` in turn order."""
    line = F.struct("turn", "prop_id", F.concat_ws(": ", "speaker", "text").alias("line"))
    return props.groupBy("dialogue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("transcript"))
