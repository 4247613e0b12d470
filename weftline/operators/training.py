"""Selecting training examples and laying out their rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import POSITIVE_LABELS, seeded_hash
from ..sources.staged import staged
from .ordinal import crossing, queue_heads, with_ordinal


def need(have: Mapping[str, int], want: Mapping[str, int], what: str) -> None:
    """An error that names every category with fewer than wanted."""
    short = [f"{have.get(c, 0)} of {n} {c}" for c, n in want.items() if have.get(c, 0) < n]
    if short:
        raise ValueError(f"not enough {what}: {', '.join(short)}")


def rare_first(pairs: DataFrame, targets: Mapping[str, int], order: list[Column], strict: bool = False) -> DataFrame:
    """The first ``targets[c]`` pairs of each category, categories in the order given; each update once over all.

    With ``strict`` a category that falls short is an error.
    """
    out = None
    for category, n in targets.items():
        own = pairs.where(F.col("category") == category)
        if out is not None:
            own = own.join(out.select("update_id"), "update_id", "left_anti")
        one = own.orderBy(*order).limit(n).select(*pairs.columns)
        out = one if out is None else out.unionByName(one)
    if strict:
        out = staged(out, "rare_first")
        need({r["category"]: r["n"] for r in out.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}, targets, "pairs")  # a row per category
    return out


def alternating_fold(rows: DataFrame, positive: Column, size: str, capacity: int, seed: str, key: str) -> DataFrame:
    """Positive and negative rows by turns, each in seeded order; what would overrun the capacity is skipped, the next ones tried.

    Sizes are positive.  Rows are taken up to the first that overruns; after it
    only rows that fit into what is left can follow, so the least size that is
    out of reach falls with every such step, and there are at most as many steps
    as there are distinct sizes.  A step is two sums over the table; the driver
    sees where it ends, and never a list of rows.
    """
    each = rows.withColumn("_pos", positive)
    ranked = with_ordinal(each, [seeded_hash(seed, F.col(key)), F.col(key)], "_r", ("_pos",))
    n = {r["_pos"]: r["n"] for r in each.groupBy("_pos").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    both = min(n.get(True, 0), n.get(False, 0))
    turn = 2 * F.col("_r") - F.col("_pos").cast("int")  # closed form of the visiting order: by turns, then what one kind has more
    at = staged(ranked.withColumn("ord", F.when(F.col("_r") <= both, turn).otherwise(F.col("_r") + both)).drop("_pos", "_r"), "visits")
    kept, left, after = None, capacity, 0
    while True:
        fits = at.where((F.col("ord") > after) & (F.col(size) <= left))
        end, taken = crossing(fits, "ord", size, left)
        part = fits if end is None else fits.where(F.col("ord") < end)
        kept = part if kept is None else kept.unionByName(part)
        left -= taken
        if end is None:
            return kept
        after = end


def target_schedule(targets: Mapping[str, int], sizes: Mapping[str, int]) -> list[tuple[int, str, int]]:
    """(ord, category, rank): always the category that lags its target most; ties go to the larger target, then the later name."""
    want = {c: min(n, sizes.get(c, 0)) for c, n in targets.items()}
    total, taken, out = sum(targets.values()), dict.fromkeys(targets, 0), []
    for n in range(1, sum(want.values()) + 1):
        _, _, c = max((targets[c] * n / total - taken[c], targets[c], c) for c in targets if taken[c] < want[c])
        taken[c] += 1
        out.append((n, c, taken[c]))
    return out


def target_interleave(spark: SparkSession, rows: DataFrame, targets: Mapping[str, int], order: list[Column], key: str, by: str = "category", strict: bool = True) -> DataFrame:
    """Queues of ``rows`` in ``order`` interleaved to the targets; of each queue only its head is ranked.

    A queue that is shorter than its target is an error, or is used up where ``strict`` is off.
    """
    own = rows.where(F.col(by).isin(*targets))
    sizes = {r[by]: r["n"] for r in own.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per category
    if strict:
        need(sizes, targets, "rows")
    slots = spark.createDataFrame(target_schedule(targets, sizes), f"ord int, {by} string, rank int")
    return queue_heads(own, by, order, max(targets.values()), key).join(F.broadcast(slots), [by, "rank"])


def whole_rounds(rows: DataFrame, mix: Mapping[str, int], by: str = "category") -> dict[str, int]:
    """The largest multiple of ``mix`` that the queues of ``rows`` hold."""
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per category
    return {c: n * min(sizes.get(k, 0) // m for k, m in mix.items()) for c, n in mix.items()}


def dev_selection(updates: DataFrame, gold: DataFrame, seed: str, none_total: int, per_label: int) -> DataFrame:
    """(update_id, role) of updates of one block: a NONE one of each dialogue, more up to ``none_total``, then ``per_label`` with one edge of each label."""
    labels = gold.groupBy("update_id").agg(F.collect_set("type").alias("labels"))
    one = updates.where("n_blocks = 1").join(labels, "update_id", "left").withColumn("_h", seeded_hash(seed, F.col("update_id")))
    none = one.where("n_gold = 0")
    own = none.withColumn("_r", F.row_number().over(Window.partitionBy("dialogue_id").orderBy("_h", "update_id")))
    first = F.when(F.col("_r") == 1, 0).otherwise(1)
    out = own.orderBy(first, "_h", "update_id").limit(none_total).select("update_id", F.lit("NONE").alias("role"))
    for label in POSITIVE_LABELS:
        fits = one.where((F.col("n_gold") == 1) & (F.col("labels") == F.array(F.lit(label))))
        out = out.unionByName(fits.orderBy("_h", "update_id").limit(per_label).select("update_id", F.lit(label).alias("role")))
    return out


def pair_rows(pairs: DataFrame) -> DataFrame:
    """Each pair as two adjacent rows, POSITIVE then NONE, that name each other."""
    two = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("POSITIVE").alias("role"), "category", F.col("positive_id").alias("example_id"), F.col("negative_id").alias("paired_id")),
        F.struct(F.lit(1).alias("k"), F.lit("NONE").alias("role"), F.lit("NONE").alias("category"), F.col("negative_id").alias("example_id"), F.col("positive_id").alias("paired_id")),
    )
    return pairs.select("pair_id", "update_id", F.explode(two).alias("x")).select("pair_id", "update_id", "x.*")


def first_user_suffix(rows: DataFrame, messages: str, suffix: str) -> DataFrame:
    """Message lists (structs with role and content) whose first user message ends in ``suffix`` on a line of its own."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "user")

    def told(m: Column, i: Column) -> Column:
        return F.when(i + 1 == at, m.withField("content", F.concat(m["content"], F.lit("\n" + suffix)))).otherwise(m)

    return rows.withColumn(messages, F.transform(messages, told))


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest over a tree of files (path, sha256) in the order of their paths; a tree is listed, so it is small."""
    line = F.struct("path", F.concat("path", F.lit("\0"), "sha256", F.lit("\n")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("tree_sha256"), F.count(F.lit(1)).alias("files"))


def lists_to_counts(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Rows without these list columns, but with their lengths."""
    return rows.select(*[c for c in rows.columns if c not in lists], *[F.size(c).cast("long").alias(f"{c}_count") for c in lists])


def with_overrides(episodes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Episodes (dialogue_id, dialogue_order); one that ``overrides`` names is replaced and hands its place on."""
    at = episodes.join(overrides, "dialogue_id", "left")
    return at.select(F.coalesce("replacement", "dialogue_id").alias("dialogue_id"), "dialogue_order", F.when(F.col("replacement").isNotNull(), F.col("dialogue_id")).alias("replaces"))


def both_sided(files: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """(side, key) of what either side lacks."""
    a = files.join(metadata, key, "left_anti").select(F.lit("without_metadata").alias("side"), key)
    return a.unionByName(metadata.join(files, key, "left_anti").select(F.lit("without_map").alias("side"), key))
