"""Deterministic selection: seeded ranks, quotas, back-fills, cycles, interleaves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import POSITIVE_LABELS, seeded_hash
from .ordinal import queue_heads, with_ordinal


def seeded_rank(rows: DataFrame, seed: str, key: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rank in the order of the seeded hash of ``key`` within ``by``; a rank without ``by`` is cut from sorted ranges."""
    order = [seeded_hash(seed, F.col(key)), F.col(key)]
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return global_rank(rows, order, name)


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers over all rows without a single task: buckets of the first order column's hash prefix are counted, then ranked apart.

    The first column must be a hex digest, whose first four characters order the
    65,536 buckets as the digest orders the rows; 10**11 rows are some 1.5
    million a bucket.
    """
    bucketed = rows.withColumn("_b", F.substring(order[0], 1, 4))
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # 65,536 rows at most
    ranked = bucketed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return ranked.join(F.broadcast(before), "_b").withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before")


def quota_top(rows: DataFrame, quotas: DataFrame, by: list[str], seed: str, key: str) -> DataFrame:
    """The first ``quota`` rows of each group by seeded hash; ``quotas`` has a row per group."""
    return seeded_rank(rows, seed, key, by).join(quotas, by).where(F.col("rank") <= F.col("quota")).drop("quota")


def backfilled_top(rows: DataFrame, by: str, seed: str, key: str, positive: Column, n_positive: int, n_negative: int) -> DataFrame:
    """Up to so many positives and negatives per group; what is short is filled by hash order."""
    at = rows.withColumn("_pos", positive)
    at = seeded_rank(at, seed, key, [by, "_pos"], "_own")
    first = (F.col("_pos") & (F.col("_own") <= n_positive)) | (~F.col("_pos") & (F.col("_own") <= n_negative))
    w = Window.partitionBy(by).orderBy(F.when(first, 0).otherwise(1), seeded_hash(seed, F.col(key)), F.col(key))
    return at.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_positive + n_negative).drop("_pos", "_own")


def held_out(groups: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` groups by order get split ``eval``, the others ``train``."""
    last = groups.orderBy(*[F.col(c).desc() for c in order]).limit(n).select(*order).withColumn("split", F.lit("eval"))
    return groups.join(F.broadcast(last), order, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def cycle_oversample(pool: DataFrame, target: Mapping[str, int], by: str, rank: str) -> DataFrame:
    """Per group the whole pool first, then again from its start until ``target`` rows are reached.

    Row i (from 0) takes the element of rank ``i mod n``; repetition is ``i div n``.
    """
    sizes = pool.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    want = F.coalesce(*[F.when(F.col(by) == k, F.lit(v)) for k, v in target.items()])
    slots = sizes.withColumn("_t", want).where("_t > 0").select(by, "_n", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("i"))
    at = slots.withColumn(rank, (F.col("i") % F.col("_n")).cast("int") + 1).withColumn("repetition", F.floor(F.col("i") / F.col("_n")).cast("int"))
    return at.drop("_n").join(pool, [by, rank])


def cycle_contrasts(positives: DataFrame, negatives: DataFrame, key: str, total: int) -> DataFrame:
    """Slot i takes positive ``i mod n`` and, of its block's ranked negatives, number ``(i div n) mod m``.

    ``positives`` have a global rank, ``negatives`` a rank within ``key``; positives whose block has none take no part.
    """
    sizes = negatives.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    usable = positives.join(sizes, key)
    usable = global_rank(usable.drop("rank"), [F.col("h"), F.col("positive_id")])
    n = usable.agg(F.count(F.lit(1)).alias("n"))
    slots = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("i"))
    at = slots.select("i", ((F.col("i") % F.col("n")) + 1).alias("rank"), F.floor(F.col("i") / F.col("n")).alias("repetition"))
    chosen = at.join(usable, "rank").withColumn("negative_rank", (F.col("repetition") % F.col("m")).cast("int") + 1)
    return chosen.join(negatives.select(key, F.col("rank").alias("negative_rank"), "negative_id"), [key, "negative_rank"])


def interleave_schedule(weights: Mapping[str, float], sizes: Mapping[str, int], n: int) -> list[tuple[int, str, int]]:
    """(ord, category, rank) of a weighted interleave: always the category that lags its share most.

    It hangs on weights and queue lengths alone, so the driver walks it over
    ``n`` slots and the rows themselves are joined by (category, rank).
    """
    taken = dict.fromkeys(weights, 0)
    out: list[tuple[int, str, int]] = []
    for size in range(1, n + 1):
        left = [c for c in weights if taken[c] < sizes.get(c, 0)]
        if not left:
            break
        _, _, c = max((weights[c] * size - taken[c], weights[c], c) for c in left)
        taken[c] += 1
        out.append((size, c, taken[c]))
    return out


def weighted_interleave(spark: SparkSession, rows: DataFrame, weights: Mapping[str, float], n: int, seed: str, key: str, by: str = "category") -> DataFrame:
    sizes = {r[by]: r["n"] for r in rows.where(F.col(by).isin(*weights)).groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per weight
    schedule = interleave_schedule(weights, sizes, n)
    slots = spark.createDataFrame(schedule, f"ord int, {by} string, rank int")
    heads = queue_heads(rows.where(F.col(by).isin(*weights)), by, [seeded_hash(seed, F.col(key)), F.col(key)], n, key)
    return heads.join(F.broadcast(slots), [by, "rank"])


def unseen_first(pool: DataFrame, seen: DataFrame, targets: Mapping[str, int], order: list[Column], key: str, by: str = "category") -> DataFrame:
    """Per group ``targets`` slots: rows whose key ``seen`` lacks come first, then the whole pool from its start, as often as it takes.

    Adds slot (from 0), unseen and source_rank.  Two queues share a schedule: of
    u unseen rows and n in all, slot i takes unseen row i while i < u, then row
    (i - u) mod n of the pool.  Only the heads of both queues are ranked.  A
    group without any row is an error.
    """
    own = pool.where(F.col(by).isin(*targets)).join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    sizes = {r[by]: (r["n"], r["u"]) for r in own.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_seen").isNull()).alias("u")).collect()}  # a row per group
    empty = [c for c, t in targets.items() if t and c not in sizes]
    if empty:
        raise ValueError(f"no rows of {', '.join(empty)} to choose from")
    plan = pool.sparkSession.createDataFrame([(c, t, *sizes[c]) for c, t in targets.items() if t], f"{by} string, _t long, _n long, _u long")
    slots = plan.withColumn("slot", F.explode(F.expr("sequence(0L, _t - 1)"))).withColumn("unseen", F.col("slot") < F.col("_u"))
    slots = slots.select(by, "slot", "unseen", F.expr("cast(if(unseen, slot, (slot - _u) % _n) + 1 as int)").alias("source_rank"))
    most = max(targets.values(), default=1)
    first = queue_heads(own.where("_seen IS NULL"), by, order, most, key, "source_rank").withColumn("unseen", F.lit(True))
    whole = queue_heads(own, by, order, most, key, "source_rank").withColumn("unseen", F.lit(False))
    return slots.join(first.unionByName(whole).drop("_seen"), [by, "unseen", "source_rank"])


def diagnostic_quotas(dialogues: DataFrame, order: list[Column]) -> DataFrame:
    """(dialogue_id, role, quota): one of each label and one NONE, and of one label two, by turns along the dialogues' order."""
    turns = with_ordinal(dialogues, order, "_i")
    doubled = F.get(F.array(*map(F.lit, POSITIVE_LABELS)), ((F.col("_i") - 1) % len(POSITIVE_LABELS)).cast("int"))
    roles = F.explode(F.array(*map(F.lit, (*POSITIVE_LABELS, "NONE")))).alias("role")
    return turns.select("dialogue_id", roles, doubled.alias("_d")).select("dialogue_id", "role", (1 + (F.col("role") == F.col("_d")).cast("int")).alias("quota"))


def diagnostic_shortages(updates: DataFrame, quotas: DataFrame) -> DataFrame:
    """(dialogue_id, role, quota, eligible) where a dialogue has fewer updates of a role than its quota."""
    found = updates.groupBy("dialogue_id", "role").agg(F.count(F.lit(1)).alias("eligible"))
    return quotas.join(found, ["dialogue_id", "role"], "left").na.fill(0, ["eligible"]).where("eligible < quota")


def balanced_diagnostic(updates: DataFrame, quotas: DataFrame, seed: str, strict: bool = True) -> DataFrame:
    """Updates of one block up to the quota of their dialogue and role, in seeded order.

    ``updates`` has (dialogue_id, update_id, role): the label of an update of
    one gold relation, or NONE.  A dialogue that falls short is an error; with
    ``strict`` off it gives what it has, see :func:`diagnostic_shortages`.
    """
    if strict:
        short = diagnostic_shortages(updates, quotas).orderBy("dialogue_id", "role").limit(20).collect()
        if short:
            raise ValueError("not enough updates: " + ", ".join(f"{r.eligible} of {r.quota} {r.role} in {r.dialogue_id}" for r in short))
    return quota_top(updates, quotas, ["dialogue_id", "role"], seed, "update_id")
