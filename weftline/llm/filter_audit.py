"""What each of several filters removes, for every order in which they may be applied.

Each document gets one failure flag a filter.  Documents are counted once by
(part, flags); a CUBE over the part and the flags of these counts then holds, in
the rows of a grouping set whose flags are all false, how many documents survive
that set of filters.  Every figure of a step is a difference of the survivors of
two sets: the filters before it, and those with it.  So the texts are read once,
and no document meets an order.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text: too short, too repetitive, too loud, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each row of ``docs``.

    ``E`` is the repeat of a text that a smaller doc_id has.  A row passes it
    when its (digest, doc_id) is the least of that digest; that pair is the join
    key, so the rows of a text that fills a third of the table are dealt evenly.
    Rows with a null doc_id neither fail ``E`` nor make others fail.  A document
    with several label rows counts as good or toxic when one of them says so.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in text_failures(text).items()))
    rows = stage(rows, "flags")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return (
        rows.join(first, ["digest", "doc_id"], "left")
        .join(known, "doc_id", "left")
        .select("part", *"ABCD", F.expr("doc_id is not null and first is null").alias("E"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )


def survivors(profile: DataFrame, filters: str) -> DataFrame:
    """(part, chosen, n, good, toxic) for every part and set of filters: what passes all of the set, zeros included.

    ``chosen`` has bit i for the i-th filter; ``profile`` has counts n, good and
    toxic of any rows with the part and one boolean flag a filter.
    """
    flags = list(filters)
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    cube = profile.cube("part", *flags).agg(*sums, F.grouping("part").alias("no_part"), *(F.grouping(f).alias(f"no_{f}") for f in flags))
    passing = F.lit(True)
    for f in flags:
        passing = passing & ((F.col(f"no_{f}") == 1) | ~F.col(f))
    chosen = sum(((1 - F.col(f"no_{f}").cast("int")) * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    found = cube.where((F.col("no_part") == 0) & passing).select("part", chosen.alias("chosen"), "n", "good", "toxic")
    sets = profile.select("part").distinct().withColumn("chosen", F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))))
    return sets.join(found, ["part", "chosen"], "left").select("part", "chosen", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good", "toxic")))


def order_audit(profile: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step; see :func:`filter_interactions` for the columns."""
    full = (1 << len(filters)) - 1
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    bit = F.expr(f"shiftleft(1, cast(instr('{filters}', letter) - 1 as int))")
    steps = (
        profile.sparkSession.range(1)
        .select(F.explode(orders).alias("filter_order"))
        .select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
        .select("filter_order", "step", F.expr("substr(filter_order, step, 1)").alias("letter"), F.expr("substr(filter_order, 1, step - 1)").alias("earlier"))
        .select("filter_order", "step", bit.alias("bit"), sum((F.when(F.col("earlier").contains(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0)).alias("before"))
    )
    alive = stage(survivors(profile, filters), "survivors")

    def at(name: str) -> DataFrame:
        return alive.select("part", F.col("chosen").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "good", "toxic")))

    # a filter's own share: alone, and when all others have passed
    sets = steps.select("bit").distinct().withColumns({"one": F.col("bit"), "rest": F.lit(full) - F.col("bit"), "none": F.lit(0), "all": F.lit(full)})
    lone = sets.join(at("one"), "one").join(at("rest"), ["part", "rest"])
    for name in ("none", "all"):
        lone = lone.join(at(name), ["part", name])
    lone = lone.select("part", "bit", (F.col("none_n") - F.col("one_n")).alias("failing"), (F.col("rest_n") - F.col("all_n")).alias("unique_fails"))

    moved = steps.withColumn("after", F.col("before") + F.col("bit")).join(at("before"), "before").join(at("after"), ["part", "after"])
    moved = moved.select(
        "part",
        "filter_order",
        "step",
        "bit",
        F.col("after_n").alias("kept"),
        (F.col("before_n") - F.col("after_n")).alias("removed"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"),
        (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )
    share = moved.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return (
        moved.join(lone, ["part", "bit"])
        .join(share, ["part", "bit"])
        .select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of five filters.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * ``[A-Z]``
    > 10 * code points; D: any of ``#$%&*|``; E: the text of a smaller doc_id.
    Words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive.  The part is the lang.

    Null texts and langs count as empty ones, so null texts repeat each other.
    An empty text fails A alone, unless it repeats.  Repeated rows count each;
    rows that repeat a doc_id with the same text don't fail E by each other.
    Other columns are ignored.  An empty table has no part and gives no row.
    """
    flagged = failure_flags(docs, labels)
    profile = flagged.groupBy("part", *"ABCDE").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return order_audit(stage(profile, "profile"))
