"""Places in an order, the heads of queues and running totals, none of which puts a whole table or a large group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged

#: Rows of one task when totals are made exact at their crossing point.
STRETCH = 1 << 16


def with_ordinal(rows: DataFrame, order: list[Column], name: str = "ordinal", by: tuple[str, ...] = ()) -> DataFrame:
    """``row_number`` over ``order``, within ``by`` if given, for any types and groups of any size.

    Spark samples ranges of (by, order) and sorts each; the table is written, as
    ranges may fall differently the next time.  A row's place in its range and
    the counts of the ranges before it, a few rows a range, give its number.
    The order should end in a unique key: rows that tie lie in one range and
    are numbered as they come.
    """
    keys = [*map(F.col, by), *order]
    laid = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    laid = laid.withColumns({"_range": F.shiftright("_at", 33), "_group": F.struct(*by) if by else F.lit(0)})
    sizes = laid.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_group", "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    return laid.join(starts, ["_group", "_range"]).withColumn(name, F.col("_at") + F.col("_start")).drop("_group", "_range", "_start", "_at")


def queue_heads(rows: DataFrame, by: str, order: list[Column], k: int, key: str, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each queue with their ranks, for few queues of any length.

    Each queue is dealt by a hash of ``key`` over as many tasks as a shuffle has,
    these keep their own ``k`` best, and only those meet.
    """
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy(by, "_share").orderBy(*order)
    best = rows.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares))).withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= k)
    return best.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k).drop("_share", "_own")


def crossing(rows: DataFrame, ordinal: str, size: str, limit: int) -> tuple[int | None, int]:
    """(ordinal of the first row whose running total exceeds ``limit``, total before it); None and the whole total if there is none.

    Stretches of ordinals are added up first; the stretch in which the total
    crosses the limit alone is looked at row by row.
    """
    stretch = F.floor(F.col(ordinal) / STRETCH)
    sums = rows.groupBy(stretch.alias("s")).agg(F.sum(size).alias("n"))
    upto = sums.withColumn("t", F.sum("n").over(Window.orderBy("s")))  # a row per STRETCH ordinals
    first = upto.where(F.col("t") > limit).orderBy("s").select("s", F.col("t") - F.col("n")).head()
    if first is None:
        return None, rows.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
    inside = rows.where(stretch == first[0]).withColumn("t", F.sum(size).over(Window.orderBy(ordinal)) + first[1])  # STRETCH rows at most
    at = inside.where(F.col("t") > limit).orderBy(ordinal).select(ordinal, F.col("t") - F.col(size)).head()
    return at[0], at[1]
