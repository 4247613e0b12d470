"""Audits: retention funnels, violation tables, distributions, ledgers, graph order."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, violations): rows that break each rule; none means it holds."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def distribution(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(column).alias("least"), F.avg(column).alias("mean"), F.max(column).alias("most"), F.count(F.lit(1)).alias("n"))


def ledger(points: Mapping[str, DataFrame]) -> DataFrame:
    """Reports of different shapes under one scope column; what a report lacks is null."""
    out = None
    for scope, df in points.items():
        one = df.withColumn("scope", F.lit(scope))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def most_common(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Per group the most frequent value, of equals the one seen first."""
    per = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "_first", value))).where("_r = 1").drop("_r", "_first")


def topological_order(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """(dialogue_id, node_id, turn): sources first, of several the least node index; nodes in cycles follow in that order.

    ``before`` holds (dialogue_id, from_id, to_id). A map is small (tens of
    nodes), so each is one frame; maps are spread over tasks.
    """
    both = nodes.select("dialogue_id", "node_id", "node_index", F.lit(None).cast("string").alias("to_id")).unionByName(before.select("dialogue_id", F.col("from_id").alias("node_id"), F.lit(None).cast("long").alias("node_index"), "to_id"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.to_id.isna()]
        # by node index, of equals by the number in the id
        rank = {n: (i, int("".join(c for c in n if c.isdigit()) or 0)) for n, i in zip(own.node_id, own.node_index, strict=True)}
        after: dict[str, set[str]] = {n: set() for n in rank}
        need = dict.fromkeys(rank, 0)
        for a, b in pdf[pdf.to_id.notna()][["node_id", "to_id"]].itertuples(index=False):
            if a in rank and b in rank and a != b and b not in after[a]:
                after[a].add(b)
                need[b] += 1
        ready = [(rank[n], n) for n, k in need.items() if k == 0]
        heapq.heapify(ready)
        done: list[str] = []
        while ready:
            _, n = heapq.heappop(ready)
            done.append(n)
            for m in after[n]:
                need[m] -= 1
                if need[m] == 0:
                    heapq.heappush(ready, (rank[m], m))
        left = set(rank) - set(done)
        done += sorted(left, key=lambda n: (rank[n], n))
        return pd.DataFrame({"dialogue_id": pdf.dialogue_id.iloc[0], "node_id": done, "turn": range(1, len(done) + 1), "in_cycle": [n in left for n in done]})

    return both.groupBy("dialogue_id").applyInPandas(order, "dialogue_id string, node_id string, turn int, in_cycle boolean")
