"""Threshold gates over metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric, whether it must be at least (or at most) the bound, bound.
RELIABILITY = (
    ("update_count", True, 30.0), ("json_validity_rate", True, 1.0), ("schema_validity_rate", True, 1.0), ("invalid_id_count", False, 0.0), ("exact_scenario_patch_accuracy", True, 0.80), ("edge_f1", True, 0.85),
    ("relation_macro_f1", True, 0.75), ("direction_accuracy", True, 0.95), ("false_edges_per_update", False, 0.20), ("judge_validity_rate", True, 1.0), ("judge_spec_adherence_mean", True, 3.5), ("judge_robustness_mean", True, 3.5),
)
PROMOTION = (
    ("exact_patch_accuracy", True, 0.43333333333333335), ("edge_f1", True, 0.40), ("relation_macro_f1", True, 0.39), ("attack_f1", True, 0.30), ("false_edges_per_update", False, 0.30),
    ("none_scenarios_with_false_edges", False, 1.0), ("judge_robustness", True, 2.966666666666667), ("json_validity", True, 1.0), ("schema_validity", True, 1.0),
)
DEVELOPMENT = (
    ("exact_patch_accuracy", True, 0.3), ("edge_f1", True, 0.39146341463414636), ("relation_macro_f1", True, 0.3151515151515151), ("false_edges_per_update", False, 0.3333333333333333),
    ("none_scenarios_with_false_edges", False, 2.0), ("json_validity", True, 1.0), ("schema_validity", True, 1.0),
)
MARGINS = [round(i * 0.05, 2) for i in range(61)]


def check_thresholds(metrics: DataFrame, thresholds, key: list[str]) -> DataFrame:
    """(key, ord, check, value, bound, passed): a row per threshold; a metric that is null fails, one that is not there is an error."""
    missing = [m for m, _, _ in thresholds if m not in metrics.columns]
    if missing:
        raise ValueError(f"metrics without a column: {', '.join(missing)}")
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(m).alias("check"), F.col(m).cast("double").alias("value"), F.lit(b).alias("bound"), F.coalesce((F.col(m) >= b) if up else (F.col(m) <= b), F.lit(False)).alias("passed")) for i, (m, up, b) in enumerate(thresholds)]
    return metrics.select(*key, F.explode(F.array(*rows)).alias("c")).select(*key, "c.*")


def failures(checks: DataFrame, key: list[str]) -> DataFrame:
    """Per key whether all checks passed and the failed ones in their order, comma-joined."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "check"))))
    return checks.groupBy(*key).agg(F.bool_and("passed").alias("clears"), F.array_join(F.transform(failed, lambda x: x["check"]), ",").alias("failed"))


def select_margin(grid: DataFrame, thresholds) -> DataFrame:
    """The margin with the best (gate passed, F1, exact, macro-F1, fewest false edges, fewest false NONE blocks, largest margin)."""
    passed = failures(check_thresholds(grid, thresholds, ["margin"]), ["margin"]).select("margin", F.col("clears").alias("gate"))
    order = ["gate", "edge_f1", "exact_patch_accuracy", "relation_macro_f1", -F.col("false_edges_per_update"), -F.col("none_scenarios_with_false_edges"), "margin"]
    return grid.join(passed, "margin").orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order]).limit(1)


def gate_verdict(cells: DataFrame, providers: tuple[str, ...], prompts: tuple[str, ...]) -> DataFrame:
    """PASS when the matrix is complete and no cell clears the bar.

    ``cells`` has a row per (provider, prompt) with clears and complete.  The
    matrix is complete when each of ``providers`` answered each of ``prompts``,
    nobody else answered anything, and every cell is measured in full.
    """
    expected = F.array_sort(F.array(*[F.lit(f"{p}:{q}") for p in providers for q in prompts]))
    found = F.array_sort(F.collect_list(F.concat_ws(":", "provider", "prompt"))).alias("found")
    cleared = F.array_sort(F.collect_list(F.when(F.col("clears"), F.concat_ws(":", "provider", "prompt")))).alias("cleared")
    out = cells.agg(F.count(F.lit(1)).alias("cells"), found, cleared, F.coalesce(F.bool_and("complete"), F.lit(False)).alias("complete"))
    whole = F.col("complete") & (F.col("found") == expected)
    status = F.when(whole & (F.size("cleared") == 0), "PASS").otherwise("FAIL")
    return out.select("cells", whole.alias("measurement_complete"), F.array_join("cleared", ",").alias("bar_clearing"), status.alias("status"))
