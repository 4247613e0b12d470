"""Quality rules: a decision list learned by sequential covering.

Rules are conjunctions of thresholds over document statistics.  Each is grown
on two thirds of the labelled rows still uncovered, by the condition with the
largest information gain, then pruned from its end on the last third, and kept
while it is precise there.  The list becomes one ordered conditional
expression, so applying it is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import COUNTS, RATIOS, document_statistics
from .store import drop, stage

#: Labelled rows that the list is learned from, at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
FEATURES = (*(c for c in COUNTS if c not in ("n_bytes", "n_letters", "n_wide", "n_distinct")), *RATIOS)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, within: str = "") -> Column:
        value = F.col(within + self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self, within: str = "") -> Column:
        out = self.conditions[0].column(within)
        for c in self.conditions[1:]:
            out &= c.column(within)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _holds(rule: tuple[Condition, ...], x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.ones(len(rows), dtype=bool)
    for c in rule:
        out &= c.holds(x[c.feature][rows])
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Condition | None:
    """The condition with the largest gain p * (log precision after - before)."""
    y = bad[rows]
    before = np.log2(max(y.mean(), 1e-9))
    best, found = 1e-9, None
    for feature in FEATURES:
        v = x[feature][rows]
        order = np.argsort(v, kind="stable")
        v, p = v[order], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        if len(cut) > 256:
            cut = cut[np.linspace(0, len(cut) - 1, 256).astype(int)]
        for above in (False, True):
            hit = p[-1] - p[cut] if above else p[cut]
            n = len(v) - cut - 1 if above else cut + 1
            gain = np.where(hit > 0, hit * (np.log2(np.maximum(hit, 1e-9) / n) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], Condition(feature, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray, precision: float = 0.95, longest: int = 3, most: int = 24, least: int = 3) -> list[Rule]:
    """Ordered rules for rows with ``bad``; ``order`` ranks the rows and deals them to growing and pruning."""
    rows = np.argsort(order, kind="stable")
    prune = np.zeros(len(bad), dtype=bool)
    prune[rows[2::3]] = True
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < most:
        grow, hold = np.flatnonzero(left & ~prune), np.flatnonzero(left & prune)
        if bad[grow].sum() < least:
            break
        rule, inside = (), grow
        while len(rule) < longest and not bad[inside].all():
            c = _best(x, bad, inside)
            if c is None:
                break
            rule, inside = (*rule, c), inside[c.holds(x[c.feature][inside])]
        scored = []
        for k in range(1, len(rule) + 1):
            hit = hold[_holds(rule[:k], x, hold)]
            p = int(bad[hit].sum())
            scored.append(((2 * p - len(hit)) / max(len(hit), 1), -k))
        if not scored:
            break
        rule = rule[: -max(scored)[1]]
        both = np.flatnonzero(left)
        hit = both[_holds(rule, x, both)]
        pruned = hold[_holds(rule, x, hold)]
        if len(hit) < least or bad[hit].mean() < precision or (len(pruned) and bad[pruned].mean() < precision):
            break
        rules.append(Rule(rule, float(bad[hit].mean()), len(hit)))
        left[hit] = False
    return rules


def learn_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, precision: float = 0.95) -> list[Rule]:
    """Rules for label 0, from at most ``sample_rows`` labelled rows, of which those failing the base rule teach nothing; none where a class is missing."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    chosen = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample_rows)
    names = list(dict.fromkeys(FEATURES))
    # one row of each id, however often it repeats, before anything goes to the driver
    rows = stats.where(~base_failed()).join(F.broadcast(chosen), "id").groupBy("id", "h", "y").agg(F.min(F.struct(*names)).alias("s")).select("id", "h", "y", "s.*").toPandas()
    if rows.empty or rows["y"].nunique() < 2:
        return []
    rows = rows.sort_values(["h", "id"], kind="stable")
    x = {f: rows[f].to_numpy(dtype=np.float64) for f in FEATURES}
    return learn(x, rows["y"].to_numpy() == 0, np.arange(len(rows)), precision)


def verdict(rules: list[Rule], within: str = "") -> Column:
    """Number of the first rule that holds (from 1), null where none does; statistics are columns, or fields of the struct ``within``."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(within), F.lit(i)).otherwise(out)
    return out


def base_failed(within: str = "") -> Column:
    words, repeated = F.col(f"{within}n_words"), F.col(f"{within}n_repeat_words")
    return (words < 10) | (100 * repeated > 20 * words)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of each row.

    The text is read once; its statistics are staged.  Null and empty texts
    have no words, so they fail the base rule.  Without labels of both classes
    the list is empty and the base rule alone decides.  Repeated ids keep a row
    each; of repeated labels the least counts; null labels and ids teach nothing.
    Texts of any length are counted whole; an empty table gives an empty table.
    """
    stats = stage(document_statistics(docs, id_col, text_col), "statistics")
    rules = learn_rules(stats, labels, id_col, label_col)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows of ``docs`` that the base rule and the list keep, columns as they are.

    The list is learned from the labelled rows alone; then one pass over the
    texts computes statistics and drops what is rejected.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col).distinct()
    chosen = known.withColumn("h", F.xxhash64(id_col)).orderBy("h", id_col).limit(SAMPLE_ROWS).select(id_col)
    sample = stage(document_statistics(docs.join(F.broadcast(chosen), id_col, "left_semi"), id_col, text_col), "statistics")
    rules = learn_rules(sample, labels, id_col, label_col)
    drop(sample)
    return filter_rows(docs, rules, text_col)


def filter_rows(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Rows that pass: one Arrow pass adds the statistics the rules ask for, the ordered conditional decides."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructType

    from .stats import statistics, with_ratios
    from .store import bounded_batches, given_back

    bounded_batches(docs.sparkSession)
    at, name = docs.columns.index(text_col), "_statistics"
    while name in docs.columns:
        name += "_"
    asked = list(dict.fromkeys(["n_words", "n_repeat_words", *(c.feature for r in rules for c in r.conditions)]))

    def run(batches):
        for batch in batches:
            s = with_ratios(statistics([t.as_py() or b"" for t in batch.column(at).cast(pa.binary())]))
            found = pa.StructArray.from_arrays([pa.array(s[f].astype(np.float64)) for f in asked], names=asked)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    kind = StructType()
    for f in asked:
        kind = kind.add(f, DoubleType())
    told = docs.mapInArrow(given_back(run), StructType([*docs.schema.fields]).add(name, kind))
    within = f"{name}."
    return told.where(~base_failed(within) & verdict(rules, within).isNull()).select(*docs.columns)
