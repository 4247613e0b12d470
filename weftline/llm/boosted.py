"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training runs on the driver over a bounded sample of labelled rows.  Features
are cut into at most ``BINS`` quantile bins; trees grow leaf by leaf, and all
end up in four flat arrays that numpy walks for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import COUNTS, RATIOS, document_statistics
from .store import given_back, stage

#: Labelled rows that the trees are fitted on, at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
BINS = 64
FEATURES = (*COUNTS, *RATIOS)


@dataclass(frozen=True)
class Forest:
    """Node i asks x[feature[i]] <= threshold[i]: left[i], else left[i] + 1; a leaf has feature -1 and a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + right, node)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, leaves: int = 12, rate: float = 0.12, least: int = 10, l2: float = 1.0) -> Forest:
    """Logistic loss; with fewer than two classes the forest is the (smoothed) share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.empty(x.shape, int)
    flat = binned + np.arange(x.shape[1]) * BINS
    size = x.shape[1] * BINS
    margin = np.full(len(y), base)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        at = flat[rows].ravel()
        width = x.shape[1]
        sums = [np.cumsum(np.bincount(at, np.repeat(v[rows], width), minlength=size).reshape(width, BINS), axis=1) for v in (g, h, np.ones(len(y)))]
        total = [s[0, -1] for s in sums]
        gl, hl, nl = sums
        gr, hr, nr = total[0] - gl, total[1] - hl, total[2] - nl
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
        gain[(nl < least) | (nr < least)] = -1
        k = int(np.argmax(gain))
        return gain.flat[k], k // BINS, k % BINS

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        open_ = {roots[-1]: (np.arange(len(y)), split(np.arange(len(y)), g, h))}
        done = {}
        while len(open_) + len(done) < leaves:
            node = max(open_, key=lambda i: open_[i][1][0], default=None)
            if node is None or open_[node][1][0] <= 1e-6:
                break
            rows, (_, j, b) = open_.pop(node)
            feature[node], threshold[node], left[node] = j, float(edges[j][b]), len(feature)
            for side in (rows[binned[rows, j] <= b], rows[binned[rows, j] > b]):
                i = len(feature)
                feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
                if len(side) >= 2 * least:
                    open_[i] = (side, split(side, g, h))
                else:
                    done[i] = (side, None)
        for i, (rows, _) in (open_ | done).items():
            value[i] = float(rate * g[rows].sum() / (h[rows].sum() + l2))
            margin[rows] += value[i]
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), base)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of each row; only statistics of the text enter the score.

    Trained on labelled rows that are not held out.  Null and empty texts get
    the score of their (zero) statistics.  A null id is not held out and teaches
    nothing; repeated ids keep a row each.  Without labels of both classes every
    score is the smoothed share of label 1, 0.5 where there is none.  Texts of
    any length are counted whole; an empty table gives an empty table.
    """
    stats = stage(document_statistics(docs, id_col, text_col), "statistics")
    forest = learn_forest(stats, labels, id_col, label_col, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy().astype(np.float64) for i in range(len(FEATURES))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stats.select("id", *FEATURES).mapInArrow(given_back(run), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def learn_forest(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trees fitted on at most ``sample_rows`` labelled ids that are not held out, one row of each."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    chosen = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample_rows)
    rows = stats.join(F.broadcast(chosen), "id").groupBy("id", "h", "y").agg(F.min(F.struct(*FEATURES)).alias("s")).select("id", "h", "y", "s.*").toPandas().sort_values(["h", "id"], kind="stable")
    return fit(rows[list(FEATURES)].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64))
