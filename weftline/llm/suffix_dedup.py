"""Suffix-array dedup with a run-length index.

Goal: every byte covered by a ``length``-byte string that also starts anywhere
else.  A suffix array of a whole corpus doesn't fit a task, so strings are
dealt to small indexes first, and exactly: each ``length``-byte window belongs
to its anchor, the ``GRAM``-byte piece of least hash in it.  Equal windows have
equal anchors, so only anchors that occur twice matter, and windows of
different anchors never need to meet.  What is sent is the anchor's context,
the bytes of the windows it owns; equal contexts are made one on the way.

Each task then builds a run-compressed Burrows-Wheeler transform over the
contexts it holds, with positions and longest common prefixes sampled at the
ends of its runs.  Matching statistics are streamed over the texts from these
samples, and positions with a match of ``length`` bytes or more in another
context are marked.  Equal contexts are one text there; one that stands in
several places repeats as a whole.

An anchor with more than ``MOST_CONTEXTS`` different contexts isn't indexed:
digests of its windows are counted instead, which a combine keeps balanced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _BASE, _BYTE, _INVERSE, mix64, powers, runs_of_texts
from .store import bounded_batches, drop, given_back, stage

LENGTH = 200
GRAM = 32
MOST_CONTEXTS = 4096
#: Bytes of contexts in one index, about.
INDEX_BYTES = 1 << 20
#: Bytes of contexts that a task holds before it sends them on, and those of one text more.
CUT_BYTES = 4 << 20
#: Bytes of short texts that are hashed at once.
HASHED_BYTES = 1 << 18
#: Longer texts are cut into overlapping pieces for hashing.
PIECE = 1 << 20
_POSITION_BITS = 26
_U = np.uint64


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor of one text."""
    parts = []
    for base in range(0, max(1, len(text) - length + 1), PIECE):
        parts.append([x + base if i else x for i, x in enumerate(_anchors([text[base : base + PIECE + length - 1]], length)[1:])])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(texts: list[bytes], length: int):
    """(text number, hash, position, first window, last window) of the anchors of short texts, positions within the text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    base = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty.astype(_U), empty, empty, empty
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=_U, out=total[1:])
    n = len(data) - GRAM + 1
    grams = mix64((total[GRAM:] - total[:n]) * powers(_INVERSE, len(data))[:n])
    least = (grams & ~_U((1 << _POSITION_BITS) - 1)) | np.arange(n, dtype=_U)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)  # per window; windows across texts go next
    of = np.repeat(np.arange(len(texts)), lengths)[: len(at)]
    whole = np.arange(len(at)) + length <= base[of + 1]
    windows = np.flatnonzero(whole)
    if not len(windows):
        return empty, empty.astype(_U), empty, empty, empty
    at, of = at[windows], of[windows]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]))))
    last = np.concatenate((cut[1:] - 1, [len(at) - 1]))
    number = of[cut]
    return number, grams[at[cut]], at[cut] - base[number], windows[cut] - base[number], windows[last] - base[number]


def _each_text(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``anchors`` of each text, short ones together."""
    for a, b in runs_of_texts([len(t) for t in texts], HASHED_BYTES):
        if b - a == 1:
            yield anchors(texts[a], length)
            continue
        number, *rest = _anchors(texts[a:b], length)
        cut = np.searchsorted(number, np.arange(b - a + 1))
        for i in range(b - a):
            yield tuple(x[cut[i] : cut[i + 1]] for x in rest)


def context_key(context: bytes) -> int:
    return int.from_bytes(hashlib.md5(context, usedforsecurity=False).digest()[:8], "little", signed=True)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts that end each in a mark of its own.

    Kept are, for each of the r runs, its symbol (a byte plus one; 0: a mark,
    always a run of its own) and length, and for its first and last row the
    position of the suffix there and the longest prefix that it shares with the
    row before or after.  The suffix order and its ranks live while these are
    computed; what stays is proportional to r, which copies hardly raise.
    """

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        n = self.size = int(lengths.sum()) + len(texts)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(n, dtype=bool)
        inside[ends] = False
        symbols = np.zeros(n + 8, dtype=np.int16)
        symbols[:n][inside] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int16) + 1
        rest = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols before the mark
        steps = self._ranks(symbols, rest, int(lengths.max(initial=0)))
        # suffixes that are equal up to their marks stand in text order, as their marks do
        order = np.argsort(steps[-1][1], kind="stable")
        transform = np.where(order > 0, symbols[order - 1], 0)
        change = np.ones(n + 1, dtype=bool)
        change[1:n] = (transform[1:] != transform[:-1]) | (transform[1:] == 0)
        bounds = np.flatnonzero(change)
        heads, tails = bounds[:-1], bounds[1:] - 1
        self.symbols, self.lengths = transform[heads], np.diff(bounds)
        self.first = self._samples(order, heads, -1, symbols, rest, steps)
        self.last = self._samples(order, tails, 1, symbols, rest, steps)

    @staticmethod
    def _ranks(symbols: np.ndarray, rest: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
        """Ranks of all suffixes by their first 7, 14, 28 .. symbols, until they differ or nothing is longer."""

        def ranked(keys: np.ndarray) -> tuple[np.ndarray, int]:
            by = np.argsort(keys)
            new = np.zeros(len(keys), dtype=np.int32)
            np.cumsum(keys[by[1:]] != keys[by[:-1]], out=new[1:])
            rank = np.empty(len(keys), dtype=np.int32)
            rank[by] = new
            return rank, int(new[-1]) + 1 if len(new) else 0

        n = len(rest)
        packed = np.zeros(n, dtype=np.int64)
        for k in range(7):
            packed = packed << 9 | np.where(rest > k, symbols[k : k + n], 0)
        rank, classes = ranked(packed)
        steps, depth = [(7, rank)], 7
        while classes < n and depth <= longest:
            packed = rank.astype(np.int64) * (n + 1)
            long = np.flatnonzero(rest >= depth)
            packed[long] += rank[long + depth] + 1
            rank, classes = ranked(packed)
            depth *= 2
            steps.append((depth, rank))
        return steps

    @staticmethod
    def _samples(order: np.ndarray, rows: np.ndarray, other: int, symbols: np.ndarray, rest: np.ndarray, steps: list) -> tuple[np.ndarray, np.ndarray]:
        """By position: (position of the suffix in each of the rows, prefix shared with that in the row beside it)."""
        near = rows + other
        ok = (near >= 0) & (near < len(order))
        start, a, b = order[rows], order[rows[ok]], order[near[ok]]
        room, out = np.minimum(rest[a], rest[b]), np.zeros(len(a), dtype=np.int64)
        for depth, rank in reversed(steps):
            for _ in range(2 if rank is steps[-1][1] else 1):
                same = (out + depth <= room) & (rank[a] == rank[b])
                out[same] += depth
                a[same] += depth
                b[same] += depth
        left = np.flatnonzero(out < room)
        for _ in range(6):
            left = left[(symbols[a[left]] == symbols[b[left]]) & (out[left] < room[left])]
            out[left] += 1
            a[left] += 1
            b[left] += 1
        found = np.zeros(len(rows), dtype=np.int64)
        found[ok] = out
        by = np.argsort(start)
        return start[by], found[by]

    def matching_statistics(self, start: int, stop: int) -> np.ndarray:
        """Longest match, with any other position, of each position from start to stop.

        Streamed from the samples: where the row before a suffix is of the same
        run, so is that of the next position, and its match is one less.  The
        first position of a text follows a mark and so is always sampled.
        """
        at = np.arange(start, stop)
        out = np.zeros(stop - start, dtype=np.int64)
        for sampled, common in (self.first, self.last):
            k = np.searchsorted(sampled, at, side="right") - 1
            out = np.maximum(out, common[k] - (at - sampled[k]))
        return out

    def text(self, i: int) -> bytes:
        """The i-th text, read backwards out of the runs alone."""
        starts = np.cumsum(self.lengths) - self.lengths
        by = np.argsort(self.symbols, kind="stable")
        base = np.empty(len(by), dtype=np.int64)
        base[by] = np.cumsum(self.lengths[by]) - self.lengths[by]
        row, out = i, bytearray()
        while True:
            run = int(np.searchsorted(starts, row, side="right")) - 1
            if self.symbols[run] == 0:
                return bytes(reversed(out))
            out.append(int(self.symbols[run]) - 1)
            row = int(base[run]) + row - int(starts[run])


def marked_windows(contexts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context the runs [first, last] of its windows that another context holds too."""
    index = RunLengthIndex(contexts)
    out, base = [], 0
    for c in contexts:
        own = np.concatenate(([False], index.matching_statistics(base, base + len(c)) >= length, [False]))
        edges = np.flatnonzero(own[1:] != own[:-1])
        out.append([(int(a), int(b) - 1) for a, b in zip(edges[0::2], edges[1::2], strict=True)])
        base += len(c) + 1
    return out


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def _index_tasks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit(rows):
            found = marked_windows([r[2] for r in rows], length)
            rows = [(h, c, m) for (h, c, _), m in zip(rows, found, strict=True) if m]
            runs = [[{"first": a, "last": b} for a, b in m] for _, _, m in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(runs, _RUNS)], names=["h", "c", "runs"])

        for batch in batches:
            for h, c, context in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if size >= INDEX_BYTES and held[-1][0] != h:  # contexts of an anchor stay together
                    yield emit(held)
                    held, size = [], 0
                held.append((h, c, context))
                size += len(context)
        if held:
            yield emit(held)

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row; texts are their UTF-8 bytes.

    A byte goes when a ``length``-byte string that covers it starts anywhere
    else, in another row or the same.  Null and empty texts have no bytes.  Rows
    with equal texts of ``length`` bytes or more lose all of them; results hang
    on the text, so repeated and null ids keep a row each.  Texts of any length
    are cut into overlapping pieces for hashing; other columns are ignored, an
    empty table gives an empty table.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            texts, keys = [], []
            for k, t in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                if len(t) >= length and k not in met:
                    texts.append(t)
                    keys.append(k)
                    if len(met) < 1 << 20:  # spares copies within a task; others fall together by key
                        met.add(k)
            h, doc, many = [np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, bool)]
            for k, (a, _, _, _) in zip(keys, _each_text(texts, length), strict=True):
                kinds, n = np.unique(a, return_counts=True)
                h.append(kinds), many.append(n > 1), doc.append(np.full(len(kinds), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(many))], names=["h", "doc", "many"])

    found = stage(texts.select("doc", "text").mapInArrow(given_back(find), "h long, doc long, many boolean"), "anchors")
    twice = found.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("many").alias("many")).where("many OR a <> b").select("h")
    twice = stage(twice, "twice")  # written, so that the join may split an anchor that a large share of the texts hold
    wanted = stage(found.join(twice, "h").groupBy("doc").agg(F.collect_set("h").alias("wanted")), "repeated-anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        names = ["h", "c", "doc", "first", "reach", "context"]

        def emit(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())], names=names)

        for batch in batches:
            own = [(k, t, w) for k, t, w in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2), strict=True) if k not in met and not met.add(k)]
            rows: list[list] = []
            held = 0
            for (doc, text, some), (h, pos, first, last) in zip(own, _each_text([o[1] for o in own], length), strict=True):
                open_rows: dict[tuple[int, int], list] = {}
                for i in np.flatnonzero(np.isin(h, some.values.to_numpy().view(_U))):
                    context, begin = text[first[i] : last[i] + length], int(first[i])
                    # contexts that start at other distances from the anchor can't be equal as a whole
                    key = int(h[i].astype(np.int64)), context_key(context + int(pos[i] - first[i]).to_bytes(4, "little"))
                    row = open_rows.get(key)
                    if row is not None and begin - row[3] - row[4] <= length:
                        row[4] = begin - row[3]
                        continue
                    open_rows[key] = [*key, doc, begin, 0, context if row is None else None]
                    rows.append(open_rows[key])
                    held += len(context) if row is None else 0
                if held >= CUT_BYTES:
                    yield emit(rows)
                    rows, held = [], 0
            yield emit(rows)

    # a stretch of equal contexts at most ``length`` bytes apart is one row: marks within them join to one span; ``reach`` is from its first to its last
    contexts = texts.select("doc", "text").join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(given_back(cut), "h long, c long, doc long, first long, reach long, context binary")
    contexts = stage(contexts, "contexts")
    drop(found, wanted, twice)

    spot = F.struct("doc", "first")
    kinds = stage(contexts.groupBy("h", "c").agg(F.first("context", ignorenulls=True).alias("context"), ((F.min(spot) != F.max(spot)) | (F.max("reach") > 0)).alias("many")), "context-kinds")
    per_anchor = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = per_anchor.where(F.col("n") > MOST_CONTEXTS).select("h")
    some = per_anchor.where(F.col("n").between(2, MOST_CONTEXTS)).select("h")
    indexed = kinds.join(some, "h").select("h", "c", "context").repartition("h").sortWithinPartitions("h", "c").mapInArrow(given_back(_index_tasks(length)), "h long, c long, runs array<struct<first: long, last: long>>")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, context in zip(*batch.columns, strict=True):
                t = context.as_py()
                n = len(t) - length + 1
                digests = [hashlib.md5(t[i : i + length], usedforsecurity=False).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * n, pa.int64()), pa.array([c.as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary())], names=["h", "c", "i", "digest"])

    each = kinds.join(hot, "h", "left_semi").select("h", "c", "context").mapInArrow(given_back(windows), "h long, c long, i long, digest binary")
    again = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    counted = each.join(again, "digest").groupBy("h", "c").agg(F.array_agg(F.struct(F.col("i").alias("first"), F.col("i").alias("last"))).alias("runs"))

    whole = kinds.where("many").select("h", "c", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.length("context") - length).cast("long").alias("last"))).alias("runs"))
    marks = whole.unionByName(indexed).unionByName(counted)
    spans = contexts.select("h", "c", "doc", "first", "reach").join(marks, ["h", "c"]).select("doc", F.expr(f"inline(transform(runs, r -> named_struct('a', first + r.first, 'b', first + reach + r.last + {length})))")).distinct()
    spans = stage(spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")
    drop(contexts, kinds)

    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests = [], [], [], []
            for text, runs in zip(_bytes(batch.column(1)), batch.column(2), strict=True):
                merged: list[list[int]] = []
                for r in runs.as_py() or ():
                    if merged and r["a"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["b"])
                    else:
                        merged.append([r["a"], r["b"]])
                kept = [text[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(text)], strict=True)]
                n_bytes.append(len(text))
                n_removed.append(sum(b - a for a, b in merged))
                n_spans.append(len(merged))
                digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # equal texts: nothing about their insides needs to be known
    counts = texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit(True).alias("copied"))
    copied = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b")))
    known = counts.unionByName(spans, allowMissingColumns=True).groupBy("doc").agg(F.max("copied").alias("copied"), F.first("spans", ignorenulls=True).alias("spans"))
    known = stage(known, "known")  # written, so that the join may split a text that a large share of the rows hold
    told = texts.join(known, "doc", "left")
    told = told.select("id", "text", F.when(F.col("copied") & (F.octet_length("text") >= length), copied).otherwise(F.col("spans")).alias("spans"))
    return told.mapInArrow(given_back(apply), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
