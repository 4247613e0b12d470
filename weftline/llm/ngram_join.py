"""N-gram Jaccard join over count-vector R-trees.

Shingles are hashed into groups.  A document is the point of its group counts;
the summed coordinate minima of two points bound the overlap of their shingle
sets from above, and of a node's upper corner and a point likewise.  Surviving
pairs are verified on the shingle sets.

One R-tree over a corpus prunes little: the distance between unrelated points
is spread over all coordinates.  So the groups give the points one coordinate
more, a block.  Two sets of sizes a, b with Jaccard similarity t
differ in at most (a + b)(1 - t)/(1 + t) shingles; with more groups than that,
some group holds the same shingles in both, and its digest is a block that both
enter.  No link between different texts is lost, no frequency table is needed,
and a document enters about 0.15 n blocks at t = 0.9.  Each task packs the
points dealt to it, whole blocks, into one tree by (block, size, counts) and
searches it for all of them; its nodes prune by block, size, component and
summed minima, and every candidate comes out of a leaf.

Three rounds keep the number of pairs linear in tight clusters: the first
verifies one partner for each member of a block, the second the likeliest one
of another component, and only the third all pairs that are still in different
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import mix64, shingle_sets
from .store import bounded_batches, drop, given_back, is_small, stage

DIMENSIONS = 64
#: Coordinates in the last round, where unlinked pairs of a cluster are left and only finer counts tell them from links.
FINE_DIMENSIONS = 256
LEAF = 16
#: Pairs of members that one search of a tree looks at, at most, but for a single block of more.
AT_ONCE = 1 << 18
#: Members of a block that one task holds; larger blocks are joined page by page.
PAGE = 2048
#: Ids (8 bytes each) that may be broadcast; beyond it the join is a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_NONE = np.iinfo(np.int64).max


class Levels:
    """Size classes, and how many groups a set of a size needs."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the similarity must be between 0 and 1")
        self.num, self.den = num, den
        step = den / num
        ratio = step
        while ratio < 1.3:
            ratio *= step
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, -int(-bounds[-1] * ratio // 1)))
        self.bounds = np.array(bounds, dtype=np.int64)

    def differ(self, twice: int) -> int:
        """Most shingles that two linked sets, of this many in sum, can differ in."""
        return int(twice) * (self.den - self.num) // (self.den + self.num)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Digests of the first held groups, one more than can differ, at the set's level and, near its top, the next.

        Of two linked sets at one level, take that whose last such group comes
        first: all its keys lie in the other's range, and one group at least is
        untouched.  A set that holds too few groups gives its empty ones too;
        two such sets share an untouched group of either kind.
        """
        n = len(shingles)
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        out = []
        for level in (own, own + 1):
            if level > own and n * self.den < self.num * int(self.bounds[level]):
                continue
            top = int(self.bounds[level + 1]) - 1
            groups = int((self.differ(2 * top) + 1) * 1.1) + 2
            wanted = self.differ(n + min(top, n * self.den // self.num)) + 1
            group = (mix64(shingles ^ _U(level * 7919 + 1)) % _U(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            group = group[order]
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            digest = np.add.reduceat(mix64(shingles[order] + _U(12345)), cut)
            held = group[cut]
            if len(held) < wanted:
                empty = np.setdiff1d(np.arange(groups), held)
                held, digest = np.concatenate((held, empty)), np.concatenate((digest, np.zeros(len(empty), dtype=_U)))
            else:
                held, digest = held[:wanted], digest[:wanted]
            out.append(mix64(mix64(digest + held.astype(_U) * _U(0x9E3779B97F4A7C15)) + _U(level)))
        return np.concatenate(out)


def _signature(shingles: np.ndarray) -> int:
    return int(mix64(np.array([mix64(shingles + _U(77)).sum(dtype=_U) + _U(len(shingles))], dtype=_U)).view(np.int64)[0])


def _point(shingles: np.ndarray, dimensions: int = DIMENSIONS) -> bytes:
    counts = np.bincount((mix64(shingles + _U(99)) % _U(dimensions)).astype(np.int64), minlength=dimensions)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def _sketch(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, met = Levels(num, den), set()
        for batch in batches:
            sizes, sigs, keys = [], [], []
            for s in shingle_sets([t.lower() for t in _texts(batch.column(1))], width):
                sizes.append(len(s))
                sigs.append(_signature(s) if len(s) else None)
                keys.append(levels.keys(s).view(np.int64) if len(s) and sigs[-1] not in met else None)
                if len(met) < 1 << 20:  # only spares rows of copies; they fall together later anyway
                    met.add(sigs[-1])
            offsets = np.concatenate(([0], np.cumsum([0 if k is None else len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "n", "sig", "keys"])

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, sig), each pair once, where a key has more than one sig.

    Streams: of the key at a batch's end only the last sig is kept back.
    """
    last_key = last_sig = None
    open_run = False  # whether rows of last_key went out already
    for batch in batches:
        key, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last_key is not None:
            key, sig = np.concatenate(([last_key], key)), np.concatenate(([last_sig], sig))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig = key[new], sig[new]
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        out = np.zeros(len(key), dtype=bool)
        out[1:] |= same
        out[:-1] |= same
        first_is_out = open_run and last_key is not None and key[0] == last_key
        if first_is_out:
            out[0] = False
        carried_out = first_is_out if len(key) == 1 else bool(out[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(sig[out])], names=["key", "sig"])
        last_key, last_sig, open_run = key[-1], sig[-1], carried_out
    return


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            sets = list(shingle_sets([t.lower() for t in _texts(batch.column(1))], width))
            # ids may repeat, with other texts; rows that repeat both give a set once a task, and a few more do no harm
            same = [len(s) > 0 and _signature(s) == k and k not in met and not met.add(k) for s, k in zip(sets, batch.column(0).to_pylist(), strict=True)]
            batch = batch.filter(pa.array(same, pa.bool_()))
            sets = [s for s, k in zip(sets, same, strict=True) if k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_point(s) for s in sets], pa.binary()), pa.array([_point(s, FINE_DIMENSIONS) for s in sets], pa.binary()), pa.array([(s >> _U(48)).astype(np.uint16).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "n", "point", "wide", "fine", "shingles"]
            )

    return run


class RTree:
    """Sort-tile packed tree over (block, size, counts).

    A node has the ranges of its members' blocks, sizes and labels, and the
    upper corner of their counts.  Two members may be a pair if they are of one
    block and of different labels.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, labels: np.ndarray):
        spread = np.argsort(-points.astype(np.float32).var(axis=0), kind="stable")[:2]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], sizes, blocks))
        self.points, self.sizes, self.blocks, self.labels = points[self.order], sizes[self.order], blocks[self.order], labels[self.order]
        self.levels = []
        corner, low, high = self.points, (self.blocks, self.sizes, self.labels), (self.blocks, self.sizes, self.labels)
        while len(corner) > LEAF:
            cuts = np.arange(0, len(corner), LEAF)
            corner = np.maximum.reduceat(corner, cuts)
            low, high = tuple(np.minimum.reduceat(x, cuts) for x in low), tuple(np.maximum.reduceat(x, cuts) for x in high)
            self.levels.append((corner, low, high))

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that the bounds leave, each once, as positions in the arrays given; in parts of bounded work."""
        work = np.cumsum(np.bincount(self.blocks)[self.blocks])
        start = 0
        while start < len(self.blocks):
            stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + AT_ONCE, side="right")))
            a, b = self.search(np.arange(start, stop), num, den)
            yield self.order[a], self.order[b]
            start = stop

    def search(self, own: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """From the top down, for many members at once: (member, partner after it), both in the tree's order."""
        top = len(self.levels[-1][0]) if self.levels else len(self.blocks)
        q, node = np.repeat(own, top), np.tile(np.arange(top), len(own))
        for k in range(len(self.levels) - 1, -1, -1):
            corner, (b0, s0, l0), (b1, s1, l1) = self.levels[k]
            n = self.sizes[q]
            ok = (b0[node] <= self.blocks[q]) & (b1[node] >= self.blocks[q]) & ((node + 1) * LEAF ** (k + 1) > q + 1)
            ok &= (s1[node] * den >= num * n) & (s0[node] * num <= den * n) & ((l0[node] != self.labels[q]) | (l1[node] != self.labels[q]))
            q, node = q[ok], node[ok]
            # the least total that any size in the node's range needs
            ok = self._overlap(corner, node, q, np.maximum(s0[node], -(-num * self.sizes[q] // den)), s1[node], num, den)
            q, node = q[ok], node[ok]
            q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            there = node < (len(self.levels[k - 1][0]) if k else len(self.blocks))
            q, node = q[there], node[there]
        n, m = self.sizes[q], self.sizes[node]
        ok = (node > q) & (self.blocks[node] == self.blocks[q]) & (self.labels[node] != self.labels[q]) & (m * den >= num * n) & (m * num <= den * n)
        q, node = q[ok], node[ok]
        ok = self._overlap(self.points, node, q, self.sizes[node], self.sizes[node], num, den)
        return q[ok], node[ok]

    def _overlap(self, corner: np.ndarray, node: np.ndarray, q: np.ndarray, least: np.ndarray, most: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether summed minima still allow den * overlap >= num * union with a set of ``least`` to ``most`` shingles. A count of 255 stands for any larger one."""
        out = np.ones(len(q), dtype=bool)
        for s in range(0, len(q), 50_000):
            at = slice(s, s + 50_000)
            both = np.minimum(corner[node[at]], self.points[q[at]])
            n = self.sizes[q[at]]
            total = np.where((both == 255).any(axis=1), n, both.sum(axis=1, dtype=np.int64))
            out[at] = (num + den) * np.minimum(np.minimum(total, n), most[at]) >= num * (n + least[at])
        return out


def _block_pairs(num: int, den: int, partners: str):
    """Pairs of the blocks (key, cell) that the tree over a task's rows leaves.

    Partners "hub": for each member the one with the least sig, if that is less
    than its own; "best": the likeliest one of another component, by summed
    minima; "all": all of another component.  A cell of two pages pairs across
    them only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()

        def emit(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows)
            key, cell, sig, n, label, page = (t.column(c).to_numpy() for c in ("key", "cell", "sig", "n", "label", "page"))
            point = np.frombuffer(b"".join(t.column("point").to_pylist()), dtype=np.uint8).reshape(len(key), -1)
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
            cut, block = np.flatnonzero(new), np.cumsum(new) - 1
            differ = lambda x: np.minimum.reduceat(x, cut) != np.maximum.reduceat(x, cut)
            across = differ(page)
            use = np.flatnonzero(differ(label)[block])
            if not len(use):
                return
            least = np.full(len(key), _NONE)  # of each member's partners in its block
            score, best = np.zeros(len(key)), np.full(len(key), -1)
            for a, b in RTree(point[use], n[use], block[use], label[use]).pairs(num, den):
                a, b = use[a], use[b]
                ok = ~across[block[a]] | (page[a] != page[b])
                a, b = a[ok], b[ok]
                low, high = np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])
                if partners == "hub":
                    np.minimum.at(least, np.where(sig[a] > sig[b], a, b), low)
                elif partners == "all":
                    yield from fresh(low, high)
                else:
                    liking = _likeness(point, n, a, b)
                    for own, other in ((a, b), (b, a)):
                        at = np.lexsort((sig[other], -liking, own))
                        at = at[np.concatenate(([True], own[at[1:]] != own[at[:-1]]))] if len(at) else at
                        at = at[liking[at] > score[own[at]]]
                        score[own[at]], best[own[at]] = liking[at], other[at]
            if partners == "hub":
                found = np.flatnonzero(least != _NONE)
                yield from fresh(least[found], sig[found])
            elif partners == "best":
                found = np.flatnonzero(best >= 0)
                yield from fresh(np.minimum(sig[found], sig[best[found]]), np.maximum(sig[found], sig[best[found]]))

        def fresh(low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = [p for p in dict.fromkeys(zip(low.tolist(), high.tolist(), strict=True)) if p not in met]
            if len(met) < 1 << 18:  # pairs meet in many blocks; the rest is made distinct later
                met.update(new)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held)
            key, cell = t.column("key").to_numpy(), t.column("cell").to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            if not len(change):
                continue
            done = int(change[-1]) + 1
            yield from emit(t.slice(0, done).to_batches())
            held = t.slice(done).combine_chunks().to_batches()
            rows = t.num_rows - done
        if held:
            yield from emit(held)

    return run


def _likeness(point: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarities of pairs, by summed minima."""
    out = np.empty(len(a))
    for s in range(0, len(a), 50_000):
        x, y = a[s : s + 50_000], b[s : s + 50_000]
        both = np.minimum(np.minimum(point[x], point[y]).sum(axis=1, dtype=np.int64), np.minimum(n[x], n[y]))
        out[s : s + 50_000] = both / (n[x] + n[y] - both)
    return out


def _numbered(sorted_groups: np.ndarray) -> np.ndarray:
    """Distinct numbers for the members of a sorted list: its k-th seven becomes the k-th number for seven."""
    at = np.arange(len(sorted_groups))
    new = np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1]))
    return sorted_groups.astype(np.int64) << 32 | (at - np.maximum.accumulate(np.where(new, at, 0)))


def _enough(num: int, den: int, exact: bool):
    """Keeps pairs whose overlap suffices: of the shingles, or at first of their counts in 2**16 groups, which bound it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=_U if exact else np.uint16) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True) if exact else np.intersect1d(_numbered(x), _numbered(y), assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that are links. Pairs are few beside the sets, so these stay in place and only what pairs need is moved.

    Two bytes a shingle settle nearly all pairs; the shingles of the others follow.
    """
    for column in ("fine", "shingles"):
        found = stage(pairs.distinct(), "pairs")
        small = is_small(found, BROADCAST_IDS)

        def side(own: str, other: str, found=found, small=small, column=column) -> DataFrame:
            given = found.select(F.col(own).alias("sig"), F.col(other).alias("other"))
            out = sets.select("sig", column).join(F.broadcast(given) if small else given, "sig")
            return out.select(F.col("sig").alias(own), F.col("other").alias(other), F.col(column).alias(f"of_{own}"))

        both = side("a", "b").join(side("b", "a"), ["a", "b"])
        pairs = both.select("a", "b", "of_a", "of_b").mapInArrow(given_back(_enough(num, den, column == "shingles")), "a long, b long")
    return pairs


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id): documents linked where den * overlap >= num * union of their shingle sets.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A text of
    fewer than ``width`` words is one shingle.  Null, empty and blank texts have
    no shingle and are linked with nothing: their component is their own id.
    Rows with equal sets fall into one class first, so copies are never paired.
    Repeated ids give one row each; a null id gets a null component and lends
    none.  Of equal sets the least id names the class, so ties don't arise.  A
    text of any length is hashed whole, in one task.  Other columns are ignored.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = stage(rows.mapInArrow(given_back(_sketch(width, num, den)), "id long, n long, sig long, keys array<long>"), "sketch")
    sketch = stage(full.select("id", "n", "sig"), "signatures")
    classes = sketch.where("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.min("n").alias("n"))

    spread = full.where("keys is not null").select(F.explode("keys").alias("key"), "sig").repartition("key").sortWithinPartitions("key", "sig")
    shared = stage(spread.mapInArrow(given_back(_shared_keys), "key long, sig long"), "blocks")
    drop(full)

    # the text of a class is read from its least id; classes are made before the join, so copies don't meet in one task
    involved = shared.select("sig").distinct()
    chosen = stage(classes.where("rep IS NOT NULL").join(involved, "sig", "left_semi").select("sig", F.col("rep").alias("id")), "involved")
    one = rows.join(F.broadcast(chosen) if is_small(chosen, BROADCAST_IDS) else chosen, "id").select("sig", "text")
    sets = stage(one.mapInArrow(given_back(_sets(width)), "sig long, n long, point binary, wide binary, fine binary, shingles binary"), "sets")

    many = shared.groupBy("key").agg(F.count(F.lit(1)).alias("members")).withColumn("pages", F.ceil(F.col("members") / PAGE))
    placed = shared.join(many.select("key", "pages"), "key").withColumn("page", F.pmod(F.xxhash64("sig"), F.col("pages")))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    cells = cells.select("key", (F.least("page", "other") * (1 << 20) + F.greatest("page", "other")).alias("cell"), "sig", "page")
    cells = stage(cells, "cells")
    def pairs(labels: DataFrame | None, partners: str) -> DataFrame:
        """Candidates of the blocks; once there are components, only blocks of more than one are dealt again, and points last."""
        if labels is None:
            b = cells.withColumn("label", F.col("sig"))
        else:
            b = stage(cells.join(labels.select(F.col("v").alias("sig"), F.col("root")), "sig", "left").select("key", "cell", "sig", "page", F.coalesce("root", "sig").alias("label")), "labelled")
            mixed = b.groupBy("key", "cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "cell")
            b = b.join(mixed, ["key", "cell"], "left_semi")
        points = sets.select("sig", "n", F.col("wide" if partners == "all" else "point").alias("point"))
        dealt = b.join(points, "sig").select("key", "cell", "sig", "n", "label", "page", "point").repartition("key", "cell").sortWithinPartitions("key", "cell", "sig")
        return dealt.mapInArrow(given_back(_block_pairs(num, den, partners)), "a long, b long")

    links = stage(_verified(pairs(None, "hub"), sets, num, den), "links")
    labels = components(links)
    spent = [shared, cells, sets, links]
    for partners in ("best", "all"):
        more = stage(_verified(pairs(labels, partners), sets, num, den), "links")
        spent.append(more)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    drop(*spent)

    member = classes.join(labels.select(F.col("v").alias("sig"), "root"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(member.join(least, "root").select("sig", "component_id"), "classes")
    out = sketch.select("id", F.col("n").alias("n_shingles"), F.coalesce("sig", "id").alias("sig")).join(named, "sig", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), own).alias("component_id"))


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of ``docs`` but those linked to a smaller id, columns as they are.

    Rows with a null id stay; rows that repeat an id count as one document and
    stay or go together.
    """
    found = ngram_jaccard_components(docs, id_col, text_col, width, num, den)
    gone = stage(found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct(), "copies")
    return docs.join(F.broadcast(gone) if is_small(gone, BROADCAST_IDS) else gone, id_col, "left_anti").select(*docs.columns)
