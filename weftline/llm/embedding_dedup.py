"""Near duplicates among vectors: p-stable hashing for candidates, exact cosines for links.

Vectors are scaled to length 1, so a cosine is a Euclidean distance.  A table
hashes a vector to the floors of ``bits`` Gaussian projections, shifted and
divided by ``WIDTH``; vectors that share all of them share a bucket.  Projections
run on integers, so that every machine finds the same floors.

Equal vectors are one class before hashing.  A bucket is compared within a task
by matrix products, page by page when it is large; a pair counts in the first
table that its ends share, so sums over all tables count no pair twice, and the
rows that leave a task follow its members, not its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import mix64
from .store import Batches, bounded_batches, drop, given_back, is_small, stage

#: Width of a quantised step; near the least exponent of this hash for cosines from 0.8 to 0.95.
WIDTH = 2.5
#: Least expected share of pairs at exactly the threshold that some bucket holds; closer pairs are likelier.
RECALL = 0.99
#: Unrelated vectors that a bucket holds on the average.
STRANGERS = 32
#: Members of a bucket that one task compares with as many others at once.
PAGE = 8192
#: Rows of a matrix product.
_STRIP = 256
#: Keys of large buckets that may be broadcast.
_BROADCAST_KEYS = 1_000_000
_UNIT, _GAUSS = 1 << 20, 1 << 10  # scales of the integer vectors and projections: products stay below 2**53


def _collision(distance: float) -> float:
    """Chance that one projection puts two vectors of this distance into one step."""
    t = WIDTH / distance
    return 1 - 2 * (0.5 * math.erfc(t / math.sqrt(2))) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_shape(classes: int, cosine: float) -> tuple[int, int]:
    """(bits, tables): bits so that unrelated vectors seldom meet, tables so that pairs at ``cosine`` do."""
    near, far = _collision(math.sqrt(2 - 2 * cosine)), _collision(math.sqrt(2))
    bits = max(6, math.ceil(math.log(max(1.0, classes / STRANGERS)) / -math.log(far)))
    return bits, math.ceil(math.log(1 - RECALL) / math.log1p(-(near**bits)))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Bucket keys of unit vectors; the same on every machine for the same seed."""

    def __init__(self, dims: int, bits: int, tables: int, seed: int = 12):
        rng = np.random.Generator(np.random.PCG64([seed, dims]))
        self.bits, self.tables = bits, tables
        self.axes = np.rint(rng.standard_normal((tables * bits, dims)) * _GAUSS)
        self.shift = np.rint(rng.random(tables * bits) * WIDTH * _UNIT * _GAUSS)
        self.salt = mix64(np.arange(1, bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def keys(self, units: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Keys (rows, tables) of the first ``upto`` tables."""
        n = self.tables if upto is None else upto
        steps = (np.rint(units * _UNIT) @ self.axes[: n * self.bits].T + self.shift[: n * self.bits]) // (WIDTH * _UNIT * _GAUSS)
        steps = mix64(steps.astype(np.int64).view(np.uint64).reshape(len(units), n, self.bits) * self.salt)
        total = steps.sum(axis=2, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        return mix64(total).view(np.int64)


def _classes(batches: Batches) -> Batches:
    """(id, sig, vector, dims): digest and bytes of each usable vector, nulls for the others."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        if isinstance(column, pa.ExtensionArray):
            column = column.storage
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(column.type.value_type.to_pandas_dtype(), copy=False)
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))  # a null component reads as not a number
        some = np.concatenate(([0], np.cumsum(flat != 0)))
        size = np.asarray([0 if not v.is_valid else len(v) for v in column])
        end = np.cumsum(size)
        sig, vector = [], []
        for a, b in zip(end - size, end, strict=True):
            if bad[b] != bad[a] or some[b] == some[a]:
                sig.append(None)
                vector.append(None)
                continue
            held = (flat[a:b] + 0.0).tobytes()  # no negative zeros
            sig.append(hashlib.blake2b(held, digest_size=16).digest())
            vector.append(held)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sig, pa.binary()), pa.array(vector, pa.binary()), pa.array(size, pa.int32())], names=["id", "sig", "vector", "dims"])


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1))


def _hashed(bits: int, tables: int, dtype: str):
    def run(batches: Batches) -> Batches:
        made: dict[int, Tables] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                keys = made.setdefault(int(d), Tables(int(d), bits, tables)).keys(_rows(part.column("vector"), dtype))
                flat = pa.array(keys.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("sig", "vector", "dims", "copies")), lists], names=["sig", "vector", "dims", "copies", "keys"])

    return run


class Links:
    """Partners and connections among the members of one cell."""

    def __init__(self, n: int):
        self.count = np.zeros(n, dtype=np.int64)
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray, copies: np.ndarray) -> None:
        np.add.at(self.count, a, copies[b])
        np.add.at(self.count, b, copies[a])
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (flat := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = flat


def _surely(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """For pairs close to the threshold, sums that don't hang on the shape of a matrix product."""
    return np.asarray([math.fsum(p * q) >= cosine * math.sqrt(math.fsum(p * p) * math.fsum(q * q)) for p, q in zip(x, y, strict=True)], dtype=bool)


def _linked(x: np.ndarray, page: np.ndarray, copies: np.ndarray, table: int, hashes: Tables, cosine: float) -> Links:
    """Links of one cell: pairs of its members, of different pages if it has two, that no earlier table holds."""
    found = Links(len(x))
    across = page[0] != page[-1]
    half = int(np.searchsorted(page, page[-1])) if across else len(x)
    for s in range(0, half, _STRIP):
        stop = min(s + _STRIP, half)
        first = half if across else s
        near = x[s:stop] @ x[first:].T
        a, b = np.nonzero(near >= cosine - 1e-9)
        value = near[a, b]
        a, b = a + s, b + first
        if not across:
            value, a, b = value[b > a], a[b > a], b[b > a]
        if not len(a):
            continue
        who, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        if table:
            earlier = hashes.keys(x[who], table)
            i, j = at[: len(a)], at[len(a) :]
            new = np.ones(len(a), dtype=bool)
            for t in range(table):
                new[new] = earlier[i[new], t] != earlier[j[new], t]
            a, b, value = a[new], b[new], value[new]
        unsure = np.flatnonzero(value < cosine + 1e-9)
        if len(unsure):
            ok = np.ones(len(a), dtype=bool)
            ok[unsure] = _surely(x[a[unsure]], x[b[unsure]], cosine)
            a, b = a[ok], b[ok]
        found.add(a, b, copies)
    return found


def _compared(bits: int, tables: int, dtype: str, cosine: float):
    """(sig, links, root) of members of the cells (key, cell) that a task holds, cells in one piece and pages in order."""

    def run(batches: Batches) -> Batches:
        made: dict[int, Tables] = {}

        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, cell, table, page, dims, copies = (rows.column(c).to_numpy() for c in ("key", "cell", "table", "page", "dims", "copies"))
            sig, vector = rows.column("sig").to_pylist(), rows.column("vector").combine_chunks()
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (dims[1:] != dims[:-1]), [True])))
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                hashes = made.setdefault(int(dims[a]), Tables(int(dims[a]), bits, tables))
                links = _linked(_rows(vector.slice(a, b - a), dtype), page[a:b], copies[a:b], int(table[a]), hashes, cosine)
                for i in np.flatnonzero(links.count).tolist():
                    out[0].append(sig[a + i])
                    out[1].append(int(links.count[i]))
                    out[2].append(sig[a + int(links.root[i])])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["sig", "links", "root"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows < 2 * PAGE:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key, cell, dims = (t.column(c).to_numpy() for c in ("key", "cell", "dims"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (dims[1:] != dims[:-1]))
            if not len(change):
                continue
            done = int(change[-1]) + 1
            yield from emit(t.slice(0, done))
            held = t.slice(done).combine_chunks().to_batches()
            rows = t.num_rows - done
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept): vectors linked where hashing finds a pair and its cosine is at least ``cosine``.

    n_links counts the other rows linked directly, equal vectors among them;
    component_id is the least id reachable by links, the row's own included;
    kept marks the row that names its component.

    Vectors that are null, empty, all zero, or hold a null or a component that is
    not finite, link with nothing; nor do vectors of different lengths.  Repeated
    rows count each.  A null id gets a null component if it has a usable vector
    or not, lends none, and is kept.  Components of any float or double size are
    compared, in double precision.  Other columns are ignored; an empty table
    gives an empty table.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 4000)
    dtype = "<f4" if "array<float>" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if dtype == "<f4" else "array<double>").alias("vector"))
    full = stage(given.mapInArrow(given_back(_classes), "id long, sig binary, vector binary, dims int"), "vectors")
    classes = stage(full.where("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"), F.first("vector").alias("vector"), F.first("dims").alias("dims")), "vector_classes")

    bits, tables = table_shape(classes.count(), cosine)
    hashed = stage(classes.select("sig", "vector", "dims", "copies").mapInArrow(given_back(_hashed(bits, tables, dtype)), "sig binary, vector binary, dims int, copies long, keys array<long>"), "hashed")
    large = hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > PAGE)
    large = stage(large.select("key", F.ceil(F.col("members") / PAGE).alias("pages")), "large_buckets")
    spread = hashed.select("sig", "vector", "dims", "copies", F.posexplode("keys").alias("table", "key"))
    spread = spread.join(F.broadcast(large) if is_small(large, _BROADCAST_KEYS) else large, "key", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))
    cells = spread.withColumn("page", F.pmod(F.xxhash64("sig"), F.col("pages"))).withColumn("other", F.explode(F.expr("sequence(0L, pages - 1)")))
    cells = cells.select("key", (F.least("page", "other") * (1 << 20) + F.greatest("page", "other")).alias("cell"), "table", "page", "dims", "sig", "copies", "vector")
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "dims", "page", "sig")
    found = stage(dealt.mapInArrow(given_back(_compared(bits, tables, dtype, cosine)), "sig binary, links long, root binary"), "vector_links")
    drop(hashed)

    counts = found.groupBy("sig").agg(F.sum("links").alias("links"))
    labels = components(found.where("sig <> root").select(F.col("sig").alias("a"), F.col("root").alias("b")))
    member = classes.select("sig", "copies", "rep").join(counts, "sig", "left").join(labels.select(F.col("v").alias("sig"), "root"), "sig", "left")
    member = stage(member.select("sig", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "sig").alias("root")), "members")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(member.join(least, "root").select("sig", "n_links", "component_id"), "named")
    out = full.select("id", "sig").join(named, "sig", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
