"""Content-addressed store of token ids.

A rolling hash over the last ids cuts each document's id stream into chunks
where the content says so, so equal passages give equal chunks wherever they
stand.  Unique chunks are stored once under the SHA-256 of their bytes; a
document is a recipe, the list of its chunk digests, with a Merkle root over
them.  Reading verifies every chunk against its digest and every recipe
against its root.

Layout under one folder: ``chunks`` (digest, n, data: little-endian ids of the
manifest's width), ``recipes`` (part, id, n_tokens, root, digests, sizes) in
ascending id order, ``manifest`` (part, first_id, last_id, n_docs, n_tokens,
width, root).
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .kernels import _BASE, mix64, runs_of_texts
from .store import bounded_batches, drop, fresh_path, given_back, stage

WINDOW = 16
#: A chunk ends where so many low bits of the rolling hash are zero, and after so many ids at most.
CUT_BITS = 9
LONGEST = 8192
_U = np.uint64
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
#: On these characters the plain expression splits as the library does.
_PLAIN = re.compile(f"[^\\t\\n\\r -~{_LETTER}¡¿«»–—‘’“”…€]")
#: White space in runs, or other than blank and line end.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: Recipes in one part of the store, about.
PART_ROWS = 50_000
#: Characters of plain texts whose distinct parts are encoded together.
ENCODED_BYTES = 4 << 20


_encoders: dict[str, Encoder] = {}
#: Ends a part where many are encoded in one go; no plain text has it.
_END = "\0"


def byte_ranks(vocabulary: dict[str, int], merges: list) -> dict[bytes, int] | None:
    """The vocabulary by the bytes of its tokens, where a smaller id is an earlier merge; None where it isn't so."""
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    byte = {c: bytes([i]) for i, c in enumerate(byte_characters())}
    merged = set(made)
    return {b"".join(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if i in merged or t in byte}


class Encoder:
    """Ids as the tokenizers library gives them.

    Plain texts are split as the library splits, and their pieces merged by
    tiktoken with the ranks of the same file; others go to the library whole.
    Where single blanks or line ends stand between the words, no piece reaches
    over one, so each distinct part of a batch is encoded once.
    """

    def __init__(self, description: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(description)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        model = self.library.to_str()
        ranks = None
        if '"type":"ByteLevel","add_prefix_space":false' in model and '"normalizer":null' in model:
            parsed = json.loads(description)["model"]
            ranks = byte_ranks(parsed["vocab"], parsed["merges"])
        self.plain = ranks is not None
        if self.plain:
            split = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}\\x00]+"
            self.whole = tiktoken.Encoding("whole", pat_str=split + "|\\s+(?!\\S)|\\s+", mergeable_ranks=ranks, special_tokens={})
            self.parts = tiktoken.Encoding("parts", pat_str=split + "|\\x00|\\s+", mergeable_ranks=ranks, special_tokens={})
            self.end = ranks[_END.encode()]

    @classmethod
    def kept(cls, description: str) -> Encoder:
        """One encoder a worker process."""
        if description not in _encoders:
            _encoders.clear()
            _encoders[description] = cls(description)
        return _encoders[description]

    def _kind(self, text: str) -> int:
        """2 where single blanks or line ends stand between words, 1 for other plain texts, else 0."""
        if not self.plain or _PLAIN.search(text) is not None or any(s in text for s in self.special):
            return 0
        return 1 if text[:1].isspace() or text[-1:].isspace() or any(r in text for r in _RUNS) else 2

    def _all_spaced(self, texts: pa.Array) -> bool:
        """Whether every text is of kind 2 or empty; may say no where two texts together look otherwise."""
        data = texts.buffers()[2]
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if data is None or at[0] == at[-1]:
            return True
        raw = np.frombuffer(data, np.uint8)
        first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
        return not np.isin(raw[np.concatenate((first, last))], (9, 10, 13, 32)).any() and self._kind(raw[at[0] : at[-1]].tobytes().decode()) == 2

    def _spaced(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts of kind 2; a part is a word with the blank or line end before it."""
        marked = pc.replace_substring(pc.replace_substring(texts, " ", _END + " "), "\n", _END + "\n")
        parts = pc.split_pattern(marked, _END)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), _END)[0].as_py() + _END
        ids = np.array(self.parts.encode_ordinary(joined), dtype=self.dtype)
        starts = np.concatenate(([0], np.flatnonzero(ids == self.end) + 1)).astype(np.int32)
        taken = pa.ListArray.from_arrays(pa.array(starts), pa.array(ids)).take(coded.indices)
        flat = taken.flatten().to_numpy()
        bounds = parts.offsets.to_numpy()
        bounds = taken.offsets.to_numpy()[bounds].astype(np.int64) - bounds  # without the mark that ends each part
        flat = flat[flat != self.end]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null has none."""
        texts = texts.cast(pa.string()).fill_null("")
        out: list[np.ndarray] = []
        for a, b in runs_of_texts(pc.binary_length(texts).to_pylist(), ENCODED_BYTES):
            some = texts.slice(a, b - a)
            if self.plain and self._all_spaced(some):
                out += self._spaced(some)
                continue
            given = some.to_pylist()
            kinds = [self._kind(t) if t else 2 for t in given]
            spaced = iter(self._spaced(pa.array([t for t, kind in zip(given, kinds, strict=True) if kind == 2], pa.string())) if 2 in kinds and self.plain else ())
            for t, kind in zip(given, kinds, strict=True):
                if kind == 2 and self.plain:
                    out.append(next(spaced))
                else:
                    out.append(np.array(self.whole.encode_ordinary(t) if kind == 1 else self.library.encode(t, add_special_tokens=False).ids, dtype=self.dtype))
        return out


_hashed: list[np.ndarray] = [np.empty(0, np.uint32)]


def _hashes(n: int) -> np.ndarray:
    """A random 32-bit value for each id below n."""
    if len(_hashed[0]) < n:
        _hashed[0] = (mix64(np.arange(1, max(n, 1 << 16) + 1, dtype=_U)) >> _U(32)).astype(np.uint32)
    return _hashed[0]


def cut_points(streams: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each id stream, the first after ``WINDOW`` ids at least; they depend on the ``WINDOW`` ids before them only."""
    lengths = np.fromiter(map(len, streams), dtype=np.int64, count=len(streams))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    ids = np.concatenate(streams) if streams else np.empty(0, np.uint16)
    rolling, width = _hashes(int(ids.max(initial=0)) + 1)[ids], 1
    while width < WINDOW:  # the hash of a run, from those of its halves
        rolling, width = rolling[width:] + rolling[:-width] * np.uint32(pow(_BASE, width, 1 << 32)), width * 2
    marks = np.flatnonzero(rolling < np.uint32(1 << (32 - CUT_BITS))) + WINDOW
    low = np.searchsorted(marks, bounds[:-1] + WINDOW)
    high = np.searchsorted(marks, bounds[1:], side="right")
    out = []
    for i in range(len(streams)):
        base, end = int(bounds[i]), int(lengths[i])
        ends = (marks[low[i] : high[i]] - base).tolist()
        if end and (not ends or ends[-1] != end):
            ends.append(end)
        if end > LONGEST:
            ends = [e for start, stop in zip([0, *ends], ends, strict=False) for e in (*range(start + LONGEST, stop, LONGEST), stop)]
        out.append(ends)
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary hash tree over the digests; an odd node goes up as it is."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bits reflected."""
    out, b = np.zeros(len(a), dtype=np.uint32), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def crc_followed_by(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What a piece with this CRC-32 adds (by xor) to that of a whole in which so many bytes follow it."""
    out, power = crc.astype(np.uint32), np.full(1, 1 << 23, dtype=np.uint32)  # x**8
    left = zeros.astype(np.int64).copy()
    while (left > 0).any():
        odd = (left & 1).astype(bool)
        out[odd] = _times(out[odd], np.repeat(power, odd.sum()))
        power, left = _times(power, power), left >> 1
    return out


def write_store(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the store.

    The encoded stream is staged once; chunks are shuffled by digest and made
    unique with a combine on the map side, recipes are dealt by ranges of the id.
    Repeated ids keep a recipe each, ordered by id and root; null ids come
    first.  A text of any length is encoded whole and cut into chunks of
    ``LONGEST`` ids at most.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 4000)
    with open(vocabulary, encoding="utf-8") as f:
        description = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.kept(description.value)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        width, met = encode.dtype.itemsize, set()
        for batch in batches:
            digests, sizes, data, roots, totals = [], [], [], [], []
            raws = [ids.tobytes() + end for ids in encode.batch(batch.column(1))]
            cuts = [c for a, b in runs_of_texts([len(r) for r in raws]) for c in cut_points([np.frombuffer(r, dtype=encode.dtype) for r in raws[a:b]])]
            for raw, ends in zip(raws, cuts, strict=True):
                parts = [raw[a * width : b * width] for a, b in zip([0, *ends], ends, strict=False)]
                own = [hashlib.sha256(p).digest() for p in parts]
                digests.append(own)
                sizes.append([len(p) // width for p in parts])
                data.append([None if d in met else p for d, p in zip(own, parts, strict=True)])
                if len(met) < 1 << 18:  # spares copies within a task; the rest falls together by digest
                    met.update(own)
                roots.append(merkle_root(own))
                totals.append(len(raw) // width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(roots, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(data, pa.list_(pa.binary()))],
                names=["id", "n_tokens", "root", "digests", "sizes", "data"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    encoded = stage(rows.mapInArrow(given_back(run), "id long, n_tokens long, root binary, digests array<binary>, sizes array<int>, data array<binary>"), "encoded")

    each = encoded.select(F.explode(F.arrays_zip("digests", "sizes", "data")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.sizes").alias("n"), F.col("c.data").alias("data"))
    chunks = each.where("data is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")

    parts = max(1, -(-encoded.count() // PART_ROWS))
    ordered = encoded.select("id", "n_tokens", "root", "digests", "sizes").repartitionByRange(parts, F.col("id"), F.col("root")).sortWithinPartitions("id", "root")
    ordered.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    width = 2 if Encoder.kept(description.value).dtype.itemsize == 2 else 4
    _parts(spark.read.parquet(f"{path}/recipes")).withColumn("width", F.lit(width)).write.parquet(f"{path}/manifest")
    drop(encoded)


def _parts(recipes: DataFrame) -> DataFrame:
    """What the manifest says of each part; its root is over the roots of the part's recipes in order."""
    listed = F.array_sort(F.collect_list(F.struct("id", "root")))["root"]
    return recipes.groupBy("part").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(F.transform(listed, F.hex), ""), 256).alias("root"))


def verified_manifest(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, int]]]:
    """Width of the ids, and (part, n_tokens) in order: a row for ``PART_ROWS`` recipes. Raises where a part's recipes are not those of the manifest."""
    columns = ("part", "first_id", "last_id", "n_docs", "n_tokens", "root")
    given = spark.read.parquet(f"{path}/manifest")
    told = sorted(map(tuple, given.select(*columns, "width").collect()))
    found = sorted(map(tuple, _parts(spark.read.parquet(f"{path}/recipes")).select(*columns).collect()))
    if [t[:-1] for t in told] != found:
        raise ValueError("the recipes do not match the manifest")
    return max((t[-1] for t in told), default=2), [(t[0], t[4]) for t in told]


def read_ids(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, n_tokens, ids) rebuilt from verified recipes and chunks; ``ids`` (a column id) names those to read, else all."""
    width, _ = verified_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    if ids is not None:
        recipes = recipes.join(ids.select("id").distinct(), "id", "left_semi")
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "data")
    each = recipes.select("id", "root", "n_tokens", F.posexplode("digests").alias("seq", "digest")).distinct().join(chunks, "digest")
    whole = each.groupBy("id", "root", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("seq", "data")))["data"].alias("data"))
    back = recipes.select(F.col("id").alias("i"), F.col("root").alias("r")).join(whole, F.expr("i <=> id AND r = root")).select("id", "n_tokens", "root", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, data in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                pieces = data.as_py()
                if merkle_root([hashlib.sha256(x).digest() for x in pieces]) != root:
                    raise ValueError("chunks do not match the root of their recipe")
                out.append(np.frombuffer(b"".join(pieces), dtype=f"<u{width}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["id", "n_tokens", "ids"])

    return back.mapInArrow(given_back(run), "id long, n_tokens long, ids array<long>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every recipe, from the files.

    The CRC-32 of a document, over its ids as little-endian unsigned 32-bit
    integers, is put together from those of its chunks, so no chunk is moved:
    each is read, verified and summed up once, however many recipes name it.
    """
    width, totals = verified_manifest(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for digest, data in zip(batch.column(0), batch.column(1), strict=True):
                raw = data.as_py()
                if hashlib.sha256(raw).digest() != digest.as_py():
                    raise ValueError("a chunk does not match its digest")
                crc.append(zlib.crc32(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], names=["digest", "crc"])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, after = batch.column(2).to_numpy().astype(np.uint32), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc_followed_by(crc, after).astype(np.int64))], names=["root", "crc"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per chunk of each recipe, with the bytes that follow it."""
        for batch in batches:
            roots, digests, after = [], [], []
            for root, own, sizes in zip(*batch.columns, strict=True):
                root, own = root.as_py(), own.as_py()
                if merkle_root(own) != root:
                    raise ValueError("a recipe does not match its root")
                n = np.array(sizes.as_py(), dtype=np.int64)
                roots += [root] * len(own)
                digests += own
                after.append((n.sum() - np.cumsum(n)) * 4)
            flat = np.concatenate(after) if after else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(digests, pa.binary()), pa.array(flat)], names=["root", "digest", "after"])

    recipes = spark.read.parquet(f"{path}/recipes")
    crc = spark.read.parquet(f"{path}/chunks").select("digest", "data").mapInArrow(given_back(sums), "digest binary, crc long")
    kinds = recipes.select("root", "digests", "sizes").groupBy("root").agg(F.first("digests").alias("digests"), F.first("sizes").alias("sizes"))
    each = kinds.mapInArrow(given_back(verified), "root binary, digest binary, after long")
    whole = each.join(crc, "digest").select("root", "after", "crc").mapInArrow(given_back(shifted), "root binary, crc long").groupBy("root").agg(F.bit_xor("crc").alias("ids_crc32"))
    whole = stage(whole, "checksums")  # written, so that the join below may split a root that many share

    before, offset = [], 0
    for part, n in totals:
        before.append((part, offset))
        offset += n
    base = spark.createDataFrame(before, "part int, base long")
    w = Window.partitionBy("part").orderBy("id", "root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = recipes.select("part", "id", "root", "n_tokens").withColumn("upto", F.sum("n_tokens").over(w)).join(F.broadcast(base) if len(before) <= 100_000 else base, "part")
    return placed.join(whole, "root").select("id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_store_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write a store to the shared folder and read the checksums back."""
    path = fresh_path(docs.sparkSession, "token-store")
    write_store(docs, vocabulary, path, id_col, text_col, end_id)
    out = read_checksums(docs.sparkSession, path)
    return out.withColumnRenamed("id", id_col)
