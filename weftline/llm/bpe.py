"""BPE encoding and decoding with a contiguous rank array per word.

A word is a list of parts and, beside it, the rank of each adjacent pair.  The
least rank is found by a scan, its boundary deleted and the two neighbouring
ranks looked up anew.  Words are short, so the scan beats a queue; a word of
more than ``LONG`` parts, where scanning turns quadratic, takes a heap.  Both
merge the leftmost of equal ranks first and give the same parts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, given_back

LONG = 256
#: Distinct words in each of the two generations that a worker remembers.
REMEMBERED = 150_000
_NONE = 1 << 60

#: Characters for which plain regular expressions and str.lower() agree with the library.
PLAIN = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ÿŒœ«»¡¿–—‘’“”…€]")
_LETTER = "a-zà-öø-ÿœß"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


_kept: dict[str, Bpe] = {}


class Bpe:
    """Encoder and decoder of a tokenizer file whose model is BPE over byte characters with a word end."""

    def __init__(self, description: str):
        from tokenizers import Tokenizer

        parsed = json.loads(description)
        self.model = parsed["model"]
        if self.model["type"] != "BPE" or parsed["decoder"] is not None or self.model.get("unk_token"):
            raise ValueError("only BPE files without decoder and unknown token are read")
        self.vocab = dict(self.model["vocab"])
        self.end = self.model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.added_at = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in self.model["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.bytes = dict(enumerate(byte_characters()))
        # normaliser and splitter of the library, for texts beyond PLAIN; merges are ours
        rest = Tokenizer.from_str(description)
        self.normalize, self.split = rest.normalizer.normalize_str, rest.pre_tokenizer.pre_tokenize_str

    @classmethod
    def kept(cls, description: str) -> Bpe:
        """One a worker process, so that the file is not read for each task."""
        if description not in _kept:
            _kept.clear()
            _kept[description] = cls(description)
        return _kept[description]

    def merge(self, characters: str) -> list[int]:
        """Ids of one word, given as byte characters."""
        vocab = self.vocab
        parts = [vocab.get(c) for c in characters[:-1]] + [vocab.get(characters[-1] + self.end)]
        parts = [p for p in parts if p is not None]
        return self._queue(parts) if len(parts) > LONG else self._scan(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        pairs = self.pairs
        none = (_NONE, -1)
        ranks = [pairs.get(p, none)[0] for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), none)[0]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), none)[0]
        return parts

    def _queue(self, parts: list[int]) -> list[int]:
        pairs, n = self.pairs, len(parts)
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = pairs[a, b][1], False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (p := (parts[x], parts[y])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], x, *p))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Words in order, as (string, whether it stands for byte characters); added tokens come as themselves."""
        at = 0
        for m in self.added_at.finditer(text) if self.added_at and "<" in text else ():
            yield from self._words(text[at : m.start()])
            yield m[0], True
            at = m.end()
        yield from self._words(text[at:] if at else text)

    def _words(self, text: str) -> Iterator[tuple[str, bool]]:
        if PLAIN.search(text) is None:
            for w in _SPLIT.findall(text.lower()):
                yield w, False
        else:
            for w, _ in self.split(self.normalize(text)):
                yield w, True

    def ids(self, piece: str, mapped: bool) -> list[int]:
        if mapped and piece in self.added:
            return [self.added[piece]]
        return self.merge(piece if mapped else "".join(map(self.bytes.__getitem__, piece.encode())))

    def encode(self, text: str | None) -> list[int]:
        return [i for piece, mapped in self.pieces(text or "") for i in self.ids(piece, mapped)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as a file without decoder asks; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


class Generations(dict):
    """A bounded memo: words not asked for since the last change of generation are forgotten."""

    def __init__(self, make, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, word):
        out = self.older.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= LONG:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class _Words(Generations):
    """(ids as text, tokens as text, number of ids) of each plain word."""

    def __init__(self, bpe: Bpe):
        super().__init__(lambda word: self.of(bpe.ids(word, False)))
        self.bpe = bpe

    def of(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), self.bpe.decode(ids), len(ids)


def digest(bpe: Bpe, words: _Words, text: str | None) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids in decimal and of the decoded text."""
    text = text or ""
    if PLAIN.search(text) is None and not ("<" in text and bpe.added_at and bpe.added_at.search(text)):
        got = list(map(words.__getitem__, _SPLIT.findall(text.lower())))
    else:
        got = [words.of(bpe.ids(p, True)) if mapped else words[p] for p, mapped in bpe.pieces(text)]
    got = [g for g in got if g[2]]
    ids, tokens = " ".join([g[0] for g in got]), " ".join([g[1] for g in got])
    return sum([g[2] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text; a map without shuffle.

    ``vocabulary`` is the path of a tokenizer file, read on the driver and sent
    out once (its size is that of the file, under 2 MB for the public ones).
    Null counts as empty: no ids, and the digests of the empty string.  Repeated
    and null ids keep a row each; other columns are ignored.  A text of any
    length is encoded whole, a word of any length with the queue beyond ``LONG``
    parts.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        description = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.kept(description.value)
        words = _Words(bpe)
        for batch in batches:
            rows = [digest(bpe, words, t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(given_back(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", digest_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text in ``ids_col`` (replaced where it exists); null gives no ids.

    With ``digest_col`` the ids are decoded in the same pass, and that column
    gets the SHA-256 of the decoded text, as ``bpe_decode`` gives it.
    """
    bounded_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        description = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.drop(ids_col, *([digest_col] if digest_col else []))
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.kept(description.value)
        packed = lambda piece, mapped: array("i", bpe.ids(piece, mapped)).tobytes()
        words = Generations(lambda word: packed(word, False), REMEMBERED // 2)

        for batch in batches:
            texts = [b"".join([packed(piece, True) if mapped else words[piece] for piece, mapped in bpe.pieces(text.as_py() or "")]) for text in batch.column(at)]
            ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))) // 4
            flat = np.frombuffer(b"".join(texts), dtype=np.int32)
            columns, names = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [*batch.schema.names, ids_col]
            if digest_col:
                columns.append(pa.array([hashlib.sha256(bpe.decode(flat[a:b].tolist()).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                names.append(digest_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    schema = StructType([*base.schema.fields]).add(ids_col, ArrayType(IntegerType(), False))
    return base.mapInArrow(given_back(run), schema.add(digest_col, StringType()) if digest_col else schema)


def bpe_decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", digest_col: str = "decoded_sha256") -> DataFrame:
    """``docs`` with the SHA-256 of the text that ``ids_col`` decodes to, as in ``bpe_round_trip``; null ids decode to no text."""
    bounded_batches(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        description = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.drop(digest_col)
    at = base.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.kept(description.value)
        for batch in batches:
            digests = [hashlib.sha256(bpe.decode(ids.as_py() or []).encode()).hexdigest() for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, digest_col])

    from pyspark.sql.types import StringType, StructType

    return base.mapInArrow(given_back(run), StructType([*base.schema.fields]).add(digest_col, StringType()))
