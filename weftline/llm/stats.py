"""Statistics of whole texts, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _BASE, _BYTE, _INVERSE, _SPACE, mix64, powers, runs_of_texts, spaced_words
from .store import bounded_batches, given_back

_U = np.uint64

#: Whole-number statistics.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_ends", "n_exclaims", "n_letters", "n_wide", "n_distinct", "n_one_char", "longest_word", "n_bytes")
#: Ratios that rules and trees look at besides.
RATIOS = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "end_ratio", "exclaim_ratio", "letter_ratio", "wide_ratio", "distinct_ratio", "one_char_ratio", "line_words", "space_ratio")


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOLS = _members("#*$%&|<>")
_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _members("abcdefghijklmnopqrstuvwxyz")
_DIGITS = _members("0123456789")
_ENDS = _members(".?!;:,")
_EXCLAIM = _members("!")
_LEAD = np.arange(256) & 0xC0 != 0x80
_WIDE = np.arange(256) >= 0xC0


def _sums(of: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(of) + 1, dtype=np.int64)
    np.cumsum(of, out=total[1:])
    return np.diff(total[bounds])


def _within(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it is an equal of an earlier one of its owner, and whether it has any equal there."""
    salted = mix64(keys ^ mix64(owner.astype(_U) + _U(0x51ED27)))
    order = np.argsort(salted, kind="stable")
    same = salted[order][1:] == salted[order][:-1]
    later, any_ = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def statistics(texts: Sequence[bytes], width: int = 5) -> dict[str, np.ndarray]:
    """COUNTS of each text.

    Words are ``[^\\x20\\x09-\\x0D]+``; word_chars counts code points in them;
    n_dup_lines are lines with a word equal to an earlier one; n_repeat_words
    are words in ``width``-word windows that the text holds twice or more.
    """
    parts = []
    for a, b in runs_of_texts([len(t) for t in texts]):
        own = texts[a:b]
        data, starts, ends, words, first = spaced_words(own)
        n = b - a
        lengths = np.fromiter(map(len, own), dtype=np.int64, count=n)
        bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = ~_SPACE[data]
        out = {"n_words": np.diff(first), "n_bytes": lengths, "word_chars": _sums(_LEAD[data] & inside, bounds)}
        for name, table in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_digits", _DIGITS), ("n_ends", _ENDS), ("n_exclaims", _EXCLAIM), ("n_letters", _UPPER | _LOWER), ("n_wide", _WIDE)):
            out[name] = _sums(table[data], bounds)
        owner = np.repeat(np.arange(n), out["n_words"])
        later, _ = _within(words, owner)
        word_bounds = first
        out["n_distinct"] = out["n_words"] - _sums(later, word_bounds)
        size = ends - starts
        out["n_one_char"] = _sums(size == 1, word_bounds)
        out["longest_word"] = np.zeros(n, dtype=np.int64)
        held = out["n_words"] > 0
        if held.any():
            out["longest_word"][held] = np.maximum.reduceat(size, first[:-1][held])
        # windows of words
        m = len(words) - width + 1
        repeat = np.zeros(len(words) + 1, dtype=np.int64)
        if m > 0:
            whole = owner[:m] == owner[width - 1 :]
            at = np.flatnonzero(whole)
            grams = np.zeros(m, dtype=_U)
            for k in range(width):
                grams = grams * _U(_BASE) + words[k : k + m]
            _, twice = _within(grams[at], owner[at])
            np.add.at(repeat, at[twice], 1)
            np.add.at(repeat, at[twice] + width, -1)
        out["n_repeat_words"] = _sums(np.cumsum(repeat[:-1]) > 0, word_bounds)
        # lines
        line_end = np.flatnonzero(data == 0x0A)
        line_start = np.concatenate(([0], line_end[:-1] + 1))
        total = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=_U, out=total[1:])
        value = mix64(((total[line_end] - total[line_start]) * powers(_INVERSE, len(data))[line_start]) ^ (line_end - line_start).astype(_U))
        filled = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(inside, out=filled[1:])
        worded = filled[line_end] > filled[line_start]
        of_line = np.searchsorted(bounds, line_start, side="right") - 1
        out["n_lines"] = np.bincount(of_line[worded], minlength=n)
        later, _ = _within(value[worded], of_line[worded])
        out["n_dup_lines"] = np.bincount(of_line[worded][later], minlength=n)
        parts.append(out)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in COUNTS}


def with_ratios(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words, chars, lines = (np.maximum(c[k], 1).astype(np.float64) for k in ("n_words", "word_chars", "n_lines"))
    return c | {
        "mean_word": c["word_chars"] / words, "symbol_ratio": c["n_symbols"] / words, "dup_line_ratio": c["n_dup_lines"] / lines, "repeat_ratio": c["n_repeat_words"] / words,
        "upper_ratio": c["n_upper"] / chars, "digit_ratio": c["n_digits"] / chars, "end_ratio": c["n_ends"] / words, "exclaim_ratio": c["n_exclaims"] / words,
        "letter_ratio": c["n_letters"] / chars, "wide_ratio": c["n_wide"] / chars, "distinct_ratio": c["n_distinct"] / words, "one_char_ratio": c["n_one_char"] / words,
        "line_words": c["n_words"] / lines, "space_ratio": (c["n_bytes"] - c["word_chars"]) / np.maximum(c["n_bytes"], 1),
    }


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS as long, RATIOS as double) of every whole text, null counting as empty; a map without shuffle."""
    bounded_batches(docs.sparkSession)
    names = [*COUNTS, *RATIOS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = with_ratios(statistics([t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]))
            columns = [pa.array(found[k].astype(np.int64 if k in COUNTS else np.float64)) for k in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{k} long" for k in COUNTS), *(f"{k} double" for k in RATIOS)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(given_back(run), schema)
