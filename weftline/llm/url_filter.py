"""URL rules and a Bloom filter cascade, in DataFrame functions only.

The cascade answers membership in a list of keys exactly for every key of a
known universe: level 1 encodes the listed keys, level 2 the universe's keys
that level 1 takes for listed, level 3 the listed keys that level 2 takes for
those, and so on until a level is never wrong.  The first level that denies a
key decides.  Only listed keys that occur in the corpus are encoded, so sizes
follow the shorter of the two; the levels travel as literals and nothing is
joined, neither to build the cascade nor to ask it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, free_name, stage

#: Listed keys of one cascade, about; its levels then stay below some 8 MB. More keys are dealt to several cascades, asked one after the other.
MOST_LISTED = 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and its subdomains where the url's path starts with ``/path``."""

    allow: bool
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the domains above it: ``a.b.c``, ``b.c``, ``c``; none for an empty host."""
    parts = F.split(host, "[.]")
    n = F.size(parts)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


@dataclass(frozen=True)
class Level:
    bits: bytes
    hashes: int
    seed: int

    def position(self, key: Column, j: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed), j), F.lit(len(self.bits) * 8))

    def admits(self, key: Column) -> Column:
        bits = F.lit(self.bits)  # stands once in the plan, however many hashes there are

        def is_set(j: Column) -> Column:
            p = self.position(key, j)
            byte = F.ascii(F.decode(F.substring(bits, F.shiftright(p, 3).cast("int") + F.lit(1), F.lit(1)), "ISO-8859-1"))
            return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), p.bitwiseAND(F.lit(7)).cast("int") + 1)) != 0

        return F.forall(_numbers(self.hashes), is_set)


def _numbers(n: int) -> Column:
    return F.array(*map(F.lit, range(n)))


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the ``n`` keys (column key) with about this rate of false positives; one job."""
    size = max(8, 8 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 8))
    level = Level(bytes(size // 8), max(1, round(-math.log2(rate))), seed)
    set_bits = keys.select(F.explode(F.transform(_numbers(level.hashes), lambda j: level.position(F.col("key"), j))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    bits = bytearray(-(-size // 64) * 8)
    for word, v in words.collect():  # a row per eight bytes of the level at most
        bits[word * 8 : word * 8 + 8] = v.to_bytes(8, "little", signed=True)
    return Level(bytes(bits[: size // 8]), level.hashes, seed)


def build_cascade(inside: DataFrame, outside: DataFrame, most_levels: int = 64) -> list[Level]:
    """Levels that tell the keys ``inside`` from those ``outside`` (column key, distinct). Driver loop over levels, two jobs each."""
    levels: list[Level] = []
    yes, no, staged = inside, outside, []
    n_yes, n_no = yes.count(), no.count()
    while n_yes and len(levels) < most_levels:
        # the first level lets through about as many as are listed; later ones halve
        rate = min(0.5, max(1e-9, n_yes / max(n_no, 1) * math.sqrt(0.5))) if not levels else 0.5
        level = build_level(yes, n_yes, rate, len(levels) + 1)
        levels.append(level)
        wrong = stage(no.where(level.admits(F.col("key"))), "false-positives")
        staged.append(wrong)
        yes, no, n_no = wrong, yes, n_yes
        n_yes = wrong.count()
    if n_yes:
        raise RuntimeError("the cascade does not end")
    drop(*staged)
    return levels


def split_keys(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """(key, listed) of the universe's distinct keys: one aggregate over both tables."""
    both = universe.select("key", F.lit(True).alias("occurs"), F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(False).alias("occurs"), F.lit(True).alias("listed")))
    return both.where("key is not null").groupBy("key").agg(F.max("occurs").alias("occurs"), F.max("listed").alias("listed")).where("occurs").select("key", "listed")


def contains(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level to deny it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.admits(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _member(levels: list[Level], number: int, cascades: int) -> Callable[[Column], Column]:
    def of(key: Column) -> Column:
        found = contains(levels, key)
        return found if cascades == 1 else (F.pmod(F.xxhash64(F.lit(0), key), F.lit(cascades)) == number) & found

    return of


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (replaced where they exist).

    The longest fitting rule decides; else a host is blocked when it or a domain
    above it is in ``listed`` (column key).  Null urls and such without ``://``
    have empty host and path, fit no rule and are allowed.  Repeated rows and
    urls of any length are judged each; a null listed key lists nothing.
    """
    base = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, allow = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.allow)).otherwise(allow)
    keys = stage(split_keys(listed, base.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))).withColumn("deal", F.xxhash64(F.lit(0), "key")), "keys")
    cascades = -(-keys.where("listed").count() // MOST_LISTED)
    met = free_name(base, "_blocked")
    base = base.withColumn(met, F.lit(False)) if cascades != 1 else base
    blocked = F.lit(False)
    for c in range(cascades):
        own = keys.where(F.pmod("deal", F.lit(cascades)) == c)
        levels = build_cascade(own.where("listed").select("key"), own.where("NOT listed").select("key"))
        blocked = F.exists(suffixes(F.col("host")), _member(levels, c, cascades))
        if cascades > 1:  # one cascade's literals at a time
            base = stage(base.withColumn(met, F.col(met) | blocked), "judged")
    if cascades != 1:
        blocked = F.col(met)
    drop(keys)
    verdict = F.when(F.coalesce(allow, ~blocked), F.lit("allow")).otherwise(F.lit("block"))
    return base.select(*pages.drop("host", "path", "rule", "verdict").columns, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
