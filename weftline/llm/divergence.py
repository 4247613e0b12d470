"""How far the sources of each language part from each other, term by term.

For two groups g, h of V terms the divergence is the sum of f(p_g(t), p_h(t))
over all terms t, most of which neither group has.  It is not added up term by
term.  With supports G, H and z the probability of a term that a group lacks,

    sum = sum over G of f(p_g, z_h)  +  sum over H of f(z_g, p_h)
        + sum over the overlap of G and H of f(p_g, p_h) - f(p_g, z_h) - f(z_g, p_h) + f(z_g, z_h)
        + (V - |G| - |H|) * f(z_g, z_h)

The first two sums only need how many terms of a group have each probability;
the third is a join of postings, and the last is a constant.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Batches, bounded_batches, given_back, stage

SCALE = 1_000_000_000
#: Sources of one term that meet all others of that term in one task.
SIDE = 1000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Bytes of one text that are cut into terms at once.
_SLICE = 1 << 20
#: Entries that a task holds before it hands them on.
_HELD = 300_000


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in slices that end between terms."""
    at = 0
    while len(text) - at > _SLICE:
        rest = _TERM.match(text, at + _SLICE)  # a term that crosses the end belongs to this slice
        end = rest.end() if rest else at + _SLICE
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _term_counts(batches: Batches) -> Batches:
    """(lang, source, term, n, docs) of a task's rows, partial sums; the empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for a in range(0, len(terms), 10_000):
                part = terms[a : a + 10_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array([t.decode() for t in part]), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    entries = 0
    for batch in batches:
        texts, langs, sources = batch.column("text").cast(pa.large_binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for i in range(batch.num_rows):
            n, docs = held.setdefault((langs[i], sources[i]), (Counter({b"": 0}), Counter()))
            before = len(n)
            seen: set[bytes] = set()
            for piece in _pieces(texts[i].as_py().lower()):
                terms = _TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            entries += len(n) - before
            if entries > _HELD:
                yield from out()
                entries = 0
    yield from out()


def _probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); the product leaves 64 bits once counts pass 9e9."""
    exact = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", exact, (total + terms).cast("decimal(20,0)"))


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def postings(docs: DataFrame, min_docs: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged (groups, terms, postings) of ``docs``.

    groups: lang, source, total, terms (of the lang), z (of a term that the group lacks), lang_total.
    terms: lang, term, n, sources.  postings: lang, source, term, n, for kept terms that a group has.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = rows.mapInArrow(given_back(_term_counts), "lang string, source string, term string, n long, docs long")
    # dealt by (lang, term): both the sums of a group and those of a lang find their rows together
    counts = stage(partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term_counts")
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("sources"))
    terms = stage(terms.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    held = stage(counts.join(terms.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "postings")
    by_group = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    by_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    groups = counts.where("term = ''").select("lang", "source").join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["terms", "lang_total", "total", "support"])
    groups = groups.withColumn("z", F.when(F.col("terms") > 0, _probability(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    return stage(groups, "groups"), terms, held


def pair_divergence(groups: DataFrame, terms: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other source of its lang."""
    facts = groups.select("lang", "source", "total", "terms", "z")
    priced = held.join(facts, ["lang", "source"]).withColumn("p", _probability(F.col("n"), F.col("total"), F.col("terms"))).select("lang", "source", "term", "p", "z")
    priced = stage(priced, "priced")

    # one-sided terms: a histogram of each group's probabilities against the distinct z of the lang
    bars = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    zs = groups.where("z is not null").select("lang", F.col("z").alias("q")).distinct()
    sided = stage(bars.join(zs, "lang").groupBy("lang", "source", "q").agg(F.sum(F.expr(f"k * ({_f('p', 'q')})")).alias("as_p"), F.sum(F.expr(f"k * ({_f('q', 'p')})")).alias("as_q")), "one_sided")

    # overlaps: a term of many sources is dealt to several tasks, each with a share of its left sources and all right ones
    wide = terms.where("sources > 1").select("lang", "term", F.ceil(F.col("sources") / SIDE).cast("int").alias("shares"))
    wide = priced.join(wide, ["lang", "term"])
    left = wide.select("lang", "term", F.pmod(F.xxhash64("source"), F.col("shares")).cast("int").alias("share"), F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = wide.select("lang", "term", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    correction = lambda p, q, zp, zq: F.expr(f"({_f(p, q)}) - ({_f(p, zq)}) - ({_f(zp, q)}) + ({_f(zp, zq)})")
    both = left.join(right, ["lang", "term", "share"]).where("a < b")
    both = both.groupBy("lang", "a", "b").agg(F.sum(correction("pa", "pb", "za", "zb")).alias("ab"), F.sum(correction("pb", "pa", "zb", "za")).alias("ba"))
    both = stage(both, "overlaps")
    overlap = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("overlap")).unionByName(
        both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("overlap"))
    )

    one = groups.select("lang", "source", "terms", "support", F.col("z").alias("zp"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("support").alias("support_q"), F.col("z").alias("zq"))
    pairs = one.join(other, "lang").where("source <> item")
    pairs = pairs.join(sided.select("lang", "source", F.col("q").alias("zq"), "as_p"), ["lang", "source", "zq"], "left")
    pairs = pairs.join(sided.select("lang", F.col("source").alias("item"), F.col("q").alias("zp"), "as_q"), ["lang", "item", "zp"], "left")
    pairs = pairs.join(overlap, ["lang", "source", "item"], "left")
    constant = F.when(F.col("terms") > 0, F.expr(f"(terms - support - support_q) * ({_f('zp', 'zq')})")).otherwise(0)
    value = constant + sum((F.coalesce(c, F.lit(0)) for c in ("as_p", "as_q", "overlap")), F.lit(0))
    return pairs.select("lang", "source", "item", value.cast("long").alias("value"))


def term_divergence(groups: DataFrame, terms: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, item, value): what each term that a source has more of than its lang adds to their divergence."""
    facts = groups.select("lang", "source", "total", "terms", "lang_total")
    rows = held.join(facts, ["lang", "source"]).join(terms.select("lang", "term", F.col("n").alias("lang_n")), ["lang", "term"])
    rows = rows.withColumn("p", _probability(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", _probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of each language.

    Terms are runs of letters A-Z (lower-cased), a-z and of all characters from
    U+0080 on; a lang keeps those that ``min_docs`` of its rows hold.  A kept term
    of count n has p = 1 + floor(10**9 * (n + 1) / (total + V)) in a group, and
    f = floor((p - q)**2 / q).  Part ``pair``: the sum of f against each other
    source of the lang.  Part ``term``: f against the lang itself, for terms with
    p > q that the group has, the ``top_terms`` first.  Ranks go by value,
    descending, then by item.

    Null texts, langs and sources count as empty; a group without terms still
    has its pairs, and a lang without kept terms has pairs of value 0.  Repeated
    rows count each.  Texts of any length are cut in slices.  Values never tie
    in rank, as items differ.  Other columns are ignored; an empty table gives
    an empty table.
    """
    groups, terms, held = postings(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    pairs = ranked(pair_divergence(groups, terms, held), "pair")
    tops = ranked(term_divergence(groups, terms, held), "term").where(F.col("rank") <= top_terms)
    return pairs.unionByName(tops)
