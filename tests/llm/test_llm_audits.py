"""Source divergence, embedding near duplicates and filter interactions against brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, part string, rank int, term string"


def divergence_rows():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "abcdefghijé" for b in ("x", "Y", "zz", "日本")] + ["𝒳", "Ünï", "don't"]
    rows = []
    for i in range(160):
        lang, source = rng.choice(("en", "de", None, "")), f"s{min(rng.randrange(9), rng.randrange(9))}"
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 3, 30, 120)))) + rng.choice(("", " 12-34", "\n\t."))
        rows.append((i, text, lang, source, "clash", 1, "clash"))
    rows += [(900, None, "en", "only null", "clash", 1, "clash"), (901, "", "fr", "empty", "clash", 1, "clash"), (902, "rare words", "fr", None, "clash", 1, "clash")]
    rows += [(903, "ax " * 500_000 + "bx", "en", "long", "c", 1, "c"), (904, "y" * 1_300_000, "en", "long", "c", 1, "c")]
    return rows + [rows[5], rows[5]]


def divergence_of(rows, min_docs, top):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(lower))) for r in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in docs:
        df[lang].update(set(w))
        count[lang, source].update(w)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        groups = {g[1]: c for g, c in count.items() if g[0] == lang}
        whole = sum(groups.values(), Counter())

        def rated(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {g: rated(c) for g, c in groups.items()}
        q = rated(whole)
        for g in groups:
            pairs = [(h, sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in groups if h != g]
            terms = [(t, (p[g][t] - q[t]) ** 2 // q[t]) for t in kept if groups[g][t] and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("side", "min_docs", "top"), [(1000, 3, 200), (2, 1, 5)])
def test_source_divergence(spark, monkeypatch, side, min_docs, top):
    from weftline.llm import divergence

    monkeypatch.setattr(divergence, "SIDE", side)
    rows = divergence_rows()
    got = divergence.source_divergence(spark.createDataFrame(rows, DOCS).repartition(5), min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_of(rows, min_docs, top)


def test_source_divergence_of_nothing(spark):
    from weftline.llm.divergence import source_divergence

    assert source_divergence(spark.createDataFrame([], DOCS)).collect() == []
    alone = spark.createDataFrame([(1, "a b", "en", "x", "", 1, ""), (2, None, "en", "y", "", 1, "")], DOCS)
    assert sorted(map(tuple, source_divergence(alone).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    from weftline.llm.divergence import _probability

    n, total, terms = 8 * 10**12 + 7, 9 * 10**15 + 1, 123_457
    got = spark.range(1).select(_probability(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + terms)


def vectors():
    rng = np.random.default_rng(3)
    plain = rng.standard_normal((40, 16))
    near = [c + rng.standard_normal(16) * s for c in plain[:6] for s in (0.02, 0.05, 0.1, 0.1)]
    tight = [plain[7] + rng.standard_normal(16) * 0.01 for _ in range(70)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*plain, *near, *tight])]
    rows += [(1000 + i, rows[3][1]) for i in range(5)] + [(3, rows[9][1]), (None, rows[8][1]), (None, [0.5] * 16)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [None]), (2004, [1.0] * 15 + [float("nan")]), (2005, [float("inf")] + [0.0] * 15), (2006, rows[2][1][:8])]
    rows += [(2007, [x * 1e30 for x in rows[4][1]]), (2008, [x * 1e-30 for x in rows[4][1]]), (2009, [-0.0] + rows[4][1][1:]), (2010, [0.0] + rows[4][1][1:]), (2011, [-x for x in rows[4][1]])]
    return rows


def links_of(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, root = Counter(), list(range(len(rows)))
    for i, (_, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if not (ok[i] and ok[j]) or len(v) != len(w):
                continue
            a, b = np.asarray(v, dtype=np.float64), np.asarray(w, dtype=np.float64)
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b >= cosine * np.sqrt((a @ a) * (b @ b)):
                links[i] += 1
                links[j] += 1
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = defaultdict(list)
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r].append(rows[i][0])
    out = []
    for i, r in enumerate(root):
        c = None if rows[i][0] is None else min(least[r])
        out.append((rows[i][0], links[i], c, rows[i][0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("kind", "page"), [("double", 8192), ("float", 16)])
def test_near_vectors(spark, monkeypatch, kind, page):
    from weftline.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "PAGE", page)
    rows = vectors()
    if kind == "float":
        rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    given = spark.createDataFrame([(i, v, b"x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, sig binary, root int").repartition(3)
    got = embedding_dedup.near_vectors(given, cosine=0.9)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == links_of(rows, 0.9)


def test_near_vectors_of_nothing(spark):
    from weftline.llm.embedding_dedup import near_vectors

    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    zero = spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(zero).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold, the hardest ones, share a bucket about as often as promised; unrelated ones seldom do."""
    from weftline.llm.embedding_dedup import RECALL, STRANGERS, Tables, table_shape, unit

    for n in (10_000, 1_000_000):
        bits, tables = table_shape(n, 0.9)
        rng = np.random.default_rng(n)
        a = unit(rng.standard_normal((3000, 64)))
        side = rng.standard_normal((3000, 64))
        side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
        b = 0.9 * a + np.sqrt(1 - 0.81) * side
        hashes = Tables(64, bits, tables)
        x, y = hashes.keys(a), hashes.keys(b)
        assert (x == y).any(axis=1).mean() >= RECALL - 0.01
        assert (x == np.roll(x, 1, axis=0)).mean() * n <= 2 * STRANGERS
        assert (hashes.keys(a[5:9], 3) == x[5:9, :3]).all()


def filter_rows():
    rng = random.Random(13)
    texts = [None, "", " ", "# x", "ABC def", "ABC def", "a\xa0b", "É" * 9 + "A", "é" * 9 + "A", "word " * 150]
    for _ in range(120):
        words = [f"w{rng.randrange(rng.choice((20, 9999)))}" for _ in range(rng.choice((5, 99, 100, 140)))]
        texts.append(rng.choice((" ", "\n", "\x0b")).join(words) + rng.choice(("", "", " &", " LOUD" * 30)))
    texts += [rng.choice(texts) for _ in range(60)] + ["x y " * 300_000]
    rows = [(i, t, rng.choice(("en", "de", "", None)), "src", "clash", 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (21, "other text, same id", "en", "src", "c", 1, "c"), (None, texts[12], "de", "src", "c", 1, "c"), (None, texts[12], "de", "src", "c", 1, "c")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150)] + [(4, 1, 1), (5, 0, 1), (99999, 1, 1), (None, 1, 1)]
    return rows, labels


def interactions_of(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r[0] is not None and r[0] > first[t]}
        parts[r[2] or ""].append(({k for k, v in fails.items() if v}, r[0] in good, r[0] in toxic))
    out = []
    for part, docs in parts.items():
        told = []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing, lone = sum(f in d[0] for d in docs), sum(d[0] == {f} for d in docs)
                told.append((part, "".join(order), step, len(left), len(here), failing - len(here), lone, sum(d[1] for d in here), sum(d[2] for d in here)))
        total = Counter()
        for t in told:
            total[t[1][t[2] - 1]] += t[4]
        out += [(*t, total[t[1][t[2] - 1]]) for t in told]
    return sorted(out)


def test_filter_interactions(spark):
    from weftline.llm.filter_audit import filter_interactions

    rows, labels = filter_rows()
    got = filter_interactions(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == interactions_of(rows, labels)


def test_filter_interactions_of_nothing(spark):
    from weftline.llm.filter_audit import filter_interactions

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_interactions(spark.createDataFrame([], DOCS), labels).collect() == []
    one = filter_interactions(spark.createDataFrame([(1, None, None, None, "", 1, "")], DOCS), labels).where("filter_order = 'ABCDE'").collect()
    assert [(r.part, r.step, r.kept, r.removed, r.unique_fails, r.shapley) for r in sorted(one, key=lambda r: r.step)] == [("", 1, 0, 1, 1, 120)] + [("", i, 0, 0, 0, 0) for i in range(2, 6)]
