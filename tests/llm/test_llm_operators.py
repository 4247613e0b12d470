"""The dealt operators against brute-force versions, on small tables with odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

DOCS = "doc_id long, text string, kept_sha256 string, id string"


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(9999)}" if rng.random() < share else w for w in text.split(" "))


def corpus():
    rng = random.Random(5)
    base = [words_text(rng, rng.choice((3, 12, 40, 150, 400))) for _ in range(25)]
    texts = base + [edited(rng, rng.choice(base), rng.choice((0.0, 0.01, 0.02, 0.05))) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "one two", "one two", "ONE two", "a b c", base[3] + " " + base[4], "é " * 300]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [(3, base[3], "clash", "again"), (4, base[9], "clash", "same id, other text"), (None, base[5], "clash", "no id")]


def sets_of(text, width):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_ngram_join(spark, width, num, den):
    from weftline.llm import ngram_join

    rows = corpus()
    sets = [sets_of(t, width) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    want = sorted(((r[0], len(s), min(ids[find(i)]) if r[0] is not None else None) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_components(df, width=width, num=num, den=den).collect()), key=str) == want
    assert ngram_join.ngram_jaccard_components(df.limit(0)).count() == 0
    kept = ngram_join.keep_first_of_groups(df, width=width, num=num, den=den)
    assert kept.columns == df.columns
    gone = {r[0] for r in want if r[0] is not None and r[2] < r[0]}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in gone), key=str)


def test_ngram_join_null_id_before_its_copies(spark):
    from weftline.llm import ngram_join

    rng = random.Random(3)
    base = words_text(rng, 200, 9999)
    near = " ".join([*base.split(" ")[:199], "other"])
    df = spark.createDataFrame([(None, base), (7, base), (8, base), (None, near), (9, near)], "doc_id long, text string").coalesce(1)
    got = {r.component_id for r in ngram_join.ngram_jaccard_components(df, width=3, num=90, den=100).collect() if r.doc_id is not None}
    assert got == {7}
    assert sorted((r.doc_id for r in ngram_join.keep_first_of_groups(df).collect()), key=str) == [7, None, None]


def test_ngram_join_pages_of_hot_blocks(spark, monkeypatch):
    from weftline.llm import ngram_join

    rng = random.Random(2)
    base = words_text(rng, 120, 9999).split(" ")
    rows = [(i, " ".join([*base[:119], f"v{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PAGE", 8)
    assert {r.component_id for r in ngram_join.ngram_jaccard_components(df, width=3, num=90, den=100).collect()} == {0}


def test_rtree_search_is_complete(monkeypatch):
    from weftline.llm import ngram_join
    from weftline.llm.ngram_join import DIMENSIONS, RTree

    monkeypatch.setattr(ngram_join, "AT_ONCE", 5000)
    rng = np.random.default_rng(3)
    points = rng.poisson(1.0, (600, DIMENSIONS)).astype(np.uint8)
    points[200:400] = np.maximum(points[:200].astype(int) - (rng.random((200, DIMENSIONS)) < 0.03), 0).astype(np.uint8)
    points[5, 3] = points[205, 3] = 255
    sizes = points.sum(axis=1).astype(np.int64)
    for blocks in (np.zeros(600, np.int64), np.arange(600) % 200, np.tile(rng.integers(0, 40, 200), 3)):
        labels = rng.integers(0, 500, 600)
        want = set()
        for i, j in combinations(range(600), 2):
            both = np.minimum(points[i], points[j])
            total = min(sizes[i], sizes[j]) if (both == 255).any() else min(int(both.sum()), sizes[i], sizes[j])
            if blocks[i] == blocks[j] and labels[i] != labels[j] and 18 * total >= 8 * (sizes[i] + sizes[j]) and sizes[i] * 10 >= 8 * sizes[j] and sizes[j] * 10 >= 8 * sizes[i]:
                want.add((i, j))
        got = [(min(i, j), max(i, j)) for a, b in RTree(points, sizes, blocks, labels).pairs(8, 10) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_candidates_come_out_of_trees(monkeypatch):
    """On real tables: every candidate pair is found by a tree search, and nodes prune."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from weftline.llm import ngram_join
    from weftline.llm.kernels import shingle_sets

    searches = []
    search = ngram_join.RTree.search
    monkeypatch.setattr(ngram_join.RTree, "search", lambda self, own, *a: (searches.append((len(own), len(self.levels))), search(self, own, *a))[1])
    texts = [(t or "").lower().encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    levels, rows = ngram_join.Levels(90, 100), {}
    for s in shingle_sets(texts, 3):
        if len(s):
            rows[ngram_join._signature(s)] = s
    dealt = sorted((int(k), sig) for sig, s in rows.items() for k in levels.keys(s).view(np.int64))
    shared = Counter(k for k, _ in dealt)
    dealt = [(k, sig) for k, sig in dealt if shared[k] > 1]
    columns = {"key": [k for k, _ in dealt], "cell": [0] * len(dealt), "sig": [g for _, g in dealt], "n": [len(rows[g]) for _, g in dealt], "label": [g for _, g in dealt], "page": [0] * len(dealt), "point": [ngram_join._point(rows[g]) for _, g in dealt]}
    out = list(ngram_join._block_pairs(90, 100, "all")(iter(pa.table(columns).to_batches())))
    found = {p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert found and sum(n for n, _ in searches) == len(dealt) and max(depth for _, depth in searches) > 1
    holders, both = defaultdict(list), Counter()
    for g, s in rows.items():
        for x in s.tolist():
            holders[x].append(g)
    for own in holders.values():
        both.update((min(a, b), max(a, b)) for a, b in combinations(own, 2))
    linked = {(a, b) for (a, b), k in both.items() if 100 * k >= 90 * (len(rows[a]) + len(rows[b]) - k)}
    assert linked and linked <= found


def test_components_of_chains_and_stars(spark):
    from weftline.llm.graph import components

    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = defaultdict(set)
    for v, r in got:
        roots[r].add(v)
    assert sorted(map(len, roots.values())) == [30, 61]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark, monkeypatch):
    from weftline.llm import url_filter
    from weftline.llm.queries import BLOCKED, RULES
    from weftline.llm.url_filter import build_cascade, contains, judge_urls

    rng = random.Random(1)
    hosts = [f"h{i}.example.net" for i in range(400)] + BLOCKED
    urls = [f"https://{rng.choice(('', 'www.', 'm.'))}{rng.choice(hosts)}/{rng.choice(('fr', 'de', 'en', 'es'))}/{rng.randrange(99)}{rng.choice(('', '?a=/x', '#t'))}" for _ in range(300)]
    urls += [None, "", "no scheme", "HTTP://Spam-Farm.EXAMPLE.com", "x://", "a://b.org?x/", "a://b.com#/fr/", "a://org/", "a://example.org/en/12", "a://example.org/en/2", "a://spam-farm.example.net.evil/", "a://spam-farm.example.net/" + "é" * 200_000, "a://" + "x." * 500 + "spam-farm.example.net/"]
    urls += urls[:20]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], "clash")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        best = None
        for r in RULES:
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
                best = r
        listed = any(host == k or host.endswith("." + k) for k in BLOCKED)
        return host, path, best and best.text, ("allow" if best.allow else "block") if best else ("block" if listed else "allow")

    listed = spark.createDataFrame([(k,) for k in BLOCKED], "key string")
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judge_urls(df, RULES, listed).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *judge(u)) for i, u, _ in rows), key=str)
    assert judge_urls(df.limit(0), RULES, listed).count() == 0
    assert judge_urls(df, RULES, listed.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0

    # more keys than one cascade takes: several, with the same verdicts
    monkeypatch.setattr(url_filter, "MOST_LISTED", 3)
    again = judge_urls(df, RULES, listed.unionByName(listed).unionByName(spark.createDataFrame([(None,)], "key string")))
    assert again.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, again.drop("url").collect()), key=str) == sorted(map(tuple, got), key=str)

    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    some = keys.where("substring(key, -1) = '7'")
    levels = build_cascade(some, keys.exceptAll(some))
    assert len(levels) > 1
    assert sorted(r.key for r in keys.where(contains(levels, keys["key"])).collect()) == sorted(r.key for r in some.collect())


ODD_TEXTS = ["", None, "<|startoftext|>Hello <|endoftext|> Wor<|endoftext|>ld", "İstanbul ΑΣΣΑΣ ς", "ábc é É", "日本語テスト ١٢٣ ² ½ Ⅳ", "\x1c a\x1fb c\x85d\u00a0e", "'S it's I'LL we'Re", "😀😀 ok 😀", "x" * 3000, "ab" * 400 + "é" * 300, "  \n\t ", "don't<|start", "ﬁ 힣가", "a  b   c\n\n\nd "]


def test_bpe(spark):
    from weftline.llm.bpe import Bpe, bpe_encode, bpe_round_trip

    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = ODD_TEXTS + ["".join(rng.choice("abcdefghie nrst'É\n.,1") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i, t, "c", "c") for i, t in enumerate(texts)] + [(None, "x y", "c", "c"), (0, "again", "c", "c")]
    df = spark.createDataFrame(rows, DOCS)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))))
    assert sorted(map(tuple, bpe_round_trip(df, path).collect()), key=str) == sorted(want, key=str)
    assert bpe_round_trip(df.limit(0), path).count() == 0
    with_ids = bpe_encode(df, path)
    assert with_ids.columns == [*df.columns, "ids"]
    assert all(list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids for r in with_ids.collect())
    bpe = Bpe(open(path, encoding="utf-8").read())
    for word in ("aaaaaaa", "thethethe", "inandthon" * 50):
        parts = [bpe.vocab[c] for c in word[:-1]] + [bpe.vocab[word[-1] + "</w>"]]
        assert bpe._scan(list(parts)) == bpe._queue(list(parts))


def test_token_store(spark, monkeypatch):
    from weftline.llm import token_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(9)
    long = " ".join(f"word{rng.randrange(3000)}" for _ in range(4000))
    texts = [*ODD_TEXTS, "<|endoftext|>", long, long, "prefix " + long]
    rows = [(i, t, "c", "c") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = token_store.token_store_round_trip(spark.createDataFrame(rows, DOCS), path).collect()
    start, want = 0, []
    for i, t, _, _ in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want
    assert token_store.token_store_round_trip(spark.createDataFrame(rows, DOCS).limit(0), path).count() == 0
    store = token_store.fresh_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([*rows, (3, "twice", "c", "c"), (None, "no id", "c", "c")], DOCS), path, store)
    back = token_store.read_ids(spark, store, spark.createDataFrame([(3,), (len(texts) - 1,)], "id long")).collect()
    by_id = dict((r[0], r[1]) for r in rows)
    assert sorted(tuple(r.ids) for r in back) == sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for t in (by_id[3], "twice", texts[-1]))
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    recipes = spark.read.parquet(f"{store}/recipes").collect()
    assert all(token_store.merkle_root([bytes(d) for d in r.digests]) == bytes(r.root) for r in recipes)
    # a store of several parts; a lost recipe is noticed
    monkeypatch.setattr(token_store, "PART_ROWS", 5)
    store = token_store.fresh_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame(rows, DOCS), path, store)
    assert spark.read.parquet(f"{store}/manifest").count() > 1
    assert sorted(map(tuple, token_store.read_checksums(spark, store).collect())) == want
    lost = spark.read.parquet(f"{store}/recipes").where("id <> 4").persist()
    lost.count()
    lost.write.mode("overwrite").parquet(f"{store}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_checksums(spark, store)


def test_encoder_follows_the_library():
    """Texts of all kinds in one batch: runs of blanks, odd letters, special tokens, a very long one."""
    import pyarrow as pa

    from weftline.llm.token_store import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = tokenizers.Tokenizer.from_file(path), Encoder(open(path, encoding="utf-8").read())
    rng = random.Random(14)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for letters in ("abc  \n\n\t'stre.,!12éßœ日\r\0—“ x", "abc '\nstre.,!12éßœ—“ x") for _ in range(2000)]
    texts += [*ODD_TEXTS, "a <|endoftext|> b", "long word " * 300_000 + "é", "9" * 5000]
    for some in (texts, [t for t in texts if t and encoder._kind(t) == 2]):
        for t, ids in zip(some, encoder.batch(pa.array(some, pa.string())), strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, (t or "")[:80]


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = defaultdict(set)
    for item, t in items:
        w = cut(t)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    from weftline.llm import decontaminate
    from weftline.llm.decontaminate import contamination, drop_contaminated

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(4)
    items = [(i, words_text(rng, rng.choice((13, 20, 60)), 5000)) for i in range(30)] + [(40, "hello, world"), (41, None), (42, "É"), (None, "brown"), (43, "!!"), (40, "hello, world"), (44, "a a a")]
    docs = []
    for i in range(80):
        w = words_text(rng, rng.choice((5, 100, 900)), 5000).split(" ")
        if i % 2:
            p = (items[rng.randrange(30)][1]).split(" ")
            a = rng.randrange(len(p))
            w[len(w) // 2 : len(w) // 2] = p[a : a + rng.choice((11, 12, 13, 14, 30))]
        docs.append((i, " ".join(w)))
    docs += [(100, "Hello World! x"), (101, None), (102, ""), (None, "say hello-world"), (103, "the brown fox"), (104, "é É"), (105, "a a a a a"), (105, "a a a a a"), (105, "other")]
    items += [(50, "b " * 20), (51, words_text(rng, 3000, 9999)), (52, items[3][1]), (53, items[3][1] + " more words")]
    docs += [(106, "c " + "b " * 40), (107, words_text(rng, 60_000, 5000) + " " + items[3][1]), (108, items[51 - 51][1].upper()), (109, " ".join(items[-3][1].split(" ")[1000:1500]))]
    docs += [(110, " ".join([*items[4][1].split(" ")[:13], "cut", *items[4][1].split(" ")[1:14]]))]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    want = brute_contamination(docs, items)
    assert sorted(map(tuple, contamination(df, b).collect()), key=str) == sorted(want, key=str)
    kept = drop_contaminated(df, b)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)
    assert contamination(df.limit(0), b).count() == 0
    assert contamination(df, b.limit(0)).where("n_hit > 0 OR contaminated").count() == 0


def test_decontamination_of_repetitive_text(spark):
    from weftline.llm.decontaminate import contamination

    rng = random.Random(41)

    def junk():
        out = []
        for _ in range(rng.randrange(1, 4)):
            phrase = [rng.choice("abcdefghijkl") for _ in range(rng.choice((1, 1, 2, 3, 5, 6, 8, 10)))]
            out += (phrase * 40)[: rng.choice((6, 12, 13, 14, 25, 40, 40))] + rng.choice(([], ["x"], ["x", "y"]))
        return " ".join(out)

    items = [(i, junk()) for i in range(40)] + [(90, "w " * 300), (91, "v " + "w " * 200 + "u"), (92, "w " * 13 + "z")]
    docs = [(i, junk()) for i in range(200)] + [(900, "w " * 1500), (901, "v " + "w " * 900 + "u " + "w " * 13 + "z"), (902, "q " * 12 + "w " * 12), (903, "w " * 12 + "z")]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    assert sorted(map(tuple, contamination(df, b).collect())) == sorted(brute_contamination(docs, items))


@pytest.mark.parametrize("version", [1, 2])
def test_warc(spark, version):
    from weftline.llm.warc import warc_round_trip

    odd = ["", None, "filedesc://x\n1 0 a\n\nWARC/1.1\r\n\r\n", "é日本\r\n\r\nx", "a\nfiledesc://zz 0.0.0.0 1 text/plain 5\n1 0 a\n", "plain", "plain", "z" * 100_000]
    rows = [(i, f"http://h{i}/ x\n", t, "c") for i, t in enumerate(odd)] + [(50, None, "plain", "c"), (51, "", "é日本\r\n\r\nx", "c"), (None, "u", "plain", "c")]
    got = warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string"), version=version).collect()
    last = {}
    for i, _, t, _ in rows:
        if i is not None:
            last[t or ""] = max(last.get(t or "", -1), i)
    want = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        own = i is None or last[t or ""] == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else last[t or ""]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_warc_repeated_ids_are_judged_by_payload(spark, monkeypatch, tmp_path, broadcast):
    from weftline.llm import warc

    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = [(5, "u", "AAAA"), (5, "u", "BBBB"), (9, "v", "AAAA"), (9, "w", "AAAA"), (3, "x", "CC"), (3, "x", "CC"), (7, "y", None), (2, "z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(df).collect())
    want = [(5, 4, "revisit", 9), (5, 4, "response", None), (9, 4, "response", None), (9, 4, "response", None), (3, 2, "response", None), (3, 2, "response", None), (7, 0, "response", None), (2, 0, "revisit", 7)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    warc.write_arc(df, f"{tmp_path}/arc")
    warc.convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    blocks = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.glob("warc/*.gz"))
    assert b"BBBB" in blocks and blocks.count(b"AAAA") == 2


def test_warc_keeps_long_urls(spark, tmp_path):
    from weftline.llm.warc import convert_arc, read_warc, write_arc

    same = "http://h/" + "é日" * 6000
    rows = [(1, same + "a", "one"), (2, same + "b", "two"), (3, same + "c", "two")]
    write_arc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/arc")
    convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    records = [h for f in tmp_path.glob("warc/*.gz") for h, _ in read_warc(gzip.decompress(f.read_bytes())) if h["warc-type"] != "warcinfo"]
    want = [url.replace("日", "&#26085;") for _, url, _ in rows]
    assert sorted(h["warc-target-uri"] for h in records) == want and len({h["warc-record-id"] for h in records}) == 3
    assert [h["warc-refers-to-target-uri"] for h in records if h["warc-type"] == "revisit"] == [want[2]]


def brute_repeats(docs, n):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k] += 1
                gone[k + n] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((i, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 3])
def test_suffix_dedup(spark, monkeypatch, most):
    from weftline.llm import suffix_dedup

    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcde éñ\n") for _ in range(n))
    passage = letters(700)
    docs = [(i, letters(rng.randrange(600)) + passage[a : a + rng.choice((190, 199, 205, 400))] + letters(rng.randrange(300))) for i, a in enumerate(rng.randrange(300) for _ in range(40))]
    docs += [(100, None), (101, ""), (102, "ab" * 400), (103, "é" * 150), (104, "é" * 150 + "z"), (105, passage[:150]), (105, passage[:150]), (106, passage), (106, passage), (None, passage + "q"), (107, letters(5000) * 2)]
    docs += [(108, letters(20_000) + passage), (109, "x" * 5000)]
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    assert sorted(map(tuple, suffix_dedup.repeated_bytes(df).collect()), key=str) == sorted(brute_repeats(docs, 200), key=str)
    assert suffix_dedup.repeated_bytes(df.limit(0)).count() == 0


def test_anchors_of_very_long_texts(monkeypatch):
    """Hashed in pieces, each window has the anchor that it has in the whole."""
    from weftline.llm import suffix_dedup

    text = bytes(random.Random(17).choice(b"abcdef ") for _ in range(30_000))
    of = lambda: {w: (int(h), int(p)) for h, p, a, b in zip(*suffix_dedup.anchors(text, 200), strict=True) for w in range(a, b + 1)}
    want = of()
    monkeypatch.setattr(suffix_dedup, "PIECE", 4096)
    assert of() == want and len(want) == len(text) - 199


def test_run_length_index():
    from weftline.llm.suffix_dedup import RunLengthIndex

    rng = random.Random(1)
    for _ in range(15):
        base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(6)]
        texts = list(dict.fromkeys(base + [b[: rng.randint(1, len(b))] for b in base] + [rng.choice(base) + rng.choice(base) for _ in range(4)]))
        index = RunLengthIndex(texts)
        assert [index.text(i) for i in range(len(texts))] == texts
        assert index.lengths.sum() == index.size and len(index.first[0]) == len(index.symbols)
        found = np.concatenate([index.matching_statistics(a, min(a + 7, index.size)) for a in range(0, index.size, 7)])
        at = [t[i:] for t in texts for i in range(len(t) + 1)]
        for p, s in enumerate(at):
            best = max(next((k for k in range(min(len(s), len(t))) if s[k] != t[k]), min(len(s), len(t))) for q, t in enumerate(at) if q != p)
            assert found[p] == best
    # what is kept follows the runs, not the bytes
    one = bytes(rng.choice(b"abcd") for _ in range(3000))
    assert len(RunLengthIndex([one] * 20).symbols) < len(RunLengthIndex([one]).symbols) + 100


@pytest.mark.parametrize("least", [1, 20])
def test_line_dedup(spark, least):
    from weftline.llm.line_dedup import dedup_lines, line_dedup_report

    rng = random.Random(7)
    lines = [words_text(rng, n, 9999) for n in (19, 20, 30, 60)]
    docs = [(i, "\n".join(rng.choice([*lines, words_text(rng, 25, 9999), "short"]) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, lines[3] + "\r\n  " + lines[3].upper() + " \n"), (104, lines[2].replace(" ", "\t"))]
    very_long = words_text(rng, 200_000, 99_999)
    docs += [(105, very_long), (106, "x\n" + very_long + "\nSHORT\n" + "\n".join("short" for _ in range(20_000)))]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs] + [(None, lines[3], "c", "c"), (0, docs[0][1], "c", "twice")], DOCS)
    first, want = set(), {}
    for i, t in docs:
        kept, cut, again, at = [], [], [], 0
        for line in (t or "").split("\n"):
            key = " ".join(line.split()).lower()
            if key in first and key:
                again.append((at, at + len(line)))
            if key in first and key and len(line.split()) >= least:
                cut.append((at, at + len(line)))
            else:
                kept.append(line)
            first.add(key)
            at += len(line) + 1
        want[i] = (cut, again, None if t is None else "\n".join(kept))
    for r in line_dedup_report(df, min_words=least).collect():
        cut, again, kept = want[r.doc_id] if r.doc_id is not None else ([], [], lines[3])
        assert ([(x.start, x.end) for x in r.removed], r.n_removed, r.removed_chars) == (cut, len(cut), sum(b - a for a, b in cut)), r.doc_id
        assert ([(x.start, x.end) for x in r.repeated], r.n_repeated) == (again, len(again)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256((kept or "").encode()).hexdigest()
    out = dedup_lines(df, min_words=least)
    assert out.schema == df.schema
    assert all(r.text == (want[r.doc_id][2] if r.doc_id is not None else lines[3]) for r in out.collect())
    assert dedup_lines(df.limit(0)).count() == 0


def test_suffix_dedup_of_repetitive_text(spark, monkeypatch):
    from weftline.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 1000)
    rng = random.Random(6)
    docs = [(1, "a" * 30_000), (2, "ab" * 9000 + "c"), (3, "x" + "abc" * 100), (4, "z" * 200), (5, "y" * 201), (6, "q" + "a" * 199), (7, "a" * 250 + "b" + "a" * 250)]
    for i in range(60):
        phrase = "".join(rng.choice("klmn ") for _ in range(rng.choice((1, 2, 7, 33, 120, 199, 200, 201, 230))))
        docs.append((100 + i, "".join(rng.choice("uvw") for _ in range(rng.randrange(90))) + phrase * rng.randrange(1, 2 + 1200 // len(phrase)) + "end"))
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    assert sorted(map(tuple, suffix_dedup.repeated_bytes(df).collect())) == sorted(brute_repeats(docs, 200))


def brute_passages(docs, n=50, min_words=20):
    """Words and lines that go, on the texts as given; docs of (id, text) in ascending id order."""
    seen, lines, out = set(), set(), {}
    for i, text in docs:
        where = [(k, m.group().lower()) for k, line in enumerate(text.split("\n")) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        w = [x for _, x in where]
        gone = set()
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            if run in seen:
                gone.update(range(k, k + n))
            seen.add(run)
        for k, line in enumerate(text.split("\n")):
            key = " ".join(line.split()).lower()
            if len(line.split()) >= min_words:
                if key in lines:
                    gone.update(j for j, (at, _) in enumerate(where) if at == k)
                lines.add(key)
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


def test_passages_over_short_lines(spark):
    """Hard-wrapped text: no line of 20 words, but a passage of 60 that repeats."""
    from weftline.llm.line_dedup import dedup_passages

    rng = random.Random(31)
    wrapped = [words_text(rng, 12, 9999) for _ in range(5)]
    short = words_text(rng, 12, 9999)
    docs = [(i, "\n".join([words_text(rng, 12, 9999), short, *wrapped, words_text(rng, 9, 9999)])) for i in range(4)]
    docs += [(4, "\n".join([short, words_text(rng, 30, 9999), *wrapped[:4], words_text(rng, 30, 9999)])), (5, " ".join(wrapped).upper())]
    docs += [(6, "\n".join([*wrapped[:3], words_text(rng, 25, 9999)])), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs] + [(None, docs[5][1], "c", "c")], DOCS)
    out = dedup_passages(df)
    assert out.schema == df.schema
    got = {r.doc_id: r.text for r in out.collect()}
    want = brute_passages([(i, t) for i, t in docs if t is not None])
    assert {i: t.lower().split() for i, t in got.items() if i is not None and t is not None} == want
    assert got[0] == docs[0][1] and got[1] == "\n".join([docs[1][1].split("\n")[0], docs[1][1].split("\n")[-1]])
    assert got[6] == docs[6][1] and short in got[4] and wrapped[0] not in got[1]
    assert got[5] == "" and got[None] == docs[5][1] and got[7] is None
    assert dedup_passages(df.limit(0)).count() == 0


def test_passages_inside_long_lines(spark):
    """A passage within longer lines, at other offsets, beside a changed word, across documents and within one."""
    from weftline.llm.line_dedup import dedup_passages

    rng = random.Random(32)
    new = lambda n: words_text(rng, n, 9999)
    part, line = new(52), new(130)
    changed = line.split(" ")
    changed[60] = "zz"
    docs = [(0, new(70) + " " + part + " " + new(20)), (1, new(5) + "  " + part.upper() + "\t" + new(300) + "\r\nend"), (2, line), (3, " ".join(changed) + " added"), (4, new(30) + " " + " ".join(part.split(" ")[:49]) + " " + new(30))]
    docs += [(5, part + " " + new(40) + " " + part), (6, new(60) + "\n" + part + " tail\n" + "é " * 120), (7, "é " * 120)]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    odd = [("É" if k % 3 else "İK ") + w for k, w in enumerate(new(60).split(" "))]
    more = [(8, " ".join(odd)), (9, "x\u00a0" + "\u3000".join(w.replace("É", "é") for w in odd) + "\x1cK y")]
    both = {r.doc_id: r.text for r in dedup_passages(spark.createDataFrame([(i, t, "c", "c") for i, t in more], DOCS)).collect()}
    assert both == {8: more[0][1], 9: "x\u00a0K y"}
    got = {r.doc_id: r.text for r in dedup_passages(df).collect()}
    assert {i: t.lower().split() for i, t in got.items()} == brute_passages(docs)
    assert got[0] == docs[0][1] and got[2] == line and got[4] == docs[4][1]
    assert got[3] == "zz added" and got[6].split("\n")[1] == "tail"


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def quality_table():
    """Rows, labels of some of them, and what labels would say of the others."""
    rng = random.Random(11)
    rows, labels, others = [], [], {}
    for i in range(400):
        good = rng.random() < 0.7
        t = "\n".join(words_text(rng, 20) for _ in range(rng.randrange(1, 6)))
        if not good:
            t = t.replace(" ", " ### ") if rng.random() < 0.5 else t.upper().replace(" ", "!! ")
        rows.append((i, t))
        if i % 4:
            labels.append((i, int(good)))
        else:
            others[i] = int(good)
    rows += [(900, None), (901, ""), (902, "a b c d e " * 9), (903, " x\n \n x\n x"), (None, rows[0][1]), (904, "é ñ 日本 " * 5)]
    rows += [(905, " ".join(f"n{k}" for k in range(200_000))), (906, "x" * 2_000_000)]
    rows += [(1, rows[1][1])] * 3  # a labelled id that repeats
    return rows, labels, others


def test_quality_rules(spark):
    from weftline.llm.decision_list import keep_good, learn_rules, quality_rules
    from weftline.llm.stats import document_statistics

    rows, labels, others = quality_table()
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], DOCS)
    lab = spark.createDataFrame([(i, q, "c") for i, q in labels] + [(None, 1, "c"), (5, None, "c")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality_rules(df, lab).collect()}
    truth = dict(labels)
    for i, t in rows:
        n = brute_statistics(t)
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)
    right = [got[i].kept == bool(q) for i, q in others.items()]
    assert len(right) == 100 and sum(right) / len(right) > 0.95  # rows without a label
    # the ordered conditional against the same rules, one by one in plain Python
    stats = {r.id: r for r in document_statistics(df).collect()}
    rules = learn_rules(document_statistics(df), lab)
    assert rules and set(truth) <= set(stats)
    for i, r in got.items():
        first = next((k for k, rule in enumerate(rules, 1) if all((stats[i][c.feature] > c.threshold) == c.above for c in rule.conditions)), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)
    kept = keep_good(df.withColumn("_statistics", df.id), lab).drop("_statistics")
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows if got[i].kept), key=str)
    assert quality_rules(df.limit(0), lab).count() == 0
    alone = quality_rules(df, lab.limit(0))
    assert alone.where("kept = base_failed").count() == 0


def test_quality_classifier(spark):
    from weftline.llm.boosted import FEATURES, fit, learn_forest, quality_scores
    from weftline.llm.stats import document_statistics

    rows, labels, others = quality_table()
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(df, lab).collect()}
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r.held_out} == held
    right = [got[i].predicted == q for i, q in labels if i in held]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    # the flattened trees, walked node by node in plain Python
    stats = document_statistics(df)
    forest = learn_forest(stats, lab)
    assert len(forest.roots) > 1
    for r in stats.collect():
        margin = forest.base
        for node in forest.roots.tolist():
            while forest.feature[node] >= 0:
                node = int(forest.left[node]) + (r[FEATURES[forest.feature[node]]] > forest.threshold[node])
            margin += forest.value[node]
        assert abs(got[r.id].score - 1 / (1 + np.exp(-margin))) < 1e-9
    # labels of held-out rows change nothing
    turned = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels], "doc_id long, quality int")
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in quality_scores(df, turned).collect()}
    assert {round(r.score, 6) for r in quality_scores(df, lab.limit(0)).collect()} == {0.5}
    assert quality_scores(df.limit(0), lab).count() == 0
    x = np.random.default_rng(0).normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((fit(x, y).score(x) > 0.5) == y).mean() > 0.95


def test_pipeline(spark, tmp_path):
    """Each stage against its brute-force version on its own input."""
    import corpus_pipeline

    rng = random.Random(12)
    item = words_text(rng, 30, 9999)
    shared = words_text(rng, 60, 9999)
    texts = [words_text(rng, rng.choice((30, 80, 200)), 9999) for _ in range(30)]
    texts += [texts[0], edited(rng, texts[2], 0.01), texts[5] + "\n" + shared, texts[6][:90] + "\n" + shared, "x " + item, "a b", None, "", "s p a m " * 40]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(38, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, now, str(tmp_path))
        assert out.schema == docs.schema
        seen.append({r.doc_id: r.text for r in out.collect()})
        now = out
    good, single, lines, clean = seen
    failed = {i for i, t in enumerate(texts) if (s := brute_statistics(t))[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert set(range(len(texts))) - set(good) == failed
    sets = {i: sets_of(t, 5) for i, t in good.items()}
    dup = {j for i, j in combinations(sorted(good), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert set(good) - set(single) == dup and dup
    assert sum(shared in (t or "") for t in single.values()) == 2 and sum(shared in (t or "") for t in lines.values()) == 1
    bad = {r[0] for r in brute_contamination(lines.items(), [(1, item)]) if r[5]}
    assert set(lines) - set(clean) == bad and bad
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: library.encode(t, add_special_tokens=False).ids for i, t in clean.items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table, null and repeated ids and a very long text go through every stage."""
    import corpus_pipeline

    rng = random.Random(21)
    text = words_text(rng, 40, 9999)
    rows = [(None, text), (None, text), (7, text), (7, text), (8, words_text(rng, 50_000, 99_999)), (9, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], kind)
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words_text(rng, 30, 9999))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given, want in ((docs, ["7", "7", "8", "None", "None"]), (docs.limit(0), [])):
        now = given
        for name, f in corpus_pipeline.STAGES:
            now = f(spark, now, str(tmp_path))
            assert now.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
        assert sorted(str(r.doc_id) for r in now.collect()) == want


def test_pipeline_decodes(spark):
    import corpus_pipeline

    from weftline.llm.bpe import bpe_round_trip

    assert corpus_pipeline.STAGES[-1][0] == "BPE encoding and decoding"
    rng = random.Random(13)
    texts = [words_text(rng, 30), "Été, naïve don't 12 日本", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.token_stage(spark, docs, "").collect()}
    assert got == {r.doc_id: r.decoded_sha256 for r in bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}


def test_registered_queries_have_contract_columns():
    from weftline.llm.queries import QUERIES, SQL

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)
    assert json.dumps(sorted(SQL))


def test_archives_of_any_bytes(spark, tmp_path):
    """A version 2 archive with a binary payload, a header line in Latin-1, a dns record and a version block."""
    from weftline.llm.warc import convert_arc, read_records, read_warc

    def entry(url, kind, block):
        return b" ".join((url, b"1.2.3.4", b"20010203040506", kind, b"200", b"-", b"-", b"0", b"f.arc", str(len(block)).encode())) + b"\n" + block + b"\n"

    version = b"2 0 maker\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/x\r\nContent-Length: 6\r\nX-Page-Id: 7\r\n\r\n\xff\xfe\r\n\x00\x80"
    copy = image.replace(b"Id: 7", b"Id: 9")
    names = b"20010203040506\nexample.org. 60 IN A 1.2.3.4\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(entry(b"filedesc://old/f.arc", b"text/plain", version) + entry("http://h/é".encode("latin-1"), b"image/x", image) + entry(b"dns:example.org", b"text/dns", names) + entry(b"http://h/copy", b"image/x", copy)))
    convert_arc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    records = {(h["warc-type"], h.get("warc-target-uri")): (h, b) for f in tmp_path.glob("warc/*.gz") for h, b in read_warc(gzip.decompress(f.read_bytes()))}
    assert set(records) == {("warcinfo", None), ("revisit", "http://h/é"), ("resource", "dns:example.org"), ("response", "http://h/copy")}
    header, block = records["response", "http://h/copy"]
    assert block == copy and header["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"\xff\xfe\r\n\x00\x80").digest()).decode() and header["warc-date"] == "2001-02-03T04:05:06Z"
    header, block = records["resource", "dns:example.org"]
    assert block == names and header["content-type"] == "text/dns" and header["warc-payload-digest"] == header["warc-block-digest"]
    header, block = records["warcinfo", None]
    assert header["warc-filename"] == "f.arc" and header["content-type"] == "application/warc-fields" and b"arc-version: 2\r\n" in block and b"arc-fields: URL IP-address" in block
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in read_records(spark, f"{tmp_path}/warc").collect()) == [(0, "resource", None, len(names)), (7, "revisit", 9, 6), (9, "response", None, 6)]


CLASHES = ("_blocked", "_id", "_later", "_first", "_runs", "_run_id", "_line_id", "_i", "_d", "_key", "id", "digest", "key", "_LATER_", "n_words")


def test_columns_that_clash_with_inner_names_stay(spark):
    from weftline.llm.decontaminate import drop_contaminated
    from weftline.llm.line_dedup import dedup_lines, dedup_passages, line_dedup_report
    from weftline.llm.url_filter import Rule, judge_urls

    rng = random.Random(8)
    line, passage = words_text(rng, 30), words_text(rng, 70)
    texts = [line, f"a\n{line}\nb", passage, f"x y {passage} z", "own words here", None]
    extra = {c: f"keep {c}" for c in CLASHES}
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(i, t, *extra.values()) for i, t in enumerate(texts)], f"doc_id long, text string, {names}")

    def kept(df):
        assert df.columns == docs.columns
        rows = {r["doc_id"]: r for r in df.collect()}
        assert all(r[c] == extra[c] for r in rows.values() for c in CLASHES)
        return {i: r["text"] for i, r in rows.items()}

    assert kept(dedup_lines(docs)) == {0: line, 1: "a\nb", 2: passage, 3: f"x y {passage} z", 4: "own words here", 5: None}
    assert kept(dedup_passages(docs)) == {0: line, 1: "a\nb", 2: passage, 3: "x y z", 4: "own words here", 5: None}
    assert {r.doc_id: r.n_repeated for r in line_dedup_report(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert set(kept(drop_contaminated(docs, items))) == {0, 1, 4, 5}
    for listed in ([], [("bad.org",)]):
        pages = spark.createDataFrame([("http://bad.org/", *extra.values()), ("http://good.org/", *extra.values())], f"url string, {names}")
        out = {r.url: r for r in judge_urls(pages, [Rule(True, "net/")], spark.createDataFrame(listed, "key string")).collect()}
        assert all(r[c] == extra[c] for r in out.values() for c in CLASHES)
        assert [out[u].verdict for u in ("http://bad.org/", "http://good.org/")] == ["block" if listed else "allow", "allow"]


def test_line_query_tells_passages_inside_lines(spark, tmp_path):
    """Passages within longer lines and over short ones count, lone short lines that repeat don't; the SQL's columns stay."""
    duckdb = pytest.importorskip("duckdb")
    from weftline.llm.line_dedup import dedup_passages
    from weftline.llm.queries import SQL, op7_line_dedup

    rng = random.Random(41)
    new = lambda n: words_text(rng, n, 9999)
    part, long, short = new(60), new(25), "all rights reserved."
    wrapped = "\n".join(" ".join(part.split(" ")[k : k + 12]) for k in range(0, 60, 12))
    docs = [(0, f"é {new(30)} {part} {new(20)}"), (1, f"ééé {new(5)} {part.upper()} tail\n{short}"), (2, f"{short}\n{new(40)}\n{short}"), (3, f"{new(4)}\n{wrapped}\n{short}")]
    docs += [(4, long), (5, f"日本\n{long}\nend"), (6, f"{new(9)} {' '.join(part.split(' ')[:49])} {new(9)}"), (7, ""), (8, f"{new(3)} {part} {new(2)} {part}")]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = op7_line_dedup(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(SQL["op7_line_dedup"])
    assert out.columns[-3:] == ["n_passage_words", "passages", "left_sha256"] and sorted(out.columns[:-3]) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.values()) == sorted(want.fetchall())
    left = {r.doc_id: r.text for r in dedup_passages(df).collect()}
    for i, words in brute_passages(docs).items():
        text = dict(docs)[i]
        spans = [tuple(map(int, x.split("-"))) for x in got[i].passages.split(",") if x]
        rest = "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in spans))
        assert rest.lower().split() == left[i].lower().split() == words
        assert got[i].n_passage_words == len(text.split()) - len(words) == sum(len(text[a:b].split()) for a, b in spans)
        assert got[i].left_sha256 == hashlib.sha256(left[i].encode()).hexdigest()
    assert {i for i in got if got[i].n_passage_words} == {1, 3, 5, 8} and {i for i in got if got[i].n_repeated} == {2, 3, 5}
    assert {i: got[i].n_passage_words for i in (1, 3, 5, 8)} == {1: 60, 3: 60, 5: 25, 8: 120}


def test_line_report_of_null_and_repeated_ids(spark):
    from weftline.llm.line_dedup import line_dedup_report

    part = words_text(random.Random(42), 60, 9999)
    docs = [(1, f"a {part}"), (None, f"b {part}"), (1, f"c {part} {part}"), (2, f"d {part}"), (3, None)]
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    seen = sorted(map(str, ((r.doc_id, r.n_passage_words) for r in line_dedup_report(df, run_words=50).collect())))
    assert seen == sorted(map(str, [(1, 0), (None, 0), (1, 60), (2, 60), (3, 0)]))
    assert line_dedup_report(df.limit(0), run_words=50).count() == 0
