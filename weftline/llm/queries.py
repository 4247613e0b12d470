"""The dealt operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted import quality_scores
from .bpe import bpe_round_trip
from .decision_list import quality_rules
from .decontaminate import contamination
from .divergence import source_divergence
from .embedding_dedup import near_vectors
from .filter_audit import filter_interactions
from .line_dedup import MIN_WORDS, RUN_WORDS, line_dedup_report
from .ngram_join import ngram_jaccard_components
from .suffix_dedup import repeated_bytes
from .token_store import token_store_round_trip
from .url_filter import Rule, judge_urls
from .warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard similarity of at least 0.9."""
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; the package is only needed where the default is taken."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [Rule(True, "org/"), Rule(False, "example.org/es/"), Rule(False, "example.org/en/1"), Rule(True, "com/fr/"), Rule(False, "com/de/")]
#: Blocked hosts, each with all of its subdomains.
BLOCKED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, BLOCKED))).alias("key"))
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listed).drop("url")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line is reported; repeated lines of ``MIN_WORDS`` words are removed.

    The last three columns, which the SQL has not, tell the words that go with
    passages of ``RUN_WORDS`` words too, wherever in lines these lie.
    """
    out = line_dedup_report(_table(spark, sf_dir, "documents"), min_words=MIN_WORDS, run_words=RUN_WORDS)
    return out.withColumns({c: F.expr(f"array_join(transform({c}, x -> concat(x.start, '-', x.end)), ',')") for c in ("repeated", "removed", "passages")})


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store_round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_store": op8_token_store,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_filter_interactions": op13_filter_interactions,
}

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
_RULE_SQL = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(RULES, key=lambda r: -len(r.text))
)

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 90 * (s.n + t.n - k)),
pairs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, pairs.y FROM reach JOIN pairs ON reach.r = pairs.x)
SELECT v AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes ON sizes.doc_id = v GROUP BY v
""",
    "op5_warc": """
WITH bits AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS b FROM pages
), coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS INT), 1) AS INT) << (4 - j)))::INT + 1, 1)), '') AS payload_digest FROM bits
), last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS o FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN o = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(o, page_id) AS refers_to FROM last
""",
    "op2_url_filter": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (
  SELECT *, CASE {_RULE_SQL} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ({", ".join(f"'{r.text}'" for r in RULES if r.allow)}) THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN {" OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in BLOCKED)} THEN 'block'
  ELSE 'allow' END AS verdict
FROM judged
""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 11))) AS i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) k, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op7_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), units AS (
  SELECT *, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS words,
    sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start
  FROM lines
), ranked AS (
  SELECT *, len(words) >= 1 AND row_number() OVER (PARTITION BY lower(array_to_string(words, ' ')) ORDER BY doc_id, i) > 1 AS again, again AND len(words) >= {MIN_WORDS} AS gone FROM units
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_repeated, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(line) AS BIGINT), ',' ORDER BY i) FILTER (again), '') AS repeated,
  CAST(coalesce(sum(length(line)) FILTER (gone), 0) AS BIGINT) AS removed_chars,
  coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(line) AS BIGINT), ',' ORDER BY i) FILTER (gone), '') AS removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
""",
    "op11_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), found AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM found GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(counts.c, 0) AS c, k.c AS lang_c
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = k.term
), rated AS (
  SELECT *, 1 + (1000000000 * CAST(c + 1 AS HUGEINT)) // (sum(c) OVER g + count(*) OVER g) AS p, 1 + (1000000000 * CAST(lang_c + 1 AS HUGEINT)) // (sum(lang_c) OVER g + count(*) OVER g) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM rated x JOIN rated y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM rated WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op12_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS x, b.r AS y, b.vec_id AS id FROM usable a JOIN usable b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9 * a.norm * b.norm
), reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.y FROM reach JOIN links ON reach.s = links.x),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r)
SELECT vec_id, coalesce(k, 0) AS n_links, CASE WHEN vec_id IS NOT NULL THEN component_id END AS component_id, vec_id IS NOT DISTINCT FROM (CASE WHEN vec_id IS NOT NULL THEN component_id END) AS kept
FROM v JOIN least USING (r) LEFT JOIN (SELECT x, count(*) AS k FROM links GROUP BY x) n ON n.x = v.r
""",
    "op13_filter_interactions": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(marks.toxic, 0) AS toxic
  FROM d LEFT JOIN marks USING (doc_id)
), profile AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
met AS (
  SELECT *, contains(fails, f) AS failing, regexp_matches(fails, '[' || (CASE WHEN earlier = '' THEN '0' ELSE earlier END) || ']') AS gone FROM profile, steps
), told AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed, sum(n) FILTER (gone AND failing) AS redundant,
    sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (NOT gone AND failing) AS good_lost, sum(toxic) FILTER (NOT gone AND failing) AS toxic_lost FROM met GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM told
""",
}
