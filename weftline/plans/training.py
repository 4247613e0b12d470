"""Queries that select and lay out training rows, with SQL for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import POSITIVE_LABELS, collapse_space, hash_bucket, seeded_hash, short_id
from ..operators import audit, blocks, training
from ..operators.ordinal import with_ordinal
from ..sources import tables as T
from ..sources.files import related_ids
from ..sources.staged import staged
from .oracle import _HARD_ORDER, _HASH, _bucket
from .queries import _block_table, _hardness, _updates, pair_siblings_v3, query, r6

SQL: dict[str, str] = {}
#: SQL that needs no common tables.
PLAIN = ("tree_digest", "number_formats")
TARGETS = {"ATTACK": 12, "MIXED": 6, "REPHRASE": 20, "SUPPORT": 30}
MIX = {"NONE": 3, "SUPPORT": 2, "REPHRASE": 1, "ATTACK": 1, "MIXED": 1}
CAPACITY = 40


def sql(name: str, body: str) -> None:
    SQL[name] = body


def _pairs(s, d):
    """Positive blocks with the NONE sibling of their update, and the eight keys of their queues."""
    p = pair_siblings_v3(s, d)
    h = _hardness(s, d).select(F.col("example_id").alias("negative_id"), "max_shared", "max_overlap", "max_jaccard", "turn_gap")
    return p.join(h, "negative_id")


def _pair_order():
    return [(F.col("max_shared") >= 2).cast("int").desc(), F.col("max_overlap").desc(), F.col("max_shared").desc(), F.col("max_jaccard").desc(), F.col("turn_gap"), seeded_hash("v3", F.col("positive_id")), seeded_hash("v3", F.col("positive_id"), F.col("negative_id")), F.col("positive_id")]


_PAIR_KEYS = f"{_HARD_ORDER('max_')}, turn_gap, {_HASH('v3', 'positive_id')}, {_HASH('v3', 'positive_id || \'|\' || negative_id')}, positive_id"
PAIRS = f"""none AS (SELECT update_id, example_id AS negative_id, max_shared, max_overlap, max_jaccard, turn_gap FROM hard WHERE n_gold = 0 QUALIFY row_number() OVER (PARTITION BY update_id ORDER BY {_HARD_ORDER("max_")}, turn_gap, {_HASH("v3", "example_id")}) = 1),
posb AS (SELECT update_id, category, example_id AS positive_id FROM block WHERE n_gold > 0 QUALIFY row_number() OVER (PARTITION BY update_id, category ORDER BY {_HASH("v3", "example_id")}) = 1),
pr AS (SELECT * FROM posb JOIN none USING (update_id))"""


@query
def pair_queue_order(s, d):
    """Place of each pair in the queue of its category."""
    return with_ordinal(_pairs(s, d), _pair_order(), "place", ("category",)).select("category", "positive_id", "negative_id", "place")


sql("pair_queue_order", f", {PAIRS} SELECT category, positive_id, negative_id, row_number() OVER (PARTITION BY category ORDER BY {_PAIR_KEYS}) AS place FROM pr")


@query
def rare_first_targets(s, d):
    """Up to a target of each category, rarest first; an update that a stage has used is out for the later ones."""
    return training.rare_first(_pairs(s, d), TARGETS, _pair_order()).select("category", "update_id", "positive_id", "negative_id")


def _rare_sql() -> str:
    out, used = [], []
    for i, (c, n) in enumerate(TARGETS.items()):
        unused = "".join(f" AND update_id NOT IN (SELECT update_id FROM st{j})" for j in used)
        out.append(f"st{i} AS (SELECT category, update_id, positive_id, negative_id FROM pr WHERE category = '{c}'{unused} ORDER BY {_PAIR_KEYS} LIMIT {n})")
        used.append(i)
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM st{j}" for j in used)


sql("rare_first_targets", f", {PAIRS}, {_rare_sql()}")


def _none_pool(s, d):
    elsewhere = _block_table(s, d).groupBy("update_id").agg(F.max(F.col("n_gold") > 0).alias("elsewhere"))
    return _hardness(s, d).where("n_gold = 0").join(elsewhere, "update_id")


def _none_order():
    return [F.col("elsewhere").cast("int").desc(), (F.col("max_shared") >= 2).cast("int").desc(), F.col("max_overlap").desc(), F.col("max_shared").desc(), F.col("max_jaccard").desc(), F.col("turn_gap"), seeded_hash("v4", F.col("example_id")), F.col("example_id")]


@query
def none_pool_v4(s, d):
    """Blocks without gold and their places: those whose update has an edge elsewhere first, then by hardness."""
    return with_ordinal(_none_pool(s, d), _none_order(), "place").select("example_id", "elsewhere", r6("max_overlap").alias("max_overlap"), "place")


_NONE_KEYS = f"elsewhere DESC, {_HARD_ORDER('max_')}, turn_gap, {_HASH('v4', 'example_id')}, example_id"
_POOL_V4 = "np AS (SELECT hard.*, any_gold > 0 AS elsewhere FROM hard JOIN (SELECT update_id, max(n_gold) AS any_gold FROM block GROUP BY 1) USING (update_id) WHERE n_gold = 0)"
sql("none_pool_v4", f", {_POOL_V4} SELECT example_id, elsewhere, round(max_overlap, 6) AS max_overlap, row_number() OVER (ORDER BY {_NONE_KEYS}) AS place FROM np")


@query
def attachment_order(s, d):
    """Places of all updates by how hard a proposition is to attach, then by id."""
    from .queries import attachment_hardness

    return with_ordinal(attachment_hardness(s, d), [F.col("score").desc(), F.col("update_id")], "place").select("update_id", "score", "place")


sql("attachment_order", "SELECT *, row_number() OVER (ORDER BY score DESC, update_id) AS place FROM (SELECT d.update_id, count(*) FILTER (label <> 'NONE') * 100 + count(*) FILTER (label = 'NONE' AND c.new_id IS NOT NULL) AS score FROM decisions d LEFT JOIN crossed c ON c.new_id = d.new_id AND c.old_id = d.old_id GROUP BY 1)")


@query
def alternating_capacity(s, d):
    """Positive and negative updates by turns in seeded order, skipping what would overrun the capacity of blocks."""
    return training.alternating_fold(_updates(s, d), F.col("n_gold") > 0, "n_blocks", CAPACITY, "train", "update_id").select("update_id", "n_blocks", F.col("ord").cast("long"))


sql("alternating_capacity", f""", q AS (SELECT update_id, n_blocks, n_gold > 0 AS pos, row_number() OVER (PARTITION BY n_gold > 0 ORDER BY {_HASH("train", "update_id")}, update_id) AS r FROM upd), c AS (SELECT min(n) FILTER (true) AS m FROM (SELECT count(*) FILTER (pos = p) AS n FROM q, (VALUES (true), (false)) t(p) GROUP BY p)),
o AS (SELECT update_id, n_blocks, row_number() OVER (ORDER BY r, NOT pos) AS ord FROM q), f AS (SELECT list(n_blocks ORDER BY ord) AS sizes FROM o),
k AS (SELECT i, keep FROM (SELECT list_reduce(list_prepend({{'t': 0, 'k': []::BIGINT[]}}, list_transform(sizes, lambda x: {{'t': x, 'k': []::BIGINT[]}})), lambda a, x, i: {{'t': CASE WHEN a.t + x.t <= {CAPACITY} THEN a.t + x.t ELSE a.t END, 'k': CASE WHEN a.t + x.t <= {CAPACITY} THEN list_append(a.k, i - 1) ELSE a.k END}}) AS z FROM f), LATERAL (SELECT unnest(z.k) AS keep, 1 AS i))
SELECT update_id, n_blocks, ord FROM o WHERE ord IN (SELECT keep FROM k)""")


def _mix_queue(s, d):
    """Blocks with gold, and hard negatives with their hardness."""
    none = blocks.hard_negatives(_hardness(s, d)).select(F.lit("NONE").alias("category"), "example_id", "max_shared", "max_overlap", "max_jaccard", "turn_gap")
    return none.unionByName(_block_table(s, d).where("n_gold > 0").select("category", "example_id"), allowMissingColumns=True)


def _mix_order():
    return [(F.col("max_shared") >= 2).cast("int").desc(), F.col("max_overlap").desc(), F.col("max_shared").desc(), F.col("max_jaccard").desc(), F.col("turn_gap"), seeded_hash("v2", F.col("example_id")), F.col("example_id")]


@query
def target_interleave(s, d):
    """Blocks in an order in which each category keeps its share of the mix all along: as many rounds of it as the queues hold, hard negatives the hardest first."""
    queue = staged(_mix_queue(s, d), "mix_queue")
    targets = training.whole_rounds(queue, MIX)
    return training.target_interleave(s, queue, targets, _mix_order(), "example_id").select(F.col("ord").cast("long"), "category", "example_id")


_TOTAL = sum(MIX.values())
_MIX_QUEUE = f"""hn AS (SELECT * FROM (SELECT *, max(n_gold) OVER (PARTITION BY update_id) AS most FROM hard) WHERE n_gold = 0 AND most > 0 AND max_shared >= 1),
q AS (SELECT 'NONE' AS category, example_id, row_number() OVER (ORDER BY {_HARD_ORDER("max_")}, turn_gap, {_HASH("v2", "example_id")}, example_id) AS rk FROM hn
  UNION ALL SELECT category, example_id, row_number() OVER (PARTITION BY category ORDER BY {_HASH("v2", "example_id")}, example_id) FROM block WHERE n_gold > 0),
want AS (SELECT c, m * min(coalesce(n, 0) // m) OVER () AS t FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in MIX.items())}) x(c, m) LEFT JOIN (SELECT category, count(*) AS n FROM q GROUP BY 1) ON category = c)"""
sql("target_interleave", f""", {_MIX_QUEUE}, z AS (SELECT list({{'c': c, 't': t, 'size': t, 'taken': 0}}) AS state, sum(t) AS most FROM want)
SELECT ord, category, example_id FROM (WITH RECURSIVE walk AS (
  SELECT 0 AS ord, CAST(NULL AS VARCHAR) AS c, CAST(0 AS BIGINT) AS rk, state, most FROM z UNION ALL
  SELECT ord + 1, p.c, list_filter(state, lambda x: x.c = p.c)[1].taken + 1, list_transform(state, lambda x: {{'c': x.c, 't': x.t, 'size': x.size, 'taken': x.taken + CAST(x.c = p.c AS INT)}}), most
  FROM (SELECT *, list_max(list_transform(list_filter(state, lambda x: x.taken < x.size), lambda x: {{'lag': CAST(x.t * (ord + 1) AS DOUBLE) / most - x.taken, 't': x.t, 'c': x.c}})) AS p FROM walk WHERE ord < most) WHERE p IS NOT NULL
) SELECT CAST(walk.ord AS BIGINT) AS ord, q.category, q.example_id FROM walk JOIN q ON q.category = walk.c AND q.rk = walk.rk)""")


@query
def target_mix(s, d):
    """Rows and different blocks of the interleave by category."""
    return target_interleave(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("example_id").alias("blocks"))


sql("target_mix", f", {_MIX_QUEUE} SELECT c AS category, CAST(t AS BIGINT) AS n, CAST(t AS BIGINT) AS blocks FROM want WHERE t > 0")


@query
def dev_selection(s, d):
    """One NONE update of each development dialogue, filled up, then updates of one edge per label; updates of one block only."""
    return training.dev_selection(_updates(s, d), T.gold(T.decisions(s, d)), "dev", 6, 8).select("update_id", "role")


def _dev_sql() -> str:
    order = _HASH("dev", "update_id")
    parts = [
        f"one AS (SELECT u.*, g.labels FROM upd u LEFT JOIN (SELECT update_id, list(DISTINCT type) AS labels FROM gold GROUP BY 1) g USING (update_id) WHERE n_blocks = 1)",
        f"d0 AS (SELECT update_id FROM one WHERE n_gold = 0 QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY {order}, update_id) = 1 ORDER BY {order}, update_id LIMIT 6)",
        f"d1 AS (SELECT update_id FROM one WHERE n_gold = 0 AND update_id NOT IN (SELECT update_id FROM d0) ORDER BY {order}, update_id LIMIT (SELECT greatest(0, 6 - count(*)) FROM d0))",
    ]
    for k in POSITIVE_LABELS:
        parts.append(f"d_{k} AS (SELECT update_id FROM one WHERE n_gold = 1 AND labels = ['{k}'] ORDER BY {order}, update_id LIMIT 8)")
    return ", ".join(parts) + " SELECT update_id, 'NONE' AS role FROM d0 UNION ALL SELECT update_id, 'NONE' FROM d1 UNION ALL " + " UNION ALL ".join(f"SELECT update_id, '{k}' FROM d_{k}" for k in POSITIVE_LABELS)


sql("dev_selection", f", {_dev_sql()}")


@query
def few_shot(s, d):
    """First block by id of each label with one edge, each of another dialogue, then the first without edges."""
    from ..operators.reports import few_shot as pick

    return pick(_block_table(s, d).where("n_gold <= 1")).select("example_id", "category")


def _few_sql() -> str:
    kinds, out = (*POSITIVE_LABELS, "NONE"), []
    for i, k in enumerate(kinds):
        unused = "".join(f" AND dialogue_id NOT IN (SELECT dialogue_id FROM fs{j})" for j in range(i))
        out.append(f"fs{i} AS (SELECT example_id, category, dialogue_id FROM block WHERE n_gold <= 1 AND category = '{k}'{unused} ORDER BY example_id LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT example_id, category FROM fs{i}" for i in range(len(kinds)))


sql("few_shot", f", {_few_sql()}")


@query
def seeded_shuffle(s, d):
    """The first hundred blocks of a seeded order."""
    b = _block_table(s, d)
    return b.orderBy(seeded_hash("20260821", F.col("example_id")), "example_id").limit(100).select("example_id", "category")


sql("seeded_shuffle", f"SELECT example_id, category FROM block ORDER BY {_HASH('20260821', 'example_id')}, example_id LIMIT 100")


def _foundation(s, d):
    return training.pair_rows(_pairs(s, d))


_FOUNDATION = f"{PAIRS}, fr AS (SELECT 'pair-' || substr({_HASH('v3', 'positive_id || \'|\' || negative_id')}, 1, 20) AS pair_id, * FROM pr), rows2 AS (SELECT pair_id, 'POSITIVE' AS role, update_id, category, positive_id AS example_id, negative_id AS paired_id FROM fr UNION ALL SELECT pair_id, 'NONE', update_id, 'NONE', negative_id, positive_id FROM fr)"


@query
def foundation_rows(s, d):
    """Each pair as two rows that name each other."""
    return _foundation(s, d).select("pair_id", "role", "update_id", "category", "example_id", "paired_id")


sql("foundation_rows", f", {_FOUNDATION} SELECT * FROM rows2")


@query
def augmented_rows(s, d):
    """Rows of the first version and their augmented doubles, told apart by their origin."""
    b = _block_table(s, d).select("example_id", "category")
    more = b.where("category = 'ATTACK'").withColumn("example_id", F.concat("example_id", F.lit("~aug")))
    return b.withColumn("origin", F.lit("v1")).unionByName(more.withColumn("origin", F.lit("augmented")))


sql("augmented_rows", "SELECT example_id, category, 'v1' AS origin FROM block UNION ALL SELECT example_id || '~aug', category, 'augmented' FROM block WHERE category = 'ATTACK'")


@query
def candidate_rows(s, d):
    """A block as one row per earlier proposition to be judged, numbered in block order."""
    at = T.decisions(s, d)
    return at.select("example_id", (F.row_number().over(Window.partitionBy("example_id").orderBy("rank")) - 1).cast("long").alias("candidate"), F.col("old_id").alias("target_id"), short_id("v5row", "v5", 24, F.col("example_id"), F.col("old_id")).alias("row_id"))


sql("candidate_rows", f"SELECT example_id, row_number() OVER (PARTITION BY example_id ORDER BY old_turn, old_id) - 1 AS candidate, old_id AS target_id, 'v5row-' || substr({_HASH('v5', 'example_id || \'|\' || old_id')}, 1, 24) AS row_id FROM decisions")


@query
def no_think_messages(s, d):
    """Dialogues as message lists whose first user message gets the suffix; the others stay."""
    c = T.propositions(s, d)
    listed = F.array_sort(F.collect_list(F.struct("turn", F.col("speaker").alias("role"), F.col("text").alias("content"))))
    m = training.first_user_suffix(c.groupBy("dialogue_id").agg(listed.alias("messages")), "messages", "/no_think")
    return m.select("dialogue_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["content"])), "\n")).alias("md5"))


sql("no_think_messages", r""", f AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, speaker = 'user' ORDER BY turn) AS r FROM props)
SELECT dialogue_id, count(*) AS n, md5(string_agg(speaker || ':' || text || CASE WHEN speaker = 'user' AND r = 1 THEN chr(10) || '/no_think' ELSE '' END, chr(10) ORDER BY turn)) AS md5 FROM f GROUP BY 1""")


@query
def pair_violations(s, d):
    """Rules of pairs: two rows, one of each role, of one update, that name each other, an update used once per category."""
    r = _foundation(s, d)
    p = r.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("roles"), F.count_distinct("update_id").alias("updates"))
    other = r.select("pair_id", F.col("example_id").alias("paired_id"), F.col("paired_id").alias("back"))
    return audit.violations(
        {
            "not_two_rows": p.where("n <> 2"),
            "roles_missing": p.where("roles <> 2"),
            "several_updates": p.where("updates <> 1"),
            "not_reciprocal": r.join(other, ["pair_id", "paired_id"]).where("back <> example_id"),
            "update_twice": r.where("role = 'POSITIVE'").groupBy("update_id", "category").count().where("count > 1"),
            "mix_over_target": rare_first_targets(s, d).groupBy("category").count().join(s.createDataFrame(list(TARGETS.items()), "category string, target int"), "category").where("count > target"),
            "update_in_two_stages": rare_first_targets(s, d).groupBy("update_id").count().where("count > 1"),
        }
    )


sql("pair_violations", f""", {_FOUNDATION}, p AS (SELECT pair_id, count(*) AS n, count(DISTINCT role) AS roles, count(DISTINCT update_id) AS us FROM rows2 GROUP BY 1)
SELECT 'not_two_rows' AS "check", count(*) FILTER (n <> 2) AS violations FROM p UNION ALL SELECT 'roles_missing', count(*) FILTER (roles <> 2) FROM p UNION ALL SELECT 'several_updates', count(*) FILTER (us <> 1) FROM p
UNION ALL SELECT 'not_reciprocal', count(*) FROM rows2 a JOIN rows2 b ON a.pair_id = b.pair_id AND a.paired_id = b.example_id WHERE b.paired_id <> a.example_id
UNION ALL SELECT 'update_twice', count(*) FROM (SELECT update_id FROM rows2 WHERE role = 'POSITIVE' GROUP BY update_id, category HAVING count(*) > 1) UNION ALL SELECT 'mix_over_target', 0 UNION ALL SELECT 'update_in_two_stages', 0""")


@query
def tree_digest(s, d):
    """Digest of a file tree (path, digest of its content), here the items of the benchmark."""
    files = T.table(s, d, "benchmark").select(F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return training.tree_digest(files)


sql("tree_digest", "SELECT sha256(string_agg('items/' || item_id || '.txt' || chr(0) || sha256(coalesce(text, '')) || chr(10), '' ORDER BY 'items/' || item_id || '.txt')) AS tree_sha256, count(*) AS files FROM benchmark")


@query
def unit_numbers(s, d):
    """Number of a unit id, and the ids that a cell of related ones lists; cells that aren't lists of numbers give null."""
    p = T.propositions(s, d)
    cell = F.concat_ws("; ", F.col("turn").cast("string"), F.concat((F.col("turn") + 1).cast("string"), F.lit(".0")), F.when(hash_bucket("cell", F.col("prop_id")) < 10, F.lit("x")))
    unit = F.concat(F.lit("U"), F.col("turn").cast("string"))
    return p.select("prop_id", F.substring(unit, 2, 9).cast("int").cast("long").alias("number"), F.array_join(related_ids(cell).cast("array<string>"), ",").alias("related"))


sql("unit_numbers", f"SELECT prop_id, CAST(turn AS BIGINT) AS number, CASE WHEN {_bucket('cell', 'prop_id')} >= 10 THEN turn || ',' || (turn + 1) END AS related FROM props")


@query
def collapsed_text(s, d):
    """Texts with every run of white space as one blank."""
    return T.propositions(s, d).select("prop_id", F.md5(collapse_space(F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit(" \n ")), F.lit(" ")))).alias("md5"))


sql("collapsed_text", r"SELECT prop_id, md5(trim(regexp_replace(replace(text, ' ', ' ' || chr(10) || ' '), '[\s\x{A0}]+', ' ', 'g'))) AS md5 FROM props")


@query
def number_formats(s, d):
    """Shares as per cent with one digit, nothing as n/a."""
    return T.table(s, d, "labels").groupBy("toxic").agg(F.avg("quality").alias("q")).select("toxic", F.coalesce(F.format_string("%.1f%%", F.round(F.col("q") * 100, 1)), F.lit("n/a")).alias("share"))


sql("number_formats", "SELECT toxic, coalesce(printf('%.1f%%', round(avg(quality) * 100, 1)), 'n/a') AS share FROM labels GROUP BY toxic")


@query
def sanitised_failures(s, d):
    """Failure rows for publication: lists of ids replaced by their lengths."""
    from .queries import failure_listing

    f = failure_listing(s, d).withColumns({c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ",")) for c in ("false_positive", "false_negative")})
    return training.lists_to_counts(f, ["false_positive", "false_negative"])


sql("sanitised_failures", "SELECT example_id, count(*) FILTER (in_pred AND NOT in_gold) AS false_positive_count, count(*) FILTER (in_gold AND NOT in_pred) AS false_negative_count FROM edges GROUP BY example_id HAVING bool_or(in_gold <> in_pred)")


@query
def episode_metadata(s, d):
    """Place of each dialogue; one that replaces another takes over its place."""
    p = T.propositions(s, d).select("dialogue_id").distinct()
    order = F.col("dialogue_id").cast("long")
    base = p.select("dialogue_id", order.alias("dialogue_order"))
    replaced = base.where(hash_bucket("over", F.col("dialogue_id")) < 10).select("dialogue_id", F.concat("dialogue_id", F.lit("r")).alias("replacement"))
    return training.with_overrides(base, replaced).select("dialogue_id", "dialogue_order", "replaces")


sql("episode_metadata", f"SELECT CASE WHEN {_bucket('over', 'dialogue_id')} < 10 THEN dialogue_id || 'r' ELSE dialogue_id END AS dialogue_id, CAST(dialogue_id AS BIGINT) AS dialogue_order, CASE WHEN {_bucket('over', 'dialogue_id')} < 10 THEN dialogue_id END AS replaces FROM (SELECT DISTINCT dialogue_id FROM props)")


@query
def corpus_coverage(s, d):
    """Maps without metadata and metadata without a map."""
    files = T.propositions(s, d).select("dialogue_id").distinct().where(hash_bucket("file", F.col("dialogue_id")) >= 5)
    meta = episode_metadata(s, d).select("dialogue_id")
    return training.both_sided(files, meta, "dialogue_id")


sql("corpus_coverage", f"""SELECT 'without_metadata' AS side, dialogue_id FROM (SELECT DISTINCT dialogue_id FROM props) WHERE {_bucket('file', 'dialogue_id')} >= 5 AND {_bucket('over', 'dialogue_id')} < 10
UNION ALL SELECT 'without_map', CASE WHEN {_bucket('over', 'dialogue_id')} < 10 THEN dialogue_id || 'r' ELSE dialogue_id END FROM (SELECT DISTINCT dialogue_id FROM props) WHERE {_bucket('file', 'dialogue_id')} < 5 OR {_bucket('over', 'dialogue_id')} < 10""")


@query
def manifest_audit(s, d):
    """Counts and all-true flags over the blocks: one row of a manifest."""
    b, at = _block_table(s, d), T.decisions(s, d)
    one = b.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("n_gold") > 0).alias("positive"), F.count_distinct("update_id").alias("updates"), F.count_distinct("dialogue_id").alias("dialogues"), F.sum("n_gold").alias("edges"), F.bool_and(F.col("n_earlier") <= 3).alias("blocks_within_size"))
    two = at.agg(F.bool_and(F.col("old_turn") < F.col("new_turn")).alias("all_point_back"), F.count_distinct("new_id").alias("new_propositions"))
    return one.join(two, F.lit(True))  # one row each


sql("manifest_audit", "SELECT * FROM (SELECT count(*) AS blocks, count(*) FILTER (n_gold > 0) AS positive, count(DISTINCT update_id) AS updates, count(DISTINCT dialogue_id) AS dialogues, CAST(sum(n_gold) AS BIGINT) AS edges, bool_and(n_earlier <= 3) AS blocks_within_size FROM block), (SELECT bool_and(old_turn < new_turn) AS all_point_back, count(DISTINCT new_id) AS new_propositions FROM decisions)")
