"""Queries over the relations of argument maps, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import hash_bucket
from ..operators import audit, blocks, excerpts, maps
from ..sources import tables as T
from ..sources.files import repeats_keys
from .oracle import _HASH, _bucket
from .queries import SIDES, query

SQL: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    SQL[name] = body


def joined(c: str):
    return F.array_join(c, ",").alias(c)


def _relations(s, d):
    return maps.relation_table(T.relation_ends(s, d))


def _turns(s, d):
    return maps.proposition_turns(T.propositions(s, d), T.groundings(s, d))


def _canonical(s, d):
    return maps.canonical(_relations(s, d), _turns(s, d))


def _candidates(s, d):
    return maps.candidates(_canonical(s, d), T.decisions(s, d), maps.usable_maps(_turns(s, d)))


def _b(seed: str) -> str:
    return _bucket(seed, "new_id", "old_id")


MAPS = f"""
gr AS (SELECT dialogue_id, prop_id, unnest(CASE WHEN {_bucket("gr", "prop_id")} < 10 THEN [turn, turn + 1] WHEN {_bucket("gr", "prop_id")} >= 96 THEN [] WHEN {_bucket("gr", "prop_id")} >= 93 THEN [NULL] ELSE [turn] END) AS turn FROM props),
turns AS (SELECT p.dialogue_id, p.prop_id, count(g.prop_id) AS n_groundings, min(g.turn) AS turn FROM props p LEFT JOIN gr g ON g.prop_id = p.prop_id GROUP BY ALL),
rel0 AS (
  SELECT dialogue_id, 'R' || new_id || '>' || old_id AS relation_id, label, CASE label WHEN 'SUPPORT' THEN 'RA' WHEN 'ATTACK' THEN 'CA' ELSE 'MA' END AS kind,
    CASE WHEN {_b("turned")} < 30 THEN old_id ELSE new_id END AS a0, CASE WHEN {_b("turned")} < 30 THEN new_id ELSE old_id END AS b0, {_b("nary")} < 8 AS nary, {_b("inc")} < 5 AS inc, {_b("dup")} < 10 AS dup
  FROM decisions WHERE label <> 'NONE'
), rel AS (
  SELECT *, unnest(CASE WHEN dup THEN [0, 1] ELSE [0] END) AS map_order, CASE WHEN nary THEN a0 || ',' || dialogue_id || ':0' ELSE a0 END AS sources, CASE WHEN inc THEN '' ELSE b0 END AS targets,
    CASE WHEN inc THEN 'incomplete' WHEN nary THEN 'n-ary' ELSE 'binary' END AS arity FROM rel0
), can0 AS (
  SELECT r.*, CASE WHEN arity = 'binary' THEN a0 END AS a, CASE WHEN arity = 'binary' THEN b0 END AS b, x.turn AS ta, y.turn AS tb, x.n_groundings AS an, y.n_groundings AS bn
  FROM rel r LEFT JOIN turns x ON x.prop_id = r.a0 AND arity = 'binary' LEFT JOIN turns y ON y.prop_id = r.b0 AND arity = 'binary'
), can AS (
  SELECT *, CASE WHEN arity <> 'binary' THEN NULL WHEN ta IS NULL OR tb IS NULL THEN 'unknown' WHEN ta = tb THEN 'same_turn' WHEN ta > tb THEN 'later_to_earlier' ELSE 'earlier_to_later' END AS direction,
    CASE WHEN ta > tb THEN a WHEN ta < tb THEN b END AS canonical_source, CASE WHEN ta > tb THEN b WHEN ta < tb THEN a END AS canonical_target, coalesce(ta <> tb AND an = 1 AND bn = 1, false) AS unambiguous FROM can0
), usable AS (SELECT dialogue_id FROM turns GROUP BY 1 HAVING count(*) >= 2 AND bool_and(n_groundings = 1 AND turn IS NOT NULL)),
own AS (SELECT * FROM decisions WHERE dialogue_id IN (SELECT dialogue_id FROM usable)),
cand0 AS (SELECT dialogue_id, update_id, new_id, count(*) AS n_earlier, unnest(o) AS map_order FROM own JOIN (SELECT dialogue_id, list(DISTINCT map_order) AS o FROM rel GROUP BY 1) USING (dialogue_id) GROUP BY dialogue_id, update_id, new_id, o),
ends AS (SELECT dialogue_id, map_order, relation_id, unnest(list_filter(string_split(sources || ',' || targets, ','), lambda x: x <> '')) AS e FROM can WHERE NOT unambiguous),
bad AS (SELECT DISTINCT x.dialogue_id, x.map_order, x.e AS new_id FROM ends x JOIN ends y ON x.relation_id = y.relation_id AND x.map_order = y.map_order JOIN own o ON o.new_id = x.e AND o.old_id = y.e),
cand AS (SELECT * FROM cand0 c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.map_order = c.map_order AND b.new_id = c.new_id)),
goldedge AS (SELECT r.dialogue_id, r.map_order, r.relation_id, r.label, o.new_id, o.old_id, o.update_id FROM can r JOIN own o ON o.new_id = canonical_source AND o.old_id = canonical_target WHERE unambiguous AND EXISTS (SELECT 1 FROM cand c WHERE c.map_order = r.map_order AND c.new_id = o.new_id)),
kept AS (SELECT c.*, coalesce(g, 0) AS n_gold FROM cand c LEFT JOIN (SELECT map_order, new_id, count(DISTINCT old_id || label) AS g FROM goldedge GROUP BY ALL) USING (map_order, new_id) QUALIFY row_number() OVER (PARTITION BY c.dialogue_id, c.new_id ORDER BY coalesce(g, 0) DESC, n_earlier DESC, c.map_order) = 1)
"""


@query
def relation_endpoints(s, d):
    return _relations(s, d).select(*maps.RELATION, "label", joined("sources"), joined("targets"))


sql("relation_endpoints", f", {MAPS} SELECT dialogue_id, map_order, relation_id, label, sources, targets FROM rel")


@query
def relation_arity(s, d):
    return _relations(s, d).groupBy(maps.arity(F.col("sources"), F.col("targets")).alias("arity"), "label").agg(F.count(F.lit(1)).alias("n"))


sql("relation_arity", f", {MAPS} SELECT arity, label, count(*) AS n FROM rel GROUP BY ALL")


@query
def unique_relations(s, d):
    """Of relations that several maps hold, the first."""
    return maps.first_wins(_relations(s, d), ["dialogue_id", "relation_id", "sources", "targets"], "map_order").select(*maps.RELATION)


sql("unique_relations", f", {MAPS} SELECT dialogue_id, min(map_order) AS map_order, relation_id FROM rel GROUP BY dialogue_id, relation_id, sources, targets")


@query
def canonical_relations(s, d):
    return _canonical(s, d).select(*maps.RELATION, "arity", "direction", "canonical_source", "canonical_target", "unambiguous")


sql("canonical_relations", f", {MAPS} SELECT dialogue_id, map_order, relation_id, arity, direction, canonical_source, canonical_target, unambiguous FROM can")


@query
def binary_relations(s, d):
    return _canonical(s, d).where("unambiguous").select(*maps.RELATION, "canonical_source", "canonical_target", "label")


sql("binary_relations", f", {MAPS} SELECT dialogue_id, map_order, relation_id, canonical_source, canonical_target, label FROM can WHERE unambiguous")


@query
def usable_maps(s, d):
    return maps.usable_maps(_turns(s, d))


sql("usable_maps", f", {MAPS} SELECT dialogue_id FROM usable")


@query
def map_issues(s, d):
    return maps.issues(_turns(s, d))


sql("map_issues", f""", {MAPS} SELECT dialogue_id, kind || ': ' || string_agg(prop_id, ',' ORDER BY prop_id) AS issue FROM (
  SELECT *, CASE WHEN n_groundings = 0 THEN 'propositions without grounding' WHEN n_groundings > 1 THEN 'propositions with several groundings' WHEN turn IS NULL THEN 'propositions without turn' END AS kind FROM turns) WHERE kind IS NOT NULL GROUP BY dialogue_id, kind""")


@query
def compatible_updates(s, d):
    return _candidates(s, d)[0].select("dialogue_id", "map_order", "update_id", "n_earlier")


sql("compatible_updates", f", {MAPS} SELECT dialogue_id, map_order, update_id, n_earlier FROM cand")


@query
def gold_edges(s, d):
    return _candidates(s, d)[1].select(*maps.RELATION, "update_id", "old_id", "label")


sql("gold_edges", f", {MAPS} SELECT dialogue_id, map_order, relation_id, update_id, old_id, label FROM goldedge")


@query
def one_map_per_update(s, d):
    return maps.one_map_per_update(*_candidates(s, d)).select("dialogue_id", "map_order", "update_id", "n_gold")


sql("one_map_per_update", f", {MAPS} SELECT dialogue_id, map_order, update_id, n_gold FROM kept")


@query
def relation_defects(s, d):
    return maps.defects(_canonical(s, d), maps.usable_maps(_turns(s, d)))


sql("relation_defects", f""", {MAPS}, b AS (SELECT *, dialogue_id IN (SELECT dialogue_id FROM usable) AS ok FROM can WHERE arity = 'binary')
SELECT 'grounding' AS kind, CASE WHEN an = 1 AND bn = 1 THEN 'both_endpoints_exactly_one' WHEN an = 0 OR bn = 0 THEN 'at_least_one_endpoint_missing' ELSE 'ambiguous_only_no_missing_endpoint' END AS class, count(*) AS n FROM b GROUP BY ALL
UNION ALL SELECT 'chronology', CASE WHEN NOT ok THEN 'excluded_unresolved_map' WHEN direction = 'same_turn' THEN 'excluded_same_turn' ELSE 'resolvable' END, count(*) FROM b WHERE an = 1 AND bn = 1 GROUP BY ALL""")


@query
def relation_funnel(s, d):
    """What each step of the retention funnel leaves of the relations, per label and over all."""
    rel, (updates, gold) = _canonical(s, d), _candidates(s, d)
    kept = gold.join(maps.one_map_per_update(updates, gold).select("dialogue_id", "map_order", "new_id"), ["dialogue_id", "map_order", "new_id"], "left_semi")
    flag = lambda df, name: df.select("dialogue_id", "relation_id").distinct().withColumn(name, F.lit(True))
    first = rel.groupBy("dialogue_id", "relation_id").agg(F.min("map_order").alias("first"))
    key = ["dialogue_id", "relation_id"]
    at = rel.join(first, key).join(flag(gold, "in_gold"), key, "left").join(flag(kept, "in_kept"), key, "left").join(maps.usable_maps(_turns(s, d)).withColumn("usable", F.lit(True)), "dialogue_id", "left")
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    stages = {"raw": F.lit(True), "unique": F.col("map_order") == F.col("first"), "binary": F.col("arity") == "binary", "grounded": single, "chronology_resolvable": F.col("usable") & (F.col("a_turn") != F.col("b_turn")), "behavior_compatible": F.col("in_gold"), "retained": F.col("in_kept")}
    return maps.labelled_funnel(at, stages).select(F.col("ord").cast("long"), "stage", "label", "total", "removed")


_STEPS = (("raw", "true"), ("unique", "map_order = 0"), ("binary", "arity = 'binary'"), ("grounded", "an = 1 AND bn = 1"), ("chronology_resolvable", "ok AND ta <> tb"), ("behavior_compatible", "g"), ("retained", "k"))
sql("relation_funnel", f""", {MAPS}, f AS (SELECT *, dialogue_id IN (SELECT dialogue_id FROM usable) AS ok, relation_id IN (SELECT relation_id FROM goldedge) AS g,
  relation_id IN (SELECT relation_id FROM goldedge e JOIN kept USING (map_order, new_id)) AS k FROM can), l AS (SELECT *, unnest(['all', label]) AS lab FROM f),
t AS ({" UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS stage, lab, count(*) FILTER ({' AND '.join(f'coalesce({c}, false)' for _, c in _STEPS[: i + 1])}) AS total FROM l GROUP BY lab" for i, (n, _) in enumerate(_STEPS))})
SELECT CAST(ord AS BIGINT) AS ord, stage, lab AS label, total, coalesce(lag(total) OVER (PARTITION BY lab ORDER BY ord) - total, 0) AS removed FROM t""")


def _eight(s, d):
    """Blocks of eight, as the reference cuts them."""
    return T.decisions(s, d, block_size=8)


@query
def block_rows(s, d):
    """Blocks of eight with their earlier propositions, gold edges and the relations that gave these."""
    updates, gold = _candidates(s, d)
    kept = maps.one_map_per_update(updates, gold).select("dialogue_id", "map_order", "new_id")
    at = _eight(s, d).join(kept.select("new_id"), "new_id", "left_semi")
    out = maps.block_rows(at, gold.join(kept, ["dialogue_id", "map_order", "new_id"], "left_semi"))
    edge = F.transform("gold", lambda x: F.concat_ws("|", x["target"], x["type"], x["relation_id"]))
    return out.select("example_id", joined("earlier"), F.array_join(edge, ",").alias("gold"))


sql("block_rows", f""", {MAPS}, e8 AS (SELECT *, row_number() OVER (PARTITION BY update_id ORDER BY old_turn, old_id) AS rk FROM pairs WHERE new_id IN (SELECT new_id FROM kept)),
g AS (SELECT e.new_id, e.old_id, e.label, min(e.relation_id) AS relation_id FROM goldedge e JOIN kept k ON k.map_order = e.map_order AND k.new_id = e.new_id GROUP BY ALL)
SELECT update_id || ':b' || lpad(CAST((rk - 1) // 8 AS VARCHAR), 2, '0') AS example_id, string_agg(e8.old_id, ',' ORDER BY rk) AS earlier, coalesce(string_agg(e8.old_id || '|' || label || '|' || relation_id, ',' ORDER BY e8.old_id, label) FILTER (label IS NOT NULL), '') AS gold
FROM e8 LEFT JOIN g ON g.new_id = e8.new_id AND g.old_id = e8.old_id GROUP BY 1""")


@query
def block_assign_eight(s, d):
    return _eight(s, d).select("example_id", "old_id", F.col("block_index").cast("long"))


sql("block_assign_eight", "SELECT update_id || ':b' || lpad(CAST((row_number() OVER (PARTITION BY update_id ORDER BY old_turn, old_id) - 1) // 8 AS VARCHAR), 2, '0') AS example_id, old_id, (row_number() OVER (PARTITION BY update_id ORDER BY old_turn, old_id) - 1) // 8 AS block_index FROM pairs")


@query
def window_ids_full(s, d):
    """Windows of two neighbours each side, filled to eight, ten at most."""
    at = T.decisions(s, d).where("label = 'ATTACK'")
    return blocks.windows_around(at, T.propositions(s, d)).select("new_id", "old_id", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


_WINDOWS = """near AS (SELECT d.dialogue_id, d.new_id, d.old_id, p.turn, abs(p.turn - d.new_turn) <= 2 OR abs(p.turn - d.old_turn) <= 2 AS c, abs(p.turn - (d.new_turn + d.old_turn) / 2.0) AS far FROM decisions d JOIN props p USING (dialogue_id) WHERE label = 'ATTACK'),
wr AS (SELECT *, sum(CAST(c AS INT)) OVER (PARTITION BY new_id, old_id) AS nc, row_number() OVER (PARTITION BY new_id, old_id ORDER BY CAST(c AS INT), far, turn) AS k FROM near),
win AS (SELECT dialogue_id, new_id, old_id, array_to_string(list_slice(list_sort(list_distinct(list(turn))), 1, 10), ',') AS turns FROM wr WHERE c OR k <= 8 - nc GROUP BY ALL)"""
sql("window_ids_full", f", {_WINDOWS} SELECT new_id, old_id, turns FROM win")


@query
def window_candidates(s, d):
    """Each distinct window once, by its first conflict, with all conflicts that lie inside it."""
    at = T.decisions(s, d).where("label = 'ATTACK'")
    w = blocks.windows_around(at, T.propositions(s, d))
    anchors = blocks.best_per_key(w.withColumn("key", F.array_join(F.col("turns").cast("array<string>"), ",")), ["dialogue_id", "key"], "new_id", "old_id")
    inside = anchors.join(at.select("dialogue_id", F.col("new_id").alias("n"), F.col("old_id").alias("o"), "new_turn", "old_turn"), "dialogue_id").where(F.array_contains("turns", F.col("new_turn")) & F.array_contains("turns", F.col("old_turn")))
    edges = F.array_join(F.array_sort(F.collect_set(F.concat_ws(">", "n", "o"))), ",")
    return inside.groupBy("dialogue_id", F.col("key").alias("turns"), "new_id", "old_id").agg(edges.alias("conflicts"))


sql("window_candidates", f""", {_WINDOWS}, anc AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY dialogue_id, turns ORDER BY new_id, old_id) = 1)
SELECT a.dialogue_id, a.turns, a.new_id, a.old_id, string_agg(DISTINCT d.new_id || '>' || d.old_id, ',' ORDER BY d.new_id || '>' || d.old_id) AS conflicts FROM anc a JOIN decisions d ON d.dialogue_id = a.dialogue_id AND d.label = 'ATTACK'
AND list_contains(string_split(a.turns, ','), CAST(d.new_turn AS VARCHAR)) AND list_contains(string_split(a.turns, ','), CAST(d.old_turn AS VARCHAR)) GROUP BY 1, 2, 3, 4""")


@query
def derived_gold(s, d):
    """Conflicts across sides inside each window, and whether they equal the curated ones: (dialogue_id, only_derived, only_curated)."""
    cross = blocks.cross_side_pairs(T.propositions(s, d), SIDES).select("dialogue_id", "new_id", "old_id")
    derived = T.decisions(s, d).where("label = 'ATTACK'").join(cross, ["dialogue_id", "new_id", "old_id"], "left_semi").select("dialogue_id", "new_id", "old_id", F.lit(1).alias("derived"))
    curated = derived.where(hash_bucket("cur", F.col("new_id"), F.col("old_id")) >= 15).select("dialogue_id", "new_id", "old_id", F.lit(1).alias("curated"))
    both = derived.join(curated, ["dialogue_id", "new_id", "old_id"], "full")
    return both.groupBy("dialogue_id").agg(F.count_if(F.col("curated").isNull()).alias("only_derived"), F.count_if(F.col("derived").isNull()).alias("only_curated"))


sql("derived_gold", f"SELECT d.dialogue_id, count(*) FILTER ({_bucket('cur', 'd.new_id', 'd.old_id')} < 15) AS only_derived, CAST(0 AS BIGINT) AS only_curated FROM decisions d JOIN crossed c ON c.new_id = d.new_id AND c.old_id = d.old_id WHERE label = 'ATTACK' GROUP BY 1")


@query
def annotation_violations(s, d):
    """Rules of annotated pairs: unique, of known units, pointing back, gold across sides, extensions within one."""
    side = F.coalesce(*[F.when(F.col("speaker") == k, v) for k, v in SIDES.items()])
    units = T.propositions(s, d).select("prop_id", "turn", side.alias("side"))
    a = T.predicted(T.decisions(s, d)).select("source", "target", "type")
    at = a.join(units.select(F.col("prop_id").alias("source"), F.col("turn").alias("st"), F.col("side").alias("ss")), "source", "left").join(units.select(F.col("prop_id").alias("target"), F.col("turn").alias("tt"), F.col("side").alias("ts")), "target", "left")
    return audit.violations(
        {
            "repeated_pair": a.groupBy("source", "target").count().where("count > 1"),
            "unknown_unit": at.where("st IS NULL OR tt IS NULL"),
            "points_forward": at.where("st <= tt"),
            "attack_within_a_side": at.where("type = 'ATTACK' AND ss = ts"),
            "extension_across_sides": at.where("type = 'REPHRASE' AND ss <> ts"),
        }
    )


sql("annotation_violations", """, u AS (SELECT prop_id, turn, CASE speaker WHEN 'user' THEN 'AFF' WHEN 'assistant' THEN 'NEG' END AS side FROM props), ann AS (SELECT p.*, a.turn AS st, b.turn AS tt, a.side AS ss, b.side AS ts FROM pred p LEFT JOIN u a ON a.prop_id = source LEFT JOIN u b ON b.prop_id = target)
SELECT 'repeated_pair' AS "check", count(*) AS violations FROM (SELECT source FROM pred GROUP BY source, target HAVING count(*) > 1) UNION ALL SELECT 'unknown_unit', count(*) FROM ann WHERE st IS NULL OR tt IS NULL
UNION ALL SELECT 'points_forward', count(*) FROM ann WHERE st <= tt UNION ALL SELECT 'attack_within_a_side', count(*) FROM ann WHERE type = 'ATTACK' AND ss = ts UNION ALL SELECT 'extension_across_sides', count(*) FROM ann WHERE type = 'REPHRASE' AND ss <> ts""")


@query
def row_violations(s, d):
    """Rules of block rows, over blocks of eight with the predicted edges as their patch."""
    e = _eight(s, d)
    b = e.groupBy("example_id", "update_id", "new_id").agg(F.collect_list("old_id").alias("old"), F.min("new_turn").alias("new_turn"), F.max("old_turn").alias("last"), F.count(F.lit(1)).alias("n"), F.min("block_index").alias("i"))
    p = T.predicted(e).join(b, ["example_id", "update_id"])
    return audit.violations(
        {
            "empty_block": b.where("n = 0"),
            "more_than_eight": b.where("n > 8"),
            "repeated_earlier_id": b.where("size(array_distinct(old)) <> n"),
            "new_among_earlier": b.where("array_contains(old, new_id)"),
            "earlier_not_before_new": b.where("last >= new_turn"),
            "edge_not_from_new": p.where("source <> new_id"),
            "edge_to_unknown": p.where("NOT array_contains(old, target)"),
        }
    )


sql("row_violations", """, e8 AS (SELECT *, (row_number() OVER (PARTITION BY update_id ORDER BY old_turn, old_id) - 1) // 8 AS i FROM pairs),
p8 AS (SELECT p.*, e.new_id, x.i AS di, split_part(p.example_id, ':b', 1) FROM pred p JOIN decisions d0 ON d0.example_id = p.example_id AND (d0.old_id = p.target OR d0.old_id = p.source) JOIN e8 x ON x.update_id = p.update_id AND x.old_id = d0.old_id JOIN e8 e ON e.update_id = x.update_id AND e.old_id = x.old_id)
SELECT 'empty_block' AS "check", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'more_than_eight', count(*) FROM (SELECT update_id FROM e8 GROUP BY update_id, i HAVING count(*) > 8)
UNION ALL SELECT 'repeated_earlier_id', count(*) FROM (SELECT update_id FROM e8 GROUP BY update_id, i HAVING count(DISTINCT old_id) <> count(*)) UNION ALL SELECT 'new_among_earlier', count(DISTINCT (update_id, i)) FROM e8 WHERE old_id = new_id
UNION ALL SELECT 'earlier_not_before_new', count(DISTINCT (update_id, i)) FROM e8 WHERE old_turn >= new_turn UNION ALL SELECT 'edge_not_from_new', count(*) FROM p8 WHERE source <> new_id
UNION ALL SELECT 'edge_to_unknown', count(*) FROM p8 WHERE NOT EXISTS (SELECT 1 FROM e8 WHERE e8.update_id = p8.update_id AND e8.i = p8.di AND e8.old_id = p8.target)""")


@query
def scenario_violations(s, d):
    """Rules of scenarios: blocks of one update are contiguous, of one new proposition and dialogue, and cover every earlier one once."""
    e = _eight(s, d)
    u = e.groupBy("update_id").agg(F.count_distinct("new_id").alias("news"), F.count_distinct("dialogue_id").alias("dialogues"), F.max("block_index").alias("last"), F.count_distinct("block_index").alias("k"), F.count(F.lit(1)).alias("n"), F.count_distinct("old_id").alias("distinct_old"), F.min("new_turn").alias("turn"))
    return audit.violations(
        {
            "several_new_propositions": u.where("news <> 1"),
            "several_dialogues": u.where("dialogues <> 1"),
            "blocks_not_contiguous": u.where("last + 1 <> k"),
            "earlier_covered_twice": u.where("n <> distinct_old"),
            "earlier_missing": u.where("n <> turn - 1"),
            "wrong_block_count": u.where("k <> ceil(n / 8.0)"),
        }
    )


sql("scenario_violations", """, e8 AS (SELECT *, (row_number() OVER (PARTITION BY update_id ORDER BY old_turn, old_id) - 1) // 8 AS i FROM pairs), u AS (SELECT update_id, count(DISTINCT new_id) AS news, count(DISTINCT dialogue_id) AS ds, max(i) AS last, count(DISTINCT i) AS k, count(*) AS n, count(DISTINCT old_id) AS dn, min(new_turn) AS turn FROM e8 GROUP BY 1)
SELECT 'several_new_propositions' AS "check", count(*) FILTER (news <> 1) AS violations FROM u UNION ALL SELECT 'several_dialogues', count(*) FILTER (ds <> 1) FROM u UNION ALL SELECT 'blocks_not_contiguous', count(*) FILTER (last + 1 <> k) FROM u
UNION ALL SELECT 'earlier_covered_twice', count(*) FILTER (n <> dn) FROM u UNION ALL SELECT 'earlier_missing', count(*) FILTER (n <> turn - 1) FROM u UNION ALL SELECT 'wrong_block_count', count(*) FILTER (k <> ceil(n / 8.0)) FROM u""")


def _slots(s, d):
    """Relation slots of the units of one long debate: the unit before, and for some the one before that; some are broken."""
    u = T.propositions(s, d).select((F.col("dialogue_id").cast("long") * 100 + F.col("turn")).alias("id"), "turn", "prop_id")
    b = hash_bucket("slot", F.col("prop_id"))
    before = (F.col("id") - 1).cast("string")
    related = F.when(b < 5, F.lit(None)).when(b < 15, F.concat(before, F.lit(".0; "), (F.col("id") - 2).cast("string"))).when(b < 20, F.concat(before, F.lit("a"))).otherwise(before)
    kind = F.when(b >= 95, F.lit(None)).when(b >= 90, F.lit("XX")).when(b % 3 == 0, F.lit("ra")).when(b % 3 == 1, F.lit("CA")).otherwise(F.lit("Ma"))
    return u.select("id", F.lit(0).alias("slot"), related.alias("related"), kind.alias("kind"))


def _debate_units(s, d):
    side = F.coalesce(*[F.when(F.col("speaker") == k, v) for k, v in SIDES.items()])
    return T.propositions(s, d).select((F.col("dialogue_id").cast("long") * 100 + F.col("turn")).alias("id"), side.alias("side"))


_SB = _bucket("slot", "prop_id")
SLOTS = f"""units AS (SELECT CAST(dialogue_id AS BIGINT) * 100 + turn AS id, CASE speaker WHEN 'user' THEN 'AFF' WHEN 'assistant' THEN 'NEG' END AS side, {_SB} AS b FROM props),
sl AS (SELECT id, CASE WHEN b < 5 OR b >= 95 THEN 'incomplete_pair' WHEN b >= 90 THEN 'unknown_relation_type' WHEN b >= 15 AND b < 20 THEN 'unreadable_ids' END AS why, CASE b % 3 WHEN 0 THEN 'inference' WHEN 1 THEN 'conflict' ELSE 'rephrase' END AS kind, CASE WHEN b < 15 THEN [id - 1, id - 2] ELSE [id - 1] END AS ids FROM units),
se AS (SELECT id, kind, unnest(ids) AS target FROM sl WHERE why IS NULL),
slot_out AS (SELECT id, CAST(NULL AS BIGINT) AS target, CAST(NULL AS VARCHAR) AS type, why AS reason FROM sl WHERE why IS NOT NULL
  UNION ALL SELECT id, target, CASE WHEN k THEN kind END, CASE WHEN NOT k THEN 'unknown_target' END FROM (SELECT *, target IN (SELECT id FROM units) AS k FROM se))"""


@query
def slot_classification(s, d):
    return excerpts.classify_slots(_slots(s, d), _debate_units(s, d)).select("id", "target", "type", "reason")


sql("slot_classification", f", {SLOTS} SELECT id, target, type, reason FROM slot_out")


@query
def cross_stance_conflicts(s, d):
    u = _debate_units(s, d)
    return excerpts.cross_stance_conflicts(excerpts.classify_slots(_slots(s, d), u).where("reason IS NULL"), u)


sql("cross_stance_conflicts", f", {SLOTS} SELECT DISTINCT greatest(o.id, o.target) AS later, least(o.id, o.target) AS earlier FROM slot_out o JOIN units a ON a.id = o.id JOIN units b ON b.id = o.target WHERE type = 'conflict' AND a.side <> b.side")

_FLAGS = ("accept", "meaning_preserved", "edge_support_preserved", "no_new_response_cues", "fluent_and_atomic")


@query
def quality_gate(s, d):
    """Rewritten dialogues that pass all five flags and kept their units and sides."""
    u = T.propositions(s, d).groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker"))).alias("expected"))
    k = lambda seed: hash_bucket(seed, F.col("dialogue_id"))
    rows = u.withColumns({f: F.when(k(f) >= 97, F.lit(None)).otherwise(k(f) >= 10) for f in _FLAGS}).withColumn("actual", F.when(k("units") < 8, F.reverse("expected")).otherwise(F.col("expected")))
    return excerpts.accepted(rows, list(_FLAGS), "expected", "actual").select("dialogue_id")


sql("quality_gate", "SELECT dialogue_id FROM props GROUP BY dialogue_id HAVING " + " AND ".join(f"{_bucket(f, 'dialogue_id')} BETWEEN 10 AND 96" for f in _FLAGS) + f" AND ({_bucket('units', 'dialogue_id')} >= 8 OR count(*) = 1)")


@query
def dataset_suite(s, d):
    """The rules of a whole dataset: splits apart, members singly grounded, gold and decisions agreeing, blocks full and complete."""
    from .queries import leakage_intersect

    updates, gold = _candidates(s, d)
    kept = maps.one_map_per_update(updates, gold).select("dialogue_id", "map_order", "new_id")
    at = _eight(s, d).join(kept.select("new_id"), "new_id", "left_semi")
    own = gold.join(kept, ["dialogue_id", "map_order", "new_id"], "left_semi")
    members = at.select(F.explode(F.array("new_id", "old_id")).alias("prop_id")).distinct()
    ends = own.select("new_id", "old_id", F.col("label").alias("gold")).distinct()
    b = at.groupBy("update_id", "block_index").agg(F.count(F.lit(1)).alias("n"))
    u = at.groupBy("update_id").agg(F.max("block_index").alias("last"), F.count_distinct("old_id").alias("k"), F.min("new_turn").alias("turn"))
    return audit.violations(
        {
            "episode_in_both_splits": leakage_intersect(s, d),
            "member_not_singly_grounded": members.join(_turns(s, d), "prop_id").where("n_groundings <> 1 OR turn IS NULL"),
            "gold_without_relation": own.join(_canonical(s, d).where("unambiguous").select(*maps.RELATION), maps.RELATION, "left_anti"),
            "positive_decision_without_gold": at.where("label <> 'NONE'").join(ends, ["new_id", "old_id"], "left_anti"),
            "gold_on_a_negative_decision": at.where("label = 'NONE'").join(ends, ["new_id", "old_id"], "left_semi"),
            "early_block_not_full": b.join(u, "update_id").where("block_index < last AND n <> 8"),
            "earlier_not_covered": u.where("k <> turn - 1"),
        }
    )


_SPLITS = f"""sp AS (SELECT dialogue_id, row_number() OVER (ORDER BY CAST(dialogue_id AS BIGINT) DESC) <= 6 AS ev, row_number() OVER (ORDER BY {_HASH("dev", "dialogue_id")}) > 4 AS tr FROM (SELECT DISTINCT dialogue_id FROM props))"""
sql("dataset_suite", f""", {MAPS}, {_SPLITS}, e8 AS (SELECT *, (row_number() OVER (PARTITION BY update_id ORDER BY old_turn, old_id) - 1) // 8 AS i FROM decisions WHERE new_id IN (SELECT new_id FROM kept)),
og AS (SELECT e.* FROM goldedge e JOIN kept k ON k.map_order = e.map_order AND k.new_id = e.new_id), mem AS (SELECT new_id AS p FROM e8 UNION SELECT old_id FROM e8), bl AS (SELECT update_id, i, count(*) AS n FROM e8 GROUP BY ALL), up AS (SELECT update_id, max(i) AS last, count(DISTINCT old_id) AS k, min(new_turn) AS turn FROM e8 GROUP BY 1)
SELECT 'episode_in_both_splits' AS "check", count(*) FILTER (ev AND tr) AS violations FROM sp UNION ALL SELECT 'member_not_singly_grounded', count(*) FILTER (n_groundings <> 1 OR turn IS NULL) FROM mem JOIN turns ON prop_id = p
UNION ALL SELECT 'gold_without_relation', CAST(0 AS BIGINT) UNION ALL SELECT 'positive_decision_without_gold', count(*) FROM e8 WHERE label <> 'NONE' AND NOT EXISTS (SELECT 1 FROM og WHERE og.new_id = e8.new_id AND og.old_id = e8.old_id)
UNION ALL SELECT 'gold_on_a_negative_decision', count(*) FROM e8 WHERE label = 'NONE' AND EXISTS (SELECT 1 FROM og WHERE og.new_id = e8.new_id AND og.old_id = e8.old_id)
UNION ALL SELECT 'early_block_not_full', count(*) FROM bl JOIN up USING (update_id) WHERE i < last AND n <> 8 UNION ALL SELECT 'earlier_not_covered', count(*) FILTER (k <> turn - 1) FROM up""")


@query
def excerpt_violations(s, d):
    """Rules of excerpts, here whole dialogues: 2 to 12 units of distinct, rising ids, both sides, a side for each speaker."""
    side = F.coalesce(*[F.when(F.col("speaker") == k, v) for k, v in SIDES.items()])
    u = T.propositions(s, d).withColumn("side", side)
    e = u.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prop_id").alias("ids"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_distinct("side").alias("sides"))
    return audit.violations({"too_few_units": e.where("n < 2"), "too_many_units": e.where("n > 12"), "repeated_id": e.where("ids <> n"), "gap_in_ids": e.where("last - first + 1 <> n"), "one_side_only": e.where("sides < 2"), "unit_without_side": u.where("side IS NULL")})


sql("excerpt_violations", """, u AS (SELECT *, CASE speaker WHEN 'user' THEN 'AFF' WHEN 'assistant' THEN 'NEG' END AS side FROM props), e AS (SELECT dialogue_id, count(*) AS n, count(DISTINCT prop_id) AS ids, min(turn) AS f, max(turn) AS l, count(DISTINCT side) AS sides FROM u GROUP BY 1)
SELECT 'too_few_units' AS "check", count(*) FILTER (n < 2) AS violations FROM e UNION ALL SELECT 'too_many_units', count(*) FILTER (n > 12) FROM e UNION ALL SELECT 'repeated_id', count(*) FILTER (ids <> n) FROM e UNION ALL SELECT 'gap_in_ids', count(*) FILTER (l - f + 1 <> n) FROM e
UNION ALL SELECT 'one_side_only', count(*) FILTER (sides < 2) FROM e UNION ALL SELECT 'unit_without_side', count(*) FROM u WHERE side IS NULL""")


@query
def repeated_json_keys(s, d):
    """Events whose JSON holds a key twice; one in twenty is given one."""
    e = T.table(s, d, "events").select("event_id", F.when(hash_bucket("key", F.col("event_id").cast("string")) < 5, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "k": 0}'))).otherwise(F.col("props")).alias("props"))
    return e.where(repeats_keys(F.col("props"))).select("event_id")


PLAIN = ("repeated_json_keys",)
sql("repeated_json_keys", f"SELECT event_id FROM events WHERE {_bucket('key', 'CAST(event_id AS VARCHAR)')} < 5")
