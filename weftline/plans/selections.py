"""Queries of the later training versions: supplements, final orders, the balanced diagnostic, the ordered corpus; with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import POSITIVE_LABELS, seeded_hash
from ..operators import selection
from ..operators.ordinal import queue_heads, with_ordinal
from ..operators.training import need
from ..sources import tables as T
from ..sources.staged import staged
from .oracle import _CONTRAST, _HASH
from .queries import _block_table, _updates, contrast_cycle_v5, query
from .training import _NONE_KEYS, _POOL_V4, PAIRS, _none_order, _none_pool, _rare_sql, rare_first_targets

SQL: dict[str, str] = {}
#: The supplement in its order of categories; positives repeat once their pool is used up.
SUPPLEMENT = {"ATTACK": 115, "MIXED": 4, "REPHRASE": 43, "SUPPORT": 43}
NONE_ROWS = 24


def sql(name: str, body: str) -> None:
    SQL[name] = body


def _foundation_ids(s, d):
    pairs = staged(rare_first_targets(s, d), "foundation")
    return pairs.select("category", F.col("positive_id").alias("example_id")), pairs.select(F.col("negative_id").alias("example_id"))


def _supplement(s, d, positives, negatives):
    """(category, slot, unseen, source_rank, example_id): positives that the foundation lacks first, then NONE blocks that it lacks, the hardest first."""
    blocks = _block_table(s, d).where("n_gold > 0").select("category", "example_id")
    order = [seeded_hash("v4", F.col("example_id")), F.col("example_id")]
    more = selection.unseen_first(blocks, positives, SUPPLEMENT, order, "example_id")
    pool = staged(_none_pool(s, d).join(negatives, "example_id", "left_anti").withColumn("category", F.lit("NONE")), "none_pool")
    need({"NONE": pool.count()}, {"NONE": NONE_ROWS}, "unused blocks")
    none = queue_heads(pool, "category", _none_order(), NONE_ROWS, "example_id", "source_rank")
    return more.unionByName(none.select("category", (F.col("source_rank") - 1).cast("long").alias("slot"), F.lit(True).alias("unseen"), "source_rank", "example_id"))


@query
def supplement_v4(s, d):
    """Slots of the supplement with the block that each takes, unseen ones first."""
    return _supplement(s, d, *_foundation_ids(s, d)).select("category", "slot", "unseen", F.col("source_rank").cast("long").alias("source_rank"), "example_id")


_WANT = ", ".join(f"('{c}', {n})" for c, n in SUPPLEMENT.items())
_SUPPLEMENT = f"""{PAIRS}, fnd AS ({{rare}}),
pl AS (SELECT category, example_id, example_id IN (SELECT positive_id FROM fnd) AS met, row_number() OVER (PARTITION BY category ORDER BY {_HASH("v4", "example_id")}, example_id) AS rk FROM block WHERE n_gold > 0),
un AS (SELECT category, example_id, row_number() OVER (PARTITION BY category ORDER BY rk) AS rk FROM pl WHERE NOT met),
sz AS (SELECT category, count(*) AS n, count(*) FILTER (NOT met) AS u FROM pl GROUP BY 1),
sl AS (SELECT category, i AS slot, i < u AS unseen, CASE WHEN i < u THEN i + 1 ELSE (i - u) % n + 1 END AS source_rank FROM (VALUES {_WANT}) w(category, t) JOIN sz USING (category), LATERAL (SELECT unnest(range(t)) AS i)),
{_POOL_V4}, nn AS (SELECT example_id, row_number() OVER (ORDER BY {_NONE_KEYS}) AS rk FROM np WHERE example_id NOT IN (SELECT negative_id FROM fnd)),
sup AS (
  SELECT sl.*, example_id FROM sl JOIN un ON un.category = sl.category AND un.rk = source_rank WHERE unseen
  UNION ALL SELECT sl.*, example_id FROM sl JOIN pl ON pl.category = sl.category AND pl.rk = source_rank WHERE NOT unseen
  UNION ALL SELECT 'NONE', rk - 1, true, rk, example_id FROM nn WHERE rk <= {NONE_ROWS}
)"""


def _with_foundation() -> str:
    stages, _, chosen = _rare_sql().partition(" SELECT * FROM st0")
    return _SUPPLEMENT.replace("fnd AS ({rare})", f"{stages}, fnd AS (SELECT * FROM st0{chosen})")


sql("supplement_v4", f", {_with_foundation()} SELECT category, slot, unseen, source_rank, example_id FROM sup")


def _rows_v4(s, d):
    """Foundation rows and the supplement with their repetition, counted along foundation, then slots."""
    positives, negatives = _foundation_ids(s, d)
    more = _supplement(s, d, positives, negatives)
    first = positives.withColumn("role", F.lit("POSITIVE")).unionByName(negatives.select(F.lit("NONE").alias("category"), "example_id", F.lit("NONE").alias("role")))
    again = more.join(positives.select("example_id", F.lit(1).alias("base")), "example_id", "left").groupBy("category", "example_id", F.coalesce("base", F.lit(0)).alias("base")).agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    again = again.select("category", "example_id", F.when(F.col("category") == "NONE", "NONE").otherwise("POSITIVE").alias("role"), F.posexplode("slots").alias("k", "slot"), "base")
    out = first.select("category", "example_id", "role", F.lit("V3_FOUNDATION").alias("source_stage"), F.lit(0).cast("long").alias("repetition"))
    out = out.unionByName(again.select("category", "example_id", "role", F.lit("V4_CLASS_BALANCE").alias("source_stage"), (F.col("base") + F.col("k")).cast("long").alias("repetition")))
    key = seeded_hash("v4", F.col("example_id"), F.col("source_stage"), F.col("repetition"))
    return out.withColumn("row_id", F.concat(F.lit("v4row-"), F.substring(key, 1, 24)))


_ROWS_V4 = f"""{_with_foundation()}, rv AS (
  SELECT category, positive_id AS example_id, 'POSITIVE' AS role, 'V3_FOUNDATION' AS source_stage, 0 AS repetition FROM fnd UNION ALL SELECT 'NONE', negative_id, 'NONE', 'V3_FOUNDATION', 0 FROM fnd
  UNION ALL SELECT category, example_id, CASE WHEN category = 'NONE' THEN 'NONE' ELSE 'POSITIVE' END, 'V4_CLASS_BALANCE',
    row_number() OVER (PARTITION BY example_id ORDER BY slot) - 1 + CAST(example_id IN (SELECT positive_id FROM fnd) AS INT) FROM sup
), ri AS (SELECT *, 'v4row-' || substr({_HASH("v4", "example_id || '|' || source_stage || '|' || repetition")}, 1, 24) AS row_id FROM rv)"""


@query
def shuffled_rows_v4(s, d):
    """All rows of the version in their final order, by the seeded hash of the row id."""
    out = with_ordinal(_rows_v4(s, d), [seeded_hash("v4", F.col("row_id")), F.col("row_id")], "place")
    return out.select("place", "row_id", "example_id", "category", "role", "source_stage", "repetition")


sql("shuffled_rows_v4", f", {_ROWS_V4} SELECT row_number() OVER (ORDER BY {_HASH('v4', 'row_id')}, row_id) AS place, row_id, example_id, category, role, source_stage, CAST(repetition AS BIGINT) AS repetition FROM ri")


@query
def foundation_and_supplement(s, d):
    """Rows and different blocks of each stage and category."""
    return _rows_v4(s, d).groupBy("source_stage", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("example_id").alias("examples"), F.count_if(F.col("repetition") > 0).alias("copies"))


sql("foundation_and_supplement", f", {_ROWS_V4} SELECT source_stage, category, count(*) AS n, count(DISTINCT example_id) AS examples, count(*) FILTER (repetition > 0) AS copies FROM ri GROUP BY ALL")


@query
def shuffled_pairs_v5(s, d):
    """Contrasts in the seeded order of their pair ids, each as a POSITIVE and a NONE row, one after the other."""
    c = contrast_cycle_v5(s, d)
    pair = seeded_hash("v5", F.col("example_id"), F.col("positive_id"), F.col("label"), F.col("negative_id"), F.col("repetition"))
    at = with_ordinal(c.withColumn("pair_id", F.concat(F.lit("v5pair-"), F.substring(pair, 1, 24))), [seeded_hash("v5", F.col("pair_id")), F.col("pair_id")])
    ends = F.array(F.struct(F.lit(1).alias("k"), F.lit("POSITIVE").alias("role"), F.col("positive_id").alias("target")), F.struct(F.lit(0).alias("k"), F.lit("NONE").alias("role"), F.col("negative_id").alias("target")))
    return at.select("ordinal", "pair_id", "example_id", F.explode(ends).alias("e")).select((F.col("ordinal") * 2 - F.col("e.k")).alias("place"), "pair_id", "example_id", "e.role", "e.target")


_PAIR_ID = "'v5pair-' || substr(" + _HASH("v5", "example_id || '|' || positive_id || '|' || label || '|' || negative_id || '|' || repetition") + ", 1, 24)"
sql("shuffled_pairs_v5", f""", {_CONTRAST}, po AS (SELECT *, row_number() OVER (ORDER BY {_HASH("v5", "pair_id")}, pair_id) AS o FROM (SELECT *, {_PAIR_ID} AS pair_id FROM con))
SELECT 2 * o - 1 AS place, pair_id, example_id, 'POSITIVE' AS role, positive_id AS target FROM po UNION ALL SELECT 2 * o, pair_id, example_id, 'NONE', negative_id FROM po""")


def _diagnostic(s, d):
    """Updates of one block and of one relation or none, and the quotas of all dialogues."""
    one = _block_table(s, d).join(_updates(s, d).where("n_blocks = 1 AND n_gold <= 1").select("update_id"), "update_id").select("dialogue_id", "update_id", F.col("category").alias("role"))
    return one, selection.diagnostic_quotas(T.propositions(s, d).select("dialogue_id").distinct(), [F.col("dialogue_id").cast("long")])


@query
def balanced_diagnostic(s, d):
    """Updates of one block up to the quotas of their dialogue: one of each label, two of one label by turns, one without relations."""
    return selection.balanced_diagnostic(*_diagnostic(s, d), "diagnostic", strict=False).select("dialogue_id", "role", "update_id", F.col("rank").cast("long"))


@query
def diagnostic_shortages(s, d):
    """Dialogues and roles with fewer updates than their quota, which a strict selection refuses."""
    return selection.diagnostic_shortages(*_diagnostic(s, d)).select("dialogue_id", "role", F.col("quota").cast("long"), "eligible")


_ROLES = ", ".join(f"('{k}', {i})" for i, k in enumerate((*POSITIVE_LABELS, "NONE")))
_DIAGNOSTIC = f"""dq AS (SELECT dialogue_id, role, CASE WHEN (row_number() OVER (PARTITION BY role ORDER BY CAST(dialogue_id AS BIGINT)) - 1) % 3 = j THEN 2 ELSE 1 END AS quota FROM (SELECT DISTINCT dialogue_id FROM props), (VALUES {_ROLES}) r(role, j)),
du AS (SELECT b.dialogue_id, b.update_id, b.category AS role FROM block b JOIN upd u USING (update_id) WHERE u.n_blocks = 1 AND u.n_gold <= 1)"""
sql("balanced_diagnostic", f", {_DIAGNOSTIC} SELECT dialogue_id, role, update_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY dialogue_id, role ORDER BY {_HASH('diagnostic', 'update_id')}, update_id) AS rank FROM du) JOIN dq USING (dialogue_id, role) WHERE rank <= quota")
sql("diagnostic_shortages", f", {_DIAGNOSTIC} SELECT dialogue_id, role, CAST(quota AS BIGINT) AS quota, coalesce(n, 0) AS eligible FROM dq LEFT JOIN (SELECT dialogue_id, role, count(*) AS n FROM du GROUP BY ALL) USING (dialogue_id, role) WHERE coalesce(n, 0) < quota")


@query
def ordered_corpus(s, d):
    """All propositions in the order of their dialogue, turn and id, numbered."""
    return with_ordinal(T.propositions(s, d), [F.col("dialogue_id").cast("long"), F.col("turn"), F.col("prop_id")], "place").select("place", "prop_id")


sql("ordered_corpus", "SELECT row_number() OVER (ORDER BY CAST(dialogue_id AS BIGINT), turn, prop_id) AS place, prop_id FROM props")
