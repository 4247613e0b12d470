"""The reference model over the driver's tables.

Dialogues come from ``conversations``; these hold no argument edges, so labels,
predictions and scores are drawn from seeded hashes.  They are fixtures that
give every operator something to do, not annotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import POSITIVE_LABELS, hash_bucket
from ..operators.blocks import assign_blocks, earlier_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialogue_id, prop_id, turn from 1, speaker, text)."""
    c = table(spark, sf_dir, "conversations")
    dialogue = F.col("conv_id").cast("string")
    return c.select(dialogue.alias("dialogue_id"), F.concat_ws(":", dialogue, F.col("turn").cast("string")).alias("prop_id"), (F.col("turn") + 1).alias("turn"), F.col("role").alias("speaker"), "text")


def gold_label(new_id: Column, old_id: Column) -> Column:
    b = hash_bucket("g", new_id, old_id)
    return F.when(b < 5, "ATTACK").when(b < 15, "REPHRASE").when(b < 30, "SUPPORT").otherwise("NONE")


def decisions(spark: SparkSession, sf_dir: str, block_size: int = 3) -> DataFrame:
    """Each (new, earlier) pair with its block and gold label."""
    pairs = assign_blocks(earlier_pairs(propositions(spark, sf_dir)), block_size)
    return pairs.withColumn("label", gold_label(F.col("new_id"), F.col("old_id")))


def predicted(d: DataFrame) -> DataFrame:
    """Predicted edges (example_id, update_id, source, target, type): most gold ones, some relabelled, reversed, dropped or invented."""
    b = hash_bucket("p", F.col("new_id"), F.col("old_id"))
    other = F.when(F.col("label") == "SUPPORT", "ATTACK").when(F.col("label") == "ATTACK", "REPHRASE").otherwise("SUPPORT")
    positive = F.col("label") != "NONE"
    kind = F.when(positive & (b < 60), F.col("label")).when(positive & (b < 75), other).when(positive & (b < 85), F.col("label")).when(~positive & (b < 3), "SUPPORT").when(~positive & (b < 5), "ATTACK")
    reverse = positive & (b >= 75)
    out = d.withColumn("type", kind).where("type IS NOT NULL")
    return out.select("example_id", "update_id", F.when(reverse, F.col("old_id")).otherwise(F.col("new_id")).alias("source"), F.when(reverse, F.col("new_id")).otherwise(F.col("old_id")).alias("target"), "type")


def gold(d: DataFrame) -> DataFrame:
    return d.where("label <> 'NONE'").select("example_id", "update_id", F.col("new_id").alias("source"), F.col("old_id").alias("target"), F.col("label").alias("type"))


def scores(d: DataFrame) -> DataFrame:
    """``d`` with a score per label (hundredths) that leans towards the gold label."""
    lean = lambda k: F.when(F.col("label") == k, 60).otherwise(0)
    return d.withColumns({f"s_{k.lower()}": (hash_bucket(k, F.col("new_id"), F.col("old_id")) + lean(k)) / F.lit(100.0) for k in ("NONE", *POSITIVE_LABELS)})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument-map nodes drawn from dialogues: a locution L, an illocution YA and a proposition I per turn."""
    p = propositions(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(i).alias("k")) for i, k in enumerate(("L", "YA", "I"))])
    return p.select("dialogue_id", "turn", F.explode(kinds).alias("n")).select("dialogue_id", F.concat(F.col("n.type"), F.col("turn").cast("string")).alias("node_id"), F.col("n.type").alias("type"), ((F.col("turn") - 1) * 3 + F.col("n.k")).alias("node_index"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of those maps: L to YA to I, and L to TA to the next L; one turn in ten is grounded twice, one loops."""
    p = propositions(spark, sf_dir)
    t = F.col("turn").cast("string")
    b = hash_bucket("e", F.col("prop_id"))
    edge = lambda a, c: F.struct(a.alias("src"), c.alias("dst"))
    L, YA, I = F.concat(F.lit("L"), t), F.concat(F.lit("YA"), t), F.concat(F.lit("I"), t)  # noqa: E741
    TA, N = F.concat(F.lit("TA"), t), F.concat(F.lit("L"), (F.col("turn") + 1).cast("string"))
    base = F.array(edge(L, YA), edge(YA, I), edge(L, TA), edge(TA, F.when(b >= 95, L).otherwise(N)))
    out = F.when(b < 10, F.array_append(base, edge(L, YA))).otherwise(base)
    return p.select("dialogue_id", F.explode(out).alias("e")).select("dialogue_id", "e.src", "e.dst")


def groundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialogue_id, prop_id, turn): one row a proposition, two for one in ten, none for one in twenty-five, some without a turn."""
    p = propositions(spark, sf_dir)
    b = hash_bucket("gr", F.col("prop_id"))
    turns = F.when(b < 10, F.array(F.col("turn"), F.col("turn") + 1)).when(b >= 96, F.array().cast("array<bigint>")).when(b >= 93, F.array(F.lit(None).cast("bigint"))).otherwise(F.array(F.col("turn").cast("bigint")))
    return p.select("dialogue_id", "prop_id", F.explode(turns).alias("turn"))


def relation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of relation nodes (dialogue_id, map_order, relation_id, kind, edge_index, role, prop_id).

    A relation for each labelled pair; some point forward, have a second source
    or lack their target, and one in ten stands in a second map too.
    """
    d = decisions(spark, sf_dir).where("label <> 'NONE'")
    bucket = lambda seed: hash_bucket(seed, F.col("new_id"), F.col("old_id"))
    kind = F.when(F.col("label") == "SUPPORT", "RA").when(F.col("label") == "ATTACK", "CA").otherwise("MA")
    turned = bucket("turned") < 30
    first, last = F.when(turned, F.col("old_id")).otherwise(F.col("new_id")), F.when(turned, F.col("new_id")).otherwise(F.col("old_id"))
    end = lambda role, prop: F.struct(F.lit(role).alias("role"), prop.alias("prop_id"))
    ends = F.array(end("source", first))
    ends = F.when(bucket("nary") < 8, F.array_append(ends, end("source", F.concat("dialogue_id", F.lit(":0"))))).otherwise(ends)
    ends = F.when(bucket("inc") >= 5, F.array_append(ends, end("target", last))).otherwise(ends)
    orders = F.explode(F.when(bucket("dup") < 10, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("map_order")
    at = d.select("dialogue_id", F.concat(F.lit("R"), "new_id", F.lit(">"), "old_id").alias("relation_id"), kind.alias("kind"), ends.alias("ends"), orders)
    return at.select("dialogue_id", "map_order", "relation_id", "kind", F.posexplode("ends").alias("edge_index", "e")).select("dialogue_id", "map_order", "relation_id", "kind", "edge_index", "e.role", "e.prop_id")


PROVIDERS, PROMPTS = ("mini", "small"), ("zero", "few", "rules")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each (provider, prompt) to each block: raw_response, and raw_judge, both JSON with some faults."""
    at = decisions(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(q).alias("prompt")) for p in PROVIDERS for q in PROMPTS])).alias("c")
    every = at.select("example_id", "update_id").distinct().select("example_id", "update_id", cells).select("example_id", "update_id", "c.provider", "c.prompt")
    told = predicted(at).groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "type"))).alias("r"))
    b = lambda seed: hash_bucket(seed, F.col("provider"), F.col("prompt"), F.col("example_id"))
    item = lambda x: F.concat(F.lit('{"source":"'), x["source"], F.lit('","target":"'), x["target"], F.lit('","type":"'), x["type"], F.lit('"}'))
    body = F.concat(F.lit('{"relations":['), F.coalesce(F.when(b("drop") >= 10, F.array_join(F.transform("r", item), ",")), F.lit("")), F.lit("]"))
    raw = F.concat(body, F.when(b("json") < 3, "").when(b("json") < 8, ',"note":1}').otherwise("}"))
    fault = b("valid")
    reason = F.when(fault == 5, "").otherwise("clear")
    rob = F.when(fault == 6, F.lit("5")).otherwise((b("rob") % 5).cast("string"))
    judge = F.concat(F.lit('{"spec_adherence":'), (b("spec") % 5).cast("string"), F.lit(',"robustness":'), rob, F.lit(',"brief_reason":"'), reason, F.lit('"'), F.when(fault < 5, "").when(fault == 7, ',"x":1}').otherwise("}"))
    return every.join(told, "example_id", "left").select("provider", "prompt", "example_id", "update_id", raw.alias("raw_response"), judge.alias("raw_judge"))


# What a debate excerpt and a pair without a response may be marked with.
PHENOMENA = ("local_direct", "long_distance", "branching", "response_chain", "rephrase_trap", "same_side_extension_trap", "topical_distractor", "dropped_argument", "cross_application")
HARD_NEGATIVES = ("topical_nonresponse", "same_side_extension", "repetition_or_rephrase", "independent_counterargument")


def _unit(prop: str) -> Column:
    return F.concat(F.lit("U"), (F.split(prop, ":")[1].cast("long") + 1).cast("string"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, category, split, phenomena, gold, hard): dialogues as excerpts whose units respond to earlier ones.

    gold is a set of (source, target); hard has (phenomenon, source, target) of pairs without a response.
    """
    at = decisions(spark, sf_dir).withColumns({"source": _unit("new_id"), "target": _unit("old_id"), "b": hash_bucket("hn", F.col("new_id"), F.col("old_id"))})
    kind = F.get(F.array(*map(F.lit, HARD_NEGATIVES)), F.col("b") % 4)
    pairs = at.groupBy("dialogue_id").agg(
        F.collect_list(F.when(F.col("label") != "NONE", F.struct("source", "target"))).alias("gold"),
        F.collect_list(F.when((F.col("label") == "NONE") & (F.col("b") < 40), F.struct(kind.alias("phenomenon"), "source", "target"))).alias("hard"),
    )
    d = lambda seed: hash_bucket(seed, F.col("dialogue_id"))
    marks = F.filter(F.array(*[F.when((d("ph") + 7 * i) % 10 < 3, p) for i, p in enumerate(PHENOMENA)]), lambda x: x.isNotNull())
    category = F.when(d("cat") < 50, "vivesdebate_real").when(d("cat") < 75, "synthetic_dropped_argument").otherwise("synthetic_cross_application")
    return pairs.select(F.col("dialogue_id").alias("scenario_id"), category.alias("category"), F.when(d("split") < 60, "development").otherwise("heldout_test").alias("split"), marks.alias("phenomena"), "gold", "hard")


def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each (provider, prompt) to each excerpt, some fenced, some broken, and what a judge says of most of them.

    The judge sees the answer without its fence; some of its verdicts are
    turned, some miss edges, some lack scores, some aren't of the form.
    """
    told = predicted(decisions(spark, sf_dir)).groupBy(F.split("update_id", "/")[0].alias("scenario_id")).agg(F.array_sort(F.collect_set(F.struct(_unit("source").alias("source"), _unit("target").alias("target")))).alias("told"))
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(q).alias("prompt")) for p in PROVIDERS for q in PROMPTS])).alias("c")
    e = excerpts(spark, sf_dir).select("scenario_id", "gold", cells).select("scenario_id", "gold", "c.*").join(told, "scenario_id", "left")
    b = lambda seed: hash_bucket(seed, F.col("provider"), F.col("prompt"), F.col("scenario_id"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    said = F.when(b("drop1") < 30, F.filter("gold", lambda x: x.isNotNull())).when(b("drop1") < 40, none).otherwise(F.coalesce("told", none))
    pair = lambda more: lambda x: F.concat(F.lit('{"source":"'), x["source"], F.lit('","target":"'), x["target"], F.lit('"' + more + "}"))
    listed = lambda edges, more="": F.concat(F.lit("["), F.array_join(F.transform(edges, pair(more)), ","), F.lit("]"))
    e = e.withColumn("said", said).withColumn("f", b("form1"))
    body = F.concat(F.lit('{"relations":'), listed(F.col("said"), ',"type":"responds_to"'))
    raw = F.when(F.col("f") < 5, body).when(F.col("f") < 15, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(F.col("f") < 20, F.concat(body, F.lit(',"note":1}'))).otherwise(F.concat(body, F.lit("}")))
    seen = F.when((F.col("f") < 5) | F.col("f").between(15, 19), none).otherwise(F.col("said"))
    e = e.withColumns({"raw_response": raw, "missed": F.array_except("gold", seen), "spurious": F.array_except(seen, F.col("gold"))})
    right = (F.size("missed") == 0) & (F.size("spurious") == 0) & ((F.col("f") >= 20) | F.col("f").between(5, 14))
    verdict = F.when(right != (b("turn1") < 10), "correct").otherwise("incorrect")
    scores = F.when(b("rubric1") < 30, "").otherwise(F.concat(F.lit('"spec_adherence":'), (b("spec1") % 5).cast("string"), F.lit(',"robustness":'), (b("rob1") % 5).cast("string"), F.lit(",")))
    missed = F.when(b("blind1") < 20, none).otherwise(F.col("missed"))
    judge = F.concat(F.lit("{"), scores, F.lit('"assessment":"'), verdict, F.lit('","missed_edges":'), listed(missed), F.lit(',"spurious_edges":'), listed(F.col("spurious")), F.when(b("valid1") < 8, "}").otherwise(',"brief_reason":"seen"}'))
    return e.select("provider", "prompt", "scenario_id", "raw_response", F.when(b("asked1") >= 10, judge).alias("raw_judge"))
