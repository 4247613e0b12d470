"""Orders, queue heads and the selections of the later versions against plain loops."""

from __future__ import annotations

import hashlib
import inspect
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F


def seeded(seed, *key):
    return hashlib.sha256("|".join((seed, *map(str, key))).encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_ordinal_is_the_row_number(spark, parts):
    from weftline.operators.ordinal import with_ordinal

    rng = random.Random(parts)
    rows = [(i, rng.choice(("a", "b", None)), rng.choice((None, 0.5, -1.0, 7.25)), f"k{rng.randrange(10**6)}-{i}") for i in range(700)]
    rows += [(1000 + i, "hot", 1.0, f"h{i}") for i in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "id long, g string, x double, k string").repartition(parts)
        got = {r.id: r.n for r in with_ordinal(df, [F.col("x").desc(), F.col("k")], "n").collect()}
        own = {r.id: r.n for r in with_ordinal(df, [F.col("x").desc(), F.col("k")], "n", ("g",)).collect()}
        assert with_ordinal(df.limit(0), [F.col("k")]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[3]))
    assert got == {r[0]: i for i, r in enumerate(order, 1)}
    place = Counter()
    for r in order:
        place[r[1]] += 1
        assert own[r[0]] == place[r[1]]


def test_queue_heads_meet_only_as_heads(spark):
    from weftline.operators.ordinal import queue_heads

    rows = [(("a", "b")[i % 10 == 0], seeded("s", i), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "category string, h string, id long")
    out = queue_heads(df, "category", [F.col("h")], 7, "id")
    want = {(c, r[2], i) for c in "ab" for i, r in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: r[1])[:7], 1)}
    assert {(r["category"], r.id, r["rank"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [row_number()" in line]
    assert len(windows) == 2 and "_share" in windows[1]  # the window over a whole queue comes after the one over its shares


def replay_supplement(pool, seen, targets):
    out = []
    for category, target in targets.items():
        own = sorted((x for x in pool if x[0] == category), key=lambda x: (seeded("v4", x[1]), x[1]))
        chosen = [x for x in own if x[1] not in seen][:target]
        i = 0
        while len(chosen) < target:
            chosen.append(own[i % len(own)])
            i += 1
        out += [(category, k, x[1]) for k, x in enumerate(chosen)]
    return out


@pytest.mark.parametrize(("targets", "share"), [({"ATTACK": 25, "MIXED": 3, "SUPPORT": 40}, 0.3), ({"ATTACK": 4, "MIXED": 30}, 1.0), ({"SUPPORT": 9, "MIXED": 0}, 0.0)])
def test_unseen_come_first(spark, targets, share):
    from weftline.functions.text import seeded_hash
    from weftline.operators.selection import unseen_first

    rng = random.Random(4)
    pool = [(c, f"{c}{i}") for c, n in (("ATTACK", 7), ("MIXED", 4), ("SUPPORT", 30)) for i in range(n)]
    seen = {x[1] for x in pool if rng.random() < share}
    df, met = spark.createDataFrame(pool, "category string, id string"), spark.createDataFrame([(x,) for x in seen] * 2, "id string")
    got = unseen_first(df, met, targets, [seeded_hash("v4", F.col("id")), F.col("id")], "id")
    assert sorted((r["category"], r.slot, r.id) for r in got.collect()) == sorted(replay_supplement(pool, seen, targets))


def test_empty_pools_and_short_queues_are_errors(spark):
    from weftline.operators.selection import unseen_first
    from weftline.operators.training import rare_first, target_interleave, whole_rounds

    df = spark.createDataFrame([("A", "x", "u1"), ("A", "y", "u2"), ("B", "z", "u3")], "category string, id string, update_id string")
    with pytest.raises(ValueError, match="no rows of C"):
        unseen_first(df, df.select("id").limit(0), {"A": 1, "C": 2}, [F.col("id")], "id")
    with pytest.raises(ValueError, match="1 of 2 B"):
        target_interleave(spark, df, {"A": 2, "B": 2}, [F.col("id")], "id")
    assert target_interleave(spark, df, {"A": 2, "B": 2}, [F.col("id")], "id", strict=False).count() == 3
    assert [r.id for r in target_interleave(spark, df, {"A": 2, "B": 1}, [F.col("id")], "id").orderBy("ord").collect()] == ["x", "z", "y"]
    with pytest.raises(ValueError, match="2 of 3 A"):
        rare_first(df, {"B": 1, "A": 3}, [F.col("id")], strict=True)
    assert whole_rounds(df, {"A": 1, "B": 1}) == {"A": 1, "B": 1} and whole_rounds(df, {"A": 1, "C": 1}) == {"A": 0, "C": 0}


def test_balanced_diagnostic(spark):
    from weftline.operators.selection import balanced_diagnostic, diagnostic_quotas

    labels = ("SUPPORT", "ATTACK", "REPHRASE", "NONE")
    rows = [(f"d{e}", f"u{e}-{role}-{i}", role) for e in range(6) for role in labels for i in range(5)]
    updates = spark.createDataFrame(rows, "dialogue_id string, update_id string, role string")
    quotas = diagnostic_quotas(updates.select("dialogue_id").distinct(), [F.col("dialogue_id")])
    got = [(r.dialogue_id, r["role"], r.update_id) for r in balanced_diagnostic(updates, quotas, "s").collect()]
    assert Counter(r[1] for r in got) == {"SUPPORT": 8, "ATTACK": 8, "REPHRASE": 8, "NONE": 6}
    assert set(Counter(r[0] for r in got).values()) == {5}
    own = defaultdict(list)
    for d, u, role in rows:
        own[d, role].append(u)
    for e in range(6):
        for i, role in enumerate(labels):
            n = 1 + (role != "NONE" and e % 3 == i)
            assert sorted(u for d, r, u in got if (d, r) == (f"d{e}", role)) == sorted(sorted(own[f"d{e}", role], key=lambda u: seeded("s", u))[:n])
    short = updates.where("update_id NOT LIKE 'u4-ATTACK%' OR update_id = 'u4-ATTACK-1'")
    with pytest.raises(ValueError, match="1 of 2 ATTACK in d4"):
        balanced_diagnostic(short, quotas, "s")
    assert balanced_diagnostic(short, quotas, "s", strict=False).count() == 29


def test_fold_stays_off_the_driver():
    from weftline.operators import ordinal, training

    assert not any("toLocalIterator" in inspect.getsource(m) for m in (ordinal, training))
