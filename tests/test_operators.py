from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F


def test_strict_parse_cases():
    from weftline.functions.parsing import parse_patch

    edge = {"source": "a", "target": "b", "type": "SUPPORT"}
    cases = {
        '{"relations": []}': (True, True, 0),
        '```json\n{"relations": []}\n```': (False, False, 0),
        '{"relations": [], "x": 1}': (True, False, 0),
        json.dumps({"relations": [edge | {"type": "responds_to"}]}): (True, False, 0),
        json.dumps({"relations": [edge, edge]}): (True, False, 2),
        json.dumps({"relations": [edge, edge | {"source": 2}]}): (True, False, 1),
        "[]": (True, False, 0),
        "null": (True, False, 0),
        '{"relations": []} trailing': (False, False, 0),
        json.dumps({"relations": [edge]}): (True, True, 1),
    }
    for raw, (valid, schema, n) in cases.items():
        got = parse_patch(raw)
        assert (got[0], got[1], len(got[2])) == (valid, schema, n), raw
    assert parse_patch(None) == (False, False, [])


def test_interleave_schedule():
    from weftline.operators.selection import interleave_schedule

    out = interleave_schedule({"A": 0.5, "B": 0.3, "C": 0.2}, {"A": 100, "B": 100, "C": 1}, 10)
    assert [c for _, c, _ in out[:3]] == ["A", "B", "C"]
    assert sum(c == "C" for _, c, _ in out) == 1 and len(out) == 10
    assert [r for _, c, r in out if c == "A"] == list(range(1, sum(c == "A" for _, c, _ in out) + 1))
    assert interleave_schedule({"A": 1.0}, {}, 5) == []


def test_alternating_fold_skips_and_goes_on(spark):
    """Against the plain loop: by turns while both last, the rest after; what would overrun is skipped."""
    import hashlib
    import random

    from pyspark.sql import functions as F

    from weftline.operators.training import alternating_fold

    rng = random.Random(2)
    rows = [(f"u{i}", rng.random() < 0.4, rng.randrange(1, 6)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, pos boolean, n long")
    queues = [sorted((r for r in rows if r[1] is kind), key=lambda r: hashlib.sha256(f"s|{r[0]}".encode()).hexdigest()) for kind in (True, False)]
    order = [q[i] for i in range(60) for q in queues if i < len(q)]
    for capacity in (0, 7, 30, 10_000):
        total, want = 0, []
        for r in order:
            if total + r[2] <= capacity:
                total += r[2]
                want.append(r[0])
        got = alternating_fold(df, F.col("pos"), "n", capacity, "s", "id").orderBy("ord").collect()
        assert [r.id for r in got] == want


def test_patches_of_any_ids(spark):
    """Answers put together from decisions are read back as they were, whatever the ids hold."""
    from pyspark.sql import functions as F

    from weftline.functions.parsing import parse_patch
    from weftline.operators.maps import pairwise_patch

    ids = ['a"b', "c\\d", "line\nbreak", "tab\t", "é“", "plain", "</x>"]
    labels = ["SUPPORT", "NONE", "ATTACK", "REPHRASE", "SUPPORT", "NONE", "ATTACK"]
    rows = [(source, list(zip(ids, labels, strict=True))) for source in ids] + [("none", [("a", "NONE")]), ("empty", [])]
    df = spark.createDataFrame(rows, "source string, d array<struct<target: string, label: string>>")
    got = dict(df.select("source", pairwise_patch(F.col("source"), F.col("d"))).collect())
    for source, decided in rows:
        valid, of_schema, relations = parse_patch(got[source])
        assert valid and of_schema
        assert relations == [{"source": source, "target": t, "type": k} for t, k in decided if k != "NONE"]
    assert got["none"] == got["empty"] == '{"relations":[]}'


def test_gates_need_every_metric(spark):
    from weftline.operators import gates

    one = spark.createDataFrame([(0.9, 0.9, 0.0)], "edge_f1 double, relation_macro_f1 double, false_edges_per_update double")
    with pytest.raises(ValueError, match="update_count"):
        gates.check_thresholds(one, gates.RELIABILITY, [])
    full = one.selectExpr("*", *[f"CAST({30 if m == 'update_count' else None if m == 'direction_accuracy' else 1 if up else 0} AS DOUBLE) AS {m}".replace("None", "NULL") for m, up, _ in gates.RELIABILITY if m not in one.columns])
    checks = {r.check: r.passed for r in gates.check_thresholds(full, gates.RELIABILITY, []).collect()}
    assert len(checks) == 12 and [k for k, ok in checks.items() if not ok] == ["direction_accuracy", "judge_spec_adherence_mean", "judge_robustness_mean"]
    assert (len(gates.DEVELOPMENT), len(gates.PROMOTION)) == (7, 9)


def test_gate_verdict_needs_the_whole_matrix(spark):
    from weftline.operators.gates import gate_verdict

    def status(cells):
        return gate_verdict(spark.createDataFrame(cells, "provider string, prompt string, clears boolean, complete boolean"), ("a", "b"), ("x", "y")).head()

    whole = [(p, q, False, True) for p in "ab" for q in "xy"]
    assert status(whole).status == "PASS"
    assert status(whole[:3]).status == "FAIL" and not status([*whole[:3], ("b", "z", False, True)]).measurement_complete
    assert status([*whole[:3], ("b", "y", True, True)]).bar_clearing == "b:y"
    assert status([*whole[:3], ("b", "y", False, False)]).status == "FAIL"


def test_judge_answers_are_strict():
    from weftline.functions.parsing import parse_assessment

    def told(spec=3, robustness=4, reason="clear", **more):
        return json.dumps({"spec_adherence": spec, "robustness": robustness, "brief_reason": reason, **more})

    assert parse_assessment(told()) == (3, 4) and parse_assessment(told(0, 0)) == (0, 0) and parse_assessment(told(reason="x" * 600)) == (3, 4)
    assert parse_assessment(told("2", 3.0)) == (2, 3) and parse_assessment(told(True, 4)) == (1, 4)
    for bad in (None, "", "[]", "null", told(5), told(-1), told(2.5), told("x"), told(None), told(reason=""), told(reason="x" * 601), told(reason=3), told(x=1), told() + " ok", '{"spec_adherence": 3, "robustness": 4}', f"```json\n{told()}\n```"):
        assert parse_assessment(bad) == (None, None), bad


def test_each_kind_of_secret_is_found(spark):
    from weftline.plans.queries import SECRETS

    key = "A1b2C3d4E5f6G7h8"
    planted = [f"see AKIA{key} there", f"sk-{key}", f"(hf_{key})", f"ghp_{key}{key}", f"api_key = '{key}'", f"access-key:{key}", f"PRIVATE_KEY={key}", f"my secret: {key}", f'token="{key}"', f"Password = {key}"]
    clean = [f"task_{key}", "the key is under the mat", "token: short", f"desk-{key}", "a secret that nobody of us would tell", f"riskAKIA{key}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(planted + clean)], "i int, text string")
    assert {r.i for r in df.where(F.col("text").rlike(SECRETS)).collect()} == set(range(len(planted)))


def test_first_user_suffix(spark):
    from weftline.operators.training import first_user_suffix

    m = [("system", "s"), ("user", "u"), ("user", "v")]
    df = spark.createDataFrame([(1, m), (2, [("system", "s")]), (3, [])], "id int, messages array<struct<role: string, content: string>>")
    got = {r.id: [x.content for x in r.messages] for r in first_user_suffix(df, "messages", "/no_think").collect()}
    assert got == {1: ["s", "u\n/no_think", "v"], 2: ["s"], 3: []}


def test_topological_order_with_cycle(spark):
    from weftline.operators.audit import topological_order

    nodes = spark.createDataFrame([("m", x, i) for i, x in enumerate("edcbaxy")], "dialogue_id string, node_id string, node_index long")
    before = spark.createDataFrame([("m", "a", "b"), ("m", "b", "e"), ("m", "x", "y"), ("m", "y", "x"), ("m", "c", "c")], "dialogue_id string, from_id string, to_id string")
    rows = sorted(topological_order(nodes, before).collect(), key=lambda r: r.turn)
    assert "".join(r.node_id for r in rows) == "dcabexy"
    assert [r.node_id for r in rows if r.in_cycle] == ["x", "y"]


def test_text_functions(spark):
    from weftline.functions.text import calibrated_label, content_tokens, speaker_of, unfence

    df = spark.createDataFrame([("Ann : hi: x", "```JSON\n{}\n```", "The cat AND the 42nd cats of ab"), ("Bob: y", "x ```json {} ```", ""), (" : z", "```\n{}```", "a1b2"), ("none", "{}", "you")], "s string, r string, t string")
    rows = df.select(speaker_of(F.col("s")), unfence(F.col("r")), content_tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["Ann", "Bob", None, None]
    assert [r[1] for r in rows] == ["{}", "x ```json {} ```", "{}", "{}"]
    assert [r[2] for r in rows] == [["42nd", "cat", "cats"], [], ["a1b2"], []]
    s = spark.createDataFrame([(0.5, 0.7, 0.7, 0.1), (0.5, 0.5, 0.2, 0.1), (0.0, 0.1, 0.2, 0.3)], "n double, a double, b double, c double")
    label = calibrated_label({"SUPPORT": F.col("a"), "ATTACK": F.col("b"), "REPHRASE": F.col("c")}, F.col("n"), F.lit(0.0))
    assert [r[0] for r in s.select(label).collect()] == ["SUPPORT", "NONE", "REPHRASE"]


def test_files(spark, tmp_path):
    from weftline.sources import files

    (tmp_path / "maps").mkdir()
    nodes = [{"nodeID": "1", "text": "a", "type": "L"}, {"nodeID": "2", "text": "b", "type": "I"}, {"nodeID": "2", "text": "c", "type": "I"}]
    records = [{"nodeID": "1", "personID": "p", "start": "x", "timestamp": "y"}, {"nodeID": "1", "personID": "q", "start": "x", "timestamp": "y"}, {"nodeID": "2", "personID": "p"}]
    (tmp_path / "maps" / "m7.json").write_text(json.dumps({"nodes": nodes, "edges": [{"edgeID": "1", "fromID": "1", "toID": "9"}], "locutions": records}))
    t = files.read_nodesets(spark, str(tmp_path / "maps"))
    assert [tuple(r)[:3] for r in t["locutions"].collect()] == [("m7", "1", "p")]
    assert sorted(r.defect for r in t["defects"].collect()) == ["dangling edge", "repeated locution", "repeated node", "stray locution"]

    (tmp_path / "d.csv").write_text("ID,TEAM STANCE,ADU_EN,ADU_ES,REL,REL.1,KIND,KIND.1\n1, favour ,, hola  que ,2;3.0,,RA,\n2,NONE,x,,,,,\n3,AGAINST,y,,x,1,CA,RA\n")
    d = files.read_debates(spark, str(tmp_path / "d.csv"))
    assert [(r.ID, r.side, r.text) for r in d.collect()] == [("1", "AFF", "hola que"), ("3", "NEG", "y")]
    slots = files.relation_slots(d, "ID", "REL", "KIND").withColumn("ids", files.related_ids(F.col("related")))
    assert [(r.id, r.slot, r.ids, r.kind) for r in slots.collect()] == [("1", 0, [2, 3], "RA"), ("3", 0, None, "CA"), ("3", 1, [1], "RA")]

    out = str(tmp_path / "out")
    files.write_ordered_jsonl(spark.range(5).withColumn("x", F.lit(None).cast("string")), ["id"], out)
    assert files.read_jsonl(spark, out, "id long, x string").count() == 5
    found = files.file_digests(spark, out).where("path LIKE '%.json'")
    assert files.manifest_differences(found, found).count() == 0
    changed = found.withColumn("sha256", F.lit("0"))
    assert {r.state for r in files.manifest_differences(found, changed).collect()} == {"changed"}
