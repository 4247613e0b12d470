from __future__ import annotations

import json

import pytest


def test_jsonl_errors_name_the_line(spark, tmp_path):
    from weftline.sources.files import jsonl_errors, schema_version

    lines = ["", '{"schema_version": "v2", "n": 1, "s": null}', '{"n": 1}', "[1]", '{"schema_version": "v2", "n": true, "s": "x"}', '{"schema_version": "v2", "n": 1, "n": 2, "s": "x"}', "{", "  "]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = sorted((r.line, r.error.split(":")[0]) for r in jsonl_errors(spark, f"{tmp_path}/a.jsonl", {"schema_version": "string", "n": "integer", "s": "string?"}).collect())
    assert got == [(3, "fields are n"), (4, "not an object"), (5, "n is no integer"), (6, "not JSON"), (7, "not JSON")]
    assert schema_version(spark, f"{tmp_path}/a.jsonl") == "v2"


def test_repeated_keys(spark):
    from weftline.sources.files import repeats_keys

    texts = ['{"a": 1, "a": 2}', '{"a": 1}', '{"a": {"b": 1, "b": 2}}', "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert sorted(r.i for r in df.where(repeats_keys(df.t)).collect()) == [0, 2]


def test_manifest_and_schema(spark, tmp_path):
    from weftline.sources.files import file_digests, manifest_differences, manifest_json, schema_json

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.txt").write_text("b")
    found = file_digests(spark, f"{tmp_path}/x")
    manifest = json.loads(manifest_json(spark.createDataFrame([(3,)], "blocks int"), found, seed="s"))
    assert manifest["counts"] == {"blocks": 3} and manifest["seed"] == "s" and list(manifest["files"].values())[0]["bytes"] == 1
    assert found.head().md5 == "92eb5ffee6ae2fec3ad71c777531578f"
    told = found.collect()
    (tmp_path / "x" / "b.txt").write_text("c")
    (tmp_path / "x" / "d.txt").write_text("d")
    assert sorted(r.state for r in manifest_differences(file_digests(spark, f"{tmp_path}/x"), spark.createDataFrame(told)).collect()) == ["changed", "undeclared"]
    assert json.loads(schema_json(found))["type"] == "struct"


def test_replay(spark):
    from weftline.operators.replay import answered, replayed

    class Echo:
        def generate(self, prompts):
            return [p.upper() if p else None for p in prompts]

    rows = spark.createDataFrame([("a", "x"), ("b", None)], "example_id string, prompt string")
    assert {r.example_id: r.raw_response for r in answered(rows, Echo).collect()} == {"a": "X", "b": None}
    told = spark.createDataFrame([("a", 1, "no", False), ("a", 2, "yes", True), ("a", 3, "late", True), ("b", 4, "late", True), ("c", 1, "other", True)], "example_id string, attempt int, raw_response string, accepted boolean")
    assert [tuple(r) for r in replayed(rows, told).select("example_id", "raw_response", "attempt").collect()] == [("a", "yes", 2)]


def test_record_log_takes_up_where_it_stopped(spark, tmp_path):
    from weftline.operators.replay import append_records

    log = f"{tmp_path}/log"
    some = lambda *ids: spark.createDataFrame([(i, f"r{i}") for i in ids], "assignment_id string, raw string")
    assert append_records(some("a", "b", "b"), log).count() == 2
    assert sorted(r.assignment_id for r in append_records(some("b", "c"), log).collect()) == ["a", "b", "c"]


def test_reports_of_sections(spark):
    from weftline.operators import reports

    df = spark.createDataFrame([(12, 0.25), (24, None)], "n int, f1 double")
    svg = reports.svg_curve(df, "n", "f1", "F1 & n")
    assert svg.startswith("<svg") and "F1 &amp; n" in svg and "25.0 %" in svg
    assert reports.markdown_report("R", [("A", "text", df, ["n"], frozenset({"f1"})), ("B", "none", None, [], frozenset())]).count("## ") == 2
    assert reports.template("zero", {"zero": "Q {{BLOCK}}"}) == "Q {{BLOCK}}"
    with pytest.raises(ValueError):
        reports.template("other", {"zero": "Q {{BLOCK}}"})


def test_line_numbers_of_a_split_file(spark, tmp_path):
    """One file in many tasks, endings of all kinds across the splits, as a reader of text numbers them."""
    import random

    from weftline.sources.files import jsonl_errors, numbered_lines

    rng = random.Random(9)
    parts = []
    for i in range(4000):
        text = "" if rng.random() < 0.05 else json.dumps({"n": i, "s": "é" * rng.randrange(30)}, ensure_ascii=False) if rng.random() < 0.99 else f"broken {i}"
        parts.append(text + rng.choice(("\n", "\n", "\r\n")))
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "a.jsonl").write_bytes("".join(parts).encode())
    (tmp_path / "big" / "b.jsonl").write_bytes(b'{"n": 1, "s": ""}\n\xff\xfe\n{"n": 2, "s": 3}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = numbered_lines(spark, f"{tmp_path}/big")
        got = sorted((r.path.rsplit("/", 1)[1], r.line, r.value) for r in lines.collect())
        bad = sorted((r.path.rsplit("/", 1)[1], r.line) for r in jsonl_errors(spark, f"{tmp_path}/big", {"n": "integer", "s": "string"}).collect())
        assert spark.read.text(f"{tmp_path}/big/a.jsonl").rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(tmp_path / "big" / "a.jsonl", encoding="utf-8") as f:
        want = [("a.jsonl", i, line.rstrip("\n")) for i, line in enumerate(f, 1)]
    assert [x for x in got if x[0] == "a.jsonl"] == want
    assert bad == [("a.jsonl", i) for _, i, line in want if line.startswith("broken")] + [("b.jsonl", 2), ("b.jsonl", 3)]
    assert [x[1:] for x in got if x[0] == "b.jsonl"] == [(1, '{"n": 1, "s": ""}'), (2, None), (3, '{"n": 2, "s": 3}')]


def test_closed_forms_at_any_depth(spark):
    from weftline.sources.files import unexpected_keys

    form = {"a": None, "b?": {"c": None}, "d": [{"e": None, "f?": None}]}
    texts = {
        1: {"a": 1, "d": []}, 2: {"a": [{"z": 1}], "b": {"c": None}, "d": [{"e": 1, "f": 2}, {"e": 3}]},
        3: {"d": [], "x": 1}, 4: {"a": 1, "b": {}, "d": [{"e": 1}, {"f": 2, "g": 3}, 7]}, 5: {"a": 1, "d": {"e": 1}}, 6: {"a": 1, "b": 3, "d": []}, 7: [], 8: {},
    }
    rows = [(k, json.dumps(v)) for k, v in texts.items()] + [(9, "{"), (10, '{"a": 1, "a": 2, "d": []}'), (11, None)]
    got = [(r.id, r.path, r.key, r.problem) for r in unexpected_keys(spark.createDataFrame(rows, "i int, t string"), "i", "t", form).collect()]
    assert sorted(got, key=str) == sorted([
        (3, "$", "x", "unexpected"), (3, "$", "a", "missing"), (4, "$.b", "c", "missing"), (4, "$.d[]", "e", "missing"), (4, "$.d[]", "g", "unexpected"), (4, "$.d[]", None, "not an object"),
        (5, "$", "d", "not an array"), (6, "$.b", None, "not an object"), (7, "$", None, "not an object"), (8, "$", "a", "missing"), (8, "$", "d", "missing"), (9, "$", None, "not JSON"), (10, "$", None, "not JSON"), (11, "$", None, "not JSON"),
    ], key=str)


def aif(nodes=("1", "2"), edges=(("1", "2"),), **more):
    return {"nodes": [{"nodeID": n, "text": "t", "type": "L"} for n in nodes], "edges": [{"edgeID": str(i), "fromID": a, "toID": b} for i, (a, b) in enumerate(edges)], "locutions": [{"nodeID": nodes[0], "personID": "p", "start": "s", "timestamp": "t"}], **more}


@pytest.mark.parametrize(("faults", "message"), [
    ({}, None), ({"m1": aif(note="x")}, "m1 $ note unexpected"), ({"m1": {k: v for k, v in aif().items() if k != "edges"}}, "m1 $ edges missing"),
    ({"m1": aif(nodes=("1", "1", "2"))}, "m1 has a repeated node 1"), ({"m1": aif(edges=(("1", "9"),))}, "m1 has a dangling edge 9"), ({"m7": aif()}, "m7 has no metadata"), ({"m1": None}, "m1 has no file"),
])
def test_maps_are_loaded_in_order_or_not_at_all(spark, tmp_path, faults, message):
    from weftline.sources.files import load_maps

    for name, content in ({f"m{i}": aif() for i in range(4)} | faults).items():
        if content is not None:
            (tmp_path / f"{name}.json").write_text(json.dumps(content))
    meta = spark.createDataFrame([("m0", "d2", 2, 1), ("m1", "d1", 1, 2), ("m2", "d1", 1, 1), ("m3", "d2", 2, 1)], "map_id string, dialogue_id string, dialogue_order int, map_order int")
    if message is None:
        tables = load_maps(spark, str(tmp_path), meta)
        assert [r.map_id for r in tables["maps"].orderBy("place").collect()] == ["m2", "m1", "m0", "m3"]
        assert tables["nodes"].count() == 8
    else:
        with pytest.raises(ValueError, match=message.replace("$", r"\$")):
            load_maps(spark, str(tmp_path), meta)


def test_packages_against_their_manifest(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftline.sources.files import manifest_differences, package_files

    root = tmp_path / "package"
    (root / "data").mkdir(parents=True)
    (root / "data" / "train.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (root / "data" / "none.jsonl").write_text("")
    (root / "data" / "t.csv").write_text("a,b\n1,2\n3,4\n5,6\n")
    (root / "README.md").write_text("# x\n")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/p")
    (root / "data" / "t.parquet").write_bytes(next(tmp_path.glob("p/part-*.parquet")).read_bytes())
    found = package_files(spark, f"{root}/")
    told = {r.path: (r.bytes, r.rows) for r in found.collect()}
    assert {k: v[1] for k, v in told.items()} == {"data/train.jsonl": 2, "data/none.jsonl": 0, "data/t.csv": 3, "data/t.parquet": 7, "README.md": None}
    manifest = spark.createDataFrame(found.collect(), found.schema)
    assert manifest_differences(found, manifest).count() == 0
    other = manifest.withColumn("rows", F.when(F.col("path") == "data/t.csv", 9).otherwise(F.col("rows"))).where("path <> 'README.md'")
    other = other.withColumn("sha256", F.when(F.col("path") == "data/train.jsonl", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("gone.txt", 1, "1", None)], found.schema))
    assert {r.path: r.state for r in manifest_differences(found, other).collect()} == {"data/t.csv": "miscounted", "README.md": "undeclared", "data/train.jsonl": "changed", "gone.txt": "missing"}
    assert {r.state for r in manifest_differences(found.drop("rows"), other.drop("rows")).collect()} == {"undeclared", "changed", "missing"}
