from __future__ import annotations

import pytest
from pyspark.sql import functions as F


def test_reports(spark):
    from weftline.operators import reports

    df = spark.createDataFrame([("b", 0.5, None), ("a|x", 0.25, 2)], "k string, rate double, n int")
    assert reports.markdown_table(df, ["k"], frozenset({"rate"})).splitlines()[2:] == ["| a\\|x | 25.0 % | 2 |", "| b | 50.0 % | n/a |"]
    assert "<td>a|x</td>" in reports.html_table(df, ["k"], "t&t") and "t&amp;t" in reports.html_table(df, ["k"], "t&t")
    with pytest.raises(ValueError):
        reports.markdown_table(spark.range(1001).toDF("k"), ["k"])

    rows = [(f"e{i}", f"u{i // 2}", f"d{i % 5}", c) for i, c in enumerate(["SUPPORT", "ATTACK", "REPHRASE", "NONE", "NONE", "SUPPORT", "ATTACK", "NONE", "MIXED", "NONE"])]
    blocks = spark.createDataFrame(rows, "example_id string, update_id string, dialogue_id string, category string")
    shots = reports.few_shot(blocks).collect()
    assert [r.category for r in sorted(shots, key=lambda r: r.example_id)] == ["SUPPORT", "ATTACK", "REPHRASE", "NONE"] and len({r.dialogue_id for r in shots}) == 4
    dev = reports.dev_selection(blocks.select("update_id").distinct(), blocks, "s", 2, 1).collect()
    assert sorted(r.category for r in dev if r.category != "NONE") and len({r.update_id for r in dev if r.category != "NONE"}) == sum(r.category != "NONE" for r in dev)

    one = spark.createDataFrame([("U7 answers U3, not U7 or XU3",), (None,)], "text string")
    got = reports.remap_units(one, "text").collect()
    assert [r.text for r in got] == ["U1 answers U2, not U1 or XU3", None] and got[0].names == {"U7": "U1", "U3": "U2"}
    far = reports.remap_units(one.where("text IS NOT NULL"), "text", 900).withColumn("r", F.expr("array(named_struct('source', 'U7', 'target', 'U3', 'type', 'ATTACK'))"))
    assert [tuple(x) for x in reports.remap_graph(far, "r").head().r] == [("U900", "U901", "ATTACK")]
    with pytest.raises(Exception, match="no new id for U9"):
        reports.remap_graph(far.withColumn("r", F.expr("array(named_struct('source', 'U9', 'target', 'U3', 'type', 'ATTACK'))")), "r").collect()
    p = reports.render_prompts(one.where("text IS NOT NULL").select(F.struct("text").alias("block")), "Q: {{BLOCK}}").head().prompt
    assert p.startswith('Q: {\n  "text"')
    with pytest.raises(ValueError):
        reports.render_prompts(one, "no marker")
