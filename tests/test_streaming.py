"""Blocks over a stream against the batch operator."""

from __future__ import annotations

import datetime as dt


def turn(dialogue, n, minute):
    return (dialogue, f"{dialogue}:{n}", n, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute))


SCHEMA = "dialogue_id string, prop_id string, turn long, at timestamp"


def streamed(spark, tmp_path, batches, **more):
    from weftline.streaming.blocks import ROCKSDB, stream_blocks

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = f"{tmp_path}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream_blocks(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), **more).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
        assert query.exception() is None, i
    return query, spark.read.parquet(out).collect()


def test_streamed_blocks_equal_those_of_the_batch(spark, tmp_path):
    from weftline.operators.blocks import assign_blocks, earlier_pairs

    turns = [turn(d, n, 10 * n) for d in ("a", "b") for n in range(1, 8)]
    batches = [[t for t in turns if t[2] <= 3], [t for t in turns if 3 < t[2] <= 5], [t for t in turns if t[2] > 5]]
    query, got = streamed(spark, tmp_path, batches, block_size=3)
    want = assign_blocks(earlier_pairs(spark.createDataFrame(turns, SCHEMA)), 3)
    assert sorted((r.dialogue_id, r.new_id, r.old_id, r.block_index) for r in got) == sorted((r.dialogue_id, r.new_id, r.old_id, r.block_index) for r in want.collect())
    assert not any(r.late for r in got)
    entries = query.lastProgress["stateOperators"][0]
    assert entries["numRowsTotal"] >= len(turns)  # an entry a proposition


def test_late_turns_are_told_and_idle_dialogues_forgotten(spark, tmp_path):
    batches = [[turn("a", 1, 0), turn("a", 3, 20)], [turn("a", 2, 21), turn("a", 4, 22)], [turn("z", 1, 600)], [turn("z", 2, 601)], [turn("a", 5, 602)]]
    _, got = streamed(spark, tmp_path, batches, block_size=2, idle="2 hours", delay="1 minute")
    assert [(r.new_id, r.old_id) for r in got if r.late] == [("a:2", None)]
    pairs = {(r.new_id, r.old_id, r.block_index) for r in got if not r.late}
    assert pairs == {("a:3", "a:1", 0), ("a:4", "a:1", 0), ("a:4", "a:3", 0), ("z:2", "z:1", 0)}  # a:5 came after its dialogue was forgotten
