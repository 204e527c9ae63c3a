from __future__ import annotations

from tracemill.streaming import replay


def trace():
    kinds = ["observation", "prompt", "action", "observation", "prompt", "action", "observation", "observation", "prompt", "pin", "prompt", "finish"]
    return [(t, i, k, "obs-0001" if k == "pin" else None) for t in ("a", "b") for i, k in enumerate(kinds)]


def test_old_observations_turn_compact_once(spark):
    df = spark.createDataFrame(trace(), "task_id string, event_index long, type string, observation_id string")
    got = [r for r in replay.replay(df).collect() if r.task_id == "a"]
    first = {r.prompt_index: (r.stage, r.tier, r.level, r.switched) for r in got if r.observation_id == "obs-0001"}
    assert first == {0: ("CAPTURED", "HOT", 3, False), 1: ("ENRICHED", "HOT", 3, False), 2: ("ENRICHED", "COLD", 1, True), 3: ("ENRICHED", "COLD", 3, True)}


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "task_id string, event_index long, type string, observation_id string"
    df = spark.createDataFrame(trace(), schema)
    for k in range(3):
        df.where(f"event_index div 4 = {k}").coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = replay.replay_stream(stream).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(map(tuple, spark.table("replayed").collect())) == sorted(map(tuple, replay.replay(df).collect()))
