from refrain.operators import windows
from refrain.sources.sequences import conv_frames
from refrain.streaming import rolling

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    frames = conv_frames(spark, DATA)
    for k in range(3):  # three micro-batches, in order within each sequence
        part = frames.filter(f"frame_idx >= {k * 3} and frame_idx < {k * 3 + 3 if k < 2 else 10_000}").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = rolling.stream_rolling_hash(stream, 3)
    query = out.writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.episode_id, r.hash) for r in spark.table("rolled").collect()}
    want = {(r.episode_id, r.hash) for r in windows.rolling_hash(frames, 3).collect()}
    assert got == want


def test_state_machine():
    roll = rolling.RollingHash(3)
    made = [roll.add(v) for v in (1, 2, 3, 4, 5)]
    assert made[:2] == [None, None] and len(set(made[2:])) == 3
    roll.reset()
    assert roll.add(9) is None
