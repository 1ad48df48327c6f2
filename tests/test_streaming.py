from turnwise.streaming.live import windowed_activity


def test_windowed_activity(spark, make_turns, tmp_path):
    from datetime import datetime

    t = make_turns([(1, i, "User", "x", {"ingested_at": datetime(2025, 1, 1, 0, i)}) for i in range(8)] + [(1, 0, "User", "x", {"ingested_at": datetime(2025, 1, 1, 0, 0)}), (1, 99, "AI", "x", {"ingested_at": datetime(2025, 1, 1, 3, 0)})])
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = windowed_activity(stream).writeStream.outputMode("append").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.speaker, r.window.start.minute): r.turns for r in spark.table("activity").collect()}
    assert got == {("User", 0): 5, ("User", 5): 3}
