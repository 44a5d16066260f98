from chronoweave.streaming import ingest


def test_delays():
    assert [ingest.retry_delay(n) for n in (1, 2, 3, 4, 20)] == [16, 32, 64, 128, 900]


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", "g"), ("b", "g"), ("a", "g")], [("b", "g"), ("c", "h"), (None, "h")]):
        spark.createDataFrame(part, "uuid string, group_id string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    write = ingest.ingest_once(out)
    stream = ingest.episode_stream(spark, src, schema)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    rows = lambda: sorted(r.uuid for r in spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(out).collect())
    assert rows() == ["a", "b", "c"]
    write(spark.read.parquet(src), 1)  # a batch that runs again
    assert rows() == ["a", "b", "c"]


def test_debounced_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("g", f"e{i}") for i in range(6)] + [("h", "x")], "group_id string, uuid string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("group_id string, uuid string").parquet(src)
    q = ingest.debounced(stream, idle_ms=1500).writeStream.format("memory").queryName("due").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        import time

        for _ in range(30):
            time.sleep(1)
            if spark.table("due").count() >= 2:
                break
        assert sorted((r.group_id, r.n_episodes) for r in spark.table("due").collect()) == [("g", 6), ("h", 1)]
    finally:
        q.stop()
