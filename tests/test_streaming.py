from pyspark.sql import functions as F

from cadenza.streaming import jobs


def drain(df, name, mode="append", **trigger):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def test_jobs_stream_equals_batch(spark, tmp_path):
    rows = [(u, i, float(i * 40), 1.0 + i % 3) for u in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id bigint, id bigint, at double, seconds double")
    df.coalesce(1).write.parquet(p := str(tmp_path / "in"))
    got = drain(jobs.stream_jobs(spark.readStream.schema(df.schema).parquet(p), 2, 3600.0), "jobs", once=True)  # a query with timeouts never runs out of batches
    want = jobs.replay_jobs(df, 2, 3600.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["outcome"] for r in want} == {"admitted", "rejected"}


def test_blocks_drop_partial_and_late_rows(spark, tmp_path):
    rows = [(float(t), "a", 1.0) for t in range(0, 40)] + [(41.0, "a", 1.0)]
    df = spark.createDataFrame(rows, "t double, k string, v double").select(F.timestamp_seconds("t").alias("at"), "k", "v")
    df.where("v > 0").coalesce(1).write.parquet(p := str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(p)
    got = drain(jobs.stream_blocks(s, "at", "k", "v", "4 seconds", "0 seconds", 4), "blocks")
    assert len(got) == 10 and all(r["total"] == 4.0 for r in got)


def test_latest_drops_repeated_deliveries(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 2)], "t double, id int").select(F.timestamp_seconds("t").alias("at"), "id")
    df.coalesce(1).write.parquet(p := str(tmp_path / "in"))
    assert len(drain(jobs.stream_latest(spark.readStream.schema(df.schema).parquet(p), "at", ["id"]), "latest")) == 2
