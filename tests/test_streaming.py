from tessera.streaming import windows


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in df.sparkSession.sql(f"SELECT * FROM {name}").collect()]
    finally:
        q.stop()


def batches(spark, tmp_path, parts, schema):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_throttle_remembers(spark, tmp_path):
    source = batches(spark, tmp_path, [[(1, 0.0, 1), (1, 0.5, 2)], [(1, 0.9, 3), (1, 1.2, 4)]], "src long, t double, id long")
    assert sorted(run(windows.throttle(source, 1.0), "throttled")) == [(1, 0.0, 1), (1, 1.2, 4)]


def test_moving_average_remembers(spark, tmp_path):
    source = batches(spark, tmp_path, [[(1, 0.0, 1, 1.0)], [(1, 1.0, 2, 0.0)]], "src long, t double, id long, value double")
    assert sorted(run(windows.accumulate(source, 0.25), "averaged")) == [(1, 1, 1.0), (1, 2, 0.75)]


def test_hop_windows(spark, tmp_path):
    rows = [(1, float(i) / 10, float(i)) for i in range(10)]
    raw = batches(spark, tmp_path, [rows], "src long, s double, value double").selectExpr("src", "timestamp_millis(cast(s * 1000 as bigint)) as ts", "value")
    got = run(windows.hop_windows(raw), "hops", "complete")
    assert sum(r[3] for r in got) == 20


def test_sessions(spark, tmp_path):
    rows = [(1, 0), (1, 5), (1, 40)]
    raw = batches(spark, tmp_path, [rows], "src long, s long").selectExpr("src", "timestamp_seconds(s) as ts")
    assert sorted(r[3] for r in run(windows.sessions(raw), "runs", "complete")) == [1, 2]
