from skerry.streaming.windows import counts, sessions


def test_stream_like_table(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00"), ("a", "2024-01-01 03:00:00")]
    spark.createDataFrame(rows, "k string, ts string").selectExpr("k", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = counts(stream, "ts", "1 hour", "k", late="10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, counts(table, "ts", "1 hour", "k").collect()))
    assert sorted(r.n for r in sessions(table, "ts", "1 hour", "k").collect()) == [1, 1, 2]
