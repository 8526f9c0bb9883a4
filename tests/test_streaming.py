from pyspark.sql import functions as F

from tidemill.streaming import loads


def test_load_and_merge_available(spark, tmp_path):
    src, out, merged = (str(tmp_path / x) for x in ("in", "out", "merged"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(src)
    stream = lambda: loads.stream_files(spark, "parquet", src, spark.read.parquet(src).schema)
    loads.load_available(stream(), out, str(tmp_path / "c1"))
    loads.merge_available(stream(), merged, ["k"], ["v"], str(tmp_path / "c2"))
    spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string").coalesce(1).write.mode("append").parquet(src)
    loads.load_available(stream(), out, str(tmp_path / "c1"))
    loads.merge_available(stream(), merged, ["k"], ["v"], str(tmp_path / "c2"))
    assert spark.read.parquet(out).count() == 4
    assert sorted(map(tuple, spark.read.parquet(merged).collect())) == [(1, "a"), (2, "z"), (3, "c")]


def test_windows_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert loads.windowed(events, "ts", "1 hour", "30 minutes", "1 hour", [], n=F.count("*")).agg(F.sum("n")).first()[0] == 2 * events.count()
    assert loads.sessions(events, "ts", "1 hour", "1 hour", ["user_id"]).agg(F.sum("n")).first()[0] == events.count()
