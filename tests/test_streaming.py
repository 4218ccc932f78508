"""Streams give what the batch gives once all has arrived."""

from pyspark.sql import functions as F

from combtrack.operators.sampling import balanced_sample, matched_controls
from combtrack.streaming import windows


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 00:{i % 50:02d}:00", float(i)) for i in range(120)] + [(9, "2024-01-02 12:00:00", 0.0)]
    df = spark.createDataFrame(rows, "uid int, at string, value double").select("uid", F.to_timestamp("at").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, work in (("bins", windows.timebin_counts), ("stays", windows.stays)):
        query = work(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        own = sorted(tuple(r) for r in spark.table(name).collect())
        batch = sorted(tuple(r) for r in work(df).where("uid <> 9").collect())
        assert own == batch  # the last row moves the watermark past all others


def test_first_detections_of_a_stream(spark, tmp_path):
    """Of repeated detections one stays, whichever file it comes in."""
    for rows in ([(1, 0), (1, 0), (2, 0)], [(1, 0), (1, 30), (2, 0)], [(2, 59), (2, 59)]):
        df = spark.createDataFrame([(u, f"2024-01-01 00:00:{s:02d}") for u, s in rows], "uid int, at string").select("uid", F.to_timestamp("at").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.first_detections(stream).writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["uid"], r["ts"].second) for r in spark.table("firsts").collect()) == [(1, 0), (1, 30), (2, 0), (2, 59)]


def test_samples_are_fixed_by_the_seed(spark):
    df = spark.range(100).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    one = sorted(r["id"] for r in balanced_sample(df, "label", "id", 8, 1).collect())
    assert one == sorted(r["id"] for r in balanced_sample(df.repartition(7), "label", "id", 8, 1).collect()) and len(one) == 16
    events = spark.createDataFrame([(1, 5), (2, 5)], "day int, uid int")
    pool = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5)], "day int, uid int")
    got = {r["day"]: r["control"] for r in matched_controls(events, pool, ["day"], "uid", 3).collect()}
    assert got[1] in (6, 7) and got[2] is None
