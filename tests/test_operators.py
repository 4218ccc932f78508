"""Edge cases of the state and window operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from combtrack.config import HIVE_2018
from combtrack.operators import events, states, stats, windows
from combtrack.plans import catalogue
from combtrack.sources.tables import scan_detections


def grid(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "uid int, td int, state int")


def test_bouts_break_at_nulls(spark):
    got = sorted(tuple(r) for r in windows.bouts(grid(spark, [1, 1, None, 1, 0, 0])).select("state", "start", "end", "length").collect())
    assert got == [(0, 4, 5, 2), (1, 0, 1, 2), (1, 3, 3, 1)]


def test_uncensored_drops_first_and_last(spark):
    runs = windows.bouts(grid(spark, [1, 0, 0, 1, 1]))
    assert [(r["state"], r["length"]) for r in windows.uncensored(runs).collect()] == [(0, 2)]
    assert windows.uncensored(windows.bouts(grid(spark, [1, 1]))).count() == 0


def hive(spark, cells, bins):
    df = spark.createDataFrame([(1, *c) for c in cells], "uid int, td int, n int, near boolean")
    out = states.in_hive(df, ["uid"], bins, F.col("n") >= 5, F.col("near"))
    return [r["state"] for r in out.orderBy("td").collect()]


def test_in_hive_contract(spark):
    assert hive(spark, [(i, 5, False) for i in range(4)], 4) == [1] * 4
    assert hive(spark, [(0, 4, True)], 3) == [None] * 3
    assert hive(spark, [(0, 9, True), (3, 9, False)], 5) == [1, 0, 0, 1, 1]
    assert hive(spark, [(1, 9, False), (2, 9, True)], 3) == [0, 1, 1]  # the second seen bin decides


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "uid int, td int, n int, near boolean")
    assert states.in_hive(empty, ["uid"], 4, F.col("n") >= 5, F.col("near")).count() == 0
    assert windows.bouts(grid(spark, [])).count() == 0


def test_cut_is_right_closed(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (None,)], "x double").select(stats.cut(F.col("x"), [0, 1, 2]).alias("b")).collect()
    assert [r["b"] for r in got] == [None, 0, 1, None]


def test_bins_match_the_image():
    assert (HIVE_2018.x_bins, HIVE_2018.y_bins, HIVE_2018.frames_per_day) == (41, 35, 259_200)


def test_scan_limit_keeps_the_earliest(spark):
    start = datetime(2024, 1, 3)
    df = spark.createDataFrame([(i, i, start + timedelta(seconds=9 - i // 2), 0.2 + 0.2 * (i % 5)) for i in range(10)], "event_id long, uid int, ts timestamp, confidence double")
    scan = lambda limit: [r["event_id"] for r in scan_detections(df, None, 4096, 0.3, "2024-01-03", "2024-01-04", limit).orderBy("ts", "event_id").collect()]
    assert scan(None) == [8, 9, 6, 7, 4, 2, 3, 1]
    assert scan(3) == [8, 9, 6] and scan(100) == scan(None)


def test_registered_scan_holds_all_matches(spark, tmp_path):
    """More matches than the 3,000 of which the scan kept the earliest."""
    start = datetime(2024, 1, 4)
    rows = [(i, i % 50, start + timedelta(seconds=i), "k1", 400.0 if i % 2 else 100.0) for i in range(7000)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r["event_id"] for r in catalogue.queries()["scan_filter_confidence"](spark, str(tmp_path)).collect())
    assert got == list(range(1, 7000, 2))


def test_pivot_holds_all_days(spark):
    df = spark.createDataFrame([(1, 3, 0, 1), (1, 3, 1, 0), (1, 4, 0, 0), (2, 5, 1, None)], "uid int, daynum int, td int, state int")
    got = sorted(tuple(r) for r in events.pivot_state(df, 2).select("uid", "daynum", "t0", "t1").collect())
    assert got == [(1, 3, 1, 0), (1, 4, 0, None), (2, 5, None, None)]
