"""A database scan by hours, the bucketed table, and rasters in tiles."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from combtrack.config import HIVE_2019
from combtrack.operators import substrate
from combtrack.operators import windows as w
from combtrack.sources import tables


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """A Derby table, whose jars come with Spark: some detections on the hour, one at either end, one on the next day."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/hive;create=true"
    stamps = ["2024-07-16 09:59:59.999", "2024-07-16 10:00:00", "2024-07-16 10:30:00", "2024-07-16 11:00:00", "2024-07-16 11:00:00.5", "2024-07-16 12:00:00", "2024-07-16 12:00:00.001", "2024-07-17 00:00:00", "2024-07-17 01:00:00"]
    rows = [(t, i % 3, 0.1 * (i % 10), i % 2, float(i), float(i), 0.5) for i, t in enumerate(stamps * 2)]
    df = spark.createDataFrame(rows, "t string, bee_id int, bee_id_confidence double, cam_id int, x_pos double, y_pos double, orientation double")
    df = df.select(F.col("t").cast("timestamp").alias("timestamp"), *df.columns[1:])
    df.coalesce(1).write.jdbc(url, "detections", mode="overwrite")
    return url, df


@pytest.mark.parametrize(("ids", "start", "end"), [(None, "10:00:00", "12:00:00"), ([0, 2], "10:15:00", "11:00:00"), ([1], "00:00:00", "23:59:59.999999"), (None, "11:00:00", "01:00:00"), ([], "00:00:00", "23:59:59"), ([0, 1, 2], "10:00:00", "10:00:00")])
def test_scan_by_hours(spark, database, ids, start, end):
    url, df = database
    got = tables.scan_jdbc(spark, url, "detections", "2024-07-16", ids, 3, 0.2, start, end)
    named = df.select(F.col("timestamp").alias("ts"), F.col("bee_id").alias("uid"), F.col("bee_id_confidence").alias("confidence"), F.monotonically_increasing_id().alias("event_id"), "x_pos")
    want = tables.scan_detections(named, ids, 3, 0.2, f"2024-07-16 {start}", f"2024-07-16 {end}")
    assert sorted((r["timestamp"], r["bee_id"], r["x_pos"]) for r in got.collect()) == sorted((r["ts"], r["uid"], r["x_pos"]) for r in want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    if ids != []:
        assert "bee_id_confidence" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert got.rdd.getNumPartitions() == (len(tables.jdbc_hours("2024-07-16", start, end)) if ids != [] else got.rdd.getNumPartitions())


def test_bucketed_days(spark, tmp_path):
    """Windows need no exchange, and a day written again leaves the others alone."""
    rows = [(u, day, f, float(u * f)) for u in range(9) for day in range(3) for f in range(0, 50, 7)]
    df = spark.createDataFrame(rows, "uid bigint, daynum int, framenum int, x double")
    spark.sql("DROP TABLE IF EXISTS sightings_by_uid")
    tables.write_bucketed(df, "sightings_by_uid", 4)
    again = df.where("daynum = 1 and uid < 5").withColumn("x", F.lit(-1.0))
    for _ in range(2):
        tables.write_bucketed(again, "sightings_by_uid", 4)
    stored = spark.table("sightings_by_uid")
    assert sorted(map(tuple, stored.select(df.columns).collect())) == sorted(map(tuple, df.where("daynum <> 1").union(again).collect()))
    for spec in (w.by_day(), w.by_uid()):
        plan = stored.withColumn("gap", F.lead("framenum").over(spec))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    spark.sql("DROP TABLE sightings_by_uid")


@pytest.mark.parametrize("size", [1, 3, 5, 64])
def test_tiles_are_the_nearest(spark, size):
    """Against all distances, on random rasters; the size of tiles changes nothing."""
    rng = np.random.default_rng(6)
    images, want = [], {}
    for i, (h, wd, share) in enumerate([(7, 9, 0.2), (12, 5, 0.05), (1, 11, 0.3), (10, 1, 0.2), (6, 6, 0.0), (8, 8, 1.0)]):
        codes = np.where(rng.random((h, wd)) < share, rng.integers(0, 3, (h, wd)), -1)
        colour = np.array([[0, 0, 0], [100, 0, 0], [0, 200, 0], [0, 0, 250]], np.uint8)[codes + 1]
        images.append((i, h, wd, bytearray(colour.tobytes())))
        known = list(zip(*np.nonzero(codes >= 0)))
        for y, x in itertools.product(range(h), range(wd)):
            near = min((((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in known), default=None)
            want[i, x, y] = None if near is None else int(codes[near[1], near[2]])
    df = spark.createDataFrame([*images, (98, 2, 2, None), (99, 0, 0, bytearray())], "raster_id long, height int, width int, pixels binary")
    got = substrate.classify_rasters(df, [(100, 0, 0), (0, 200, 0), (0, 0, 250)], size=size).collect()
    assert {(r["raster_id"], r["xi"], r["yi"]): r["code"] for r in got} == want and len(got) == len(want)


def test_scale_of_a_season(spark):
    from combtrack.operators.signal import clean_trajectories

    rows = [(1, 0, f, f"2024-01-01 00:00:{f // 3:02d}.{f % 3}", 1160.0 + f, 580.0, 0, 0.9, f) for f in range(30)]
    df = spark.createDataFrame(rows, "uid bigint, daynum int, framenum int, t string, x double, y double, camera int, confidence double, event_id bigint").withColumn("ts", F.col("t").cast("timestamp"))
    got = clean_trajectories(df, HIVE_2019, 0.8, 10).where("framenum = 0").first()
    assert round(got["x"], 6) == 1000 and round(got["y"], 6) == 500 and round(got["fx"], 6) == 1000
