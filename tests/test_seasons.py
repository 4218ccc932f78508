"""Sources, trajectories and small operators against plain Python; queries with SQL are compared in test_catalogue."""

import math
import os
import shutil
import struct
import subprocess
import sys
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from combtrack.config import HIVE_2018 as C
from combtrack.functions import geometry, timeops
from combtrack.operators import identity, models, signal, stats, substrate, timebins, windows
from combtrack.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def png(path, pixels):
    """A true-colour PNG of rows of (red, green, blue)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_in_pairs(spark, tmp_path):
    red, blue = (255, 0, 0), (0, 0, 255)
    for m, names in ((3, ("b.png", "a.png")), (12, ("x.png",))):
        os.makedirs(tmp_path / str(m))
        for i, n in enumerate(names):
            png(str(tmp_path / str(m) / n), [[red, blue], [blue, blue], [red, red]] if i == 0 else [[blue]])
    (tmp_path / "3" / "notes.txt").write_text("no image")
    got = tables.read_rasters(spark, str(tmp_path))
    assert sorted((r["measurement"], r["nth"], r["raster_id"], r["height"], r["width"]) for r in got.collect()) == [(3, 0, 6, 1, 1), (3, 1, 7, 3, 2), (12, 0, 24, 3, 2)]
    codes = substrate.classify_rasters(got, [(0, 0, 255), (255, 0, 0)])  # red, blue as the source has them
    assert sorted((r["yi"], r["xi"], r["code"]) for r in codes.where("raster_id = 24").collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 1, 0)]


def test_day_files(spark, tmp_path):
    folders = {(0, 49): "early", (50, 85): "late"}
    template = str(tmp_path) + "/{folder}/tracks_{day:03d}.parquet"
    for day in (7, 50):
        spark.createDataFrame([(1, day)], "uid int, daynum int").write.parquet(tables.day_paths([day], template, folders)[0])
    assert tables.day_paths([7, 50], template, folders) == [f"{tmp_path}/early/tracks_007.parquet", f"{tmp_path}/late/tracks_050.parquet"]
    assert sorted(r["daynum"] for r in tables.read_day_files(spark, [50, 7], template, folders).collect()) == [7, 50]
    with pytest.raises(ValueError, match="day 86"):
        tables.day_paths([86], template, folders)


def test_csv_and_days_round_trip(spark, tmp_path):
    rows = [(1, 0, "12.0", 5, "a"), (2, 1, "7", 9, "b,c"), (3, 1, "none", None, None)]
    schema = "uid int, daynum int, x string, framenum int, note string"
    df = spark.createDataFrame(rows, schema)
    tables.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/csv", schema).collect())) == sorted(rows)
    df.coalesce(1).write.csv(f"{tmp_path}/gz", header=True, compression="gzip")
    assert tables.read_csv(spark, f"{tmp_path}/gz", schema).count() == 3
    tables.convert_days(df, f"{tmp_path}/days", ["x"])
    back = tables.read_days(spark, f"{tmp_path}/days", [1])
    assert sorted((r["uid"], r["daynum"], r["x"]) for r in back.collect()) == [(2, 1, 7), (3, 1, None)]
    assert "PartitionFilters: [isnotnull(daynum" in back._jdf.queryExecution().executedPlan().toString()
    assert tables.read_days(spark, f"{tmp_path}/days", []).count() == 0


def test_flagged_days(spark):
    df = spark.createDataFrame([(3, "TRUE"), (4, "FALSE"), (9, "TRUE?"), (10, None), (11, "TRUE")], "exp_day int, rest_day string")
    assert sorted(r[0] for r in tables.flagged_days(df, "rest_day").collect()) == [3, 11]
    assert [r[0] for r in tables.flagged_days(df, "rest_day", "TRUE?").collect()] == [9]


def test_clean_trajectories(spark):
    """One individual's hour: the best detection of a frame, no error of speed, no sparse hour, the clock moved on, every second frame."""
    t0 = datetime(2024, 1, 2, 23, 0)
    rows = [(i, 1, 1, 23 * 10_800 + 3 * i, t0 + timedelta(seconds=i), 0.9, 0, 100.0 + i, 50.0) for i in range(12)]
    rows += [(100, 1, 1, 23 * 10_800 + 9, t0 + timedelta(seconds=3), 0.95, 0, 5000.0, 50.0)]  # better, but far away
    rows += [(101, 1, 1, 23 * 10_800 + 60, t0 + timedelta(seconds=20), 0.2, 0, 110.0, 50.0)]  # too unsure
    rows += [(200 + i, 2, 1, 23 * 10_800 + 3 * i, t0 + timedelta(seconds=i), 0.9, 0, 100.0, 50.0) for i in range(4)]  # too few
    df = spark.createDataFrame(rows, "event_id int, uid int, daynum int, framenum int, ts timestamp, confidence double, camera int, fx double, fy double")
    got = sorted((r["event_id"], r["framenum"]) for r in signal.clean_trajectories(df, C, 0.5, 10, shift_hours=2.0, every=2).collect())
    # the jump to 5000 drops that row; the row after it is as far from it, so goes in the same pass
    want = [(i, 10_800 + 3 * i) for i in range(12) if i not in (3, 4) and (10_800 + 3 * i) % 2 == 0]
    assert got == want


def test_ids_in_text(spark):
    df = spark.createDataFrame([(x,) for x in ("12", "12.0", " 7 ", "x", None, "1e2")], "t string")
    assert [r[0] for r in df.select(identity.id_of(F.col("t"))).collect()] == [12, 12, 7, None, None, 100]


def test_calendar_and_text(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31, 12, 0, 1),)], "ts timestamp")
    assert df.select(timeops.day_within(F.col("ts"), 31, C)).first()[0] == 30
    with pytest.raises(Exception, match="not in the calendar"):
        df.select(timeops.day_within(F.col("ts"), 30, C)).collect()
    row = spark.createDataFrame([("2024-01-05", "12:00", "Bee 7", "Wasp 7")], "a string, b string, c string, d string")
    got = row.select(timeops.time_from(F.col("a")).cast("string"), timeops.time_from(F.lit("no time")), timeops.unlabelled(F.col("c")), timeops.unlabelled(F.col("d")), timeops.unlabelled(F.lit("Bee "))).first()
    assert tuple(got) == ("2024-01-05 00:00:00", None, "7", "Wasp 7", "")


def test_edges_of_scales(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 5.0, 5.0), (3, None, 5.0), (4, 10.0, 0.0)], "k int, v double, n double")
    got = {r[0]: tuple(r)[1:] for r in df.select("k", geometry.log_positive(F.col("v")), geometry.clipped(F.col("v"), F.lit(1.0), F.lit(6.0)), geometry.opacity(F.col("v"), F.col("n"))).collect()}
    assert got[1] == (None, 0.0, 0.0) and got[3] == (None, None, None)
    assert math.isclose(got[2][0], math.log(5)) and math.isclose(got[2][1], 0.99 * 0.8) and got[2][2] == 1.0
    assert got[4][2] is None


def test_quantiles_and_positions(spark):
    values = [3.0, 1.0, 1.0, 2.0, 9.0, 9.0, 9.0, -4.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 1 / 3, 0.9, 1.0]
    want = df.selectExpr(f"percentile(v, array({','.join(map(str, shares))}))").first()[0]
    assert stats.quantiles(df, "v", shares).first()[0] == pytest.approx(want)
    assert stats.quantiles(df.limit(0), "v", shares).first()[0] is None
    order = sorted(values)
    assert {r["value"]: (r["first"], r["last"]) for r in stats.positions(df, "v").collect()} == {v: (order.index(v) + 1, order.index(v) + order.count(v)) for v in values}
    plan = stats.numbered_values(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_range" in plan


def test_cohorts_share_tags(spark):
    rows = [("queen", 5, "2023-12-01"), ("apollo", 5, "2024-01-03"), ("apollo", 2, "2024-01-03"), ("boreas", 5, "2024-01-10")]
    dim = identity.cohort_dimension(spark.createDataFrame(rows, "cohort string, tag int, birth string").withColumn("birth", F.col("birth").cast("date")), C, 30)
    assert sorted((r["uid"], r["cohort"], r["tag"], r["last_use"]) for r in dim.collect()) == [(0, "queen", 5, 3), (1, "apollo", 2, 31), (2, "apollo", 5, 10), (3, "boreas", 5, 31)]
    ages = {(r["daynum"], r["uid"]): r["age"] for r in identity.ages(dim, [1, 5, 12], C).collect()}
    assert [ages[1, u] for u in range(4)] == [32, -1, -1, -1] and [ages[12, u] for u in range(4)] == [43, 10, -1, 3]
    seen = spark.createDataFrame([(1, 2, 1), (2, 2, 5), (3, 5, 12), (4, 99, 5)], "event_id int, tag int, daynum int")
    got = {r["event_id"]: (r["who"], r["age"]) for r in identity.resolved(seen, dim, C).collect()}
    assert got == {1: (-1, -1), 2: (1, 3), 3: (0, 43), 4: (-1, -1)}  # the queen's tag is hers for good


def test_gap_round_an_event(spark):
    rows = spark.createDataFrame([(i, 1, 0, f) for i, f in enumerate((10, 20, 50, 60, 90, 95))] + [(50, 2, 0, 10)], "event_id int, uid int, daynum int, framenum int")
    events = spark.createDataFrame([(0, 1, 0, 50), (1, 1, 0, 95), (2, 2, 0, 10)], "event_id int, uid int, daynum int, framenum int")
    found, view = windows.around_gap(events, rows, 40, 40)
    assert {r["event_id"]: tuple(r)[3:] for r in found.collect()} == {0: (21, 50, 95), 1: (61, 90, 95), 2: (None, None, 10)}
    assert sorted(r["sighting"] for r in view.where("event_id = 0").collect()) == [0, 1, 2, 3]


def test_grid_of_neighbours(spark):
    data = [(i, [float(i % 3), (i * 7 % 11) / 11], i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "id long, v array<double>, label long")
    grid = models.best_neighbours(df, range(1, 4), "v", "label", "id", folds=3).collect()
    assert len(grid) == 6 and all(r["accuracy"] == 1.0 for r in grid) and [r["k"] for r in grid] == [1, 1, 2, 2, 3, 3]


def test_bins_below_the_least(spark):
    rows = [(i, 1, 0, 3 * i, 0, 100.0, 100.0, 100.0, 100, 50.0, 3, 5, 0, 1.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id int, uid int, daynum int, framenum int, camera int, fx double, fy double, xa double, y int, exit_dist double, frame int, code0 int, code1 int, weight0 double, weight1 double").withColumn("x", F.lit(100))
    few, zeros = timebins.bin_metrics(df, C, 24).first(), timebins.bin_metrics(df, C, 24, zero_fill=True).first()
    enough = timebins.bin_metrics(df, C, 24, least=4).first()
    assert few["n"] == 4 and few["dance"] is None and few["trips"] is None and zeros["dance"] == 0 and zeros["trips"] == 0
    assert enough["dance"] == 1.0 and enough["speed_median"] == 0.0 and enough["frame_3"] == 1.0 and enough["dispersion_minute"] == 0.0 and enough["tortuosity"] is None


def test_queries_without_the_training_data_part(tmp_path):
    """With the folders for training data deleted the other queries are still listed."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, any(x.startswith('op1') for x in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    n, n_sql, pipeline, op1 = out.stdout.split()[-4:]
    assert int(n) > 100 and int(n_sql) > 90 and pipeline == op1 == "False"
