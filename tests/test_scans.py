"""Two-level scans, quantiles, rank correlations, look-ups and histograms against plain Python."""

import random
from collections import defaultdict
from datetime import datetime
from itertools import groupby

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from combtrack.config import HIVE_2018 as C
from combtrack.operators import events, signal, stats, substrate, timebins, windows


def test_running_visits_across_days(spark):
    rng = random.Random(1)
    rows = [(u, day, f, rng.choice([0, 1, 1, None] if u == 2 else [0, 1])) for u in range(4) for day in sorted(rng.sample(range(9), 5)) for f in sorted(rng.sample(range(50), rng.choice([1, 2, 6])))]
    got = windows.running_visits(spark.createDataFrame(rows, "uid int, daynum int, framenum int, flag int"), F.col("flag")).collect()
    want = {}
    for u, own in groupby(rows, lambda r: r[0]):
        before, visits = None, 0
        for _, day, f, on in own:
            visits += before == 0 and on == 1
            before = on
            want[u, day, f] = (on, visits)
    assert {(r["uid"], r["daynum"], r["framenum"]): (r["on"], r["visits"]) for r in got} == want


def test_bouts_of_parts(spark):
    """Runs over the ends of days, with nulls there and days of nothing else: as without parts."""
    rng = random.Random(7)
    rows = [(u, day, 6 * day + i, s) for u in range(40) for day in range(4) for i, s in enumerate(rng.choices([0, 1, None], [4, 4, 1], k=6) if (u + day) % 5 else [None] * 6)]
    df = spark.createDataFrame(rows, "uid int, daynum int, td int, state int")
    columns = ["uid", "state", "start", "end", "length"]
    whole, parts = windows.bouts(df).select(columns), windows.bouts(df, part="daynum").select(columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], list(range(1000)), [5] * 400 + [7] * 3, [x * x % 97 for x in range(3000)]])
def test_quantiles_by_selection(spark, values):
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)] * 3, "v double")
    got = stats.quantiles(df, "v", shares).collect()
    assert len(got) == 1 and (got[0][0] is None if not values else np.allclose(got[0][0], np.quantile(values, shares)))


def test_spearman_with_nulls(spark):
    """Pairwise complete, ranks among those rows, ties averaged, repeated rows: as pandas has it."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.integers(0, 12, (300, 5)), columns=list("abcde")).astype(float)
    frame["e"] = frame["a"] * 2 + rng.integers(0, 3, 300)
    frame = frame.mask(rng.random(frame.shape) < [0, 0.2, 0.5, 0, 0.05])
    frame["none"], frame["same"] = np.nan, 1.0
    want = frame.corr(method="spearman")
    rows = [tuple(None if np.isnan(x) else float(x) for x in r) for r in frame.itertuples(index=False)]
    got = stats.spearman_matrix(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)), list(frame)).collect()
    assert len(got) == 21
    for r in got:
        w = want.loc[r["a"], r["b"]]
        assert (r["r"] is None) == bool(np.isnan(w)) and (r["r"] is None or abs(r["r"] - w) < 1e-9)


def test_columns_interpolate_by_their_own_sightings(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 10, 10.0, None), (1, 0, 20, 20.0, 20.0), (2, 0, 0, None, 1.0), (2, 0, 10, 4.0, None)], "uid int, daynum int, framenum int, x double, y double")
    for columns in (["x", "y"], ["y", "x"]):
        got = {(r["uid"], r["framenum"]): (r["x"], r["y"]) for r in events.upsampled(df, 5, columns).collect()}
        assert got == {(1, f): (float(f), float(f)) for f in (0, 5, 10, 15, 20)} | {(2, f): (4.0, 1.0) for f in (0, 5, 10)}


def test_tied_stamps_come_in_one_order(spark):
    """Two detections of one time: the same ones stay, however they arrive."""
    rows = [(1, i, f"2024-01-01 00:00:{i // 2:02d}", float(x), 0.0, 0) for i, x in enumerate([0, 1, 2, 3, 4, 90_000, 5, 6, 7, 8, 9, 95_000])]
    kept = set()
    for order in (rows, rows[::-1], rows[6:] + rows[:6]):
        df = spark.createDataFrame(order, "uid int, event_id int, at string, fx double, fy double, camera int").withColumn("ts", F.col("at").cast("timestamp"))
        kept.add(tuple(sorted(r["event_id"] for r in signal.drop_speed_errors(df.coalesce(1), C, ["uid"], 100.0, 2).collect())))
    assert len(kept) == 1


def test_codes_of_all_maps_at_once(spark):
    rng = random.Random(5)
    raster = spark.createDataFrame([(m, c, x, y, rng.randrange(15)) for m in range(2) for c in range(2) for x in range(4) for y in range(3) if rng.random() < 0.7], "map_id int, camera int, xi int, yi int, code int")
    rows = [(i, rng.randrange(2), rng.choice([None, -1.0, 0.5, 1.5, 9.0]), rng.choice([0.0, 1.4, None, 7.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, camera int, x double, y double")
    single = {(r["id"], r["map_id"]): r["code"] for r in substrate.substrate_at(df, raster, 14).collect()}
    got = substrate.codes_at(df, raster, (0, 1), 14).collect()
    assert len(got) == 60 and {(r["id"], m): r[f"code{m}"] for r in got for m in (0, 1)} == single


def test_met_within_is_the_range_join(spark):
    rng = random.Random(9)
    es = [(i, rng.randrange(2), rng.randrange(2), rng.randrange(200)) for i in range(40)]
    rs = [(u, day, f) for u in range(2) for day in range(2) for f in sorted(rng.sample(range(200), 80))]
    e, r = spark.createDataFrame(es, "e int, uid int, daynum int, at int"), spark.createDataFrame(rs, "uid int, daynum int, framenum int")
    for before, after in ((10, 5), (9, -1), (0, 0), (-1, 20), (-3, 2)):
        got = windows.met_within(e, r, "at", before, after)
        want = sorted((i, f) for i, u, day, at in es for v, k, f in rs if (u, day) == (v, k) and at - before <= f <= at + after)
        assert sorted((x["e"], x["framenum"]) for x in got.collect()) == want
        assert "_stretch" in got._jdf.queryExecution().executedPlan().toString().split("Join")[1].split("\n")[0]


def test_minutes_weigh_the_same(spark):
    """Against a loop over bins and parts, with steps from one side to the other, and bins of too few rows."""
    rng = random.Random(4)
    rows = [(e, e % 3, f, 33 * rng.randrange(110), rng.randrange(5700), rng.randrange(2), rng.choice([0, 5, 13, None])) for e, f in enumerate(sorted(rng.sample(range(2 * 10_800), 900)))]
    df = spark.createDataFrame([(*r[:2], 0, *r[2:], r[-1]) for r in rows], "event_id int, uid int, daynum int, framenum int, x int, y int, camera int, code0 int, code1 int")
    got = {(r["uid"], r["td"], r["cell"]): (r["n"], r["n_minute"], r["speed"], r["speed_minute"]) for r in timebins.bin_cells(windows.with_geometry(df, C), C, 24).collect()}
    codes = {(r["uid"], r["td"], r["code"]): (r["n"], r["n_minute"]) for r in timebins.bin_substrates(windows.with_geometry(df, C), C, 24).where("map = 0").collect()}
    bins, want, want_codes = defaultdict(list), {}, {}
    for r in rows:
        bins[r[1], r[2] // 10_800].append(r)
    square = lambda x, y, camera: None if y > 5652 or x + 3296 * (1 - camera) > 6592 else min(int((x + 3296 * (1 - camera)) * 41 / 6592), 40) * 35 + min(int(y * 35 / 5652), 34)
    for (uid, td), own in bins.items():
        if len(own) < 10:
            continue
        parts = [list(p) for _, p in groupby(own, lambda r: r[2] // 180)]

        def steps(rs):
            out = defaultdict(list)
            for a, b in zip(rs, rs[1:]):
                if a[5] == b[5]:
                    out[square(*b[3:6])].append(float(np.hypot(b[3] - a[3], b[4] - a[4])))
            return out

        whole = steps(own)
        for cell in {square(*r[3:6]) for r in own} - {None}:
            minute = sum(sum(square(*r[3:6]) == cell for r in p) / len(p) for p in parts) / len(parts) * len(own)
            inner = [np.mean(s[cell]) / len(p) for p in parts if cell in (s := steps(p))]
            want[uid, td, cell] = (sum(square(*r[3:6]) == cell for r in own), minute, np.mean(whole[cell]) if cell in whole else None, np.mean(inner) * len(own) if inner else None)
        for code in {r[6] for r in own} - {None}:
            want_codes[uid, td, code] = (sum(r[6] == code for r in own), sum(sum(r[6] == code for r in p) / len(p) for p in parts) / len(parts) * len(own))
    for a, b in ((got, want), (codes, want_codes)):
        assert a.keys() == b.keys()
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-6) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_many_short_series_are_filtered_side_by_side():
    """Series of many lengths, as each alone; those too short give nothing."""
    rng = np.random.default_rng(6)
    lengths = np.array([5, 18, 19, 40, 300, 700, 41, 256, 1])
    series, sections = [np.cumsum(rng.normal(size=n)) for n in lengths], signal.butterworth(5, 0.05, 3)
    got = signal.zero_phase_all(np.concatenate(series), np.cumsum(lengths) - lengths, lengths, sections)
    for x, y in zip(series, np.split(got, np.cumsum(lengths)[:-1]), strict=True):
        alone = signal.zero_phase(x[:, None], sections)
        assert np.isnan(y).all() if alone is None else np.allclose(y, alone[:, 0], atol=1e-9)


def test_groups_take_no_python_call_each(spark):
    """Small groups of a batch are worked on together, and groups that batches cut are whole again."""
    rows = [(u, 0, datetime(2024, 1, 1, 0, 0, i), float(i * (1 if u % 2 else 90)), 0.0, 0, i) for u in range(300) for i in range(7)]
    df = spark.createDataFrame(rows, "uid bigint, daynum int, ts timestamp, fx double, fy double, camera int, framenum int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        left, smooth = signal.drop_speed_errors(df, C, ["uid", "daynum"], 50.0, 3), signal.low_pass(df, ["fx"], 0.05, 3)
        assert all("FlatMapGroups" not in f._jdf.queryExecution().optimizedPlan().toString() for f in (left, smooth))
        assert left.groupBy("uid").count().where("uid % 2 = 1").select(F.min("count"), F.count("*")).first() == (7, 150)
        assert left.where("uid % 2 = 0").count() == 0 or left.where("uid % 2 = 0").groupBy("uid").count().agg(F.max("count")).first()[0] < 3
        assert smooth.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_quartiles_of_keys_by_selection(spark):
    """As numpy has them, with ties and nulls, and no aggregate that holds a key's values."""
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, float(rng.randrange(40)), rng.random() * 40])) for _ in range(3000)] + [("d", 5.0), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = stats.box(df, "k", "v")
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["q1"], r["median"], r["q3"]) for r in found.collect()}
    for key in "abcd":
        assert got[key] == pytest.approx(tuple(np.quantile([v for k, v in rows if k == key and v is not None], [0.25, 0.5, 0.75])))


def test_pivot_holds_no_sorted_rows(spark):
    """Columns are counted in a hash map of fixed rows, beside the states' own windows."""
    states = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 2, 0), (2, 0, 1, None)], "uid int, daynum int, td int, state int")
    wide = events.pivot_state(states, 3)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" not in plan.lower() and sorted(map(tuple, wide.collect())) == [(1, 0, 1, None, 0), (2, 0, None, None, None)]


def test_meetings_of_those_asked_for(spark):
    """All meetings of the asked individuals at the asked times, and none beside."""
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.randrange(2), rng.randrange(40), 0, rng.randrange(60), rng.randrange(60)) for _ in range(300)]
    df = spark.createDataFrame(rows, "uid bigint, daynum int, framenum int, camera int, x int, y int")
    asked = spark.createDataFrame([(1, 0, 0), (5, 1, 3), (5, 1, 3)], "uid bigint, daynum int, bucket bigint")
    some, full = events.interactions(df, 20, 10, asked), events.interactions(df, 20, 10)
    want = [r for r in map(tuple, full.collect()) if (r[3], r[0], r[1]) in {(1, 0, 0), (5, 1, 3)}]
    assert sorted(map(tuple, some.collect())) == sorted(want) and 0 < len(want) < full.count()
