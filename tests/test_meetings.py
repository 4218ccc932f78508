"""Meetings of individuals beside plain loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from combtrack.operators import events, meetings
from combtrack.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sightings(spark):
    """Crowded sightings of three days, with fractions, points on the edges of squares, the same individual twice, and nulls."""
    some = random.Random(7)
    rows = [(u % 23, u % 3, some.randrange(40), some.randrange(2), some.choice([20.0 * some.randrange(-3, 4), some.uniform(-70, 70)]), some.uniform(-70, 70)) for u in range(300)]
    rows += [(None, 0, 1, 0, 0.0, 0.0), (1, 0, 1, None, 0.0, 0.0), (2, 0, 1, 0, None, 0.0), (3, 0, 1, 0, float("nan"), 0.0)]
    return rows, spark.createDataFrame(rows, "uid bigint, daynum int, framenum int, camera int, x double, y double")


def met(rows, distance, frames):
    out = []
    for a in rows:
        for b in rows:
            if None not in a and None not in b and a[0] != b[0] and a[1] == b[1] and a[2] // frames == b[2] // frames and a[3] == b[3]:
                d = math.sqrt((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2)
                if d < distance:
                    out.append((a[1], a[2] // frames, a[3], a[0], b[0], round(d, 9)))
    return sorted(out)


def test_interactions_are_all_pairs_in_both_directions(sightings):
    rows, df = sightings
    got = events.interactions(df, 20, 10).collect()
    expected = met(rows, 20, 10)
    assert expected and sorted((r["daynum"], r["bucket"], r["camera"], r["uid"], r["partner"], round(r["d"], 9)) for r in got) == expected


def test_a_meeting_costs_no_decimal_and_no_hypot(spark):
    """A row of output is cheap: on sixty copies of the events there are a thousand million."""
    plan = catalogue.queries()["interactions"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "HYPOT" not in plan and "round(" not in plan


def test_rounded_roots_of_whole_numbers(spark):
    """Distances below 500 of whole positions: the rounding of `interactions` is that of `round`, for every one of them."""
    root = F.sqrt(F.col("id").cast("double"))
    assert spark.range(250_000).where(F.rint(root * 1e6) / 1e6 != F.round(root, 6)).count() == 0


@pytest.mark.parametrize("block, least", [(8192, 16), (2, 1), (100, 1)])
def test_first_meetings_in_blocks_of_any_size(spark, sightings, monkeypatch, block, least):
    """Pairs within a block and between two, whose partner's own time comes before, after, with the meeting, or never."""
    monkeypatch.setattr(meetings, "BLOCK", block)
    monkeypatch.setattr(meetings, "LEAST_BLOCKS", least)
    rows, df = sightings
    since = {u: u % 6 for u in range(23) if u % 4}
    got = meetings.first_meetings(df, spark.createDataFrame(list(since.items()), "uid bigint, at int"), 20, 10, 40).collect()
    first = {}
    for day, bucket, _, u, p, _ in met(rows, 20, 10):
        first[u, p] = min(first.get((u, p), 99), day * 4 + bucket)
    expected = sorted((u, p, t) for (u, p), t in first.items() if since.get(p, 99) < t)
    assert expected and len(expected) < len(first) and sorted(map(tuple, got)) == expected


def test_no_shuffle_holds_pairs(spark):
    plan = catalogue.queries()["prior_partners"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_i" in plan and "hashpartitioning(uid" in plan and not any("partner" in part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])


def test_no_sightings_no_meetings(spark):
    none = spark.createDataFrame([], "uid bigint, daynum int, framenum int, camera int, x int, y int")
    assert meetings.first_meetings(none, spark.createDataFrame([], "uid bigint, at int"), 20, 10).collect() == []


@pytest.fixture(scope="module")
def departures(spark, sightings):
    """Events of individuals that were seen before, or not, or only then, two of one individual at one time, and what plain loops count for them."""
    rows, _ = sightings
    events_ = [(k, who, (k * 5 + shift) % 25, k % 4, 3 + (k * 7) % 38) for k in range(60) for shift, who in ((0, "event"), (3, "control"))] + [(90, "event", 1, 1, 39), (91, "event", 1, 1, 39), (None, "event", 1, 1, 39)]
    since, expected = {u: 40 * (u % 3) + u for u in range(23) if u % 4}, []
    for key, who, uid, day, at in events_:
        first = {}
        for d, bucket, _, u, p, _ in met(rows, 20, 5):
            if u == uid and d == day and at - 17 < 5 * bucket < at:
                first[p] = min(first.get(p, 99), 5 * bucket)
        if first:
            expected.append((key, who, len(first), sum(since.get(p, 999) < 40 * day + t for p, t in first.items())))
    return spark.createDataFrame(events_, "event_id bigint, who string, uid bigint, daynum int, framenum int"), spark.createDataFrame(list(since.items()), "uid bigint, at int"), expected


@pytest.mark.parametrize("marks, blocks, piece", [(1 << 24, 4, 128), (1, 1, 1), (60, 30, 2)])
def test_partners_before_events_in_blocks_of_any_size(spark, sightings, departures, monkeypatch, marks, blocks, piece):
    for name, value in (("MARKS", marks), ("DAY_BLOCKS", blocks), ("SLICE", piece)):
        monkeypatch.setattr(meetings, name, value)
    before, since, expected = departures
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # an event's sightings come in several batches
    try:
        got = meetings.partners_before(before, sightings[1], since, 20, 17, 5, ["event_id", "who"], 40).where("partners > 0").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected)) and any(0 < e < n for *_, n, e in expected)


def test_blocks_of_a_day_grow_with_its_sightings(spark, sightings, departures, monkeypatch):
    monkeypatch.setattr(meetings, "DAY_ROWS", 3)
    before, since, expected = departures
    got = meetings.partners_before(before, sightings[1], since, 20, 17, 5, ["event_id", "who"], 40).where("partners > 0").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_no_shuffle_holds_partners_of_events(spark):
    """`before_leaves` counts partners within blocks: none of its shuffles has a row for an event and a partner."""
    plan = catalogue.queries()["before_leaves"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(daynum" in plan and not any("partner" in part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])


@pytest.mark.parametrize("strip, piece, cells", [(4, 128, 1 << 20), (1, 1, 1), (1, 5, 40), (100, 128, 60)])
def test_all_meetings_in_strips_and_pieces_of_any_size(spark, sightings, monkeypatch, strip, piece, cells):
    """Also sightings on the edges of strips, a strip in several batches, and two sightings of an individual."""
    for name, value in (("STRIP", strip), ("SLICE", piece), ("CELLS", cells)):
        monkeypatch.setattr(meetings, name, value)
    rows, df = sightings
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = meetings.all_meetings(df, 20, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["daynum"], r["bucket"], r["camera"], r["uid"], r["partner"], round(r["d"], 9)) for r in got) == met(rows, 20, 10)


def test_a_sighting_is_shuffled_once_or_twice_for_its_meetings(spark):
    """`interactions` deals sightings into strips, to the next one only from its edge, and joins no copies of them by squares."""
    plan = catalogue.queries()["interactions"](spark, DATA)._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("hashpartitioning(") == 1
