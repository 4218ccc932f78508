"""Sightings of one individual in one frame come in one order, by time and number, however they arrive."""

import re
from datetime import datetime, timedelta

import duckdb
import pytest

from combtrack.operators import events
from combtrack.plans import catalogue, seasons, surfaces  # noqa: F401  (they register the queries)

from test_catalogue import rows

NAMES = "complete_rows crossing_matrix dance_arrivals left_indicator_merge recent_visits right_join_events running_index speed_hist speed_per_step speed_quantiles timebin_metrics training_table union_distinct_thinned upsample_interpolate"


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """The same sightings in two files, several to a frame, forwards and backwards."""
    start, rows = datetime(2024, 1, 3), []
    for u in range(6):
        for i in range(120):
            at = start + timedelta(seconds=600 * (i // 3) + (i > 60) * 20_000, milliseconds=90 * (i % 3))
            n = 1000 * u + (i * 7919) % 997
            rows.append((n, at, u, "view", float(n % 500), f'{{"k": {(143 + n * 31) % 100}}}'))
    out = []
    for name, some in (("a", rows), ("b", rows[::-1])):
        path = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(some, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
        out.append(path)
    return out


@pytest.mark.parametrize("name", NAMES.split())
def test_rows_do_not_depend_on_arrival(spark, arrivals, name):
    one, other = (sorted(map(str, catalogue.queries()[name](spark, d).collect())) for d in arrivals)
    assert one == other and one


def ordered(sql):
    """The SQL with its open ties closed as in the queries: sightings of a frame by time and number; the first of a range of frames is that of the least visits."""
    sql = re.sub(r"ORDER BY (daynum, )?framenum(?=[)])", r"ORDER BY \1framenum, ts, event_id", sql)
    sql = re.sub(r"ORDER BY daynum, framenum (?=ROWS)", "ORDER BY daynum, framenum, ts, event_id ", sql)
    return sql.replace("first_value(visits)", "min(visits)").replace("SELECT event_id, uid, daynum, framenum, row_number()", "SELECT event_id, uid, daynum, framenum, ts, row_number()")


@pytest.fixture(scope="module")
def partings(spark, tmp_path_factory):
    """Sightings, two to a frame, with long absences behind them, so that of two in one frame the second may be a leave."""
    start, path = datetime(2024, 1, 3), str(tmp_path_factory.mktemp("partings"))
    rows = [(1000 * u + (i * 7919) % 997, start + timedelta(seconds=600 * (i // 2) + 9000 * (i // 10), milliseconds=90 * (i % 2)), u, "view", float(i), f'{{"k": {(143 + u * 17 + i * 31) % 100}}}') for u in range(40) for i in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", [n for n in NAMES.split() if n != "upsample_interpolate"])
@pytest.mark.parametrize("kind", ["arrivals", "partings"])
def test_same_as_duckdb_but_for_the_order_of_ties(spark, arrivals, partings, name, kind):
    con, path = duckdb.connect(), arrivals[0] if kind == "arrivals" else partings
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    own, other = catalogue.queries()[name](spark, path), con.execute(ordered(catalogue.oracle_sql()[name]))
    assert rows(own.columns, own.collect()) == rows([c[0] for c in other.description], other.fetchall())


def test_a_frame_with_two_sightings_is_one_step_of_the_grid(spark):
    rows = [(1, 0, 0, 1, 10.0), (1, 0, 0, 2, 20.0), (1, 0, 10, 3, 40.0), (1, 0, 10, 4, None)]
    df = spark.createDataFrame(rows, "uid bigint, daynum int, framenum int, event_id bigint, x double")
    got = events.upsampled(df, 5, ["x"]).orderBy("framenum").collect()
    assert [(r["framenum"], r["x"]) for r in got] == [(0, 20.0), (5, 30.0), (10, 40.0)]


@pytest.mark.parametrize("name", ["leave_events", "plot_segments"])
@pytest.mark.parametrize("kind", ["arrivals", "partings"])
def test_leaves_and_segments_as_duckdb_but_for_the_order_of_ties(spark, arrivals, partings, name, kind):
    con, paths = duckdb.connect(), arrivals if kind == "arrivals" else [partings]
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{paths[0]}/events.parquet/*.parquet'")
    sql = ordered(catalogue.oracle_sql()[name]).replace("ORDER BY framenum ROWS", "ORDER BY framenum, ts, event_id ROWS")
    other = con.execute(sql)
    expected = rows([c[0] for c in other.description], other.fetchall())
    for path in paths:  # however the sightings arrive
        own = catalogue.queries()[name](spark, path)
        assert rows(own.columns, own.collect()) == expected
