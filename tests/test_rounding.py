"""Six digits are rounded as the SQL rounds them, to the last bit, also next to a half of the sixth."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from combtrack.operators import stats
from combtrack.plans import catalogue, seasons, surfaces  # noqa: F401  (they register the queries)


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Four sightings of an individual 40 s apart, all on one side and at one x: a speed is pixels / 3200, often of seven digits with a 5 at the end."""
    start, path = datetime(2024, 1, 3), str(tmp_path_factory.mktemp("halves"))
    numbers = random.Random(1).sample(range(0, 1_000_000, 2), 4000)
    rows = [(numbers[i], start + timedelta(seconds=40 * (i % 4)), i // 4, "view", 1.0, '{"k": 50}') for i in range(4000)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["complete_rows", "speed_per_step", "timebin_metrics"])
def test_halves_are_those_of_the_sql(spark, halves, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{halves}/events.parquet/*.parquet'")
    own = catalogue.queries()[name](spark, halves)
    other = con.execute(f"SELECT {', '.join(own.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, own.collect()))) == sorted(map(str, other))


def test_six_digits_of_either_sign_and_of_none(spark):
    x = "(2 * id + 1) / 2e6 * if(id % 2 = 0, 1, -1)"
    own = spark.range(200_000).select(F.expr(x).alias("x")).select("x", catalogue.r6("x", "y"))
    con = duckdb.connect()
    other = con.execute("SELECT round((2 * id + 1) / 2e6 * if(id % 2 = 0, 1, -1), 6) AS y FROM range(200000) t(id) ORDER BY id").fetchall()
    assert [(r["y"],) for r in own.orderBy(F.abs("x")).collect()] == other
    rest = spark.sql("SELECT stack(4, null, double('NaN'), double('inf'), double('-inf')) AS x").select(catalogue.r6("x", "y"))
    assert [str(r["y"]) for r in rest.collect()] == ["None", "nan", "inf", "-inf"]


def test_quantiles_next_to_halves_are_those_of_the_sql(spark, halves):
    """Some of these individuals' 0.9 quantiles lie next to a half of the sixth digit."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{halves}/events.parquet/*.parquet'")
    own = catalogue.queries()["speed_quantiles"](spark, halves)
    other = con.execute(f"SELECT {', '.join(own.columns)} FROM ({catalogue.oracle_sql()['speed_quantiles']})").fetchall()
    assert sorted(map(str, map(tuple, own.collect()))) == sorted(map(str, other))


def test_quantiles_of_arrays_are_those_of_duckdb_to_the_last_bit(spark):
    some = random.Random(3)
    sets = [[some.choice([some.uniform(-5, 5), some.randrange(1, 20000) / 3200, some.expovariate(1), 0.0]) for _ in range(some.randrange(12))] for _ in range(1500)]
    shares = (0.0, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)
    df = spark.createDataFrame(list(enumerate(sets)), "k int, v array<double>").withColumn("v", F.array_sort("v"))
    own = df.select("k", *[stats.quantile_of(F.col("v"), q).alias(f"q{i}") for i, q in enumerate(shares)]).orderBy("k").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INTEGER, v DOUBLE[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[k, v] for k, v in enumerate(sets)])
    other = con.execute("SELECT k, " + ", ".join(f"(SELECT quantile_cont(x, {q}) FROM (SELECT unnest(v) AS x))" for q in shares) + " FROM t ORDER BY k").fetchall()
    assert [tuple(r) for r in own] == other


def test_quantiles_of_huge_numbers_are_finite(spark):
    """Where the halves of the digits overflow, the sum is that of the rounded products."""
    own = spark.sql("SELECT array(1e305D, 3e305D) AS v").select(stats.quantile_of(F.col("v"), 0.25).alias("q")).collect()
    assert own[0]["q"] == pytest.approx(1.5e305, rel=1e-15)
