"""Stateful streams give the batch's rows of the days that are over, over micro-batches, a late row and a restart."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from combtrack.config import HIVE_2018 as C
from combtrack.operators import events as ev
from combtrack.operators import states as st
from combtrack.streaming import states as live

BINS, NEAR, ABSENCE = 24, 500.0, 20_000


@pytest.fixture(scope="module")
def sightings(spark):
    """Three days of seven individuals in the order of time, and one sighting weeks later that moves the watermark past them."""
    rng = random.Random(2)
    rows = []
    for uid in range(7):
        for day in range(3):
            if uid == 3 and day == 1:
                continue
            for h in sorted(rng.sample(range(24), rng.choice([1, 2, 5, 9, 24]))):
                for _ in range(rng.randint(1, 4)):
                    rows.append((uid, (day * 86_400 + h * 3_600 + rng.randrange(3_600)) * 1_000, float(rng.choice([100, 400, 499, 501, 900]))))
    rows = sorted(set(rows), key=lambda r: r[1])
    rows = [(*r, i) for i, r in enumerate(rows)]
    last = (99, 30 * 86_400_000, 0.0, 10_000)
    return rows, last


def frame(spark, rows):
    df = spark.createDataFrame(rows, "uid bigint, ms bigint, exit_dist double, event_id bigint")
    return df.select("uid", (F.timestamp_millis(F.unix_millis(F.lit("2024-01-01").cast("timestamp")) + F.col("ms"))).alias("ts"), "exit_dist", "event_id")


def streamed(spark, tmp_path, work, name, sightings):
    """Five micro-batches, rows of one batch shuffled, a late row in the fourth, a restart after the second; the last moves the watermark."""
    rows, last = sightings
    source, sink, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    size = -(-len(rows) // 4)
    parts = [list(x) for x in itertools.batched(rows, size)]
    parts[3].append((5, 60_000, 100.0, 20_000))  # two days late
    for i, part in enumerate([*parts, [last]]):
        random.Random(i).shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        if i in (0, 2, 4):  # each start goes on where the checkpoint says
            stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = work(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
            query.awaitTermination(240)
            assert query.exception() is None and not query.isActive
    return sorted(tuple(r) for r in spark.read.parquet(sink).where("uid < 99").collect())


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def placed(spark, rows):
    df = live._placed(frame(spark, rows), C, "0 seconds")
    return df.withColumn("td", F.expr(f"framenum div {C.frames_per_day // BINS}").cast("int"))


def batch_states(spark, rows):
    seen = placed(spark, rows).groupBy("uid", "daynum", "td").agg(F.count("*").alias("n"), F.median("exit_dist").alias("m"))
    return st.in_hive(seen, ["uid", "daynum"], BINS, F.col("n") >= 1, F.col("m") < NEAR)


def test_in_hive(spark, tmp_path, sightings):
    own = streamed(spark, tmp_path, lambda s: live.in_hive(s, C, BINS, NEAR), "states", sightings)
    assert own == sorted(tuple(r) for r in batch_states(spark, sightings[0]).collect())


def test_hive_events(spark, tmp_path, sightings):
    own = streamed(spark, tmp_path, lambda s: live.hive_events(s, C, BINS, NEAR), "events", sightings)
    batch = st.hive_events(batch_states(spark, sightings[0]), ["uid", "daynum"], BINS, C.frames_per_day)
    assert own == sorted(tuple(r) for r in batch.collect()) and {r[-1] for r in own} == {"leave", "return", "no change"}


def test_leaves(spark, tmp_path, sightings):
    own = streamed(spark, tmp_path, lambda s: live.leave_events(s, C, NEAR, ABSENCE), "leaves", sightings)
    batch = ev.leave_events(placed(spark, sightings[0]), NEAR, ABSENCE).select("uid", "daynum", "framenum", "event_id", "gap", "status")
    assert own == sorted(tuple(r) for r in batch.collect()) and own


@pytest.mark.parametrize("same_bin", [False, True])
def test_decided_is_the_batch(spark, same_bin):
    """Every day of five bins: what is decided at the end is the batch, and no earlier word is taken back."""
    days = list(itertools.product((0, 1, 2), repeat=5))
    rows = [(i, 0, td, 100.0 if x == 2 else 900.0) for i, codes in enumerate(days) for td, x in enumerate(codes) if x]
    df = spark.createDataFrame(rows, "uid bigint, daynum int, td int, m double")
    batch = {}
    for r in st.in_hive(df, ["uid", "daynum"], 5, F.col("m").isNotNull(), F.col("m") < NEAR, same_bin).collect():
        batch.setdefault(r["uid"], {})[r["td"]] = r["state"]
    for i, codes in enumerate(days):
        states = live.decided(list(codes), 5, same_bin)
        assert states == [batch[i][td] for td in range(5)] if any(codes) else not states
        assert all(live.decided(list(codes[:k]), 5, same_bin) == states[: len(live.decided(list(codes[:k]), 5, same_bin))] for k in range(5))
