"""Tables that models learn from, and events beside their controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HIVE_2018
from ..functions import timeops
from . import events as ev
from .identity import id_of, mapped
from .meetings import partners_before
from .windows import met_within, recent_visits


def training_table(rows: DataFrame, leaves: DataFrame, ages: DataFrame, every: int, look_back: int) -> DataFrame:
    """(event_id, uid, age, year ... second, recent, status): every k-th sighting and all leaves, told apart by `status`.

    A leave is that sighting alone, not another one of its individual in its frame.

    `rows` has `visits`, the running number of visits, of which those within `look_back` frames among the rows that are
    left count as `recent`. `ages` has (id, age), where the id may be text like `12` or `12.0`; an individual that is
    named twice with one age counts once.
    """
    named = ev.marked(rows, leaves, ["event_id"]).withColumn("status", mapped(F.col("status") == "leave", {True: "leave", False: "no change"}))
    kept = ev.thinned(named, every).union(named.where("status = 'leave'")).distinct()
    known = ages.select(id_of(F.col("id")).alias("_id"), F.col("age").cast("int").alias("age")).distinct()
    out = recent_visits(kept, look_back).join(known, F.col("uid") == F.col("_id"), "left")
    return out.select("event_id", "uid", "age", *[v.alias(k) for k, v in timeops.parts_of(F.col("ts")).items()], "recent", "status")


def foraging_labels(rows: DataFrame, hive_events: DataFrame, ages: DataFrame, direction: int = -1) -> DataFrame:
    """Rows with `forage` and `age`: 1 where the row's frame is one at which somebody left that day, and its individual left that day.

    Both hold on their own, so it needn't be the same event. `direction` -1 takes departures, 1 returns.
    """
    gone = hive_events.where(F.col("diff") == direction)
    frames = gone.select("daynum", "framenum").distinct().withColumn("_f", F.lit(1))
    who = gone.select("daynum", "uid").distinct().withColumn("_u", F.lit(1))
    known = ages.select("uid", "age").distinct()
    out = rows.join(frames, ["daynum", "framenum"], "left").join(who, ["daynum", "uid"], "left").join(known, "uid", "left")
    return out.withColumn("forage", F.coalesce(F.col("_f") * F.col("_u"), F.lit(0))).drop("_f", "_u")


def before_events(events: DataFrame, rows: DataFrame, first: DataFrame, distance: float, frames: int, bucket: int, frames_per_day: int = HIVE_2018.frames_per_day) -> DataFrame:
    """Events (event_id, who, uid, daynum, framenum) with what their `uid` did in the `frames` frames before: partners and speed.

    partners: distinct individuals met, as `interactions` has them with `distance` and `bucket` frames to a bucket;
    earlier_partners: those whose own first event (uid, at: day and frame in one number) came before they were met. mean
    and highest `speed` leave out what isn't a number; `seen` is the share of the frames with a sighting.
    """
    keys = ["event_id", "who"]
    e = events.select(*keys, "uid", "daynum", F.col("framenum").alias("_at"))
    speed = F.when(~F.isnan("speed"), F.col("speed"))
    moved = met_within(e, rows.select("uid", "daynum", "framenum", "speed"), "_at", frames - 1, -1)
    moved = moved.groupBy(*keys).agg(F.avg(speed).alias("mean_speed"), F.max(speed).alias("max_speed"), (F.count("*") / frames).alias("seen"))
    met = partners_before(events, rows, first, distance, frames, bucket, keys, frames_per_day)
    out = e.drop("_at", "daynum").join(met, keys, "left").join(moved, keys, "left")
    none = {"partners": 0, "earlier_partners": 0, "seen": 0.0}
    return out.select(*keys, "uid", *[F.coalesce(c, F.lit(none[c])).alias(c) if c in none else F.col(c) for c in ("partners", "earlier_partners", "mean_speed", "max_speed", "seen")])
