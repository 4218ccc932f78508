"""Ordered analytics over the rows of one individual; every window has a key and a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import HiveConfig
from ..functions import geometry as g

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def by_uid() -> WindowSpec:
    """An individual's rows across days."""
    return Window.partitionBy("uid").orderBy("daynum", "framenum")


def in_days() -> WindowSpec:
    """An individual's days, of which each is a row."""
    return Window.partitionBy("uid").orderBy("daynum")


def by_day() -> WindowSpec:
    """An individual's rows of a day, those of one frame in no order: for ranges of frames."""
    return Window.partitionBy("uid", "daynum").orderBy("framenum")


def total_order(df: DataFrame) -> list[str]:
    """The frame, then time and number of the sighting where the table has them, so that sightings of one frame have one order too."""
    return ["framenum", *(c for c in ("ts", "event_id") if c in df.columns)]


def in_order(df: DataFrame) -> WindowSpec:
    """An individual's rows of a day, one after the other."""
    return Window.partitionBy("uid", "daynum").orderBy(*total_order(df))


def running_visits(df: DataFrame, flag: Column) -> DataFrame:
    """`on` (the flag) and `visits`: rises of the flag so far, across days; the first row never counts as a rise.

    A scan in two levels: rises within each day, then of each individual's days, a row a day, the rises before it and
    whether its first sighting is one; no task takes a season's sightings.
    """
    out, w, first = df.withColumn("on", flag), in_order(df), F.struct(*total_order(df))
    out = out.withColumn("_rise", F.coalesce((F.lag("on").over(w) == 0) & (F.col("on") == 1), F.lit(False)).cast("int"))
    days = out.groupBy("uid", "daynum").agg(F.sum("_rise").alias("_n"), F.min_by("on", first).alias("_a"), F.max_by("on", first).alias("_z"))
    days = days.withColumn("_at_first", F.coalesce((F.lag("_z").over(in_days()) == 0) & (F.col("_a") == 1), F.lit(False)).cast("int"))
    upto = F.sum(F.col("_n") + F.col("_at_first")).over(in_days().rowsBetween(*UP_TO_HERE))
    days = days.select("uid", "daynum", (upto - F.col("_n")).alias("_before"))
    visits = F.col("_before") + F.sum("_rise").over(w.rowsBetween(*UP_TO_HERE))
    return out.join(days, ["uid", "daynum"]).withColumn("visits", visits).select(*df.columns, "on", "visits")


def recent_visits(df: DataFrame, frames: int) -> DataFrame:
    """`recent`: visits since the first sighting of the day at most `frames` earlier (as-of look-back as a range frame).

    Visits never fall, so the first sighting has the least of them, in whatever order those of its frame come.
    """
    back = by_day().rangeBetween(-frames, 0)
    return df.withColumn("recent", F.col("visits") - F.min("visits").over(back))


def gap_after(df: DataFrame) -> DataFrame:
    """`gap`: frames to the next sighting of the day; null at the last."""
    return df.withColumn("gap", F.lead("framenum").over(in_order(df)) - F.col("framenum"))


def speed_steps(df: DataFrame, c: HiveConfig, max_seconds: float) -> DataFrame:
    """`distance` (cm) and `speed` (cm/s) from the row before; null across days, cameras, gaps over `max_seconds` and in no time."""
    w = in_order(df)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / c.pixels_per_cm
    seconds = (F.col("framenum") - F.lag("framenum").over(w)) / c.fps
    out = df.withColumns({"distance": step, "_s": seconds, "_c": F.lag("camera").over(w)})
    fine = (F.col("_c") == F.col("camera")) & (F.col("_s") <= max_seconds) & (F.col("_s") > 0)
    return out.withColumn("speed", F.when(fine, F.try_divide("distance", "_s"))).drop("_s", "_c")


def bouts(df: DataFrame, key: str = "uid", at: str = "td", state: str = "state", part: str | None = None) -> DataFrame:
    """(key, state, start, end, length): runs of one state; a null is a run of its own, and left out.

    With `part`, a column that grows with `at` (the day), runs are found within each part, and only they, not the rows,
    are put in order by key: one that ends a part goes on in the one that begins the next.
    """
    if part is None:
        w = Window.partitionBy(key).orderBy(at)
        cut = F.when(F.col(state).isNull() | F.lag(state).over(w).isNull() | (F.lag(state).over(w) != F.col(state)), 1).otherwise(0)
        runs = df.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w.rowsBetween(*UP_TO_HERE)))
        runs = runs.where(F.col(state).isNotNull()).groupBy(key, "_run", F.col(state).alias("state"))
        return runs.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("length")).drop("_run")
    w = Window.partitionBy(key, part).orderBy(at)
    cut = F.coalesce((~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("int"), F.lit(1))  # nulls next to one another are one cut here
    runs = df.withColumn("_cut", cut).withColumns({"_run": F.sum("_cut").over(w.rowsBetween(*UP_TO_HERE)), "_first": F.row_number().over(w) == 1, "_last": F.lead(at).over(w).isNull()})
    runs = runs.groupBy(key, part, "_run").agg(F.first(state).alias("state"), F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("length"), F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    over = Window.partitionBy(key).orderBy("start")
    goes_on = F.col("_first") & F.lag("_last").over(over) & (F.lag("state").over(over) == F.col("state"))
    runs = runs.withColumn("_nth", F.sum(1 - F.coalesce(goes_on, F.lit(False)).cast("int")).over(over.rowsBetween(*UP_TO_HERE)))
    return runs.where("state is not null").groupBy(key, "_nth", "state").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length")).drop("_nth")


def uncensored(runs: DataFrame, key: str = "uid") -> DataFrame:
    """Bouts other than an individual's first and last, whose true length isn't known."""
    w = Window.partitionBy(key)
    out = runs.withColumns({"_first": F.min("start").over(w), "_last": F.max("end").over(w)})
    return out.where((F.col("start") != F.col("_first")) & (F.col("end") != F.col("_last"))).drop("_first", "_last")


def plot_segments(df: DataFrame, jump: float, least: int = 2) -> DataFrame:
    """`segment` of each row: numbers runs without a jump or change of camera; rows of shorter runs than `least` are left out."""
    w = in_order(df)
    far = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > jump
    cut = F.coalesce(far | (F.lag("camera").over(w) != F.col("camera")), F.lit(True)).cast("int")
    out = df.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(*UP_TO_HERE)))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("uid", "daynum", "segment"))).where(F.col("_n") >= least).drop("_n", "_cut")


def largest_gap(df: DataFrame) -> DataFrame:
    """(uid, daynum, left, back, gap): the longest absence of the day between two sightings, the first of equal ones."""
    gaps = gap_after(df).where("gap is not null")
    best = gaps.groupBy("uid", "daynum").agg(F.max(F.struct("gap", (-F.col("framenum")).alias("f"))).alias("m"))
    return best.select("uid", "daynum", (-F.col("m.f")).alias("left"), (F.col("m.gap") - F.col("m.f")).alias("back"), F.col("m.gap").alias("gap"))


def met_within(events: DataFrame, rows: DataFrame, at: str, before: int, after: int, keys: tuple[str, ...] = ("uid", "daynum"), frame: str = "framenum") -> DataFrame:
    """Rows with the events of their keys from `before` frames before it to `after` frames behind it (negative: on the other side).

    An interval join: both meet by keys and a stretch of frames as long as the interval, an event in each of the two or
    three that its interval touches, so a row meets the events next to it instead of all of the day's.
    """
    width = max(1, before + after + 1)
    near = F.sequence(F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width))
    spread = events.withColumn("_stretch", F.explode(F.when(F.lit(before + after >= 0), near).otherwise(F.array().cast("array<bigint>"))))
    found = rows.withColumn("_stretch", F.floor(F.col(frame) / width)).join(spread, [*keys, "_stretch"])
    return found.where(F.col(frame).between(F.col(at) - before, F.col(at) + after)).drop("_stretch")


def around_gap(events: DataFrame, rows: DataFrame, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """The longest absence of an individual round each event (event_id, uid, daynum, framenum), and the sightings round that.

    First (event_id, uid, daynum, new_frame, return_frame, last_frame): in the closed window of frames round the event,
    the frame after the sighting before the longest gap (the first of equal ones), the sighting after it, or -1 where
    the day's last sighting is at that new frame, and the last sighting. An event with fewer than two sightings in its
    window has null frames. Second (event_id, daynum, uid, framenum, sighting) of the window round the new frame.
    """
    e = events.select("event_id", "uid", "daynum", F.col("framenum").alias("_at"))
    r = rows.select("uid", "daynum", "framenum", F.col("event_id").alias("sighting"))
    last = r.groupBy("uid", "daynum").agg(F.max("framenum").alias("last_frame"))
    near = met_within(e, r, "_at", before, after)
    following = F.lead("framenum").over(Window.partitionBy("event_id").orderBy("framenum", "sighting"))
    gaps = near.withColumn("_next", following).where("_next is not null")
    best = gaps.groupBy("event_id").agg(F.max(F.struct((F.col("_next") - F.col("framenum")).alias("gap"), (-F.col("framenum")).alias("f"))).alias("_m"))
    new = e.join(best, "event_id", "left").join(last, ["uid", "daynum"], "left").withColumn("new_frame", 1 - F.col("_m.f"))
    back = F.when(F.col("last_frame") == F.col("new_frame"), -1).otherwise(F.col("_m.gap") - F.col("_m.f"))
    found = new.select("event_id", "uid", "daynum", "new_frame", F.when(F.col("new_frame").isNotNull(), back).alias("return_frame"), "last_frame")
    view = met_within(found.where("new_frame is not null"), r, "new_frame", before, after)
    return found, view.select("event_id", "daynum", "uid", "framenum", "sighting")


def numbered_rows(df: DataFrame, every: int) -> DataFrame:
    """`index` of each sighting in its individual's day, from 0, and `phase`, the index modulo `every`."""
    out = df.withColumn("index", F.row_number().over(in_order(df)) - 1)
    return out.withColumn("phase", F.col("index") % every)


def best_confidence(df: DataFrame, threshold: float) -> DataFrame:
    """The detection of highest confidence per individual and frame (ties: the latest, then the higher event), if above the threshold."""
    w = Window.partitionBy("uid", "daynum", "framenum").orderBy(F.desc("confidence"), F.desc("ts"), F.desc("event_id"))
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("confidence") > threshold)).drop("_n")


def trailing_mean(df: DataFrame, column: str, frames: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(column).over(by_day().rangeBetween(-frames, 0)))


def flat_step(df: DataFrame) -> Column:
    """Distance from the row before in folded coordinates."""
    w = in_order(df)
    return F.hypot(F.col("fx") - F.lag("fx").over(w), F.col("fy") - F.lag("fy").over(w))


def scaled(df: DataFrame, c: HiveConfig) -> DataFrame:
    """Positions in the scale of the season's maps."""
    return df if c.scale == 1 else df.withColumns({k: F.col(k) / c.scale for k in ("x", "y")})


def with_geometry(df: DataFrame, c: HiveConfig) -> DataFrame:
    return df.withColumns({"xa": g.x_unfolded(c), "fx": g.x_flat(c), "fy": g.y_flat(c), "exit_dist": g.exit_distance(c), "frame": g.frame_index(c)})
