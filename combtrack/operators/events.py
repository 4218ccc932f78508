"""Leave and return events, interactions and look-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HIVE_2018
from .meetings import all_meetings
from .windows import gap_after, in_order, met_within, total_order


def leave_events(df: DataFrame, exit_distance: float, absence: int) -> DataFrame:
    """The sightings close to the exit after which an individual isn't seen for at least `absence` frames.

    A sighting right after such a one is a return, not another leave.
    """
    out = gap_after(df).withColumn("_leave", F.coalesce((F.col("gap") >= absence) & (F.col("exit_dist") <= exit_distance), F.lit(False)))
    out = out.withColumn("_back", F.coalesce(F.lag("_leave").over(in_order(df)), F.lit(False)))
    return out.where("_leave and not _back").drop("_leave", "_back").withColumn("status", F.lit("leave"))


def typed_events(events: DataFrame, short: int, frames_per_day: int = HIVE_2018.frames_per_day) -> DataFrame:
    """`kind` of leaves and returns by the individual's next event: short or long with return, disappeared, not sure, or return event."""
    w = Window.partitionBy("uid").orderBy("daynum", "framenum")
    own = events.where(F.col("status").isin("leave", "return"))
    at = F.col("daynum").cast("bigint") * frames_per_day + F.col("framenum")
    own = own.withColumns({"_next": F.lead("status").over(w), "_gap": F.lead(at).over(w) - at})
    kind = F.when(F.col("status") == "return", "return event").when(F.col("_next").isNull(), "disappeared").when(F.col("_next") == "leave", "not sure").when(F.col("_gap") < short, "short with return").otherwise("long with return")
    return own.withColumn("kind", kind).drop("_next", "_gap")


def marked(rows: DataFrame, events: DataFrame, keys: list[str], status: str = "leave") -> DataFrame:
    """All rows with `status`, where the key is among the events, else `no change`; null keys match each other."""
    own = events.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
    match = F.lit(True)
    for k in keys:
        match = match & rows[k].eqNullSafe(own[f"_{k}"])
    return rows.join(own, match, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise("no change")).drop("_hit", *[f"_{k}" for k in keys])


def thinned(df: DataFrame, every: int) -> DataFrame:
    """Every k-th sighting of an individual's day."""
    return df.withColumn("_n", F.row_number().over(in_order(df))).where(F.col("_n") % every == 1 % every).drop("_n")


def interactions(df: DataFrame, distance: float, frames: int, asked: DataFrame | None = None) -> DataFrame:
    """(daynum, bucket, camera, uid, partner, d): pairs of individuals on one side, closer than `distance` in the same `frames` frames.

    With `asked` (uid, daynum, bucket) only meetings of those individuals at those times are listed, with any partner: an
    equality join on day, bucket, side and squares of `distance` pixels, where their rows meet their own square and the
    eight round it.
    """
    if asked is None:
        return all_meetings(df, distance, frames)
    side = df.withColumns({"bucket": F.expr(f"framenum div {frames}"), "_gx": F.floor(F.col("x") / distance), "_gy": F.floor(F.col("y") / distance)})
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    a = side.join(asked, ["uid", "daynum", "bucket"], "left_semi")
    a = a.select("daynum", "bucket", "camera", "uid", "x", "y", F.explode(near).alias("_n"), "_gx", "_gy")
    a = a.withColumns({"_gx": F.col("_gx") + F.col("_n.i"), "_gy": F.col("_gy") + F.col("_n.j")}).drop("_n")
    b = side.select("daynum", "bucket", "camera", F.col("uid").alias("partner"), F.col("x").alias("_px"), F.col("y").alias("_py"), "_gx", "_gy")
    pairs = a.join(b, ["daynum", "bucket", "camera", "_gx", "_gy"]).where("uid <> partner")
    dx, dy = ((F.col(a) - F.col(b)).cast("double") for a, b in (("x", "_px"), ("y", "_py")))
    pairs = pairs.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") < distance)
    return pairs.select("daynum", "bucket", "camera", "uid", "partner", "d")


def history(events: DataFrame, df: DataFrame, frames: int) -> DataFrame:
    """Sightings of the day in the open interval of `frames` frames before each event, with the event's frame."""
    e = events.select("uid", "daynum", F.col("framenum").alias("event_frame"))
    return met_within(e, df, "event_frame", frames - 1, -1)


def pivot_state(states: DataFrame, bins: int) -> DataFrame:
    """One row per individual and day, a column for each bin."""
    return states.groupBy("uid", "daynum").agg(*[F.max(F.when(F.col("td") == i, F.col("state"))).alias(f"t{i}") for i in range(bins)])


def upsampled(df: DataFrame, step: int, columns: list[str]) -> DataFrame:
    """A row every `step` frames between an individual's first and last sighting of the day, columns interpolated linearly.

    Every column goes by its own sightings, those where it isn't null: between two of them by their frames, beyond its
    first or last one it keeps that value. Of several in one frame the last counts.
    """
    ends = df.groupBy("uid", "daynum").agg(F.min("framenum").alias("_a"), F.max("framenum").alias("_b"))
    full = ends.select("uid", "daynum", F.explode(F.sequence("_a", "_b", F.lit(step))).alias("framenum"))
    last = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(*total_order(df), F.col(c).alias("_v"))))["_v"] for c in columns}
    frames = df.groupBy("uid", "daynum", "framenum").agg(*[x.alias(c) for c, x in last.items()])  # a row a frame: its last sighting of each column
    both = full.withColumn("_grid", F.lit(True)).join(frames, ["uid", "daynum", "framenum"], "full")
    whole = in_order(both)
    before, after = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(0, Window.unboundedFollowing)
    seen = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("framenum").alias("f"), F.col(c).alias("v"))) for c in columns}
    both = both.withColumns({f"_{c}0": F.last(x, True).over(before) for c, x in seen.items()} | {f"_{c}1": F.first(x, True).over(after) for c, x in seen.items()})

    def between(c: str) -> Column:
        a, b = F.col(f"_{c}0"), F.col(f"_{c}1")
        share = F.coalesce(F.try_divide(F.col("framenum") - a["f"], b["f"] - a["f"]), F.lit(0.0))
        return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share).alias(c)

    return both.where("_grid").select("uid", "daynum", "framenum", *map(between, columns))


def first_fine(starts: DataFrame, rows: DataFrame, width: int, frames_per_day: int, flag: Column) -> DataFrame:
    """(uid, daynum, framenum): the first flagged row within `width` frames after each individual's coarse start.

    The window is open and null is given where it would cross midnight or holds no such row. `starts`: one row (uid,
    daynum, framenum) per individual.
    """
    begun = starts.select("uid", F.col("daynum").alias("_day"), F.col("framenum").alias("_from"))
    asked = begun.where(F.col("_from") + width < frames_per_day).withColumnRenamed("_day", "daynum")
    hits = met_within(asked, rows.where(flag).select("uid", "daynum", "framenum"), "_from", -1, width - 1)
    first = hits.groupBy("uid").agg(F.min("framenum").alias("framenum"))
    return begun.join(first, "uid", "left").select("uid", F.when(F.col("framenum").isNotNull(), F.col("_day")).alias("daynum"), "framenum")


def among_events(rows: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose every key has a value that some event has, each on its own: not the same event. `marked` is the pairwise form."""
    for key in keys:
        rows = rows.join(events.select(key).distinct(), key, "left_semi")
    return rows


def not_yet(rows: DataFrame, first: DataFrame, at: Column, margin: int) -> DataFrame:
    """Rows of individuals without a first event (uid, first) up to `margin` after the row's time."""
    out = rows.join(first.select("uid", F.col("first").alias("_first")), "uid", "left")
    return out.where(F.col("_first").isNull() | (F.col("_first") > at + margin)).drop("_first")
