"""The table of metrics per individual and time bin, and what is rolled up from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HiveConfig
from ..functions import geometry as g

#: Classes of comb contents by code (fixed values of the label images).
HONEY, BROOD, EMPTY, POLLEN, DANCE, FESTOON = (0,), (1, 2), (3,), (4,), (5,), (13,)
#: How columns of the time-bin table become columns of a day.
DAY_SUMS = ["n", "trips", "dance_visits", *[f"crossings_{i}" for i in range(6)]]
DAY_MEANS = ["dispersion_minute"]
DAY_WEIGHTED = ["honey", "brood", "pollen", "dance", "other", *[f"frame_{i}" for i in range(6)], "speed_median", "speed_iqr", "speed_q90", "dispersion", "exit_median", "fraction_squares", "festoon", "empty"]


def _count(what: Column) -> Column:
    return F.sum(F.coalesce(what, F.lit(False)).cast("bigint"))


def bin_metrics(rows: DataFrame, c: HiveConfig, bins: int, least: int = 10, zero_fill: bool = False, max_seconds: float = 1.0, trip_frames: int = 1800, part_frames: int = 180, dance_floor: bool = False) -> DataFrame:
    """One row per individual, day and bin of the day (uid, daynum, td) with all metrics of a bin.

    `rows` has geometry, `event_id`, two codes of comb contents (`code0`, `code1`: the maps before and after the day) and
    their `weight0`, `weight1`. With `dance_floor` its rectangle overrides both codes. Rows of a bin are taken in the
    order of frames; a step counts for speed on one side within `max_seconds`. `dispersion_minute` and
    `tortuosity_minute` are means over parts of `part_frames` with three rows or more. A trip is an absence of
    `trip_frames` after the frame of the exit. Bins with fewer than `least` rows have null metrics, or 0 with
    `zero_fill`, and keep their number.
    """
    width = c.frames_per_day // bins
    bin_ = ["uid", "daynum", "td"]
    rows = rows.withColumns({"td": F.expr(f"framenum div {width}").cast("int"), "_part": F.expr(f"framenum div {part_frames}")}).repartition(*bin_)
    if dance_floor:
        on = g.within(c, c.dance_floor) == 1
        rows = rows.withColumns({k: F.when(on, DANCE[0]).otherwise(F.col(k)) for k in ("code0", "code1")})
    whole, part = Window.partitionBy(*bin_), Window.partitionBy(*bin_, "_part")
    w, w_part = whole.orderBy("framenum", "event_id"), part.orderBy("framenum", "event_id")
    lag = lambda k, by=w: F.lag(k).over(by)
    flat = lambda by: F.hypot(F.col("fx") - lag("fx", by), F.col("fy") - lag("fy", by))
    seconds = (F.col("framenum") - lag("framenum")) / c.fps
    fine = (lag("camera") == F.col("camera")) & (seconds > 0) & (seconds <= max_seconds)
    gap = F.lead("framenum").over(w) - F.col("framenum")
    to_end = F.lit(width) - (F.col("framenum") - F.col("td") * width)
    off = lambda by: F.hypot(F.col("fx") - F.avg("fx").over(by), F.col("fy") - F.avg("fy").over(by))
    rows = rows.withColumns({
        "_flat": flat(w), "_speed": F.when(fine, F.try_divide(flat(w), seconds)), "_off": off(whole), "_off_part": off(part), "_flat_part": flat(w_part),
        "_frame": g.frame_in_image(c), "_cell": g.cell(c), "_crossed": F.coalesce(lag("frame") != F.col("frame"), F.lit(False)),
        "_arrived": (lag("code0") != F.col("code0")) & (F.col("code0") == DANCE[0]),
        "_away": F.when(gap.isNotNull(), gap >= trip_frames).otherwise(to_end > trip_frames),
    })
    ends = F.hypot(F.max_by("fx", F.struct("framenum", "event_id")) - F.min_by("fx", F.struct("framenum", "event_id")), F.max_by("fy", F.struct("framenum", "event_id")) - F.min_by("fy", F.struct("framenum", "event_id")))
    parts = rows.groupBy(*bin_, "_part").agg(F.count("*").alias("_k"), F.avg("_off_part").alias("_d"), F.try_divide(F.sum("_flat_part"), ends).alias("_t"))
    parts = parts.where("_k >= 3").groupBy(*bin_).agg(F.avg("_d").alias("dispersion_minute"), F.avg("_t").alias("tortuosity_minute"))

    def on_class(codes: tuple[int, ...]) -> Column:
        share = lambda i: F.when(F.col(f"code{i}").isin(*codes), F.col(f"weight{i}")).otherwise(0.0)
        return F.sum(share(0) + share(1))

    q = lambda k, *shares: F.expr(f"percentile({k}, array({', '.join(map(str, shares))}))")
    out = rows.groupBy(*bin_).agg(
        F.count("*").alias("n"), *[on_class(x).alias(f"_{k}") for k, x in (("honey", HONEY), ("brood", BROOD), ("pollen", POLLEN), ("dance", DANCE), ("festoon", FESTOON), ("empty", EMPTY))],
        *[_count(F.col("_frame") == i).alias(f"_frame_{i}") for i in range(6)], q("_speed", 0.25, 0.5, 0.75, 0.9).alias("_s"), F.avg("_off").alias("dispersion"), F.try_divide(F.sum("_flat"), ends).alias("tortuosity"),
        F.avg("exit_dist").alias("exit_mean"), F.stddev_pop("exit_dist").alias("exit_std"), q("exit_dist", 0.25, 0.5, 0.75).alias("_e"), F.size(F.collect_set("_cell")).alias("_cells"),
        _count((F.col("_frame") == 5) & F.col("_away")).alias("trips"), _count(F.col("_arrived")).alias("dance_visits"), *[_count(F.col("_crossed") & (F.col("frame") == i)).alias(f"crossings_{i}") for i in range(6)],
    ).join(parts, bin_, "left")
    enough, n = F.col("n") >= least, F.col("n")
    own = {k: F.try_divide(F.col(f"_{k}"), n) for k in ("honey", "brood", "pollen", "dance")}
    own["other"] = F.try_divide(n - F.col("_honey") - F.col("_brood") - F.col("_pollen") - F.col("_dance"), n)
    own |= {f"frame_{i}": F.try_divide(f"_frame_{i}", n) for i in range(6)}
    own |= {"speed_median": F.col("_s")[1], "speed_iqr": F.col("_s")[2] - F.col("_s")[0], "speed_q90": F.col("_s")[3]}
    own |= {"dispersion": F.col("dispersion"), "dispersion_minute": F.col("dispersion_minute"), "tortuosity": F.col("tortuosity"), "tortuosity_minute": F.col("tortuosity_minute")}
    own |= {"exit_mean": F.col("exit_mean"), "exit_std": F.col("exit_std"), "exit_median": F.col("_e")[1], "exit_iqr": F.col("_e")[2] - F.col("_e")[0]}
    own |= {"fraction_squares": F.try_divide(F.col("_cells"), F.lit(c.x_bins * c.y_bins)) if bins == 24 else F.lit(None).cast("double"), "festoon": F.col("_festoon"), "empty": F.col("_empty")}
    own |= {k: F.col(k) for k in ("trips", "dance_visits", *[f"crossings_{i}" for i in range(6)])}
    return out.select(*bin_, "n", *[F.when(enough, F.coalesce(v, F.lit(0)) if zero_fill else v).otherwise(F.lit(0) if zero_fill else None).alias(k) for k, v in own.items()])


def with_identity(table: DataFrame, identity: DataFrame, age: Column) -> DataFrame:
    """The table with `cohort` and `age`, which are -1 where the individual isn't born yet, its tag is worn again, or nobody knows it."""
    out = table.join(identity, "uid", "left").withColumn("age", F.coalesce(age, F.lit(-1)))
    return out.withColumn("cohort", F.when(F.col("age") >= 0, F.col("cohort")).otherwise(-1)).select(*table.columns, "cohort", "age")


def day_matrix(table: DataFrame, hour: Column, *outside: DataFrame) -> DataFrame:
    """One row per individual and day: sums, means, means weighted by sightings, a circadian coefficient of speed.

    A weighted mean leaves out bins without a value above, but not their sightings below the line. `outside` are tables
    by (uid, daynum), joined by both keys: who is missing in one is left out.
    """
    first = [c for c in ("age", "cohort") if c in table.columns]
    weighted = lambda k: F.try_divide(F.sum(F.col(k) * F.col("n")), F.sum("n"))
    cells = [F.min_by(c, "td").alias(c) for c in first] + [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DAY_SUMS] + [F.avg(c).alias(c) for c in DAY_MEANS] + [weighted(c).alias(c) for c in DAY_WEIGHTED]
    known = F.when(F.col("speed_median").isNotNull(), g.circadian(hour) * F.col("speed_median"))
    out = table.groupBy("uid", "daynum").agg(*cells, F.try_divide(F.avg(known), F.avg("speed_median")).alias("circadian"))
    for other in outside:
        out = out.join(other, ["uid", "daynum"])
    return out


def day_histograms(rows: DataFrame, c: HiveConfig) -> DataFrame:
    """(uid, daynum, cell, xbin, ybin, n): sightings per square of the comb, only squares that have some."""
    counts = rows.withColumn("cell", g.cell(c)).where("cell is not null").groupBy("uid", "daynum", "cell").agg(F.count("*").alias("n"))
    return counts.select("uid", "daynum", "cell", *g.cell_bins(F.col("cell"), c), "n")


def _in_bins(rows: DataFrame, c: HiveConfig, bins: int, least: int, part_frames: int) -> DataFrame:
    """`td`, `_part`, rows of the bin (`n`) and of the part (`_m`), and how many parts have rows (`_parts`); bins under `least` go. One exchange."""
    width, bin_ = c.frames_per_day // bins, ["uid", "daynum", "td"]
    rows = rows.withColumns({"td": F.expr(f"framenum div {width}").cast("int"), "_part": F.expr(f"framenum div {part_frames}")}).repartition(*bin_)
    whole, part = Window.partitionBy(*bin_), Window.partitionBy(*bin_, "_part")
    rows = rows.withColumns({"_m": F.count("*").over(part), "_nth": F.row_number().over(part.orderBy("framenum", "event_id"))})
    rows = rows.withColumns({"n": F.count("*").over(whole), "_parts": F.sum((F.col("_nth") == 1).cast("int")).over(whole)})
    return rows.where(F.col("n") >= least).drop("_nth")


def bin_cells(rows: DataFrame, c: HiveConfig, bins: int, least: int = 10, part_frames: int = 180) -> DataFrame:
    """(uid, daynum, td, cell, xbin, ybin, n, n_minute, speed, speed_minute): histograms over the squares of the comb, only squares that have some.

    `n` counts sightings; `n_minute` is the mean over parts of `part_frames` of a square's share of the part, times the
    bin's sightings, so that each part weighs the same: a row weighs one over its part's rows, and no row per part is
    made. `speed` is the mean length of the steps that end in a square on the side where they began; `speed_minute` the
    mean over parts, of those that have such a step within, of that mean over the part's rows, times the bin's sightings.
    Bins of fewer than `least` sightings are left out. `rows` has geometry and `event_id`.
    """
    bin_ = ["uid", "daynum", "td"]
    rows = _in_bins(rows, c, bins, least, part_frames).withColumn("cell", g.cell(c))
    order = lambda *keys: Window.partitionBy(*bin_, *keys).orderBy("framenum", "event_id")

    def step(w) -> Column:
        lag = lambda k: F.lag(k).over(w)
        return F.when(lag("camera") == F.col("camera"), F.hypot(F.col("x") - lag("x"), F.col("y") - lag("y")))

    rows = rows.withColumns({"_step": step(order()), "_inner": step(order("_part"))}).where("cell is not null")
    whole = rows.groupBy(*bin_, "_part", "cell", "n", "_m", "_parts").agg(F.count("*").alias("_k"), F.sum("_step").alias("_s"), F.count("_step").alias("_c"), F.avg("_inner").alias("_v"))
    out = whole.groupBy(*bin_, "cell").agg(
        F.sum("_k").alias("_n"), (F.first("n") * F.sum(F.col("_k") / F.col("_m")) / F.first("_parts")).alias("n_minute"),
        F.try_divide(F.sum("_s"), F.sum("_c")).alias("speed"), (F.first("n") * F.avg(F.col("_v") / F.col("_m"))).alias("speed_minute"),
    )
    return out.select(*bin_, "cell", *g.cell_bins(F.col("cell"), c), F.col("_n").alias("n"), "n_minute", "speed", "speed_minute")


def bin_substrates(rows: DataFrame, c: HiveConfig, bins: int, least: int = 10, part_frames: int = 180, dance_floor: bool = False) -> DataFrame:
    """(uid, daynum, td, map, code, n, n_minute): sightings per class under the map before the day (0) and the one after it (1).

    `n_minute` as in `bin_cells`. `rows` has `code0` and `code1`; sightings without a code count in their part alone. With
    `dance_floor` its rectangle overrides both codes.
    """
    bin_ = ["uid", "daynum", "td"]
    rows = _in_bins(rows, c, bins, least, part_frames)
    on = g.within(c, c.dance_floor) == 1 if dance_floor else F.lit(False)
    maps = F.array(*[F.struct(F.lit(i).alias("map"), F.when(on, DANCE[0]).otherwise(F.col(f"code{i}")).cast("int").alias("code")) for i in (0, 1)])
    rows = rows.select(*bin_, "n", "_m", "_parts", F.inline(maps)).where("code is not null")
    out = rows.groupBy(*bin_, "map", "code").agg(F.count("*").alias("_n"), (F.first("n") * F.sum(1 / F.col("_m")) / F.first("_parts")).alias("n_minute"))
    return out.select(*bin_, "map", "code", F.col("_n").alias("n"), "n_minute")


def rolled_cells(cells: DataFrame) -> DataFrame:
    """(uid, daynum, cell, n, n_minute, speed): a day's squares from those of its bins; speed by sightings, where there is one."""
    seen = F.sum(F.when(F.col("speed").isNotNull(), F.col("n")))
    return cells.groupBy("uid", "daynum", "cell").agg(F.sum("n").alias("n"), F.sum("n_minute").alias("n_minute"), F.try_divide(F.sum(F.col("speed") * F.col("n")), seen).alias("speed"))
