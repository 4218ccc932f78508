"""The library's registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HIVE_2018 as C
from ..functions import geometry as g
from ..functions import timeops as t
from ..operators import events as ev
from ..operators import meetings
from ..operators import states as st
from ..operators import stats
from ..operators import windows as w
from ..sources.tables import calendar, detections, scan_detections, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# Parameters that suit the sparse event table.
DAY, BINS, LOOK_BACK, ABSENCE, NEAR_EXIT = C.frames_per_day, 24, 40_000, 10_000, 4_000
HOUR = DAY // BINS

DET = """WITH det AS (SELECT event_id, user_id AS uid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS daynum,
  CAST(((epoch_us(ts) % 86400000000) * 3) // 1000000 AS INTEGER) AS framenum, 33 * CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS x,
  CAST((event_id * 997) % 5653 AS INTEGER) AS y, CAST(event_id % 2 AS INTEGER) AS camera, ts, value FROM events)"""
GEO = DET + """, geo AS (SELECT *, x + CASE WHEN camera = 0 THEN 3296 ELSE 0 END AS xa, CASE WHEN camera = 1 THEN 3296 - x ELSE x END AS fx, CASE WHEN camera = 1 THEN y + 40 ELSE y END AS fy,
  CASE WHEN y < 0 THEN -1 WHEN y < 1890 THEN 0 WHEN y < 3680 THEN 1 WHEN y < 11304 THEN 2 ELSE 3 END + CASE WHEN camera = 0 THEN 3 ELSE 0 END AS frame,
  sqrt(pow(CASE WHEN camera = 1 THEN 3296 - x ELSE x END - 3296, 2) + pow(CASE WHEN camera = 1 AND y > 3640 THEN 7360 - (y + 40) WHEN camera = 1 THEN y + 40 ELSE y END - 5652, 2)) AS exit_dist FROM det)"""
FLAG = "CASE WHEN xa BETWEEN 4700 AND 6000 AND y BETWEEN 4350 AND 5200 THEN 1 ELSE 0 END"
VIS = GEO + f""", fl AS (SELECT *, {FLAG} AS cross_df FROM geo), rise AS (SELECT *, CASE WHEN lag(cross_df) OVER u = 0 AND cross_df = 1 THEN 1 ELSE 0 END AS r FROM fl WINDOW u AS (PARTITION BY uid ORDER BY daynum, framenum)),
 vis AS (SELECT *, CAST(sum(r) OVER (PARTITION BY uid ORDER BY daynum, framenum ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visits FROM rise),
 rec AS (SELECT *, visits - first_value(visits) OVER (PARTITION BY uid, daynum ORDER BY framenum RANGE BETWEEN {LOOK_BACK} PRECEDING AND CURRENT ROW) AS recent FROM vis)"""
LEAVE = VIS + f""", gp AS (SELECT *, lead(framenum) OVER d - framenum AS gap FROM rec WINDOW d AS (PARTITION BY uid, daynum ORDER BY framenum)),
 lf AS (SELECT *, coalesce(gap >= {ABSENCE} AND exit_dist <= {NEAR_EXIT}, false) AS lv FROM gp),
 lb AS (SELECT *, coalesce(lag(lv) OVER (PARTITION BY uid, daynum ORDER BY framenum), false) AS bk FROM lf), leaves AS (SELECT * FROM lb WHERE lv AND NOT bk)"""
BINNED = GEO + f""", binned AS (SELECT uid, daynum, CAST(framenum // {HOUR} AS INTEGER) AS td, count(*) AS n, quantile_cont(exit_dist, 0.5) AS exit_med, avg(CASE WHEN frame IN (0, 3) THEN 1.0 ELSE 0.0 END) AS top FROM geo GROUP BY ALL)"""
GRID = BINNED + f""", gr AS (SELECT k.uid, k.daynum, CAST(b.td AS INTEGER) AS td, n, exit_med, top, n IS NOT NULL AS obs, coalesce(exit_med < {NEAR_EXIT}, false) AS near, coalesce(top > 0.5, false) AS tp
  FROM (SELECT DISTINCT uid, daynum FROM det) k CROSS JOIN range({BINS}) b(td) LEFT JOIN binned USING (uid, daynum, td)),
 c1 AS (SELECT *, CASE WHEN lag(obs) OVER q = obs THEN 0 ELSE 1 END AS c FROM gr WINDOW q AS (PARTITION BY uid, daynum ORDER BY td)),
 c2 AS (SELECT *, sum(c) OVER (PARTITION BY uid, daynum ORDER BY td ROWS UNBOUNDED PRECEDING) AS seg FROM c1),
 sg AS (SELECT *, min(td) OVER (PARTITION BY uid, daynum, seg) AS s, max(td) OVER (PARTITION BY uid, daynum, seg) + 1 AS e, max(seg) OVER (PARTITION BY uid, daynum) AS nseg FROM c2),
 fl2 AS (SELECT uid, daynum, list(near ORDER BY td) AS nears, list(tp ORDER BY td) AS tops FROM gr GROUP BY uid, daynum), sp AS (SELECT sg.*, nears, tops FROM sg JOIN fl2 USING (uid, daynum)),
 inh AS (SELECT uid, daynum, td, CAST(CASE WHEN nseg = 1 THEN CASE WHEN obs THEN 1 END WHEN obs THEN 1 WHEN coalesce(nears[CASE WHEN seg = 1 THEN least(e + 1, {BINS - 1}) ELSE s - 1 END + 1], false) THEN 0 ELSE 1 END AS INTEGER) AS state FROM sp),
 ons AS (SELECT uid, daynum, td, CAST(CASE WHEN nseg = 1 THEN CASE WHEN obs AND tops[1] THEN 1 END ELSE CAST(coalesce(tops[CASE WHEN obs THEN s WHEN seg = 1 THEN e ELSE s - 1 END + 1], false) AS INTEGER) END AS INTEGER) AS state FROM sp)"""
BOUTS = GRID + f""", sl AS (SELECT uid, daynum * {BINS} + td AS td, state FROM ons), b1 AS (SELECT *, CASE WHEN state IS NULL OR lag(state) OVER q IS NULL OR lag(state) OVER q <> state THEN 1 ELSE 0 END AS c FROM sl WINDOW q AS (PARTITION BY uid ORDER BY td)),
 b2 AS (SELECT *, sum(c) OVER (PARTITION BY uid ORDER BY td ROWS UNBOUNDED PRECEDING) AS run FROM b1),
 bt AS (SELECT uid, state, min(td) AS start, max(td) AS "end", count(*) AS length FROM b2 WHERE state IS NOT NULL GROUP BY uid, run, state)"""
STEP = GEO + """, stp AS (SELECT *, sqrt(pow(x - lag(x) OVER d, 2) + pow(y - lag(y) OVER d, 2)) / 80 AS distance, (framenum - lag(framenum) OVER d) / 3.0 AS sec, lag(camera) OVER d AS pc,
  sqrt(pow(fx - lag(fx) OVER d, 2) + pow(fy - lag(fy) OVER d, 2)) AS flat, lag(frame) OVER d AS pf, xa - lag(xa) OVER d AS dx, y - lag(y) OVER d AS dy FROM geo WINDOW d AS (PARTITION BY uid, daynum ORDER BY framenum)),
 spd AS (SELECT *, CASE WHEN pc = camera AND sec <= 86400 AND sec > 0 THEN distance / sec END AS speed FROM stp)"""


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def six_digits(c):
    """Six digits as the SQL rounds: a million times the double to a whole number, halves away from zero.

    Spark's `round` goes by the digits of the number as printed, and so differs where a double lies next to a half.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def r6(c, name: str):
    return six_digits(c).alias(name)


def _geo(spark, d):
    return w.with_geometry(detections(spark, d, C), C)


def _visits(spark, d):
    return w.recent_visits(w.running_visits(_geo(spark, d), g.within(C, C.dance_floor)), LOOK_BACK)


def _leaves(spark, d):
    return ev.leave_events(_visits(spark, d), NEAR_EXIT, ABSENCE)


def _binned(spark, d):
    rows = _geo(spark, d).select("uid", "daynum", F.expr(f"framenum div {HOUR}").cast("int").alias("td"), "exit_dist", "frame")
    # a median needs all rows in any case, and the windows of a day's bins go on in these partitions, with up to 24 rows for one: so they are not merged
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid", "daynum")
    return rows.groupBy("uid", "daynum", "td").agg(F.count("*").alias("n"), F.median("exit_dist").alias("exit_med"), F.avg(F.col("frame").isin(0, 3).cast("double")).alias("top"))


def _in_hive(spark, d):
    return st.in_hive(_binned(spark, d), ["uid", "daynum"], BINS, F.col("n") >= 1, F.col("exit_med") < NEAR_EXIT)


def _on_substrate(spark, d):
    return st.on_substrate(_binned(spark, d), ["uid", "daynum"], BINS, F.col("n") >= 1, F.col("top") > 0.5)


def _bouts(spark, d):
    states = _on_substrate(spark, d).select("uid", "daynum", (F.col("daynum") * BINS + F.col("td")).alias("td"), "state")
    return w.bouts(states, part="daynum")


def _speeds(spark, d):
    out = w.speed_steps(_geo(spark, d), C, 86_400)
    lag = lambda c: F.lag(c).over(w.in_order(out))
    return out.withColumns({"flat": w.flat_step(out), "pf": lag("frame"), "pc": lag("camera"), "dx": F.col("xa") - lag("xa"), "dy": F.col("y") - lag("y")})


@query(DET + " SELECT event_id, uid, daynum, framenum, x, y, camera FROM det WHERE value / 500 > 0.3 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'")
def scan_filter_confidence(spark, d):
    rows = detections(spark, d, C).withColumn("confidence", F.col("value") / 500)
    return scan_detections(rows, None, 4096, 0.3, "2024-01-03", "2024-01-20").select("event_id", "uid", "daynum", "framenum", "x", "y", "camera")


@query("SELECT CAST(i AS INTEGER) AS daynum, strftime(DATE '2024-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS day, count(e.ts) AS n FROM range(60) t(i) LEFT JOIN events e ON CAST(e.ts AS DATE) = DATE '2024-01-01' + CAST(i AS INTEGER) GROUP BY ALL")
def calendar_days(spark, d):
    days = calendar(spark, "2024-01-01", "2024-02-29")
    return days.join(detections(spark, d, C).select(F.col("daynum").alias("k"), "ts"), F.col("k") == F.col("daynum"), "left").groupBy("daynum", F.col("day").cast("string").alias("day")).agg(F.count("ts").alias("n"))


@query(DET + " SELECT event_id, daynum, framenum, strftime(TIMESTAMP '2024-01-01' + to_microseconds(CAST(daynum AS BIGINT) * 86400000000 + (CAST(framenum AS BIGINT) * 1000000) // 3), '%Y-%m-%d %H:%M:%S.%f') AS back, strftime(TIMESTAMP '2024-01-01' + to_microseconds(CAST(daynum AS BIGINT) * 86400000000 + (CAST(framenum AS BIGINT) // 3) * 1000000), '%Y-%m-%d %H:%M:%S') AS whole, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute FROM det")
def frame_roundtrip(spark, d):
    day, frame = F.col("daynum"), F.col("framenum")
    return detections(spark, d, C).select("event_id", "daynum", "framenum", F.date_format(t.time_of(day, frame, C), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("back"), F.date_format(t.time_of(day, frame, C, True), "yyyy-MM-dd HH:mm:ss").alias("whole"), F.hour("ts").alias("hour"), F.minute("ts").alias("minute"))


@query(GEO + " SELECT event_id, CAST(xa AS INTEGER) AS xa, CAST(fx AS INTEGER) AS fx, CAST(fy AS INTEGER) AS fy, round(exit_dist, 6) AS exit_dist, CAST(frame AS INTEGER) AS frame FROM geo")
def geometry_flatten_exitdist(spark, d):
    return _geo(spark, d).select("event_id", F.col("xa").cast("int"), F.col("fx").cast("int"), F.col("fy").cast("int"), r6("exit_dist", "exit_dist"), F.col("frame").cast("int"))


@query(GEO + f" SELECT event_id, CASE WHEN xa BETWEEN 3500 AND 6500 AND y BETWEEN 3800 AND 5400 THEN 1 ELSE 0 END AS in_exit_frame, {FLAG} AS cross_df FROM geo")
def region_flags(spark, d):
    return detections(spark, d, C).select("event_id", g.within(C, C.exit_frame).alias("in_exit_frame"), g.within(C, C.dance_floor).alias("cross_df"))


@query(DET + " SELECT event_id, round(atan2(sin(value), cos(value)), 6) AS angle, round(sin((hour(ts) - 5.5) / 24 * 2 * pi()), 6) AS weight FROM det")
def angle_and_circadian(spark, d):
    return detections(spark, d, C).select("event_id", r6(g.angle_wrapped(F.col("value")), "angle"), r6(g.circadian(F.hour("ts")), "weight"))


@query(DET + ", c AS (SELECT *, value / 500 AS confidence, framenum // 43200 AS slot FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY uid, daynum, slot ORDER BY confidence DESC, ts DESC, event_id DESC) AS k FROM c) SELECT event_id, uid, daynum, CAST(slot AS INTEGER) AS framenum FROM r WHERE k = 1 AND confidence > 0.1")
def dedup_best_confidence(spark, d):
    rows = detections(spark, d, C).withColumns({"confidence": F.col("value") / 500, "framenum": F.expr("framenum div 43200").cast("int")})
    return w.best_confidence(rows, 0.1).select("event_id", "uid", "daynum", "framenum")


@query(VIS + " SELECT uid, daynum, CAST(sum(cross_df) AS BIGINT) AS frames_on FROM vis GROUP BY ALL")
def total_visits(spark, d):
    return _visits(spark, d).groupBy("uid", "daynum").agg(F.sum("on").alias("frames_on"))


@query(VIS + " SELECT event_id, visits, CAST(recent AS BIGINT) AS recent FROM rec")
def recent_visits(spark, d):
    return _visits(spark, d).select("event_id", "visits", "recent")


@query(LEAVE + " SELECT event_id, uid, daynum, framenum, CAST(gap AS INTEGER) AS gap, CAST(recent AS BIGINT) AS recent, 'leave' AS status FROM leaves")
def leave_events(spark, d):
    return _leaves(spark, d).select("event_id", "uid", "daynum", "framenum", "gap", "recent", "status")


@query(GRID + f", dd AS (SELECT uid, daynum, td, lead(td) OVER q AS nx, lead(state) OVER q - state AS diff FROM inh WINDOW q AS (PARTITION BY uid, daynum ORDER BY td)) SELECT uid, daynum, td AS minute, CAST(td * {HOUR} AS INTEGER) AS framenum, diff, CASE WHEN diff = -1 THEN 'leave' WHEN diff = 1 THEN 'return' WHEN diff = 0 THEN 'no change' ELSE 'not sure' END AS status FROM dd WHERE nx IS NOT NULL")
def hive_events(spark, d):
    return st.hive_events(_in_hive(spark, d), ["uid", "daynum"], BINS, DAY)


@query(GRID + f""", dd AS (SELECT uid, daynum, td * {HOUR} AS framenum, lead(state) OVER q - state AS diff FROM inh WINDOW q AS (PARTITION BY uid, daynum ORDER BY td)),
 e AS (SELECT *, CASE WHEN diff = -1 THEN 'leave' ELSE 'return' END AS status FROM dd WHERE diff IN (-1, 1)),
 n AS (SELECT *, lead(status) OVER q AS nx, lead(daynum * 259200 + framenum) OVER q - (daynum * 259200 + framenum) AS gp FROM e WINDOW q AS (PARTITION BY uid ORDER BY daynum, framenum))
 SELECT uid, daynum, CAST(framenum AS INTEGER) AS framenum, CASE WHEN status = 'return' THEN 'return event' WHEN nx IS NULL THEN 'disappeared' WHEN nx = 'leave' THEN 'not sure' WHEN gp < 50000 THEN 'short with return' ELSE 'long with return' END AS kind FROM n""")
def raw_leave_types(spark, d):
    return ev.typed_events(st.hive_events(_in_hive(spark, d), ["uid", "daynum"], BINS, DAY), 50_000).select("uid", "daynum", "framenum", "kind")


@query(LEAVE + " SELECT a.event_id, CASE WHEN b.event_id IS NULL THEN 'no change' ELSE 'leave' END AS status FROM det a LEFT JOIN leaves b ON a.uid = b.uid AND a.daynum = b.daynum AND a.framenum = b.framenum")
def left_indicator_merge(spark, d):
    return ev.marked(detections(spark, d, C), _leaves(spark, d), ["uid", "daynum", "framenum"]).select("event_id", "status")


@query(LEAVE + ", k AS (SELECT event_id, uid, daynum, framenum, row_number() OVER (PARTITION BY uid, daynum ORDER BY framenum) AS n FROM det) SELECT event_id, uid, daynum, framenum FROM k WHERE n % 3 = 1 UNION SELECT event_id, uid, daynum, framenum FROM leaves")
def union_distinct_thinned(spark, d):
    columns = ["event_id", "uid", "daynum", "framenum"]
    return ev.thinned(detections(spark, d, C), 3).select(*columns).union(_leaves(spark, d).select(*columns)).distinct()


@query(GRID + " SELECT uid, daynum, td, n, round(exit_med, 6) AS exit_med FROM gr")
def gap_filled_grid(spark, d):
    return st.filled(_binned(spark, d), ["uid", "daynum"], BINS).select("uid", "daynum", "td", "n", r6("exit_med", "exit_med"))


@query(GRID + " SELECT * FROM inh")
def in_hive_state(spark, d):
    return _in_hive(spark, d)


@query(GRID + " SELECT * FROM ons")
def on_substrate_state(spark, d):
    return _on_substrate(spark, d)


@query(BOUTS + ' SELECT uid, state, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", length FROM bt')
def bouts(spark, d):
    return _bouts(spark, d)


@query(BOUTS + ', k AS (SELECT *, min(start) OVER (PARTITION BY uid) AS f, max("end") OVER (PARTITION BY uid) AS l FROM bt) SELECT uid, state, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", length FROM k WHERE start <> f AND "end" <> l')
def noncensored_bouts(spark, d):
    return w.uncensored(_bouts(spark, d)).select("uid", "state", "start", "end", "length")


@query(BOUTS + " SELECT state, count(*) AS bouts, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std, round(quantile_cont(length, 0.5), 6) AS median, min(length) AS shortest, max(length) AS longest FROM bt GROUP BY state")
def bout_stats(spark, d):
    return _bouts(spark, d).groupBy("state").agg(F.count("*").alias("bouts"), r6(F.avg("length"), "mean"), r6(F.stddev_samp("length"), "std"), r6(F.median("length"), "median"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


@query(GRID + ", l AS (SELECT *, lag(state) OVER (PARTITION BY uid, daynum ORDER BY td) AS p FROM inh) SELECT uid, daynum, round(avg(CASE WHEN state = 0 THEN 1.0 ELSE 0.0 END), 6) AS outside, CAST(sum(CASE WHEN p = 1 AND state = 0 THEN 1 ELSE 0 END) AS BIGINT) AS trips FROM l GROUP BY ALL")
def time_outside_day(spark, d):
    return st.time_outside(_in_hive(spark, d), ["uid", "daynum"]).select("uid", "daynum", r6("outside", "outside"), "trips")


@query(STEP + " SELECT event_id, round(distance, 6) AS distance, round(speed, 6) AS speed FROM spd")
def speed_per_step(spark, d):
    return _speeds(spark, d).select("event_id", r6("distance", "distance"), r6("speed", "speed"))


@query(STEP + " SELECT uid, round(quantile_cont(speed, 0.5), 6) AS median, round(quantile_cont(speed, 0.75) - quantile_cont(speed, 0.25), 6) AS iqr, round(quantile_cont(speed, 0.9), 6) AS q90 FROM spd GROUP BY uid")
def speed_quantiles(spark, d):
    rows = _speeds(spark, d).groupBy("uid").agg(F.array_sort(F.collect_list("speed")).alias("v"))
    q = {share: stats.quantile_of(F.col("v"), share) for share in (0.25, 0.5, 0.75, 0.9)}
    return rows.select("uid", r6(q[0.5], "median"), r6(q[0.75] - q[0.25], "iqr"), r6(q[0.9], "q90"))


@query(GEO + " SELECT uid, daynum, " + ", ".join(f"CAST(sum(CASE WHEN camera = {1 - k // 3} AND y >= {[0, 1850, 3640, 0, 1890, 3680][k]} AND y {['< 1850', '< 3640', '<= 5652', '< 1890', '< 3680', '<= 5652'][k]} THEN 1 ELSE 0 END) AS BIGINT) AS f{k}" for k in range(6)) + " FROM geo GROUP BY ALL")
def frame_hist(spark, d):
    counts = []
    for camera, dividers in ((1, C.div_left), (0, C.div_right)):
        edges = [0, *dividers, C.ypixels]
        for i in range(3):
            inside = (F.col("y") >= edges[i]) & ((F.col("y") <= edges[i + 1]) if i == 2 else (F.col("y") < edges[i + 1]))
            counts.append(F.sum(((F.col("camera") == camera) & inside).cast("bigint")).alias(f"f{len(counts)}"))
    return detections(spark, d, C).groupBy("uid", "daynum").agg(*counts)


XY = "CAST(CASE WHEN xa = 6592 THEN 40 ELSE floor(xa * 41 / 6592.0) END AS INTEGER) AS xbin, CAST(CASE WHEN y = 5652 THEN 34 ELSE floor(y * 35 / 5652.0) END AS INTEGER) AS ybin"


def _cells(df):
    return df.withColumns({"xbin": g.bin_of(F.col("xa"), C.x_bins, 2.0 * C.xpixels), "ybin": g.bin_of(F.col("y"), C.y_bins, float(C.ypixels))}).where("xbin is not null and ybin is not null")


@query(GEO + f" SELECT {XY}, count(*) AS n FROM geo WHERE xa BETWEEN 0 AND 6592 AND y BETWEEN 0 AND 5652 GROUP BY ALL")
def xy_hist(spark, d):
    return _cells(_geo(spark, d)).groupBy("xbin", "ybin").agg(F.count("*").alias("n"))


@query(STEP + f" SELECT {XY}, round(avg(flat / sec), 6) AS speed, round(avg(dx / sec), 6) AS vx, round(avg(dy / sec), 6) AS vy FROM stp WHERE pc = camera AND sec > 0 GROUP BY ALL")
def velocity_hist(spark, d):
    rows = _speeds(spark, d)
    rows = rows.withColumn("sec", (F.col("framenum") - F.lag("framenum").over(w.in_order(rows))) / C.fps).where("pc = camera and sec > 0")
    return _cells(rows).groupBy("xbin", "ybin").agg(r6(F.avg(F.col("flat") / F.col("sec")), "speed"), r6(F.avg(F.col("dx") / F.col("sec")), "vx"), r6(F.avg(F.col("dy") / F.col("sec")), "vy"))


@query(STEP + " SELECT CAST(pf AS INTEGER) AS from_frame, CAST(frame AS INTEGER) AS to_frame, count(*) AS n FROM stp WHERE pf IS NOT NULL AND pf <> frame GROUP BY ALL")
def crossing_matrix(spark, d):
    return _speeds(spark, d).where("pf is not null and pf <> frame").groupBy(F.col("pf").cast("int").alias("from_frame"), F.col("frame").cast("int").alias("to_frame")).agg(F.count("*").alias("n"))


@query(GEO + f", c AS (SELECT uid, {XY} FROM geo WHERE xa BETWEEN 0 AND 6592 AND y BETWEEN 0 AND 5652) SELECT uid, round(count(DISTINCT xbin * 35 + ybin) / (41 * 35.0), 6) AS fraction FROM c GROUP BY uid")
def fraction_squares(spark, d):
    return _cells(_geo(spark, d)).groupBy("uid").agg(r6(F.countDistinct(F.col("xbin") * C.y_bins + F.col("ybin")) / (C.x_bins * C.y_bins), "fraction"))


@query(STEP + """, m AS (SELECT *, avg(fx) OVER (PARTITION BY uid, daynum) AS mx, avg(fy) OVER (PARTITION BY uid, daynum) AS my FROM spd)
 SELECT uid, daynum, count(*) AS n, round(avg(sqrt(pow(fx - mx, 2) + pow(fy - my, 2))), 6) AS dispersion, round(sum(flat) / nullif(sqrt(pow(last(fx ORDER BY framenum) - first(fx ORDER BY framenum), 2) + pow(last(fy ORDER BY framenum) - first(fy ORDER BY framenum), 2)), 0), 6) AS tortuosity,
 round(quantile_cont(speed, 0.5), 6) AS speed_median, round(avg(exit_dist), 6) AS exit_mean, round(stddev_pop(exit_dist), 6) AS exit_std, round(quantile_cont(exit_dist, 0.5), 6) AS exit_median, CAST(sum(CASE WHEN pf <> frame THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM m GROUP BY ALL HAVING count(*) >= 3""")
def timebin_metrics(spark, d):
    by = Window.partitionBy("uid", "daynum")
    rows = _speeds(spark, d).withColumn("off", F.hypot(F.col("fx") - F.avg("fx").over(by), F.col("fy") - F.avg("fy").over(by)))
    at = F.struct(*w.total_order(rows))
    ends = F.hypot(F.max_by("fx", at) - F.min_by("fx", at), F.max_by("fy", at) - F.min_by("fy", at))
    out = rows.groupBy("uid", "daynum").agg(F.count("*").alias("n"), r6(F.avg("off"), "dispersion"), r6(F.try_divide(F.sum("flat"), ends), "tortuosity"), r6(F.median("speed"), "speed_median"), r6(F.avg("exit_dist"), "exit_mean"), r6(F.stddev_pop("exit_dist"), "exit_std"), r6(F.median("exit_dist"), "exit_median"), F.sum(F.coalesce(F.col("pf") != F.col("frame"), F.lit(False)).cast("bigint")).alias("crossings"))
    return out.where("n >= 3")


@query(GEO + f""", h AS (SELECT *, framenum // {HOUR} AS td FROM geo), m AS (SELECT *, avg(fx) OVER q AS mx, avg(fy) OVER q AS my, count(*) OVER q AS k FROM h WINDOW q AS (PARTITION BY uid, daynum, td)),
 p AS (SELECT uid, daynum, td, avg(sqrt(pow(fx - mx, 2) + pow(fy - my, 2))) AS disp FROM m WHERE k >= 2 GROUP BY ALL) SELECT uid, daynum, round(avg(disp), 6) AS dispersion FROM p GROUP BY ALL""")
def dispersion_minute_avg(spark, d):
    by = Window.partitionBy("uid", "daynum", "td")
    rows = _geo(spark, d).withColumn("td", F.expr(f"framenum div {HOUR}"))
    rows = rows.withColumns({"off": F.hypot(F.col("fx") - F.avg("fx").over(by), F.col("fy") - F.avg("fy").over(by)), "k": F.count("*").over(by)})
    return rows.where("k >= 2").groupBy("uid", "daynum", "td").agg(F.avg("off").alias("disp")).groupBy("uid", "daynum").agg(r6(F.avg("disp"), "dispersion"))


@query(GEO + f", q AS (SELECT *, coalesce(lead(framenum) OVER (PARTITION BY uid, daynum ORDER BY framenum), {DAY}) - framenum AS gap FROM geo) SELECT uid, daynum, CAST(sum(CASE WHEN frame = 5 AND gap > 1800 THEN 1 ELSE 0 END) AS BIGINT) AS trips FROM q GROUP BY ALL")
def outside_trips(spark, d):
    rows = w.gap_after(_geo(spark, d)).withColumn("gap", F.coalesce("gap", DAY - F.col("framenum")))
    return rows.groupBy("uid", "daynum").agg(F.sum(((F.col("frame") == 5) & (F.col("gap") > 1800)).cast("bigint")).alias("trips"))


@query(VIS + " SELECT uid, CAST(max(visits) AS BIGINT) AS arrivals FROM vis GROUP BY uid")
def dance_arrivals(spark, d):
    return _visits(spark, d).groupBy("uid").agg(F.max("visits").alias("arrivals"))


@query("SELECT c_nationkey AS cohort, strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice * n) / nullif(sum(n), 0) + 1e-7, 4) AS weighted, round(avg(o_totalprice) + 1e-7, 4) AS mean, count(*) AS n FROM (SELECT o_custkey, o_orderdate, o_totalprice, 1 + o_orderkey % 5 AS n FROM orders) o JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def day_rollup_weighted(spark, d):  # the small term keeps means of whole cents off the halves that engines round differently
    orders = table(spark, d, "orders").withColumn("n", 1 + F.pmod("o_orderkey", F.lit(5)))
    rows = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("cohort"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.try_divide(F.sum(F.col("o_totalprice") * F.col("n")), F.sum("n")) + 1e-7, 4).alias("weighted"), F.round(F.avg("o_totalprice") + 1e-7, 4).alias("mean"), F.count("*").alias("n"))


@query(STEP + " SELECT daynum, round(avg(speed * sin((hour(ts) - 5.5) / 24 * 2 * pi())) / nullif(avg(speed), 0), 6) AS coefficient FROM spd GROUP BY daynum")
def circadian_coeff(spark, d):
    return _speeds(spark, d).groupBy("daynum").agg(r6(F.try_divide(F.avg(F.col("speed") * g.circadian(F.hour("ts"))), F.avg("speed")), "coefficient"))


@query("""WITH s AS (SELECT c_nationkey AS cohort, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 g AS (SELECT c.cohort, k.m, coalesce(n, 0) AS n FROM (SELECT DISTINCT cohort FROM s) c CROSS JOIN (SELECT DISTINCT m FROM s) k LEFT JOIN s ON s.cohort = c.cohort AND s.m = k.m)
 SELECT cohort, strftime(m, '%Y-%m') AS month, n, CAST(sum(n) OVER (PARTITION BY m ORDER BY cohort ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stacked FROM g""")
def cohort_daily_stacked(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = rows.groupBy(F.col("c_nationkey").alias("cohort"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    months = F.broadcast(s.select("month").distinct().agg(F.collect_set("month").alias("months")))  # a row of months
    full = s.select("cohort").distinct().crossJoin(months).select("cohort", F.explode("months").alias("month")).join(s, ["cohort", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("stacked", F.sum("n").over(Window.partitionBy("month").orderBy("cohort").rowsBetween(Window.unboundedPreceding, 0)))


@query(VIS + ", f AS (SELECT *, min(CASE WHEN cross_df = 1 THEN daynum END) OVER (PARTITION BY uid) AS first FROM vis) SELECT event_id, CAST(daynum - first AS INTEGER) AS since, CAST(coalesce(daynum >= first, false) AS INTEGER) AS ever FROM f")
def first_event_aligned(spark, d):
    first = F.min(F.when(F.col("on") == 1, F.col("daynum"))).over(Window.partitionBy("uid"))
    rows = _visits(spark, d).withColumn("first", first)
    return rows.select("event_id", (F.col("daynum") - F.col("first")).alias("since"), F.coalesce(F.col("daynum") >= F.col("first"), F.lit(False)).cast("int").alias("ever"))


@query(DET + ", p AS (SELECT uid, daynum, count(*) AS own FROM det GROUP BY ALL) SELECT uid, daynum, own, CAST(sum(own) OVER (PARTITION BY daynum) - own AS BIGINT) AS others, CAST(sum(own) OVER (PARTITION BY uid ORDER BY daynum ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM p")
def leave_one_out_total(spark, d):
    own = detections(spark, d, C).groupBy("uid", "daynum").agg(F.count("*").alias("own"))
    total = own.groupBy("daynum").agg(F.sum("own").alias("total"))
    so_far = F.sum("own").over(Window.partitionBy("uid").orderBy("daynum").rowsBetween(Window.unboundedPreceding, 0))
    return own.join(total, "daynum").select("uid", "daynum", "own", (F.col("total") - F.col("own")).alias("others"), so_far.alias("so_far"))


@query("SELECT CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 0 WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 1 WHEN c_acctbal > 2500 AND c_acctbal <= 5000 THEN 2 WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 3 END AS bin, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY ALL")
def cut_fixed_bins(spark, d):
    bins = table(spark, d, "customer").withColumn("bin", stats.cut(F.col("c_acctbal"), [-1000, 0, 2500, 5000, 10000]))
    return bins.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


QCUT = "WITH e AS (SELECT quantile_cont(c_acctbal, [0, 0.0666666666666666667, 0.1333333333333333333, 0.2, 0.2666666666666666667, 0.3333333333333333333, 0.4, 0.4666666666666666667, 0.5333333333333333333, 0.6, 0.6666666666666666667, 0.7333333333333333333, 0.8, 0.8666666666666666667, 0.9333333333333333333, 1]) AS q FROM customer), b AS (SELECT customer.*, CAST(greatest(len(list_filter(q, lambda v: v < c_acctbal)) - 1, 0) AS INTEGER) AS bin FROM customer, e)"


@query(QCUT + " SELECT bin, count(*) AS n FROM b GROUP BY bin")
def qcut_bins(spark, d):
    return stats.qcut(table(spark, d, "customer"), "c_acctbal", 15).groupBy("bin").agg(F.count("*").alias("n"))


@query(QCUT + " SELECT bin, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 4) AS sem, round(stddev_samp(c_acctbal) / sqrt(count(DISTINCT c_nationkey)), 4) AS sem_entities FROM b GROUP BY bin")
def binned_mean_sem(spark, d):
    out = stats.mean_sem(stats.qcut(table(spark, d, "customer"), "c_acctbal", 15), ["bin"], "c_acctbal", "c_nationkey")
    return out.select("bin", *[F.round(c, 4).alias(c) for c in ("mean", "sem", "sem_entities")])


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]
CORR = "WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS) + ")"


@query(CORR + " SELECT a, b, round(r, 6) AS r FROM p")
def pearson_pairs(spark, d):
    return stats.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", r6("r", "r"))


@query(CORR + " SELECT a, b, round(r, 6) AS r FROM p WHERE r > 0.5")
def large_corrs(spark, d):
    return stats.pearson(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).where("r > 0.5").select("a", "b", r6("r", "r"))


@query("WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(k.a, k.b), 6) AS r FROM k")
def spearman_pairs(spark, d):
    return stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount").select("a", "b", r6("r", "r"))


@query(VIS + " SELECT daynum, count(DISTINCT uid) AS individuals, round(sum(cross_df) / count(*), 6) AS share, round(avg(CASE WHEN cross_df = 1 THEN exit_dist END), 6) AS dist_on FROM vis GROUP BY daynum")
def daily_ratios(spark, d):
    return _visits(spark, d).groupBy("daynum").agg(F.countDistinct("uid").alias("individuals"), r6(F.try_divide(F.sum("on"), F.count("*")), "share"), r6(F.avg(F.when(F.col("on") == 1, F.col("exit_dist"))), "dist_on"))


@query(DET + ", f AS (SELECT uid, count(*) AS n, count(DISTINCT daynum) AS days FROM det GROUP BY uid) SELECT days, count(*) AS individuals, round(avg(n), 6) AS sightings FROM f GROUP BY days")
def conditional_freq(spark, d):
    f = detections(spark, d, C).groupBy("uid").agg(F.count("*").alias("n"), F.countDistinct("daynum").alias("days"))
    return f.groupBy("days").agg(F.count("*").alias("individuals"), r6(F.avg("n"), "sightings"))


@query("WITH b AS (SELECT CAST(least(floor((l_quantity - 1) / 4.9), 9) AS INTEGER) AS bin FROM lineitem WHERE l_quantity BETWEEN 1 AND 50), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin) SELECT bin, n, round(n / (sum(n) OVER () * 4.9), 6) AS density FROM c")
def density_hist(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_quantity", 1.0, 50.0, 10).select("bin", "n", r6("density", "density"))


@query("WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
def boxplot_stats(spark, d):
    return stats.box(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "low", "high")


@query(STEP + ", s AS (SELECT *, sum(CASE WHEN pc IS NULL OR distance * 80 > 1500 OR pc <> camera THEN 1 ELSE 0 END) OVER (PARTITION BY uid, daynum ORDER BY framenum ROWS UNBOUNDED PRECEDING) AS segment FROM stp), k AS (SELECT *, count(*) OVER (PARTITION BY uid, daynum, segment) AS n FROM s) SELECT event_id, CAST(segment AS BIGINT) AS segment FROM k WHERE n >= 2")
def plot_segments(spark, d):
    return w.plot_segments(_geo(spark, d), 1500).select("event_id", "segment")


@query(DET + ", q AS (SELECT uid, daynum, framenum, lead(framenum) OVER (PARTITION BY uid, daynum ORDER BY framenum) AS nx FROM det), k AS (SELECT *, row_number() OVER (PARTITION BY uid, daynum ORDER BY nx - framenum DESC, framenum) AS n FROM q WHERE nx IS NOT NULL) SELECT uid, daynum, framenum AS \"left\", nx AS back, CAST(nx - framenum AS INTEGER) AS gap FROM k WHERE n = 1")
def largest_gap_window(spark, d):
    return w.largest_gap(detections(spark, d, C))


@query(LEAVE + f" SELECT a.event_id, b.framenum AS event_frame FROM det a JOIN leaves b ON a.uid = b.uid AND a.daynum = b.daynum WHERE a.framenum > b.framenum - {LOOK_BACK} AND a.framenum < b.framenum")
def history_lookback(spark, d):
    return ev.history(_leaves(spark, d), detections(spark, d, C), LOOK_BACK).select("event_id", "event_frame")


MEET = DET + ", met AS (SELECT a.daynum, a.framenum // 10800 AS bucket, a.camera, a.uid, b.uid AS partner, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM det a JOIN det b ON a.daynum = b.daynum AND a.framenum // 10800 = b.framenum // 10800 AND a.camera = b.camera AND a.uid <> b.uid WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 500)"


@query(MEET + " SELECT daynum, CAST(bucket AS INTEGER) AS bucket, camera, uid, partner, round(d, 6) AS d FROM met")
def interactions(spark, d):
    d6 = F.rint(F.col("d") * 1e6) / 1e6  # as `round` gives it for roots of whole numbers (tested for all), without a decimal for each row
    return ev.interactions(detections(spark, d, C), 500, 10_800).select("daynum", F.col("bucket").cast("int"), "camera", "uid", "partner", d6.alias("d"))


@query(MEET + f", f AS (SELECT uid, partner, min(daynum * 24 + bucket) AS met_at FROM met GROUP BY ALL), o AS (SELECT uid, min(daynum * 24 + framenum // 10800) AS on_at FROM (SELECT *, x + CASE WHEN camera = 0 THEN 3296 ELSE 0 END AS xa FROM det) WHERE {FLAG} = 1 GROUP BY uid) SELECT f.uid, partner, CAST(met_at AS INTEGER) AS met_at FROM f JOIN o ON o.uid = f.partner WHERE on_at < met_at")
def prior_partners(spark, d):
    rows = detections(spark, d, C)
    on = rows.where(g.within(C, C.dance_floor) == 1).groupBy("uid").agg(F.min(F.expr("daynum * 24 + framenum div 10800")).alias("at"))
    return meetings.first_meetings(rows, on, 500, 10_800).withColumn("met_at", F.col("met_at").cast("int"))


@query("SELECT c_custkey AS uid, c_nationkey AS tag, row_number() OVER q AS generation, CAST(lead(c_custkey) OVER q AS BIGINT) AS next_uid FROM customer WINDOW q AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def tag_reuse_validity(spark, d):
    own = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("tag"), F.row_number().over(own).cast("bigint").alias("generation"), F.lead("c_custkey").over(own).alias("next_uid"))


@query("WITH b AS (SELECT o_custkey AS uid, CAST(min(o_orderdate) AS DATE) AS birth FROM orders GROUP BY o_custkey) SELECT o_orderkey, CAST(date_diff('day', birth, CAST(o_orderdate AS DATE)) AS INTEGER) AS age FROM orders JOIN b ON uid = o_custkey")
def entity_age(spark, d):
    orders = table(spark, d, "orders")
    birth = orders.groupBy(F.col("o_custkey").alias("uid")).agg(F.min("o_orderdate").cast("date").alias("birth"))
    return orders.join(birth, F.col("uid") == F.col("o_custkey")).select("o_orderkey", F.date_diff(F.col("o_orderdate").cast("date"), "birth").alias("age"))


@query(GRID + ", k AS (SELECT uid, daynum, td, state FROM inh WHERE daynum = 3) SELECT uid, " + ", ".join(f"max(CASE WHEN td = {i} THEN state END) AS t{i}" for i in range(24)) + " FROM k GROUP BY uid")
def state_pivot(spark, d):
    return ev.pivot_state(_in_hive(spark, d).where("daynum = 3"), BINS).drop("daynum")


@query(GRID + " SELECT uid, daynum, " + ", ".join(f"max(CASE WHEN td = {i} THEN state END) AS t{i}" for i in range(24)) + " FROM inh GROUP BY uid, daynum")
def state_pivot_days(spark, d):
    return ev.pivot_state(_in_hive(spark, d), BINS)


@query(GEO + " SELECT event_id, round(avg(exit_dist) OVER (PARTITION BY uid, daynum ORDER BY framenum RANGE BETWEEN 40000 PRECEDING AND CURRENT ROW), 6) AS mean_dist FROM geo")
def trailing_mean_exit_distance(spark, d):
    return w.trailing_mean(_geo(spark, d), "exit_dist", LOOK_BACK, "mean_dist").select("event_id", r6("mean_dist", "mean_dist"))


@query(DET + """, e AS (SELECT uid, daynum, min(framenum) AS a, max(framenum) AS b FROM det GROUP BY ALL), f AS (SELECT uid, daynum, CAST(unnest(range(a, b + 1, 3000)) AS INTEGER) AS framenum FROM e),
 l AS (SELECT f.*, p.framenum AS f0, p.x AS x0 FROM f ASOF JOIN det p ON p.uid = f.uid AND p.daynum = f.daynum AND p.framenum <= f.framenum), r AS (SELECT l.*, n.framenum AS f1, n.x AS x1 FROM l ASOF JOIN det n ON n.uid = l.uid AND n.daynum = l.daynum AND n.framenum >= l.framenum),
 py AS (SELECT uid, daynum, framenum, y FROM det WHERE event_id % 3 <> 0), ly AS (SELECT r.*, p.framenum AS g0, p.y AS y0 FROM r ASOF LEFT JOIN py p ON p.uid = r.uid AND p.daynum = r.daynum AND p.framenum <= r.framenum), ry AS (SELECT ly.*, n.framenum AS g1, n.y AS y1 FROM ly ASOF LEFT JOIN py n ON n.uid = ly.uid AND n.daynum = ly.daynum AND n.framenum >= ly.framenum)
 SELECT uid, daynum, framenum, round(x0 + (x1 - x0) * coalesce((framenum - f0) / nullif(f1 - f0, 0), 0), 6) AS x, round(CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * coalesce((framenum - g0) / nullif(g1 - g0, 0), 0) END, 6) AS y FROM ry""")
def upsample_interpolate(spark, d):
    """Two columns, of which `y` lacks every third sighting."""
    rows = detections(spark, d, C).withColumn("y", F.when(F.col("event_id") % 3 != 0, F.col("y")))
    return ev.upsampled(rows, 3000, ["x", "y"]).select("uid", "daynum", "framenum", r6("x", "x"), r6("y", "y"))
