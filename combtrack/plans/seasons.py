"""Registered queries on time-bin tables, individuals, training tables and clock and display functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import HIVE_2018 as C
from ..functions import geometry as g
from ..functions import timeops as t
from ..operators import events as ev
from ..operators import identity, models, sampling, signal, stats, substrate, timebins, training
from ..operators import states as st
from ..operators import windows as w
from ..sources import tables
from ..sources.tables import detections, scan_detections, table
from .catalogue import BINS, DAY, DET, GEO, GRID, HOUR, LEAVE, LOOK_BACK, STEP, _binned, _geo, _in_hive, _leaves, _speeds, _visits, query, r6, six_digits
from .surfaces import AT, _at, _raster

# Two individuals, so that an hour has enough rows; parts of twenty minutes and steps of up to two hours.
PART, SLOW = 3_600, 7_200
DENSE = GEO.replace("user_id AS uid", "user_id % 2 AS uid") + AT.removeprefix(DET)
FLOOR = "xa BETWEEN 4700 AND 6000 AND y BETWEEN 4350 AND 5200"
CLASSES = {"honey": "0", "brood": "1, 2", "pollen": "4", "dance": "5", "festoon": "13", "empty": "3"}
ENDS = "nullif(sqrt(pow(last(fx ORDER BY framenum, event_id) - first(fx ORDER BY framenum, event_id), 2) + pow(last(fy ORDER BY framenum, event_id) - first(fy ORDER BY framenum, event_id), 2)), 0)"
BIN_SQL = DENSE + f""", codes AS (SELECT event_id, max(CASE WHEN map_id = 0 THEN code END) AS m0, max(CASE WHEN map_id = 1 THEN code END) AS m1 FROM cell GROUP BY event_id),
 h AS (SELECT geo.*, CAST(framenum // {HOUR} AS INTEGER) AS td, framenum // {PART} AS part, CASE WHEN {FLOOR} THEN 5 ELSE m0 END AS code0, CASE WHEN {FLOOR} THEN 5 ELSE m1 END AS code1, 1 - (daynum % 5) / 4.0 AS w0, (daynum % 5) / 4.0 AS w1,
  CASE WHEN y < 0 OR y > 5652 THEN NULL WHEN camera = 1 THEN CASE WHEN y < 1850 THEN 0 WHEN y < 3640 THEN 1 ELSE 2 END ELSE CASE WHEN y < 1890 THEN 3 WHEN y < 3680 THEN 4 ELSE 5 END END AS img,
  CASE WHEN xa BETWEEN 0 AND 6592 AND y BETWEEN 0 AND 5652 THEN CAST(CASE WHEN xa = 6592 THEN 40 ELSE floor(xa * 41 / 6592.0) END AS INTEGER) * 35 + CAST(CASE WHEN y = 5652 THEN 34 ELSE floor(y * 35 / 5652.0) END AS INTEGER) END AS square FROM geo JOIN codes USING (event_id)),
 s AS (SELECT *, sqrt(pow(fx - lag(fx) OVER b, 2) + pow(fy - lag(fy) OVER b, 2)) AS flat, sqrt(pow(fx - lag(fx) OVER p, 2) + pow(fy - lag(fy) OVER p, 2)) AS flat_part, (framenum - lag(framenum) OVER b) / 3.0 AS sec, lag(camera) OVER b AS pc, lag(frame) OVER b AS pf, lag(code0) OVER b AS c0, lead(framenum) OVER b - framenum AS gap,
  avg(fx) OVER (PARTITION BY uid, daynum, td) AS mx, avg(fy) OVER (PARTITION BY uid, daynum, td) AS my, avg(fx) OVER (PARTITION BY uid, daynum, td, part) AS px, avg(fy) OVER (PARTITION BY uid, daynum, td, part) AS py
  FROM h WINDOW b AS (PARTITION BY uid, daynum, td ORDER BY framenum, event_id), p AS (PARTITION BY uid, daynum, td, part ORDER BY framenum, event_id)),
 u AS (SELECT *, CASE WHEN pc = camera AND sec > 0 AND sec <= {SLOW} THEN flat / sec END AS speed, CASE WHEN gap IS NULL THEN {HOUR} - (framenum - td * {HOUR}) > 1800 ELSE gap >= 1800 END AS away FROM s),
 mp AS (SELECT uid, daynum, td, part, count(*) AS k, avg(sqrt(pow(fx - px, 2) + pow(fy - py, 2))) AS d, sum(flat_part) / {ENDS} AS t FROM u GROUP BY ALL), mn AS (SELECT uid, daynum, td, avg(d) AS dispersion_minute, avg(t) AS tortuosity_minute FROM mp WHERE k >= 3 GROUP BY ALL),
 a AS (SELECT uid, daynum, td, count(*) AS n, {", ".join(f"sum(CASE WHEN code0 IN ({x}) THEN w0 ELSE 0 END + CASE WHEN code1 IN ({x}) THEN w1 ELSE 0 END) AS c_{k}" for k, x in CLASSES.items())}, {", ".join(f"count(*) FILTER (img = {i}) AS f_{i}" for i in range(6))},
  quantile_cont(speed, 0.5) AS speed_median, quantile_cont(speed, 0.75) - quantile_cont(speed, 0.25) AS speed_iqr, quantile_cont(speed, 0.9) AS speed_q90, avg(sqrt(pow(fx - mx, 2) + pow(fy - my, 2))) AS dispersion, sum(flat) / {ENDS} AS tortuosity, avg(exit_dist) AS exit_mean, stddev_pop(exit_dist) AS exit_std, quantile_cont(exit_dist, 0.5) AS exit_median,
  quantile_cont(exit_dist, 0.75) - quantile_cont(exit_dist, 0.25) AS exit_iqr, count(DISTINCT square) / (41 * 35.0) AS fraction_squares, count(*) FILTER (img = 5 AND away) AS trips, count(*) FILTER (c0 <> code0 AND code0 = 5) AS dance_visits, {", ".join(f"count(*) FILTER (pf <> frame AND frame = {i}) AS crossings_{i}" for i in range(6))} FROM u GROUP BY ALL),
 tb AS (SELECT a.uid, a.daynum, a.td, n, {", ".join(f"c_{k} / n AS {k}" for k in ("honey", "brood", "pollen", "dance"))}, (n - c_honey - c_brood - c_pollen - c_dance) / n AS other, {", ".join(f"f_{i} / n AS frame_{i}" for i in range(6))}, speed_median, speed_iqr, speed_q90, dispersion, dispersion_minute, tortuosity, tortuosity_minute, exit_mean, exit_std, exit_median, exit_iqr, fraction_squares, c_festoon AS festoon, c_empty AS empty, trips, dance_visits, {", ".join(f"crossings_{i}" for i in range(6))} FROM a LEFT JOIN mn USING (uid, daynum, td))"""
SHARES = ["honey", "brood", "pollen", "dance", "other", *[f"frame_{i}" for i in range(6)], "speed_median", "speed_iqr", "speed_q90", "dispersion", "dispersion_minute", "tortuosity", "tortuosity_minute", "exit_mean", "exit_std", "exit_median", "exit_iqr", "fraction_squares", "festoon", "empty"]
COUNTS = ["trips", "dance_visits", *[f"crossings_{i}" for i in range(6)]]
COHORTS = """co AS (SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS cohort, CAST(c_custkey % 400 AS BIGINT) AS tag, DATE '2023-12-01' + CAST(c_nationkey * 7 % 60 AS INTEGER) AS birth FROM customer), cz AS (SELECT cohort, min(birth) AS birth, count(*) AS k FROM co GROUP BY cohort),
 cn AS (SELECT *, row_number() OVER (ORDER BY birth, cohort) - 1 AS nth, coalesce(sum(k) OVER (ORDER BY birth, cohort ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM cz),
 idn AS (SELECT CAST(bf + row_number() OVER (PARTITION BY cohort ORDER BY tag) - 1 AS BIGINT) AS uid, cohort, nth, tag, cn.birth, coalesce(date_diff('day', DATE '2024-01-01', lead(cn.birth) OVER (PARTITION BY tag ORDER BY nth)) + 1, 31) AS last_use FROM co JOIN cn USING (cohort))"""


def _age(day: str) -> str:
    born = f"{day} - date_diff('day', DATE '2024-01-01', birth)"
    return f"CAST(CASE WHEN {born} >= 0 AND (nth = 0 OR {day} < last_use) THEN {born} ELSE -1 END AS INTEGER)"


def _identity(spark, d):
    c = table(spark, d, "customer")
    cohorts = c.select(F.col("c_nationkey").cast("int").alias("cohort"), F.pmod("c_custkey", F.lit(400)).alias("tag"), F.date_add(F.lit("2023-12-01").cast("date"), F.pmod(F.col("c_nationkey") * 7, F.lit(60)).cast("int")).alias("birth")).distinct()
    return identity.cohort_dimension(cohorts, C, 30)


def _dense(spark, d):
    return _geo(spark, d).withColumn("uid", F.pmod("uid", F.lit(2)))


def _coded(spark, d):
    rows = _dense(spark, d).withColumns({"_lx": F.col("x") / 330.0, "_ly": F.col("y") / 471.0})
    return substrate.codes_at(rows, _raster(spark, d), (0, 1), 14, "_lx", "_ly").drop("_lx", "_ly")


def _bins(spark, d, zero_fill=False):
    share = F.pmod("daynum", F.lit(5)) / 4.0
    rows = _coded(spark, d).withColumns({"weight0": 1 - share, "weight1": share})
    return timebins.bin_metrics(rows, C, BINS, zero_fill=zero_fill, max_seconds=SLOW, part_frames=PART, dance_floor=True)


def _rounded(df, names):
    return df.withColumns({k: six_digits(k) for k in names})


@query(BIN_SQL + ", " + COHORTS + f" SELECT tb.uid, daynum, td, n, {', '.join(f'CASE WHEN n >= 10 THEN round({k}, 6) END AS {k}' for k in SHARES)}, {', '.join(f'CASE WHEN n >= 10 THEN {k} END AS {k}' for k in COUNTS)}, CASE WHEN coalesce({_age('daynum')}, -1) >= 0 THEN cohort ELSE -1 END AS cohort, coalesce({_age('daynum')}, -1) AS age FROM tb LEFT JOIN idn USING (uid)")
def timebin_table(spark, d):
    """All columns of an hour's metrics, with age and cohort."""
    out = timebins.with_identity(_bins(spark, d), _identity(spark, d), identity.age_on(F.col("daynum"), C))
    return _rounded(out, SHARES)


@query(BIN_SQL + f" SELECT uid, daynum, td, n, {', '.join(f'CASE WHEN n >= 10 THEN coalesce(round({k}, 6), 0) ELSE 0 END AS {k}' for k in SHARES)}, {', '.join(f'CASE WHEN n >= 10 THEN {k} ELSE 0 END AS {k}' for k in COUNTS)} FROM tb")
def timebin_table_zeros(spark, d):
    return _rounded(_bins(spark, d, True), SHARES)


OUTSIDE = GRID.replace("user_id AS uid", "user_id % 2 AS uid")
ROLLED = ["dispersion_minute", *timebins.DAY_WEIGHTED, "circadian", "outside"]


@query(BIN_SQL + OUTSIDE.removeprefix(GEO.replace("user_id AS uid", "user_id % 2 AS uid")) + f""", l AS (SELECT *, lag(state) OVER (PARTITION BY uid, daynum ORDER BY td) AS p FROM inh), o AS (SELECT uid, daynum, avg(CASE WHEN state = 0 THEN 1.0 ELSE 0.0 END) AS outside, CAST(sum(CASE WHEN p = 1 AND state = 0 THEN 1 ELSE 0 END) AS BIGINT) AS departures FROM l GROUP BY ALL),
 t10 AS (SELECT uid, daynum, td, n, {', '.join(f'CASE WHEN n >= 10 THEN {k} END AS {k}' for k in SHARES + COUNTS)} FROM tb),
 m AS (SELECT uid, daynum, {', '.join(f'CAST(coalesce(sum({k}), 0) AS BIGINT) AS {k}' for k in timebins.DAY_SUMS)}, avg(dispersion_minute) AS dispersion_minute, {', '.join(f'sum({k} * n) / nullif(sum(n), 0) AS {k}' for k in timebins.DAY_WEIGHTED)}, avg(speed_median * sin((td - 5.5) / 24 * 2 * pi())) / nullif(avg(speed_median), 0) AS circadian FROM t10 GROUP BY ALL)
 SELECT uid, daynum, {', '.join(timebins.DAY_SUMS)}, {', '.join(f'round({k}, 6) AS {k}' for k in ROLLED)}, departures FROM m JOIN o USING (uid, daynum)""")
def day_matrix(spark, d):
    dense = _geo(spark, d).withColumns({"uid": F.pmod("uid", F.lit(2)), "td": F.expr(f"framenum div {HOUR}").cast("int")})
    seen = dense.groupBy("uid", "daynum", "td").agg(F.count("*").alias("n"), F.median("exit_dist").alias("exit_med"))
    outside = st.time_outside(st.in_hive(seen, ["uid", "daynum"], BINS, F.col("n") >= 1, F.col("exit_med") < 4_000), ["uid", "daynum"]).withColumnRenamed("trips", "departures")
    return _rounded(timebins.day_matrix(_bins(spark, d), F.col("td"), outside), ROLLED)


CELLS = BIN_SQL + """, ws AS (SELECT *, count(*) OVER (PARTITION BY uid, daynum, td) AS k, count(*) OVER (PARTITION BY uid, daynum, td, part) AS m, CASE WHEN lag(camera) OVER b = camera THEN sqrt(pow(x - lag(x) OVER b, 2) + pow(y - lag(y) OVER b, 2)) END AS step,
 CASE WHEN lag(camera) OVER p = camera THEN sqrt(pow(x - lag(x) OVER p, 2) + pow(y - lag(y) OVER p, 2)) END AS inner_step FROM h WINDOW b AS (PARTITION BY uid, daynum, td ORDER BY framenum, event_id), p AS (PARTITION BY uid, daynum, td, part ORDER BY framenum, event_id)),
 wp AS (SELECT uid, daynum, td, count(DISTINCT part) AS parts FROM h GROUP BY ALL), wf AS (SELECT ws.*, parts FROM ws JOIN wp USING (uid, daynum, td) WHERE k >= 10),
 wm AS (SELECT uid, daynum, td, square, part, k, parts, count(*) / any_value(m) AS share, count(*) AS n, sum(step) AS s, count(step) AS c, avg(inner_step) / any_value(m) AS v FROM wf WHERE square IS NOT NULL GROUP BY uid, daynum, td, square, part, k, parts),
 wc AS (SELECT uid, daynum, td, square AS cell, CAST(sum(n) AS BIGINT) AS n, k * sum(share) / parts AS n_minute, sum(s) / nullif(sum(c), 0) AS speed, k * avg(v) AS speed_minute FROM wm GROUP BY uid, daynum, td, square, k, parts)"""


@query(CELLS + " SELECT uid, daynum, td, cell, cell // 35 AS xbin, cell % 35 AS ybin, n, round(n_minute, 6) AS n_minute, round(speed, 6) AS speed, round(speed_minute, 6) AS speed_minute FROM wc")
def timebin_cells(spark, d):
    """Sightings and speeds per square of the comb in an hour, by rows and by parts of equal weight."""
    return _rounded(timebins.bin_cells(_dense(spark, d), C, BINS, part_frames=PART), ["n_minute", "speed", "speed_minute"])


@query(CELLS + """, wx AS (SELECT uid, daynum, td, k, m, parts, unnest([{'map': 0, 'code': code0}, {'map': 1, 'code': code1}]) AS c FROM wf)
 SELECT uid, daynum, td, c.map AS map, CAST(c.code AS INTEGER) AS code, count(*) AS n, round(k * sum(1.0::DOUBLE / m) / parts, 6) AS n_minute FROM wx WHERE c.code IS NOT NULL GROUP BY uid, daynum, td, c.map, c.code, k, parts""")
def timebin_substrates(spark, d):
    return _rounded(timebins.bin_substrates(_coded(spark, d), C, BINS, part_frames=PART, dance_floor=True), ["n_minute"])


@query(CELLS + " SELECT uid, daynum, cell, CAST(sum(n) AS BIGINT) AS n, round(sum(n_minute), 6) AS n_minute, round(sum(speed * n) / sum(CASE WHEN speed IS NOT NULL THEN n END), 6) AS speed FROM wc GROUP BY ALL")
def day_cells(spark, d):
    return _rounded(timebins.rolled_cells(timebins.bin_cells(_dense(spark, d), C, BINS, part_frames=PART)), ["n_minute", "speed"])


@query(GEO + ", s AS (SELECT uid, daynum, CAST(CASE WHEN xa = 6592 THEN 40 ELSE floor(xa * 41 / 6592.0) END AS INTEGER) AS xbin, CAST(CASE WHEN y = 5652 THEN 34 ELSE floor(y * 35 / 5652.0) END AS INTEGER) AS ybin FROM geo WHERE xa BETWEEN 0 AND 6592 AND y BETWEEN 0 AND 5652) SELECT uid, daynum, xbin * 35 + ybin AS cell, xbin, ybin, count(*) AS n FROM s GROUP BY ALL")
def day_histograms(spark, d):
    return timebins.day_histograms(_geo(spark, d), C)


@query("WITH " + COHORTS + " SELECT uid, cohort, CAST(nth AS INTEGER) AS nth, tag, strftime(birth, '%Y-%m-%d') AS birth, CAST(last_use AS INTEGER) AS last_use FROM idn")
def cohort_dimension(spark, d):
    return _identity(spark, d).withColumn("birth", F.col("birth").cast("string"))


@query("WITH " + COHORTS + f" SELECT CAST(k AS INTEGER) AS daynum, uid, {_age('k')} AS age FROM idn, (VALUES (0), (15), (29)) days(k)")
def ages_on_days(spark, d):
    return identity.ages(_identity(spark, d), [0, 15, 29], C)


TAGS = DET + ", " + COHORTS + f", wear AS (SELECT tag, daynum, uid, {_age('daynum')} AS age FROM (SELECT DISTINCT uid % 400 AS tag, daynum FROM det) JOIN idn USING (tag)), res AS (SELECT tag, daynum, min(uid) AS who, arg_min(age, uid) AS age FROM wear WHERE age >= 0 GROUP BY ALL)"


def _resolved(spark, d):
    rows = detections(spark, d, C).select("event_id", "daynum", F.pmod("uid", F.lit(400)).alias("tag"))
    return identity.resolved(rows, _identity(spark, d), C)


@query(TAGS + " SELECT event_id, coalesce(who, -1) AS who, coalesce(age, -1) AS age FROM det d LEFT JOIN res ON res.tag = d.uid % 400 AND res.daynum = d.daynum")
def tags_resolved(spark, d):
    return _resolved(spark, d).select("event_id", "who", "age")


@query(TAGS + " SELECT event_id, who, age FROM det d JOIN res ON res.tag = d.uid % 400 AND res.daynum = d.daynum WHERE age BETWEEN 0 AND 30")
def alive_sightings(spark, d):
    return identity.alive(_resolved(spark, d), 30).select("event_id", "who", "age")


AGES = "CASE WHEN uid % 3 = 0 THEN uid || '.0' ELSE CAST(uid AS VARCHAR) END AS id, CAST(uid % 40 AS INTEGER) AS age"


@query(LEAVE + f""", k AS (SELECT *, row_number() OVER (PARTITION BY uid, daynum ORDER BY framenum) AS i FROM vis), kept AS (SELECT k.* FROM k LEFT JOIN leaves l USING (event_id) WHERE i % 3 = 1 OR l.event_id IS NOT NULL),
 rk AS (SELECT *, visits - first_value(visits) OVER (PARTITION BY uid, daynum ORDER BY framenum RANGE BETWEEN {LOOK_BACK} PRECEDING AND CURRENT ROW) AS rec FROM kept), ag AS (SELECT DISTINCT {AGES} FROM det WHERE uid % 5 <> 0)
 SELECT rk.event_id, rk.uid, ag.age, CAST(year(rk.ts) AS INTEGER) AS year, CAST(month(rk.ts) AS INTEGER) AS month, CAST(day(rk.ts) AS INTEGER) AS day, CAST(hour(rk.ts) AS INTEGER) AS hour, CAST(minute(rk.ts) AS INTEGER) AS minute, CAST(second(rk.ts) AS INTEGER) AS second, CAST(rec AS BIGINT) AS recent, CASE WHEN l.event_id IS NULL THEN 'no change' ELSE 'leave' END AS status
 FROM rk LEFT JOIN leaves l ON l.event_id = rk.event_id LEFT JOIN ag ON CAST(CAST(ag.id AS DOUBLE) AS BIGINT) = rk.uid""")
def training_table(spark, d):
    uid = F.col("uid")
    known = detections(spark, d, C).where(F.pmod(uid, F.lit(5)) != 0).select(F.when(F.pmod(uid, F.lit(3)) == 0, F.concat(uid.cast("string"), F.lit(".0"))).otherwise(uid.cast("string")).alias("id"), F.pmod(uid, F.lit(40)).cast("string").alias("age"))
    return training.training_table(_visits(spark, d), _leaves(spark, d), known, 3, LOOK_BACK)


@query(GRID + f""", dd AS (SELECT uid, daynum, td * {HOUR} AS f, lead(state) OVER (PARTITION BY uid, daynum ORDER BY td) - state AS diff FROM inh), gone AS (SELECT * FROM dd WHERE diff = -1)
 SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM gone e WHERE e.daynum = g.daynum AND e.f = g.framenum // {HOUR} * {HOUR}) AND EXISTS (SELECT 1 FROM gone e WHERE e.daynum = g.daynum AND e.uid = g.uid) THEN 1 ELSE 0 END AS forage, CASE WHEN uid % 5 <> 0 THEN CAST(uid % 40 AS INTEGER) END AS age, CASE WHEN xa BETWEEN 3500 AND 6500 AND y BETWEEN 3800 AND 5400 THEN 1 ELSE 0 END AS in_exit_frame FROM geo g""")
def foraging_labels(spark, d):
    rows = _geo(spark, d).withColumns({"framenum": F.expr(f"framenum div {HOUR} * {HOUR}").cast("int"), "in_exit_frame": g.within(C, C.exit_frame)})
    known = rows.where("uid % 5 <> 0").select("uid", F.pmod("uid", F.lit(40)).cast("int").alias("age"))
    hive = st.hive_events(_in_hive(spark, d), ["uid", "daynum"], BINS, DAY)
    return training.foraging_labels(rows, hive, known).select("event_id", "forage", "age", "in_exit_frame")


@query(None)
def clean_trajectories(spark, d):
    """Two individuals' detections cleaned by the hour, two hours later by the clock, every third frame."""
    rows = _geo(spark, d).withColumns({"uid": F.pmod("uid", F.lit(2)), "confidence": F.col("value") / 500})
    return signal.clean_trajectories(rows, C, 0.1, 5, 20.0, 2.0, 3).select("event_id", "uid", "daynum", "framenum")


GAPS = LEAVE + """, near AS (SELECT l.event_id, l.uid, l.daynum, d.framenum, d.event_id AS s, lead(d.framenum) OVER (PARTITION BY l.event_id ORDER BY d.framenum, d.event_id) AS nx FROM leaves l JOIN det d ON d.uid = l.uid AND d.daynum = l.daynum AND d.framenum BETWEEN l.framenum - 60000 AND l.framenum + 60000),
 best AS (SELECT event_id, max((nx - framenum)::BIGINT * 1000000 - framenum) AS m, max(nx - framenum)::BIGINT AS wide FROM near WHERE nx IS NOT NULL GROUP BY event_id), lf2 AS (SELECT uid, daynum, max(framenum) AS last_frame FROM det GROUP BY ALL),
 found AS (SELECT l.event_id, l.uid, l.daynum, wide * 1000000 - m + 1 AS new_frame, CASE WHEN wide IS NULL THEN NULL WHEN last_frame = wide * 1000000 - m + 1 THEN -1 ELSE wide * 1000000 - m + wide END AS return_frame, last_frame FROM leaves l LEFT JOIN best USING (event_id) LEFT JOIN lf2 USING (uid, daynum))"""


@query(GAPS + " SELECT event_id, uid, daynum, CAST(new_frame AS INTEGER) AS new_frame, CAST(return_frame AS INTEGER) AS return_frame, last_frame FROM found")
def gap_round_leaves(spark, d):
    return w.around_gap(_leaves(spark, d), detections(spark, d, C), 60_000, 60_000)[0]


@query(GAPS + " SELECT f.event_id, f.daynum, f.uid, d.framenum, d.event_id AS sighting FROM found f JOIN det d ON d.uid = f.uid AND d.daynum = f.daynum AND d.framenum BETWEEN f.new_frame - 60000 AND f.new_frame + 60000")
def view_round_leaves(spark, d):
    return w.around_gap(_leaves(spark, d), detections(spark, d, C), 60_000, 60_000)[1]


HASH = "md5('12345|' || {key})"
WIDE, NEAR = 10_800, 1_500


@query(LEAVE + STEP.removeprefix(GEO) + f""", pool AS (SELECT DISTINCT daynum, uid AS control FROM det), pk AS (SELECT *, row_number() OVER (PARTITION BY daynum ORDER BY {HASH.format(key="daynum || '|' || control")}, control) - 1 AS pos, count(*) OVER (PARTITION BY daynum) AS n FROM pool),
 z AS (SELECT DISTINCT daynum, n FROM pk), ec AS (SELECT l.event_id, l.uid, l.daynum, l.framenum, z.n, CAST('0x' || substr({HASH.format(key="l.daynum || '|' || l.uid")}, 1, 8) AS BIGINT) % z.n AS pos FROM leaves l JOIN z USING (daynum)),
 ct AS (SELECT e.event_id, coalesce(nullif(a.control, e.uid), nullif(b.control, e.uid)) AS control FROM ec e LEFT JOIN pk a ON a.daynum = e.daynum AND a.pos = e.pos LEFT JOIN pk b ON b.daynum = e.daynum AND b.pos = (e.pos + 1) % e.n),
 ew AS (SELECT event_id, 'event' AS who, uid, daynum, framenum AS f FROM leaves UNION ALL SELECT l.event_id, 'control', control, daynum, framenum FROM leaves l JOIN ct USING (event_id) WHERE control IS NOT NULL),
 mv AS (SELECT ew.event_id, who, avg(speed) AS mean_speed, max(speed) AS max_speed, count(*) / {float(LOOK_BACK)} AS seen FROM ew JOIN spd s ON s.uid = ew.uid AND s.daynum = ew.daynum AND s.framenum > f - {LOOK_BACK} AND s.framenum < f GROUP BY ew.event_id, who),
 mt AS (SELECT DISTINCT a.daynum, a.framenum // {WIDE} * {WIDE} AS t, a.uid, b.uid AS partner FROM det a JOIN det b ON a.daynum = b.daynum AND a.framenum // {WIDE} = b.framenum // {WIDE} AND a.camera = b.camera AND a.uid <> b.uid WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < {NEAR}),
 mm AS (SELECT event_id, who, ew.daynum, partner, min(t) AS t FROM ew JOIN mt ON mt.uid = ew.uid AND mt.daynum = ew.daynum AND t > f - {LOOK_BACK} AND t < f GROUP BY ALL), fe AS (SELECT uid, min(daynum * 259200 + framenum) AS began FROM leaves GROUP BY uid),
 mc AS (SELECT event_id, who, count(*) AS partners, CAST(sum(CASE WHEN began < daynum * 259200 + t THEN 1 ELSE 0 END) AS BIGINT) AS earlier_partners FROM mm LEFT JOIN fe ON fe.uid = partner GROUP BY ALL)
 SELECT event_id, who, uid, coalesce(partners, 0) AS partners, coalesce(earlier_partners, 0) AS earlier_partners, round(mean_speed, 6) AS mean_speed, round(max_speed, 6) AS max_speed, round(coalesce(seen, 0), 6) AS seen FROM ew LEFT JOIN mc USING (event_id, who) LEFT JOIN mv USING (event_id, who)""")
def before_leaves(spark, d):
    """What individuals did before they left, beside controls of the same day at the same time."""
    leaves, rows = _leaves(spark, d), _speeds(spark, d)
    controls = sampling.matched_controls(leaves, rows.select("daynum", "uid").distinct(), ["daynum"], "uid", 12345).where("control is not null")
    both = leaves.select("event_id", F.lit("event").alias("who"), "uid", "daynum", "framenum").unionAll(controls.select("event_id", F.lit("control").alias("who"), F.col("control").alias("uid"), "daynum", "framenum"))
    first = leaves.groupBy("uid").agg(F.min(F.col("daynum").cast("bigint") * DAY + F.col("framenum")).alias("at"))
    out = training.before_events(both, rows, first, NEAR, LOOK_BACK, WIDE)
    return _rounded(out, ["mean_speed", "max_speed", "seen"])


@query(DET + """ SELECT event_id, CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 3) AS INTEGER) AS frame, strftime(TIMESTAMP '2024-01-01' + to_microseconds(CAST(daynum AS BIGINT) * 86400000000 + (framenum // 10800) * 3600000000), '%Y-%m-%d %H:%M:%S') AS bin_time, round((epoch_us(ts) % 86400000000) / 1e6, 6) AS seconds,
 strftime(try_cast(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed, framenum + 900 AS upper, framenum - 900 AS lower, lpad(CAST(framenum // 10800 AS VARCHAR), 2, '0') || ':' || lpad(CAST(framenum // 180 % 60 AS VARCHAR), 2, '0') || ':00' AS label, strftime(ts, '%m-%d') AS day_label, 'Bee ' || uid AS name, CAST(uid AS VARCHAR) AS bare, CAST((framenum + 21600) % 259200 AS INTEGER) AS shifted, daynum AS day FROM det""")
def clock_functions(spark, d):
    ts, frame = F.col("ts"), F.col("framenum")
    upper, lower = t.around(frame)
    parsed = t.time_from(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return detections(spark, d, C).select("event_id", t.frame_at(F.hour(ts), F.minute(ts), F.second(ts), C).alias("frame"), F.date_format(t.bin_time(F.col("daynum"), F.expr(f"framenum div {HOUR}"), BINS, C), "yyyy-MM-dd HH:mm:ss").alias("bin_time"), r6(t.seconds_of_day(ts), "seconds"), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"), upper.alias("upper"), lower.alias("lower"), t.clock_label(F.floor(frame / 180)).alias("label"), t.day_label(ts).alias("day_label"), t.labelled(F.col("uid")).alias("name"), t.unlabelled(t.labelled(F.col("uid"))).alias("bare"), t.shifted(frame, 2.0, C).alias("shifted"), t.day_within(ts, 60, C).alias("day"))


@query(DET + " SELECT event_id FROM det WHERE ts BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-06 18:00:00'")
def sightings_in_window(spark, d):
    """Who is where from noon of day 4 on, for 30 hours."""
    return detections(spark, d, C).where(F.col("ts").between(*t.window_bounds(4.5, 30, C))).select("event_id")


@query("WITH q AS (SELECT quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi, quantile_cont(value, 0.99) AS norm FROM events) SELECT event_id, round(CASE WHEN value - 100 > 0 THEN ln(value - 100) END, 6) AS logged, round(0.99 * least(greatest((value - lo) / nullif(hi - lo, 0), 0), 1), 6) AS clipped, round(least(value / nullif(norm, 0), 1), 6) AS opacity FROM events, q")
def display_scales(spark, d):
    rows = table(spark, d, "events")
    q = F.broadcast(stats.quantiles(rows, "value", [0.001, 0.999, 0.99]))  # one row
    v = F.col("value")
    return rows.crossJoin(q).select("event_id", r6(g.log_positive(v - 100), "logged"), r6(g.clipped(v, F.col("_q")[0], F.col("_q")[1]), "clipped"), r6(g.opacity(v, F.col("_q")[2]), "opacity"))


@query(DET + ", n AS (SELECT daynum, count(*) AS n FROM det GROUP BY daynum) SELECT * FROM n WHERE daynum BETWEEN 5 AND 12")
def closed_day_slice(spark, d):
    return detections(spark, d, C).groupBy("daynum").agg(F.count("*").alias("n")).where(F.col("daynum").between(5, 12))


@query("SELECT p_partkey, p_type FROM part WHERE NOT suffix(p_type, 'UM')")
def without_suffix(spark, d):
    return table(spark, d, "part").where(~F.col("p_type").endswith("UM")).select("p_partkey", "p_type")


@query(DET + " SELECT DISTINCT uid FROM det ORDER BY uid LIMIT 20")
def first_keys(spark, d):
    """The first 20 individuals by number, in order."""
    return detections(spark, d, C).select("uid").distinct().orderBy("uid").limit(20)


@query(DET + ", a AS (SELECT daynum, count(*) AS a FROM det WHERE uid % 7 = 0 AND daynum < 20 GROUP BY daynum), b AS (SELECT daynum, count(*) AS b FROM det WHERE uid % 7 = 1 AND daynum > 5 GROUP BY daynum) SELECT coalesce(a.daynum, b.daynum) AS daynum, a, b FROM a FULL JOIN b ON a.daynum = b.daynum")
def series_side_by_side(spark, d):
    rows = detections(spark, d, C)
    one = rows.where("uid % 7 = 0 and daynum < 20").groupBy("daynum").agg(F.count("*").alias("a"))
    return one.join(rows.where("uid % 7 = 1 and daynum > 5").groupBy("daynum").agg(F.count("*").alias("b")), "daynum", "full")


@query("WITH r AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS i FROM lineitem) SELECT v AS value, min(i) AS first, max(i) AS last FROM r GROUP BY v")
def rank_positions(spark, d):
    return stats.positions(table(spark, d, "lineitem"), "l_quantity")


@query(DET + ", k AS (SELECT event_id, row_number() OVER (PARTITION BY uid, daynum ORDER BY framenum) - 1 AS i FROM det) SELECT event_id, CAST(i AS INTEGER) AS index, CAST(i % 3 AS INTEGER) AS phase FROM k")
def running_index(spark, d):
    return w.numbered_rows(detections(spark, d, C), 3).select("event_id", F.col("index").cast("int"), F.col("phase").cast("int"))


EDGES = [0.0, 2.5, 10.0, 11.0, 30.0, 50.0]


@query(f"WITH b AS (SELECT CASE {' '.join(f'WHEN l_quantity >= {a} AND l_quantity {q} {b} THEN {i}' for i, (a, b, q) in enumerate(zip(EDGES, EDGES[1:], ['<', '<', '<', '<', '<='], strict=False)))} END AS bin FROM lineitem), n AS (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin) SELECT CAST(bin AS INTEGER) AS bin, n, round(n / ((SELECT sum(n) FROM n) * [2.5, 7.5, 1.0, 19.0, 20.0][bin + 1]), 6) AS density FROM n")
def edges_hist(spark, d):
    return stats.histogram_of(table(spark, d, "lineitem"), "l_quantity", EDGES).select("bin", "n", r6("density", "density"))


@query("SELECT CAST(CASE WHEN l_quantity <= 1 + 49 / 7.0 THEN 0 ELSE ceil((l_quantity - 1) * 7 / 49.0) - 1 END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def equal_width_bins(spark, d):
    edges = stats.equal_width_edges(1.0, 50.0, 7)
    return table(spark, d, "lineitem").groupBy(stats.cut(F.col("l_quantity"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query(DET + ", s AS (SELECT uid, daynum, sum(CASE WHEN value > 300 THEN value END) AS total FROM det GROUP BY ALL) SELECT uid, daynum, round(total, 6) AS known, round(coalesce(total, 0), 6) AS filled FROM s")
def sums_of_nothing(spark, d):
    """A sum over nothing as null, and as 0."""
    total = F.sum(F.when(F.col("value") > 300, F.col("value")))
    return detections(spark, d, C).groupBy("uid", "daynum").agg(r6(total, "known"), r6(F.coalesce(total, F.lit(0.0)), "filled"))


MATRIX = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "CASE WHEN l_linenumber <> 2 THEN l_tax END"}


@query("WITH v AS (SELECT l_quantity, l_discount, CASE WHEN l_linenumber <> 2 THEN l_tax END AS l_tax FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))))
def spearman_all(spark, d):
    rows = table(spark, d, "lineitem").select(*[F.expr(x).alias(k) for k, x in MATRIX.items()])
    return stats.spearman_matrix(rows, list(MATRIX)).select("a", "b", r6("r", "r"))


NAMES = ["honey", "larvae", "eggs", "empty", "pollen", "dance floor", "wood", "feeder", "white", "peripheral", "queen cell", "drone", "new comb", "festoon", "outside"]


@query(AT + f" SELECT event_id, map_id, {NAMES}[CAST(code AS INTEGER) + 1] AS name FROM cell")
def substrate_names(spark, d):
    return _at(spark, d).select("event_id", F.col("map_id").cast("int").alias("map_id"), substrate.substrate_name(F.col("code"), NAMES).alias("name"))


@query(DET + " SELECT event_id, 'many' AS ids FROM det WHERE uid IN (1, 7, 30) AND value / 500 > 0.3 AND ts BETWEEN TIMESTAMP '2024-01-03 20:00:00' AND TIMESTAMP '2024-01-04 04:00:00' UNION ALL SELECT event_id, 'one' FROM det WHERE uid = 5 AND value / 500 > 0.3 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' UNION ALL SELECT event_id, 'all' FROM det WHERE value / 500 > 0.3 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'")
def scan_by_ids(spark, d):
    """The scan with many ids over midnight, one, all, and none."""
    rows, out = detections(spark, d, C).withColumn("confidence", F.col("value") / 500), None
    for name, ids, start, end in (("many", [1, 7, 30], "2024-01-03 20:00:00", "2024-01-03 04:00:00"), ("one", [5], "2024-01-03", "2024-01-20"), ("all", list(range(4096)), "2024-01-03", "2024-01-04"), ("none", [], "2024-01-03", "2024-01-20")):
        one = scan_detections(rows, ids, 4096, 0.3, start, end).select("event_id", F.lit(name).alias("ids"))
        out = one if out is None else out.unionAll(one)
    return out


@query(None)
def knn_grid(spark, d):
    """Accuracy of the vote by number of neighbours and weighting."""
    return models.best_neighbours(table(spark, d, "embeddings"), range(2, 11), "embedding", "label", "vec_id").withColumn("accuracy", F.round("accuracy", 6))


@query(DET + " SELECT event_id, framenum FROM det WHERE framenum % 3 = 0")
def every_third_frame(spark, d):
    return detections(spark, d, C).where("framenum % 3 = 0").select("event_id", "framenum")


@query(STEP + " SELECT event_id, round(speed, 6) AS speed, round(distance, 6) AS distance FROM spd WHERE speed IS NOT NULL AND distance IS NOT NULL")
def complete_rows(spark, d):
    return _speeds(spark, d).dropna(subset=["speed", "distance"]).select("event_id", r6("speed", "speed"), r6("distance", "distance"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS exp_day FROM nation WHERE n_regionkey = 1 UNION ALL SELECT CAST(n_nationkey AS INTEGER) FROM nation WHERE n_regionkey = 3")
def flagged_days(spark, d):
    """Days of a calendar made of the nations whose flag is set, and those with a label."""
    flag = F.when(F.col("n_regionkey") == 1, "TRUE").when(F.col("n_regionkey") == 3, "half").otherwise("FALSE")
    calendar = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("exp_day"), flag.alias("rest_day"))
    return tables.flagged_days(calendar, "rest_day").unionAll(tables.flagged_days(calendar, "rest_day", "half"))


@query(GRID + f", dd AS (SELECT uid, daynum, td, lead(state) OVER (PARTITION BY uid, daynum ORDER BY td) - state AS diff FROM inh) SELECT uid, daynum, CAST(td * {HOUR} AS INTEGER) AS framenum FROM dd WHERE diff = 1")
def hive_returns(spark, d):
    """When individuals come back: the other direction of the list of leaves."""
    return st.hive_events(_in_hive(spark, d), ["uid", "daynum"], BINS, DAY).where("diff = 1").select("uid", "daynum", "framenum")


@query(GRID.replace("tops[CASE WHEN obs THEN s WHEN", "tops[CASE WHEN obs THEN td WHEN") + " SELECT uid, daynum, td, state FROM ons")
def on_substrate_per_bin(spark, d):
    """Each seen bin's own state, instead of that of its run's first."""
    rows = _binned(spark, d)
    return st.on_substrate(rows, ["uid", "daynum"], BINS, F.col("n") >= 1, F.col("top") > 0.5, per_bin=True)
