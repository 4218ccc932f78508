"""Registered queries on rasters, signals, samples and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import HIVE_2018 as C
from ..operators import events as ev
from ..operators import models, sampling, signal, substrate
from ..operators import windows as w
from ..sources.tables import detections, table
from .catalogue import BINS, DAY, DET, GEO, GRID, HOUR, LEAVE, STEP, _bouts, _geo, _leaves, _speeds, _visits, query, r6

# Rasters of 10 by 12 cells on two maps and two sides, from the parts' keys and sizes.
RASTER = "raster AS (SELECT p_partkey % 2 AS map_id, (p_partkey // 2) % 2 AS camera, (p_partkey // 4) % 10 AS xi, (p_partkey // 40) % 12 AS yi, max(p_size) % 15 AS code FROM part GROUP BY ALL)"
AT = DET + f", {RASTER}, e AS (SELECT min(mx) AS mx, min(my) AS my FROM (SELECT max(xi) AS mx, max(yi) AS my FROM raster GROUP BY map_id)), k AS (SELECT DISTINCT map_id FROM raster), cell AS (SELECT d.event_id, k.map_id, coalesce(r.code, 14) AS code FROM det d CROSS JOIN k CROSS JOIN e LEFT JOIN raster r ON r.map_id = k.map_id AND r.camera = d.camera AND r.xi = least(CAST(round_even(d.x / 330.0, 0) AS INTEGER), mx) AND r.yi = least(CAST(round_even(d.y / 471.0, 0) AS INTEGER), my))"


def _raster(spark, d):
    k = lambda n, m: F.expr(f"(p_partkey div {n}) % {m}").cast("int")
    return table(spark, d, "part").groupBy(k(1, 2).alias("map_id"), k(2, 2).alias("camera"), k(4, 10).alias("xi"), k(40, 12).alias("yi")).agg((F.max("p_size") % 15).cast("int").alias("code"))


def _at(spark, d):
    rows = detections(spark, d, C).select("event_id", "camera", (F.col("x") / 330.0).alias("x"), (F.col("y") / 471.0).alias("y"))
    return substrate.substrate_at(rows, _raster(spark, d), 14)


@query(AT + " SELECT event_id, CAST(map_id AS INTEGER) AS map_id, CAST(code AS INTEGER) AS code FROM cell")
def substrate_lookup(spark, d):
    return _at(spark, d).select("event_id", "map_id", "code")


@query(AT + ", p AS (SELECT event_id, max(CASE WHEN map_id = 0 THEN code END) AS c, max(CASE WHEN map_id = 1 THEN code END) AS dance FROM cell GROUP BY event_id) SELECT event_id, CAST(CASE WHEN dance = 5 THEN 4 WHEN c IN (1, 2) THEN 1 WHEN c = 3 THEN 2 WHEN c = 4 THEN 3 WHEN c > 4 THEN 5 ELSE c END AS INTEGER) AS code FROM p")
def substrate_simple(spark, d):
    both = _at(spark, d).groupBy("event_id").agg(*[F.max(F.when(F.col("map_id") == i, F.col("code"))).alias(n) for i, n in enumerate(("c", "dance"))])
    return both.select("event_id", substrate.simple_substrate(F.col("c"), F.col("dance")).cast("int").alias("code"))


@query(DET + """, m AS (SELECT n_nationkey AS meas, CAST(n_nationkey * n_nationkey % 31 AS INTEGER) AS md FROM nation), d AS (SELECT DISTINCT daynum FROM det),
 a AS (SELECT daynum, arg_max(meas, md * 1000 + meas) AS am, max(md) AS ad FROM d JOIN m ON md <= daynum GROUP BY daynum), b AS (SELECT daynum, arg_min(meas, md * 1000 + meas) AS bm, min(md) AS bd FROM d JOIN m ON md >= daynum GROUP BY daynum),
 p AS (SELECT d.daynum, am, bm, d.daynum - ad AS da, bd - d.daynum AS db FROM d LEFT JOIN a USING (daynum) LEFT JOIN b USING (daynum)),
 u AS (SELECT daynum, am AS meas, CASE WHEN bm IS NULL OR bm = am THEN 1.0 WHEN db = 0 THEN 0.0 ELSE db / (da + db) END AS weight FROM p WHERE am IS NOT NULL
 UNION ALL SELECT daynum, bm, CASE WHEN am IS NULL THEN 1.0 WHEN db = 0 THEN 1.0 ELSE da / (da + db) END FROM p WHERE bm IS NOT NULL AND (am IS NULL OR am <> bm)) SELECT daynum, meas, round(weight, 6) AS weight FROM u""")
def measurement_weights(spark, d):
    measured = table(spark, d, "nation").select(F.col("n_nationkey").alias("meas"), F.pmod(F.col("n_nationkey") * F.col("n_nationkey"), F.lit(31)).cast("int").alias("daynum"))
    return substrate.measurement_weights(detections(spark, d, C), measured).select("daynum", "meas", r6("weight", "weight"))


@query(None)
def raster_classes(spark, d):
    """Vectors of 64 components as grey images of 8 by 8 pixels, in five classes."""
    byte = lambda v: F.unhex(F.repeat(F.lpad(F.hex(F.pmod(F.floor(v.cast("double") * 256), F.lit(256))), 2, "0"), 3))
    grey = F.aggregate("embedding", F.unhex(F.lit("")), lambda a, v: F.concat(a, byte(v)))
    images = table(spark, d, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").alias("raster_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), grey.alias("pixels"))
    return substrate.classify_rasters(images, [(g, g, g) for g in (20, 70, 128, 190, 240)])


@query(None)
def lowpass_filter(spark, d):
    """Positions of a day in steps of 200 seconds, smoothed below one cycle in about 3 hours."""
    rows = detections(spark, d, C).select("event_id", "uid", "daynum", F.expr("framenum div 600").alias("framenum"), "x", "y")
    out = signal.low_pass(rows, ["x", "y"], 1 / 10_000, 1 / 200)
    return out.select("event_id", *[r6(f"filtered {c}", f"filtered_{c}") for c in "xy"])


@query(None)
def speed_fixpoint_clean(spark, d):
    """Sightings left in each individual's day of three or more when none is to be reached at over 0.1 pixels a second."""
    return signal.drop_speed_errors(_geo(spark, d), C, ["uid", "daynum"], 0.1, 3).select("event_id", "uid", "daynum")


HASH = "md5('{seed}|' || {key})"


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format(seed=42, key='event_id')}, event_id) AS n FROM events) WHERE n <= 100")
def balanced_sample(spark, d):
    return sampling.balanced_sample(table(spark, d, "events"), "event_type", "event_id", 100, 42).select("event_id", "event_type")


@query(f"WITH k AS (SELECT event_id, row_number() OVER (ORDER BY {HASH.format(seed=42, key='event_id')}, event_id) - 1 AS pos FROM events WHERE event_type = 'click'), t AS (SELECT count(*) AS n FROM k), r AS (SELECT i, CAST('0x' || substr({HASH.format(seed=42, key='i')}, 1, 8) AS BIGINT) % n AS pos FROM range(601) x(i), t WHERE n > 0) SELECT i AS draw, event_id FROM r JOIN k USING (pos)")
def bootstrap_balance(spark, d):
    return sampling.bootstrap(table(spark, d, "events").where("event_type = 'click'"), "event_id", 601, 42).select("draw", "event_id")


@query(LEAVE + f""", pool AS (SELECT DISTINCT daynum, uid AS control FROM det), k AS (SELECT *, row_number() OVER (PARTITION BY daynum ORDER BY {HASH.format(seed=12345, key="daynum || '|' || control")}, control) - 1 AS pos, count(*) OVER (PARTITION BY daynum) AS n FROM pool),
 z AS (SELECT DISTINCT daynum, n FROM k), e AS (SELECT l.event_id, l.uid, l.daynum, z.n, CAST('0x' || substr({HASH.format(seed=12345, key="l.daynum || '|' || l.uid")}, 1, 8) AS BIGINT) % z.n AS pos FROM leaves l JOIN z USING (daynum))
 SELECT e.event_id, coalesce(nullif(a.control, e.uid), nullif(b.control, e.uid)) AS control FROM e LEFT JOIN k a ON a.daynum = e.daynum AND a.pos = e.pos LEFT JOIN k b ON b.daynum = e.daynum AND b.pos = (e.pos + 1) % e.n""")
def matched_controls(spark, d):
    pool = detections(spark, d, C).select("daynum", "uid").distinct()
    return sampling.matched_controls(_leaves(spark, d), pool, ["daynum"], "uid", 12345).select("event_id", "control")


@query(GRID + f""", sl AS (SELECT uid, daynum, td, state, lag(state) OVER (PARTITION BY uid ORDER BY daynum, td) AS p FROM ons), fs AS (SELECT uid, min(daynum * {BINS} + td) AS s FROM sl WHERE state = 1 AND (p IS NULL OR p <> 1) GROUP BY uid),
 st AS (SELECT uid, CAST(s // {BINS} AS INTEGER) AS daynum, (s % {BINS}) * {HOUR} AS f FROM fs), h AS (SELECT st.uid, min(g.framenum) AS framenum FROM st JOIN geo g ON g.uid = st.uid AND g.daynum = st.daynum AND g.framenum > f AND g.framenum < f + {HOUR} WHERE f + {HOUR} < {DAY} AND g.frame IN (0, 3) GROUP BY st.uid)
 SELECT st.uid, CASE WHEN h.framenum IS NOT NULL THEN st.daynum END AS daynum, h.framenum FROM st LEFT JOIN h USING (uid)""")
def first_fine_event(spark, d):
    first = _bouts(spark, d).where("state = 1").groupBy("uid").agg(F.min("start").alias("s"))
    starts = first.select("uid", F.expr(f"cast(s div {BINS} as int)").alias("daynum"), (F.col("s") % BINS * HOUR).alias("framenum"))
    return ev.first_fine(starts, _geo(spark, d), HOUR, DAY, F.col("frame").isin(0, 3))


@query(GRID + AT.removeprefix(DET) + f""", sl AS (SELECT uid, daynum, td, state, lag(state) OVER (PARTITION BY uid ORDER BY daynum, td) AS p FROM ons), fs AS (SELECT uid, min(daynum * {BINS} + td) AS s FROM sl WHERE state = 1 AND (p IS NULL OR p <> 1) GROUP BY uid),
 st AS (SELECT uid, CAST(s // {BINS} AS INTEGER) AS daynum, (s % {BINS}) * {HOUR} AS f FROM fs), on13 AS (SELECT g.uid, g.daynum, g.framenum FROM geo g JOIN cell c ON c.event_id = g.event_id AND c.map_id = g.daynum % 2 AND c.code IN (8, 13)),
 h AS (SELECT st.uid, min(o.framenum) AS framenum FROM st JOIN on13 o ON o.uid = st.uid AND o.daynum = st.daynum AND o.framenum > f AND o.framenum < f + {HOUR} WHERE f + {HOUR} < {DAY} GROUP BY st.uid)
 SELECT st.uid, CASE WHEN h.framenum IS NOT NULL THEN st.daynum END AS daynum, h.framenum FROM st LEFT JOIN h USING (uid)""")
def first_fine_substrate(spark, d):
    """First frames on two classes of the comb, festoon among them, under the map of the day."""
    first = _bouts(spark, d).where("state = 1").groupBy("uid").agg(F.min("start").alias("s"))
    starts = first.select("uid", F.expr(f"cast(s div {BINS} as int)").alias("daynum"), (F.col("s") % BINS * HOUR).alias("framenum"))
    rows = detections(spark, d, C).select("event_id", "uid", "daynum", "framenum").join(_at(spark, d).select("event_id", "map_id", "code"), "event_id")
    flag = (F.col("map_id") == F.pmod("daynum", F.lit(2))) & F.col("code").isin(8, 13)
    return ev.first_fine(starts, rows, HOUR, DAY, flag)


@query(STEP + " SELECT CAST(floor(flat / sec * 200) AS BIGINT) AS bin, count(*) AS n FROM stp WHERE pc = camera AND sec > 0 GROUP BY ALL")
def speed_hist(spark, d):
    rows = _speeds(spark, d)
    rows = rows.withColumn("sec", (F.col("framenum") - F.lag("framenum").over(w.in_order(rows))) / C.fps).where("pc = camera and sec > 0")
    return rows.groupBy(F.floor(F.col("flat") / F.col("sec") * 200).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 50 <> 0), k AS (SELECT q.vec_id, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, p.e), p.vec_id) AS n FROM q, p), v AS (SELECT vec_id, label, count(*) AS c FROM k WHERE n <= 5 GROUP BY ALL) SELECT vec_id, CAST(arg_max(label, c * 1000 - label) AS BIGINT) AS predicted FROM v GROUP BY vec_id"
)
def knn_eval(spark, d):
    rows = table(spark, d, "embeddings")
    return models.nearest_vote(rows.where("vec_id % 50 = 0"), rows.where("vec_id % 50 <> 0"), 5, "embedding", "label", "vec_id")


@query(AT + """, w AS (SELECT d.uid, d.daynum, c.code, CASE WHEN c.map_id = 0 THEN 1 - (d.daynum % 5) / 4.0 ELSE (d.daynum % 5) / 4.0 END AS weight FROM cell c JOIN det d USING (event_id)), g AS (SELECT uid, daynum, code, sum(weight) AS n FROM w GROUP BY ALL)
 SELECT uid, daynum, CAST(code AS INTEGER) AS code, round(n, 6) AS n, round(n / nullif(sum(n) OVER (PARTITION BY uid, daynum), 0), 6) AS share FROM g""")
def substrate_blend(spark, d):
    rows = detections(spark, d, C).select("event_id", "uid", "daynum")
    share = F.pmod("daynum", F.lit(5)) / 4.0
    weights = rows.select("daynum").distinct().select("daynum", F.explode(F.array(F.struct(F.lit(0).alias("map_id"), (1 - share).alias("weight")), F.struct(F.lit(1).alias("map_id"), share.alias("weight")))).alias("c")).select("daynum", "c.*")
    out = substrate.blended(_at(spark, d).join(rows, "event_id"), weights, ["uid", "daynum"])
    return out.select("uid", "daynum", "code", r6("n", "n"), r6("share", "share"))


@query(LEAVE + " SELECT event_id FROM det WHERE daynum IN (SELECT daynum FROM leaves) AND uid IN (SELECT uid FROM leaves)")
def independent_semi_joins(spark, d):
    return ev.among_events(detections(spark, d, C), _leaves(spark, d), ["daynum", "uid"]).select("event_id")


@query(LEAVE + " SELECT b.event_id, b.uid, b.framenum, a.recent FROM (SELECT uid, daynum, framenum, CAST(recent AS BIGINT) AS recent FROM leaves) a RIGHT JOIN det b ON a.uid = b.uid AND a.daynum = b.daynum AND a.framenum = b.framenum")
def right_join_events(spark, d):
    leaves = _leaves(spark, d).select("uid", "daynum", "framenum", "recent")
    return leaves.join(detections(spark, d, C).select("event_id", "uid", "daynum", "framenum"), ["uid", "daynum", "framenum"], "right").select("event_id", "uid", "framenum", "recent")


@query(LEAVE + ", f AS (SELECT uid, min(daynum) AS first FROM leaves GROUP BY uid) SELECT event_id FROM det LEFT JOIN f USING (uid) WHERE first IS NULL OR first > daynum + 2")
def not_yet_left(spark, d):
    first = _leaves(spark, d).groupBy("uid").agg(F.min("daynum").alias("first"))
    return ev.not_yet(detections(spark, d, C), first, F.col("daynum"), 2).select("event_id")


@query(DET + ", t AS (SELECT count(DISTINCT (daynum, framenum)) AS n FROM det) SELECT uid, round(count(*) / max(t.n), 6) AS visible FROM det, t GROUP BY uid")
def frame_visibility(spark, d):
    rows = detections(spark, d, C)
    total = F.broadcast(rows.agg(F.countDistinct("daynum", "framenum").alias("total")))  # one number
    return rows.groupBy("uid").agg(F.count("*").alias("n")).crossJoin(total).select("uid", r6(F.try_divide("n", "total"), "visible"))


@query("SELECT event_type, count(*) AS n, count(value) AS seen FROM events GROUP BY event_type")
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("seen"))


@query(GEO + f", h AS (SELECT CAST(uid % 4 AS BIGINT) AS cohort, CAST(framenum // {HOUR} AS INTEGER) AS hour, CAST(frame AS INTEGER) AS frame, count(*) AS n FROM geo GROUP BY ALL), k AS (SELECT CAST(uid % 4 AS BIGINT) AS cohort, count(DISTINCT uid) AS individuals FROM det GROUP BY ALL) SELECT cohort, hour, frame, round(n / individuals, 6) AS mean FROM h JOIN k USING (cohort)")
def cohort_hour_hist(spark, d):
    rows = _geo(spark, d).select("uid", F.pmod("uid", F.lit(4)).alias("cohort"), F.expr(f"cast(framenum div {HOUR} as int)").alias("hour"), F.col("frame").cast("int").alias("frame"))
    size = rows.groupBy("cohort").agg(F.countDistinct("uid").alias("individuals"))
    return rows.groupBy("cohort", "hour", "frame").agg(F.count("*").alias("n")).join(size, "cohort").select("cohort", "hour", "frame", r6(F.try_divide("n", "individuals"), "mean"))


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM events GROUP BY event_type")
def class_distribution(spark, d):
    q = table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile(value, array(0.05, 0.25, 0.5, 0.75, 0.95))").alias("q"))
    return q.select("event_type", *[r6(F.col("q")[i], f"q{p}") for i, p in enumerate((5, 25, 50, 75, 95))])


FEATURES = ["daynum", "hour", "minute", "exit_dist", "visits", "recent"]


def _examples(spark, d):
    """Every leave against as many other sightings, by a seed."""
    leaves = _leaves(spark, d).select("event_id", F.lit(1).alias("left"))
    rows = _visits(spark, d).withColumns({"hour": F.hour("ts"), "minute": F.minute("ts")}).join(leaves, "event_id", "left")
    rows = rows.withColumn("label", F.coalesce("left", F.lit(0)))
    return models.assembled(sampling.against_all(rows, "label", "event_id", 42), FEATURES, "event_id", 25)


def _model(name: str):
    def run(spark, d):
        """Three rows of figures, for which the model is fitted when the query is built; the examples are held meanwhile."""
        rows = _examples(spark, d).persist()
        found = models.judged(models.estimator(name), models.in_few_parts(rows)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})
        figures = found.collect()
        rows.unpersist()
        return spark.createDataFrame(figures, found.schema)

    run.__name__ = f"{name}_eval"
    return query(None)(run)


for _name in models.NAMES:
    _model(_name)


@query(None)
def knn_judged(spark, d):
    """Three rows of figures for the vote of five neighbours on the labels' parity, as the other models' `..._eval` give."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.pmod("label", F.lit(2)).cast("bigint").alias("label"), F.pmod(F.xxhash64(F.lit(25), "vec_id"), F.lit(100)).cast("int").alias("part"))
    found = models.judged_neighbours(rows, 5, vector="embedding", key="vec_id")
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})
