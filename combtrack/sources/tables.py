"""Scans, and the adapter that reads the driver's event table as detections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HIVE_2018, HiveConfig
from ..functions import timeops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, c: HiveConfig = HIVE_2018) -> DataFrame:
    """(event_id, uid, daynum, framenum, x, y, camera, ts, value) from `events`."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("uid"),
        timeops.day_of(ts, c).cast("int").alias("daynum"),
        timeops.frame_of(ts, c).alias("framenum"),
        (33 * F.regexp_extract("props", "([0-9]+)", 1).cast("int")).alias("x"),
        F.pmod(F.col("event_id") * 997, F.lit(5653)).cast("int").alias("y"),
        F.pmod("event_id", F.lit(2)).cast("int").alias("camera"),
        ts.alias("ts"),
        "value",
    )


def scan_detections(df: DataFrame, ids: Sequence[int] | None, id_space: int, confidence: float, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Filters as a detector's database scan: no ids give no rows, all ids no predicate; confidence is strict, times closed.

    An end before the start lies on the next day. Filters and columns reach the scan.
    """
    begin, finish = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    finish = F.when(finish <= begin, finish + F.expr("interval 1 day")).otherwise(finish)
    out = df.where((F.col("confidence") > confidence) & F.col("ts").between(begin, finish))
    if ids is not None and len(set(ids)) < id_space:
        out = out.where(F.col("uid").isin(list(ids)) if len(ids) else F.lit(False))
    return out.orderBy("ts", "event_id").limit(limit) if limit else out


def jdbc_hours(day: str, start: str = "00:00:00", end: str = "23:59:59.999999") -> list[tuple[datetime, datetime, bool]]:
    """Slices of up to an hour of a closed interval of times, [from, to) but for the last, which is closed; an end not behind the start is on the next day."""
    first, last = (datetime.fromisoformat(f"{day}T{x}") for x in (start, end))
    if last <= first:
        last += timedelta(days=1)
    out, at = [], first
    while at < last:
        to = min(last, at.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1))
        out.append((at, to, to == last))
        at = to
    return out


def scan_jdbc(spark: SparkSession, url: str, name: str, day: str, ids: Sequence[int] | None = None, id_space: int = 4096, confidence: float = 0.3, start: str = "00:00:00", end: str = "23:59:59.999999", columns: Sequence[str] = ("timestamp", "bee_id", "bee_id_confidence", "cam_id", "x_pos", "y_pos", "orientation"), options: dict[str, str] | None = None) -> DataFrame:
    """Detections of a day from a database table, a partition for each hour of it; columns by their names there.

    The hour is each partition's own predicate in the database, half open, so that a detection stamped on the hour comes
    once; the whole interval is closed. Ids and confidence are pushed down like any filter on the frame: none of the ids
    gives no rows, all of them no predicate, confidence is strict. No ordering and no limit: both are the frame's.
    """
    stamp, who, sure = columns[:3]
    quoted = ", ".join(f'"{c}"' for c in columns)
    text = lambda t: t.strftime("%Y-%m-%d %H:%M:%S.%f")
    slices = [f"\"{stamp}\" >= '{text(a)}' AND \"{stamp}\" {'<=' if closed else '<'} '{text(b)}'" for a, b, closed in jdbc_hours(day, start, end)]
    out = spark.read.jdbc(url, f"(SELECT {quoted} FROM {name}) scan", predicates=slices, properties=options or {})
    out = out.where(F.col(sure) > confidence)
    if ids is not None and len(set(ids)) < id_space:
        out = out.where(F.col(who).isin(list(ids)) if len(ids) else F.lit(False))
    return out


def write_bucketed(df: DataFrame, name: str, buckets: int = 64) -> None:
    """A table of days, bucketed and sorted by individual: windows by individual, or by individual and day, need no exchange.

    The first write makes the table; a later one replaces the days that it has rows of and leaves the others untouched,
    whatever their number. Each day's task writes whole buckets: rows are dealt out by individual as the buckets are.
    """
    spark = df.sparkSession
    last = [c for c in df.columns if c != "daynum"] + ["daynum"]
    dealt = df.select(last).repartition(buckets, "uid").sortWithinPartitions("daynum", "uid", "framenum")
    if not spark.catalog.tableExists(name):
        dealt.write.partitionBy("daynum").bucketBy(buckets, "uid").sortBy("uid", "framenum").option("compression", "zstd").saveAsTable(name)
        return
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dealt.select(spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(daynum, day) of every day from first to last."""
    days = spark.range(1).select(F.posexplode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("daynum", "day"))
    return days.select(F.col("daynum").cast("int"), "day")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headed CSV, plain or gzip (which one task reads: deal it out afterwards)."""
    return spark.read.csv(path, schema=schema, header=True)


def write_days(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by day, so that later scans of some days read their folders alone."""
    df.repartition("daynum").sortWithinPartitions("uid", "framenum").write.partitionBy("daynum").option("compression", "zstd").mode(mode).parquet(path)


def day_paths(days: Sequence[int], template: str, folders: dict[tuple[int, int], str]) -> list[str]:
    """Paths of the days' files: `template` has {folder} and {day}, with any padding; `folders` by range of days, ends included."""
    out = []
    for day in days:
        folder = next((f for (a, b), f in folders.items() if a <= day <= b), None)
        if folder is None:
            raise ValueError(f"no folder for day {day}")
        out.append(template.format(folder=folder, day=day))
    return out


def read_day_files(spark: SparkSession, days: Sequence[int], template: str, folders: dict[tuple[int, int], str]) -> DataFrame:
    """The Parquet files of some days, one a day; no days are an error, as they have no schema."""
    return spark.read.parquet(*day_paths(days, template, folders))


def convert_days(df: DataFrame, path: str, whole: Sequence[str], mode: str = "error") -> None:
    """Writes a table by day with the columns of whole numbers, however they came, as integers; text that is no number is null."""
    casts = {c: F.col(c).try_cast("double").try_cast("int") for c in whole}
    write_days(df.withColumns(casts), path, mode)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(measurement, nth, raster_id, height, width, pixels) of the images in `path`/<measurement>/, numbered by name.

    Pixels are three bytes each in the order blue, green, red, as Spark's image source has them; of other images only
    those of three channels are read. A raster's id is 2 * measurement + nth, as a measurement has a pair of images.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    images = images.where("nChannels = 3").withColumn("measurement", F.regexp_extract("origin", "/([0-9]+)/[^/]*$", 1).try_cast("int"))
    nth = F.row_number().over(Window.partitionBy("measurement").orderBy("origin")) - 1
    nth = F.when(nth < 2, nth).otherwise(F.raise_error(F.lit("a measurement has more than two images")))
    out = images.where("measurement is not null").withColumn("nth", nth)
    return out.select("measurement", "nth", (2 * F.col("measurement") + F.col("nth")).cast("bigint").alias("raster_id"), "height", "width", F.col("data").alias("pixels"))


def read_days(spark: SparkSession, path: str, days: Sequence[int]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("daynum").isin(list(days)))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def flagged_days(experiments: DataFrame, flag: str, label: str = "TRUE") -> DataFrame:
    """Days of an experiment calendar whose flag has a label."""
    return experiments.where(F.col(flag) == label).select("exp_day")
