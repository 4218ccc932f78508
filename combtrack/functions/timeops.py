"""Columns of the recordings' clock: days of 24 hours of `fps` frames a second, in exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HiveConfig

DAY_US = 86_400_000_000


def micros_of_day(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts), F.lit(DAY_US))


def frame_of(ts: Column, c: HiveConfig) -> Column:
    return F.floor(micros_of_day(ts) * c.fps / 1_000_000).cast("int")


def day_of(ts: Column, c: HiveConfig) -> Column:
    return F.date_diff(ts.cast("date"), F.lit(c.first_day).cast("date"))


def time_of(day: Column, frame: Column, c: HiveConfig, whole_seconds: bool = False) -> Column:
    """Inverse of day and frame, to the microsecond or cut to whole seconds."""
    start = F.unix_micros(F.lit(c.first_day).cast("timestamp")) + day.cast("bigint") * DAY_US
    within = F.floor(frame / c.fps) * 1_000_000 if whole_seconds else F.floor(frame.cast("bigint") * 1_000_000 / c.fps)
    return F.timestamp_micros(start + within)


def frame_at(hour: Column, minute: Column, second: Column, c: HiveConfig) -> Column:
    """Frame of a time of day; seconds may have fractions."""
    return F.floor((hour * 3600 + minute * 60 + second) * c.fps).cast("int")


def seconds_of_day(ts: Column) -> Column:
    return micros_of_day(ts) / 1_000_000


def bin_time(day: Column, td: Column, bins: int, c: HiveConfig) -> Column:
    """When a time bin of a day begins."""
    start = F.unix_micros(F.lit(c.first_day).cast("timestamp")) + day.cast("bigint") * DAY_US
    return F.timestamp_micros(start + F.floor(td.cast("bigint") * DAY_US / bins))


def day_within(ts: Column, days: int, c: HiveConfig) -> Column:
    """Day number of a calendar of so many days; a time outside it is an error."""
    day = day_of(ts, c)
    return F.when(ts.isNull() | day.between(0, days - 1), day).otherwise(F.raise_error(F.concat(F.lit("not in the calendar: "), ts.cast("string"))))


def parts_of(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts)}


def time_from(text: Column) -> Column:
    """`yyyy-MM-dd[ HH:mm:ss]` as a time; null for other text."""
    return F.try_to_timestamp(text)


def around(frame: Column, frames: int = 900) -> tuple[Column, Column]:
    """(upper, lower) bounds of the frames round one; 900 are five minutes."""
    return frame + frames, frame - frames


def clock_label(minutes: Column) -> Column:
    """Minutes of a day as HH:MM:00."""
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(two(F.floor(minutes / 60)), F.lit(":"), two(F.pmod(minutes, F.lit(60))), F.lit(":00"))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd")


def labelled(uid: Column, prefix: str = "Bee ") -> Column:
    return F.concat(F.lit(prefix), uid.cast("string"))


def unlabelled(text: Column, prefix: str = "Bee ") -> Column:
    """What follows the prefix, where the text has it."""
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def shifted(frame: Column, hours: float, c: HiveConfig) -> Column:
    """A frame of the day moved on, round the clock."""
    return F.pmod(frame + int(hours * 3600 * c.fps), F.lit(c.frames_per_day))


def window_bounds(day: float, hours: float, c: HiveConfig) -> tuple[Column, Column]:
    """First and last time of a window of `hours` from a fractional day on."""
    start = F.unix_micros(F.lit(c.first_day).cast("timestamp")) + int(day * DAY_US)
    return F.timestamp_micros(start), F.timestamp_micros(start + int(hours * 3_600_000_000))
