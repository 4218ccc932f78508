"""Columns of positions on the two sides of the comb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HiveConfig

def x_unfolded(c: HiveConfig, x="x", camera="camera") -> Column:
    """Camera 0 is drawn to the right of camera 1."""
    return F.col(x) + F.when(F.col(camera) == 0, c.xpixels).otherwise(0)


def x_flat(c: HiveConfig, x="x", camera="camera") -> Column:
    """Camera 1 is the mirror image of camera 0."""
    return F.when(F.col(camera) == 1, c.xpixels - F.col(x)).otherwise(F.col(x))


def y_flat(c: HiveConfig, y="y", camera="camera") -> Column:
    return F.when(F.col(camera) == 1, F.col(y) + c.left_yshift).otherwise(F.col(y))


def exit_distance(c: HiveConfig, x="x", y="y", camera="camera") -> Column:
    """To the exit in the corner of camera 0; the path from the lowest frame of camera 1 is reflected at its divider."""
    flat = F.when((F.col(camera) == 1) & (F.col(y) > c.div_left[1]), 2 * c.div_right[1] - (F.col(y) + c.left_yshift)).otherwise(y_flat(c, y, camera))
    return F.hypot(x_flat(c, x, camera) - c.xpixels, flat - c.ypixels)


def within(c: HiveConfig, box: tuple[int, int, int, int], x="x", y="y", camera="camera") -> Column:
    """1 inside the closed rectangle (x0, x1, y0, y1) of unfolded coordinates, else 0 (also where a coordinate is null)."""
    inside = x_unfolded(c, x, camera).between(box[0], box[1]) & F.col(y).between(box[2], box[3])
    return F.coalesce(inside, F.lit(False)).cast("int")


def frame_index(c: HiveConfig, y="y", camera="camera") -> Column:
    """0 to 2 on camera 1, 3 to 5 on camera 0, by the right side's dividers; one less above the image, one more far below."""
    row = F.when(F.col(y) < 0, -1).when(F.col(y) < c.div_right[0], 0).when(F.col(y) < c.div_right[1], 1).when(F.col(y) < 2 * c.ypixels, 2).otherwise(3)
    return row + F.when(F.col(camera) == 0, 3).otherwise(0)


def bin_of(value: Column, n: int, top: float) -> Column:
    """Number of the equal-width bin of [0, top], which the last bin includes; null outside."""
    bin_ = F.when(value == top, n - 1).otherwise(F.floor(value * n / top))
    return F.when((value >= 0) & (value <= top), bin_).cast("int")


def angle_wrapped(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def circadian(hour: Column) -> Column:
    """A sine over the day, highest at 11:30."""
    return F.sin((hour - 5.5) / 24 * 2 * F.pi())


def frame_in_image(c: HiveConfig, y="y", camera="camera") -> Column:
    """0 to 2 on camera 1, 3 to 5 on camera 0, by each side's own dividers; the last frame includes the lower edge, outside the image null."""

    def on(dividers: tuple[int, int], first: int) -> Column:
        return F.when((F.col(y) < 0) | (F.col(y) > c.ypixels), None).when(F.col(y) < dividers[0], first).when(F.col(y) < dividers[1], first + 1).when(F.col(y) <= c.ypixels, first + 2)

    return F.when(F.col(camera) == 1, on(c.div_left, 0)).when(F.col(camera) == 0, on(c.div_right, 3))


def cell(c: HiveConfig, x="xa", y="y") -> Column:
    """Number of the square of unfolded coordinates, column by column; null outside."""
    return bin_of(F.col(x), c.x_bins, 2.0 * c.xpixels) * c.y_bins + bin_of(F.col(y), c.y_bins, float(c.ypixels))


def cell_bins(number: Column, c: HiveConfig) -> list[Column]:
    """`xbin` and `ybin` of a square's number."""
    return [F.floor(number / c.y_bins).cast("int").alias("xbin"), F.pmod(number, F.lit(c.y_bins)).cast("int").alias("ybin")]


def log_positive(value: Column) -> Column:
    """Natural logarithm; null where there is none."""
    return F.when(value > 0, F.log(value))


def clipped(value: Column, low: Column, high: Column) -> Column:
    """Share of the way from low to high, cut to 0..1 and scaled by 0.99, so that it numbers a colour; null for a range of nothing."""
    share = F.try_divide(value - low, high - low)
    return F.when(share.isNotNull(), 0.99 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def opacity(count: Column, norm: Column) -> Column:
    """A histogram's count as an opacity: 1 from the norm on; null for a norm of nothing."""
    share = F.try_divide(count, norm)
    return F.when(share.isNotNull(), F.least(share, F.lit(1.0)))
