"""Rasters of comb contents: classes of pixels, look-up under detections, weights of the measurements around a day."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most maps, whose list (80 KB) is sent to every task.
MOST_MAPS = 10_000
#: Days of a block, within which measurements are put in order.
BLOCK_DAYS = 64
#: Side of a tile: a task holds as many rows, or columns, of an image.
TILE = 256


def _bounded(items: Column, most: int, what: str) -> Column:
    return F.when(F.size(items) <= most, items).otherwise(F.raise_error(F.lit(f"more than {most} {what}")))


def measurement_weights(days: DataFrame, measured: DataFrame) -> DataFrame:
    """(daynum, meas, weight): the last measurement up to each day and the first from it on, by inverse distance.

    A single one weighs 1; of two on the day itself the first weighs 1 and the other 0. `measured` has (meas, daynum),
    numbered in order of time; nulls in either column are left out. A scan in two levels: within blocks of BLOCK_DAYS
    days, and over a row a block, which carries the measurements next to it in.
    """
    ends = measured.dropna(subset=["daynum", "meas"]).groupBy("daynum").agg(F.min("meas").alias("_first"), F.max("meas").alias("_last"))
    asked = days.select("daynum").dropna().distinct().withColumn("_asked", F.lit(True))
    entry = lambda meas: F.when(F.col(meas).isNotNull(), F.struct(F.col("daynum").alias("day"), F.col(meas).alias("meas")))
    out = asked.join(ends, "daynum", "full").withColumns({"_block": F.floor(F.col("daynum") / BLOCK_DAYS), "_a": entry("_last"), "_b": entry("_first")})
    in_block, blocks = Window.partitionBy("_block").orderBy("daynum"), Window.orderBy("_block")
    carried = out.groupBy("_block").agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    carried = carried.select("_block", F.max("_a").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_b").over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    last, following = F.max("_a").over(in_block.rowsBetween(Window.unboundedPreceding, 0)), F.min("_b").over(in_block.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumns({"_a": last, "_b": following}).join(carried, "_block").where("_asked")
    out = out.select("daynum", F.coalesce("_a", "_before").alias("a"), F.coalesce("_b", "_after").alias("b"))
    far_a, far_b = F.col("daynum") - F.col("a.day"), F.col("b.day") - F.col("daynum")
    lone = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == F.col("b"))
    share = F.when(lone, 1.0).when(far_b == 0, 0.0).otherwise(F.try_divide(far_b, far_a + far_b))
    cells = F.array(F.struct(F.col("a.meas").alias("meas"), share.alias("weight")), F.struct(F.when(~lone | F.col("a").isNull(), F.col("b.meas")).alias("meas"), F.when(F.col("a").isNull(), 1.0).otherwise(1 - share).alias("weight")))
    return out.select("daynum", F.explode(cells).alias("c")).select("daynum", "c.meas", "c.weight").where("meas is not null")


def _cells(df: DataFrame, extent: DataFrame, x: str, y: str) -> DataFrame:
    """`_xi`, `_yi`: coordinates rounded half to even and cut to the smallest map's extent (one row of `_mx`, `_my`)."""
    cell = lambda c, most: F.when(F.col(c).isNotNull(), F.least(F.bround(F.col(c).cast("double"), 0).cast("int"), most))
    return df.crossJoin(F.broadcast(extent)).withColumns({"_xi": cell(x, "_mx"), "_yi": cell(y, "_my")})


def substrate_at(df: DataFrame, raster: DataFrame, default: int, x: str = "x", y: str = "y") -> DataFrame:
    """Each row once per map of the raster (map_id, camera, xi, yi, code), with `map_id` and `code`.

    Coordinates are rounded half to even and cut to the smallest map's extent; a cell that a map lacks has the
    default, a coordinate that is null or negative no code.
    """
    extent = raster.groupBy("map_id").agg(F.max("xi").alias("mx"), F.max("yi").alias("my"))
    extent = extent.agg(F.collect_set("map_id").alias("_maps"), F.min("mx").alias("_mx"), F.min("my").alias("_my"))
    extent = extent.select(_bounded(F.col("_maps"), MOST_MAPS, "maps").alias("_maps"), "_mx", "_my")
    at = _cells(df, extent, x, y).withColumn("map_id", F.explode("_maps")).drop("_maps", "_mx", "_my")
    cells = raster.select("map_id", "camera", F.col("xi").alias("_xi"), F.col("yi").alias("_yi"), F.col("code").alias("_code"))
    found = at.join(cells, ["map_id", "camera", "_xi", "_yi"], "left")
    fine = (F.col("_xi") >= 0) & (F.col("_yi") >= 0)
    return found.withColumn("code", F.when(fine, F.coalesce("_code", F.lit(default)))).drop("_code", "_xi", "_yi")


def codes_at(df: DataFrame, raster: DataFrame, maps: Sequence[int], default: int, x: str = "x", y: str = "y") -> DataFrame:
    """Each row once, with `code<map>` for each of `maps`, by one look-up: a cell of the raster holds its codes on all of them. All else as `substrate_at`."""
    extent = raster.groupBy("map_id").agg(F.max("xi").alias("mx"), F.max("yi").alias("my")).agg(F.min("mx").alias("_mx"), F.min("my").alias("_my"))
    codes = [F.max(F.when(F.col("map_id") == m, F.col("code"))).alias(f"code{m}") for m in maps]
    cells = raster.where(F.col("map_id").isin(list(maps))).groupBy("camera", F.col("xi").alias("_xi"), F.col("yi").alias("_yi")).agg(*codes)
    found = _cells(df, extent, x, y).drop("_mx", "_my").join(cells, ["camera", "_xi", "_yi"], "left")
    fine = (F.col("_xi") >= 0) & (F.col("_yi") >= 0)
    return found.withColumns({f"code{m}": F.when(fine, F.coalesce(f"code{m}", F.lit(default))) for m in maps}).drop("_xi", "_yi")


def simple_substrate(code: Column, dance: Column) -> Column:
    """Six classes: 0 honey, 1 brood, 2 empty comb, 3 pollen, 4 dance floor (where the dance map has 5), 5 other."""
    return F.when(dance == 5, 4).when(code.isin(1, 2), 1).when(code == 3, 2).when(code == 4, 3).when(code > 4, 5).otherwise(code)


def substrate_name(code: Column, names: Sequence[str]) -> Column:
    """The code's name; null for codes without one."""
    return F.get(F.array(*[F.lit(n) for n in names]), code.cast("int"))


def cut_tiles(images: DataFrame, size: int = TILE) -> DataFrame:
    """(raster_id, y0, x0, height, width, pixels): whole images (raster_id long, height int, width int, pixels binary of three bytes each) as tiles.

    `height` and `width` are the image's; a tile ends with its image. Images of null pixels or of no size have no tiles.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, h, w, data in zip(batch["raster_id"], batch["height"], batch["width"], batch["pixels"]):
                if data is None or not h or not w:
                    continue
                image = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                for y in range(0, h, size):
                    row = [(i, y, x, h, w, image[y : y + size, x : x + size].tobytes()) for x in range(0, w, size)]
                    yield pd.DataFrame(row, columns=["raster_id", "y0", "x0", "height", "width", "pixels"])

    return images.select("raster_id", "height", "width", "pixels").mapInPandas(work, "raster_id long, y0 int, x0 int, height int, width int, pixels binary")


def _in_column(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the row of the nearest assigned one in its column (ties: the upper; -1: none) and its code."""
    height, (rows, columns) = len(codes), np.indices(codes.shape)
    above = np.maximum.accumulate(np.where(codes >= 0, rows, -1), axis=0)
    below = np.minimum.accumulate(np.where(codes >= 0, rows, height)[::-1], axis=0)[::-1]
    take_below = (above < 0) | ((below < height) & (below - rows < rows - above))
    near = np.where(take_below, np.where(below < height, below, -1), above)
    return near, np.where(near >= 0, codes[np.maximum(near, 0), columns], -1)


def _in_row(near: np.ndarray, code: np.ndarray, first_row: int) -> np.ndarray:
    """The code of the nearest assigned pixel (Euclid; ties: the upper, then the left one), from the nearest ones of all columns.

    Columns are tried from the pixel's own outwards, as long as one could still be nearer than what has been found.
    """
    height, width = near.shape
    rows = np.arange(first_row, first_row + height)[:, None]
    far = np.int64(1) << 60
    off = np.where(near >= 0, (near.astype(np.int64) - rows) ** 2, far)
    best, where, out = off.copy(), np.where(near >= 0, near.astype(np.int64) * width + np.arange(width), far), code.copy()
    todo = np.nonzero(off > 0)
    for dx in range(1, width):
        open_ = best[todo] >= dx * dx
        todo = (todo[0][open_], todo[1][open_])
        if not len(todo[0]):
            break
        for side in (-dx, dx):
            x = todo[1] + side
            inside = (x >= 0) & (x < width)
            y, at, x = todo[0][inside], todo[1][inside], x[inside]
            d, pos = off[y, x] + dx * dx, near[y, x].astype(np.int64) * width + x
            nearer = (near[y, x] >= 0) & ((d < best[y, at]) | ((d == best[y, at]) & (pos < where[y, at])))
            y, at, x = y[nearer], at[nearer], x[nearer]
            best[y, at], where[y, at], out[y, at] = d[nearer], pos[nearer], code[y, x]
    return out


def classify_tiles(tiles: DataFrame, colours: Sequence[tuple[int, int, int]], tolerance: int = 20) -> DataFrame:
    """(raster_id, xi, yi, code) of tiles as `cut_tiles` gives them, of any size, also of images that no task could hold.

    A pixel has the code of the last colour within `tolerance` (sum over the channels), else that of the nearest pixel
    of a class by Euclid's distance; ties go to the upper, then the left one. This is exact in two passes: along
    columns, where a task holds the tiles of one column of them, and along rows, where it holds one row of them. An
    image without a pixel of a class gives null codes.
    """
    palette = np.array(colours, dtype=np.int16).reshape(-1, 3)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in batches:
            out = []
            for y0, x0, h, w, data in zip(tile["y0"], tile["x0"], tile["height"], tile["width"], tile["pixels"]):
                pixels = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int16)
                codes = np.full(len(pixels), -1, np.int32)
                for code, colour in enumerate(palette):
                    codes[np.abs(pixels - colour).sum(axis=1) <= tolerance] = code
                out.append(codes.tobytes())
            yield tile.assign(pixels=out).rename(columns={"pixels": "codes"})

    def columns(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("y0")
        height = int(tile["height"].iloc[0])
        strip = np.frombuffer(b"".join(tile["codes"]), np.int32).reshape(height, -1)
        near, code = (x.astype(np.int32) for x in _in_column(strip))
        ends = [*tile["y0"].tolist()[1:], height]
        part = lambda x: [x[a:b].tobytes() for a, b in zip(tile["y0"], ends, strict=True)]
        return tile.assign(codes=part(code), near=part(near))

    def rows(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("x0")
        y0, width = int(tile["y0"].iloc[0]), int(tile["width"].iloc[0])
        ends = [*tile["x0"].tolist()[1:], width]
        joined = lambda c: np.concatenate([np.frombuffer(data, np.int32).reshape(-1, b - a) for data, a, b in zip(tile[c], tile["x0"], ends, strict=True)], axis=1)
        codes = _in_row(joined("near"), joined("codes"), y0)
        y, x = np.indices(codes.shape)
        flat = codes.ravel()
        return pd.DataFrame({"raster_id": tile["raster_id"].iloc[0], "xi": x.ravel().astype(np.int32), "yi": (y.ravel() + y0).astype(np.int32), "code": pd.Series(flat, dtype="Int32").mask(flat < 0)})

    fields = "raster_id long, y0 int, x0 int, height int, width int, codes binary"
    found = tiles.mapInPandas(coded, fields).groupBy("raster_id", "x0").applyInPandas(columns, f"{fields}, near binary")
    return found.groupBy("raster_id", "y0").applyInPandas(rows, "raster_id long, xi int, yi int, code int")


def classify_rasters(images: DataFrame, colours: Sequence[tuple[int, int, int]], tolerance: int = 20, size: int = TILE) -> DataFrame:
    """(raster_id, xi, yi, code) of whole images, cut into tiles of `size`, which changes no code; all as `classify_tiles` says."""
    return classify_tiles(cut_tiles(images, size), colours, tolerance)


def blended(at: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, n, share): rows per class under the maps of a day, each map by its weight; `share` of the rows with a code.

    `at` is that of substrate_at, with `daynum`; `weights` has (daynum, map_id, weight).
    """
    rows = at.where(F.col("code").isNotNull()).join(weights, ["daynum", "map_id"]).groupBy(*keys, "code").agg(F.sum("weight").alias("n"))
    return rows.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(*keys))))
