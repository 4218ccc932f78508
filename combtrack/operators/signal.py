"""Work on one individual's series that no window expresses: the low-pass filter and removal of speed errors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import HiveConfig
from ..functions.timeops import shifted
from .windows import best_confidence, scaled, with_geometry

#: Samples that one matrix product filters; series, and samples of them, that are filtered side by side.
BLOCK, SIDE_BY_SIDE, SAMPLES = 256, 512, 1 << 20


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """By key over all shuffle partitions: rows are few for their bytes, but each group costs time."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _ties(df: DataFrame, *first: str) -> list[str]:
    """The columns that put rows in one order: those named, then time and number of the sighting, where there are any."""
    return [*first, *(c for c in ("ts", "framenum", "event_id") if c in df.columns and c not in first)]


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by key as tables of whole groups, with the group of each row: many small groups at once, or one large one."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        group = _group_of(rows, keys)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield rows.slice(0, last), group[:last]
        rest = rows.slice(last)
    if rest is not None:
        yield rest, np.zeros(rest.num_rows, int)


def _group_of(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, int)
    for key in keys:
        codes = pc.dictionary_encode(rows.column(key).combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _floats(rows: pa.Table, name: str) -> np.ndarray:
    """A column of numbers as doubles; null as NaN."""
    return pc.cast(rows.column(name), pa.float64(), safe=False).to_numpy()


def butterworth(poles: int, cutoff: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(b, a) of each second-order section of a low-pass filter by the bilinear transform; unit gain at rest."""
    edge = 2 * rate * np.tan(np.pi * cutoff / rate)
    angles = np.pi * (2 * np.arange(1, poles + 1) + poles - 1) / (2 * poles)
    roots = (2 * rate + edge * np.exp(1j * angles)) / (2 * rate - edge * np.exp(1j * angles))
    sections = []
    for root in roots[np.imag(roots) > 1e-12]:
        a = np.array([1.0, -2 * root.real, abs(root) ** 2])
        sections.append((np.array([1.0, 2.0, 1.0]) * a.sum() / 4, a))
    if poles % 2:
        root = roots[poles // 2].real
        sections.append((np.array([1.0, 1.0, 0.0]) * (1 - root) / 2, np.array([1.0, -root, 0.0])))
    return sections


@lru_cache
def _matrices(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """A section in state space: powers of the step, the input's gain, the response within a block, and the state at rest."""
    step, gain = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = np.empty((BLOCK + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(BLOCK):
        powers[i + 1] = step @ powers[i]
    response = np.concatenate([[b[0]], (powers[: BLOCK - 1] @ gain)[:, 0]])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    return powers, powers[:BLOCK] @ gain, np.where(lag >= 0, response[np.abs(lag)], 0.0), np.linalg.solve(np.eye(2) - step, gain)


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One section over the columns of x, as if its first value had always been there; one matrix product per block."""
    powers, driven, moving, rest = _matrices(tuple(b), tuple(a))
    state, y = np.outer(rest, x[0]), np.empty_like(x)
    for start in range(0, len(x), BLOCK):
        part = x[start : start + BLOCK]
        n = len(part)
        y[start : start + n] = moving[:n, :n] @ part + powers[:n, 0, :] @ state
        state = powers[n] @ state + driven[:n][::-1].T @ part
    return y


def zero_phase(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """The columns of x filtered forwards and backwards, with odd reflections at the ends; None if x is too short for them."""
    pad = 3 * (2 * len(sections) + 1 - sum(a[2] == 0 for _, a in sections))
    if len(x) <= pad:
        return None
    out = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            out = _section(b, a, out)
        out = out[::-1]
    return out[pad:-pad]


def zero_phase_all(full: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """`zero_phase` of many series that lie one behind the other in `full`, side by side by their lengths; NaN where one is too short."""
    pad = 3 * (2 * len(sections) + 1 - sum(a[2] == 0 for _, a in sections))
    out, order = np.full(len(full), np.nan), np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > pad]
    at = 0
    while at < len(order):
        some = order[at : at + max(1, min(SIDE_BY_SIDE, SAMPLES // int(lengths[order[at]] + 2 * pad)))]
        at += len(some)
        n, begin = lengths[some], starts[some]
        row = np.arange(int(n.max()) + 2 * pad)[:, None]
        pos = row - pad  # odd reflections before the first and behind the last sample; rows behind those are not read
        value = full[begin + np.clip(np.where(pos < 0, -pos, np.where(pos >= n, 2 * (n - 1) - pos, pos)), 0, n - 1)]
        x = np.where(pos < 0, 2 * full[begin] - value, np.where(pos >= n, 2 * full[begin + n - 1] - value, value))
        back = np.maximum(n + 2 * pad - 1 - row, 0)
        for _ in range(2):
            for b, a in sections:
                x = _section(b, a, x)
            x = np.take_along_axis(x, back, axis=0)
        inside = (pos >= 0) & (pos < n)
        out[(begin + pos)[inside]] = x[inside]
    return out


def low_pass(df: DataFrame, columns: list[str], cutoff: float, rate: float, poles: int = 5, frame: str = "framenum") -> DataFrame:
    """`filtered <column>` of each: interpolated to every frame, filtered without delay, kept at the observed frames.

    Per (uid, daynum). Null coordinates are interpolated over and stay null, as do series too short to filter; of rows
    of one frame the last counts, by time and number of the sighting where there are any. Tasks take sorted rows as they
    come and filter the series of a batch side by side; what they hold is a batch, or a day of one individual, which the
    clock bounds.
    """
    keys, sections = ["uid", "daynum"], butterworth(poles, cutoff, rate)
    out = T.StructType([*df.schema, *[T.StructField(f"filtered {c}", T.DoubleType()) for c in columns]])

    def filtered(at: np.ndarray, value: np.ndarray, group: np.ndarray) -> np.ndarray:
        smooth, seen = np.full(len(at), np.nan), np.flatnonzero(~np.isnan(at) & ~np.isnan(value))
        if not len(seen):
            return smooth
        frames, of = at[seen].astype(np.int64), group[seen]
        last = np.append((frames[1:] != frames[:-1]) | (of[1:] != of[:-1]), True)
        own, number = np.unique(of, return_inverse=True)
        low, high = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
        np.minimum.at(low, number, frames)
        np.maximum.at(high, number, frames)
        lengths = high - low + 1
        for a, b in _runs(lengths):
            starts = np.cumsum(lengths[a:b]) - lengths[a:b]
            rows = np.flatnonzero((number >= a) & (number < b))
            place = starts[number[rows] - a] + frames[rows] - low[number[rows]]
            full = np.interp(np.arange(int(lengths[a:b].sum())), place[last[rows]], value[seen[rows]][last[rows]])
            smooth[seen[rows]] = zero_phase_all(full, starts, lengths[a:b], sections)[place]
        return smooth

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches, keys):
            at = _floats(rows, frame)
            for c in columns:
                smooth = filtered(at, _floats(rows, c), group)
                rows = rows.append_column(f"filtered {c}", pa.array(smooth, mask=np.isnan(smooth)))
            yield from rows.to_batches()

    return _dealt(df, keys).sortWithinPartitions(*keys, *_ties(df, frame)).mapInArrow(work, out)


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of series that have SAMPLES samples or few more, or are one longer series."""
    number = np.cumsum(lengths) // SAMPLES
    bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(lengths)]
    return zip(bounds[:-1], bounds[1:], strict=True)


def drop_speed_errors(df: DataFrame, c: HiveConfig, keys: list[str], max_speed: float | None = None, least: int = 10, at: str = "ts") -> DataFrame:
    """Rows left when steps faster than `max_speed` (pixels a second, by `at`) on one camera are removed until none is left.

    Each pass drops the later row of every such step, and the first row if the first step is one. Groups of fewer than
    `least` rows go; one that shrinks below it keeps what is left. Needs `fx`, `fy`, `camera`; a step with a null or in no
    time isn't an error unless it moves. Rows of one time go by `framenum` and `event_id`, so that their arrival doesn't matter. A group is an individual's hour (or day), which the clock bounds; only groups
    that have an error leave the JVM, where a pass goes over all groups of a batch at once.
    """
    limit = c.max_speed if max_speed is None else max_speed
    order = _ties(df, at)

    def kept(rows: pa.Table, group: np.ndarray) -> np.ndarray:
        x, y, camera = (_floats(rows, k) for k in ("fx", "fy", "camera"))
        seconds = pc.cast(pc.cast(rows.column(at), pa.timestamp("us", rows.column(at).type.tz)), pa.int64()).to_numpy() / 1_000_000
        left, settled = np.flatnonzero(np.bincount(group)[group] >= least), []
        while len(left):
            own, before = group[left], np.append(-1, group[left[:-1]])
            with np.errstate(invalid="ignore"):
                moved = np.hypot(np.diff(x[left]), np.diff(y[left])) > limit * np.diff(seconds[left])
                wrong = np.append(False, moved & (np.diff(camera[left]) == 0)) & (own == before) & (np.bincount(own)[own] >= least)
            again = np.bincount(own, weights=wrong)[own] > 0
            settled.append(left[~again])
            at_first = np.append(wrong[1:], False) & (own != before)
            left = left[again & ~wrong & ~at_first]
        return np.sort(np.concatenate(settled)) if settled else left

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches, keys):
            yield from rows.take(pa.array(kept(rows, group))).to_batches()

    group, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
    step = F.hypot(F.col("fx") - F.lag("fx").over(w), F.col("fy") - F.lag("fy").over(w))
    seconds = (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / 1_000_000
    wrong = F.coalesce((step > limit * seconds) & (F.col("camera") == F.lag("camera").over(w)), F.lit(False))
    rows = df.withColumns({"_n": F.count("*").over(group), "_wrong": wrong}).where(F.col("_n") >= least)
    rows = rows.withColumn("_bad", F.max("_wrong").over(group)).drop("_n", "_wrong")
    fine, bad = rows.where(~F.col("_bad")).drop("_bad"), rows.where("_bad").drop("_bad")
    return fine.unionByName(_dealt(bad, keys).sortWithinPartitions(*keys, *order).mapInArrow(work, df.schema))


def clean_trajectories(df: DataFrame, c: HiveConfig, confidence: float, least: int = 10, max_speed: float | None = None, shift_hours: float = 0.0, every: int = 1) -> DataFrame:
    """Raw detections (confidence, ts, geometry) as trajectories: in a season of another scale positions and geometry anew; the best detection of each frame, if above `confidence`; hours with fewer than `least` rows go; speed errors go (`drop_speed_errors`); the clock is shifted; every k-th frame stays.
    """
    rows = df if c.scale == 1 else with_geometry(scaled(df, c), c)
    hours = best_confidence(rows, confidence).withColumn("_hour", F.expr(f"framenum div {c.frames_per_day // 24}"))
    kept = drop_speed_errors(hours, c, ["uid", "daynum", "_hour"], max_speed, least).drop("_hour")
    return kept.withColumn("framenum", shifted(F.col("framenum"), shift_hours, c)).where(F.col("framenum") % every == 0)
