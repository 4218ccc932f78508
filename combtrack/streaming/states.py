"""Presence states, hive events and leaves over an endless table of sightings, decided by event-time timers.

A sighting has `uid`, `ts` (timestamp), `exit_dist` and, for leaves, `event_id` (bigint). State is kept per individual and
survives a restart in the query's checkpoint; what belongs to a day goes when its last bin is over. The stream needs
`spark.sql.streaming.stateStore.providerClass` to be PROVIDER. Rows later than the watermark are left out.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import HiveConfig

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _placed(stream: DataFrame, c: HiveConfig, late: str) -> DataFrame:
    """`daynum` and `framenum` of each sighting by its time in the session's zone, with a watermark."""
    day = F.datediff(F.to_date("ts"), F.lit(c.first_day))
    inside = F.unix_micros("ts") - F.unix_micros(F.date_trunc("day", "ts"))
    placed = stream.withColumns({"daynum": day.cast("int"), "framenum": F.floor(inside * c.fps / 1_000_000).cast("int"), "begin": F.unix_millis(F.date_trunc("day", "ts"))})
    return placed.withWatermark("ts", late)


UNSEEN, SEEN, CLOSE = 0, 1, 2


def decided(codes: list[int], bins: int, same_bin: bool = False) -> list[int]:
    """States of a day's first bins, as far as the codes of the bins that are over decide them: 1 inside, 0 outside.

    Seen bins are inside; unseen ones behind a seen bin are outside if that was close to the exit. A first run of unseen
    bins is decided by the second bin (`same_bin`: the first) behind it, and no later bin comes out before.
    """
    first = next((i for i, x in enumerate(codes) if x), None)
    probe = None if first is None else first if same_bin else min(first + 1, bins - 1)
    if first is None or (first and probe >= len(codes)):
        return []
    out = [0 if first and codes[probe] == CLOSE else 1] * first
    for code in codes[first:]:
        run = 1 if code else out[-1] if out[-1] == 0 or codes[len(out) - 1] != CLOSE else 0
        out.append(run)
    return out


class _Presence(StatefulProcessor):
    """Ends an individual's bins one by one by timers, each of which sets the next one's, up to the end of the day."""

    def __init__(self, bins: int, least: int, near: float, same_bin: bool, events: bool, width: int) -> None:
        self.bins, self.least, self.near, self.same_bin, self.events, self.width = bins, least, near, same_bin, events, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "daynum int, td int", "distances array<double>")
        self.days = handle.getMapState("days", "daynum int", "begin bigint, codes array<int>, sent int")

    def _end(self, begin: int, td: int) -> int:
        return begin + DAY_MS * (td + 1) // self.bins

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found: dict = {}
        for r in rows:
            found.setdefault((r["daynum"], r["td"], r["begin"]), []).append(r["exit_dist"])
        for (day, td, begin), distances in sorted(found.items()):
            if not self.days.containsKey((day,)):
                self.days.updateValue((day,), (begin, [], 0))
            if td >= len(self.days.getValue((day,))[1]):
                held = list(self.seen.getValue((day, td))[0]) if self.seen.containsKey((day, td)) else []
                self.seen.updateValue((day, td), (held + distances,))
                self.handle.registerTimer(self._end(begin, td))
        return iter(())

    def _code(self, day: int, td: int) -> int:
        if not self.seen.containsKey((day, td)):
            return UNSEEN
        distances = list(self.seen.getValue((day, td))[0])
        self.seen.removeKey((day, td))
        known = [x for x in distances if x is not None]
        if len(distances) < self.least:
            return UNSEEN
        return CLOSE if known and statistics.median(known) < self.near else SEEN

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = timerValues.getCurrentWatermarkInMs(), []  # all up to here is over, whichever timer rings
        for (day,), (begin, codes, sent) in [(tuple(k), tuple(v)) for k, v in self.days.iterator()]:
            codes = list(codes)
            while len(codes) < self.bins and self._end(begin, len(codes)) <= now:
                codes.append(self._code(day, len(codes)))
            states = decided(codes, self.bins, self.same_bin)
            for i in range(max(sent, 1) if self.events else sent, len(states)):
                if self.events:
                    diff = states[i] - states[i - 1]
                    out.append(Row(uid=key[0], daynum=day, minute=i - 1, framenum=(i - 1) * self.width, diff=diff, status={-1: "leave", 0: "no change", 1: "return"}[diff]))
                else:
                    out.append(Row(uid=key[0], daynum=day, td=i, state=states[i]))
            if len(codes) == self.bins:
                self.days.removeKey((day,))
            elif self._end(begin, len(codes)) > now:
                self.days.updateValue((day,), (begin, codes, len(states)))
                if any(codes):
                    self.handle.registerTimer(self._end(begin, len(codes)))
        return iter(out)

    def close(self) -> None:
        pass


def _presence(stream: DataFrame, c: HiveConfig, bins: int, least: int, near: float, same_bin: bool, events: bool, late: str, schema: str) -> DataFrame:
    width = c.frames_per_day // bins
    rows = _placed(stream, c, late).withColumn("td", F.expr(f"framenum div {width}").cast("int")).select("uid", "ts", "daynum", "td", "begin", F.col("exit_dist").cast("double"))
    return rows.groupBy("uid").transformWithState(_Presence(bins, least, near, same_bin, events, width), schema, "Append", "EventTime")


def in_hive(stream: DataFrame, c: HiveConfig, bins: int, near: float, least: int = 1, same_bin: bool = False, late: str = "10 minutes") -> DataFrame:
    """(uid, daynum, td, state) of every bin as soon as it is decided: the rows of `operators.states.in_hive` over the days that are over.

    A bin counts as seen with `least` sightings, as close with their median `exit_dist` below `near`. A bin without
    sightings is decided when its time has passed. Days without a seen bin are unknown and have no rows.
    """
    return _presence(stream, c, bins, least, near, same_bin, False, late, "uid bigint, daynum int, td int, state int")


def hive_events(stream: DataFrame, c: HiveConfig, bins: int, near: float, least: int = 1, same_bin: bool = False, late: str = "10 minutes") -> DataFrame:
    """(uid, daynum, minute, framenum, diff, status) for each bin but the day's last, as `operators.states.hive_events` of those states."""
    return _presence(stream, c, bins, least, near, same_bin, True, late, "uid bigint, daynum int, minute int, framenum int, diff int, status string")


class _Leaves(StatefulProcessor):
    """Sightings wait until none earlier can come, then go by in order: each tells whether the one before it was a leave."""

    def __init__(self, near: float, absence: int, step_ms: int) -> None:
        self.near, self.absence, self.step = near, absence, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, daynum int, framenum int, event_id bigint, exit_dist double")
        self.last = handle.getValueState("last", "daynum int, framenum int, event_id bigint, exit_dist double, back boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["ms"], r["daynum"], r["framenum"], r["event_id"], r["exit_dist"]) for r in rows]
        self.waiting.appendList(new)
        for at in {-(-ms // self.step) * self.step for ms, *_ in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = timerValues.getCurrentWatermarkInMs(), []  # all up to here is over, whichever timer rings
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        last = tuple(self.last.get()) if self.last.exists() else None
        for _, day, frame, event, distance in due:
            left = bool(last) and last[0] == day and frame - last[1] >= self.absence and last[3] is not None and last[3] <= self.near
            if left and not last[4]:
                out.append(Row(uid=key[0], daynum=day, framenum=last[1], event_id=last[2], gap=frame - last[1], status="leave"))
            last = (day, frame, event, distance, left)
        if last:
            self.last.update(last)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if due and not later:  # after the day nothing is left of it
            begin = due[-1][0] - due[-1][0] % DAY_MS
            self.handle.registerTimer(begin + 2 * DAY_MS)
        elif not due and not later and expiredTimerInfo.getExpiryTimeInMs() % DAY_MS == 0:
            self.last.clear()
        return iter(out)

    def close(self) -> None:
        pass


def leave_events(stream: DataFrame, c: HiveConfig, exit_distance: float, absence: int, late: str = "10 minutes", step_ms: int = 60_000) -> DataFrame:
    """(uid, daynum, framenum, event_id, gap, status): `operators.events.leave_events` of the sightings, each once the absence behind it has ended.

    A sighting is looked at when the watermark has passed its time (in steps of `step_ms`), in the order of frames; an
    individual that isn't seen again on the day has not left, as in the batch.
    """
    rows = _placed(stream, c, late).select("uid", "ts", F.unix_millis("ts").alias("ms"), "daynum", "framenum", "event_id", F.col("exit_dist").cast("double"))
    return rows.groupBy("uid").transformWithState(_Leaves(exit_distance, absence, step_ms), "uid bigint, daynum int, framenum int, event_id bigint, gap int, status string", "Append", "EventTime")
