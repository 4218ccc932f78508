"""Presence states on a dense grid of individuals and time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(df: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Every key's bins 0 to bins - 1, each once, with its metrics; null where nothing was seen.

    A seen bin stands for itself and the unseen ones up to the next, the first also for those before it: one pass over
    each key's rows, without a grid to join.
    """
    w = Window.partitionBy(*keys).orderBy("td")
    columns = [c for c in df.columns if c not in (*keys, "td")]
    fill = F.sequence(F.when(F.lag("td").over(w).isNull(), 0).otherwise(F.col("td")), F.coalesce(F.lead("td").over(w), F.lit(bins)) - 1)
    out = df.withColumn("_fill", fill).withColumnRenamed("td", "_at").withColumn("td", F.explode("_fill"))
    return out.select(*keys, "td", *[F.when(F.col("td") == F.col("_at"), F.col(c)).alias(c) for c in columns])


def _segments(df: DataFrame, keys: list[str], bins: int, seen: Column, flag: Column) -> DataFrame:
    """`obs`, `flag`, and per row: `cut` (a run of `obs` begins here), `until`, the end of the first run (null if it is the only one)."""
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("td")
    out = filled(df, keys, bins).select(*keys, "td", F.coalesce(seen, F.lit(False)).alias("obs"), F.coalesce(flag, F.lit(False)).alias("flag"))
    out = out.withColumn("cut", F.coalesce(F.lag("obs").over(w) != F.col("obs"), F.lit(False)))
    return out.withColumn("until", F.min(F.when(F.col("cut"), F.col("td"))).over(whole))


def _at_cut(value: Column, keys: list[str]) -> Column:
    """The value at the first bin of the row's run; of the first run null."""
    upto = Window.partitionBy(*keys).orderBy("td").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(F.col("cut"), value), ignorenulls=True).over(upto)


def in_hive(df: DataFrame, keys: list[str], bins: int, seen: Column, close: Column, same_bin: bool = False) -> DataFrame:
    """(keys, td, state): 1 inside, 0 outside, null unknown.

    Seen bins are inside. An unseen run is outside if the bin before it was close to the exit; a run from the first
    bin on if the second bin (`same_bin`: the first) after it is. An individual seen never is unknown throughout.
    """
    out = _segments(df, keys, bins, seen, close)
    w = Window.partitionBy(*keys).orderBy("td")
    out = out.withColumn("_before", F.lag("flag").over(w)).withColumn("_before", _at_cut(F.col("_before"), keys))
    probe = F.col("until") if same_bin else F.least(F.col("until") + 1, F.lit(bins - 1))
    out = out.withColumn("_after", F.max(F.when(F.col("td") == probe, F.col("flag"))).over(Window.partitionBy(*keys)))
    probed = F.when(F.col("td") < F.col("until"), F.col("_after")).otherwise(F.col("_before"))
    state = F.when(F.col("until").isNull(), F.when(F.col("obs"), 1)).when(F.col("obs"), 1).when(F.coalesce(probed, F.lit(False)), 0).otherwise(1)
    return out.select(*keys, "td", state.cast("int").alias("state"))


def on_substrate(df: DataFrame, keys: list[str], bins: int, seen: Column, top: Column, per_bin: bool = False) -> DataFrame:
    """(keys, td, state): 1 on the substrate, 0 off it. A seen run takes the state of its first bin (`per_bin`: each its own), an unseen one that of the bin before, or after the first run."""
    out = _segments(df, keys, bins, seen, top)
    whole = Window.partitionBy(*keys)
    out = out.withColumn("_before", F.lag("flag").over(whole.orderBy("td")))
    out = out.withColumns({"_here": _at_cut(F.col("flag"), keys), "_before": _at_cut(F.col("_before"), keys)})
    out = out.withColumns({"_first": F.max(F.when(F.col("td") == 0, F.col("flag"))).over(whole), "_after": F.max(F.when(F.col("td") == F.col("until"), F.col("flag"))).over(whole)})
    in_first = F.col("td") < F.col("until")
    seen_state = F.col("flag") if per_bin else F.when(in_first, F.col("_first")).otherwise(F.col("_here"))
    probed = F.when(F.col("obs"), seen_state).when(in_first, F.col("_after")).otherwise(F.col("_before"))
    state = F.when(F.col("until").isNull(), F.when(F.col("obs") & F.col("_first"), 1)).otherwise(F.coalesce(probed, F.lit(False)).cast("int"))
    return out.select(*keys, "td", state.cast("int").alias("state"))


def hive_events(states: DataFrame, keys: list[str], bins_per_day: int, frames_per_day: int) -> DataFrame:
    """(keys, minute, framenum, diff, status) for each bin but the last: leave, return, no change, or not sure beside a null."""
    w = Window.partitionBy(*keys).orderBy("td")
    out = states.withColumns({"_n": F.lead("td").over(w), "diff": F.lead("state").over(w) - F.col("state")}).where("_n is not null")
    status = F.when(F.col("diff") == -1, "leave").when(F.col("diff") == 1, "return").when(F.col("diff") == 0, "no change").otherwise("not sure")
    return out.select(*keys, F.col("td").alias("minute"), (F.col("td") * (frames_per_day // bins_per_day)).alias("framenum"), "diff", status.alias("status"))


def time_outside(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outside, trips): share of all bins outside (unknown ones aren't), and departures."""
    w = Window.partitionBy(*keys).orderBy("td")
    out = states.withColumn("_l", F.lag("state").over(w))
    gone = F.coalesce((F.col("_l") == 1) & (F.col("state") == 0), F.lit(False)).cast("bigint")
    return out.groupBy(*keys).agg(F.avg(F.coalesce(F.col("state") == 0, F.lit(False)).cast("double")).alias("outside"), F.sum(gone).alias("trips"))
