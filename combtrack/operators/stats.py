"""Binning, correlations and summaries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed interval (lo, hi] of the edges; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((value > edges[i - 1]) & (value <= edges[i]), i - 1).otherwise(out)
    return out


#: At most so many values part the distinct ones into ranges, each of which is a task's; looked up in two steps of STEP.
RANGES, STEP = 256, 16


def _in_ranges(counts: DataFrame, keys: list[str]) -> DataFrame:
    """`_range`: counts of values (keys, value, n) dealt into ranges of each key's values, between values that a hash picks.

    The picks are the same whenever they are computed. A row of at most RANGES values a key is joined to the counts, and
    a value looks for its place among every STEP-th of them, then among those between.
    """
    mixed = F.xxhash64("value")
    picked = counts.groupBy(*keys, F.pmod(mixed, F.lit(RANGES)).alias("_p")).agg(F.min_by("value", mixed).alias("value"))
    picks = picked.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("_picks"))
    every = F.transform(F.sequence(F.lit(1), F.lit(RANGES // STEP)), lambda i: F.get("_picks", i * STEP - 1))
    picks = picks.withColumn("_coarse", F.filter(every, lambda x: x.isNotNull()))
    dealt = counts.join(F.broadcast(picks), keys) if keys else counts.crossJoin(F.broadcast(picks))
    upto = lambda values: F.size(F.filter(values, lambda x: x <= F.col("value")))
    dealt = dealt.withColumn("_c", upto(F.col("_coarse")) * STEP)
    return dealt.withColumn("_range", F.col("_c") + upto(F.slice("_picks", F.col("_c") + 1, F.lit(STEP)))).drop("_picks", "_coarse", "_c")


def _ranges(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _range, _start, _size, total): rows below each range, in it, and in all; at most RANGES + 1 rows a key."""
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("_size"))
    whole = Window.partitionBy(*keys)
    start = F.coalesce(F.sum("_size").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumns({"_start": start, "total": F.sum("_size").over(whole)})


def numbered_values(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, value, n, before, total): each key's distinct values, how often each occurs, the key's rows below it and in all; nulls are left out.

    Values are counted and the counts dealt into ranges. Sums within ranges and the few ranges' totals give the rows
    below: no task sees a whole key. There should be few keys, as some rows of each are broadcast; a null key is left out.
    """
    keys = list(keys)
    known = df.dropna(subset=[column, *keys])
    dealt = _in_ranges(known.groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("n")), keys)
    return _below(dealt, _ranges(dealt, keys), keys).select(*keys, "value", "n", "before", "total")


def _below(dealt: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """`before` of the values whose range is among `ranges`."""
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(ranges), [*keys, "_range"])
    return out.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_start"))


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, `_q`: the exact quantiles, interpolated linearly between the values next to them; null without values.

    Selection by ranges: the few rows of ranges tell which of them hold wanted ranks, and only values of those ranges
    are put in order.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = _in_ranges(counts, [])
    wanted = F.array(*[F.lit(float(p)) for p in shares])
    at = lambda p: (F.col("total") - 1) * p
    within = lambda x, start, n: (x >= start) & (x < start + n)
    near = F.flatten(F.transform(wanted, lambda p: F.array(F.floor(at(p)), F.ceil(at(p)))))
    ranges = _ranges(dealt, []).withColumn("_near", F.filter(near, lambda x: within(x, F.col("_start"), F.col("_size")))).where(F.size("_near") > 0)
    held = _below(dealt, ranges, []).where(F.exists("_near", lambda x: within(x, F.col("before"), F.col("n"))))
    row = held.agg(F.collect_list(F.struct("before", "n", F.col("value").cast("double").alias("value"))).alias("_held"), F.max("total").alias("total"))

    return row.select(F.when(F.col("total").isNotNull(), F.transform(wanted, lambda p: _held_at(at(p)))).alias("_q"))


def _held_at(at: Column) -> Column:
    """The value at a place between those of `_held`, by linear interpolation."""
    value_at = lambda x: F.get(F.filter("_held", lambda h: (x >= h["before"]) & (x < h["before"] + h["n"])), F.lit(0))["value"]
    share = at - F.floor(at)
    low, high = value_at(F.floor(at)), value_at(F.ceil(at))
    return F.when(share == 0, low).otherwise((1 - share) * low + share * high)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the product's own rounding error (by halves of the digits) and the sum's are added to the sum.

    Only where the product lies between two doubles and one number is 2^53 times the other can the last bit differ.
    """
    halves = lambda v: (v * 134217729.0 - (v * 134217729.0 - v), v - (v * 134217729.0 - (v * 134217729.0 - v)))
    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    s = p + c
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl + ((p - (s - (s - p))) + (c - (s - p)))
    return F.when(F.isnan(lost), s).otherwise(s + lost)  # beyond 1e300 the halves overflow


def quantile_of(values: Column, share: float) -> Column:
    """The quantile of an ascending array, interpolated linearly; null without values.

    Of the two weighted values the lower one's product isn't rounded before they are added, as DuckDB has it: Spark's
    `percentile` rounds it and can differ in the last bit.
    """
    at = (F.size(values) - 1) * F.lit(share)
    low, high, d = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int")), at - F.floor(at)
    return _fused(low, 1 - d, high * d)


def quantiles_by(df: DataFrame, key: str, column: str, shares: list[float]) -> DataFrame:
    """(key, _q): `quantiles` within each of a few keys, by the same ranges, so that no task holds a key's values; a null key is left out."""
    known = df.dropna(subset=[key, column])
    dealt = _in_ranges(known.groupBy(key, F.col(column).alias("value")).agg(F.count("*").alias("n")), [key])
    wanted = F.array(*[F.lit(float(p)) for p in shares])
    at = lambda p: (F.col("total") - 1) * p
    within = lambda x, start, n: (x >= start) & (x < start + n)
    near = F.flatten(F.transform(wanted, lambda p: F.array(F.floor(at(p)), F.ceil(at(p)))))
    ranges = _ranges(dealt, [key]).withColumn("_near", F.filter(near, lambda x: within(x, F.col("_start"), F.col("_size")))).where(F.size("_near") > 0)
    held = _below(dealt, ranges, [key]).where(F.exists("_near", lambda x: within(x, F.col("before"), F.col("n"))))
    row = held.groupBy(key).agg(F.collect_list(F.struct("before", "n", F.col("value").cast("double").alias("value"))).alias("_held"), F.max("total").alias("total"))
    return row.select(key, F.transform(wanted, lambda p: _held_at(at(p))).alias("_q"))


def qcut(df: DataFrame, column: str, n: int) -> DataFrame:
    """`bin`: right-closed quantile bins, the lowest value in the first; equal edges are an error. One row of edges is broadcast."""
    edges = quantiles(df, column, [i / n for i in range(n + 1)]).withColumnRenamed("_q", "_edges")
    edges = edges.select(F.when(F.col("_edges").isNull() | (F.size(F.array_distinct("_edges")) == F.size("_edges")), F.col("_edges")).otherwise(F.raise_error(F.lit("bin edges must be unique"))).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(column))) - 1
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.col(column).isNotNull(), F.greatest(below, F.lit(0)))).drop("_edges")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs i < j in one pass; rows with a null in either are left out for that pair."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.r")


def ranked(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): average ranks of the distinct values; counts per value are ranked, not rows."""
    return numbered_values(df, column).select("value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def positions(df: DataFrame, column: str) -> DataFrame:
    """(value, first, last): the places, from 1, that the rows of each value take in the order of all."""
    return numbered_values(df, column).select("value", (F.col("before") + 1).alias("first"), (F.col("before") + F.col("n")).alias("last"))


def equal_width_edges(low: float, high: float, n: int) -> list[float]:
    """Edges of n equal-width bins for `cut`; the first is lowered by a thousandth of the range, so that it takes the lowest value."""
    step = (high - low) / n
    return [low - 0.001 * (high - low), *[low + step * i for i in range(1, n)], high]


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, r): Pearson correlation of average ranks over the rows that have both."""
    return spearman_matrix(df, [a, b])


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs i < j; ranks are those among the rows that have both; null without rows or spread.

    Distinct rows are counted once. All columns' values are ranked together: under a key for the column, and one for each
    other column whose nulls leave rows of it out. A row's ranks then meet again, and one aggregate takes the sums of
    every pair.
    """
    pairs, n = list(combinations(range(len(columns)), 2)), len(columns)
    rows = df.groupBy(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("_n"))
    rows = rows.select(F.array(*[f"_v{i}" for i in range(n)]).alias("_row"), "_n")
    # key i * (n + 1) is column i among all its rows, i * (n + 1) + 1 + j among those that have j
    keyed = [(i, j) for i in range(n) for j in range(-1, n) if j != i]
    cells = F.array(*[F.struct(F.lit(i * (n + 1) + 1 + j).alias("_key"), F.when(F.lit(True) if j < 0 else F.get("_row", j).isNotNull(), F.get("_row", i)).alias("value")) for i, j in keyed])
    gaps = rows.agg(*[F.max(F.get("_row", i).isNull().cast("int")).alias(str(i)) for i in range(n)]).first()
    gap = [bool(x) for x in gaps]
    cells = F.filter(cells, lambda x: x["value"].isNotNull() & x["_key"].isin([i * (n + 1) + 1 + j for i, j in keyed if j < 0 or gap[j]]))
    long = rows.select("_row", "_n", F.inline(cells))
    counts = long.groupBy("_key", "value").agg(F.sum("_n").alias("n"))
    dealt = _in_ranges(counts, ["_key"])
    ranks = _below(dealt, _ranges(dealt, ["_key"]), ["_key"]).select("_key", "value", (F.col("before") + (F.col("n") + 1) / 2).alias("_rank"))
    ranked_rows = long.join(ranks, ["_key", "value"]).groupBy("_row", "_n").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_rank"))).alias("_ranks"))
    rank = lambda i, j: F.try_element_at("_ranks", F.lit(i * (n + 1) + (1 + j if gap[j] else 0)))
    sums = []
    for k, (i, j) in enumerate(pairs):
        both = F.get("_row", i).isNotNull() & F.get("_row", j).isNotNull()
        x, y, m = F.when(both, rank(i, j)), F.when(both, rank(j, i)), F.col("_n")
        sums += [F.sum(e).alias(f"{what}{k}") for what, e in (("n", F.when(both, m)), ("x", m * x), ("y", m * y), ("xx", m * x * x), ("yy", m * y * y), ("xy", m * x * y))]
    row = ranked_rows.agg(*sums)
    of = lambda what, k: F.col(f"{what}{k}")
    spread = lambda what, k: of("n", k) * of(what * 2, k) - of(what, k) ** 2
    r = lambda k: F.try_divide(of("n", k) * of("xy", k) - of("x", k) * of("y", k), F.sqrt(spread("x", k) * spread("y", k)))
    out = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), r(k).alias("r")) for k, (i, j) in enumerate(pairs)])
    return row.select(F.inline(out))


def histogram(df: DataFrame, column: str, lo: float, hi: float, n: int) -> DataFrame:
    """(bin, n, density) of equal-width bins of [lo, hi]; the last includes hi, values outside are left out."""
    return histogram_of(df, column, [lo + (hi - lo) * i / n for i in range(n)] + [hi])


def histogram_of(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, n, density) of the bins between the edges, each with its lower edge, the last with its upper one too."""
    x, last = F.col(column), len(edges) - 2
    at = F.least(F.size(F.filter(F.array(*map(F.lit, map(float, edges))), lambda e: e <= x)) - 1, F.lit(last))
    bins = df.where(x.between(edges[0], edges[-1])).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    width = F.get(F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:], strict=False)]), F.col("bin"))
    return bins.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy()) * width))  # of the few bins


def box(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, q1, median, q3, low, high): quartiles and the furthest values within 1.5 interquartile ranges of them."""
    q = quantiles_by(df, key, column, [0.25, 0.5, 0.75])
    q = q.select(key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.select(key, column).join(F.broadcast(q), key).where(F.col(column).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(key, "q1", "median", "q3").agg(F.min(column).alias("low"), F.max(column).alias("high"))


def mean_sem(df: DataFrame, keys: list[str], column: str, entity: str) -> DataFrame:
    """(keys, mean, sem, sem_entities): standard errors by rows and by distinct entities."""
    out = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("_s"), F.count(column).alias("_n"), F.countDistinct(entity).alias("_e"))
    return out.select(*keys, "mean", F.try_divide("_s", F.sqrt("_n")).alias("sem"), F.try_divide("_s", F.sqrt("_e")).alias("sem_entities"))
