"""Samples that a seed fixes: ranks by a hash of the row's key, not by the order in which tasks run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def _below(digest: Column, n: Column) -> Column:
    """A whole number from 0 to n - 1, by the digest; null where n is 0."""
    return F.when(n > 0, F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n))


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each label, or all of a rarer one. Each task keeps its own first n before the shuffle."""
    w = Window.partitionBy(label).orderBy(_hash(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, keys: list[str], by: list[str], seed: int) -> DataFrame:
    """`_at` from 0 and `_of`, the number of rows, within each group of keys, in the order of a hash of `by`.

    Numbers are given in 256 parts by the first digits of the hash, then moved by the parts before, so that a group of
    any size is dealt to many tasks.
    """
    part = [*keys, "_part"]
    rows = df.withColumn("_hash", _hash(seed, *keys, *by)).withColumn("_part", F.substring("_hash", 1, 2))
    sizes = rows.groupBy(*part).agg(F.count("*").alias("_size"))
    group = Window.partitionBy(*keys)
    before = F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"_before": F.coalesce(before, F.lit(0)), "_of": F.sum("_size").over(group)}).drop("_size")
    number = F.row_number().over(Window.partitionBy(*part).orderBy("_hash", *by)) - 1
    return rows.withColumn("_own", number).join(sizes, part).withColumn("_at", F.col("_own") + F.col("_before")).drop("_own", "_before", "_hash", "_part")


def against_all(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Every row of label 1 and, by a hash of the key, as many of label 0, or all of those where there are fewer."""
    rows = numbered(df.where(F.col(label).isin(0, 1)), [label], [key], seed)
    ones = F.broadcast(df.agg(F.count(F.when(F.col(label) == 1, 1)).alias("_ones")))  # one number
    return rows.crossJoin(ones).where((F.col(label) == 1) | (F.col("_at") < F.col("_ones"))).drop("_at", "_of", "_ones")


def bootstrap(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """`draw` from 0 to n - 1 with a row of df each, drawn with replacement; no rows if df is empty."""
    rows = numbered(df, [], [key], seed)
    total = F.broadcast(df.agg(F.count("*").alias("_total")))  # one number
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(total)
    draws = draws.select("draw", _below(_hash(seed, "draw"), F.col("_total")).alias("_at"))
    return draws.join(rows, "_at").drop("_at", "_of")


def matched_controls(events: DataFrame, candidates: DataFrame, keys: list[str], who: str, seed: int) -> DataFrame:
    """Each event with `control`: one of the candidates of the same keys, other than the event's own, drawn by hash; null if there is none.

    A drawn candidate that is the event's own is replaced by the next one.
    """
    pool = numbered(candidates.select(*keys, F.col(who).alias("control")).distinct(), keys, ["control"], seed)
    sizes = pool.groupBy(*keys).agg(F.max("_of").alias("_n"))
    drawn = events.join(sizes, keys, "left").withColumn("_at", _below(_hash(seed, *keys, who), F.col("_n")))
    following = pool.select(*keys, F.pmod(F.col("_at") - 1, F.col("_of")).alias("_at"), F.col("control").alias("_next"))
    drawn = drawn.join(pool.drop("_of"), [*keys, "_at"], "left").join(following, [*keys, "_at"], "left")
    own = lambda c: F.when(F.col(c) != F.col(who), F.col(c))
    return drawn.withColumn("control", F.coalesce(own("control"), own("_next"))).drop("_at", "_n", "_next")
