"""Individuals behind tags that are worn again: cohorts, validity, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HiveConfig


def cohort_dimension(cohorts: DataFrame, c: HiveConfig, days: int) -> DataFrame:
    """(uid, cohort, nth, tag, birth, last_use) of (cohort, tag, birth): individuals numbered by birth of their cohort and tag.

    `nth` numbers the cohorts by birth, then name; `last_use` is the day on which a later cohort wears the tag, plus
    one, or days + 1 where none does. Only the few cohorts are ordered in one place; a cohort's tags are in one task.
    """
    sizes = cohorts.groupBy("cohort").agg(F.min("birth").alias("birth"), F.count("*").alias("_size"))
    by_birth = Window.partitionBy().orderBy("birth", "cohort")
    sizes = sizes.withColumns({"nth": F.row_number().over(by_birth) - 1, "_before": F.coalesce(F.sum("_size").over(by_birth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    out = cohorts.select("cohort", "tag").join(F.broadcast(sizes), "cohort")
    uid = F.col("_before") + F.row_number().over(Window.partitionBy("cohort").orderBy("tag")) - 1
    out = out.withColumns({"uid": uid, "_next": F.lead("birth").over(Window.partitionBy("tag").orderBy("nth"))})
    last = F.coalesce(F.date_diff("_next", F.lit(c.first_day).cast("date")) + 1, F.lit(days + 1))
    return out.select("uid", "cohort", "nth", "tag", "birth", last.alias("last_use"))


def age_on(day: Column, c: HiveConfig) -> Column:
    """Days since birth on a day, -1 before birth and, but for the first cohort, once the tag is worn again."""
    age = day - F.date_diff(F.col("birth"), F.lit(c.first_day).cast("date"))
    return F.when((age >= 0) & ((F.col("nth") == 0) | (day < F.col("last_use"))), age).otherwise(-1).cast("int")


def ages(identity: DataFrame, days: list[int], c: HiveConfig) -> DataFrame:
    """(daynum, uid, age) of everybody on the days."""
    return identity.withColumn("daynum", F.explode(F.array(*map(F.lit, days)))).select("daynum", "uid", age_on(F.col("daynum"), c).alias("age"))


def resolved(rows: DataFrame, identity: DataFrame, c: HiveConfig) -> DataFrame:
    """Rows by (tag, daynum) with `who` and `age`: the first individual that wears the tag on the day, -1 if none does."""
    days = rows.select("tag", "daynum").distinct().join(identity, "tag").withColumn("age", age_on(F.col("daynum"), c)).where("age >= 0")
    first = days.groupBy("tag", "daynum").agg(F.min(F.struct("uid", "age")).alias("_first"))
    out = rows.join(first, ["tag", "daynum"], "left")
    return out.withColumns({"who": F.coalesce("_first.uid", F.lit(-1)), "age": F.coalesce("_first.age", F.lit(-1))}).drop("_first")


def alive(rows: DataFrame, most_days: int) -> DataFrame:
    """Rows of individuals that are born and, at `age` days, may still live."""
    return rows.where(F.col("age").between(0, most_days))


def id_of(text: Column) -> Column:
    """Whole number of an id that was written as text, with or without a fraction; null if it is none."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def mapped(value: Column, names: dict) -> Column:
    """The value's name; null for a value without one."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]
