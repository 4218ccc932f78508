"""How evaluations fit their models: few parts, a few models at a time, the same predictions."""

import threading

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from combtrack.operators import models


def examples(spark, parts):
    df = spark.range(2000, numPartitions=parts).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("int").alias("part"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("label", (F.col("a") + F.col("b") > 8).cast("int"))).select("id", "label", "features", "part")


def test_held_rows_come_in_few_parts(spark):
    rows = examples(spark, 200)
    few = models.in_few_parts(rows)
    assert few.rdd.getNumPartitions() == models.FIT_PARTS and sorted(r["id"] for r in few.collect()) == list(range(2000))
    assert models.in_few_parts(examples(spark, 3)).rdd.getNumPartitions() == 3


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", 50)
    assert models.in_few_parts(examples(spark, 200)).rdd.getNumPartitions() == 40


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """Two fits are under way at once, and each row is predicted by a model of the other folds."""
    rows = examples(spark, 4).persist()
    together, own = threading.Barrier(2, timeout=60), models.estimator("logistic")

    class Watched:
        def copy(self):
            return self

        def fit(self, df):
            together.wait()
            return own.copy().fit(df)

    got = models.cross_validated(Watched(), rows, 4).groupBy("label", "prediction").count().collect()
    fold, want = F.pmod("part", F.lit(4)), {}
    for i in range(4):
        for r in own.fit(rows.where(fold != i)).transform(rows.where(fold == i)).groupBy("label", "prediction").count().collect():
            want[r["label"], r["prediction"]] = want.get((r["label"], r["prediction"]), 0) + r["count"]
    assert {(r["label"], r["prediction"]): r["count"] for r in got} == want and sum(want.values()) == 2000
    rows.unpersist()
