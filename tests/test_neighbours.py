"""Exact neighbours over cells, against brute force, and what bad vectors do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from combtrack.operators import models


def brute(queries, points, k, apart=None):
    out = set()
    for q, v, s in queries:
        found = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), p, y) for p, w, y, t in points if apart is None or s != t)
        out |= {(q, p, y, n + 1) for n, (_, p, y) in enumerate(found[:k])}
    return out


@pytest.fixture(scope="module")
def clusters():
    """Twelve clusters of whole numbers, so that distances are exact, with copies and ties."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (12, 6))
    vectors = [(centres[i % 12] + rng.integers(-6, 7, 6)).astype(float).tolist() for i in range(600)]
    return vectors + vectors[:30]


@pytest.mark.parametrize(("cell", "part", "apart"), [(40, 4096, None), (40, 16, None), (1000, 4096, None), (25, 20, "side")])
def test_neighbours_are_exact(spark, clusters, monkeypatch, cell, part, apart):
    monkeypatch.setattr(models, "CELL_POINTS", cell)
    monkeypatch.setattr(models, "PART_POINTS", part)
    rows = [(i, v, i % 3, i % 5) for i, v in enumerate(clusters)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label bigint, side bigint").repartition(3)
    queries = df.where("id % 7 = 0")
    got = models.nearest_points(queries, df, 5, "v", "label", "id", apart)
    want = brute([(i, v, s) for i, v, _, s in rows if i % 7 == 0], rows, 5, apart)
    assert {(r["id"], r["near"], r["vote"], r["nth"]) for r in got.collect()} == want
    if cell == 40:
        assert models.visited_share(queries, df, 5, "v", "label", "id") < 0.5


def test_bad_vectors_take_no_part(spark):
    good = [(i, [float(i), 0.0], i % 2) for i in range(10)]
    bad = [(20, [float("nan"), 0.0], 1), (21, [float("inf"), 1.0], 1), (22, None, 1), (23, [None, 1.0], 1), (None, [3.0, 0.0], 1), (24, [4.0, 0.0], None)]
    schema = "id bigint, v array<double>, label bigint"
    both, fine = spark.createDataFrame(good + bad, schema), spark.createDataFrame(good, schema)
    found = lambda q, p: sorted(map(tuple, models.nearest_points(q, p, 3, "v", "label", "id").where("id < 20").collect()))
    assert found(both, both) == found(fine, fine) and len(found(fine, fine)) == 30
    assert models.nearest_points(both.where("id > 19"), both, 3, "v", "label", "id").select("id").distinct().collect() == [(24,)]
    assert models.nearest_points(fine, fine.where("false"), 3, "v", "label", "id").collect() == []
    mixed = fine.union(spark.createDataFrame([(30, [1.0], 0)], schema))
    for q, p in ((mixed, fine), (fine, mixed)):
        with pytest.raises(ValueError, match="components"):
            models.nearest_points(q, p, 3, "v", "label", "id")


def test_judged_neighbours(spark, clusters):
    """Clusters tell their own labels."""
    df = spark.createDataFrame([(i, v, (i % 12) % 2) for i, v in enumerate(clusters[:600])], "event_id bigint, features array<double>, label bigint")
    got = models.judged_neighbours(df.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(100)).cast("int")), 3).collect()
    assert {r["on"] for r in got} == {"test", "cv_train", "cv_test"} and all(r["accuracy"] > 0.95 for r in got)


def test_queries_travel_by_lots_of_cells(spark, monkeypatch):
    """However many cells a query visits, it is one row before the lots and one for each lot after; large cells are divided."""
    monkeypatch.setattr(models, "CELL_POINTS", 4)
    monkeypatch.setattr(models, "PART_POINTS", 200)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist(), 0) for i in range(800)], "id bigint, v array<double>, label bigint")
    cells = models.Cells(df, "v", "id")
    first, parts = cells.lots()
    assert len(first) > 100 and (first + parts).max() <= 8 and (parts == 1).all()
    got = cells.visits(df.withColumn("_bound", F.lit(None).cast("double")), False, np.equal.outer(first, np.arange(first.max() + 1))).select("_cells").collect()
    assert len(got) == 800 and max(len(r[0]) for r in got) <= 8
    cells.size = np.array([150, 900, 40, 100])
    assert [x.tolist() for x in cells.lots()] == [[0, 1, 6, 6], [1, 5, 1, 1]]
