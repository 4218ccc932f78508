"""Classifiers of events and how they are judged. `features` is a vector column, `label` 0 or 1."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

NAMES = ("naive_bayes", "logistic", "forest", "svm")


def assembled(df: DataFrame, columns: list[str], key: str, seed: int) -> DataFrame:
    """(key, label, features, part): `part` from 0 to 99 by a hash of the key, for splits; rows with a null feature go."""
    rows = df.dropna(subset=[*columns, "label"]).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100)).cast("int"))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select(key, "label", "features", "part")


def estimator(name: str, seed: int = 25) -> Estimator:
    """One of NAMES; needs a running session."""
    makers = {
        "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
        "logistic": lambda: LogisticRegression(maxIter=100),
        "forest": lambda: RandomForestClassifier(seed=seed),
        "svm": lambda: LinearSVC(maxIter=10, regParam=0.01, tol=1e-2),
    }
    return makers[name]()


def performance(predicted: DataFrame, *keys: str) -> DataFrame:
    """(keys, tn, fp, fn, tp, precision, recall, f1, accuracy, mislabelled) of (label, prediction); a ratio over nothing is null."""
    cell = lambda y, p: F.sum(((F.col("label") == y) & (F.col("prediction") == p)).cast("bigint"))
    out = predicted.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratios = {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "mislabelled": fp + fn}
    return out.withColumns(ratios)


#: Models that are fitted at a time: a fit is a row of small jobs, which leave most cores idle. Least parts and rows to a part of what they learn from.
FITS, FIT_PARTS, FIT_ROWS = 4, 16, 131_072


def in_few_parts(rows: DataFrame) -> DataFrame:
    """Held rows in parts by their number, for jobs that pass over them many times; counting them fills the cache."""
    return rows.coalesce(max(FIT_PARTS, -(-rows.count() // FIT_ROWS)))


def cross_validated(model: Estimator, rows: DataFrame, folds: int) -> DataFrame:
    """(label, prediction) of every row by a model of the other folds, a few fitted side by side; folds by `part`."""
    fold = F.pmod("part", F.lit(folds))

    def predicted(i: int) -> DataFrame:
        return model.copy().fit(rows.where(fold != i)).transform(rows.where(fold == i)).select("label", "prediction")

    with ThreadPool(min(FITS, folds)) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(predicted), range(folds)))


def judged(model: Estimator, rows: DataFrame, test_share: int = 33, folds: int = 5) -> DataFrame:
    """One row: performance on the held-out share, and accuracy of cross-validation within both parts."""
    train, test = rows.where(F.col("part") >= test_share), rows.where(F.col("part") < test_share)
    held_out = model.fit(train).transform(test).select("label", "prediction", F.lit("test").alias("on"))
    inner = cross_validated(model, train, folds).withColumn("on", F.lit("cv_train"))
    outer = cross_validated(model, test, folds).withColumn("on", F.lit("cv_test"))
    return performance(held_out.unionByName(inner).unionByName(outer), "on")


#: Points to a cell, most cells, points that a task holds at once, and most blocks of queries that meet the same points.
CELL_POINTS, MOST_CELLS, PART_POINTS, QUERY_BLOCKS = 1024, 256, 32768, 8
#: Queries that Python compares, or places, at a time.
AT_ONCE = 256


def _usable(df: DataFrame, vector: str, key: str, *others: str) -> DataFrame:
    """Rows with a key and a vector of finite numbers alone (as doubles), and with what else is asked for."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(key, F.col(vector).cast("array<double>").alias(vector), *others).dropna(subset=[key, *others]).where(F.col(vector).isNotNull() & fine)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclid's distances up to rounding, by a matrix product."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _with(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in columns.items())])


class Cells:
    """Voronoi cells of points round pivots that a hash of the key picks: the pivots, each cell's radius and points.

    Building them runs two jobs; at most MOST_CELLS pivots and their figures come to the driver.
    """

    def __init__(self, points: DataFrame, vector: str, key: str) -> None:
        self.vector, self.key = vector, key
        n, low, high = points.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
        if low != high:
            raise ValueError(f"vectors of {low} to {high} components can't be compared")
        self.dim, count = high or 0, min(MOST_CELLS, -(-n // CELL_POINTS))
        bucket = F.pmod(F.xxhash64(F.lit(1), key), F.lit(max(1, count)))
        picked = points.groupBy(bucket.alias("b")).agg(F.min_by(vector, F.struct(F.xxhash64(F.lit(2), key), key)).alias("v"))
        chosen = [r["v"] for r in picked.orderBy("b").collect()] if count else []
        self.pivots = np.array(chosen, float).reshape(len(chosen), self.dim)
        self.radius, self.size = np.zeros(len(self.pivots)), np.zeros(len(self.pivots), int)
        if count:
            for cell, size, radius in self.placed(points).groupBy("_cell").agg(F.count("*"), F.max("_off")).collect():
                self.size[cell], self.radius[cell] = size, radius

    def placed(self, df: DataFrame) -> DataFrame:
        """The rows with `_cell`, that of the nearest pivot, and `_off`, the distance to it."""
        pivots, vector = self.pivots, self.vector

        def work(batches):
            for rows in batches:
                if len(rows):
                    d = _distances(np.stack(rows[vector].to_list()).astype(float), pivots)
                    yield rows.assign(_cell=d.argmin(axis=1).astype(np.int32), _off=d.min(axis=1))

        return df.mapInPandas(work, _with(df, _cell=T.IntegerType(), _off=T.DoubleType()))

    def reached(self, vectors: np.ndarray, bound: np.ndarray | None) -> np.ndarray:
        """(queries, cells): whether to search a cell. Without a bound the query's own, else the others that may hold a point within it.

        A cell is left out if the triangle inequality or the plane between it and the own cell keeps it beyond the bound.
        """
        d = _distances(vectors, self.pivots)
        home, each = np.where(self.size > 0, d, np.inf).argmin(axis=1), np.arange(len(d))
        if bound is None:
            go = np.zeros(d.shape, bool)
            go[each, home] = True
            return go
        slack = 1e-6 * (1 + d.max(axis=1, keepdims=True))
        apart = _distances(self.pivots, self.pivots)[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d**2 - d[each, home][:, None] ** 2) / (2 * apart), 0.0)
        go = (np.maximum(d - self.radius, plane) <= bound[:, None] + slack) & (self.size > 0)
        go[each, home] = False
        return go

    def visits(self, queries: DataFrame, own: bool, lots: np.ndarray | None = None) -> DataFrame:
        """The queries with `_cells` to search: their own, or the others within `_bound` (null: any); with `lots` (cells by lots), the lots that hold them."""
        cells, vector = self, self.vector

        def work(batches):
            for batch in batches:
                for i in range(0, len(batch), AT_ONCE):
                    rows = batch.iloc[i : i + AT_ONCE]
                    go = cells.reached(np.stack(rows[vector].to_list()).astype(float), None if own else rows["_bound"].fillna(np.inf).to_numpy(float))
                    go = go if lots is None else go @ lots
                    yield rows.assign(_cells=[np.flatnonzero(x).astype(np.int32) for x in go])

        return queries.mapInPandas(work, _with(queries, _cells=T.ArrayType(T.IntegerType())))

    def lots(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, parts): cells dealt into lots of about PART_POINTS points: each cell's lot, or the first of its own if it has more points."""
        first, parts, lot, held = np.zeros(len(self.size), int), np.ones(len(self.size), int), 0, 0
        for cell, size in enumerate(self.size.tolist()):
            if held and held + size > PART_POINTS:
                lot, held = lot + 1, 0
            first[cell], parts[cell] = lot, max(1, -(-size // PART_POINTS))
            lot, held = lot + parts[cell] - 1, held + size
        return first, parts


def _searched(asked: DataFrame, points: DataFrame, cells: Cells, k: int, own: bool, blocks: int, vector: str, label: str, key: str, apart: str | None) -> DataFrame:
    """(key, d, near, vote): of each lot of cells the k nearest points of each query that visits one of them.

    Points are dealt out by lots, of which a task holds one, and lots of one large cell by a hash; a query goes to a lot
    once, whatever number of its cells it visits, so copies grow by lots and not by cells. Queries of a lot are dealt into
    `blocks`, each beside the lot's points, so that few lots still make many tasks. A task takes a lot's points, then its
    queries batch by batch as they come, and compares a query with the points of the cells it visits.
    """
    first, parts = cells.lots()
    held_in = np.zeros((len(first), int((first + parts).max(initial=0))), bool)
    for cell, (at, n) in enumerate(zip(first, parts, strict=True)):
        held_in[cell, at : at + n] = True
    of = lambda numbers: F.get(F.array(*map(F.lit, numbers.tolist())), F.col("_cell"))
    side = F.lit(None).cast("bigint") if apart is None else F.col(apart).cast("bigint")
    lot = (of(first) + F.pmod(F.xxhash64(key), of(parts))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    none = F.lit(None).cast("double")
    left = cells.placed(points).select(lot.alias("_lot"), every.alias("_block"), F.lit(0).alias("_asks"), "_cell", F.col(key).cast("bigint").alias("id"), vector, F.col(label).cast("bigint").alias("vote"), side.alias("side"), none.alias("bound"))
    right = cells.visits(asked, own, held_in).select(F.explode("_cells").alias("_lot"), F.pmod(F.xxhash64(F.lit(3), key), F.lit(blocks)).cast("int").alias("_block"), F.lit(1).alias("_asks"), F.lit(None).cast("int").alias("_cell"), F.col(key).cast("bigint").alias("id"), vector, F.lit(None).cast("bigint").alias("vote"), side.alias("side"), (none if own else F.col("_bound")).alias("bound"))
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).repartition(tasks, "_lot", "_block").sortWithinPartitions("_lot", "_block", "_asks", "_cell", "id")

    def nearest(q: pd.DataFrame, p: dict[str, np.ndarray]):
        go = cells.reached(np.stack(q[vector].to_list()).astype(float), None if own else q["bound"].fillna(np.inf).to_numpy(float))
        asks, sides = np.stack(q[vector].to_list()).astype(float), q["side"].to_numpy()
        rows, found, far = [], [], []
        for cell, start, end in zip(p["cells"].tolist(), p["starts"].tolist(), p["ends"].tolist(), strict=True):
            here = np.flatnonzero(go[:, cell])
            if not len(here):
                continue
            part, at, size = asks[here], p["at"][start:end], p["size"][start:end]
            about = (part**2).sum(axis=1)[:, None] + size - 2 * part @ at.T
            if apart is not None:
                about[sides[here][:, None] == p["side"][None, start:end]] = np.inf
            most = min(k, len(at)) - 1
            rim = np.partition(about, most, axis=1)[:, most] + 1e-9 * (1 + size.max() + (part**2).sum(axis=1))
            a, b = np.nonzero((about <= rim[:, None]) & np.isfinite(about))
            rows.append(here[a])
            found.append(b + start)
            far.append(np.sqrt(((part[a] - at[b]) ** 2).sum(axis=1)))
        if not rows:
            return
        a, b, d = map(np.concatenate, (rows, found, far))
        order = np.lexsort((p["id"][b], d, a))
        a, b, d = a[order], b[order], d[order]
        best = np.arange(len(a)) - np.searchsorted(a, a) < k
        yield pd.DataFrame({key: q["id"].to_numpy()[a[best]], "d": d[best], "near": p["id"][b[best]], "vote": p["vote"][b[best]].astype(np.int64)})

    def gathered(held: list[pd.DataFrame]) -> dict[str, np.ndarray]:
        p = pd.concat(held)
        at, cell = np.stack(p[vector].to_list()).astype(float), p["_cell"].to_numpy(int)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        return {"at": at, "size": (at**2).sum(axis=1), "cells": cell[starts], "starts": starts, "ends": np.append(starts[1:], len(cell)), **{c: p[c].to_numpy() for c in ("id", "vote", "side")}}

    def work(batches):
        now, held, points = None, [], None
        for batch in batches:
            for (lot, block, asks), rows in batch.groupby(["_lot", "_block", "_asks"], sort=False):
                if (lot, block) != now:
                    now, held, points = (lot, block), [], None
                if not asks:
                    held.append(rows)
                elif held or points:
                    points, held = points or gathered(held), []
                    for i in range(0, len(rows), AT_ONCE):
                        yield from nearest(rows.iloc[i : i + AT_ONCE], points)

    return both.mapInPandas(work, f"{key} long, d double, near long, vote long")


def nearest_points(queries: DataFrame, points: DataFrame, k: int, vector: str, label: str, key: str, apart: str | None = None) -> DataFrame:
    """(key, d, near, vote, nth): the k nearest points of each query (Euclid), with their labels; ties to the smaller key.

    Exact search over Voronoi cells in two rounds: a query's own cell gives a bound that its kth neighbour keeps, and of
    the other cells only those are visited that may hold a point within it. With `apart` neighbours have another value
    of that column than the query. Rows without a key, a label (points) or with a vector that is null or has a null or
    non-finite component take no part; vectors of several lengths are an error. Queries of `queries` are a stated set.
    """
    extra = [] if apart is None else [apart]
    points, queries = _usable(points, vector, key, label, *extra), _usable(queries, vector, key, *extra)
    cells = Cells(points, vector, key)
    n, low, high = queries.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if cells.dim and low is not None and not low == high == cells.dim:
        raise ValueError(f"vectors of {low} to {high} components can't be compared with those of {cells.dim}")
    if not len(cells.pivots):
        return queries.select(F.col(key).cast("bigint").alias(key), F.lit(0.0).alias("d"), F.lit(0).cast("bigint").alias("near"), F.lit(0).cast("bigint").alias("vote"), F.lit(0).alias("nth")).limit(0)
    blocks = max(1, min(QUERY_BLOCKS, n // CELL_POINTS))
    best = Window.partitionBy(key).orderBy("d", "near")
    top = lambda df: df.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    first = top(_searched(queries, points, cells, k, True, blocks, vector, label, key, apart))
    bound = first.where(F.col("nth") == k).select(F.col(key), F.col("d").alias("_bound"))
    second = _searched(queries.join(bound, key, "left"), points, cells, k, False, blocks, vector, label, key, apart)
    return top(first.drop("nth").unionByName(second))


def visited_share(queries: DataFrame, points: DataFrame, k: int, vector: str, label: str, key: str) -> float:
    """Share of all pairs of a query and a point that `nearest_points` compares."""
    found = nearest_points(queries, points, k, vector, label, key)
    points, queries = _usable(points, vector, key, label), _usable(queries, vector, key)
    cells = Cells(points, vector, key)
    bound = found.where(F.col("nth") == k).select(key, F.col("d").alias("_bound"))
    size = F.get(F.array(*map(F.lit, cells.size.tolist())), F.col("_cell"))
    met = sum(cells.visits(q, own).select(F.explode("_cells").alias("_cell")).agg(F.sum(size)).first()[0] or 0 for q, own in ((queries, True), (queries.join(bound, key, "left"), False)))
    return met / max(1, queries.count() * int(cells.size.sum()))


def voted(near: DataFrame, key: str, weighted: Column, *keys: str) -> DataFrame:
    """(key, keys, predicted): the commonest label, ties to the smaller one; `weighted` by inverse distance, where points at no distance outvote all others."""
    touching = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy(key, *keys))
    inverse = F.when(touching == 1, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), "d"))
    votes = near.withColumn("_w", F.when(weighted, inverse).otherwise(1.0)).groupBy(key, *keys, "vote").agg(F.sum("_w").alias("_w"))
    return votes.groupBy(key, *keys).agg(F.max_by("vote", F.struct("_w", -F.col("vote"))).alias("predicted"))


def nearest_vote(queries: DataFrame, points: DataFrame, k: int, vector: str, label: str, key: str, weighted: bool = False) -> DataFrame:
    """(key, predicted): the label that the k nearest points vote for."""
    return voted(nearest_points(queries, points, k, vector, label, key), key, F.lit(weighted))


def best_neighbours(points: DataFrame, ks: range, vector: str, label: str, key: str, folds: int = 5) -> DataFrame:
    """(k, weighted, accuracy) of cross-validation over a grid, the best first.

    One search serves all folds and the whole grid: neighbours lie in other folds than the query. Every row is a query once.
    """
    rows = points.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    near = nearest_points(rows, rows, max(ks), vector, label, key, "_fold")
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weighted")) for k in ks for w in (False, True)]))
    near = near.withColumn("_g", grid).select(key, "d", "near", "vote", "nth", "_g.k", "_g.weighted").where("nth <= k")
    got = voted(near, key, F.col("weighted"), "k", "weighted").join(points.select(key, label), key)
    return got.groupBy("k", "weighted").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy")).orderBy(F.desc("accuracy"), "k", "weighted")


def judged_neighbours(rows: DataFrame, k: int, weighted: bool = False, test_share: int = 33, folds: int = 5, vector: str = "features", label: str = "label", key: str = "event_id") -> DataFrame:
    """One row a set, as `judged` gives for the other models: votes of k neighbours on the held-out share, and cross-validated within both parts. `rows` has `part`, and `features` as an array."""
    train, test = rows.where(F.col("part") >= test_share), rows.where(F.col("part") < test_share)

    def predicted(queries: DataFrame, points: DataFrame, on: str, apart: str | None = None) -> DataFrame:
        votes = voted(nearest_points(queries, points, k, vector, label, key, apart), key, F.lit(weighted))
        return votes.join(queries.select(key, label), key).select(F.col(label).alias("label"), F.col("predicted").cast("double").alias("prediction"), F.lit(on).alias("on"))

    inside = [predicted(p, p, on, "_fold") for p, on in ((d.withColumn("_fold", F.pmod("part", F.lit(folds))), on) for d, on in ((train, "cv_train"), (test, "cv_test")))]
    return performance(predicted(test, train, "test").unionByName(inside[0]).unionByName(inside[1]), "on")
