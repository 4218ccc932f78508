"""Connected components of a graph kept in tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, other): links from the least node of each component of the links (a, b) to all its others."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[i] != label[j]).any():
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is the centre of its links (u, v), v < u, or the outer end of a single one."""
    ends = edges.selectExpr("u as node", "1 as outer_end", "0 as centre").unionAll(edges.selectExpr("v", "0", "1"))
    nodes = ends.groupBy("node").agg(F.sum("outer_end").alias("n"), F.max("centre").alias("centre"))
    return not nodes.where("n + centre > 1").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node that links lead to, for every node with a link to another one.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges are stars; each step is a minimum
    per node and a join back, so a hub is never one task's group. Nulls and loops are left out. Edges that are stars
    already take no step, so tasks that find many had better give them `contracted`.
    """
    current = materialize(edges.where(f"{a} <> {b}").selectExpr(f"greatest({a}, {b}) as u", f"least({a}, {b}) as v").distinct())
    while not _are_stars(current):
        both = current.unionAll(current.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialize(both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").distinct())
        second = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(second, "u").where("v <> m").selectExpr("v as u", "m as v")
        after = materialize(small.unionAll(second).distinct())
        discard(current, least, large, second)
        current = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(current.select("v", "v")).distinct()
