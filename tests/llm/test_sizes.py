"""What grows with the tables stays off the driver."""

import random

import numpy as np

from combtrack.llm import _components, op01_jaccard, op04_topk


def least_reachable(pairs):
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


def written(monkeypatch, module):
    """Grows by one with each stage that the module writes."""
    out, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: out.append(1) or write(df))
    return out


def test_stars_take_no_step(spark, monkeypatch):
    stages = written(monkeypatch, _components)
    stars = [(c, c + i) for c in (0, 100, 200) for i in range(1, 60)] + [(7000, 7000)]
    df = spark.createDataFrame(random.Random(1).sample(stars, len(stars)), "a bigint, b bigint").repartition(3)
    assert dict(_components.connected_components(df, "a", "b").collect()) == least_reachable(stars)
    assert len(stages) == 1  # the edges themselves


def test_components_of_any_links(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(1000, 1040)]
    for pairs in ([], [(3, 3)], path, path[::-1] + [(1040, 5), (5, 9)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]):
        df = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(3)
        assert dict(_components.connected_components(df, "a", "b").collect()) == least_reachable(pairs)
        a, b = _components.contracted(*np.array(pairs, np.int64).reshape(-1, 2).T)
        least = least_reachable(pairs)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((v, k) for k, v in least.items() if k != v)


def test_a_cluster_of_near_copies_takes_few_stages(spark, monkeypatch):
    stages = written(monkeypatch, _components)
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.choices(range(120), k=80))]
    found = op01_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), 3, 90, 100)
    assert {r["component_id"] for r in found.collect()} == {0}
    assert len(stages) <= 6  # the exact links, stars of one block, take no step; those of the sketches one at most


def test_top_k_broadcasts_no_copies(spark, monkeypatch):
    """Blocks that explode has copied meet by a sort-merge join, however small their estimate."""
    plans, write = [], op04_topk.materialize

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(op04_topk, "materialize", spy)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id bigint, embedding array<double>")
    assert op04_topk.top_k(df, df.where("vec_id % 50 = 0"), 5, block=2, chunk=20).count() == 20
    met = [p for p in plans if "qb#" in p and "Join" in p]
    assert met and all("BroadcastExchange" not in p and "SortMergeJoin" in p for p in met)
