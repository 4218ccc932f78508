"""Decontamination, resampling and whitening against brute force and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from combtrack.llm import op11_decontaminate as leaks
from combtrack.llm import op12_resampling as resampling
from combtrack.llm import op13_whitening as whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, row string, words int, h bigint, score double, w string"
ITEMS = "item_id bigint, text string, item string, n int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("etaoinéß7", k=rng.randint(1, 5))) for _ in range(60)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, make(rng.choice([1, 2, 4, 9, 10, 11, 25]))) for i in range(25)]
    items += [(3, make(14)), (None, make(12)), (70, None), (71, ""), (72, " -- "), (73, items[0][1]), (74, "A a A a A a A a A a A a A a")]
    docs = []
    for i in range(60):
        parts = [make(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            parts += [rng.choice([" ", "--", "\n"]).join(w[a:] if rng.random() < 0.3 else w), make(rng.randint(0, 5))]
        docs.append((i % 50, " ".join(parts).title() if i % 3 else " ".join(parts)))
    docs += [(None, docs[4][1]), (None, docs[4][1]), (90, None), (91, ""), (92, "..."), (93, "a " * 3000), (94, "É İ ẞ x_y"), (4, docs[4][1])]
    return docs, items


def expected_leaks(docs, items, window=10):
    kept = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), window)
        for a in range(len(w) - n + 1 if n else 0):
            kept.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in kept}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in kept:
                    hit |= set(range(a, a + n))
                    found |= kept[tuple(w[a : a + n])] - {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "r", 1, 2, 0.5, "w") for i, t in docs], DOCS).repartition(5), spark.createDataFrame([(i, t, "x", 3) for i, t in items], ITEMS)


@pytest.mark.parametrize(("window", "shingle", "small"), [(10, 5, True), (10, 5, False), (4, 4, True), (3, 1, True)])
def test_leaks(spark, corpus, monkeypatch, window, shingle, small):
    if not small:  # the shuffled join and a filter row that lets nearly all through
        monkeypatch.setattr(leaks, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(leaks, "LEAST_BITS", 128)
        monkeypatch.setattr(leaks, "MOST_BITS", 128)
    docs, items = frames(spark, *corpus)
    assert rows_of(leaks.leak_digests(docs, items, window, shingle=shingle)) == expected_leaks(*corpus, window)


def test_leaks_spans_and_empty_tables(spark):
    docs, items = frames(spark, [(1, "x a b c y"), (2, None)], [(5, "b c"), (6, "A b")])
    found = {r[0]: r for r in leaks.find_leaks(docs, items).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(1, 4)] and found[1]["items"] == ["5", "6"]
    assert found[2]["spans"] == [] and found[2]["n_words"] == 0
    none = items.where("false")
    assert [(r[1], r[2], r[5]) for r in leaks.leak_digests(docs, none).where("doc_id = 1").collect()] == [(5, 0, False)]
    assert leaks.leak_digests(docs.where("false"), items).count() == 0
    with pytest.raises(ValueError):
        leaks.find_leaks(docs, items, window=4)


def test_crc_composes():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.choice([0, 1, 7, 1000]))) for _ in range(200)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.int64)
    out = resampling.combine(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert out.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize(("longest", "most"), [(1, 100_000), (3, 100_000), (2, 5), (2, 0)])
def test_resampling(spark, corpus, longest, most):
    docs, items = corpus
    buckets, seed = 97, 7

    def hashed(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[a : a + n]).encode()) % buckets for n in range(1, longest + 1) for a in range(len(w) - n + 1)]

    s, t = (Counter(b for _, text in rows for b in hashed(text)) for rows in (docs, items))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    want, drawable = [], []
    for i, text in docs:
        f = hashed(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(words(text)) >= 20:
            drawable.append(want[-1])
    drawn = sorted(drawable, key=lambda r: (-r[3], r[0] is None, r[0]))[: 30 * len(drawable) // 100]
    ranks = Counter((r, k + 1) for k, r in enumerate(drawn))
    a, b = frames(spark, docs, items)
    got = resampling.importance_resample(a, b, percent=30, longest=longest, buckets=buckets, seed=seed, dictionary_words=most).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(want)
    assert Counter((tuple(r)[:4], r["rank"]) for r in got if r["rank"]) == ranks


def test_resampling_without_rows(spark, corpus):
    a, b = frames(spark, *corpus)
    assert resampling.importance_resample(a.where("false"), b).count() == 0
    assert resampling.importance_resample(a, b.where("false"), percent=0).where("rank is not null").count() == 0


def test_dictionary_learns_and_overlaps():
    d = resampling.WordDictionary(3)
    text = b" a b a  cc a dd e a "
    first, second = d.scan(text), d.scan(text)
    assert len(d.ids) == 3 and first[1].tolist() == second[1].tolist() == resampling.payloads(text.split()).tolist()


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (30, 7))
    x[:, 3] = 0
    m = x.T @ x
    poly = whitening.characteristic_polynomial(spark, m.tolist())
    for t in (-3, 0, 11):  # det(t - m), exact by fractions
        a = [[Fraction(int(t * (i == j) - m[i, j])) for j in range(7)] for i in range(7)]
        det = Fraction(1)
        for k in range(7):
            pivot = next((i for i in range(k, 7) if a[i][k]), None)
            if pivot is None:
                det = Fraction(0)
                break
            if pivot != k:
                a[k], a[pivot], det = a[pivot], a[k], -det
            det *= a[k][k]
            for i in range(k + 1, 7):
                f = a[i][k] / a[k][k]
                a[i] = [u - f * v for u, v in zip(a[i], a[k], strict=True)]
        assert sum(c * t**k for k, c in enumerate(poly)) == det
    roots = whitening.largest_roots(poly, int(np.trace(m)), 7, 160)
    assert np.allclose([float(r[1]) for r in roots], np.linalg.eigvalsh(m)[::-1][:6], rtol=1e-12)
    assert whitening.largest_roots([9 * 4, -33, 10, -1][::1], 10, 3, 160) != [] and sum(n for *_, n in whitening.largest_roots([-36, 33, -10, 1], 10, 3, 160)) == 3  # 3, 3 and 4


def whitened(vectors, components=8):
    """{component: (column, share)} by numpy, up to the sign."""
    x = np.floor(1024 * np.asarray(vectors, float)) + 100_000
    v = np.cov(x.T, bias=True)
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return (x - x.mean(0)) @ axes[:, order] / np.sqrt(e[order]), e[order] / np.trace(v), ((len(x) * x - x.sum(0)) ** 2).sum(1)


def test_whitening(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(0.2, 1.5, 12)).tolist()
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    bad = [(900, None, "x"), (901, [1.0] * 11 + [None], "x"), (902, [float("nan")] * 12, "x"), (903, [float("inf")] * 12, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, w string").repartition(4)
    got = whitening.whiten(df, 5).collect()
    want, share, deviation = whitened(vectors, 5)
    assert len(got) == 300 * 5 and {r["n"] for r in got} == {300}
    for k in range(5):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        w = np.array([mine[i]["whitened"] for i in range(300)])
        assert min(np.abs(w - want[:, k]).max(), np.abs(w + want[:, k]).max()) < 1e-8
        assert abs(mine[0]["explained"] / share[k] - 1) < 1e-9 and 0 <= mine[0]["identity_error"] < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(enumerate(deviation.astype(int).tolist()))


def test_whitening_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])] * 3, [(1, None)]):
        assert whitening.whiten(make(rows)).collect() == []
    square = [(None, [1.0, 1.0]), (None, [1.0, -1.0]), (2, [-1.0, 1.0]), (2, [-1.0, -1.0])]  # one eigenvalue, twice
    got = whitening.whiten(make(square)).collect()
    assert len(got) == 8 and {r["explained"] for r in got} == {0.5} and got[0]["identity_error"] < 1e-12
    short = whitening.whiten(make([(1, [1.0]), (2, [1.0, 2.0]), (3, [])])).collect()  # as (1, 0), (1, 2), (0, 0)
    full = whitening.whiten(make([(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0])])).collect()
    assert sorted(map(tuple, short)) == sorted(map(tuple, full)) and len(short) == 6
    large = whitening.whiten(make([(1, [3.0e5, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])])).collect()  # beyond 64 bits a batch
    assert {r["n"] for r in large} == {3} and large[0]["identity_error"] < 1e-9


def test_registered(spark):
    from combtrack.llm import entry

    found = {n: entry.queries()[n](spark, "/root/testdata/sf0.001") for n in ("op11_decontamination", "op12_resampling", "op13_whitening")}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert found["op11_decontamination"].count() == found["op12_resampling"].count() == docs
    assert found["op13_whitening"].agg(F.max("component")).first()[0] == 8
