"""Each stage of the pipeline against plain Python on its own input: null ids, repeated rows, copies and shared passages."""

import random
import struct
from collections import Counter

import public_tokenizers as tok
import pytest
from test_llm import WORD, jaccard

import corpus_pipeline
from combtrack.llm._pieces import text_encoder

KINDS = {"aa": ["the", "and", "ing", "ther"], "bb": ["und", "ich", "sch", "keit"]}
COLUMNS = ["doc_id", "text", "lang", "n_chars"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, n_chars int").repartition(3)


def held(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


def want(rows):
    return Counter((i, t, lang, len(t or "")) for i, t, lang in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    make = lambda k, n: " ".join("".join(rng.choices(KINDS[k], k=3)) for _ in range(n))
    out = [(i, make(k, 80), k) for i, k in enumerate(rng.choices(list(KINDS), k=120))]
    base, passage = make("aa", 200), make("aa", 70)
    copies = [base] + [" ".join(w if j != 5 + i else "other" for j, w in enumerate(base.split())) for i in range(4)]
    out += [(200 + i, t, "aa") for i, t in enumerate([*copies, base])]
    out += [(300 + i, f"{make('aa', 20 + i)}  {passage}\n{make('aa', 30)}", "aa") for i in range(5)]
    out += [out[3], out[3], out[120], out[127]]  # repeated rows
    out += [(None, base, "aa"), (None, base, "aa"), (None, f"x {passage}", "aa")]
    return out


def test_language_stage(spark, rows, monkeypatch):
    """Kept rows get the predicted label; texts without a letter, of another language than those wanted, or of none go."""
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("aa", "bb"))
    rng = random.Random(3)
    other = ["ñoz", "gwyx", "pfk", "qum"]
    third = [(600 + i, " ".join("".join(rng.choices(other, k=3)) for _ in range(60)), "cc") for i in range(20)]
    noise = [(700, "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=400)), "aa"), (None, "".join(rng.choices("0123456789абвгдежз", k=300)), "bb")]
    gone = [(400, None, "aa"), (401, "", "aa"), (402, "12 3 !", "bb"), (None, "77", "bb"), (None, None, "aa")]
    wrong = [(800, rows[0][1], "bb" if rows[0][2] == "aa" else "aa"), (801, rows[1][1], None), (802, third[0][1], "aa")]
    got = held(corpus_pipeline.language(spark, frame(spark, rows + gone + third + noise + wrong), ""))
    assert got == want(rows + [(800, rows[0][1], rows[0][2]), (801, rows[1][1], rows[1][2])])


def test_toxicity_stage(spark, rows, tmp_path):
    toxic = [(500 + i, f"{t} grubby {t}", lang) for i, (_, t, lang) in enumerate(rows[:60])]
    toxic += [toxic[0], (None, "a grubby the", "aa")]
    labels = [(i, int(i >= 500)) for i in {r[0] for r in rows + toxic} - {None}]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert held(corpus_pipeline.toxicity(spark, frame(spark, rows + toxic), str(tmp_path))) == want(rows)


def test_near_duplicates_stage(spark, rows):
    found = jaccard([r[:2] for r in rows if r[0] is not None], 5, 80, 100)
    kept = [r for r in rows if r[0] is None or found[r[0]][1] == r[0]]
    assert 5 <= len({r[0] for r in rows}) - len({r[0] for r in kept})
    assert held(corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")) == want(kept)


def test_passages_stage(spark, rows):
    first = {}
    for i, t, _ in sorted(r for r in rows if r[0] is not None):
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    kept = []
    for i, t, lang in rows:
        w = WORD.findall(t)
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t, lang))
    assert kept != rows
    assert held(corpus_pipeline.passages(spark, frame(spark, rows), "")) == want(kept)


def test_packing_stage(spark, rows):
    encode = text_encoder(tok.path("byte_bpe_50k.json"), tok.PATTERN).encode
    size = lambda t: len(encode(t) + struct.pack("<I", 0)) // 4
    got = corpus_pipeline.packing(spark, frame(spark, rows), "").where("start = 0").select("doc_id", "doc_tokens").collect()
    assert Counter(tuple(r) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
