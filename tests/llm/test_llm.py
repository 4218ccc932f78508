"""The dealt operators against brute force, exact round trips and edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F

from combtrack.llm import op01_jaccard, op02_suffix, op03_bpe, op04_topk, op05_toxicity, op06_token_file, op07_packing, op08_language, op09_passages, op10_tiff
from combtrack.llm._pieces import text_encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ["x <|endoftext|> y", "a<|startoftext|>", "", None, " ", "\n", "a", "A  b", "é́ ＡＢ Σίσυφος ΑΣ", "don't 's\n\n  x", "x" * 3000, "ab " * 400, "　y z\x1cw", "<|endoftext|> hi", "日本語\tテキスト 12"]
ODD = "doc_id bigint, text string, sketch string, marks int, shard int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = make(260), make(90)
    out = [make(rng.randint(1, 300)) for _ in range(30)]
    for _ in range(25):  # near copies
        w = base.split()
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [base] * 6 + [make(rng.randint(0, 40)) + " " + passage[rng.randint(0, 60) :] + " " + make(30) for _ in range(20)]
    return list(enumerate(out + EDGES))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1, 2) for i, t in rows], ODD).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def jaccard(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "num", "group"), [(3, 90, 2048), (5, 80, 4)])
def test_jaccard(docs, rows, empty, n, num, group):
    assert by_id(op01_jaccard.jaccard_components(docs, n, num, 100, group_rows=group)) == jaccard(rows, n, num, 100)
    if group > 4:
        assert op01_jaccard.jaccard_components(empty, n, num, 100).count() == 0


def repeated_bytes(rows, length):
    texts = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k : k + length] for b in texts.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in texts.items():
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("group", [1000, 3])
def test_repeated_bytes(docs, rows, empty, group):
    assert by_id(op02_suffix.drop_repeated_bytes(docs, digest=True, group_rows=group)) == repeated_bytes(rows, 200)
    if group > 3:
        assert op02_suffix.drop_repeated_bytes(empty, digest=True).count() == 0


def thue_morse(n, zero, one):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(one if b else zero for b in bits), "".join(zero if b else one for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_balanced_patterns_differ(spark, n):
    """Polynomials modulo a power of two can't tell these words apart, whatever their base."""
    a, b = thue_morse(n, "a", "b")
    many = [f"w{i}" for i in range(49)]
    rows = [(1, a), (2, b), (3, " ".join([*many[:20], a, *many[20:]])), (4, " ".join([*many[:20], b, *many[20:]])), (5, " ".join(thue_morse(64, "x ", "y ")[0].split())), (6, " ".join(thue_morse(64, "x ", "y ")[1].split()))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_id(op01_jaccard.jaccard_components(df, 3, 90, 100)) == jaccard(rows, 3, 90, 100)
    assert by_id(op09_passages.drop_repeated_passages(df, digest=True)) == repeated_words(rows, 50)
    assert by_id(op02_suffix.drop_repeated_bytes(df, digest=True)) == repeated_bytes(rows, 200)


def test_jaccard_links(docs, rows):
    """All links of different texts, and whom each document stands for."""
    links, members = (x.collect() for x in op01_jaccard.jaccard_links(docs, 3, 90, 100, group_rows=8))
    sets, first = {}, {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if w:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)}
            first.setdefault(tuple(w), i)
            assert (i, first[tuple(w)]) in {tuple(r) for r in members}
    reps = sorted(first.values())
    assert len(members) == len(sets)
    assert sorted(tuple(r) for r in links) == [(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("names", [("kept", "_p_id", "score", "_gone"), ("_s_id", "marks", "lang_pred", "toxicity")])
def test_clashing_columns(spark, names):
    base = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, base, 5, "x"), (2, base, 6, "y"), (None, base, 7, "z")], f"doc_id bigint, text string, {names[0]} int, {names[1]} string").withColumns({n: F.lit(n) for n in names[2:]})
    model, lexicon = (("aa", "w w w"),), op05_toxicity.ToxicLexicon(((" w1 ", 1.0),), (), 1.0)
    for out in (op02_suffix.drop_repeated_bytes(df), op09_passages.drop_repeated_passages(df), op05_toxicity.score_toxicity(df, lexicon, keep=True), op08_language.identify_language(df, model, keep=True), op01_jaccard.keep_one_of_each(df, op01_jaccard.jaccard_components(df))):
        assert {(r["doc_id"], r[2], r[3]) for r in out.collect()} >= {(1, 5, "x"), (None, 7, "z")} and out.columns[:6] == df.columns
        assert all(r[k] == k for r in out.collect() for k in names[2:])
    kept = {r["doc_id"]: bytes(r[-1]) for r in op02_suffix.drop_repeated_bytes(df).collect()}
    assert kept == {1: b"", 2: b"", None: base.encode()}
    assert {r["doc_id"]: r["text"] for r in op09_passages.drop_repeated_passages(df).collect()} == {1: base, 2: "", None: base}


def test_prefix_intervals():
    assert sorted(op02_suffix.prefix_intervals([2, 3, 1])) == [(0, 2, 2), (0, 3, 1), (1, 2, 3)]


def test_byte_bpe(docs, rows):
    path = tok.path("byte_bpe_50k.tiktoken")
    enc = op03_bpe.coder(path, tok.PATTERN)
    got = by_id(op03_bpe.bpe_digests(docs, path, tok.PATTERN, piece_chars=50))
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = by_id(op03_bpe.decode_bpe(op03_bpe.encode_bpe(docs, path, tok.PATTERN), path, tok.PATTERN))
    assert {i: bytes(x[0]) for i, x in back.items()} == {i: (t or "").encode() for i, t in rows}


def nearest(data, k):
    """By Python integers; vectors by id, those of an odd kind left out, the shorter filled with zeros."""
    fine = {i: [a * 256 // b for a, b in map(float.as_integer_ratio, v)] for i, v in sorted(data, key=lambda x: str(x[1]), reverse=True) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in fine if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(fine[q], v, strict=False)), i) for i, v in fine.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "chunk": 3, "tile": 1}, {"block": 5, "chunk": 40, "tile": 2}])
def test_top_k(spark, sizes):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 16))
    x[40:60] = x[40]  # ties
    odd = [(300, None), (301, [float("nan")] * 16), (302, [None] * 16), (304, [float("inf")]), (None, [1.0] * 16)]
    wide = [(350, [600000.0, 0.0]), (400, rng.normal(0, 1e6, 16).tolist()), (401, rng.normal(0, 1e6, 16).tolist()), (402, rng.normal(0, 9e3, 16).tolist())]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + odd + wide + [(303, [1.0]), (450, [0.5] * 20), (500, [])]
    df = spark.createDataFrame([(i, v, "z", 7) for i, v in data], "vec_id bigint, embedding array<double>, b string, qb int").repartition(4)
    asked = df.where("vec_id % 50 = 0")
    assert sorted(tuple(r) for r in op04_topk.top_k(df, asked, 5, **sizes).collect()) == nearest(data, 5)
    if not sizes:
        assert op04_topk.top_k(df.limit(0), df.limit(0)).count() == op04_topk.top_k(df, df.limit(0)).count() == 0
        assert op04_topk.top_k(df.unionAll(df), asked.unionAll(asked), 5).count() == len(nearest(data, 5))  # repeated ids
        assert op04_topk.top_k(df.limit(3), df.limit(3), 5).count() == 6


def test_cells_bound_products():
    rng = np.random.default_rng(4)
    for scale in (3, 300, 2**24):
        x, q = rng.integers(-scale, scale, (50, 7)), rng.integers(-scale, scale, (9, 7))
        lower, upper = op04_topk.ApproximationFile.of(x).bounds(q)
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()


def test_toxicity(spark, empty):
    rng = random.Random(1)
    filler = ["".join(rng.choices("mnaeru", k=5)) for _ in range(200)]
    data = []
    for i in range(400):
        w = rng.choices(filler, k=60)
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["grubby", "gru8by", "GRUBBY!", "zoink"])
        elif i % 9 == 0:
            w[3:5] = ["old", "zoinkers"]
        data.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    lexicon = op05_toxicity.learn_toxicity(df.drop("toxic"), df.drop("text"), df["doc_id"] % 3 != 0)
    got = by_id(op05_toxicity.score_toxicity(df, lexicon))
    assert sum((got[i][0] >= 0.3) == bool(toxic) for i, _, toxic in data) >= 396
    assert op05_toxicity.fold("Іd1οt  l0ser") == " idiot ioser "
    assert by_id(op05_toxicity.score_toxicity(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"), lexicon)) == {1: (0.0,), 2: (0.0,)}


def test_matches_against_plain_search():
    rng = random.Random(12)
    lexicon = op05_toxicity.ToxicLexicon(((" ab", 2.0), (" abc ", 3.0), (" ba ", 1.5)), (" x ab", " abc d ", " ba ba "), 1.0)
    automaton = op05_toxicity._automaton(lexicon)
    for _ in range(300):
        folded = " " + " ".join(rng.choices(["ab", "abc", "ba", "x", "d", "abcd"], k=rng.randint(0, 12))) + " "
        spared = [(k, k + len(p)) for p in lexicon.exceptions for k in range(len(folded)) if folded.startswith(p, k)]
        want = {}
        for pattern, weight in lexicon.patterns:
            for k in range(len(folded)):
                if folded.startswith(pattern, k) and k + len(pattern) > want.get(k, (0, 0, 0))[1]:
                    want[k] = (k, k + len(pattern), weight)
        want = sorted(m for m in want.values() if not any(a <= m[0] and m[1] <= b for a, b in spared))
        assert sorted(op05_toxicity.matches(automaton, folded)) == want


def plain_lexicon(toxic, clean):
    """Patterns with weights, exceptions: by counting each candidate in each folded text, one after another."""
    fold = op05_toxicity.fold
    toxic, clean = ([fold(t) for t in sorted(set(x))] for x in (toxic, clean))
    words = {w for t in toxic for w in t.split() if len(w) >= 3}
    candidates = {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in range(4, min(8, len(w)) + 1)}
    held = {p: (sum(p in t for t in toxic), sum(p in t for t in clean)) for p in candidates}
    odds = {p: math.log((a + 0.5) / (len(toxic) + 1)) - math.log((b + 0.5) / (len(clean) + 1)) for p, (a, b) in held.items()}
    fine = {p for p, (a, b) in held.items() if a >= max(2, len(toxic) // 500) and odds[p] > 2 and a >= 8 * b}
    kept, left = [], toxic
    while fine and (most := max((sum(p in t for t in left), odds[p], len(p), p) for p in fine))[0] >= 2:
        kept.append(most[3])
        left = [t for t in left if most[3] not in t]
    kept += [p for p in fine if p.endswith(" ") and held[p][0] * 10 >= len(toxic) and not held[p][1] and not any(q in p for q in kept)]
    phrases = [set(), set()]  # of clean and of toxic texts, numbered
    for label, texts in enumerate((clean, toxic)):
        for nth, t in enumerate(texts):
            w = t.split()
            for k in range(len(w)):
                if any(f" {w[k]} ".startswith(p) for p in kept):
                    around = [w[k : k + 1], *([w[k - 1 : k + 1]] if k else []), *([w[k : k + 2]] if k + 1 < len(w) else [])]
                    phrases[label] |= {(nth, " " + " ".join(x) + " ") for x in around}
    times = [Counter(p for _, p in x) for x in phrases]
    spared = sorted(p for p, n in times[0].items() if n >= 2 and n >= 4 * times[1][p])
    return {p: odds[p] for p in kept}, spared


@pytest.mark.parametrize("seed", range(3))
def test_learning_against_plain_counting(spark, seed):
    """Candidates that tie, copies, words that begin alike in toxic and clean texts, and long texts."""
    rng = random.Random(seed)
    filler = ["".join(rng.choices("mnaeru", k=rng.randint(2, 7))) for _ in range(60)]
    data = []
    for i in range(240):
        w = rng.choices(filler, k=rng.choice([6, 30, 400 if i % 40 == 0 else 12]))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["grubby", "gru8bier", "Fl0rp", "blarg", "blargh", *(f"z0ink{c}" for c in "abcdefgh")])
        elif i % 80 in (10, 61):
            at = rng.randrange(len(w) - 1)
            w[at : at + 2] = ["blargon", "mill"] if i % 80 == 61 else ["old", "zoinkers"]
        data.append((i, " ".join(w), int(i % 3 == 0)))
    data += [(1000 + i, t, x) for i, (_, t, x) in enumerate(data[:30])]
    df = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    lexicon = op05_toxicity.learn_toxicity(df.drop("toxic"), df.drop("text"), df["doc_id"] >= 0)
    weights, spared = plain_lexicon([t for _, t, x in data if x], [t for _, t, x in data if not x])
    assert weights and spared
    assert dict(lexicon.patterns) == pytest.approx(weights)
    assert sorted(lexicon.exceptions) == spared


def test_toxicity_without_labels(spark, empty):
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, toxic int")
    df = spark.createDataFrame([(1, "a bad word"), (2, "bad " * 20000), (2, "bad"), (None, "bad")], "doc_id bigint, text string")
    lexicon = op05_toxicity.learn_toxicity(df, labels, labels["doc_id"] > 0)
    assert [r[1] for r in op05_toxicity.score_toxicity(df, lexicon).collect()] == [0.0] * 4
    assert op05_toxicity.learn_toxicity(empty, labels.limit(0), labels["doc_id"] > 0).patterns == ()
    assert op05_toxicity.score_toxicity(empty, lexicon).count() == 0


def test_toxicity_reads_all_contexts(spark):
    """Two clean documents with far more than 2000 contexts each, of which only the alphabetically last is common to them."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdefg", k=n))
    data = [(i, f"{word(6)} zoink{word(3)} {word(6)}", 1) for i in range(60)] + [(100 + i, " ".join(word(5) for _ in range(9)), 0) for i in range(60)]
    data += [(200 + i, " ".join(f"{word(9)} zoinkers" for _ in range(2500)), 0) for i in range(2)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    lexicon = op05_toxicity.learn_toxicity(df.drop("toxic"), df.drop("text"), df["doc_id"] >= 0)
    assert any(p.startswith(" zoi") for p, _ in lexicon.patterns) and " zoinkers " in lexicon.exceptions


@pytest.mark.parametrize(("name", "pattern"), [("word_bpe_49k.json", None), ("byte_bpe_50k.json", tok.PATTERN)])
def test_encoders_equal_the_library(rows, name, pattern):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tok.path(name))  # the plain call: strings of special tokens are those tokens
    for _, t in rows:
        data = text_encoder(tok.path(name), pattern).encode(t or "")
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == library.encode(t or "", add_special_tokens=False).ids


def test_token_file_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 4000):
        for top in (1, 300, 49408, 2**32 - 1):
            ids = rng.integers(0, top, n).astype(np.uint32)
            if n > 1:
                ids[-1] = 2**32 - 1  # an exception
            data = op06_token_file.pack_ids(ids)
            assert (op06_token_file.unpack_ids(data) == ids).all()
            assert (op06_token_file.unpack_ids(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_token_files(docs, rows, empty):
    path = tok.path("word_bpe_49k.json")
    got = by_id(op06_token_file.token_file_digests(docs, path, 1, file_ids=500))
    start = 0
    for i, t in rows:
        data = text_encoder(path).encode(t or "") + struct.pack("<I", 1)
        assert got[i] == (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    assert op06_token_file.token_file_digests(empty, path, 1).count() == 0


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_token_files_of_odd_rows(spark, kind):
    """Null and repeated ids, ids of text, and the ids themselves read back."""
    path = tok.path("word_bpe_49k.json")
    texts = [("10", "ten words"), ("2", "two"), ("2", None), (None, "nobody"), ("2", "two")]
    df = spark.createDataFrame([(None if i is None else i if kind == "string" else int(i), t) for i, t in texts], f"doc_id {kind}, text string").repartition(2)
    folder = op06_token_file.write_token_files(df, path, 1, file_ids=2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], list(r["ids"])) for r in op06_token_file.read_token_files(spark, folder).collect())
    want = {t: list(np.frombuffer(text_encoder(path).encode(t or ""), "<u4")) + [1] for _, t in texts}
    assert [r[1] for r in got] == [None, *(["10", "2", "2", "2"] if kind == "string" else [2, 2, 2, 10])]
    assert Counter((r[1] and str(r[1]), tuple(r[3])) for r in got) == Counter((i, tuple(want[t])) for i, t in texts)
    at = 0
    for start, _, n, ids in got:
        assert (start, n) == (at, len(ids))
        at += n


def test_bpe_of_odd_rows(spark, empty):
    path = tok.path("byte_bpe_50k.tiktoken")
    enc, long = op03_bpe.coder(path, tok.PATTERN), "x" * 70_000
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (2, long)], "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in op03_bpe.bpe_digests(df, path, tok.PATTERN).collect())
    assert got == Counter([(None, 2), (None, 2), (1, 0), (2, len(enc.encode_ordinary(long)))])
    assert op03_bpe.bpe_digests(empty, path, tok.PATTERN).count() == op03_bpe.decode_bpe(op03_bpe.encode_bpe(empty, path, tok.PATTERN), path, tok.PATTERN).count() == 0


def test_jaccard_of_odd_rows(spark):
    """Null ids are left out; an id's rows are one document's; long texts have many prefix rows."""
    rng = random.Random(7)
    make = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long, a, b = make(4000), make(50), make(50)
    rows = [(1, long), (2, long + " end"), (3, a), (4, a), (4, b), (5, b), (6, b), (7, make(4000)), (None, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in op01_jaccard.jaccard_components(df, 3, 90, 100).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (5, 3), (6, 3), (7, 7)])


def test_packing(docs, rows, empty):
    path = tok.path("byte_bpe_50k.json")
    got = op07_packing.pack_tokens(docs, path, 0, tok.PATTERN, size=64, shard_docs=16).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        data = text_encoder(path, tok.PATTERN).encode(t or "") + struct.pack("<I", 0)
        at = 0
        for r in sorted(own[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + r["length"])]) and r["doc_tokens"] == len(data) // 4
            at += r["length"]
        assert at == len(data) // 4
    full = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
        full += at == 64
    assert full >= len(sequences) - 8
    assert op07_packing.pack_tokens(empty, path, 0, tok.PATTERN).count() == 0


def test_packing_of_wide_ids_and_repeated_rows(spark, tmp_path):
    """A vocabulary beyond 16 bits: ids of the given file, moved up."""
    import json

    with open(tok.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {t: i + 60_000 for t, i in spec["model"]["vocab"].items()}
    spec["added_tokens"] = []
    path = str(tmp_path / "wide.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["hello wide world " * 9, None, "", "x", "x"]
    df = spark.createDataFrame([(None if i < 2 else 7, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = op07_packing.pack_tokens(df, path, 3, tok.PATTERN, size=4096).collect()
    enc = text_encoder(path, tok.PATTERN)
    want = [enc.encode(t or "") + struct.pack("<I", 3) for t in texts]
    assert max(np.frombuffer(want[0], "<u4")) > 65_535
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == Counter((None if i < 2 else 7, len(w) // 4, zlib.crc32(w)) for i, w in enumerate(want))


def test_language(spark, empty):
    rng = random.Random(4)
    kinds = {"aa": ["the", "and", "ing", "ther"], "bb": ["und", "ich", "sch", "keit"], "cc": ["eau", "é", "ment", "les"]}
    data = [(i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(40)), k) for i, k in enumerate(rng.choices(list(kinds), k=150))]
    df = spark.createDataFrame([*data, (900, None, "aa"), (901, "123 !", "bb")], "doc_id bigint, text string, lang string")
    model = op08_language.learn_languages(df, df["doc_id"] % 2 == 0)
    got = by_id(op08_language.identify_language(df, model))
    assert all(got[i][0] == lang for i, _, lang in data)
    assert got[900] == got[901] == ("und", 0.0, None)
    assert op08_language.identify_language(empty, model).count() == 0


def test_cross_parse():
    """Against a quadratic search for longest matches; how the work is cut changes nothing."""
    rng = random.Random(9)
    samples = ["".join(rng.choices("abc ", k=120)), "ab" * 40 + "c", "q"]
    texts = ["".join(rng.choices("abcdé ", k=rng.randint(1, 300))) for _ in range(20)] + ["ab" * 200, "a", "q" * 50, "ba" * 150 + "c" * 30]
    tables, starts = [], []
    for x in samples:
        starts.append(sum(map(len, tables)))
        tables.append(op08_language.SuffixAutomaton(op08_language.fold([x])[0]).table())
    seq, offsets = op08_language.fold(texts)
    want = []
    for i in range(len(texts)):
        own, row = seq[offsets[i] : offsets[i + 1]].tobytes(), []
        for x in samples:
            sample, at, n = op08_language.fold([x])[0].tobytes(), 0, 0
            while at < len(own):
                size = 1
                while at + size < len(own) and own[at : at + size + 1] in sample:
                    size += 1
                at, n = at + size, n + 1
            row.append(n)
        want.append(row)
    for segment in (1, 3, 16, 1024):
        assert op08_language.phrases(np.concatenate(tables), np.array(starts), seq, offsets, segment).tolist() == want


def test_languages_learn_whole_texts(spark):
    rows = [(i, f"w{i} " * 50, "aa") for i in range(5)] + [(9, "long " * 9000, "bb"), (10, None, "bb"), (11, "t", None), (12, "12", "cc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = dict(op08_language.learn_languages(df, df["doc_id"] >= 0, sample_docs=3))
    assert set(model) == {"aa", "bb"} and model["bb"] == "long " * 9000 and len(model["aa"]) == 3 * 150 + 2
    with pytest.raises(ValueError, match="languages"):
        op08_language.learn_languages(df, df["doc_id"] >= 0, sample_docs=1, max_languages=1)
    twins = (("aa", "same text"), ("bb", "same text"))
    assert by_id(op08_language.identify_language(df.where("doc_id = 11"), twins))[11][:2] == ("aa", 0.5)  # ties: the first by name


def repeated_words(rows, window):
    texts = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i, w in sorted(texts.items()):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()
    return out


@pytest.mark.parametrize(("window", "period"), [(50, 31), (20, 7)])
def test_passages(docs, rows, empty, window, period):
    assert by_id(op09_passages.drop_repeated_passages(docs, window=window, period=period, digest=True)) == repeated_words(rows, window)
    kept = op09_passages.drop_repeated_passages(docs, window=window, period=period)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert op09_passages.drop_repeated_passages(empty, window=window, period=period).count() == 0


def test_hot_passages_and_shingles(spark):
    """A third of all rows hold one passage, in surroundings of their own or as copies, and short texts share one shingle."""
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage, copied = make(70), make(120)
    texts = [f"{make(rng.randint(1, 40))} {passage} {make(rng.randint(1, 40))}" for _ in range(40)]
    texts += [copied] * 40 + [make(90) for _ in range(15)] + ["to be or not" + rng.choice(["", " to be", " at all"]) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert len(op09_passages.often_seen(df, 50, 31, 4000)) > 0
    assert by_id(op09_passages.drop_repeated_passages(df, digest=True)) == repeated_words(rows, 50)
    assert by_id(op01_jaccard.jaccard_components(df, 3, 90, 100, group_rows=8)) == jaccard(rows, 3, 90, 100)


def test_rows_of_a_passage_settle_in_their_task():
    ids, keys = np.array([5, 3, 9, 3, 7]), np.array([1, 1, 1, 2, 2], np.uint64)
    assert op09_passages._earliest(ids, keys, keys).tolist() == [False, True, False, True, False]
    parts = [(np.arange(i),) for i in (3, 0, 4, 1)]
    assert [len(x[0]) for x in op09_passages._gathered(iter(parts), 5)] == [7, 1]


def test_covers_hold_every_difference():
    for period, cover in op09_passages.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_tiff(docs, rows, spark):
    rng = random.Random(6)
    for n in (0, 1, 5000):
        for kinds in (1, 3, 256):
            data = bytes(rng.randrange(kinds) for _ in range(n))
            assert op10_tiff.unlzw(op10_tiff.lzw(data), n) == op10_tiff.unpackbits(op10_tiff.packbits(data), n) == data
    pixels = np.frombuffer(rng.randbytes(576 * 300), np.uint8).reshape(-1, 576)
    for packing in (1, 5, 8, 32773):
        for tile in (0, 64):
            data = op10_tiff.write_tiff(pixels, op10_tiff.Layout(packing, 2, tile=tile))
            assert (np.concatenate([op10_tiff.read_page(data, d) for d in op10_tiff.directories(data)]) == pixels).all()
    got = by_id(op10_tiff.media_digests(docs))
    for i, t in rows:
        payload = op10_tiff.pad((t or "").encode())
        assert got[i][:4] == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    pages = op10_tiff.read_pages(op10_tiff.store_texts(docs)).collect()
    assert {r["doc_id"] for r in pages} == {i for i, _ in rows} and all(r["error"] is None for r in pages)
    stored = {r["doc_id"]: bytes(r["media"]) for r in op10_tiff.store_texts(docs).collect()}
    read = defaultdict(list)
    for r in pages:
        read[r["doc_id"]].append((r["page"], r["height"], r["compression"], bytes(r["samples"])))
    for i, t in rows:
        own = sorted(read[i])
        data = b"".join(x[3] for x in own)
        assert data == op10_tiff.pad((t or "").encode())
        share = [data.count(b) / len(data) for b in range(256)]
        entropy = -sum(p * np.log2(p) for p in share if p)
        feature = f"pages={len(own)};rows={sum(x[1] for x in own)};compression={own[-1][2]};mean={sum(b * p for b, p in enumerate(share)):.4f};entropy={entropy:.4f}"
        assert got[i][4:] == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest(), feature)
    bad = op10_tiff.read_pages(spark.createDataFrame([(1, None), (2, b"II*"), (3, b"no")], "doc_id bigint, media binary")).collect()
    assert len(bad) == 3 and all(r["error"] for r in bad)


def test_malformed_tiff_gives_errors(spark):
    """Every byte of a small file of two pages set to other values: never an exception, and a page keeps its number."""
    pixels = np.arange(40, dtype=np.uint8).reshape(-1, 8)
    for layout in (op10_tiff.Layout(1, 1, rows=2, page_rows=3), op10_tiff.Layout(5, 2, rows=2, page_rows=3), op10_tiff.Layout(8, 1, tile=16, page_rows=3), op10_tiff.Layout(32773, 1, rows=2, page_rows=3)):
        data = op10_tiff.write_tiff(pixels, layout)
        for at in range(len(data)):
            for value in (0, 1, 127, 255):
                found = list(op10_tiff.pages(data[:at] + bytes([value]) + data[at + 1 :]))
                assert found and [p[0] for p in found] == list(range(len(found)))
                assert all((x is None) != (e is None) for _, _, x, e in found)
            assert list(op10_tiff.pages(data[:at])) or at == 0
    second = bytearray(data)
    first = struct.unpack_from("<I", second, 4)[0]
    link = first + 2 + 12 * struct.unpack_from("<H", second, first)[0]
    at = struct.unpack_from("<I", second, link)[0]
    second[at + 10 : at + 14] = b"\0\0\0\0"  # the second page's width
    found = list(op10_tiff.pages(bytes(second)))
    assert [(p, e is None) for p, _, _, e in found] == [(0, True), (1, False)]
    df = spark.createDataFrame([("k", bytes(second)), (None, data), ("k", None)], "doc_id string, media binary")
    got = Counter((r["doc_id"], r["page"], r["error"] is None) for r in op10_tiff.read_pages(df).collect())
    assert got == Counter([("k", 0, True), ("k", 1, False), (None, 0, True), (None, 1, True), ("k", 0, False)])
    assert op10_tiff.media_digests(df.limit(0).selectExpr("doc_id", "string(media) as text")).count() == 0


def test_big_endian_tiff():
    tags = [(256, 4, 4), (257, 4, 2), (258, 3, 8 << 16), (259, 3, 1 << 16), (273, 4, 8), (278, 4, 2), (279, 4, 8)]
    data = b"MM\0*" + struct.pack(">I", 16) + bytes(range(8)) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4
    ((page, _, pixels, error),) = op10_tiff.pages(data)
    assert (page, error, pixels.tolist()) == (0, None, [[0, 1, 2, 3], [4, 5, 6, 7]])


def test_pipeline(spark):
    import os

    import corpus_pipeline

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.select("doc_id").distinct().count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "passages", "packing"]
