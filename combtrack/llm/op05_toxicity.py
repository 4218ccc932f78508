"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name

# Letters of other alphabets that look like Latin ones, and digits written for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
INVISIBLE = "­​‌‍⁠﻿"
# Letters that a digit may stand for alike: l and i are both written 1.
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {"l": "i"} | {c: None for c in INVISIBLE} | {"ӏ": "i"})
_SIGN = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """` word word `: lower case, look-alikes and digits as the letters that they stand for, one space between words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return " " + _GAP.sub(" ", text.translate(_FOLD)).strip() + " "


@dataclass(frozen=True)
class ToxicLexicon:
    """patterns: (folded pattern with its leading space, weight). exceptions: folded phrases within which no pattern counts."""

    patterns: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    rate: float


def _automaton(lexicon: ToxicLexicon):
    import ahocorasick

    out = ahocorasick.Automaton()
    for pattern, weight in lexicon.patterns:
        out.add_word(pattern, (len(pattern), weight))
    for phrase in lexicon.exceptions:
        out.add_word(phrase, (len(phrase), 0.0))
    if len(out):
        out.make_automaton()
    return out


def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the patterns outside exception phrases; where several begin together the longest counts."""
    if not len(automaton):
        return []
    found, spared = {}, []
    for end, (size, weight) in automaton.iter(folded):
        if weight:
            start = end + 1 - size
            if start not in found or found[start][1] < end + 1:
                found[start] = (start, end + 1, weight)
        else:
            spared.append((end + 1 - size, end + 1))
    if not spared:
        return list(found.values())
    spared.sort()
    reach = list(accumulate((b for _, b in spared), max))  # furthest end of the phrases that begin so early
    begins = [a for a, _ in spared]
    out = []
    for m in found.values():
        i = bisect_right(begins, m[0]) - 1
        if i < 0 or reach[i] < m[1]:
            out.append(m)
    return out


def density(automaton, text: str) -> float:
    """Weight of the matches, normalised by length: divided by the logarithm of the words, so that a long text needs more of them."""
    folded = fold(text)
    hits = matches(automaton, folded)
    return math.fsum(m[2] for m in hits) / math.log2(4 + folded.count(" ") / 100) if hits else 0.0


def _candidates(folded: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Whole words ` word ` and their beginnings ` wor` of `shortest` to `longest` letters."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(" " + word[:n] for n in range(shortest, min(longest, len(word)) + 1))
    return out


def learn_toxicity(docs: DataFrame, labels: DataFrame, learnable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 3000, threshold: float = 0.3) -> ToxicLexicon:
    """Learns patterns, weights, exception phrases and the scale from a bounded sample of labelled documents.

    The sample holds, of either label, the `sample_docs` learnable documents with the lowest hash of their id; null
    ids, texts and labels are left out, and copies count once. Patterns are words of three letters or more and
    beginnings of four to eight letters with much better odds in toxic documents, of which the greedy cover keeps those
    that explain documents no better pattern explains. A phrase round a pattern that mostly clean documents use becomes
    an exception; every context in the sample counts. Candidates and exceptions have no cap: what `sample_docs`
    documents can teach bounds them. No label of another row is read. Without learnable toxic documents the lexicon
    is empty and every score 0; without clean ones every toxic word counts.
    """
    labelled = labels.where(learnable & labels[label_col].isin(0, 1) & labels[id_col].isNotNull()).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).dropDuplicates(["id"])
    of_label = [labelled.where(F.col("toxic") == x).orderBy(F.xxhash64("id"), "id").limit(sample_docs) for x in (0, 1)]
    chosen = of_label[0].unionAll(of_label[1])  # of bounded size
    texts = docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").dropDuplicates(["text"]).select("toxic", "text")

    def count(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for p in _candidates(fold(text)):
                    seen[p][toxic] += 1
        at = list(seen)
        for i in range(0, len(at), 20_000):
            part = at[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[p][0] for p in part], pa.int64()), pa.array([seen[p][1] for p in part], pa.int64())], ["pattern", "clean", "toxic"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_toxic:
        return ToxicLexicon((), (), 1.0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    counted = sample.mapInArrow(count, "pattern string, clean bigint, toxic bigint").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = max(2, n_toxic // 500)
    rows = counted.withColumn("weight", odds).where((F.col("toxic") >= least) & (F.col("weight") > 2.0) & (F.col("toxic") >= 8 * F.col("clean"))).orderBy(F.desc("toxic"), "pattern").collect()
    weight = {r["pattern"]: float(r["weight"]) for r in rows}

    def hold(batches):
        for batch in batches:
            found = [sorted(p for p in _candidates(fold(t)) if p in weight) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["patterns"])

    left = [set(r[0]) for r in sample.where("toxic = 1").mapInArrow(hold, "patterns array<string>").collect()]
    kept: list[str] = []
    while left:
        cover = Counter(p for x in left for p in x)
        if not cover:
            break
        best = max(cover, key=lambda p: (cover[p], weight[p], len(p), p))
        if cover[best] < 2:
            break
        kept.append(best)
        left = [x for x in left if best not in x]
    # words that many toxic and no clean documents have, though the cover can do without them
    kept += [r["pattern"] for r in rows if r["pattern"].endswith(" ") and r["toxic"] * 10 >= n_toxic and not r["clean"] and not any(p in r["pattern"] for p in kept)]
    bare = ToxicLexicon(tuple((p, weight[p]) for p in sorted(kept)), (), 1.0)

    def contexts(batches):
        automaton = _automaton(bare)
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                folded, own = fold(text), set()
                for start, end, _ in matches(automaton, folded):
                    end = folded.index(" ", end - 1) + 1
                    before = folded.rfind(" ", 0, start)
                    after = folded.find(" ", end)
                    own.add(folded[start:end])
                    if before >= 0:
                        own.add(folded[before:end])
                    if after >= 0:
                        own.add(folded[start : after + 1])
                phrases = list(own)
                for i in range(0, len(phrases), 20_000):
                    part = phrases[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(part), pa.int32()), pa.array(part, pa.string())], ["toxic", "phrase"])

    seen = sample.mapInArrow(contexts, "toxic int, phrase string")
    spared = seen.groupBy("phrase").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).where("clean >= 2 and clean >= 4 * toxic").orderBy("phrase").collect()
    lexicon = ToxicLexicon(bare.patterns, tuple(r["phrase"] for r in spared), 1.0)

    def measure(batches):
        automaton = _automaton(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([density(automaton, t) for t in batch.column("text").to_pylist()], pa.float64())], ["toxic", "density"])

    points = sorted((r["density"], r["toxic"]) for r in sample.mapInArrow(measure, "toxic int, density double").collect())
    best, cut, hit, false = -1.0, 1.0, n_toxic, n_clean
    below = 0.0
    for value, toxic in points:  # everything from `value` on is called toxic
        if value > below:
            quality = 2 * hit / (hit + false + n_toxic) if hit else 0.0
            if quality > best:
                best, cut = quality, (value + below) / 2
        below = value
        hit, false = hit - toxic, false - (1 - toxic)
    return ToxicLexicon(lexicon.patterns, lexicon.exceptions, -math.log(1 - threshold) / cut)


def score_toxicity(docs: DataFrame, lexicon: ToxicLexicon, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, toxicity), or all columns and `toxicity` with `keep`: 0 without a match, towards 1 the more matches for the length.

    Null and empty texts score 0; texts are read whole; equal texts score alike; null ids and repeated rows are kept.
    Other columns stay; where one is named `toxicity`, the result's is `toxicity_`.
    """
    source = docs if keep else docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    text_at = text_col if keep else "text"
    columns = source.columns if keep else ["doc_id"]
    name = free_name("toxicity", columns)

    def run(batches):
        automaton = _automaton(lexicon)
        for batch in batches:
            score = [1 - math.exp(-lexicon.rate * density(automaton, t.as_py() or "")) for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score, pa.float64())], [*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in columns)
    return source.mapInArrow(run, f"{fields}, `{name}` double")
