"""Importance resampling towards a target: hashed runs of words, by an Aho-Corasick dictionary whose payloads compose."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, slices, utf8

#: Bytes between words become spaces; A-Z fold to a-z; digits, letters and all bytes beyond ASCII are words.
_TO = np.arange(256, dtype=np.uint8)
_TO[:48] = _TO[58:65] = _TO[91:97] = _TO[123:128] = 32
_TO[65:91] += 32
FOLD = _TO.tobytes()
#: Reversed polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320


def _doubled(columns: np.ndarray) -> np.ndarray:
    """The operator applied twice: a linear map of 32 bits, as the images of its bits."""
    bits = (columns[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits.astype(bool), columns[None, :], np.uint32(0)), axis=1)


def _zero_operators(n: int = 32) -> list[np.ndarray]:
    """For each power of two a (4, 256) table that carries a CRC over so many zero bytes, by the CRC's bytes."""
    columns = np.concatenate(([POLYNOMIAL], 1 << np.arange(31))).astype(np.uint32)  # one zero bit
    for _ in range(3):
        columns = _doubled(columns)
    out = []
    for _ in range(n):
        table = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            values = np.arange(256)
            table[bit // 8, (values >> (bit % 8)) & 1 == 1] ^= columns[bit]
        out.append(table)
        columns = _doubled(columns)
    return out


_ZEROS = _zero_operators()


def combine(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one behind the other, from either's CRC and the right one's size."""
    crc, power = left.astype(np.uint32), 0
    while (size >> power).any():
        moved = np.flatnonzero((size >> power) & 1)
        x, t = crc[moved], _ZEROS[power]
        crc[moved] = t[0, x & 255] ^ t[1, (x >> 8) & 255] ^ t[2, (x >> 16) & 255] ^ t[3, x >> 24]
        power += 1
    return crc ^ right.astype(np.uint32)


class WordDictionary:
    """Distinct words, each bounded by delimiters, in an automaton; payloads are CRC-32 alone and behind a space, and the size.

    It learns up to `most` words from the texts that it scans. A word that it lacks gets the same payload from its bytes,
    so that what it knows changes the time alone.
    """

    def __init__(self, most: int) -> None:
        import ahocorasick

        self.automaton, self.most, self.ids = ahocorasick.Automaton(), most, {}
        self.payloads = np.zeros((0, 3), np.int64)

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.ids][: self.most - len(self.ids)]
        if not new:
            return
        for w in new:
            self.automaton.add_word(f" {w.decode('latin-1')} ", len(self.ids))
            self.ids[w] = len(self.ids)
        self.payloads = np.concatenate([self.payloads, payloads(new)])
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and payloads (words, 3) of all words of a folded text that begins and ends with a space."""
        space = np.frombuffer(text, np.uint8) == 32
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        out, known = np.zeros((len(starts), 3), np.int64), np.zeros(len(starts), bool)
        if len(self.ids):
            pairs = np.array(list(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, pairs[:, 0])  # a match ends with the delimiter behind its word
            out[at], known[at] = self.payloads[pairs[:, 1]], True
        missing = np.flatnonzero(~known)
        if len(missing):
            words = [text[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            out[missing] = payloads(words)
            if len(self.ids) < self.most and len(missing) * 20 > len(starts):  # scans of much that is new teach it
                self.learn(words)
        return starts, out


def payloads(words: list[bytes]) -> np.ndarray:
    """(CRC-32, CRC-32 behind a space, bytes with the space) of each word."""
    lead = zlib.crc32(b" ")
    return np.array([(zlib.crc32(w), zlib.crc32(w, lead), len(w) + 1) for w in words], np.int64).reshape(-1, 3)


_DICTIONARY: dict[int, WordDictionary] = {}


def features(texts: list[bytes], longest: int, buckets: int, dictionary: WordDictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of all runs of 1 to `longest` words of each text, and each text's number of words."""
    folded = [b" " + t.translate(FOLD) + b" " for t in texts]
    offsets = np.cumsum([0, *map(len, folded)])
    starts, loads = dictionary.scan(b"".join(folded))
    owner = np.searchsorted(offsets, starts, "right") - 1
    crc, rows, found = loads[:, 0].astype(np.uint32), [owner], [loads[:, 0] % buckets]
    for n in range(2, longest + 1):  # a run and the word behind it compose to the run that is longer by one
        whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
        crc = combine(crc[: len(owner) - n + 1], loads[n - 1 :, 1], loads[n - 1 :, 2])
        rows.append(owner[n - 1 :][whole])
        found.append(crc[whole].astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(found), np.bincount(owner, minlength=len(texts))


def _scanned(batches: Iterator[pa.RecordBatch], longest: int, buckets: int, most: int):
    dictionary = _DICTIONARY.setdefault(most, WordDictionary(most))
    for batch in slices(batches):
        yield batch, *features(utf8(batch.column("text")), longest, buckets, dictionary)


def bucket_counts(texts: DataFrame, longest: int, buckets: int, most: int) -> np.ndarray:
    """How many features of all texts each bucket has: summed in every task, then per bucket; `buckets` rows come back."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, found, _ in _scanned(batches, longest, buckets, most):
            total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of a feature's smoothed share in the target over that in the source), by bucket; in doubles."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", dictionary_words: int = 100_000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): documents drawn without replacement by how much they resemble the target.

    Features are runs of 1 to `longest` words (ASCII letters in lower case, digits, bytes beyond ASCII), repeats counted,
    dealt into `buckets` by the CRC-32 of their words with one space between. A bucket's gain tells how much likelier it
    is in the target than in the documents; a document's weight is the floored mean of its features' gains, its score
    adds Gumbel noise from the hash of `seed` and its id. Of the N documents with `least_words` the floor(percent * N /
    100) with the highest scores are drawn and ranked from 1; others have a null rank.

    Words get their payloads from an automaton of up to `dictionary_words` words that each task's process learns while it
    scans; other words from their bytes, with the same result. All rows are counted. Null and empty texts have no
    features, weight 0 and are not drawn unless `least_words` is 0. Ties go to the smaller id, nulls last; a null id hashes
    like an empty one. Repeated rows are documents of their own. Without documents the result is empty, without target
    texts all its counts are 0. Texts are whole; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(source.select("text"), longest, buckets, dictionary_words), bucket_counts(target.select(F.col(target_text_col).alias("text")), longest, buckets, dictionary_words))

    def weigh(batches):
        for batch, rows, found, n_words in _scanned(batches, longest, buckets, dictionary_words):
            n = np.bincount(rows, minlength=len(n_words))
            total = np.zeros(len(n_words), np.int64)
            np.add.at(total, rows, gain[found])
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    weighed = source.mapInArrow(weigh, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed.withColumn("score", (F.col("weight") + noise).cast("bigint")))
    return _ranked(spark, scored, F.col("n_words") >= least_words, percent)


def _ranked(spark: SparkSession, scored: DataFrame, eligible, percent: int) -> DataFrame:
    """Ranks among all by score: documents per score are counted, and only those of one score are put in order together.

    Scores are whole numbers, the noise lies between -3,100 and 22,181 and a weight within some 88,000 of 0, so the counts
    that come to the driver are a bounded number whatever the documents' number.
    """
    counts = sorted(((r[0], r[1]) for r in scored.where(eligible).groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    above, starts = 0, []
    for score, n in counts:
        if above >= draw:
            break
        starts.append((score, above))
        above += n
    out = ["doc_id", "n_features", "weight", "score"]
    if not starts:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    least = starts[-1][0]
    high = scored.where(eligible & (F.col("score") >= least)).join(F.broadcast(spark.createDataFrame(starts, "score bigint, above bigint")), "score")
    nth = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    high = high.select(*out, F.when(nth <= draw, nth).cast("bigint").alias("rank"))
    return high.unionByName(scored.where(~eligible | (F.col("score") < least)).select(*out, F.lit(None).cast("bigint").alias("rank")))
