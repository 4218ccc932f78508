"""Benchmark decontamination: a prefix-filtered set join of shingles, verified over windows as long as an item's."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize

#: Words are runs of ASCII digits, ASCII letters and everything beyond ASCII; text is lower-cased in A-Z alone.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and items up to so many bytes are broadcast; larger ones meet the documents by a shuffled join over SALTS.
BROADCAST_BYTES, SALTS = 8 << 20, 32
#: Bits of the filter row: 16 for each shingle between these bounds. A fuller one lets more shingles through to the join.
LEAST_BITS, MOST_BITS = 1 << 14, 1 << 22


def words_of(text: Column) -> Column:
    """The lower-cased words; null has none."""
    ascii_only = F.length(text) == F.octet_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, size: int) -> Column:
    """A 64-bit number of the `size` words from `at` on; equal numbers are compared by their words later."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size)))


def _positions(words: Column, size: int) -> Column:
    """0 to the last place where a shingle of `size` words begins."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))


def _shingles(words: Column, size: int) -> Column:
    """(at, h) of all shingles of `size` words."""
    return F.transform(_positions(words, size), lambda at: F.struct(at.alias("at"), _shingle(words, at, size).alias("h")))


def _filter_row(shingles: DataFrame, count: int) -> tuple[DataFrame, int]:
    """One row with a bitmap of at most MOST_BITS of the column `h`, and by how many bits a shingle's number is shifted to find its place."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * max(1, count)))))
    shift = 64 - (bits.bit_length() - 1) + 6  # the highest bits tell the array's element, the lowest 6 the bit in it
    marks = shingles.groupBy(F.shiftrightunsigned("h", shift).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    dense = shingles.sparkSession.range(bits // 64).join(marks, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("marks")), shift


def _marked(marks: Column, h: Column, shift: int) -> Column:
    return F.getbit(F.get(marks, F.shiftrightunsigned(h, shift).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _meet(many: DataFrame, few: DataFrame, key: str, small: bool) -> DataFrame:
    """Equi-join of the documents' rows with the items'; a key that a third of the documents hold is dealt over SALTS tasks."""
    if small:
        return many.join(F.broadcast(few), key)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items): where the items' windows occur in each document, and whose they are.

    An item's windows are all runs of `window` of its words; an item of fewer words, but not none, is one window. `spans`
    are the maximal runs [start, end) of document words inside occurrences of windows, `items` the ids of the items whose
    windows occur, as sorted strings.

    A window is the set of its shingles of `shingle` words (of all its words, if it has fewer), and a document must
    contain all of them, so the necessary prefix of a window, in the order of rarity, is its rarest shingle. 1. All
    documents' shingles that items have are counted; windows with one that never occurs can't occur. 2. Documents meet
    windows by the rarest shingle alone. 3. The shingle's place in the window tells where the window would begin; it must
    begin and end within the document. 4. The words there are compared with the window's. A bitmap of bounded size, sent
    to all tasks as one row, leaves out most other shingles before the join.

    Null and empty texts have no words; an item without words has no window. Windows of a null item id mark words, but
    it is in no list. Rows that repeat an item id add windows to it. Every row of documents gives one row, repeated and
    null ids too. Without items or documents all is empty. Very long texts are whole; other columns are not read.
    """
    if not 1 <= shingle <= window:
        raise ValueError("a shingle has 1 to `window` words")
    item_words = items.select(F.col(item_id_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = item_words.withColumn("n", length).select("item", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"))
    owned = materialize(starts.select("item", "n", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("w")).distinct())
    windows = materialize(owned.select("w", "n").distinct())
    n_windows, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("w") + 64), F.lit(0))).first()
    owned_bytes = owned.agg(F.coalesce(F.sum(F.octet_length("w") + 64), F.lit(0))).first()[0]
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect())  # at most `shingle` numbers

    own = F.split("w", " ", -1)
    parts = [_shingles(own, k) for k in sizes]
    of_size = F.lit(None)
    for k, part in zip(sizes, parts, strict=True):
        of_size = F.when(F.least("n", F.lit(shingle)) == k, part).otherwise(of_size)
    small = n_bytes * window <= BROADCAST_BYTES
    source = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.concat_ws(" ", F.col(id_col).cast("string"), F.col(text_col)).cast("binary")).alias("row"), words_of(F.col(text_col)).alias("words"))
    if n_windows:
        shingles = materialize(windows.select("w", "n", F.inline(of_size)))
        known = materialize(shingles.select("h").distinct())
        marks, shift = _filter_row(known, known.count())
        words = F.col("words")

        def marked(k: int, shift: int) -> Column:
            return F.filter(_shingles(words, k), lambda x: _marked(F.col("marks"), x["h"], shift))

        every = F.concat(*(F.transform(marked(k, shift), lambda x: x["h"]) for k in sizes))
        seen = _meet(source.crossJoin(F.broadcast(marks)).select("row", F.explode(every).alias("h")), known, "h", small).groupBy("h").agg(F.count("*").alias("seen"))
        rarity = shingles.join(materialize(seen), "h", "left").groupBy("w", "n").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "at")).alias("rarest"))
        prefixes = materialize(rarity.where("rarest.seen > 0").select("w", "n", "rarest.h", "rarest.at"))
        marks, shift = _filter_row(prefixes, prefixes.count())

        def candidates(k: int) -> Column:
            back = F.lit(window - k)
            return F.transform(marked(k, shift), lambda x: F.struct(x["at"].alias("pos"), x["h"].alias("h"), F.slice(words, F.greatest(x["at"] - back, F.lit(0)) + 1, F.lit(2 * window - k)).alias("context"), F.least(x["at"], back).alias("before")))

        read = materialize(source.crossJoin(F.broadcast(marks)).select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), F.concat(*map(candidates, sizes)).alias("found")))
        met = _meet(read.where(F.size("found") > 0).select("row", "n_words", F.inline("found")), prefixes, "h", small)
        start = F.col("pos") - F.col("at")
        within = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
        same = F.array_join(F.slice("context", F.greatest(F.col("before") - F.col("at"), F.lit(0)) + 1, F.col("n")), " ") == F.col("w")
        places = materialize(met.where(within & same).select("row", start.alias("start"), (start + F.col("n")).alias("end"), "w"))
    else:
        read = source.select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"))
        places = docs.sparkSession.createDataFrame([], "row string, start int, end int, w string")

    by_place = Window.partitionBy("row").orderBy("start")
    reach = places.groupBy("row", "start").agg(F.max("end").alias("end"))
    reach = reach.withColumn("before", F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
    reach = reach.withColumn("nth", F.sum((F.col("before").isNull() | (F.col("start") > F.col("before"))).cast("int")).over(by_place))
    runs = reach.groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    held = _meet(places.select("row", "w").distinct(), owned.where("item is not null").select("w", "item"), "w", owned_bytes <= BROADCAST_BYTES)
    held = held.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = read.select("doc_id", "row", "n_words").join(spans.join(held, "row", "left"), "row", "left")
    out = out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    if n_windows:
        discard(shingles, known)
    return out


def leak_digests(docs: DataFrame, items: DataFrame, window: int = 10, **names) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): `find_leaks` in numbers; all as its docstring says."""
    found = find_leaks(docs, items, window, **names)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    found = found.withColumn("n_hit", hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
