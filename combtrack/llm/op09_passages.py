"""Removal of passages that an earlier document holds, by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ODD, U64, free_name, materialize, mix, rolled, slices, utf8, words

#: For each period residues among whose differences every residue of the period occurs.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
_EDGE = U64(0x5851F42D4C957F2D)


class Anchors:
    """The anchors of many texts: at each cover position a hash of window - period + 1 words and, extended from it, of its context.

    Two equal windows, wherever they begin, both have a cover position within their first `period` words and at the
    same distance from their beginnings; so an anchor of window - period + 1 words there lies in both. The context of
    an anchor is all that such windows can hold, `period` - 1 words to either side (beyond a text's ends: a mark).
    Where contexts are equal, so are all windows round the anchors.
    """

    def __init__(self, texts: list[bytes], window: int, period: int) -> None:
        self.window, self.period = window, period
        self.size, self.reach = window - period + 1, period - 1
        self.lanes, self.offsets = words(texts)
        self.count = np.diff(self.offsets)
        text = np.repeat(np.arange(len(texts)), self.count)
        place = np.arange(self.lanes.shape[1]) - self.offsets[:-1][text]
        covered = np.zeros(period, bool)
        covered[list(COVERS[period])] = True
        at = np.flatnonzero(covered[place % period] & (place + self.size <= self.count[text]) & (self.count[text] >= window))
        self.text, self.place = text[at], place[at]
        wide = np.full((2, len(text) + 2 * self.reach * len(texts)), _EDGE)
        moved = np.arange(len(text)) + self.reach * (2 * text + 1)
        wide[:, moved] = self.lanes
        begin = moved[at] - self.reach
        self.context = [rolled(lane, self.size + 2 * self.reach)[begin] for lane in wide]
        self.hash = rolled(self.lanes[0], self.size)[at]

    def among(self, marks: list[np.ndarray]) -> np.ndarray:
        """Which anchors have a context that their text's marks name."""
        bounds = np.searchsorted(self.text, np.arange(len(marks) + 1))
        return np.concatenate([np.isin(self.context[0][a:b], m) for a, b, m in zip(bounds[:-1], bounds[1:], marks, strict=True)]) if marks else np.zeros(0, bool)

    def around(self, which: np.ndarray, words_too: bool) -> np.ndarray:
        """Flags of the places at which windows that hold these anchors begin, or of all words that they cover."""
        edge = np.zeros(self.lanes.shape[1] + 1, np.int32)
        text, place = self.text[which], self.place[which]
        first = np.maximum(place - self.reach, 0)
        last = np.minimum(place, self.count[text] - self.window) + (self.window if words_too else 1)
        np.add.at(edge, self.offsets[text] + first, 1)
        np.add.at(edge, self.offsets[text] + last, -1)
        return np.cumsum(edge[:-1]) > 0

    def windows(self) -> list[np.ndarray]:
        """Two hashes of the window that begins at each place."""
        return [rolled(lane, self.window) for lane in self.lanes]


def _distinct(text: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Positions of the first row of each text with a key (its first part decides)."""
    order = np.lexsort((keys[0], text))
    new = np.ones(len(order), bool)
    new[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (text[order][1:] != text[order][:-1])
    return order[new]


def _earliest(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows have the smallest id of all rows with their keys."""
    order = np.lexsort((ids, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    low = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = ids[order] == low
    return out


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], rows: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """Puts parts (arrays of one length each) together until they hold so many rows."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for part in parts:
        held.append(part)
        count += len(part[0])
        if count >= rows:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, count = [], 0
    if count:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _marks(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in column]


def often_seen(texts: DataFrame, window: int, period: int, sample_docs: int) -> np.ndarray:
    """Anchors that many documents of a sample hold, sorted; at most 100,000, which only decides how rows are dealt out."""
    count = texts.count()

    def spread(batches):
        for batch in slices(batches):
            found = Anchors(utf8(batch.column("text")), window, period)
            yield pa.RecordBatch.from_arrays([_signed(found.hash[_distinct(found.text, found.hash)])], ["anchor"])

    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-count // sample_docs)))) == 0)
    often = sampled.mapInArrow(spread, "anchor bigint").groupBy("anchor").count().where(F.col("count") >= max(8, min(count, sample_docs) // 500))
    return np.sort(np.array([r[0] for r in often.orderBy(F.desc("count"), "anchor").limit(100_000).collect()], np.int64).view(np.uint64))


def repeated_windows(texts: DataFrame, window: int = 50, period: int = 31, sample_docs: int = 4000) -> DataFrame:
    """(_p_id, _p_whole, _p_windows): for each doc_id the contexts, and beyond them the windows, that documents of smaller id hold too.

    Contexts are compared first, by 128 bits of their words. One that a smaller id has repeats as a whole. Only the
    first of each of several contexts of an anchor needs more: its windows are compared with the others'.

    No key gathers its rows: a row that meets one of a smaller id in its own task is settled there and dealt out by a
    hash of itself, so a passage gives one row for each million; and an anchor that a bounded sample (`sample_docs`)
    finds often counts as one of several contexts unseen, so its rows are dealt out by their contexts.
    """
    named = texts.where("doc_id is not null")
    often = often_seen(named, window, period, sample_docs)

    def find(batches):
        def parts():
            for batch in slices(batches):
                found = Anchors(utf8(batch.column("text")), window, period)
                own = _distinct(found.text, found.context[0])
                yield found.hash[own], found.context[0][own], found.context[1][own], batch.column("doc_id").to_numpy()[found.text[own]]

        for anchor, c1, c2, ids in _gathered(parts()):
            first = _earliest(ids, c2, c1)
            anchor = np.where(np.isin(anchor, often), c1, anchor)
            anchor = np.where(first, anchor, mix(c1 + ids.view(np.uint64) * ODD))
            yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(c1), pa.array(c2.view(np.int64), mask=~first), pa.array(ids)], ["anchor", "c1", "c2", "doc_id"])

    def compare(batches):
        def parts():
            for batch in slices(batches):
                hit = np.flatnonzero(batch.column("some").is_valid().to_numpy(zero_copy_only=False))
                if not len(hit):
                    continue
                batch = batch.take(pa.array(hit))
                found = Anchors(utf8(batch.column("text")), window, period)
                at = np.flatnonzero(found.around(found.among(_marks(batch.column("some"))), False))
                owner = np.searchsorted(found.offsets, at, "right") - 1
                w1, w2 = (w[at] for w in found.windows())
                own = _distinct(owner, w1)
                yield w1[own], w2[own], batch.column("doc_id").to_numpy()[owner[own]]

        for w1, w2, ids in _gathered(parts()):
            first = _earliest(ids, w2, w1)
            w2 = np.where(first, w2, mix(w1 + ids.view(np.uint64) * ODD))
            yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), pa.array(ids), pa.array(~first)], ["w1", "w2", "doc_id", "settled"])

    # settled rows have no c2, those of anchors seen often have their context for an anchor
    seen = named.mapInArrow(find, "anchor bigint, c1 bigint, c2 bigint, doc_id bigint").repartition("anchor")
    seen = seen.selectExpr("*", "min(doc_id) over (partition by anchor, c1, c2) as low", "min(c1) over (partition by anchor) as c0", "max(c1) over (partition by anchor) as c9")
    seen = seen.where("c2 is null or low < doc_id or anchor = c1 or c0 <> c9").selectExpr("doc_id", "c2 is null or low < doc_id as whole", "c1")
    marks = seen.groupBy("doc_id").agg(F.expr("collect_list(c1) filter (where whole)").alias("whole"), F.expr("collect_list(c1) filter (where not whole)").alias("some"))
    marks = marks.selectExpr("doc_id as _p_id", "whole as _p_whole", "if(size(some) = 0, null, some) as some")
    marks = materialize(marks)
    held = texts.join(marks.select("_p_id", "some"), texts["doc_id"] == marks["_p_id"], "left").select("doc_id", "text", "some")
    held = held.mapInArrow(compare, "w1 bigint, w2 bigint, doc_id bigint, settled boolean")
    held = held.selectExpr("w1", "doc_id", "settled", "min(doc_id) over (partition by w1, w2) as low")
    held = held.where("settled or low < doc_id").groupBy(F.col("doc_id").alias("_w_id")).agg(F.collect_set("w1").alias("_p_windows"))
    return marks.drop("some").join(held, marks["_p_id"] == held["_w_id"], "full").selectExpr("coalesce(_p_id, _w_id) as _p_id", "_p_whole", "_p_windows")


def repeated_words(texts: list[bytes], whole: pa.Array, windows: pa.Array, window: int, period: int) -> list[np.ndarray | None]:
    """For each text flags of the words that go, None where none do."""
    whole, windows = _marks(whole), _marks(windows)
    hit = [i for i in range(len(texts)) if len(whole[i]) or len(windows[i])]
    out: list[np.ndarray | None] = [None] * len(texts)
    if not hit:
        return out
    found = Anchors([texts[i] for i in hit], window, period)
    gone = found.around(found.among([whole[i] for i in hit]), True)
    first = found.windows()[0]
    for k, i in enumerate(hit):
        a, b = found.offsets[k], found.offsets[k + 1]
        own = gone[a:b]
        if len(windows[i]) and b - a >= window:
            own = own | _spread(np.flatnonzero(np.isin(first[a : b - window + 1], windows[i])), window, b - a)
        out[i] = own if own.any() else None
    return out


def _spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places the runs of `length` from `starts` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31, digest: bool = False) -> DataFrame:
    """All columns with the text's kept words joined by one space; with `digest` (doc_id, n_words, n_removed, kept_sha256).

    A word goes if a window of `window` words of its document that covers it also starts in a document with a smaller
    id; windows are judged on the input. A document of which nothing goes keeps its text as it is. Null texts stay
    null (digest: no words). Rows whose id is null keep their text and take no part; rows that repeat an id don't
    remove each other's words. Texts of fewer than `window` words stay as they are. Other columns are kept, whatever
    their names.
    """
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    marks = repeated_windows(texts, window, period)
    if digest:
        source, key, text_at = texts, "doc_id", "text"
    else:
        source, key, text_at = docs, id_col, text_col
    columns = source.columns
    own, whole, windows = (free_name(x, columns) for x in ("_p_id", "_p_whole", "_p_windows"))
    marks = marks.toDF(own, whole, windows)
    joined = source.join(marks, source[key].cast("bigint") == marks[own], "left").drop(own)

    def run(batches):
        for batch in slices(batches, text_at):
            texts = utf8(batch.column(text_at))
            gone = repeated_words(texts, batch.column(whole), batch.column(windows), window, period)
            if digest:
                rows = []
                for text, g in zip(texts, gone, strict=True):
                    own = text.split()
                    kept = own if g is None else [w for w, x in zip(own, g.tolist(), strict=True) if not x]
                    rows.append((len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                n, r, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                new = batch.column(text_at).to_pylist()
                for i, g in enumerate(gone):
                    if g is not None:
                        new[i] = b" ".join([w for w, x in zip(texts[i].split(), g.tolist(), strict=True) if not x]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text_at else batch.column(c) for c in columns], columns)

    fields = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" if digest else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return joined.mapInArrow(run, fields)
