"""Removal of repeated byte strings by enhanced suffix arrays over content-chosen anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BYTE_CODES, ODD, U64, by_key, discard, free_name, group_bounds, materialize, mix, slices, utf8

#: Bytes of an anchor.
ANCHOR = 64


def _extreme(x: np.ndarray, width: int, pick, rest) -> np.ndarray:
    """pick (minimum or maximum) of each run of `width` values; runs past the end are filled with `rest`."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        more = np.full(len(x), rest, x.dtype)
        more[: len(x) - step] = out[step:]
        out, done = pick(out, more), done + step
    return out


def anchor_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place, by doubling, folded at each step so that no pattern cancels out (void near the end)."""
    out = BYTE_CODES[buf]
    width = 1
    while width < ANCHOR:
        if width < len(out):
            both = out[:-width] * ODD
            both += out[width:]
            both ^= both >> U64(32)
            out[:-width] = both
        width *= 2
    return out


def find_anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, two halves of a digest of the context) of the anchors.

    An anchor is a place whose hash is the least of all places within some window of `length` bytes (ties: all of
    them), so equal windows have equal anchors at equal distances. Its context is all that such windows can cover.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    starts = ends - size
    reach = length - ANCHOR
    data = b"".join(texts)
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), np.zeros((0, 2), np.uint64)
    text = np.repeat(np.arange(len(texts)), size)
    left = ends[text] - np.arange(len(buf))  # bytes from here to the text's end
    raw = anchor_hashes(buf)
    key = (mix(raw) >> U64(32)).astype(np.uint32) | np.uint32(1)
    key[left < ANCHOR] = np.uint32(0xFFFFFFFF)
    least = _extreme(key, reach + 1, np.minimum, np.uint32(0xFFFFFFFF))
    least[left < length] = 0
    most = _extreme(least[::-1], reach + 1, np.maximum, np.uint32(0))[::-1]
    at = np.flatnonzero((most == key) & (left >= ANCHOR))
    own = text[at]
    a, b = np.maximum(starts[own], at - reach), np.minimum(ends[own], at + length)
    context = [hashlib.blake2b(data[x:y], digest_size=16, salt=z.to_bytes(4, "little")).digest() for x, y, z in zip(a.tolist(), b.tolist(), (at - a).tolist(), strict=True)]
    return own, at - starts[own], mix(raw[at]), np.frombuffer(b"".join(context), np.uint64).reshape(-1, 2)


def _rows(parts: list[bytes], width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A byte matrix of strings, filled with 0, and their lengths."""
    if backwards:
        parts = [p[::-1] for p in parts]
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), np.fromiter(map(len, parts), np.int64, len(parts))


def _common(m: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of rows i and j."""
    differ = m[i] != m[j]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(size[i], size[j]))


def _sorted(keys: np.ndarray, m: np.ndarray) -> np.ndarray:
    whole = np.concatenate([keys.astype(">u8").view(np.uint8).reshape(-1, 8), m], axis=1)
    return np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel(), kind="stable")


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Nodes (first, last, common prefix) of the common-prefix interval tree, by a stack scan over neighbours' prefixes."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > value:
            prefix, first = stack.pop()
            yield first, i - 1, prefix
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def extend(keys: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix (an anchor and what follows, `right`) the bytes before and after its place that repeats cover; 0, 0 if none.

    The suffixes of a key form an enhanced suffix array. Each node of its interval tree is a set of suffixes with a
    common prefix; where what precedes them differs (left-extension diversity) each suffix extends to the left as far
    as any other of the node, its neighbour in the order of the texts read backwards. Nodes of which prefix and
    extension make up `length` bytes are repeats, with all their occurrences. Windows begin lo to hi bytes before.
    """
    n = len(keys)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return before, after
    reach = length - ANCHOR
    r, r_size = _rows(right, length)
    l, l_size = _rows(left, max(1, reach), True)  # noqa: E741
    order = _sorted(keys, r)
    rank = np.empty(n, np.int64)
    rank[_sorted(keys, l)] = np.arange(n)
    bounds = group_bounds(keys[order])
    lcp = _common(r, r_size, order[:-1], order[1:])

    def cover(members: np.ndarray, prefix, extension: np.ndarray) -> None:
        longest = np.minimum(extension, hi[members])
        shown = np.minimum(prefix, length - lo[members])
        fine = longest + shown >= length
        members = members[fine]
        before[members] = np.maximum(before[members], longest[fine])
        after[members] = np.maximum(after[members], shown[fine])

    sizes = np.diff(bounds)
    pairs = bounds[:-1][sizes == 2]
    if len(pairs):
        i, j = order[pairs], order[pairs + 1]
        extension = _common(l, l_size, i, j)
        cover(i, lcp[pairs], extension)
        cover(j, lcp[pairs], extension)
    for a, b in zip(bounds[:-1][sizes > 2], bounds[1:][sizes > 2], strict=True):
        for first, last, prefix in prefix_intervals(lcp[a : b - 1].tolist()):
            if prefix < ANCHOR:
                continue
            members = order[a + first : a + last + 1]
            members = members[np.argsort(rank[members])]
            shared = _common(l, l_size, members[:-1], members[1:])
            extension = np.zeros(len(members), np.int64)
            extension[1:] = shared
            extension[:-1] = np.maximum(extension[:-1], shared)
            cover(members, prefix, extension)
    return before, after


#: Parts into which the rows of an anchor that a sample finds often are dealt.
SALTS = 64


def _often(texts: DataFrame, length: int, sample_docs: int) -> np.ndarray:
    """Sorted hashes of anchors that many documents of a bounded sample hold; they only decide how rows are dealt out."""
    count = texts.count()
    step = max(1, -(-count // sample_docs))

    def spread(batches):
        for batch in slices(batches):
            own, _, anchor, _ = find_anchors(utf8(batch.column("text")), length)
            pairs = np.unique(np.stack([own.astype(np.uint64), anchor]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], ["h"])

    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).mapInArrow(spread, "h bigint")
    often = sampled.groupBy("h").count().where(F.col("count") >= max(8, min(count, sample_docs) // 200)).orderBy(F.desc("count"), "h").limit(50_000)
    return np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int = 200, group_rows: int = 4096, sample_docs: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, marks) and (doc_id, starts, ends): what repeats of `length` bytes cover, as marked anchors and as spans.

    1. Anchors of all texts, dealt out by hash, those that a bounded sample finds often in parts that are then summed.
       Where a whole context occurs again, all windows round it are repeats: mark 1. Where contexts of an anchor differ,
       one occurrence of each (mark 2) is sent on with its context.
    2. The contexts of each anchor go through `extend`. An anchor with over `group_rows` contexts is first divided by
       the bytes that all windows of a half have in common, again and again: occurrences with all bytes of the half
       alike are repeats and one of them stays for the others, one without company is none, and small groups go on.
    """
    reach = length - ANCHOR
    texts = docs.where(docs[id_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    often = _often(texts, length, sample_docs)

    def find(batches):
        for batch in slices(batches):
            own, place, anchor, context = find_anchors(utf8(batch.column("text")), length)
            order = np.lexsort((place, context[:, 1], context[:, 0], anchor, own))
            own, place, anchor, context = own[order], place[order], anchor[order], context[order]
            new = np.ones(len(own) + 1, bool)  # a text that repeats a context has one row for it
            new[1:-1] = (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]).any(axis=1)
            bounds = np.flatnonzero(new)
            at, times = bounds[:-1], np.diff(bounds)
            rest: list = [None] * len(at)
            for i in np.flatnonzero(times > 1).tolist():
                rest[i] = place[at[i] + 1 : at[i] + times[i]]
            ids = batch.column("doc_id").to_numpy()[own[at]]
            part = np.where(np.isin(anchor[at], often), 1 + ids % SALTS, 0).astype(np.int32)
            halves = [pa.array(np.ascontiguousarray(context[at, k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(part), *halves, pa.array(ids), pa.array(place[at].astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(rest, pa.list_(pa.int64()))], ["h", "part", "c1", "c2", "doc_id", "pos", "times", "rest"])

    seen = texts.mapInArrow(find, "h bigint, part int, c1 bigint, c2 bigint, doc_id bigint, pos int, times int, rest array<bigint>").repartition("h", "part")
    whole = "over (partition by h, part, c1, c2 order by doc_id, pos"
    seen = seen.selectExpr("*", f"sum(times) {whole} rows between unbounded preceding and unbounded following) as same", f"row_number() {whole}) as nth")
    seen = seen.selectExpr("*", "sum(int(nth = 1)) over (partition by h, part) as kinds")
    seen = materialize(seen.where("part > 0 or same >= 2 or kinds > 1").drop("times"))
    parts = seen.where("part > 0 and nth = 1").groupBy("h", "c1", "c2").agg(F.sum("same").alias("same"), F.min(F.struct("doc_id", "pos")).alias("first"))
    parts = materialize(parts)
    kinds = parts.groupBy("h").agg(F.count("*").alias("kinds"))
    summed = parts.join(kinds, "h").where("same >= 2 or kinds > 1")
    columns = ["doc_id", "pos", "rest", "same", "kinds", "first"]
    hot = seen.where("part > 0").drop("same", "kinds", "nth").join(summed, ["h", "c1", "c2"]).withColumn("first", F.expr("first = struct(doc_id, pos)")).select(columns)
    seen = seen.where("part = 0").withColumn("first", F.expr("nth = 1")).select(columns).unionByName(hot)
    mark = f"int(same >= 2) + 2 * int(kinds > 1 and first) + 4 * int(kinds > {group_rows})"
    marks = materialize(seen.selectExpr("doc_id", f"concat(array(bigint(pos) * 8 + {mark}), coalesce(transform(rest, p -> p * 8 + 1), array())) as mark").groupBy("doc_id").agg(F.flatten(F.collect_list("mark")).alias("marks")))

    def send(batches):
        names = ["key", "doc_id", "pos", "wanted", "lo", "hi", "lefts", "rights", "big"]
        for batch in slices(batches):
            key, doc, pos, wanted, lefts, rights, big = [], [], [], [], [], [], []
            for i, data in enumerate(utf8(batch.column("text"))):
                m = batch.column("marks")[i].values.to_numpy()
                m = m[m & 2 > 0]
                at = m >> 3
                at, m = at[at + ANCHOR <= len(data)], m[at + ANCHOR <= len(data)]
                if not len(at):
                    continue
                buf = np.frombuffer(data, np.uint8)
                key.append(mix(anchor_hashes(buf[at[:, None] + np.arange(ANCHOR)].ravel())[::ANCHOR]))
                doc += [batch.column("doc_id")[i].as_py()] * len(at)
                pos += at.tolist()
                wanted += (m & 1 == 0).tolist()
                big += (m & 4 > 0).tolist()
                lefts += [data[max(0, p - reach) : p] for p in at.tolist()]
                rights += [data[p : p + length] for p in at.tolist()]
            if key:
                n = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(wanted), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, reach, np.int32)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(big)], names)

    fields = "key bigint, doc_id bigint, pos int, wanted boolean, lo int, hi int, lefts binary, rights binary"
    contexts = texts.join(marks.where("exists(marks, m -> m & 2 > 0)"), "doc_id").mapInArrow(send, f"{fields}, big boolean")
    contexts = materialize(contexts)
    ready, big = contexts.where("not big").drop("big"), contexts.where("big").drop("big")
    resolved = []
    while not big.isEmpty():
        halves = big.withColumn("part", F.explode(F.expr("case when lo = hi then array(named_struct('lo', lo, 'hi', hi)) else array(named_struct('lo', lo, 'hi', (lo + hi) div 2), named_struct('lo', (lo + hi) div 2 + 1, 'hi', hi)) end")))
        halves = halves.withColumns({"lo": F.col("part.lo"), "hi": F.col("part.hi")}).drop("part")
        far, near = "least(hi, length(lefts))", f"least({length} - lo, length(rights))"
        halves = halves.where(f"length(lefts) >= lo and length(rights) >= {length} - hi and {far} + {near} >= {length}")
        halves = halves.withColumn("key", F.expr(f"xxhash64(key, lo, hi, substring(lefts, length(lefts) - lo + 1, lo), substring(rights, 1, {length} - hi))"))
        halves = halves.withColumn("all", F.expr(f"struct({far} as far, {near} as near, sha2(concat(substring(lefts, length(lefts) - {far} + 1, {far}), substring(rights, 1, {near})), 256) as bytes)"))
        all_halves = materialize(halves)
        all_kinds = materialize(all_halves.groupBy("key", "all").agg(F.count("*").alias("same"), F.min(F.struct("doc_id", "pos")).alias("first")))
        groups = materialize(all_kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("same").alias("members")).where("members > 1"))
        kinds = materialize(all_kinds.join(groups, "key"))
        halves = materialize(all_halves.join(kinds, ["key", "all"]))
        discard(all_halves, all_kinds, groups, kinds)
        resolved.append(halves.where("same > 1 and wanted").selectExpr("doc_id", f"pos - {far} as start", f"pos + {near} as end"))
        halves = halves.where("kinds > 1 and first = struct(doc_id, pos)").withColumn("wanted", F.expr("wanted and same = 1"))
        ready = ready.unionByName(halves.where(f"kinds <= {group_rows}").select(ready.columns))
        big = halves.where(f"kinds > {group_rows}").select(ready.columns)

    def scan(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {c: table.column(c) for c in ("key", "doc_id", "pos", "lo", "hi", "wanted")}
        columns = {c: x.to_numpy() for c, x in columns.items()}
        before, after = extend(columns["key"].view(np.uint64), table.column("lefts").to_pylist(), table.column("rights").to_pylist(), columns["lo"], columns["hi"], length)
        hit = np.flatnonzero((after > 0) & columns["wanted"])
        pos = columns["pos"][hit].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(columns["doc_id"][hit]), pa.array((pos - before[hit]).astype(np.int32)), pa.array((pos + after[hit]).astype(np.int32))], ["doc_id", "start", "end"])

    spans = by_key(ready, "key", scan, "doc_id bigint, start int, end int", rows=8000)
    for more in resolved:
        spans = spans.unionAll(more)
    spans = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return marks.select("doc_id", F.expr("filter(marks, m -> m & 1 > 0)").alias("marks")).where("size(marks) > 0"), spans


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, digest: bool = False, group_rows: int = 4096) -> DataFrame:
    """All columns and `kept` (binary: the bytes that stay); with `digest` (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    A byte of a text's UTF-8 goes if a string of `length` bytes that covers it starts anywhere else, in the same
    document too; strings are judged on the input, and every occurrence goes, the first included. Null texts are
    empty. Rows whose id is null keep their bytes and take no part. A repeated row is a copy like any other; ids name
    one text, so rows of one id with different texts are judged by all of that id's spans. Other columns stay; where
    one is named `kept`, the result's is `kept_`.
    """
    marks, spans = repeated_spans(docs, id_col, text_col, length, group_rows)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")) if digest else docs
    key, text_at = ("doc_id", "text") if digest else (id_col, text_col)
    columns = source.columns
    kept_at = free_name("kept", columns)
    same, own, other, mark_at, start_at, end_at = (free_name(x, columns) for x in ("_s_id", "_s_marked", "_s_spanned", "_s_marks", "_s_starts", "_s_ends"))
    keyed = source.withColumn(same, source[key].cast("bigint"))
    marks, spans = marks.toDF(own, mark_at), spans.toDF(other, start_at, end_at)
    joined = keyed.join(marks, keyed[same] == marks[own], "left").join(spans, keyed[same] == spans[other], "left").drop(same, own, other)
    reach = length - ANCHOR

    def gone(n: int, row_marks, starts, ends) -> np.ndarray:
        edge = np.zeros(n + 1, np.int32)
        if row_marks.is_valid:
            at = row_marks.values.to_numpy() >> 3
            np.add.at(edge, np.clip(at - reach, 0, n), 1)
            np.add.at(edge, np.clip(at + length, 0, n), -1)
        if starts.is_valid:
            np.add.at(edge, np.clip(starts.values.to_numpy(), 0, n), 1)
            np.add.at(edge, np.clip(ends.values.to_numpy(), 0, n), -1)
        return np.cumsum(edge[:-1]) > 0

    def run(batches):
        for batch in slices(batches, text_at):
            rows = []
            for data, m, s, e in zip(utf8(batch.column(text_at)), batch.column(mark_at), batch.column(start_at), batch.column(end_at), strict=True):
                if not m.is_valid and not s.is_valid:
                    rows.append((len(data), 0, 0, data))
                    continue
                out = gone(len(data), m, s, e)
                runs = int(np.count_nonzero(out[1:] & ~out[:-1])) + int(out[:1].sum())
                rows.append((len(data), int(out.sum()), runs, np.frombuffer(data, np.uint8)[~out].tobytes()))
            n, removed, runs, kept = zip(*rows, strict=True)
            if digest:
                sha = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(kept, pa.binary())], [*columns, kept_at])

    kind = source.schema[key].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" if digest else ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), f"`{kept_at}` binary"])
    return joined.mapInArrow(run, fields)
