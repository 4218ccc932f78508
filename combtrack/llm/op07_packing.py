"""Packing token ids into sequences, best fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_key, group_bounds
from ._pieces import text_encoder


class CapacityTree:
    """Segment tree over remaining capacities: how many open windows have each; finds the tightest that holds a length."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (window, capacity) of the least capacity of at least `length`."""
        at = length + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[capacity].pop(), capacity


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of items; each item of at most `size`, longest first, goes into the tightest open window."""
    tree, windows = CapacityTree(size), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item])
        window, capacity = found or (len(windows), size)
        if not found:
            windows.append([])
        windows[window].append(item)
        if capacity > lengths[item]:
            tree.add(window, capacity - lengths[item])
    return windows


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start in the item, length); at most one isn't full.

    Best fit decreasing first; what the emptiest windows hold is then cut to fill the gaps of the others.
    """
    windows = [[(i, 0, lengths[i]) for i in w] for w in best_fit(lengths, size)]
    fill = [sum(x[2] for x in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: (-fill[i], i))
    keep = max(0, -(-sum(fill) // size) - 1)
    loose = [x for i in order[keep:] for x in windows[i]]
    for i in order[:keep]:
        while fill[i] < size:
            item, start, length = loose.pop()
            part = min(length, size - fill[i])
            windows[i].append((item, start, part))
            fill[i] += part
            if part < length:
                loose.append((item, start + part, length - part))
    return [windows[i] for i in order[:keep]] + ([loose] if loose else [])


def _narrow(ids: bytes) -> bytes:
    """Little-endian 32-bit ids in 16 bits each where all fit."""
    x = np.frombuffer(ids, "<u4")
    return x.astype("<u2").tobytes() if x.max(initial=0) < 1 << 16 else ids


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def pack_tokens(docs: DataFrame, tokenizer: str, end_id: int, pattern: str | None = None, size: int = 1024, shard_docs: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece, ids cut into sequences of `size`.

    A document's ids (those of its whole text and `end_id`) are first cut into full windows; the rests are dealt into
    shards of about `shard_docs` documents by a hash of doc_id and text, and each shard is packed best fit decreasing.
    Each shard leaves at most one sequence that isn't full. Null texts are empty and have the end id alone; null ids
    and repeated rows are packed like any other. Ids may take 32 bits. Other columns are not read.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    source = source.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    kind = source.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = text_encoder(tokenizer, pattern), np.uint32(end_id).tobytes()
        for batch in batches:
            source_row, start, length, crc, total, rest = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = coder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    part = ids[4 * at : 4 * (at + size)]
                    whole = len(part) == 4 * size
                    source_row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part) if whole else None)
                    rest.append(None if whole else _narrow(part))
                    total.append(n)
            at = pa.array(source_row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("shard").take(at), batch.column("doc_id").take(at), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.binary())], ["shard", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"])

    def place(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shard = table.column("shard").to_numpy()
        bounds = group_bounds(shard)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = table.slice(a, b - a)
            start, length, crc, rest = (own.column(c).to_pylist() for c in ("start", "length", "ids_crc32", "rest"))
            whole = [i for i in range(b - a) if rest[i] is None]
            cut = [i for i in range(b - a) if rest[i] is not None]
            rows = [(i, start[i], size, crc[i], w, 0) for w, i in enumerate(whole)]
            for w, window in enumerate(pack([length[i] for i in cut], size), len(whole)):
                at = 0
                for item, begin, n in window:
                    i = cut[item]
                    ids = _wide(rest[i], length[i])[begin : begin + n]
                    rows.append((i, start[i] + begin, n, zlib.crc32(ids.tobytes()), w, at))
                    at += n
            row, begin, n, sums, window, at = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield from pa.table([own.column("doc_id").take(pa.array(row)), begin, n, sums, own.column("doc_tokens").take(pa.array(row)), window + (int(shard[a]) << 32), at], names).combine_chunks().to_batches()

    fields = f"shard bigint, doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, rest binary"
    return by_key(source.mapInArrow(encode, fields), "shard", place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", rows=2 * shard_docs, order=("doc_id", "start"))
