"""Files of token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import work_dir
from ._pieces import text_encoder

MAGIC, BLOCK = b"PFR1", 128


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_ids(ids: np.ndarray, percentile: int = 90) -> bytes:
    """A file of unsigned 32-bit ids.

    Header: magic, ids, blocks, exceptions. Then for each block its start in the body (index), minimum, width and
    number of exceptions; the body, in which a block's 128 differences from its minimum take `width` bits each; the
    exceptions' places in their blocks and their high bits. The width is that of the `percentile`-th difference by
    size; the last block is filled with its minimum.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[(blocks - 1) * BLOCK :].min()
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if n else np.zeros(0, np.uint32)
    rows = rows - low[:, None]
    need = _bits(rows)
    width = np.partition(need, BLOCK * percentile // 100, axis=1)[:, BLOCK * percentile // 100] if n else np.zeros(0, np.uint8)
    odd = need > width[:, None]
    at_block, at_place = np.nonzero(odd)
    high = (rows >> width[:, None].astype(np.uint32))[odd]
    start = np.zeros(blocks + 1, np.uint64)
    np.cumsum(width.astype(np.uint64) * (BLOCK // 8), out=start[1:])
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            wide = 16 if w <= 16 else 32
            bits = np.unpackbits(rows[own].astype(f">u{wide // 8}").view(np.uint8), axis=1).reshape(len(own), BLOCK, wide)
            packed = np.packbits(bits[:, :, wide - w :].reshape(len(own), -1), axis=1)
            body[(start[own][:, None].astype(np.int64) + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    counts = np.bincount(at_block, minlength=blocks).astype(np.uint8)
    return b"".join([MAGIC, struct.pack("<QII", n, blocks, len(high)), start[:-1].tobytes(), low.tobytes(), width.tobytes(), counts.tobytes(), body.tobytes(), at_place.astype(np.uint8).tobytes(), high.astype(np.uint32).tobytes()])


def unpack_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids `first` to `last` (exclusive) of a file: the index leads to the blocks that hold them; no others are decoded."""
    if data[:4] != MAGIC:
        raise ValueError("no file of token ids")
    n, blocks, exceptions = struct.unpack_from("<QII", data, 4)
    last = n if last is None else min(last, n)
    at = 20

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    start, low, width, counts = take(np.uint64, blocks), take(np.uint32, blocks), take(np.uint8, blocks), take(np.uint8, blocks)
    body_at = at
    at += int(start[-1]) + int(width[-1]) * (BLOCK // 8) if blocks else 0
    places, high = take(np.uint8, exceptions), take(np.uint32, exceptions)
    if first >= last:
        return np.zeros(0, np.uint32)
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    rows = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width[b0:b1]):
        if w:
            own = np.flatnonzero(width[b0:b1] == w)
            size = int(w) * (BLOCK // 8)
            body = np.frombuffer(data, np.uint8, len(data) - body_at, body_at)
            packed = body[(start[b0:b1][own][:, None].astype(np.int64) + np.arange(size))]
            wide = 16 if w <= 16 else 32
            bits = np.zeros((len(own), BLOCK, wide), np.uint8)
            bits[:, :, wide - w :] = np.unpackbits(packed, axis=1).reshape(len(own), BLOCK, int(w))
            rows[own] = np.packbits(bits, axis=2).view(f">u{wide // 8}")[:, :, 0]
    ends = np.cumsum(counts.astype(np.int64))
    e0, e1 = (int(ends[b0 - 1]) if b0 else 0), int(ends[b1 - 1])
    owner = np.repeat(np.arange(b1 - b0), counts[b0:b1])
    rows[owner, places[e0:e1]] |= high[e0:e1] << width[b0:b1][owner].astype(np.uint32)
    rows += low[b0:b1][:, None]
    return rows.ravel()[first - b0 * BLOCK : last - b0 * BLOCK]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 18, path: str | None = None) -> str:
    """Encodes every whole text, appends `end_id`, and writes the ids in ascending order of doc_id; returns the folder.

    Texts are dealt out by ranges of doc_id and sorted; each task cuts its ids into files of about `file_ids` ids
    (whole documents), kept as rows (part, seq, before, doc_ids, lengths, data) of a parquet table in the shared folder; `before` counts the part's ids ahead. Null
    texts are empty; null ids come first; repeated rows stay, those of one id in the order of their texts' hashes. Ids
    may be of any type that Spark orders; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or work_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder, end, of_ids = text_encoder(tokenizer, pattern), struct.pack("<I", end_id), None
        part, seq, before, held, names, sizes, size = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def file():
            data = pack_ids(np.frombuffer(b"".join(held), np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(of_ids)), pa.array([sizes], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "before", "doc_ids", "lengths", "n_ids", "data"])

        for batch in batches:
            of_ids = batch.column("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = coder.encode(text.as_py() or "") + end
                held.append(ids)
                names.append(key)
                sizes.append(len(ids) // 4)
                size += len(ids) // 4
                if size >= file_ids:
                    yield file()
                    seq, before, held, names, sizes, size = seq + 1, before + size, [], [], [], 0
        if names:
            yield file()

    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, f"part int, seq int, before bigint, doc_ids array<{kind}>, lengths array<bigint>, n_ids bigint, data binary").write.parquet(path)
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of a folder that write_token_files wrote; start counts the ids of all documents before."""
    return _read(spark, path, True)


def _read(spark, path: str, ids: bool) -> DataFrame:
    files = spark.read.parquet(path)
    base, offsets = 0, {}
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a number for each task that wrote
        offsets[r["part"]] = base
        base += r["n"]

    def run(batches):
        for batch in batches:
            of_ids = batch.column("doc_ids").type.value_type
            for row in batch.to_pylist():
                own = unpack_ids(row["data"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                place = pa.array(starts + offsets[row["part"]] + row["before"])
                if ids:
                    last = pa.array([own[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64()))
                else:
                    last = pa.array([zlib.crc32(own[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], of_ids), place, pa.array(row["lengths"], pa.int64()), last], ["doc_id", "start", "n_tokens", "last"])

    rows = files.select("part", "before", "doc_ids", "lengths", "data")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, last {'array<bigint>' if ids else 'bigint'}").withColumnRenamed("last", "ids" if ids else "ids_crc32")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files that write_token_files writes.

    Null and empty texts have the end id alone; null ids, repeated rows and other columns are as in write_token_files.
    """
    return _read(docs.sparkSession, write_token_files(docs, tokenizer, end_id, **options), False)
