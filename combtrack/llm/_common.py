"""What the operators of this subpackage share: written stages, Arrow batches, hashes of words."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes that part words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240607)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
ODD = U64(0x9E3779B97F4A7C15)
_OWN = uuid.uuid4().hex


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001, S110  (the session has gone: its folder is the owner's to clear)
        pass


@functools.cache
def _root(spark: SparkSession, base: str) -> str:
    """This process's folder, which goes when the process ends."""
    path = f"{base.rstrip('/')}/combtrack-{_OWN}"
    atexit.register(_clean, spark, path)
    return path


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset a local session gets a folder of its own; on a cluster it is an error, as executors don't see
    one another's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='combtrack-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{_root(spark, base)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes a stage to the shared folder and reads it again, which cuts its lineage: lost executors lose nothing."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*stages: DataFrame) -> None:
    """Deletes written stages that no later one will read."""
    for df in stages:
        _delete(df.sparkSession, df._written)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores behind it as it takes to differ from all columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Whole texts as UTF-8; null as empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about `limit` bytes of text (a longer text is a run of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bytes(texts: list[bytes], lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts as one binary array, and each text's offset in it (n + 1 numbers)."""
    joined = b" ".join(texts)
    if lower:
        joined = joined.lower()  # bytes.lower() folds A-Z alone
    buf = np.frombuffer(joined, np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=offsets[1:])
    space = SPACES[buf]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(buf[~space])])
    return array, np.searchsorted(starts, offsets).astype(np.int64)


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word (2, words), halves of the 128-bit XXH3 of its bytes, and each text's offset."""
    array, offsets = word_bytes(texts, lower)
    if not len(array):
        return np.zeros((2, 0), np.uint64), offsets
    coded = array.dictionary_encode()
    _, ends, data = coded.dictionary.buffers()
    at, data = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1).tolist(), data.to_pybytes()
    digests = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at, at[1:], strict=False)])
    lanes = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    return np.ascontiguousarray(lanes[:, coded.indices.to_numpy()]), offsets


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order; mixed at each step, so that no pattern of equal parts cancels out."""
    return mix(left * ODD + right)


def rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive values, by doubling; as long as the input, the last length - 1 are void."""
    n = len(hashes)
    out, done = np.zeros(n, np.uint64), 0
    power, width, left = hashes.copy(), 1, length
    while left:
        if left & 1:
            if done < n:
                out[: n - done] = joined(out[: n - done], power[done:])
            done += width
        left >>= 1
        if left:
            if width < n:
                power[: n - width] = joined(power[: n - width], power[width:])
            width *= 2
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """From batches sorted by `key`: tables of whole groups, of about `rows` rows or one group."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        cut = int(pc.index(keys, last).as_py())
        if held and held[-1].column(key)[held[-1].num_rows - 1] != keys[0] and count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
        if cut and count + cut >= rows:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, count = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal values, with the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


def by_key(df: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 20_000, order: tuple[str, ...] = ()) -> DataFrame:
    """Deals rows out by `key` and hands whole groups, many at a time and sorted by `order`, to `work`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key, rows):
            yield from work(table)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
