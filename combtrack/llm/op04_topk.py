"""Exact top-k by inner product with a vector-approximation file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import by_key, group_bounds, materialize

#: Integer components up to this size (and so many of them) multiply exactly in 64 bits; other vectors are Python integers.
WIDE, LONG = 2.0**24, 1 << 13
CELL_BITS = 8
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def vectors(column: pa.Array, scale: float = 256.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x)) by length: an int64 matrix, and one of Python integers for vectors beyond WIDE or LONG."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        x = pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
        with np.errstate(over="ignore"):
            exact = np.floor(x * scale)
        small = (np.abs(exact) <= WIDE).all(axis=1) & (dim <= LONG)
        if small.any():
            yield rows[small], exact[small].astype(np.int64)
        if not small.all():
            a, b = float(scale).as_integer_ratio()
            whole = [[n * a // (d * b) for n, d in map(float.as_integer_ratio, row)] for row in x[~small].tolist()]
            yield rows[~small], np.array(whole, object).reshape(-1, dim)


class ApproximationFile:
    """Cells of vectors, at most 8 bits a component: cell = (x - low) >> shift, where low is the component's least value."""

    def __init__(self, low: np.ndarray, shift: int, cells: np.ndarray) -> None:
        self.low, self.shift, self.cells = low, shift, cells

    @classmethod
    def of(cls, exact: np.ndarray) -> ApproximationFile:
        low = exact.min(axis=0)
        shift = max(0, int((exact - low).max(initial=0)).bit_length() - CELL_BITS)
        return cls(low, shift, ((exact - low) >> shift).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products (queries, vectors); the shorter of both counts as filled with zeros.

        q.low + 2^shift q.cell + r * (q's negative parts) <= q.x <= the same with the positive parts, r = 2^shift - 1.
        """
        dim = min(queries.shape[1], self.cells.shape[1])
        q, cells, low = queries[:, :dim], self.cells[:, :dim], self.low[:dim]
        rest = (1 << self.shift) - 1
        if q.dtype == object:
            inner = q.dot(cells.T.astype(object)) if dim else np.zeros((len(q), len(cells)), object)
            base = inner * (1 << self.shift) + (q * low.astype(object)).sum(axis=1)[:, None]
            return _clipped(base + rest * np.minimum(q, 0).sum(axis=1)[:, None]), _clipped(base + rest * np.maximum(q, 0).sum(axis=1)[:, None])
        most = float(np.abs(q).max(initial=0)) * 255 * dim
        kind = np.float32 if most < 2**24 else np.float64  # exact in either
        base = ((q.astype(kind) @ cells.T.astype(kind)).astype(np.int64) << self.shift) + (q @ low)[:, None]
        return base + rest * np.minimum(q, 0).sum(axis=1)[:, None], base + rest * np.maximum(q, 0).sum(axis=1)[:, None]


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, int(LEAST) + 1, int(MOST)).astype(np.int64)


def survivors(lower: np.ndarray, upper: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among a query's k best.

    The upper bound passes the kth best lower one, or reaches it with an id no larger than that one's: of equal vectors
    whose cells are exact no more than k survive.
    """
    own = query_ids[:, None] == ids[None, :]
    lower = np.where(own, LEAST, lower)
    if len(ids) <= k:
        return np.nonzero(~own)
    kth = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
    last = np.full(len(kth), MOST)  # the id of the kth best: of those at its bound the first few by id are in
    for i in np.flatnonzero(kth > LEAST).tolist():
        tied, room = ids[lower[i] == kth[i]], k - int((lower[i] > kth[i]).sum())
        last[i] = np.partition(tied, room - 1)[room - 1]
    return np.nonzero(((upper > kth[:, None]) | ((upper == kth[:, None]) & (ids[None, :] <= last[:, None]))) & ~own)


def product(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of the components that both have; one beyond 64 bits is an error."""
    dim = min(len(a), len(b))
    out = int(a[:dim].dot(b[:dim])) if dim else 0
    if not LEAST <= out <= MOST:
        raise OverflowError("a score doesn't fit in 64 bits")
    return out


def _pack(x: np.ndarray) -> bytes:
    return json.dumps(x.tolist()).encode() if x.dtype == object else x.tobytes()


def _unpack(data: bytes, n: int, dim: int, kind: type) -> np.ndarray:
    return np.array(json.loads(data), object).reshape(n, dim) if kind is object else np.frombuffer(data, kind).reshape(n, dim)


FIELDS = "bigint, dim int, wide boolean, ids binary, low binary, shift int, data binary"


def _blocks(df: DataFrame, name: str, count: int, scale: float, cells: bool) -> DataFrame:
    """(name, dim, wide, ids, low, shift, data): the vectors by the hash of their id, a row for each block and length of vectors."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        numbers, ids = table.column(name).to_numpy(), table.column("id").to_numpy()
        bounds = group_bounds(numbers)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for own, x in vectors(table.column("v").slice(a, b - a).combine_chunks(), scale):
                wide, low, shift, data = x.dtype == object, b"", 0, _pack(x)
                if cells and not wide:
                    file = ApproximationFile.of(x)
                    low, shift, data = file.low.tobytes(), file.shift, file.cells.tobytes()
                values = [[int(numbers[a])], [x.shape[1]], [wide], [ids[a:b][own].tobytes()], [low], [shift], [data]]
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], [name, "dim", "wide", "ids", "low", "shift", "data"])

    return by_key(df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(count))), name, work, f"{name} {FIELDS}", rows=1, order=("id",))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block: int = 2048, chunk: int = 8192, tile: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k other rows with the highest integer inner product.

    1. The approximation file: blocks of about `chunk` vectors' cells, written once; queries in blocks of about `block`.
    2. Each block of cells meets each block of queries by a join on both numbers. Bounds leave few vectors of a block,
       and the kth best lower bound over all blocks fewer.
    3. Exact vectors are read for those alone, in the order of their bounds: first the 2k of a query with the highest
       bound, which fix a score that the kth reaches, then what may still exceed it.

    Components x count as floor(scale * x), exactly; where lengths differ, the shorter vector counts as filled with
    zeros. Ties go to the smaller id. Null ids and vectors that are null or hold a null or non-finite component take
    no part. Of rows that repeat an id the least vector counts, and an id never finds itself. A score beyond 64 bits is
    an error. Without queries or candidates the result is empty. Other columns are not read.
    """

    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        df = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return materialize(df.where(F.col("id").isNotNull() & fine).groupBy("id").agg(F.min("v").alias("v")))

    source, asked = usable(rows), usable(queries)
    n_blocks, n_asked = max(1, -(-source.count() // chunk)), max(1, -(-asked.count() // block))
    cells = materialize(_blocks(source, "b", n_blocks, scale, True)).withColumn("qb", F.explode(F.expr(f"sequence(0L, {n_asked - 1}L)")))
    sent = materialize(_blocks(asked, "qb", n_asked, scale, False)).withColumn("b", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")))
    sent = sent.select("b", "qb", *(F.col(c).alias(f"q_{c}") for c in ("dim", "wide", "ids", "data")))

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                asked = _unpack(row["q_data"], len(query_ids), row["q_dim"], object if row["q_wide"] else np.int64)
                x = _unpack(row["data"], len(ids), row["dim"], object if row["wide"] else np.uint8)
                file = None if row["wide"] else ApproximationFile(np.frombuffer(row["low"], np.int64), row["shift"], x)
                for at in range(0, len(query_ids), tile):
                    q, q_ids = asked[at : at + tile], query_ids[at : at + tile]
                    if file:
                        lower, upper = file.bounds(q)
                    else:  # beyond cells: the products themselves
                        dim = min(q.shape[1], x.shape[1])
                        lower = upper = _clipped(q[:, :dim].astype(object).dot(x[:, :dim].T)) if dim else np.zeros((len(q), len(x)), np.int64)
                    a, v = survivors(lower, upper, ids, q_ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[v]), pa.array(lower[a, v]), pa.array(upper[a, v])], ["query_id", "vec_id", "lower", "upper"])

    # sizes are estimated without the copies that explode makes, so either side might be broadcast with all of its copies
    met = materialize(cells.hint("merge").join(sent.hint("merge"), ["b", "qb"]).mapInArrow(scan, "query_id bigint, vec_id bigint, lower bigint, upper bigint"))

    def kth_best(df: DataFrame, column: str) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc(column), "vec_id")
        return df.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col(column).alias("least"), F.col("vec_id").alias("last"))

    def exact(batches):
        for batch in batches:
            v, q = ({i: y for own, x in vectors(batch.column(c), scale) for i, y in zip(own.tolist(), x, strict=True)} for c in ("v", "q"))
            score = [product(q[i], v[i]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    def read(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("query_id", "vec_id").join(source.selectExpr("id as vec_id", "v"), "vec_id").join(asked.selectExpr("id as query_id", "v as q"), "query_id")
        return pairs.mapInArrow(exact, "query_id bigint, vec_id bigint, score bigint")

    left = met.join(kth_best(met, "lower"), "query_id", "left").where("least is null or upper > least or upper = least and vec_id <= last").drop("least", "last")
    left = materialize(left.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id"))))
    first = materialize(read(left.where(F.col("nth") <= 2 * k)))
    rest = left.where(F.col("nth") > 2 * k).join(kth_best(first, "score"), "query_id").where("upper > least or upper = least and vec_id < last")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionAll(read(rest)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
