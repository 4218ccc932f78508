"""Whitening of embeddings by principal components from the exact characteristic polynomial of the integer scatter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

#: Whole numbers up to this size multiply and add up, a batch at a time, in 64 bits; larger ones are Python integers.
SMALL = 1 << 24
#: Eigenvalues that differ by less than this share of the trace (a power of two) count as one that is repeated.
APART_BITS = 160
#: Bits behind the point of the numbers that eigenvectors are computed in.
POINT = 640


def is_prime(n: int) -> bool:
    """Miller and Rabin's test, with bases that decide it below 2^32."""
    if n < 4 or n % 2 == 0:
        return n in (2, 3)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 7, 61):
        x = pow(a, d, n)
        if a % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_below(top: int, bits: int) -> list[int]:
    """Primes from `top` downwards whose product has more than `bits` bits."""
    out, size, n = [], 0.0, top
    while size <= bits + 1:
        n -= 1
        if is_prime(n):
            out.append(n)
            size += math.log2(n)
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(t - matrix) modulo a prime below 2^31, through Hessenberg form."""
    h, d = (matrix % p).astype(np.int64), len(matrix)
    for k in range(1, d - 1):  # similar matrices, with zeros below the subdiagonal of column k - 1
        pivot = k + int(np.argmax(h[k:, k - 1] != 0))
        if not h[pivot, k - 1]:
            continue
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + _dot(h[:, k + 1 :], factor, p)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # of the leading minors of each size
    poly[0, 0] = 1
    for n in range(1, d + 1):
        poly[n, 1:] = poly[n - 1, :-1]
        poly[n] = (poly[n] - int(h[n - 1, n - 1]) * poly[n - 1]) % p
        below = 1
        for i in range(1, n):
            below = below * int(h[n - i, n - i - 1]) % p
            if not below:
                break
            poly[n] = (poly[n] - int(h[n - i - 1, n - 1]) * below % p * poly[n - i - 1]) % p
    return poly[d]


def _dot(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    return (a * b % p).sum(axis=1) % p


def characteristic_polynomial(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of det(t - scatter), exact: residues by primes, which Spark deals out, put together by remainders.

    Of a matrix whose eigenvalues aren't negative the coefficient k below the highest is at most C(d, k) (trace / k)^k.
    """
    d, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    size = max((math.comb(d, k).bit_length() + k * (max(0, trace.bit_length() - k.bit_length() + 1)) for k in range(1, d + 1)), default=1)
    chosen = primes_below(1 << 31, size + 2)
    text = [[str(x) for x in row] for row in scatter]

    def residues(batches):
        matrix = np.array([[int(x) for x in row] for row in text], object).reshape(d, d)
        for batch in batches:
            found = [(p, polynomial_mod(matrix, p).tolist()) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["p", "residues"])

    rows = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(-(-len(chosen) // 16)).mapInArrow(residues, "p bigint, residues array<bigint>").collect()
    product, total = 1, [0] * (d + 1)
    for p, residue in sorted((r[0], r[1]) for r in rows):
        inverse = pow(product, -1, p)
        total = [t + product * ((r - t) * inverse % p) for t, r in zip(total, residue, strict=True)]
        product *= p
    return [t - product if 2 * t > product else t for t in total]


def roots_above(poly: list[int], at: Fraction) -> int:
    """How many roots, each as often as it occurs, exceed `at`, of a polynomial with real roots alone: the changes of sign (Descartes) after moving the origin there."""
    a, b, d = at.numerator, at.denominator, len(poly) - 1
    c = [x * b ** (d - k) for k, x in enumerate(poly)]  # roots times b
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], trace: int, count: int, bits: int) -> list[tuple[Fraction, Fraction, int]]:
    """Intervals (low, high] of width trace / 2^bits at most, and the roots in each, from the highest down until they hold `count` positive ones.

    Intervals are halved until each holds one root or is narrow; those of one root are then narrowed by the polynomial's sign.
    """
    width = Fraction(trace, 1 << bits)
    out, found = [], 0
    todo = [(Fraction(0), Fraction(trace), roots_above(poly, Fraction(0)), 0)]  # the last on the list is the highest
    while todo and found < count:
        low, high, above_low, above_high = todo.pop()
        n = above_low - above_high
        if not n:
            continue
        if high - low <= width:
            out.append((low, high, n))
            found += n
        elif n == 1:
            out.append((*_narrowed(poly, low, high, width), 1))
            found += 1
        else:
            middle = (low + high) / 2
            above = roots_above(poly, middle)
            todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return out


def _sign(poly: list[int], at: Fraction) -> int:
    a, b, total, power = at.numerator, at.denominator, 0, 1
    for x in reversed(poly):
        total, power = total * a + x * power, power * b
    return (total > 0) - (total < 0)


def _narrowed(poly: list[int], low: Fraction, high: Fraction, width: Fraction) -> tuple[Fraction, Fraction]:
    above = _sign(poly, high)
    if not above:
        return high, high
    while high - low > width:
        middle = (low + high) / 2
        sign = _sign(poly, middle)
        if not sign:
            return middle, middle
        low, high = (low, middle) if sign == above else (middle, high)
    return low, high


def null_space(scatter: list[list[int]], low: Fraction, high: Fraction, count: int, trace: int) -> list[list[float]]:
    """`count` orthonormal vectors that scatter - t sends next to 0, for the root(s) t between low and high.

    Inverse iteration in whole numbers with POINT bits behind the point: the shift lies next to the root, so a step
    lengthens its vectors by 40 bits more than those of any eigenvalue apart from it, and mostly by far more.
    """
    d, one = len(scatter), 1 << POINT
    shift = (low + high) / 2 + Fraction(trace, 1 << (APART_BITS + 40))
    unit = Fraction(one, trace)
    m = np.array([[int((scatter[i][j] - (shift if i == j else 0)) * unit) for j in range(d)] for i in range(d)], object).reshape(d, d)
    order, factors = _eliminated(m)
    rng = np.random.default_rng(20240607)
    x = np.array([[int(v) << (POINT - 40) for v in row] for row in rng.integers(-(1 << 40), 1 << 40, (d, count)).tolist()], object).reshape(d, count)
    for _ in range(4):
        x = _orthonormal(_solved(factors, x[order]))
    return [[float(Fraction(v, one)) for v in x[:, k].tolist()] for k in range(count)]


def _eliminated(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows, and both triangular factors of m in it, by the largest pivots."""
    a, d = m.copy(), len(m)
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        factor = np.array([(v << POINT) // a[k, k] for v in a[k + 1 :, k].tolist()], object)
        a[k + 1 :, k + 1 :] -= (factor[:, None] * a[k, k + 1 :]) >> POINT
        a[k + 1 :, k] = factor
    return order, a


def _solved(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The solution for a right side in the factors' order of rows."""
    b, d = x.copy(), len(a)
    for k in range(d):
        b[k + 1 :] -= (a[k + 1 :, k, None] * b[k]) >> POINT
    for k in range(d - 1, -1, -1):
        b[k] = [(v << POINT) // a[k, k] for v in b[k].tolist()]
        b[:k] -= (a[:k, k, None] * b[k]) >> POINT
    return b


def _orthonormal(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    for k in range(x.shape[1]):
        largest = max(1, *(abs(v) for v in out[:, k].tolist()))
        v = np.array([(u << POINT) // largest for u in out[:, k].tolist()], object)
        for _ in range(2):
            for j in range(k):
                v = v - (out[:, j] * (int((v * out[:, j]).sum()) >> POINT) >> POINT)
        norm = max(1, math.isqrt(int((v * v).sum())))
        out[:, k] = [(u << POINT) // norm for u in v.tolist()]
    return out


def whole(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * c) of all vectors, (rows, dim), exact; a shorter vector is filled up with zeros."""
    out = np.zeros((len(column), dim))
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    starts = np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - starts] = np.floor(flat * scale)
    if not (np.abs(out) < 2.0**62).all():
        raise OverflowError("an entry of a vector doesn't fit in 64 bits")
    return out.astype(np.int64)


def scatter_of(rows: DataFrame, dim: int, scale: float) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y = floor(scale * c) and the whole numbers n sum(y y') - sum(y) sum(y)': n^2 times the covariance.

    Every task adds up its own vectors, and Spark the tasks' sums, entry by entry; dim^2 / 2 numbers come to the driver.
    """
    upper = np.triu_indices(dim)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                y = whole(batch.column("v").slice(at, 4096), dim, scale)
                if (np.abs(y) >= SMALL).any():
                    y = y.astype(object)
                n, sums, squares = n + len(y), sums + y.sum(axis=0).astype(object), squares + (y.T @ y).astype(object)
        if n:
            values = [n, *sums.tolist(), *squares[upper].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values], pa.string())], ["i", "v"])

    rows = rows.select("v").mapInArrow(add, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    total = {i: int(v) for i, v in rows.collect()}
    n, sums = total[0], [total[1 + i] for i in range(dim)]
    out = [[0] * dim for _ in range(dim)]
    for k, (i, j) in enumerate(zip(*(x.tolist() for x in upper), strict=True)):
        out[i][j] = out[j][i] = n * total[1 + dim + k] - sums[i] * sums[j]
    return n, sums, out


def principal_components(spark: SparkSession, scatter: list[list[int]], count: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit eigenvector) of the integer scatter, the highest first; only positive eigenvalues, so there may be fewer than `count`."""
    trace = sum(scatter[i][i] for i in range(len(scatter)))
    if not trace:
        return []
    out = []
    for low, high, n in largest_roots(characteristic_polynomial(spark, scatter), trace, count, APART_BITS):
        out += [((low + high) / 2, v) for v in null_space(scatter, low, high, n, trace)]
    return out[:count]


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every vector on the first principal components, each of variance 1.

    Entries count as x = floor(scale * c) plus a constant, which no result depends on. The scatter n^2 V is a matrix of
    whole numbers, summed exactly. Its characteristic polynomial is computed modulo primes, of which Spark deals out as
    many as its coefficients need, and put together by remainders; all roots are real, so changes of sign count those
    above a number, and halving isolates the highest ones to 2^-160 of the trace. Vectors come from inverse iteration
    with 640 bits. `deviation` is the exact sum of (n x - S)^2; one beyond 64 bits is an error. `explained` is an
    eigenvalue's share of the trace. `identity_error` is measured on the projections of all rows, by two sums over them.

    Vectors that are null or hold a null or non-finite entry are left out. Repeated rows, repeated and null ids count as
    vectors of their own; of vectors of several lengths the shorter ones are filled up with zeros, and empty ones are all
    zeros. A component of variance 0 can't be whitened: it has no rows, so equal vectors, a single one and an empty table
    give an empty result. A repeated eigenvalue has any orthonormal vectors of its space. Other columns are not read.
    """
    spark = rows.sparkSession
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fine)
    kind = kept.schema["vec_id"].dataType.simpleString()
    fields = "n bigint, deviation bigint, w array<double>"
    dim = kept.agg(F.max(F.size("v"))).first()[0] or 0
    n, sums, scatter = scatter_of(kept, dim, scale) if dim else (0, [], [])
    found = principal_components(spark, scatter, components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not found:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    axes = np.array([v for _, v in found]).T
    roots = np.array([math.sqrt(e) for e, _ in found])
    trace = sum(scatter[i][i] for i in range(dim))
    centre = np.array(sums, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole(batch.column("v"), dim, scale)
            largest = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
            if largest**2 * dim < 1 << 63:
                apart = n * y - centre.astype(np.int64)
                deviation = (apart * apart).sum(axis=1)
            else:
                apart = n * y.astype(object) - centre
                deviation = (apart * apart).sum(axis=1)
                if max(deviation, default=0) >= 1 << 63:
                    raise OverflowError("a deviation doesn't fit in 64 bits")
            w = apart.astype(float) @ axes / roots  # n (x - S/n) over sqrt(n^2 e)
            held = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.full(len(y), n)), pa.array(deviation.tolist(), pa.int64()), held], ["vec_id", "n", "deviation", "w"])

    done = materialize(kept.mapInArrow(project, f"vec_id {kind}, {fields}"))
    k = len(found)
    w = [F.get("w", i) for i in range(k)]
    mean = list(done.agg(*(F.sum(x) / n for x in w)).first())
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = done.agg(*(F.sum((w[i] - mean[i]) * (w[j] - mean[j])) / n for i, j in pairs)).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(covariance, pairs, strict=True))
    shares = F.array(*(F.lit(float(e / trace)) for e, _ in found))
    out = done.select("vec_id", "n", "deviation", F.posexplode("w").alias("at", "whitened"))
    out = out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"))
    return out.select(*names)
