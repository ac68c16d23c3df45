"""Whitening of embeddings on an exact distributed covariance, with refined eigenvectors.

Entries become integers, floor(scale * entry). The fit list holds each distinct integer vector
once; copies are merged before they are shuffled. One pass over it gives the sums, a second one
the products of vectors centred on the nearest integers to their means. Tasks add these up as
integers and a tree of bounded fan-in adds up the tasks, so the covariance is exact before its
only rounding and does not depend on how rows are partitioned.

The covariance is one matrix of dimension x dimension. Its eigenvectors are found in float32 and
corrected by matrix products in higher precision (Ogita and Aishima): with R = I - X'X and
S = X'AX, X gains X E, where E_ij = (S_ij + e_j R_ij) / (e_j - e_i), and R_ij / 2 for eigenvalues
too near to be told apart at the present error. What such a cluster leaves open is decided by a
solve of the small matrix X_J'(A - m)X_J of its vectors, whose own scale is that of the cluster.

Edge cases: rows whose vector is null or has null, NaN or infinite entries are left out. The
dimension is the length of most vectors of the fit list (of the longer ones, if equal); vectors of
other lengths and empty ones have no place in that space and are left out. Entries beyond the
range of a long take its nearest end. Components without variance have a null ``whitened``, and
``explained`` is null if there is no variance at all; ``identity_error`` looks at the others and is
null without them. Rows that repeat an id or a vector each give their rows; a null id stays null;
an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import hold, packed, release

SCALE, COMPONENTS = 256, 4
#: A sum of integers is kept as so many numbers of 32 bits; the last one has the sign.
LIMBS = 5
#: Bytes that one task or the driver holds of the tasks' partial sums.
HELD = 1 << 26
LONG = 1 << 63
DDL = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()),
                 ("explained", pa.float64()), ("identity_error", pa.float64())])


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows with a usable vector, and for each length (row numbers, matrix of long integers)."""
    lengths = np.where(np.asarray(column.is_null()), 0, np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * values)
    # finite entries may leave the range of a double when scaled; they end at the range of a long all the same
    x = np.where(scaled >= LONG, LONG - 1, np.where(scaled <= -LONG, -LONG, np.where((scaled < LONG) & (scaled > -LONG), scaled, 0).astype(np.int64)))
    starts = np.append(0, np.cumsum(lengths)[:-1])
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    good = (lengths > 0) & (bad[starts + lengths] == bad[starts])
    out = []
    for n in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == n))
        out.append((rows, x[starts[rows][:, None] + np.arange(n)].astype(np.int64)))
    return good, out


def encoded(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: the width of an integer, then the integers in the least width that holds the row."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for width in (1, 2, 4, 8):
        half = 1 << (8 * width - 1)
        fits = left & (low >= -half) & (high <= half - 1)
        for i, row in zip(np.flatnonzero(fits).tolist(), x[fits].astype(f"<i{width}")):
            out[i] = bytes([width]) + row.tobytes()
        left &= ~fits
    return out


def decoded(column: pa.Array, dimension: int) -> np.ndarray:
    """Matrix of the encoded rows that have ``dimension`` integers."""
    found = []
    rows = column.to_pylist()
    for width in (1, 2, 4, 8):
        same = [r for r in rows if r[0] == width and len(r) == 1 + width * dimension]
        if same:
            table = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), -1)[:, 1:]
            found.append(np.ascontiguousarray(table).view(f"<i{width}").astype(np.int64))
    return np.concatenate(found) if found else np.zeros((0, dimension), np.int64)


def fit_list(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(x, dimension): each distinct integer vector once."""
    schema = pa.schema([("x", pa.binary()), ("dimension", pa.int32())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in integers(b.column(0), scale)[1]:
                yield packed({"x": encoded(x), "dimension": [x.shape[1]] * len(x)}, schema)

    return rows.select(F.col(f"`{embedding}`").cast("array<double>").alias("v")).mapInArrow(part, "x binary, dimension int").distinct()


def limbs(p: np.ndarray) -> np.ndarray:
    """Python or 64-bit integers as LIMBS 64-bit arrays, each but the last below 2**32."""
    out = np.zeros((LIMBS, *p.shape), np.int64)
    for k in range(LIMBS - 1):
        out[k] = (p & 0xFFFFFFFF).astype(np.int64)
        p = p >> 32
    out[-1] = p.astype(np.int64)
    return out


def unlimbed(parts: np.ndarray) -> np.ndarray:
    """The integers of their limbs, as Python integers."""
    total = np.zeros(parts.shape[1:], object)
    for k in range(LIMBS):
        total = total + parts[k].astype(object) * (1 << 32 * k)
    return total


def column_sums(x: np.ndarray) -> np.ndarray:
    """Limbs of the sums of the columns, exact."""
    big = max(abs(int(x.min())), abs(int(x.max())))
    return limbs((x if big * len(x) < LONG else x.astype(object)).sum(axis=0))


def products(y: np.ndarray) -> np.ndarray:
    """Limbs of y'y, exact."""
    big = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))), 1)
    total = np.zeros((LIMBS, y.shape[1], y.shape[1]), np.int64)
    if y.dtype == object or big * big >= 1 << 53:
        return limbs(y.astype(object).T @ y.astype(object)) if len(y) else total
    step = min((1 << 53) // (big * big), 1 << 20)
    for at in range(0, len(y), step):  # every partial sum is an integer below 2**53
        f = y[at:at + step].astype(np.float64)
        total += limbs((f.T @ f).astype(np.int64))
    return total


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre; as Python integers where it may leave 64 bits."""
    if len(x) and max(abs(int(x.min())), abs(int(x.max()))) + max(abs(int(v)) for v in centre) >= LONG - 1:
        return x.astype(object) - centre
    return x - centre.astype(np.int64)


def tree_sum(parts: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Sum of the tasks' vectors of ``size`` integers: rows (part, values), by groups of bounded size.

    Groups come from the number of the task, so no group has more than ``fan`` rows.
    """
    fan = max(2, min(32, HELD // (8 * size)))

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, np.int64) for v in t.column("values").to_pylist()], axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([total.tobytes()], pa.binary())})

    while tasks > fan:
        parts = parts.withColumn("part", F.expr(f"cast(part div {fan} as int)")).groupBy("part").applyInArrow(add, "part int, values binary")
        tasks = -(-tasks // fan)
    return np.sum([np.zeros(size, np.int64), *(np.frombuffer(bytes(r["values"]), np.int64) for r in parts.select("values").collect())], axis=0)


def summed(fit: DataFrame, dimension: int, of: callable, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over the fit list of an array of integers, as Python integers."""
    size = LIMBS * int(np.prod(shape))
    schema = pa.schema([("part", pa.int32()), ("values", pa.binary())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LIMBS, *shape), np.int64)
        for b in batches:
            x = decoded(b.column(0), dimension)
            if len(x):
                total += of(x)
                for k in range(LIMBS - 1):  # carried from limb to limb, so that none overflows however many batches there are
                    total[k + 1] += total[k] >> 32
                    total[k] &= 0xFFFFFFFF
        yield packed({"part": [TaskContext.get().partitionId()], "values": [total.tobytes()]}, schema)

    rows = fit.select("x")
    return unlimbed(tree_sum(rows.mapInArrow(part, "part int, values binary"), rows.rdd.getNumPartitions(), size).reshape(LIMBS, *shape))


def in_two_parts(numerators: np.ndarray, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotients of integers as the sum of two doubles."""
    high = np.array([a / denominator for a in numerators.ravel()], np.float64)
    low = np.array([float(Fraction(a, denominator) - Fraction(float(h))) for a, h in zip(numerators.ravel(), high)], np.float64)
    return high.reshape(numerators.shape), low.reshape(numerators.shape)


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Groups of two or more falling eigenvalues, each within ``near`` of the next."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > near) + 1
    return [g for g in np.split(np.arange(len(values)), cuts) if len(g) > 1]


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns that are nearly orthonormal, made so in their own precision."""
    for _ in range(2):
        x = x @ (1.5 * np.eye(x.shape[1], dtype=x.dtype) - 0.5 * (x.T @ x))
    return x


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One refinement of the eigenvectors x of a in the precision of a: (vectors, largest change)."""
    d = len(a)
    r = np.eye(d, dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    near = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x + x @ e
    for j in clusters(values, near):
        middle = values[j].mean()
        xj = x[:, j]
        t = xj.T @ (a @ xj) - middle * (xj.T @ xj)
        t = (t + t.T) / 2
        size = np.abs(t).max()
        if size > 0:  # scaled to the cluster, double precision tells its members apart
            _, w = np.linalg.eigh((t / size).astype(np.float64))
            x[:, j] = xj @ orthonormal(w[:, ::-1].astype(a.dtype))
    return x, float(np.abs(e).max())


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of the symmetric matrix high + low, in extended precision.

    The start is a float32 solve. The first steps are in double precision, the last ones in the
    longest floating point type; they end when nothing changes any more.
    """
    size = 2.0 ** np.ceil(np.log2(np.abs(high).max())) if high.any() else 1.0
    a = high.astype(np.longdouble) / size + low.astype(np.longdouble) / size
    _, start = np.linalg.eigh((high / size).astype(np.float32))
    x = start[:, ::-1].astype(np.float64)
    for matrix, least, steps in ((a.astype(np.float64), 1e-10, 8), (a, 1e-18, 6)):
        x = x.astype(matrix.dtype)
        for _ in range(steps):
            x, change = corrected(matrix, x)
            if change <= least:
                break
        x = orthonormal(x)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * np.longdouble(size), x[:, order]


def deviations(y: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Exact sums of (n y - rest)**2; null beyond 38 digits."""
    big = max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))
    bound = n * big + max((abs(int(v)) for v in rest), default=0)
    if y.dtype != object and bound * bound * y.shape[1] < LONG:
        z = n * y - rest.astype(np.int64)
        return pa.array((z * z).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    from decimal import Decimal
    z = n * y.astype(object) - rest
    sums = (z * z).sum(axis=1)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in sums], pa.decimal128(38, 0))


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Up to ``components`` rows for each usable vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``n`` is the size of the fit list, ``deviation`` the exact squared distance of n times the
    integer vector from the sums, ``explained`` the component's share of the variance and
    ``identity_error`` how far the covariance of the whitened fit list is from the identity.
    """
    every = hold(fit_list(rows, vec_id, embedding, scale))
    sizes = every.groupBy("dimension").count().orderBy(F.desc("count"), F.desc("dimension")).head()
    if sizes is None:
        release(every)
        return rows.sparkSession.createDataFrame([], DDL)
    dimension, n = sizes["dimension"], sizes["count"]
    fit = every.filter(F.col("dimension") == dimension)
    total = summed(fit, dimension, column_sums, (dimension,))
    centre = np.array([(2 * s + n) // (2 * n) for s in total], object)
    rest = total - n * centre
    moments = summed(fit, dimension, lambda x: products(centred(x, centre)), (dimension, dimension))
    high, low = in_two_parts(n * moments - np.outer(rest, rest), n * n)
    values, vectors = eigen(high, low)
    k = min(components, dimension)
    trace = float(np.trace(high))
    live = (values[:k] > values[0] * dimension * np.finfo(np.float64).eps) & (values[0] > 0)
    weights = np.where(live, vectors[:, :k] / np.sqrt(np.where(live, values[:k], 1)), 0).astype(np.float64)
    shift = np.array([r / n for r in rest])

    def projected(y: np.ndarray) -> np.ndarray:
        w = (y.astype(np.float64) - shift) @ weights
        return np.where(live, w, np.nan)

    w_schema = pa.schema([("w", pa.list_(pa.float64()))])

    def of_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = decoded(b.column(0), dimension)
            yield packed({"w": list(projected(centred(x, centre)))}, w_schema)

    at = [i for i in range(k) if live[i]]
    error = None
    if at:
        pairs = [(i, j) for i in at for j in at if i <= j]
        found = fit.select("x").mapInArrow(of_fit, "w array<double>").agg(
            *[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))
    release(every)
    shares = [float(values[i] / trace) if trace > 0 else None for i in range(k)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for numbers, x in integers(b.column(1), scale)[1]:
                if x.shape[1] != dimension:
                    continue
                y = centred(x, centre)
                copies = pa.array(np.repeat(np.arange(len(x)), k))
                ids = b.column(0).take(pa.array(numbers)).take(copies)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([n] * (k * len(x)), pa.int64()),
                    deviations(y, n, rest).take(copies), pa.array(projected(y).ravel(), pa.float64(), from_pandas=True),
                    pa.array(shares * len(x), pa.float64()), pa.array([error] * (k * len(x)), pa.float64())], schema=OUT)

    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).mapInArrow(part, DDL)
