"""Whitening of embeddings: exact scatter matrix from residues modulo several primes, then one eigendecomposition in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: Entries are taken as 64ths, moved by a fixed value so that they are natural numbers where |entry| is below 15,625.
SCALE, SHIFT = 64, 1_000_000
#: An entry beyond this has no exact place in the arithmetic, and counts as non-finite.
LIMIT = 2.0**46
#: Primes lie below 2**PRIME_BITS and residues round zero, so the products of BLOCK rows add up below 2**53 and doubles are exact.
PRIME_BITS, BLOCK = 20, 1 << 14
COMPONENTS = 16


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): rows whose vector has only finite entries, each entry c as floor(64 c) + 1000000."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)))
    x = F.transform(v, lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of vectors of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def primes() -> Iterator[int]:
    """Primes below 2**PRIME_BITS, the largest first."""
    for p in range((1 << PRIME_BITS) - 1, 2, -2):
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            yield p


def needed(bound: int) -> list[int]:
    """Primes whose product is beyond twice ``bound``, so every number of at most that size, of either sign, has residues of its own."""
    out, product = [], 1
    for p in primes():
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise OverflowError("too few primes")


def residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n x - S modulo ``p``, between -p/2 and p/2, as doubles."""
    s = np.array([v % p for v in sums], dtype=np.int64)
    r = ((n % p) * (x % p) - s) % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def reconstructed(rests: list[int], moduli: list[int]) -> int:
    """The number nearest to zero with these rests (Chinese remainder theorem, one modulus after another)."""
    value, product = 0, 1
    for r, p in zip(rests, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Of the distinct vectors: their number, exact sums by dimension, and a bound of |n x - S|."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * dims, None, None
        for b in batches:
            x = matrix(b.column(0), dims)
            if len(x):
                n += len(x)
                # in two halves, so that no sum leaves 64 bits
                total = [t + (int(a) << 26) + int(c) for t, a, c in zip(total, (x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0), strict=True)]
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                names=["d", "n", "s", "low", "high"],
            )

    rows = fit.select("x").mapInArrow(partial, "d int, n long, s decimal(38,0), low long, high long")
    rows = rows.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    if not rows:
        return 0, [], 0
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    return n, sums, max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(rows, sums, strict=True))


def scatter(fit: DataFrame, dims: int, n: int, sums: list[int], most: int) -> list[list[int]]:
    """Exact sums of (n x - S)_i (n x - S)_j over the distinct vectors, as integers.

    Every task multiplies residues by blocks, prime by prime; what tasks have is added by Spark entry by entry. The driver gets one number for each
    prime and pair of dimensions, whatever the number of rows.
    """
    moduli = needed(n * most * most)
    upper = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), dims, dims), dtype=np.int64)
        for b in batches:
            x = matrix(b.column(0), dims)
            for i in range(0, len(x), BLOCK):
                for k, p in enumerate(moduli):
                    r = residues(x[i : i + BLOCK], n, sums, p)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        for k in range(len(moduli)):
            e = total[k][upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), k), pa.int32()), pa.array(np.arange(len(e)), pa.int32()), pa.array(e, pa.int64())], names=["k", "e", "r"])

    sums_of = fit.select("x").mapInArrow(partial, "k int, e int, r long").groupBy("k", "e").agg(F.sum("r").alias("r")).collect()
    rests = [[0] * len(moduli) for _ in upper[0]]
    for row in sums_of:
        rests[row["e"]][row["k"]] = row["r"] % moduli[row["k"]]
    out = [[0] * dims for _ in range(dims)]
    for i, j, r in zip(*upper, rests, strict=True):
        out[i][j] = out[j][i] = reconstructed(r, moduli)
    return out


class Whitener:
    """Frozen numbers of the fit: n, S, eigenvectors (columns, of falling eigenvalue) and eigenvalues, and each one's share of the trace."""

    def __init__(self, n: int, sums: list[int], most: int, products: list[list[int]], components: int) -> None:
        cube = n**3
        covariance = np.array([[v / cube for v in row] for row in products])
        values, columns = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")
        # what a double can tell from a direction in which nothing varies
        real = values[order] > len(values) * np.finfo(float).eps * max(values.max(), 0.0)
        order = order[real][:components]
        columns = columns[:, order]
        # of either sign, the one whose largest entry is positive
        columns = columns * np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(len(order))])
        self.n, self.sums, self.most = n, sums, most
        self.values, self.columns = values[order], columns
        self.explained = self.values / (sum(products[i][i] for i in range(len(sums))) / cube) if len(order) else self.values

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: in 64 bits where they suffice, else as Python's integers."""
        wide = self.n * (int(np.abs(x).max(initial=0)) + 1) >= 1 << 62 or max(map(abs, self.sums)) >= 1 << 62
        return x.astype(object) * self.n - np.array(self.sums, dtype=object) if wide else x * self.n - np.array(self.sums, dtype=np.int64)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of squares, exactly; None where one is no long."""
        most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        if most * most * y.shape[1] < 1 << 63:
            return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (y.astype(object) ** 2).sum(axis=1).tolist()]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ self.columns / np.sqrt(self.values)


def identity_error(fit: DataFrame, dims: int, model: Whitener) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, from the whitened vectors themselves."""
    size = len(model.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(size), np.zeros((size, size))
        for b in batches:
            w = model.whitened(model.centred(matrix(b.column(0), dims)))
            first += w.sum(axis=0)
            second += w.T @ w
        e = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(e)), pa.int32()), pa.array(e)], names=["e", "v"])

    sums = fit.select("x").mapInArrow(partial, "e int, v double").groupBy("e").agg(F.sum("v").alias("v")).orderBy("e").collect()
    v = np.array([r["v"] for r in sums]) / model.n
    mean, second = v[:size], v[size:].reshape(size, size)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(size)).max())


def commonest_length(x: DataFrame) -> int | None:
    """The length that most vectors have, of equally common ones the largest."""
    top = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return top["dims"] if top else None


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null or non-finite entry (or one of 2**46 or more) are left out, as are vectors of another length than
    the commonest. The fit counts each distinct vector once, so copies weigh nothing; rows repeat as given, null ids too. Components with no variance that a
    double can tell from none are left out, so a table of one vector, like an empty one, gives no rows. ``deviation`` is null where it is
    no long. Other columns are not read. The fit list is written once and read by three passes.
    """
    session = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    every = vectors(rows, id_col, vector_col)
    fit = written(every.select("x").distinct(), "fit")
    dims = commonest_length(every)
    if dims is None:
        return session.createDataFrame([], schema)
    fit, every = (t.filter(F.size("x") == dims) for t in (fit, every))
    n, sums, most = moments(fit, dims)
    model = Whitener(n, sums, most, scatter(fit, dims, n, sums, most), components)
    if not len(model.values):
        return session.createDataFrame([], schema)
    error = identity_error(fit, dims, model)
    projected = every.mapInArrow(projection(model, dims), "vec_id long, deviation long, whitened array<double>")
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    out = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def projection(model: Whitener, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = model.centred(matrix(b.column(1), dims))
            w = model.whitened(y)
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.deviations(y), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    return run


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
