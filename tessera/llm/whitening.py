"""Operator 13: embeddings whitened by components from a randomised range finder.

Every product with the covariance is a pass over all rows, centred before multiplying; tasks send sums of the size of a
basis, never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, lean, small_batches, table

#: Components of the query; directions beyond them that the range finder starts with; power passes; seed.
COMPONENTS, OVERSAMPLED, POWERS, SEED = 32, 10, 3, 13
#: A component's residual may be so much of the largest eigenvalue, else the basis is expanded to all dimensions.
RESIDUAL = 1e-13
#: Eigenvalues up to so much of the largest one count as zero: rounding alone makes them.
ZERO = 1e-12
#: Sums that one task adds up on the way to the driver; different lengths of vectors; the largest entry.
FAN, LENGTHS, LARGEST = 32, 64, 2.0**34


def finite(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): rows whose vector is there and has neither null nor non-finite entries, as doubles."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """floor(64 c) + 1000000 of a batch of vectors of one length, as a matrix."""
    vectors = batch.column("vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if flat.size and np.abs(flat).max() > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST:g}")
    return (np.floor(flat * 64).astype(np.int64) + 1_000_000).reshape(len(vectors), -1)


def totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (number of rows, exact sums a dimension)}."""

    def own(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                x = whole(batch.filter(pa.array(lengths == d))) if d else np.zeros((int((lengths == 0).sum()), 0), np.int64)
                sums.setdefault(int(d), np.zeros(d + 1, object))
                sums[int(d)] += np.array([len(x), *x.sum(axis=0).tolist()], object)
            if len(sums) > LENGTHS:
                raise ValueError(f"vectors have more than {LENGTHS} lengths")
        out = [(d, j, Decimal(v)) for d, s in sums.items() for j, v in enumerate(s)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.decimal128(30, 0)), strict=True)], ["d", "j", "s"])

    found: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(lean(own), "d int, j int, s decimal(30,0)").groupBy("d", "j").agg(F.sum("s").alias("s")).collect():
        found.setdefault(r.d, {})[r.j] = int(r.s)
    return {d: (s[0], [s[j] for j in range(1, d + 1)]) for d, s in found.items()}


@dataclass
class Centre:
    """The mean of n whole vectors: a whole part, and what is left of the sums, below n."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list:
        """Sums of (n x - S)^2, exact; None beyond a long."""
        near = x - self.base
        if (self.n * (float(np.abs(near).max(initial=0)) + 1)) ** 2 * max(1, x.shape[1]) < 2**62:
            return ((self.n * near - self.rest) ** 2).sum(axis=1).tolist()
        sums = ((self.n * near.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(s) if s < 2**63 else None for s in sums]


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of part(whole vectors of a batch), an array of so many doubles: a sum a task, then by FAN."""

    def added(values) -> Batches:
        total = None
        for v in values:
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def own(batches: Batches) -> Batches:
        return added(part(whole(b)).ravel() for b in batches if b.num_rows)

    def more(batches: Batches) -> Batches:
        return added(np.frombuffer(v) for b in batches for v in b.column("part").to_pylist())

    out = rows.mapInArrow(lean(own), "part binary")
    left = out.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        out = out.repartition(left).mapInArrow(more, "part binary")
    return sum((np.frombuffer(r.part) for r in out.collect()), np.zeros(size))


def components(rows: DataFrame, centre: Centre, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k first eigenvectors of the covariance (columns), their eigenvalues and the trace.

    A random basis with OVERSAMPLED more columns than asked for is multiplied by the covariance POWERS times and made
    orthonormal each time. Rayleigh-Ritz in that basis gives components; unless all their residuals are small, the
    basis is expanded to all dimensions.
    """
    d, n = len(centre.base), centre.n
    rng = np.random.default_rng(SEED)

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times q, and its trace: one pass."""

        def part(x: np.ndarray) -> np.ndarray:
            y = centre.centred(x)
            return np.append((y.T @ (y @ q)).ravel(), (y * y).sum())

        found = summed(rows, part, q.size + 1) / n
        return found[:-1].reshape(q.shape), float(found[-1])

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, bool]:
        z, trace = times(q)
        t = q.T @ z
        values, w = np.linalg.eigh((t + t.T) / 2)
        values, w = values[::-1][:k], w[:, ::-1][:, :k]
        left = np.linalg.norm(z @ w - q @ w * values, axis=0)
        return q @ w, values, trace, bool((left <= RESIDUAL * max(values[0], 0)).all())

    width = min(d, k + OVERSAMPLED)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    if width < d:
        for _ in range(POWERS):
            q = np.linalg.qr(times(q)[0])[0]
    vectors, values, trace, good = ritz(q)
    if not good and width < d:
        q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, d - width))]))[0]
        vectors, values, trace, _ = ritz(q)
    return vectors, values, trace


def whitened(df: DataFrame, key: str, vector: str, k: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) a row and component, up to k.

    Rows whose vector is null or holds null or non-finite entries take no part; other columns are not looked at. Null keys
    and repeated rows stay. Vectors of different lengths are fitted apart, each length on its rows; empty vectors have no
    components, nor has an empty table. Components without variance (up to rounding) have null for whitened, and
    explained is null where nothing varies at all. deviation is null where it goes beyond a long. More than LENGTHS
    lengths, and entries beyond LARGEST, are errors. The sign of a component is the same for all rows.
    """
    spark = df.sparkSession
    small_batches(spark, 4096)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = finite(df, key, vector)
    parts = [fitted(rows.where(F.size("vector") == d), Centre.of(n, sums), k, schema) for d, (n, sums) in sorted(totals(rows).items()) if d]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fitted(rows: DataFrame, centre: Centre, k: int, schema: str) -> DataFrame:
    """The rows of vectors of one length, whitened."""
    k = min(k, len(centre.base))
    vectors, values, trace = components(rows, centre, k)
    real = values > ZERO * max(values[0], 0)
    scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1)), 0)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ scaled
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    found = summed(rows, spread, k * k + k) / centre.n
    mean = found[k * k :]
    off = np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.diag(real.astype(float)))
    error = float(off.max())
    explained = np.maximum(values, 0) / trace if trace > 0 else None
    names = [part.split("`")[1] if "`" in part else part.split()[0] for part in schema.split(", ")]

    def own(batches: Batches) -> Batches:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = whole(batch)
            w = centre.centred(x) @ scaled
            key = batch.column("key").take(pa.array(np.repeat(np.arange(m), k)))
            gone = np.tile(~real, m)
            share = pa.array(np.tile(explained, m)) if explained is not None else pa.nulls(m * k, pa.float64())
            dev = pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n, np.int64)), dev, pa.array(w.ravel(), mask=gone), share, pa.array(np.full(m * k, error))], names)

    return rows.mapInArrow(lean(own), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
