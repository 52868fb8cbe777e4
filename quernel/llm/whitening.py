"""Embedding whitening by a randomised range finder.

A random block of directions, OVERSAMPLING wider than the components wanted, is multiplied by the covariance again and again (a power pass over all centred rows each)
and orthonormalised in between. Rayleigh-Ritz on the block gives components and eigenvalues, and the same pass gives their residuals. While these fail after
PASSES passes, the block is widened with new random directions, up to the full dimension, where the block spans everything and one pass is exact.

A pass is a map over row blocks whose partial products, one small matrix a task, are summed in two levels; only matrices of dimension x width reach the driver. Rows
are integers (floor(64 c) + 1000000), so n * x - S is exact and centring rounds once, however far the mean lies from zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.topk import usable

COMPONENTS, OVERSAMPLING, PASSES, SEED = 32, 16, 4, 12
SCALE, SHIFT = 64.0, 1_000_000
#: Residuals of the components, and the eigenvalues that count as zero, both relative to the largest eigenvalue.
TOLERANCE, ZERO = 1e-13, 1e-12
#: Rows of a batch of Arrow: with hundreds of components each a batch stays at some tens of MB.
ROWS = 2048
LONG = (1 << 63) - 1


class Fit(NamedTuple):
    """n rows with exact sums; components are the columns of vectors, by falling eigenvalue. width: directions that the last pass took; residual: the largest, relative."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    width: int
    passes: int
    residual: float


def fixed(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    """floor(64 c) + 1000000 of every vector of a batch of equally long ones."""
    column = batch.column(at)
    return (np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)).astype(np.int64).reshape(len(column), -1) + SHIFT


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once."""
    return (n * x - sums).astype(np.float64) / n


def blocks(df: DataFrame, vector: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of part(x) over all row blocks x: one matrix a task, summed by as many tasks as the root of their number, and then by the driver. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                found = part(fixed(batch.slice(k, ROWS)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str]), pa.array([list(total.shape)], pa.list_(pa.int32()))], names=["m", "kind", "shape"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, like = None, None
        for batch in batches:
            for m, kind in zip(batch.column(0), batch.column(1)):
                found = np.frombuffer(m.as_py(), kind.as_py())
                total, like = (found.copy() if total is None else total + found), batch
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), *(like.column(k).slice(0, 1) for k in (1, 2))], names=["m", "kind", "shape"])

    schema = "m binary, kind string, shape array<int>"
    parts = df.select(vector).mapInArrow(run, schema)
    tasks = max(1, int(df.rdd.getNumPartitions() ** 0.5))
    rows = parts.repartition(tasks).mapInArrow(summed, schema).collect()
    return sum(np.frombuffer(r.m, r.kind).reshape(r.shape) for r in rows) if rows else None


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Whitening's components from the usable rows of df: None if there is none. Vectors of different lengths are refused with a ValueError."""
    rows = df.where(usable(F.col(vector)))
    n, short, long, low, high = rows.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector)), F.min(F.array_min(vector)).cast("double"), F.max(F.array_max(vector)).cast("double")).first()
    if not n:
        return None
    if short != long:
        raise ValueError(f"vectors of {short} and of {long} entries")
    if max(abs(low), abs(high)) * SCALE + SHIFT >= LONG / n / 4:
        raise ValueError("entries are too large for exact sums")
    d = short
    sums = blocks(rows, vector, lambda x: x.sum(0))
    trace = float(blocks(rows, vector, lambda x: (centred(x, n, sums) ** 2).sum(0)).sum()) / n

    def times(q: np.ndarray) -> np.ndarray:
        """The covariance times q: a pass over all centred rows."""

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return blocks(rows, vector, part) / n

    k, rng, passes = min(components, d), np.random.default_rng(SEED), 0
    width = min(d, k + OVERSAMPLING)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    while True:
        for _ in range(PASSES if width < d else 1):
            y = times(q)
            passes += 1
            small = q.T @ y
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            top = max(float(values[0]), 0.0)
            worst = float(np.linalg.norm(y @ turn - (q @ turn) * values, axis=0)[:k].max()) / (top or 1.0)
            if width == d or worst <= TOLERANCE:
                kept = int((values[:k] > ZERO * top).sum()) if trace > 0 else 0
                return Fit(n, sums, (q @ turn)[:, :kept], values[:kept], trace, width, passes, worst)
            q = np.linalg.qr(y)[0]
        width = min(d, 2 * width)
        # the block goes on; what comes new is orthogonal to it, twice over for rounding
        new = rng.standard_normal((d, width - q.shape[1]))
        for _ in range(2):
            new -= q @ (q.T @ new)
        q = np.linalg.qr(np.concatenate((q, new), 1))[0]


def identity_error(df: DataFrame, found: Fit, vector: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened rows (divisor n, centred) minus the identity: two passes over the rows as whitened."""
    n, sums, axes = found.n, found.sums, found.vectors / np.sqrt(found.values)
    rows = df.where(usable(F.col(vector)))
    mean = blocks(rows, vector, lambda x: (centred(x, n, sums) @ axes).sum(0)) / n

    def part(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ axes - mean
        return w.T @ w

    return float(np.abs(blocks(rows, vector, part) / n - np.eye(axes.shape[1])).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component int (from 1), n, deviation long, whitened, explained, identity_error double.

    Vectors that are null, empty, or hold null or non-finite entries are dropped; a null vec_id stays null; repeated rows are rows of their own, and all enter the fit. Only directions
    in which the rows vary are components: fewer than n vectors or constant entries give fewer, equal vectors none, so no rows. Equal eigenvalues: any basis of
    theirs, the same for all rows. An empty table gives an empty result. A deviation beyond the range of long is refused. Other columns of df take no part.
    """
    schema = f"vec_id {df.schema[vec_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(df, vector, components)
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(df, found, vector)
    n, sums, axes, share = found.n, found.sums, found.vectors / np.sqrt(found.values), found.values / found.trace
    k = len(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = fixed(part, 1)
                off = n * x - sums
                if (off.astype(np.float64) ** 2).sum(1).max() >= LONG:
                    raise OverflowError("a deviation beyond the range of long")
                m = len(x)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(np.repeat((off * off).sum(1), k)),
                    pa.array((off.astype(np.float64) / n @ axes).ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.where(usable(F.col(vector))).select(vec_id, vector).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitens all embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
