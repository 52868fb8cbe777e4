"""Least squares by a tall-skinny QR tree.

Each task reduces its rows of [1 | X | y] to a triangular factor, batch by batch; factors meet FAN at a time until one is left, and back-substitution gives the
weights. XᵀX is never formed, so the condition number isn't squared: columns that normal equations can't tell apart are still fitted. What is moved is one triangle a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.linalg import SingularMatrix

#: Triangles that one task merges in a round.
FAN = 16
#: A pivot below this share of its column's length makes the columns dependent.
DEPENDENT = 1e-14
TRIANGLE = "n long, r array<double>"


def triangle(blocks: Iterator[np.ndarray]) -> tuple[int, np.ndarray] | None:
    """Rows and the triangular factor of all blocks below one another; None without rows."""
    n, r = 0, None
    for x in blocks:
        if len(x):
            n += len(x)
            r = np.linalg.qr(x if r is None else np.concatenate((r, x)), mode="r")
    return None if r is None else (n, r)


def _out(found: tuple[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    if found is not None:
        yield pa.RecordBatch.from_arrays([pa.array([found[0]], pa.int64()), pa.array([found[1].ravel()], pa.list_(pa.float64()))], names=["n", "r"])


def factor(df: DataFrame, columns: Sequence[str], tasks: int | None = None) -> DataFrame:
    """One row (n, r): the number of rows and the triangular factor, row-major, of the columns of df, read as doubles; no row for an empty table. Nulls are refused when they are read."""
    cells = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a null in {c}"))).otherwise(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
    width = len(columns)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(triangle(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rest = 0, []
        for b in batches:
            n += sum(b.column(0).to_pylist())
            rest += [np.array(x.as_py()).reshape(-1, width) for x in b.column(1)]
        found = triangle(iter(rest))
        yield from _out(None if found is None else (n, found[1]))

    out = df.select(*cells).mapInArrow(first, TRIANGLE)
    left = tasks or df.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        # triangles are moved even to a single task: coalesce() would have it read the rows of all
        out = out.repartition(left).mapInArrow(merge, TRIANGLE)
    return out


def back_substitute(r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with r @ x = b, r being upper triangular."""
    lengths = np.linalg.norm(r, axis=0)
    if len(r) < r.shape[1] or (np.abs(np.diag(r)) <= DEPENDENT * lengths).any():
        raise SingularMatrix("the columns depend on one another")
    x = np.zeros(len(b))
    for k in range(len(b) - 1, -1, -1):
        x[k] = (b[k] - r[k, k + 1 :] @ x[k + 1 :]) / r[k, k]
    return x


def fit(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature string, idx int, weight double, n long, mse double), idx 0 the intercept: least squares, all in the plan. An empty table gives no row; dependent columns raise SingularMatrix."""
    names, d = ["(intercept)", *features], len(features) + 1
    rows = df.withColumn("__one", F.lit(1.0))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.array(r).reshape(-1, d + 1)
                w = back_substitute(r[:d, :d], r[:d, d])
                rest = r[d:, d]
                out = [names, np.arange(d, dtype=np.int32), w, np.full(d, n), np.full(d, float(rest @ rest) / n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["feature", "idx", "weight", "n", "mse"])

    return factor(rows, ["__one", *features, target]).mapInArrow(solve, "feature string, idx int, weight double, n long, mse double")
