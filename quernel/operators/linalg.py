"""Linear systems: elimination with partial pivoting, as a kernel on small dense matrices and as a lazy operator on one row per system."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A pivot below this, in absolute value, makes a matrix singular. Fixed value.
SINGULAR = 1e-12


class SingularMatrix(RuntimeError):
    """No pivot is large enough."""


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with a @ x = b; b may have several columns."""
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("the matrix isn't square")
    one = b.ndim == 1
    b = b.reshape(len(b), -1)
    if len(b) != len(a):
        raise ValueError("the right side has another number of rows")
    work = np.hstack((a, b))
    n = len(a)
    for k in range(n):
        best = k + int(np.argmax(np.abs(work[k:, k])))  # the first of equal ones
        if not abs(work[best, k]) >= SINGULAR:
            raise SingularMatrix("singular matrix")
        if best != k:
            work[[k, best]] = work[[best, k]]
        work[k + 1 :] -= np.outer(work[k + 1 :, k] / work[k, k], work[k])
    x = np.zeros_like(b)
    for k in range(n - 1, -1, -1):
        x[k] = (work[k, n:] - work[k, k + 1 : n] @ x[k + 1 :]) / work[k, k]
    return x[:, 0] if one else x


def inverse(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, np.float64)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("the matrix isn't square")
    return solve(a, np.eye(len(a)))


def solve_rows(df: DataFrame, a: str, b: str, out: str = "x") -> DataFrame:
    """One system a row: a array<double> row-major n*n, b array<double> n -> out array<double>; it replaces a column of this name."""
    kept = df.drop(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: [solve(np.array(m).reshape(len(v), -1), np.array(v)) for m, v in zip(f[a], f[b])]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{fields}, `{out}` array<double>")


def inverse_rows(df: DataFrame, a: str, out: str = "inverse") -> DataFrame:
    """One matrix a row: a array<double> row-major n*n -> out array<double> row-major."""
    kept = df.drop(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: [inverse(np.array(m).reshape(int(len(m) ** 0.5), -1)).ravel() for m in f[a]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{fields}, `{out}` array<double>")
