"""Moments of wide rows: mean and co-moments of array columns by mergeable centred blocks.

A task centres each batch by the batch's own mean, and merges what it has (n, mean, co-moments) with the batch's; tasks' blocks merge FAN at a time in the same way. Nothing is ever summed
around zero, so a large common offset costs no digits. A block is d + d² numbers, however many rows it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
#: Rows that are centred at once.
ROWS = 4096
SCHEMA = "n long, mean array<double>, comoments array<double>"
Block = tuple[int, np.ndarray, np.ndarray]


def block(x: np.ndarray) -> Block:
    mean = x.mean(0)
    c = x - mean
    # what rounding has left of the mean, taken out of the product
    rest = c.sum(0)
    return len(x), mean + rest / len(x), c.T @ c - np.outer(rest, rest) / len(x)


def merge(a: Block | None, b: Block) -> Block:
    """Chan's formula: co-moments add up, with what the means differ by."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _out(found: Block | None) -> Iterator[pa.RecordBatch]:
    if found is not None:
        yield pa.RecordBatch.from_arrays([pa.array([found[0]], pa.int64()), *(pa.array([x.ravel()], pa.list_(pa.float64())) for x in found[1:])], names=["n", "mean", "comoments"])


def comoments(df: DataFrame, vector: str, tasks: int | None = None) -> DataFrame:
    """One row (n, mean, comoments row-major) of an array column; no row for an empty table. Null rows don't count; null entries and rows of another length are refused."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, width = None, None
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            width = int(sizes[0]) if width is None else width
            if (sizes != width).any():
                raise ValueError("rows of different lengths")
            values = column.flatten()
            if values.null_count:
                raise ValueError("a null entry")
            x = values.to_numpy(zero_copy_only=False).reshape(-1, width)
            for k in range(0, len(x), ROWS):
                found = merge(found, block(x[k : k + ROWS]))
        yield from _out(found)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            for n, mean, co in zip(*(c.to_pylist() for c in b.columns)):
                if found is not None and len(mean) != len(found[1]):
                    raise ValueError("rows of different lengths")
                found = merge(found, (n, np.array(mean), np.array(co).reshape(len(mean), -1)))
        yield from _out(found)

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))
    out, left = rows.mapInArrow(first, SCHEMA), tasks or df.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        out = (out.repartition(left) if left > 1 else out.coalesce(1)).mapInArrow(together, SCHEMA)
    return out


def covariance_cells(df: DataFrame, vector: str, sample: bool = True) -> DataFrame:
    """(i, j, v): the covariance of all pairs of components; no rows where there are too few."""
    found = comoments(df, vector).where(F.col("n") > (1 if sample else 0))
    width, by = F.size("mean"), F.col("n") - (1 if sample else 0)
    cells = found.select(by.alias("by"), width.alias("d"), F.posexplode("comoments").alias("k", "x"))
    return cells.select(F.floor(F.col("k") / F.col("d")).cast("int").alias("i"), (F.col("k") % F.col("d")).cast("int").alias("j"), (F.col("x") / F.col("by")).alias("v"))


def component_moments(df: DataFrame, vector: str) -> DataFrame:
    """(i, n, mean, variance, stddev) of each component; variance and stddev by n - 1, null for one row."""
    cells = comoments(df, vector).select("n", F.size("mean").alias("d"), "comoments", F.posexplode("mean").alias("i", "mean"))
    variance = F.when(F.col("n") > 1, F.get("comoments", F.col("i") * (F.col("d") + 1)) / (F.col("n") - 1))
    return cells.select("i", "n", "mean", variance.alias("variance"), F.sqrt(variance).alias("stddev"))
