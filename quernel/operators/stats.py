"""Descriptive statistics: column builders for select and agg, and eager forms that raise on degenerate input.

The builders are plain aggregates (partial and final, one shuffle of one row per partition and group), so all of them also work grouped.
Spark gives NULL where the input is too small; value() and matrix_value() raise ValueError instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean(x: Column | str) -> Column:
    return F.avg(_c(x).cast("double"))


def variance(x: Column | str, sample: bool = True) -> Column:
    return (F.var_samp if sample else F.var_pop)(_c(x).cast("double"))


def stddev(x: Column | str, sample: bool = True) -> Column:
    return (F.stddev_samp if sample else F.stddev_pop)(_c(x).cast("double"))


def covariance(a: Column | str, b: Column | str, sample: bool = True) -> Column:
    return (F.covar_samp if sample else F.covar_pop)(_c(a).cast("double"), _c(b).cast("double"))


def correlation(a: Column | str, b: Column | str) -> Column:
    """NULL where a side has no variance."""
    return F.try_divide(covariance(a, b), stddev(a) * stddev(b))


def minimum(x: Column | str) -> Column:
    return F.min(_c(x))


def maximum(x: Column | str) -> Column:
    return F.max(_c(x))


def percentile(x: Column | str, p: float) -> Column:
    """Exact, with linear interpolation at rank p / 100 * (n - 1)."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies within 0 and 100")
    return F.percentile(_c(x).cast("double"), F.lit(p / 100))


def median(x: Column | str) -> Column:
    return percentile(x, 50)


def approximate_percentile(x: Column | str, p: float, accuracy: int = 10_000) -> Column:
    """For columns whose distinct values don't fit in a task's memory: a bounded sketch."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies within 0 and 100")
    return F.percentile_approx(_c(x).cast("double"), p / 100, accuracy)


def summary(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """One row a group: n, mean, variance, stddev (sample), min, max; one pass."""
    return df.groupBy(*(by or [])).agg(
        F.count(x).alias("n"), mean(x).alias("mean"), variance(x).alias("variance"), stddev(x).alias("stddev"), minimum(x).cast("double").alias("min"), maximum(x).cast("double").alias("max")
    )


def covariance_matrix(df: DataFrame, cols: list[str], sample: bool = True) -> DataFrame:
    """(i, j, v) of all pairs of columns; the upper triangle in one aggregate, mirrored."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = df.agg(*[covariance(cols[i], cols[j], sample).alias(f"s{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{min(i, j)}_{max(i, j)}").alias("v")) for i in range(len(cols)) for j in range(len(cols))])
    return sums.select(F.inline(cells))


def histogram(df: DataFrame, x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin int, n long, empty bins included. The bin number is truncated towards zero, so that what lies less than a width below lo counts in the first bin; hi is left out."""
    if bins <= 0 or not hi > lo:
        raise ValueError("a histogram needs a range and bins")
    width = (hi - lo) / bins
    at = (F.col(x).cast("double") - lo) / width
    inside = df.where((at > -1) & (at < bins)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(inside, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_bars(counts: DataFrame, lo: float, hi: float, bins: int, length: int = 50) -> DataFrame:
    """Adds each bin's center, and its bar scaled to the largest; the window spans the bins only."""
    width = (hi - lo) / bins
    most = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy()))
    return counts.select("bin", "n", (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("center"), (F.lit(length) * F.col("n") / most).cast("int").alias("bar"))


def mean_squared_error(predicted: Column | str, y: Column | str) -> Column:
    d = _c(predicted) - _c(y)
    return F.avg(d * d)


def accuracy(predicted: Column | str, y: Column | str) -> Column:
    return F.avg((_c(predicted) == _c(y)).cast("double"))


def perplexity(loss: Column | str) -> Column:
    return F.exp(F.avg(_c(loss)))


def norm(x: Column | str) -> Column:
    return F.sqrt(F.sum(_c(x) * _c(x)))


#: Least number of values that each needs.
LEAST = {"mean": 1, "minimum": 1, "maximum": 1, "median": 1, "percentile": 1, "variance": 2, "stddev": 2, "covariance": 2, "correlation": 2}


def value(df: DataFrame, what: str, *cols: str, **args) -> float:
    """One statistic as a number; ValueError where there are too few values."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    n, v = df.where(complete).agg(F.count("*"), globals()[what](*cols, **args)).first()
    if n < LEAST[what]:
        raise ValueError(f"{what} needs {LEAST[what]} values or more, not {n}")
    return float("nan") if v is None else float(v)


def matrix_value(df: DataFrame, cols: list[str], sample: bool = True) -> list[list[float]]:
    if df.limit(2).count() < 2:
        raise ValueError("a covariance matrix needs 2 rows or more")
    out = [[0.0] * len(cols) for _ in cols]
    for r in covariance_matrix(df, cols, sample).collect():
        out[r["i"]][r["j"]] = r["v"]
    return out
