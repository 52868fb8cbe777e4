"""Running statistics of a stream, beyond what a batch has: the sums that statistics and linear fits need merge, so a stream keeps them as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators import stats
from quernel.operators.regression import gram


def windowed(df: DataFrame, x: str, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """n, mean, variance, stddev, min and max of each window (and group); what is later than late is dropped, and a window's state goes once it is past."""
    source = df.withWatermark(ts, late) if df.isStreaming else df
    out = source.groupBy(F.window(ts, window).alias("window"), *by).agg(
        F.count(x).alias("n"), stats.mean(x).alias("mean"), stats.variance(x).alias("variance"), stats.stddev(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean", "variance", "stddev", "min", "max")


def running_gram(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The sums of a linear fit over all that has come; complete output mode."""
    return gram(df, features, target)
