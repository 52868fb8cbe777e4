"""Named matrices as a Parquet table (name, i, j, value)."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(spark: SparkSession, params: Mapping[str, np.ndarray]) -> DataFrame:
    parts = []
    for name, m in params.items():
        m = np.atleast_2d(np.asarray(m, np.float64))
        i, j = np.indices(m.shape)
        parts.append(pd.DataFrame({"name": name, "i": i.ravel(), "j": j.ravel(), "value": m.ravel()}))
    schema = "name string, i long, j long, value double"
    return spark.createDataFrame(pd.concat(parts), schema) if parts else spark.createDataFrame([], schema)


def save(df: DataFrame, path: str) -> None:
    df.select("name", "i", "j", "value").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """To the driver: a model's parameters, not data."""
    out = {}
    for name, part in df.toPandas().groupby("name"):
        m = np.zeros((part.i.max() + 1, part.j.max() + 1))
        m[part.i, part.j] = part.value
        out[name] = m
    return out


def shapes(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))
