"""Numeric CSV: all columns DOUBLE, no quoting; blank lines are skipped. A ragged, empty or non-numeric cell is an error, not a NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, has_header: bool = True) -> DataFrame:
    """Names come from the first line that isn't blank, or are c0, c1, ...; the number of columns from the first line of data."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).where(F.trim("line") != "")
    head = [r["line"] for r in lines.limit(2).collect()]
    if not head:
        raise ValueError(f"{path} has no lines")
    names = cells(head[0]) if has_header else [f"c{i}" for i in range(len(cells(head[0])))]
    if has_header and len(head) > 1 and len(cells(head[1])) != len(names):
        raise ValueError("the header and the first row have different numbers of cells")
    if len(set(names)) < len(names):
        raise ValueError("columns of one name")
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    found = spark.read.csv(path, schema=schema, header=has_header, mode="FAILFAST", enforceSchema=True, ignoreLeadingWhiteSpace=True, nanValue="nan", positiveInf="inf", negativeInf="-inf")
    # FAILFAST lets an empty cell pass as NULL
    return found.select(*[F.when(F.col(f"`{n}`").isNull(), F.raise_error(F.lit(f"an empty cell in {n}"))).otherwise(F.col(f"`{n}`")).alias(n) for n in names])


def cells(line: str) -> list[str]:
    """A trailing empty cell doesn't count."""
    found = line.split(",")
    return found[:-1] if len(found) > 1 and found[-1] == "" else found
