"""Text corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row a file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_or(spark: SparkSession, path: str, lines: Sequence[str]) -> DataFrame:
    """The corpus at path, or the given lines where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return read(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([("", "".join(f"{x}\n" for x in lines))], "path string, text string")


def without_numbering(line: Column | str) -> Column:
    """A line without the number and two dots before it."""
    return F.regexp_replace(line, r"^[0-9]+\.\.\s*", "")


def cleaned(spark: SparkSession, path: str, more: str | None = None) -> DataFrame:
    """(line): the lines at path without numbering, and after them those at more as they are."""
    lines = spark.read.text(path).select(without_numbering("value").alias("line"))
    return lines if more is None else lines.unionByName(spark.read.text(more).select(F.col("value").alias("line")))


def numbers(line: Column | str) -> Column:
    """The numbers of a line parted by white space; null where one isn't a number."""
    c = F.trim(F.col(line) if isinstance(line, str) else line)
    return F.when(c == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(c, r"\s+"), lambda x: x.try_cast("double")))
