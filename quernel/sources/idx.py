"""IDX files of images and labels: big-endian headers, bytes as pixels. Pixels come as values from 0 to 1. Files are read by ranges (quernel.sources.binary)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources import binary


def read(spark: SparkSession, image_path: str, label_path: str, max_items: int = 0, split: int = binary.SPLIT) -> DataFrame:
    """(id long, image array<double>, label int); max_items 0: all. A task reads split bytes of images, and the labels that belong to them."""
    rows = binary.load(spark, image_path, "idx", labels=label_path, max_items=max_items, split=split)
    return rows.select(F.col("row_id").alias("id"), F.transform("v", lambda x: x / F.lit(255.0)).alias("image"), "label")
