"""A session with the settings that the operators expect."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "quernel", **conf: str) -> SparkSession:
    """ANSI, UTC and adaptive execution; conf overrides, with dots in names as double underscores."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if "SPARK_MASTER" not in os.environ and not SparkSession.getActiveSession():
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors share; it goes when the driver ends. Only a local session may go without the setting, and uses a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernel-")
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path
