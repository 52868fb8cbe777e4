"""Shared pieces of the training-data operators: shared-folder tables, connected components, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, and tab to carriage return.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"

#: A broadcast is asked for only up to this many rows of a few bytes each; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session, as in tests, may go without: it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Hadoop's settings for writing tables where the shared folder is a local one: without them the executor's JVM forks a process for the rights of each file,
#: of its checksum file and of both again, beside which it counts twice while it forks. Other file systems have no such rights and take no notice.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: Rows of an Arrow batch of texts: what a Python worker and its executor hold at once.
TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on makes no Arrow batches of more rows: with thousands of whole texts in each they'd fill a worker's memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def table(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where a count shows that df is small; else df as it is. df should be a table() of narrow rows."""
    return F.broadcast(df) if df.count() <= rows else df


def size_of(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Links that one task joins up; bounds its memory.
TASK_LINKS = 250_000


def stars(edges: DataFrame, tasks: int) -> DataFrame:
    """edges (u, v), a table() -> edges from each node to the smallest of its part, as far as a task sees it. No task reads many more than TASK_LINKS edges."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while (p := parent[x]) != x:
                parent[x] = x = parent[p]
            return x

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [f.type for f in batch.schema]
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = [(x, r) for x in parent if (r := find(x)) != x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in (0, 1)], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, names)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """links (a, b), of any orderable type, as an undirected graph; returns (node, root): root is the smallest node reachable.

    Each task first joins up its share of the links, TASK_LINKS at most. What remains of more than one share is alternated between large-star and
    small-star steps, each a min per node, which Spark pre-aggregates, and a join by node that adaptive execution may split where a node is hot,
    until one share holds it or nothing changes. No step gathers a node's links in one place. No links: an empty result.
    """
    edges = table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    n, before = edges.count(), None
    edges = table(stars(edges, max(1, -(-n // TASK_LINKS))), "cc")
    for _ in range(rounds):
        if n <= TASK_LINKS:
            break
        # large star: every larger neighbour of u, and u itself, moves to the smallest of u's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, moves to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        edges = table(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        n, now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        if n <= TASK_LINKS:
            edges = table(stars(edges, 1), "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
