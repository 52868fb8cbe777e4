"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. Each round sums, over all blocks, a histogram of each query's scores within the range that
holds its kth value, and the bin that holds it is the next range, until a range is a single score. A last round takes what scores above
the kth value, and as many equal to it as are wanted, smaller ids first. A block sends only bins from the top down to its own kth score, at most k.
Queries and rows meet as a grid of blocks of bounded size: no side is broadcast, and no block pair depends on how vectors are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm.common import table

ROW_BLOCK, QUERY_BLOCK, BINS = 2048, 512, 256
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as double; beyond the range of long the nearest long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)


def column(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False)


def scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Inner products as int64: exact by float64 where the bound allows, else by integers; saturated beyond the range of long."""
    if bound < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)


def search(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of df of highest inner product for each row where queries holds, itself left out: query_id, rank int, vec_id, score long.

    Only rows with an id and a usable vector take part, against vectors of the same length. Fewer than k others: all of them. Ties go to the
    smaller id. Repeated rows are rows of their own: a copy of the query is a candidate. An empty table gives an empty result.
    """
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), quantized(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = table(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, n_asks, top = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long")), F.max(norm)).first()
    bound = int((top or 0.0) * 1.001) + 2  # of any score, by Cauchy and Schwarz
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-(n_asks or 0) // QUERY_BLOCK))
    levels = 1
    while BINS**levels < 2 * min(bound, LONG) + 1:
        levels += 1
    block = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "rid"), F.lit(count)).cast("int")
    listed = lambda *cols: F.collect_list(F.struct(*cols)).alias("items")
    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    cells = row_blocks * query_blocks
    candidates = table(rows.groupBy("dim", block(row_blocks, 1).alias("cb")).agg(listed("rid", "id", "v")), "blocks")
    spread = candidates.select("dim", "cb", F.col("items").alias("rows"), every(query_blocks, "qb"))
    asked = table(rows.where("asks").select("rid", "dim", "v", block(query_blocks, 2).alias("qb")), "queries")
    # exact longs as decimals don't fit everywhere: low is a long; it starts where no score lies below
    first = -min(bound, LONG)
    state = asked.select("rid", F.lit(first).cast("long").alias("low"), F.lit(k).alias("need"), F.lit(False).alias("few"))

    def scored(state: DataFrame, kernel, schema: str) -> DataFrame:
        blocks = asked.join(state, "rid").groupBy("dim", "qb").agg(listed("rid", "v", "low", "need", "few"))
        grid = blocks.select("dim", "qb", F.col("items").alias("asks"), every(row_blocks, "cb"))
        pairs = grid.join(spread.hint("shuffle_hash"), ["dim", "qb", "cb"]).select("asks", "rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for asks, rows in zip(batch.column(0), batch.column(1)):
                    q, c = asks.values, rows.values
                    s = scores(matrix(q, "v"), matrix(c, "v"), bound)
                    own = column(q, "rid")[:, None] == column(c, "rid")[None, :]
                    yield kernel(q, c, s, ~own)

        return pairs.repartition(max(cells, 1)).mapInArrow(run, schema) if cells > 1 else pairs.mapInArrow(run, schema)

    def histogram(width: int):
        def kernel(q: pa.StructArray, c: pa.StructArray, s: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
            low, need = column(q, "low"), column(q, "need")
            # differences as unsigned: ranges may span all longs
            bins = (s.view(np.uint64) - low.view(np.uint64)[:, None]) // np.uint64(width)
            at, col = np.nonzero(other & (s >= low[:, None]) & (bins < BINS) & ~column(q, "few")[:, None])
            counts = np.bincount(at * BINS + bins[at, col].astype(np.int64), minlength=len(q) * BINS).reshape(len(q), BINS)
            above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
            i, b = np.nonzero((counts > 0) & (above < need[:, None]))
            return pa.RecordBatch.from_arrays([pa.array(column(q, "rid")[i]), pa.array(b.astype(np.int64)), pa.array(counts[i, b].astype(np.int64))], names=["rid", "bin", "n"])

        return kernel

    for level in range(levels):
        width = BINS ** (levels - 1 - level)
        bins = scored(state, histogram(width), "rid long, bin long, n long").groupBy("rid", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("rid").orderBy(F.desc("bin"))
        found = bins.withColumn("upto", F.sum("n").over(down)).withColumnRenamed("rid", "r").join(state.select("rid", "need"), F.col("r") == F.col("rid")).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        step = found.select("r", "bin", (F.col("need") - F.col("upto") + F.col("n")).cast("int").alias("left"))
        state = state.join(step, F.col("rid") == F.col("r"), "left").select(
            "rid", (F.col("low") + F.coalesce(F.col("bin"), F.lit(0)) * width).alias("low"), F.coalesce("left", "need").alias("need"), F.col("bin").isNull().alias("few")
        )
        state = table(state, "state")

    def taken(q: pa.StructArray, c: pa.StructArray, s: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        low, need, few, ids = column(q, "low"), column(q, "need"), column(q, "few"), column(c, "id")
        i, j = np.nonzero(other & ((s > low[:, None]) | few[:, None]))
        ti, tj = np.nonzero(other & (s == low[:, None]) & ~few[:, None])
        order = np.lexsort((ids[tj], ti))
        ti, tj = ti[order], tj[order]
        place = np.arange(len(ti)) - np.searchsorted(ti, ti)
        near = place < need[ti]
        i, j = np.concatenate((i, ti[near])), np.concatenate((j, tj[near]))
        return pa.RecordBatch.from_arrays([pa.array(column(q, "rid")[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["rid", "vec_id", "score"])

    best = scored(state, taken, "rid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    names = rows.where("asks").select(F.col("rid").alias("r"), F.col("id").alias("query_id"))
    return ranked.join(names, F.col("rid") == F.col("r")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every 50th vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
