"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: each source's share is proportional to its weight; a source whose share exceeds max_epochs times its size is clamped there, and
what it leaves is shared again among the others by weight, until no share exceeds its limit. Repetitions: with target = whole * size + rest,
every document is taken whole times; then documents in the order of a seeded hash are taken once more until rest is used up, the last one in part
(its first words). Where that order reaches rest is found by narrowing the hash range by histograms, so no source is sorted or gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm.common import WORD, size_of, table

#: Bits of the hash, and how many each histogram resolves.
HASH_BITS, STEP_BITS, STEPS = 60, 8, 3


def seeded(seed: int, doc_id: Column | str) -> Column:
    """60 bits of md5 of seed and id; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources (size, weight, ...) with target double: shares of the sum of all sizes. sources should be a table()."""
    limit = F.col("size") * max_epochs
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = 0.0
    while True:  # each round clamps at least one more source, or ends; two numbers a round come to the driver
        free = limit >= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(free, 0).otherwise(limit)).alias("used")).first()
        if not row["w"]:
            break
        now = (total - row["used"]) / row["w"]
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def plan(docs: DataFrame, source: str = "source", seed: int = 17, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs (source, size, h) as a table() -> one row a source: source, source_size, target, whole, and for the fractional repetition
    cut (hash where it ends; earlier ones are taken), part, part_size (words taken of the documents at the cut, and their words).

    Sources are ranked by code point, null last; their weights repeat. Ranks come from a range-partitioned table, not from one task.
    """
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("size"))
    dealt = table(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()), "sources")
    before = dealt.groupBy("p").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int"))
    filled = water_fill(table(dealt.join(before, "p").select("source", "size", weight.alias("weight")), "weights"), max_epochs)
    words = F.round("target").cast("long")
    whole = F.when(F.col("size") > 0, F.floor(words / F.col("size"))).otherwise(0).cast("long")
    found = filled.select("source", F.col("size").alias("source_size"), "target", whole.alias("whole"), (words - whole * F.col("size")).alias("rest"), F.lit(0).cast("long").alias("low"))
    found = table(found, "targets")
    width = HASH_BITS
    for _ in range(STEPS):
        # the words of each of 256 parts of a source's hash range; the part that reaches rest is the next range
        part = F.shiftright(F.col("h") - F.col("low"), width - STEP_BITS)
        inside = (F.col("h") >= F.col("low")) & (part < (1 << STEP_BITS))
        bins = docs.select(F.col(source).alias("s"), "size", "h").join(found, F.col("s").eqNullSafe(F.col("source"))).where(inside & (F.col("rest") > 0)).groupBy("source", "rest", "low", part.alias("part")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("part"))
        reached = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        step = reached.select(F.col("source").alias("s"), (F.col("low") + F.shiftleft(F.col("part").cast("long"), width - STEP_BITS)).alias("low2"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest2"))
        found = found.join(step, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "whole", F.coalesce("rest2", "rest").alias("rest"), F.coalesce("low2", "low").alias("low"))
        found = table(found, "targets")
        width -= STEP_BITS
    # within the last range, words by hash; documents of one hash share the cut by size
    near = docs.select(F.col(source).alias("s"), "size", "h").join(found, F.col("s").eqNullSafe(F.col("source"))).where((F.col("rest") > 0) & (F.col("h") >= F.col("low")) & (F.shiftright(F.col("h") - F.col("low"), width) < 1))
    by_hash = near.groupBy("source", "rest", "h").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("h")))
    cut = by_hash.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))).select(F.col("source").alias("s"), F.col("h").alias("cut"), (F.col("rest") - F.col("upto") + F.col("n")).alias("part"), F.col("n").alias("part_size"))
    done = found.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "whole", "cut", "part", "part_size")
    return table(done, "mix")


def decide(docs: DataFrame, found: DataFrame, source: str = "source") -> DataFrame:
    """docs (source, size, h, ...) with source_size, target, whole and extra: words of the fractional repetition."""
    plans = found.withColumnRenamed("source", "mix_source")
    extra = F.when(F.col("h") < F.col("cut"), F.col("size")).when(F.col("h") == F.col("cut"), F.expr("(part * size) div part_size")).otherwise(0)
    return docs.join(plans, F.col(source).eqNullSafe(F.col("mix_source"))).withColumn("extra", F.coalesce(extra, F.lit(0)).cast("long")).drop("mix_source", "cut", "part", "part_size")


def mix(docs: DataFrame, seed: int = 17, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Documents (doc_id, text, source, n_chars, any other columns) as the mix has them: a row for each repetition, the fractional one cut to its words.

    Null texts and texts without words are taken only with their source's whole repetitions. Repeated rows are rows of their own; of equal ids, whose hashes tie,
    each gets its share by size of what their cut leaves. Long texts are split into words only where a source's cut falls into them. An empty table gives an empty one.
    """
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {name: f"c{i}" for i, name in enumerate(columns)}
    text, h = F.col(at["text"]), seeded(seed, at["doc_id"])
    sized = table(renamed.select(F.col(at["source"]).alias("source"), size_of(text).alias("size"), h.alias("h")), "sizes")
    plans = plan(sized, seed=seed, max_epochs=max_epochs, weights=weights).select(F.col("source").alias("mix_source"), "whole", "cut", "part", "part_size")
    found = renamed.withColumn("h", h).join(plans, F.col(at["source"]).eqNullSafe(F.col("mix_source")))
    # words of the fractional repetition: -1 for all of them; they are counted only of the texts at a cut
    edge = F.col("h") == F.col("cut")
    found = found.withColumn("own", F.when(edge, size_of(text)))
    words = F.expr("(part * own) div part_size")
    words = F.when(F.col("h") < F.col("cut"), F.when(text.rlike(WORD), -1)).when(edge & (F.col("own") > 0), F.when(words == F.col("own"), -1).otherwise(words))
    found = found.withColumn("words", F.coalesce(words, F.lit(0)).cast("int"))
    copies = F.sequence(F.lit(1), (F.col("whole") + F.when(F.col("words") != 0, 1).otherwise(0)).cast("int"))
    taken = found.where((F.col("whole") > 0) | (F.col("words") != 0)).withColumn("copy", F.explode(copies))
    partial = (F.col("copy") > F.col("whole")) & (F.col("words") > 0)
    starts = F.split(text, r"(?<=[ \t-\r])(?=[^ \t-\r])")
    lead = F.when(text.rlike(r"^[ \t-\r]"), 1).otherwise(0)
    cut = F.array_join(F.slice(starts, F.lit(1), F.col("words") + lead), "")
    out = {"text": F.when(partial, cut).otherwise(text)}
    if "n_chars" in columns:
        out["n_chars"] = F.when(partial, F.length(cut).cast("long")).otherwise(F.col(at["n_chars"]))
    return taken.select(*[out.get(c, F.col(at[c])).alias(c) for c in columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = table(docs.select("doc_id", "source", size_of("text").alias("size"), seeded(17, "doc_id").alias("h")), "sizes")
    chosen = decide(sized, plan(sized))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
                  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, ((k - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER p - cap AS below, sum(weight) OVER () - (sum(weight) OVER p - weight) AS free, sum(source_size) OVER () AS total
      FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight, k ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((total - below)::DOUBLE / free) AS level FROM o WHERE (total - below)::DOUBLE / free <= cap::DOUBLE / weight
      AND NOT EXISTS (SELECT 1 FROM o q WHERE q.cap::DOUBLE / q.weight < o.cap::DOUBLE / o.weight AND (q.total - q.below)::DOUBLE / q.free <= q.cap::DOUBLE / q.weight)),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM w, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT *, round(target)::BIGINT - whole * source_size AS rest FROM g),
c AS (SELECT source, h, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.whole * d.size + CASE WHEN c.upto <= r.rest THEN d.size WHEN c.upto - c.n < r.rest THEN (r.rest - c.upto + c.n) * d.size // c.n ELSE 0 END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
