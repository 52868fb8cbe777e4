"""Chat formatting: logged snapshots of a growing conversation collapse to the longest, which is then rendered. Spark's own functions only.

Each turn gets the hash of all turns up to it (rolling prefix hash: the xor of hashes of place, role and text). A conversation whose whole hash
is the prefix hash of a longer one is a snapshot of that one and is dropped by an anti-join; of equal ones the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def render(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns -> one row for each maximal conversation: conv_id, n_turns long, n_chars long, rendered string.

    Turns are ordered by turn (null first), those that tie by the md5 of their rendered line; repeated rows are turns of their own. A null role or text is empty.
    Rows without a conversation id belong to none. An empty table gives an empty one. The hashes are shuffled without the texts, and prefixes are
    pre-aggregated, so a first turn or a whole conversation that many share is one row; only a conversation's own turns meet, as its one rendered text requires.
    """
    said = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    line_of = lambda role, text: F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))
    place = F.unhex(F.md5(line_of(F.col("role"), F.col("text")).cast("binary"))).alias("digest")
    hashes = said.select("conv_id", "turn", place, F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"))
    order = Window.partitionBy("conv_id").orderBy("turn", "digest")
    placed = hashes.withColumn("place", F.row_number().over(order)).withColumn("turns", F.count("*").over(Window.partitionBy("conv_id")))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    prefix = placed.select("conv_id", "place", "turns", F.bit_xor(F.xxhash64("place", "a")).over(so_far).alias("h1"), F.bit_xor(F.xxhash64("b", "place")).over(so_far).alias("h2"))
    whole = prefix.where("place = turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = prefix.where("place < turns").select("place", "h1", "h2").distinct()
    kept = whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id")
    turns = said.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", place, "role", "text"))).alias("turns"))
    line = F.transform("turns", lambda t: line_of(t["role"], t["text"]))
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(line, "").alias("rendered"))
    return out.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), "rendered")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders the maximal conversations."""
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (SELECT conv_id, turn, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns, string_agg(line, '') OVER w AS said
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(line) ROWS UNBOUNDED PRECEDING)),
f AS (SELECT min(conv_id) AS conv_id, turns, said FROM p WHERE place = turns GROUP BY turns, said)
SELECT conv_id, turns::BIGINT AS n_turns, length(said)::BIGINT AS n_chars, said AS rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.turns AND p.place = f.turns AND p.said = f.said)
"""
