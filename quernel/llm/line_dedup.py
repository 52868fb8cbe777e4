"""Line dedup by site-relative frequency: a line that stands on too large a share of a host's pages is boilerplate there and goes.

Spark's own functions only. A line is compared without white space around it; blank lines always stay. What a page loses depends on its host and
text alone, so copies are worked out once and decisions come back by hashes of the two, not by row ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import small, table

#: A line is boilerplate on a host if over RATIO of its pages hold it, and MIN_PAGES at least.
RATIO, MIN_PAGES = 0.1, 5
#: Pages with boilerplate up to which their few hashes each are broadcast; beyond it the join is a shuffle.
DROP_ROWS = 200_000


def host_of(url: Column | str) -> Column:
    """The host of a URL, lower case, without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\n\v\f\r"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages (host, keys: distinct line keys of a page) -> (host, key, pages, total) of the lines to drop."""
    lines = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("total"))
    return lines.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > F.col("total") * ratio).select("host", "key", "pages", "total")


def drop_lines(df: DataFrame, host: str | tuple, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """df with text without its boilerplate lines, and n_lines, n_dropped (long); these replace columns of their names.

    A null host is a host of its own. A null text stays null, with 0 lines. Repeated rows count as pages of their own. An empty table stays empty.
    Without copies, a host's equal texts count as one page, and a page that would lose all but blank lines stays whole: a group of copies that makes up
    more than ratio of a host can't take its own lines away, and what is left of it is for the stage that removes copies.
    """
    names = df.columns
    said = F.col("__text")
    inner = df.toDF(*[f"__c{i}" for i in range(len(names))])
    inner = inner.withColumn("__text", F.col(f"__c{names.index(text)}")).withColumn("__host", df_host(host, names))
    keys = F.filter(F.array_distinct(F.transform(lines_of(said), line_key)), lambda k: k.isNotNull())
    mark = [F.xxhash64("__host", "__text").alias("m1"), F.xxhash64(F.lit(7), "__text", "__host").alias("m2")]
    pages = table(inner.where(said.isNotNull()).select(F.col("__host").alias("host"), *mark, keys.alias("keys")), "lines")
    empty = inner.where(said.isNull()).select(F.col("__host").alias("host"), F.array().cast("array<bigint>").alias("keys"))
    counted = pages.select("host", "keys")
    if not copies:
        counted = pages.groupBy("host", "m1", "m2").agg(F.first("keys").alias("keys")).select("host", "keys")
        empty = empty.distinct()
    found = table(boilerplate(counted.unionByName(empty), ratio, min_pages).select(F.col("host").alias("h"), "key"), "boilerplate")
    hit = pages.select("host", "m1", "m2", F.explode("keys").alias("key")).join(small(found), "key")
    hit = hit.where(F.col("host").eqNullSafe(F.col("h"))).groupBy("m1", "m2").agg(F.collect_set("key").alias("drops"))
    drops = small(table(hit, "drops"), DROP_ROWS)
    joined = inner.withColumns({"__m1": mark[0], "__m2": mark[1]}).join(drops, (F.col("__m1") == F.col("m1")) & (F.col("__m2") == F.col("m2")), "left")
    kept = F.filter(lines_of(said), lambda x: ~F.coalesce(F.array_contains("drops", line_key(x)), F.lit(False)))
    lost = F.col("drops").isNotNull()
    if not copies:
        lost = lost & F.exists(kept, lambda x: line_key(x).isNotNull())
    clean = F.when(lost, F.array_join(kept, "\n")).otherwise(said)
    n_lines = F.coalesce(F.size(lines_of(said)), F.lit(0))
    n_lines = F.when(said.isNull(), 0).otherwise(n_lines).cast("long")
    n_dropped = F.when(lost, n_lines - F.size(kept)).otherwise(0).cast("long")
    out = [(clean if c == text else F.col(f"__c{i}")).alias(c) for i, c in enumerate(names) if c not in ("n_lines", "n_dropped")]
    return joined.select(*out, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def df_host(host: str | tuple, names: list[str]) -> Column:
    """A column name, or a function of one as (function, name)."""
    if isinstance(host, tuple):
        return host[0](F.col(f"__c{names.index(host[1])}"))
    return F.col(f"__c{names.index(host)}")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of documents, a source being the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_lines(docs, "source")
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS bare FROM l),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (SELECT k.source, bare FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE bare <> '' GROUP BY k.source, bare, total
      HAVING count(DISTINCT rid) >= 5 AND count(DISTINCT rid) > total * 0.1::DOUBLE),
m AS (SELECT rid, line, pos, EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM k.source AND b.bare = k.bare) AS gone FROM k),
o AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS said FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN text IS NOT NULL THEN length(said) END::BIGINT AS n_chars_kept,
       CASE WHEN text IS NOT NULL THEN sha256(said) END AS kept_sha256
FROM d LEFT JOIN o USING (rid)
"""
