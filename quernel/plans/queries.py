"""The registered queries of the numerical operators, each beside the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import neural, rng, streams
from quernel.functions.tokenizer import CharTokenizer, char_counts, split_chars, train_val_split, windows
from quernel.models import nn
from quernel.operators import decoding, selection, stats
from quernel.operators.linalg import inverse_rows, solve_rows
from quernel.operators.matrix import Mat, batch_of, product
from quernel.operators.regression import LinearRegression, LogisticRegression, lazy_fit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return named


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v array<double>"""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def exploded(df: DataFrame, key: str, v: str = "v") -> DataFrame:
    return df.select(key, F.posexplode(v).alias("j", "x")).select(key, F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


#: What DuckDB begins with where vectors are needed as doubles.
V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
CELLS = "unnest({0}) AS x, generate_subscripts({0}, 1) - 1 AS j"


def cells_sql(value: str, key: str = "vec_id", extra: str = "", source: str = "v") -> str:
    return f"WITH {V}{extra}, e AS (SELECT {key}, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS j FROM (SELECT {key}, {value} AS w FROM {source})) SELECT {key}, j::BIGINT AS j, round(x, 6) + 0.0 AS x FROM e"


# Statistics


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(stddev_samp(l_quantity), 6) AS stddev, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag")
def stats_summary(spark, sf_dir):
    out = stats.summary(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "stddev")], "min", "max")


@query("SELECT round(var_pop(l_quantity), 6) AS variance FROM lineitem")
def variance_pop(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.round(stats.variance("l_quantity", False), 6).alias("variance"))


@query("SELECT l_linestatus, round(stddev_samp(l_discount), 6) AS sample, round(stddev_pop(l_discount), 6) AS population FROM lineitem GROUP BY l_linestatus")
def stddev_grouped(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(stats.stddev("l_discount"), 6).alias("sample"), F.round(stats.stddev("l_discount", False), 6).alias("population"))


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS sample, round(covar_pop(l_quantity, l_extendedprice), 2) AS population FROM lineitem")
def covariance_pair(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.round(stats.covariance("l_quantity", "l_extendedprice"), 2).alias("sample"), F.round(stats.covariance("l_quantity", "l_extendedprice", False), 2).alias("population"))


FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH " + "s AS (SELECT " + ", ".join(f"covar_samp({a}, {b}) AS s{i}_{j}" for i, a in enumerate(FOUR) for j, b in enumerate(FOUR)) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(s{i}_{j}, 1) + 0.0 AS v FROM s" for i in range(4) for j in range(4)))
def covariance_matrix(spark, sf_dir):
    return stats.covariance_matrix(read(spark, sf_dir, "lineitem"), FOUR).select("i", "j", (F.round("v", 1) + 0.0).alias("v"))


@query(f"WITH {V}, c AS (SELECT label, CASE WHEN stddev_samp(v[1]) * stddev_samp(v[2]) <> 0 THEN covar_samp(v[1], v[2]) / (stddev_samp(v[1]) * stddev_samp(v[2])) END AS r FROM v GROUP BY label) SELECT label, round(r, 6) AS r FROM c")
def correlation_safe(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("label").agg(F.round(stats.correlation(F.col("v")[0], F.col("v")[1]), 6).alias("r"))


@query("SELECT o_orderstatus, round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max FROM orders GROUP BY o_orderstatus")
def min_max(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(stats.minimum("o_totalprice"), 6).alias("min"), F.round(stats.maximum("o_totalprice"), 6).alias("max"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def percentile_grouped(spark, sf_dir):
    out = selection.wide(read(spark, sf_dir, "lineitem"), "l_extendedprice", {"p10": 10, "p90": 90}, ["l_returnflag"])
    return out.select("l_returnflag", F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"))


@query("SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY l_linestatus")
def median_grouped(spark, sf_dir):
    out = selection.wide(read(spark, sf_dir, "lineitem"), "l_extendedprice", {"median": 50}, ["l_linestatus"])
    return out.select("l_linestatus", F.round("median", 4).alias("median"))


LO, HI, BINS = 1000.0, 101000.0, 20
HISTOGRAM = f"b AS (SELECT trunc((l_extendedprice - {LO}) / {(HI - LO) / BINS})::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT s.i::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM range({BINS}) s(i) LEFT JOIN b ON b.bin = s.i)"


@query(f"WITH {HISTOGRAM} SELECT bin, n FROM h")
def histogram_trunc(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", LO, HI, BINS)


@query(f"WITH {HISTOGRAM} SELECT bin, n, {LO} + (bin + 0.5::DOUBLE) * {(HI - LO) / BINS}::DOUBLE AS center, trunc(50 * n::DOUBLE / greatest(1, max(n) OVER ()))::INTEGER AS bar FROM h")
def histogram_bars(spark, sf_dir):
    return stats.histogram_bars(histogram_trunc(spark, sf_dir), LO, HI, BINS)


# Matrices; a matrix of embeddings has a row per vec_id


def matrix(spark, sf_dir, n: int | None = None) -> Mat:
    df = vectors(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "v")
    return Mat(df, df.count(), 64)


def as_cells(m: Mat) -> DataFrame:
    return m.cells().select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def matrix_sql(value: str) -> str:
    return f"WITH {V}, e AS (SELECT vec_id AS i, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS j FROM (SELECT vec_id, {value} AS w FROM v)) SELECT i, j::BIGINT AS j, round(v, 6) + 0.0 AS v FROM e"


@query("SELECT a.i AS i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i) a, (SELECT unnest(range((SELECT count(*) FROM supplier))) AS i) b")
def mat_identity(spark, sf_dir):
    """As large as there are suppliers."""
    return as_cells(Mat.identity(spark, read(spark, sf_dir, "supplier").count()))


@query("SELECT a.i AS i, b.i AS j, 1.5::DOUBLE AS v FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS i) a, range(4) b(i)")
def mat_full(spark, sf_dir):
    """A row for each customer."""
    return as_cells(Mat.full(spark, read(spark, sf_dir, "customer").count(), 4, 1.5))


@query(f"WITH {V}, e AS (SELECT vec_id, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM v) SELECT i::BIGINT AS i, vec_id AS j, round(v, 6) + 0.0 AS v FROM e")
def mat_transpose(spark, sf_dir):
    """By blocks; rows are numbered by vec_id."""
    df = vectors(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "v")
    return as_cells(Mat(df, df.agg(F.max("row_id") + 1).first()[0] or 0, 64).T)


@query(matrix_sql("list_transform(v, lambda x: x * 2.5)"))
def mat_scale(spark, sf_dir):
    return as_cells(matrix(spark, sf_dir) * 2.5)


@query(matrix_sql("list_transform(v, lambda x: x + x * x)"))
def mat_add(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return as_cells(m + m.hadamard(m))


@query(matrix_sql("list_transform(v, lambda x: 3.0 * x - x)"))
def mat_sub(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return as_cells(3.0 * m - m)


@query(matrix_sql("list_transform(v, lambda x: x * x)"))
def mat_hadamard(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return as_cells(m.hadamard(m))


@query(matrix_sql("list_transform(v, lambda x: 7.0::DOUBLE)"))
def mat_fill(spark, sf_dir):
    return as_cells(matrix(spark, sf_dir).fill(7.0))


@query(matrix_sql("list_concat([1.0::DOUBLE], v)"))
def augment_bias(spark, sf_dir):
    return as_cells(matrix(spark, sf_dir).augment_bias())


@query(f"WITH {V}, e AS (SELECT vec_id AS i, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS j FROM v) SELECT a.j::BIGINT AS i, b.j::BIGINT AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN e b USING (i) GROUP BY a.j, b.j")
def mat_matmul(spark, sf_dir):
    """XᵀX by the cell join."""
    cells = matrix(spark, sf_dir).cells()
    return product(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), cells).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {V}, e AS (SELECT vec_id AS i, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS k FROM v), w AS (SELECT a.i AS k, b.i AS j, (a.i + b.i * 2) % 5 - 2.0 AS y FROM range(64) a(i), range(3) b(i)) SELECT e.i, w.j, round(sum(v * y), 6) + 0.0 AS v FROM e JOIN w USING (k) GROUP BY e.i, w.j")
def mat_times_thin(spark, sf_dir):
    """A tall matrix times a thin one, in Arrow batches."""
    import numpy as np

    k, j = np.indices((64, 3))
    return as_cells(matrix(spark, sf_dir).times((k + 2 * j) % 5 - 2.0))


@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) SELECT c_custkey, (k // 128)::BIGINT AS batch FROM c WHERE k // 128 < (SELECT count(*) // 128 FROM c)")
def minibatch_assign(spark, sf_dir):
    """Batches of consecutive rows in the order of keys, without a last one that isn't full; rows are numbered by range partitions, so no window is needed."""
    from quernel.models.training import numbered

    customers, base = numbered(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return customers.select("c_custkey", batch_of("n_th", 128).alias("batch")).where(F.col("batch") < base.count() // 128)


# Linear systems: normal equations of price by quantity for each flag

SYSTEM = "s AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(l_quantity) AS x, sum(l_quantity * l_quantity) AS xx, sum(l_extendedprice) AS y, sum(l_quantity * l_extendedprice) AS xy FROM lineitem GROUP BY l_returnflag)"


def systems(spark, sf_dir) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    sums = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"))
    return sums.select("l_returnflag", F.array("n", "x", "x", "xx").alias("a"), F.array("y", "xy").alias("b"))


@query(f"WITH {SYSTEM} SELECT l_returnflag, round((y * xx - x * xy) / (n * xx - x * x), 2) AS intercept, round((n * xy - x * y) / (n * xx - x * x), 3) AS slope FROM s")
def linear_solve_2x2(spark, sf_dir):
    return solve_rows(systems(spark, sf_dir), "a", "b").select("l_returnflag", F.round(F.col("x")[0], 2).alias("intercept"), F.round(F.col("x")[1], 3).alias("slope"))


@query(f"WITH {SYSTEM} SELECT l_returnflag, round(1e6 * xx / (n * xx - x * x), 6) AS i00, round(-1e6 * x / (n * xx - x * x), 6) AS i01, round(1e6 * n / (n * xx - x * x), 6) AS i11 FROM s")
def matrix_inverse_2x2(spark, sf_dir):
    out = inverse_rows(systems(spark, sf_dir), "a")
    return out.select("l_returnflag", *[F.round(F.col("inverse")[k] * 1e6, 6).alias(n) for k, n in ((0, "i00"), (1, "i01"), (3, "i11"))])


# Text

CHARS = "c AS (SELECT doc_id, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) - 1 AS p FROM documents WHERE text <> '')"
VOCAB = f"{CHARS}, f AS (SELECT token, min((doc_id, p)) AS place FROM c WHERE token <> '' GROUP BY token), vocab AS (SELECT token, (row_number() OVER (ORDER BY place) - 1)::INTEGER AS token_id FROM f)"


@query(f"WITH {CHARS} SELECT token, count(*) AS n FROM c WHERE token <> '' GROUP BY token")
def char_split_counts(spark, sf_dir):
    return char_counts(read(spark, sf_dir, "documents"), "text")


def tokenizer(spark, sf_dir) -> CharTokenizer:
    return CharTokenizer.fit(read(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"WITH {VOCAB} SELECT token, token_id FROM vocab")
def char_vocab(spark, sf_dir):
    return tokenizer(spark, sf_dir).vocab


@query(f"WITH {VOCAB}, e AS (SELECT doc_id, p, token_id FROM c JOIN vocab USING (token)) SELECT doc_id, count(*) AS n, md5(string_agg(token_id, ',' ORDER BY p)) AS ids_md5 FROM e GROUP BY doc_id")
def char_encode(spark, sf_dir):
    ids = tokenizer(spark, sf_dir).encode(read(spark, sf_dir, "documents"), "text", "doc_id").where(F.size("ids") > 0)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def char_decode_roundtrip(spark, sf_dir):
    own, docs = tokenizer(spark, sf_dir), read(spark, sf_dir, "documents").where("text is not null")
    return own.decode(own.encode(docs, "text", "doc_id"), "ids", "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query(f"WITH {CHARS}, k AS (SELECT DISTINCT token FROM c WHERE doc_id = (SELECT min(doc_id) FROM documents) AND token <> '') SELECT doc_id, count(*) FILTER (token IN (SELECT token FROM k)) AS known, count(*) FILTER (token <> '' AND token NOT IN (SELECT token FROM k)) AS dropped FROM c GROUP BY doc_id")
def oov_drop(spark, sf_dir):
    """A vocabulary learned from one document, applied to all."""
    docs = read(spark, sf_dir, "documents").where("text <> ''")
    first = docs.join(docs.agg(F.min("doc_id").alias("m")), F.col("doc_id") == F.col("m")).drop("m")
    sized = docs.select("doc_id", F.size(split_chars("text")).alias("all"))
    ids = CharTokenizer.fit(first, "text", "doc_id").encode(docs, "text", "doc_id").select("doc_id", F.size("ids").alias("known"))
    return sized.join(ids, "doc_id").select("doc_id", F.col("known").cast("long").alias("known"), (F.col("all") - F.col("known")).cast("long").alias("dropped"))


@query("WITH d AS (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE text <> '') SELECT doc_id, len(c) * 9 // 10 AS n_train, len(c) - len(c) * 9 // 10 AS n_val, md5(array_to_string(c[len(c) * 9 // 10 + 1:], '')) AS val_md5 FROM d")
def train_val_positions(spark, sf_dir):
    train, val = train_val_split(split_chars("text"))
    out = read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.size(train).cast("long").alias("n_train"), F.size(val).cast("long").alias("n_val"), F.md5(F.array_join(val, "")).alias("val_md5"))
    return out


@query("WITH b AS (SELECT item_id, string_split(text, '') AS c FROM benchmark WHERE text <> ''), s AS (SELECT item_id, c, unnest(range(greatest(len(c) - 64, 0))) AS start FROM b) SELECT item_id, start, md5(array_to_string(c[start + 1 : start + 64], '')) AS x_md5, md5(array_to_string(c[start + 2 : start + 65], '')) AS y_md5 FROM s")
def context_windows(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").where("text <> ''")
    w = items.select("item_id", F.explode(windows(split_chars("text"), 64)).alias("w"))
    return w.select("item_id", F.col("w.start").cast("long").alias("start"), F.md5(F.array_join("w.x", "")).alias("x_md5"), F.md5(F.array_join("w.y", "")).alias("y_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '^[0-9]+\.\.\s*', '')) AS line_md5 FROM documents WHERE text IS NOT NULL")
def strip_numbering(spark, sf_dir):
    from quernel.sources.text import without_numbering

    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(without_numbering("text")).alias("line_md5"))


# Regression


@query("SELECT '(intercept)' AS feature, 0 AS idx, round(regr_intercept(l_extendedprice, l_quantity), 2) AS weight FROM lineitem UNION ALL SELECT 'l_quantity', 1, round(regr_slope(l_extendedprice, l_quantity), 2) FROM lineitem")
def linreg_normal(spark, sf_dir):
    """Closed form, all in the plan: one aggregate, then a kernel on its one row."""
    return lazy_fit(read(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice").select("feature", "idx", F.round("weight", 2).alias("weight"))


TWO = """c AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, covar_samp(l_quantity, l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, covar_samp(l_discount, l_discount) AS d,
 covar_samp(l_quantity, l_extendedprice) AS p, covar_samp(l_discount, l_extendedprice) AS q FROM lineitem), w AS (SELECT (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2, * FROM c), f AS (SELECT my - w1 * m1 - w2 * m2 AS w0, w1, w2 FROM w)"""


@query(f"WITH {TWO} SELECT l_orderkey, l_linenumber, round(w0 + w1 * l_quantity + w2 * l_discount, 1) AS prediction FROM lineitem, f")
def linreg_predict(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    out = LinearRegression().fit_normal_equation(items, ["l_quantity", "l_discount"], "l_extendedprice").predict(items)
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 1).alias("prediction"))


@query(f"WITH {TWO} SELECT round(avg((w0 + w1 * l_quantity + w2 * l_discount - l_extendedprice) ** 2) / 1e6, 4) AS mse_millions FROM lineitem, f")
def linreg_mse(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    model = LinearRegression().fit_normal_equation(items, ["l_quantity", "l_discount"], "l_extendedprice")
    return items.agg(F.round(stats.mean_squared_error(model.prediction(), "l_extendedprice") / 1e6, 4).alias("mse_millions"))


@query("""WITH RECURSIVE f AS (SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, l_extendedprice / 100000 AS y FROM lineitem),
g AS (SELECT count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(y) AS t0, sum(x1 * y) AS t1, sum(x2 * y) AS t2 FROM f),
r AS (SELECT 0 AS k, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL
 SELECT k + 1, w0 - 0.1 * (n * w0 + s1 * w1 + s2 * w2 - t0) / n, w1 - 0.1 * (s1 * w0 + s11 * w1 + s12 * w2 - t1) / n, w2 - 0.1 * (s2 * w0 + s12 * w1 + s22 * w2 - t2) / n FROM r, g WHERE k < 200)
SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM r WHERE k = 200""")
def linreg_gd(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_extendedprice") / 100000).alias("y"))
    fit = lazy_fit(items, ["x1", "x2"], "y", lr=0.1, epochs=200)
    return fit.groupBy().pivot("idx", [0, 1, 2]).agg(F.round(F.first("weight"), 6)).toDF("w0", "w1", "w2")


EPOCHS = 10
LOGREG = f"""RECURSIVE f AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x1, l_discount * 10 AS x2, CASE WHEN l_extendedprice > 40000 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM lineitem),
r AS (SELECT 0 AS k, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL SELECT k + 1, w0 - 0.5 * avg(e), w1 - 0.5 * avg(e * x1), w2 - 0.5 * avg(e * x2)
 FROM (SELECT r.*, x1, x2, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) - y AS e FROM r, f WHERE k < {EPOCHS}) GROUP BY k, w0, w1, w2), w AS (SELECT w0, w1, w2 FROM r WHERE k = {EPOCHS})"""


def labelled(spark, sf_dir) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), F.when(F.col("l_extendedprice") > 40000, 1.0).otherwise(0.0).alias("y"))


def logistic(spark, sf_dir) -> tuple[DataFrame, LogisticRegression]:
    rows = labelled(spark, sf_dir)
    return rows, LogisticRegression().fit(rows, ["x1", "x2"], "y", lr=0.5, epochs=EPOCHS)


@query(f"WITH {LOGREG} SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM w")
def logreg_fit(spark, sf_dir):
    w = logistic(spark, sf_dir)[1].weights
    return spark.range(1).select(*[F.round(F.lit(float(x)), 6).alias(f"w{i}") for i, x in enumerate(w)])


@query(f"WITH {LOGREG} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))), 5) AS probability FROM f, w")
def logreg_proba(spark, sf_dir):
    rows, model = logistic(spark, sf_dir)
    return model.predict_proba(rows).select("l_orderkey", "l_linenumber", F.round("probability", 5).alias("probability"))


@query(f"WITH {LOGREG} SELECT l_orderkey, l_linenumber, CASE WHEN 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM f, w")
def logreg_predict(spark, sf_dir):
    rows, model = logistic(spark, sf_dir)
    return model.predict(rows).select("l_orderkey", "l_linenumber", "prediction")


@query(f"WITH {LOGREG} SELECT round(avg(CASE WHEN (1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f, w")
def logreg_accuracy(spark, sf_dir):
    rows, model = logistic(spark, sf_dir)
    return model.predict(rows).agg(F.round(stats.accuracy("prediction", "y"), 6).alias("accuracy"))


# Neural-network operations on the embeddings


def mapped(column) -> Query:
    return lambda spark, sf_dir: exploded(vectors(spark, sf_dir).select("vec_id", column(F.col("v")).alias("v")), "vec_id").select("vec_id", "j", (F.col("x") + 0.0).alias("x"))


SOFTMAX = "list_transform({0}, lambda x: exp((x - list_max({0})) / {1}) / list_sum(list_transform({0}, lambda y: exp((y - list_max({0})) / {1}))))"
QUERIES["relu"], SQL["relu"] = mapped(neural.relu), cells_sql("list_transform(v, lambda x: greatest(x, 0.0))")
QUERIES["softmax_rows"], SQL["softmax_rows"] = mapped(neural.softmax), cells_sql(SOFTMAX.format("v", "1.0"))
QUERIES["softmax_temperature"], SQL["softmax_temperature"] = mapped(lambda v: neural.softmax(v, 0.7)), cells_sql(SOFTMAX.format("v", "0.7"))
QUERIES["layernorm"] = mapped(lambda v: neural.layernorm(v, F.array_repeat(F.lit(1.5), 64), F.array_repeat(F.lit(0.25), 64)))
SQL["layernorm"] = cells_sql("list_transform(v, lambda x: 1.5 * (x - list_avg(v)) / sqrt(list_var_pop(v) + 1e-5) + 0.25)")
QUERIES["slice_cols"], SQL["slice_cols"] = mapped(lambda v: neural.slice_cols(v, 8, 16)), cells_sql("v[9:24]")
QUERIES["concat_cols"], SQL["concat_cols"] = mapped(lambda v: neural.concat_cols(neural.slice_cols(v, 0, 4), neural.slice_cols(v, 60, 4))), cells_sql("list_concat(v[1:4], v[61:64])")
#: 64 inputs, 2 outputs: ((3 i + 5 j) mod 7 - 3) / 4, and the biases 0.1 and -0.1.
LINEAR = [[((3 * i + 5 * j) % 7 - 3) / 4 for j in range(2)] for i in range(64)]
QUERIES["linear_forward"] = mapped(lambda v: neural.linear(v, LINEAR, [0.1, -0.1]))
SQL["linear_forward"] = cells_sql("[" + ", ".join(f"list_sum(list_transform(v, lambda x, i: x * ((3 * (i - 1) + {5 * j}) % 7 - 3) / 4.0)) + {bias}" for j, bias in ((0, 0.1), (1, -0.1))) + "]")
QUERIES["sigmoid"], SQL["sigmoid"] = mapped(lambda v: F.transform(v, neural.sigmoid)), cells_sql("list_transform(v, lambda x: 1 / (1 + exp(-x)))")
QUERIES["gelu"] = mapped(neural.gelu)
#: erf by its series, whose terms are below 1e-12 for the components here after 30.
SERIES = " + ".join(f"({'-' if k % 2 else ''}1.0 / {math.factorial(k) * (2 * k + 1)}.0) * (x / sqrt(2.0)) ** {2 * k + 1}" for k in range(24))
SQL["gelu"] = cells_sql(f"list_transform(v, lambda x: 0.5 * x * (1 + 2 / sqrt(pi()) * ({SERIES})))")


@query(f"WITH {V} SELECT vec_id, round(-ln({SOFTMAX.format('v', '1.0')}[label % 64 + 1] + 1e-12), 6) AS loss FROM v WHERE label IS NOT NULL")
def cross_entropy(spark, sf_dir):
    rows = vectors(spark, sf_dir).where("label is not null")
    return rows.select("vec_id", F.round(neural.cross_entropy("v", F.col("label") % 64), 6).alias("loss"))


@query(f"WITH {V} SELECT round(exp(avg(-ln({SOFTMAX.format('v', '1.0')}[label % 64 + 1] + 1e-12))), 6) AS perplexity FROM v WHERE label IS NOT NULL")
def perplexity(spark, sf_dir):
    rows = vectors(spark, sf_dir).where("label is not null").select(neural.cross_entropy("v", F.col("label") % 64).alias("loss"))
    return rows.agg(F.round(stats.perplexity("loss"), 6).alias("perplexity"))


@query(f"WITH {V}, p AS (SELECT vec_id, label, {SOFTMAX.format('v', '1.0')} AS p FROM v WHERE label IS NOT NULL), e AS (SELECT vec_id, label, unnest(p) AS q, generate_subscripts(p, 1) - 1 AS j FROM p) SELECT vec_id, j::BIGINT AS j, round(q - CASE WHEN j = label % 64 THEN 1 ELSE 0 END, 6) + 0.0 AS x FROM e")
def cross_entropy_grad(spark, sf_dir):
    rows = vectors(spark, sf_dir).where("label is not null")
    g = rows.select("vec_id", neural.cross_entropy_grad("v", F.col("label") % 64).alias("v"))
    return exploded(g, "vec_id").select("vec_id", "j", (F.col("x") + 0.0).alias("x"))


TOKENS = "t AS (SELECT event_id AS e_id, (event_id % (SELECT count(*) FROM embeddings))::BIGINT AS token_id FROM events)"


@query(f"WITH {V}, {TOKENS} SELECT e_id AS event_id, token_id, round(list_sum(v), 6) AS total FROM t JOIN v ON token_id = vec_id")
def embedding_lookup(spark, sf_dir):
    """Each event's row of the whole table, event_id modulo its size."""
    table = vectors(spark, sf_dir).select(F.col("vec_id").alias("token_id"), "v")
    tokens = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % max(1, table.count())).alias("token_id"))
    return neural.embedding(tokens, table).select("event_id", "token_id", F.round(neural.total("v"), 6).alias("total"))


@query("WITH g AS (SELECT (event_id % 97)::BIGINT AS token_id, [value, value * 2] AS g FROM events WHERE value IS NOT NULL), e AS (SELECT token_id, unnest(g) AS x, generate_subscripts(g, 1) - 1 AS j FROM g) SELECT token_id, j::INTEGER AS j, round(sum(x), 3) AS g FROM e GROUP BY token_id, j")
def embedding_scatter_grad(spark, sf_dir):
    grads = read(spark, sf_dir, "events").where("value is not null").select((F.col("event_id") % 97).alias("token_id"), F.array(F.col("value"), F.col("value") * 2).alias("g"))
    return neural.embedding_grad(grads).select("token_id", "j", F.round("g", 3).alias("g"))


@query(f"""WITH {V}, c AS (SELECT vec_id // 32 AS seq, vec_id % 32 AS i, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS d FROM v),
s AS (SELECT q.seq, q.i, k.i AS j, sum(q.v * k.v) / sqrt(64.0) AS s FROM c q JOIN c k ON q.seq = k.seq AND q.d = k.d AND k.i <= q.i GROUP BY q.seq, q.i, k.i),
m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, i)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, i) AS p FROM m)
SELECT p.seq, p.i, c.d::BIGINT AS d, round(sum(p.p * c.v), 6) + 0.0 AS v FROM p JOIN c ON c.seq = p.seq AND c.i = p.j GROUP BY p.seq, p.i, c.d""")
def causal_attention_head(spark, sf_dir):
    """Sequences of 32 vectors."""
    cells = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).alias("seq"), (F.col("vec_id") % 32).alias("i"), F.posexplode("v").alias("d", "v"))
    out = neural.causal_attention(cells.withColumn("d", F.col("d").cast("long")), 64)
    return out.select("seq", "i", "d", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {V} SELECT vec_id, list_position(v, list_max(v)) - 1 AS token FROM v")
def argmax(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", neural.argmax("v").alias("token"))


@query(f"WITH {V} SELECT label, round(avg(CASE WHEN list_position(v, list_max(v)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v GROUP BY label")
def argmax_accuracy(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", neural.argmax("v").alias("hat"))
    return rows.groupBy("label").agg(F.round(F.avg(F.when(F.col("hat") == F.col("label"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


KEPT = f"""{V}, l AS (SELECT vec_id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS token FROM (SELECT vec_id, {SOFTMAX.format('v', '0.1')} AS p FROM v)),
k AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY p DESC, token)),
kept AS (SELECT vec_id, token, rank, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM k WHERE rank <= 10 AND (rank = 1 OR before < 0.6))"""


def kept_tokens(spark, sf_dir) -> DataFrame:
    return decoding.filtered(decoding.token_probabilities(vectors(spark, sf_dir), "v", "vec_id", 0.1), "vec_id", 10, 0.6)


@query(f"WITH {KEPT} SELECT vec_id, token::INTEGER AS token, rank::INTEGER AS rank, round(p, 6) AS p FROM kept")
def topk_topp(spark, sf_dir):
    return kept_tokens(spark, sf_dir).select("vec_id", "token", "rank", F.round("p", 6).alias("p"))


@query(f"WITH {KEPT}, c AS (SELECT *, (vec_id * 7919 % 1000) / 1000.5 AS u, sum(p) OVER (PARTITION BY vec_id ORDER BY token ROWS UNBOUNDED PRECEDING) AS cdf FROM kept), n AS (SELECT vec_id, len(v) AS n FROM v) SELECT vec_id, (CASE WHEN max(u) <= 0 THEN 0 ELSE coalesce(min(token) FILTER (WHERE cdf >= u), max(n) - 1) END)::INTEGER AS token FROM c JOIN n USING (vec_id) GROUP BY vec_id")
def inverse_cdf(spark, sf_dir):
    u = vectors(spark, sf_dir).select("vec_id", ((F.col("vec_id") * 7919 % 1000) / 1000.5).alias("u"), (F.size("v") - 1).alias("last"))
    return decoding.draw(kept_tokens(spark, sf_dir), "vec_id", u)


# Optimizers on parameters kept as a table: weights are the vectors, gradients their squares less a tenth

PARAMS = f"{V}, w AS (SELECT vec_id, j, w, w * w - 0.1 AS g FROM (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) - 1 AS j FROM v))"


def parameters(spark, sf_dir) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("j", "w"))
    return rows.select("vec_id", F.col("j").cast("long").alias("j"), "w", (F.col("w") * F.col("w") - 0.1).alias("g"))


@query(f"WITH {PARAMS} SELECT vec_id, j::BIGINT AS j, round(w - 0.05 * g, 6) + 0.0 AS w FROM w")
def sgd_step(spark, sf_dir):
    return parameters(spark, sf_dir).select("vec_id", "j", (F.round(nn.sgd_column(F.col("w"), F.col("g"), 0.05), 6) + 0.0).alias("w"))


@query(f"WITH {PARAMS} SELECT vec_id, j::BIGINT AS j, round(w - 0.01 * ((0.1 * g / 0.1) / (sqrt(0.001 * g * g / 0.001) + 1e-8) + 0.01 * w), 6) + 0.0 AS w, round(0.1 * g, 6) + 0.0 AS m FROM w")
def adam_step(spark, sf_dir):
    zero = F.lit(0.0)
    w, m, _ = nn.adam_columns(F.col("w"), F.col("g"), zero, zero, 1, lr=0.01, weight_decay=0.01)
    return parameters(spark, sf_dir).select("vec_id", "j", (F.round(w, 6) + 0.0).alias("w"), (F.round(m, 6) + 0.0).alias("m"))


@query(f"WITH {PARAMS}, n AS (SELECT sqrt(sum(g * g)) AS n FROM w) SELECT vec_id, j::BIGINT AS j, round(CASE WHEN n > 1 THEN g * 1 / (n + 1e-6) ELSE g END, 6) + 0.0 AS g FROM w, n")
def clip_grad_norm(spark, sf_dir):
    rows = parameters(spark, sf_dir)
    both = rows.crossJoin(F.broadcast(rows.agg(stats.norm("g").alias("n"))))
    return both.select("vec_id", "j", (F.round(F.when(F.col("n") > 1, F.col("g") / (F.col("n") + 1e-6)).otherwise(F.col("g")), 6) + 0.0).alias("g"))


@query("SELECT o_orderkey, round(CASE WHEN i < 100 THEN i / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (i - 100) / 900.0))) END::DOUBLE, 6) AS lr FROM (SELECT o_orderkey, o_orderkey % 1201 AS i FROM orders)")
def cosine_lr(spark, sf_dir):
    """The rate at the step that each order stands for."""
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(nn.cosine_lr_column(F.col("o_orderkey") % 1201, 1000, 1.0, 100), 6).alias("lr"))


# Random streams, as exact as the serial one: a draw for each customer, in the order of keys

SEED = 42
STREAM = f"""RECURSIVE c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer), s0 AS (SELECT -1 AS id, {SEED}::UHUGEINT AS s UNION ALL SELECT id + 1, xor(b, b >> 27) FROM
 (SELECT id, xor(a, (a * 33554432) % 18446744073709551616::UHUGEINT) AS b FROM (SELECT id, xor(s, s >> 12) AS a FROM s0 WHERE id < (SELECT count(*) + 9 FROM customer)))),
u AS (SELECT id, ((s * 2685821657736338717::UHUGEINT % 18446744073709551616::UHUGEINT) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM s0 WHERE id >= 0)"""


def drawn(spark, sf_dir, draws: streams.Draws) -> DataFrame:
    return streams.attach(read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], draws, SEED)[0]


@query(f"WITH {STREAM} SELECT c_custkey, u AS value FROM u JOIN c USING (id)")
def rng_uniform(spark, sf_dir):
    return drawn(spark, sf_dir, streams.uniform())


NORMAL = "p AS (SELECT a.id, sqrt(-2 * ln(a.u)) AS r, 2 * pi() * b.u AS t FROM u a JOIN u b ON b.id = a.id + 1 WHERE a.id % 2 = 0), z AS (SELECT id, r * cos(t) AS z FROM p UNION ALL SELECT id + 1, r * sin(t) FROM p)"


@query(f"WITH {STREAM}, {NORMAL} SELECT c_custkey, round(1 + 2 * z, 6) AS value FROM z JOIN c USING (id)")
def rng_gaussian(spark, sf_dir):
    return drawn(spark, sf_dir, streams.gaussian(1.0, 2.0)).select("c_custkey", F.round("value", 6).alias("value"))


@query(f"WITH {STREAM} SELECT c_custkey, round(-ln(u) / 2, 6) AS value FROM u JOIN c USING (id)")
def rng_exponential(spark, sf_dir):
    return drawn(spark, sf_dir, streams.exponential(2.0)).select("c_custkey", F.round("value", 6).alias("value"))


@query(f"WITH {STREAM} SELECT c_custkey, CASE WHEN u < 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM u JOIN c USING (id)")
def rng_bernoulli(spark, sf_dir):
    return drawn(spark, sf_dir, streams.bernoulli(0.3))


#: A draw takes as many uniforms as its product needs to fall to exp(-4); k counts the factors beyond the first.
POISSON = f"""RECURSIVE c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer), p AS (SELECT 0 AS id, -1 AS k, 1.0::DOUBLE AS product, {SEED}::UHUGEINT AS s UNION ALL
 SELECT CASE WHEN product > exp(-4.0) THEN id ELSE id + 1 END, CASE WHEN product > exp(-4.0) THEN k + 1 ELSE 0 END, CASE WHEN product > exp(-4.0) THEN product ELSE 1.0 END
  * (((n * 2685821657736338717::UHUGEINT % 18446744073709551616::UHUGEINT) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE), n
 FROM (SELECT id, k, product, xor(b, b >> 27) AS n FROM (SELECT id, k, product, xor(a, (a * 33554432) % 18446744073709551616::UHUGEINT) AS b
  FROM (SELECT id, k, product, xor(s, s >> 12) AS a FROM p WHERE id < (SELECT count(*) FROM customer)))))"""


@query(f"WITH {POISSON} SELECT c_custkey, k AS value FROM (SELECT id, max(k)::DOUBLE AS k FROM p GROUP BY id) JOIN c USING (id)")
def rng_poisson(spark, sf_dir):
    return drawn(spark, sf_dir, streams.poisson(4.0))


@query(f"WITH {STREAM}, {NORMAL} SELECT c_custkey, round(c_acctbal + 100 * z, 4) AS noisy FROM z JOIN c USING (id) JOIN customer USING (c_custkey)")
def noisy_balance(spark, sf_dir):
    """A column with noise of the serial stream."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return streams.attach(rows, ["c_custkey"], streams.gaussian(0.0, 100.0), SEED)[0].select("c_custkey", F.round(F.col("c_acctbal") + F.col("value"), 4).alias("noisy"))


# Streaming's statistics on the table as a batch


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY ALL")
def windowed_moments(spark, sf_dir):
    from quernel.streaming.moments import windowed

    out = windowed(read(spark, sf_dir, "events"), "value", window="1 day", by=["event_type"])
    return out.select("start", "event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


# Models: kernels without SQL


def points(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).where("label is not null").select("vec_id", F.col("v").alias("x"), (F.col("label") % 2).alias("label"))


@query(None)
def mlp_train(spark, sf_dir):
    """Data-parallel training on whole vectors: each epoch's loss."""
    from quernel.models.training import MLP, fit_mlp

    losses = fit_mlp(points(spark, sf_dir), MLP(64, 8, 2, rng.Rng(1)), 5)
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@query(None)
def mlp_minibatch(spark, sf_dir):
    """Mini-batches of 50 in the order of vec_id, in rounds of four shards of two batches: each epoch's mean loss."""
    from quernel.models.training import MLP, fit_mlp_batches

    losses = fit_mlp_batches(points(spark, sf_dir).withColumnRenamed("vec_id", "id"), MLP(64, 16, 2, rng.Rng(1)), 3, 50, shards=4, batches=2)
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@query(None)
def mlp_train_groups(spark, sf_dir):
    """A model for each label modulo 4."""
    from quernel.models.training import fit_groups

    rows = vectors(spark, sf_dir).where("label is not null").select((F.col("label") % 4).alias("part"), F.col("v").alias("x"), F.shiftright("label", 2).bitwiseAND(1).alias("label"))
    return fit_groups(rows, "part", 64, 8, 2, 20)


def normals(seed: int, n: int, extra: str = "") -> str:
    """SQL: z (id, z), the first n (even) standard normals of the stream of a seed; extra: further tables."""
    return f"""RECURSIVE s0 AS (SELECT -1 AS id, {seed}::UHUGEINT AS s UNION ALL SELECT id + 1, xor(b, b >> 27) FROM
 (SELECT id, xor(a, (a * 33554432) % 18446744073709551616::UHUGEINT) AS b FROM (SELECT id, xor(s, s >> 12) AS a FROM s0 WHERE id < {n - 1}))),
u AS (SELECT id, ((s * 2685821657736338717::UHUGEINT % 18446744073709551616::UHUGEINT) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM s0 WHERE id >= 0),
z AS MATERIALIZED (SELECT a.id + k AS id, sqrt(-2 * ln(a.u)) * CASE WHEN k = 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * b.u) END AS z FROM u a JOIN u b ON b.id = a.id + 1, range(2) r(k) WHERE a.id % 2 = 0){extra}"""


#: 64 inputs, 8 hidden, 2 outputs; weights row by row, biases 0.
PERCEPTRON = normals(1, 64 * 8 + 8 * 2, f""", {V},
x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM v WHERE label IS NOT NULL),
h AS (SELECT vec_id, id % 8 AS j, greatest(sum(x * z * sqrt(2.0 / 64)), 0) AS h FROM x JOIN z ON id // 8 = i AND id < 512 GROUP BY vec_id, id % 8),
o AS (SELECT vec_id, id % 2 AS c, sum(h * z * sqrt(2.0 / 8)) AS o FROM h JOIN z ON (id - 512) // 2 = j AND id >= 512 GROUP BY vec_id, id % 2)""")


@query(f"WITH {PERCEPTRON} SELECT vec_id, arg_max(c, (o, -c))::INTEGER AS prediction FROM o GROUP BY vec_id")
def mlp_predict(spark, sf_dir):
    from quernel.models.training import MLP, predict_mlp

    return predict_mlp(points(spark, sf_dir), MLP(64, 8, 2, rng.Rng(1))).select("vec_id", "prediction")


def chunked(spark, sf_dir, width: int = 16) -> DataFrame:
    """All contexts of the benchmark's texts as character ids modulo 64; a text too short for a full one is one context, if it has two characters."""
    items = read(spark, sf_dir, "benchmark").where("text <> ''")
    items = items.repartition(spark.sparkContext.defaultParallelism, "item_id").select("item_id", F.transform(split_chars("text"), lambda c: F.ascii(c) % 64).alias("ids"))
    n = F.size("ids")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.slice("ids", F.lit(1), n - 1).alias("x"), F.slice("ids", F.lit(2), n - 1).alias("y")))
    w = items.where(n > 1).select("item_id", F.explode(F.when(n > width, windows("ids", width)).otherwise(whole)).alias("w"))
    return w.select((F.shiftleft("item_id", 32) + F.col("w.start")).alias("id"), F.col("w.x").alias("x"), F.col("w.y").alias("y"))


def small_gpt():
    from quernel.models.training import GPT, GPTConfig

    return GPT(GPTConfig(64, 16, 2, 1, 16), rng.Rng(7))


@query(None)
def gpt_forward(spark, sf_dir):
    from quernel.models.training import gpt_losses

    return gpt_losses(chunked(spark, sf_dir), small_gpt()).select("id", F.round("loss", 6).alias("loss"))


def benchmark_ids(spark, sf_dir) -> DataFrame:
    """The benchmark's texts as character ids modulo 64."""
    items = read(spark, sf_dir, "benchmark").where("text <> ''")
    return items.select("item_id", F.transform(split_chars("text"), lambda c: F.ascii(c) % 64).alias("ids"))


@query(None)
def gpt_train(spark, sf_dir):
    """Three steps on random windows of the joined texts."""
    from quernel.models.training import TokenCorpus, fit_gpt

    corpus = TokenCorpus(benchmark_ids(spark, sf_dir), ["item_id"])
    losses = fit_gpt(corpus, small_gpt(), 3, batch=8, lr=1e-2)
    corpus.unpersist()
    return spark.createDataFrame(list(enumerate(losses)), "step int, loss double")


#: Windows as a serial loop draws them from the joined text of the benchmark: 40 of 64 ids, by the stream of seed 2026.
DRAWN = """RECURSIVE s0 AS (SELECT -1 AS id, 2026::UHUGEINT AS s UNION ALL SELECT id + 1, xor(b, b >> 27) FROM
 (SELECT id, xor(a, (a * 33554432) % 18446744073709551616::UHUGEINT) AS b FROM (SELECT id, xor(s, s >> 12) AS a FROM s0 WHERE id < 39))),
u AS (SELECT id, ((s * 2685821657736338717::UHUGEINT % 18446744073709551616::UHUGEINT) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM s0 WHERE id >= 0),
t AS (SELECT string_agg(text, '' ORDER BY item_id) AS t FROM benchmark WHERE text <> ''),
w AS (SELECT id, least(floor(u * (length(t) - 64))::BIGINT, length(t) - 65) AS s, t FROM u, t)"""


@query(f"WITH {DRAWN} SELECT id::BIGINT AS id, md5(array_to_string(list_transform(string_split(substring(t, s + 1, 64), ''), lambda c: ascii(c) % 64), ',')) AS x_md5, md5(array_to_string(list_transform(string_split(substring(t, s + 2, 64), ''), lambda c: ascii(c) % 64), ',')) AS y_md5 FROM w")
def sampled_windows(spark, sf_dir):
    """Random windows by the offset index: they go over documents, and no window is stored."""
    from quernel.operators.corpus import TokenCorpus

    out = TokenCorpus(benchmark_ids(spark, sf_dir), ["item_id"]).sample(rng.Rng(2026), 40, 64)
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"))
    return out.select("id", text("x").alias("x_md5"), text("y").alias("y_md5"))


@query(None)
def gpt_generate(spark, sf_dir):
    """Whole texts as prompts; the model sees the last ids of each."""
    from quernel.models.training import generate

    prompts = read(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.transform(split_chars("text"), lambda c: F.ascii(c) % 64).alias("ids"))
    return generate(prompts, small_gpt(), 8, decoding.SampleConfig(0.8, 40, 0.9), "item_id")
