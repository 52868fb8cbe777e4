"""Registered queries of the operators for data that fits no task; the same registry as quernel.plans.queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quernel.functions.tokenizer import split_bytes
from quernel.operators import moments, selection, tsqr
from quernel.operators.attention import attention
from quernel.operators.matrix import Mat
from quernel.plans.queries import QUERIES, SERIES, SQL, V, as_cells, benchmark_ids, query, read, small_gpt, vectors

#: Blocks of 32 x 32, so that the tables here have several along every side.
SIDE = 32


def dense_rows(spark, sf_dir) -> Mat:
    """Embeddings as a matrix: the row number is the vec_id."""
    df = vectors(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "v")
    return Mat(df, df.agg(F.max("row_id") + 1).first()[0] or 0, 64)


@query(f"""WITH {V}, e AS (SELECT vec_id AS i, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS k FROM v),
g AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS x FROM e a JOIN e b USING (i) GROUP BY a.k, b.k)
SELECT e.i AS i, g.j::BIGINT AS j, round(sum(e.x * g.x), 6) + 0.0 AS v FROM e JOIN g ON e.k = g.i GROUP BY e.i, g.j""")
def mat_block_matmul(spark, sf_dir):
    """X (XᵀX) by blocks: a product along the rows, whose number grows, and one whose result grows."""
    x = dense_rows(spark, sf_dir).blocks(SIDE)
    out = x @ (x.T @ x)
    return as_cells(Mat(out.to_rows(), out.rows, out.cols))


PS = [0.0, 10.0, 50.0, 99.5, 100.0]


def _percentiles_sql(by: str, value: str, source: str) -> str:
    group = f"{by}, " if by else ""
    parts = " UNION ALL ".join(f"SELECT {group}{p}::DOUBLE AS p, count({value}) AS n, round(quantile_cont({value}, {p / 100}), 6) AS value FROM {source}" + (f" GROUP BY {by}" if by else "") for p in PS)
    return parts


@query(_percentiles_sql("", "l_extendedprice", "lineitem"))
def percentile_selected(spark, sf_dir):
    """Five percentiles of a whole column, selected digit by digit."""
    return selection.percentiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", PS).select("p", "n", F.round("value", 6).alias("value"))


@query(_percentiles_sql("l_suppkey", "l_extendedprice", "lineitem"))
def percentile_selected_grouped(spark, sf_dir):
    """The same for each supplier, in the same passes."""
    return selection.percentiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", PS, ["l_suppkey"]).select("l_suppkey", "p", "n", F.round("value", 6).alias("value"))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n FROM lineitem),
m AS (SELECT avg((a + b * l_quantity - l_extendedprice) ** 2) / 1e6 AS mse FROM lineitem, f)
SELECT '(intercept)' AS feature, 0 AS idx, round(a, 3) AS weight, n, round(mse, 4) AS mse_millions FROM f, m UNION ALL SELECT 'l_quantity', 1, round(b, 3), n, round(mse, 4) FROM f, m""")
def linreg_qr(spark, sf_dir):
    """Least squares by a tree of triangular factors."""
    out = tsqr.fit(read(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return out.select("feature", "idx", F.round("weight", 3).alias("weight"), "n", F.round(F.col("mse") / 1e6, 4).alias("mse_millions"))


#: Three sequences, which grow with the table: vec_id modulo 3, in the order of vec_id. Four heads.
HEADS = 4
SEQ = f"{V}, x AS (SELECT vec_id % 3 AS seq, vec_id // 3 AS pos, v FROM v)"


def sequences(spark, sf_dir):
    return vectors(spark, sf_dir).select((F.col("vec_id") % 3).alias("seq"), F.floor(F.col("vec_id") / 3).alias("pos"), "v")


def _cells(name: str, v: str, source: str) -> str:
    return f"{name} AS (SELECT seq, pos, unnest({v}) AS x, generate_subscripts({v}, 1) - 1 AS j FROM {source})"


def _attention_sql(q: str, k: str, v: str) -> str:
    """Cells (seq, pos, j, x) of queries, keys and values -> att, the same of the result."""
    return f"""sc AS (SELECT q.seq, q.pos, k.pos AS at_key, q.j // 16 AS h, sum(q.x * k.x) / 4.0 AS s FROM {q} q JOIN {k} k ON q.seq = k.seq AND q.j = k.j AND k.pos <= q.pos GROUP BY ALL),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos, h)) AS e FROM sc), pr AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, pos, h) AS p FROM ex),
att AS (SELECT pr.seq, pr.pos, v.j, sum(pr.p * v.x) AS x FROM pr JOIN {v} v ON v.seq = pr.seq AND v.pos = pr.at_key AND v.j // 16 = pr.h GROUP BY ALL)"""


def _rounded(df, column: str = "v", digits: int = 6):
    cells = df.select("seq", "pos", F.posexplode(column).alias("j", "x"))
    return cells.select("seq", "pos", F.col("j").cast("long").alias("j"), (F.round("x", digits) + 0.0).alias("x"))


@query(f"WITH {SEQ}, {_cells('c', 'v', 'x')}, {_attention_sql('c', 'c', 'c')} SELECT seq, pos, j::BIGINT AS j, round(x, 6) + 0.0 AS x FROM att")
def multi_head_attention(spark, sf_dir):
    """Causal attention of four heads, query, key and value being the vector: by blocks of 32, four to a cell."""
    return _rounded(attention(sequences(spark, sf_dir).select("seq", "pos", F.col("v").alias("q"), F.col("v").alias("k"), "v"), HEADS, block=32, span=4))


#: A weight's cells by a rule: ((a i + b j + c) mod 13 - 6) / 100, and biases the same of row 0.
WEIGHTS = {"q": (64, 64, 3, 5, 1), "k": (64, 64, 7, 2, 4), "v": (64, 64, 5, 11, 2), "o": (64, 64, 2, 9, 3), "fc": (64, 256, 4, 7, 5), "proj": (256, 64, 9, 4, 6)}


def weights() -> dict[str, np.ndarray]:
    out = {"ln1_g": np.full(64, 1.25), "ln1_b": np.full(64, 0.125), "ln2_g": np.full(64, 0.75), "ln2_b": np.full(64, -0.25)}
    for name, (rows, cols, a, b, c) in WEIGHTS.items():
        i, j = np.indices((rows, cols))
        out[name] = ((a * i + b * j + c) % 13 - 6) / 100
        out[f"{name}_b"] = ((b * np.arange(cols) + c) % 13 - 6) / 100
    return out


def _norm_sql(out: str, source: str, gamma: float, beta: float) -> str:
    """Cells (seq, pos, j, x) -> normed cells."""
    row = "OVER (PARTITION BY seq, pos)"
    return f"{out} AS (SELECT seq, pos, j, {gamma} * (x - avg(x) {row}) / sqrt(var_pop(x) {row} + 1e-5) + {beta} AS x FROM {source})"


def _affine_sql(out: str, source: str, name: str) -> str:
    rows, cols, a, b, c = WEIGHTS[name]
    return f"{out} AS (SELECT seq, pos, w.j, sum(s.x * w.w) + ((({b} * w.j + {c}) % 13) - 6) / 100.0::DOUBLE AS x FROM {source} s JOIN (SELECT i.i AS i, j.i AS j, ((({a} * i.i + {b} * j.i + {c}) % 13) - 6) / 100.0::DOUBLE AS w FROM range({rows}) i(i), range({cols}) j(i)) w ON s.j = w.i GROUP BY seq, pos, w.j)"


_add_sql = lambda out, a, b: f"{out} AS (SELECT seq, pos, j, a.x + b.x AS x FROM {a} a JOIN {b} b USING (seq, pos, j))"
GELU_SQL = f"0.5 * x * (1 + 2 / sqrt(pi()) * ({SERIES}))"


@query("WITH " + ", ".join([SEQ, _cells("c", "v", "x"), _norm_sql("h1", "c", 1.25, 0.125), *(_affine_sql(f"{n}c", "h1", n) for n in "qkv"), _attention_sql("qc", "kc", "vc"), _affine_sql("oc", "att", "o"), _add_sql("r1", "c", "oc"),
    _norm_sql("h2", "r1", 0.75, -0.25), _affine_sql("fcc", "h2", "fc"), f"gc AS (SELECT seq, pos, j, {GELU_SQL} AS x FROM fcc)", _affine_sql("pc", "gc", "proj"), _add_sql("r2", "r1", "pc")])
    + " SELECT seq, pos, j::BIGINT AS j, round(x, 5) + 0.0 AS x FROM r2")
def transformer_block(spark, sf_dir):
    """A whole pre-norm block of four causal heads and a GELU layer of four times the width, with weights by a rule."""
    from quernel.models.relational import block

    out = block(sequences(spark, sf_dir).withColumnRenamed("v", "x"), weights(), HEADS, rows=32, span=4)
    return _rounded(out, "x", 5)


BYTES = "((floor(x * 64)::BIGINT % 256) + 256) % 256"


@query(f"""WITH {V}, b AS (SELECT vec_id, list_transform(v, lambda x: {BYTES}) AS b FROM v)
SELECT vec_id AS row_id, md5(array_to_string(list_transform(v, lambda x: floor(x * 1048576)::BIGINT), ',')) AS floats, md5(array_to_string(b, ',')) AS bytes, coalesce(label, 255)::INTEGER AS label FROM v JOIN b USING (vec_id)""")
def binary_round_trip(spark, sf_dir):
    """Embeddings written in both binary layouts, by as many tasks as the session shuffles to, and read back by byte ranges of 16 KB."""
    from quernel.sources import binary
    from quernel.session import shared_folder

    folder = shared_folder(spark, "binary")
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("row_id"), "v", F.coalesce("label", F.lit(255)).alias("label"))
    binary.save(rows, f"{folder}/floats", (64,))
    binary.save(rows.withColumn("v", F.transform("v", lambda x: F.pmod(F.floor(x * 64), F.lit(256)))), f"{folder}/images", (8, 8), "idx")
    binary.save(rows.withColumn("v", F.array("label")), f"{folder}/labels", (1,), "idx")
    floats = binary.load(spark, f"{folder}/floats", split=1 << 14).select("row_id", "v")
    images = binary.load(spark, f"{folder}/images", "idx", labels=f"{folder}/labels", split=1 << 14).select("row_id", F.col("v").alias("b"), "label")
    text = lambda x: F.md5(F.array_join(x.cast("array<string>"), ",").cast("binary"))
    return floats.join(images, "row_id").select("row_id", text(F.transform("v", lambda x: F.floor(x.cast("double") * 1048576))).alias("floats"), text(F.col("b")).alias("bytes"), "label")


@query(f"""WITH RECURSIVE {V}, x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM v),
r AS (SELECT 0 AS t, vec_id, j, x, x AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM x UNION ALL
 SELECT t + 1, vec_id, j, x, w - 0.01 * ((m2 / (1 - 0.9 ** (t + 1))) / (sqrt(s2 / (1 - 0.999 ** (t + 1))) + 1e-8) + 0.01 * w), m2, s2
 FROM (SELECT *, 0.9 * m + 0.1 * g AS m2, 0.999 * s + 0.001 * g * g AS s2 FROM (SELECT *, x * ((t + 1) % 3 - 1) + 0.1 * (t + 1) AS g FROM r WHERE t < 10)))
SELECT vec_id, j::BIGINT AS j, round(w, 6) + 0.0 AS w, round(m, 6) + 0.0 AS m FROM r WHERE t = 10""")
def adam_ten_steps(spark, sf_dir):
    """Ten steps of Adam with gradients that change, over a bucketed state table of a row for each vector."""
    from quernel.models.tables import AdamTable

    rows = vectors(spark, sf_dir).select("vec_id", "v")
    table = AdamTable(rows.select("vec_id", F.col("v").alias("w")), "vec_id", 0.01, weight_decay=0.01)
    for t in range(1, 11):
        table.step(rows.select("vec_id", F.transform("v", lambda x: x * (t % 3 - 1) + 0.1 * t).alias("g")))
    cells = table.state.select("vec_id", F.posexplode(F.arrays_zip("w", "m")).alias("j", "x"))
    return cells.select("vec_id", F.col("j").cast("long").alias("j"), (F.round("x.w", 6) + 0.0).alias("w"), (F.round("x.m", 6) + 0.0).alias("m"))


@query(f"WITH {V}, e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM v) SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS v FROM e a JOIN e b USING (vec_id) GROUP BY a.j, b.j")
def covariance_wide(spark, sf_dir):
    """All 64 x 64 covariances, one block a task."""
    return moments.covariance_cells(vectors(spark, sf_dir), "v").select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {V}, e AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM v) SELECT i::INTEGER AS i, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(var_samp(x), 6) AS variance, round(stddev_samp(x), 6) AS stddev FROM e GROUP BY i")
def component_moments(spark, sf_dir):
    out = moments.component_moments(vectors(spark, sf_dir), "v")
    return out.select("i", "n", (F.round("mean", 6) + 0.0).alias("mean"), F.round("variance", 6).alias("variance"), F.round("stddev", 6).alias("stddev"))


#: Each text's bytes without the first doc_id modulo 4 and the last doc_id modulo 3, so that characters are cut at both ends; in SQL as hexadecimal digits.
HEX = "(?:[0-7].|[89AB].|F[89A-F])|[CD].(?:..)|E.(?:....)|F[0-7](?:......)|.."


@query(f"""WITH h AS (SELECT doc_id, substr(hex(encode(text)), 2 * (doc_id % 4) + 1, greatest(0, 2 * (strlen(text) - doc_id % 4 - doc_id % 3))::BIGINT) AS h FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, regexp_extract_all(h, '{HEX}') AS c FROM h) SELECT doc_id, len(c)::BIGINT AS n, len(list_filter(c, lambda x: len(x) > 2))::BIGINT AS longer, md5(array_to_string(c, ',')) AS characters FROM c""")
def byte_split(spark, sf_dir):
    """Characters of texts as bytes that are cut anywhere."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    raw, skip, lost = F.encode("text", "UTF-8"), F.col("doc_id") % 4, F.col("doc_id") % 3
    cut = F.substring(raw, (skip + 1).cast("int"), F.greatest(F.lit(0), F.length(raw) - skip - lost).cast("int"))
    c = docs.select("doc_id", split_bytes(cut).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.size(F.filter("c", lambda x: F.length(x) > 1)).cast("long").alias("longer"), F.md5(F.array_join(F.transform("c", F.hex), ",").cast("binary")).alias("characters"))


@query(None)
def gpt_logits(spark, sf_dir):
    """The forward pass with a row for each position: all texts of the benchmark in stretches of 16 characters; the loss of the next one."""
    from quernel.functions import neural
    from quernel.models.relational import gpt_logits

    ids = benchmark_ids(spark, sf_dir).select("item_id", F.posexplode("ids").alias("p", "id"), "ids")
    rows = ids.select((F.shiftleft("item_id", 32) + F.floor(F.col("p") / 16)).alias("seq"), (F.col("p") % 16).alias("pos"), "id", F.get("ids", F.col("p") + 1).alias("next"))
    out = gpt_logits(rows, small_gpt()).join(rows.select("seq", "pos", "next"), ["seq", "pos"]).where("next is not null")
    return out.select("seq", "pos", F.round(neural.cross_entropy("logits", "next"), 6).alias("loss"))


@query(f"WITH {V}, l AS (SELECT label, arg_max(v, vec_id) AS v FROM v GROUP BY label), e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM l) SELECT label, j::BIGINT AS j, round(x, 6) + 0.0 AS x FROM e")
def last_logits(spark, sf_dir):
    """The last row of each sequence of logits, a sequence being the vectors of a label in the order of vec_id."""
    last = vectors(spark, sf_dir).groupBy("label").agg(F.max_by("v", "vec_id").alias("v"))
    cells = last.select("label", F.posexplode("v").alias("j", "x"))
    return cells.select("label", F.col("j").cast("long").alias("j"), (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH {V}, e AS (SELECT vec_id AS i, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS j FROM v) SELECT i, j::BIGINT AS j, round(CASE WHEN i = 7 AND j = 3 THEN 99.5 ELSE v END, 6) + 0.0 AS v FROM e")
def mat_put(spark, sf_dir):
    return as_cells(dense_rows(spark, sf_dir).put(7, 3, 99.5))


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_linenumber::DOUBLE AS l_linenumber, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount FROM lineitem")
def csv_round_trip(spark, sf_dir):
    """Numeric columns written as CSV with a header, and read back strictly."""
    from quernel.session import shared_folder
    from quernel.sources import csv

    path = f"{shared_folder(spark, 'csv')}/lineitem"
    read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount").write.option("header", True).csv(path)
    return csv.read(spark, path)


@query("SELECT vec_id::VARCHAR AS name, len(embedding)::BIGINT AS cols, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS total FROM embeddings")
def matrix_round_trip(spark, sf_dir):
    """Named matrices, one a vector, saved and loaded as cells."""
    from quernel.session import shared_folder
    from quernel.sources import params

    path = f"{shared_folder(spark, 'params')}/p"
    cells = vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("name"), F.lit(0).cast("long").alias("i"), F.posexplode("v").alias("j", "value"))
    params.save(cells.withColumn("j", F.col("j").cast("long")), path)
    back = params.load(spark, path)
    return params.shapes(back).join(back.groupBy("name").agg((F.round(F.sum("value"), 6) + 0.0).alias("total")), "name").select("name", "cols", "total")


@query(r"""WITH t AS (SELECT regexp_replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '^[0-9]+\.\.\s*', '') AS line FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT replace(replace(text, chr(10), ' '), chr(13), ' ') FROM documents WHERE text IS NOT NULL)
SELECT md5(line) AS line_md5, count(*) AS n FROM t GROUP BY 1""")
def corpus_union(spark, sf_dir):
    """A numbered corpus cleaned, and another one after it, from text files."""
    from quernel.session import shared_folder
    from quernel.sources import text

    folder = shared_folder(spark, "text")
    line = F.translate("text", "\r\n", "  ").alias("value")
    for name in ("benchmark", "documents"):
        read(spark, sf_dir, name).where("text is not null").select(line).write.text(f"{folder}/{name}")
    return text.cleaned(spark, f"{folder}/benchmark", f"{folder}/documents").groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


__all__ = ["QUERIES", "SQL"]
