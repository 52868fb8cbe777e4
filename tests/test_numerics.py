import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import neural, rng, streams
from quernel.functions.rng import Rng
from quernel.functions.tokenizer import CharTokenizer, split_chars, train_val_split, windows
from quernel.operators import decoding, linalg, stats
from quernel.operators.matrix import Mat, add_cells, batch_of, full_batches, product
from quernel.operators.regression import LinearRegression, LogisticRegression, NotFitted, lazy_fit


# matrices and systems


def test_matrix_constructors(spark):
    m = Mat.full(spark, 2, 3, 1.5)
    assert (m.rows, m.cols, m.size) == (2, 3, 6) and (m.to_numpy() == 1.5).all()
    assert (Mat.identity(spark, 3).to_numpy() == np.eye(3)).all()
    with pytest.raises(ValueError):
        Mat.from_rows(spark, [[1, 2], [3]])
    with pytest.raises(IndexError):
        m.at(2, 0)
    assert str(Mat.from_rows(spark, [[1, 2.5]])) == "Matrix(1x2)\n[1, 2.5]"


def test_matrix_operations(spark):
    x, y = Mat.from_rows(spark, [[1, 2], [3, 4]]), Mat.from_rows(spark, [[5, 6], [7, 8]])
    assert (x @ y).to_numpy().tolist() == [[19, 22], [43, 50]]
    assert (x + y).at(0, 0) == 6 and (y - x).at(1, 1) == 4 and (2 * x).at(0, 1) == 4 and x.hadamard(y).at(1, 1) == 32 and x.T.at(0, 1) == 3
    assert x.fill(9).to_numpy().tolist() == [[9, 9], [9, 9]]
    assert x.augment_bias().to_numpy().tolist() == [[1, 1, 2], [1, 3, 4]]
    assert x.slice_rows(1, 1).to_numpy().tolist() == [[3, 4]]
    assert x.gram(y).tolist() == (np.array([[1, 3], [2, 4]]) @ np.array([[5, 6], [7, 8]])).tolist()
    assert {(r.i, r.j): r.v for r in product(x.cells(), y.cells()).collect()} == {(0, 0): 19, (0, 1): 22, (1, 0): 43, (1, 1): 50}
    assert {(r.i, r.j): r.v for r in add_cells(x.cells(), x.cells()).collect()}[(1, 1)] == 8
    for bad in (lambda: x @ Mat.full(spark, 3, 1), lambda: x + Mat.full(spark, 2, 3), lambda: x.hadamard(Mat.full(spark, 1, 2))):
        with pytest.raises(ValueError):
            bad()


def test_matrix_null_is_refused(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None)], "id long, a double")
    with pytest.raises(Exception, match="a null in a"):
        Mat.from_df(df, ["a"], "id").to_numpy()


def test_batches(spark):
    assert [r[0] for r in spark.range(7).select(batch_of("id", 3)).collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert full_batches(7, 3) == 2


def test_solve():
    assert np.allclose(linalg.solve([[2, 1], [1, 3]], [5, 10]), [1, 3])
    assert np.allclose(linalg.solve([[0, 1], [1, 0]], [2, 3]), [3, 2])
    a = np.array([[4.0, 7, 1], [2, 6, 0], [1, 0, 3]])
    assert np.allclose(a @ linalg.inverse(a), np.eye(3))
    for singular in ([[1, 2], [2, 4]], [[1, 0], [0, 1e-13]]):
        with pytest.raises(linalg.SingularMatrix):
            linalg.solve(singular, [1, 2])
    for bad in (lambda: linalg.solve([[1, 2]], [1]), lambda: linalg.solve([[1, 0], [0, 1]], [1]), lambda: linalg.inverse([[1, 2]])):
        with pytest.raises(ValueError):
            bad()


# statistics


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 6)], "x double")
    v = lambda what, **a: stats.value(df, what, "x", **a)
    assert (v("mean"), v("variance"), v("variance", sample=False), v("median"), v("minimum"), v("maximum")) == (3, 2.5, 2, 3, 1, 5)
    assert [round(v("percentile", p=p), 9) for p in (0, 10, 25, 50, 100)] == [1, 1.4, 2, 3, 5]
    assert v("stddev") == pytest.approx(math.sqrt(2.5))
    for p in (-1, 101):
        with pytest.raises(ValueError):
            stats.percentile("x", p)
    empty, one = df.limit(0), df.limit(1)
    for what in ("mean", "minimum", "maximum", "median"):
        with pytest.raises(ValueError):
            stats.value(empty, what, "x")
    with pytest.raises(ValueError):
        stats.value(one, "variance", "x", sample=False)
    with pytest.raises(ValueError):
        stats.matrix_value(one, ["x"])


def test_correlation_and_covariance(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1, 11.0 - 2 * x, 7.0) for x in range(1, 5)], "x double, y double, z double, c double")
    assert stats.value(df, "correlation", "x", "y") == pytest.approx(1) and stats.value(df, "correlation", "x", "z") == pytest.approx(-1)
    assert stats.value(df, "covariance", "x", "y") == pytest.approx(2 * stats.value(df, "variance", "x"))
    assert math.isnan(stats.value(df, "correlation", "x", "c"))
    m = stats.matrix_value(df.selectExpr("x AS a", "2 * x AS b"), ["a", "b"])
    assert m[0][1] == m[1][0] and m[1][1] == pytest.approx(4 * m[0][0])


def test_histogram_edges(spark):
    lo, hi, bins = 0.0, 4.0, 4
    df = spark.createDataFrame([(x,) for x in (-0.5, 0.0, 4.0, 3.999999, -1.0, None, float("nan"))], "x double")
    assert sorted((r.bin, r.n) for r in stats.histogram(df, "x", lo, hi, bins).collect()) == [(0, 2), (1, 0), (2, 0), (3, 1)]


# random streams


GOLDEN = {
    42: ([6255019084209693600, 14430073426741505498, 14575455857230217846], [0.33908526400192196, 0.7822558479199243, 0.7901370452687786], [0.2960330150871692, -1.440615086680639, 0.6443779794453868]),
    1: ([5180492295206395165, 12380297144915551517, 13389498078930870103], [0.28083505005035947, 0.6711372530266764, 0.7258461452833668], [-0.7577863290384503, -1.4020468838556457, -0.2641954195379085]),
    0: ([973819730272012410, 6108091081255984487, 12125365036566318712], [0.052790873358508184, 0.33112028100185353, 0.6573173557412489], [-1.183403831048955, 2.117165389193116, -0.9142438849714216]),
}


@pytest.mark.parametrize("seed", GOLDEN)
def test_stream(seed):
    bits, uniforms, gaussians = GOLDEN[seed]
    r = Rng(seed)
    assert [r.next_u64() for _ in range(3)] == bits
    r = Rng(seed)
    assert [r.uniform() for _ in range(3)] == uniforms
    r = Rng(seed)
    assert [r.gaussian() for _ in range(3)] == pytest.approx(gaussians, abs=1e-15)


def test_jump_and_partitions(spark):
    r = Rng(42)
    serial = [r.uniform() for _ in range(1000)]
    assert rng.jump(Rng(42).state, 1000) == r.state
    assert [x.value for x in streams.frame(spark, 1000, "uniform", 42).orderBy("id").collect()] == serial


def test_moments_of_one_stream():
    r, n = Rng(42), 20_000
    u = np.array([r.uniform() for _ in range(n)])
    g = r.gaussians((n,), 3, 2)
    b = np.mean([r.bernoulli(0.3) for _ in range(n)])
    e = np.mean([r.exponential(2) for _ in range(n)])
    p = np.mean([r.poisson(4) for _ in range(n)])
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.01 and abs(g.mean() - 3) < 0.05 and abs(g.std() - 2) < 0.05
    assert abs(b - 0.3) < 0.02 and abs(e - 0.5) < 0.02 and abs(p - 4) < 0.06


# tokenizer


def test_tokenizer(spark):
    docs = spark.createDataFrame([(0, "abcabc"), (1, "áàá"), (2, "Đi😀"), (3, ""), (4, None)], "id long, text string")
    own = CharTokenizer.fit(docs, "text", "id")
    assert [(r.token, r.token_id) for r in own.vocab.orderBy("token_id").collect()][:3] == [("a", 0), ("b", 1), ("c", 2)]
    ids = own.encode(docs, "text", "id")
    assert {r.id: r.text for r in own.decode(ids, "ids", "id").collect()} == {0: "abcabc", 1: "áàá", 2: "Đi😀", 3: "", 4: ""}
    assert own.contains("Đ") and not own.contains("Q") and own.token(0) == "a"
    odd = spark.createDataFrame([(0, "QaZb")], "id long, text string")
    assert own.encode(odd, "text", "id").first().ids == [0, 1]
    assert own.decode(spark.createDataFrame([(0, [0, 999, 1])], "id long, ids array<int>"), "ids", "id").first().text == "ab"
    assert docs.where("id = 2").select(split_chars("text")).first()[0] == ["Đ", "i", "😀"]
    accents = CharTokenizer.fit(docs.where("id = 1"), "text", "id")
    assert accents.vocab_size == 2


def test_split_and_windows(spark):
    df = spark.createDataFrame([(list(range(11)),), ([1, 2],), ([],)], "ids array<int>")
    train, val = train_val_split("ids")
    assert [(r[0], r[1]) for r in df.select(train, val).collect()] == [(list(range(9)), [9, 10]), ([1], [2]), ([], [])]
    w = df.select(windows("ids", 10)).collect()
    assert [(x.start, x.x, x.y) for x in w[0][0]] == [(0, list(range(10)), list(range(1, 11)))] and w[1][0] == [] and w[2][0] == []


# regression


LINE = [(1, 1), (2, 1), (1, 2), (3, 2), (2, 3), (0, 0)]


def test_linear_regression(spark):
    df = spark.createDataFrame([(float(a), float(b), 2.0 * a + 3 * b + 1) for a, b in LINE], "x1 double, x2 double, y double")
    model = LinearRegression().fit_normal_equation(df, ["x1", "x2"], "y")
    assert np.allclose(model.weights, [1, 2, 3], atol=1e-6) and model.mse(df, "y") < 1e-12
    lazy = {r.idx: r.weight for r in lazy_fit(df, ["x1", "x2"], "y").collect()}
    assert np.allclose([lazy[i] for i in range(3)], [1, 2, 3])
    model.fit_gradient_descent(df, ["x1", "x2"], "y", lr=0.05, epochs=20_000)
    assert np.allclose(model.weights[1:], [2, 3], atol=0.05) and model.mse(df, "y") < 1e-3
    with pytest.raises(NotFitted):
        LinearRegression().predict(df)
    with pytest.raises(NotFitted):
        model.predict(df.drop("x2"))
    with pytest.raises(ValueError):
        LinearRegression().fit_normal_equation(df.limit(0), ["x1"], "y")


def test_logistic_regression(spark):
    df = streams.clusters(spark.range(400), ["id"], 7).coalesce(2)
    model = LogisticRegression().fit(df, ["x1", "x2"], "y", lr=0.1, epochs=40)
    assert model.accuracy(df, "y") > 0.95
    p = model.predict_proba(df).agg(F.min("probability"), F.max("probability")).first()
    assert 0 < p[0] < p[1] < 1
    with pytest.raises(NotFitted):
        LogisticRegression().predict(df)


def test_partitioning_does_not_matter(spark):
    df = streams.noisy_line(spark.range(300), ["id"], 5)
    fits = [LinearRegression().fit_normal_equation(df.repartition(n), ["x"], "y").weights for n in (1, 4, 16)]
    assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])


# decoding


def logits(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, z array<double>")


def test_softmax_and_argmax(spark):
    df = logits(spark, [[0.1, 2.5, -1.0, 0.3], [1.0, 1.0]])
    p = df.select(neural.softmax("z"), neural.argmax("z")).collect()
    assert p[0][0] == pytest.approx([0.0736515313, 0.8118738202, 0.0245164650, 0.0899581835]) and [r[1] for r in p] == [1, 0]


def brute_filter(z, k, top_p, t=1.0):
    p = np.exp((np.array(z) - max(z)) / t)
    p /= p.sum()
    kept, cum = [], 0.0
    for i in sorted(range(len(p)), key=lambda i: (-p[i], i)):
        kept.append(i)
        cum += p[i]
        if (k and len(kept) >= k) or (top_p < 1 and cum >= top_p):
            break
    return {i: p[i] / p[kept].sum() for i in kept}


@pytest.mark.parametrize(("k", "top_p"), [(0, 1.0), (1, 1.0), (2, 0.9), (3, 0.5), (0, 0.0), (10, 0.3)])
def test_filter_and_draw(spark, k, top_p):
    rows = [[0.1, 2.5, -1.0, 0.3], [0.0, 0.0, 0.0, 0.0], [3.0, 1.0, 2.0, 0.0]]
    kept = decoding.filtered(decoding.token_probabilities(logits(spark, rows), "z", "id"), "id", k, top_p)
    got = {}
    for r in kept.collect():
        got.setdefault(r.id, {})[r.token] = r.p
    for i, z in enumerate(rows):
        assert got[i] == pytest.approx(brute_filter(z, k, top_p))
    u = spark.createDataFrame([(0, 0.0, 3), (1, 0.5, 3), (2, 1.5, 3)], "id long, u double, last int")
    drawn = {r.id: r.token for r in decoding.draw(kept, "id", u).collect()}
    sums = np.cumsum([got[1].get(t, 0.0) for t in range(4)])
    assert drawn == {0: 0, 1: int(np.searchsorted(sums, 0.5)), 2: 3}


def test_draw_by_token(spark):
    """By hand: 0.2, 0.5, 0.3 in the order of tokens reach 0.2, 0.7, 1; without the first, renormalised, 0, 0.625, 1."""
    u = {0: 0.1, 1: 0.6, 2: 0.75, 3: 0.2}
    df = spark.createDataFrame([(i, [math.log(p) for p in (0.2, 0.5, 0.3)]) for i in u], "id long, z array<double>")
    us = spark.createDataFrame(list(u.items()), "id long, u double")

    class At:
        def __init__(self, x):
            self.x = x

        def uniform(self):
            return self.x

    for config, want in ((decoding.SampleConfig(), {0: 0, 1: 1, 2: 2, 3: 0}), (decoding.SampleConfig(top_k=2), {0: 1, 1: 1, 2: 2, 3: 1})):
        us_near = us.withColumn("u", F.col("u") - 1e-9)
        assert {r.id: r.token for r in decoding.sample(df, "z", "id", config, us_near).collect()} == want
        assert {i: decoding.sample_one([math.log(p) for p in (0.2, 0.5, 0.3)], config, At(x - 1e-9)) for i, x in u.items()} == want


def test_sample_one():
    z, r = [0.1, 2.5, -1.0, 0.3], Rng(1)
    assert {decoding.sample_one(z, decoding.SampleConfig(0.01), r) for _ in range(50)} == {1}
    assert {decoding.sample_one(z, decoding.SampleConfig(top_k=1), r) for _ in range(50)} == {1}
    assert {decoding.sample_one([0, 0, 0, 0], decoding.SampleConfig(), r) for _ in range(400)} == {0, 1, 2, 3}
    assert {decoding.sample_one(z, decoding.SampleConfig(0.0), r) for _ in range(20)} == {1}


def test_column_forms(spark):
    df = logits(spark, [[-1.0, 0.0, 2.0]])
    row = df.select(neural.relu("z"), neural.layernorm("z"), neural.gelu("z"), neural.linear("z", [[1, 0], [0, 1], [1, 1]], [0.5, 0]), neural.cross_entropy("z", F.lit(2))).first()
    x = np.array([-1.0, 0, 2])
    assert row[0] == [0, 0, 2] and row[1] == pytest.approx((x - x.mean()) / np.sqrt(x.var() + 1e-5))
    assert row[2] == pytest.approx([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]) and row[3] == [1.5, 2]
    assert row[4] == pytest.approx(-math.log(np.exp(2) / np.exp(x).sum()))


def test_minibatches_of_keys_with_gaps(spark, tmp_path):
    from quernel.plans import queries

    keys = sorted([i * 5 for i in range(250)] + [35] * 20)
    spark.createDataFrame([(k,) for k in reversed(keys)], "c_custkey long").repartition(5).write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted((r.batch, r.c_custkey) for r in queries.QUERIES["minibatch_assign"](spark, str(tmp_path)).collect())
    assert got == [(k // 128, key) for k, key in enumerate(keys[:256])]


def test_texts_are_looked_at_a_piece_at_a_time(monkeypatch):
    import pyarrow as pa

    from quernel.functions import tokenizer

    monkeypatch.setattr(tokenizer, "PIECE", 10)
    texts = ["abc", None, "", "defghij", "k" * 25, "l", "m" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["id", "text"])
    found = [p.column(1).to_pylist() for p in tokenizer.pieces(batch, 1)]
    assert sum(found, []) == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in found)
    ids = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([[1] * 6, None, [2] * 6], pa.list_(pa.int32()))], names=["id", "ids"])
    assert [p.num_rows for p in tokenizer.pieces(ids, 1)] == [2, 1]
    assert list(tokenizer.pieces(batch.slice(0, 0), 1)) == []


def test_cells_of_an_identity_take_few_bytes(spark, tmp_path):
    n = 2500
    cells = Mat.identity(spark, n).cells()
    cells.coalesce(1).write.parquet(f"{tmp_path}/cells")
    back = spark.read.parquet(f"{tmp_path}/cells")
    assert back.count() == n * n and back.distinct().count() == n * n and back.agg(F.sum("v"), F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()[:] == (n, 0, n - 1, 0, n - 1)
    assert back.where("(i = j) <> (v = 1.0)").count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "cells").glob("*.parquet")) < 0.3 * n * n
    assert Mat.identity(spark, 0).cells().count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 600])
def test_identities_of_whole_and_cut_tiles(spark, n):
    cells = Mat.identity(spark, n).cells()
    assert cells.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "double")]
    assert sorted(map(tuple, cells.where("v <> 0").collect())) == [(i, i, 1.0) for i in range(n)]
    assert cells.count() == cells.distinct().count() == n * n and cells.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()[:] == (0, n - 1, 0, n - 1)


def test_a_task_makes_a_bounded_part_of_an_identity(spark):
    """The tasks grow with the cells, and none has an array of them."""
    n = 20_000
    cells = Mat.identity(spark, n).cells()
    assert max(r[0] for r in cells.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()) <= 1 << 24
    assert cells.count() == n * n and "Generate" not in cells._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_encoded_in_their_order(spark, monkeypatch):
    """Texts over a piece, known characters left out between them, nulls and empty texts: sizes and decoded texts stay with their keys."""
    rows = [(0, "ab" * 700_000), (1, None), (2, "xbya"), (3, ""), (4, "ba" * 600_000)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    own = CharTokenizer.fit(df.where("id = 0"), "text", "id")
    ids = own.encode(df, "text", "id")
    assert {r.id: r.n for r in ids.select("id", F.size("ids").alias("n")).collect()} == {0: 1_400_000, 1: 0, 2: 2, 3: 0, 4: 1_200_000}
    assert {r.id: r.text for r in own.decode(ids, "ids", "id").collect()} == {0: rows[0][1], 1: "", 2: "ba", 3: "", 4: rows[4][1]}


@pytest.mark.parametrize("name", ["char_encode", "oov_drop"])
def test_queries_encode_a_piece_at_a_time(spark, monkeypatch, tmp_path, name):
    """A batch of texts that is larger than a piece goes out in several, so a worker's arrays don't grow with the batch."""
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    from quernel.functions import tokenizer
    from quernel.plans import queries

    spark.createDataFrame([(1, "ab"), (2, "bca")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    steps, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, *rest: steps.append((f, schema)) or real(self, f, schema, *rest))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 2
    (encode,) = [f for f, schema in steps if "ids" in str(schema)]
    monkeypatch.setattr(tokenizer, "PIECE", 6)
    texts = ["abab", "", "bb", None, "bacab", "a" * 9]
    out = list(encode(iter([pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])])))
    assert [b.num_rows for b in out] == [4, 1, 1] and sum((b.column(0).to_pylist() for b in out), []) == list(range(6))
    known = {c: i for i, c in enumerate("ab" if name == "oov_drop" else "abc")}
    assert sum((b.column(1).to_pylist() for b in out), []) == [[known[c] for c in t or "" if c in known] for t in texts]
