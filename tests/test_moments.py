import numpy as np
import pytest

from quernel.functions.tokenizer import CharTokenizer, char_counts, split_bytes
from quernel.operators import moments


def frame(spark, x):
    return spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")


@pytest.mark.parametrize("parts", [1, 40])
@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_covariance_at_an_offset(spark, parts, offset):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((700, 5)) @ rng.standard_normal((5, 5))
    x = base + offset
    want = np.cov((x - offset).T)
    got = np.zeros((5, 5))
    for r in moments.covariance_cells(frame(spark, x).repartition(parts), "v").collect():
        got[r.i, r.j] = r.v
    assert np.abs(got - want).max() < (1e-12 if offset == 0 else 1e-6 * np.abs(want).max())
    rows = moments.component_moments(frame(spark, x).repartition(parts), "v").orderBy("i").collect()
    assert [r.n for r in rows] == [700] * 5 and np.allclose([r.mean for r in rows], x.mean(0), rtol=1e-15)
    assert np.allclose([r.stddev for r in rows], np.sqrt(np.diag(want)), rtol=1e-6)


def test_few_and_odd_rows(spark):
    one = frame(spark, np.array([[1.0, 2.0]]))
    assert moments.covariance_cells(one, "v").count() == 0 and [r.v for r in moments.covariance_cells(one, "v", sample=False).collect()] == [0.0] * 4
    assert [(r.mean, r.variance) for r in moments.component_moments(one, "v").orderBy("i").collect()] == [(1.0, None), (2.0, None)]
    assert moments.comoments(one.limit(0), "v").count() == 0
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, None], [1.0, 2.0]]):
        with pytest.raises(Exception, match="lengths|null entry"):
            moments.comoments(spark.createDataFrame([(r,) for r in bad], "v array<double>").repartition(2), "v").collect()
    assert moments.comoments(spark.createDataFrame([(None,), ([3.0],)], "v array<double>"), "v").first().n == 1


#: Bytes, and the characters that lead bytes make of them, worked out by hand.
CASES = {
    b"": [],
    b"abc": [b"a", b"b", b"c"],
    "aé漢😀".encode(): [b"a", "é".encode(), "漢".encode(), "😀".encode()],
    b"\x80\xbfa": [b"\x80", b"\xbf", b"a"],
    b"\xff\xfe\xf8\n": [b"\xff", b"\xfe", b"\xf8", b"\n"],
    b"\xc3": [b"\xc3"],
    b"\xe6\xbc": [b"\xe6", b"\xbc"],
    b"\xf0\x9f\x98": [b"\xf0", b"\x9f", b"\x98"],
    b"\xf0\x9f\xc3\xa9": [b"\xf0\x9f\xc3\xa9"],
    b"\xc3\xc3\xa9": [b"\xc3\xc3", b"\xa9"],
    b"\xe6a\r\n": [b"\xe6a\r", b"\n"],
    b"\xf7abc\xe6ab\xc0": [b"\xf7abc", b"\xe6ab", b"\xc0"],
}


def test_bytes_by_lead_bytes(spark):
    df = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(CASES)] + [(-1, None)], "i int, raw binary").select("i", split_bytes("raw").alias("c"))
    got = {r.i: [bytes(x) for x in r.c] for r in df.collect()}
    assert got == {i: v for i, v in enumerate(CASES.values())} | {-1: []}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_characters_in_batches(spark):
    rows = [(3, "banana"), (1, "é漢b"), (None, "zé"), (2, ""), (4, None), (5, "😀a😀")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    own = CharTokenizer.fit(df, "text", "k")
    assert own.tokens == ["z", "é", "漢", "b", "a", "n", "😀"]
    got = {r.k: r.ids for r in own.encode(df, "text", "k").collect()}
    assert got == {3: [3, 4, 5, 4, 5, 4], 1: [1, 2, 3], None: [0, 1], 2: [], 4: [], 5: [6, 4, 6]}
    assert {r.k: r.text for r in own.decode(own.encode(df, "text", "k"), "ids", "k").collect()} == {k: t or "" for k, t in rows}
    less = CharTokenizer(own.vocab.where("token_id < 4"))
    assert {r.k: r.ids for r in less.encode(df, "text", "k").collect()}[5] == []
    odd = spark.createDataFrame([(1, [0, 99, None, -1, 6]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.text for r in own.decode(odd, "ids", "k").collect()} == {1: "z😀", 2: "", 3: ""}
    assert {r.token: r.n for r in char_counts(df, "text").collect()} == {"b": 2, "a": 4, "n": 2, "é": 2, "漢": 1, "z": 1, "😀": 2}
