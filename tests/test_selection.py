import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import selection, tsqr
from quernel.operators.linalg import SingularMatrix
from quernel.operators.regression import LinearRegression


def want(values, p):
    x = sorted(values, key=lambda v: (math.isnan(v), v))
    rank = p / 100 * (len(x) - 1)
    a, b = x[math.floor(rank)], x[math.ceil(rank)]
    return a if a == b or rank == math.floor(rank) else a + (rank - math.floor(rank)) * (b - a)


def close(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-12 * max(abs(a), abs(b))


def test_keys_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan, -np.nan])
    keys = selection.to_keys(x)
    assert (np.diff(keys[:4]) > 0).all() and keys[4] == keys[5] and (np.diff(keys[5:11]) > 0).all() and keys[10] == keys[11]
    back = selection.from_keys(keys)
    assert np.array_equal(back, np.where(x == 0, 0.0, x), equal_nan=True)


@pytest.mark.parametrize("digit", [8, 16])
def test_grouped_with_ties_infinities_and_nulls(spark, digit):
    rng = random.Random(digit)
    special = [-0.0, 0.0, math.inf, -math.inf, math.nan, 5e-324, -1e308, 1e308]
    rows = [(g, rng.choice(special) if rng.random() < 0.3 else rng.choice([rng.gauss(0, 10 ** rng.randint(-9, 9)), 7.0])) for g in ("a", "b", None) for _ in range(rng.randint(1, 200))]
    rows += [("one", 3.5), ("none", None), ("a", None), ("hot", 2.0)] + [("hot", 1.0)] * 500
    ps = [0.0, 10.0, 33.3, 50.0, 99.9, 100.0]
    frame = spark.createDataFrame(rows, "i string, n double").repartition(5)
    out = {(r.i, r.p): r for r in selection.percentiles(frame, "n", ps, ["i"], digit).collect()}
    groups = {g: [x for h, x in rows if h == g and x is not None] for g, _ in rows}
    assert len(out) == sum(bool(v) for v in groups.values()) * len(ps)
    for (g, p), r in out.items():
        assert r.n == len(groups[g]) and close(r.value, want(groups[g], p)), (g, p, r.value, want(groups[g], p))


def test_ungrouped(spark):
    values = [float(x) for x in np.random.default_rng(1).standard_normal(1001)]
    frame = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r.value for r in selection.percentiles(frame, "x", [25, 50]).orderBy("p").collect()] == pytest.approx([want(values, 25), want(values, 50)], rel=1e-15)
    assert selection.median(frame, "x").first().n == 1001
    assert selection.percentiles(frame.limit(0), "x", [50]).count() == 0
    with pytest.raises(ValueError):
        selection.percentiles(frame, "x", [101])


def test_tree_of_triangles(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + 0.1 * rng.standard_normal(500)
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double").repartition(40)
    rows = tsqr.fit(frame, ["a", "b", "c"], "y").orderBy("idx").collect()
    full = np.column_stack((np.ones(500), x))
    best = np.linalg.lstsq(full, y, rcond=None)[0]
    assert [r.weight for r in rows] == pytest.approx(best.tolist(), rel=1e-10) and rows[0].n == 500
    assert rows[0].mse == pytest.approx(float(np.mean((full @ best - y) ** 2)), rel=1e-9)
    r = tsqr.factor(frame, ["a", "b", "c"]).first().r
    assert np.abs(np.array(r).reshape(3, 3).T @ np.array(r).reshape(3, 3) - x.T @ x).max() < 1e-9


def test_where_normal_equations_lose_all_digits(spark):
    """Two columns that differ in the ninth digit: their sums of squares are equal in double precision."""
    n = 400
    t = np.linspace(-1, 1, n)
    x2 = 1 + 1e-9 * t
    y = 3 + 2e9 * (x2 - 1)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x2, y)], "x double, y double").repartition(7)
    rows = {r.feature: r.weight for r in tsqr.fit(frame, ["x"], "y").collect()}
    assert rows["x"] == pytest.approx(2e9, rel=1e-5)
    try:
        normal = LinearRegression().fit_normal_equation(frame, ["x"], "y").weights[1]
        assert abs(normal / 2e9 - 1) > 0.01
    except SingularMatrix:
        pass


def test_dependent_columns_and_empty_table(spark):
    frame = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.lit(1.0).alias("y"))
    with pytest.raises(Exception, match="depend"):
        tsqr.fit(frame, ["a", "b"], "y").collect()
    with pytest.raises(Exception, match="depend"):
        tsqr.fit(frame.limit(1), ["a"], "y").collect()
    assert tsqr.fit(frame.limit(0), ["a"], "y").count() == 0
    with pytest.raises(Exception, match="a null in a"):
        tsqr.fit(frame.select(F.lit(None).cast("double").alias("a"), "y"), ["a"], "y").collect()


def test_wide_keeps_every_group_and_aggregates_no_values(spark):
    """A null group and one without values have their rows; no aggregate holds a group's values."""
    rows = [("a", float(i)) for i in range(11)] + [(None, 3.0), (None, 5.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = selection.wide(df, "x", {"p10": 10, "p90": 90}, ["g"])
    assert {r.g: (r.p10, r.p90) for r in out.collect()} == {"a": (1.0, 9.0), None: (3.2, 4.8), "b": (None, None)}


@pytest.mark.parametrize("name", ["percentile_grouped", "median_grouped"])
def test_grouped_queries_hold_no_group_in_a_task(spark, name):
    from quernel.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_one_task_merges_triangles_and_reads_no_rows(spark):
    """With few partitions the last task still gets their triangles, by an exchange, instead of their rows."""
    df = spark.range(0, 4000, 1, 4).selectExpr("cast(id as double) x", "2 * id + 1.0 y")
    assert tsqr.factor(df, ["x", "y"]).count() == 1 and "Coalesce 1" not in tsqr.factor(df, ["x", "y"])._jdf.queryExecution().toString()
    assert [round(r.weight, 6) for r in tsqr.fit(df, ["x"], "y").orderBy("idx").collect()] == [1.0, 2.0]
