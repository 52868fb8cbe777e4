import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.models import nn
from quernel.models.tables import AdamTable
from quernel.models.tape import Tensor


def test_ten_steps_equal_the_array_optimizer(spark):
    draws = np.random.default_rng(1)
    w = draws.standard_normal((40, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "k long, w array<double>").repartition(5)
    table, own = AdamTable(df, "k", 0.05, weight_decay=0.01, buckets=4), Tensor(w.copy())
    adam = nn.Adam([own], 0.05, weight_decay=0.01)
    for t in range(10):
        g = draws.standard_normal((40, 3)) * (t + 1)
        rows = [(i, x.tolist()) for i, x in enumerate(g) if i % 7]
        g[::7] = 0.0  # keys without a gradient
        table.step(spark.createDataFrame(rows, "k long, g array<double>"))
        own.grad[...] = g
        adam.step()
    got = {r.k: r for r in table.state.collect()}
    assert max(np.abs(np.array(got[i].w) - own.value[i]).max() for i in range(40)) < 1e-12
    assert max(np.abs(np.array(got[i].v) - adam.v[0][i]).max() for i in range(40)) < 1e-12
    table.drop()


def test_no_exchange_on_the_state(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.array(F.lit(1.0)).alias("w"))
    table = AdamTable(df, "k", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = table.stepped(df.select("k", F.col("w").alias("g")))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
    table.drop()


def test_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k long, w array<double>")
    table = AdamTable(df, "k", buckets=2)
    with pytest.raises(Exception, match="another length"):
        table.stepped(df.select("k", F.array(F.lit(1.0)).alias("g"))).collect()
    table.drop()
    with pytest.raises(Exception, match="a null in k"):
        AdamTable(df.select(F.lit(None).cast("long").alias("k"), "w"), "k", buckets=2)
    none = AdamTable(df.limit(0), "k", buckets=2)
    none.step(df.select("k", F.col("w").alias("g")))
    assert none.state.count() == 0
    none.drop()
