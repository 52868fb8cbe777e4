import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import streams
from quernel.functions.rng import Rng

KINDS = {"uniform": {}, "gaussian": {"mean": 1.0, "sd": 2.0}, "exponential": {"rate": 2.0}, "bernoulli": {"p": 0.3}, "poisson": {"rate": 4.0}}


def serial(dist, n, seed, **params):
    own = Rng(seed)
    return [float(getattr(own, dist)(**params)) for _ in range(n)]


def test_source_enters_the_stream_anywhere():
    own = Rng(5)
    want = [own.uniform() for _ in range(10_000)]
    for at in (0, 1, 777, 5000):
        assert streams.Source(5, at).take(5000).tolist() == want[at : at + 5000]


@pytest.mark.parametrize("parts", ["1", "8"])
@pytest.mark.parametrize("dist", KINDS)
def test_rows_get_the_serial_stream(spark, dist, parts):
    """Rows in the order of their keys, over small segments of the stream, odd rows at the partitions' starts."""
    n = 3001
    draws = streams.DISTRIBUTIONS[dist](**KINDS[dist])
    df = spark.range(n).select((F.col("id") * 37 % n).alias("key"), F.lit("x").alias("value"), F.col("id").alias("other"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out, base = streams.attach(df, ["key"], draws, 42, size=500)
        rows = sorted((r.key, r.value) for r in out.collect())
        tasks = base.select(F.spark_partition_id()).distinct().count()
        base.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[1] for r in rows] == pytest.approx(serial(dist, n, 42, **KINDS[dist]), rel=1e-13, abs=1e-13)
    assert (tasks > 1) == (parts == "8")


@pytest.mark.parametrize("dist", ["gaussian", "exponential", "poisson"])
def test_rejections_shift_the_rest(spark, dist, monkeypatch):
    """With a bound that refuses many uniforms: what comes after a refusal moves, in all tasks."""
    from quernel.functions import rng

    monkeypatch.setattr(rng, "TINY", 0.2)
    monkeypatch.setattr(streams, "TINY", 0.2)
    want = serial(dist, 400, 7, **KINDS[dist])
    draws = streams.DISTRIBUTIONS[dist](**KINDS[dist])
    got = [x for part in _take(streams.serial(7, draws, 0, 0, 0, chunk=50), 400) for x in part]
    assert got[:400] == pytest.approx(want, rel=1e-13)
    for k in range(3):  # maps lead to where the chain goes
        entry, first = 0, 0
        for s in range(k):
            out, units = streams.segment_map(7, draws, s, 100)
            entry, first = int(out[entry]), first + int(units[entry])
        tail = next(streams.serial(7, draws, k * 100 + entry, first, first * draws.rows, chunk=100))[0]
        assert tail[:20].tolist() == pytest.approx(want[first * draws.rows :][:20], rel=1e-13)


def _take(parts, n):
    have = 0
    while have < n:
        part = next(parts)[0].tolist()
        have += len(part)
        yield part


def test_levels_of_maps(spark):
    """Maps composed four at a time and again give the entries of a walk."""
    draws = streams.poisson(4.0)
    out = {r.k: (r.entry, r["first"]) for r in streams.segments(spark, 3, draws, 2000, size=64, fan=4, top=5).collect()}
    entry, first = 0, 0
    for k in range(len(out)):
        assert out[k] == (entry, first)
        after, units = streams.segment_map(3, draws, k, 64)
        entry, first = int(after[entry]), first + int(units[entry])
    assert first >= 2000


def test_data_sets(spark):
    ids = spark.range(501)
    r, rows = Rng(5), []
    for i in range(501):
        radius, angle = (r.uniform(0, 1) if i % 2 == 0 else r.uniform(1.5, 2.5)), r.uniform(0, 2 * math.pi)
        rows.append((radius * math.cos(angle) + r.gaussian(0, 0.05), radius * math.sin(angle) + r.gaussian(0, 0.05), i % 2))
    assert [(x.x1, x.x2, x.label) for x in streams.rings(ids, ["id"], 5).orderBy("id").collect()] == [(pytest.approx(a, abs=1e-12), pytest.approx(b, abs=1e-12), c) for a, b, c in rows]
    r, rows = Rng(6), []
    for i in range(501):
        x = r.uniform(-5, 5)
        rows.append((x, 4.0 * x + 7.0 + r.gaussian(0, 1)))
    assert [(x.x, x.y) for x in streams.noisy_line(ids, ["id"], 6).orderBy("id").collect()] == [(pytest.approx(a, abs=1e-12), pytest.approx(b, abs=1e-12)) for a, b in rows]
    r, rows = Rng(7), []
    for _ in range(501):
        x = r.gaussian()
        rows.append((x, 0.8 * x + r.gaussian(0, 0.5)))
    assert [(x.x, x.y) for x in streams.correlated(ids, ["id"], 7).orderBy("id").collect()] == [(pytest.approx(a, abs=1e-12), pytest.approx(b, abs=1e-12)) for a, b in rows]
    assert np.mean([x.y for x in streams.clusters(ids, ["id"], 8).collect()]) == pytest.approx(0.5, abs=0.01)
    assert streams.frame(spark, 0, "poisson", rate=2.0).count() == 0
    with pytest.raises(ValueError):
        streams.frame(spark, 1, "cauchy")
