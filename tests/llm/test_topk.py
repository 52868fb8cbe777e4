import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k):
    ok = [(i, r[0], [int(np.floor(256 * x)) for x in r[1]]) for i, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, q, a in ok:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, j, b in ok if m != i and len(a) == len(b))[:k]
            out += [(q, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e-3])
def test_against_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6).round(2) * scale).tolist(), "") for i in range(300)]
    rows += [(400 + i, rows[7][1], "") for i in range(30)] + [(i * 50, rows[3][1], "") for i in range(8, 12)]
    rows += [(50, rows[50][1], ""), (550, None, ""), (600, [1.0, None], ""), (650, [float("nan")] * 6, ""), (None, rows[0][1], ""), (700, [0.5, 0.5], ""), (751, [0.25, 1.0], ""), (800, [1.0], "")]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5)


def test_huge_scores_saturate_and_empty(spark):
    frame = spark.createDataFrame([(0, [1e30, 1.0], ""), (1, [1e30, 0.0], ""), (2, [-1e30, 0.0], "")], SCHEMA)
    got = topk.search(frame, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert topk.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
