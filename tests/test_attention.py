import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.functions import neural
from quernel.functions.rng import Rng
from quernel.models import relational
from quernel.models.networks import GPT, GPTConfig
from quernel.models.tape import Tensor
from quernel.operators.attention import State, attention


def dense(q, k, v, heads, causal):
    out, width = np.zeros_like(v), q.shape[1] // heads
    for c in range(0, q.shape[1], width):
        s = q[:, c : c + width] @ k[:, c : c + width].T / math.sqrt(width)
        if causal:
            s = np.where(np.tri(len(s), dtype=bool), s, -np.inf)
        e = np.exp(s - s.max(1, keepdims=True))
        out[:, c : c + width] = e / e.sum(1, keepdims=True) @ v[:, c : c + width]
    return out


def frame(spark, parts, seqs):
    rows = [(s, i, *(x[i].tolist() for x in qkv)) for s, qkv in seqs.items() for i in range(len(qkv[0]))]
    return spark.createDataFrame(rows, "seq string, pos long, q array<double>, k array<double>, v array<double>").repartition(parts)


@pytest.mark.parametrize("causal, block, span", [(True, 4, 2), (False, 4, 2), (True, 128, 16), (True, 1, 1), (False, 3, 100)])
def test_equals_dense_attention(spark, causal, block, span):
    rng = np.random.default_rng(block)
    seqs = {s: [rng.standard_normal((n, 6)) * 3 for _ in range(3)] for s, n in (("a", 30), ("b", 1), ("c", 9), ("", 4))}
    out = attention(frame(spark, 3, seqs), 2, causal, block, span).collect()
    want = {s: dense(*qkv, 2, causal) for s, qkv in seqs.items()}
    assert len(out) == 44
    assert max(np.abs(want[r.seq][r.pos] - r.v).max() for r in out) < 1e-12


def test_scores_far_apart_and_missing_positions(spark):
    """Scores of some thousands neither overflow nor vanish; a gap in positions leaves no key."""
    rng = np.random.default_rng(1)
    qkv = [rng.standard_normal((20, 4)) * s for s in (60, 60, 1)]
    kept = [i for i in range(20) if i not in (3, 4, 5, 6, 11)]
    df = frame(spark, 2, {"s": qkv}).where(F.col("pos").isin(kept))
    out = {r.pos: r.v for r in attention(df, 1, True, 2, 2).collect()}
    want = dense(*(x[kept] for x in qkv), 1, True)
    assert sorted(out) == kept and max(np.abs(out[p] - want[i]).max() for i, p in enumerate(kept)) < 1e-10


def test_states_merge_in_any_order():
    rng = np.random.default_rng(2)
    q, k, v = rng.standard_normal((2, 3, 4)), rng.standard_normal((2, 12, 4)) * 5, rng.standard_normal((2, 12, 4))
    parts = [State.of(q, k[:, i : i + 3], v[:, i : i + 3], None) for i in range(0, 12, 3)]
    whole = State.of(q, k, v, None).result()
    left = parts[0].merge(parts[1]).merge(parts[2]).merge(parts[3]).result()
    right = State.empty(2, 3, 4).merge(parts[3].merge(parts[2])).merge(State.load(parts[0].merge(parts[1]).dump(), 2, 4)).result()
    assert np.abs(left - whole).max() < 1e-14 and np.abs(right - whole).max() < 1e-14


def test_refused_and_empty(spark):
    df = frame(spark, 1, {"a": [np.ones((2, 6))] * 3})
    for heads in (0, 4):
        with pytest.raises(ValueError):
            attention(df, heads)
    assert attention(df.limit(0), 2).count() == 0
    none = df.withColumn("pos", F.when(F.col("pos") == 0, F.col("pos")))
    assert attention(none, 2).count() == 1


def test_block_equals_the_model(spark):
    """The relational block against the differentiable one, by a sequence longer than a packed block."""
    config = GPTConfig(vocab_size=5, n_embd=8, n_head=2, n_layer=1, block_size=16)
    model = GPT(config, Rng(3))
    rng = np.random.default_rng(4)
    weights = {n: rng.standard_normal(t.value.shape) * 0.7 for n, t in model.names.items()}
    model.load(weights)
    x = rng.standard_normal((13, 8))
    want = model._block(Tensor(x), "h0", Tensor(np.triu(np.full((13, 13), -1e9), 1))).value
    df = spark.createDataFrame([(7, i, x[i].tolist()) for i in range(13)], "seq long, pos long, x array<double>").repartition(4)
    own = {n.removeprefix("h0."): w for n, w in weights.items() if n.startswith("h0.")}
    out = relational.block(df, own, 2, rows=4, span=2)
    assert max(np.abs(want[r.pos] - r.x).max() for r in out.collect()) < 1e-12


def test_forward_equals_the_model(spark):
    config = GPTConfig(vocab_size=7, n_embd=8, n_head=2, n_layer=2, block_size=9)
    model = GPT(config, Rng(3))
    model.load({n: t.value * 20 for n, t in model.names.items()})
    rng = np.random.default_rng(5)
    seqs = {s: rng.integers(0, 7, n).tolist() for s, n in (("a", 9), ("b", 1), ("c", 5))}
    df = spark.createDataFrame([(s, i, x) for s, ids in seqs.items() for i, x in enumerate(ids)], "seq string, pos long, id int").repartition(3)
    out = relational.gpt_logits(df, model, rows=4, span=2).collect()
    want = {s: model.forward(ids).value for s, ids in seqs.items()}
    assert len(out) == 15 and max(np.abs(want[r.seq][r.pos] - r.logits).max() for r in out) < 1e-12
    with pytest.raises(Exception, match="outside of the model"):
        relational.gpt_logits(df.withColumn("pos", F.col("pos") + 1), model).collect()


def test_erf_to_the_last_digits(spark):
    x = np.concatenate([np.linspace(-6.5, 6.5, 4001), [0.0, -0.0, 1e-300, 0.46875, 4.0, 26.9, 28.0, np.inf, -np.inf]])
    want = np.array([math.erf(v) for v in x])
    assert np.abs(neural.erf_array(x) - want).max() < 5e-16
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)] + [(None, -1), (math.nan, -2)], "x double, i int")
    out = {r.i: r.y for r in df.select("i", neural.erf(F.col("x")).alias("y")).collect()}
    assert max(abs(out[i] - w) for i, w in enumerate(want)) < 5e-16 and out[-1] is None and math.isnan(out[-2])
    plan = df.select(neural.gelu(F.array("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_what_is_moved_grows_with_the_rows(spark):
    """A sequence four times as long puts each of its rows in no more cells, and the result stays that of the dense form."""
    rng = np.random.default_rng(8)
    qkv = [rng.standard_normal((1600, 4)) for _ in range(3)]
    df = frame(spark, 3, {"s": qkv})

    def moved(n):
        out = attention(df.where(F.col("pos") < n), 2, True, 2, 1)
        got = {r.pos: r.v for r in out.collect()}
        want = dense(*(x[:n] for x in qkv), 2, True)
        assert sorted(got) == list(range(n)) and max(np.abs(got[p] - want[p]).max() for p in got) < 1e-10
        plan = out._jdf.queryExecution().executedPlan()
        nodes, rows = [plan], 0
        while nodes:
            node = nodes.pop()
            if "AdaptiveSparkPlan" in node.nodeName():
                nodes.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                nodes.append(node.plan())
            elif "Union" in node.nodeName():
                continue
            if node.nodeName() == "Exchange" and "Union" in str(node.toString()):
                rows = max(rows, node.metrics().apply("shuffleRecordsWritten").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        return rows

    few, many = moved(400), moved(1600)
    assert 0 < few and many <= 4.2 * few


def test_stretches_no_longer_than_memory_allows(spark, monkeypatch):
    from quernel.operators import attention as module

    monkeypatch.setattr(module, "GRID", 2)
    monkeypatch.setattr(module, "ROWS", 8)
    rng = np.random.default_rng(9)
    for causal in (True, False):
        qkv = [rng.standard_normal((61, 4)) for _ in range(3)]
        got = {r.pos: r.v for r in attention(frame(spark, 3, {"s": qkv}), 2, causal, 2, 1).collect()}
        want = dense(*qkv, 2, causal)
        assert sorted(got) == list(range(61)) and max(np.abs(got[p] - want[p]).max() for p in got) < 1e-11
