import copy
import math

import numpy as np
import pytest

from quernel.functions.rng import Rng
from quernel.functions.streams import rings
from quernel.models import nn, tape
from quernel.models.networks import GPT, MLP, GPTConfig
from quernel.models.tape import Tensor
from quernel.models.training import TokenCorpus, fit_gpt, fit_groups, fit_mlp, fit_mlp_batches, generate, gpt_forward, gpt_loss, gradient, mlp_loss, perplexity, predict_mlp, sampled_perplexity
from quernel.operators.decoding import SampleConfig


def slope(loss, p, at, eps=1e-5):
    old = p.value[at]
    p.value[at] = old + eps
    up = float(loss().value[0, 0])
    p.value[at] = old - eps
    down = float(loss().value[0, 0])
    p.value[at] = old
    return (up - down) / (2 * eps)


def check(loss, params, every=1):
    for p in params:
        p.zero_grad()
    loss().backward()
    for p in params:
        for at in list(np.ndindex(p.shape))[::every]:
            assert p.grad[at] == pytest.approx(slope(loss, p, at), abs=1e-6), at


RNG = np.random.default_rng(3)
KERNELS = {
    "matmul": lambda a, b: tape.matmul(a, tape.transpose(b)),
    "add": tape.add,
    "add_row": lambda a, b: tape.add(a, tape.matmul(Tensor(np.ones((1, 3))), b)),
    "mul": lambda a, b: tape.mul(tape.add(a, b), -2.5),
    "relu": lambda a, b: tape.relu(tape.add(a, b)),
    "gelu": lambda a, b: tape.gelu(tape.add(a, b)),
    "softmax": lambda a, b: tape.softmax_rows(tape.add(a, b)),
    "layernorm": lambda a, b: tape.layernorm(a, tape.slice_cols(tape.matmul(Tensor(np.ones((1, 3))), b), 0, 4), tape.matmul(Tensor(np.full((1, 3), 0.3)), b)),
    "embedding": lambda a, b: tape.add(tape.embedding(a, [2, 0, 2]), b),
    "slice_concat": lambda a, b: tape.concat_cols([tape.slice_cols(a, 1, 2), b, tape.slice_cols(a, 0, 1)]),
}


@pytest.mark.parametrize("name", KERNELS)
def test_gradients(name):
    a, b = Tensor(RNG.standard_normal((3, 4))), Tensor(RNG.standard_normal((3, 4)))
    check(lambda: tape.cross_entropy(KERNELS[name](a, b), [0, 2, 1]), [a, b])


def test_tape_details():
    x = Tensor([[0.0, -1.0, 2.0]])
    tape.matmul(tape.relu(x), Tensor(np.ones((3, 1)))).backward()
    assert x.grad.tolist() == [[0, 0, 1]]
    y = Tensor([[1.0, 2.0]])
    assert tape.add(y, y).value.tolist() == [[2, 4]]
    deep = z = Tensor([[1.0]])
    for _ in range(5000):
        deep = tape.mul(deep, 1.0)
    deep.backward()
    assert z.grad[0, 0] == 1
    for bad in (lambda: tape.matmul(y, y), lambda: tape.cross_entropy(y, [2]), lambda: tape.slice_cols(y, 1, 2)):
        with pytest.raises((ValueError, IndexError)):
            bad()


def test_mlp_gradient_and_xor():
    model = MLP(2, 4, 3, Rng(123))
    x = np.array([[0.5, -1], [1, 2], [-1.5, 0.3], [0.2, 0.7]])
    check(lambda: tape.cross_entropy(model.forward(Tensor(x)), [0, 2, 1, 0]), model.params())
    model, x = MLP(2, 8, 2, Rng(2)), np.array([[0.0, 0], [0, 1], [1, 0], [1, 1]])
    optimizer = nn.Adam(model.params(), 0.05)
    for _ in range(600):
        optimizer.zero_grad()
        loss = tape.cross_entropy(model.forward(Tensor(x)), [0, 1, 1, 0])
        loss.backward()
        optimizer.step()
    assert loss.value[0, 0] < 0.05


def test_optimizers():
    p = Tensor([[0.0, 0.0]])
    p.grad[...] = [[3.0, 4.0]]
    assert nn.clip_grad_norm([p], 1.0) == 5 and np.linalg.norm(p.grad) == pytest.approx(1) and p.grad[0, 1] / p.grad[0, 0] == pytest.approx(4 / 3)
    p.grad[...] = [[0.3, 0.4]]
    assert nn.clip_grad_norm([p], 10.0) == pytest.approx(0.5) and p.grad.tolist() == [[0.3, 0.4]]
    nn.SGD([p], 0.5).step()
    assert p.value.tolist() == [[-0.15, -0.2]]
    w = Tensor([[1.0]])
    w.grad[...] = 2
    nn.Adam([w], 0.1, weight_decay=0.5).step()
    assert w.value[0, 0] == pytest.approx(1 - 0.1 * (1 + 0.5))
    known = {0: 0, 50: 0.5, 100: 1, 325: 0.868198, 550: 0.55, 775: 0.231802, 1000: 0.1, 1500: 0.1}
    assert {k: nn.cosine_lr(k, 1000, 1.0, 100) for k in known} == pytest.approx(known, abs=1e-6)


TINY = GPTConfig(5, 8, 2, 1, 6)


def test_gpt():
    model = GPT(TINY, Rng(7))
    assert sum(p.value.size for p in model.params()) == 1021
    check(lambda: model.loss([1, 3, 2, 4], [3, 2, 4, 0]), model.params(), every=5)
    for bad in (lambda: GPT(GPTConfig(5, 8, 3, 1, 6), Rng(1)), lambda: model.forward([]), lambda: model.forward([1] * 7), lambda: model.forward([5])):
        with pytest.raises((ValueError, IndexError)):
            bad()
    before = model.forward([1, 2, 3]).value[:2]
    assert np.allclose(before, model.forward([1, 2, 4]).value[:2])  # later ids don't matter to earlier positions


def test_gpt_memorizes():
    model = GPT(TINY, Rng(7))
    optimizer, losses = nn.Adam(model.params(), 0.01), []
    for _ in range(300):
        optimizer.zero_grad()
        loss = model.loss([1, 2, 3, 4, 0, 1], [2, 3, 4, 0, 1, 2])
        loss.backward()
        optimizer.step()
        losses.append(loss.value[0, 0])
    assert losses[-1] < 0.2 * losses[0]


def points(spark, n=120):
    from pyspark.sql import functions as F

    return rings(spark.range(n), ["id"], 3).select("id", F.array("x1", "x2").alias("x"), "label")


def test_distributed_gradient_equals_local(spark):
    df = points(spark)
    local = df.orderBy("id").toPandas()
    model, other = MLP(2, 4, 2, Rng(1)), MLP(2, 4, 2, Rng(1))
    loss, n = mlp_loss(other, local)
    tape.mul(loss, 1 / n).backward()
    for parts in (1, 5):
        mean, rows = gradient(df.repartition(parts), model, mlp_loss)
        assert rows == n and mean == pytest.approx(loss.value[0, 0] / n)
        for a, b in zip(model.params(), other.params()):
            assert np.allclose(a.grad, b.grad)


def test_training(spark):
    df = points(spark).coalesce(2).cache()
    model = MLP(2, 16, 2, Rng(2))
    losses = fit_mlp(df, model, 12, 0.05)
    assert losses[-1] < losses[0]
    assert predict_mlp(df, model).where("prediction = label").count() > 70
    assert len(fit_mlp_batches(df, MLP(2, 4, 2, Rng(2)), 1, 50)) == 1
    groups = fit_groups(df.selectExpr("id % 2 AS part", "x", "CAST(x[0] > 0 AS INT) AS label"), "part", 2, 8, 2, 60, 0.05).collect()
    assert len(groups) == 2 and all(r.last_loss < r.first_loss and r.accuracy > 0.8 for r in groups)
    df.unpersist()


@pytest.mark.parametrize("parts", [1, 6])
def test_mini_batches_equal_a_loop(spark, parts):
    """Over any number of partitions as over one array, whatever the order of rows; the last, short batch is dropped."""
    draws = np.random.default_rng(3)
    x, y = draws.normal(size=(57, 3)), draws.integers(0, 2, 57)
    rows = [(int(i), x[i].tolist(), int(y[i])) for i in draws.permutation(57)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(parts)
    got, want = MLP(3, 4, 2, Rng(2)), MLP(3, 4, 2, Rng(2))
    losses = fit_mlp_batches(df, got, 2, 10, lr=0.05)
    optimizer, means = nn.Adam(want.params(), 0.05), []
    for _ in range(2):
        each = []
        for k in range(0, 50, 10):
            optimizer.zero_grad()
            loss = tape.cross_entropy(want.forward(Tensor(x[k : k + 10])), y[k : k + 10])
            loss.backward()
            optimizer.step()
            each.append(float(loss.value[0, 0]))
        means.append(np.mean(each))
    assert losses == pytest.approx(means)
    for p, q in zip(got.params(), want.params()):
        assert np.allclose(p.value, q.value)
    assert math.isnan(fit_mlp_batches(df.limit(0), got, 1, 10)[0])


@pytest.mark.parametrize("parts, shards, batches", [(1, 3, 2), (6, 3, 2), (4, 2, 1), (5, 4, 50)])
def test_shards_equal_a_serial_simulation(spark, parts, shards, batches):
    """Rounds of shards x batches batches; every shard from the same state, then the average by batches taken."""
    draws = np.random.default_rng(9)
    x, y = draws.normal(size=(83, 3)), draws.integers(0, 2, 83)
    rows = [(int(i) * 10, x[i].tolist(), int(y[i])) for i in draws.permutation(83)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(parts)
    got, want = MLP(3, 4, 2, Rng(2)), MLP(3, 4, 2, Rng(2))
    losses = fit_mlp_batches(df, got, 2, 5, lr=0.05, shards=shards, batches=batches)
    state = nn.Adam(want.params(), 0.05)
    means = []
    for _ in range(2):
        each = []
        for start in range(0, 16, shards * batches):
            ends, taken = [], []
            for s in range(shards):
                own, adam = copy.deepcopy((want, state))
                adam.params = own.params()
                mine = range(start + s * batches, min(start + (s + 1) * batches, 16))
                for k in mine:
                    adam.zero_grad()
                    loss = tape.cross_entropy(own.forward(Tensor(x[k * 5 : k * 5 + 5])), y[k * 5 : k * 5 + 5])
                    loss.backward()
                    adam.step()
                    each.append(float(loss.value[0, 0]))
                ends.append([*(p.value for p in own.params()), *adam.m, *adam.v])
                taken.append(len(mine))
            for target, *parts_ in zip([*(p.value for p in want.params()), *state.m, *state.v], *ends):
                target[...] = sum(t * p for t, p in zip(taken, parts_)) / sum(taken)
            state.t += max(taken)
        means.append(np.mean(each))
    assert losses == pytest.approx(means, rel=1e-9)
    for p, q in zip(got.params(), want.params()):
        assert np.abs(p.value - q.value).max() < 1e-9


def test_gpt_over_frames(spark):
    chunks = spark.createDataFrame([(i, [1, 2, 3, 4, 0, 1], [2, 3, 4, 0, 1, 2]) for i in range(4)], "id long, x array<int>, y array<int>").coalesce(2)
    model = GPT(TINY, Rng(7))
    before = perplexity(chunks, model)
    assert before == pytest.approx(math.exp(model.loss([1, 2, 3, 4, 0, 1], [2, 3, 4, 0, 1, 2]).value[0, 0]))
    corpus = TokenCorpus(spark.createDataFrame([(0, [1, 2, 3, 4, 0]), (1, []), (2, None), (3, [1, 2, 3, 4, 0] * 6)], "k long, ids array<int>"), ["k"])
    losses = fit_gpt(corpus, model, 6, batch=4, lr=0.05)
    assert sampled_perplexity(corpus, model, 5, Rng(1)) < before
    assert losses[-1] < losses[0] and perplexity(chunks, model) < before
    prompts = spark.createDataFrame([(0, [1, 2]), (1, [3])], "id long, ids array<int>")
    out = {r.id: r.ids for r in generate(prompts, model, 9, SampleConfig(0.8, 3, 0.9)).collect()}
    assert out[0][:2] == [1, 2] and len(out[0]) == 11 and len(out[1]) == 10
    assert out == {r.id: r.ids for r in generate(prompts.repartition(2), model, 9, SampleConfig(0.8, 3, 0.9)).collect()}
    assert len(gpt_forward(prompts, model).first().last_logits) == 5


def test_gpt_draws_from_all_partitions(spark, tmp_path, monkeypatch):
    """Benchmark in many files: each step's windows are those that a serial loop draws from the joined text."""
    from quernel.models import training
    from quernel.plans import queries

    rows = [(i, "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(40))) for i in range(12)]
    spark.createDataFrame(rows, "item_id long, text string").repartition(6).write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "".join(t for _, t in rows)
    seen = []

    def watched(df, model, loss):
        out = gradient(df, model, loss)
        seen.append((out[1], [(r.x, r.y) for r in df.orderBy("id").collect()]))
        return out

    monkeypatch.setattr(training, "gradient", watched)
    queries.QUERIES["gpt_train"](spark, str(tmp_path)).collect()
    assert [n for n, _ in seen] == [8, 8, 8]
    rng = Rng(1)
    ids = [ord(c) % 64 for c in text]
    for _, windows in seen:
        starts = [int(rng.uniform(0.0, len(ids) - 16)) for _ in range(8)]
        assert windows == [(ids[s : s + 16], ids[s + 1 : s + 17]) for s in starts]
    two = spark.createDataFrame([(0, [1, 2], [2, 3], 3), (1, [4, 0], [0, 1], 1)], "id long, x array<int>, y array<int>, times int")
    model = GPT(TINY, Rng(7))
    mean, n = gradient(two, model, gpt_loss)
    a, b = (float(model.loss(*xy).value[0, 0]) for xy in (([1, 2], [2, 3]), ([4, 0], [0, 1])))
    assert n == 4 and mean == pytest.approx((3 * a + b) / 4)


def test_gpt_queries_take_whole_texts(spark, tmp_path):
    from quernel.plans import queries

    texts = ["ab", "short text", "x" * 16, "seventeen letters", "a longer text of more than two windows", "z", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, t in enumerate(texts):
        c = [ord(x) % 64 for x in t]
        for s in range(max(1, len(c) - 16) if len(c) > 1 else 0):
            want[(i << 32) + s] = (c[s : s + 16][: len(c) - 1 - s], c[s + 1 : s + 17])
    got = {r.id: (r.x, r.y) for r in queries.chunked(spark, str(tmp_path)).collect()}
    assert got == want
    assert {r.id for r in queries.QUERIES["gpt_forward"](spark, str(tmp_path)).collect()} == set(want)
    out = {r.item_id: r.ids for r in queries.QUERIES["gpt_generate"](spark, str(tmp_path)).collect()}
    assert {i: x[:-8] for i, x in out.items()} == {i: [ord(c) % 64 for c in t] for i, t in enumerate(texts) if t}


@pytest.mark.parametrize("parts", ["1", "5"])
def test_windows_of_a_joined_text(spark, parts):
    """Windows over many documents, over partitions, at the ends, repeated and outside, against the joined list."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    draws = np.random.default_rng(1)
    docs = [(int(k), [int(x) for x in draws.integers(0, 99, draws.integers(0, 12))]) for k in draws.permutation(60)] + [(100, None)]
    joined = [x for _, ids in sorted(docs, key=lambda d: d[0]) for x in ids or []]
    corpus = TokenCorpus(spark.createDataFrame(docs, "k long, ids array<int>").repartition(4), ["k"])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert corpus.size == len(joined) and corpus.split() == (len(joined) * 9 // 10, len(joined) - len(joined) * 9 // 10)
    places = [(0, 1), (0, len(joined)), (len(joined) - 3, 10), (5, 40), (5, 40), *((int(s), 25) for s in draws.integers(0, len(joined) - 25, 20))]
    got = {r.draw: r.ids for r in corpus[places].collect()}
    assert got == {i: joined[s : s + w] for i, (s, w) in enumerate(places)}
    assert corpus[[(len(joined), 5)]].count() == 0
    with pytest.raises(ValueError):
        corpus.sample(Rng(1), 2, len(joined))
    assert len(corpus.offsets) > 1 or parts == "1"
    corpus.unpersist()


def test_one_state_a_round_reaches_the_driver(spark, monkeypatch):
    """Also over several chunks of rounds and more shards than are added up at once."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from quernel.models import training

    monkeypatch.setattr(training, "CHUNK", 2)
    seen, real = [], Frame.collect

    def collect(self):
        rows = real(self)
        if "state" in self.columns:
            seen.append(len(rows))
        return rows

    monkeypatch.setattr(Frame, "collect", collect)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(2).tolist(), i % 2) for i in range(100)], "id long, x array<double>, label int")
    assert np.isfinite(fit_mlp_batches(df, MLP(2, 4, 2, Rng(2)), 1, 2, shards=10, batches=1)).all()
    assert seen == [1] * 5


@pytest.mark.parametrize("shards, batches, rows", [(4, 2, 103), (7, 1, 103), (8, 3, 9), (1, 2, 41)])
def test_rounds_of_a_stage_are_one_job(spark, monkeypatch, shards, batches, rows):
    """The same digits as with a job a round; also for more shards than slots, tasks without rows and a last round that isn't full."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from quernel.models import training

    monkeypatch.setattr(training, "STAGE", 4, raising=False)
    seen, real = [], Frame.collect

    def collect(self):
        out = real(self)
        if "state" in self.columns:
            seen.append(len(out))
        return out

    monkeypatch.setattr(Frame, "collect", collect)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i * 3, rng.standard_normal(2).tolist(), i % 2) for i in range(rows)], "id long, x array<double>, label int")
    rounds, got, want = -(-(rows // 4) // (shards * batches)), MLP(2, 4, 2, Rng(2)), MLP(2, 4, 2, Rng(2))
    losses = fit_mlp_batches(df, got, 2, 4, shards=shards, batches=batches)
    assert seen == [1] * (2 * -(-rounds // 4))
    monkeypatch.setattr(training, "gang", lambda context, shards: 0)
    assert losses == fit_mlp_batches(df, want, 2, 4, shards=shards, batches=batches)
    assert all((p.value == q.value).all() for p, q in zip(got.params(), want.params()))
