"""Training and inference over DataFrames.

A step of data-parallel training broadcasts the parameters (their size is the model's, not the data's), sums gradients of losses per partition in
Arrow batches and steps on the driver. The kernels return sums, divided by the global number of rows, so results don't depend on the partitioning.
fit_groups() trains one model per group in one task each, for many small models.
"""

from __future__ import annotations

import math
import pickle
import secrets
import socket
from collections.abc import Callable, Iterator
from itertools import groupby
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.rng import Rng
from quernel.models import tape
from quernel.models.networks import GPT, MLP, GPTConfig
from quernel.models.nn import Adam, clip_grad_norm, cosine_lr
from quernel.models.tape import Tensor
from quernel.operators.corpus import TokenCorpus
from quernel.operators.decoding import SampleConfig, sample_one
from quernel.session import shared_folder

#: One partial result: the partition, the loss's sum, the rows, then the gradient of each parameter, flat.
PARTIAL = "part int, loss double, n long, grad array<double>"
#: Tasks that add up partial results.
FAN = 8
#: Rounds of mini-batches whose rows are held at once, where a round is a job.
CHUNK = 64
#: Rounds of a barrier stage: what a lost task repeats.
STAGE = 512


def flat(params: list[Tensor]) -> np.ndarray:
    return np.concatenate([p.grad.ravel() for p in params])


def unflat(params: list[Tensor], grad: np.ndarray) -> None:
    at = 0
    for p in params:
        p.grad[...] = grad[at : at + p.grad.size].reshape(p.grad.shape)
        at += p.grad.size


def gradient(df: DataFrame, model, loss_sum: Callable[[object, pd.DataFrame], tuple[Tensor, int]]) -> tuple[float, int]:
    """Sets the gradients of model's parameters to those of the mean loss over df; returns that mean and the number of rows.

    Partitions' sums are added up in FAN tasks, in the order of partitions, so that reruns agree; FAN vectors at most reach the driver, however many partitions df has.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total, rows, part = shipped.value, 0.0, 0, 0
        for p in own.params():
            p.zero_grad()
        for f in frames:
            if len(f):
                loss, n = loss_sum(own, f)
                loss.backward()
                total, rows, part = total + float(loss.value[0, 0]), rows + n, int(f["__part"].iloc[0])
        if rows:
            yield pd.DataFrame({"part": [part], "loss": [total], "n": [rows], "grad": [flat(own.params())]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows, grad, part = 0.0, 0, None, 0
        for f in frames:
            for p, loss, n, g in zip(f.part, f.loss, f.n, f.grad):
                total, rows, part = total + loss, rows + n, int(p)
                grad = np.array(g) if grad is None else grad + g
        if grad is not None:
            yield pd.DataFrame({"part": [part], "loss": [total], "n": [rows], "grad": [grad]})

    sums = df.withColumn("__part", F.spark_partition_id()).mapInPandas(run, PARTIAL)
    added = sums.repartition(FAN, F.pmod("part", F.lit(FAN))).sortWithinPartitions("part").mapInPandas(add, PARTIAL)
    parts = sorted(added.collect(), key=lambda r: r["part"])
    shipped.unpersist()
    n = sum(r["n"] for r in parts)
    if not n:
        raise ValueError("no rows")
    unflat(model.params(), sum(np.array(r["grad"]) for r in parts) / n)
    return sum(r["loss"] for r in parts) / n, n


def mlp_loss(model: MLP, f: pd.DataFrame) -> tuple[Tensor, int]:
    x = Tensor(np.stack(f.x.to_numpy()))
    return tape.mul(tape.cross_entropy(model.forward(x), f.label.to_numpy()), float(len(f))), len(f)


def fit_mlp(df: DataFrame, model: MLP, epochs: int, lr: float = 0.01) -> list[float]:
    """df (x array<double>, label int): full-batch Adam. Returns the losses."""
    base = df.select("x", "label").persist(StorageLevel.MEMORY_AND_DISK)
    optimizer, losses = Adam(model.params(), lr), []
    try:
        for _ in range(epochs):
            losses.append(gradient(base, model, mlp_loss)[0])
            optimizer.step()
    finally:
        base.unpersist()
    return losses


def packed(model, optimizer: Adam) -> np.ndarray:
    """Parameters and the optimizer's moments, one after the other."""
    return np.concatenate([x.ravel() for x in [*(p.value for p in model.params()), *optimizer.m, *optimizer.v]])


def unpack(model, optimizer: Adam, flat_state: np.ndarray) -> None:
    at = 0
    for x in [*(p.value for p in model.params()), *optimizer.m, *optimizer.v]:
        x[...] = flat_state[at : at + x.size].reshape(x.shape)
        at += x.size


#: What a shard comes back with: its batches, the sum of their losses, and its state times its batches.
SHARD = "shard long, batches long, loss double, state array<double>"
#: Sums over shards, the first of them, and the most batches of one.
SUM = "shard long, most long, batches long, loss double, state array<double>"


#: What a barrier stage comes back with: the optimizer's clock, each round's sum of losses, the state.
STAGED = "clock long, losses array<double>, state array<double>"


def fit_mlp_batches(df: DataFrame, model: MLP, epochs: int, batch: int, lr: float = 1e-3, shards: int = 1, batches: int = 64) -> list[float]:
    """df (id, x, label): mini-batches of consecutive rows in the order of id, the last of an epoch dropped if it isn't full. Returns each epoch's mean loss, nan without a full batch.

    Local SGD with averaging: a round deals shards * batches batches, those of a shard being consecutive. Every shard starts from the same weights and Adam moments and goes through its
    batches one after the other; then states are averaged, weighted by the batches taken, and the next round begins. The optimizer's clock goes on by the most batches that a shard took. With one
    shard this is the serial loop. What the result depends on is shards and batches, never the number of tasks, partitions or executors. Rows are numbered once and written in chunks of rounds.
    Up to FAN shards, a chunk is a barrier stage of STAGE rounds: its tasks stay for all of them and send their shards' states to the first task, which answers with the average, so a round costs
    a message each way, not a job, and none of it goes through the driver. A lost task repeats its stage. With more shards, which one task would have to add up, or where barrier stages can't run, a
    round is a job with a task for each shard over a chunk of CHUNK rounds that is held. Either way a task holds a batch and the states, and one average of states reaches the driver a job.
    """
    ordered, base = numbered(df.select("id", "x", "label"), "id")
    context, optimizer, out = df.sparkSession.sparkContext, Adam(model.params(), lr), []
    whole, long = base.count() // batch, STAGE if gang(context, shards) else CHUNK
    number = F.floor(F.col("n_th") / batch)
    turn = F.floor(number / (shards * batches))
    dealt = ordered.where(number < whole).select(F.floor(turn / long).alias("chunk"), turn.alias("round"), F.pmod(F.floor(number / batches), F.lit(shards)).alias("shard"), "n_th", "x", "label")
    rounds, path = -(-whole // (shards * batches)), f"{shared_folder(df.sparkSession, 'batches')}/dealt"
    try:
        dealt.write.partitionBy("chunk").parquet(path)
    finally:
        base.unpersist()
    for _ in range(epochs):
        lost = 0.0
        for c in range(0, rounds, long):
            own, turns = df.sparkSession.read.schema(dealt.drop("chunk").schema).parquet(f"{path}/chunk={c // long}"), range(c, min(c + long, rounds))
            tasks = gang(context, shards)
            if tasks:
                placed = own.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("n_th")
                for loss in _stage(context, placed, model, optimizer, batch, shards, batches, turns):
                    lost += loss
                continue
            own = own.repartition(shards, "shard").sortWithinPartitions("shard", "n_th").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                for k in turns:
                    lost += _round(context, own.where(F.col("round") == k).drop("round"), model, optimizer, batch, shards)[0]
            finally:
                own.unpersist()
        out.append(lost / whole if whole else math.nan)
    return out


def gang(context, shards: int) -> int:
    """Tasks of a barrier stage for so many shards, one for each as far as there are slots; 0 where rounds have to be jobs."""
    if shards > FAN or context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    own = context._jsc.sc()
    return min(shards, own.maxNumConcurrentTasks(own.resourceProfileManager().defaultResourceProfile()))


def _shipped(context, model: MLP, optimizer: Adam):
    return context.broadcast(pickle.dumps((model, optimizer.lr, optimizer.t, packed(model, optimizer))))


def _start(held: bytes) -> tuple[MLP, Adam]:
    own, rate, t, flat_state = pickle.loads(held)
    adam = Adam(own.params(), rate)
    adam.t = t
    unpack(own, adam, flat_state)
    return own, adam


def _step(own: MLP, adam: Adam, x: list, y: list) -> float:
    """One batch; its loss."""
    adam.zero_grad()
    loss = tape.cross_entropy(own.forward(Tensor(np.stack(x))), np.array(y))
    loss.backward()
    adam.step()
    return float(loss.value[0, 0])


def _batches(frames: Iterator[pd.DataFrame], batch: int) -> Iterator[tuple[int, list, list]]:
    """The number, rows and labels of each batch of frames (n_th, x, label), which have whole batches in the order of n_th."""
    x, y = [], []
    for f in frames:
        for n, row, label in zip(f.n_th, f.x, f.label):
            x.append(row)
            y.append(label)
            if len(x) == batch:
                yield int(n) // batch, x, y
                x, y = [], []


def _meet(secret: bytes) -> list[Connection]:
    """In a task of a barrier stage: the first task's connections to the others, or another's to the first."""
    own = BarrierTaskContext.get()
    tasks = own.getTaskInfos()
    if own.partitionId() == 0:
        with Listener(("", 0), backlog=len(tasks), authkey=secret) as door:
            own.allGather(str(door.address[1]))
            ends = [door.accept() for _ in tasks[1:]]
    else:
        port = int(own.allGather("")[0])
        ends = [Client((tasks[0].address.rsplit(":", 1)[0], port), authkey=secret)]
    for end in ends:
        with socket.fromfd(end.fileno(), socket.AF_INET, socket.SOCK_STREAM) as line:
            line.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return ends


def _average(done: np.ndarray) -> np.ndarray:
    """done: a row for each shard that took batches: its number, batches, loss and its state times its batches. The most batches of one, the loss, the average state."""
    total = np.zeros(done.shape[1])
    for row in done[done[:, 0].argsort()]:  # in the order of shards, whichever task has them
        total += row
    return np.concatenate([[done[:, 1].max(), total[2]], total[3:] / total[1]])


def _stage(context, df: DataFrame, model: MLP, optimizer: Adam, batch: int, shards: int, batches: int, turns: range) -> list[float]:
    """All rounds of turns over df (n_th, x, label), whose partitions hold whole shards in the order of n_th, in one barrier stage: sets model and optimizer; each round's sum of losses."""
    shipped, secret = _shipped(context, model, optimizer), secrets.token_bytes(32)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, adam = _start(shipped.value)
        first, ends, todo = BarrierTaskContext.get().partitionId() == 0, _meet(secret), groupby(_batches(frames, batch), lambda b: b[0] // batches)
        state, clock, losses, at = packed(own, adam), adam.t, [], next(todo, None)
        for k in turns:
            done = []
            while at is not None and at[0] // shards == k:
                unpack(own, adam, state)
                adam.t, taken, lost = clock, 0, 0.0
                for _, x, y in at[1]:
                    taken, lost = taken + 1, lost + _step(own, adam, x, y)
                done.append(np.concatenate([[at[0], taken, lost], packed(own, adam) * taken]))
                at = next(todo, None)
            if first:
                done = np.concatenate([*done, *(np.frombuffer(e.recv_bytes()) for e in ends)])
                told = _average(done.reshape(-1, 3 + len(state)))
                for e in ends:
                    e.send_bytes(told)
            else:
                ends[0].send_bytes(np.concatenate([np.empty(0), *done]))
                told = np.frombuffer(ends[0].recv_bytes())
            clock, state = clock + int(told[0]), told[2:]
            losses.append(float(told[1]))
        for e in ends:
            e.close()
        if first:
            yield pd.DataFrame({"clock": [clock], "losses": [losses], "state": [state]})

    (found,) = df.select("n_th", "x", "label").mapInPandas(run, STAGED, barrier=True).collect()
    shipped.unpersist()
    unpack(model, optimizer, np.array(found["state"]))
    optimizer.t = found["clock"]
    return found["losses"]


def _round(context, df: DataFrame, model: MLP, optimizer: Adam, batch: int, shards: int) -> tuple[float, int]:
    """One round over df (shard, n_th, x, label), whose partitions hold whole shards in the order of n_th: sets model and optimizer to the average of the shards; the sum of losses, and the batches."""
    shipped = _shipped(context, model, optimizer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, own, adam, x, y, taken, lost = None, None, None, [], [], 0, 0.0
        for f in frames:
            for s, row, label in zip(f.shard, f.x, f.label):
                if s != shard:
                    if taken:
                        yield pd.DataFrame({"shard": [shard], "batches": [taken], "loss": [lost], "state": [packed(own, adam) * taken]})
                    shard, (own, adam), x, y, taken, lost = s, _start(shipped.value), [], [], 0, 0.0
                x.append(row)
                y.append(label)
                if len(x) == batch:
                    x, y, taken, lost = [], [], taken + 1, lost + _step(own, adam, x, y)
        if taken:
            yield pd.DataFrame({"shard": [shard], "batches": [taken], "loss": [lost], "state": [packed(own, adam) * taken]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, most, taken, lost, state = None, 0, 0, 0.0, None
        for f in frames:
            for r in f.itertuples(index=False):
                first, most, taken, lost = r.shard if first is None else first, max(most, r.most), taken + r.batches, lost + r.loss
                state = np.array(r.state) if state is None else state + r.state
        if first is not None:
            yield pd.DataFrame({"shard": [first], "most": [most], "batches": [taken], "loss": [lost], "state": [state]})

    done = df.mapInPandas(run, SHARD).withColumn("most", F.col("batches"))
    # in the order of shards, so that reruns agree: by FAN tasks where there are more of them, then by one
    if shards > FAN:
        done = done.repartition(FAN, F.pmod("shard", F.lit(FAN))).sortWithinPartitions("shard").mapInPandas(add, SUM)
    found = done.repartition(1).sortWithinPartitions("shard").mapInPandas(add, SUM).first()
    shipped.unpersist()
    n = found["batches"]
    unpack(model, optimizer, np.array(found["state"]) / n)
    optimizer.t += found["most"]
    return found["loss"], n


def fit_groups(df: DataFrame, key: str, inputs: int, hidden: int, outputs: int, epochs: int, lr: float = 0.01, seed: int = 1) -> DataFrame:
    """One small perceptron a group, trained in one task on all of its rows: (key, n long, first_loss, last_loss, accuracy double). A group must fit a task's memory."""
    kind = df.schema[key].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        model = MLP(inputs, hidden, outputs, Rng(seed))
        optimizer, x, y, losses = Adam(model.params(), lr), np.stack(f.x.to_numpy()), f.label.to_numpy(), []
        for _ in range(epochs):
            optimizer.zero_grad()
            loss = tape.cross_entropy(model.forward(Tensor(x)), y)
            loss.backward()
            optimizer.step()
            losses.append(float(loss.value[0, 0]))
        hit = float((model.forward(Tensor(x)).value.argmax(1) == y).mean())
        return pd.DataFrame({key: [f[key].iloc[0]], "n": [len(f)], "first_loss": [losses[0]], "last_loss": [losses[-1]], "accuracy": [hit]})

    return df.select(key, "x", "label").groupBy(key).applyInPandas(run, f"`{key}` {kind}, n long, first_loss double, last_loss double, accuracy double")


def predict_mlp(df: DataFrame, model: MLP, x: str = "x") -> DataFrame:
    """Adds logits array<double> and prediction int, the first largest."""
    shipped, kept = df.sparkSession.sparkContext.broadcast(model), df.drop("logits", "prediction")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                z = shipped.value.forward(Tensor(np.stack(f[x].to_numpy()))).value
                yield f.assign(logits=list(z), prediction=z.argmax(1).astype(np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{fields}, logits array<double>, prediction int")


def gpt_loss(model: GPT, f: pd.DataFrame) -> tuple[Tensor, int]:
    """times: how often a chunk counts."""
    total = None
    for x, y, times in zip(f.x, f.y, f.times):
        one = tape.mul(model.loss(x, y), float(times))
        total = one if total is None else tape.add(total, one)
    return total, int(f.times.sum())


def numbered(df: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """df with n_th long, from 0 without gaps in the order of by, and the persisted frame that it reads.

    Rows are numbered within range partitions; offsets come from the partitions' counts, so no task sees all rows.
    """
    base = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    offsets, below = [], 0
    for part, n in sorted(tuple(r) for r in base.groupBy(F.shiftright("__at", 33).alias("part")).count().collect()):
        offsets.append((part, below))
        below += n
    first = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __below long"))
    placed = base.join(first, F.shiftright("__at", 33) == F.col("__part"))
    return placed.select(*df.columns, (F.col("__below") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("n_th")), base


def fit_gpt(corpus: TokenCorpus, model: GPT, steps: int, batch: int = 16, lr: float = 3e-4, weight_decay: float = 0.01, warmup: int = 0, clip: float = 1.0, seed: int = 1) -> list[float]:
    """Each step draws batch windows of the model's length from the joined text, averages their gradients, clips and steps. Returns the losses.

    A step reads the documents that its windows lie in; nothing else is moved but the windows, gradients and parameters.
    """
    optimizer, rng, losses, tasks = Adam(model.params(), lr, weight_decay=weight_decay), Rng(seed), [], corpus.base.sparkSession.sparkContext.defaultParallelism
    for step in range(1, steps + 1):
        optimizer.set_lr(cosine_lr(step, steps, lr, warmup))
        drawn = corpus.sample(rng, batch, model.config.block_size).withColumn("times", F.lit(1))
        losses.append(gradient(drawn.repartition(min(batch, tasks), "id"), model, gpt_loss)[0])
        clip_grad_norm(model.params(), clip)
        optimizer.step()
    return losses


def sampled_perplexity(corpus: TokenCorpus, model: GPT, chunks: int, rng: Rng) -> float:
    """exp of the mean loss of random windows."""
    return perplexity(corpus.sample(rng, chunks, model.config.block_size), model)


def gpt_forward(df: DataFrame, model: GPT, ids: str = "ids") -> DataFrame:
    """Adds last_logits array<double>, of the position after the last id; the context is the last block_size ids."""
    shipped, kept = df.sparkSession.sparkContext.broadcast(model), df.drop("last_logits")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = shipped.value
            yield f.assign(last_logits=[own.forward(list(x)[-own.config.block_size :]).value[-1] for x in f[ids]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{fields}, last_logits array<double>")


def gpt_losses(chunks: DataFrame, model: GPT) -> DataFrame:
    """(id, loss) of each chunk (id, x, y)."""
    shipped = chunks.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f.id, "loss": [float(shipped.value.loss(x, y).value[0, 0]) for x, y in zip(f.x, f.y)]})

    return chunks.select("id", "x", "y").mapInPandas(run, "id long, loss double")


def perplexity(chunks: DataFrame, model: GPT) -> float:
    return math.exp(gpt_losses(chunks, model).agg(F.avg("loss")).first()[0])


def generate(prompts: DataFrame, model: GPT, n: int, config: SampleConfig, key: str = "id", ids: str = "ids", seed: int = 1) -> DataFrame:
    """(key, ids with n more): each prompt goes on by itself, with a stream of its own from seed and key, so prompts run in parallel and reruns agree."""
    shipped = prompts.sparkSession.sparkContext.broadcast(model)
    kind = prompts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own, out = shipped.value, []
            for k, x in zip(f[key], f[ids]):
                rng, said = Rng(seed * 1_000_003 + int(k) + 1), [int(i) for i in x]
                for _ in range(n):
                    logits = own.forward(said[-own.config.block_size :]).value[-1]
                    said.append(sample_one(logits, config, rng))
                out.append(said)
            yield pd.DataFrame({key: f[key], "ids": out})

    return prompts.select(key, ids).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


__all__ = ["GPT", "GPTConfig", "MLP", "TokenCorpus", "fit_gpt", "fit_groups", "fit_mlp", "fit_mlp_batches", "generate", "gpt_forward", "gpt_losses", "gradient", "numbered", "perplexity", "predict_mlp", "sampled_perplexity"]
