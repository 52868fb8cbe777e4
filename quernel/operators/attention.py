"""Attention over sequences of any length, by blocks with mergeable softmax states.

Positions are packed in blocks of BLOCK rows, all heads of a row in it. A stretch of query blocks and one of key blocks are a cell; in it the queries go through the keys, TILE by TILE, and
keep, for each row and head, the running maximum, the sum of exponentials and the weighted sum of values. States merge whatever their order, so the cells of a
query block are merged where there are several, and scores are never rows. A stretch is SPAN blocks, or the GRID-th part of a longer sequence, so that a block meets GRID cells at most and
what is moved grows with the rows, not with their square; only stretches of ROWS rows, which a cell holds in memory, don't grow any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, SPAN = 128, 16
#: Stretches of a sequence, and rows of a stretch (at most, unless SPAN blocks have more).
GRID, ROWS = 12, 1 << 16
#: Queries and keys whose scores a cell makes at once.
TILE = (256, 512)
#: Sequences whose lengths are broadcast.
LENGTHS = 1_000_000


class State:
    """Of the rows of a query block (heads, rows, …): the largest score so far, the sum of exp(score - largest), and the values so weighted."""

    def __init__(self, top: np.ndarray, total: np.ndarray, values: np.ndarray):
        self.top, self.total, self.values = top, total, values

    @staticmethod
    def empty(heads: int, rows: int, width: int) -> State:
        return State(np.full((heads, rows), -np.inf), np.zeros((heads, rows)), np.zeros((heads, rows, width)))

    def merge(self, other: State) -> State:
        top = np.maximum(self.top, other.top)
        # a row that has seen nothing has no largest score
        a, b = (np.exp(np.where(np.isneginf(top), 0.0, x.top - np.where(np.isneginf(top), 0.0, top))) for x in (self, other))
        return State(top, a * self.total + b * other.total, a[..., None] * self.values + b[..., None] * other.values)

    @staticmethod
    def of(q: np.ndarray, k: np.ndarray, v: np.ndarray, allowed: np.ndarray | None) -> State:
        """q (heads, rows, width), k and v (heads, keys, width); allowed (rows, keys) or all."""
        scores = q @ k.transpose(0, 2, 1) / math.sqrt(q.shape[2])
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        top = scores.max(2)
        e = np.exp(scores - np.where(np.isneginf(top), 0.0, top)[..., None])
        return State(top, e.sum(2), e @ v)

    def result(self) -> np.ndarray:
        return self.values / self.total[..., None]

    def dump(self) -> bytes:
        return np.concatenate((self.top[..., None], self.total[..., None], self.values), 2).tobytes()

    @staticmethod
    def load(raw, heads: int, width: int) -> State:
        x = np.frombuffer(raw, np.float64).reshape(heads, -1, width + 2)
        return State(x[..., 0], x[..., 1], x[..., 2:])


def _heads(raw: bytes, heads: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, heads, width).transpose(1, 0, 2)


def attention(df: DataFrame, heads: int, causal: bool = True, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """df (seq, pos long, q, k, v array<double>) -> (seq, pos, v): softmax(q kᵀ / sqrt(width)) v of each head, heads side by side.

    pos is from 0 and orders a sequence; causal: a position sees itself and those before it. Missing positions are nobody's keys. Repeated positions see one another. Null seq or pos take no part.
    """
    kind = df.schema["seq"].dataType.simpleString()
    size = df.select(F.max(F.size("q")), F.min(F.size("q")), F.max(F.size("v")), F.min(F.size("v")), F.max(F.size("k")), F.min(F.size("k")), F.approx_count_distinct("seq")).first()
    *size, sequences = size
    if size[0] is None:
        return df.select("seq", "pos", "v")
    wide = size[0]
    if set(size) != {wide} or heads <= 0 or wide % heads:
        raise ValueError("q, k and v have one width, a multiple of the number of heads")
    width = wide // heads
    rows = df.where(F.col("seq").isNotNull() & F.col("pos").isNotNull()).select("seq", F.floor(F.col("pos") / block).alias("b"), "pos", "q", "k", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            pos, *parts = zip(*held)
            raw = [np.concatenate(x).tobytes() for x in parts]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], types[0]), pa.array([key[1]], pa.int64()), pa.array([list(pos)], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in raw)], names=["seq", "b", "pos", "q", "k", "v"])

        types = None
        for batch in batches:
            types = types or [f.type for f in batch.schema]
            seqs, bs, ps = (batch.column(i).to_pylist() for i in range(3))
            for n, at in enumerate(zip(seqs, bs)):
                if at != key:
                    if held:
                        yield out()
                    key, held = at, []
                held.append((ps[n], *(batch.column(c)[n].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in (3, 4, 5))))
        if held:
            yield out()

    packed = rows.repartition("seq", "b").sortWithinPartitions("seq", "b", "pos").mapInArrow(pack, f"seq {kind}, b long, pos array<long>, q binary, k binary, v binary")

    # cells (g, h): query blocks g * span and on, key blocks h * span and on
    long = F.least(F.ceil((F.col("last") + 1) / GRID), F.lit(max(1, ROWS // block)))
    last = rows.groupBy("seq").agg(F.max("b").alias("last")).select("seq", F.greatest(F.lit(span), long).cast("long").alias("span"), "last")
    own, end = (F.floor(F.col(c) / F.col("span")) for c in ("b", "last"))
    placed = packed.join(F.broadcast(last) if sequences <= LENGTHS else last, "seq").withColumns({"own": own, "end": end})
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    asks = placed.select("seq", F.col("own").alias("g"), F.explode(F.sequence(zero, F.col("own") if causal else F.col("end"))).alias("h"), F.lit(0).alias("side"), "b", "pos", F.col("q").alias("x"), none.alias("y"))
    keys = placed.select("seq", F.explode(F.sequence(F.col("own") if causal else zero, F.col("end"))).alias("g"), F.col("own").alias("h"), F.lit(1).alias("side"), "b", "pos", F.col("k").alias("x"), F.col("v").alias("y"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, held, found, wide = None, [], [], None, 0

        def fold() -> None:
            """All queries of the cell go through the keys that wait."""
            nonlocal found, wide
            if held and asked:
                if found is None:
                    q, at = np.concatenate([a[2] for a in asked], 1), np.concatenate([a[1] for a in asked])
                    found = q, at, State.empty(heads, len(at), width)
                q, at, state = found
                at_keys, k, v = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], 1), np.concatenate([x[2] for x in held], 1)
                for i in range(0, len(at), TILE[0]):
                    here = slice(i, i + TILE[0])
                    if causal and at[here].max() < at_keys.min():
                        continue
                    allowed = at[here, None] >= at_keys if causal and at[here].min() < at_keys.max() else None
                    new = State(*(x[:, here] for x in (state.top, state.total, state.values))).merge(State.of(q[:, here], k, v, allowed))
                    state.top[:, here], state.total[:, here], state.values[:, here] = new.top, new.total, new.values
            held.clear()
            wide = 0

        def out() -> Iterator[pa.RecordBatch]:
            fold()
            n = 0
            for b, pos, _ in asked if found else ():
                here = slice(n, n := n + len(pos))
                state = State(*(x[:, here] for x in (found[2].top, found[2].total, found[2].values)))
                if np.isfinite(state.top).any():
                    yield pa.RecordBatch.from_arrays([pa.array([cell[0]], kinds[0]), pa.array([b], pa.int64()), pa.array([cell[2]], pa.int64()), pa.array([pos], pa.list_(pa.int64())), pa.array([state.dump()], pa.binary())], names=["seq", "b", "h", "pos", "state"])

        kinds = None
        for batch in batches:
            kinds = kinds or [f.type for f in batch.schema]
            for r in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                at = (r["seq"], r["g"], r["h"])
                if at != cell:
                    yield from out()
                    cell, asked, found = at, [], None
                x = _heads(r["x"], heads, width)
                if r["side"] == 0:
                    asked.append((r["b"], r["pos"], x))
                    continue
                held.append((np.array(r["pos"]), x, _heads(r["y"], heads, width)))
                wide += x.shape[1]
                if wide >= TILE[1]:
                    fold()
        yield from out()

    order = ["seq", "g", "h", "side", "b"]
    states = asks.unionByName(keys).repartition("seq", "g", "h").sortWithinPartitions(*order).mapInArrow(meet, f"seq {kind}, b long, h long, pos array<long>, state binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, state = None, None, None

        def out() -> pa.RecordBatch:
            x = state.result().transpose(1, 0, 2).reshape(len(pos), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(pos), kinds[0]), pa.array(pos, pa.int64()), lists], names=["seq", "pos", "v"])

        kinds = None
        for batch in batches:
            kinds = kinds or [f.type for f in batch.schema]
            for r in batch.to_pylist():
                found = State.load(r["state"], heads, width)
                if (r["seq"], r["b"]) != key:
                    if key is not None:
                        yield out()
                    key, pos, state = (r["seq"], r["b"]), r["pos"], found
                else:
                    state = state.merge(found)
        if key is not None:
            yield out()

    return states.repartition("seq", "b").sortWithinPartitions("seq", "b", "h").mapInArrow(join, f"seq {kind}, pos long, v array<double>")
