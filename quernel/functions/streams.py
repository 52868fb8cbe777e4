"""Draws of one serial random stream attached to the rows of a table, by many tasks.

Rows are put in order by a range partitioning, and row i gets what Rng(seed) draws for its ith call, whatever the number of partitions. A stream is entered anywhere by powers of
its step. Where a unit (what a row, or a pair of rows, takes) has a varying number of draws, where the ith begins depends on all before it. The stream is cut in segments, and each is read
from every place it may be entered at, at once: its map says, for each such place, where the unit that crosses its end ends in the next segment, and how many units begin in it. Chains
from different places soon run together, so a map costs little more than one chain. Maps compose: FAN neighbours at a time, level by level, until few are left;
then the way down gives each segment its true entry and the number of its first unit, and each partition of rows starts at the segment that holds its first unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.rng import DEFAULT_SEED, MULTIPLIER, TINY, Rng, advance, apply, jump, step_matrix

#: States that are stepped at once; draws of a segment; maps that one task composes, and maps that the driver does.
LANES, SEGMENT, FAN, TOP = 4096, 1 << 18, 256, 1024
FAR = np.int64(1 << 62)


@lru_cache
def _tables() -> np.ndarray:
    """The step by LANES, for each byte of a state: 8 x 256."""
    matrix = step_matrix()
    for _ in range(LANES.bit_length() - 1):
        matrix = [apply(matrix, c) for c in matrix]
    out = np.zeros((8, 256), np.uint64)
    for k in range(8):
        for value in range(256):
            out[k, value] = apply(matrix, value << 8 * k)
    return out


class Source:
    """The stream of a seed from its draw number at on."""

    def __init__(self, seed: int, at: int = 0):
        state, first = jump(Rng(seed).state, at), []
        for _ in range(LANES):
            state = advance(state)
            first.append(state)
        self.lanes, self.used = np.array(first, np.uint64), 0

    def take(self, n: int) -> np.ndarray:
        """The next n uniforms."""
        parts, tables = [], _tables()
        while n:
            if self.used == LANES:
                x = self.lanes
                self.lanes = tables[0][x & np.uint64(255)]
                for k in range(1, 8):
                    self.lanes ^= tables[k][x >> np.uint64(8 * k) & np.uint64(255)]
                self.used = 0
            part = self.lanes[self.used : self.used + n]
            parts.append(part)
            self.used, n = self.used + len(part), n - len(part)
        x = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return (x * np.uint64(MULTIPLIER) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Draws(NamedTuple):
    """What a unit draws: a uniform for each U of pattern, one above TINY for each P; or, with no pattern, uniforms until their product is limit or less. rows: of a unit.

    values: uniforms (units, len(pattern)), or the number of draws of each unit, and the numbers of their rows -> one array for each of names.
    """

    pattern: str
    rows: int
    names: tuple[str, ...]
    values: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]]
    limit: float = 0.0

    @property
    def mean(self) -> float:
        return len(self.pattern) or 1.0 - math.log(self.limit)

    @property
    def entries(self) -> int:
        """Places at which a segment may be entered: a unit that goes further into it has a probability below 1e-30."""
        return 64 + len(self.pattern) if self.pattern else int(64 + self.mean + 16 * self.mean**0.5)

    @property
    def fixed(self) -> bool:
        """Every unit draws the same number."""
        return bool(self.pattern) and "P" not in self.pattern

    def after(self, u: np.ndarray, n: int) -> np.ndarray:
        """For each place below n where the unit that begins there ends; FAR where u doesn't hold all of it."""
        at = np.arange(n)
        if not self.pattern:
            out, product, k = np.full(n, FAR), u[:n].copy(), 1
            live = np.arange(n)
            while len(live):
                done = product <= self.limit
                out[live[done]] = live[done] + k
                live, product = live[~done], product[~done]
                inside = live + k < len(u)
                live, product = live[inside], product[inside] * u[live[inside] + k]
                k += 1
            return out
        # the next place that a P may take
        fine = np.minimum.accumulate(np.where(u > TINY, np.arange(len(u)), FAR)[::-1])[::-1]
        for c in self.pattern:
            inside = at < len(u)
            at = np.where(inside, fine[np.minimum(at, len(u) - 1)] if c == "P" else at, FAR)
            at = np.where(at < len(u), at + 1, FAR)
        return at

    def drawn(self, u: np.ndarray, starts: np.ndarray, after: np.ndarray) -> np.ndarray:
        """What values() takes, for the units at starts."""
        if not self.pattern:
            return after[starts] - starts
        out, at = np.empty((len(starts), len(self.pattern))), starts.copy()
        for k, c in enumerate(self.pattern):
            while c == "P" and (low := u[at] <= TINY).any():
                at[low] += 1
            out[:, k] = u[at]
            at += 1
        return out


def _read(source: Source, draws: Draws, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Uniforms from here on, and where each unit that begins at one of the first n ends."""
    u = source.take(n + draws.entries)
    while ((after := draws.after(u, n)) >= FAR).any():
        u = np.concatenate((u, source.take(len(u))))
    return u, after


def segment_map(seed: int, draws: Draws, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of segment k: the entry of the next one, and the units that begin in between."""
    after = _read(Source(seed, k * size), draws, size)[1]
    count = np.ones(size, np.int64)
    while (inside := after < size).any():  # twice as far each time
        on = after[inside]
        count[inside] += count[on]
        after[inside] = after[on]
    n = draws.entries
    out, units = after[:n] - size, count[:n]
    if size < n:  # a segment shorter than the places it may be entered at is passed over from the rest
        out, units = np.concatenate((out, np.arange(n - size))), np.concatenate((units, np.zeros(n - size, np.int64)))
    return out, units


def _compose(maps: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    out, count = maps[0]
    for after, more in maps[1:]:
        if out.max() >= len(after):
            raise OverflowError("a unit takes more draws than a segment may be entered after")
        out, count = after[out], count + more[out]
    return out, count


MAPS = "k long, exit array<long>, units array<long>"
SEGMENTS = "k long, entry long, first long, units long"


def segments(spark: SparkSession, seed: int, draws: Draws, units: int, size: int = SEGMENT, fan: int = FAN, top: int = TOP) -> DataFrame:
    """(k, entry, first, units, all long) of the segments that the first units reach: where the first unit to begin in segment k begins, its number, and how many begin there."""
    n = int(units * draws.mean / size * 1.01) + 8
    while True:
        tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                found = [segment_map(seed, draws, int(k), size) for k in f.id]
                yield pd.DataFrame({"k": f.id, "exit": [x for x, _ in found], "units": [x for _, x in found]})

        def up(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("k")
            out, count = _compose([(np.asarray(a), np.asarray(b)) for a, b in zip(f.exit, f.units)])
            return pd.DataFrame({"k": [int(f.k.iloc[0]) // fan], "exit": [out], "units": [count]})

        def down(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(b):
                entry, first = int(b.entry.iloc[0]), int(b["first"].iloc[0])
                for k, after, count in a.sort_values("k").itertuples(index=False):
                    out.append((k, entry, first, int(count[entry])))
                    entry, first = int(after[entry]), first + int(count[entry])
            return pd.DataFrame(out, columns=["k", "entry", "first", "units"])

        levels = [spark.range(0, n, 1, tasks).mapInPandas(run, MAPS).persist(StorageLevel.MEMORY_AND_DISK)]
        left = n
        while left > top:
            left = -(-left // fan)
            levels.append(levels[-1].groupBy(F.floor(F.col("k") / fan)).applyInPandas(up, MAPS).persist(StorageLevel.MEMORY_AND_DISK))
        entry, first, found = 0, 0, []
        for r in sorted(levels[-1].collect(), key=lambda r: r["k"]):
            found.append((r["k"], entry, first, r["units"][entry]))
            entry, first = r["exit"][entry], first + r["units"][entry]
        if first < units:
            n += max(8, n // 20)
            for level in levels:
                level.unpersist()
            continue
        out = spark.createDataFrame(found, SEGMENTS)
        for level in reversed(levels[:-1]):
            out = level.groupBy(F.floor(F.col("k") / fan).alias("g")).cogroup(out.groupBy(F.col("k").alias("g"))).applyInPandas(down, SEGMENTS)
        return out


def attach(df: DataFrame, keys: Sequence[str], draws: Draws, seed: int = DEFAULT_SEED, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """df with the columns draws.names: in the order of keys, which should name a row, each row has what the serial stream gives it. And the persisted frame that it reads.

    Rows that tie in keys come in any order. Columns of these names are replaced. An empty table stays empty.
    """
    spark, kept = df.sparkSession, df.drop(*draws.names)
    base = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    starts, below = {}, 0
    for part, n in sorted(tuple(r) for r in base.groupBy(F.shiftright("__at", 33).alias("part")).count().collect()):
        starts[part], below = below, below + n
    # for each partition: its first row, the place in the stream to read from, and the number of the unit that begins there
    units = -(-below // draws.rows)
    if draws.fixed or not starts:
        at = {part: (row, row // draws.rows * len(draws.pattern), row // draws.rows) for part, row in starts.items()}
    else:
        # a segment looks its units up among the partitions' first ones, of which it holds few
        parts = sorted((row // draws.rows, part, row) for part, row in starts.items())
        wanted = np.array([unit for unit, _, _ in parts])

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                low, high = (np.searchsorted(wanted, x) for x in (f["first"], f["first"] + f["units"]))
                for k in np.flatnonzero(low < high):
                    yield pd.DataFrame([(i, *f.iloc[k]) for i in range(low[k], high[k])], columns=["i", "k", "entry", "first", "units"])

        near = segments(spark, seed, draws, units, size).mapInPandas(look, f"i long, {SEGMENTS}").collect()
        at = {parts[r["i"]][1]: (parts[r["i"]][2], r["k"] * size + r["entry"], r["first"]) for r in near}
    shipped = spark.sparkContext.broadcast(at)
    kinds = [pa.float64() if n != "label" else pa.int32() for n in draws.names]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.DoubleType() if n != "label" else T.IntegerType()) for n in draws.names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, row, made = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if made is None:
                row, place, unit = shipped.value[batch.column(batch.num_columns - 1)[0].as_py() >> 33]
                made = serial(seed, draws, place, unit, row)
                ready = [np.zeros(0)] * len(draws.names)
            while len(ready[0]) < batch.num_rows:
                ready = [np.concatenate((a, b)) for a, b in zip(ready, next(made))]
            new = [pa.array(x[: batch.num_rows], t, safe=False) for x, t in zip(ready, kinds)]
            ready = [x[batch.num_rows :] for x in ready]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[f.name for f in schema])

    return base.mapInArrow(run, schema), base


def serial(seed: int, draws: Draws, place: int, unit: int, row: int, chunk: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The values of row and all after it, a chunk at a time; the unit of that number begins at place of the stream."""
    source, rest, at = Source(seed, place), np.zeros(0), 0
    while True:
        u = np.concatenate((rest, source.take(chunk)))
        after = draws.after(u, len(u))
        if draws.fixed:
            starts = np.arange(at, len(u) - len(draws.pattern) + 1, len(draws.pattern))
        else:
            chain, where = [], after.tolist()
            while at < len(u) and where[at] < FAR:
                chain.append(at)
                at = where[at]
            starts = np.array(chain, np.int64)
        at = int(after[starts[-1]]) if len(starts) else at
        numbers = np.arange(unit * draws.rows, (unit + len(starts)) * draws.rows)
        values, skip = draws.values(draws.drawn(u, starts, after), numbers) if len(starts) else [np.zeros(0)] * len(draws.names), max(0, row - unit * draws.rows)
        unit += len(starts)
        rest, at = u[at:], 0
        yield [np.asarray(x)[skip:] for x in values]


def _normal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    radius, angle = np.sqrt(-2.0 * np.log(a)), 2.0 * math.pi * b
    return radius * np.cos(angle), radius * np.sin(angle)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack((a, b)).ravel()


def uniform(a: float = 0.0, b: float = 1.0) -> Draws:
    return Draws("U", 1, ("value",), lambda u, i: [u[:, 0] if (a, b) == (0.0, 1.0) else a + (b - a) * u[:, 0]])


def bernoulli(p: float) -> Draws:
    return Draws("U", 1, ("value",), lambda u, i: [(u[:, 0] < p).astype(float)])


def exponential(rate: float = 1.0) -> Draws:
    return Draws("P", 1, ("value",), lambda u, i: [-np.log(u[:, 0]) / rate])


def gaussian(mean: float = 0.0, sd: float = 1.0) -> Draws:
    """Values come in pairs."""
    return Draws("PU", 2, ("value",), lambda u, i: [mean + sd * _both(*_normal(u[:, 0], u[:, 1]))])


def poisson(rate: float) -> Draws:
    return Draws("", 1, ("value",), lambda n, i: [(n - 1).astype(float)], math.exp(-rate))


DISTRIBUTIONS = {"uniform": uniform, "gaussian": gaussian, "exponential": exponential, "bernoulli": bernoulli, "poisson": poisson}


def frame(spark: SparkSession, n: int, dist: str = "uniform", seed: int = DEFAULT_SEED, **params: float) -> DataFrame:
    """(id long, value double): the n values that Rng(seed) gives one after the other."""
    if dist not in DISTRIBUTIONS:
        raise ValueError(f"no distribution {dist}")
    return attach(spark.range(n), ["id"], DISTRIBUTIONS[dist](**params), seed)[0]


def rings(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """A point (x1, x2, label) for each row: two classes, label = row number % 2, of radius within 1, and from 1.5 to 2.5, with noise of sd 0.05."""

    def values(u, i):
        radius, angle = np.where(i % 2 == 0, u[:, 0], 1.5 + (2.5 - 1.5) * u[:, 0]), 2 * math.pi * u[:, 1]
        a, b = _normal(u[:, 2], u[:, 3])
        return radius * np.cos(angle) + 0.05 * a, radius * np.sin(angle) + 0.05 * b, i % 2

    return attach(df, keys, Draws("UUPU", 1, ("x1", "x2", "label"), values), seed)[0]


def clusters(df: DataFrame, keys: Sequence[str], seed: int, sd: float = 0.6) -> DataFrame:
    """(x1, x2, y): two clusters around (-2, -2) and (2, 2), y = row number % 2."""

    def values(u, i):
        center = np.where(i % 2 == 1, 2.0, -2.0)
        a, b = _normal(u[:, 0], u[:, 1])
        return center + sd * a, center + sd * b, (i % 2).astype(float)

    return attach(df, keys, Draws("PU", 1, ("x1", "x2", "y"), values), seed)[0]


def noisy_line(df: DataFrame, keys: Sequence[str], seed: int, slope: float = 4.0, intercept: float = 7.0, sd: float = 1.0) -> DataFrame:
    """(x, y): x from -5 to 5. The second of a pair of normals goes to the next row."""

    def values(u, i):
        x = -5 + 10 * _both(u[:, 0], u[:, 3])
        return x, slope * x + intercept + sd * _both(*_normal(u[:, 1], u[:, 2]))

    return attach(df, keys, Draws("UPUU", 2, ("x", "y"), values), seed)[0]


def correlated(df: DataFrame, keys: Sequence[str], seed: int, slope: float = 0.8, sd: float = 0.5) -> DataFrame:
    def values(u, i):
        a, b = _normal(u[:, 0], u[:, 1])
        return a, slope * a + sd * b

    return attach(df, keys, Draws("PU", 1, ("x", "y"), values), seed)[0]
