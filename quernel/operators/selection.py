"""Exact percentiles of columns that fit no task, by distributed selection.

Every value is a 64-bit key in the order of the doubles. A round counts, for each group, the keys that share a wanted rank's prefix by their next DIGIT bits, and the counts
name the next digit, until after 64 / DIGIT rounds the key is whole. All groups, all percentiles and both ranks beside each go through the same rounds. A task holds counts of digits,
at most 2 ** DIGIT for each prefix in use, however many rows or distinct values there are. All rounds are one lazy plan: each reads the column again and joins the prefixes,
which Spark broadcasts where they are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16
#: Groups whose prefixes are broadcast.
FEW = 10_000
SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def to_keys(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles: -0.0 is 0.0, every nan is the one that comes after infinity."""
    x = np.where(np.isnan(x), np.nan, x) + 0.0
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ SIGN, bits)


def from_keys(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ SIGN, keys).view(np.float64)


def _mapped(df: DataFrame, by: list[str], source: str, out: str, kind: str, work) -> DataFrame:
    """by and the column out that work makes of source, an array of numpy."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), f"`{out}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(work(b.columns[-1].to_numpy(zero_copy_only=False)))], names=[*by, out])

    return df.select(*by, source).mapInArrow(run, schema)


def percentiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = (), digit: int = DIGIT, few: bool = False) -> DataFrame:
    """by columns, p double, n long, value double: each group's exact percentiles, with linear interpolation at rank p / 100 * (n - 1).

    Null values don't count; a group without any has no row, and an empty table gives none. A null in by is a group. few: groups are few, so that prefixes are broadcast and no key is moved. nan is the largest value; between infinities of one sign there is nothing to interpolate.
    """
    if not ps or not all(0 <= p <= 100 for p in ps):
        raise ValueError("a percentile lies within 0 and 100")
    if 64 % digit:
        raise ValueError("64 is no multiple of the digit")
    groups = [f"__g{i}" for i in range(len(by))]
    base = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(value).cast("double").alias("__x"))
    keys = _mapped(base, groups, "__x", "__key", "long", to_keys)
    part = lambda below: F.shiftright("__key", below)
    low = lambda below: F.col("__key").bitwiseAND(F.lit((1 << digit) - 1)) if below == 0 else F.shiftright("__key", below).bitwiseAND(F.lit((1 << digit) - 1))

    def found(counted: DataFrame, near: list[str], targets: Column, prefix: Column) -> DataFrame:
        """Counts of digits -> the prefixes that hold targets (struct p, side, rank), with the ranks that are left within each."""
        before = F.sum("__n").over(Window.partitionBy(*near).orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1))
        placed = counted.withColumn("__before", F.coalesce(before, F.lit(0)))
        here = lambda t: (t["rank"] >= F.col("__before")) & (t["rank"] < F.col("__before") + F.col("__n"))
        moved = lambda t: F.struct(t["i"].alias("i"), t["side"].alias("side"), (t["rank"] - F.col("__before")).alias("rank"), t["n"].alias("n"))
        kept = placed.select(*groups, prefix.alias("__prefix"), F.transform(F.filter(targets, here), moved).alias("__targets"))
        return kept.where(F.size("__targets") > 0)

    # the first round needs no prefix, and its counts give n
    below = 64 - digit
    counted = keys.groupBy(*groups, part(below).alias("__digit")).agg(F.count("*").alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*groups))
    at = [(i, side, F.col("__all").cast("double") - 1, float(p)) for i, p in enumerate(ps) for side in (0, 1)]
    rank = lambda side, last, p: (F.ceil if side else F.floor)(last * F.lit(p / 100)).cast("long")
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank(side, last, p).alias("rank"), F.col("__all").alias("n")) for i, side, last, p in at])
    state = found(counted.withColumn("__all", total), groups, targets, F.col("__digit"))
    while below:
        below -= digit
        same = [F.col(f"k.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
        both = keys.alias("k").join((F.broadcast(state) if few else state).alias("s"), [*same, F.shiftright("k.__key", below + digit) == F.col("s.__prefix")])
        both = both.select(*[F.col(f"k.{g}").alias(g) for g in groups], "__prefix", "__targets", low(below).alias("__digit"))
        counted = both.groupBy(*groups, "__prefix", "__digit").agg(F.count("*").alias("__n"), F.first("__targets").alias("__targets"))
        state = found(counted, [*groups, "__prefix"], F.col("__targets"), F.shiftleft("__prefix", digit).bitwiseOR(F.col("__digit")))
    rows = state.select(*groups, F.explode("__targets").alias("t"), "__prefix").select(*groups, "t.i", "t.side", "t.n", "__prefix")
    ends = _mapped(rows, [*groups, "i", "side", "n"], "__prefix", "__x", "double", from_keys)
    pair = ends.groupBy(*groups, "i", "n").agg(F.max(F.when(F.col("side") == 0, F.col("__x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("__x"))).alias("b"))
    rate = F.element_at(F.array(*[F.lit(p / 100) for p in ps]), F.col("i") + 1) * (F.col("n").cast("double") - 1)
    share = rate - F.floor(rate)
    out = F.when((share == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + share * (F.col("b") - F.col("a")))
    p = F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("i") + 1)
    return pair.select(*[F.col(g).alias(c) for g, c in zip(groups, by)], p.alias("p"), "n", out.alias("value"))


def wide(df: DataFrame, value: str, names: dict[str, float], by: Sequence[str]) -> DataFrame:
    """by columns and a column for each of names, the percentile that it stands for. Every group of df has its row, with nulls where it has no value."""
    groups = df.select(*by).distinct()
    rows = percentiles(df, value, list(names.values()), by, few=groups.limit(FEW + 1).count() <= FEW)
    found = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n) for n, p in names.items()])
    return groups.join(found, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").select(*by, *names)


def median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return percentiles(df, value, [50.0], by)
