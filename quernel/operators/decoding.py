"""Choosing a next token from logits: temperature, top-k with top-p, inverse-CDF draws.

The relational forms work on any number of rows at once: windows are per row of logits, never over the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.neural import softmax
from quernel.functions.rng import Rng


@dataclass(frozen=True)
class SampleConfig:
    temperature: float = 1.0
    #: 0: all
    top_k: int = 0
    top_p: float = 1.0


def token_probabilities(df: DataFrame, logits: str, key: str, temperature: float = 1.0) -> DataFrame:
    """(key, token int, p double)"""
    return df.select(key, F.posexplode(softmax(logits, temperature)).alias("token", "p"))


def filtered(probabilities: DataFrame, key: str, top_k: int = 0, top_p: float = 1.0) -> DataFrame:
    """(key, token, rank, p): the most probable tokens, down to top_k or until those kept reach top_p, one at least; p is renormalised. Equal ones by token."""
    by = Window.partitionBy(key).orderBy(F.desc("p"), "token")
    ranked = probabilities.withColumn("rank", F.row_number().over(by)).withColumn("before", F.coalesce(F.sum("p").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    kept = ranked.where((F.lit(top_k <= 0) | (F.col("rank") <= top_k)) & (F.lit(top_p >= 1) | (F.col("rank") == 1) | (F.col("before") < top_p)))
    return kept.select(key, "token", "rank", (F.col("p") / F.sum("p").over(Window.partitionBy(key))).alias("p"))


def draw(kept: DataFrame, key: str, u: DataFrame) -> DataFrame:
    """kept (key, token, rank, p), u (key, u, last) -> (key, token): the first, in the order of token, whose running sum reaches u; last, the vocabulary's last
    token, if rounding leaves none. A token that isn't kept has p = 0, so a u of 0 takes token 0."""
    run = F.sum("p").over(Window.partitionBy(key).orderBy("token").rowsBetween(Window.unboundedPreceding, 0))
    reached = kept.withColumn("cdf", run).join(u.select(key, "u", "last"), key)
    first = F.coalesce(F.min(F.when(F.col("cdf") >= F.col("u"), F.col("token"))), F.max("last"))
    return reached.groupBy(key).agg(F.when(F.max("u") <= 0, 0).otherwise(first).alias("token"))


def sample(df: DataFrame, logits: str, key: str, config: SampleConfig, u: DataFrame) -> DataFrame:
    """u (key, u) -> (key, token)"""
    last = u.join(df.select(key, (F.size(logits) - 1).alias("last")), key)
    return draw(filtered(token_probabilities(df, logits, key, config.temperature), key, config.top_k, config.top_p), key, last)


def sample_one(logits: np.ndarray, config: SampleConfig, rng: Rng) -> int:
    """The same for one row, as a kernel."""
    x = np.asarray(logits, np.float64)
    p = np.exp((x - x.max()) / (config.temperature if config.temperature > 0 else 1e-6))
    p /= p.sum()
    order = np.lexsort((np.arange(len(p)), -p))
    before = np.concatenate(([0.0], np.cumsum(p[order])[:-1]))
    keep = np.ones(len(p), bool)
    if config.top_k > 0:
        keep &= np.arange(len(p)) < config.top_k
    if config.top_p < 1:
        keep &= before < config.top_p
    keep[0] = True
    p[order[~keep]] = 0.0
    # running sums by token, as they are drawn
    return min(int(np.searchsorted(np.cumsum(p / p.sum()), rng.uniform())), len(p) - 1)
