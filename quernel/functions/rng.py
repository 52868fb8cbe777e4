"""A reproducible random stream: xorshift64* and what is drawn from it.

The state's steps are linear over the bits, so a stream can be entered at any draw, by powers of the step's 64 by 64 bit matrix. quernel.functions.streams
attaches its draws to the rows of tables.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The seed that stands for 0, and the output multiplier.
DEFAULT_SEED = 0x9E3779B97F4A7C15
MULTIPLIER = 0x2545F4914F6CDD1D
MASK = (1 << 64) - 1
#: Fixed value: uniforms that aren't above this are drawn again before a logarithm.
TINY = 1e-12


def advance(state: int) -> int:
    state ^= state >> 12
    state ^= state << 25 & MASK
    return state ^ state >> 27


class Rng:
    def __init__(self, seed: int = DEFAULT_SEED):
        self.state = seed & MASK or DEFAULT_SEED
        self.spare: float | None = None

    def next_u64(self) -> int:
        self.state = advance(self.state)
        return self.state * MULTIPLIER & MASK

    def uniform(self, a: float = 0.0, b: float = 1.0) -> float:
        u = (self.next_u64() >> 11) * 2.0**-53
        return u if (a, b) == (0.0, 1.0) else a + (b - a) * u

    def _positive(self) -> float:
        while (u := self.uniform()) <= TINY:
            pass
        return u

    def gaussian(self, mean: float = 0.0, sd: float = 1.0) -> float:
        """Box-Muller. Values come in pairs; the second, in standard form, waits for the next call."""
        if self.spare is not None:
            z, self.spare = self.spare, None
        else:
            radius, angle = math.sqrt(-2.0 * math.log(self._positive())), 2.0 * math.pi * self.uniform()
            z, self.spare = radius * math.cos(angle), radius * math.sin(angle)
        return mean + sd * z

    def exponential(self, rate: float = 1.0) -> float:
        return -math.log(self._positive()) / rate

    def bernoulli(self, p: float) -> int:
        return int(self.uniform() < p)

    def poisson(self, rate: float) -> int:
        """Counts factors of a product of uniforms that stays above exp(-rate); for rates under about 745."""
        limit, k, product = math.exp(-rate), 0, self.uniform()
        while product > limit:
            k += 1
            product *= self.uniform()
        return k

    def gaussians(self, shape: tuple[int, ...], mean: float = 0.0, sd: float = 1.0) -> np.ndarray:
        return np.array([self.gaussian(mean, sd) for _ in range(math.prod(shape))]).reshape(shape)


def step_matrix() -> list[int]:
    """Column b: the state after bit b alone."""
    return [advance(1 << b) for b in range(64)]


def apply(matrix: list[int], state: int) -> int:
    out, b = 0, 0
    while state:
        if state & 1:
            out ^= matrix[b]
        state >>= 1
        b += 1
    return out


def jump(state: int, steps: int) -> int:
    """The state after so many steps, by repeated squaring."""
    matrix = step_matrix()
    while steps:
        if steps & 1:
            state = apply(matrix, state)
        matrix = [apply(matrix, c) for c in matrix]
        steps >>= 1
    return state


def fast_uniform(df: DataFrame, seed: int, out: str = "u") -> DataFrame:
    """Where the exact stream isn't needed: Spark's own generator, in every partition at once."""
    return df.withColumn(out, F.rand(seed))
