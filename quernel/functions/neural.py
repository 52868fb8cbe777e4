"""Neural-network operations on array<double> columns, as higher-order functions: no Python, no shuffle.

linear() with a weight of more than a few cells takes Arrow batches, through Mat.times().
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: keeps the logarithm of a probability of 0 finite.
LOG_EPS = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_of(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def relu(v: Column | str) -> Column:
    return F.transform(_c(v), lambda x: F.greatest(x, F.lit(0.0)))


def scale(v: Column | str, s: float) -> Column:
    return F.transform(_c(v), lambda x: x * float(s))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def exponentials(v: Column | str, temperature: float = 1.0) -> Column:
    """exp((x - max) / temperature); a temperature of 0 or less counts as 1e-6."""
    c, t = _c(v), temperature if temperature > 0 else 1e-6
    # the largest is bound first: a lambda works its free expressions out again at each call
    bound = F.array(F.struct(c.alias("v"), F.array_max(c).alias("m")))
    return F.flatten(F.transform(bound, lambda b: F.transform(b["v"], lambda x: F.exp((x - b["m"]) / t))))


def softmax(v: Column | str, temperature: float = 1.0) -> Column:
    e = exponentials(v, temperature)
    # both in one fold, so that the exponentials are worked out once
    state = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(F.array(e), state, lambda s, x: F.struct(total(x).alias("sum"), x.alias("all")), lambda s: F.transform(s["all"], lambda x: x / s["sum"]))


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """Of one row; the mean is an aggregate."""
    return -F.ln(F.element_at(softmax(logits), _c(label).cast("int") + 1) + LOG_EPS)


def cross_entropy_grad(logits: Column | str, label: Column | str, n: float = 1.0) -> Column:
    """By the logits: (p - onehot) / n."""
    return F.transform(softmax(logits), lambda p, i: (p - F.when(i == _c(label).cast("int"), 1.0).otherwise(0.0)) / n)


def layernorm(v: Column | str, gamma: Column | None = None, beta: Column | None = None, eps: float = 1e-5) -> Column:
    c = _c(v)
    n = F.size(c)

    def normed(x: Column) -> Column:
        mean = total(x) / n
        spread = lambda m: F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - m) * (y - m)) / n
        one = F.transform(F.array(mean), lambda m: F.struct(m.alias("m"), F.sqrt(spread(m) + eps).alias("d")))
        return F.flatten(F.transform(one, lambda p: F.transform(x, lambda y: (y - p["m"]) / p["d"])))

    out = normed(c)
    if gamma is not None:
        out = F.zip_with(out, gamma, lambda x, g: x * g)
    return out if beta is None else F.zip_with(out, beta, lambda x, b: x + b)


def slice_cols(v: Column | str, start: int, width: int) -> Column:
    return F.slice(_c(v), start + 1, width)


def concat_cols(*parts: Column | str) -> Column:
    return F.concat(*map(_c, parts))


def argmax(v: Column | str) -> Column:
    """The first largest."""
    return (F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("int")


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def dot(v: Column | str, w: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(_c(v), array_of(w), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(v: Column | str, weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """x W + b for a weight of a few cells, which become literals."""
    return F.array(*[dot(v, [row[j] for row in weight]) + float(bias[j]) for j in range(len(bias))])


#: Coefficients of rational approximations of erf(x) / x in x², of exp(x²) erfc(x) in x, and of x exp(x²) erfc(x) in 1 / x², numerator then denominator, highest power first (W. J. Cody, 1969).
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERF_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERF_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
#: Where the first ends, and where the last begins.
ERF_EDGES = (0.46875, 4.0)


def _ratio(x, table):
    """A ratio of polynomials, by columns or by arrays."""
    above, below = (reduce(lambda s, c: s * x + c, rest, first) for first, *rest in table)
    return above / below


def erf(x: Column) -> Column:
    """Within 4e-16 of the error function; null stays null, nan stays nan."""
    a = F.abs(x)
    near = x * _ratio(x * x, ERF_NEAR)
    # both tails, with arguments that their branch uses; elsewhere their values go unused
    middle = F.exp(-a * a) * _ratio(a, ERF_MIDDLE)
    inverse = F.lit(1.0) / (a * a)
    far = F.exp(-a * a) / a * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, ERF_FAR))
    tail = F.when(a <= ERF_EDGES[1], middle).when(a < 27.0, far).otherwise(0.0)
    return F.when(x.isNull() | F.isnan(x), x).when(a <= ERF_EDGES[0], near).when(x > 0, 1.0 - tail).otherwise(tail - 1.0)


def erf_array(x: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    a = np.abs(x)
    out = np.zeros_like(a)
    near, far = a <= ERF_EDGES[0], a > ERF_EDGES[1]
    middle = ~near & ~far
    out[near] = a[near] * _ratio(a[near] ** 2, ERF_NEAR)
    out[middle] = 1 - np.exp(-(a[middle] ** 2)) * _ratio(a[middle], ERF_MIDDLE)
    z = np.minimum(a[far], 27.0)
    inverse = 1 / z**2
    out[far] = 1 - np.exp(-(z**2)) / z * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, ERF_FAR))
    return np.where(np.isnan(x), x, np.copysign(out, x))


def gelu(v: Column | str) -> Column:
    """x (1 + erf(x / sqrt 2)) / 2, exact, in Spark's own expressions."""
    return F.transform(_c(v), lambda x: 0.5 * x * (1.0 + erf(x / math.sqrt(2.0))))


def embedding(tokens: DataFrame, table: DataFrame, token_id: str = "token_id") -> DataFrame:
    """tokens (…, token_id) with their row of table (token_id, v); Spark broadcasts the table where its size allows."""
    return tokens.join(table, token_id)


def embedding_grad(grads: DataFrame, token_id: str = "token_id") -> DataFrame:
    """(token_id, g array) summed by token: (token_id, j, g)."""
    return grads.select(token_id, F.posexplode("g").alias("j", "g")).groupBy(token_id, "j").agg(F.sum("g").alias("g"))


def causal_attention(cells: DataFrame, dim: int) -> DataFrame:
    """One head with q = k = v: cells (seq, i, d, v) -> (seq, i, d, v). Row i attends to rows j <= i of its sequence."""
    from pyspark.sql import Window

    q = cells.select("seq", "i", "d", F.col("v").alias("q"))
    k = cells.select("seq", F.col("i").alias("j"), "d", F.col("v").alias("k"))
    scores = q.join(k, ["seq", "d"]).where("j <= i").groupBy("seq", "i", "j").agg((F.sum(F.col("q") * F.col("k")) / math.sqrt(dim)).alias("s"))
    row = Window.partitionBy("seq", "i")
    e = scores.withColumn("e", F.exp(F.col("s") - F.max("s").over(row)))
    p = e.select("seq", "i", "j", (F.col("e") / F.sum("e").over(row)).alias("p"))
    return p.join(k, ["seq", "j"]).groupBy("seq", "i", "d").agg(F.sum(F.col("p") * F.col("k")).alias("v"))
