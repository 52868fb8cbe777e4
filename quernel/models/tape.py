"""Reverse-mode differentiation over NumPy arrays, for kernels that run in executor tasks.

An operation returns a Tensor that knows its inputs and how a gradient flows back to them. User operations are made the same way, with op().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from quernel.functions.neural import erf_array

LOG_EPS = 1e-12


class Tensor:
    def __init__(self, value, inputs: Sequence[Tensor] = (), back: Callable[[np.ndarray], Sequence[np.ndarray | None]] | None = None):
        self.value = np.atleast_2d(np.asarray(value, np.float64))
        self.grad = np.zeros_like(self.value)
        self.inputs, self.back = tuple(inputs), back

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def zero_grad(self) -> None:
        self.grad[...] = 0

    def backward(self) -> None:
        """From a 1 x 1 result; gradients add up in the leaves. No recursion, so graphs may be deep."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            node, done = todo.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                todo.append((node, True))
                todo += [(x, False) for x in node.inputs]
        self.grad[0, 0] = 1
        for node in reversed(order):
            if node.back is not None:
                for x, g in zip(node.inputs, node.back(node.grad)):
                    if g is not None:
                        x.grad += g


def op(value: np.ndarray, inputs: Sequence[Tensor], back: Callable) -> Tensor:
    return Tensor(value, inputs, back)


def matmul(a: Tensor, b: Tensor) -> Tensor:
    if a.shape[1] != b.shape[0]:
        raise ValueError("inner dimensions differ")
    return op(a.value @ b.value, (a, b), lambda g: (g @ b.value.T, a.value.T @ g))


def add(a: Tensor, b: Tensor) -> Tensor:
    """b may be one row, which is then added to each row of a."""
    spread = b.shape[0] == 1 and a.shape[0] != 1
    if a.shape[1] != b.shape[1] or not (spread or a.shape == b.shape):
        raise ValueError("shapes differ")
    return op(a.value + b.value, (a, b), lambda g: (g, g.sum(0, keepdims=True) if spread else g))


def mul(a: Tensor, s: float) -> Tensor:
    return op(a.value * s, (a,), lambda g: (g * s,))


def transpose(a: Tensor) -> Tensor:
    return op(a.value.T, (a,), lambda g: (g.T,))


def relu(a: Tensor) -> Tensor:
    return op(np.maximum(a.value, 0), (a,), lambda g: (g * (a.value > 0),))


def gelu(a: Tensor) -> Tensor:
    x = a.value
    cdf = 0.5 * (1 + erf_array(x / math.sqrt(2)))
    pdf = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return op(x * cdf, (a,), lambda g: (g * (cdf + x * pdf),))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def softmax_rows(a: Tensor) -> Tensor:
    p = _softmax(a.value)
    return op(p, (a,), lambda g: (p * (g - (g * p).sum(1, keepdims=True)),))


def cross_entropy(logits: Tensor, labels: Sequence[int]) -> Tensor:
    """The mean over rows, 1 x 1."""
    y = np.asarray(labels, np.int64)
    n, width = logits.shape
    if len(y) != n or (n and not (0 <= y.min() and y.max() < width)):
        raise ValueError("labels don't fit the logits")
    p = _softmax(logits.value)
    loss = -np.log(p[np.arange(n), y] + LOG_EPS).mean()
    onehot = np.eye(width)[y]
    return op(np.array([[loss]]), (logits,), lambda g: ((p - onehot) * (g[0, 0] / n),))


def layernorm(x: Tensor, gamma: Tensor, beta: Tensor, eps: float = 1e-5) -> Tensor:
    mean = x.value.mean(1, keepdims=True)
    inverse = 1 / np.sqrt(x.value.var(1, keepdims=True) + eps)
    hat = (x.value - mean) * inverse

    def back(g: np.ndarray):
        h = g * gamma.value
        dx = inverse * (h - h.mean(1, keepdims=True) - hat * (h * hat).mean(1, keepdims=True))
        return dx, (g * hat).sum(0, keepdims=True), g.sum(0, keepdims=True)

    return op(hat * gamma.value + beta.value, (x, gamma, beta), back)


def embedding(table: Tensor, ids: Sequence[int]) -> Tensor:
    i = np.asarray(ids, np.int64)
    if len(i) and not (0 <= i.min() and i.max() < table.shape[0]):
        raise IndexError("an id outside of the table")

    def back(g: np.ndarray):
        d = np.zeros_like(table.value)
        np.add.at(d, i, g)
        return (d,)

    return op(table.value[i], (table,), back)


def slice_cols(a: Tensor, start: int, width: int) -> Tensor:
    if start < 0 or width < 0 or start + width > a.shape[1]:
        raise IndexError("columns outside of the matrix")

    def back(g: np.ndarray):
        d = np.zeros_like(a.value)
        d[:, start : start + width] = g
        return (d,)

    return op(a.value[:, start : start + width], (a,), back)


def concat_cols(parts: Sequence[Tensor]) -> Tensor:
    ends = np.cumsum([p.shape[1] for p in parts])[:-1]
    return op(np.concatenate([p.value for p in parts], 1), parts, lambda g: np.split(g, ends, 1))
