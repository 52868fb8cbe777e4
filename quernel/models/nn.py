"""Layers, optimizers, gradient clipping and a learning-rate schedule. The optimizers also come as column expressions, for parameters kept as tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.rng import Rng
from quernel.models import tape
from quernel.models.tape import Tensor


class Linear:
    """x W + b; W from a normal distribution of sd sqrt(2 / inputs), drawn row by row."""

    def __init__(self, inputs: int, outputs: int, rng: Rng):
        self.weight = Tensor(rng.gaussians((inputs, outputs), 0.0, math.sqrt(2.0 / inputs)))
        self.bias = Tensor(np.zeros((1, outputs)))

    def forward(self, x: Tensor) -> Tensor:
        return tape.add(tape.matmul(x, self.weight), self.bias)

    def params(self) -> list[Tensor]:
        return [self.weight, self.bias]


class SGD:
    def __init__(self, params: Sequence[Tensor], lr: float):
        self.params, self.lr = list(params), lr

    def zero_grad(self) -> None:
        for p in self.params:
            p.zero_grad()

    def step(self) -> None:
        for p in self.params:
            p.value -= self.lr * p.grad


class Adam:
    """With decoupled weight decay."""

    def __init__(self, params: Sequence[Tensor], lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, weight_decay: float = 0.0):
        self.params, self.lr, self.beta1, self.beta2, self.eps, self.weight_decay = list(params), lr, beta1, beta2, eps, weight_decay
        self.m = [np.zeros_like(p.value) for p in self.params]
        self.v = [np.zeros_like(p.value) for p in self.params]
        self.t = 0

    def zero_grad(self) -> None:
        for p in self.params:
            p.zero_grad()

    def set_lr(self, lr: float) -> None:
        self.lr = lr

    def step(self) -> None:
        self.t += 1
        a, b = 1 - self.beta1**self.t, 1 - self.beta2**self.t
        for p, m, v in zip(self.params, self.m, self.v):
            m += (1 - self.beta1) * (p.grad - m)
            v += (1 - self.beta2) * (p.grad**2 - v)
            p.value -= self.lr * (m / a / (np.sqrt(v / b) + self.eps) + self.weight_decay * p.value)


def clip_grad_norm(params: Sequence[Tensor], most: float) -> float:
    """Scales all gradients so that their common norm is most; returns what it was."""
    norm = math.sqrt(sum(float((p.grad**2).sum()) for p in params))
    if norm > most:
        for p in params:
            p.grad *= most / (norm + 1e-6)
    return norm


def cosine_lr(step: int, total: int, base: float, warmup: int) -> float:
    """Linear to base over the warm-up, then half a cosine down to a tenth of it."""
    if step < warmup:
        return base * step / max(1, warmup)
    p = min(1.0, (step - warmup) / max(1, total - warmup))
    return base * (0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * p)))


def cosine_lr_column(step: Column, total: int, base: float, warmup: int) -> Column:
    p = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, F.lit(base) * step / max(1, warmup)).otherwise(F.lit(base) * (F.lit(0.1) + F.lit(0.45) * (1 + F.cos(F.lit(math.pi) * p))))


def sgd_column(w: Column, g: Column, lr: float) -> Column:
    return w - lr * g


def adam_columns(w: Column, g: Column, m: Column, v: Column, t: int, lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, weight_decay: float = 0.0) -> tuple[Column, Column, Column]:
    """w, m, v after step t."""
    m2, v2 = m * beta1 + g * (1 - beta1), v * beta2 + g * g * (1 - beta2)
    return w - lr * (m2 / (1 - beta1**t) / (F.sqrt(v2 / (1 - beta2**t)) + eps) + weight_decay * w), m2, v2
