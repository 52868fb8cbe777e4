"""A perceptron with one hidden layer, and a small decoder-only Transformer over token ids."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from quernel.functions.rng import Rng
from quernel.models import tape
from quernel.models.nn import Linear
from quernel.models.tape import Tensor

#: Fixed value: what a later position's score is lowered by.
MASKED = -1e9


class MLP:
    def __init__(self, inputs: int, hidden: int, outputs: int, rng: Rng):
        self.first, self.second = Linear(inputs, hidden, rng), Linear(hidden, outputs, rng)

    def forward(self, x: Tensor) -> Tensor:
        return self.second.forward(tape.relu(self.first.forward(x)))

    def params(self) -> list[Tensor]:
        return self.first.params() + self.second.params()


@dataclass(frozen=True)
class GPTConfig:
    vocab_size: int
    n_embd: int = 128
    n_head: int = 4
    n_layer: int = 3
    block_size: int = 64


class GPT:
    """Token and position embeddings, pre-norm blocks of causal attention and a GELU layer of four times the width, a final norm and a head."""

    def __init__(self, config: GPTConfig, rng: Rng):
        if config.n_head <= 0 or config.n_embd % config.n_head:
            raise ValueError("the width must be a multiple of the number of heads")
        self.config, e = config, config.n_embd
        weight = lambda r, c: Tensor(rng.gaussians((r, c), 0.0, 0.02))
        zeros, ones = (lambda c: Tensor(np.zeros((1, c)))), (lambda c: Tensor(np.ones((1, c))))
        self.names: dict[str, Tensor] = {"tok": weight(config.vocab_size, e), "pos": weight(config.block_size, e)}
        for k in range(config.n_layer):
            block = {"q": weight(e, e), "k": weight(e, e), "v": weight(e, e), "o": weight(e, e), "fc": weight(e, 4 * e), "proj": weight(4 * e, e)}
            block |= {f"{x}_b": zeros(e) for x in "qkvo"} | {"fc_b": zeros(4 * e), "proj_b": zeros(e)}
            block |= {"ln1_g": ones(e), "ln1_b": zeros(e), "ln2_g": ones(e), "ln2_b": zeros(e)}
            self.names |= {f"h{k}.{n}": t for n, t in block.items()}
        self.names |= {"lnf_g": ones(e), "lnf_b": zeros(e), "head": weight(e, config.vocab_size), "head_b": zeros(config.vocab_size)}

    def params(self) -> list[Tensor]:
        return list(self.names.values())

    def load(self, values: dict[str, np.ndarray]) -> GPT:
        for n, v in values.items():
            self.names[n].value[...] = v
        return self

    def state(self) -> dict[str, np.ndarray]:
        return {n: t.value for n, t in self.names.items()}

    def _affine(self, x: Tensor, name: str) -> Tensor:
        return tape.add(tape.matmul(x, self.names[name]), self.names[f"{name}_b"])

    def _block(self, x: Tensor, at: str, mask: Tensor) -> Tensor:
        p, width = self.names, self.config.n_embd // self.config.n_head
        h = tape.layernorm(x, p[f"{at}.ln1_g"], p[f"{at}.ln1_b"])
        q, k, v = (self._affine(h, f"{at}.{n}") for n in "qkv")
        heads = []
        for c in range(0, self.config.n_embd, width):
            part = lambda t: tape.slice_cols(t, c, width)  # noqa: E731, B023
            scores = tape.mul(tape.matmul(part(q), tape.transpose(part(k))), 1 / math.sqrt(width))
            heads.append(tape.matmul(tape.softmax_rows(tape.add(scores, mask)), part(v)))
        x = tape.add(x, self._affine(tape.concat_cols(heads), f"{at}.o"))
        h = tape.layernorm(x, p[f"{at}.ln2_g"], p[f"{at}.ln2_b"])
        return tape.add(x, self._affine(tape.gelu(self._affine(h, f"{at}.fc")), f"{at}.proj"))

    def forward(self, ids) -> Tensor:
        """Logits of each position."""
        n = len(ids)
        if not 0 < n <= self.config.block_size:
            raise ValueError(f"a sequence has 1 to {self.config.block_size} ids")
        x = tape.add(tape.embedding(self.names["tok"], ids), tape.embedding(self.names["pos"], range(n)))
        mask = Tensor(np.triu(np.full((n, n), MASKED), 1))
        for k in range(self.config.n_layer):
            x = self._block(x, f"h{k}", mask)
        x = tape.layernorm(x, self.names["lnf_g"], self.names["lnf_b"])
        return tape.add(tape.matmul(x, self.names["head"]), self.names["head_b"])

    def loss(self, x, y) -> Tensor:
        return tape.cross_entropy(self.forward(x), y)
