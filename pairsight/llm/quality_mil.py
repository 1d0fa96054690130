"""Quality by attention over passages (multiple-instance learning).

A text is a bag of passages of ``Settings.words`` words. Each passage is encoded (hashed n-grams
of letters and of character classes, shares of repeated words, then one tanh layer), a gated attention (tanh gate times
sigmoid gate) weighs the passages, and a logistic unit reads the weighted sum. All weights are
learnt in numpy from labels of whole texts, on a bounded sample of rows with all their passages: of
either label the rows with the least id hashes, at most ``Settings.each`` and as many as fit
``Settings.sample_bytes`` together. Prediction reads every passage of whole texts.

Null or empty text: one empty passage. Without labels of both kinds every score is the share of
label 1 (0 without any). Repeated rows get equal scores; only the id is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import LETTERS, SHAPE, Passages
from .toxicity import _WHITE, Constant, passages_of, prior_shift, sample_of


@dataclass(frozen=True)
class Settings:
    words: int = 64
    dims: int = 512
    hidden: int = 24
    gate: int = 12
    each: int = 1500
    #: UTF-8 bytes of the sampled rows of one label, at most; longer rows aren't sampled.
    sample_bytes: int = 5 << 20
    epochs: int = 12
    rate: float = 0.01
    decay: float = 1e-4


def encode(texts: list[bytes], s: Settings, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage (unit length halves: classes and letters), and each text's first row."""
    shape = Passages(texts, _WHITE, size)
    flat = b" " + b" ".join(texts) + b" "
    cut = [shape.bytes_of(i, flat) for i in range(len(shape.starts))]
    data = b"".join(cut)
    parts = []
    for table, orders, whole in ((SHAPE, (1, 2, 3), False), (LETTERS, (3,), True)):
        p = Passages.__new__(Passages)
        p.data = np.frombuffer(data.translate(table), np.uint8)
        p.starts = np.concatenate(([0], np.cumsum([len(x) for x in cut])[:-1])).astype(np.int64) if cut else np.zeros(0, np.int64)
        x = np.sqrt(p.counts(orders, s.dims, whole))
        parts.append(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9))
    parts.append(np.array([repetition(c) for c in cut], np.float32).reshape(-1, 2))
    return np.hstack(parts), shape.first


def repetition(passage: bytes) -> tuple[float, float]:
    """Share of words equal to the one before, and share of words seen before in the passage."""
    words = passage.split()
    n = len(words)
    if n < 2:
        return 0.0, 0.0
    return sum(map(eq, words, words[1:])) / (n - 1), 1 - len(set(words)) / n


class Model:
    def __init__(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, s: Settings):
        self.s, rng = s, np.random.default_rng(5)
        d = x.shape[1]
        self.w = {
            "w1": rng.normal(0, 0.5, (d, s.hidden)), "b1": np.zeros(s.hidden), "v": rng.normal(0, 0.3, (s.hidden, s.gate)), "u": rng.normal(0, 0.3, (s.hidden, s.gate)),
            "a": rng.normal(0, 0.3, s.gate), "out": rng.normal(0, 0.3, s.hidden), "bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        q = {k: np.zeros_like(v) for k, v in self.w.items()}
        ends = np.append(first[1:], len(x))
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
        step = 0
        for epoch in range(s.epochs):
            order = rng.permutation(len(y))
            for b in range(0, len(order), 64):
                r = order[b : b + 64]
                n = ends[r] - first[r]
                rows = np.concatenate([np.arange(first[i], ends[i]) for i in r])
                grad = self._gradient(x[rows], np.concatenate(([0], np.cumsum(n)[:-1])), n, y[r], weight[r])
                step += 1
                for k, g in grad.items():
                    g = g + s.decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    q[k] = 0.999 * q[k] + 0.001 * g * g
                    self.w[k] -= (s.rate * (1 - 0.9 * epoch / s.epochs)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-7)

    def _forward(self, x, first, n):
        w = self.w
        h = np.tanh(x @ w["w1"] + w["b1"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-h @ w["u"]))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        att = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(h * att[:, None], first)
        return h, t, g, att, z, z @ w["out"] + w["bias"][0]

    def _gradient(self, x, first, n, y, weight):
        w = self.w
        h, t, g, att, z, logit = self._forward(x, first, n)
        d = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
        dz = np.repeat(d, n)[:, None] * w["out"]
        datt = (dz * h).sum(1)
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, first), n))
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh = dz * att[:, None] + dt @ w["v"].T + dg @ w["u"].T
        dh *= 1 - h * h
        return {"w1": x.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": ((t * g) * de[:, None]).sum(0), "out": z.T @ d, "bias": np.array([d.sum()])}

    def predict(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode() for t in texts]
        x, first = encode(raw, self.s, self.s.words)
        n = np.diff(np.append(first, len(x)))
        return 1 / (1 + np.exp(-np.clip(self._forward(x, first, n)[-1].astype(np.float64), -30, 30)))


def fit_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> Model | Constant:
    s = settings or Settings()
    got = sample_of(docs, labels, label_col, {0: s.each, 1: s.each}, s.sample_bytes, id_col, text_col, "quality")
    if len({label for label, _ in got}) < 2:
        return Constant(float(np.mean([label for label, _ in got])) if got else 0.0)
    rng = np.random.default_rng(3)
    bags = [(label, passages_of(x.encode(), s.words, _WHITE)) for label, x in got]
    # short texts are rare among long passages: the first few words of one passage serve as a text too
    bags += [(label, [b" ".join(ps[rng.integers(len(ps))].split()[: rng.integers(1, 16)])]) for label, ps in bags]
    flat = [p for _, ps in bags for p in ps]
    x = np.concatenate([encode(flat[i : i + 1024], s, 1 << 30)[0] for i in range(0, len(flat), 1024)])
    first = np.concatenate(([0], np.cumsum([len(ps) for _, ps in bags])[:-1]))
    y = np.array([label for label, _ in bags])
    model = Model(x, first, y, s)
    model.w["bias"] += np.float32(prior_shift(labels, label_col, np.array([0, 1])))
    return model
