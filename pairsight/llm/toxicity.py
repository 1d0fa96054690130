"""Toxicity from subword bags.

Every word is a bag of hashed letter n-grams (3 to 6 bytes with word ends), a passage of
``Settings.words`` words is the mean of its n-grams' embeddings, and a linear softmax reads it;
embeddings and softmax are trained together in numpy. Misspelt words share n-grams with known
ones. A text is scored by its most toxic passage, so long texts don't dilute a few words, and the
maximum is calibrated on labelled rows that training didn't see. As labels belong to whole texts,
later rounds of training take only those passages of a toxic text that score highest.

Learning takes a bounded sample of rows, each with its whole text: of either label the rows with the
least id hashes, at most ``Settings.positives`` and ``Settings.negatives`` of them and as many as fit
``Settings.sample_bytes`` together. Prediction reads whole texts. Null or empty text: the score of an empty passage. Without labels of both kinds every score
is the share of label 1 (0 without any). Repeated rows get equal scores; only the id is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .grams import LETTERS, Passages, gram_hash, inside_word


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dims: int = 4
    orders: tuple[int, ...] = (3, 4, 5, 6)
    words: int = 4
    positives: int = 2000
    negatives: int = 3000
    #: UTF-8 bytes of the sampled rows of one label, at most; longer rows aren't sampled.
    sample_bytes: int = 6 << 20
    epochs: int = 6
    rate: float = 1.0
    decay: float = 1e-7
    batch: int = 1024
    least: int = 4


def prepared(texts: list[str | None]) -> list[bytes]:
    return [(x or "").lower().encode() for x in texts]


def bag(texts: list[bytes], s: Settings, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """n-gram buckets of passages given as texts, and where each one's begin."""
    ids, sizes = [], []
    for k in range(0, len(texts), step):
        part = texts[k : k + step]
        p = Passages(part, LETTERS, 1 << 30)
        own = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(p.at))
        keep = [np.flatnonzero(inside_word(p.data, n)) for n in s.orders]
        owner = np.concatenate([own[x] for x in keep])
        value = np.concatenate([gram_hash(p.data, n)[x] % np.uint32(s.buckets) for n, x in zip(s.orders, keep, strict=True)])
        ids.append(value[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


class Model:
    """``table``: each n-gram's pull towards label 1 (its embedding times the softmax's difference)."""

    def __init__(self, passages: list[bytes], doc: np.ndarray, label: np.ndarray, s: Settings):
        """passages: training passages; doc: their text's number; label: of each text."""
        self.s, rng = s, np.random.default_rng(11)
        ids, at = bag(passages, s)
        size = np.maximum(np.diff(at), 1)
        # n-grams of fewer than ``least`` training texts say nothing: they count as padding
        seen = np.zeros(s.buckets, np.int32)
        edges = np.searchsorted(doc, np.arange(len(label) + 1))
        for i in range(len(label)):
            seen[np.unique(ids[at[edges[i]] : at[edges[i + 1]]])] += 1
        common = seen >= s.least
        table = rng.normal(0, 0.1, (s.buckets, s.dims)).astype(np.float32) * common[:, None]
        soft = rng.normal(0, 0.3, (s.dims, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        tune = rng.random(len(label)) < 0.25
        y = label[doc]
        train = ~tune[doc]
        history = np.full(s.buckets, 1e-6, np.float32)
        for epoch in range(s.epochs):
            weight = train.astype(np.float64)
            if epoch > 1:
                z = self._logits(ids, at, size, table @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])
                top = np.full(len(label), -np.inf)
                np.maximum.at(top, doc, z)
                weight *= (y == 0) | (z >= np.minimum(top[doc], 1.0))
            pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
            weight *= np.where(y == 1, 0.5 * (pos + neg) / max(pos, 1), 0.5 * (pos + neg) / max(neg, 1))
            rows = rng.permutation(np.flatnonzero(weight > 0))
            rate = s.rate * (1 - 0.8 * epoch / s.epochs)
            for b in range(0, len(rows), s.batch):
                r = rows[b : b + s.batch]
                n = at[r + 1] - at[r]
                ends = np.cumsum(n)
                g = ids[np.repeat(at[r] - (ends - n), n) + np.arange(ends[-1])]
                owner = np.repeat(np.arange(len(r)), n)
                mean = np.stack([np.bincount(owner, table[g, k], len(r)) for k in range(s.dims)], 1) / size[r][:, None]
                logit = mean @ soft + bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(r)), y[r]] -= 1
                p *= (weight[r] / len(r))[:, None]
                back = (p @ soft.T) / size[r][:, None]
                soft -= (0.02 * (mean.T @ p)).astype(np.float32)
                bias -= (0.02 * p.sum(0)).astype(np.float32)
                known = common[g]
                unique, place = np.unique(g[known], return_inverse=True)
                grad = np.stack([np.bincount(place, back[owner[known], k], len(unique)) for k in range(s.dims)], 1) + s.decay * table[unique]
                history[unique] += (grad * grad).mean(1) * len(r)
                table[unique] -= rate * grad * np.sqrt(len(r)) / np.sqrt(history[unique])[:, None]
        table *= common[:, None]
        self.table = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        z = self._logits(ids, at, size, self.table, self.bias)
        top = np.full(len(label), -np.inf)
        np.maximum.at(top, doc, z)
        known = np.isfinite(top) & (tune if len(set(label[tune])) == 2 else np.ones(len(label), bool))
        self.scale, self.shift = _platt(top[known], label[known])

    @staticmethod
    def _logits(ids, at, size, table, bias):
        out = np.empty(len(size))
        for k in range(0, len(size), 8192):
            a = at[k : k + 8193]
            sums = np.concatenate(([0.0], np.cumsum(table[ids[a[0] : a[-1]]], dtype=np.float64)))
            out[k : k + 8192] = (sums[a[1:] - a[0]] - sums[a[:-1] - a[0]]) / size[k : k + 8192] + bias
        return out

    def predict(self, texts: list[str | None]) -> np.ndarray:
        s = self.s
        p = Passages(prepared(texts), LETTERS, s.words)
        value, count = np.zeros(len(p.data), np.float32), np.zeros(len(p.data), np.float32)
        for n in s.orders:
            keep = inside_word(p.data, n)
            value[: len(keep)] += self.table[gram_hash(p.data, n) % np.uint32(s.buckets)] * keep
            count[: len(keep)] += keep
        z = np.add.reduceat(value, p.starts, dtype=np.float64) / np.maximum(np.add.reduceat(count, p.starts), 1) + self.bias
        top = np.maximum.reduceat(z, p.first)
        return 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-dimensional logistic regression by Newton steps, with softened targets."""
    mean, sd = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - mean) / sd, np.ones(len(z))], 1)
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - target) + 1e-3 * w
        w -= np.clip(np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 1e-3 * np.eye(2), grad), -2, 2)
    return w[0] / sd, w[1] - w[0] * mean / sd


class Constant:
    def __init__(self, score: float):
        self.score = score

    def predict(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.score)


def prior_shift(labels: DataFrame, label_col: str, taken: np.ndarray) -> float:
    """What to add to a log-odds learnt on the sample, whose share of label 1 is not that of the table."""
    known = {int(r[0]): r[1] for r in labels.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}
    every = np.log((known.get(1, 0) + 0.5) / (sum(known.values()) - known.get(1, 0) + 0.5))
    return float(every - np.log(((taken == 1).sum() + 0.5) / ((taken != 1).sum() + 0.5)))


def sample_of(docs: DataFrame, labels: DataFrame, label_col: str, sizes: dict[int, int], room: int, id_col: str, text_col: str, salt: str) -> list[tuple[int, str]]:
    """(label, whole text) of labelled rows, in the order of their ids' hashes.

    Of each label the rows with the least hashes (ties by id), at most ``sizes`` and ``room`` bytes in
    all; a row that alone exceeds the room is passed over. An id with both labels takes the larger one,
    an id with several rows their greatest text.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    least = []
    for label, n in sizes.items():
        h = F.xxhash64(F.col("id").cast("string"), F.lit(salt))
        least += [(r["id"], label, k) for k, r in enumerate(known.where(F.col("label") == label).orderBy(h, "id").limit(n).collect())]
    schema = f"id {known.schema['id'].dataType.simpleString()}, label int, place int"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(spark.createDataFrame(least, schema)), "id")
    size = {(r["label"], r["place"]): r["n"] for r in rows.groupBy("label", "place").agg(F.max(F.octet_length("text")).alias("n")).collect()}
    chosen = []
    for label in sizes:
        left = room
        for k in sorted(k for x, k in size if x == label):
            n = size[label, k]
            if n > left and n <= room:
                break
            if n <= room:
                left -= n
                chosen.append((label, k))
    picked = rows.join(F.broadcast(spark.createDataFrame(chosen, "label int, place int")), ["label", "place"])
    got = picked.groupBy("label", "place").agg(F.max("text").alias("text")).collect()
    return [(r["label"], r["text"]) for r in sorted(got, key=lambda r: (r["label"], r["place"]))]


def fit_model(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> Model | Constant:
    s = settings or Settings()
    got = sample_of(docs, labels, label_col, {1: s.positives, 0: s.negatives}, s.sample_bytes, id_col, text_col, "toxicity")
    y = np.array([label for label, _ in got])
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if got else 0.0)
    bags = [passages_of(x.lower().encode(), s.words, LETTERS) for _, x in got]
    model = Model([p for ps in bags for p in ps], np.repeat(np.arange(len(got)), [len(ps) for ps in bags]), y, s)
    model.shift += prior_shift(labels, label_col, y)
    return model


def passages_of(text: bytes, words: int, table: bytes) -> list[bytes]:
    """All passages of a whole text."""
    p = Passages([text], table, words)
    body = b" " + text + b" "
    return [p.bytes_of(i, body) for i in range(len(p.starts))]


_WHITE = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))


def score(docs: DataFrame, model: Model | Constant, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score and predicted of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch):
        z = held.value.predict(batch.column(1).to_pylist())
        yield {id_col: batch.column(0), "score": z, "predicted": (z >= threshold).astype(np.int32)}

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, fn, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double, predicted int", "text")


def keep_scored(docs: DataFrame, model: Model | Constant, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows (all columns) whose whole text scores at least ``threshold``; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch):
        yield batch.filter(pa.array(held.value.predict(batch.column(at).cast(pa.string()).to_pylist()) >= threshold))

    return map_batches(docs, fn, docs.schema, text_col)
