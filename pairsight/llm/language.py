"""Hierarchical language identification.

First the language family, by one linear machine per family (one against the rest); then, within
the family, a linear support vector machine for every pair of its languages, which vote. All
machines read square roots of hashed letter n-gram counts, scaled to length one, and are trained
in numpy by dual coordinate descent on a bounded sample: ``Settings.sample`` rows per language (fewer
if there are so many languages that ``Settings.rows`` in all would be exceeded, but one at least), in
the order of a hash of the id.

Null text, or text without letters: ``und`` with score 0. Languages without a known family form
a family of their own. With no labelled row at all everything is ``und``; with one language that
one is predicted. Ties go to the first language in alphabetical order. Repeated rows get equal
predictions; only the id column is kept, so other columns can't clash. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches
from .grams import LETTERS, gram_hash, inside_word, joined

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"other:{lang}")


@dataclass(frozen=True)
class Settings:
    dims: int = 4096
    orders: tuple[int, ...] = (1, 2, 3)
    sample: int = 1200
    #: Sampled rows of all languages together.
    rows: int = 20_000
    cost: float = 10.0
    passes: int = 12


#: Rows of features that are held at once.
ROWS = 256


def features(texts: list[bytes], s: Settings) -> np.ndarray:
    """Rows of unit length: square roots of hashed n-gram counts of lower-cased whole texts."""
    data, at = joined(texts, LETTERS)
    counts = np.zeros(len(texts) * s.dims)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * s.dims, np.diff(at))
    row = np.append(row, row[-1:])
    for n in s.orders:
        h = (gram_hash(data, n) % np.uint32(s.dims)).astype(np.int64)
        keep = inside_word(data, n)
        counts += np.bincount((row[: len(h)] + h)[keep], minlength=len(counts))
    x = np.sqrt(counts).reshape(len(texts), s.dims).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


class Sparse:
    """Rows of features as the places and values of what isn't zero, with a last column of ones."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], dims: int):
        self.dims = dims
        self.at = [np.append(i.astype(np.int32), np.int32(dims)) for i, _ in rows]
        self.value = [np.append(v.astype(np.float32), np.float32(1)) for _, v in rows]

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        return cls([(np.flatnonzero(row), row[row != 0]) for row in x], x.shape[1])

    def take(self, rows: np.ndarray) -> Sparse:
        out = Sparse([], self.dims)
        out.at, out.value = [self.at[i] for i in rows], [self.value[i] for i in rows]
        return out


def train_svm(x: Sparse, y: np.ndarray, cost: float, passes: int) -> np.ndarray:
    """L2-regularised squared-hinge machine by dual coordinate descent; the bias is the last weight."""
    rng = np.random.default_rng(7)
    w, alpha = np.zeros(x.dims + 1, np.float32), [0.0] * len(y)
    sign, half = y.tolist(), 0.5 / cost
    diag = [float(v @ v) + half for v in x.value]
    for _ in range(passes):
        for i in rng.permutation(len(y)).tolist():
            at, v = x.at[i], x.value[i]
            g = sign[i] * float(w[at] @ v) - 1 + alpha[i] * half
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w[at] += np.float32((new - alpha[i]) * sign[i]) * v
                alpha[i] = new
    return w


def _prepared(texts: list[str | None]) -> list[bytes]:
    return [(x or "").lower().encode() for x in texts]


class Model:
    def __init__(self, x: Sparse, labels: list[str], s: Settings):
        self.s, self.langs = s, sorted(set(labels))
        fam = np.array([family_of(x) for x in labels])
        self.families = sorted(set(fam))
        self.members = {f: [i for i, lang in enumerate(self.langs) if family_of(lang) == f] for f in self.families}
        y = np.array([self.langs.index(v) for v in labels])
        fit = lambda rows, sign: train_svm(x.take(rows), sign, s.cost, s.passes)
        every = np.arange(len(y))
        self.top = np.stack([fit(every, np.where(fam == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = []
        for f in self.families:
            ids = self.members[f]
            for n, a in enumerate(ids):
                for b in ids[n + 1 :]:
                    rows = np.flatnonzero((y == a) | (y == b))
                    self.pairs.append((f, a, b, fit(rows, np.where(y[rows] == a, 1.0, -1.0))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts = [self._predict(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
        return [lang for langs, _ in parts for lang in langs], np.concatenate([np.zeros(0), *(score for _, score in parts)])

    def _predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x = features(_prepared(texts), self.s)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        sure = np.ones((len(x), len(self.families)))
        if self.top is not None:
            z = np.exp(3 * np.clip(x @ self.top.T, -8, 8).astype(np.float64))
            sure = z / z.sum(1, keepdims=True)
        best = sure.argmax(1)
        votes, share = np.zeros((len(x), len(self.langs))), np.ones((len(x), len(self.langs)))
        for f, a, b, w in self.pairs:
            p = 1 / (1 + np.exp(-3 * np.clip((x @ w).astype(np.float64), -8, 8)))
            votes[:, a] += (p >= 0.5) + p * 1e-3
            votes[:, b] += (p < 0.5) + (1 - p) * 1e-3
            share[:, a] = np.minimum(share[:, a], p)
            share[:, b] = np.minimum(share[:, b], 1 - p)
        mine = np.stack([np.isin(np.arange(len(self.langs)), self.members[f]) for f in self.families])
        pick = np.where(mine[best], votes, -1).argmax(1)
        rows = np.arange(len(x))
        score = np.clip(sure[rows, best] * share[rows, pick], 0, 1)
        lang = [self.langs[i] for i in pick]
        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t):
                lang[i], score[i] = "und", 0.0
        return lang, score


def fit_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", settings: Settings | None = None) -> Model | None:
    """Learn from a bounded sample: of each language the rows with the least id hashes.

    One scan of narrow columns finds them; each task keeps its own least rows of a language before
    they are shuffled. Features are computed on the executors and come sparse, so what reaches the
    driver doesn't depend on the texts' lengths. Rows of one id are one row (the greatest text).
    """
    s = settings or Settings()
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return None
    h = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("language"))
    order = Window.partitionBy("lang").orderBy("h", "id")
    ranked = rows.select("id", "lang", h.alias("h")).withColumn("rank", F.row_number().over(order))
    most = max(1, min(s.sample, s.rows // n_langs))
    picked = ranked.where(F.col("rank") <= most).select("id", "lang").distinct()
    ids = spark.createDataFrame(picked.collect(), picked.schema)  # at most max(rows, languages)
    chosen = rows.join(F.broadcast(ids), rows["id"].eqNullSafe(ids["id"]) & (rows["lang"] == ids["lang"]), "left_semi")
    chosen = chosen.groupBy("id", "lang").agg(F.max("text").alias("text")).select("text", "lang")

    def fn(batch: pa.RecordBatch):
        texts = _prepared(batch.column(0).to_pylist())
        x = [row for i in range(0, len(texts), ROWS) for row in features(texts[i : i + ROWS], s)]
        at = [np.flatnonzero(row).astype(np.uint32) for row in x]
        yield {"lang": batch.column(1), "at": [i.tobytes() for i in at], "value": [row[i].astype(np.float16).tobytes() for row, i in zip(x, at, strict=True)]}

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["value"])) for r in map_batches(chosen, fn, "lang string, at binary, value binary", "text").collect())
    x = Sparse([(np.frombuffer(i, np.uint32), np.frombuffer(v, np.float16)) for _, i, v in got], s.dims)
    return Model(x, [lang for lang, _, _ in got], s)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        lang, score = (["und"] * len(texts), np.zeros(len(texts))) if held.value is None else held.value.predict(texts)
        yield {id_col: batch.column(0), "lang_pred": lang, "score": score}

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, fn, f"`{id_col}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double", "text")
