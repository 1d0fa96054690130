import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (ids in order) or from (id, text) pairs."""

    def build(texts, **extra):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, None if i is None or i % 4 == 3 else "en", None if i is None or i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in rows], DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return build


#: Null, empty, blank and very long texts, ties, repeated rows, null ids, odd characters.
ODD = [
    "plain words here", None, "", "   \t\n ", "word " * 40_000, "é " * 3000, "same text for two", "same text for two", "\x00\x1c odd　space   Ⅳ ﬁ", "<p>&amp;</p> <|endoftext|>", "***!!!", "a",
    (0, "plain words here"), (None, "no id at all"), (None, None),
]
#: Columns that operators use names like.
CLASH = {"id": 1, "key": "k", "score": 0.5, "media": "m", "n_words": 3, "kept": True, "mix_epoch": 9, "part": 1, "bin": 2, "label": 1, "feature": "f", "text2": "x", "u": 1, "root": 5, "g0": "z", "tokens": 4, "h": 1}
