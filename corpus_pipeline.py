"""The corpus pipeline: documents are filtered, deduplicated, mixed and packed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet to shared
storage and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.llm import common, mixing, near_dedup, packing, quality_mil, substring_dedup, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects (learnt from labels outside its held-out rows)."""
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod(F.col("doc_id"), 4) != 2)
    return toxicity.keep_scored(docs, quality_mil.fit_model(docs, labels), threshold=0.7)


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """Rows repeated under one id are one document: of them the one with the longest text stays (ties by the columns' order).

    Rows with null ids are documents of their own.
    """
    many = common.materialise(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    n = many.count()
    if not n:
        return docs
    many = common.small(many, n)
    rows = docs.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("__length"), *docs.columns)).alias("__row"))
    return docs.join(many, "doc_id", "left_anti").select(docs.columns).unionByName(rows.select([F.col("__row")[c].alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group (five-word shingles, 0.8), in one row."""
    docs = one_row_an_id(docs)
    groups = near_dedup.near_duplicates(docs, near_dedup.Settings(words=5, percent=80))
    gone = common.materialise(groups.where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(common.small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of windows that occur elsewhere; a document left without words goes.

    Documents that lose nothing keep their text as it is; of others the words left are joined by
    spaces and n_chars is counted again. A row repeated under its id is no repetition.
    """
    docs = one_row_an_id(docs)
    cut = substring_dedup.remove_repeated(docs, substring_dedup.Settings(window=35)).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), "kept_text")
    joined = docs.join(cut, docs["doc_id"] == F.col("cut_id"), "left").where(F.col("cut_id").isNull() | (F.col("kept_text") != ""))
    text = F.when(F.col("cut_id").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    n_chars = F.when(F.col("cut_id").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return joined.select(*[text.alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else docs[c] for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats small sources up to the temperature mix; every document is read at least once."""
    return mixing.mix(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mixing", mixed),
    ("packing", packed),
]

#: No SQL: the quality classifier is a trained model; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return docs
