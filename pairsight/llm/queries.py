"""The queries of this subpackage: name -> function of (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, html_text, language, media, mixing, near_dedup, packing, quality_mil, quality_rules, substring_dedup, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_features(media.encode_images(documents(spark, sf_dir)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_rank", "mix_key", "mix_tokens", "mix_weight")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = common.crc_mod(F.col("doc_id"), 5) == 0
    model = language.fit_model(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), common.table(spark, sf_dir, "labels")
    held_out = common.crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit_model(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), near_dedup.Settings(words=4, percent=80))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(documents(spark, sf_dir), substring_dedup.Settings(window=35), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), common.table(spark, sf_dir, "labels")
    held_out = common.crc_mod(F.col("doc_id"), 4) == 2
    model = quality_mil.fit_model(docs, labels.where(~held_out))
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_media, op2_mixing, op3_language, op4_html, op5_toxicity, op6_near_dedup, op7_packing, op8_quality_rules, op9_quality, op10_substring)}
_WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents), t AS (SELECT doc_id, ws, len(ws) AS n FROM w)"

ORACLE_SQL: dict[str, str] = {
    "op6_near_dedup": "WITH RECURSIVE "
    + _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
sh AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i+3], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(n-2, 2))) AS i FROM t WHERE n > 0)),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
e AS MATERIALIZED (SELECT p.a AS a, p.b AS b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN z u ON u.doc_id = p.a JOIN z v ON v.doc_id = p.b WHERE 100*p.c >= 80*(u.n+v.n-p.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT t.doc_id AS doc_id, coalesce(z.n, 0) AS n_shingles, r.m AS component_id, t.doc_id = r.m AS kept FROM t LEFT JOIN z ON z.doc_id = t.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = t.doc_id""",
    "op10_substring": "WITH "
    + _WORDS.format(text="coalesce(text, '')")
    + """,
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, n-33)) AS i FROM t WHERE n >= 35)),
s AS MATERIALIZED (SELECT doc_id, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
word AS (SELECT doc_id, unnest(range(1, n+1)) AS p, unnest(ws) AS word FROM t),
c AS (SELECT word.doc_id AS doc_id, p, word, max(i) OVER (PARTITION BY word.doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) >= p-34 AS gone FROM word LEFT JOIN s ON s.doc_id = word.doc_id AND s.i = word.p),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone IS NOT TRUE) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id AS doc_id, t.n AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id""",
}
