"""From scores to verdicts, counts, a headline and a level of similarity.

Results are a long table (pair_id, engine_id, value, verdict, ...); decisions read one row a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import COUNTED, FLAGGED, TAIL_MS, costs, engines, thresholds


def verdict(value: Column, better: Column | str, match: Column | float | None, partial: Column | float | None) -> Column:
    """null and NaN are n/a; a missing threshold never fires."""
    better = F.lit(better) if isinstance(better, str) else better
    match = match if isinstance(match, Column) else F.lit(match).cast("double")
    partial = partial if isinstance(partial, Column) else F.lit(partial).cast("double")
    return (
        F.when(value.isNull() | F.isnan(value), "na")
        .when(better == "equal", F.when(value != 0, "identical").otherwise("none"))
        .when(((better == "higher") & (value >= match)) | ((better == "lower") & (value <= match)), "match")
        .when(((better == "higher") & (value >= partial)) | ((better == "lower") & (value <= partial)), "partial")
        .otherwise("none")
    )


def verdict_of(engine_id: str, value: Column) -> Column:
    return verdict(value.cast("double"), *thresholds(engine_id))


def judge(results: DataFrame, spark: SparkSession) -> DataFrame:
    """Adds ``verdict`` and ``display`` to (pair_id, engine_id, value): the catalogue is 101 rows."""
    out = results.join(F.broadcast(engines(spark)), "engine_id")
    found = verdict(F.col("value"), F.col("better"), F.col("match"), F.col("partial"))
    if "verdict" in results.columns:
        found = F.coalesce(results["verdict"], found)
    display = F.when(F.col("value").isNull() | F.isnan("value"), "n/a").otherwise(F.format_number("value", 3))
    return out.select("pair_id", "engine_id", "grp", "value", found.alias("verdict"), display.alias("display"))


def switch_off(results: DataFrame, disabled: list[str]) -> DataFrame:
    """Tests of disabled models are kept as rows that were skipped."""
    off = F.col("engine_id").isin(disabled)
    return results.withColumn("verdict", F.when(off, "skipped").otherwise(F.col("verdict"))).withColumn("value", F.when(off, F.lit(None).cast("double")).otherwise(F.col("value")))


def counts(judged: DataFrame) -> DataFrame:
    """Flagged, partial and counted tests of each pair and group, and of the pair as a whole (grp null)."""
    return judged.rollup("pair_id", "grp").agg(
        F.count_if(F.col("verdict").isin(*FLAGGED)).alias("flagged"),
        F.count_if(F.col("verdict") == "partial").alias("partial"),
        F.count_if(F.col("verdict").isin(*COUNTED)).alias("counted"),
        F.grouping_id().alias("g"),
    ).where("g < 3").select("pair_id", "grp", "flagged", "partial", "counted")


def by_pair(judged: DataFrame, ids: list[str]) -> DataFrame:
    """A column of (value, verdict) for each engine: one aggregation, no join."""
    return judged.groupBy("pair_id").agg(*[F.first(F.when(F.col("engine_id") == i, F.struct("value", "verdict")), ignorenulls=True).alias(i) for i in ids])


DECIDING = ["sha256", "payload", "pixels", "crop", "sscd", "sscdAligned", "pdq", "pdqDihedral", "phash", "dhash", "ssim", "msssim", "orb", "akaze", "brisk", "clip", "dino", "dreamsim"]


def _is(engine: str, *verdicts: str) -> Column:
    return F.coalesce(F.col(f"{engine}.verdict").isin(*verdicts), F.lit(False))


def _score(engine: str) -> Column:
    """The value, where the test counts."""
    value = F.col(f"{engine}.value")
    return F.when(F.col(f"{engine}.verdict").isin(*COUNTED) & value.isNotNull() & ~F.isnan(value), value)


def _above(score: Column, least: float) -> Column:
    return F.coalesce(score >= least, F.lit(False))


def headline(pairs: DataFrame) -> Column:
    """One of the titles below; ``pairs`` has a column for each engine of DECIDING, odd (an image is
    flat or noise), stripped (credits removed) and patch_share (mutual patches)."""
    whole, aligned = _score("sscd"), _score("sscdAligned")
    better = F.coalesce(aligned.isNotNull() & (whole.isNull() | (aligned > whole + 0.05)), F.lit(False))
    score = F.when(better, aligned).otherwise(whole)
    geometry = _is("orb", "match") | _is("akaze", "match") | _is("brisk", "match")
    semantic = _above(_score("clip"), 0.75) | _above(_score("dino"), 0.4) | _above(F.col("patch_share"), 0.1) | F.coalesce(_score("dreamsim") <= 0.4, F.lit(False))
    return (
        F.when(_is("sha256", "identical"), "Identical files")
        .when(_is("payload", "identical"), F.when(F.col("stripped"), "Same image, credits stripped").otherwise("Same image, different metadata"))
        .when(_is("pixels", "identical"), "Identical pixels")
        .when(_is("crop", "identical"), "Verbatim crop")
        .when(F.col("odd"), "Too little structure to judge")
        .when(_above(score, 0.75), "Copy detected")
        .when(_above(score, 0.5), "Possible partial copy")
        .when(score.isNull() & (_is("pdq", "match") | _is("pdqDihedral", "match") | geometry), "Likely copy")
        .when(geometry, "Shared content")
        .when(semantic, "Similar subject, not a copy")
        .otherwise("No meaningful similarity")
    )


def level(pairs: DataFrame) -> Column:
    """One of LEVELS; reads the columns of ``headline`` and cover_a, cover_b (shares of the overlap)."""
    whole, aligned = _score("sscd"), _score("sscdAligned")
    lifted = aligned.isNotNull() & (whole.isNull() | (aligned > whole + 0.05))
    geometry = _is("orb", "match") | _is("akaze", "match") | _is("brisk", "match")
    hashes = _is("pdq", "match") | (_is("phash", "match") & _is("dhash", "match"))
    semantic = _above(_score("clip"), 0.75) | _above(_score("dino"), 0.4) | _above(F.col("patch_share"), 0.1) | F.coalesce(_score("dreamsim") <= 0.4, F.lit(False))
    return (
        F.when(_is("sha256", "identical"), "file")
        .when(_is("payload", "identical") | _is("pixels", "identical"), "pixels")
        .when(F.col("odd"), "none")
        .when(hashes & (_is("msssim", "match") | _is("ssim", "match")), "resaved")
        .when(_above(aligned, 0.75) & F.coalesce(lifted, F.lit(False)), F.when(F.coalesce(F.least("cover_a", "cover_b"), F.lit(1.0)) >= 0.6, "edited").otherwise("part"))
        .when(_above(whole, 0.75) | _is("pdqDihedral", "match"), "edited")
        .when(_is("crop", "identical", "match") | _above(whole, 0.5), "part")
        .when(_above(aligned, 0.5) & F.coalesce(lifted, F.lit(False)), "part")
        .when(geometry, "part")
        .when(semantic, "subject")
        .otherwise("none")
    )


def keypoint_verdict(inliers: Column, ratio: Column, sane: Column) -> Column:
    return F.when(sane & (inliers >= 20) & (ratio >= 0.5), "match").when(sane & (inliers >= 10) & (ratio >= 0.4), "partial").otherwise("none")


def object_verdict(aligned: Column, changed: Column, ssim: Column, sscd: Column, combined: Column) -> Column:
    """One object pair: by change where the images are aligned, else by likeness."""
    unlike = F.coalesce(~F.isnan(ssim) & (ssim < 0.8), F.lit(False))
    by_change = F.when((changed <= 0.1) & ~unlike, "match").when((F.coalesce(sscd, F.lit(1.0)) >= 0.5) | (changed <= 0.4), "partial").otherwise("none")
    likeness = F.coalesce(sscd, combined)
    return F.when(aligned, by_change).otherwise(F.when(likeness >= 0.75, "match").when(likeness >= 0.5, "partial").otherwise("none"))


def progress(judged: DataFrame, spark: SparkSession) -> DataFrame:
    """Share of the expected time whose tests are done, for each pair."""
    timed = judged.join(F.broadcast(costs(spark)), "engine_id")
    done = ~F.col("verdict").isin("pending", "running")
    return timed.groupBy("pair_id").agg((F.sum(F.when(done, F.col("expected_ms")).otherwise(0.0)) / (F.sum("expected_ms") + TAIL_MS)).alias("done"))


def report(judged: DataFrame) -> DataFrame:
    """A JSON report of each pair; infinite values are text, other non-finite ones null."""
    value = F.when(F.col("value") == float("inf"), F.lit('"Infinity"')).when(F.isnan("value") | (F.col("value") == float("-inf")), F.lit(None)).otherwise(F.col("value").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("engine_id", value.alias("value"), "verdict")))
    return judged.groupBy("pair_id").agg(F.to_json(F.struct(rows.alias("results"))).alias("report"))
