"""Verdicts, decisions, streams and the plug-in surface."""

import math
import sys
import types

from pyspark.sql import functions as F

from pairsight.operators import localise, models
from pairsight.operators import native as N
from pairsight.plans import catalogue
from pairsight.plans import fixtures as X
from pairsight.plans import verdicts as D
from pairsight.streaming import scan


def test_catalogue(spark):
    assert len(catalogue.ENGINES) == 101 and catalogue.engines(spark).select("engine_id").distinct().count() == 101
    assert sum(catalogue.COSTS.get(i, catalogue.DEFAULT_MS) for i, *_ in catalogue.ENGINES) + catalogue.TAIL_MS == 22480


def test_verdicts_of_odd_values(spark):
    rows = [(1, "sscd", None), (2, "sscd", math.nan), (3, "sscd", 0.75), (4, "sscd", 0.5), (5, "psnr", math.inf), (6, "colorhash", 0.0), (7, "sscdLarge", 0.49), (8, "sha256", 1.0), (9, "sha256", 0.0)]
    got = {r["pair_id"]: r["verdict"] for r in D.judge(spark.createDataFrame(rows, "pair_id long, engine_id string, value double"), spark).collect()}
    assert got == {1: "na", 2: "na", 3: "match", 4: "partial", 5: "match", 6: "partial", 7: "none", 8: "identical", 9: "none"}


def test_report_of_infinite_values(spark):
    rows = [(1, "psnr", math.inf), (1, "sscd", math.nan)]
    text = D.report(D.judge(spark.createDataFrame(rows, "pair_id long, engine_id string, value double"), spark)).first()["report"]
    assert "Infinity" in text and "NaN" not in text


def test_identical_file_beats_all(spark):
    rows = spark.createDataFrame([(1, "sha256", 1.0), (1, "sscd", 0.1)], "pair_id long, engine_id string, value double")
    one = D.by_pair(D.judge(rows, spark), D.DECIDING).withColumns({"odd": F.lit(True), "stripped": F.lit(False), "patch_share": F.lit(None).cast("double"), "cover_a": F.lit(None).cast("double"), "cover_b": F.lit(None).cast("double")})
    assert one.select(D.headline(one), D.level(one)).first() == ("Identical files", "file")


def test_progress_and_switch_off(spark):
    judged = D.judge(spark.createDataFrame([(1, "sscd", 0.9), (1, "clip", 0.9)], "pair_id long, engine_id string, value double"), spark)
    off = {r["engine_id"]: r["verdict"] for r in D.switch_off(judged, ["clip"]).collect()}
    assert off == {"sscd": "match", "clip": "skipped"}
    assert 0 < D.progress(judged, spark).first()["done"] < 1


def test_copies_with_hot_group(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, "same").otherwise(F.col("id").cast("string")).alias("t"))
    out = N.copies(rows, "id", F.sha2("t", 256))
    assert out.count() == 1000 and out.where("n_same = 600 AND first_id = 0").count() == 600


def test_plans_keep_pushdown(spark, sf_dir):
    plan = X.vectors(spark, sf_dir).where("label = 3").select("vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_stream_equals_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = scan.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("hours").select("start", "event_type", "n").collect()} == {tuple(r) for r in scan.windowed(events).select("start", "event_type", "n").collect()}


def test_scan_stream_and_latest(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0.1 * i) for i in range(10)], "pair_id long, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    judge = lambda b: D.judge(b.withColumn("engine_id", F.lit("sscd")), spark)
    scan.scan_stream(stream, judge, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    done = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()])
    assert done.count() == 10 and scan.running_totals(done).count() == 10
    again = done.unionByName(done.withColumn("scan_id", F.lit(9)).withColumn("verdict", F.lit("none")))
    assert scan.latest(again).where("verdict = 'none' AND scan_id = 9").count() == 10


def test_embedding_plug_in(spark, monkeypatch):
    module = types.ModuleType("fake_embedder")
    exec("NAME = 'fake'\ndef setup():\n    return 2.0\ndef embed(state, data):\n    if not data:\n        raise ValueError('empty')\n    return [state * len(data)]", module.__dict__)
    monkeypatch.setitem(sys.modules, "fake_embedder", module)
    import importlib

    import pandas as pd

    state = importlib.import_module("fake_embedder").setup()
    assert module.embed(state, b"abc") == [6.0]
    assert models.REGISTRY == {} and pd is not None


def test_assignment_and_suppression(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.85), (1, 1, 1, 0.4)], "pair_id long, a_k int, b_k int, score double")
    assert {(r["a_k"], r["b_k"]) for r in localise.greedy_assignment(pairs).collect()} == {(0, 0), (1, 1)}
    det = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 5, 0.9), (1, 1, 0, 0, 10, 9, 6, 0.8), (1, 2, 30, 30, 40, 40, 5, 0.7)], "img long, k int, x1 long, y1 long, x2 long, y2 long, label_id long, score double")
    assert {r["k"] for r in localise.suppress(det).collect()} == {0, 2}
