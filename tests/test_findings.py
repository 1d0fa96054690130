"""What reviews found in the registered queries: results that rounding, chance or size spoilt."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairsight.operators import descriptors, edits, fullreference, imagehash, native, nearest, registration
from pairsight.operators import planes as P
from pairsight.plans import catalogue
from pairsight.plans import fixtures as X
from pairsight.queries import ORACLE_SQL, QUERIES

MIDDLE = "/root/testdata/sf0.01"


def written(spark, tmp_path, **tables):
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def neighbours(spark, tmp_path, first):
    """A folder with two documents of the middle tables."""
    return written(spark, tmp_path, documents=spark.read.parquet(f"{MIDDLE}/documents.parquet").where(F.col("doc_id").isin(first, first + 1)))


def test_crc32_of_different_texts_meets(spark, tmp_path):
    """Two texts of one CRC-32 aren't copies of each other."""
    docs = spark.createDataFrame([(1, "yhcbdjwhj"), (2, "cfmwjcitz"), (3, "cfmwjcitz"), (4, "")], "doc_id long, text string")
    got = QUERIES["exact_crc32"](spark, written(spark, tmp_path, documents=docs)).toPandas().sort_values("doc_id")
    want = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet') {ORACLE_SQL['exact_crc32']}").df().sort_values("doc_id")
    assert got.to_numpy().tolist() == want[got.columns].to_numpy().tolist()


def test_third_moment_of_zero(spark, tmp_path):
    """The first text's third moments are 0: the cube roots of what rounding left of them shifted the distance (2.06346...)."""
    assert QUERIES["hsvMoments"](spark, neighbours(spark, tmp_path, 909)).first()["value"] == 2.0635


def brute(rows, keep):
    """(pair_id, ia): the best ib of plain sums over (vec_id, v, label), ties to the lower id."""
    out = {}
    for ia, va, la in rows:
        sims = [(-sum(x * y for x, y in zip(va, vb, strict=True)), ib) for ib, vb, lb in rows if lb == la + 1]
        if sims:
            out[la, ia] = [ib for _, ib in sorted(sims)[:keep]]
    return out


@pytest.mark.parametrize("keep", [1, 2])
def test_matches_of_blocks(spark, monkeypatch, keep):
    """Blocks of both sides, copies on either side and nearly equal similarities give what plain sums give."""
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "ROWS", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[rng.integers(30)]], int(rng.integers(3))) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, v array<float>, label int")
    got = {}
    for r in native.best_matches(*native.label_sides(v), keep).orderBy("rank").collect():
        got.setdefault((r["pair_id"], r["ia"]), []).append(r["ib"])
    assert got == brute(rows, keep)


def test_matches_make_no_pairs_of_rows(spark):
    """36 million similarities of one image pair: hours as rows."""
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=(6000, 16)).astype(np.float32) for _ in "ab")
    rows = pd.DataFrame({"vec_id": np.arange(12000), "v": [*a.tolist(), *b.tolist()], "label": np.repeat([0, 1], 6000)})
    v = spark.createDataFrame(rows, "vec_id long, v array<float>, label int").repartition(8)
    began = time.time()
    got = native.best_matches(*native.label_sides(v), 1).toPandas().sort_values("ia")
    assert time.time() - began < 60
    assert (got["ib"].to_numpy() == (a.astype(float) @ b.T.astype(float)).argmax(1) + 6000).all()


def test_vectors_with_nulls(spark):
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [0.5, 1.0], 1), (5, [3.0, 1.0], 1), (6, None, 1)]
    v = spark.createDataFrame(rows, "vec_id long, v array<float>, label int")
    got = {r["ia"]: (r["ib"], r["sim"]) for r in native.best_matches(*native.label_sides(v), 1).collect()}
    assert got == {1: (5, 5.0), 2: (4, None), 3: (4, None)}


#: Milliseconds a pair of rasters of side 64 may take; before, these took two to thirty times as long on one core.
LIMITS = {
    "akaze": 20, "alignedSsim": 14, "orb": 14, "brisk": 20, "fourierMellin": 14, "msTemplate": 45, "dss": 14, "ccv": 7, "gabor": 24, "gist": 28, "paletteEmd": 26, "marrHildreth": 16,
    "colorMoment": 75, "cropResistant": 40,
}
KERNELS = fullreference.KERNELS | imagehash.KERNELS | descriptors.KERNELS | registration.KERNELS


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_kernel_is_quick(name):
    """A text's side is described once for both its pairs, so a pair costs one description and one comparison."""
    kernel, rng = KERNELS[name], np.random.default_rng(5)
    a, b, c = rng.integers(0, 256, (3, 64, 64, 3), dtype=np.uint8)
    split = hasattr(kernel, "describe")
    x, y = (kernel.describe(a), kernel.describe(b)) if split else (a, b)
    best = 1e9
    for _ in range(5):
        began = time.thread_time()
        if split:
            kernel.compare(y, kernel.describe(c))
        else:
            kernel(y, c)
        best = min(best, time.thread_time() - began)
    assert best * 1000 < LIMITS[name]


def test_neighbours_meet_once(spark):
    """Ids on both sides of a run's border, gaps, repeated ids, null texts and failing kernels."""
    ids = [*range(60, 70), 127, 128, 192, 194, -1, 0, 1]
    rows = [(i, f"text {i}") for i in ids] + [(64, "again"), (66, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def fails(a, b):
        return float("x") if b"64" in a else float(len(a) + len(b))

    kernels = {"size": P.Described(len, lambda x, y: x + y), "fails": fails}
    got = X.kernel_neighbours(docs, kernels, None).collect()
    want = [(i, a, b) for i, a in rows for j, b in rows if i is not None and j is not None and j == i + 1]
    sizes = sorted((i, float(len(a or "") + len(b or ""))) for i, a, b in want)
    assert sorted((r["pair_id"], r["value"]) for r in got if r["engine_id"] == "size") == sizes
    assert {r["pair_id"] for r in got if r["error"]} == {64} and sum(r["engine_id"] == "fails" for r in got) == len(want)


def test_areas_are_those_of_each_code():
    code = np.random.default_rng(6).integers(0, 3, (25, 31))
    for eight in (False, True):
        of, sizes = P.areas(code, eight)
        for c in range(3):
            label, n = P.components(code == c, eight)
            assert sorted(sizes[of == c]) == sorted(np.bincount(label.ravel(), minlength=n + 1)[1:])


def test_homographies_are_those_of_each_set():
    src, dst = np.random.default_rng(7).normal(0, 30, (2, 40, 4, 2))
    h, some = registration.homographies(src, dst)
    assert some.all() and all(np.allclose(x, registration.homography(p, q), atol=1e-6) for x, p, q in zip(h, src, dst, strict=True))


def test_robustness_counts(spark, tmp_path):
    """Null texts count as rows but have no part in the recall."""
    docs = spark.createDataFrame([(i, None if i == 3 else f"a text of its own {i} " * (i + 1)) for i in range(9)], "doc_id long, text string")
    got = QUERIES["robustness"](spark, written(spark, tmp_path, documents=docs)).toPandas()
    assert len(got) == 48 and (got["n"] == 9).all() and got["error"].isna().all()
    assert np.allclose((got["recall"] * 8) % 1, 0)


def test_peaks_make_no_row_for_each_cell(spark, sf_dir):
    plan = QUERIES["evidence_peaks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def quickest(f, times=7):
    best = 1e9
    for _ in range(times):
        began = time.thread_time()
        f()
        best = min(best, time.thread_time() - began)
    return best


def plain_moments(img, side=512):
    """Whole planes, step by step."""
    x = P.resize(img, side, side, "bicubic").astype(float)
    x = np.stack([np.rint(P.separable(c, P.gaussian(3, 0.8), "reflect")) for c in np.moveaxis(x, -1, 0)], -1)
    yl = x @ np.array([0.299, 0.587, 0.114])
    planes = [*np.moveaxis(P.hsv8(x).astype(float), -1, 0), yl, (x[..., 0] - yl) * 0.713 + 128, (x[..., 2] - yl) * 0.564 + 128]
    return np.concatenate([imagehash.hu_moments(p) for p in planes])


@pytest.mark.parametrize("shape", [(64, 64, 3), (45, 60, 3), (512, 512, 3), (600, 40, 3), (1, 1, 3)])
def test_colour_moments_equal_plain_ones(shape):
    """Also where neighbours differ so much that 32 bits won't do."""
    rng = np.random.default_rng(11)
    for img in (rng.integers(0, 256, shape, dtype=np.uint8), rng.integers(0, 2, shape, dtype=np.uint8) * np.uint8(255), np.full(shape, 7, np.uint8)):
        assert np.allclose(imagehash.colour_moments(img), plain_moments(img), rtol=1e-10, atol=1e-15)


def test_colour_moments_against_plain_time():
    """By strips of 64-bit samples they took more than half of the plain way's time, which was too long for 1 GB."""
    img = np.random.default_rng(12).integers(0, 256, (64, 64, 3), dtype=np.uint8)
    assert quickest(lambda: imagehash.colour_moments(img)) * 2.3 < quickest(lambda: plain_moments(img), 3)


def test_small_changes_round_alike():
    k, d = P.gaussian(3, 0.8), np.arange(-1020, 1021)
    corner, edge = k[0] * k[0], k[0] * k[1]
    for c in d:
        want = np.rint(c * corner + d * edge)
        got = np.rint(np.float32(c) * np.float32(corner) + d.astype(np.float32) * np.float32(edge))
        assert (got == want)[np.minimum(abs(got), abs(want)) <= imagehash._SURE].all()


ROBUST = ("phash", "dhash", "pdq", "blockMean0")


def odd_rasters():
    """Noise, flat and periodic ones, as short texts have them."""
    rng = np.random.default_rng(13)
    return [*rng.integers(0, 256, (6, 64, 64, 3), dtype=np.uint8), *[X.raster_of(t, 64) for t in ("a", "ab c", "a b " * 8, "word " * 50, "x" * 20000)]]


@pytest.mark.parametrize("edit", [None, *edits.EDITS])
def test_hashes_of_many_equal_single_ones(edit):
    rasters = odd_rasters()
    many = np.ascontiguousarray(np.moveaxis(np.array(rasters), -1, 0))
    if edit:
        many, rasters = edits.EDITS_MANY[edit](many), [edits.EDITS[edit](a) for a in rasters]
    assert all((np.moveaxis(many[:, i], 0, -1) == a).all() for i, a in enumerate(rasters))
    grey = P.grey_many(many)
    assert (grey == [P.grey(a) for a in rasters]).all()
    for h in ROBUST:
        assert (imagehash.HASHES_MANY[h](many, grey) == [imagehash.HASHES[h](a).ravel() for a in rasters]).all(), h


def test_hashes_of_many_against_single_time():
    """One raster at a time was too slow for 1 GB."""
    rasters = np.random.default_rng(14).integers(0, 256, (32, 64, 64, 3), dtype=np.uint8)
    many = np.ascontiguousarray(np.moveaxis(rasters, -1, 0))

    def together():
        for edit in edits.EDITS_MANY.values():
            made = edit(many)
            grey = P.grey_many(made)
            for h in ROBUST:
                imagehash.HASHES_MANY[h](made, grey)

    def apart():
        for a in rasters:
            for edit in edits.EDITS.values():
                made = edit(a)
                for h in ROBUST:
                    imagehash.HASHES[h](made)

    assert quickest(together, 3) * 2 < quickest(apart, 1)


def test_robustness_equals_counts_of_pairs(spark, tmp_path):
    """More texts than are hashed together, with null and empty ones among them."""
    texts = [None if i % 20 == 7 else f"text {i} of {i * i} " * (1 + i % 9) for i in range(70)] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {(r["edit"], r["hash"]): (r["n"], r["recall"]) for r in QUERIES["robustness"](spark, written(spark, tmp_path, documents=docs)).collect()}
    rasters = [X.raster_of(t, 64) for t in texts if t]
    for e, edit in edits.EDITS.items():
        made = [edit(a) for a in rasters]
        for h in ROBUST:
            line = float(catalogue.thresholds(h)[1])
            hits = sum(imagehash.KERNELS[h](a, b) <= line for a, b in zip(rasters, made, strict=True))
            assert got[e, h] == (len(texts), round(hits / len(rasters), 6)), (e, h)
