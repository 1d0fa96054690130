"""Identities, symmetries and published values of the numpy kernels."""

import zlib

import numpy as np
import pytest

from pairsight.operators import descriptors, edits, fullreference, fuzzy, imagehash, localise, registration, watermark
from pairsight.operators import planes as P
from pairsight.plans.catalogue import ENGINES
from pairsight.sources import images

RNG = np.random.default_rng(0)
A = np.clip(P.resize(RNG.integers(0, 256, (12, 12, 3), dtype=np.uint8), 96, 96, "bicubic").astype(int) + RNG.integers(-4, 5, (96, 96, 3)), 0, 255).astype(np.uint8)
B = P.resize(RNG.integers(0, 256, (12, 12, 3), dtype=np.uint8), 96, 96, "bicubic") // np.array([1, 3, 5], np.uint8)
ALL = fullreference.KERNELS | imagehash.KERNELS | descriptors.KERNELS | registration.KERNELS
BETTER = {i: b for i, _, _, b, _, _ in ENGINES}
#: Kernels whose value for an image and itself isn't a plain 0 or 1.
SELF = {"psnr": float("inf"), "nmi": 2.0, "orb": None, "akaze": None, "brisk": None, "kaze": None, "msTemplate": None, "ncd": None}


@pytest.mark.parametrize("name", sorted(ALL))
def test_self_pair_is_best(name):
    same, other = ALL[name](A, A), ALL[name](A, B)
    want = SELF.get(name, 0.0 if BETTER[name] == "lower" else 1.0)
    if want is not None:
        assert same == pytest.approx(want, abs=1e-6)
    if other is not None:
        assert other < same if BETTER[name] == "higher" else other > same


@pytest.mark.parametrize("name", ["psnr", "ncc", "uqi", "gmsd", "deltaE", "nmi", "histChi", "histIntersect", "jsDiv", "lumaEmd", "ksLuma", "phash", "dhash", "pdq", "glcm", "lbp", "paletteEmd"])
def test_symmetric(name):
    assert ALL[name](A, B) == pytest.approx(ALL[name](B, A), rel=1e-9, abs=1e-9)


def test_ciede2000_published_pairs():
    """Values of the published test data for the colour difference formula."""
    pairs = [
        ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0),
        ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
    ]
    for x, y, want in pairs:
        assert P.ciede2000(np.array(x, float), np.array(y, float)) == pytest.approx(want, abs=1e-4)


def test_dihedral_finds_turns():
    for turned in (np.rot90(A), np.rot90(A, 2), A[::-1], A[:, ::-1], A.swapaxes(0, 1)):
        assert imagehash.KERNELS["pdqDihedral"](A, turned) < imagehash.KERNELS["pdq"](A, turned)


def test_components_against_flood():
    mask = RNG.random((30, 40)) < 0.5
    for eight in (False, True):
        label, n = P.components(mask, eight)
        seen, count = np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask), strict=True):
            if seen[start]:
                continue
            count += 1
            todo = [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 30 and 0 <= x < 40 and mask[y, x] and not seen[y, x]:
                    seen[y, x] = count
                    todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
        assert n == count
        assert len({(a, b) for a, b in zip(label[mask], seen[mask], strict=True)}) == n


def test_transport_is_optimal_on_a_line():
    p, q = RNG.random(6), RNG.random(6)
    p, q = p / p.sum(), q / q.sum()
    cost = np.abs(np.arange(6)[:, None] - np.arange(6)[None]).astype(float)
    assert descriptors.transport(p, q, cost) == pytest.approx(np.abs(np.cumsum(p - q)).sum(), abs=1e-9)


def test_registration():
    assert registration.phase_correlate(P.luma(A), P.luma(np.roll(A, (3, 7), (0, 1))))[:2] == pytest.approx((7, 3), abs=0.01)
    assert registration.crop_search(A, A[10:60, 20:70]) == 1.0
    assert registration.crop_search(A, B[:40, :40]) < 0.97
    assert registration.crop_search(A, B) is None
    h = np.array([[1.1, 0.05, 3], [-0.04, 0.95, 5], [1e-4, 2e-4, 1]])
    src = RNG.random((40, 2)) * 90
    dst = registration.project(h, src)
    dst[:12] = RNG.random((12, 2)) * 90
    got, inliers = registration.ransac(src, dst)
    assert inliers.sum() >= 28 and np.allclose(got, h, atol=1e-6) and registration.sane(got, 96, 96)


def test_fuzzy_digests():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(600)).encode()
    near, far = text[:2000] + b"changed " + text[2000:], bytes(RNG.integers(0, 256, 4000, dtype=np.uint8))
    assert fuzzy.KERNELS["ssdeep"](text, text) == 100 and fuzzy.KERNELS["ssdeep"](text, near) >= 50 and fuzzy.KERNELS["ssdeep"](text, far) == 0
    assert fuzzy.KERNELS["tlsh"](text, text) == 0 and fuzzy.KERNELS["tlsh"](text, near) < fuzzy.KERNELS["tlsh"](text, far)
    assert fuzzy.tlsh(b"short") is None
    assert fuzzy.KERNELS["nilsimsa"](text, text) == 128 and fuzzy.KERNELS["nilsimsa"](text, near) > 60
    assert fuzzy.KERNELS["lzjd"](text, text) == 1 and fuzzy.KERNELS["lzjd"](text, near) > fuzzy.KERNELS["lzjd"](text, far)
    assert sorted(fuzzy.nilsimsa_table()) == list(range(256))
    for name, kernel in fuzzy.KERNELS.items():
        kernel(b"", b"")
        kernel(b"a", b"")
        assert name


def test_images_round_trip():
    data = images.encode_png(A, {"Title": "x"})
    assert (images.decode(data) == A).all()
    info = images.parse_container(data)
    assert info["format"] == "PNG" and info["text"] == {"Title": "x"}
    assert info["payload"] == images.parse_container(images.encode_png(A))["payload"]
    ppm = b"P6\n96 96\n255\n" + A.tobytes()
    assert (images.decode(ppm) == A).all()
    assert images.carve(b"head" + data + b"tail") == [data]
    assert images.parse_container(b"")["format"] == "unknown"
    dqt = bytes([0]) + bytes(range(1, 65))
    jpeg = b"\xff\xd8\xff\xdb" + (2 + len(dqt)).to_bytes(2, "big") + dqt + b"\xff\xda\x00\x02xyz"
    assert images.parse_container(jpeg)["tables"] == [(0, list(range(1, 65)))]


def test_png_filters_undone():
    rows = A[:20].reshape(20, -1)
    for kind in range(5):
        raw = np.zeros((20, rows.shape[1] + 1), np.uint8)
        raw[:, 0] = kind
        for y in range(20):
            up = rows[y - 1].astype(int) if y else np.zeros(rows.shape[1], int)
            for x in range(rows.shape[1]):
                a, b, c = (int(rows[y, x - 3]) if x >= 3 else 0), int(up[x]), (int(up[x - 3]) if x >= 3 else 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                raw[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255
        assert (images._unfilter(raw, 3) == rows).all()


def test_watermark_vote():
    mark = watermark.KNOWN["sdxl"]
    img = np.clip(watermark.insert(np.full((128, 128, 3), 90, np.uint8), mark), 0, 255)
    name, share = watermark.detect(img)
    assert (name, share) == ("sdxl", 1.0)
    assert watermark.detect(A)[1] < 0.95


def test_links_sum_to_score():
    x, y = RNG.normal(size=(64, 20)) + 0.5, RNG.normal(size=(64, 20)) + 0.5
    r = localise.evidence(x, y)
    got = localise.copy_links(r, (8, 8), (8, 8))
    assert got["score"] == pytest.approx(float(x.sum(0) @ y.sum(0) / np.linalg.norm(x.sum(0)) / np.linalg.norm(y.sum(0))))
    assert sum(v["weight"] for v in got["links"]) + got["rest"] + got["negative"] == pytest.approx(got["score"])


def test_differences_and_edits():
    changed = A.copy()
    changed[30:50, 40:60] = 255 - changed[30:50, 40:60]
    found = localise.find_differences(A, changed)
    x1, y1, x2, y2 = found[0]["box"]
    assert abs(x1 - 40) <= 2 and abs(y1 - 30) <= 2 and abs(x2 - 60) <= 2 and abs(y2 - 50) <= 2
    assert localise.find_differences(A, A) == []
    for name, edit in edits.EDITS.items():
        out = edit(A)
        assert out.dtype == np.uint8 and out.shape[2] == 3, name


def test_ncd_bytes():
    x = bytes(RNG.integers(0, 256, 1500, dtype=np.uint8))
    assert fullreference.ncd_bytes(x, x) < 0.1
    assert fullreference.ncd_bytes(b"abc" * 500, bytes(RNG.integers(0, 256, 1500, dtype=np.uint8))) > 0.9
    assert zlib.crc32(b"") == 0


def test_regions_of_images():
    assert localise.overlap_quad(np.eye(3), A.shape, A.shape) == pytest.approx((1, 1, 1, 0))
    assert localise.overlap_quad(np.array([[1, 0, 48.0], [0, 1, 0], [0, 0, 1]]), A.shape, A.shape)[:2] == pytest.approx((0.5, 0.5))
    assert (localise.dense_shifts(A, np.roll(A, (1, 2), (0, 1)))[1:-1, 1:-1] == [1, 2]).all()
    assert localise.unmatched_pieces(np.array([[0, 0, 1.0], [0, 1, 1], [1, 1, 0]]), 0.5) == [(0, 0, 2, 2)]
    same = localise.compare_region(A, A, (10, 10, 40, 40), [(12, 12, 20, 20)])
    assert same == {"ssim": pytest.approx(1), "delta_e": 0, "changed": 0}
    assert localise.crop_similarity(A, A) == pytest.approx(1) and localise.crop_similarity(A, B) < 0.6
    grid = np.array([(y, x, y, x + 1) for y in range(4) for x in range(4)])
    found = localise.match_regions(np.concatenate([grid, [[20, 20, 3, 3]]]), np.full(17, 0.8))
    assert len(found) == 1 and found[0]["size"] == 16 and found[0]["b"] == (0, 1, 3, 4)
    assert len(localise.spread_lines(grid, np.arange(16.0), gap=1)) == 4
