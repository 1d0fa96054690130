"""Lining rasters up: phase correlation, Fourier-Mellin, templates, keypoints and homographies."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import planes as P


def hanning(h: int, w: int) -> np.ndarray:
    return np.sqrt(np.outer(np.hanning(h), np.hanning(w)))


def phase_correlate(a: np.ndarray, b: np.ndarray, window: np.ndarray | None = None) -> tuple[float, float, float]:
    """(dx, dy, response): the shift, and the share of energy in the 5 x 5 cells around the peak."""
    if window is not None:
        a, b = a * window, b * window
    return spectra_correlate(np.fft.fft2(a), np.fft.fft2(b))


def spectra_correlate(fa: np.ndarray, fb: np.ndarray) -> tuple[float, float, float]:
    cross = fa * np.conj(fb)
    size = np.abs(cross)
    c = np.fft.fftshift(np.fft.ifft2(np.where(size > 1e-12, cross / np.where(size > 1e-12, size, 1), 0)).real)
    h, w = c.shape
    y, x = np.unravel_index(c.argmax(), c.shape)
    y0, y1, x0, x1 = max(0, y - 2), min(h, y + 3), max(0, x - 2), min(w, x + 3)
    part = c[y0:y1, x0:x1]
    total = part.sum()
    yy, xx = np.mgrid[y0:y1, x0:x1]
    cx, cy = ((part * xx).sum() / total, (part * yy).sum() / total) if abs(total) > 1e-12 else (x, y)
    return float(w // 2 - cx), float(h // 2 - cy), float(total)


def phase_response(a, b):
    x, y = (P.grey(P.fit_within(z, 256)).astype(float) for z in (a, b))
    return phase_correlate(x, y, hanning(*x.shape))[2]


def letterbox(img, n):
    x = P.fit_within(img, n)
    k = n / max(x.shape[:2])
    x = P.resize(x, max(1, round(x.shape[1] * k)), max(1, round(x.shape[0] * k)), "bilinear") if k > 1 else x
    out = np.full((n, n), 128.0)
    y0, x0 = (n - x.shape[0]) // 2, (n - x.shape[1]) // 2
    out[y0 : y0 + x.shape[0], x0 : x0 + x.shape[1]] = P.grey(x)
    return out


@lru_cache(maxsize=2)
def _polar_places(n: int) -> tuple[np.ndarray, ...]:
    c = n / 2
    r = np.exp(np.arange(n) / n * np.log(c))
    t = np.pi * np.arange(n) / n
    y, x = c + r[None] * np.sin(t)[:, None], c + r[None] * np.cos(t)[:, None]
    y0, x0 = np.clip(np.floor(y).astype(int), 0, n - 2), np.clip(np.floor(x).astype(int), 0, n - 2)
    return y0, x0, np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)


def log_polar(mag: np.ndarray, n: int) -> np.ndarray:
    y0, x0, fy, fx = _polar_places(n)
    return (1 - fy) * ((1 - fx) * mag[y0, x0] + fx * mag[y0, x0 + 1]) + fy * ((1 - fx) * mag[y0 + 1, x0] + fx * mag[y0 + 1, x0 + 1])


@lru_cache(maxsize=2)
def _mellin_weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.meshgrid(np.linspace(-0.5, 0.5, n), np.linspace(-0.5, 0.5, n), indexing="ij")
    cos = np.cos(np.pi * x) * np.cos(np.pi * y)
    return hanning(n, n), (1 - cos) * (2 - cos)


def mellin_spectrum(img, n=128):
    """Spectrum of the log-polar magnitudes."""
    win, high = _mellin_weights(n)
    return np.fft.fft2(log_polar(np.fft.fftshift(np.abs(np.fft.fft2(letterbox(img, n) * win))) * high, n))


def _integrals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = lambda z: np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c(x), c(x * x)


def _normalised(top: np.ndarray, sums: tuple[np.ndarray, np.ndarray], h: int, w: int, energy: float) -> np.ndarray:
    box = lambda z: z[h:, w:] - z[:-h, w:] - z[h:, :-w] + z[:-h, :-w]
    s1, s2 = (box(z) for z in sums)
    size = np.sqrt(np.maximum(s2 - s1**2 / (h * w), 0) * energy)
    return np.where(size > 1e-6, top / np.where(size > 1e-6, size, 1), 0)


def template_scores(big: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Normalised correlation (means removed) of ``small`` at every place in ``big`` (grey planes).

    A circular transform of the size of ``big`` is enough: where ``small`` lies within it, nothing wraps.
    """
    h, w = small.shape
    t = small.astype(float) - small.mean()
    x = big.astype(float)
    top = np.fft.irfft2(np.fft.rfft2(x) * np.conj(np.fft.rfft2(t, x.shape)), x.shape)[: x.shape[0] - h + 1, : x.shape[1] - w + 1]
    return _normalised(top, _integrals(x), h, w, (t * t).sum())


def crop_search(a, b):
    """Best placement of the image that is smaller both ways in the other, checked cell by cell.

    None unless one is smaller in both dimensions; 1 only for an exact copy of the cells.
    """
    big, small = (a, b) if a.shape[0] > b.shape[0] and a.shape[1] > b.shape[1] else (b, a)
    if not (big.shape[0] > small.shape[0] and big.shape[1] > small.shape[1]):
        return None
    s = template_scores(P.grey(big), P.grey(small))
    y, x = np.unravel_index(s.argmax(), s.shape)
    best = float(s[y, x])
    if best >= 0.97:
        h, w = small.shape[:2]
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                if y + dy >= 0 and x + dx >= 0 and (big[y + dy : y + dy + h, x + dx : x + dx + w].shape == small.shape) and (big[y + dy : y + dy + h, x + dx : x + dx + w] == small).all():
                    return 1.0
    return min(best, 0.9999)


class Templates:
    """An image to search in, and its smaller copies to search for."""

    def __init__(self, img, steps, least):
        g = P.grey(img).astype(float)
        self.shape, self.spectrum, self.sums = g.shape, np.fft.rfft2(g), _integrals(g)
        self.copies = []
        for k in range(steps):
            f = 0.25 + 0.75 * k / (steps - 1)
            h, w = round(g.shape[0] * f), round(g.shape[1] * f)
            if min(h, w) >= min(least, min(g.shape)):
                t = P.grey(P.resize(img, w, h, "bilinear")).astype(float)
                t -= t.mean()
                self.copies.append((h, w, t, (t * t).sum()))
        self.kept: dict = {}

    def spectra(self, shape) -> list[tuple[int, int, np.ndarray, float]]:
        """Of the copies that fit into a plane of that shape."""
        if shape not in self.kept:
            self.kept = {shape: [(h, w, np.conj(np.fft.rfft2(t, shape)), e) for h, w, t, e in self.copies if h < shape[0] and w < shape[1]]}
        return self.kept[shape]


def templates_alike(a: Templates, b: Templates) -> float | None:
    best = None
    for big, small in ((a, b), (b, a)):
        for h, w, t, energy in small.spectra(big.shape):
            top = np.fft.irfft2(big.spectrum * t, big.shape)[: big.shape[0] - h + 1, : big.shape[1] - w + 1]
            s = float(_normalised(top, big.sums, h, w, energy).max())
            best = s if best is None else max(best, s)
    return best


def multi_scale_template(steps=16, least=24):
    return P.Described(lambda z: Templates(z, steps, least), templates_alike)


# ---- keypoints --------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _pattern(kind: str) -> np.ndarray:
    """Pairs of sampling places: normal (orb), rings (brisk) or a grid's neighbours (akaze)."""
    if kind == "brisk":
        p = np.concatenate([[[0, 0]], *[[[r * np.cos(t), r * np.sin(t)] for t in 2 * np.pi * np.arange(n) / n] for r, n in ((3, 8), (5, 10), (7, 12))]])
        i, j = np.triu_indices(len(p), 1)
        keep = np.linspace(0, len(i) - 1, 256).astype(int)
        return np.round(np.stack([p[i[keep]], p[j[keep]]], 2).transpose(0, 2, 1).reshape(256, 4))
    if kind == "akaze":
        g = np.array([[x, y] for x in range(-7, 8, 2) for y in range(-7, 8, 2)])
        rng = np.random.default_rng(5)
        i, j = rng.integers(0, len(g), 256), rng.integers(0, len(g), 256)
        return np.concatenate([g[i], g[j]], 1).astype(float)
    return np.clip(np.round(np.random.default_rng(31).normal(0, 4, (256, 4))), -8, 8)


def corners(img, most=500, kind="orb"):
    """Oriented corners with descriptors: 256 comparisons, or for ``kaze`` 64 gradient sums.

    Corners score by the Harris measure; detectors of other libraries find other points.
    """
    g = P.grey(P.fit_within(img, 800)).astype(float)
    if min(g.shape) < 32:
        return np.zeros((0, 2)), np.zeros((0, 256), bool)
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) / 8
    gx, gy = P.correlate(g, k), P.correlate(g, k.T)
    f = lambda z: P.separable(z, P.gaussian(7, 1.5), "edge")
    xx, yy, xy = f(gx * gx), f(gy * gy), f(gx * gy)
    r = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    win = np.pad(r, 2, constant_values=-np.inf)
    win = np.maximum.reduce([win[i : i + r.shape[0]] for i in range(5)])
    win = np.maximum.reduce([win[:, i : i + r.shape[1]] for i in range(5)])
    edge = 13
    ok = (r == win) & (r > 1e-3 * r.max())
    ok[:edge], ok[-edge:], ok[:, :edge], ok[:, -edge:] = False, False, False, False
    y, x = np.nonzero(ok)
    order = np.argsort(-r[y, x], kind="stable")[:most]
    y, x = y[order], x[order]
    s = P.separable(g, P.gaussian(7, 2.0), "edge")
    pairs = _pattern(kind)
    d = np.arange(-7, 8)
    disc = (d[:, None] ** 2 + d[None] ** 2) <= 49
    patches = np.lib.stride_tricks.sliding_window_view(g, (15, 15))[y - 7, x - 7] * disc
    t = np.arctan2((patches * d[:, None]).sum((1, 2)), (patches * d[None]).sum((1, 2)))
    c, n = np.cos(t), np.sin(t)
    if kind == "kaze":
        out = np.zeros((len(x), 64))
        v, u = np.mgrid[-8:8, -8:8] + 0.5
        for i, (yy0, xx0) in enumerate(zip(y, x, strict=True)):
            qy, qx = np.clip(np.round(yy0 + n[i] * u + c[i] * v).astype(int), 0, g.shape[0] - 1), np.clip(np.round(xx0 + c[i] * u - n[i] * v).astype(int), 0, g.shape[1] - 1)
            du, dv = c[i] * gx[qy, qx] + n[i] * gy[qy, qx], c[i] * gy[qy, qx] - n[i] * gx[qy, qx]
            sums = [z.reshape(4, 4, 4, 4).sum((1, 3)).ravel() for z in (du, dv, np.abs(du), np.abs(dv))]
            total = np.concatenate(sums)
            out[i] = total / (np.linalg.norm(total) or 1)
        return np.stack([x, y], 1).astype(float), out
    px, py = pairs[:, 0::2], pairs[:, 1::2]
    c, n = c[:, None, None], n[:, None, None]
    qx, qy = np.round(c * px - n * py).astype(int), np.round(n * px + c * py).astype(int)
    v = s[np.clip(y[:, None, None] + qy, 0, g.shape[0] - 1), np.clip(x[:, None, None] + qx, 0, g.shape[1] - 1)]
    return np.stack([x, y], 1).astype(float), v[..., 0] < v[..., 1]


def ratio_matches(da: np.ndarray, db: np.ndarray, ratio=0.8) -> np.ndarray:
    """(b, a) pairs whose nearest neighbour is much nearer than the second."""
    if len(da) < 2 or not len(db):
        return np.zeros((0, 2), int)
    if da.dtype == bool:
        d = (db.sum(1)[:, None] + da.sum(1)[None] - 2 * (db.astype(np.float32) @ da.T.astype(np.float32))).astype(float)
    else:
        d = np.sqrt(np.maximum((db**2).sum(1)[:, None] + (da**2).sum(1)[None] - 2 * db @ da.T, 0))
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    i = np.arange(len(db))
    good = d[i, order[:, 0]] < ratio * d[i, order[:, 1]]
    return np.stack([i[good], order[good, 0]], 1)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Direct linear transform with normalised coordinates."""

    def scaled(p):
        m = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - m) ** 2).sum(1)).mean(), 1e-12)
        return (p - m) * s, np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

    (x, t), (u, v) = scaled(src), scaled(dst)
    n = len(x)
    a = np.zeros((2 * n, 9))
    a[0::2, 0:2], a[0::2, 2], a[0::2, 6:8], a[0::2, 8] = x, 1, -u[:, :1] * x, -u[:, 0]
    a[1::2, 3:5], a[1::2, 5], a[1::2, 6:8], a[1::2, 8] = x, 1, -u[:, 1:] * x, -u[:, 1]
    h = np.linalg.inv(v) @ np.linalg.svd(a)[2][-1].reshape(3, 3) @ t
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.concatenate([p, np.ones((len(p), 1))], 1) @ h.T
    return q[:, :2] / np.where(np.abs(q[:, 2:]) > 1e-12, q[:, 2:], 1e-12)


def homographies(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``homography`` of many small sets of points at once, and whether each has one."""

    def scaled(p):
        m = p.mean(1)
        s = np.sqrt(2) / np.maximum(np.sqrt(((p - m[:, None]) ** 2).sum(2)).mean(1), 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0], t[:, 1, 1], t[:, 0, 2], t[:, 1, 2], t[:, 2, 2] = s, s, -s * m[:, 0], -s * m[:, 1], 1
        return (p - m[:, None]) * s[:, None, None], t

    (x, t), (u, v) = scaled(src), scaled(dst)
    a = np.zeros((len(x), 2 * x.shape[1], 9))
    a[:, 0::2, 0:2], a[:, 0::2, 2], a[:, 0::2, 6:8], a[:, 0::2, 8] = x, 1, -u[..., :1] * x, -u[..., 0]
    a[:, 1::2, 3:5], a[:, 1::2, 5], a[:, 1::2, 6:8], a[:, 1::2, 8] = x, 1, -u[..., 1:] * x, -u[..., 1]
    h = np.linalg.inv(v) @ np.linalg.svd(a)[2][:, -1].reshape(-1, 3, 3) @ t
    some = np.abs(h[:, 2, 2]) > 1e-12
    return h / np.where(some, h[:, 2, 2], 1)[:, None, None], some


@lru_cache(maxsize=512)
def _picks(n: int, rounds: int, seed: int) -> np.ndarray:
    """The rounds' four points of n."""
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(n, 4, replace=False) for _ in range(rounds)])


def ransac(src: np.ndarray, dst: np.ndarray, limit=5.0, rounds=500, seed=1) -> tuple[np.ndarray | None, np.ndarray]:
    """Best homography and its inliers."""
    n = len(src)
    none = np.zeros(n, bool)
    if n < 4:
        return None, none
    picks, best, first = _picks(n, rounds, seed), none, 0
    for last in (8, 64, rounds):  # all points at once need no further rounds
        if best.all() or first >= rounds:
            break
        k = picks[first : min(last, rounds)]
        first = last
        h, some = homographies(src[k], dst[k])
        q = np.concatenate([src, np.ones((n, 1))], 1) @ h.transpose(0, 2, 1)
        q = q[..., :2] / np.where(np.abs(q[..., 2:]) > 1e-12, q[..., 2:], 1e-12)
        ok = (((q - dst) ** 2).sum(2) < limit * limit) & some[:, None]
        counts = ok.sum(1)
        i = int(counts.argmax())
        if counts[i] > best.sum():
            best = ok[i]
    if best.sum() < 4:
        return None, none
    h = homography(src[best], dst[best])
    return h, best


def sane(h: np.ndarray | None, w: int, hgt: int) -> bool:
    """Neither a collapse nor a fold: area ratio in (1/50, 50), mild perspective, convex outline."""
    if h is None:
        return False
    det = h[0, 0] * h[1, 1] - h[0, 1] * h[1, 0]
    if not 1 / 50 < abs(det) < 50 or np.hypot(h[2, 0], h[2, 1]) > 0.6 / np.hypot(w, hgt):
        return False
    q = project(h, np.array([[0, 0], [w, 0], [w, hgt], [0, hgt]], float))
    d = np.roll(q, -1, 0) - q
    e = np.roll(d, -1, 0)
    turn = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
    return bool((turn > 0).all() or (turn < 0).all())


def matched_keypoints(x, y, shape) -> dict:
    """The match of two images' corners; ``shape`` is that of the second."""
    (pa, da), (pb, db) = x, y
    m = ratio_matches(da, db)
    h, ok = ransac(pb[m[:, 0]], pa[m[:, 1]]) if len(m) else (None, np.zeros(0, bool))
    return {"inliers": int(ok.sum()), "good": len(m), "h": h, "sane": sane(h, shape[1], shape[0])}


def keypoint_match(a, b, kind="orb") -> dict:
    return matched_keypoints(corners(a, kind=kind), corners(b, kind=kind), b.shape)


def keypoints(kind="orb"):
    """Inliers of a sane homography between oriented corners (0 without one)."""

    def inliers(x, y):
        r = matched_keypoints(x[:2], y[:2], y[2])
        return float(r["inliers"]) if r["sane"] else 0.0

    return P.Described(lambda z: None if min(z.shape[:2]) < 32 else (*corners(z, kind=kind), z.shape), inliers)


def warp(img, h: np.ndarray, w: int, hgt: int) -> tuple[np.ndarray, np.ndarray]:
    """The image drawn in the frame (w, hgt) that ``h`` leads to, and where it covers it."""
    y, x = np.mgrid[:hgt, :w]
    p = project(np.linalg.inv(h), np.stack([x.ravel(), y.ravel()], 1).astype(float))
    px, py = p[:, 0].reshape(hgt, w), p[:, 1].reshape(hgt, w)
    inside = (px >= 0) & (py >= 0) & (px <= img.shape[1] - 1) & (py <= img.shape[0] - 1)
    x0, y0 = np.clip(np.floor(px).astype(int), 0, img.shape[1] - 2), np.clip(np.floor(py).astype(int), 0, img.shape[0] - 2)
    fx, fy = np.clip(px - x0, 0, 1)[..., None], np.clip(py - y0, 0, 1)[..., None]
    i = img.astype(float)
    out = (1 - fy) * ((1 - fx) * i[y0, x0] + fx * i[y0, x0 + 1]) + fy * ((1 - fx) * i[y0 + 1, x0] + fx * i[y0 + 1, x0 + 1])
    return np.where(inside[..., None], np.round(out), 0).astype(np.uint8), inside


def aligned_ssim(x, y, least=0.05):
    """SSIM over the overlap after warping B by the best homography; None without one. Sides: image, corners."""
    from .fullreference import _ssim_maps

    (a, ka), (b, kb) = x, y
    r = matched_keypoints(ka, kb, b.shape)
    if not r["sane"] or r["inliers"] < 10:
        return None
    moved, mask = warp(b, r["h"], a.shape[1], a.shape[0])
    core = np.lib.stride_tricks.sliding_window_view(np.pad(mask, 5), (11, 11)).all((2, 3))
    if core.mean() < least:
        return None
    return float(_ssim_maps(P.luma(a), P.luma(moved), P.gaussian(11, 1.5), "symmetric")[0][core].mean())


KERNELS = {
    "phaseCorr": phase_response, "fourierMellin": P.Described(mellin_spectrum, lambda x, y: spectra_correlate(x, y)[2]), "msTemplate": multi_scale_template(),
    **{k: keypoints(k) for k in ("orb", "akaze", "brisk", "kaze")}, "alignedSsim": P.Described(lambda z: None if min(z.shape[:2]) < 32 else (z, corners(z)), aligned_ssim),
}
