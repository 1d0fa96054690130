"""Colour and texture descriptors of rasters (numpy) and their distances."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import planes as P
from .imagehash import hu_moments


def rgb_histogram(img) -> np.ndarray:
    x = img.reshape(-1, 3).astype(int) >> 5
    return np.bincount(x[:, 0] * 64 + x[:, 1] * 8 + x[:, 2], minlength=512) / len(x)


def grey_histogram(plane) -> np.ndarray:
    return np.bincount(np.clip(np.round(plane), 0, 255).astype(int).ravel(), minlength=256) / plane.size


def correlation(p, q):
    x, y = p - p.mean(), q - q.mean()
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / size) if size > 0 else 1.0


def chi_square(p, q):
    s = p + q
    return float(0.5 * ((p - q) ** 2 / np.where(s > 0, s, 1)).sum())


def bhattacharyya(p, q):
    return float(np.sqrt(max(0.0, 1 - np.sqrt(p * q).sum())))


def kl(p, q, eps=1e-12):
    some = p > eps
    return float((p[some] * np.log(p[some] / np.where(q[some] > eps, q[some], 1e-10))).sum())


def jensen_shannon(p, q):
    m = (p + q) / 2
    h = lambda a: (a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum()
    return float(np.sqrt(max(0.0, (h(p) + h(q)) / 2)))


def emd_1d(p, q):
    return float(np.abs(np.cumsum(p - q)).sum() / (len(p) - 1))


def ks(p, q):
    return float(np.abs(np.cumsum(p - q)).max())


def canberra(x, y):
    s = np.abs(x) + np.abs(y)
    return float((np.abs(x - y) / np.where(s > 0, s, 1)).mean())


def cosine(x, y):
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / size) if size > 0 else 0.0


def euclid(x, y):
    return float(np.sqrt(((x - y) ** 2).sum()))


def hsv_moments(img):
    h = P.hsv8(img).reshape(-1, 3) / 255.0
    m = h.mean(0)
    return np.concatenate([m, h.std(0), np.cbrt(((h - m) ** 3).mean(0))])


def coherence(img, share=0.01):
    """Coherent and incoherent shares of 64 colours after a 3 x 3 blur."""
    x = np.pad(P.fit_within(img, 256).astype(int), ((1, 1), (1, 1), (0, 0)), mode="edge")
    x = x[:-2] + x[1:-1] + x[2:]
    x = (x[:, :-2] + x[:, 1:-1] + x[:, 2:]) / 9
    q = np.round(x).astype(int) >> 6
    code = q[..., 0] * 16 + q[..., 1] * 4 + q[..., 2]
    of, sizes = P.areas(code, eight=True)
    large = sizes >= share * code.size
    out = np.stack([np.bincount(of[some], sizes[some], 64) for some in (large, ~large)], 1)
    return (out / code.size).ravel()


def correlogram(img, distances=(1, 3, 5, 7)):
    """Chance that a cell at Chebyshev distance d has the same of 64 colours."""
    q = P.fit_within(img, 128).astype(int) >> 6
    code = q[..., 0] * 16 + q[..., 1] * 4 + q[..., 2]
    h, w = code.shape
    out = np.zeros((64, len(distances)))
    for k, d in enumerate(distances):
        same, every = np.zeros(64), np.zeros(64)
        for dy in range(-d, d + 1):
            for dx in range(-d, d + 1):
                if max(abs(dy), abs(dx)) != d or abs(dy) >= h or abs(dx) >= w:
                    continue
                a = code[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
                b = code[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
                every += np.bincount(a.ravel(), minlength=64)
                same += np.bincount(a[a == b], minlength=64)
        out[:, k] = same / np.maximum(every, 1)
    return out


def palette(img, k=8, rounds=30):
    """Lab centres and shares by k-means, seeded at even steps of brightness."""
    x = P.lab(P.fit_within(img, 64)).reshape(-1, 3)
    order = np.argsort(x[:, 0], kind="stable")
    planes = np.ascontiguousarray(x.T)
    centres = x[order[((np.arange(k) + 0.5) * len(x) / k).astype(int)]].copy()
    for _ in range(rounds):
        own = sum((c[None] - at[:, None]) ** 2 for c, at in zip(planes, centres.T, strict=True)).argmin(0)
        n = np.bincount(own, minlength=k)
        new = np.stack([np.bincount(own, c, k) for c in planes], 1) / np.maximum(n, 1)[:, None]
        new[n == 0] = centres[n == 0]
        if np.allclose(new, centres):
            break
        centres = new
    share = np.bincount(own, minlength=k) / len(x)
    return centres[share > 0], share[share > 0]


def transport(supply, demand, cost) -> float:
    """Least cost of moving supply to demand (successive shortest paths on a small table)."""
    n, m = cost.shape
    supply, demand, c, inf = supply.tolist(), demand.tolist(), cost.tolist(), float("inf")
    flow, potential = [[0.0] * m for _ in range(n)], [0.0] * (n + m)
    while max(supply) > 1e-12 and max(demand) > 1e-12:
        dist, done, back = [0.0 if s > 1e-12 else inf for s in supply] + [inf] * m, [False] * (n + m), [-1] * (n + m)
        for _ in range(n + m):
            u = min((i for i in range(n + m) if not done[i]), key=dist.__getitem__)
            if dist[u] == inf:
                break
            done[u] = True
            if u < n:
                steps = [(n + j, c[u][j] + potential[u] - potential[n + j]) for j in range(m)]
            else:
                steps = [(i, -c[i][u - n] + potential[u] - potential[i]) for i in range(n) if flow[i][u - n] > 1e-12]
            for to, step in steps:
                new = dist[u] + max(step, 0.0)
                if new < dist[to] - 1e-15:
                    dist[to], back[to] = new, u
        v = min((n + j for j in range(m) if demand[j] > 1e-12), key=dist.__getitem__)
        path = [v]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        steps = list(zip(path[1:], path[:-1], strict=True))
        amount = min(supply[path[-1]], demand[v - n], *[flow[a][b - n] for b, a in steps if b >= n])
        for b, a in steps:
            if b < n:
                flow[b][a - n] += amount
            else:
                flow[a][b - n] -= amount
        supply[path[-1]] -= amount
        demand[v - n] -= amount
        potential = [p + min(x, dist[v]) for p, x in zip(potential, dist, strict=True)]
    flow = np.array(flow)
    return float((flow * cost).sum() / max(flow.sum(), 1e-12))


def palettes_apart(a, b):
    (ca, sa), (cb, sb) = a, b
    return transport(sa, sb, np.sqrt(((ca[:, None] - cb[None]) ** 2).sum(-1)))


def mean_colour(a, b):
    return float(P.ciede2000(*(P.lab(P.fit_within(x, 256)).reshape(-1, 3).mean(0) for x in (a, b))))


# ---- texture ----------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _gist_bank(n: int, per_scale=(8, 8, 8, 8)) -> np.ndarray:
    fy, fx = np.meshgrid(np.arange(-n // 2, n // 2), np.arange(-n // 2, n // 2), indexing="ij")
    r, t = np.fft.fftshift(np.hypot(fx, fy)), np.fft.fftshift(np.arctan2(fy, fx))
    out = []
    for i, k in enumerate(per_scale):
        for j in range(k):
            at = np.pi / k * j
            d = t + at
            d = d + 2 * np.pi * (d < -np.pi) - 2 * np.pi * (d > np.pi)
            out.append(np.exp(-10 * 0.35 * (r / n / (0.3 / 1.85**i) - 1) ** 2 - 2 * (16 * k**2 / 32**2) * np.pi * d**2))
    return np.array(out)


@lru_cache(maxsize=2)
def _gist_low(n: int, fc: float) -> np.ndarray:
    f = np.meshgrid(np.fft.fftfreq(n) * n, np.fft.rfftfreq(n) * n, indexing="ij")
    return np.exp(-(f[0] ** 2 + f[1] ** 2) / (fc / np.sqrt(np.log(2))) ** 2)


def gist(img, side=128, cells=4, fc=4):
    g = P.resize(img, side, side, "bilinear").astype(float).mean(-1)
    pad = 5
    x = np.pad(np.log(g + 1), pad, mode="symmetric")
    n = x.shape[0]
    low = _gist_low(n, fc)
    x = x - np.fft.irfft2(np.fft.rfft2(x) * low, x.shape)
    x = x / (0.2 + np.sqrt(np.abs(np.fft.irfft2(np.fft.rfft2(x * x) * low, x.shape))))
    f = np.fft.fft2(x[pad:-pad, pad:-pad])
    y = np.empty((len(_gist_bank(side)), side, side))
    for i, wing in enumerate(_gist_bank(side)):  # one at a time stays in a core's cache
        z = np.fft.ifft2(f * wing)
        np.sqrt(z.real**2 + z.imag**2, out=y[i])
    return y.reshape(len(y), cells, side // cells, cells, side // cells).mean((2, 4)).ravel()


def hog(img, side=128, bins=9, cell=16):
    g = P.resize(P.grey(img), side, side, "bilinear").astype(float)
    gy, gx = np.zeros_like(g), np.zeros_like(g)
    gy[1:-1], gx[:, 1:-1] = g[2:] - g[:-2], g[:, 2:] - g[:, :-2]
    mag, ang = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    n = side // cell
    where = np.minimum((ang / (180 / bins)).astype(int), bins - 1)
    cells = np.zeros((n, n, bins))
    for k in range(bins):
        cells[..., k] = np.where(where == k, mag, 0).reshape(n, cell, n, cell).mean((1, 3))
    out = []
    for y in range(n - 1):
        for x in range(n - 1):
            v = cells[y : y + 2, x : x + 2].ravel()
            v = np.minimum(v / np.sqrt((v * v).sum() + 1e-10), 0.2)
            out.append(v / np.sqrt((v * v).sum() + 1e-10))
    return np.concatenate(out)


@lru_cache(maxsize=4)
def _gabor_bank(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters of four frequencies and six directions as matrices (24, h, h) and (24, w, w) that act down and across.

    A filter is the product of one along each axis; the border's padding is part of the matrices.
    """

    def along(size, wave, r):
        pad = np.pad(np.eye(size), ((r, r), (0, 0)), mode="symmetric" if min(h, w) >= r else "edge")
        return np.array([wave[::-1] @ pad[i : i + 2 * r + 1] for i in range(size)])

    down, across = [], []
    for f in (0.05, 0.1, 0.2, 0.4):
        for k in range(6):
            t = np.pi * k / 6
            s = np.sqrt(np.log(2) / 2) * 3 / (np.pi * f)
            r = int(np.ceil(max(1, 3 * s)))
            at = np.arange(-r, r + 1)
            wave = lambda turn, at=at, s=s, f=f: np.exp(-(at * at) / (2 * s * s)) * np.exp(2j * np.pi * f * at * turn)
            down.append(along(h, wave(np.sin(t)) / (2 * np.pi * s * s), r))
            across.append(along(w, wave(np.cos(t)), r))
    return np.array(down), np.array(across)


def gabor(img):
    g = P.grey(P.fit_within(img, 128)).astype(float) / 255
    down, across = _gabor_bank(*g.shape)
    y = np.abs((down.reshape(-1, len(g)) @ g).reshape(len(down), *g.shape) @ across.transpose(0, 2, 1))
    return np.stack([y.mean((1, 2)), y.std((1, 2))], 1).ravel()


def glcm(img, levels=32):
    """Six properties of symmetric co-occurrence, for two distances, averaged over directions."""
    q = P.grey(P.fit_within(img, 256)).astype(int) * levels // 256
    h, w = q.shape
    i, j = np.mgrid[:levels, :levels]
    out = []
    for d in (1, 2):
        props = []
        for dy, dx in ((0, d), (-d, d), (-d, 0), (-d, -d)):
            a = q[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            b = q[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
            p = np.bincount((a * levels + b).ravel(), minlength=levels**2).reshape(levels, levels).astype(float)
            p = p + p.T
            p /= max(p.sum(), 1)
            mi, asm = (i * p).sum(), (p * p).sum()
            var = ((i - mi) ** 2 * p).sum()
            corr = (((i - mi) * (j - mi)) * p).sum() / var if var > 1e-15 else 1.0
            props.append([(p * (i - j) ** 2).sum(), (p * np.abs(i - j)).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt(asm), corr, asm])
        out.append(np.mean(props, 0))
    return np.concatenate(out)


def lbp(img):
    """Histogram of uniform patterns of eight neighbours (outside reads 0; transitions not wrapped)."""
    g = P.grey(P.fit_within(img, 256)).astype(float)
    pad = np.pad(g, 2)
    h, w = g.shape
    bits = []
    for k in range(8):
        y, x = -np.sin(2 * np.pi * k / 8), np.cos(2 * np.pi * k / 8)
        y0, x0 = int(np.floor(round(y, 5))), int(np.floor(round(x, 5)))
        fy, fx = round(y, 5) - y0, round(x, 5) - x0
        at = lambda dy, dx: pad[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
        v = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
        bits.append(v - g >= -1e-9)
    b = np.array(bits)
    turns = (b[1:] != b[:-1]).sum(0)
    code = np.where(turns <= 2, b.sum(0), 9)
    return np.bincount(code.ravel(), minlength=10) / code.size


def zernike(img, degree=8):
    g = P.grey(P.fit_within(img, 128)).astype(float)
    total = g.sum()
    if total == 0:
        return None
    h, w = g.shape
    y, x = np.mgrid[:h, :w]
    radius = np.hypot(h, w) / 2
    dy, dx = (y - (y * g).sum() / total) / radius, (x - (x * g).sum() / total) / radius
    r, t = np.hypot(dx, dy), np.arctan2(dy, dx)
    inside = r <= 1
    f = g / total
    from math import factorial as fact

    out = []
    for n in range(degree + 1):
        for m in range(n % 2, n + 1, 2):
            poly = sum((-1) ** k * fact(n - k) / (fact(k) * fact((n + m) // 2 - k) * fact((n - m) // 2 - k)) * r ** (n - 2 * k) for k in range((n - m) // 2 + 1))
            out.append(abs((n + 1) / np.pi * (f * poly * np.exp(-1j * m * t) * inside).sum()))
    return np.array(out)


def hu_distance(a, b):
    x, y = (hu_moments(P.grey(P.fit_within(z, 256))) for z in (a, b))
    scaled = lambda h: np.where(np.abs(h) > 1e-5, np.sign(h) * np.log10(np.abs(np.where(h == 0, 1, h))), 0)
    both = (np.abs(x) > 1e-5) & (np.abs(y) > 1e-5)
    return float(np.abs(scaled(x) - scaled(y))[both].sum())


_pair = P.Described
_luma = lambda z: grey_histogram(P.luma(z))
KERNELS = {
    "histCorrel": _pair(rgb_histogram, correlation), "histChi": _pair(rgb_histogram, chi_square), "histIntersect": _pair(rgb_histogram, lambda p, q: float(np.minimum(p, q).sum())),
    "histBhatt": _pair(rgb_histogram, bhattacharyya), "lumaEmd": _pair(_luma, emd_1d), "klDiv": _pair(rgb_histogram, kl), "jsDiv": _pair(rgb_histogram, jensen_shannon),
    "ksLuma": _pair(lambda z: grey_histogram(P.grey(z)), ks), "hsvMoments": _pair(hsv_moments, lambda x, y: float(np.abs(x - y).sum())),
    "ccv": _pair(coherence, lambda x, y: float(0.5 * np.abs(x - y).sum())), "correlogram": _pair(correlogram, lambda x, y: float((np.abs(x - y) / (1 + x + y)).sum())),
    "paletteEmd": _pair(palette, palettes_apart), "meanColor": mean_colour, "gist": _pair(gist, euclid), "hog": _pair(hog, cosine), "gabor": _pair(gabor, canberra), "glcm": _pair(glcm, canberra),
    "lbp": _pair(lbp, chi_square), "zernike": _pair(zernike, euclid), "huMoments": hu_distance,
}
