"""Plane algebra in numpy: resampling, filters, transforms, colour spaces."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def luma(img: np.ndarray) -> np.ndarray:
    return img.astype(float) @ np.array([0.299, 0.587, 0.114])


def grey(img: np.ndarray) -> np.ndarray:
    x = img.astype(np.int64)
    return ((x[..., 0] * 19595 + x[..., 1] * 38470 + x[..., 2] * 7471 + 32768) >> 16).astype(np.uint8)


def _kernel(kind: str):
    if kind == "box":
        return 0.5, lambda x: ((x > -0.5) & (x <= 0.5)).astype(float)
    if kind == "bilinear":
        return 1.0, lambda x: np.maximum(0, 1 - np.abs(x))
    if kind == "bicubic":

        def cubic(x, a=-0.5):
            x = np.abs(x)
            return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0))

        return 2.0, cubic
    return 3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


@lru_cache(maxsize=1024)
def _weights(n: int, m: int, kind: str) -> np.ndarray:
    """Matrix (m, n) that resamples n samples to m; support grows when shrinking."""
    reach, f = _kernel(kind)
    scale = n / m
    stretch = max(scale, 1.0)
    out = np.zeros((m, n))
    for i in range(m):
        centre = (i + 0.5) * scale
        a, b = max(0, int(centre - reach * stretch + 0.5)), min(n, int(centre + reach * stretch + 0.5))
        w = f((np.arange(a, b) - centre + 0.5) / stretch)
        total = w.sum()
        out[i, a:b] = w / total if total else 0
    return np.floor(out * (1 << 22) + 0.5) / (1 << 22)


def resize(img: np.ndarray, width: int, height: int, kind: str = "lanczos") -> np.ndarray:
    """8-bit resampling: across first, then down, rounded and clipped after each."""
    x = (img[..., None] if img.ndim == 2 else img).astype(float)
    h, w, c = x.shape
    # weights are multiples of 2^-22 and samples have 8 bits, so the products' sums are exact in any order
    if w != width:
        x = _rounded(_weights(w, width, kind) @ x.transpose(1, 0, 2).reshape(w, -1)).reshape(width, h, c).transpose(1, 0, 2)
    if h != height:
        x = _rounded(_weights(h, height, kind) @ x.reshape(h, -1)).reshape(height, -1, c)
    x = x.astype(np.uint8)
    return x[..., 0] if img.ndim == 2 else x


def resize_many(x: np.ndarray, width: int, height: int, kind: str = "lanczos") -> np.ndarray:
    """As resize, for whole samples of many planes (any axes before the rows and columns)."""
    *many, h, w = x.shape
    if w != width:
        x = _rounded(x.reshape(-1, w).astype(float) @ _weights(w, width, kind).T).reshape(*many, h, width)
    if h != height:
        x = _rounded(_weights(h, height, kind) @ x.astype(float))
    return x.astype(np.uint8)


def grey_many(x: np.ndarray) -> np.ndarray:
    """As grey, for planes of red, green and blue; 32 bits hold these sums exactly."""
    v = np.array([19595, 38470, 7471], np.float32) @ x.reshape(3, -1).astype(np.float32)
    v += 32768
    v /= 65536
    return v.astype(np.uint8).reshape(x.shape[1:])


def _rounded(x: np.ndarray) -> np.ndarray:
    x += 0.5
    np.floor(x, out=x)
    return np.clip(x, 0, 255, out=x)


def fit_within(img: np.ndarray, most: int, kind: str = "box") -> np.ndarray:
    h, w = img.shape[:2]
    k = min(1.0, most / max(h, w))
    return img if k == 1 else resize(img, max(1, round(w * k)), max(1, round(h * k)), kind)


def gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    g = np.exp(-x * x / (2 * sigma * sigma))
    return g / g.sum()


def separable(x: np.ndarray, k: np.ndarray, mode: str | None = "symmetric", ky: np.ndarray | None = None) -> np.ndarray:
    """Correlation with k across and ky (k) down; mode None keeps only full windows."""
    ky = k if ky is None else ky
    if mode is not None:
        r, ry = len(k) // 2, len(ky) // 2
        x = np.pad(x, ((ry, len(ky) - 1 - ry), (r, len(k) - 1 - r)), mode=mode)
    win = np.lib.stride_tricks.sliding_window_view
    return win(win(x, len(k), axis=1) @ k, len(ky), axis=0) @ ky


def correlate(x: np.ndarray, k: np.ndarray, mode: str | None = "edge") -> np.ndarray:
    if mode is not None:
        ry, rx = k.shape[0] // 2, k.shape[1] // 2
        x = np.pad(x, ((ry, k.shape[0] - 1 - ry), (rx, k.shape[1] - 1 - rx)), mode=mode)
    return np.einsum("abij,ij->ab", np.lib.stride_tricks.sliding_window_view(x, k.shape), k)


def box_sums(x: np.ndarray, n: int) -> np.ndarray:
    c = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]


def pool(x: np.ndarray, n: int = 2) -> np.ndarray:
    h, w = x.shape[0] // n * n, x.shape[1] // n * n
    return x[:h, :w].reshape(h // n, n, w // n, n).mean((1, 3))


@lru_cache(maxsize=64)
def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


PREWITT = np.array([[1, 0, -1], [1, 0, -1], [1, 0, -1]]) / 3
SCHARR = np.array([[3, 0, -3], [10, 0, -10], [3, 0, -3]]) / 16


def gradient(x: np.ndarray, k: np.ndarray, mode: str = "constant") -> np.ndarray:
    return np.hypot(correlate(x, k, mode), correlate(x, k.T, mode))


def alike(a: np.ndarray, b: np.ndarray, c: float) -> np.ndarray:
    return (2 * a * b + c) / (a * a + b * b + c)


def yiq(img: np.ndarray) -> np.ndarray:
    return img.astype(float) @ np.array([[0.299, 0.587, 0.114], [0.5959, -0.2746, -0.3213], [0.2115, -0.5227, 0.3112]]).T


def lab(img: np.ndarray) -> np.ndarray:
    x = img.astype(float) / 255
    x = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    xyz = x @ np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]).T / np.array([0.95047, 1, 1.08883])
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (xyz * (24389 / 27) + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def ciede2000(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """CIEDE2000 of Lab arrays (last axis L, a, b)."""
    l1, a1, b1, l2, a2, b2 = (*np.moveaxis(x, -1, 0), *np.moveaxis(y, -1, 0))
    cm7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 0.5 * (1 - np.sqrt(cm7 / (cm7 + 25.0**7)))
    a1, a2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    none = c1 * c2 == 0
    dh = np.where(none, 0, (h2 - h1 + 180) % 360 - 180)
    dh = np.where(~none & (np.abs(h2 - h1) == 180), h2 - h1, dh)
    total = h1 + h2
    hm = np.where(none, total, np.where(np.abs(h1 - h2) <= 180, total / 2, np.where(total < 360, (total + 360) / 2, (total - 360) / 2)))
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    big = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh / 2))
    cos = lambda k, o: np.cos(np.radians(k * hm + o))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.2 * cos(4, -63)
    sl = 1 + 0.015 * (lm - 50) ** 2 / np.sqrt(20 + (lm - 50) ** 2)
    rt = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((hm - 275) / 25) ** 2))))
    dl, dc, hh = (l2 - l1) / sl, (c2 - c1) / (1 + 0.045 * cm), big / (1 + 0.015 * cm * t)
    return np.sqrt(np.maximum(0, dl * dl + dc * dc + hh * hh + rt * dc * hh))


def hsv8(img: np.ndarray) -> np.ndarray:
    """8-bit hue, saturation, value (each 0 to 255)."""
    out = np.empty(img.shape, np.uint8)
    rows = max(1, 8192 // max(1, img.shape[1])) if img.ndim == 3 else len(img)  # parts that stay in a core's cache
    for k in range(0, len(img), rows):
        for i, plane in enumerate(hsv_planes(*(np.ascontiguousarray(c, float) for c in np.moveaxis(img[k : k + rows], -1, 0)))):
            out[k : k + rows, ..., i] = plane
    return out


def hsv_planes(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value up to 255, before they lose their fractions."""
    hi, lo = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    gap = hi - lo
    span = np.where(gap > 0, gap, 1)
    turn = (g - b) / span
    turn = np.where(turn < 0, turn + 6, turn)
    h = np.where(r == hi, turn, np.where(g == hi, (b - r) / span + 2, (r - g) / span + 4)) / 6
    return np.where(gap > 0, h, 0) * 255, gap / np.maximum(hi, 1) * 255, hi


def components(mask: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Labels from 1 of connected cells, by joining the rows' runs."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    if not len(row):
        return np.zeros((h, w), int), 0
    kinds, number = np.unique(_joined(row, first, last, w, eight), return_inverse=True)
    out = np.zeros(h * w + 1, int)
    np.add.at(out, row * w + first, number + 1)
    np.add.at(out, row * w + last + 1, -(number + 1))
    return np.cumsum(out)[:-1].reshape(h, w), len(kinds)


def areas(code: np.ndarray, eight: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code and size of every connected area of cells of one code, for all codes in one pass."""
    h, w = code.shape
    start = np.ones((h, w), bool)
    start[:, 1:] = code[:, 1:] != code[:, :-1]
    row, first = np.nonzero(start)
    last = np.append(first[1:], 0) - 1
    last[last < 0] = w - 1
    of = code[row, first]
    kinds, number = np.unique(_joined(row, first, last, w, eight, of), return_inverse=True)
    return of[kinds], np.bincount(number, weights=last - first + 1).astype(int)


def _joined(row, first, last, w: int, eight: bool, code=None) -> np.ndarray:
    """For each run of cells the least run it is connected to, through runs of its code."""
    n = len(row)
    # runs of the row above that touch: those that begin before the run's end and end after its start
    reach = int(eight)
    key = (w + 2) * row
    lo = np.searchsorted(key + last, (w + 2) * (row - 1) + first - reach, "left")
    hi = np.searchsorted(key + first, (w + 2) * (row - 1) + last + reach, "right")
    count = np.maximum(hi - lo, 0)
    u = np.repeat(np.arange(n), count)
    v = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if code is not None:
        same = code[u] == code[v]
        u, v = u[same], v[same]
    label = np.arange(n)
    while len(u):
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while (label[label] != label).any():
            label = label[label]
        go = label[u] != label[v]
        u, v = u[go], v[go]
    return label


class Described:
    """A pairwise kernel made of a description of each side, which callers may keep, and a comparison."""

    def __init__(self, describe, compare):
        self.describe, self.compare = describe, compare

    def __call__(self, a, b):
        x, y = self.describe(a), self.describe(b)
        return None if x is None or y is None else self.compare(x, y)
