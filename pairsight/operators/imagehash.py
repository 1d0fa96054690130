"""Perceptual hashes of rasters (numpy), as bits or bytes, and their comparisons."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np

from . import planes as P


def words(bits: np.ndarray) -> list[int]:
    """Bits (first one highest) as signed 64-bit words, padded with zeros."""
    b = np.asarray(bits, bool).ravel()
    b = np.concatenate([b, np.zeros(-len(b) % 64, bool)])
    return np.packbits(b).view(">i8").astype(np.int64).tolist()


def average(img, n=8):
    g = P.resize(P.grey(img), n, n)
    return g > g.mean()


def difference(img, n=8):
    g = P.resize(P.grey(img), n + 1, n).astype(int)
    return g[:, 1:] > g[:, :-1]


def difference_vertical(img, n=8):
    g = P.resize(P.grey(img), n, n + 1).astype(int)
    return g[1:] > g[:-1]


def _cosines(x: np.ndarray) -> np.ndarray:
    """Unnormalised DCT-II along the last axis."""
    n = x.shape[-1]
    return x @ (2 * np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n) + 1) / (2 * n))).T


def perceptual(img, n=8, factor=4):
    g = P.resize(P.grey(img), n * factor, n * factor).astype(float)
    low = _cosines(_cosines(g.T).T)[:n, :n]
    return low > np.median(low)


def perceptual_simple(img, n=8, factor=4):
    g = P.resize(P.grey(img), n * factor, n * factor).astype(float)
    low = _cosines(g)[:n, 1 : n + 1]
    return low > low.mean()


def _power_of_two(img) -> int:
    return 2 ** int(np.log2(min(img.shape[:2])))


def wavelet(img, n=8):
    """Haar approximation: sums of equal blocks against their median."""
    side = max(n, _power_of_two(img))
    g = P.resize(P.grey(img), side, side).astype(float)
    low = P.pool(g, side // n)
    return low > np.median(low)


#: Low-pass decomposition filter of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])


def _low_pass(x: np.ndarray) -> np.ndarray:
    pad = np.pad(x, ((0, 0), (7, 7)), mode="symmetric")
    full = np.lib.stride_tricks.sliding_window_view(pad, 8, axis=1) @ DB4[::-1]
    return full[:, 1 : x.shape[1] + 7 : 2]


def wavelet_db4(img, n=8, side=None):
    side = side or max(n, _power_of_two(img))
    x = P.resize(P.grey(img), side, side) / 255.0
    for _ in range(max(0, int(np.log2(side // n)))):
        x = _low_pass(_low_pass(x).T).T
    return x > np.median(x)


def block(img, n=16):
    """Block sums of r + g + b with fractional borders, against the median of each quarter of rows."""
    x = img.astype(float).sum(-1)
    for axis in (0, 1):
        size = x.shape[axis]
        w = np.zeros((n, size))
        for i in range(n):
            a, b = i * size / n, (i + 1) * size / n
            k = np.arange(int(a), min(size, int(np.ceil(b))))
            w[i, k] = np.minimum(k + 1, b) - np.maximum(k, a)
        x = np.moveaxis(np.tensordot(w, x, (1, axis)), 0, axis)
    half = 255 * 3 * (img.shape[0] / n) * (img.shape[1] / n) / 2
    out = np.zeros((n, n), bool)
    for band in range(0, n, n // 4):
        part = x[band : band + n // 4]
        m = np.median(part)
        out[band : band + n // 4] = (part > m) | ((np.abs(part - m) < 1) & (m > half))
    return out


def colour(img, bits=3):
    """Shares of black and grey, and of six faint and six bright hue bands, in three bits each."""
    g, h = P.grey(img).ravel(), P.hsv8(img).reshape(-1, 3).astype(int)
    black = g < 256 // 8
    grey = ~black & (h[:, 1] < 256 // 3)
    coloured = ~black & ~grey
    faint = coloured & (h[:, 1] < 256 * 2 // 3)
    bright = coloured & ~faint
    band = h[:, 0] * 6 // 255
    top = 2**bits
    code = lambda x: min(top - 1, int(x * top))
    values = [code(black.mean()), code(grey.sum() / max(1, (~black).sum()))]
    c = max(1, coloured.sum())
    values += [code((faint & (np.minimum(band, 5) == k)).sum() / c) for k in range(6)]
    values += [code((bright & (np.minimum(band, 5) == k)).sum() / c) for k in range(6)]
    return np.array([[v >> (bits - 1 - i) & 1 for i in range(bits)] for v in values], bool)


def block_mean(img, overlapping=False):
    g = P.resize(P.grey(img), 256, 256, "bilinear").astype(float)
    step = 8 if overlapping else 16
    s = P.pool(g, step) * step**2  # whole numbers, as all sums here
    if overlapping:
        s = s[:-1, :-1] + s[1:, :-1] + s[:-1, 1:] + s[1:, 1:]
    return s / 256 >= g.mean()


@lru_cache(maxsize=2)
def _marr_blocks(alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (2, 31, 512), down and across: filter with edges repeated, then means of blocks of 16.

    The filter (2 - x^2 - y^2) exp((x^2 + y^2) / 2) is a sum of two products of one along each axis.
    """
    k = np.arange(-8, 9) / alpha
    e = np.exp(k * k / 2)
    pad = np.pad(np.eye(512), ((8, 8), (0, 0)), mode="edge")
    along = lambda f: sum(c * pad[i : i + 512] for i, c in enumerate(f)).reshape(32, 16, 512).mean(1)[:31]
    return np.array([along((2 - k * k) * e), along(-e)]), np.array([along(e), along(k * k * e)])


def marr_hildreth(img, alpha=2.0):
    g = P.grey(img)
    g = P.resize(g, 512, 512, "bicubic")
    hist = np.bincount(g.ravel(), minlength=256).cumsum()
    g = np.round((hist - hist[hist > 0][0]) / max(1, g.size - hist[hist > 0][0]) * 255)[g]
    down, across = _marr_blocks(alpha)
    blocks = np.tensordot(down @ g, across, ((0, 2), (0, 2)))
    bits = []
    for y in range(0, 30 - 1, 4):
        for x in range(0, 30 - 1, 4):
            cell = blocks[y : y + 3, x : x + 3]
            bits.append((cell > cell.mean()).ravel())
    return np.concatenate(bits)


def radial_variance(img, lines=180, coefficients=40):
    """40 low cosine coefficients, as bytes, of the variance along lines through the centre."""
    g = P.separable(P.grey(img).astype(float), P.gaussian(7, 1.0), "reflect" if min(img.shape[:2]) > 3 else "edge")
    h, w = g.shape
    r = np.arange(-(max(h, w) // 2), max(h, w) // 2 + 1)
    var = np.zeros(lines)
    for k in range(lines):
        t = np.pi * k / lines
        y, x = np.round(h / 2 + r * np.sin(t)).astype(int), np.round(w / 2 + r * np.cos(t)).astype(int)
        ok = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        var[k] = g[y[ok], x[ok]].var()
    sd = var.std()
    f = (var - var.mean()) / (sd or 1)
    c = np.array([(f * np.cos(np.pi * (2 * np.arange(lines) + 1) * k / (2 * lines))).sum() for k in range(coefficients)]) * np.sqrt(2 / lines)
    c[0] /= np.sqrt(2)
    span = np.ptp(c)
    return ((c - c.min()) / (span or 1) * 255).astype(np.uint8)


def radial_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The largest correlation over circular shifts; never below zero."""
    x, y = x.astype(float) - x.mean(), y.astype(float) - y.mean()
    size = np.sqrt((x * x).sum() * (y * y).sum())
    if size == 0:
        return 1.0 if (x == y).all() else 0.0
    return float(max(max((x * np.roll(y, k)).sum() for k in range(len(x))) / size, np.finfo(float).tiny))


def hu_moments(plane: np.ndarray) -> np.ndarray:
    v = plane.astype(float)
    y, x = (np.vander(np.arange(n) - (n - 1) / 2, 4, increasing=True) for n in v.shape)
    return hu_invariants(y.T @ v @ x)


def hu_invariants(raw: np.ndarray) -> np.ndarray:
    """Of moments up to order 3 (rows: powers down, columns: powers across) about any place."""
    m = raw[0, 0]
    if m == 0:
        return np.zeros(7)
    shift = lambda c: np.array([[1, 0, 0, 0], [-c, 1, 0, 0], [c * c, -2 * c, 1, 0], [-c * c * c, 3 * c * c, -3 * c, 1]])
    moments = shift(raw[1, 0] / m) @ raw @ shift(raw[0, 1] / m).T
    n = lambda p, q: moments[q, p] / m ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = n(2, 0), n(0, 2), n(1, 1), n(3, 0), n(0, 3), n(2, 1), n(1, 2)
    p, q = n30 + n12, n21 + n03
    r, s = n30 - 3 * n12, 3 * n21 - n03
    return np.array([
        n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, r * r + s * s, p * p + q * q, r * p * (p * p - 3 * q * q) + s * q * (3 * p * p - q * q),
        (n20 - n02) * (p * p - q * q) + 4 * n11 * p * q, s * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q),
    ])


@lru_cache(maxsize=8)
def _enlarging(n: int, side: int, rows: int) -> list[tuple[int, int, np.ndarray]]:
    """For each strip of ``rows`` and one more on both sides: its source rows' range, and weights of these and (last) of a half to round by.

    Weights of few bits, as for a power of two, are 32-bit: sums of them stay exact.
    """
    down = P._weights(n, side, "bicubic") if n != side else np.eye(side)
    down = np.pad(down, ((1, 1), (0, 0)), mode="reflect")
    out = []
    for i in range(0, side, rows):
        w = down[i : i + rows + 2]
        used = np.flatnonzero(w.any(0))
        a, b = used[0], used[-1] + 1
        w = np.hstack([w[:, a:b], np.ones((len(w), 1))])
        few = not (w * 2**13 % 1).any() and np.abs(w).sum(1).max() < 8
        out.append((a, b, w.astype(np.float32) if few else w))
    return out


#: Up to this change, 32-bit products of all whole sums round as 64-bit ones do.
_SURE = 35


@lru_cache(maxsize=1)
def _soft() -> np.ndarray:
    return P.gaussian(3, 0.8)


def _softened(z: np.ndarray) -> np.ndarray:
    """Whole samples (planes, rows, columns; int16) blurred by three weights each way and rounded.

    Rows of the result begin one lower and the last two are to be left, as the first and last column.
    """
    k = _soft()
    w, flat = z.shape[-1], z.ravel()
    mid, ends = flat[w:-w], flat[: -2 * w] + flat[2 * w :]
    four = mid[1:-1] * np.int16(4)
    corners = ends[:-2] + ends[2:]
    corners -= four
    edges = mid[:-2] + mid[2:]
    edges += ends[1:-1]
    edges -= four

    def change(kind):
        x, y = corners.astype(kind), edges.astype(kind)
        x *= kind(k[0] * k[0])
        y *= kind(k[0] * k[1])
        x += y
        return np.rint(x, out=x)

    out = np.zeros_like(z)
    inner = out.ravel()[1 : -2 * w - 1]
    inner[:] = change(np.float32)
    own = out[:, :-2, 1:-1]
    if own.max() > _SURE or own.min() < -_SURE:
        inner[:] = change(np.float64)
    inner += mid[1:-1]
    return out


def _hue_saturation(r, g, b, top) -> tuple[np.ndarray, np.ndarray]:
    """Of whole samples (int16) and their highest, up to 255, before they lose their fractions: as P.hsv_planes, without branches."""
    gap = top - np.minimum(np.minimum(r, g), b)
    some = np.maximum(gap, 1)
    red, other = g - b, b - r
    not_red, not_green = (r - top) >> 15, (g - top) >> 15  # all bits where another is the highest
    other ^= not_green & (other ^ (r - g))
    sixths = (not_red & ((not_green & 2) + 2)) | (~not_red & (red >> 15) & 6)
    red ^= not_red & (red ^ other)
    hue = red.astype(float)
    hue /= some.astype(float)
    hue += sixths.astype(float)
    hue /= 6
    hue *= 255
    saturation = gap.astype(np.float32)
    saturation *= 255
    saturation /= np.maximum(top, 1).astype(np.float32)  # whole quotients are exact, others further from whole numbers than rounding goes
    return hue, saturation


@lru_cache(maxsize=8)
def _powers(side: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Small whole numbers of each place within a group of cells, and what makes powers 0 to 3 of the place in the whole side of them: (4, groups, 4).

    Twice the place is an odd number u: u * u - 1 is a multiple of 8, u * u * u - u one of 24.
    """
    u, middle = 2 * np.arange(group) - (group - 1.0), np.arange(side // group) * group + (group - side) / 2
    near = np.stack([u**0, u, (u * u - 1) / 8, (u * u * u - u) / 24], 1)
    own = np.array([[1, 0, 0, 0], [0, 1 / 2, 0, 0], [1 / 4, 0, 2, 0], [0, 1 / 8, 0, 3]])
    shift = np.array([[comb(p, q) * middle ** max(0, p - q) for q in range(4)] for p in range(4)])
    return near.astype(np.float32), shift.swapaxes(1, 2) @ own


def colour_moments(img, side=512, rows=32, group=32):
    """Hu invariants of the hue, saturation, value and of the luma and chroma planes: 42 numbers.

    Enlarged, blurred by three weights each way and summed up a few rows at a time, which stay in a core's cache.
    Powers are summed in groups of cells first, whose sums 32 bits hold exactly; luma and chroma are sums of the
    samples' moments.
    """
    n = img.shape[0]
    wide = np.full((3, n + 1, side + 2), 0.5, np.float32)
    wide[:, :n, 1:-1] = P.resize_many(np.moveaxis(img, -1, 0), side, n, "bicubic")
    wide[:, :n, 0], wide[:, :n, -1] = wide[:, :n, 2], wide[:, :n, -3]
    near, shift = _powers(side, group)
    down = np.vander(np.arange(side) - (side - 1) / 2, 4, increasing=True)
    found, sums = np.empty((6, rows, side), np.float32), np.zeros((4, 6, side // group * 4))
    for i, (a, b, w) in zip(range(0, side, rows), _enlarging(n, side, rows), strict=True):
        z = w @ np.concatenate([wide[:, a:b], wide[:, n:]], 1)
        z = _softened(np.clip(z, 0, 255, out=z).astype(np.int16))
        planes = z[:, :-2]
        top = planes.max(0)
        hue, saturation = _hue_saturation(*planes, top)
        found[:3], found[5] = planes[..., 1:-1], top[:, 1:-1]
        found[3], found[4] = np.floor(hue, out=hue)[:, 1:-1], np.floor(saturation, out=saturation)[:, 1:-1]
        part = (found.reshape(-1, group) @ near).reshape(6, rows, -1)
        sums += (down[i : i + rows].T @ part.astype(float)).swapaxes(0, 1)
    raw = sums.reshape(24, -1) @ shift.reshape(4, -1).T
    r, g, b, hue, saturation, value = raw.reshape(4, 6, 4).swapaxes(0, 1)
    yl, one = 0.299 * r + 0.587 * g + 0.114 * b, np.outer(down.sum(0), down.sum(0))
    return np.concatenate([hu_invariants(m) for m in (hue, saturation, value, yl, (r - yl) * 0.713 + 128 * one, (b - yl) * 0.564 + 128 * one)])


def _jarosz(x: np.ndarray, window: int, axis: int) -> np.ndarray:
    """Mean over a sliding window that shrinks at the borders."""
    n = x.shape[axis]
    half = (window + 2) // 2
    i = np.arange(n)
    a, b = np.maximum(0, i - (window - half)), np.minimum(n, i + half)
    c = np.concatenate([np.zeros_like(np.take(x, [0], axis)), x.cumsum(axis)], axis)
    shape = [-1 if k == axis else 1 for k in range(2)]
    return (np.take(c, b, axis) - np.take(c, a, axis)) / (b - a).reshape(shape)


def pdq_coefficients(img) -> tuple[np.ndarray, int]:
    """16 x 16 cosine coefficients and the quality (0 to 100)."""
    x = P.luma(P.fit_within(img, 512))
    wy, wx = max(1, -(-x.shape[0] // 128)), max(1, -(-x.shape[1] // 128))
    for _ in range(2):
        x = _jarosz(_jarosz(x, wx, 1), wy, 0)
    yy = ((np.arange(64) + 0.5) * x.shape[0] / 64).astype(int)
    xx = ((np.arange(64) + 0.5) * x.shape[1] / 64).astype(int)
    s = x[yy][:, xx]
    grad = np.abs(((s[1:] - s[:-1]) * 100 / 255).astype(int)).sum() + np.abs(((s[:, 1:] - s[:, :-1]) * 100 / 255).astype(int)).sum()
    d = P.dct_matrix(64)[1:17]
    return d @ s @ d.T, min(100, int(grad / 90))


def pdq_bits(c: np.ndarray) -> np.ndarray:
    return c > np.sort(c.ravel())[127]


#: What each turn or mirror does to the coefficients: transpose, then signs of odd rows and columns.
DIHEDRAL = {
    "original": (False, 1, 1), "rotated 90": (True, -1, 1), "rotated 180": (False, -1, -1), "rotated 270": (True, 1, -1),
    "flipped": (False, -1, 1), "mirrored": (False, 1, -1), "transposed": (True, 1, 1), "anti-transposed": (True, -1, -1),
}


def pdq_variants(img) -> dict[str, np.ndarray]:
    c, _ = pdq_coefficients(img)
    odd = np.where(np.arange(1, 17) % 2 == 1, -1, 1)  # the coefficients start at order 1
    out = {}
    for name, (turn, rows, cols) in DIHEDRAL.items():
        x = c.T if turn else c
        x = x * (odd[:, None] if rows < 0 else 1) * (odd[None, :] if cols < 0 else 1)
        out[name] = pdq_bits(x)
    return out


def pdq(img):
    return pdq_bits(pdq_coefficients(img)[0])


def _median(x: np.ndarray) -> np.ndarray:
    """Of the 3 x 3 cells around each: sorted columns, then the middle of their highest lows, middles and lowest highs."""

    def middle(a, b, c):
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))

    p = np.pad(x, 1, mode="edge")
    a, b, c = p[:-2], p[1:-1], p[2:]
    low, high = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
    three = lambda z: (z[:, :-2], z[:, 1:-1], z[:, 2:])
    return middle(np.maximum.reduce(three(low)), middle(*three(middle(a, b, c))), np.minimum.reduce(three(high)))


def segments(img, threshold=128, least=500, side=300) -> list[np.ndarray]:
    """Difference hashes of bright and dark regions (4-connected, more than ``least`` cells)."""
    g = P.resize(P.grey(img), side, side).astype(float)
    g = P.separable(g, P.gaussian(13, 2.0), "edge")
    g = _median(g)
    out = []
    full = P.grey(P.resize(img, side, side))
    for mask in (g > threshold, g <= threshold):
        label, n = P.components(mask)
        sizes = np.bincount(label.ravel(), minlength=n + 1)
        for k in np.flatnonzero(sizes > least):
            if k:
                own = label == k
                y, x = np.flatnonzero(own.any(1)), np.flatnonzero(own.any(0))
                part = P.resize(full[y.min() : y.max() + 1, x.min() : x.max() + 1], 9, 8)
                out.append(part[:, 1:] > part[:, :-1])
    return out or [difference(img)]


def segments_alike(a: list[np.ndarray], b: list[np.ndarray], most=16) -> float:
    d = np.array([[int((x != y).sum()) for y in b] for x in a])
    return float(min((d.min(1) <= most).mean(), (d.min(0) <= most).mean()))


HASHES = {
    "pdq": pdq, "phash": perceptual, "dhash": difference, "ahash": average, "whash": wavelet, "blockhash": block, "phashSimple": perceptual_simple,
    "dhashVertical": difference_vertical, "whashDb4": wavelet_db4, "colorhash": colour, "blockMean0": block_mean,
    "blockMean1": lambda x: block_mean(x, True), "marrHildreth": marr_hildreth,
}

#: Pairwise tests that aren't a plain Hamming distance.
COMPARED = {
    "pdqDihedral": P.Described(pdq_variants, lambda x, y: float(min((x["original"] != v).sum() for v in y.values()))),
    "cropResistant": P.Described(segments, segments_alike),
    "radialVariance": P.Described(radial_variance, radial_correlation),
    "colorMoment": P.Described(colour_moments, lambda x, y: float(np.sqrt(((x - y) ** 2).sum()) * 1e4)),
}
KERNELS = {k: P.Described(f, lambda x, y: float((x != y).sum())) for k, f in HASHES.items()} | COMPARED

# ---- the same hashes of many rasters of one size: greys (rasters, rows, columns), or planes of red, green and blue -----------


def _perceptual_many(grey: np.ndarray, n=8, factor=4) -> np.ndarray:
    g = P.resize_many(grey, n * factor, n * factor).astype(float)
    low = _cosines(_cosines(g.swapaxes(1, 2)).swapaxes(1, 2))[:, :n, :n].reshape(len(g), -1)
    return low > np.median(low, 1, keepdims=True)


def _difference_many(grey: np.ndarray, n=8) -> np.ndarray:
    g = P.resize_many(grey, n + 1, n)
    return (g[..., 1:] > g[..., :-1]).reshape(len(g), -1)


@lru_cache(maxsize=16)
def _bands(n: int, side: int, step: int) -> list[tuple[int, int, np.ndarray]]:
    """For each band of ``step`` enlarged rows: its source rows' range, and weights of these and (last) of a half to round by; 32-bit if they have few bits."""
    w = P._weights(n, side, "bilinear") if n != side else np.eye(side)
    few = not (w * 2**13 % 1).any()
    out = []
    for i in range(0, side, step):
        used = np.flatnonzero(w[i : i + step].any(0))
        a, b = used[0], used[-1] + 1
        out.append((a, b, np.hstack([w[i : i + step, a:b], np.ones((step, 1))]).astype(np.float32 if few else float)))
    return out


def _block_mean_many(grey: np.ndarray, side=256, step=16) -> np.ndarray:
    """Enlarged, rounded and summed up a band of blocks at a time; sums are whole and below 2^24."""
    n, h, w = grey.shape
    bands = _bands(h, side, step)
    kind = bands[0][2].dtype
    x = grey
    if w != side:
        few = np.float32 if _bands(w, side, step)[0][2].dtype == np.float32 else float
        x = grey.reshape(-1, w).astype(few) @ P._weights(w, side, "bilinear").T.astype(few)
        x += few(0.5)
        x = np.floor(x, out=x).reshape(n, h, side)
    x = x.astype(kind, copy=False)
    half = np.full((n, 1, side), 0.5, kind)
    sums = np.empty((n, side // step, side))
    for i, (a, b, weights) in enumerate(bands):
        z = weights @ np.concatenate([x[:, a:b], half], 1)
        sums[:, i] = np.floor(z, out=z).sum(1)
    sums = sums.reshape(n, -1, step).sum(2)
    return sums * (side // step) ** 2 >= sums.sum(1, keepdims=True)


def _pdq_many(planes: np.ndarray) -> np.ndarray:
    _, n, h, w = planes.shape
    if max(h, w) > 128:  # windows of more than a cell
        return np.array([pdq(np.moveaxis(planes[:, i], 0, -1)).ravel() for i in range(n)])
    x = P.luma(np.ascontiguousarray(np.moveaxis(planes, 0, -1)).reshape(-1, 3)).reshape(n, h, w)
    for axis in (2, 1) * 2:  # sums' differences, rounded as with wider windows
        c = x.cumsum(axis)
        x = c.copy()
        if axis == 2:
            x[..., 1:] -= c[..., :-1]
        else:
            x[:, 1:] -= c[:, :-1]
    if (h, w) != (64, 64):
        yy, xx = (((np.arange(64) + 0.5) * k / 64).astype(int) for k in (h, w))
        x = x[:, yy[:, None], xx]
    d = P.dct_matrix(64)[1:17]
    c = (d @ x @ d.T).reshape(n, -1)
    return c > np.sort(c, 1)[:, 127:128]


#: Bits (rasters, bits) of planes and their greys, in the order that HASHES has them.
HASHES_MANY = {
    "phash": lambda planes, grey: _perceptual_many(grey), "dhash": lambda planes, grey: _difference_many(grey),
    "pdq": lambda planes, grey: _pdq_many(planes), "blockMean0": lambda planes, grey: _block_mean_many(grey),
}
