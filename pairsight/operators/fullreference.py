"""Full-reference similarity of two rasters of equal size (numpy arrays h x w x 3, 8 bits).

Every function returns a float, or None where the measure doesn't apply. As in the reference data
model B is stretched to A's size before, and measures that tell test from reference take A as the
reference.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import planes as P

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _ssim_maps(x, y, k, mode):
    f = lambda z: P.separable(z, k, mode)
    mx, my = f(x), f(y)
    vx, vy, vxy = f(x * x) - mx * mx, f(y * y) - my * my, f(x * y) - mx * my
    cs = (2 * vxy + C2) / (vx + vy + C2)
    return (2 * mx * my + C1) / (mx * mx + my * my + C1) * cs, cs


def ssim_plane(x: np.ndarray, y: np.ndarray) -> float:
    full, _ = _ssim_maps(x, y, P.gaussian(11, 1.5), "symmetric")
    inner = full[5:-5, 5:-5]
    return float(inner.mean() if inner.size else full.mean())


def ssim(a, b):
    return ssim_plane(P.luma(a), P.luma(b))


#: Weights of the five scales.
SCALES = np.array([0.0448, 0.2856, 0.3001, 0.2363, 0.1333])


def msssim(a, b):
    x, y = P.luma(a), P.luma(b)
    n = 5
    while n > 1 and min(x.shape) <= 10 * 2 ** (n - 1):
        n -= 1
    w = SCALES[:n] / (SCALES[:n].sum() if n < 5 else 1)
    out = 1.0
    for i in range(n):
        k = P.gaussian(11, 1.5) if min(x.shape) >= 11 else P.gaussian(min(x.shape), 1.5)
        full, cs = _ssim_maps(x, y, k, None)
        out *= max(0.0, float((full if i == n - 1 else cs).mean())) ** w[i]
        x, y = P.pool(x), P.pool(y)
    return out


def psnr(a, b):
    mse = float(((a.astype(float) - b) ** 2).mean())
    return float("inf") if mse == 0 else 10 * np.log10(65025 / mse)


def ncc(a, b):
    x, y = P.luma(a), P.luma(b)
    dx, dy = x - x.mean(), y - y.mean()
    vx, vy = (dx * dx).sum(), (dy * dy).sum()
    if vx < 1e-9 and vy < 1e-9:
        return float(abs(x.mean() - y.mean()) < 1e-9)
    return float((dx * dy).sum() / np.sqrt(vx * vy)) if vx > 1e-9 and vy > 1e-9 else 0.0


def uqi(a, b, n=8):
    x, y = P.luma(a), P.luma(b)
    if min(x.shape) < n:
        return None
    k = n * n
    sx, sy, sxy, s2 = P.box_sums(x, n), P.box_sums(y, n), P.box_sums(x * y, n), P.box_sums(x * x + y * y, n)
    top = 4 * (k * sxy - sx * sy) * sx * sy
    spread, level = k * s2 - (sx * sx + sy * sy), sx * sx + sy * sy
    q = np.ones_like(top)
    flat = (np.abs(spread) < 1e-9) & (level > 1e-9)
    q[flat] = (2 * sx * sy / np.where(level > 1e-9, level, 1))[flat]
    full = (np.abs(spread) >= 1e-9) & (level > 1e-9)
    q[full] = (top / np.where(full, spread * level, 1))[full]
    return float(q.mean())


def gmsd(a, b, t=170.0):
    x, y = P.pool(P.luma(a)), P.pool(P.luma(b))
    m = P.alike(P.gradient(x, P.PREWITT), P.gradient(y, P.PREWITT), t)
    return float(m.std(ddof=1))


def delta_e(a, b):
    return float(P.ciede2000(P.lab(a), P.lab(b)).mean())


def changed(a, b, least=5.0):
    return float((P.ciede2000(P.lab(a), P.lab(b)) > least).mean())


def tile_rms(a, b, tiles=4):
    d = (a.astype(float) - b) / 255
    h, w = d.shape[0] // tiles * tiles, d.shape[1] // tiles * tiles
    t = (d[:h, :w] ** 2).reshape(tiles, h // tiles, tiles, w // tiles, 3).mean((1, 3, 4))
    return float(np.sqrt(t.max()))


@lru_cache(maxsize=8)
def _log_gabor(h: int, w: int, scales=4, orientations=4, shortest=6.0, mult=2.0, sigma=0.55, spread=1.2):
    fy, fx = np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij")
    radius = np.hypot(fx, fy)
    radius[0, 0] = 1
    theta = np.arctan2(-fy, fx)
    low = 1 / (1 + (np.hypot(fx, fy) / 0.45) ** 30)
    radial = []
    for s in range(scales):
        g = np.exp(-(np.log(radius * shortest * mult**s) ** 2) / (2 * np.log(sigma) ** 2)) * low
        g[0, 0] = 0
        radial.append(g)
    angular = []
    for o in range(orientations):
        at = o * np.pi / orientations
        d = np.abs(np.arctan2(np.sin(theta - at), np.cos(theta - at)))
        angular.append(np.exp(-(d**2) / (2 * (np.pi / orientations / spread) ** 2)))
    return np.array(radial), np.array(angular)


def phase_congruency(x: np.ndarray, k: float = 2.0) -> np.ndarray:
    """Kovesi's measure, summed over orientations."""
    radial, angular = _log_gabor(*x.shape)
    f, eps = np.fft.fft2(x), 1e-4
    energy_all, amplitude_all = np.zeros(x.shape), np.zeros(x.shape)
    for wing in angular:
        bank = radial * wing
        eo = np.fft.ifft2(f[None] * bank)
        amplitude = np.abs(eo)
        total = eo.sum(0)
        size = np.abs(total) + eps
        re, im = total.real / size, total.imag / size
        energy = (eo.real * re + eo.imag * im - np.abs(eo.real * im - eo.imag * re)).sum(0)
        # noise, from the median energy of the finest scale
        mean = -np.median(amplitude[0] ** 2) / np.log(0.5)
        power = mean / (bank[0] ** 2).sum()
        spatial = np.fft.ifft2(bank).real * np.sqrt(x.size)
        est = (spatial**2).sum()
        cross = sum((spatial[i] * spatial[j]).sum() for i in range(len(bank)) for j in range(i))
        noise = np.sqrt(max(0.0, 2 * power * est + 4 * power * cross) / 2)
        t = (noise * np.sqrt(np.pi / 2) + k * np.sqrt((2 - np.pi / 2) * noise**2)) / 1.7
        energy_all += np.maximum(energy - t, 0)
        amplitude_all += amplitude.sum(0)
    return energy_all / (amplitude_all + eps)


def fsim(a, b):
    k = max(1, round(min(a.shape[:2]) / 256))
    qa, qb = (np.stack([P.pool(c, k) for c in np.moveaxis(P.yiq(z), -1, 0)]) for z in (a, b))
    pa, pb = phase_congruency(qa[0]), phase_congruency(qb[0])
    ga, gb = (P.gradient(q[0], P.SCHARR) for q in (qa, qb))
    s = P.alike(pa, pb, 0.85) * P.alike(ga, gb, 160)
    chroma = P.alike(qa[1], qb[1], 200) * P.alike(qa[2], qb[2], 200)
    s = s * np.real(np.power(chroma.astype(complex), 0.03))
    m = np.maximum(pa, pb)
    return float((s * m).sum() / m.sum()) if m.sum() > 0 else 1.0


def _saliency(img: np.ndarray) -> np.ndarray:
    h, w = img.shape[:2]
    lab = P.lab(img)
    fy, fx = np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij")
    r = np.hypot(fx, fy)
    g = np.exp(-(np.log(np.where(r > 0, r, 1) / 0.021) ** 2) / (2 * 1.34**2)) * (r > 0)
    s = np.sqrt(sum(np.fft.ifft2(np.fft.fft2(c) * g).real ** 2 for c in np.moveaxis(lab, -1, 0)))
    y, x = np.mgrid[:h, :w]
    centre = np.exp(-((y - h / 2) ** 2 + (x - w / 2) ** 2) / 145**2)
    unit = lambda c: (c - c.min()) / (np.ptp(c) or 1)
    warm = 1 - np.exp(-(unit(lab[..., 1]) ** 2 + unit(lab[..., 2]) ** 2) / 0.25**2)
    return unit(s * centre * warm)


def vsi(a, b):
    sa, sb = _saliency(a), _saliency(b)
    m = np.array([[0.06, 0.63, 0.27], [0.3, 0.04, -0.35], [0.34, -0.6, 0.17]])
    la, lb = a.astype(float) @ m.T, b.astype(float) @ m.T
    g = P.alike(P.gradient(la[..., 0], P.SCHARR), P.gradient(lb[..., 0], P.SCHARR), 386)
    chroma = P.alike(la[..., 1], lb[..., 1], 130) * P.alike(la[..., 2], lb[..., 2], 130)
    s = P.alike(sa, sb, 1.27) * g**0.4 * np.real(np.power(chroma.astype(complex), 0.02))
    w = np.maximum(sa, sb)
    return float((s * w).sum() / w.sum()) if w.sum() > 0 else 1.0


def haarpsi(a, b, c=30.0, alpha=4.2):
    qa, qb = (np.moveaxis(P.yiq(z), -1, 0) for z in (a, b))
    qa, qb = ([P.pool(p) for p in q] for q in (qa, qb))
    logistic = lambda x: 1 / (1 + np.exp(-alpha * x))

    def haar(x, n):
        k = np.ones((2**n, 2**n)) / 2**n
        k[: 2 ** (n - 1)] *= -1
        return np.abs(P.correlate(x, k, "constant")), np.abs(P.correlate(x, k.T, "constant"))

    la, lb = ([haar(q[0], n) for n in (1, 2, 3)] for q in (qa, qb))
    top, bottom = 0.0, 0.0
    for o in range(2):
        local = sum(P.alike(la[n][o], lb[n][o], c * c) for n in (0, 1)) / 2
        w = np.maximum(la[2][o], lb[2][o])
        top, bottom = top + (logistic(local) * w).sum(), bottom + w.sum()
    local = sum(P.alike(np.abs(P.pool(np.pad(qa[k], ((0, 1), (0, 1)), mode="edge"), 1)), np.abs(P.pool(np.pad(qb[k], ((0, 1), (0, 1)), mode="edge"), 1)), c * c) for k in (1, 2))[:-1, :-1] / 2
    w = (np.maximum(la[2][0], lb[2][0]) + np.maximum(la[2][1], lb[2][1])) / 2
    top, bottom = top + (logistic(local) * w).sum(), bottom + w.sum()
    if bottom == 0:
        return 1.0
    x = np.clip(top / bottom, 1e-9, 1 - 1e-9)
    return float((np.log(x / (1 - x)) / alpha) ** 2)


def vif(a, b, noise=2.0):
    x, y = P.luma(a), P.luma(b)  # x is the reference
    if min(x.shape) < 41:
        return None
    top = bottom = 0.0
    for scale in range(1, 5):
        n = 2 ** (4 - scale + 1) + 1
        k = P.gaussian(n, n / 5)
        if scale > 1:
            x, y = P.separable(x, k, None)[::2, ::2], P.separable(y, k, None)[::2, ::2]
        f = lambda z, k=k: P.separable(z, k, None)
        mx, my = f(x), f(y)
        vx, vy, vxy = np.maximum(f(x * x) - mx * mx, 0), np.maximum(f(y * y) - my * my, 0), f(x * y) - mx * my
        g = vxy / (vx + 1e-10)
        sv = vy - g * vxy
        g, sv = np.where(vx < 1e-10, 0, g), np.where(vx < 1e-10, vy, sv)
        vx = np.where(vx < 1e-10, 0, vx)
        g, sv = np.where(vy < 1e-10, 0, g), np.where(vy < 1e-10, 0, sv)
        sv = np.where(g < 0, vy, sv)
        g = np.maximum(g, 0)
        sv = np.maximum(sv, 1e-10)
        top += np.log10(1 + g * g * vx / (sv + noise)).sum()
        bottom += np.log10(1 + vx / noise).sum()
    return float(top / bottom) if bottom > 0 else 1.0


def nmi(a, b, bins=100):
    x, y = P.grey(a).astype(float), P.grey(b).astype(float)

    def binned(z):
        span = z.max() - z.min()
        return np.minimum((z - z.min()) / (span or 1) * bins, bins - 1).astype(int)

    joint = np.bincount((binned(x) * bins + binned(y)).ravel(), minlength=bins * bins).reshape(bins, bins) / x.size
    h = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    hxy = h(joint)
    return float((h(joint.sum(1)) + h(joint.sum(0))) / hxy) if hxy > 0 else 1.0


def dss(a, b, size=8, spread=1.55, worst=0.05):
    d = P.dct_matrix(size)

    def blocks(z):
        z = P.luma(z)
        h, w = z.shape[0] // size * size, z.shape[1] // size * size
        t = z[:h, :w].reshape(h // size, size, w // size, size).swapaxes(1, 2)
        return d @ t @ d.T

    x, y = blocks(a), blocks(b)
    i, j = np.mgrid[:size, :size]
    weight = np.exp(-(i**2 + j**2) / (2 * spread**2))
    weight[weight < 1e-2] = 0
    u, v = np.nonzero(weight)
    p, q = (np.ascontiguousarray(z[..., u, v].transpose(2, 0, 1)) for z in (x, y))
    g = P.gaussian(3, 1.5)

    def f(z):
        z = np.pad(z, ((0, 0), (1, 1), (1, 1)), mode="edge")
        z = z[..., :-2] * g[0] + z[..., 1:-1] * g[1] + z[..., 2:] * g[2]
        return z[:, :-2] * g[0] + z[:, 1:-1] * g[1] + z[:, 2:] * g[2]

    fp, fq = f(p), f(q)
    vx, vy, vxy = np.maximum(f(p * p) - fp**2, 0), np.maximum(f(q * q) - fq**2, 0), f(p * q) - fp * fq
    left = (2 * np.sqrt(vx * vy) + 300) / (vx + vy + 300)
    few = max(1, round(worst * left[0].size))
    lowest = lambda z: np.sort(z.reshape(len(z), -1), axis=1)[:, :few].mean(1)
    low, w = lowest(left), weight[u, v]
    first = (u == 0) & (v == 0)
    low[first] *= np.maximum(lowest(((vxy[first] + 1000) / (np.sqrt(vx[first] * vy[first]) + 1000))), 0)
    return float((w * low).sum() / w.sum())


def ms_gmsd(a, b, t=170.0):
    x, y = P.yiq(a)[..., 0], P.yiq(b)[..., 0]
    weights, total = (0.096, 0.596, 0.289, 0.019), 0.0
    for k, w in enumerate(weights):
        if k:
            x, y = P.pool(x), P.pool(y)
        if min(x.shape) < 3:
            break
        ga, gb = P.gradient(x, P.PREWITT), P.gradient(y, P.PREWITT)
        total += w * P.alike(ga, gb, t).std() ** 2
    return float(np.sqrt(total))


def mdsi(a, b, c1=140.0, c2=55.0, c3=550.0, alpha=0.6, q=0.25, o=0.25):
    k = max(1, round(min(a.shape[:2]) / 256))
    m = np.array([[0.2989, 0.587, 0.114], [0.3, 0.04, -0.35], [0.34, -0.6, 0.17]])
    x, y = ([P.pool(p, k) for p in np.moveaxis(z.astype(float) @ m.T, -1, 0)] for z in (a, b))
    gx, gy, gf = P.gradient(x[0], P.PREWITT), P.gradient(y[0], P.PREWITT), P.gradient((x[0] + y[0]) / 2, P.PREWITT)
    gs = P.alike(gx, gy, c1) + P.alike(gy, gf, c2) - P.alike(gx, gf, c2)
    cs = (2 * (x[1] * y[1] + x[2] * y[2]) + c3) / (x[1] ** 2 + y[1] ** 2 + x[2] ** 2 + y[2] ** 2 + c3)
    s = np.power((alpha * gs + (1 - alpha) * cs).astype(complex), q)
    return float(np.abs(s - s.mean()).mean() ** o)


# ---- edges ------------------------------------------------------------------------------------


def edges(img: np.ndarray, low=50, high=150) -> np.ndarray:
    """Canny's edges of the grey plane (Sobel, thinning, hysteresis)."""
    g = P.grey(img).astype(float)
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    gx, gy = P.correlate(g, k), P.correlate(g, k.T)
    mag = np.abs(gx) + np.abs(gy)
    pad = np.pad(mag, 1)
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    step = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    thin = np.zeros(mag.shape, bool)
    h, w = mag.shape
    for d, (dy, dx) in step.items():
        one, two = pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], pad[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        thin |= (turn == d) & (mag > one) & (mag >= two)
    weak = thin & (mag > low)
    label, n = P.components(weak, eight=True)
    strong = np.zeros(n + 1, bool)
    strong[np.unique(label[weak & (mag > high)])] = True
    strong[0] = False
    return strong[label]


def distances(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every cell to the nearest marked one."""
    h, w = mask.shape
    if not mask.any():
        return np.full((h, w), float(h + w))
    big = 1e12
    col = np.where(mask, 0.0, big)
    i = np.arange(h)
    down = np.min(col[None] + ((i[:, None] - i[None]) ** 2)[:, :, None], axis=1)
    j = np.arange(w)
    return np.sqrt(np.min(down[:, None, :] + ((j[:, None] - j[None]) ** 2)[None], axis=2))


def pratt_fom(a, b, alpha=1 / 9):
    ea, eb = edges(a), edges(b)
    if not ea.any() or not eb.any():
        return None if not ea.any() and not eb.any() else 0.0
    da, db = distances(ea), distances(eb)
    most = max(ea.sum(), eb.sum())
    one = (1 / (1 + alpha * db[ea] ** 2)).sum() / most
    two = (1 / (1 + alpha * da[eb] ** 2)).sum() / most
    return float((one + two) / 2)


def mod_hausdorff(a, b):
    ea, eb = edges(a), edges(b)
    if not ea.any() or not eb.any():
        return None
    return float(max(distances(eb)[ea].mean(), distances(ea)[eb].mean()))


def ncd_bytes(x: bytes, y: bytes) -> float:
    import zlib

    def size(z: bytes) -> int:
        c = zlib.compressobj(-1, zlib.DEFLATED, -15)
        return len(c.compress(z) + c.flush())

    cx, cy, both = size(x), size(y), size(x + y)
    return (both - min(cx, cy)) / max(cx, cy)


def ncd(a, b):
    return ncd_bytes(P.resize(P.grey(a), 128, 128, "bilinear").tobytes(), P.resize(P.grey(b), 128, 128, "bilinear").tobytes())


KERNELS = {
    "ssim": ssim, "msssim": msssim, "psnr": psnr, "ncc": ncc, "uqi": uqi, "gmsd": gmsd, "deltaE": delta_e, "changed": changed, "carlini": tile_rms,
    "fsim": fsim, "vsi": vsi, "haarpsi": haarpsi, "vif": vif, "nmi": nmi, "dss": dss, "msGmsd": ms_gmsd, "mdsi": mdsi, "prattFom": pratt_fom,
    "modHausdorff": mod_hausdorff, "ncd": ncd,
}
