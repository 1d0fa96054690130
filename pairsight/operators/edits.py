"""Edits of rasters: as index arithmetic over long pixels, and as numpy for larger rasters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from . import planes as P


def pixel_edits(pixels: DataFrame, side: int) -> DataFrame:
    """(doc_id, edit, y, x, r, g, b): seven edits in one pass over the cells."""
    y, x, r, g, b = (F.col(c) for c in ("y", "x", "r", "g", "b"))
    last = side - 1
    grey = C.grey(r, g, b)
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v))).cast("int")
    edits = {
        "mirror": (y, last - x, r, g, b), "flip": (last - y, x, r, g, b), "rot90": (x, last - y, r, g, b), "grey": (y, x, grey, grey, grey),
        "invert": (y, x, 255 - r, 255 - g, 255 - b), "contrast": (y, x, *[clip((2 * c - 255) * 0.8 + 128) for c in (r, g, b)]),
        "brightness": (y, x, *[clip(c * 1.2 + 0.5) for c in (r, g, b)]),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("edit"), *[v.cast("int").alias(n) for n, v in zip(("y", "x", "r", "g", "b"), e, strict=True)]) for k, e in edits.items()])
    return pixels.select("doc_id", F.explode(rows).alias("e")).select("doc_id", "e.*")


def box_blur(img: np.ndarray, radius: int, passes: int = 3) -> np.ndarray:
    k = np.ones(2 * radius + 1) / (2 * radius + 1)
    x = [c.astype(float) for c in np.moveaxis(img, -1, 0)]
    for _ in range(passes):
        x = [P.separable(c, k, "edge") for c in x]
    return np.clip(np.round(np.stack(x, -1)), 0, 255).astype(np.uint8)


def noise(img: np.ndarray, sigma: float, seed: int = 1234) -> np.ndarray:
    return np.clip(np.round(img + np.random.default_rng(seed).normal(0, sigma, img.shape)), 0, 255).astype(np.uint8)


def hue_shift(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turn in the chroma plane, keeping luma."""
    m = np.array([[0.299, 0.587, 0.114], [0.5959, -0.2746, -0.3213], [0.2115, -0.5227, 0.3112]])
    t = np.radians(degrees)
    turn = np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
    return np.clip(np.round(img @ (np.linalg.inv(m) @ turn @ m).T), 0, 255).astype(np.uint8)


def collage(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = min(a.shape[0], b.shape[0])
    return np.concatenate([P.resize(z, max(1, round(z.shape[1] * h / z.shape[0])), h, "bilinear") for z in (a, b)], 1)


def _part(img, y0, y1, x0, x1):
    h, w = img.shape[:2]
    return img[int(h * y0) : max(int(h * y0) + 1, int(h * y1)), int(w * x0) : max(int(w * x0) + 1, int(w * x1))]


#: The benchmark's edits.
EDITS = {
    "small40": lambda z: P.resize(z, max(1, round(z.shape[1] * 0.4)), max(1, round(z.shape[0] * 0.4)), "bicubic"),
    "crop50": lambda z: _part(z, 0.146, 0.854, 0.146, 0.854), "corner30": lambda z: _part(z, 0, 0.55, 0, 0.55),
    "flip": lambda z: z[:, ::-1], "rot90": lambda z: np.rot90(z), "hue": lambda z: hue_shift(z, 60), "gray": lambda z: np.repeat(P.grey(z)[..., None], 3, -1),
    "noise": lambda z: noise(z, 20), "blur": lambda z: box_blur(z, 2),
    "pixelate": lambda z: P.resize(P.resize(z, max(1, z.shape[1] // 12), max(1, z.shape[0] // 12), "box"), z.shape[1], z.shape[0], "box"),
    "contrast": lambda z: np.clip(np.round((z.astype(float) - 128) * 1.6 + 128), 0, 255).astype(np.uint8),
    "frame": lambda z: np.pad(z, ((z.shape[0] // 10,) * 2, (z.shape[1] // 10,) * 2, (0, 0)), constant_values=255),
}


# ---- the same edits of many rasters of one size: planes of red, green and blue, each (rasters, rows, columns) ----------------


@lru_cache(maxsize=8)
def _boxes(n: int, radius: int, passes: int) -> np.ndarray:
    """Matrix of counts: sums over windows with the border repeated, so many times."""
    pad = np.pad(np.eye(n), ((radius, radius), (0, 0)), mode="edge")
    once = sum(pad[i : i + n] for i in range(2 * radius + 1))
    return np.linalg.matrix_power(once, passes).astype(np.float32)


def _blur_many(x: np.ndarray, radius: int = 2, passes: int = 3) -> np.ndarray:
    """Whole sums below 2^24, which 32 bits hold; no quotient comes so near a half that its rounding would depend on more."""
    h, w = x.shape[-2:]
    z = _boxes(h, radius, passes) @ (x.reshape(-1, w).astype(np.float32) @ _boxes(w, radius, passes).T).reshape(x.shape)
    z /= (2 * radius + 1) ** (2 * passes)
    return np.rint(z, out=z).astype(np.uint8)


@lru_cache(maxsize=8)
def _grain(h: int, w: int, sigma: float, seed: int = 1234) -> np.ndarray:
    return np.ascontiguousarray(np.moveaxis(np.random.default_rng(seed).normal(0, sigma, (h, w, 3)), -1, 0))[:, None]


def _noise_many(x: np.ndarray, sigma: float) -> np.ndarray:
    z = x + _grain(*x.shape[-2:], sigma)
    return np.clip(np.rint(z, out=z), 0, 255, out=z).astype(np.uint8)


def _hue_many(x: np.ndarray, degrees: float) -> np.ndarray:
    m = np.array([[0.299, 0.587, 0.114], [0.5959, -0.2746, -0.3213], [0.2115, -0.5227, 0.3112]])
    t = np.radians(degrees)
    turn = np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
    z = (np.linalg.inv(m) @ turn @ m) @ x.reshape(3, -1).astype(float)
    return np.clip(np.rint(z, out=z), 0, 255, out=z).astype(np.uint8).reshape(x.shape)


def _part_many(x: np.ndarray, *where: float) -> np.ndarray:
    return np.moveaxis(_part(np.moveaxis(x, (2, 3), (0, 1)), *where), (0, 1), (2, 3))


def _scaled_many(x: np.ndarray, k: float) -> np.ndarray:
    h, w = x.shape[-2:]
    return P.resize_many(x, max(1, round(w * k)), max(1, round(h * k)), "bicubic")


def _pixelate_many(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[-2:]
    return P.resize_many(P.resize_many(x, max(1, w // 12), max(1, h // 12), "box"), w, h, "box")


EDITS_MANY = {
    "small40": lambda x: _scaled_many(x, 0.4),
    "crop50": lambda x: _part_many(x, 0.146, 0.854, 0.146, 0.854), "corner30": lambda x: _part_many(x, 0, 0.55, 0, 0.55),
    "flip": lambda x: x[..., ::-1], "rot90": lambda x: np.rot90(x, axes=(2, 3)), "hue": lambda x: _hue_many(x, 60), "gray": lambda x: np.repeat(P.grey_many(x)[None], 3, 0),
    "noise": lambda x: _noise_many(x, 20), "blur": _blur_many, "pixelate": _pixelate_many,
    "contrast": lambda x: EDITS["contrast"](np.arange(256))[x],
    "frame": lambda x: np.pad(x, ((0, 0), (0, 0), (x.shape[2] // 10,) * 2, (x.shape[3] // 10,) * 2), constant_values=255),
}
