"""Known invisible watermarks: bits read from blocks of the U plane's Haar approximation, by vote."""

from __future__ import annotations

import numpy as np

#: The 48-bit message of a public image pipeline, and a text mark.
KNOWN = {
    "sdxl": [int(c) for c in "101100111110110010010000011110111011000110011110"],
    "sd-v1": np.unpackbits(np.frombuffer(b"StableDiffusionV1", np.uint8)).tolist(),
}
SCALE, BLOCK = 36.0, 4


def block_bits(img: np.ndarray) -> np.ndarray:
    """A bit for each 4 x 4 block of the approximation: where the largest value falls in a scale step."""
    h, w = img.shape[0] // 4 * 4, img.shape[1] // 4 * 4
    x = img[:h, :w].astype(float)
    u = 0.492 * (x[..., 2] - (0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2])) + 128
    low = (u[0::2, 0::2] + u[1::2, 0::2] + u[0::2, 1::2] + u[1::2, 1::2]) / 2
    n, m = low.shape[0] // BLOCK, low.shape[1] // BLOCK
    cells = low[: n * BLOCK, : m * BLOCK].reshape(n, BLOCK, m, BLOCK).swapaxes(1, 2).reshape(n * m, BLOCK * BLOCK)
    top = np.abs(cells[:, 1:]).max(1)
    return (top % SCALE) > SCALE / 2


def detect(img: np.ndarray) -> tuple[str | None, float]:
    """The best known mark and the share of its bits that the blocks' vote agrees with."""
    bits = block_bits(img)
    best: tuple[str | None, float] = (None, 0.0)
    for name, mark in KNOWN.items():
        n = len(mark)
        if len(bits) >= n:
            vote = np.array([bits[i::n].mean() for i in range(n)]) > 127 / 255
            share = float((vote == np.array(mark, bool)).mean())
            if share > best[1]:
                best = (name, share)
    return best


def insert(img: np.ndarray, mark: list[int]) -> np.ndarray:
    """The image with a mark in its blue channel's blocks (for tests)."""
    out = img.astype(float).copy()
    h, w = img.shape[0] // 8, img.shape[1] // 8
    for k in range(h * w):
        y, x = divmod(k, w)
        cell = out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8]
        luma = 0.299 * cell[..., 0] + 0.587 * cell[..., 1]
        # every value of the block at a quarter or three quarters of a scale step
        step = np.floor(256 / SCALE) * SCALE + SCALE * (0.75 if mark[k % len(mark)] else 0.25)
        cell[..., 2] = (((step / 2) - 128) / 0.492 + luma) / (1 - 0.114)
    return out


KERNELS = {"sdmark": lambda a, b: float(detect(a)[1] >= 0.95 and detect(b)[1] >= 0.95)}
