"""Texts as PNG images in a binary column, and low-frequency cosine hashes of them.

``encode_images`` stores each text losslessly as an 8-bit RGB image: UTF-8 bytes, padded with
spaces to a positive multiple of 192, 64 pixels a row. ``image_features`` reads the stored bytes
back (signature, every chunk's CRC-32, zlib stream, row filters undone in numpy) and computes the
feature. A damaged image raises ValueError; it is never skipped.

Null or empty text: one row of spaces. Only the id column passes through. Equal texts give equal images and features. An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Idat bytes per chunk.
IDAT = 1 << 16


def payload(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % ROW if text else ROW)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: bytes, level: int = 4, adaptive: bool = True) -> bytes:
    """An RGB PNG, 64 pixels wide.

    Each row takes the filter (none, left, up) of least absolute sum; without ``adaptive`` rows stay
    unfiltered.
    """
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    if not adaptive:
        out = np.zeros((len(rows), ROW + 1), np.uint8)
        out[:, 1:] = rows
        return _file(out, level)
    left = rows.copy()
    left[:, 3:] -= rows[:, :-3]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = np.stack([np.minimum(x, 0 - x).sum(1, dtype=np.int64) for x in (rows, left, up)])
    kind = cost.argmin(0).astype(np.uint8)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.choose(kind[:, None], (rows, left, up))
    return _file(out, level)


def _file(out: np.ndarray, level: int) -> bytes:
    body = zlib.compress(out.tobytes(), level)
    head = struct.pack(">IIBBBBB", ROW // 3, len(out), 8, 2, 0, 0, 0)
    parts = [SIGNATURE, chunk(b"IHDR", head)]
    parts += [chunk(b"IDAT", body[i : i + IDAT]) for i in range(0, len(body), IDAT)]
    return b"".join([*parts, chunk(b"IEND", b"")])


def unfilter(raw: np.ndarray, bpp: int = 3) -> np.ndarray:
    """Undo PNG row filters. Rows of the kinds none, left and up are undone without a loop."""
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    left = kinds == 1
    if left.any():
        n, width = int(left.sum()), out.shape[1]
        out[left] = np.cumsum(out[left].reshape(n, width // bpp, bpp), axis=1, dtype=np.uint8).reshape(n, width)
    if (kinds <= 2).all():
        # a row of kind up adds to the row above, back to the last row of another kind
        sums = np.vstack([np.zeros((1, out.shape[1]), np.uint8), np.cumsum(out, axis=0, dtype=np.uint8)])
        at = np.arange(len(kinds))
        base = np.maximum.accumulate(np.where(kinds == 2, 0, at))
        return sums[1:] - sums[base]
    zero = np.zeros(out.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        above = out[y - 1] if y else zero
        if kind == 2:
            out[y] += above
        elif kind > 2:
            line = out[y].astype(np.int32)
            up = above.astype(np.int32)
            for x in range(0, len(line), bpp):
                a = line[x - bpp : x] if x else np.zeros(bpp, np.int32)
                b = up[x : x + bpp]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x - bpp : x] if x else np.zeros(bpp, np.int32)
                    d = np.stack([np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)])
                    guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], b, c))
                line[x : x + bpp] = (line[x : x + bpp] + guess) & 255
            out[y] = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples as (height, width, 3); raises ValueError on any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or at + 12 + n > len(data):
            raise ValueError("cut off")
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("unsupported or incomplete image")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width * 3 + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(height, width * 3 + 1)).reshape(height, width, 3)


def _basis(n: int, k: int) -> np.ndarray:
    i = np.arange(n)
    return np.cos(np.pi * (2 * i + 1)[None, :] * np.arange(k)[:, None] / (2 * n))


_COS = _basis(32, 9)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits of the lowest cosine coefficients (without the first of each axis) above their median.

    The grey image is averaged down to 32 x 32 first (rows repeat where there are fewer).
    """
    grey = image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    h, w = grey.shape
    edges = (np.arange(32) * h) // 32
    heights = np.maximum(np.diff(np.append(edges, h)), 1)
    rows = grey if h == 32 else (np.add.reduceat(grey, edges, axis=0) if h > 32 else grey[edges])
    if h > 32:
        rows = rows / heights[:, None]
    cells = rows.reshape(32, 32, w // 32).mean(2)
    low = (_COS @ cells @ _COS.T)[1:, 1:].ravel()
    bits = low > np.median(low)
    return np.packbits(bits).tobytes().hex()


ENCODED = "n_bytes long, media binary"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 4) -> DataFrame:
    """id, n_bytes (of the text) and media (PNG bytes)."""

    def fn(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        yield {id_col: batch.column(0), "n_bytes": [len(x) for x in texts], "media": [encode_png(payload(x), level) for x in texts]}

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, fn, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {ENCODED}", "text")


def image_features(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored images back; payload facts, the stored form's digest and the cosine hash."""

    def fn(batch: pa.RecordBatch):
        out: dict = {id_col: batch.column(0), "n_bytes": batch.column(1), "payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
        for media in batch.column(2).to_pylist():
            image = decode_png(media)
            samples = image.tobytes()
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-16:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(cosine_hash(image))
        yield out

    images = images.select(id_col, "n_bytes", "media")
    return map_batches(images, fn, f"`{id_col}` {images.schema[0].dataType.simpleString()}, {FEATURES}", "media")
