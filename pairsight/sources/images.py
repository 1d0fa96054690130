"""Image files: decoding of PNG, BMP and PPM, and scans of JPEG, PNG and WebP containers.

JPEG and WebP pictures can't be decoded here (no codec); their containers are read all the same.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            break
        out.append((kind, body))
        at += 12 + n
        if kind == b"IEND":
            break
    return out


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    kinds, rows = raw[:, 0], raw[:, 1:].astype(np.int64)
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.int64)
    for y, kind in enumerate(kinds):
        line = rows[y]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, bpp), 0).reshape(-1) & 255
        elif kind == 2:
            out[y] = (line + above) & 255
        else:
            cur = out[y]
            for x in range(0, len(line), bpp):
                a = cur[x - bpp : x] if x else np.zeros(bpp, np.int64)
                b, c = above[x : x + bpp], above[x - bpp : x] if x else np.zeros(bpp, np.int64)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                cur[x : x + bpp] = (line[x : x + bpp] + guess) & 255
        above = out[y]
    return out.astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """h x w x 3 over white; 8-bit grey, grey-alpha, palette, RGB and RGBA, not interlaced."""
    chunks = png_chunks(data)
    head = dict(chunks)[b"IHDR"]
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit images without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT")), np.uint8).reshape(h, w * bands + 1)
    px = _unfilter(raw, bands).reshape(h, w, bands)
    if kind == 3:
        table = np.frombuffer(dict(chunks)[b"PLTE"], np.uint8).reshape(-1, 3)
        return table[px[..., 0]]
    colour = np.repeat(px[..., :1], 3, -1) if kind in (0, 4) else px[..., :3]
    if kind in (4, 6):
        alpha = px[..., -1:].astype(float) / 255
        colour = np.floor(colour * alpha + 255 * (1 - alpha) + 0.5).astype(np.uint8)
    return colour


def encode_png(img: np.ndarray, text: dict[str, str] | None = None) -> bytes:
    """An RGB file, with text chunks if given."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    h, w = img.shape[:2]
    raw = np.zeros((h, w * 3 + 1), np.uint8)
    raw[:, 1:] = img.reshape(h, w * 3)
    notes = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace")) for k, v in (text or {}).items())
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + notes + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def decode_ppm(data: bytes) -> np.ndarray:
    parts = data.split(None, 4)
    if parts[0] != b"P6" or int(parts[3]) != 255:
        raise ValueError("only binary 8-bit PPM")
    w, h = int(parts[1]), int(parts[2])
    return np.frombuffer(data[-w * h * 3 :], np.uint8).reshape(h, w, 3)


def decode_bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    w, h = struct.unpack_from("<ii", data, 18)
    bits = struct.unpack_from("<H", data, 28)[0]
    if bits not in (24, 32):
        raise ValueError("only 24 and 32-bit BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (px[::-1] if h > 0 else px)[..., 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    if data[:8] == PNG:
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:2] == b"P6":
        return decode_ppm(data)
    raise ValueError("no decoder for this format")


#: Chunks and segments that hold the picture itself.
PNG_PICTURE = frozenset((b"IHDR", b"PLTE", b"tRNS", b"IDAT", b"acTL", b"fcTL", b"fdAT"))
WEBP_PICTURE = frozenset((b"VP8 ", b"VP8L", b"ALPH", b"ANMF"))


def parse_container(data: bytes) -> dict:
    """format, segments (name, size), payload (digest of the picture's own bytes), tables, text, c2pa."""
    info: dict = {"format": "unknown", "segments": [], "payload": None, "tables": [], "text": {}, "c2pa": b"jumb" in data or b"C2PA" in data}
    picture = hashlib.sha256()
    if data[:8] == PNG:
        info["format"] = "PNG"
        for kind, body in png_chunks(data):
            info["segments"].append((kind.decode("latin-1"), len(body)))
            if kind in PNG_PICTURE:
                picture.update(kind + body)
            elif kind == b"tEXt" and b"\0" in body:
                key, value = body.split(b"\0", 1)
                info["text"][key.decode("latin-1")] = value.decode("latin-1")
            elif kind == b"iTXt" and b"\0" in body:
                key, rest = body.split(b"\0", 1)
                info["text"][key.decode("latin-1")] = rest.split(b"\0")[-1].decode("utf-8", "replace")
    elif data[:2] == b"\xff\xd8":
        info["format"], at = "JPEG", 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            info["segments"].append((f"{kind:02X}", len(body)))
            if kind == 0xDB:
                k = 0
                while k + 65 <= len(body) and not body[k] >> 4:
                    info["tables"].append((body[k] & 15, list(body[k + 1 : k + 65])))
                    k += 65
            if not 0xE0 <= kind <= 0xEF and kind != 0xFE:
                picture.update(bytes([kind]) + body)
            at += 2 + size
            if kind == 0xDA:
                picture.update(data[at:])
                break
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        info["format"], at = "WebP", 12
        while at + 8 <= len(data):
            kind, size = struct.unpack_from("<4sI", data, at)
            body = data[at + 8 : at + 8 + size]
            info["segments"].append((kind.decode("latin-1"), size))
            if kind in WEBP_PICTURE:
                picture.update(kind + body)
            at += 8 + size + size % 2
    else:
        return info
    info["payload"] = picture.hexdigest()
    return info


CONTAINER = "format string, payload string, c2pa boolean, segments array<struct<name: string, size: long>>, text map<string, string>"


def read_containers(files: DataFrame, id_col: str, data_col: str = "content") -> DataFrame:
    """Container facts of a binary column (such as the ``binaryFile`` source gives)."""

    def run(batches):
        for batch in batches:
            infos = [parse_container(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([i["format"] for i in infos]), pa.array([i["payload"] for i in infos], pa.string()), pa.array([i["c2pa"] for i in infos]),
                    pa.array([[{"name": n, "size": s} for n, s in i["segments"]] for i in infos], pa.list_(pa.struct([("name", pa.string()), ("size", pa.int64())]))),
                    pa.array([list(i["text"].items()) for i in infos], pa.map_(pa.string(), pa.string())),
                ],
                names=[id_col, "format", "payload", "c2pa", "segments", "text"],
            )

    source = files.select(F.col(id_col), F.col(data_col))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {CONTAINER}")


def carve(data: bytes) -> list[bytes]:
    """PNG and JPEG files inside another file, in order."""
    out, at = [], 0
    while True:
        p, j = data.find(PNG, at), data.find(b"\xff\xd8\xff", at)
        if p < 0 and j < 0:
            return out
        if j < 0 or 0 <= p < j:
            end = data.find(b"IEND", p)
            if end < 0:
                return out
            out.append(data[p : end + 8])
            at = end + 8
        else:
            end = data.find(b"\xff\xd9", j)
            if end < 0:
                return out
            out.append(data[j : end + 2])
            at = end + 2
