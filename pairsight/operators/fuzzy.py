"""Fuzzy digests of byte strings: ssdeep, TLSH, Nilsimsa, LZJD, and their comparisons."""

from __future__ import annotations

import numpy as np

# ---- context-triggered piecewise hash ----------------------------------------------------------

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PRIME, _INIT, _WINDOW, _LENGTH = 0x01000193, 0x28021967, 7, 64


def rolling(data: np.ndarray) -> np.ndarray:
    """The 7-byte rolling hash at every position (sum, weighted sum and shifted xor, 32 bits)."""
    n = len(data)
    x = np.concatenate([np.zeros(_WINDOW, np.uint32), data.astype(np.uint32)])
    h1, h2, h3 = (np.zeros(n, np.uint32) for _ in range(3))
    for k in range(_WINDOW):
        b = x[_WINDOW - k : _WINDOW - k + n]
        h1 += b
        h2 += b * np.uint32(_WINDOW - k)
        h3 ^= b << np.uint32(5 * k)
    return h1 + h2 + h3


def ssdeep(data: bytes) -> str:
    roll = rolling(np.frombuffer(data, np.uint8)).tolist()
    size = 3
    while size * _LENGTH < len(data):
        size *= 2
    while True:
        one, two, f1, f2 = [], [], _INIT, _INIT
        for byte, r in zip(data, roll, strict=True):
            f1 = ((f1 * _PRIME) & 0xFFFFFFFF) ^ byte
            f2 = ((f2 * _PRIME) & 0xFFFFFFFF) ^ byte
            if r % size == size - 1:
                if len(one) < _LENGTH - 1:
                    one.append(B64[f1 & 63])
                    f1 = _INIT
                if r % (2 * size) == 2 * size - 1 and len(two) < _LENGTH // 2 - 1:
                    two.append(B64[f2 & 63])
                    f2 = _INIT
        if size > 3 and len(one) < _LENGTH // 2:
            size //= 2
            continue
        if roll and roll[-1] != 0:
            one.append(B64[f1 & 63])
            two.append(B64[f2 & 63])
        return f"{size}:{''.join(one)}:{''.join(two)}"


def _runs(s: str) -> str:
    out = []
    for c in s:
        if len(out) < 3 or not (out[-1] == out[-2] == out[-3] == c):
            out.append(c)
    return "".join(out)


def _score(a: str, b: str, size: int) -> int:
    if len(a) < _WINDOW or len(b) < _WINDOW or not {a[i : i + _WINDOW] for i in range(len(a) - 6)} & {b[i : i + _WINDOW] for i in range(len(b) - 6)}:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    score = 100 - 100 * (row[-1] * _LENGTH // (len(a) + len(b))) // _LENGTH
    return max(0, min(score, size // 3 * min(len(a), len(b))))


def ssdeep_compare(x: str, y: str) -> int:
    """0 to 100; digests compare only where their block sizes are equal or double."""
    (n, a1, a2), (m, b1, b2) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    a1, a2, b1, b2 = map(_runs, (a1, a2, b1, b2))
    if n == m:
        return 100 if a1 == b1 and a2 == b2 and len(a1) >= _WINDOW else max(_score(a1, b1, n), _score(a2, b2, 2 * n))
    if n == 2 * m:
        return _score(a1, b2, n)
    return _score(a2, b1, m) if m == 2 * n else 0


# ---- Nilsimsa ----------------------------------------------------------------------------------


def nilsimsa_table(target: int = 53) -> np.ndarray:
    """The permutation of bytes, by its generating rule."""
    out, j = [], 0
    for _ in range(256):
        j = (j * target + 1) & 255
        j += j
        if j > 255:
            j -= 255
        while j in out:
            j = (j + 1) & 255
        out.append(j)
    return np.array(out)


_T = nilsimsa_table()


def nilsimsa(data: bytes) -> np.ndarray:
    """256 bits: trigrams of a 5-byte window counted by bucket, a bit where the count is above the mean."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(b)
    acc = np.zeros(256, np.int64)

    def tran(x, y, z, k):
        return ((_T[(x + k) & 255] ^ (_T[y] * (2 * k + 1))) + _T[z ^ _T[k]]) & 255

    at = lambda k, need: b[need - k : n - k]
    for need, triples in ((2, ((0, 1, 2, 0),)), (3, ((0, 1, 3, 1), (0, 2, 3, 2))), (4, ((0, 1, 4, 3), (0, 2, 4, 4), (0, 3, 4, 5), (4, 1, 0, 6), (4, 3, 0, 7)))):
        if n > need:
            for x, y, z, k in triples:
                acc += np.bincount(tran(at(x, need), at(y, need), at(z, need), k), minlength=256)
    total = 1 if n == 3 else 4 if n == 4 else 8 * n - 28 if n > 4 else 0
    return acc > total / 256


def nilsimsa_score(x: np.ndarray, y: np.ndarray) -> int:
    return 128 - int((x != y).sum())


# ---- TLSH --------------------------------------------------------------------------------------


def pearson_table(seed: int = 1) -> np.ndarray:
    """A permutation of bytes by rule. Digests of other tools need their table as a parameter."""
    return np.random.default_rng(seed).permutation(256)


_PEARSON = pearson_table()
TRIPLES = ((2, 0, 1, 2), (3, 0, 1, 3), (5, 0, 2, 3), (7, 0, 2, 4), (11, 0, 1, 4), (13, 0, 3, 4))


def tlsh(data: bytes, table: np.ndarray = _PEARSON) -> dict | None:
    """checksum, length code, quartile ratios and 128 two-bit buckets; None for short or plain data."""
    if len(data) < 256:
        return None
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(b)
    at = lambda k: b[4 - k : n - k]
    counts = np.zeros(256, np.int64)
    for salt, x, y, z in TRIPLES:
        h = table[table[table[table[salt] ^ at(x)] ^ at(y)] ^ at(z)]
        counts += np.bincount(h, minlength=256)
    check = 0
    for cur, prev in zip(at(0).tolist(), at(1).tolist(), strict=True):
        check = int(table[table[table[table[0] ^ cur] ^ prev] ^ check])
    c = counts[:128]
    if (c > 0).sum() <= 64:
        return None
    s = np.sort(c)
    q1, q2, q3 = int(s[31]), int(s[63]), int(s[95])
    if q3 == 0:
        return None
    code = (c > q1).astype(int) + (c > q2) + (c > q3)
    log = np.log
    length = int(log(n) / log(1.5)) if n <= 656 else int(log(n) / log(1.3) - 8.72777) if n <= 3199 else int(log(n) / log(1.1) - 62.5472)
    return {"check": check, "length": length & 255, "q1": int(q1 * 100 / q3) % 16, "q2": int(q2 * 100 / q3) % 16, "code": code}


def _ring(x: int, y: int, n: int) -> int:
    d = abs(x - y)
    return min(d, n - d)


def tlsh_distance(x: dict | None, y: dict | None) -> int | None:
    if x is None or y is None:
        return None
    d = _ring(x["length"], y["length"], 256)
    total = d if d <= 1 else d * 12
    for q in ("q1", "q2"):
        d = _ring(x[q], y[q], 16)
        total += d if d <= 1 else (d - 1) * 12
    total += x["check"] != y["check"]
    gap = np.abs(x["code"] - y["code"])
    return int(total + np.where(gap == 3, 6, gap).sum())


# ---- Lempel-Ziv Jaccard ------------------------------------------------------------------------


def _finish(h: int) -> int:
    h ^= h >> 16
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    h ^= h >> 13
    h = h * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def lzjd(data: bytes, k: int = 1024) -> list[int]:
    """The k least hashes of the Lempel-Ziv phrases, sorted (signed 32 bits)."""
    seen: set[int] = set()
    h = 0x811C9DC5
    for byte in data:
        h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
        f = _finish(h)
        if f not in seen:
            seen.add(f)
            h = 0x811C9DC5
    return sorted(x - (1 << 32) if x >> 31 else x for x in seen)[:k]


def jaccard(x: list[int], y: list[int]) -> float:
    a, b = set(x), set(y)
    return len(a & b) / len(a | b) if a | b else 1.0


def _nilsimsa(a: bytes, b: bytes) -> float:
    return float(nilsimsa_score(nilsimsa(a), nilsimsa(b)))


KERNELS = {
    "ssdeep": lambda a, b: float(ssdeep_compare(ssdeep(a), ssdeep(b))),
    "tlsh": lambda a, b: None if (d := tlsh_distance(tlsh(a), tlsh(b))) is None else float(d),
    "nilsimsa": _nilsimsa,
    "lzjd": lambda a, b: jaccard(lzjd(a), lzjd(b)),
}
