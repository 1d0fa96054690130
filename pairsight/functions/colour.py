"""Colour conversions and differences as column expressions (sRGB, D65)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB primaries to XYZ over the D65 white, row by row.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def grey(r: Column, g: Column, b: Column) -> Column:
    """Integer luma, as image libraries convert to grey."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def linear(c: Column) -> Column:
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = [linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(XYZ, WHITE, strict=True):
        t = sum((k * c for k, c in zip(row[1:], lin[1:], strict=True)), row[0] * lin[0]) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def hue(a: Column, b: Column) -> Column:
    h = F.degrees(F.atan2(b, a))
    return F.when((a == 0) & (b == 0), 0.0).when(h < 0, h + 360).otherwise(h)


def ciede2000_steps() -> list[dict[str, Column]]:
    """The formula as successive columns over l1, a1, b1, l2, a2, b2; the last is ``de``.

    Kept apart so that shared terms are computed once a row.
    """
    c = F.col
    p7 = 25.0**7
    cm7 = F.pow((F.hypot("a1", "b1") + F.hypot("a2", "b2")) / 2, F.lit(7.0))
    rad = lambda x: F.radians(x)
    return [
        {"g": 0.5 * (1 - F.sqrt(cm7 / (cm7 + p7)))},
        {"ap1": (1 + c("g")) * c("a1"), "ap2": (1 + c("g")) * c("a2")},
        {"c1": F.hypot("ap1", "b1"), "c2": F.hypot("ap2", "b2"), "h1": hue(c("ap1"), c("b1")), "h2": hue(c("ap2"), c("b2"))},
        {"dh": F.when(c("c1") * c("c2") == 0, 0.0).when(F.abs(c("h2") - c("h1")) <= 180, c("h2") - c("h1")).when(c("h2") - c("h1") > 180, c("h2") - c("h1") - 360).otherwise(c("h2") - c("h1") + 360),
         "hm": F.when(c("c1") * c("c2") == 0, c("h1") + c("h2")).when(F.abs(c("h1") - c("h2")) <= 180, (c("h1") + c("h2")) / 2).when(c("h1") + c("h2") < 360, (c("h1") + c("h2") + 360) / 2).otherwise((c("h1") + c("h2") - 360) / 2),
         "lm": (c("l1") + c("l2")) / 2, "cm": (c("c1") + c("c2")) / 2},
        {"dhh": 2 * F.sqrt(c("c1") * c("c2")) * F.sin(rad(c("dh") / 2)),
         "t": 1 - 0.17 * F.cos(rad(c("hm") - 30)) + 0.24 * F.cos(rad(2 * c("hm"))) + 0.32 * F.cos(rad(3 * c("hm") + 6)) - 0.2 * F.cos(rad(4 * c("hm") - 63)),
         "sl": 1 + 0.015 * F.pow(c("lm") - 50, F.lit(2.0)) / F.sqrt(20 + F.pow(c("lm") - 50, F.lit(2.0))), "sc": 1 + 0.045 * c("cm"),
         "rt": -2 * F.sqrt(F.pow("cm", F.lit(7.0)) / (F.pow("cm", F.lit(7.0)) + p7)) * F.sin(rad(60 * F.exp(-F.pow((c("hm") - 275) / 25, F.lit(2.0)))))},
        {"tl": (c("l2") - c("l1")) / c("sl"), "tc": (c("c2") - c("c1")) / c("sc"), "th": c("dhh") / (1 + 0.015 * c("cm") * c("t"))},
        {"de": F.sqrt(F.greatest(F.lit(0.0), c("tl") * c("tl") + c("tc") * c("tc") + c("th") * c("th") + c("rt") * c("tc") * c("th")))},
    ]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    """Metres between two positions."""
    d = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(d)))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in 0 to 1."""
    hi, lo = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    span = hi - lo
    x, y, z = r / 255.0, g / 255.0, b / 255.0
    h = F.when(span == 0, 0.0).when(x == hi, F.pmod((y - z) / span, F.lit(6.0))).when(y == hi, (z - x) / span + 2).otherwise((x - y) / span + 4) / 6
    return h, F.when(hi > 0, span / hi).otherwise(0.0), hi


