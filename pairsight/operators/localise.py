"""Where two images are alike: regions, links, assignments, differences (per-pair numpy kernels)
and small native decisions. The grouped forms take one pair's bounded rows at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import planes as P
from . import registration as R


def greedy_assignment(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs by falling score from (pair_id, a_k, b_k, score); ties by a_k, then b_k."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        taken_a, taken_b, keep = set(), set(), []
        for row in pdf.sort_values(["score", "a_k", "b_k"], ascending=[False, True, True]).itertuples(index=False):
            keep.append(row.a_k not in taken_a and row.b_k not in taken_b)
            if keep[-1]:
                taken_a.add(row.a_k)
                taken_b.add(row.b_k)
        return pdf.sort_values(["score", "a_k", "b_k"], ascending=[False, True, True])[keep]

    return candidates.select("pair_id", "a_k", "b_k", "score").groupBy("pair_id").applyInPandas(one, "pair_id long, a_k int, b_k int, score double")


def suppress(det: DataFrame, any_label: float = 0.8, same_label: float = 0.5) -> DataFrame:
    """Detections of an image without near copies of better ones."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "k"], ascending=[False, True])
        box, label, keep = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["label_id"].to_numpy(), []
        for i in range(len(pdf)):
            ok = True
            for j in keep:
                w = min(box[i, 2], box[j, 2]) - max(box[i, 0], box[j, 0])
                h = min(box[i, 3], box[j, 3]) - max(box[i, 1], box[j, 1])
                both = max(0, w) * max(0, h)
                iou = both / ((box[i, 2] - box[i, 0]) * (box[i, 3] - box[i, 1]) + (box[j, 2] - box[j, 0]) * (box[j, 3] - box[j, 1]) - both)
                ok &= not (iou > any_label or (iou > same_label and label[i] == label[j]))
            if ok:
                keep.append(i)
        return pdf.iloc[keep]

    return det.groupBy("img").applyInPandas(one, det.schema)


def match_regions(matches: np.ndarray, sims: np.ndarray, near_a: int = 2, near_b: int = 3, least: int = 4, most: int = 6) -> list[dict]:
    """Groups of matches (ay, ax, by, bx) that are neighbours in both images, by size times similarity."""
    n = len(matches)
    if not n:
        return []
    d = np.abs(matches[:, None] - matches[None])
    close = (d[..., :2].max(-1) <= near_a) & (d[..., 2:].max(-1) <= near_b)
    label = np.arange(n)
    while True:
        new = np.where(close, label[None], n).min(1)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label):
        m, s = matches[label == k], sims[label == k]
        if len(m) >= least:
            out.append({"size": len(m), "sim": float(s.mean()), "a": (*m[:, :2].min(0), *m[:, :2].max(0)), "b": (*m[:, 2:].min(0), *m[:, 2:].max(0))})
    return sorted(out, key=lambda r: -r["size"] * r["sim"])[:most]


def spread_lines(matches: np.ndarray, sims: np.ndarray, gap: int = 1, most: int = 90) -> np.ndarray:
    """Indexes of the best matches, none within ``gap`` cells of a better one."""
    order, keep = np.argsort(-sims, kind="stable"), []
    for i in order:
        if len(keep) == most:
            break
        if all(np.abs(matches[i, :2] - matches[j, :2]).max() > gap for j in keep):
            keep.append(int(i))
    return np.array(keep, int)


def evidence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How every pair of cells adds to the cosine of two summed descriptors; the entries sum to it."""
    za, zb = np.linalg.norm(a.sum(0)), np.linalg.norm(b.sum(0))
    return (a @ b.T) / (za * zb) if za > 0 and zb > 0 else np.zeros((len(a), len(b)))


def copy_links(r: np.ndarray, grid_a: tuple[int, int], grid_b: tuple[int, int], most: int = 8) -> dict:
    """Links between groups of cells with the weight they carry; links, rest and negative sum to the score."""
    score, target = float(r.sum()), r.argmax(1)
    weight = np.maximum(r, 0)[np.arange(len(r)), target]
    ya, xa = np.divmod(np.arange(len(r)), grid_a[1])
    yb, xb = np.divmod(target, grid_b[1])
    close = (np.maximum(np.abs(ya[:, None] - ya), np.abs(xa[:, None] - xa)) <= 1) & (np.maximum(np.abs(yb[:, None] - yb), np.abs(xb[:, None] - xb)) <= 2)
    label = np.arange(len(r))
    while True:
        new = np.where(close, label[None], len(r)).min(1)
        if (new == label).all():
            break
        label = new
    links = []
    for k in np.unique(label):
        i = label == k
        w = weight[i].sum()
        if w >= max(0.02, 0.04 * score):
            c = lambda v, i=i, w=w: float((v[i] * weight[i]).sum() / w)
            links.append({"weight": float(w), "a": (c(ya), c(xa)), "b": (c(yb), c(xb))})
    links = sorted(links, key=lambda x: -x["weight"])[:most]
    negative = float(np.minimum(r, 0).sum())
    return {"links": links, "negative": negative, "rest": score - negative - sum(x["weight"] for x in links), "score": score}


def find_differences(a: np.ndarray, b: np.ndarray, most: int = 15) -> list[dict]:
    """Boxes where aligned images differ: colour out of the other's local range, both ways."""
    x, y = a.astype(float), b.astype(float)

    def outside(p, q):
        pad = np.pad(q, ((1, 1), (1, 1), (0, 0)), mode="edge")
        win = np.lib.stride_tricks.sliding_window_view(pad, (3, 3), axis=(0, 1))
        lo, hi = win.min((-1, -2)), win.max((-1, -2))
        return np.maximum(0, np.maximum(lo - p, p - hi)).sum(-1)

    d = np.maximum(outside(x, y), outside(y, x))
    limit = np.clip(d.mean() + 4 * d.std(), 30, 90)
    hot = d > limit
    if hot.mean() > 0.3:
        return [{"global": True, "score": float(d.sum())}]
    win = lambda m: np.lib.stride_tricks.sliding_window_view(np.pad(m, 1), (3, 3))
    closed = win(win(hot).any((2, 3))).all((2, 3)) | hot
    label, n = P.components(closed, eight=True)
    boxes = []
    for k in range(1, n + 1):
        yy, xx = np.nonzero(label == k)
        if len(yy) >= 4:
            boxes.append({"global": False, "score": float(d[yy, xx].sum()), "box": (int(xx.min()), int(yy.min()), int(xx.max()) + 1, int(yy.max()) + 1)})
    boxes.sort(key=lambda v: -v["score"])
    return [v for v in boxes[:most] if v["score"] >= 0.4 * boxes[0]["score"]] if boxes else []


def describe_change(edges_a: Column, edges_b: Column, ssim: Column) -> Column:
    """added, removed, recoloured or changed."""
    return F.when(edges_b > 1.6 * edges_a + 2, "added").when(edges_a > 1.6 * edges_b + 2, "removed").when(ssim >= 0.6, "recoloured").otherwise("changed")


def place_name(x: Column, y: Column) -> Column:
    """Name of the third of the image that holds a relative position."""
    col = F.when(x < 1 / 3, "left").when(x > 2 / 3, "right").otherwise("centre")
    row = F.when(y < 1 / 3, "top").when(y > 2 / 3, "bottom").otherwise("middle")
    return F.when((row == "middle") & (col == "centre"), "centre").otherwise(F.concat_ws(" ", row, col))


def two_lenses(score: Column, share: Column, sim: Column, least: float = 0.6) -> Column:
    """Whether a patch is copied, only similar, or neither."""
    return F.when((score >= 0.4) & (share >= 0.3) & (sim >= least - 0.1), "copied").when(sim >= least, "similar").otherwise("none")


def arrow_pattern(links: DataFrame) -> DataFrame:
    """How a copy was moved, from links (pair_id, ax, ay, bx, by, w): weighted moments, then a rule."""
    m = lambda e: F.sum(F.col("w") * e) / F.sum("w")
    c = F.col
    agg = links.groupBy("pair_id").agg(*[m(c(n)).alias(f"m_{n}") for n in ("ax", "ay", "bx", "by")], *[m(c(p) * c(q)).alias(f"m_{p}_{q}") for p, q in (("ax", "bx"), ("ay", "by"), ("ax", "ax"), ("ay", "ay"), ("bx", "bx"), ("by", "by"))])
    cov = lambda p, q: c(f"m_{p}_{q}") - c(f"m_{p}") * c(f"m_{q}")
    rx = cov("ax", "bx") / F.nullif(F.sqrt(cov("ax", "ax") * cov("bx", "bx")), F.lit(0.0))
    ry = cov("ay", "by") / F.nullif(F.sqrt(cov("ay", "ay") * cov("by", "by")), F.lit(0.0))
    grow = F.sqrt((cov("bx", "bx") + cov("by", "by")) / F.nullif(cov("ax", "ax") + cov("ay", "ay"), F.lit(0.0)))
    near = F.hypot(c("m_ax") - c("m_bx"), c("m_ay") - c("m_by")) < 0.1
    pattern = F.when((rx < -0.6) & (ry > 0.6), "mirrored").when((rx > 0.6) & (ry < -0.6), "flipped").when((rx > 0.6) & (ry > 0.6), F.when(grow > 1.25, "enlarged").when(grow < 0.8, "shrunk").when(near, "in place").otherwise("moved")).otherwise("rearranged")
    return agg.select("pair_id", pattern.alias("pattern"))


def consistent(points: DataFrame) -> DataFrame:
    """(pair_id, matches, inliers, sane) of matched points (pair_id, ia, xa, ya, xb, yb): one homography a pair."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ia")
        a, b = pdf[["xa", "ya"]].to_numpy(), pdf[["xb", "yb"]].to_numpy()
        h, ok = R.ransac(b, a)
        w, hgt = (np.ptp(b, axis=0) + 1).astype(int) if len(b) else (1, 1)
        return pd.DataFrame({"pair_id": [pdf["pair_id"].iloc[0]], "matches": [len(pdf)], "inliers": [int(ok.sum())], "sane": [R.sane(h, int(w), int(hgt))]})

    return points.groupBy("pair_id").applyInPandas(one, "pair_id long, matches long, inliers long, sane boolean")


def overlap_quad(h: np.ndarray, shape_a: tuple, shape_b: tuple, grid: int = 40) -> tuple[float, float, float, float]:
    """Shares of A and of B that overlap when B is drawn into A by ``h``, zoom and turn in degrees."""

    def share(m, inner, outer):
        y, x = (np.mgrid[:grid, :grid] + 0.5) / grid
        p = R.project(m, np.stack([x.ravel() * outer[1], y.ravel() * outer[0]], 1))
        return float(((p >= 0) & (p <= [inner[1], inner[0]])).all(1).mean())

    zoom = float(np.sqrt(abs(h[0, 0] * h[1, 1] - h[0, 1] * h[1, 0])))
    return share(np.linalg.inv(h), shape_b, shape_a), share(h, shape_a, shape_b), zoom, float(np.degrees(np.arctan2(h[1, 0], h[0, 0])))


def unmatched_pieces(best: np.ndarray, limit: float) -> list[tuple[int, int, int, int]]:
    """Boxes of 4-connected cells without a good match, of at least 3 cells and 3 % of the grid."""
    label, n = P.components(best < limit)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        if len(y) >= max(3, 0.03 * best.size):
            out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    return out


def dense_shifts(a: np.ndarray, b: np.ndarray, tile: int = 16, reach: int = 4, least_sd: float = 6.0, least: float = 0.45) -> np.ndarray:
    """(rows, cols, 2): how far each tile of A has moved in B (dy, dx), smoothed by medians of neighbours."""
    ga, gb = P.grey(a).astype(float), np.pad(P.grey(b).astype(float), reach, mode="edge")
    rows, cols = ga.shape[0] // tile, ga.shape[1] // tile
    out = np.full((rows, cols, 2), np.nan)
    for i in range(rows):
        for j in range(cols):
            t = ga[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
            if t.std() < least_sd:
                continue
            s = R.template_scores(gb[i * tile : (i + 1) * tile + 2 * reach, j * tile : (j + 1) * tile + 2 * reach], t)
            y, x = np.unravel_index(s.argmax(), s.shape)
            if s[y, x] >= least:
                out[i, j] = y - reach, x - reach
    pad = np.pad(out, ((1, 1), (1, 1), (0, 0)), constant_values=np.nan)
    win = np.lib.stride_tricks.sliding_window_view(pad, (3, 3), axis=(0, 1)).reshape(rows, cols, 2, 9)
    known = np.isfinite(win).any(-1)
    smooth = np.zeros((rows, cols, 2))
    smooth[known] = np.nanmedian(win[known], axis=-1)
    return smooth


def compare_region(a: np.ndarray, b: np.ndarray, box: tuple[int, int, int, int], without: list[tuple[int, int, int, int]] = ()) -> dict:
    """Likeness inside a box of two aligned images, without nested boxes unless less than a quarter is left."""
    from .fullreference import ssim_plane

    x1, y1, x2, y2 = box
    mask = np.ones((y2 - y1, x2 - x1), bool)
    for u1, v1, u2, v2 in without:
        mask[max(0, v1 - y1) : max(0, v2 - y1), max(0, u1 - x1) : max(0, u2 - x1)] = False
    if mask.mean() < 0.25:
        mask[:] = True
    p, q = a[y1:y2, x1:x2], b[y1:y2, x1:x2]
    de = P.ciede2000(P.lab(p), P.lab(q))[mask]
    ssim = ssim_plane(P.luma(p), P.luma(q)) if min(p.shape[:2]) >= 16 else float("nan")
    return {"ssim": ssim, "delta_e": float(de.mean()), "changed": float((de > 6).mean())}


def crop_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Half of the hue-saturation histograms' correlation and half of SSIM at 96 cells a side; never below 0."""
    from .descriptors import correlation
    from .fullreference import ssim

    def hist(z):
        h = P.hsv8(z).reshape(-1, 3).astype(int)
        return np.bincount(np.minimum(h[:, 0] * 16 // 256, 15) * 8 + h[:, 1] * 8 // 256, minlength=128) / len(h)

    small = [P.resize(z, 96, 96, "bilinear") for z in (a, b)]
    return 0.5 * max(0.0, correlation(hist(a), hist(b))) + 0.5 * max(0.0, ssim(*small))
