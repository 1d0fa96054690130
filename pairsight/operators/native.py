"""Tests that stay in DataFrame functions: digests, rasters in long form, histograms, vectors,
boxes, joints and metadata. Tables and pairs are those of ``plans.fixtures``; values are rounded
to six places in the queries only, after verdicts are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import colour as C
from ..functions import vector as V
from ..plans import fixtures as X
from .nearest import best_matches

# ---- digests ----------------------------------------------------------------------------------


def copies(rows: DataFrame, id_col: str, digest: Column, exact: Column | None = None) -> DataFrame:
    """Every row with its digest, the least id that shares it and how many do.

    Equal digests are counted before the shuffle and joined back, so that a digest of very many
    copies neither fans out into pairs nor meets in one task (the join can be split). ``exact`` tells
    rows apart that a short digest confuses.
    """
    by = ["digest"] if exact is None else ["digest", "exact"]
    keyed = rows.select(F.col(id_col), digest.alias("digest"), *([] if exact is None else [exact.alias("exact")]))
    groups = keyed.groupBy(*by).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n_same"))
    out = keyed.join(groups, by)
    return out.select(id_col, "digest", "first_id", "n_same", F.when(F.col("n_same") > 1, "identical").otherwise("none").alias("verdict"))


def page_payload(html: Column) -> Column:
    """What is left of a page without its head and comments."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<head>.*?</head>", ""), r"(?s)<!--.*?-->", "")


# ---- pixel metrics over pair pixels --------------------------------------------------------------


def squared(a: str = "1", b: str = "2") -> Column:
    d = lambda c: F.col(c + a) - F.col(c + b)
    return d("r") * d("r") + d("g") * d("g") + d("b") * d("b")


def pixel_scores(pp: DataFrame, side: int = X.SIDE) -> DataFrame:
    """pixels, psnr and ncc of every pair in one aggregation."""
    same = (F.col("r1") == F.col("r2")) & (F.col("g1") == F.col("g2")) & (F.col("b1") == F.col("b2"))
    x, y = C.luma(F.col("r1"), F.col("g1"), F.col("b1")), C.luma(F.col("r2"), F.col("g2"), F.col("b2"))
    agg = pp.groupBy("pair_id").agg(
        F.avg(same.cast("double")).alias("pixels"), F.avg(squared() / 3.0).alias("mse"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"),
    )
    psnr = F.when(F.col("mse") == 0, float("inf")).otherwise(10 * F.log10(65025 / F.when(F.col("mse") > 0, F.col("mse"))))
    flat1, flat2 = F.col("vx") < 1e-9, F.col("vy") < 1e-9
    ncc = F.when(flat1 & flat2, F.when(F.abs(F.col("mx") - F.col("my")) < 1e-9, 1.0).otherwise(0.0)).when(flat1 | flat2, 0.0).otherwise(F.col("cxy") / F.sqrt(F.col("vx") * F.col("vy")))
    return agg.select("pair_id", "pixels", psnr.alias("psnr"), ncc.alias("ncc"))


def delta_e(pp: DataFrame) -> DataFrame:
    """Mean CIEDE2000 and the share of cells that changed by more than 5."""
    rows = pp
    for n in ("1", "2"):
        rows = rows.withColumns(dict(zip((f"l{n}", f"a{n}", f"bb{n}"), C.lab(F.col(f"r{n}"), F.col(f"g{n}"), F.col(f"b{n}")), strict=True)))
    rows = rows.select("pair_id", "l1", "a1", F.col("bb1").alias("b1"), "l2", "a2", F.col("bb2").alias("b2"))
    for step in C.ciede2000_steps():
        rows = rows.withColumns(step)
    return rows.groupBy("pair_id").agg(F.avg("de").alias("deltaE"), F.avg((F.col("de") > 5).cast("double")).alias("changed"))


def tile_rms(pp: DataFrame, side: int = X.SIDE, tiles: int = 4) -> DataFrame:
    """The largest root mean square of a tile's difference, in 0 to 1."""
    size = side // tiles
    tile = F.floor(F.floor(F.col("i") / side) / size) * tiles + F.floor((F.col("i") % side) / size)
    rms = pp.groupBy("pair_id", tile.alias("tile")).agg(F.sqrt(F.avg(squared() / (3.0 * 65025))).alias("rms"))
    return rms.groupBy("pair_id").agg(F.max("rms").alias("carlini"))


# ---- histograms ----------------------------------------------------------------------------------


def histograms(rasters: DataFrame, bins: str) -> DataFrame:
    """(doc_id, bin, p) of ``rgb`` (512 bins), ``luma`` or ``grey`` (256)."""
    p = X.pixels(rasters)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    code = {"rgb": F.shiftright(r, 5) * 64 + F.shiftright(g, 5) * 8 + F.shiftright(b, 5), "luma": F.floor(C.luma(r, g, b) + 0.5).cast("int"), "grey": C.grey(r, g, b)}[bins]
    n = X.SIDE * X.SIDE
    return p.groupBy("doc_id", code.alias("bin")).agg((F.count(F.lit(1)) / F.lit(n)).alias("p"))


def histogram_maps(rasters: DataFrame, bins: str) -> DataFrame:
    """(doc_id, h): a map of bin to share: a few entries, whatever the raster's size."""
    return histograms(rasters, bins).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("h"))


def histogram_pairs(rasters: DataFrame, bins: str) -> DataFrame:
    """(pair_id, p, q): dense shares of neighbours' bins that either has, in the order of bins."""
    h = histogram_maps(rasters, bins)
    q = h.select((F.col("doc_id") - 1).alias("pair_id"), F.col("h").alias("h2"))
    both = h.select(F.col("doc_id").alias("pair_id"), F.col("h").alias("h1")).join(q, "pair_id")
    keys = F.sort_array(F.array_union(F.map_keys("h1"), F.map_keys("h2")))
    value = lambda m: F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0)))
    return both.select("pair_id", keys.alias("bins"), value("h1").alias("p"), value("h2").alias("q"))


def rgb_scores(rasters: DataFrame) -> DataFrame:
    """Six distances of neighbours' colour histograms, of 512 bins (bins that neither has count as 0)."""
    hp = histogram_pairs(rasters, "rgb")
    p, q, n = F.col("p"), F.col("q"), 512
    sums = hp.select("pair_id", "p", "q", V.zipped(p, q, lambda x, y: x * y).alias("pq"), V.zipped(p, p, lambda x, y: x * y).alias("pp"), V.zipped(q, q, lambda x, y: x * y).alias("qq"))
    m = 1.0 / n  # the mean share, as shares sum to 1
    size = F.sqrt((F.col("pp") - m) * (F.col("qq") - m))
    correl = F.when(size > 1e-15, (F.col("pq") - m) / size).otherwise(1.0)
    log2 = lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0)
    return sums.select(
        "pair_id", correl.alias("histCorrel"), V.chi_square(p, q).alias("histChi"), V.zipped(p, q, F.least).alias("histIntersect"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - V.zipped(p, q, lambda x, y: F.sqrt(x * y)))).alias("histBhatt"),
        V.zipped(p, q, lambda x, y: F.when(x > 1e-12, x * F.ln(x / F.when(y > 1e-12, y).otherwise(1e-10))).otherwise(0.0)).alias("klDiv"),
        F.sqrt(F.greatest(F.lit(0.0), V.zipped(p, q, lambda x, y: log2(x, y) + log2(y, x)) / 2)).alias("jsDiv"),
    )


def running_scores(rasters: DataFrame, bins: str) -> DataFrame:
    """(pair_id, emd, ks) of two histograms of 256 levels, from running sums over their bins."""
    hp = histogram_pairs(rasters, bins)
    gap = F.aggregate(
        F.zip_with("p", "q", lambda x, y: x - y),
        F.array().cast("array<double>"),
        lambda acc, d: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + d)),
    )
    rows = hp.select("pair_id", "bins", gap.alias("cum"))
    # between two bins that appear, the running sums stay as they are
    widths = F.transform("bins", lambda b, i: F.coalesce(F.get("bins", i + 1), F.lit(256)) - b)
    emd = V.zipped(F.transform("cum", F.abs), widths, lambda c, w: c * w) / 255
    return rows.select("pair_id", emd.alias("emd"), F.array_max(F.transform("cum", F.abs)).alias("ks"))


def hsv_moments(rasters: DataFrame) -> DataFrame:
    """(doc_id, nine moments): means, population deviations and cube roots of third moments."""
    p = X.pixels(rasters)
    names = ("h", "s", "v")
    p = p.select("doc_id", *[c.alias(n) for n, c in zip(names, C.hsv(F.col("r"), F.col("g"), F.col("b")), strict=True)])
    agg = p.groupBy("doc_id").agg(*[f(n).alias(f"{n}{k}") for n in names for k, f in ((1, F.avg), (2, F.stddev_pop), (3, F.skewness))])

    def third(n):
        """Of central sums; a cube root would turn what rounding leaves of a moment of 0 (some 1e-17) into 1e-5."""
        moment = F.col(f"{n}3") * F.pow(f"{n}2", F.lit(3.0))
        return F.when((F.col(f"{n}2") > 0) & (F.abs(moment) > 1e-15), F.cbrt(moment)).otherwise(0.0)

    return agg.select("doc_id", F.array(*[F.col(f"{n}1") for n in names], *[F.col(f"{n}2") for n in names], *[third(n) for n in names]).alias("m"))


# ---- hashes of rasters as they are ------------------------------------------------------------------


def grey_array(rgb: Column, side: int = X.SIDE) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: C.grey(F.get(rgb, 3 * i), F.get(rgb, 3 * i + 1), F.get(rgb, 3 * i + 2)))


def hash_bits(rasters: DataFrame, side: int = X.SIDE) -> DataFrame:
    """Bits of five hashes, taken on the raster's own cells."""
    g = rasters.select("doc_id", grey_array(F.col("rgb"), side).alias("g"))
    cells = [(y, x) for y in range(0, side, 2) for x in range(0, side, 2)]
    at = lambda y, x: F.get("g", F.lit(y * side + x))
    sums = F.array(*[at(y, x) + at(y, x + 1) + at(y + 1, x) + at(y + 1, x + 1) for y, x in cells])
    g = g.select("doc_id", "g", V.total(F.col("g")).alias("total"), sums.alias("blocks"))
    ordered = F.sort_array("blocks")
    half = len(cells) // 2
    g = g.withColumn("median", (F.get(ordered, F.lit(half - 1)) + F.get(ordered, F.lit(half))) / 2.0)
    seq = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    right = F.transform(F.filter(seq(side * side), lambda i: i % side < side - 1), lambda i: F.get("g", i + 1) > F.get("g", i))
    below = F.transform(seq(side * (side - 1)), lambda i: F.get("g", i + side) > F.get("g", i))
    return g.select(
        "doc_id", right.alias("dhash"), below.alias("dhashVertical"), F.transform("g", lambda v: v > F.col("total") / (side * side)).alias("ahash"),
        F.transform("blocks", lambda v: v > F.col("median")).alias("whash"), F.transform("blocks", lambda v: v * F.lit(side * side) >= 4 * F.col("total")).alias("blockMean0"),
    )


def hash_distances(bits: DataFrame) -> DataFrame:
    """(pair_id, one Hamming distance a hash) of neighbours."""
    names = [c for c in bits.columns if c != "doc_id"]
    b = bits.select((F.col("doc_id") - 1).alias("pair_id"), *[F.col(n).alias(f"{n}_b") for n in names])
    both = bits.withColumnRenamed("doc_id", "pair_id").join(b, "pair_id")
    differ = lambda n: F.aggregate(F.zip_with(n, f"{n}_b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v).cast("double")
    return both.select("pair_id", *[differ(n).alias(n) for n in names])


# ---- texture ---------------------------------------------------------------------------------------


def cooccurrence(rasters: DataFrame, levels: int = 32, side: int = X.SIDE) -> DataFrame:
    """(doc_id, contrast, dissimilarity, homogeneity, asm) of the symmetric table to the right neighbour."""
    g = rasters.select("doc_id", F.transform(grey_array(F.col("rgb"), side), lambda v: F.floor(v * levels / 256).cast("int")).alias("q"))
    cells = F.filter(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: i % side < side - 1)
    rows = g.select("doc_id", "q", F.explode(cells).alias("k")).select("doc_id", F.get("q", F.col("k")).alias("i"), F.get("q", F.col("k") + 1).alias("j"))
    both = rows.select("doc_id", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("c")).select("doc_id", "c.i", "c.j")
    p = both.groupBy("doc_id", "i", "j").agg((F.count(F.lit(1)) / F.lit(2.0 * side * (side - 1))).alias("p"))
    d = (F.col("i") - F.col("j")).cast("double")
    return p.groupBy("doc_id").agg(F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("asm"))


def structure(rasters: DataFrame, side: int = X.SIDE) -> DataFrame:
    """flat, noise or normal, by the deviation of luma and its correlation with the right neighbour."""
    p = X.pixels(rasters).withColumn("l", C.luma(F.col("r"), F.col("g"), F.col("b")))
    nxt = F.lead("l").over(Window.partitionBy("doc_id", "y").orderBy("x"))
    agg = p.withColumn("n", nxt).groupBy("doc_id").agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("sd"), F.avg(F.when(F.col("n").isNotNull(), F.col("l") * F.col("n"))).alias("ln"), F.avg(F.when(F.col("n").isNotNull(), F.col("l"))).alias("l1"), F.avg("n").alias("n1"))
    rho = (F.col("ln") - F.col("m") * (F.col("l1") + F.col("n1")) + F.col("m") * F.col("m")) / F.when(F.col("sd") > 0, F.col("sd") * F.col("sd"))
    return agg.select("doc_id", F.when(F.col("sd") < 2.5, "flat").when(rho < 0.3, "noise").otherwise("normal").alias("structure"))


def peaks(rasters: DataFrame, side: int = X.SIDE, share: float = 0.45, most: int = 3) -> DataFrame:
    """Local maxima of the grey plane among eight neighbours, at least ``share`` of the largest; the top three."""

    def found(batches):
        for batch in batches:
            ids, rgb = batch.column(0), batch.column(1).flatten().to_numpy().reshape(-1, side, side, 3)
            g = (rgb[..., 0] * 19595 + rgb[..., 1] * 38470 + rgb[..., 2] * 7471 + 32768) >> 16
            p = np.pad(g, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
            near = np.maximum.reduce([p[:, 1 + dy : 1 + dy + side, 1 + dx : 1 + dx + side] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
            i, y, x = np.nonzero((g >= share * g.max((1, 2), keepdims=True, initial=0)) & (g > near))
            v = g[i, y, x]
            by = np.lexsort((x, y, -v, i))
            rank = np.arange(len(by)) - np.searchsorted(i, i) + 1
            by, rank = by[rank <= most], rank[rank <= most]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[by])), *[pa.array(z.astype(np.int32)) for z in (rank, y[by], x[by], v[by])]], names=["doc_id", "rank", "y", "x", "v"])

    return rasters.select("doc_id", "rgb").mapInArrow(found, "doc_id long, rank int, y int, x int, v int")


# ---- vectors ----------------------------------------------------------------------------------------


def label_sides(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels as images: pair l holds the vectors of label l and of label l + 1."""
    left = v.select(F.col("label").cast("long").alias("pair_id"), F.col("vec_id").alias("ia"), F.col("v").alias("va"))
    right = v.select((F.col("label") - 1).cast("long").alias("pair_id"), F.col("vec_id").alias("ib"), F.col("v").alias("vb"))
    return left, right


def mutual_matches(v: DataFrame) -> DataFrame:
    """(pair_id, ia, ib, sim) that choose each other."""
    left, right = label_sides(v)
    ab = best_matches(left, right, 1).select("pair_id", "ia", "ib", "sim")
    ba = best_matches(right.select("pair_id", F.col("ib").alias("ia"), F.col("vb").alias("va")), left.select("pair_id", F.col("ia").alias("ib"), F.col("va").alias("vb")), 1)
    return ab.join(ba.select("pair_id", F.col("ia").alias("ib"), F.col("ib").alias("ia")), ["pair_id", "ia", "ib"])


def ratio_matches(v: DataFrame, ratio: float = 0.95) -> DataFrame:
    """(pair_id, ia, ib, d1, d2): nearest neighbours that are clearly nearer than the second."""
    two = best_matches(*label_sides(v), 2)
    d = lambda k: F.max(F.when(F.col("rank") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("sim")))))
    out = two.groupBy("pair_id", "ia").agg(F.max(F.when(F.col("rank") == 1, F.col("ib"))).alias("ib"), d(1).alias("d1"), d(2).alias("d2"))
    return out.where(F.col("d1") < ratio * F.col("d2"))


def auc(scores: DataFrame) -> DataFrame:
    """auc (ties count half), thr (99th percentile of negatives) and tpr1 (positives above it).

    scores: score, label. Ranks come from counts below each distinct score, so no pairs are made.
    """
    per = scores.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = per.withColumn("below", below).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    thr = scores.where("label = 0").agg(F.percentile("score", F.lit(0.99)).alias("thr"))
    tpr = scores.where("label = 1").crossJoin(F.broadcast(thr)).agg(F.avg((F.col("score") > F.col("thr")).cast("double")).alias("tpr1"), F.first("thr").alias("thr"))
    return total.crossJoin(F.broadcast(tpr))  # one row each


# ---- boxes and joints --------------------------------------------------------------------------------


def area(b: str) -> Column:
    return (F.col(f"{b}x2") - F.col(f"{b}x1")) * (F.col(f"{b}y2") - F.col(f"{b}y1"))


def overlap(a: str, b: str) -> Column:
    w = F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1")
    h = F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1")
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: str = "a_", b: str = "b_") -> Column:
    both = overlap(a, b)
    return both / (area(a) + area(b) - both)


def box_pairs(det: DataFrame) -> DataFrame:
    """Boxes of an image with those of the next one; a_ and b_ columns."""
    cols = ("k", "x1", "y1", "x2", "y2", "label_id", "score")
    a = det.select(F.col("img").alias("pair_id"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = det.select((F.col("img") - 1).alias("pair_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, "pair_id")


def best_boxes(det: DataFrame, least: float = 0.3) -> DataFrame:
    """For each box the box of the next image that covers it best (+0.1 for the same label)."""
    rows = box_pairs(det).withColumn("iou", iou()).where(F.col("iou") >= least)
    rows = rows.withColumn("rank_score", F.col("iou") + F.when(F.col("a_label_id") == F.col("b_label_id"), 0.1).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy("pair_id", "a_k").orderBy(F.desc("rank_score"), "b_k"))
    return rows.withColumn("rank", rank).where("rank = 1").select("pair_id", "a_k", "b_k", "iou", "rank_score")


def kinds_in_common(det: DataFrame, least: float = 0.5, kinds: int = 9) -> DataFrame:
    """Jaccard index of the kinds (labels by synonym group) seen with enough confidence; null if none."""
    kind = F.when(F.col("label_id") <= kinds, F.col("label_id") % 4).otherwise(F.col("label_id"))  # fixture's synonym groups
    sets = det.groupBy("img").agg(F.collect_set(F.when(F.col("score") >= least, kind)).alias("kinds"))
    b = sets.select((F.col("img") - 1).alias("pair_id"), F.col("kinds").alias("kb"))
    both = sets.select(F.col("img").alias("pair_id"), F.col("kinds").alias("ka")).join(b, "pair_id")
    union = F.size(F.array_union("ka", "kb"))
    return both.select("pair_id", F.when(union > 0, F.size(F.array_intersect("ka", "kb")) / union).alias("value"))


def nested_boxes(det: DataFrame) -> DataFrame:
    """Boxes that lie within another box of their image: a range join inside the image."""
    a = det.select("img", *[F.col(c).alias(f"a_{c}") for c in ("k", "x1", "y1", "x2", "y2")])
    b = det.select("img", *[F.col(c).alias(f"b_{c}") for c in ("k", "x1", "y1", "x2", "y2")])
    inside = (F.col("a_x1") >= F.col("b_x1")) & (F.col("a_y1") >= F.col("b_y1")) & (F.col("a_x2") <= F.col("b_x2")) & (F.col("a_y2") <= F.col("b_y2"))
    return a.join(b, "img").where(inside & (F.col("a_k") != F.col("b_k"))).select("img", F.col("a_k").alias("inner_k"), F.col("b_k").alias("outer_k"))


def pose_similarity(joints: DataFrame, least_conf: float = 0.3, tolerance: float = 1.5, least: int = 5) -> DataFrame:
    """Best similarity fit of one skeleton to the next, then the mean of exp(-d^2 / (2 s^2)) over joints.

    Closed form of the fit in the plane: with centred joints, scale and turn are the complex ratio
    of the cross sum to the own sum. s is ``tolerance`` tenths of the target's spread.
    """
    b = joints.select((F.col("img") - 1).alias("pair_id"), "j", F.col("x").alias("u"), F.col("y").alias("v"), F.col("conf").alias("cb"))
    rows = joints.select(F.col("img").alias("pair_id"), "j", "x", "y", "conf").join(b, ["pair_id", "j"]).where((F.col("conf") >= least_conf) & (F.col("cb") >= least_conf))
    s = lambda e: F.sum(e)
    c = F.col
    sums = rows.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), s(c("x") * c("x") + c("y") * c("y")).alias("xx"),
        s(c("u") * c("u") + c("v") * c("v")).alias("uu"), s(c("u") * c("x") + c("v") * c("y")).alias("re"), s(c("u") * c("y") - c("v") * c("x")).alias("im"),
    ).where(F.col("n") >= least)
    n = c("n")
    sums = sums.select(
        "pair_id", "n", "mx", "my", "mu", "mv", (c("xx") - n * (c("mx") ** 2 + c("my") ** 2)).alias("sxx"), (c("uu") - n * (c("mu") ** 2 + c("mv") ** 2)).alias("suu"),
        (c("re") - n * (c("mu") * c("mx") + c("mv") * c("my"))).alias("re"), (c("im") - n * (c("mu") * c("my") - c("mv") * c("mx"))).alias("im"),
    )
    fit = rows.join(sums, "pair_id").withColumns({"p": c("u") - c("mu"), "q": c("v") - c("mv")})
    px = c("mx") + (c("re") * c("p") - c("im") * c("q")) / c("suu")
    py = c("my") + (c("re") * c("q") + c("im") * c("p")) / c("suu")
    d2 = (c("x") - px) ** 2 + (c("y") - py) ** 2
    spread = c("sxx") / c("n")
    return fit.groupBy("pair_id").agg(F.avg(F.exp(-d2 / (2 * (tolerance / 10) ** 2 * spread))).alias("value"))


# ---- metadata ------------------------------------------------------------------------------------------


def capture_ladder(a_id: Column, b_id: Column, a_cam: Column, b_cam: Column, a_time: Column, b_time: Column) -> Column:
    """The strongest agreement of two captures: image id, camera and time, camera, time, nothing."""
    same = lambda x, y: x.isNotNull() & y.isNotNull() & (x.cast("string") == y.cast("string"))
    return (
        F.when(same(a_id, b_id), "same image id").when(same(a_cam, b_cam) & same(a_time, b_time), "same camera and time").when(same(a_cam, b_cam), "same camera").when(same(a_time, b_time), "same time").otherwise("different")
    )


def normalised_notice(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def notices_kept(a: Column, b: Column) -> Column:
    """none, kept (either holds the other), removed or changed."""
    p, q = normalised_notice(a), normalised_notice(b)
    return F.when(F.coalesce(p, F.lit("")) == "", "none").when(F.coalesce(q, F.lit("")) == "", "removed").when(F.contains(p, q) | F.contains(q, p), "kept").otherwise("changed")


def shape_verdict(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    ratio = lambda x: F.abs(F.ln(x))
    return F.when((w1 == w2) & (h1 == h2), "same size").when(ratio((w1 / h1) / (w2 / h2)) < 0.01, "same aspect").when(ratio((w1 / h1) * (w2 / h2)) < 0.01, "turned").otherwise("different")


def file_format(data: Column) -> Column:
    """The format that the first bytes tell."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("47494638"), "GIF").when(head.startswith("424D"), "BMP")
        .when(head.startswith("00000100"), "ICO").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WebP")
        .when(F.substring(head, 9, 8) == "66747970", "ISO-BMFF").when(F.lower(F.decode(F.substring(data, 1, 256), "ISO-8859-1")).contains("<svg"), "SVG").otherwise("unknown")
    )


#: The standard luminance quantisation table, in reading order.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def quality_table(quality: Column) -> Column:
    """The table an encoder uses at a quality of 1 to 100."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    return F.transform(F.array(*[F.lit(v) for v in LUMINANCE]), lambda v: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((v * scale + 50) / 100))).cast("int"))


def estimated_quality(tables: DataFrame) -> DataFrame:
    """(table, quality, err): the quality whose table is nearest in absolute sum; ties go to the lowest.

    Few distinct tables exist, so they are compared once each.
    """
    tried = tables.select("table").distinct().select("table", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("q"))
    err = V.l1(F.col("table"), quality_table(F.col("q")))
    best = tried.select("table", "q", err.alias("err")).groupBy("table").agg(F.min(F.struct("err", "q")).alias("best"))
    return best.select("table", F.col("best.q").alias("quality"), F.col("best.err").alias("err"))
