"""Registered queries of the library and, where SQL can state them, the equivalent SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour as C
from .functions import vector as V
from .operators import descriptors, fullreference, fuzzy, imagehash, localise, registration, watermark
from .operators import native as N
from .plans import catalogue
from .plans import fixtures as X
from .plans import verdicts as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


def sql_verdict(engine: str, value: str) -> str:
    better, match, partial = catalogue.thresholds(engine)
    op = ">=" if better == "higher" else "<="
    cases = [f"WHEN {value} IS NULL OR isnan({value}) THEN 'na'"]
    cases += [f"WHEN {value} {op} {t} THEN '{v}'" for t, v in ((match, "match"), (partial, "partial")) if t is not None]
    return f"CASE {' '.join(cases)} ELSE 'none' END"


# ---- exact ---------------------------------------------------------------------------------------

_COPIES = """SELECT {id}, d.digest AS digest, g.first_id AS first_id, g.n_same AS n_same, CASE WHEN g.n_same > 1 THEN 'identical' ELSE 'none' END AS verdict
FROM (SELECT {id}, {digest} AS digest FROM {table}) d JOIN (SELECT {digest} AS digest, min({id}) AS first_id, count(*) AS n_same FROM {table} GROUP BY 1) g USING (digest)"""


def _docs(spark, sf_dir):
    return X.table(spark, sf_dir, "documents")


for _name, _fn, _sql in (("sha256", lambda c: F.sha2(c, 256), "sha256(text)"), ("sha1", F.sha1, "sha1(text)"), ("md5", F.md5, "md5(text)")):
    query(f"exact_{_name}", _COPIES.format(id="doc_id", digest=_sql, table="documents"))(lambda s, d, f=_fn: N.copies(_docs(s, d), "doc_id", f(F.encode("text", "UTF-8"))))

_EQUAL = """SELECT doc_id, first_id, n_same, CASE WHEN n_same > 1 THEN 'identical' ELSE 'none' END AS verdict FROM documents
JOIN (SELECT text, min(doc_id) AS first_id, count(*) AS n_same FROM documents GROUP BY text) USING (text)"""


def _hashlib(make):
    """A digest that Spark lacks, over Arrow batches; made with a session at hand."""

    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: make(x.encode()).hexdigest())

    return F.pandas_udf(digest, "string")("text")


for _name, _fn in (("sha512", lambda: F.sha2(F.encode("text", "UTF-8"), 512)), ("crc32", lambda: F.lpad(F.lower(F.hex(F.crc32(F.encode("text", "UTF-8")))), 8, "0")), ("sha3", lambda: _hashlib(hashlib.sha3_256)), ("blake2b", lambda: _hashlib(partial(hashlib.blake2b, digest_size=32)))):
    # 32 bits meet by chance from some ten thousand texts on: equal ones are held against a long digest
    query(f"exact_{_name}", _EQUAL)(lambda s, d, f=_fn, short=_name == "crc32": N.copies(_docs(s, d), "doc_id", f(), F.sha2(F.encode("text", "UTF-8"), 256) if short else None).drop("digest"))

_PAYLOAD = "sha256(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g'))"


@query("exact_payload", _COPIES.format(id="page_id", digest=_PAYLOAD, table="pages"))
def exact_payload(spark, sf_dir):
    return N.copies(X.table(spark, sf_dir, "pages"), "page_id", F.sha2(F.encode(N.page_payload(F.col("html")), "UTF-8"), 256))


# ---- rasters -------------------------------------------------------------------------------------

_PX = """cp AS (SELECT doc_id, n, unnest(u) AS u, unnest(range(n)) AS p FROM (SELECT doc_id, length(text) AS n, list_transform(string_split(text, ''), lambda x: unicode(x)) AS u FROM documents WHERE length(text) > 0)),
sm AS MATERIALIZED (SELECT doc_id, any_value(n) AS n, p % 768 AS k, CAST(sum(u)*7%256 AS INTEGER) AS v FROM cp GROUP BY doc_id, p % 768),
wj AS MATERIALIZED (SELECT doc_id, j, j % n AS k FROM (SELECT doc_id, any_value(n) AS n FROM sm GROUP BY doc_id) d, range(768) t(j)),
sv AS MATERIALIZED (SELECT wj.doc_id AS doc_id, j, v FROM wj JOIN sm ON sm.doc_id = wj.doc_id AND sm.k = wj.k),
px AS MATERIALIZED (SELECT doc_id, j//3 AS i, j//3//16 AS y, j//3%16 AS x, max(v) FILTER (j%3=0) AS r, max(v) FILTER (j%3=1) AS g, max(v) FILTER (j%3=2) AS b FROM sv GROUP BY doc_id, j//3),
gr AS (SELECT *, (r*19595+g*38470+b*7471+32768)>>16 AS v, CAST(0.299 AS DOUBLE)*r+CAST(0.587 AS DOUBLE)*g+CAST(0.114 AS DOUBLE)*b AS l FROM px),
pp AS (SELECT p.doc_id AS pair_id, p.i AS i, p.y AS y, p.x AS x, p.r AS r1, p.g AS g1, p.b AS b1, p.l AS l1, q.r AS r2, q.g AS g2, q.b AS b2, q.l AS l2 FROM gr p JOIN gr q ON q.doc_id = p.doc_id + 1 AND q.i = p.i)"""

_PIXELS = f"""WITH {_PX}, s AS (SELECT pair_id, avg(CASE WHEN r1=r2 AND g1=g2 AND b1=b2 THEN 1.0 ELSE 0.0 END) AS pixels,
avg(((r1-r2)*(r1-r2)+(g1-g2)*(g1-g2)+(b1-b2)*(b1-b2))/3.0) AS mse, avg(l1) AS m1, avg(l2) AS m2, var_pop(l1) AS v1, var_pop(l2) AS v2, covar_pop(l1, l2) AS c FROM pp GROUP BY pair_id),
t AS (SELECT pair_id, pixels, CASE WHEN mse = 0 THEN CAST('inf' AS DOUBLE) ELSE 10*log10(65025/mse) END AS psnr,
CASE WHEN v1 < 1e-9 AND v2 < 1e-9 THEN CASE WHEN abs(m1-m2) < 1e-9 THEN 1.0 ELSE 0.0 END WHEN v1 < 1e-9 OR v2 < 1e-9 THEN 0.0 ELSE c/sqrt(v1*v2) END AS ncc FROM s)
"""


def _pair_pixels(spark, sf_dir):
    return X.pair_pixels(X.packed(spark, sf_dir))


@query("pixels", _PIXELS + "SELECT pair_id, round(pixels, 6) AS value, CASE WHEN pixels = 1 THEN 'identical' ELSE 'none' END AS verdict FROM t")
def pixels(spark, sf_dir):
    return N.pixel_scores(_pair_pixels(spark, sf_dir)).select("pair_id", r6("pixels", "value"), F.when(F.col("pixels") == 1, "identical").otherwise("none").alias("verdict"))


for _name in ("psnr", "ncc"):
    query(_name, _PIXELS + f"SELECT pair_id, round({_name}, 6) AS value, {sql_verdict(_name, _name)} AS verdict FROM t")(
        lambda s, d, n=_name: N.pixel_scores(_pair_pixels(s, d)).select("pair_id", r6(n, "value"), D.verdict_of(n, F.col(n)).alias("verdict"))
    )

_LIN = "CASE WHEN {c}/255.0 <= 0.04045 THEN {c}/255.0/12.92 ELSE pow(({c}/255.0+0.055)/1.055, 2.4) END AS {c}"
_CH = [f"{c}{n}" for n in (1, 2) for c in "rgb"]
_XYZ = ", ".join(f"({row[0]}*r{n}+{row[1]}*g{n}+{row[2]}*b{n})/{w} AS {k}{n}" for n in (1, 2) for k, row, w in zip("uvw", C.XYZ, C.WHITE, strict=True))
_FT = ", ".join(f"CASE WHEN {k}{n} > 216.0/24389 THEN cbrt({k}{n}) ELSE ({k}{n}*(24389.0/27)+16)/116 END AS {k}{n}" for n in (1, 2) for k in "uvw")
_LAB = ", ".join(f"116*v{n}-16 AS l{n}, 500*(u{n}-v{n}) AS a{n}, 200*(v{n}-w{n}) AS b{n}" for n in (1, 2))
_DELTA = f"""WITH {_PX}, lin AS MATERIALIZED (SELECT pair_id, {', '.join(_LIN.format(c=c) for c in _CH)} FROM pp), xyz AS MATERIALIZED (SELECT pair_id, {_XYZ} FROM lin), ft AS MATERIALIZED (SELECT pair_id, {_FT} FROM xyz), lab AS MATERIALIZED (SELECT pair_id, {_LAB} FROM ft),
s1 AS MATERIALIZED (SELECT *, pow((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2, 7) AS cm7 FROM lab),
s2 AS MATERIALIZED (SELECT *, a1*(1+0.5*(1-sqrt(cm7/(cm7+6103515625.0)))) AS ap1, a2*(1+0.5*(1-sqrt(cm7/(cm7+6103515625.0)))) AS ap2 FROM s1),
s3 AS MATERIALIZED (SELECT *, sqrt(ap1*ap1+b1*b1) AS c1, sqrt(ap2*ap2+b2*b2) AS c2, CASE WHEN ap1=0 AND b1=0 THEN 0.0 WHEN degrees(atan2(b1,ap1)) < 0 THEN degrees(atan2(b1,ap1))+360 ELSE degrees(atan2(b1,ap1)) END AS h1,
CASE WHEN ap2=0 AND b2=0 THEN 0.0 WHEN degrees(atan2(b2,ap2)) < 0 THEN degrees(atan2(b2,ap2))+360 ELSE degrees(atan2(b2,ap2)) END AS h2 FROM s2),
s4 AS MATERIALIZED (SELECT *, CASE WHEN c1*c2=0 THEN 0.0 WHEN abs(h2-h1) <= 180 THEN h2-h1 WHEN h2-h1 > 180 THEN h2-h1-360 ELSE h2-h1+360 END AS dh,
CASE WHEN c1*c2=0 THEN h1+h2 WHEN abs(h1-h2) <= 180 THEN (h1+h2)/2 WHEN h1+h2 < 360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS hm, (l1+l2)/2 AS lm, (c1+c2)/2 AS cm FROM s3),
s5 AS MATERIALIZED (SELECT *, 2*sqrt(c1*c2)*sin(radians(dh/2)) AS dhh, 1-0.17*cos(radians(hm-30))+0.24*cos(radians(2*hm))+0.32*cos(radians(3*hm+6))-0.2*cos(radians(4*hm-63)) AS t,
1+0.015*pow(lm-50,2)/sqrt(20+pow(lm-50,2)) AS sl, 1+0.045*cm AS sc, -2*sqrt(pow(cm,7)/(pow(cm,7)+6103515625.0))*sin(radians(60*exp(-pow((hm-275)/25,2)))) AS rt FROM s4),
s6 AS MATERIALIZED (SELECT pair_id, (l2-l1)/sl AS tl, (c2-c1)/sc AS tc, dhh/(1+0.015*cm*t) AS th, rt FROM s5),
de AS MATERIALIZED (SELECT pair_id, sqrt(greatest(0.0, tl*tl+tc*tc+th*th+rt*tc*th)) AS de FROM s6),
t AS (SELECT pair_id, avg(de) AS "deltaE", avg(CASE WHEN de > 5 THEN 1.0 ELSE 0.0 END) AS changed FROM de GROUP BY pair_id)
"""
for _name in ("deltaE", "changed"):
    query(_name, _DELTA + f"""SELECT pair_id, round("{_name}", 6) AS value, {sql_verdict(_name, f'"{_name}"')} AS verdict FROM t""")(
        lambda s, d, n=_name: N.delta_e(_pair_pixels(s, d)).select("pair_id", r6(n, "value"), D.verdict_of(n, F.col(n)).alias("verdict"))
    )


@query("carlini", f"""WITH {_PX}, t AS (SELECT pair_id, (y//4)*4+x//4 AS tile, sqrt(avg(((r1-r2)*(r1-r2)+(g1-g2)*(g1-g2)+(b1-b2)*(b1-b2))/(3.0*65025))) AS rms FROM pp GROUP BY 1, 2),
m AS (SELECT pair_id, max(rms) AS v FROM t GROUP BY pair_id) SELECT pair_id, round(v, 6) AS value, {sql_verdict('carlini', 'v')} AS verdict FROM m""")
def carlini(spark, sf_dir):
    return N.tile_rms(_pair_pixels(spark, sf_dir)).select("pair_id", r6("carlini", "value"), D.verdict_of("carlini", F.col("carlini")).alias("verdict"))


_BIN = {"rgb": "(r>>5)*64+(g>>5)*8+(b>>5)", "luma": "CAST(floor(l+0.5) AS INT)", "grey": "v"}


def _hist_sql(bins: str) -> str:
    n = 512 if bins == "rgb" else 256
    return f"""{_PX}, h AS (SELECT doc_id, {_BIN[bins]} AS bin, count(*)/256.0 AS p FROM gr GROUP BY 1, 2),
ids AS (SELECT DISTINCT p.doc_id AS pair_id FROM h p JOIN h q ON q.doc_id = p.doc_id + 1),
f AS (SELECT ids.pair_id AS pair_id, b.bin AS bin, coalesce(p.p, 0.0) AS p, coalesce(q.p, 0.0) AS q FROM ids CROSS JOIN range({n}) b(bin)
LEFT JOIN h p ON p.doc_id = ids.pair_id AND p.bin = b.bin LEFT JOIN h q ON q.doc_id = ids.pair_id + 1 AND q.bin = b.bin)"""


_RGB = {
    "histCorrel": "CASE WHEN sqrt((sum(p*p)-1/512.0)*(sum(q*q)-1/512.0)) > 1e-15 THEN (sum(p*q)-1/512.0)/sqrt((sum(p*p)-1/512.0)*(sum(q*q)-1/512.0)) ELSE 1.0 END",
    "histChi": "sum(CASE WHEN p+q > 0 THEN (p-q)*(p-q)/(p+q) ELSE 0.0 END)/2",
    "histIntersect": "sum(least(p, q))",
    "histBhatt": "sqrt(greatest(0.0, 1-sum(sqrt(p*q))))",
    "klDiv": "sum(CASE WHEN p > 1e-12 THEN p*ln(p/CASE WHEN q > 1e-12 THEN q ELSE 1e-10 END) ELSE 0.0 END)",
    "jsDiv": "sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p*log2(p/((p+q)/2)) ELSE 0.0 END + CASE WHEN q > 0 THEN q*log2(q/((p+q)/2)) ELSE 0.0 END)/2))",
}
for _name, _expr in _RGB.items():
    query(_name, f"WITH {_hist_sql('rgb')}, t AS (SELECT pair_id, {_expr} AS v FROM f GROUP BY pair_id) SELECT pair_id, round(v, 6) AS value, {sql_verdict(_name, 'v')} AS verdict FROM t")(
        lambda s, d, n=_name: N.rgb_scores(X.packed(s, d)).select("pair_id", r6(n, "value"), D.verdict_of(n, F.col(n)).alias("verdict"))
    )

for _name, _bins, _col, _expr in (("lumaEmd", "luma", "emd", "sum(abs(cp-cq))/255"), ("ksLuma", "grey", "ks", "max(abs(cp-cq))")):
    query(_name, f"""WITH {_hist_sql(_bins)}, c AS (SELECT pair_id, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM f WINDOW w AS (PARTITION BY pair_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
t AS (SELECT pair_id, {_expr} AS v FROM c GROUP BY pair_id) SELECT pair_id, round(v, 6) AS value, {sql_verdict(_name, 'v')} AS verdict FROM t""")(
        lambda s, d, n=_name, b=_bins, c=_col: N.running_scores(X.packed(s, d), b).select("pair_id", r6(c, "value"), D.verdict_of(n, F.col(c)).alias("verdict"))
    )

_HSV = """hs AS (SELECT doc_id, greatest(r,g,b)/255.0 AS hi, (greatest(r,g,b)-least(r,g,b))/255.0 AS sp, r/255.0 AS r, g/255.0 AS g, b/255.0 AS b FROM px),
hv AS (SELECT doc_id, CASE WHEN sp = 0 THEN 0.0 WHEN r = hi THEN ((g-b)/sp - 6*floor((g-b)/sp/6))/6 WHEN g = hi THEN ((b-r)/sp+2)/6 ELSE ((r-g)/sp+4)/6 END AS h, CASE WHEN hi > 0 THEN sp/hi ELSE 0.0 END AS s, hi AS v FROM hs)"""


@query("hsvMoments", f"""WITH {_PX}, {_HSV}, m AS (SELECT doc_id, avg(h) AS h1, avg(s) AS s1, avg(v) AS v1, avg(h*h) AS h2, avg(s*s) AS s2, avg(v*v) AS v2, avg(h*h*h) AS h3, avg(s*s*s) AS s3, avg(v*v*v) AS v3 FROM hv GROUP BY doc_id),
n AS (SELECT doc_id, h1, s1, v1, sqrt(greatest(0.0, h2-h1*h1)) AS hd, sqrt(greatest(0.0, s2-s1*s1)) AS sd, sqrt(greatest(0.0, v2-v1*v1)) AS vd, cbrt(h3-3*h1*h2+2*h1*h1*h1) AS hc, cbrt(s3-3*s1*s2+2*s1*s1*s1) AS sc, cbrt(v3-3*v1*v2+2*v1*v1*v1) AS vc FROM m)
SELECT a.doc_id AS pair_id, round(abs(a.h1-b.h1)+abs(a.s1-b.s1)+abs(a.v1-b.v1)+abs(a.hd-b.hd)+abs(a.sd-b.sd)+abs(a.vd-b.vd)+abs(a.hc-b.hc)+abs(a.sc-b.sc)+abs(a.vc-b.vc), 4) AS value FROM n a JOIN n b ON b.doc_id = a.doc_id + 1""")
def hsv_moments(spark, sf_dir):
    m = N.hsv_moments(X.packed(spark, sf_dir))
    b = m.select((F.col("doc_id") - 1).alias("pair_id"), F.col("m").alias("mb"))
    return m.select(F.col("doc_id").alias("pair_id"), "m").join(b, "pair_id").select("pair_id", F.round(V.l1(F.col("m"), F.col("mb")), 4).alias("value"))


@query("meanColor", f"""WITH {_PX}, m AS (SELECT doc_id, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px GROUP BY doc_id)
SELECT p.doc_id AS pair_id, round(sqrt((p.r-q.r)*(p.r-q.r)+(p.g-q.g)*(p.g-q.g)+(p.b-q.b)*(p.b-q.b)), 6) AS value FROM m p JOIN m q ON q.doc_id = p.doc_id + 1""")
def mean_colour(spark, sf_dir):
    """Distance of the average colours; the kernel of the same name measures it by CIEDE2000."""
    m = X.pixels(X.packed(spark, sf_dir)).groupBy("doc_id").agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"))
    q = m.select((F.col("doc_id") - 1).alias("doc_id"), *[F.col(c).alias(f"{c}2") for c in "rgb"])
    return m.join(q, "doc_id").select(F.col("doc_id").alias("pair_id"), F.round(F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in "gb"), (F.col("r") - F.col("r2")) ** 2)), 6).alias("value"))


_HASH = {
    "dhash": "SELECT doc_id, i, lead(v) OVER (PARTITION BY doc_id, y ORDER BY x) > v AS bit FROM gr",
    "dhashVertical": "SELECT doc_id, i, lead(v) OVER (PARTITION BY doc_id, x ORDER BY y) > v AS bit FROM gr",
    "ahash": "SELECT doc_id, i, v > avg(v) OVER (PARTITION BY doc_id) AS bit FROM gr",
    "whash": "SELECT doc_id, i, s > m AS bit FROM (SELECT doc_id, i, s FROM (SELECT doc_id, (y//2)*8+x//2 AS i, sum(v) AS s FROM gr GROUP BY 1, 2)) JOIN (SELECT doc_id, median(s) AS m FROM (SELECT doc_id, (y//2)*8+x//2 AS i, sum(v) AS s FROM gr GROUP BY 1, 2) GROUP BY doc_id) USING (doc_id)",
    "blockMean0": "SELECT doc_id, i, s*256 >= 4*t AS bit FROM (SELECT doc_id, (y//2)*8+x//2 AS i, sum(v) AS s FROM gr GROUP BY 1, 2) JOIN (SELECT doc_id, sum(v) AS t FROM gr GROUP BY doc_id) USING (doc_id)",
}
for _name, _sql in _HASH.items():
    query(f"{_name}_cells", f"WITH {_PX}, h AS ({_sql}), t AS (SELECT p.doc_id AS pair_id, CAST(sum(CASE WHEN p.bit <> q.bit THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM h p JOIN h q ON q.doc_id = p.doc_id + 1 AND q.i = p.i GROUP BY 1) SELECT pair_id, v AS value, {sql_verdict(_name, 'v')} AS verdict FROM t")(
        lambda s, d, n=_name: N.hash_distances(N.hash_bits(X.packed(s, d)).select("doc_id", n)).select("pair_id", F.col(n).alias("value"), D.verdict_of(n, F.col(n)).alias("verdict"))
    )


@query("glcm_cells", f"""WITH {_PX}, q AS (SELECT doc_id, y, x, v*32//256 AS q FROM gr), c AS (SELECT a.doc_id AS doc_id, a.q AS i, b.q AS j FROM q a JOIN q b ON b.doc_id = a.doc_id AND b.y = a.y AND b.x = a.x + 1),
s AS (SELECT doc_id, i, j FROM c UNION ALL SELECT doc_id, j, i FROM c), p AS (SELECT doc_id, i, j, count(*)/480.0 AS p FROM s GROUP BY 1, 2, 3)
SELECT doc_id, round(sum(p*(i-j)*(i-j)), 6) AS contrast, round(sum(p*abs(i-j)), 6) AS dissimilarity, round(sum(p/(1.0+(i-j)*(i-j))), 6) AS homogeneity, CAST(round(sum(p*p)*230400) AS BIGINT) AS asm FROM p GROUP BY doc_id""")
def glcm_cells(spark, sf_dir):
    return N.cooccurrence(X.packed(spark, sf_dir)).select("doc_id", r6("contrast"), r6("dissimilarity"), r6("homogeneity"), F.round(F.col("asm") * 230400).cast("long").alias("asm"))


@query("structure", f"""WITH {_PX}, n AS (SELECT doc_id, l, lead(l) OVER (PARTITION BY doc_id, y ORDER BY x) AS n FROM gr),
a AS (SELECT doc_id, avg(l) AS m, stddev_pop(l) AS sd, avg(CASE WHEN n IS NOT NULL THEN l*n END) AS ln, avg(CASE WHEN n IS NOT NULL THEN l END) AS l1, avg(n) AS n1 FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN sd < 2.5 THEN 'flat' WHEN (ln-m*(l1+n1)+m*m)/(sd*sd) < 0.3 THEN 'noise' ELSE 'normal' END AS structure FROM a""")
def structure(spark, sf_dir):
    return N.structure(X.packed(spark, sf_dir))


@query("evidence_peaks", f"""WITH {_PX}, h AS (SELECT doc_id, y, x, v, max(v) OVER (PARTITION BY doc_id) AS top, greatest(coalesce(lag(v) OVER w, -1), coalesce(lead(v) OVER w, -1)) AS side, greatest(v, coalesce(lag(v) OVER w, -1), coalesce(lead(v) OVER w, -1)) AS three FROM gr WINDOW w AS (PARTITION BY doc_id, y ORDER BY x)),
k AS (SELECT doc_id, y, x, v, top, side, coalesce(lag(three) OVER u, -1) AS up, coalesce(lead(three) OVER u, -1) AS down FROM h WINDOW u AS (PARTITION BY doc_id, x ORDER BY y)),
r AS (SELECT doc_id, y, x, v, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, y, x) AS rank FROM k WHERE v >= 0.45*top AND v > greatest(side, up, down)) SELECT doc_id, rank, y, x, v FROM r WHERE rank <= 3""")
def evidence_peaks(spark, sf_dir):
    return N.peaks(X.packed(spark, sf_dir))


# ---- numpy kernels over neighbouring texts -------------------------------------------------------

#: The second image cut down, to be searched for in the first.
_CROPS = {"crop": lambda a, b: registration.crop_search(a, b[16:40, 16:40])}
#: A small preview of the first image against the second.
_PREVIEWS = {"thumbnail": lambda a, b: float(min((imagehash.difference(registration.P.resize(a, 32, 32)) != imagehash.difference(z)).sum() for z in (a, b)) <= 10)}
RASTER_KERNELS = fullreference.KERNELS | imagehash.KERNELS | descriptors.KERNELS | registration.KERNELS | watermark.KERNELS | _CROPS | _PREVIEWS


def _kernel_query(name: str, kernels: dict, side: int | None):
    def run(spark, sf_dir):
        rows = X.kernel_neighbours(_docs(spark, sf_dir), {name: kernels[name]}, side)
        found = F.when(F.col("error").isNotNull(), "error").otherwise(D.verdict_of(name, F.col("value")))
        return rows.select("pair_id", "value", found.alias("verdict"), "error")

    return run


#: Cells a side of the rasters that kernels read.
KERNEL_SIDE = 64
for _name in RASTER_KERNELS:
    QUERIES[_name if _name not in QUERIES else f"{_name}_kernel"] = _kernel_query(_name, RASTER_KERNELS, KERNEL_SIDE)
for _name in fuzzy.KERNELS:
    QUERIES[_name] = _kernel_query(_name, fuzzy.KERNELS, None)
QUERIES["ncd_bytes"] = lambda s, d: X.kernel_neighbours(_docs(s, d), {"ncd": fullreference.ncd_bytes}, None).select("pair_id", "value")

# ---- vectors -------------------------------------------------------------------------------------

_VP = "vp AS (SELECT p.vec_id AS pair_id, p.embedding::DOUBLE[] AS a, q.embedding::DOUBLE[] AS b, p.label = q.label AS same FROM embeddings p JOIN embeddings q ON q.vec_id = p.vec_id + 1)"
_COS = "list_dot_product(a, b)/(sqrt(list_dot_product(a, a))*sqrt(list_dot_product(b, b)))"

for _name in ("sscd", "sscdLarge", "dino", "clip"):
    query(f"{_name}_vectors", f"WITH {_VP}, t AS (SELECT pair_id, {_COS} AS v FROM vp) SELECT pair_id, round(v, 6) AS value, {sql_verdict(_name, 'v')} AS verdict FROM t")(
        lambda s, d, n=_name: X.vector_pairs(s, d).select("pair_id", V.cosine(F.col("a"), F.col("b")).alias("v")).select("pair_id", r6("v", "value"), D.verdict_of(n, F.col("v")).alias("verdict"))
    )


@query("dreamsim_vectors", f"WITH {_VP}, t AS (SELECT pair_id, 1-{_COS} AS v FROM vp) SELECT pair_id, round(v, 6) AS value, {sql_verdict('dreamsim', 'v')} AS verdict FROM t")
def dreamsim_vectors(spark, sf_dir):
    rows = X.vector_pairs(spark, sf_dir).select("pair_id", (1 - V.cosine(F.col("a"), F.col("b"))).alias("v"))
    return rows.select("pair_id", r6("v", "value"), D.verdict_of("dreamsim", F.col("v")).alias("verdict"))


_UN = "u AS (SELECT pair_id, unnest(a) AS x, unnest(b) AS y FROM vp)"


@query("vector_distances", f"""WITH {_VP}, {_UN} SELECT pair_id, round(sqrt(sum((x-y)*(x-y))), 6) AS euclidean, round(sum(CASE WHEN abs(x)+abs(y) > 0 THEN abs(x-y)/(abs(x)+abs(y)) ELSE 0.0 END)/64, 6) AS canberra,
round(sum(abs(x-y)), 6) AS l1, round(sum(CASE WHEN abs(x)+abs(y) > 0 THEN (abs(x)-abs(y))*(abs(x)-abs(y))/(abs(x)+abs(y)) ELSE 0.0 END)/2, 6) AS chi_square, round(sum(abs(abs(x)-abs(y))/(1+abs(x)+abs(y))), 6) AS relative_l1,
CAST(sum(CASE WHEN (x > 0) <> (y > 0) THEN 1 ELSE 0 END) AS BIGINT) AS sign_bits FROM u GROUP BY pair_id""")
def vector_distances(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    p, q = F.transform(a, lambda x: F.abs(x.cast("double"))), F.transform(b, lambda x: F.abs(x.cast("double")))
    bits = V.hamming(V.sign_bits(a, 2), V.sign_bits(b, 2)).cast("long")
    return X.vector_pairs(spark, sf_dir).select(
        "pair_id", F.round(V.euclidean(a, b), 6).alias("euclidean"), F.round(V.canberra(a, b), 6).alias("canberra"), F.round(V.l1(a, b), 6).alias("l1"),
        F.round(V.chi_square(p, q), 6).alias("chi_square"), F.round(V.relative_l1(p, q), 6).alias("relative_l1"), bits.alias("sign_bits"),
    )


_SIDES = "l AS (SELECT label AS pair_id, vec_id AS ia, embedding::DOUBLE[] AS va FROM embeddings), r AS (SELECT label-1 AS pair_id, vec_id AS ib, embedding::DOUBLE[] AS vb FROM embeddings), s AS (SELECT CAST(l.pair_id AS BIGINT) AS pair_id, ia, ib, list_dot_product(va, vb) AS sim FROM l JOIN r USING (pair_id))"


@query("dinoParts", f"""WITH {_SIDES}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ia ORDER BY sim DESC, ib) AS ra, row_number() OVER (PARTITION BY pair_id, ib ORDER BY sim DESC, ia) AS rb FROM s) SELECT pair_id, ia, ib, round(sim, 6) AS sim FROM k WHERE ra = 1 AND rb = 1""")
def dino_parts(spark, sf_dir):
    return N.mutual_matches(X.vectors(spark, sf_dir)).select("pair_id", "ia", "ib", r6("sim"))


@query("ratio_matches", f"""WITH {_SIDES}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ia ORDER BY sim DESC, ib) AS ra FROM s), t AS (SELECT pair_id, ia, max(CASE WHEN ra = 1 THEN ib END) AS ib, max(CASE WHEN ra = 1 THEN sqrt(greatest(0.0, 2-2*sim)) END) AS d1, max(CASE WHEN ra = 2 THEN sqrt(greatest(0.0, 2-2*sim)) END) AS d2 FROM k WHERE ra <= 2 GROUP BY 1, 2)
SELECT pair_id, ia, ib, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM t WHERE d1 < 0.95*d2""")
def ratio_matches(spark, sf_dir):
    return N.ratio_matches(X.vectors(spark, sf_dir)).select("pair_id", "ia", "ib", r6("d1"), r6("d2"))


@query("evaluate_auc", f"""WITH {_VP}, t AS (SELECT {_COS} AS v, same FROM vp), p AS (SELECT v FROM t WHERE same), n AS (SELECT v FROM t WHERE NOT same), q AS (SELECT quantile_cont(v, 0.99) AS thr FROM n)
SELECT round((SELECT avg(CASE WHEN p.v > n.v THEN 1.0 WHEN p.v = n.v THEN 0.5 ELSE 0.0 END) FROM p, n), 6) AS auc, round((SELECT thr FROM q), 6) AS thr, round((SELECT avg(CASE WHEN v > (SELECT thr FROM q) THEN 1.0 ELSE 0.0 END) FROM p), 6) AS tpr1""")
def evaluate_auc(spark, sf_dir):
    scores = X.vector_pairs(spark, sf_dir).select(V.cosine(F.col("a"), F.col("b")).alias("score"), F.col("same").cast("int").alias("label"))
    return N.auc(scores).select(r6("auc"), r6("thr"), r6("tpr1"))


@query("recall_by_kind", f"""WITH {_VP}, t AS (SELECT pair_id, {_COS} AS v, same FROM vp), q AS (SELECT quantile_cont(v, 0.99) AS thr FROM t WHERE NOT same), k AS (SELECT CAST(e.label AS INT) AS kind, t.v AS v FROM t JOIN embeddings e ON e.vec_id = t.pair_id)
SELECT kind, count(*) AS n, round(avg(CASE WHEN v > (SELECT thr FROM q) THEN 1.0 ELSE 0.0 END), 6) AS recall, round(max(v), 6) AS largest FROM k GROUP BY kind""")
def recall_by_kind(spark, sf_dir):
    v = X.vector_pairs(spark, sf_dir).select("pair_id", V.cosine(F.col("a"), F.col("b")).alias("v"), "same")
    thr = v.where(~F.col("same")).agg(F.percentile("v", F.lit(0.99)).alias("thr"))
    kinds = X.vectors(spark, sf_dir).select(F.col("vec_id").alias("pair_id"), F.col("label").cast("int").alias("kind"))
    rows = v.join(kinds, "pair_id").crossJoin(F.broadcast(thr))  # one row
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("v") > F.col("thr")).cast("double")), 6).alias("recall"), F.round(F.max("v"), 6).alias("largest"))


@query("calibrate", f"WITH {_VP}, t AS (SELECT {_COS} AS v FROM vp WHERE NOT same) SELECT round(quantile_cont(v, 0.99), 6) AS match_line, round(quantile_cont(v, 0.95), 6) AS partial_line, count(*) AS n FROM t")
def calibrate(spark, sf_dir):
    """Thresholds that 1 % and 5 % of unrelated pairs pass."""
    v = X.vector_pairs(spark, sf_dir).where(~F.col("same")).select(V.cosine(F.col("a"), F.col("b")).alias("v"))
    return v.agg(F.round(F.percentile("v", F.lit(0.99)), 6).alias("match_line"), F.round(F.percentile("v", F.lit(0.95)), 6).alias("partial_line"), F.count(F.lit(1)).alias("n"))


@query("quantise_drift")
def quantise_drift(spark, sf_dir):
    """How far cosines move when vectors are stored in eight bits."""
    a, b = F.col("a"), F.col("b")
    return X.vector_pairs(spark, sf_dir).select("pair_id", F.round(F.abs(V.cosine(a, b) - V.cosine(V.quantised(a), V.quantised(b))), 6).alias("drift"))


# ---- objects and poses ---------------------------------------------------------------------------

_DET = """det AS (SELECT vec_id AS img, k, CAST(floor(128+256*e[8*k+1]) AS BIGINT) AS x1, CAST(floor(128+256*e[8*k+2]) AS BIGINT) AS y1, CAST(floor(128+256*e[8*k+1])+16+floor(256*abs(e[8*k+3])) AS BIGINT) AS x2, CAST(floor(128+256*e[8*k+2])+16+floor(256*abs(e[8*k+4])) AS BIGINT) AS y2,
1+(vec_id+k)%12 AS label_id, round(least(1.0, 4*abs(e[8*k+5])), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(8) t(k))"""
_IOU = "(greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)))"


@query("object_pairs", f"""WITH {_DET}, j AS (SELECT a.img AS pair_id, a.k AS a_k, b.k AS b_k, a.label_id = b.label_id AS same, {_IOU}/CAST((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-{_IOU} AS DOUBLE) AS iou FROM det a JOIN det b ON b.img = a.img + 1),
r AS (SELECT *, iou + CASE WHEN same THEN 0.1 ELSE 0.0 END AS s FROM j WHERE iou >= 0.3), t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, a_k ORDER BY s DESC, b_k) AS n FROM r) SELECT pair_id, CAST(a_k AS INT) AS a_k, CAST(b_k AS INT) AS b_k, round(iou, 6) AS iou, round(s, 6) AS rank_score FROM t WHERE n = 1""")
def object_pairs(spark, sf_dir):
    return N.best_boxes(X.detections(spark, sf_dir)).select("pair_id", "a_k", "b_k", r6("iou"), r6("rank_score"))


@query("objectLabels", f"""WITH {_DET}, kd AS (SELECT DISTINCT img, CASE WHEN label_id <= 9 THEN label_id % 4 ELSE label_id END AS kind FROM det WHERE score >= 0.5), im AS (SELECT DISTINCT vec_id AS img FROM embeddings),
u AS (SELECT p.img AS pair_id, (SELECT count(*) FROM kd a JOIN kd b ON a.kind = b.kind WHERE a.img = p.img AND b.img = p.img + 1) AS shared, (SELECT count(DISTINCT kind) FROM kd a WHERE a.img = p.img OR a.img = p.img + 1) AS every FROM im p JOIN im q ON q.img = p.img + 1),
t AS (SELECT pair_id, CASE WHEN every > 0 THEN shared/CAST(every AS DOUBLE) END AS v FROM u) SELECT pair_id, round(v, 6) AS value, {sql_verdict('objectLabels', 'v')} AS verdict FROM t""")
def object_labels(spark, sf_dir):
    return N.kinds_in_common(X.detections(spark, sf_dir)).select("pair_id", r6("value"), D.verdict_of("objectLabels", F.col("value")).alias("verdict"))


@query("nested_boxes", f"WITH {_DET} SELECT a.img AS img, CAST(a.k AS INT) AS inner_k, CAST(b.k AS INT) AS outer_k FROM det a JOIN det b ON a.img = b.img AND a.k <> b.k AND a.x1 >= b.x1 AND a.y1 >= b.y1 AND a.x2 <= b.x2 AND a.y2 <= b.y2")
def nested_boxes(spark, sf_dir):
    return N.nested_boxes(X.detections(spark, sf_dir))


_JT = "jt AS (SELECT vec_id AS img, j, round(100*e[3*j+1], 6) AS x, round(100*e[3*j+2], 6) AS y, round(least(1.0, 4*abs(e[3*j+3])), 6) AS conf FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(17) t(j))"


@query("pose", f"""WITH {_JT}, w AS (SELECT a.img AS pair_id, a.x AS x, a.y AS y, b.x AS u, b.y AS v FROM jt a JOIN jt b ON b.img = a.img + 1 AND b.j = a.j WHERE a.conf >= 0.3 AND b.conf >= 0.3),
s AS (SELECT pair_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, sum(x*x+y*y) AS xx, sum(u*u+v*v) AS uu, sum(u*x+v*y) AS re, sum(u*y-v*x) AS im FROM w GROUP BY pair_id HAVING count(*) >= 5),
f AS (SELECT pair_id, n, mx, my, mu, mv, xx-n*(mx*mx+my*my) AS sxx, uu-n*(mu*mu+mv*mv) AS suu, re-n*(mu*mx+mv*my) AS re, im-n*(mu*my-mv*mx) AS im FROM s),
d AS (SELECT w.pair_id AS pair_id, pow(x-(mx+(re*(u-mu)-im*(v-mv))/suu), 2)+pow(y-(my+(re*(v-mv)+im*(u-mu))/suu), 2) AS d2, sxx/n AS spread FROM w JOIN f USING (pair_id)),
t AS (SELECT pair_id, avg(exp(-d2/(2*0.0225*spread))) AS v FROM d GROUP BY pair_id) SELECT pair_id, round(v, 6) AS value, {sql_verdict('pose', 'v')} AS verdict FROM t""")
def pose(spark, sf_dir):
    return N.pose_similarity(X.joints(spark, sf_dir)).select("pair_id", r6("value"), D.verdict_of("pose", F.col("value")).alias("verdict"))


@query("object_assignment")
def object_assignment(spark, sf_dir):
    """One-to-one pairs of the boxes of neighbouring images, by falling overlap."""
    pairs = N.box_pairs(X.detections(spark, sf_dir)).withColumn("score", N.iou()).where("score >= 0.3")
    return localise.greedy_assignment(pairs.select("pair_id", F.col("a_k").cast("int").alias("a_k"), F.col("b_k").cast("int").alias("b_k"), F.col("score").cast("double").alias("score")))


@query("suppress")
def suppress(spark, sf_dir):
    return localise.suppress(X.detections(spark, sf_dir))


_PLACE = "CASE WHEN r = 'middle' AND c = 'centre' THEN 'centre' ELSE r || ' ' || c END"


@query("place_name", f"""WITH p AS (SELECT vec_id, CASE WHEN (embedding[1]::DOUBLE*3+1)/2 < 1/3.0::DOUBLE THEN 'left' WHEN (embedding[1]::DOUBLE*3+1)/2 > 2/3.0::DOUBLE THEN 'right' ELSE 'centre' END AS c, CASE WHEN (embedding[2]::DOUBLE*3+1)/2 < 1/3.0::DOUBLE THEN 'top' WHEN (embedding[2]::DOUBLE*3+1)/2 > 2/3.0::DOUBLE THEN 'bottom' ELSE 'middle' END AS r FROM embeddings) SELECT vec_id, {_PLACE} AS place FROM p""")
def place_name(spark, sf_dir):
    at = lambda k: (F.get("v", F.lit(k)).cast("double") * 3 + 1) / 2
    return X.vectors(spark, sf_dir).select("vec_id", localise.place_name(at(0), at(1)).alias("place"))


@query("two_lenses", "WITH " + _VP + ", t AS (SELECT pair_id, list_dot_product(a, b) AS d FROM vp) SELECT pair_id, CASE WHEN 0.4+d >= 0.4 AND 4*abs(d) >= 0.3 AND 0.5+d >= 0.5 THEN 'copied' WHEN 0.5+d >= 0.6 THEN 'similar' ELSE 'none' END AS lens FROM t")
def two_lenses(spark, sf_dir):
    d = X.vector_pairs(spark, sf_dir).select("pair_id", V.dot(F.col("a"), F.col("b")).alias("d"))
    return d.select("pair_id", localise.two_lenses(0.4 + F.col("d"), 4 * F.abs("d"), 0.5 + F.col("d")).alias("lens"))


@query("arrow_pattern")
def arrow_pattern(spark, sf_dir):
    """How matched vectors moved between labels: mutual matches as links."""
    v = X.vectors(spark, sf_dir)
    at = lambda name, k: F.get(name, F.lit(k)).cast("double")
    links = N.mutual_matches(v).join(v.select(F.col("vec_id").alias("ia"), F.col("v").alias("va")), "ia").join(v.select(F.col("vec_id").alias("ib"), F.col("v").alias("vb")), "ib")
    return localise.arrow_pattern(links.select("pair_id", at("va", 0).alias("ax"), at("va", 1).alias("ay"), at("vb", 0).alias("bx"), at("vb", 1).alias("by"), F.col("sim").alias("w")))


@query("xfeat")
def xfeat(spark, sf_dir):
    """Learned keypoints: mutual matches of descriptors, then inliers of one homography for each image pair."""
    v = X.vectors(spark, sf_dir)
    at = lambda name, k: (100 * F.get(name, F.lit(k)).cast("double"))
    m = N.mutual_matches(v).join(v.select(F.col("vec_id").alias("ia"), F.col("v").alias("va")), "ia").join(v.select(F.col("vec_id").alias("ib"), F.col("v").alias("vb")), "ib")
    points = m.select("pair_id", "ia", at("va", 0).alias("xa"), at("va", 1).alias("ya"), at("vb", 0).alias("xb"), at("vb", 1).alias("yb"))
    found = localise.consistent(points)
    ratio = F.col("inliers") / F.col("matches")
    return found.select("pair_id", "matches", "inliers", "sane", D.keypoint_verdict(F.col("inliers"), ratio, F.col("sane")).alias("verdict"))


@query("objects")
def objects(spark, sf_dir):
    """Share of the larger image's objects that pair up, and of those the share that is unchanged."""
    det = X.detections(spark, sf_dir)
    pairs = object_assignment(spark, sf_dir).groupBy("pair_id").agg(F.count(F.lit(1)).alias("paired"), F.count_if(F.col("score") >= 0.8).alias("unchanged"))
    n = det.groupBy("img").agg(F.count(F.lit(1)).alias("n"))
    both = n.select(F.col("img").alias("pair_id"), F.col("n").alias("na")).join(n.select((F.col("img") - 1).alias("pair_id"), F.col("n").alias("nb")), "pair_id").join(pairs, "pair_id", "left")
    most = F.greatest("na", "nb")
    share, same = F.coalesce("paired", F.lit(0)) / most, F.coalesce("unchanged", F.lit(0)) / most
    return both.select("pair_id", F.round(share, 6).alias("paired"), F.round(same, 6).alias("unchanged"), F.when(same >= 0.8, "match").when(share >= 0.5, "partial").otherwise("none").alias("verdict"))


@query("label_for", f"""WITH {_DET}, p AS (SELECT a.img AS img, a.k AS k, b.k AS lk, ({_IOU}*1.0/((a.x2-a.x1)*(a.y2-a.y1)))*({_IOU}*1.0/((b.x2-b.x1)*(b.y2-b.y1))) AS s FROM det a JOIN det b ON a.img = b.img AND a.k <> b.k WHERE (b.x2-b.x1)*(b.y2-b.y1) <= 0.85*512*512),
r AS (SELECT img, k, lk, s, row_number() OVER (PARTITION BY img, k ORDER BY s DESC, lk) AS n FROM p WHERE s >= 0.2) SELECT img, CAST(k AS INT) AS k, CAST(lk AS INT) AS label_k, round(s, 6) AS score FROM r WHERE n = 1""")
def label_for(spark, sf_dir):
    """For each region the detection that covers it and is covered by it best."""
    det = X.detections(spark, sf_dir)
    cols = ("k", "x1", "y1", "x2", "y2")
    a = det.select("img", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = det.select("img", *[F.col(c).alias(f"b_{c}") for c in cols])
    rows = a.join(b, "img").where((F.col("a_k") != F.col("b_k")) & (N.area("b_") <= 0.85 * 512 * 512))
    both = N.overlap("a_", "b_")
    rows = rows.withColumn("s", (both / N.area("a_")) * (both / N.area("b_"))).where("s >= 0.2")
    best = rows.groupBy("img", "a_k").agg(F.max(F.struct("s", (-F.col("b_k")).alias("neg"))).alias("m"))
    return best.select("img", F.col("a_k").cast("int").alias("k"), (-F.col("m.neg")).cast("int").alias("label_k"), F.round("m.s", 6).alias("score"))


@query("details", "SELECT a.p_partkey AS pair_id, 'brand' AS property, a.p_brand AS a, b.p_brand AS b, a.p_brand = b.p_brand AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT a.p_partkey, 'size', CAST(a.p_size AS VARCHAR), CAST(b.p_size AS VARCHAR), a.p_size = b.p_size FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT a.p_partkey, 'type', a.p_type, b.p_type, a.p_type = b.p_type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def details(spark, sf_dir):
    """Properties of both sides of a pair, one a row, and whether they agree."""
    p = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("stack(3, 'brand', p_brand, 'size', cast(p_size as string), 'type', p_type) as (property, value)"))
    b = p.select((F.col("id") - 1).alias("id"), "property", F.col("value").alias("b"))
    return p.join(b, ["id", "property"]).select(F.col("id").alias("pair_id"), "property", F.col("value").alias("a"), "b", (F.col("value") == F.col("b")).alias("same"))


@query("aspect_label", "SELECT p_partkey, CAST(p_size // gcd(p_size, p_partkey % 7 + 1) AS VARCHAR) || ':' || CAST((p_partkey % 7 + 1) // gcd(p_size, p_partkey % 7 + 1) AS VARCHAR) AS aspect, least(p_size, p_partkey % 7 + 1) < 64 AS tiny FROM part")
def aspect_label(spark, sf_dir):
    """Aspect ratio in lowest terms, and the caveat for very small images."""
    w, h = F.col("p_size").cast("long"), F.col("p_partkey") % 7 + 1
    # sides up to 64 here: the largest common divisor by trying all
    gcd = F.array_max(F.filter(F.sequence(F.lit(1), F.least(w, h)), lambda d: (w % d == 0) & (h % d == 0)))
    return X.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", (w / gcd).cast("long"), (h / gcd).cast("long")).alias("aspect"), (F.least(w, h) < 64).alias("tiny"))


@query("robustness")
def robustness(spark, sf_dir):
    """Share of rasters whose edited copy is within the match line, for each edit and hash: per-edit recall."""
    from .operators.edits import EDITS, EDITS_MANY

    names = ("phash", "dhash", "pdq", "blockMean0")
    lines = {h: float(catalogue.thresholds(h)[1]) for h in names}
    schema = "edit string, hash string, n long, known long, hits long, error string"
    failures, together = (ArithmeticError, ValueError, IndexError, TypeError), 32

    def one(a, found):
        """A raster's counts, where a failure of one edit or hash leaves the others."""
        own = {}
        for e, edit in EDITS.items():
            for h in names:
                at, kernel = found[e, h], imagehash.KERNELS[h]
                try:
                    if h not in own:
                        own[h] = kernel.describe(a)
                    value = kernel.compare(own[h], kernel.describe(edit(a)))
                    at[1], at[2] = at[1] + 1, at[2] + (value <= lines[h])
                except failures as x:
                    at[3] = max(filter(None, (at[3], f"{type(x).__name__}: {x}")))

    def many(rasters):
        """Hits of rasters by edit and hash; an edit is made once for all hashes, and own hashes once for all edits."""
        planes = np.ascontiguousarray(np.moveaxis(np.array(rasters), -1, 0))
        hashes = lambda x, grey: {h: imagehash.HASHES_MANY[h](x, grey) for h in names}
        own, hits = hashes(planes, imagehash.P.grey_many(planes)), {}
        for e, edit in EDITS_MANY.items():
            made = edit(planes)
            for h, bits in hashes(made, imagehash.P.grey_many(made)).items():
                hits[e, h] = int(((own[h] != bits).sum(1) <= lines[h]).sum())
        return hits

    def counted(batches):
        """A batch's counts."""
        for batch in batches:
            found = {(e, h): [batch.num_rows, 0, 0, None] for e in EDITS for h in names}
            texts = [t for t in batch.column(0).to_pylist() if t]
            for k in range(0, len(texts), together):
                rasters = [X.raster_of(t, KERNEL_SIDE) for t in texts[k : k + together]]
                try:
                    for key, hits in many(rasters).items():
                        found[key][1] += len(rasters)
                        found[key][2] += hits
                except failures:
                    for a in rasters:
                        one(a, found)
            rows = [(*k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["edit", "hash", "n", "known", "hits", "error"])

    rows = _docs(spark, sf_dir).select("text").repartition(X.parts(spark)).mapInArrow(counted, schema)
    return rows.groupBy("edit", "hash").agg(F.sum("n").alias("n"), F.round(F.sum("hits") / F.nullif(F.sum("known"), F.lit(0)), 6).alias("recall"), F.max("error").alias("error"))


def _grid(side: int, cells: int):
    def describe(img):
        z = registration.P.luma(img).reshape(cells, side // cells, cells, side // cells).swapaxes(1, 2).reshape(cells * cells, -1)
        return z - z.mean()

    return describe


_LOCAL = {
    "differences": lambda a, b: float(len(localise.find_differences(a, b))),
    "evidence_sum": lambda a, b: float(localise.evidence(_grid(64, 8)(a), _grid(64, 8)(b)).sum()),
    "overlap": lambda a, b: float(min(localise.overlap_quad(np.array([[0.9, 0.05, 4], [-0.05, 0.9, 6], [0, 0, 1]]), a.shape, b.shape)[:2])),
    "unmatched_pieces": lambda a, b: float(len(localise.unmatched_pieces(localise.evidence(_grid(64, 8)(a), _grid(64, 8)(b)).max(1).reshape(8, 8), 0.02))),
    "aligned_shift": lambda a, b: float(np.abs(localise.dense_shifts(a, np.roll(a, 2, 1))[..., 1]).max()),
    "copy_links": lambda a, b: float(sum(x["weight"] for x in localise.copy_links(localise.evidence(_grid(64, 8)(a), _grid(64, 8)(b)), (8, 8), (8, 8))["links"])),
}
for _name in _LOCAL:
    QUERIES[_name] = lambda s, d, n=_name: X.kernel_neighbours(_docs(s, d), {n: _LOCAL[n]}, KERNEL_SIDE).select("pair_id", "value", "error")


@query("container_scan")
def container_scan(spark, sf_dir):
    """Texts' rasters as PNG files with a note, read back: format, picture digest, chunks, notes."""
    from .sources import images

    def write(batches):
        for batch in batches:
            out = [images.encode_png(r, {"Title": str(i)}) if (r := X.raster_of(t, X.SIDE)) is not None else b"" for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    files = _docs(spark, sf_dir).select("doc_id", "text").mapInArrow(write, "doc_id long, content binary")
    found = images.read_containers(files, "doc_id")
    return found.select("doc_id", "format", "payload", F.size("segments").alias("n_segments"), F.try_element_at("text", F.lit("Title")).alias("title"))


# ---- metadata ------------------------------------------------------------------------------------


@query("gps", f"""WITH g AS (SELECT c_custkey, (c_custkey*3791%18000)/100.0-90 AS lat, (c_custkey*9173%36000)/100.0-180 AS lon FROM customer),
d AS (SELECT a.c_custkey AS pair_id, 2*6371008.8*asin(least(1.0, sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) AS v FROM g a JOIN g b ON b.c_custkey = a.c_custkey + 1)
SELECT pair_id, round(v, 2) AS value, {sql_verdict('gps', 'v')} AS verdict FROM d""")
def gps(spark, sf_dir):
    k = F.col("c_custkey")
    g = X.table(spark, sf_dir, "customer").select("c_custkey", (k * 3791 % 18000 / 100.0 - 90).alias("lat"), (k * 9173 % 36000 / 100.0 - 180).alias("lon"))
    b = g.select((k - 1).alias("c_custkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = g.join(b, "c_custkey").select(k.alias("pair_id"), C.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("v"))
    return rows.select("pair_id", F.round("v", 2).alias("value"), D.verdict_of("gps", F.col("v")).alias("verdict"))


@query("exif", """WITH m AS (SELECT event_id, json_extract_string(props, '$.k') AS image_id, user_id, CAST(ts AS DATE) AS day FROM events)
SELECT a.event_id AS pair_id, CASE WHEN a.image_id = b.image_id THEN 'same image id' WHEN a.user_id = b.user_id AND a.day = b.day THEN 'same camera and time' WHEN a.user_id = b.user_id THEN 'same camera' WHEN a.day = b.day THEN 'same time' ELSE 'different' END AS agreement FROM m a JOIN m b ON b.event_id = a.event_id + 1""")
def exif(spark, sf_dir):
    m = X.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("image_id"), "user_id", F.to_date("ts").alias("day"))
    b = m.select((F.col("event_id") - 1).alias("event_id"), *[F.col(c).alias(f"{c}_b") for c in ("image_id", "user_id", "day")])
    ladder = N.capture_ladder(F.col("image_id"), F.col("image_id_b"), F.col("user_id"), F.col("user_id_b"), F.col("day"), F.col("day_b"))
    return m.join(b, "event_id").select(F.col("event_id").alias("pair_id"), ladder.alias("agreement"))


@query("cmi", """WITH n AS (SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '<footer>([^<]*)', 1)), '[^a-z0-9]+', ' ', 'g')) AS t FROM pages)
SELECT a.page_id AS pair_id, CASE WHEN a.t = '' THEN 'none' WHEN b.t = '' THEN 'removed' WHEN contains(a.t, b.t) OR contains(b.t, a.t) THEN 'kept' ELSE 'changed' END AS notices FROM n a JOIN n b ON b.page_id = a.page_id + 1""")
def cmi(spark, sf_dir):
    n = X.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<footer>([^<]*)", 1).alias("t"))
    b = n.select((F.col("page_id") - 1).alias("page_id"), F.col("t").alias("tb"))
    return n.join(b, "page_id").select(F.col("page_id").alias("pair_id"), N.notices_kept(F.col("t"), F.col("tb")).alias("notices"))


@query("lineage", """SELECT b.conv_id AS conv_id, b.turn AS turn, a.turn AS parent_turn FROM conversations a JOIN conversations b ON CAST(b.conv_id AS VARCHAR) || '-' || CAST(b.turn - 1 AS VARCHAR) = CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR)""")
def lineage(spark, sf_dir):
    """Derived-from links: the references of one document among the own ids of another."""
    c = X.table(spark, sf_dir, "conversations")
    ident = lambda t: F.concat_ws("-", "conv_id", t)
    own = c.select(ident(F.col("turn")).alias("ident"), F.col("turn").alias("parent_turn"))
    refs = c.select("conv_id", "turn", F.explode(F.array(ident(F.col("turn") - 1))).alias("ident"))
    return refs.join(own, "ident").select("conv_id", "turn", "parent_turn")


@query("c2pa", """SELECT b.conv_id AS conv_id, b.turn AS turn, CASE WHEN count(a.turn) > 0 THEN 'match' ELSE 'none' END AS verdict FROM conversations b LEFT JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 GROUP BY 1, 2""")
def c2pa(spark, sf_dir):
    """Whether a manifest's listed ingredient is a manifest of the store (JSON read by schema)."""
    c = X.table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    label = lambda t: F.concat(F.lit("urn:"), F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    store = c.select("conv_id", "turn", F.to_json(F.struct(label(F.col("turn")).alias("label"), F.array(F.struct(label(F.col("turn") - 1).alias("manifest"))).alias("ingredients"))).alias("manifest"))
    read = store.select("conv_id", "turn", F.from_json("manifest", "label string, ingredients array<struct<manifest: string>>").alias("m"))
    known = read.select(F.col("m.label").alias("ingredient"), F.lit(True).alias("hit"))
    links = read.select("conv_id", "turn", F.explode("m.ingredients.manifest").alias("ingredient")).join(known, "ingredient", "left")
    return links.groupBy("conv_id", "turn").agg(F.max(F.coalesce("hit", F.lit(False))).alias("h")).select("conv_id", "turn", F.when(F.col("h"), "match").otherwise("none").alias("verdict"))


@query("dims", """WITH d AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 7 + 1 AS DOUBLE) AS h FROM part)
SELECT a.p_partkey AS pair_id, CASE WHEN a.w = b.w AND a.h = b.h THEN 'same size' WHEN abs(ln((a.w/a.h)/(b.w/b.h))) < 0.01 THEN 'same aspect' WHEN abs(ln((a.w/a.h)*(b.w/b.h))) < 0.01 THEN 'turned' ELSE 'different' END AS agreement FROM d a JOIN d b ON b.p_partkey = a.p_partkey + 1""")
def dims(spark, sf_dir):
    d = X.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 7 + 1).cast("double").alias("h"))
    b = d.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("w2"), F.col("h").alias("h2"))
    return d.join(b, "p_partkey").select(F.col("p_partkey").alias("pair_id"), N.shape_verdict(F.col("w"), F.col("h"), F.col("w2"), F.col("h2")).alias("agreement"))


_LUM = "[" + ", ".join(map(str, N.LUMINANCE)) + "]"
_QT = "list_transform({lum}, lambda v: CAST(greatest(1, least(255, floor((v*(CASE WHEN {q} < 50 THEN floor(5000.0/{q}) ELSE 200-2*{q} END)+50)/100))) AS INT))".replace("{lum}", _LUM)


@query("jpegq", f"""WITH o AS (SELECT o_orderkey, 1 + o_orderkey % 100 AS q0 FROM orders), c AS (SELECT CAST(q AS BIGINT) AS q, {_QT.format(q='q')} AS t FROM range(1, 101) r(q)), m AS (SELECT a.q AS q0, min(b.q) AS quality FROM c a JOIN c b ON a.t = b.t GROUP BY a.q)
SELECT o_orderkey, CAST(quality AS INT) AS quality FROM o JOIN m USING (q0)""")
def jpegq(spark, sf_dir):
    """An encoder's quality, from its quantisation table alone."""
    tables = X.table(spark, sf_dir, "orders").select("o_orderkey", N.quality_table(1 + F.col("o_orderkey") % 100).alias("table"))
    return tables.join(N.estimated_quality(tables), "table").select("o_orderkey", "quality")


@query("icc", """WITH p AS (SELECT page_id, sha256(regexp_extract(html, '<style>([^<]*)', 1)) AS d, regexp_extract(html, 'lang="([a-z]*)', 1) AS name FROM pages)
SELECT a.page_id AS pair_id, CASE WHEN a.d = b.d THEN CASE WHEN a.name = b.name THEN 'partial' ELSE 'match' END WHEN a.name = b.name THEN 'partial' ELSE 'none' END AS verdict FROM p a JOIN p b ON b.page_id = a.page_id + 1""")
def icc(spark, sf_dir):
    """Equal profiles match (only partly where a common name tells no more); equal names agree partly."""
    p = X.table(spark, sf_dir, "pages").select("page_id", F.sha2(F.regexp_extract("html", "<style>([^<]*)", 1), 256).alias("d"), F.regexp_extract("html", 'lang="([a-z]*)', 1).alias("name"))
    b = p.select((F.col("page_id") - 1).alias("page_id"), F.col("d").alias("d2"), F.col("name").alias("name2"))
    same = F.col("name") == F.col("name2")
    return p.join(b, "page_id").select(F.col("page_id").alias("pair_id"), F.when(F.col("d") == F.col("d2"), F.when(same, "partial").otherwise("match")).when(same, "partial").otherwise("none").alias("verdict"))


@query("file_format", """SELECT page_id, CASE WHEN contains(lower(substr(html, 1, 256)), '<svg') THEN 'SVG' ELSE 'unknown' END AS format FROM pages""")
def file_format(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", N.file_format(F.encode("html", "UTF-8")).alias("format"))


# ---- decisions -----------------------------------------------------------------------------------

_SCORES = {
    "sscd": "0.5+0.9*d", "sscdAligned": "0.52+1.1*d", "clip": "0.7+d", "dino": "0.3+d", "dreamsim": "0.6-d", "orb": "floor(60*abs(d))", "akaze": "floor(55*abs(d))", "brisk": "floor(50*abs(d))",
    "pdq": "floor(60-80*d)", "pdqDihedral": "floor(55-80*d)", "phash": "floor(12-20*d)", "dhash": "floor(13-20*d)", "ssim": "0.7+d", "msssim": "0.75+d", "crop": "0.85+0.5*d",
}


def _results(spark, sf_dir) -> DataFrame:
    """(pair_id, engine_id, value): scores of fifteen tests made from the vectors' dot products."""
    d = X.vector_pairs(spark, sf_dir).select("pair_id", V.dot(F.col("a"), F.col("b")).alias("d"))
    values = F.array(*[F.struct(F.lit(k).alias("engine_id"), F.expr(e).cast("double").alias("value")) for k, e in _SCORES.items()])
    return d.select("pair_id", F.explode(values).alias("r")).select("pair_id", "r.engine_id", "r.value")


_RES = "WITH " + _VP + ", dd AS (SELECT pair_id, list_dot_product(a, b) AS d FROM vp), res AS (" + " UNION ALL ".join(f"SELECT pair_id, '{k}' AS engine_id, CAST({e} AS DOUBLE) AS value, {sql_verdict(k, f'({e})')} AS verdict, '{next(g for i, g, *_ in catalogue.ENGINES if i == k)}' AS grp FROM dd" for k, e in _SCORES.items()) + ")"


@query("verdicts", _RES + " SELECT pair_id, engine_id, verdict FROM res")
def verdicts(spark, sf_dir):
    return D.judge(_results(spark, sf_dir), spark).select("pair_id", "engine_id", "verdict")


_CNT = "count(*) FILTER (verdict IN ('identical','match')) AS flagged, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict IN ('identical','match','partial','none')) AS counted"


@query("group_counts", _RES + f" SELECT pair_id, grp, {_CNT} FROM res GROUP BY pair_id, grp UNION ALL SELECT pair_id, NULL, {_CNT} FROM res GROUP BY pair_id")
def group_counts(spark, sf_dir):
    return D.counts(D.judge(_results(spark, sf_dir), spark))


def _one_row(spark, sf_dir) -> DataFrame:
    judged = D.judge(_results(spark, sf_dir), spark)
    rows = D.by_pair(judged, [i for i in D.DECIDING if i in _SCORES])
    empty = F.lit(None).cast("struct<value: double, verdict: string>")
    rows = rows.withColumns({i: empty for i in D.DECIDING if i not in _SCORES})
    return rows.withColumns({"odd": F.lit(False), "stripped": F.lit(False), "patch_share": F.lit(None).cast("double"), "cover_a": F.lit(0.7), "cover_b": F.lit(0.8)})


_ROW = _RES + ", w AS (SELECT pair_id, " + ", ".join(f"max(CASE WHEN engine_id = '{k}' THEN value END) AS {k}, max(CASE WHEN engine_id = '{k}' THEN verdict END) AS {k}_v" for k in _SCORES) + " FROM res GROUP BY pair_id)"
_GEO = "(orb_v = 'match' OR akaze_v = 'match' OR brisk_v = 'match')"
_LIFT = "sscdAligned > sscd + 0.05"


@query("headline", _ROW + f""", s AS (SELECT *, CASE WHEN {_LIFT} THEN sscdAligned ELSE sscd END AS best FROM w)
SELECT pair_id, CASE WHEN best >= 0.75 THEN 'Copy detected' WHEN best >= 0.5 THEN 'Possible partial copy' WHEN {_GEO} THEN 'Shared content' WHEN clip >= 0.75 OR dino >= 0.4 OR dreamsim <= 0.4 THEN 'Similar subject, not a copy' ELSE 'No meaningful similarity' END AS headline FROM s""")
def headline(spark, sf_dir):
    rows = _one_row(spark, sf_dir)
    return rows.select("pair_id", D.headline(rows).alias("headline"))


@query("similarity_level", _ROW + f""" SELECT pair_id, CASE WHEN (pdq_v = 'match' OR (phash_v = 'match' AND dhash_v = 'match')) AND (msssim_v = 'match' OR ssim_v = 'match') THEN 'resaved' WHEN sscdAligned >= 0.75 AND {_LIFT} THEN 'edited' WHEN sscd >= 0.75 OR pdqDihedral_v = 'match' THEN 'edited' WHEN crop_v IN ('identical','match') OR sscd >= 0.5 THEN 'part'
WHEN sscdAligned >= 0.5 AND {_LIFT} THEN 'part' WHEN {_GEO} THEN 'part' WHEN clip >= 0.75 OR dino >= 0.4 OR dreamsim <= 0.4 THEN 'subject' ELSE 'none' END AS level FROM w""")
def similarity_level(spark, sf_dir):
    rows = _one_row(spark, sf_dir)
    return rows.select("pair_id", D.level(rows).alias("level"))


@query("progress", _RES + f", c AS (SELECT engine_id, ms FROM (VALUES {', '.join(f'({chr(39)}{i}{chr(39)}, {float(catalogue.COSTS.get(i, catalogue.DEFAULT_MS))})' for i, *_ in catalogue.ENGINES)}) v(engine_id, ms)) SELECT pair_id, round(sum(ms)/(sum(ms)+{catalogue.TAIL_MS}), 6) AS done FROM res JOIN c USING (engine_id) GROUP BY pair_id")
def progress(spark, sf_dir):
    return D.progress(D.judge(_results(spark, sf_dir), spark), spark).select("pair_id", r6("done"))


@query("report")
def report(spark, sf_dir):
    return D.report(D.judge(_results(spark, sf_dir), spark))


@query("catalogue", "SELECT engine_id, grp, expected FROM (VALUES " + ", ".join(f"('{i}', '{g}', {float(catalogue.COSTS.get(i, catalogue.DEFAULT_MS))})" for i, g, *_ in catalogue.ENGINES) + ") v(engine_id, grp, expected)")
def engine_catalogue(spark, sf_dir):
    return catalogue.engines(spark).join(F.broadcast(catalogue.costs(spark)), "engine_id").select("engine_id", "grp", F.col("expected_ms").alias("expected"))


# ---- edits ---------------------------------------------------------------------------------------

_EDITS_SQL = {
    "mirror": ("y", "15-x", ["r", "g", "b"]), "flip": ("15-y", "x", ["r", "g", "b"]), "rot90": ("x", "15-y", ["r", "g", "b"]), "grey": ("y", "x", ["v", "v", "v"]),
    "invert": ("y", "x", ["255-r", "255-g", "255-b"]), "contrast": ("y", "x", [f"CAST(greatest(0, least(255, floor((2*{c}-255)*CAST(0.8 AS DOUBLE)+128))) AS BIGINT)" for c in "rgb"]),
    "brightness": ("y", "x", [f"CAST(least(255, floor({c}*CAST(1.2 AS DOUBLE)+0.5)) AS BIGINT)" for c in "rgb"]),
}


@query("edits", f"WITH {_PX} " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS edit, CAST(sum((({y})*16+({x})+1)*({c[0]})) AS BIGINT) AS r, CAST(sum((({y})*16+({x})+1)*({c[1]})) AS BIGINT) AS g, CAST(sum((({y})*16+({x})+1)*({c[2]})) AS BIGINT) AS b FROM gr GROUP BY doc_id" for k, (y, x, c) in _EDITS_SQL.items()))
def edits(spark, sf_dir):
    """Seven edits of every raster, each summed up by its channels weighed by place."""
    from .operators.edits import pixel_edits

    p = pixel_edits(X.pixels(X.packed(spark, sf_dir)), X.SIDE)
    at = F.col("y") * X.SIDE + F.col("x") + 1
    return p.groupBy("doc_id", "edit").agg(*[F.sum(at * F.col(c)).cast("long").alias(c) for c in "rgb"])


# ---- streams -------------------------------------------------------------------------------------


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """The static twin of the windowed stream."""
    from .streaming.scan import windowed

    return windowed(X.table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))

