"""Nearest neighbours inside image pairs: blocks of both sides meet in matrix products, and whatever rounding
leaves open is settled by dot products summed in order, as SQL sums them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import fixtures as X

#: Vectors of a block, and of them as many at a time as a matrix of similarities has rows.
BLOCK, ROWS = 4096, 512


def _vectors(column) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """By length: the places and the values of the vectors without a null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    whole = sizes >= 0
    if flat.null_count:
        whole[np.searchsorted(ends, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), "right")] = False
    places = {int(n): np.flatnonzero(whole & (sizes == n)) for n in np.unique(sizes[whole])}
    return places, {n: values[(ends[at] - n)[:, None] + np.arange(n)] for n, at in places.items()}


def block_matches(left: pa.Table, right: pa.Table, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left (va), rows of right (ib, vb) and similarities: for each left row the ``keep`` most similar.

    Vectors with nulls, or of different lengths, have no similarity (NaN with a null mark), which comes last.
    """
    ib = right["ib"].to_numpy()
    order = np.argsort(ib, kind="stable")
    right, ib = right.take(pa.array(order)), ib[order]
    (pa_, va), (pb, vb) = _vectors(left["va"]), _vectors(right["vb"])
    m, n = left.num_rows, len(ib)
    out = []
    for first in range(0, m, ROWS):
        count = min(ROWS, m - first)
        sims, slack = np.full((count, n), -np.inf), np.zeros(count)
        for size in pa_.keys() & pb.keys():
            here = (pa_[size] >= first) & (pa_[size] < first + count)
            x, y = va[size][here], vb[size]
            with np.errstate(invalid="ignore", over="ignore"):
                part = x @ y.T
                slack[pa_[size][here] - first] = 4 * (size + 4) * np.finfo(float).eps * np.nan_to_num(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max(initial=0))
            part[np.isnan(part)] = np.inf  # as SQL orders them
            if len(x) == count and len(y) == n:
                sims = part
            else:
                sims[np.ix_(pa_[size][here] - first, pb[size])] = part
        least = sims.max(1) if keep == 1 or n <= keep else np.partition(sims, n - keep, axis=1)[:, n - keep]
        if n <= keep:
            least = np.full(count, -np.inf)
        r, c = np.nonzero(sims >= (least - slack)[:, None])
        exact = np.full(len(r), -np.inf)
        for size in pa_.keys() & pb.keys():
            row, col = np.full(m, -1), np.full(n, -1)
            row[pa_[size]], col[pb[size]] = np.arange(len(pa_[size])), np.arange(len(pb[size]))
            some = np.flatnonzero((row[r + first] >= 0) & (col[c] >= 0))
            for k in range(0, len(some), 1 << 16):
                at = some[k : k + (1 << 16)]
                x, y = va[size][row[r[at] + first]], vb[size][col[c[at]]]
                total = np.zeros(len(at))
                for j in range(size):
                    total += x[:, j] * y[:, j]
                exact[at] = total
        key = np.where(np.isnan(exact), np.inf, exact)
        by = np.lexsort((c, -key, r))
        r, c, exact = r[by], c[by], exact[by]
        best = np.arange(len(r)) - np.searchsorted(r, r) < keep
        out.append((r[best] + first, c[best], exact[best]))
    rows, cols, sims = (np.concatenate(z) for z in zip(*out, strict=True))
    return rows, ib[cols], sims


def best_matches(left: DataFrame, right: DataFrame, keep: int) -> DataFrame:
    """(pair_id, ia, ib, sim, rank): for each ia the ``keep`` most similar ib; ties go to the lower id.

    left: pair_id, ia, va; right: pair_id, ib, vb. Of equal vectors on the right only the lowest ids can be
    among the best. Every block of a pair's left side meets every block of its right side in a task of its own.
    """
    copies = F.row_number().over(Window.partitionBy("pair_id", "vb").orderBy("ib"))
    right = right.withColumn("rank", copies).where(F.col("rank") <= keep).drop("rank")
    blocks = lambda rows, n: rows.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias(n))
    sizes = blocks(left, "na").join(blocks(right, "nb"), "pair_id")
    deal = lambda rows, i, n: rows.withColumn("of", F.pmod(F.xxhash64(i), F.col(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = deal(left.join(sizes, "pair_id"), "ia", "na").select("pair_id", F.col("of").alias("ka"), every("nb").alias("kb"), "ia", "va")
    b = deal(right.join(sizes, "pair_id"), "ib", "nb").select("pair_id", every("na").alias("ka"), F.col("of").alias("kb"), "ib", "vb")
    keys, parts = ("pair_id", "ka", "kb"), X.parts(left.sparkSession)

    def one(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            rows, ib, sim = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        else:
            rows, ib, sim = block_matches(x, y, keep)
        return pa.table({"pair_id": x["pair_id"].take(pa.array(rows)), "ia": x["ia"].take(pa.array(rows)), "ib": pa.array(ib, pa.int64()), "sim": pa.array(sim, mask=np.isneginf(sim))})

    met = a.repartition(parts, *keys).groupBy(*keys).cogroup(b.repartition(parts, *keys).groupBy(*keys)).applyInArrow(one, "pair_id long, ia long, ib long, sim double")
    rank = F.row_number().over(Window.partitionBy("pair_id", "ia").orderBy(F.desc("sim"), "ib"))
    return met.withColumn("rank", rank).where(F.col("rank") <= keep)
