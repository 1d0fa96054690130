"""Near-duplicate groups by an LSH forest, with links confirmed on full shingle sets.

1. Every text's set of distinct word shingles is hashed (64 bits a shingle); texts with equal sets
   form a class, represented by one row, so exact copies cost nothing further.
2. A representative's MinHash signature gives ``Settings.trees`` labels of eight values. The labels
   of all trees are sorted over the cluster (dealt by ranges of tree and label, so that not even equal
   labels must meet in one task). Rows whose neighbours share a prefix of four values are a
   region; at similarity 0.8 a pair misses all 32 regions with a chance of 5e-8.
3. Candidates come in three steps, each confirmed pair by pair on full sets and followed by components.
   First each document's ``Settings.nearest`` neighbours of longest common prefix in the sorted
   orders: deep where a region is crowded, shallow where it is sparse. Regions that are now one group
   are settled. Then, in unsettled regions of at most ``Settings.region`` members, the pairs across
   groups. Last, larger unsettled regions, exactly: joined into clusters, whose members outside the largest
   group are compared with all by an index of shingles; clusters of more than ``Settings.block``
   shingles are dealt into blocks, of which every pair is a task.
4. The confirmed links' components are the groups.

So every pair that shares a region is either confirmed, refuted or already in one group. Without words
or text a document has an empty set and links with nothing. Fewer words than a shingle's count as one
shingle. Null ids link nothing and are not kept. Rows repeated under one id get the same values; rows of
one id with different texts are documents of their own. Only the id column passes through. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, discard, map_batches, materialise, mix, release_memory, row_keys, small, texts_of, windows
from .components import connected_components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    trees: int = 32
    #: Values of a prefix that makes a region; labels hold twice as many.
    depth: int = 4
    #: Neighbours of longest common prefix that a document is compared with first.
    nearest: int = 2
    #: Members of a region whose pairs across groups are compared one by one.
    region: int = 16
    #: Shingles of a block: a cluster of more is dealt into blocks.
    block: int = 300_000


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, with A-Z in lower case."""
    w = Words(texts, lower=True)
    h = w.hashes()
    runs = windows(h, words)
    out = []
    for i in range(w.n):
        a, n = int(w.first[i]), int(w.counts[i])
        if n >= words:
            out.append(np.unique(runs[a : a + n - words + 1]))
        elif n:
            out.append(windows(h[a : a + n], n) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values, a row for each set (zeros for an empty one)."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), n), np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    base = (mix(np.concatenate([sets[i] for i in full])) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    mul, add = _functions(n)
    for k in range(n):
        v = (base ^ add[k]) * mul[k]
        v ^= v >> np.uint32(15)
        out[full, k] = np.minimum.reduceat(v, at)
    return out


def halves_of(signature: np.ndarray, s: Settings) -> np.ndarray:
    """Of each row and tree the first half of the label, 16 bits a value; the last half is the next tree's first."""
    short = signature.reshape(len(signature), s.trees, s.depth).astype(np.uint64) & np.uint64(0xFFFF)
    half = np.zeros(short.shape[:2], np.uint64)
    for d in range(s.depth):
        half = half << np.uint64(16) | short[:, :, d]
    return half


def describe(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id, ka and kb (of the row), n_shingles, two digests of the set, halves of labels."""
    if s.depth != 4:
        raise ValueError("labels are packed four values to a long")

    def fn(batch: pa.RecordBatch):
        sets = shingle_sets(texts_of(batch.column(1)), s.words)
        twice = [mix(x ^ np.uint64(0xA5A5A5A5DEADBEEF)) for x in sets]
        halves = halves_of(signatures(sets, s.trees * s.depth), s).view(np.int64)
        yield {
            "id": batch.column(0), "ka": batch.column(2), "kb": batch.column(3),
            "n_shingles": [len(x) for x in sets],
            "k1": [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in twice],
            "k2": [int(np.bitwise_xor.reduce(mix(x), initial=np.uint64(len(x))).astype(np.int64)) for x in twice],
            "halves": pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * s.trees, pa.array(halves.ravel())),
        }

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *row_keys(F.col(id_col).cast("long"), text))
    return map_batches(source, fn, "id long, ka long, kb long, n_shingles long, k1 long, k2 long, halves array<long>", "text")


def forest(reps: DataFrame) -> DataFrame:
    """The sorted orders: key (of a region), node, pred (the node before it there, if any) and lcp.

    Rows without a neighbour of common prefix are left out, but for the first and last of a task's range,
    whose neighbours lie in other ranges.
    """
    halves = F.posexplode("halves").alias("tree", "first")
    after = F.element_at("halves", F.pmod(F.col("tree") + 1, F.size("halves")) + 1)
    rows = reps.select("node", "halves", halves).select("tree", "first", after.alias("last"), "node")
    order = ["tree", "first", "last", "node"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, begun = None, False
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            if not len(columns[0]):
                continue
            if carried is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(carried[0], columns, strict=True)]
            tree, first, last, node = columns
            same = (tree[1:] == tree[:-1]) & (first[1:] == first[:-1])
            before = np.concatenate(([carried is not None and carried[1]], same))
            pred = np.concatenate(([carried[2] if carried else 0], node[:-1]))
            lcp = np.concatenate(([carried[3] if carried else 0], _common(last[1:], last[:-1])))
            keep = before.copy()
            keep[:-1] |= same
            if not begun:
                keep[0] = begun = True
            keep[-1] = False  # decided with the next batch
            yield _members(tree, first, node, before, pred, lcp, keep)
            carried = [c[-1:] for c in columns], bool(before[-1]), int(pred[-1]), int(lcp[-1])
        if carried is not None:
            tree, first, _, node = carried[0]
            one = np.ones(1, bool)
            yield _members(tree, first, node, one & carried[1], np.array([carried[2]]), np.array([carried[3]]), one)

    return rows.mapInArrow(walk, "key long, node long, pred long, lcp int")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the labels have in common, whose first halves are equal."""
    x = (a ^ b).view(np.uint64)
    return 4 + np.sum([(x >> np.uint64(k)) == 0 for k in (0, 16, 32, 48)], axis=0)


def _members(tree, first, node, before, pred, lcp, keep) -> pa.RecordBatch:
    key = mix(mix(first.view(np.uint64)) ^ tree.astype(np.uint64)).view(np.int64)
    columns = [pa.array(key[keep]), pa.array(node[keep]), pa.array(pred[keep], pa.int64(), mask=~before[keep]), pa.array(lcp[keep].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["key", "node", "pred", "lcp"])


# ---- one cluster, or two blocks of one --------------------------------------------------------


class Groups:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def resolve(ids: np.ndarray, sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """The smallest id of each document's group (all links among these documents are found)."""
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    n = len(ids)
    groups = Groups(n)
    if n > 1:
        _walk(sets, groups, s)
        root = groups.roots()
        largest = np.bincount(root).argmax()
        rest = np.flatnonzero(root != largest)
        if len(rest):
            _rest(sets, rest, groups, s)
    root = groups.roots()
    out = np.empty(n, ids.dtype)
    out[order] = ids[root]
    return out


def _walk(sets: list[np.ndarray], groups: Groups, s: Settings) -> None:
    """Neighbours in the trees' sorted orders, from the longest common prefix to the shortest."""
    sig = signatures(sets, s.trees * s.depth)
    width = sig.shape[1]
    tried: set[tuple[int, int]] = set()
    for t in range(s.trees):
        label = np.roll(sig, -t * s.depth, axis=1)[:, : 2 * s.depth]  # deeper levels reuse the next tree's functions
        order = np.lexsort(label.T[::-1])
        same = label[order[1:]] == label[order[:-1]]
        prefix = np.where(same.all(1), min(2 * s.depth, width), same.argmin(1))
        for d in range(label.shape[1], s.depth - 1, -1):
            for k in np.flatnonzero(prefix == d):
                a, b = int(order[k]), int(order[k + 1])
                if groups.find(a) != groups.find(b):
                    pair = (min(a, b), max(a, b))
                    if pair not in tried:
                        tried.add(pair)
                        if linked(sets[a], sets[b], s.percent):
                            groups.join(a, b)


def _rest(sets: list[np.ndarray], rest: np.ndarray, groups: Groups, s: Settings) -> None:
    """Exact overlaps of the ``rest`` with every document, by an index of the rest's shingles."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    every = np.concatenate(sets)
    wanted = np.unique(np.concatenate([sets[i] for i in rest]))
    at = np.searchsorted(wanted, every)
    at[at == len(wanted)] = len(wanted) - 1
    hit = wanted[at] == every
    term, owner = at[hit], owner[hit]
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    first = np.searchsorted(term, np.arange(len(wanted) + 1))
    for i in rest:
        terms = np.searchsorted(wanted, sets[i])
        counts = first[terms + 1] - first[terms]
        ends = np.cumsum(counts)
        take = np.repeat(first[terms] - (ends - counts), counts) + np.arange(ends[-1])
        both = np.bincount(owner[take], minlength=n)
        for j in np.flatnonzero(100 * both >= s.percent * (sizes[i] + sizes - both)):
            if j != i:
                groups.join(int(i), int(j))


# ---- the whole table ----------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every document."""
    s = settings or Settings()
    facts = materialise(describe(docs, s, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    full = facts.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = materialise(full.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("least")))
    reps = full.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    members = materialise(forest(reps.select("node", "halves")))
    groups = groups_of(docs, reps, members, s, id_col, text_col)
    rooted = classes.join(groups, classes["node"] == groups["id"], "left").select("k1", "k2", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    rooted = materialise(rooted.join(smallest, "root").select("k1", "k2", "component"))
    out = facts.join(rooted, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    discard(classes, members)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def groups_of(docs: DataFrame, reps: DataFrame, members: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, root) of the nodes that confirmed links join."""
    nodes = materialise(members.select("node").distinct().join(reps.select("node", "ka", "kb"), "node"))
    sets = materialise(_sets(docs, small(nodes, nodes.count()), s, id_col, text_col))
    # each document's neighbours of longest common prefix
    pairs = members.where(F.col("pred").isNotNull()).groupBy("node", "pred").agg(F.max("lcp").alias("lcp"), F.count(F.lit(1)).alias("trees"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("lcp"), F.desc("trees"), "pred"))
    tried = materialise(pairs.withColumn("best", best).where(F.col("best") <= s.nearest).select(F.col("node").alias("u"), F.col("pred").alias("v")))
    links = materialise(_confirmed(tried, sets, s))
    roots = materialise(connected_components(links))
    # pairs across groups in what regions are left, if small
    left, regions = _unsettled(members, roots)
    few = left.join(regions.where(F.col("n") <= s.region).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("l")).select("l").distinct()
    across = F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: (b["node"] > a["node"]) & (b["root"] != a["root"])), lambda b: F.struct(b["node"].alias("u"), a["node"].alias("v")))))
    across = few.select(F.explode(across).alias("p")).select("p.*").distinct()
    known = tried.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = materialise(_confirmed(across.join(known, ["u", "v"], "left_anti"), sets, s))
    discard(tried, regions)
    if links.limit(1).count():
        roots = materialise(connected_components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(links)))
    # larger ones
    left, regions = _unsettled(members, roots)
    large = regions.where(F.col("n") > s.region)
    n_large = large.count()
    if n_large:
        edges = left.join(small(large.select("key", "hub"), n_large), "key").select(F.col("node").alias("u"), F.col("hub").alias("v"))
        links = _cluster_links(sets, materialise(connected_components(edges)), s)
        roots = materialise(connected_components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(links)))
    return roots


def _unsettled(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their roots, and the regions of more than one group: key, n, hub."""
    left = members.select("key", "node").join(roots, members["node"] == roots["id"], "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    regions = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return left, materialise(regions.where(F.col("lo") < F.col("hi")).select("key", "n", "hub"))


def _sets(docs: DataFrame, nodes: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """node, n_shingles and shingles (sorted, as bytes); a row repeated in ``docs`` repeats here."""
    text = F.col(text_col).cast("string")
    source = docs.where(F.col(id_col).isNotNull()).select(text.alias("text"), *row_keys(F.col(id_col).cast("long"), text))
    source = source.join(nodes, ["ka", "kb"]).select("node", "text")

    def fn(batch: pa.RecordBatch):
        sets = shingle_sets(texts_of(batch.column(1)), s.words)
        yield {"node": batch.column(0), "n_shingles": [len(x) for x in sets], "shingles": [x.tobytes() for x in sets]}

    return map_batches(source, fn, "node long, n_shingles long, shingles binary", "text")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The (u, v) whose full sets are similar enough."""
    size = sets.select("node", "n_shingles").distinct()
    a, b = (size.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}")) for k in "uv")
    likely = pairs.join(a, "u").join(b, "v").where(100 * F.least("n_u", "n_v") >= s.percent * F.greatest("n_u", "n_v")).select("u", "v")
    a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "uv")
    both = likely.join(a, "u").join(b, "v").select("u", "v", "set_u", "set_v")

    def fn(batch: pa.RecordBatch):
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
        yield batch.select([0, 1]).filter(pa.array([linked(x, y, s.percent) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return map_batches(both, fn, "u long, v long", "set_u")


def _cluster_links(sets: DataFrame, clusters: DataFrame, s: Settings) -> DataFrame:
    """(u, v): links within clusters (id, root), found exactly."""
    sized = clusters.join(sets.select(F.col("node").alias("id"), "n_shingles").distinct(), "id")
    large = sized.groupBy("root").agg(F.sum("n_shingles").alias("total")).where(F.col("total") > s.block).select("root", F.ceil(F.col("total") / s.block).cast("int").alias("blocks"))
    large = materialise(large)
    dealt = clusters.join(small(large, large.count()), "root", "left")
    # a document of block b takes part in every pair of blocks with b
    mine = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.filter(others, lambda x: x["i"] != x["j"]))
    tasks = sets.join(dealt, sets["node"] == dealt["id"]).select("id", "shingles", "root", F.explode(pairs).alias("pair")).select("id", "shingles", "root", "pair.i", "pair.j")

    def solve(t: pa.Table) -> pa.Table:
        ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
        if len(ids) > 1000:
            release_memory()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").take(pa.array(first)).to_pylist()]
        root = resolve(ids, sets, s)
        moved = root != ids
        return pa.table({"u": ids[moved], "v": root[moved]})

    return materialise(tasks.groupBy("root", "i", "j").applyInArrow(solve, "u long, v long"))
