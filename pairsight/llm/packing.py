"""Packing token sequences by cutting-stock column generation.

1. Texts are tokenised once; a document is its ids and the end id. Full sequences of ``length``
   tokens are cut off; what remains (less than a sequence) is to be packed. One document of
   ``filler``, chosen by a hash of the id, is kept apart as filling, with its ids.
2. The remainders' lengths, rounded up to units of ``unit`` tokens, form a histogram of at most
   length / unit bins, whatever the number of documents. A linear program over patterns (what a
   sequence may hold) is solved by column generation: a knapsack by dynamic programming prices new
   patterns with the program's dual values until none improves it.
3. Patterns' counts are rounded down and realised: documents are ranked within their bin, and the
   rank alone gives sequence and place. What rounding leaves over is placed largest first.
4. The filling, in segments of at most ``WIDTH`` tokens, is strung along one line and cut to the room that sequences have left, in their
   order; filling beyond that makes full sequences, the last cut at powers of two, which need no
   padding. Only where the room exceeds the filling is there padding.

Null text is empty: its one piece is the end id. Repeated rows are packed as rows of their own
(they share doc_id, start and length, but not a place). Very long texts are cut as above. Only the
id passes through. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LOWER, Words, map_batches, materialise, texts_of


@dataclass(frozen=True)
class Settings:
    length: int = 2048
    end_id: int = 1
    unit: int = 16
    #: One document of so many is cut freely, to fill what patterns leave.
    filler: int = 12
    #: File of the tokenizer (None: the word BPE among the public tokenizer files).
    tokenizer: str | None = None


if sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit words")

# ---- tokens -----------------------------------------------------------------------------------

_loaded: dict = {}


#: Byte classes: white space 0, ASCII letters and digits 1, other ASCII but the apostrophe 2, the rest 3.
_CLASS = np.array([0 if c in (9, 10, 11, 12, 13, 32) else 1 if chr(c).isascii() and chr(c).isalnum() else 2 if c < 128 and c != 39 else 3 for c in range(256)], np.int8)


class Tokens:
    """Ids of texts, with the ids of each run of characters remembered in a hash table of numpy.

    The word BPE drops white space, never joins across it, and always parts ASCII letters and
    digits from other ASCII characters (the apostrophe aside), so a text's ids are those of its
    runs. A run is found by one hash and recognised by a second, independent one. Texts with the
    tokenizer's added tokens go the library's way. The table is emptied when half full.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads hold memory
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(str(path))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.place = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.ids, self.at, self.known = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of the runs with these two hashes, -1 for new ones."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            key = self.keys[slot]
            hit = (key == h[rest]) & (self.checks[slot] == check[rest])
            out[rest[hit]] = self.place[slot[hit]]
            go = ~hit & (key != 0)
            rest, slot = rest[go], (slot[go] + 1) & (self.SLOTS - 1)
        return out

    def _learn(self, h: np.ndarray, check: np.ndarray, runs: list[str]) -> None:
        """New runs and their hashes."""
        if len(h) > self.SLOTS // 2:
            raise ValueError("more runs at once than the table holds")
        parts, counts = [], []
        for k in range(0, len(runs), 500):  # one text of many runs costs less than many texts
            part = runs[k : k + 500]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            place = np.searchsorted(np.cumsum(size) - size, np.fromiter((x[0] for x in e.offsets), np.int64, len(ids)), "right") - 1
            parts.append(ids)
            counts.append(np.bincount(place, minlength=len(part)))
        flat, sizes = np.concatenate(parts), np.concatenate(counts)
        n, used = self.known, int(self.at[self.known])
        while len(self.at) < n + len(h) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.ids) < used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(flat)] = flat
        self.at[n + 1 : n + len(h) + 1] = used + np.cumsum(sizes)
        self.known += len(h)
        rest, slot = np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(rest):
            free = self.keys[slot] == 0
            first = np.zeros(len(rest), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.checks[slot[put]], self.place[slot[put]] = h[rest[put]], check[rest[put]], n + rest[put]
            go = ~put
            rest, slot = rest[go], np.where(free[go], slot[go], (slot[go] + 1) & (self.SLOTS - 1))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (unsigned 32 bits) of each text, without the end id."""
        raw = b" ".join(texts) + b" "
        w = Words.__new__(Words)
        w.raw = raw.translate(LOWER)
        w.data = np.frombuffer(w.raw, np.uint8)
        kind = _CLASS[w.data]
        before = np.concatenate(([np.int8(0)], kind[:-1]))
        begins = (kind > 0) & ((before == 0) | (kind + before == 3) & (kind < 3) & (before < 3) & (before > 0))
        w.starts = np.flatnonzero(begins)
        # a run ends where the next begins or at white space
        w.ends = np.flatnonzero(np.concatenate(((before > 0) & ((kind == 0) | begins), [False])))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.searchsorted(w.starts, np.concatenate(([0], np.cumsum(lengths + 1))))
        h, check = w.hashes(), w.hashes(1)
        h[h == 0] = 1
        found = self._find(h, check)
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.known + len(new) > self.SLOTS // 2:  # emptied: all of this call's runs are learnt anew
                self.clear()
                new = np.arange(len(h))
            order = new[np.lexsort((check[new], h[new]))]
            where = order[np.concatenate(([True], (np.diff(h[order]) != 0) | (np.diff(check[order]) != 0)))]
            self._learn(h[where], check[where], [w.raw[a:b].decode() for a, b in zip(w.starts[where].tolist(), w.ends[where].tolist(), strict=True)])
            found[new] = self._find(h[new], check[new])
        a = self.at[found]
        n = self.at[found + 1] - a
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = self.ids[np.repeat(a - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[first]
        out = [flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        if any(x in raw for x in self.added):
            for i, t in enumerate(texts):
                if any(x in t for x in self.added):
                    out[i] = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32)
        return out


def tokens_of(path: str | None) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


# ---- cutting stock ----------------------------------------------------------------------------


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern (how many of each size) within the capacity, by unbounded knapsack."""
    best = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = sizes <= c
        total = np.where(fits, best[np.maximum(c - sizes, 0)] + values, -1.0)
        k = int(total.argmax())
        if total[k] > best[c - 1] + 1e-12:
            best[c], item[c] = total[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            pattern[item[c]] += 1
            c -= sizes[item[c]]
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional counts, which meet the demand with the fewest sequences.

    Revised simplex from one pattern a size; ends when no pattern prices out by more than ``gap``,
    after 200 steps without gain, or after ``rounds`` steps. Ending early costs padding, never a document:
    whatever the patterns leave is placed afterwards.
    """
    n = len(sizes)
    patterns = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    count = inverse @ demand
    best = np.inf
    for step in range(rounds):
        dual = inverse.sum(0)  # every pattern costs one sequence
        value, pattern = price(np.maximum(dual, 0), sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, count / np.where(direction > 1e-9, direction, 1), np.inf)
        k = int(ratio.argmin())
        if not np.isfinite(ratio[k]):
            break
        count = np.maximum(count - ratio[k] * direction, 0)
        count[k] = ratio[k]
        row = inverse[k] / direction[k]
        inverse -= np.outer(direction, row)
        inverse[k] = row
        patterns[:, k] = pattern
        if step % 200 == 199:
            if count.sum() > best - 1e-3:
                break  # degenerate steps only
            best = count.sum()
    return patterns.T.astype(np.int64), count


def realise(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple]:
    """(bin, from_rank, each, sequence, slot): of a bin, ranks from ``from_rank`` on go to a pattern's
    sequences (from ``sequence`` on), ``each`` to a sequence, at slots from ``slot`` on; last, the number of ranks.
    """
    if not len(sizes):
        return []
    patterns, counts = cutting_stock(sizes, demand.astype(float), capacity)
    whole = np.floor(counts + 1e-6).astype(np.int64)
    left, sequence, out = demand.copy(), 0, []

    def place(a: np.ndarray, times: int) -> None:
        nonlocal sequence
        slot = 0
        for b in np.flatnonzero(a)[::-1]:
            out.append((int(sizes[b]), int(demand[b] - left[b]), int(a[b]), sequence, slot, int(times * a[b])))
            left[b] -= times * a[b]
            slot += int(a[b])
        sequence += int(times)

    for pattern, times in sorted(zip(map(tuple, patterns), whole, strict=True), key=lambda x: (-x[1], x[0])):
        a = np.array(pattern)
        if times > 0 and a.any():
            times = min(int(times), int((left[a > 0] // a[a > 0]).min()))
            if times > 0:
                place(a, times)
    while left.any():  # what rounding leaves: largest first, into as few sequences
        a, room = np.zeros(len(sizes), np.int64), capacity
        for b in range(len(sizes) - 1, -1, -1):
            a[b] = min(left[b], room // sizes[b])
            room -= a[b] * sizes[b]
        place(a, max(1, int((left[a > 0] // a[a > 0]).min())))
    return out


#: Tokens of a segment of filling and of a bucket of the line: a segment meets at most two buckets.
WIDTH = 1 << 16


# ---- the table --------------------------------------------------------------------------------


#: Parts of one block of the running sums.
PARTS = 1024


def _before(sums: DataFrame, part: str) -> DataFrame:
    """(part, __before): the sum of __n over all parts before; in two levels, so that no task holds all parts."""
    first = Window.unboundedPreceding
    block = F.floor(F.col(part) / PARTS).alias("__block")
    blocks = sums.groupBy(block).agg(F.sum("__n").alias("__m"))
    blocks = blocks.select("__block", F.coalesce(F.sum("__m").over(Window.orderBy("__block").rowsBetween(first, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("__block").orderBy(part).rowsBetween(first, -1)), F.lit(0))
    return sums.select(part, "__n", block).withColumn("__inner", inner).join(blocks, "__block").select(part, (F.col("__base") + F.col("__inner")).alias("__before"))


def _running(df: DataFrame, part: str, order: str, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before, by (part, order), part by part."""
    sums = _before(df.groupBy(part).agg(F.sum(value).alias("__n")), part)
    own = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__own", own).join(sums, part).withColumn(name, F.col("__before") + F.col("__own")).drop("__own", "__before")


def pack(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    s = settings or Settings()
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    whole = np.dtype("<u4").itemsize * s.length
    end = np.array([s.end_id], "<u4")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    filler = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(s.end_id)), F.lit(s.filler)) == 0

    def cut(batch: pa.RecordBatch):
        out: dict = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for row, (ids, fills) in enumerate(zip(tokens_of(s.tokenizer).encode(texts_of(batch.column(1))), batch.column(2).to_pylist(), strict=True)):
            ids = ids.tobytes() + end.tobytes()
            for at in range(0, len(ids), 4 * WIDTH if fills else whole):
                piece = ids[at : at + (4 * WIDTH if fills else whole)]
                out["row"].append(row)
                out["start"].append(at // 4)
                out["length"].append(len(piece) // 4)
                out["ids_crc32"].append(zlib.crc32(piece))
                out["doc_tokens"].append(len(ids) // 4)
                out["ids"].append(piece if fills else None)
        rows = pa.array(out.pop("row"), pa.int64())
        yield {"doc_id": batch.column(0).take(rows)} | out

    fields = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = map_batches(source.withColumn("fills", filler), cut, fields, "text")
    # the task's number and the place in it name a row: fixed once written
    pieces = materialise(pieces.withColumn("part", F.spark_partition_id()).withColumn("uid", F.monotonically_increasing_id()))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fixed = pieces.where(F.col("ids").isNull()).drop("ids")
    full, short = fixed.where(F.col("length") == s.length), fixed.where(F.col("length") < s.length)

    # rank within a bin, without bringing a bin together: rank in the part, plus the parts before
    binned = short.withColumn("bin", F.ceil(F.col("length") / s.unit).cast("int"))
    per = binned.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("bin", "part").orderBy("uid")) - 1
    ranked = binned.withColumn("own", own).join(before.select("bin", "part", "before"), ["bin", "part"]).withColumn("rank", F.col("before") + F.col("own"))
    histogram = sorted((r["bin"], r["n"]) for r in per.groupBy("bin").agg(F.sum("n").alias("n")).collect())
    sizes, demand = np.array([b for b, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    rules = realise(sizes, demand, s.length // s.unit)
    n_patterned = max((sequence + n // each for _, _, each, sequence, _, n in rules), default=0)
    schema = T.StructType([T.StructField(k, T.IntegerType() if k == "bin" else T.LongType()) for k in ("bin", "from_rank", "each", "sequence", "slot", "ranks")])
    table = F.broadcast(spark.createDataFrame(rules, schema))  # a few rows a bin, whatever the input
    at = F.col("rank") - F.col("from_rank")
    placed = ranked.join(table, (ranked["bin"] == table["bin"]) & (at >= 0) & (at < F.col("ranks"))).select(
        *columns[:5], (F.col("sequence") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("slot") + at % F.col("each")).alias("place")
    )
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))))

    # room that the patterns leave, and the fillers' tokens, both strung along one line
    room = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < s.length)
    room = room.withColumns({"room": s.length - F.col("used"), "part": F.floor(F.col("sequence_id") / 4096)})
    room = _running(room, "part", "sequence_id", "room", "from").select("sequence_id", "used", "room", "from")
    line = materialise(_running(pieces.where(F.col("ids").isNotNull()), "part", "uid", "length", "first").select("doc_id", "ids", F.col("start").alias("begin"), "doc_tokens", "first", "length"))
    total_room = (room.agg(F.sum("room")).first()[0]) or 0
    tokens = (line.agg(F.sum("length")).first()[0]) or 0
    n_full = full.count()
    # beyond the room: full sequences, the last cut at powers of two
    extra = max(0, tokens - total_room)
    tail, at_token, sequence = [], total_room + extra - extra % s.length, n_patterned + n_full + extra // s.length
    while at_token < tokens:
        n = 1 << ((tokens - at_token).bit_length() - 1)
        tail.append((sequence, 0, n, at_token))
        at_token, sequence = at_token + n, sequence + 1
    beyond = spark.range(extra // s.length).select((F.lit(n_patterned + n_full) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("used"), F.lit(s.length).cast("long").alias("room"), (F.lit(total_room) + F.col("id") * s.length).alias("from"))
    slots = room.unionByName(beyond).unionByName(spark.createDataFrame(tail, "sequence_id long, used long, room long, `from` long"))
    # overlaps of two sets of intervals: met in buckets of the line, counted in the bucket where they begin
    bucket = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / WIDTH), F.floor((F.col(a) + F.col(n) - 1) / WIDTH))).alias("bucket")
    begin, stop = F.greatest("from", "first"), F.least(F.col("from") + F.col("room"), F.col("first") + F.col("length"))
    met = slots.select("*", bucket("from", "room")).join(line.select("*", bucket("first", "length")), "bucket")
    met = met.where((begin < stop) & (F.floor(begin / WIDTH) == F.col("bucket")))
    start = F.col("begin") + begin - F.col("first")
    fills = met.select(
        "doc_id", start.alias("start"), (stop - begin).alias("length"), F.crc32(F.expr("substring(ids, int(4 * (greatest(`from`, first) - first) + 1), int(4 * (least(`from` + room, first + length) - greatest(`from`, first))))")).alias("ids_crc32"),
        "doc_tokens", "sequence_id", (F.col("used") + begin - F.col("from")).alias("offset"),
    )
    numbered = _running(full.withColumn("one", F.lit(1).cast("long")), "part", "uid", "one", "number")
    out = numbered.withColumn("sequence_id", F.lit(n_patterned) + F.col("number")).withColumn("offset", F.lit(0).cast("long")).select(columns)
    return out.unionByName(placed.select(columns)).unionByName(fills.select(columns))
