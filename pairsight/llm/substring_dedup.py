"""Removal of word sequences that occur elsewhere, by suffix automata of reference shards.

A window is ``Settings.window`` consecutive words of one document; every word of a window whose
sequence also starts anywhere else (same document included) is removed. Windows are judged on the
input, not on what is left.

Two ways, with equal results:

``remove_known``: against a reference of proven size. Suffix automata of the reference's shards
are broadcast and documents are streamed through them for matching statistics (the longest suffix
at each word that the reference holds); spans at least as long as a window are removed.

``remove_repeated``: against the whole corpus, whose automata nothing would bound, so shards are
dealt out instead of broadcast.

1. Each window is represented by its minimizer, the least hash of the ``Settings.gram``-word runs
   in it; equal windows have equal minimizers at equal places. A maximal run of windows with one
   minimizer is a span; spans part a document's windows. Equal spans that follow each other, as in
   words repeated without end, are one row with the number of times. Spans of minimizers met once
   are done.
2. Equal spans are counted, before the shuffle. All windows of a span met twice are repeated.
3. Where one minimizer has several different spans, one copy of each is the reference: spans are
   dealt into shards by minimizer, each shard builds its suffix automaton, and its spans are
   streamed through it for matching statistics; a window is repeated where the automaton's state of
   that length has two ends. A minimizer with more words than a shard may hold is settled by
   counting its windows' hashes over the cluster.
4. Repeated windows return to their documents and the words that they cover are cut out.

Spans and windows are told apart by two independent 64-bit hashes. Keys that many rows share are
few and broadcast (at most ``HEAVY`` of them, by their counts), so no task holds a hot key.

Null text: no words. Texts shorter than a window lose nothing. Whole texts are read, whatever their
length. Rows with null ids are documents like others. Rows repeated under one id count as separate
documents for repetition; each row's result is that of its own text. Only the id passes through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, map_batches, materialise, release_memory, row_keys, texts_of, windows


@dataclass(frozen=True)
class Settings:
    window: int = 35
    gram: int = 8
    #: Words of one shard's automaton, at most.
    shard_words: int = 60_000


#: A key of more than 1 / HEAVY of all rows is heavy: there can't be more than HEAVY of them.
HEAVY = 20_000


def least_of_runs(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost least value in every run of ``width`` values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        a, b = slice(0, len(value) - step), slice(step, len(value))
        right = value[b] < value[a]
        value, at = np.where(right, value[b], value[a]), np.where(right, at[b], at[a])
        size += step
    return at[:n]


class Spans:
    """Spans of several texts: doc, at (first word, from the text's), n (windows), gram, k1, k2 (digests), times.

    Equal spans that follow each other are one entry, of the first, with their number in ``times``.
    """

    def __init__(self, words: Words, s: Settings):
        h = words.hashes()
        gram = min(s.gram, s.window)
        grams = windows(h, gram)
        at = least_of_runs(grams, s.window - gram + 1)
        n = len(at)
        doc = np.repeat(np.arange(words.n, dtype=np.int32), words.counts)
        start = np.flatnonzero(doc[:n] == doc[s.window - 1 :][:n]) if n else np.zeros(0, np.int64)
        at, doc = at[start], doc[:n][start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        self.doc = doc[first] if len(first) else np.zeros(0, np.int32)
        self.gram = grams[at[first]].view(np.int64) if len(first) else np.zeros(0, np.int64)
        self.n = (last - first + 1)[: len(first)].astype(np.int32)
        self.at = (start[first] - words.first[self.doc]).astype(np.int32)
        # a span is no longer than two windows, so its first, its last and their distance tell it
        self.k1, self.k2 = (self._digest(windows(words.hashes(seed), s.window), start, first, last) for seed in (1, 2))
        self._fold()
        self.bounds = np.searchsorted(self.doc, np.arange(words.n + 1)).astype(np.int32)

    def _fold(self) -> None:
        new = np.ones(len(self.doc), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in (self.doc, self.gram, self.k1, self.k2)], axis=0)
        first = np.flatnonzero(new)
        self.times = np.diff(np.append(first, len(new))).astype(np.int32)
        for name in ("doc", "gram", "k1", "k2", "at", "n"):
            setattr(self, name, getattr(self, name)[first])

    def _digest(self, whole: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0, np.int64)
        return windows(np.stack([whole[start[first]], whole[start[last]]], 1).ravel(), 2)[::2].view(np.int64) + self.n


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Flags of the n words that windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge)[:n] > 0


def keep_known(rows: DataFrame, known: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` whose key is in ``known`` (with its count n), without a task for a heavy key."""
    heavy = F.broadcast(known.where(F.col("n") > total // HEAVY).select(on))
    light = known.where(F.col("n") <= total // HEAVY).select(on)
    return rows.join(heavy, on, "left_semi").unionByName(rows.join(heavy, on, "left_anti").join(light, on, "left_semi"))


def repeated_spans(spans: DataFrame, source: DataFrame, s: Settings) -> DataFrame:
    """ka, kb (of a row), at, n: runs of windows that are repeated."""
    key = ["gram", "k1", "k2"]
    total = spans.count()
    if not total:
        return spans.select("ka", "kb", "at", "n")
    contents = materialise(spans.groupBy(*key, "n").agg(F.sum("times").alias("c"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("ka", "kb", "at")).alias("one")))
    twice = contents.where("c > 1").select(*key, F.col("rows").alias("n"))
    same = keep_known(spans, twice, key, total).select("ka", "kb", "at", (F.col("n") * F.col("times")).alias("n"))
    # minimizers of which some span was met once: its windows may lie in the others
    mixed = contents.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum(s.window - 1 + F.col("n")).alias("words")).where("least = 1")
    mixed = materialise(mixed.select("gram", "n", "words", (F.col("words") > s.shard_words).alias("large")))
    n_words, n_copies, n_large = mixed.agg(F.sum(F.when(~F.col("large"), F.col("words"))), F.sum("n"), F.count_if("large")).first()
    if n_copies is None:
        return same
    n_shards = max(1, -(-2 * int(n_words or 0) // s.shard_words))
    chosen = keep_known(contents, mixed, ["gram"], contents.count())
    reps = chosen.select(*key, "c", "n", "one.*").groupBy("ka", "kb").agg(F.collect_list(F.struct(*key, "c", "at", "n")).alias("spans"))
    # rows repeated under one id have equal keys and texts: one of them is read
    reps = source.join(reps, ["ka", "kb"]).select("text", "ka", "kb", "spans").dropDuplicates(["ka", "kb"])

    def cut(batch: pa.RecordBatch):
        w = Words(texts_of(batch.column(0)))
        lists = batch.column(3)
        flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        at = w.first[row] + flat.field("at").to_numpy()
        last = at + s.window - 2 + flat.field("n").to_numpy()
        yield {k: flat.field(k) for k in (*key, "c", "at")} | {
            "ka": batch.column(1).take(pa.array(row)), "kb": batch.column(2).take(pa.array(row)),
            "words": [w.raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[last].tolist(), strict=True)],
        }

    copies = materialise(map_batches(reps, cut, "gram long, k1 long, k2 long, c long, at int, ka long, kb long, words binary", "text"))
    runs = "ka long, kb long, at int, n int"

    def solve(t: pa.Table) -> pa.Table:
        w = Words(texts_of(t.column("words").combine_chunks()))
        _, code = np.unique(np.stack([w.hashes(1), w.hashes(2)]), axis=1, return_inverse=True)
        code = code.ravel().tolist()
        texts = [code[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        shard = SuffixAutomaton(texts)
        shard.count_ends()
        out = {"row": [], "at": [], "n": []}
        once, begin = (t.column("c").to_numpy() == 1).tolist(), t.column("at").to_numpy().tolist()
        for row, seq in enumerate(texts):
            if once[row]:
                for a, n in shard.repeats(seq, s.window):
                    out["row"].append(row)
                    out["at"].append(begin[row] + a)
                    out["n"].append(n)
        rows = pa.array(out["row"], pa.int64())
        del shard
        release_memory()
        return pa.table({"ka": t.column("ka").take(rows), "kb": t.column("kb").take(rows), "at": pa.array(out["at"], pa.int32()), "n": pa.array(out["n"], pa.int32())})

    light = copies
    if n_large:
        large = mixed.where("large")
        light = keep_known(copies, mixed.where(~F.col("large")), ["gram"], n_copies)
    shard = F.pmod(F.xxhash64("gram"), F.lit(n_shards)).alias("shard")
    out = light.select("*", shard).groupBy("shard").applyInArrow(solve, runs)
    if n_large:
        out = out.unionByName(_counted(keep_known(copies, large, ["gram"], n_copies), s))
    return same.unionByName(materialise(out))


def _counted(copies: DataFrame, s: Settings) -> DataFrame:
    """Repeated windows of copies of minimizers with very many different spans: counted by their hashes."""

    def explode(batch: pa.RecordBatch):
        w = Words(texts_of(batch.column(3)))
        size = w.counts - (s.window - 1)
        row = np.repeat(np.arange(w.n), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        k1, k2 = (windows(w.hashes(seed), s.window)[w.first[row] + at].view(np.int64) for seed in (1, 2))
        yield {"ka": batch.column(0).take(pa.array(row)), "kb": batch.column(1).take(pa.array(row)), "at": at + batch.column(2).to_numpy()[row], "k1": k1, "k2": k2}

    each = materialise(map_batches(copies.select("ka", "kb", "at", "words"), explode, "ka long, kb long, at int, k1 long, k2 long", "words"))
    twice = each.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keep_known(each, twice, ["k1", "k2"], max(1, each.count())).select("ka", "kb", "at", F.lit(1).alias("n"))


def remove_repeated(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_text (null where nothing was removed, or not asked for) and kept_sha256.

    Rows of one id come in no certain order; each has the values of its own text.
    """
    s = settings or Settings()
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), *row_keys(F.col(id_col), text))

    def first(batch: pa.RecordBatch):
        w = Words(texts_of(batch.column(1)))
        p = Spans(w, s)
        lists = {k: pa.ListArray.from_arrays(p.bounds, pa.array(getattr(p, k))) for k in ("gram", "k1", "k2", "at", "n", "times")}
        yield {"id": batch.column(0), "ka": batch.column(2), "kb": batch.column(3), "n_words": w.counts, "sha": [hashlib.sha256(x).hexdigest() for x in w.joined()]} | lists

    fields = f"id {id_type}, ka long, kb long, n_words long, sha string, gram array<long>, k1 array<long>, k2 array<long>, at array<int>, n array<int>, times array<int>"
    facts = materialise(map_batches(source, first, fields, "text"))
    seen = facts.select(F.explode(F.arrays_zip("gram", "times")).alias("s")).groupBy("s.gram").agg(F.count(F.lit(1)).alias("n"), F.sum("s.times").alias("c"))
    seen = materialise(seen.where("c > 1").select("gram", "n"))
    total = int(facts.agg(F.sum(F.size("gram"))).first()[0] or 0)
    marks = facts.select("ka", "kb", F.explode(F.arrays_zip("gram", "k1", "k2", "at", "n", "times")).alias("s")).select("ka", "kb", "s.*")
    spans = materialise(keep_known(marks, seen, ["gram"], max(1, total)))
    runs = repeated_spans(spans, source, s)
    hits = runs.groupBy("ka", "kb").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def third(batch: pa.RecordBatch):
        w = Words(texts_of(batch.column(2)))
        lists = batch.column(3)
        flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
        start = np.repeat(w.first[:-1], size) + flat.field("at").to_numpy()
        edge = np.zeros(len(w.starts) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + flat.field("n").to_numpy() + s.window - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = w.joined(gone)
        removed = np.concatenate(([0], np.cumsum(gone)))[w.first]
        yield {"ka": batch.column(0), "kb": batch.column(1), "n_removed": np.diff(removed), "sha_left": [hashlib.sha256(x).hexdigest() for x in kept], "kept_text": kept if with_text else [None] * len(kept)}

    # rows repeated under one id have equal keys and equal results
    chosen = source.join(hits, ["ka", "kb"]).select("ka", "kb", "text", "runs").dropDuplicates(["ka", "kb"])
    cut = materialise(map_batches(chosen, third, "ka long, kb long, n_removed long, sha_left string, kept_text binary", "text"))
    discard(seen, spans)
    return facts.select("id", "ka", "kb", "n_words", "sha").join(cut, ["ka", "kb"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.col("kept_text").cast("string").alias("kept_text"), F.coalesce("sha_left", "sha").alias("kept_sha256"),
    )


# ---- automata -----------------------------------------------------------------------------------


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[int] = [0]
        for seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
                self.ends[last] += 1

    def _extend(self, last: int, c: int) -> int:
        follow, link, length = self.next, self.link, self.length
        if c in follow[last]:
            q = follow[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(length)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.ends.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        follow, link, length = self.next, self.link, self.length
        clone = len(length)
        follow.append(dict(follow[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.ends.append(0)
        link[q] = clone
        while p >= 0 and follow[p].get(c) == q:
            follow[p][c] = clone
            p = link[p]
        return clone

    def count_ends(self) -> None:
        """Let ``ends`` hold how often each state's runs end anywhere in the sequences."""
        ends, link = self.ends, self.link
        for state in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            ends[link[state]] += ends[state]

    def repeats(self, seq: Iterable[int], size: int) -> list[tuple[int, int]]:
        """(start, number) of windows of ``size`` of a known sequence that the sequences hold twice or more."""
        follow, link, length, ends = self.next, self.link, self.length, self.ends
        state, out = 0, []
        for i, c in enumerate(seq):
            state = follow[state][c]
            while length[link[state]] >= size:
                state = link[state]
            if i >= size - 1 and ends[state] > 1:
                start = i - size + 1
                if out and sum(out[-1]) == start:
                    out[-1] = (out[-1][0], out[-1][1] + 1)
                else:
                    out.append((start, 1))
        return out

    def matches(self, seq: Iterable[int]) -> list[int]:
        """Of each position, the length of the longest run ending there that the reference holds."""
        follow, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in seq:
            while state and c not in follow[state]:
                state = link[state]
                n = length[state]
            if c in follow[state]:
                state = follow[state][c]
                n += 1
            out.append(n)
        return out


def remove_known(docs: DataFrame, reference: list[str], settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 100_000, bound: int = 2_000_000) -> DataFrame:
    """id, n_words, n_removed, kept_text: without runs of ``window`` or more words that the reference holds.

    The reference is cut into shards of about ``shard_words`` words; more than ``bound`` words in
    all raise ValueError, as they are broadcast.
    """
    s = settings or Settings()
    w = Words([x.encode() for x in reference])
    if len(w.starts) > bound:
        raise ValueError(f"the reference has {len(w.starts)} words; at most {bound} can be broadcast")
    h = w.hashes().tolist()
    shards, part, size = [], [], 0
    for i in range(w.n):
        part.append(h[w.first[i] : w.first[i + 1]])
        size += len(part[-1])
        if size >= shard_words:
            shards.append(SuffixAutomaton(part))
            part, size = [], 0
    if part:
        shards.append(SuffixAutomaton(part))
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def fn(batch: pa.RecordBatch):
        words = Words(texts_of(batch.column(1)))
        codes = words.hashes().tolist()
        edge = np.zeros(len(codes) + 1, np.int32)
        for i in range(words.n):
            first = int(words.first[i])
            seq = codes[first : words.first[i + 1]]
            for shard in held.value:
                for end, n in enumerate(shard.matches(seq)):
                    if n >= s.window:
                        edge[first + end - n + 1] += 1
                        edge[first + end + 1] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
        yield {"id": batch.column(0), "n_words": words.counts, "n_removed": removed, "kept_text": [x.decode() for x in words.joined(gone)]}

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, fn, f"id {source.schema[0].dataType.simpleString()}, n_words long, n_removed long, kept_text string", "text").withColumnRenamed("id", id_col)
