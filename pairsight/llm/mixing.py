"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens (white-space separated words), raised to an exponent
and normalised. The exponent is bisected in [0, 1] so that the weights reach a target entropy, or
that no source is repeated more often than a limit. The budget defaults to the least one that
keeps every document: the source with most tokens for its weight is then read exactly once.

The weights are realised as block permutations. A source's documents are dealt into blocks by a
hash of their id; every epoch orders the blocks anew and the documents within a block by a hash,
so no shuffle of whole sources is needed. Full epochs take every block; the last, partial epoch
takes blocks in its order while they fit the rest of the source's budget, and of the next block the
documents in their order until the rest is met.

Null sources are one source. Null or empty texts have no tokens and go with their block; a source
without tokens is kept once. Repeated rows are taken independently but alike, and documents of
equal hash are ordered by id. Very long texts count whole. Columns named like the new ones are
replaced. An empty table gives an empty result. More than ``Settings.sources`` sources raise
ValueError, as their plan is broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, small
from .quality_rules import words_of


@dataclass(frozen=True)
class Settings:
    #: At most this many readings of a source (None: use ``entropy``).
    repetitions: float | None = 4.0
    #: Target entropy of the weights, as a share of the largest possible.
    entropy: float | None = None
    #: Tokens to realise (None: the least budget that keeps every document).
    budget: int | None = None
    block_tokens: int = 200_000
    #: Blocks of a source, at most: beyond that they hold more tokens.
    blocks: int = 50_000
    seed: int = 17
    sources: int = 100_000


NEW = ("mix_epoch", "mix_block", "mix_rank", "mix_key", "mix_tokens", "mix_weight")


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    raw = {k: (n / total) ** exponent if n else 0.0 for k, n in tokens.items()}
    return {k: x / sum(raw.values()) for k, x in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def repetitions(tokens: dict[str, int], w: dict[str, float], budget: float | None) -> dict[str, float]:
    budget = budget if budget is not None else max(n / w[k] for k, n in tokens.items() if n)
    return {k: w[k] * budget / n for k, n in tokens.items() if n}


def choose_exponent(tokens: dict[str, int], s: Settings) -> float:
    """The least exponent (flattest weights) within the repetition limit, or that of the target entropy."""
    live = {k: n for k, n in tokens.items() if n}
    if len(live) < 2:
        return 1.0

    def too_flat(exponent: float) -> bool:
        w = weights(live, exponent)
        if s.entropy is not None:
            return entropy(w) > s.entropy * math.log(len(live))
        return max(repetitions(live, w, s.budget).values()) > (s.repetitions or math.inf)

    if not too_flat(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


def plan(tokens: dict[str, int], s: Settings) -> list[tuple]:
    """(key, weight, full epochs, tokens of the partial epoch, blocks) of each source."""
    live = {k: n for k, n in tokens.items() if n}
    out = [(k, 0.0, 1, 0, 1) for k, n in sorted(tokens.items()) if not n]
    if live:
        w = weights(live, choose_exponent(live, s))
        for k, r in sorted(repetitions(live, w, s.budget).items()):
            full = math.floor(r + 1e-9)
            out.append((k, w[k], full, max(0, round((r - full) * live[k])), min(s.blocks, max(1, math.ceil(live[k] / s.block_tokens)))))
    return out


def _hash(*what: Column | str) -> Column:
    return F.xxhash64(*[F.lit(x) if isinstance(x, int) else x for x in what])


def mix(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for every reading of a document: its columns and

    mix_epoch (from 0), mix_block, mix_rank (of the block in the epoch's order), mix_key (order
    within the block), mix_tokens and mix_weight (of the source). Sorting a source by epoch, rank
    and key gives its sequence.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c in NEW])
    key = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00"))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    tokens = F.size(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).cast("long")
    facts = materialise(docs.select(key.alias("key"), ident.alias("ident"), tokens.alias("tokens")))
    sums = facts.groupBy("key").agg(F.sum("tokens").alias("n")).limit(s.sources + 1).collect()
    if len(sums) > s.sources:
        raise ValueError(f"more than {s.sources} sources")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("full", T.IntegerType()), T.StructField("rest", T.LongType()), T.StructField("blocks", T.LongType())])
    plans = F.broadcast(spark.createDataFrame(plan({r["key"]: int(r["n"] or 0) for r in sums}, s), schema))
    block = F.pmod(_hash("ident", s.seed), F.col("blocks"))
    dealt = facts.join(plans, "key").where(F.col("rest") > 0).withColumn("block", block)
    # the partial epoch: whole blocks by their order, then documents of the block at its end
    order = Window.partitionBy("key").orderBy(_hash("key", "block", "full", s.seed + 1), "block")
    blocks = (
        dealt.groupBy("key", "block", "full", "rest").agg(F.sum("tokens").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("before") < F.col("rest"))
        .select("key", "block", "before", (F.col("before") + F.col("n") <= F.col("rest")).alias("whole"), (F.col("rest") - F.col("before")).alias("left"))
    )
    blocks = materialise(blocks)
    n_blocks = blocks.count()
    last = blocks.where(~F.col("whole"))
    within = Window.partitionBy("key").orderBy(_hash("ident", F.col("full"), s.seed + 2), "ident")
    chosen = (
        dealt.join(F.broadcast(last), ["key", "block"])  # at most one block a source
        .withColumn("sofar", F.coalesce(F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("sofar") < F.col("left"))
        .select("key", "ident").distinct()
    )
    chosen = materialise(chosen.withColumn("picked", F.lit(True)))
    n_chosen = chosen.count()
    rows = docs.withColumns({"__key": key, "__ident": ident, "mix_tokens": tokens})
    rows = rows.join(plans.withColumnRenamed("key", "__key"), "__key")
    rows = rows.withColumn("mix_block", F.pmod(_hash("__ident", s.seed), F.col("blocks")))
    state = blocks.select(F.col("key").alias("__key"), F.col("block").alias("mix_block"), F.col("whole").alias("__whole"))
    rows = rows.join(small(state, n_blocks), ["__key", "mix_block"], "left")
    rows = rows.join(small(chosen.select(F.col("key").alias("__key"), F.col("ident").alias("__ident"), "picked"), n_chosen), ["__key", "__ident"], "left")
    extra = F.coalesce(F.col("__whole"), F.lit(False)) | F.coalesce(F.col("picked"), F.lit(False))
    epochs = F.col("full") + extra.cast("int")
    copies = F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("mix_epoch", F.explode(copies))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns], "mix_epoch", "mix_block", _hash("__key", "mix_block", F.col("mix_epoch"), s.seed + 1).alias("mix_rank"),
        _hash("__ident", F.col("mix_epoch"), s.seed + 2).alias("mix_key"), "mix_tokens", F.col("weight").alias("mix_weight"),
    )
