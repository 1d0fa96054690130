"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Base rules: too few words, or too large a share of words inside repeated 8-word windows. Beyond
them, documents are rejected by the minimum covariance determinant: for every language and source,
location and scatter of a transformed statistic vector are those of the ``Rules.half`` of its rows
with the least determinant, and a document goes if its squared Mahalanobis distance is beyond the
chi-square point of ``Rules.tail``.

The search is deterministic: three robust starts (correlation of hyperbolic tangents, spatial signs,
and the inner half, all about median and quartiles) are concentrated ``Rules.steps`` times, and
the one of least determinant stays. Medians and cuts are read from exact counts of narrow bins, so
the result doesn't depend on how rows are partitioned. A group's estimate is weighed with that of
all rows as by ``Rules.prior`` rows of the latter, so a small group leans on it and a large one doesn't.

Null text: no words, so the base rule fails. Null language or source: a group of its own. Very
long texts are one row's work. Ties (equal statistics) get equal verdicts; a floor under each
variance keeps constant statistics apart from zero. Repeated rows repeat and count as often. Only the
id and the new columns are kept, so other names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, small

#: What separates words, and the symbols that are counted.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    repeat_percent: int = 30
    half: float = 0.5
    steps: int = 4
    tail: float = 1e-4
    #: Rows' worth of the estimate of all rows in a group's estimate.
    prior: int = 40


#: Name, transformed statistic, least standard deviation that counts.
STATISTICS: tuple[tuple[str, Callable[[], Column], float], ...] = (
    ("z_word", lambda: F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), 0.12),
    ("z_symbol", lambda: F.log1p(8 * F.col("n_symbols") / (F.col("n_words") + 1)), 0.25),
    ("z_repeat", lambda: F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 1)), 0.12),
    ("z_lines", lambda: F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1)), 0.11),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    spaced = F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 8-word windows that the text holds twice or more."""
    one = F.transform(words, lambda w: F.xxhash64(w))

    def join(step: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def covered(sorted_windows: Column) -> Column:
        same = lambda w, k, other: F.get(sorted_windows, k + other)["h"] == w["h"]
        hits = F.filter(
            F.transform(sorted_windows, lambda w, k: F.when(F.coalesce(same(w, k, F.lit(-1)), F.lit(False)) | F.coalesce(same(w, k, F.lit(1)), F.lit(False)), w["i"])),
            lambda i: i.isNotNull(),
        )
        return let(
            F.array_sort(hits),
            lambda at: F.aggregate(
                F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda total, x: total + x
            ),
        )

    def count(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.array_sort(pairs), covered))

    eight = let(let(let(one, join(1)), join(2)), join(4))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(F.slice(eight, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), count))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id, group columns (g0, g1, ...), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)], text.alias("text"))
    facts = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: without(x, BLANKS) != "")
    line_facts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return base.select(
        "id",
        *[f"g{i}" for i in range(len(group_cols))],
        facts.alias("w"),
        line_facts.alias("l"),
        F.length(without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
    ).select("id", *[f"g{i}" for i in range(len(group_cols))], "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def chi_square_point(p: int, tail: float) -> float:
    """x with P(chi-square of p (even) degrees > x) = tail, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        above = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(p // 2))
        low, high = (mid, high) if above > tail else (low, mid)
    return low


def consistency(p: int, half: float) -> float:
    """Factor that makes the scatter of the inner ``half`` of a normal sample that of the whole."""
    q = chi_square_point(p, 1 - half)
    inner = 1 - math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range((p + 2) // 2))
    return half / inner


#: Bins per unit of a statistic, and of the logarithm of a distance.
FINE, LOG_FINE = 2048, 64


def _cut(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by, cut): the bin in which the ``share`` of the counted rows is reached."""
    order = Window.partitionBy(*by)
    running = F.sum("n").over(order.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"sofar": running, "all": F.sum("n").over(order)}).where(F.col("sofar") >= share * F.col("all")).groupBy(*by).agg(F.min("bin").alias("cut"))


def _cells(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _quartiles(base: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """key, m_ (medians) and s_ (quartile ranges as standard deviations, with the floors)."""
    each = base.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(n) * FINE).alias("bin")) for i, n in enumerate(names)])).alias("x")).select("key", "x.*")
    counts = materialise(each.groupBy("key", "i", "bin").agg(F.count(F.lit(1)).alias("n")))
    low, mid, high = (_cut(counts, ["key", "i"], q).withColumnRenamed("cut", f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75)))
    points = low.join(mid, ["key", "i"]).join(high, ["key", "i"])
    at = lambda i, column: F.max(F.when(F.col("i") == i, column))
    spread = (F.col("q2") - F.col("q0")) / (FINE * 1.349)
    return points.groupBy("key").agg(
        *[at(i, (F.col("q1") + 0.5) / FINE).alias(f"m_{n}") for i, n in enumerate(names)],
        *[at(i, F.sqrt(spread * spread + floors[i] ** 2)).alias(f"s_{n}") for i, n in enumerate(names)],
    )


def _starts(base: DataFrame, middle: DataFrame, names: list[str], floors: list[float], n_groups: int) -> DataFrame:
    """key, start, m_ and l_: the three starts."""
    p = len(names)
    z = [((F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")) for n in names]
    scaled = base.join(small(middle, n_groups), "key").select("key", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    norm = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(1, p)), F.col("z0") ** 2))
    scaled = scaled.withColumn("norm", norm)
    tanh = scaled.select("key", F.lit(0).alias("start"), *[F.tanh(f"z{i}").alias(f"z{i}") for i in range(p)])
    signs = scaled.select("key", F.lit(1).alias("start"), *[F.when(F.col("norm") > 0, F.col(f"z{i}") / F.col("norm")).otherwise(0.0).alias(f"z{i}") for i in range(p)])
    binned = scaled.withColumn("bin", _log_bin(F.col("norm")))
    cut = _cut(binned.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n")), ["key"], 0.5)
    inner = binned.join(small(cut, n_groups), "key").where("bin <= cut").select("key", F.lit(2).alias("start"), *[f"z{i}" for i in range(p)])
    moments = tanh.unionByName(signs).unionByName(inner).groupBy("key", "start").agg(*[F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c_{i}_{j}") for i, j in _cells(p)])
    moments = moments.join(small(middle, n_groups), "key")
    scatter = {f"c_{i}_{j}": F.col(f"c_{i}_{j}") * F.col(f"s_{names[i]}") * F.col(f"s_{names[j]}") + (floors[i] ** 2 if i == j else 0.0) for i, j in _cells(p)}
    return materialise(_cholesky(moments.withColumns(scatter), floors).drop(*[f"s_{n}" for n in names]))


def _log_bin(x: Column) -> Column:
    return F.floor(F.log(x + 1e-9) * LOG_FINE)


def mahalanobis(rows: DataFrame, names: list[str], floors: list[float], groups: list[str], rules: Rules) -> DataFrame:
    """``rows`` with d2, the squared robust distance within its group."""
    p = len(names)
    own = F.to_json(F.struct(*[F.col(g).cast("string").alias(g) for g in groups]))
    keyed = rows.withColumn("key", own)
    n_groups = 3 * (keyed.select("key").distinct().count() + 1)
    base = keyed.select("key", *names).unionByName(rows.select(F.lit("").alias("key"), *names))
    centre = _starts(base, materialise(_quartiles(base, names, floors)), names, floors, n_groups)
    factor = consistency(p, rules.half)
    scatter = {f"c_{i}_{j}": F.col(f"c_{i}_{j}") * factor + (floors[i] ** 2 if i == j else 0.0) for i, j in _cells(p)}
    for _ in range(rules.steps):
        scored = _distance(base, centre, names, n_groups).withColumn("bin", _log_bin(F.col("d2")))
        cut = _cut(scored.groupBy("key", "start", "bin").agg(F.count(F.lit(1)).alias("n")), ["key", "start"], rules.half)
        inner = scored.join(small(cut, n_groups), ["key", "start"]).where("bin <= cut")
        moments = inner.groupBy("key", "start").agg(
            *[F.round(F.avg(n), 10).alias(f"m_{n}") for n in names],
            *[F.round(F.coalesce(F.covar_pop(names[i], names[j]), F.lit(0.0)), 12).alias(f"c_{i}_{j}") for i, j in _cells(p)],
        )
        before, centre = centre, materialise(_cholesky(moments.withColumns(scatter), floors))
        discard(before)
    determinant = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, p)), F.log("l_0_0"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.round(determinant, 6), "start"))
    best = centre.withColumn("best", best).where("best = 1").join(base.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")), "key")
    # weighed with the estimate of all rows
    values = [f"m_{n}" for n in names] + [f"c_{i}_{j}" for i, j in _cells(p)]
    pooled = best.where("key = ''").select(values).first()
    if pooled is not None:
        w = F.col("n_rows") / (F.col("n_rows") + rules.prior)
        best = best.where("key <> ''").withColumns({v: F.round(w * F.col(v) + (1 - w) * F.lit(pooled[v]), 12) for v in values})
    return _distance(keyed, materialise(_cholesky(best, floors)), names, n_groups).drop("key", "start")


def _distance(rows: DataFrame, centre: DataFrame, names: list[str], n_groups: int) -> DataFrame:
    p = len(names)
    joined = rows.join(small(centre.select("key", "start", *[f"m_{n}" for n in names], *[f"l_{i}_{j}" for i, j in _cells(p)]), n_groups), "key")
    ys: list[Column] = []
    for i, n in enumerate(names):
        y = F.col(n) - F.col(f"m_{n}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * ys[j]
        ys.append(y / F.col(f"l_{i}_{i}"))
    total = sum((y * y for y in ys[1:]), ys[0] * ys[0])
    return joined.select(*rows.columns, "start", total.alias("d2"))


def _cholesky(moments: DataFrame, floors: list[float]) -> DataFrame:
    """With l_, the lower triangular root of the scatter c_."""
    for i, j in _cells(len(floors)):
        x = F.col(f"c_{i}_{j}")
        for k in range(j):
            x = x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        moments = moments.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(x, F.lit(floors[i] ** 2 / 4))) if i == j else x / F.col(f"l_{j}_{j}"))
    return moments


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), rules: Rules = Rules()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept."""
    facts = statistics(docs, id_col, text_col, group_cols)
    names = [n for n, _, _ in STATISTICS]
    rows = materialise(facts.withColumns({n: f() for n, f, _ in STATISTICS}))
    base_failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    scored = mahalanobis(rows, names, [s for _, _, s in STATISTICS], [f"g{i}" for i in range(len(group_cols))], rules)
    outlier = F.coalesce(F.col("d2") > chi_square_point(len(names), rules.tail), F.lit(False))
    return scored.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), F.sqrt("d2").alias("distance"), (~base_failed & ~outlier).alias("kept"),
    )
