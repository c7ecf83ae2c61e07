"""Quality rules and robust multivariate outliers (DataFrame functions only).

Base rules reject texts of fewer than ten words and texts in which more than a fifth of the words lie in
repeated five-word windows. For the others a vector of transformed statistics is compared with the
minimum-covariance-determinant estimate of its language and source: starting from medians and quartile
ranges, concentration steps take the three quarters of the rows that are nearest to the present estimate
and recompute mean and covariance from them. A row is rejected when its squared Mahalanobis distance is
above ``cutoff``. Distances are scaled so that their median is that of a chi-squared variable.

Order statistics come from exact counts of fine bins (a row is in the subset when its bin is not above the
bin of the wanted rank), so they are mergeable, do not depend on partitioning and gather no group in a
task. A small variance is added to each statistic (``FLOORS``): most texts have no symbol and no repeated
line at all, and one such mark in a text must not make it an outlier. The distance counts only for
statistics on their bad side where that side is one (see ``statistics``).

A group of fewer than ``min_rows`` rows that pass the base rules has no estimate of its own: its rows are
compared with that of their language over all sources, or of all rows where the language has too few as well.

Defined results: NULL texts have no words, so they fail the base rules; NULL languages and sources form
groups like others; there is no distance only where no row at all passes the base rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.native import BLANKS, let, words
from wardlens.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Statistics and the standard deviation added to each.
FLOORS = {"x_word_length": 0.15, "x_symbols": 0.5, "x_dup_lines": 1.5, "x_repeats": 1.2, "x_upper": 0.5}
STATS = list(FLOORS)
SHARE = 0.75
#: Median of the chi-squared distribution with len(STATS) = 5 degrees of freedom (fixed value).
CHI_MEDIAN = 4.3515
PER_UNIT, PER_E = 64, 32


#: Bits that hold the index of a window in its array.
INDEX_BITS = 31


def _count(text: Column, characters: str) -> Column:
    """Characters of a class, counted by taking out the runs of all others."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def repeated_words(word_list: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that the text has twice or more.

    Leading hash bits and index are sorted as one number; only neighbours that agree in these bits are
    compared by whole hash.
    """

    def beside(xs: Column, x: Column, i: Column, part: Callable[[Column], Column]) -> Column:
        return F.coalesce(part(x) == part(F.get(xs, i - 1)), F.lit(False)) | F.coalesce(part(x) == part(F.get(xs, i + 1)), F.lit(False))

    def alike(grams: Column) -> Column:
        packed = F.sort_array(F.transform(grams, lambda h, i: F.shiftleft(h, INDEX_BITS).bitwiseOR(i.cast("bigint"))))
        near = let(packed, lambda xs: F.filter(xs, lambda x, i: beside(xs, x, i, lambda y: F.shiftright(y, INDEX_BITS))))
        index = F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << INDEX_BITS) - 1)).cast("int"))
        return F.sort_array(F.transform(index, lambda i: F.struct(F.get(grams, i).alias("h"), i.alias("i"))))

    def spread(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, i: beside(pairs, x, i, lambda y: y["h"]))
        return let(
            F.sort_array(F.transform(again, lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    def covered(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(alike(grams), spread))

    def grams(hashes: Column) -> Column:
        mixed = hashes
        for j in range(1, size):
            mixed = F.zip_with(mixed, F.slice(hashes, j + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))
        return F.slice(mixed, 1, F.greatest(F.size(hashes) - size + 1, F.lit(0)))

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), lambda hashes: let(grams(hashes), covered))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, ``base_failed`` and the transformed statistics of every whole text.

    Shares are taken per hundred and log-transformed. Mean word length counts by its deviation from the
    group in either direction, the others only where they are above the group's centre.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    word_facts = let(
        words(F.col(text)),
        lambda ws: F.struct(
            F.size(ws).alias("n"), repeated_words(ws).alias("repeated"), F.length(F.array_join(ws, "")).alias("chars")
        ),
    )
    line_facts = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("d")))
    counted = docs.withColumns(
        {
            "_w": word_facts,
            "_l": line_facts,
            "n_symbols": _count(whole, SYMBOLS).cast("bigint"),
            "_upper": _count(whole, "A-Z"),
        }
    ).withColumns(
        {
            "n_words": F.col("_w.n").cast("bigint"),
            "word_chars": F.col("_w.chars").cast("bigint"),
            "n_dup_lines": (F.col("_l.n") - F.col("_l.d")).cast("bigint"),
            "n_repeat_words": F.col("_w.repeated").cast("bigint"),
        }
    )

    def share(part: str, whole_: str) -> Column:
        return F.log1p(F.lit(100.0) * F.col(part) / F.greatest(F.col(whole_), F.lit(1)))

    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "x_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "x_symbols": share("n_symbols", "word_chars"),
            "x_dup_lines": share("n_dup_lines", "_l.n"),
            "x_repeats": share("n_repeat_words", "n_words"),
            "x_upper": share("_upper", "word_chars"),
        }
    ).drop("_w", "_l", "_upper")


#: Columns of the groups that can give a row its estimate, nearest first.
LEVELS = (["lang", "source"], ["lang"], [])


def _group(level: list[str]) -> Column:
    if not level:
        return F.lit("{}")
    return F.to_json(F.struct(*[F.col(c) for c in level]), {"ignoreNullFields": "false"})


def _in_groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """(group, statistics) of the rows that pass the base rules, once for each group whose estimate some row needs."""
    own, lang, whole = (_group(level) for level in LEVELS)
    sizes = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    sizes = cut_lineage(sizes.select(own.alias("own"), lang.alias("lang_group"), "n"))
    langs = sizes.groupBy("lang_group").agg(F.sum("n").alias("lang_n"), F.min("n").alias("least"))
    few = langs.agg(F.coalesce(F.min("lang_n") < min_rows, F.lit(False)).alias("few"))
    wanted = F.array(
        F.when(F.col("n") >= min_rows, F.col("own")),
        F.when((F.col("least") < min_rows) & (F.col("lang_n") >= min_rows), F.col("lang_group")),
        F.when(F.col("few"), whole),
    )
    groups = sizes.join(langs, "lang_group").crossJoin(few).select("own", F.array_compact(wanted).alias("groups"))
    good = rows.where("NOT base_failed").select(own.alias("own"), *STATS)
    return good.join(cut_lineage(groups), "own").select(F.explode("groups").alias("group"), *STATS)


def _quantile_bins(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group the bin that holds the row of rank ceil(share * n); counts has (keys, bin, n)."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(
        F.max("all").alias("rows"),
        *[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * s), F.col("bin"))).alias(name) for name, s in shares.items()],
    )


def _with_distance(rows: DataFrame, name: str, one_sided: bool = False) -> DataFrame:
    """Forward substitution one step a column, so that no step is computed twice."""
    added = []
    for j, x in enumerate(STATS):
        off = F.col(x) - F.col(f"m_{j}")
        if one_sided and j:
            off = F.greatest(off, F.lit(0.0))
        for k in range(j):
            off = off - F.get(f"c_{j}", F.lit(k)) * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{j}", off / F.get(f"c_{j}", F.lit(j)))
        added.append(f"z_{j}")
    return rows.withColumn(name, sum((F.col(z) * F.col(z) for z in added[1:]), F.col(added[0]) * F.col(added[0]))).drop(*added)


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance (plus floors) per group: m_j, c_j = row j of the factor."""
    pairs = {f"v_{j}_{k}": F.covar_pop(STATS[j], STATS[k]) for j in range(len(STATS)) for k in range(j + 1)}
    est = rows.groupBy("group").agg(
        *[F.avg(x).alias(f"m_{j}") for j, x in enumerate(STATS)], *[v.alias(n) for n, v in pairs.items()]
    )
    floors = list(FLOORS.values())
    for j in range(len(STATS)):
        for k in range(j + 1):
            left = F.col(f"v_{j}_{k}") + (F.lit(floors[j] ** 2) if j == k else F.lit(0.0))
            for i in range(k):
                left = left - F.col(f"l_{j}_{i}") * F.col(f"l_{k}_{i}")
            est = est.withColumn(f"l_{j}_{k}", F.sqrt(left) if j == k else left / F.col(f"l_{k}_{k}"))
    return est.select(
        "group",
        *[f"m_{j}" for j in range(len(STATS))],
        *[F.array(*[F.col(f"l_{j}_{k}") for k in range(j + 1)]).alias(f"c_{j}") for j in range(len(STATS))],
    )


def _distance_bin() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-6) * PER_E)


def estimate(rows: DataFrame, steps: int = 2, min_rows: int = 30) -> DataFrame:
    """Estimates per group of ``LEVELS`` that some row needs, from rows of ``statistics``: group, m_j, c_j, scale.

    ``rows`` is read several times: pass a written table of narrow columns.
    """
    good = _in_groups(rows, min_rows)
    long = good.select("group", F.posexplode(F.array(*STATS)).alias("j", "x"))
    counts = long.groupBy("group", "j", F.floor(F.col("x") * PER_UNIT).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = _quantile_bins(counts, ["group", "j"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    floors = F.array(*[F.lit(v) for v in FLOORS.values()])
    start = spread.groupBy("group").agg(
        *[F.max(F.when(F.col("j") == j, (F.col("q2") + 0.5) / PER_UNIT)).alias(f"m_{j}") for j in range(len(STATS))],
        *[
            F.max(F.when(F.col("j") == j, (F.col("q3") - F.col("q1")) / PER_UNIT / 1.349 + F.get(floors, F.lit(j)))).alias(f"s_{j}")
            for j in range(len(STATS))
        ],
    )
    est = start.select(
        "group",
        *[f"m_{j}" for j in range(len(STATS))],
        *[F.array(*[F.lit(0.0)] * j, F.col(f"s_{j}")).alias(f"c_{j}") for j in range(len(STATS))],
    )
    for _ in range(steps):
        est = cut_lineage(est)
        near = _with_distance(good.join(est, "group"), "d2").withColumn("bin", _distance_bin())
        cut = _quantile_bins(near.groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n")), ["group"], {"cut": SHARE})
        est = _moments(near.join(cut.select("group", "cut"), "group").where("bin <= cut").select("group", *STATS))
    est = cut_lineage(est)
    near = _with_distance(good.join(est, "group"), "d2").withColumn("bin", _distance_bin())
    middle = _quantile_bins(near.groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n")), ["group"], {"mid": 0.5})
    return est.join(
        middle.select("group", (F.exp((F.col("mid") + 0.5) / PER_E) / CHI_MEDIAN).alias("scale")), "group"
    )


def judged(rows: DataFrame, estimates: DataFrame, cutoff: float = 15.0) -> DataFrame:
    """Add ``distance`` and ``kept`` to rows that have the statistics; the nearest level with an estimate counts."""
    names = [c for c in estimates.columns if c != "group"]
    estimates = cut_lineage(estimates.select("group", F.struct(*names).alias("est")))
    found = rows
    for i, level in enumerate(LEVELS):
        at = estimates.select(F.col("group").alias(f"group_{i}"), F.col("est").alias(f"est_{i}"))
        found = found.withColumn(f"group_{i}", _group(level)).join(at, f"group_{i}", "left")
    near = F.coalesce(*[F.col(f"est_{i}") for i in range(len(LEVELS))])
    found = found.withColumn("est", near).drop(*[f"{p}_{i}" for p in ("group", "est") for i in range(len(LEVELS))])
    found = found.withColumns({c: F.col(f"est.{c}") for c in names}).drop("est")
    scaled = _with_distance(found, "distance", one_sided=True).withColumn(
        "distance", F.col("distance") / F.greatest(F.col("scale"), F.lit(1.0))
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return scaled.withColumn("kept", kept).drop("scale", *[f"{p}_{j}" for p in "mc" for j in range(len(STATS))])


def kept_documents(docs: DataFrame, cutoff: float = 15.0) -> DataFrame:
    """The documents that pass the base rules and are no outliers, with their columns.

    Statistics are computed once for the estimates, on narrow columns that are written out, and once more
    beside the texts, so that texts are joined with one row per group and not with one row per document.
    """
    stats = cut_lineage(statistics(docs).select("lang", "source", "base_failed", *STATS))
    prefix = "_own"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    clash = {c: f"{prefix}_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang", "source")}
    renamed = docs.withColumnsRenamed(clash)
    # A one-row generator: the filter on the verdict cannot go below it and compute the statistics anew.
    every = statistics(renamed)
    once = every.select(F.inline(F.array(F.struct(*[F.col(c) for c in every.columns]))))
    found = judged(once, estimate(stats), cutoff).where("kept")
    return found.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
