"""Order-dependent operators that never put one hot group into one task.

A plain window or an exact ``percentile`` gathers a whole group in a single task. Here a group is
first cut into ordered slices; each slice is handled on its own, and a small table with one row per
slice carries the totals from slice to slice. Where the cuts lie only affects balance, never results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import cut_lineage

ROWS_PER_SLICE = 200_000
ROWS_PER_BLOCK = 50_000
GRID_POINTS = 200


def split_points(df: DataFrame, column: str) -> list[float]:
    """Approximate quantiles of a numeric column that cut the rows into slices of a fair size.

    There is a slice for every shuffle partition at least, and more so that a slice has about
    ``ROWS_PER_SLICE`` rows. Every point is a value of the column; one number per slice reaches the driver.
    The row count and a grid of quantiles come from one aggregate; only a table with more slices than the grid
    has points is read again, for a grid of its own size.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(column).cast("double")

    def grid(slices: int) -> tuple[int, list[float]]:
        points = F.array(*[F.lit(i / slices) for i in range(1, slices)]).cast("array<double>")
        found = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, points, 5 * slices).alias("v")).first()
        return found["n"], found["v"] or []

    fine = max(partitions, GRID_POINTS)
    n, points = grid(fine) if fine > 1 else (0, [])
    slices = max(partitions, n // ROWS_PER_SLICE + 1)
    if slices > fine:
        _, points = grid(slices)
    elif points:
        points = [points[i * fine // slices - 1] for i in range(1, slices)]
    return sorted({p for p in points if p == p})


def slice_of(value: Column, points: list[float]) -> Column:
    """Index of the slice a value falls in: how many points are not above it, by binary search.

    The points are one literal array, so the plan does not grow with them.
    """
    if not points:
        return F.lit(0)
    sorted_points = F.split(F.lit(",".join(map(repr, points))), ",").cast("array<double>")
    steps = F.sequence(F.lit(1), F.lit(len(points).bit_length()))
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(points)).alias("hi"))

    def halve(span: Column, _step: Column) -> Column:
        mid = F.shiftright(span["lo"] + span["hi"], 1)
        above = span["lo"] >= span["hi"]
        right = F.get(sorted_points, mid) <= value
        return F.struct(
            F.when(~above & right, mid + 1).otherwise(span["lo"]).alias("lo"),
            F.when(~above & ~right, mid).otherwise(span["hi"]).alias("hi"),
        )

    return F.aggregate(steps, whole, halve, lambda span: span["lo"])


def _window(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def running_totals(
    df: DataFrame,
    order: str,
    sums: list[str],
    by: list[str] | None = None,
    points: list[float] | None = None,
) -> DataFrame:
    """Add ``<sum>_before`` (rows that come earlier) and ``<sum>_all`` for each summed column.

    Expects one row per (group, order value): aggregate first. The input is read three times (cuts,
    slice totals, rows), so it is written out once instead of being computed again; a caller that
    passes the cut points has done so.
    """
    by = by or []
    if points is None:
        df = cut_lineage(df)
        points = split_points(df, order)
    cut = df.withColumn("_slice", slice_of(F.col(order).cast("double"), points))
    totals = cut.groupBy(*by, "_slice").agg(*[F.sum(s).alias(f"_{s}_in") for s in sums])
    across = _window(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_{s}_in").over(across), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(f"_{s}_in").over(_window(by)).alias(f"{s}_all") for s in sums],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = null_safe_join(cut, offsets, [*by, "_slice"])
    for s in sums:
        joined = joined.withColumn(
            f"{s}_before", F.col(f"_{s}_off") + F.coalesce(F.sum(s).over(inside), F.lit(0))
        )
    return joined.drop("_slice", *[f"_{s}_off" for s in sums])


def over_all(aggregate: Column) -> Column:
    """An aggregate over all rows of a report; only for results of a few dozen rows."""
    return aggregate.over(_window([]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _around_ranks(
    df: DataFrame, value: str, by: list[str], ranks: list[Column], weight: Column | None = None, counted: bool = False
) -> DataFrame:
    """Distinct values near the wanted zero-based ranks, as (by, _v, _n, _before, _all).

    Ranks may use ``_all``, the number of values in the group. Equal values are combined first and
    written out once, unless the input is ``counted`` (a stored table with one row per group and value);
    then only the slices that hold a wanted rank are sorted.
    """
    known = df.where(F.col(value).isNotNull())
    if counted:
        counted = known.select(*by, F.col(value).alias("_v"), weight.alias("_n"))
    else:
        counted = cut_lineage(
            known.groupBy(*by, F.col(value).alias("_v")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
        )
    points = split_points(counted, "_v")
    cut = counted.withColumn("_slice", slice_of(F.col("_v").cast("double"), points))
    totals = cut.groupBy(*by, "_slice").agg(F.sum("_n").alias("_in"))
    across = _window(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.select(
        *by,
        "_slice",
        "_in",
        F.coalesce(F.sum("_in").over(across), F.lit(0)).alias("_off"),
        F.sum("_in").over(_window(by)).alias("_all"),
    )
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | ((r >= F.col("_off")) & (r < F.col("_off") + F.col("_in")))
    kept = null_safe_join(cut, spans.where(wanted).drop("_in"), [*by, "_slice"])
    inside = Window.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return kept.withColumn(
        "_before", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ).drop("_slice", "_off")


def exact_percentiles(
    df: DataFrame,
    value: str,
    fractions: dict[str, float],
    by: list[str] | None = None,
    weight: str | None = None,
    counted: bool = False,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.

    ``weight`` names a column with the number of times a row counts; ``counted`` says that the input is a stored
    table with one row per group and value, which need not be combined and written again.
    """
    by = by or []

    def rank(fraction: float) -> Column:
        return F.lit(fraction) * (F.col("_all") - 1)

    numbers = df.withColumn(value, F.col(value).cast("double"))
    ranks = [r for f in fractions.values() for r in (F.floor(rank(f)), F.ceil(rank(f)))]
    near = _around_ranks(numbers, value, by, ranks, F.col(weight) if weight else None, counted).withColumn("_end", F.col("_before") + F.col("_n"))
    picks = []
    for name, f in fractions.items():
        picks.append(F.min(F.when(F.col("_end") > F.floor(rank(f)), F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_end") > F.ceil(rank(f)), F.col("_v"))).alias(f"_hi_{name}"))
    picked = near.groupBy(*by).agg(F.max("_all").alias("_all"), *picks)
    return picked.select(
        *by,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (rank(f) - F.floor(rank(f)))
            ).alias(name)
            for name, f in fractions.items()
        ],
    )


def smallest_share(
    df: DataFrame,
    order: Column,
    share: float,
    by: list[str] | None = None,
    tie: str | None = None,
    flag: str = "in_share",
) -> DataFrame:
    """Flag the first ``floor(share * n)`` rows of each group in (order, tie) order.

    The cut-off of a group is found on narrow columns: the order value that holds the last wanted
    rank and, among the rows that share it, the last wanted tie value. Whole rows are then compared
    with one cut-off row per group and are not sorted at all.
    """
    by = by or []
    wanted = F.floor(F.col("_all") * F.lit(share) + F.lit(1e-9))
    narrow = df.select(*by, order.alias("_order"), *([F.col(tie).alias("_tie")] if tie else []))
    holds_last = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") >= F.col("_need"))
    cuts = (
        _around_ranks(narrow, "_order", by, [wanted - 1])
        .withColumn("_need", wanted)
        .where(holds_last)
        .select(*by, F.col("_v").alias("_order_cut"), (F.col("_need") - F.col("_before")).alias("_need"))
    )
    if tie:
        keys = [*by, "_order_cut"]
        shared = null_safe_join(narrow.withColumnRenamed("_order", "_order_cut"), cuts, keys)
        cuts = (
            _around_ranks(shared, "_tie", [*keys, "_need"], [F.col("_need") - 1])
            .where(holds_last)
            .select(*keys, F.col("_v").alias("_tie_cut"))
        )
    else:
        cuts = cuts.drop("_need")
    found = [c for c in cuts.columns if c not in by]
    if by:
        joined = null_safe_join(df, cuts, by, "left")
    else:
        one = df.withColumn("_cut", cuts.select(F.struct(*found)).scalar())
        joined = one.select("*", "_cut.*").drop("_cut")
    inside = order < F.col("_order_cut")
    at_cut = order == F.col("_order_cut")
    inside = inside | ((at_cut & (F.col(tie) <= F.col("_tie_cut"))) if tie else at_cut)
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop(*found)


def _boundary_window(keys: list[str], unit: str, is_last: str):
    """Last rows of all units of a key together, all other rows apart by unit.

    A lead over it takes a last row to the last row of the next unit; the key's other rows stay
    spread over their units.
    """
    return Window.partitionBy(*keys, F.when(~F.col(is_last), F.col(unit))).orderBy(unit)


def next_row(
    df: DataFrame, order: str, columns: list[str], points: list[float], prefix: str = "next_"
) -> DataFrame:
    """Values of the row that follows in order over the whole table; NULL on the last row.

    The order is cut at the given points. The last row of a slice takes the first row of the next
    slice that has rows.
    """
    cut = df.withColumn("_slice", slice_of(F.col(order).cast("double"), points))
    inside = Window.partitionBy("_slice").orderBy(order)
    here = (
        cut.withColumn("_next", F.lead(F.struct(*columns)).over(inside))
        .withColumn("_first", F.first(F.struct(*columns)).over(inside))
        .withColumn("_is_last", F.col("_next").isNull())
    )
    after = F.lead("_first").over(_boundary_window([], "_slice", "_is_last"))
    joined = here.withColumn("_after", after).withColumn(
        "_next", F.when(F.col("_is_last"), F.col("_after")).otherwise(F.col("_next"))
    )
    return joined.select(*df.columns, *[F.col(f"_next.{c}").alias(f"{prefix}{c}") for c in columns])


def placed_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows, written once in ranges of the order, with ``_part``, ``_block`` and ``_row``.

    (part, block, row) follow the order. A part is a range partition, so equal rows of a hot key share a part
    only as far as the order cannot tell them apart; a block has at most ``ROWS_PER_BLOCK`` rows of a part.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_row", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_row", 33)).withColumn("_block", F.expr(f"_row % {1 << 33} div {ROWS_PER_BLOCK}"))


def next_in_time(df: DataFrame, keys: list[str], time: str, tie: str, name: str) -> DataFrame:
    """Next time within a key, in (time, tie) order; NULL on the last row. Rows without a time come first.

    All rows are laid out in ranges of (key, time, tie), so a hot key, day or instant spreads like all others.
    Windows run over blocks of bounded size. A carry table holds the first row of every block and gives it to
    the block before as a guard row; over the first rows of parts, of which there is one a partition, a window
    finds the part before.
    """
    order = [F.col(c).asc_nulls_first() for c in [*keys, time, tie]]
    rows = placed_in_order(df, order)
    carried = [*keys, time, "_row", "_part", "_block"]
    opens = rows.where(F.col("_row") % (1 << 33) % ROWS_PER_BLOCK == 0).select(*carried)
    parts = rows.groupBy("_part").agg(F.max("_block").alias("_last"))
    before = parts.select(
        F.lead("_part").over(_window([]).orderBy("_part")).alias("_part"),
        F.struct(F.col("_part").alias("part"), F.col("_last").alias("block")).alias("_to"),
    ).where(F.col("_part").isNotNull())
    inner = opens.where(F.col("_block") > 0).withColumn("_block", F.col("_block") - 1)
    outer = opens.where(F.col("_block") == 0).join(before, "_part").select(
        *keys, time, "_row", F.col("_to.part").alias("_part"), F.col("_to.block").alias("_block")
    )
    guards = inner.unionByName(outer).withColumn("_guard", F.lit(True))
    both = rows.withColumn("_guard", F.lit(False)).unionByName(guards, allowMissingColumns=True)
    following = Window.partitionBy("_part", "_block").orderBy("_row")
    nexts = {c: F.lead(c).over(following) for c in [*keys, time]}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(nexts[k]) for k in keys], F.lead(F.lit(True)).over(following))
    return both.withColumn(name, F.when(same, nexts[time])).where(~F.col("_guard")).select(*df.columns, name)


def first_rows(
    df: DataFrame, by: list[str], order: list[Column | str], n: int, rank: str = "rn"
) -> DataFrame:
    """First n rows per group; Spark cuts every map partition to n rows per group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
