"""Pivots, fills, trims and scalings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.operators.ordered import exact_percentiles


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Row counts per (row, column) value as a wide table, absent cells 0."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def pivot_means(
    df: DataFrame, row: str, column: str, value: str, values: list, prefix: str = ""
) -> DataFrame:
    """Long to wide mean; rows without a row key are dropped, absent cells stay NULL."""
    wide = df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, values).agg(F.avg(value))
    return wide.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def most_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """Top k values by row count, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(k)
    )


def most_frequent_values(df: DataFrame, column: str, k: int) -> list:
    """The k values themselves, needed as column names of a pivot."""
    return [r[0] for r in most_frequent(df, column, k).collect()]


def trim_outliers(df: DataFrame, columns: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Keep rows inside the percentile range of each column, one column after the other.

    Limits of a later column see only rows that survived the earlier ones, so order matters; a
    missing value fails. Two numbers per column reach the driver and become pushed-down filters.
    """
    for c in columns:
        limits = exact_percentiles(df, c, {"lo": lo, "hi": hi}).first()
        if limits is None:
            return df.where(F.lit(False))
        df = df.where(F.col(c).between(limits["lo"], limits["hi"]))
    return df


def fill_both_ways(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Carry the last value forward, then the first value backward, inside a short sequence."""
    ahead = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    for c in columns:
        df = df.withColumn(c, F.last(c, ignorenulls=True).over(ahead))
    for c in columns:
        df = df.withColumn(c, F.first(c, ignorenulls=True).over(back))
    return df


def first_present(column: str, at: str, tie: str) -> Column:
    """Aggregate: first non-missing value of a column in time order, rows without time last."""
    return F.expr(
        f"min_by({column}, struct({at} IS NULL, {at}, {tie})) FILTER (WHERE {column} IS NOT NULL)"
    )


def scale_min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """To [0, 1] over all rows; a constant column becomes 0."""
    bounds = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
            *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns],
        )
    ).scalar()
    out = df.withColumn("_b", bounds)
    for c in columns:
        lo, hi = F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}")
        out = out.withColumn(
            c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).when(F.col(c).isNotNull(), 0.0)
        )
    return out.drop("_b")


def scale_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant column is only centred."""
    bounds = df.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        )
    ).scalar()
    out = df.withColumn("_b", bounds)
    for c in columns:
        std = F.col(f"_b.std_{c}")
        out = out.withColumn(
            c, (F.col(c) - F.col(f"_b.mean_{c}")) / F.when(std > 0, std).otherwise(F.lit(1.0))
        )
    return out.drop("_b")


def fill_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace missing values by the exact median of the column.

    All medians come from one pass over the columns in long form; one number per column reaches
    the driver.
    """
    long = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]
            )
        ).alias("cell")
    ).select("cell.name", "cell.value")
    medians = {r["name"]: r["m"] for r in exact_percentiles(long, "value", {"m": 0.5}, ["name"]).collect()}
    return df.select(
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) if c in medians else F.col(c)
            for c in df.columns
        ]
    )
