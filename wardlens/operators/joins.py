"""Joins Spark has no direct operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import hour_number


def interval_join(
    spans: DataFrame,
    events: DataFrame,
    key: str,
    start: str,
    end: str,
    at: str,
    bucket_hours: int = 6,
) -> DataFrame:
    """Inner join on the key and ``start <= at <= end``, both ends included.

    Time is cut into buckets and a span is repeated once per bucket it touches, so the join key is
    (key, bucket): a subject with very many events is spread over its buckets, and an event only
    meets spans of its own bucket. A span without an end matches nothing.
    """

    def bucket(c):
        return F.floor(hour_number(c) / F.lit(bucket_hours)).cast("bigint")

    pieces = spans.where(F.col(start) <= F.col(end)).withColumn(
        "_bucket", F.explode(F.sequence(bucket(start), bucket(end)))
    )
    timed = events.where(F.col(at).isNotNull()).withColumn("_bucket", bucket(at))
    return (
        timed.join(pieces, [key, "_bucket"])
        .where(F.col(at).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join to a table with unique keys, missing keys get the default."""
    return df.join(table.select(key, value), key, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default))
    )
