"""Tables, files and models out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def save_table(
    df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: list[str] | None = None, buckets: int = 0, path: str | None = None
) -> DataFrame:
    """Create or replace a catalog table and read it; rows of a table have no order, so none is imposed.

    A bucketed table is dealt out by its bucket columns once, when it is written (a file per bucket), and sorted
    by them; joins and groupings on these columns then need no shuffle. With a path the table is external, which
    a session without a lasting catalog can replace.
    """
    if bucket_by:
        df = df.repartition(buckets, *bucket_by)
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write and read back; array and vector columns keep their type."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes are doubled and texts may hold line breaks."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save_model(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)
