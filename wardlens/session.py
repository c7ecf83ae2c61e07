"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WARDLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    A machine-local folder is made only in local mode, where there is one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="wardlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go as soon as it is, not when the driver happens to collect its garbage, and
#: Python gets rows of long lists in small batches.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
#: Bytes of a row group, the most that a reader unpacks at once.
GROUP_BYTES = 16 << 20


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    A parquet table is computed once, survives lost executors, is read by column, and its real size
    steers the joins that follow. The shuffle files it took are removed once it is written, and its row groups are
    small, since a reader unpacks thousands of rows of a group at once, however long their lists are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    with settings(spark, WRITING):
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Remove the files of a table of :func:`cut_lineage` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not folder.rpartition("/")[2].startswith("table-"):
            raise ValueError(f"not a table of cut_lineage: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a key that one task sorts at most, on average.
TASK_ROWS = 1 << 17


def dealt(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """The rows dealt out by a key in so many partitions that none has more than ``TASK_ROWS`` on average.

    Adaptive execution joins partitions by their compressed bytes, so a task that sorts rows for several joins may
    get far more memory to fill than these tell. A table of so many rows for each core is left to it. Keys must be
    near unique: one that holds many rows is not divided. ``rows`` is counted if not given.
    """
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    if rows <= TASK_ROWS * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), key)
