"""Small helpers for work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class Bounded(dict):
    """A lookup table that computes what is missing and starts anew when it holds ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def map_texts(
    rows: DataFrame, text: str, schema: StructType, work: Callable[[], Callable[[list], list[pa.Array]]]
) -> DataFrame:
    """Replace the text column (the last one) by computed columns, one Arrow batch at a time.

    ``work()`` is called once per task and returns a function from a list of texts to the new columns.
    """
    keys = [c for c in rows.columns if c != text]
    names = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work()
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(columns + made(batch.column(len(keys)).to_pylist()), names=names)

    return rows.select(*keys, text).mapInArrow(run, schema)
