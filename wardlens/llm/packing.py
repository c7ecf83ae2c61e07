"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces of that length and a remainder. Pieces are
packed best-fit decreasing: each goes to the open bin with the least room that holds it; where none does, a
bin is opened. All rules for the size of a new bin (each permitted length, the shortest that fits, the one
of least cost per packed unit) are planned and the plan of least total cost is taken. At the end each bin
shrinks to the shortest permitted length that holds its contents.

Best-fit needs only how many pieces have each length, so the plan is made for runs of equal bins from a
histogram of at most ``max(lengths)`` rows. Spark ranks the pieces of each length (counts per slice, then
ranks inside a slice) and looks every (length, rank) up in the plan.

Defined results: documents of length NULL or below 1 have no piece and no row; equal lengths are ranked by
a hash of the document, then by doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import cut_lineage

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a bin besides its length.
OVERHEAD = 16


@dataclass
class Plan:
    """Segments (length, first rank, first bin, pieces per bin, offset) and runs of bins (first, count, used)."""

    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    runs: list[tuple[int, int, int]] = field(default_factory=list)
    bins: int = 0

    def cost(self, lengths: list[int], overhead: int) -> int:
        return sum(n * (lengths[bisect_left(lengths, used)] + overhead) for _, n, used in self.runs)


def best_fit(histogram: dict[int, int], lengths: list[int], opened: str | int, overhead: int) -> Plan:
    """Best-fit decreasing over runs of equal bins; ``opened`` is a rule for the size of new bins."""
    plan, rooms, runs = Plan(), [], {}

    def push(room: int, first: int, count: int, used: int) -> None:
        if count:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, count, used))

    def size_for(length: int) -> int:
        fitting = [c for c in lengths if c >= length]
        if isinstance(opened, int):
            return opened if opened >= length else fitting[0]
        if opened == "shortest":
            return fitting[0]
        return min(fitting, key=lambda c: ((c + overhead) / (c // length * length), c))

    def place(length: int, rank: int, left: int, room: int, first: int, count: int, used: int) -> int:
        """Fill bins of a run; returns how many pieces were placed."""
        each = room // length
        full = min(count, left // each)
        if full:
            plan.segments.append((length, rank, first, each, used))
            push(room - each * length, first, full, used + each * length)
        placed, rest = full * each, left - full * each
        if full < count and 0 < rest < each:
            plan.segments.append((length, rank + placed, first + full, rest, used))
            push(room - rest * length, first + full, 1, used + rest * length)
            placed, full = placed + rest, full + 1
        push(room, first + full, count - full, used)
        return placed

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count, used = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room = size_for(length)
                first, count, used = plan.bins, -(-left // (room // length)), 0
                plan.bins += count
            placed = place(length, rank, left, room, first, count, used)
            rank, left = rank + placed, left - placed
    plan.runs = sorted(run for found in runs.values() for run in found)
    return plan


def best_plan(histogram: dict[int, int], lengths: list[int], overhead: int = OVERHEAD) -> Plan:
    rules: list[str | int] = [*lengths, "shortest", "least cost"]
    plans = [best_fit(histogram, lengths, rule, overhead) for rule in rules]
    return min(plans, key=lambda p: p.cost(lengths, overhead))


def pack(
    docs: DataFrame, length: str, key: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD
) -> DataFrame:
    """One row per piece: key, piece, start, length, bin_id, bin_offset, bin_capacity, bin_used.

    ``length`` names a column with the length of each document. ``start`` counts in the document.
    """
    permitted = sorted(set(lengths))
    longest = permitted[-1]
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select(F.col(key).alias("key"), F.col(length).cast("bigint").alias("all")).where(F.col("all") > 0)
    pieces = (
        sized.select("key", "all", F.explode(F.sequence(F.lit(0), F.ceil(F.col("all") / longest) - 1)).alias("piece"))
        .withColumn("length", F.least(F.lit(longest), F.col("all") - F.col("piece") * longest).cast("int"))
        .withColumn("slice", F.pmod(F.xxhash64("key", "piece"), F.lit(slices)).cast("int"))
        .drop("all")
    )
    pieces = cut_lineage(pieces)
    counts = cut_lineage(pieces.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_plan(histogram, permitted, overhead)
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy(F.xxhash64("key"), "key", "piece")
    ranked = (
        pieces.withColumn("in_slice", F.row_number().over(order) - 1)
        .join(offsets, ["length", "slice"])
        .select("key", "piece", "length", (F.col("before") + F.col("in_slice")).alias("rank"))
    )
    segments = np.array(sorted(plan.segments), np.int64).reshape(-1, 5)
    runs = np.array(plan.runs, np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((segments, runs, np.array(permitted, np.int64)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bins, sizes = shared.value
        # One sorted number for (length, rank): ranks of one length stay below 2**48.
        starts = (parts[:, 0] << 48) + parts[:, 1]
        for batch in batches:
            piece, size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            found = parts[np.searchsorted(starts, (size << 48) + rank, side="right") - 1]
            after = rank - found[:, 1]
            number = found[:, 2] + after // found[:, 3]
            used = bins[np.searchsorted(bins[:, 0], number, side="right") - 1, 2]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(piece),
                    pa.array(piece * longest),
                    pa.array(size),
                    pa.array(number),
                    pa.array(found[:, 4] + after % found[:, 3] * size),
                    pa.array(sizes[np.searchsorted(sizes, used)]),
                    pa.array(used),
                ],
                names=["key", "piece", "start", "length", "bin_id", "bin_offset", "bin_capacity", "bin_used"],
            )

    schema = f"key {kind}, piece bigint, start bigint, length bigint, bin_id bigint, bin_offset bigint, bin_capacity bigint, bin_used bigint"
    return ranked.mapInArrow(run, schema).withColumnRenamed("key", key)
