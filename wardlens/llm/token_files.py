"""Token ids in binary blocks: frequency-ranked ids in byte-aligned code with separate control bytes.

A block holds whole documents in ascending ``doc_id`` order. Ids are replaced by their rank of frequency in
the block (the block carries the table of ranks, equal counts in id order), so that the commonest 256 take
one byte. Each number is stored in 1 to 4 bytes, least significant first; its length minus one is two bits
of the control stream, four numbers to a control byte. Reading is table lookup: control bytes to lengths,
ranks to ids.

The blocks are rows of a Parquet table that Spark writes: its committer keeps the files whole when executors
are lost, and any store that Spark writes to will do. ``part`` numbers ranges of ``doc_id`` and ``block``
counts in a part, so (part, block) is the order of the ids.

Defined results: NULL and empty texts hold the end id alone; rows with equal doc_id follow each other in
text order; NULL doc_ids come first; an empty table gives an empty file table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.llm import bpe

BLOCKS = (
    "part int, block int, doc_ids array<bigint>, sizes array<bigint>, ranks binary, control binary, data binary"
)
#: Ids in a block, after which the next document opens a new one.
BLOCK_IDS = 1 << 21
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ids as (table of ids by rank, control bytes, data bytes)."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    by_rank = used[np.argsort(-counts[used], kind="stable")].astype("<u4")
    rank_of = np.zeros(len(counts), "<u4")
    rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
    ranks = rank_of[ids]
    lengths = (ranks > 0xFF).astype(np.uint8)
    lengths += ranks > 0xFFFF
    lengths += ranks > 0xFFFFFF
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = lengths
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    wide = int(lengths.max(initial=0)) + 1
    kept = np.arange(wide, dtype=np.uint8) <= lengths[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :wide][kept]
    return by_rank.tobytes(), control.tobytes(), data.tobytes()


def unpack(count: int, by_rank: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids that ``pack`` was given."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    stream = np.frombuffer(data, np.uint8)
    ranks = stream[starts].astype("<u4")
    for j in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > j)
        ranks[more] |= stream[starts[more] + j].astype("<u4") << np.uint32(8 * j)
    return np.frombuffer(by_rank, "<u4")[ranks]


def write_ids(docs: DataFrame, model: str, to: str, end_id: int | None = 0, text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text with the tokenizer file and write the blocks to a folder.

    The one shuffle deals the texts out by ranges of ``doc_id``.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = bpe.encoder(model), TaskContext.get().partitionId(), 0
        names, sizes, streams, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            ranks, control, data = pack(np.frombuffer(b"".join(streams), "<u4"))
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([number], pa.int32()),
                    "doc_ids": pa.array([names], pa.list_(pa.int64())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "ranks": pa.array([ranks], pa.binary()),
                    "control": pa.array([control], pa.binary()),
                    "data": pa.array([data], pa.binary()),
                }
            )

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encode.texts(batch.column(1).to_pylist()), strict=True):
                ids += end
                names.append(name)
                sizes.append(len(ids) // 4)
                streams.append(ids)
                held += len(ids) // 4
                if held >= block_ids:
                    yield block()
                    number += 1
                    names, sizes, streams, held = [], [], [], 0
        if names:
            yield block()

    dealt = docs.select("doc_id", F.col(text).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, BLOCKS).write.parquet(to)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 [, ids]."""
    kept = "part int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    schema = kept + (", ids array<bigint>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(sum(row["sizes"]), row["ranks"], row["control"], row["data"])
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                starts = ends - np.array(row["sizes"], np.int64)
                n = len(ends)
                columns = [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["block"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64()),
                ]
                names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    totals = blocks.select("part", "block", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_start = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.join(part_start, "part").select(
        "part", "block", (F.col("part_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("offset")
    )
    found = blocks.mapInArrow(run, schema).join(offsets, ["part", "block"])
    return found.select(
        "doc_id",
        (F.col("offset") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )
