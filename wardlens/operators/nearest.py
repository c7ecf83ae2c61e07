"""Nearest rows by cosine similarity: exact, in blocks of queries; for all rows, in hyperplane buckets.

Defined results: similarity is rounded to 12 decimals before rows are ranked, ties go by key; a zero vector has
similarity 0 with all; rows without a vector neither have neighbours nor are any; a row is no neighbour of itself
(equal keys), its copies are. Keys are unique and of one type (integers or strings).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators.ordered import first_rows
from wardlens.session import cut_lineage

QUERIES_PER_BLOCK = 8192
ROWS_PER_PRODUCT = 1024
ROWS_PER_BUCKET = 4096
CODE_BITS = 60
#: Of the bits with the least margins, how many are flipped in all combinations to find the buckets to probe.
FLIPPED_BITS = 10
SAMPLED_QUERIES = 200
#: Rows that one pass of the search of all rows sends, for each row of the table; more are sent in further passes.
SENT_AT_ONCE = 8
#: How much more may be compared than with the smallest buckets, if fewer rows are sent that way.
MORE_COMPARED = 1.25


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _keys(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist())


class _Best:
    """The k best (similarity, key) of every query of a block, updated product by product."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int | None):
        order = np.argsort(keys)
        self.keys, self.vectors, self.k = keys[order], vectors[order], k
        self.floor = np.full(len(keys), -np.inf)
        self.found = [np.zeros(0, np.int64), np.zeros(0), keys[:0]]

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        sims = np.round(self.vectors @ vectors.T, 12)
        if self.k is not None:
            own = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
            same = np.flatnonzero(self.keys[own] == keys)
            sims[own[same], same] = -np.inf
            if sims.shape[1] > self.k:
                least = np.partition(sims, sims.shape[1] - self.k, axis=1)[:, sims.shape[1] - self.k]
                self.floor = np.maximum(self.floor, least)
        query, row = np.nonzero((sims >= self.floor[:, None]) & (sims > -np.inf))
        self.found = [np.concatenate(x) for x in zip(self.found, (query, sims[query, row], keys[row]))]
        if self.k is not None:
            query, sim, key = self.found
            order = np.lexsort((key, -sim, query))
            starts = np.searchsorted(query[order], np.arange(len(self.keys)))
            rank = np.arange(len(order)) - starts[query[order]]
            self.found = [x[order[rank < self.k]] for x in self.found]
            last = order[rank == self.k - 1]
            self.floor[query[last]] = np.maximum(self.floor[query[last]], sim[last])

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        query, sim, key = self.found
        self.found = [x[:0] for x in self.found]
        arrays = [pa.array(self.keys[query].tolist(), schema.field(0).type), pa.array(key.tolist(), schema.field(1).type), pa.array(sim)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _searched(cells: DataFrame, key: str, k: int | None) -> DataFrame:
    """(query, neighbour, similarity) of cells (cell, is_row, key, vector): best k of the rows of each query's cell.

    A cell's queries, a block of bounded size, come first and are held; its rows stream past in products.
    """
    kind = cells.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, asked = None, None, []
        for batch in batches:
            schema = pa.schema([("query", batch.schema.field(2).type), ("neighbour", batch.schema.field(2).type), ("similarity", pa.float64())])
            numbers, is_row = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(numbers)]):
                if numbers[a] != cell:
                    if best is not None:
                        yield best.rows(schema)
                    cell, best, asked = numbers[a], None, []
                part = batch.slice(a, b - a)
                keys, vectors = _keys(part.column(2)), _matrix(part.column(3))
                if not is_row[a]:
                    asked.append((keys, vectors))
                    continue
                if best is None:
                    if not asked:
                        continue
                    best = _Best(*map(np.concatenate, zip(*asked)), k)
                for i in range(0, len(keys), ROWS_PER_PRODUCT):
                    best.add(keys[i : i + ROWS_PER_PRODUCT], vectors[i : i + ROWS_PER_PRODUCT])
                    if k is None:
                        yield best.rows(schema)
        if best is not None:
            yield best.rows(schema)

    dealt = cells.select("cell", "is_row", key, "vector").repartition("cell").sortWithinPartitions("cell", "is_row")
    return dealt.mapInArrow(run, f"query {kind}, neighbour {kind}, similarity double")


def _known(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a vector, floats as they are: products are of doubles, but half as much is sent."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast(kind).alias("vector"))


def _cells(queries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Queries in blocks by hash, rows in stretches by hash: a cell is a block of queries and a stretch of rows.

    There are about two cells for a shuffle partition, so many blocks mean few stretches to send a query to.
    """
    blocks = max(1, math.ceil(queries.count() / QUERIES_PER_BLOCK))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = min(partitions, math.ceil(2 * partitions / blocks))
    block, stretch = F.pmod(F.xxhash64(key), F.lit(blocks)), F.pmod(F.xxhash64(F.lit(7), key), F.lit(stretches))
    asked = queries.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), lambda s: block * stretches + s)).alias("cell"), F.lit(False).alias("is_row"), key, "vector"
    )
    given = rows.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * stretches + stretch)).alias("cell"), F.lit(True).alias("is_row"), key, "vector"
    )
    return asked.unionByName(given)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return first_rows(found, ["query"], [F.desc("similarity"), "neighbour"], k)


def nearest_rows(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """The k nearest rows of every query as (query, neighbour, similarity, rn), exactly.

    Every query is compared with every row, as matrix products of blocks; what is shuffled between them are k rows
    per query and stretch of rows. Queries may be rows as well. Fewer than k rows give fewer neighbours.
    """
    return _ranked(_searched(_cells(_known(queries, key, vector), _known(rows, key, vector), key), key, k), k)


def similarities(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(query, neighbour, similarity) of every query with every row, itself included: for a few anchors."""
    return _searched(_cells(_known(queries, key, vector), _known(rows, key, vector), key), key, None)


# ---- all rows against all rows ----------------------------------------------


def _projected(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Signed distances to the hyperplanes; their signs are the bits of the code."""
    planes = np.random.default_rng(seed).standard_normal((CODE_BITS, vectors.shape[1]))
    return vectors @ planes.T


def _codes(projected: np.ndarray) -> np.ndarray:
    return (projected > 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))


def _probes(projected: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Prefixes of ``bits`` bits in order of the margins that lie between a vector and the bucket, its own first."""
    wide = min(bits, FLIPPED_BITS)
    margins = np.abs(projected[:, :bits])
    lowest = np.argsort(margins, axis=1)[:, :wide]
    masks = (np.arange(1 << wide)[:, None] >> np.arange(wide)) & 1
    cost = np.take_along_axis(margins, lowest, 1) ** 2 @ masks.T
    order = np.argsort(cost, axis=1, kind="stable")[:, :count]
    flips = (np.int64(1) << (bits - 1 - lowest)).astype(np.int64)
    flipped = np.einsum("qpw,qw->qp", masks[order], flips)
    return (_codes(projected) >> (CODE_BITS - bits))[:, None] ^ flipped


def _coded(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, vector, code)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = pa.array(_codes(_projected(_matrix(batch.column(1)), seed)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code], names=[key, "vector", "code"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, "vector")]
    return rows.select(key, "vector").mapInArrow(run, f"{key} {kinds[0]}, vector {kinds[1]}, code bigint")


def _with_probes(coded: DataFrame, key: str, seed: int, bits: int, count: int) -> DataFrame:
    """(key, vector, code, prefix): a row for every bucket to probe."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                probes = _probes(_projected(_matrix(batch.column(1)), seed), bits, count)
                listed = pa.array(probes.tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=[key, "vector", "code", "probes"])

    kinds = [coded.schema[c].dataType.simpleString() for c in (key, "vector")]
    schema = f"{key} {kinds[0]}, vector {kinds[1]}, code bigint, probes array<bigint>"
    return coded.select(key, "vector", "code").mapInArrow(run, schema).select(key, "vector", "code", F.explode("probes").alias("prefix"))


def _extra_bits(coded: DataFrame, bits: int, per_bucket: int) -> DataFrame:
    """(prefix, extra): by how many further bits the buckets with far more rows than meant are divided."""
    counted = coded.groupBy(F.shiftright("code", CODE_BITS - bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    extra = F.least(F.ceil(F.log2(F.col("n") / per_bucket)), F.lit(CODE_BITS - bits)).cast("int")
    return counted.where(F.col("n") > 4 * per_bucket).select("prefix", extra.alias("extra"))


def share_compared(bits: int, probes: int) -> float:
    """Share of all rows that a query meets in buckets of equal size."""
    return probes / (1 << bits)


def rows_sent(nodes: int, bits: int, probes: int) -> float:
    """How often a row is sent: to the buckets it probes, and to the blocks of queries that probe its own bucket."""
    return probes + math.ceil(nodes * probes / (1 << bits) / QUERIES_PER_BLOCK)


def calibrated(coded: DataFrame, key: str, seed: int, k: int, recall: float, per_bucket: int) -> tuple[int, int]:
    """(bits, probes) with which a sample of queries finds its exact neighbours to the recall asked for.

    The sample is the ``SAMPLED_QUERIES`` rows whose hashed keys come first. Buckets of ``per_bucket`` rows are tried
    first, then fewer and larger ones; one bucket finds all. Buckets are made larger still while that sends fewer
    rows and compares little more. The sample and its neighbours reach the driver.
    """
    nodes = max(1, coded.count())
    bits = max(0, math.ceil(math.log2(nodes / per_bucket)))
    if bits == 0:
        return 0, 1
    sample = coded.orderBy(F.xxhash64(F.lit(seed), key), key).limit(SAMPLED_QUERIES)
    near = nearest_rows(sample, coded, key, "vector", k).select("query", F.col("neighbour").alias(key))
    near = near.join(coded.select(key, F.col("code").alias("near_code")), key).collect()
    held = sample.select(key, "vector").collect()
    at = {r[key]: i for i, r in enumerate(held)}
    projected = _projected(_matrix(pa.array([list(r["vector"]) for r in held], pa.list_(pa.float64()))), seed)
    query = np.array([at[r["query"]] for r in near], np.int64)
    codes = np.array([r["near_code"] for r in near], np.int64)
    chosen = None
    while bits > 0 and len(query):
        extra = {r["prefix"]: r["extra"] for r in _extra_bits(coded, bits, per_bucket).join(
            coded.sparkSession.createDataFrame([(int(p),) for p in set((codes >> (CODE_BITS - bits)).tolist())], "prefix bigint"), "prefix"
        ).collect()}
        probes = _probes(projected, bits, 1 << min(bits, FLIPPED_BITS))
        prefix = codes >> (CODE_BITS - bits)
        deep = np.array([extra.get(p, 0) for p in prefix.tolist()])
        mask = (np.int64(1) << deep) - 1
        same = ((codes ^ _codes(projected)[query]) >> (CODE_BITS - bits - deep)) & mask == 0
        hit = probes[query] == prefix[:, None]
        place = np.where(hit.any(1) & same, hit.argmax(1), probes.shape[1])
        reached = np.sort(place)[max(0, math.ceil(min(1.0, recall + 0.02) * len(place)) - 1)]
        if reached < probes.shape[1]:
            found = bits, int(reached) + 1
            if chosen is None:
                most = MORE_COMPARED * share_compared(*found)
            elif share_compared(*found) > most or rows_sent(nodes, *found) >= rows_sent(nodes, *chosen):
                break
            chosen = found
        elif chosen is not None:
            break
        bits -= 1
    return chosen or (0, 1)


def neighbours(
    vectors: DataFrame, key: str, vector: str, k: int = 10, recall: float = 0.9, per_bucket: int = ROWS_PER_BUCKET, seed: int = 42
) -> DataFrame:
    """The k nearest rows of all rows as (query, neighbour, similarity, rn), with the recall asked for.

    Vectors get a code of one bit per random hyperplane. Rows lie in the bucket of their code's first bits; a
    query probes its own bucket and those across the planes it lies closest to, as many as a sample of queries
    needs. Buckets far above the mean are divided by further bits. Equal vectors are one node with its first keys,
    so copies meet in no product. Inside the probed buckets similarities are exact. All queries are searched, in as many
    passes as keep what one pass sends in proportion to the table.
    """
    rows = cut_lineage(_known(vectors, key, vector).withColumn("copies", F.xxhash64("vector")))
    members = first_rows(rows, ["copies", "vector"], [key], k + 1)  # a vector's neighbours need no more of its keys
    nodes = cut_lineage(members.groupBy("copies", "vector").agg(F.min(key).alias(key), F.sort_array(F.collect_list(key)).alias("keys")))
    coded = cut_lineage(_coded(nodes, key, seed))
    bits, count = calibrated(coded, key, seed, k, recall, per_bucket)
    passes = max(1, math.ceil(rows_sent(coded.count(), bits, count) / SENT_AT_ONCE))
    extra = cut_lineage(_extra_bits(coded, bits, per_bucket)) if bits else None

    def cells(queries: DataFrame) -> DataFrame:
        if bits == 0:
            return _cells(queries, coded, key)

        def placed(df: DataFrame) -> DataFrame:
            deep = F.coalesce("extra", F.lit(0))
            rest = F.col("code").bitwiseAND(F.lit((1 << (CODE_BITS - bits)) - 1))
            return df.join(extra, "prefix", "left").withColumn("rest", F.call_function("shiftright", rest, F.lit(CODE_BITS - bits) - deep)).drop("extra")

        asked = placed(_with_probes(queries, key, seed, bits, count))
        given = placed(coded.withColumn("prefix", F.shiftright("code", CODE_BITS - bits)))
        blocks = asked.groupBy("prefix", "rest").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).alias("blocks"))
        asked = asked.join(blocks, ["prefix", "rest"]).select(F.pmod(F.xxhash64(key), "blocks").alias("block"), "prefix", "rest", F.lit(False).alias("is_row"), key, "vector")
        given = given.join(blocks, ["prefix", "rest"]).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "prefix", "rest", F.lit(True).alias("is_row"), key, "vector")
        return asked.unionByName(given).withColumn("cell", F.xxhash64("prefix", "rest", "block"))

    turn = F.pmod(F.xxhash64(F.lit(11), key), F.lit(passes))
    parts = [coded if passes == 1 else coded.where(turn == i) for i in range(passes)]
    found = reduce(DataFrame.unionByName, [cut_lineage(_ranked(_searched(cells(x), key, k), k)) for x in parts])
    # Back from nodes to rows: a row's own copies are neighbours of similarity 1 (0 for zero vectors).
    node_keys = nodes.select(F.col(key).alias("neighbour"), "keys")
    listed = found.join(node_keys, "neighbour").select("query", "similarity", F.explode("keys").alias("neighbour"))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    own = nodes.select(F.col(key).alias("query"), F.when(length > 0, 1.0).otherwise(0.0).alias("similarity"), F.explode("keys").alias("neighbour"))
    best = _ranked(listed.unionByName(own), k + 1)  # the row itself may be one of them
    lists = best.groupBy("query").agg(F.collect_list(F.struct("similarity", "neighbour")).alias("best"))
    # Rows are told from nodes by the vector; a hot vector's rows are split by adaptive execution.
    to_node = nodes.select("copies", "vector", F.col(key).alias("query"))
    each = rows.join(to_node, ["copies", "vector"]).select(F.col(key).alias("row"), "query")
    spread = each.join(lists, "query").select("row", F.inline("best")).where(F.col("row") != F.col("neighbour"))
    return _ranked(spread.withColumnRenamed("row", "query"), k)
