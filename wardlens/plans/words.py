"""Word vectors without a vocabulary on the driver.

Weighted neighbour counts are added up in blocks of word pairs, their positive pointwise mutual information is a
sparse symmetric matrix over blocks of words, and a randomised range finder with power steps finds its leading
eigenvectors block by block. What reaches the driver: matrices of (size + extra) squared numbers and the places of
the ``front`` most frequent words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlens.operators.arrays import (
    add_rows,
    flat,
    give_back,
    giving_back,
    list_column,
    matrix_of,
    pairs_added_up,
    pairs_of,
    pieces_of,
    runs,
    starts_of,
    sums_of_rows,
    weights_of,
)
from wardlens.plans.notes import token_counts, tokens
from wardlens.session import WRITING, cut_lineage, remove_table, settings

#: Tokens of a note dealt as one row; a longer note is several rows that overlap by the window.
CHUNK = 1000
#: Pairs a task adds up before it passes them on.
PAIRS_AT_ONCE = 1 << 24
#: Pairs in all notes for each group of the shuffle that adds them up; equal pairs were added up before.
PAIRS_IN_GROUP = 1 << 23
#: Cells spelled at once inside a task.
STRETCH = 50_000
#: Cells in one row of their table at most.
LISTED = 8192
#: Such rows weighed at once inside a task.
ROWS_WEIGHED = 64
#: Words of a dense block in one row of its table.
PIECE = 256
#: Bytes of a dense block that are multiplied in one pass; more columns are left for further passes.
PASS_BYTES = 1 << 24
DENSE = "block int, at int, data binary"


def vocabulary(notes: DataFrame, min_count: int = 2) -> DataFrame:
    """Words found min_count times or more in all notes, with their number."""
    return token_counts(notes).where(F.col("n") >= min_count)


def _told_apart(notes: DataFrame) -> tuple[int, int]:
    """A seed with which all words of the notes have different hashes, and the number of their tokens."""
    words = cut_lineage(token_counts(notes))
    for seed in count():
        hashed = words.groupBy(_hash("word", seed)).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
        most, total = hashed.agg(F.max("words"), F.sum("n")).first()
        if (most or 0) < 2:
            return seed, total or 0


def _hash(word: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), word)


def _parts(notes: DataFrame, window: int, seed: int, grid: int) -> DataFrame:
    """Pairs added up inside tasks, in one row per batch and pair of hash classes.

    (first, second, word, runs, context, n): each hash of ``word`` stands before so many of the contexts.
    """
    listed = notes.where(F.col("text").isNotNull()).select(F.transform(tokens("text"), lambda w: _hash(w, seed)).alias("ids"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = listed.select("ids", F.explode(begins).alias("at")).select(F.slice("ids", F.col("at") + 1, CHUNK + window).alias("ids"))
    fields = [("first", pa.int32()), ("second", pa.int32()), ("word", pa.list_(pa.int64())), ("runs", pa.list_(pa.int32())),
              ("context", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))]

    def added(held: list[pa.ListArray]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in held])
        lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
        held.clear()
        names, low, high, n = pairs_of(ids, lengths, window, CHUNK)
        del ids
        kind = (names % grid).astype(np.int32)
        group = kind[low] * grid + kind[high]
        order = np.argsort(group, kind="stable")
        edges = starts_of(group := group[order])
        for a, b in zip(edges, [*edges[1:], len(order)]):
            some = order[a:b]
            word = low[some]
            begin = starts_of(word)
            columns = [pa.array([x], pa.int32()) for x in divmod(group[a], grid)]
            values = names[word[begin]], np.diff([*begin, b - a]), names[high[some]], n[some]
            columns += [list_column([x], t.value_type) for x, (_, t) in zip(values, fields[2:])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens_held = [], 0
        step = max(1, PAIRS_AT_ONCE // (4 * window * CHUNK))
        for batch in batches:
            for i in range(0, len(batch), step):
                held.append(batch.column(0).slice(i, step))
                tokens_held += len(held[-1].flatten())
                if tokens_held * window >= PAIRS_AT_ONCE:
                    yield from added(held)
                    tokens_held = 0
        if held:
            yield from added(held)

    schema = "first int, second int, word array<bigint>, runs array<int>, context array<bigint>, n array<int>"
    return chunks.mapInArrow(giving_back(run), schema)


def _for_both(table: DataFrame, kind: str, grid: int) -> DataFrame:
    """Rows of a hash class for every group (first, second) that the class is the first or the second of."""
    others = F.sequence(F.lit(0), F.lit(grid - 1))
    own = F.col(kind).cast("int")
    places = F.concat(
        F.transform(others, lambda o: F.struct(own.alias("first"), o.cast("int").alias("second"), F.lit(False).alias("as_second"))),
        F.transform(others, lambda o: F.struct(o.cast("int").alias("first"), own.alias("second"), F.lit(True).alias("as_second"))),
    )
    return table.select(F.inline(places), *[c for c in table.columns if c != kind])


def _grouped(
    cells: DataFrame, table: DataFrame, kind: str, grid: int,
    found: Callable[[pa.Table, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, fields: list,
) -> DataFrame:
    """Rows that ``found`` makes of the cells of a pair of hash classes and the rows of both classes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        second = right.column("as_second").to_numpy()
        out = pa.Table.from_batches(found(left, right.filter(pa.array(~second)), right.filter(pa.array(second))) if left.num_rows else [], pa.schema(fields))
        give_back()
        return out

    keys = ["first", "second"]
    return cells.groupBy(*keys).cogroup(_for_both(table, kind, grid).groupBy(*keys)).applyInArrow(run, schema)


def neighbour_counts(notes: DataFrame, words: DataFrame, window: int = 5) -> DataFrame:
    """Symmetric (word, context, n) of vocabulary words at most ``window`` tokens apart in a note.

    A pair at distance d weighs window + 1 - d, the mean effect of windows of random width. A word
    beside itself counts in both directions, like any pair. Words outside the vocabulary keep their places.

    Tasks add up the pairs of their notes by hashes under which all words differ; one shuffle of those sums, by the
    hash classes of both words, adds them up and meets the words of both classes.
    """
    seed, total = _told_apart(notes)
    grid = _grid(total, window)
    listed = words.select("word").distinct().select("word", _hash("word", seed).alias("hash"))
    listed = listed.withColumn("kind", F.pmod("hash", F.lit(grid)))
    fields = [("word", pa.string()), ("context", pa.string()), ("n", pa.int64())]

    def spelled(parts: pa.Table, first: pa.Table, second: pa.Table) -> Iterator[pa.RecordBatch]:
        first, second = first.sort_by("hash"), second.sort_by("hash")
        hashes = [x.column("hash").to_numpy() for x in (first, second)]
        names = [x.column("word").combine_chunks() for x in (first, second)]
        a, b, n = pairs_added_up(parts, *hashes)
        for i in range(0, len(n), STRETCH):
            x, y, k = a[i : i + STRETCH], b[i : i + STRETCH], n[i : i + STRETCH]
            same = hashes[0][x] == hashes[1][y]
            left, right = names[0].take(pa.array(x)), names[1].take(pa.array(y))
            other = pa.array(~same)
            yield pa.RecordBatch.from_arrays([left, right, pa.array(np.where(same, 2 * k, k))], schema=pa.schema(fields))
            yield pa.RecordBatch.from_arrays([right.filter(other), left.filter(other), pa.array(k[~same])], schema=pa.schema(fields))

    return _grouped(_parts(notes, window, seed, grid), listed, "kind", grid, spelled, "word string, context string, n bigint", fields)


def _grid(total: int, window: int) -> int:
    """Hash classes of words, so that their pairs are groups of about PAIRS_IN_GROUP pairs."""
    return max(1, int(np.ceil(np.sqrt(total * window / PAIRS_IN_GROUP))))


@dataclass(frozen=True)
class Counted:
    """Neighbour counts of pairs of hash classes, with words as places in their class.

    ``cells`` has rows (first, second, a, b, n) of lists, each pair once; ``places`` has (word, kind, slot, hash).
    """

    cells: DataFrame
    places: DataFrame
    grid: int


def counted(notes: DataFrame, words: DataFrame, window: int = 5) -> Counted:
    """The numbers of :func:`neighbour_counts`, written out once in lists, for steps that read them again."""
    seed, total = _told_apart(notes)
    grid = _grid(total, window)
    listed = words.select("word").distinct().select("word", _hash("word", seed).alias("hash"))
    order = Window.partitionBy("kind").orderBy("hash")
    placed = listed.withColumn("kind", F.pmod("hash", F.lit(grid)).cast("int")).withColumn("slot", F.row_number().over(order) - 1)
    placed = cut_lineage(placed)
    fields = [("first", pa.int32()), ("second", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]

    def listing(parts: pa.Table, first: pa.Table, second: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = [pa.array([parts.column(c)[0].as_py()], pa.int32()) for c in ("first", "second")]
        found = pairs_added_up(parts, *(np.sort(x.column("hash").to_numpy()) for x in (first, second)))
        for i in range(0, len(found[2]), LISTED):
            lists = [list_column([x[i : i + LISTED]], t.value_type) for x, (_, t) in zip(found, fields[2:])]
            yield pa.RecordBatch.from_arrays([*kinds, *lists], schema=pa.schema(fields))

    schema = "first int, second int, a array<int>, b array<int>, n array<bigint>"
    cells = _grouped(_parts(notes, window, seed, grid), placed.select("kind", "hash"), "kind", grid, listing, schema, fields)
    return Counted(cut_lineage(cells), placed, grid)


def _totals(counts: Counted) -> tuple[DataFrame, float]:
    """(kind, slot, word, total) of all words, total being the sum of a word's cells, and the sum of all totals."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n")[i].values.to_numpy()
                for kind, slot in (("first", "a"), ("second", "b")):
                    found = np.bincount(batch.column(slot)[i].values.to_numpy(), n)
                    slots = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(kind)[i].as_py()], pa.int32()), list_column([slots], pa.int32()), list_column([found[slots]], pa.float64())],
                        names=["kind", "slots", "sums"],
                    )

    def added(key: tuple, parts: pa.Table) -> pa.Table:
        slots, found = flat(parts.column("slots")), flat(parts.column("sums"))
        total = np.bincount(slots, found)
        return pa.table({"kind": pa.array(np.full(len(total), key[0].as_py()), pa.int32()), "slot": pa.array(np.arange(len(total)), pa.int32()), "total": total})

    parts = counts.cells.mapInArrow(sums, "kind int, slots array<int>, sums array<double>")
    found = parts.groupBy("kind").applyInArrow(added, "kind int, slot int, total double")
    totals = counts.places.select("kind", "slot", "word").join(found, ["kind", "slot"], "left")
    totals = cut_lineage(totals.withColumn("total", F.coalesce("total", F.lit(0.0))))
    return totals, totals.agg(F.sum("total")).first()[0] or 0.0


def association(counts: DataFrame | Counted) -> DataFrame:
    """Positive pointwise mutual information of (word, context, n); pairs seen no more often than by chance go.

    Lists of counts meet the sums of their words in one shuffle of the lists; a table of counts is joined with them.
    """
    if isinstance(counts, Counted):
        totals, everything = _totals(counts)
        fields = [("word", pa.string()), ("context", pa.string()), ("n", pa.int64()), ("weight", pa.float64())]

        def spelled(cells: pa.Table, first: pa.Table, second: pa.Table) -> Iterator[pa.RecordBatch]:
            first, second = first.sort_by("slot"), second.sort_by("slot")
            names = [x.column("word").combine_chunks() for x in (first, second)]
            sums = [x.column("total").to_numpy() for x in (first, second)]
            for a, b, n, weight, turned in weights_of(cells, *sums, everything, ROWS_WEIGHED):
                for i in range(0, len(n), STRETCH):
                    left, right = names[0].take(pa.array(a[i : i + STRETCH])), names[1].take(pa.array(b[i : i + STRETCH]))
                    words = [right, left] if turned else [left, right]
                    yield pa.RecordBatch.from_arrays([*words, pa.array(n[i : i + STRETCH]), pa.array(weight[i : i + STRETCH])], schema=pa.schema(fields))

        return _grouped(counts.cells, totals, "kind", counts.grid, spelled, "word string, context string, n bigint, weight double", fields)
    counts = cut_lineage(counts)
    sums = cut_lineage(counts.groupBy("word").agg(F.sum("n").alias("total")))
    everything = sums.agg(F.sum("total").cast("double")).scalar()
    joined = counts.join(sums, "word").join(sums.select(F.col("word").alias("context"), F.col("total").alias("context_total")), "context")
    weight = F.log(F.col("n") * everything / F.col("total") / F.col("context_total"))
    return joined.select("word", "context", "n", weight.alias("weight")).where("weight > 0")


def gram(vectors: DataFrame, vector: str) -> DataFrame:
    """Inner products (i, j, x) of the columns of a table of vectors of one length, in Arrow batches."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                rows = np.stack(batch[vector].to_numpy()).astype(float)
                total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            yield _cells(total)

    return _summed(vectors.select(vector).mapInPandas(products, "i int, j int, x double"))


def _cells(matrix: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(matrix.shape)
    return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": matrix.ravel()})


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("i", "j").agg(F.sum("x").alias("x"))


def _collected(cells: DataFrame, width: int) -> np.ndarray:
    """A matrix of width squared numbers on the driver."""
    out = np.zeros((width, width))
    rows = cells.toPandas()
    out[rows["i"].to_numpy(int), rows["j"].to_numpy(int)] = rows["x"].to_numpy(float)
    return out


@dataclass(frozen=True)
class _Dense:
    """A table (block, at, data) of ``stored`` columns, times a small matrix if there is one."""

    table: DataFrame
    stored: int
    matrix: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.stored if self.matrix is None else self.matrix.shape[1]

    def times(self, matrix: np.ndarray) -> _Dense:
        return _Dense(self.table, self.stored, matrix if self.matrix is None else self.matrix @ matrix)

    def columns(self, some: slice = slice(None)) -> Callable[[pa.Scalar, slice], np.ndarray]:
        """What makes some columns of some rows of a stored row."""
        stored, matrix = self.stored, None if self.matrix is None else np.ascontiguousarray(self.matrix[:, some])

        def rows(data: pa.Scalar, which: slice | np.ndarray = slice(None)) -> np.ndarray:
            found = matrix_of(data, stored)[which]
            return found[:, some] if matrix is None else found @ matrix

        return rows


class _Blocks:
    """Sparse symmetric cells and tall dense matrices over the same blocks of ``height`` words.

    A dense matrix is a table (block, at, data), one row of numbers of up to PIECE words from a block's slot ``at``
    on; a missing piece is zero. A word's place is block * height + slot; ``front`` has the places of the words with
    most neighbours, in order.
    Cells (block, part, ahead, slot, other, weight) are lists of pairs of words of the blocks ``block`` and ``part``:
    with ``ahead``, the other is in front and told by its rank among the words in front of its block; else it is told by
    its slot, and neither word is in front.
    """

    def __init__(self, cells: DataFrame, blocks: int, height: int, front: np.ndarray):
        self.cells, self.blocks, self.height, self.front = cells, blocks, height, front

    def random(self, width: int, seed: int) -> _Dense:
        """Normal numbers, written out once: in one task with the product they would take a second Python worker."""
        height = self.height

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    yield from pieces_of(block, np.random.default_rng([seed, block]).standard_normal((height, width)), PIECE)

        spark = self.cells.sparkSession
        drawn = spark.range(self.blocks).select(F.col("id").cast("int").alias("block")).mapInArrow(draw, DENSE)
        return _Dense(cut_lineage(drawn), width)

    def _by_block(self, table: DataFrame, *order: str) -> DataFrame:
        """All rows of a block in one task, in order; so many tasks as there are blocks, or else shuffle partitions."""
        tasks = min(self.blocks, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return table.repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block", *order)

    def times(self, dense: _Dense) -> _Dense:
        """Sparse times dense, in passes over some columns each, so that blocks and what is shuffled at once are bounded."""
        passes = -(-8 * self.height * dense.width // PASS_BYTES)
        edges = [i * dense.width // passes for i in range(passes + 1)]
        found = [self._some_columns(dense, slice(a, b)) for a, b in zip(edges, edges[1:]) if b > a]
        if len(found) == 1:
            return _Dense(found[0], dense.width)
        width = dense.width

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (block, at), rows in runs(batches, 2):
                some = [(edges[i], matrix_of(x, edges[i + 1] - edges[i])) for i, x in zip(rows.column("part").to_pylist(), rows.column("data"))]
                full = np.zeros((len(some[0][1]), width))
                for begin, x in some:
                    full[:, begin : begin + x.shape[1]] = x
                yield from pieces_of(block, full, PIECE, at)

        tables = [x.select("block", "at", F.lit(i).alias("part"), "data") for i, x in enumerate(found)]
        out = cut_lineage(self._by_block(reduce(DataFrame.unionByName, tables), "at").mapInArrow(giving_back(joined), DENSE))
        for x in found:
            remove_table(x)
        return _Dense(out, width)

    def _some_columns(self, dense: _Dense, some: slice) -> DataFrame:
        """Some columns of sparse times dense. A block gets its own rows and those of the words in front, not those of all words.

        What a word takes from words in front is added up in its own block. What other words give, to words in front
        or not, is added up in the giver's block by symmetry, and only those sums go to the block they are for. A task
        holds the rows of one block, its sums, and the cells it has in common with one other block.
        """
        height, front, width, stored, made = self.height, self.front, some.stop - some.start, dense.stored, dense.columns(some)

        def ahead_of(block: int) -> np.ndarray:
            """Slots of the words of a block that are in front."""
            return front[slice(*np.searchsorted(front, [block * height, (block + 1) * height]))] - block * height

        def own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    data = pa.array([made(batch.column("data")[i]).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("block", "at")), data], names=["block", "at", "data"])

        def in_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, at, data in zip(batch.column("block").to_pylist(), batch.column("at").to_pylist(), batch.column("data")):
                    slots = ahead_of(block)
                    a, b = np.searchsorted(slots, [at, at + len(data.as_buffer()) // (8 * stored)])
                    if b > a:
                        picked = made(data, slots[a:b] - at).tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([a], pa.int32()), pa.array([picked], pa.binary())], names=["part", "at", "data"])

        sent = pa.schema([("block", pa.int32()), ("giver", pa.int32()), ("slots", pa.list_(pa.int32())), ("data", pa.binary())])

        def sums(block: int, giver: int, slots: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(slots), PIECE):
                columns = [pa.array([block], pa.int32()), pa.array([giver], pa.int32()), list_column([slots[i : i + PIECE]], pa.int32()), pa.array([rows[i : i + PIECE].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=sent)

        def filled(rows: pa.Table, out: np.ndarray) -> np.ndarray:
            for at, data in zip(rows.column("at").to_pylist(), rows.column("data")):
                if data.is_valid:
                    out[at : at + len(data.as_buffer()) // (8 * width)] = matrix_of(data, width)
            return out

        def listed(rows: pa.Table, ahead: bool) -> tuple[np.ndarray, ...]:
            some = rows.filter(pc.equal(rows.column("ahead"), ahead))
            return tuple(flat(some.column(c)) for c in ("slot", "other", "weight"))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, own, taken, is_ahead = None, np.zeros((height, width)), np.zeros((height, width)), np.zeros(height, bool)

            def ended() -> Iterator[pa.RecordBatch]:
                touched = np.flatnonzero(taken.any(axis=1))
                for i in range(0, len(touched), PIECE):
                    yield from sums(here, here, touched[i : i + PIECE], taken[touched[i : i + PIECE]])

            for (block, part), rows in runs(batches, 2):
                if block != here:
                    yield from ended()
                    here = block
                    for x in (own, taken, is_ahead):
                        x.fill(0)
                    is_ahead[ahead_of(block)] = True
                if part < 0:
                    filled(rows, own)
                    continue
                slots = ahead_of(part)
                slot, other, weight = listed(rows, True)
                to, found = sums_of_rows(slot, other, weight, filled(rows, np.zeros((len(slots), width))))
                add_rows(taken, to, found)
                given = ~is_ahead[slot]
                cells = zip((slots[other[given]], slot[given], weight[given]), (listed(rows, False)[i] for i in (1, 0, 2)))
                to, found = sums_of_rows(*map(np.concatenate, cells), own)
                if part == block:
                    add_rows(taken, to, found)
                else:
                    yield from sums(part, block, to, found)
            yield from ended()

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, total = None, np.zeros((height, width))
            for (block, _), rows in runs(batches, 2):
                if block != here:
                    if here is not None:
                        yield from pieces_of(here, total, PIECE)
                    here = block
                    total.fill(0)
                for slots, data in zip(rows.column("slots"), rows.column("data")):
                    total[slots.values.to_numpy()] += matrix_of(data, width)
            if here is not None:
                yield from pieces_of(here, total, PIECE)

        own = dense.table.mapInArrow(own_rows, DENSE).select("block", F.lit(-1).alias("part"), "at", "data")
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block")
        shared = dense.table.mapInArrow(in_front, "part int, at int, data binary").select(everywhere, "part", "at", "data")
        factors = own.unionByName(shared).unionByName(self.cells, allowMissingColumns=True)
        parts = self._by_block(factors, "part").mapInArrow(giving_back(products), "block int, giver int, slots array<int>, data binary")
        return cut_lineage(self._by_block(parts, "giver").mapInArrow(giving_back(added), DENSE))

    def inner(self, left: _Dense, right: _Dense | None = None) -> np.ndarray:
        """Left transposed times right (left itself, if None), a matrix of width squared numbers."""
        both = left.table if right is None else left.table.join(right.table.withColumnRenamed("data", "other"), ["block", "at"])
        first, second = left.columns(), (left if right is None else right).columns()
        shape, against = (left.width, (left if right is None else right).width), None if right is None else "other"

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for i, data in enumerate(batch.column("data")):
                    a = first(data)
                    total += a.T @ (a if against is None else second(batch.column(against)[i]))
            places = [pa.array(x.ravel(), pa.int32()) for x in np.indices(shape)]
            yield pa.RecordBatch.from_arrays([*places, pa.array(total.ravel())], names=["i", "j", "x"])

        with settings(left.table.sparkSession, WRITING):
            return _collected(_summed(both.mapInArrow(products, "i int, j int, x double")), left.width)

    def orthonormal(self, dense: _Dense) -> _Dense:
        """Orthonormal columns of the same span; whitened twice against rounding."""
        for _ in range(2):
            if dense.width:
                values, vectors = np.linalg.eigh(self.inner(dense))
                kept = values > max(values.max(), 0) * 1e-12
                dense = dense.times(vectors[:, kept] / np.sqrt(values[kept]))
        return dense

    def rows(self, dense: _Dense, size: int) -> DataFrame:
        """One row (block, slot, vector) per word, filled with zeros up to ``size`` numbers."""
        schema, made = pa.schema([("block", pa.int32()), ("slot", pa.int32()), ("vector", pa.list_(pa.float64()))]), dense.columns()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, at, data in zip(batch.column("block").to_pylist(), batch.column("at").to_pylist(), batch.column("data")):
                    numbers = made(data)
                    full = np.zeros((len(numbers), size))
                    full[:, : numbers.shape[1]] = numbers
                    columns = [pa.array(np.full(len(full), block), pa.int32()), pa.array(np.arange(at, at + len(full)), pa.int32()), list_column(list(full), pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return dense.table.mapInArrow(cut, "block int, slot int, vector array<double>")


def _placed_cells(counts: Counted, in_class: int, height: int, front: np.ndarray) -> DataFrame:
    """Positive associations of counted pairs as cells of :class:`_Blocks`; a class of words is ``in_class`` blocks."""
    totals, everything = _totals(counts)
    fields = [("block", pa.int32()), ("part", pa.int32()), ("ahead", pa.bool_()),
              ("slot", pa.list_(pa.int32())), ("other", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))]

    def run(cells: pa.Table, first: pa.Table, second: pa.Table) -> Iterator[pa.RecordBatch]:
        sums = [x.sort_by("slot").column("total").to_numpy() for x in (first, second)]
        classes = [cells.column(c)[0].as_py() for c in ("first", "second")]
        ranks = []
        for kind, total in zip(classes, sums):  # of all words of a class among those in front of their block, or else -1
            rank = np.full(in_class * height, -1, np.int32)
            begin, end = kind * in_class * height, (kind + 1) * in_class * height
            places = front[slice(*np.searchsorted(front, [begin, end]))] - begin
            begins = np.searchsorted(places, np.arange(in_class) * height)
            rank[places] = np.arange(len(places)) - begins[places // height]
            ranks.append(rank)
        for a, b, _, weight, turned in weights_of(cells, *sums, everything, ROWS_WEIGHED):
            (word, word_rank, kind), (context, rank, other_kind) = [(a, ranks[0], classes[0]), (b, ranks[1], classes[1])][:: -1 if turned else 1]
            kept = (rank[context] >= 0) | (word_rank[word] < 0)
            word, context, weight = word[kept], context[kept], weight[kept]
            rank = rank[context]
            (block, slot), (part, other) = np.divmod(word, height), np.divmod(context, height)
            order = np.argsort((block * in_class + part) * 2 + (rank >= 0), kind="stable")
            block, part, slot, rank, other, weight = (x[order] for x in (block, part, slot, rank, other, weight))
            edges = starts_of((block * in_class + part) * 2 + (rank >= 0))
            for i, j in zip(edges, [*edges[1:], len(order)]):
                ahead = bool(rank[i] >= 0)
                told = [slot[i:j], (rank if ahead else other)[i:j], weight[i:j]]
                names = [pa.array([int(kind * in_class + block[i])], pa.int32()), pa.array([int(other_kind * in_class + part[i])], pa.int32()), pa.array([ahead])]
                for k in range(0, j - i, LISTED):
                    lists = [list_column([x[k : k + LISTED]], t.value_type) for x, (_, t) in zip(told, fields[3:])]
                    yield pa.RecordBatch.from_arrays([*names, *lists], schema=pa.schema(fields))

    schema = "block int, part int, ahead boolean, slot array<int>, other array<int>, weight array<double>"
    return cut_lineage(_grouped(counts.cells, totals.drop("word"), "kind", counts.grid, run, schema, fields))


def word_vectors(
    notes: DataFrame, size: int = 100, window: int = 5, min_count: int = 2,
    extra: int = 10, power: int = 2, block_words: int = 32768, seed: int = 42, front: int = 65536,
) -> DataFrame:
    """Vectors (word, n, vector) of all words found ``min_count`` times or more, written to the shared folder.

    The columns of the vectors are orthogonal: eigenvectors of the association matrix times the root of the
    size of their eigenvalue, largest first, up to sign and rounding. A word without any association above chance
    (alone in its notes) has a zero vector, and columns beyond the rank are zero. NULL and empty notes add nothing;
    no notes give no rows. Work memory of a task is bounded by ``block_words`` and by ``front``, the number of most
    frequent words whose rows go to every block, not by the vocabulary; neither changes the result.
    """
    words = cut_lineage(vocabulary(notes, min_count))
    counts = counted(notes, words, window)
    most = (counts.places.agg(F.max("slot")).first()[0] or 0) + 1
    in_class = -(-most // block_words)
    height = -(-most // in_class)
    block = F.col("kind") * in_class + F.floor(F.col("slot") / height).cast("int")
    placed = counts.places.select("word", block.alias("block"), (F.col("slot") % height).alias("slot")).join(words, "word")
    placed = cut_lineage(placed)
    blocks = counts.grid * in_class
    ahead = placed.orderBy(F.desc("n"), "word").limit(front).select((F.col("block").cast("bigint") * height + F.col("slot")).alias("place"))
    ahead = np.sort(ahead.toPandas()["place"].to_numpy(np.int64))
    if not len(ahead):
        return words.select("word", "n", F.array_repeat(F.lit(0.0), size).alias("vector"))
    matrix = _Blocks(_placed_cells(counts, in_class, height, ahead), blocks, height, ahead)

    basis = matrix.random(min(size + extra, blocks * height), seed)
    read = [basis.table]
    for _ in range(1 + power):
        basis = matrix.orthonormal(matrix.times(basis))
        for table in read:
            remove_table(table)
        read = [basis.table]
        if not basis.width:
            break
    if basis.width:
        product = matrix.times(basis)
        values, turn = np.linalg.eigh(matrix.inner(basis, product))
        remove_table(product.table)
        best = np.argsort(-np.abs(values))[:size]
        turn = turn[:, best] * np.sign(turn[np.abs(turn[:, best]).argmax(axis=0), best])
        basis = basis.times(turn * np.sqrt(np.abs(values[best])))
    found = placed.join(matrix.rows(basis, size), ["block", "slot"], "left")
    nothing = F.array_repeat(F.lit(0.0), size)
    vectors = cut_lineage(found.select("word", "n", F.coalesce("vector", nothing).alias("vector")))
    for table in (*read, matrix.cells, counts.cells):
        remove_table(table)
    return vectors
