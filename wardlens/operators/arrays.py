"""Arrow lists and numpy rows inside tasks. A Python worker loads this module, not the plans and what they need."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Cells multiplied at once, so that their rows stay in a processor's cache.
MULTIPLIED = 512


def give_back() -> None:
    """Give freed memory back to the system, where it can be: a Python worker is kept for later tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def giving_back(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives back its memory at its end."""

    def ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return ended


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a list column in one array."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def sums_of_rows(to: np.ndarray, of: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct targets in order, and for each the sum of weight times row over its cells."""
    order = np.argsort(to, kind="stable")
    to, of, weights = to[order], of[order], weights[order]
    begins = starts_of(to)
    places = np.cumsum(np.bincount(begins, minlength=len(to))) - 1 if len(to) else begins
    out = np.zeros((len(begins), rows.shape[1]))
    for i in range(0, len(to), MULTIPLIED):
        at = places[i : i + MULTIPLIED]
        starts = starts_of(at)
        products = rows[of[i : i + MULTIPLIED]]
        products *= weights[i : i + MULTIPLIED, None]
        out[at[starts]] += np.add.reduceat(products, starts, axis=0)
    return to[begins], out


def runs(batches: Iterable[pa.RecordBatch], keys: int, parts: bool = False) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Rows that follow each other with the same numbers in the first columns; with ``parts``, as much of them as is in a batch."""
    key, held = None, []
    for batch in batches:
        if batch.num_rows:
            codes = np.stack([batch.column(i).to_numpy() for i in range(keys)])
            edges = np.flatnonzero((np.diff(codes) != 0).any(axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                here = tuple(codes[:, a].tolist())
                if held and (parts or here != key):
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = here
                held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def matrix_of(data: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer()).reshape(-1, width)


def add_rows(total: np.ndarray, to: np.ndarray, rows: np.ndarray) -> None:
    """Add rows at distinct places, without copies of all of them."""
    for i in range(0, len(to), MULTIPLIED):
        total[to[i : i + MULTIPLIED]] += rows[i : i + MULTIPLIED]


def pairs_of(ids: np.ndarray, lengths: np.ndarray, window: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, and (low, high, n) of the pairs in chunks of tokens as places in them, in order."""
    names, codes = np.unique(ids, return_inverse=True)
    at = (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    room = np.repeat(lengths, lengths).astype(np.int32) - at
    bits = window.bit_length()
    there = [(at < chunk) & (room > d) for d in range(1, window + 1)]
    keys, filled = np.empty(sum(map(np.count_nonzero, there)), np.int64), 0
    for d, mask in enumerate(there, 1):
        here = np.flatnonzero(mask)
        a, b = codes[here], codes[here + d]
        keys[filled : filled + len(here)] = ((np.minimum(a, b) * len(names) + np.maximum(a, b)) << bits) | (window + 1 - d)
        filled += len(here)
    del codes, at, room, there
    keys.sort()
    weights = (keys & ((1 << bits) - 1)).astype(np.int32)
    keys >>= bits
    starts = starts_of(keys)
    n = np.add.reduceat(weights, starts) if len(starts) else weights
    del weights
    keys = keys[starts]
    low = keys // max(1, len(names))
    keys -= low * len(names)
    return names, low.astype(np.int32), keys.astype(np.int32), n


def pairs_added_up(parts: pa.Table, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) of the pairs of known words, as places in two ordered lists of hashes."""

    def places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, hashes).clip(max=len(known) - 1)
        return np.where(known[at] == hashes, at, -1)

    if not len(first) or not len(second):
        return (np.zeros(0, np.int64),) * 3
    a = np.repeat(places(first, flat(parts.column("word"))), flat(parts.column("runs")))
    b, n = places(second, flat(parts.column("context"))), flat(parts.column("n"))
    kept = (a >= 0) & (b >= 0)
    key, n = a[kept] * len(second) + b[kept], n[kept].astype(np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    starts = starts_of(key)
    return *np.divmod(key[starts], len(second)), np.add.reduceat(n, starts) if len(starts) else n


def weights_of(cells: pa.Table, first: np.ndarray, second: np.ndarray, everything: float, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(a, b, n, weight, turned) of both directions of the cells with a positive weight, a pair of equal words once.

    So many rows of lists are weighed at once.
    """
    one_class = cells.column("first")[0] == cells.column("second")[0]
    for i in range(0, cells.num_rows, step):
        a, b, n = (flat(cells.column(c).slice(i, step)) for c in ("a", "b", "n"))
        same = (a == b) if one_class else np.zeros(len(a), bool)
        n = np.where(same, 2 * n, n)
        for turned in (False, True):
            total, other = (second[b], first[a]) if turned else (first[a], second[b])
            weight = np.log(n * everything / total / other)
            kept = (weight > 0) & ~(same & turned)
            yield a[kept], b[kept], n[kept], weight[kept], turned


def pieces_of(block: int, rows: np.ndarray, piece: int, begin: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of a dense table, from a slot on."""
    for at in range(0, len(rows), piece):
        columns = [pa.array([x], pa.int32()) for x in (block, begin + at)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([rows[at : at + piece].tobytes()], pa.binary())], names=["block", "at", "data"])
