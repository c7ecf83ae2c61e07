"""Substring dedup: words covered by a run of ``length`` words that also starts in an earlier document go.

Equal windows of ``length`` words have the same anchor, the least hash of the ``GRAM``-word grams in them. A
document is cut into segments, runs of windows with one anchor, and a segment is known by two hashes of 64 bits,
its anchor's and its own. Three steps, all of one narrow row per segment but the second:

1. Equal segments: all but those of the least doc_id are repeats as a whole. A task settles repeats among its own
   rows at once, so a passage that a third of the documents share reaches the shuffle a few times a task only.
2. Anchors with several segments of several documents: their words are cut out of the texts and dealt out by
   anchor. Each task builds FM-indexes over shards of at most ``SHARD_WORDS`` words, cut between anchors, streams
   the segments through backward search, and reports the intervals whose matching statistics reach ``length`` and
   whose matches lie in an earlier document.
3. The intervals are joined to the texts.

An anchor with more than its share of the rows (``HOT_SHARE``) is not used as a key: its windows become segments
of one window under their own hash, so different ones spread and equal ones combine. The list of such anchors
is bounded by the share; it decides where rows go, never results.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; NULL, blank and short texts lose nothing; repeats
within a document do not count, nor do rows of equal doc_id for each other; rows without a doc_id neither lose
words nor take any; equal rows have equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.fm_index import Index
from wardlens.llm.tables import Bounded
from wardlens.session import cut_lineage

GRAM = 6
CHUNK_WORDS = 1 << 18
SHARD_WORDS = 1 << 20
SEEN_SEGMENTS = 400_000  # a task remembers so many to settle repeats at once
CACHED_WORDS = 400_000
HOT_SHARE, HOT_ROWS = 1_000_000, 5_000  # hot: more rows than a HOT_SHARE-th of all, and than HOT_ROWS
LOCALLY_HOT = 8  # of a chunk's rows, to be counted as possibly hot
MAX_WINDOWS = 4095  # in a segment: 12 bits of a place
TIE_BITS, COUNT_BITS = 21, 12
TIE = (1 << TIE_BITS) - 1
COUNT = (1 << COUNT_BITS) - 1
C1, C2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Cutter:
    """Cuts chunks of texts into segments; holds the table of word hashes of a task."""

    def __init__(self, length: int, hot: np.ndarray):
        self.length, self.hot = length, hot
        self.gram = min(GRAM, length)
        self.hashes = Bounded(xxhash.xxh64_intdigest, CACHED_WORDS)
        self.up, self.down = powers(C2, 0), powers(C2, 0)

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of all windows in the texts: text number, start in the text, start in the chunk, anchor; and word hashes."""
        lists = [t.split() for t in texts]  # bytes split at ASCII blanks
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(sizes.sum())
        look = self.hashes.__getitem__
        hashes = np.fromiter((look(w) for words in lists for w in words), np.uint64, total)
        counts = np.maximum(sizes - self.length + 1, 0)
        text = np.repeat(np.arange(len(lists)), counts)
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = inside + np.repeat(starts, counts)
        if not len(at):
            return text, inside, at, hashes[:0], hashes
        grams = np.zeros(total - self.gram + 1, np.uint64)
        for j in range(self.gram):
            grams = grams * np.uint64(C1) + hashes[j : j + len(grams)]
        least, wide, span = mixed(grams), 1, self.length - self.gram + 1
        while wide < span:  # least of `wide` grams, doubled until it spans a window
            step = min(wide, span - wide)
            least = np.minimum(least[: len(least) - step], least[step:])
            wide += step
        return text, inside, at, least[at], hashes

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of all segments: text number, start in the text, number of windows, key, own hash."""
        text, inside, at, anchor, hashes = self.windows(texts)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        opens = np.ones(len(at), bool)
        opens[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        if len(self.hot):
            found = np.searchsorted(self.hot, anchor).clip(max=len(self.hot) - 1)
            single = self.hot[found] == anchor
            opens |= single
        else:
            single = np.zeros(len(at), bool)
        run = np.flatnonzero(opens)
        since = np.arange(len(at)) - run[np.cumsum(opens) - 1]
        first = np.flatnonzero(since % MAX_WINDOWS == 0)
        count = np.diff(np.append(first, len(at)))
        if len(self.up) <= len(hashes):
            self.up, self.down = powers(C2, len(hashes) + 1), powers(pow(C2, -1, 1 << 64), len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mixed(hashes) * self.up[: len(hashes)], out=sums[1:])
        start, words = at[first], count + self.length - 1
        own = mixed((sums[start + words] - sums[start]) * self.down[start] + words.astype(np.uint64) * np.uint64(C1))
        key = np.where(single[first], mixed(own ^ np.uint64(C2)), anchor[first])
        return text[first], inside[first], count, key, own


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_id, tie, texts) of batches (doc_id, tie, text) in pieces of a bounded number of bytes, or one long text."""
    for batch in batches:
        ids, ties, texts, first, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [], 0, 0
        for i, value in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            texts.append(value)
            held += len(value)
            if held >= 6 * CHUNK_WORDS:
                yield ids[first : i + 1], ties[first : i + 1], texts
                texts, first, held = [], i + 1, 0
        if texts:
            yield ids[first:], ties[first:], texts


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def place(start: np.ndarray, count: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """First word, number of windows and tie of a segment in one number."""
    return (start << (TIE_BITS + COUNT_BITS)) | (count << TIE_BITS) | tie


def parts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return places >> (TIE_BITS + COUNT_BITS), (places >> TIE_BITS) & COUNT, places & TIE


def hot_anchors(base: DataFrame, length: int) -> np.ndarray:
    """Anchors with more than their share of the segments, from counts over all texts; few reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(length, np.zeros(0, np.uint64))
        for _, _, texts in chunks(batches):
            key = cutter.segments(texts)[3]
            found, counts = np.unique(key, return_counts=True)
            often = counts >= LOCALLY_HOT
            out = [np.append(found[often], np.uint64(0)), np.append(counts[often], 0), np.append(0 * counts[often], len(key))]
            yield pa.RecordBatch.from_arrays([signed(out[0]), pa.array(out[1]), pa.array(out[2])], names=["key", "n", "total"])

    counted = cut_lineage(
        base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(run, "key bigint, n bigint, total bigint")
        .groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    total = counted.agg(F.sum("total")).first()[0] or 0
    found = counted.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("key").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def segment_rows(base: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """(key, own, doc_id, place) of all segments; ``own`` is NULL where an equal one of a lesser doc_id was seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = Cutter(length, hot), {}
        for ids, ties, texts in chunks(batches):
            text, start, count, key, own = cutter.segments(texts)
            docs = ids[text]
            again = np.zeros(len(text), bool)
            for i, (k, o, d) in enumerate(zip(key.tolist(), own.tolist(), docs.tolist(), strict=True)):
                known = seen.get(o)
                if known is None or known[0] != k or d < known[1]:
                    if len(seen) >= SEEN_SEGMENTS:
                        seen.clear()
                    seen[o] = (k, d)
                elif d > known[1]:
                    again[i] = True
            spread = np.where(again, mixed(key ^ docs.astype(np.uint64)), key)
            yield pa.RecordBatch.from_arrays(
                [
                    signed(spread),
                    pa.array(own.view(np.int64), mask=again),
                    pa.array(docs),
                    pa.array(place(start, count, ties[text])),
                ],
                names=["key", "own", "doc_id", "place"],
            )

    known = base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.mapInArrow(run, "key bigint, own bigint, doc_id bigint, place bigint")


def judged(key: np.ndarray, own: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole keys in order of (key, own, doc): which rows are repeats, and which need the index."""
    opens_key, opens_own = np.ones(len(key), bool), np.ones(len(key), bool)
    opens_key[1:] = key[1:] != key[:-1]
    opens_own[1:] = opens_key[1:] | (own[1:] != own[:-1])
    owner = doc[np.flatnonzero(opens_own)][np.cumsum(opens_own) - 1]
    first = np.flatnonzero(opens_key)
    group = np.cumsum(opens_key) - 1
    several = np.add.reduceat(opens_own.astype(np.int64), first) > 1
    apart = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    return doc > owner, (doc == owner) & (several & apart)[group]


def marks(rows: DataFrame) -> DataFrame:
    """(doc_id, place, key): segments that are repeats (key NULL) or whose windows must be looked up (by key)."""

    def told(key, own, doc, places) -> pa.RecordBatch:
        repeat, asked = judged(key, own, doc)
        kept = repeat | asked
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[kept]), pa.array(places[kept]), pa.array(key[kept], mask=repeat[kept])], names=["doc_id", "place", "key"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            if not known.all():
                again = batch.filter(pa.array(~known))
                nothing = pa.nulls(again.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([again.column(2), again.column(3), nothing], names=["doc_id", "place", "key"])
                batch = batch.filter(pa.array(known))
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(4)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # where the last key of the batch starts
            if held and (last > 0 or held[0][0][0] != columns[0][0]):
                if held[0][0][0] == columns[0][0]:
                    yield told(*[np.concatenate([*h, c[:last]]) for h, c in zip(zip(*held), columns)])
                else:
                    yield told(*map(np.concatenate, zip(*held)))
                    if last > 0:
                        yield told(*[c[:last] for c in columns])
                held = []
            elif last > 0:
                yield told(*[c[:last] for c in columns])
            held.append([c[last:] for c in columns])
        if held:
            yield told(*map(np.concatenate, zip(*held)))

    dealt = rows.repartition("key").sortWithinPartitions("key", "own", "doc_id", "place")
    return dealt.mapInArrow(run, "doc_id bigint, place bigint, key bigint")


def cut_words(rows: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, place, words) of texts (doc_id, tie, text, asked), a list of struct(place, key) or NULL."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tie, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not asked:
                    continue
                split, keys, places, words = text.encode().split(), [], [], []
                for w in asked:
                    start, count, of = parts(w["place"])
                    if of == tie:
                        keys.append(w["key"])
                        places.append(w["place"])
                        words.append(b" ".join(split[start : start + count + length - 1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([doc] * len(keys), pa.int64()), pa.array(places, pa.int64()), pa.array(words, pa.binary())],
                    names=["key", "doc_id", "place", "words"],
                )

    return rows.mapInArrow(run, "key bigint, doc_id bigint, place bigint, words binary")


def found_in_shard(docs: np.ndarray, places: np.ndarray, words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, place) of the runs of windows that start in a document of the shard with a lesser doc_id."""
    numbers: dict[bytes, int] = {}
    pieces = [[numbers.setdefault(w, len(numbers) + 1) for w in piece.split()] + [0] for piece in words]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.fromiter((x for piece in pieces for x in piece), np.int64, int(sizes.sum()))
    index = Index(text, length)
    starts, counts, ties = parts(places)
    segment = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.repeat(np.cumsum(sizes) - sizes, counts) + inside + length - 1
    matched, low, high = index.matching(text, ends, length)
    whole = np.flatnonzero(matched == length)
    if not len(whole):
        return docs[:0], places[:0]
    doc_of = np.append(np.repeat(docs, sizes)[index.order], np.iinfo(np.int64).max)
    spans, which = np.unique(low[whole], return_inverse=True)
    tops = np.zeros(len(spans), np.int64)
    tops[which] = high[whole]
    least = np.minimum.reduceat(doc_of, np.stack([spans, tops], 1).ravel())[::2]
    hit = whole[least[which] < docs[segment[whole]]]
    if not len(hit):
        return docs[:0], places[:0]
    opens = np.ones(len(hit), bool)
    opens[1:] = (np.diff(hit) > 1) | (np.diff(segment[hit]) > 0)
    first = hit[opens]
    run = np.diff(np.append(np.flatnonzero(opens), len(hit)))
    of = segment[first]
    return docs[of], place(starts[of] + inside[first], run, ties[of])


def matches(pieces: DataFrame, length: int) -> DataFrame:
    """(doc_id, place) of the windows in cut-out words (key, doc_id, place, words) with an equal one in an earlier document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            doc, at = found_in_shard(np.array(docs, np.int64), np.array(places, np.int64), words, length)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], names=["doc_id", "place"])

        docs, places, words, held, last = [], [], [], 0, None
        for batch in batches:
            for key, doc, at, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held >= SHARD_WORDS and key != last:
                    yield found()
                    docs, places, words, held = [], [], [], 0
                docs.append(doc)
                places.append(at)
                words.append(piece)
                held += (at >> TIE_BITS & COUNT) + length - 1
                last = key
        if docs:
            yield found()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id bigint, place bigint")


def repeated_runs(base: DataFrame, length: int) -> DataFrame:
    """(doc_id, place): runs of windows of texts (doc_id, tie, text) that also start in an earlier document."""
    marked = cut_lineage(marks(segment_rows(base, length, hot_anchors(base, length))))
    asked = marked.where(F.col("key").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("place", "key")).alias("asked"))
    pieces = cut_words(base.join(asked, "doc_id", "left").select("doc_id", "tie", "text", "asked"), length)
    return marked.where(F.col("key").isNull()).select("doc_id", "place").unionByName(matches(pieces, length))


def without_repeats(docs: DataFrame, length: int = 13, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every document.

    ``spans`` are the removed stretches as struct(start, words), ascending; ``kept`` is the other words joined by
    one space.
    """
    tie = F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(TIE)
    base = docs.select("doc_id", F.col(text).alias("text")).select("doc_id", tie.alias("tie"), "text")
    found = repeated_runs(base, length).groupBy("doc_id").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for tie, value, places in rows:
                words = (value or "").encode().split()
                start, count, of = parts(np.array(places or [], np.int64))
                start, count = start[of == tie], count[of == tie]
                turns = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + count + length - 1, minlength=len(words) + 1)
                gone = np.cumsum(turns)[: len(words)] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": a, "words": b - a} for a, b in edges.reshape(-1, 2).tolist()])
                left = words if not len(edges) else [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    rows = base.join(found, "doc_id", "left").select("doc_id", "tie", "text", "places")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,words:bigint>>, kept string"
    return rows.mapInArrow(run, schema)
