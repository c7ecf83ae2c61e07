"""N-gram Jaccard join on prefix trees.

A document is the set of its distinct word n-grams; two documents link when their Jaccard similarity is at
least ``percent`` / 100. Documents with equal sets are one node. Sets are ordered by one global order, from
rare to common n-grams (counts of all documents in a table of fixed size; equal counts by hash).

1. Index. Linked sets share an n-gram among the first ``n - ceil(t * n) + 1`` of each. Every node is listed under
   about twice as many, so that linked sets share ``n - ceil(t * n) + 1`` lists at least, about half of a node's,
   and more if they are of like size. A node that shares fewer lists with all others leaves before anything else
   is done; the lists are then divided by set size, and a node with fewer than any set in a list asks for
   leaves it. So what goes on follows the near copies, not how many n-grams unrelated texts share by chance,
   which grows with the corpus.
2. Star. Each list takes a hub, the node that is in most lists, and all others are compared with it: a block of sets is
   stored as a trie (paths from common to rare n-grams, in sorted order with the depth each shares with the
   path before), the hub's overlap is carried along shared paths, and a subtree is left as soon as the
   n-grams that remain cannot reach the wanted overlap.
3. Rest. Two nodes of a list that both link to its hub are connected already. If x does not link to hub h
   but to y, the differences of x and y from h have an element in common, more than half of those of y
   even. So where the members of a list are of several components, and share lists enough to link, they
   are listed under a prefix of their differences, and an x that did not link to the hub is compared with
   the nodes of other components in its lists, as far as the sizes of the differences and the places of
   the shared element leave room for the elements that must be in common.

No link between components is lost, and a large group of copies or near copies costs a comparison with few
hubs per member instead of one per pair. Members are compared in blocks of bounded size.

Defined results: texts without a word (NULL, empty, blank) have an empty set and link with nothing; texts of
fewer words than an n-gram have one, the whole sequence. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.session import cut_lineage

CELL_BITS, BLOCK_BITS, MARK_BITS = 18, 14, 20
#: Shingles of the sets that a task compares with one hub at a time.
BLOCK_SHINGLES = 400_000
MEMBERS = 1 << 20


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z lower-cased, blanks are \\x20 and \\x09-\\x0D."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    mixed = words[: len(words) - size + 1].copy()
    for j in range(1, size):
        mixed = _mix(mixed) + words[j : len(words) - size + 1 + j]
    return np.unique(_mix(mixed))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_of(hashes: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


class Overlap:
    """Bounds for similarity of at least percent / 100."""

    def __init__(self, percent: int):
        self.t = Fraction(percent, 100)

    def listed(self, n: int) -> int:
        """Under how many of its first n-grams a set of n is listed; ``_unlisted`` says the same of columns."""
        return min(n, 2 * (n - ceil(self.t * n)) + 1)

    def wanted(self, a: int, b: int) -> int:
        """Least common elements of linked sets of sizes a and b."""
        return ceil(self.t * (a + b) / (1 + self.t))

    def difference_prefix(self, size: int, own: int, hub: int, linked: bool) -> int:
        """How many elements of a difference of this size must be listed (see step 3)."""
        apart = (1 - self.t) / (1 + self.t)
        # What two linked sets differ in is all that their differences from the hub need not share.
        least = ceil(size - apart * (own + own / self.t))
        if linked:
            # The other set did not link to the hub, so it is nearer to this one than to the hub.
            least = max(least, floor((size - apart * max(0, own - hub)) / 2) + 1)
        return size - max(1, least) + 1


def scan(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(key, n, node) of every document, and the n-gram counts of all documents by the leading hash bits."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            n, nodes = [], []
            for value in batch.column(1).to_pylist():
                hashes = shingles(value, size)
                np.add.at(cells, (hashes >> np.uint64(64 - CELL_BITS)).astype(np.intp), 1)
                n.append(len(hashes))
                nodes.append(node_of(hashes) if len(hashes) else None)
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.float64()))],
                names=["key", "n", "node", "block", "counts"],
            )
        for b, counts in enumerate(cells.reshape(-1, 1 << BLOCK_BITS)):
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.nulls(1, batch_key),
                    "n": pa.nulls(1, pa.int64()),
                    "node": pa.nulls(1, pa.int64()),
                    "block": pa.array([b], pa.int32()),
                    "counts": pa.array([counts.astype(float).tolist()], pa.list_(pa.float64())),
                }
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batch_key = to_arrow_type(docs.schema[key].dataType)
    found = cut_lineage(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
            run, f"key {key_type}, n bigint, node bigint, block int, counts array<double>"
        )
    )
    sums = (
        found.where("block IS NOT NULL")
        .groupBy("block")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts"))
        .collect()
    )
    cells = np.zeros(1 << CELL_BITS, np.int64)
    for row in sums:
        cells[row["block"] << BLOCK_BITS : (row["block"] + 1) << BLOCK_BITS] = np.array(row["counts"], np.int64)
    return found.where("block IS NULL").select("key", "n", "node"), cells


def rare_first(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return hashes[np.lexsort((hashes, cells[hashes >> np.uint64(64 - CELL_BITS)]))]


def prefixes(docs: DataFrame, size: int, percent: int, cells, text: str = "text") -> DataFrame:
    """Lists of step 1 as rows (gid, node); a node's equal sets are listed once per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bounds, seen = cells.value, Overlap(percent), set()
        for batch in batches:
            nodes, tokens = [], []
            for value in batch.column(0).to_pylist():
                hashes = shingles(value, size)
                if not len(hashes) or (node := node_of(hashes)) in seen:
                    continue
                if len(seen) < MEMBERS:
                    seen.add(node)
                tokens.append(rare_first(hashes, counts)[: bounds.listed(len(hashes))])
                nodes.append(node)
            if nodes:
                gid = np.concatenate(tokens).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gid), pa.array(np.repeat(np.array(nodes, np.int64), [len(t) for t in tokens]))], names=["gid", "node"]
                )

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "gid bigint, node bigint")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, cells, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, n, path) of the documents whose keys are wanted, and of a few others; path: common to rare n-grams.

    The wanted keys are met through a bitmap of fixed size, so texts that take no part are not shuffled.
    """
    spark = docs.sparkSession
    cell = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << MARK_BITS))
    bits = np.zeros(1 << MARK_BITS, bool)
    bits[wanted.select(cell.alias("c")).distinct().toArrow().column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = cells.value, set()
        marked = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            rows = []
            picked = batch.filter(pa.array(marked[batch.column(0).to_numpy(zero_copy_only=False)]))
            for value in picked.column(1).to_pylist():
                hashes = shingles(value, size)
                if not len(hashes) or (node := node_of(hashes)) in seen:
                    continue
                if len(seen) < MEMBERS:
                    seen.add(node)
                rows.append((node, len(hashes), rare_first(hashes, counts)[::-1].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["node", "n", "path"],
                )

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select(cell.alias("cell"), "text")
    return picked.mapInArrow(run, "node bigint, n bigint, path binary")


def trie_search(hub: np.ndarray, paths: list[np.ndarray], bounds: Overlap) -> list[bool]:
    """Which paths link to the hub. The paths are the leaves of a trie, visited in sorted order."""
    order = sorted(range(len(paths)), key=lambda i: paths[i].tolist()) if len(paths) > 1 else range(len(paths))
    sorted_hub, linked = np.sort(hub), [False] * len(paths)
    overlap, last = np.zeros(1, np.int64), np.empty(0, np.uint64)
    for i in order:
        path = paths[i]
        m = min(len(last), len(path), len(overlap) - 1)
        differ = np.flatnonzero(last[:m] != path[:m])
        depth = int(differ[0]) if len(differ) else m
        wanted = bounds.wanted(len(hub), len(path))
        if overlap[depth] + min(len(path) - depth, len(hub) - overlap[depth]) < wanted:
            overlap, last = overlap[: depth + 1], path[:depth]
            continue
        rest = path[depth:]
        at = np.minimum(np.searchsorted(sorted_hub, rest), len(hub) - 1)
        overlap = np.concatenate([overlap[: depth + 1], overlap[depth] + np.cumsum(sorted_hub[at] == rest)])
        last = path
        linked[i] = bool(overlap[-1] >= wanted)
    return linked


def _blocks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (hub, block, member, node, n, path), dealt out and sorted so that a hub precedes its members."""
    dealt = (
        pairs.join(sets.select("node", "n"), "node")
        .groupBy("hub")
        .agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    )
    extra = [c for c in pairs.columns if c == "linked"]
    members = pairs.join(dealt, "hub").select(
        "hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("member"), "node", *extra
    )
    hubs = dealt.select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("member"), F.col("hub").alias("node")
    )
    rows = members.unionByName(hubs, allowMissingColumns=True).join(sets, "node")
    rows = rows.select("hub", "block", "member", "node", "n", "path", *extra)
    return rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "member", "node")


def _per_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[dict]]]:
    key, hub, members = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["hub"], row["block"]) != key:
                if members:
                    yield key[0], hub, members
                key, members = (row["hub"], row["block"]), []
            row["path"] = np.frombuffer(row["path"], np.uint64)
            if row["member"]:
                members.append(row)
            else:
                hub = row["path"]
    if members:
        yield key[0], hub, members


def star(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, node) with ``linked`` (step 2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Overlap(percent)
        for name, hub, members in _per_block(batches):
            found = trie_search(hub, [m["path"] for m in members], bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.int64()), pa.array([m["node"] for m in members], pa.int64()), pa.array(found, pa.bool_())],
                names=["hub", "node", "linked"],
            )

    return _blocks(pairs, sets).mapInArrow(run, "hub bigint, node bigint, linked boolean")


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Lists of step 3 for pairs (hub, node, linked), as rows (gid, node, at, d, n, linked): place in a
    difference of d elements, of a set of n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Overlap(percent)
        for name, hub, members in _per_block(batches):
            salt = _mix(np.array([name], np.int64).view(np.uint64))
            nodes, gids, facts = [], [], []
            for m in members:
                # Elements of the node alone come first, from rare to common, then those of the hub alone.
                own = m["path"][~np.isin(m["path"], hub)][::-1]
                gone = hub[~np.isin(hub, m["path"])][::-1]
                apart = np.concatenate([own, gone])
                size = len(apart)
                apart = apart[: bounds.difference_prefix(size, m["n"], len(hub), m["linked"])]
                gids.append(_mix(apart ^ salt).view(np.int64))
                nodes.append(np.full(len(apart), m["node"], np.int64))
                facts.append(np.column_stack([np.arange(len(apart)), np.full(len(apart), size), np.full(len(apart), m["n"]), np.full(len(apart), m["linked"])]))
            at, d, n, linked = np.concatenate(facts).astype(np.int32).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(gids)), pa.array(np.concatenate(nodes)), *map(pa.array, (at, d, n)), pa.array(linked.astype(bool))],
                names=["gid", "node", "at", "d", "n", "linked"],
            )

    return _blocks(pairs, sets).mapInArrow(run, "gid bigint, node bigint, at int, d int, n int, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b); a component is named by its least node.

    Each round a node takes the least name among its neighbours' and then the name of that name.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = names.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = names.select(F.col("node").alias("next"), F.col("component").alias("far"))
        stepped = cut_lineage(lower.join(jump, "next").select("node", "old", F.least("next", "far").alias("component")))
        changed = stepped.where("component <> old").limit(1).count()
        names = stepped.select("node", "component")
        if not changed:
            return names


def _shared(lists: DataFrame) -> DataFrame:
    """The rows of lists with at least two nodes, with the list's hub (largest ``rank``, then node); one shuffle."""
    dealt = lists.repartition("gid")
    ends = dealt.groupBy("gid").agg(
        F.min("node").alias("least"),
        F.max("node").alias("last"),
        F.max(F.struct("rank", "node"))["node"].alias("hub"),
        (F.count(F.lit(1)) > 2).alias("wide"),
    )
    return dealt.join(ends.where("least < last").select("gid", "hub", "wide"), "gid")


def _by_size(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Lists divided by classes of set sizes, as rows (gid, c, node, n, rank); linked sets have a class in
    common, and in that class all the lists that they share.

    The rank of a node is the number of its lists: of copies with edits of their own, the text that they
    were made from shares most.
    """
    step = log(100 / percent) * 1.001 if percent < 100 else 1e-6
    own = F.floor(F.log("n") / step)
    ranked = nodes.join(shared.groupBy("node").agg(F.count(F.lit(1)).alias("rank")), "node")
    n = F.col("n")
    facts = ranked.where(F.col("rank") >= _least_of_sizes(n, *_like_sizes(n, percent), percent)).select("node", "n", "rank", own.alias("own"))
    return (
        shared.select("gid", "node")
        .join(facts, "node")
        .select("gid", "node", "n", "rank", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("c"))
        .select(F.xxhash64("gid", "c").alias("gid"), "c", "node", "n", "rank")
    )


def _least_shared(n: Column, other: Column, percent: int) -> Column:
    """How many lists linked sets of these sizes share at least.

    Common n-grams that a set is not listed under are its last, in one order for all, so of the sets' common
    n-grams no more are missing than the larger number that one of them is not listed under.
    """
    wanted = F.ceil((n + other) * percent / F.lit(100 + percent) - 1e-9)
    return wanted - F.greatest(_unlisted(n, percent), _unlisted(other, percent))


def _unlisted(n: Column, percent: int) -> Column:
    """How many n-grams of a set of n it is not listed under."""
    return F.greatest(F.lit(0), 2 * F.ceil(n * percent / F.lit(100) - 1e-9) - n - 1)


def _like_sizes(n: Column, percent: int) -> tuple[Column, Column]:
    """Least and largest size of the sets that a set of n can link with."""
    return F.ceil(n * percent / F.lit(100) - 1e-9), F.floor(n * 100 / F.lit(percent) + 1e-9)


def _least_of_sizes(n: Column, smallest: Column, largest: Column, percent: int) -> Column:
    """The least of ``_least_shared`` over all sizes of a range.

    Without roundings, which are worth two, it is concave in the other size, so its least is at an end.
    """

    def unrounded(other: Column) -> Column:
        gone = F.greatest(n, other) * F.lit((2 * percent - 100) / 100) - 1
        return (n + other) * F.lit(percent / (100 + percent)) - F.greatest(F.lit(0.0), gone)

    return F.greatest(F.lit(1), F.ceil(F.least(unrounded(smallest), unrounded(largest)) - 2 - 1e-6))


def _viable(lists: DataFrame, percent: int) -> DataFrame:
    """Without the rows whose node shares too few lists to link with any set of the sizes in that list."""
    dealt = lists.repartition("gid")
    ends = dealt.groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("node").alias("a"), F.max("node").alias("b"))
    several = dealt.join(ends.where("a < b").drop("a", "b"), "gid")
    counted = several.groupBy("node", "c").agg(F.count(F.lit(1)).alias("lists"))
    n = F.col("n")
    smallest, largest = _like_sizes(n, percent)
    least = _least_of_sizes(n, F.greatest("lo", smallest), F.least("hi", largest), percent)
    return several.join(counted, ["node", "c"]).where(F.col("lists") >= least).select(*lists.columns)


def _able_to_link(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct (hub, node) of the lists, and whether any has a third node; without those that cannot link: their lists are theirs alone, and too few.

    What two nodes share is at most the lists of the two alone and the wide lists that either is in.
    """
    sizes = nodes.select("node", "n")
    wide = shared.where("wide").groupBy("node", "c").agg(F.count(F.lit(1)).alias("w"))
    both = shared.where("node <> hub").groupBy("hub", "node", "c").agg(F.count(F.lit(1)).alias("lists"), F.max("wide").alias("wide"))
    both = both.join(wide, ["node", "c"], "left")
    both = both.join(wide.select(F.col("node").alias("hub"), "c", F.col("w").alias("hub_w")), ["hub", "c"], "left")
    both = both.join(sizes, "node").join(sizes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")), "hub")
    upto = F.col("lists") + F.least(F.coalesce("w", F.lit(0)), F.coalesce("hub_w", F.lit(0)))
    like = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    able = F.col("wide") | (like & (upto >= _least_shared(F.col("n"), F.col("hub_n"), percent)))
    return both.where(able).groupBy("hub", "node").agg(F.max("wide").alias("wide"))


def _across(listed: DataFrame, tried: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 3: the pairs (hub, node) of different components that may still link.

    Two nodes that were not compared share only lists of which neither is the hub, so only such lists with
    nodes of several components count.
    """
    component = named.select("node", F.col("component").alias("p"))
    members = listed.where("wide AND node <> hub").join(component, "node", "left").withColumn("p", F.coalesce("p", "node"))
    several = members.groupBy("gid").agg(F.min("p").alias("least"), F.max("p").alias("last")).where("least < last").select("gid")
    left = _viable(members.join(several, "gid", "left_semi"), percent)
    open_stars = cut_lineage(tried.join(left.select("hub", "node").distinct(), ["hub", "node"]).select("hub", "node", "linked"))
    component = component.withColumnRenamed("p", "c")
    lists = cut_lineage(differences(open_stars, sets, percent)).join(component, "node", "left").withColumn("c", F.coalesce("c", "node"))
    dealt = lists.repartition("gid")
    mixed = dealt.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("gid")
    lists = cut_lineage(dealt.join(mixed, "gid", "left_semi"))
    x = lists.where("NOT linked").select("gid", F.struct("node", "c", "at", "d", "n").alias("x"))
    y = lists.select("gid", F.struct("node", "c", "at", "d", "n", "linked").alias("y"))
    # Linked sets of sizes n differ in (1-t)/(1+t) * (n + n) elements at most: so many must be in common.
    least = F.expr(f"ceil((x.d + y.d - {(100 - percent) / (100 + percent)!r}D * (x.n + y.n)) / 2 - 1e-6D)")
    may_link = (F.col("x.at") <= F.col("x.d") - least) & (F.col("y.at") <= F.col("y.d") - least)
    apart = F.expr("x.c <> y.c AND (y.linked OR x.node < y.node)")
    return x.join(y, "gid").where(apart & may_link).select(F.col("x.node").alias("hub"), F.col("y.node").alias("node")).distinct()


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the least ``doc_id`` of their component, with their columns.

    Rows with the same doc_id are one document and stay or go together.
    """
    found = similar_documents(docs, size, percent)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, node, component_id) of every document.

    ``node`` names the document's set (NULL when empty); ``component_id`` is the least key that links reach
    from the document, itself included.
    """
    spark: SparkSession = docs.sparkSession
    scanned, counted = scan(docs, size, key, text)
    cells = spark.sparkContext.broadcast(counted.astype(np.uint32))
    nodes = cut_lineage(scanned.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n")))
    lists = prefixes(docs, size, percent, cells, text).withColumn("rank", F.lit(0))
    shared = cut_lineage(_shared(lists).select("gid", "node").distinct())
    classed = cut_lineage(_viable(_by_size(shared, nodes, percent), percent))
    listed = cut_lineage(_shared(classed))
    pairs = cut_lineage(_able_to_link(listed, nodes, percent))
    taking_part = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    wanted = taking_part.join(nodes, "node").select("key")
    sets = sets_of(docs, wanted, size, cells, key, text).join(taking_part, "node", "left_semi").dropDuplicates(["node"])
    sets = cut_lineage(sets)
    named = None
    if not pairs.isEmpty():
        tried = cut_lineage(star(pairs.select("hub", "node"), sets, percent))
        links = tried.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        named = components(links)
        rest = cut_lineage(_across(listed, tried, named, sets, percent))
        if not rest.isEmpty():
            found = star(rest, sets, percent).where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
            named = components(cut_lineage(links.unionByName(found)))
    if named is None:
        placed = nodes.select("node", F.col("key").alias("component_id"))
    else:
        of_nodes = nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = of_nodes.groupBy("component").agg(F.min("key").alias("component_id"))
        placed = of_nodes.join(least, "component").select("node", "component_id")
    return scanned.join(placed, "node", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "key").alias("component_id")
    )
