"""Merkle manifest of a table: digests of all rows, one tree per group and one tree over the groups.

A leaf is the digest of a row's columns. The leaves of a group are numbered in order, and every run of
``fan`` consecutive nodes becomes the digest of their digests, level by level, until one node is left. Each
level is an equijoin of its nodes with computed sibling indices (slot XOR 1 for a fan of 2, slot offsets
modulo the fan otherwise); the rows of slot zero then emit the parents. The way back is also a join per
level: a node takes the siblings on the way to the root from its parent, so no key has more than ``fan`` rows.

Defined results: NULL columns count as ``-``; rows of equal order value follow each other by leaf, so repeated
rows are leaves of their own; NULL order values come first; NULL is a group of its own and the first one; a
group of one row is its own subtree; an empty table gives no rows. Columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import cut_lineage

FAN = 8
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PART_BITS = 33  # of monotonically_increasing_id, below the partition number


def nothing() -> Column:
    """No bytes."""
    return F.unhex(F.lit(""))


def no_path() -> Column:
    return F.array().cast("array<struct<before:binary,after:binary>>")


def digest(data: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def as_text(digests: Column) -> Column:
    """Digests as lowercase hex text; several in a row give their texts in a row."""
    return F.lower(F.hex(digests))


def row_digest(values: list[Column]) -> Column:
    """Digest of ``<UTF-8 bytes>:<value>`` of every value, ``-`` for NULL, one after the other."""
    texts = [v.cast("string") for v in values]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*marked))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Add ``at``, the row's number in its group from 0, and ``size``, the number of rows of the group.

    Rows are dealt out by ranges of (group, order), so a hot group lies in many partitions; a small table with
    one row per group and partition says how many rows of the group come before. ``group`` must not be NULL.
    """
    ranged = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", PART_BITS))
    parts = placed.groupBy(group, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(of_group).alias("size")
    )
    found = placed.join(offsets, [group, "_part"])
    return found.withColumn("at", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_part", "_first", "_before")


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Add ``before`` and ``after``, the digests of the siblings on either side, to nodes (tree, at, size, node)."""
    first = F.col("at") - F.col("at") % fan

    def sibling(offset: Column) -> Column:
        slot = (F.col("at") % fan).bitwiseXOR(offset) if fan == 2 else (F.col("at") % fan + offset) % fan
        return first + slot

    offsets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(fan - 1).cast("bigint")), sibling)
    asked = nodes.select("tree", "at", "size", F.explode(F.filter(offsets, lambda s: s < F.col("size"))).alias("sibling"))
    told = nodes.select("tree", F.col("at").alias("sibling"), "node")
    met = asked.join(told, ["tree", "sibling"]).groupBy("tree", "at", "size").agg(
        F.sort_array(F.collect_list(F.struct("sibling", "node"))).alias("run")  # at most fan rows
    )

    def side(keep) -> Column:
        return F.aggregate(F.filter("run", keep), nothing(), lambda got, s: F.concat(got, s["node"]))

    return met.select(
        "tree", "at", "size",
        side(lambda s: s["sibling"] == F.col("at")).alias("node"),
        side(lambda s: s["sibling"] < F.col("at")).alias("before"),
        side(lambda s: s["sibling"] > F.col("at")).alias("after"),
    )


def levels(nodes: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """All levels of the trees from the leaves up, as (tree, at, size, node, before, after).

    A tree that is down to one node keeps it on all higher levels, so the last level has a row per tree. One
    number reaches the driver, the size of the largest tree.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    made = []
    while largest > 1:
        level = cut_lineage(with_siblings(nodes, fan))
        made.append(level)
        nodes = level.where(F.col("at") % fan == 0).select(
            "tree",
            F.expr(f"at div {fan}").alias("at"),
            F.ceil(F.col("size") / fan).cast("bigint").alias("size"),
            F.when(F.col("size") > 1, digest(as_text(F.concat("node", "after")))).otherwise(F.col("node")).alias("node"),
        )
        largest = -(-largest // fan)
    return [*made, nodes.select("tree", "at", "size", "node", nothing().alias("before"), nothing().alias("after"))]


def paths(made: list[DataFrame], fan: int, tops: DataFrame) -> DataFrame:
    """For every leaf (tree, at) the columns of ``tops`` and ``path``, its siblings level by level up to the root.

    ``tops`` has a row per tree: tree, path (what follows above the tree's own root), and columns to pass down.
    """
    passed = [c for c in tops.columns if c not in ("tree", "path")]
    down = made[-1].select("tree", "at").join(tops, "tree")
    step = F.when(F.col("size") > 1, F.array(F.struct("before", "after"))).otherwise(no_path())
    for level in reversed(made[:-1]):
        above = down.withColumnRenamed("at", "up")
        inner = level.withColumn("up", F.expr(f"at div {fan}")).join(above, ["tree", "up"])
        down = inner.select("tree", "at", F.concat(step, "path").alias("path"), *passed)
    return down


def manifest(rows: DataFrame, group: str, order: str, fan: int = FAN) -> DataFrame:
    """Rows (with a column ``leaf`` of 32 bytes) with ``subroot``, ``root`` and ``path``.

    ``path`` is an array of struct(before, after), the sibling digests from the leaf to the root.
    """
    kept = rows.columns
    # Groups as text: NULL becomes the empty text, which comes first.
    grouped = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    leaves = cut_lineage(numbered(cut_lineage(grouped), "tree", [F.col(order).asc_nulls_first(), F.col("leaf")]))
    made = levels(leaves.select("tree", "at", "size", F.col("leaf").alias("node")), fan)
    subroots = made[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group_tree"), F.col("node").alias("subroot"))
    whole = cut_lineage(numbered(subroots, "tree", [F.col("group_tree")]))
    upper = levels(whole.select("tree", "at", "size", F.col("subroot").alias("node")), fan)
    root = upper[-1].select("tree", F.col("node").alias("root"), no_path().alias("path"))
    tops = whole.join(paths(upper, fan, root), ["tree", "at"])
    tops = cut_lineage(tops.select(F.col("group_tree").alias("tree"), "subroot", "root", "path"))
    return leaves.join(paths(made, fan, tops), ["tree", "at"]).select(*kept, "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(as_text(F.aggregate(path, nothing(), lambda got, p: F.concat(got, p["before"], p["after"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, p: digest(as_text(F.concat(p["before"], node, p["after"]))))


def documents_manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """Manifest of documents by language in order of ``doc_id``, with every document's proof.

    ``claimed`` gives columns of the documents as someone hands them out (the given ones by default);
    ``claimed_leaf`` is their digest and ``verified`` tells whether it leads to the root.
    """
    claimed = claimed or {}
    leaf = row_digest([F.col(c) for c in LEAF_COLUMNS])
    other = row_digest([claimed.get(c, F.col(c)) for c in LEAF_COLUMNS])
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), other.alias("claimed_leaf"))
    found = manifest(rows, "lang", "doc_id", fan)
    return found.withColumn("folded_root", folded(F.col("claimed_leaf"), F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
