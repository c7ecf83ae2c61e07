"""Spelling variants: words one edit apart, and for each word the far commoner form it may be a slip of.

Permuterm rotations: a word ``cat`` is marked with a terminator, and all rotations of ``cat$`` are sorted. A word
with its code point i replaced, and the word without it, both continue the rotation that starts after code point
i and skips it (``t$c`` for ``a``): the shorter word is that rotation, the others are it and one code point more.
So every rotation is a row under its own text, and one row under its text without the last code point; sorting by
that key brings all words one edit apart together, and a scan of a group gives every member its neighbours.

Words are distinct, so a group has at most one row per code point of the alphabet and one more; nothing grows
with the number of documents but counts, which are combined before the shuffle. Rows carry word numbers that
follow the code-point order, so ties are broken as by the words, and long keys (``LONG`` code points) are
replaced by their digests. A word of L code points costs 2 L + 1 rows.

Defined results: NULL texts have no words; NULL words are dropped; an empty table gives no rows; equal counts are
ordered by code points; a word without neighbours has no form and is its own root; added columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.native import hidden
from wardlens.session import cut_lineage

#: Never part of a word.
TERMINATOR = "$"
LONG = 40


def word_counts(occurrences: DataFrame, word: Column, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the distinct words that are long and common enough."""
    found = occurrences.select(word.alias("word")).where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def word_runs(
    docs: DataFrame, letters: str, keep: list[str], text: str = "text", name: str = "run", min_length: int = 1
) -> DataFrame:
    """A row for every maximal run of so many letters or more in whole texts, A-Z lower-cased, beside the kept columns."""
    held = hidden(docs, "run")
    runs = docs.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(f"({letters}{{{min_length},}})"), F.lit(0))).alias(held))
    return runs.select(*keep, F.translate(held, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias(name))


def without_code_point(word: Column, at: Column) -> Column:
    """The word without its code point number ``at`` (from 0)."""
    at = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))


def rotations(words: DataFrame) -> DataFrame:
    """Rows (key, member) of words (id, word, n): each rotation as it is, and without its last code point.

    ``member`` is struct(less: minus n, id, edit: 1 if the code point before the terminator's side is skipped,
    once: whether the skipped code point is the first of a run of equal ones, so that each deletion counts once).
    """
    steps = F.explode(F.sequence(F.lit(0), 2 * F.length("word"))).alias("step")
    at, edit = F.expr("step div 2").cast("int"), F.col("step") % 2
    rotated = F.concat(F.substr("word", at + 1 + edit), F.lit(TERMINATOR), F.substring("word", F.lit(1), at))
    before, skipped = F.substring(F.col("word"), at, F.lit(1)), F.substring(F.col("word"), at + 1, F.lit(1))
    return words.select("id", "word", "n", steps).select(
        F.when(F.length(rotated) > LONG, F.sha2(rotated, 256)).otherwise(rotated).alias("key"),
        F.struct(
            (-F.col("n")).alias("less"), "id", edit.alias("edit"), ((edit == 0) | (at == 0) | (before != skipped)).alias("once")
        ).alias("member"),
    )


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of words (id, word, n): number of words one edit away, and (less, id) of the commonest."""
    groups = rotations(words).groupBy("key").agg(F.sort_array(F.collect_list("member")).alias("group"))

    def near(m: Column) -> Column:
        def joined(o: Column) -> Column:
            return (o["id"] != m["id"]) & (o["edit"] + m["edit"] > 0) & ((o["edit"] == m["edit"]) | (o["once"] & m["once"]))

        others = F.filter("group", joined)
        return F.transform(
            F.array(others),
            lambda x: F.struct(m["id"].alias("id"), F.size(x).cast("bigint").alias("n"), F.get(x, F.lit(0)).alias("first")),
        )[0]

    told = groups.where(F.size("group") > 1).select(F.explode(F.transform("group", near)).alias("m")).where("m.n > 0")
    best = F.when(F.col("m.first").isNotNull(), F.struct(F.col("m.first.less").alias("less"), F.col("m.first.id").alias("id")))
    none = words.select("id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("struct<less:bigint,id:bigint>").alias("best"))
    rows = none.unionByName(told.select("m.id", "m.n", best.alias("best")))
    return rows.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def last_links(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, to), each followed to its end; links must not run in circles.

    Every round doubles the distance; rows that have reached an end are looked up but look up no more. One flag a
    round reaches the driver.
    """
    state = cut_lineage(links.select("id", F.col("to").alias("root"), F.lit(False).alias("done")))
    while not state.where(~F.col("done")).isEmpty():
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("further"), F.col("done").alias("ahead_done"))
        moved = state.where(~F.col("done")).join(ahead, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.coalesce("ahead_done", F.lit(True)).alias("done")
        )
        state = cut_lineage(moved.unionByName(state.where("done")))
    return state.select("id", "root")


def variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """Words (word, n) with form, root, n_near and form_n.

    ``form`` is the commonest word one edit away if it is at least ``ratio`` (2 or more) times as common.
    """
    ordered = counts.select("word", "n").where(F.col("word").isNotNull()).repartitionByRange("word").sortWithinPartitions("word")
    words = cut_lineage(ordered.withColumn("id", F.monotonically_increasing_id()))
    near = neighbours(words).select("id", "n_near", F.col("best.id").alias("to"), (-F.col("best.less")).alias("to_n"))
    rows = words.join(near, "id")
    rows = cut_lineage(rows.withColumn("to", F.when(F.col("to_n") >= ratio * F.col("n"), F.col("to"))))
    roots = last_links(rows.where(F.col("to").isNotNull()).select("id", "to"))
    forms = words.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    tops = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    linked = rows.where(F.col("to").isNotNull()).join(forms, "to")
    linked = linked.join(roots.withColumnRenamed("root", "root_id"), "id").join(tops, "root_id")
    alone = rows.where(F.col("to").isNull()).withColumn("root", F.col("word"))
    result = ["word", "form", "root", "n", "n_near", "form_n"]
    none = alone.select("*", F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("form_n"))
    return linked.select(*result).unionByName(none.select(*result))
