"""Line dedup with a log-template tree (DataFrame functions only).

A line's path in the tree has a fixed depth: its number of tokens, then its first ``depth`` tokens, with
tokens that hold a digit as ``<*>``. Within a leaf a line is a row of tokens. A token that fewer than
``min_docs`` documents show at its place is variable and generalised to ``<*>``; what remains is the line's template. A template counts when at least
``similarity`` of its tokens, and one at least, are constant; ``<*>`` is none, whatever stands behind it. Templates that occur in ``min_docs`` documents or more are
recurring: their lines stay in the document with the least ``doc_id`` and are dropped from all others. A line
that is the same (but for blanks at its ends) in that many documents recurs whatever its leaf holds; for a line
of ``long_words`` words or more two documents are enough.

Only hashes of lines and tokens are shuffled and counted; a common line is one row per document, combined
before the shuffle. Tokens are taken, in a second pass over the texts, only from distinct lines of leaves that
hold ``min_docs`` rows and more than one distinct line: elsewhere there is nothing to generalise. The texts move
once, to meet their list of dropped lines.

Defined results: NULL texts stay NULL; lines of fewer than ``min_tokens`` tokens are never dropped (unless they
have ``long_words`` words, parted by tabs); rows with
the same doc_id are one document; a document that loses all its lines has an empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.native import BLANKS, hidden, let, words
from wardlens.session import cut_lineage

VARIABLE = r"\S*[0-9]\S*"
MASK = "<*>"


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def _tokens(line: Column) -> Column:
    """Number of tokens, which are what lies between single spaces."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _masked(line: Column) -> Column:
    return F.regexp_replace(line, VARIABLE, MASK)


def _leaf(line: Column, n: Column, depth: int) -> Column:
    """Hash of the path: a variable run holds no space, so masking the first tokens gives those of the masked line."""
    return F.xxhash64(n, _masked(F.substring_index(line, " ", depth)))


def _is_long(line: Column, n: Column, long_words: int) -> Column:
    """Whether a trimmed line has so many words; without other blanks and runs of blanks its words are its tokens."""
    other = reduce(Column.__or__, [F.contains(line, F.lit(b)) for b in ("  ", *BLANKS.replace(" ", ""))])
    counted = F.when(other, F.size(words(line)) >= long_words).otherwise(n >= long_words)
    # So many words have as many characters and a blank between any two.
    return F.when(F.octet_length(line) >= 2 * long_words - 1, counted).otherwise(False)


def _line_facts(line: Column, depth: int, long_words: int) -> Column:
    """struct(n tokens, whether long, leaf, line hash) of a trimmed line."""
    return let(
        _tokens(line),
        lambda n: F.struct(
            n.alias("n"),
            _is_long(line, n, long_words).alias("long"),
            _leaf(line, n, depth).alias("leaf"),
            F.xxhash64(line).alias("line"),
        ),
    )


def _placed_line(line: Column, depth: int) -> Column:
    """struct(n tokens, leaf, text) of a trimmed line."""
    return let(_tokens(line), lambda n: F.struct(n.alias("n"), _leaf(line, n, depth).alias("leaf"), line.alias("text")))


def recurring_lines(
    docs: DataFrame, min_docs: int = 3, depth: int = 4, similarity: float = 0.6, min_tokens: int = 3, long_words: int = 50
) -> DataFrame:
    """(doc_id, lines): hashes of the lines, without blanks at their ends, that a document loses."""
    lines = F.array_distinct(_trimmed(F.coalesce("text", F.lit(""))))
    facts = F.transform(lines, lambda x: _line_facts(x, depth, long_words))
    shown = cut_lineage(docs.select("doc_id", F.inline(F.filter(facts, lambda f: f["long"] | (f["n"] >= min_tokens)))))
    counted = cut_lineage(shown.groupBy("leaf", "line", "long", "n").agg(F.count(F.lit(1)).alias("docs")))
    wanted = F.when(F.col("long"), F.least(F.lit(2), F.lit(min_docs))).otherwise(F.lit(min_docs))
    exact = counted.select("leaf", "line", F.col("line").alias("template"), wanted.alias("wanted"), "docs").where("docs >= wanted")
    rows_of = counted.where(F.col("n") >= min_tokens).groupBy("leaf").agg(F.sum("docs").alias("all"), F.count(F.lit(1)).alias("distinct"))
    busy = cut_lineage(rows_of.where((F.col("all") >= min_docs) & (F.col("distinct") > 1)).select("leaf"))
    texts = docs.select(F.inline(F.filter(F.transform(lines, lambda x: _placed_line(x, depth)), lambda f: f["n"] >= min_tokens)))
    tokens = F.split(_masked(F.col("text")), " ", -1)
    busy_lines = cut_lineage(
        texts.join(busy, "leaf", "left_semi")
        .select("leaf", F.xxhash64("text").alias("line"), F.transform(tokens, lambda x: F.when(x != MASK, F.xxhash64(x))).alias("fields"))
        .groupBy("leaf", "line", "fields")
        .agg(F.count(F.lit(1)).alias("docs"))
    )
    fields = busy_lines.select("leaf", "line", "docs", F.posexplode("fields").alias("at", "field"))
    constant = (
        fields.where("field IS NOT NULL")
        .groupBy("leaf", "at", "field")
        .agg(F.sum("docs").alias("support"))
        .where(F.col("support") >= min_docs)
        .drop("support")
    )
    templates = (
        fields.join(constant.withColumn("constant", F.lit(1)), ["leaf", "at", "field"], "left")
        .groupBy("leaf", "line")
        .agg(
            F.count("constant").alias("constants"),
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.when(F.col("constant") == 1, F.xxhash64("at", "field")).otherwise(F.xxhash64("at"))).alias("template"),
        )
        .where((F.col("constants") >= F.col("n") * similarity) & (F.col("constants") > 0))
        .select("leaf", "line", "template", F.lit(min_docs).alias("wanted"))
        .unionByName(exact.drop("docs"))
    )
    placed = cut_lineage(shown.select("doc_id", "leaf", "line").join(templates, ["leaf", "line"]))
    recurring = (
        placed.select("doc_id", "leaf", "template", "wanted")
        .distinct()
        .groupBy("leaf", "template")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.max("wanted").alias("wanted"))
        .where(F.col("docs") >= F.col("wanted"))
        .drop("docs", "wanted")
    )
    dropped = placed.join(recurring, ["leaf", "template"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return dropped.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, removed: str | None = None, **options) -> DataFrame:
    """The documents without the lines that recur; ``removed`` names a column for the number of lines lost."""
    found = recurring_lines(docs, **options)
    lost = hidden(docs, "lost")
    found = found.select(F.col("doc_id").alias(f"{lost}_id"), F.col("lines").alias(lost))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[f"{lost}_id"]), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x: ~F.array_contains(F.col(lost), F.xxhash64(F.btrim(x, F.lit(BLANKS)))))
    columns = {c: F.col(c) for c in docs.columns}
    columns["text"] = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")
    if removed:
        columns[removed] = F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("bigint").alias(removed)
    return joined.select(*columns.values())


def documents_with_new_lines(docs: DataFrame, **options) -> DataFrame:
    """As ``drop_recurring_lines``, without the documents of which no word is left; ``n_chars`` follows the text."""
    count = hidden(docs, "removed")
    left = drop_recurring_lines(docs, removed=count, **options)
    some = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) != ""
    kept = left.where((F.col(count) == 0) | some)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col(count) == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return kept.select(*docs.columns)
