"""Document fingerprints by winnowing (DataFrame functions only).

Words are hashed, every run of ``k`` words gets the cyclic-polynomial (rolling) hash of its word hashes,
and of every ``window`` consecutive hashes the smallest is kept, the rightmost one on ties. Any passage of
at least ``k + window - 1`` words that two texts share therefore leaves a common hash in both fingerprints,
and the kept positions say where.

Defined results: NULL and blank texts have an empty fingerprint; a text of fewer than ``k`` words has one
hash, that of its whole word sequence; equal texts have equal fingerprints; two empty fingerprints are
alike (1.0), an empty and a non-empty one are not (0.0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.native import hidden, indexes, let, words
from wardlens.operators.ordered import slice_of, split_points

#: Low bits of a sort key hold the word position, so that of equal hashes the rightmost sorts first.
POSITION_BITS = 28
POSITION = (1 << POSITION_BITS) - 1


def _rotated(hash_: Column, by: int) -> Column:
    if by == 0:
        return hash_
    return F.shiftleft(hash_, by).bitwiseOR(F.shiftrightunsigned(hash_, 64 - by))


def gram_hashes(word_list: Column, k: int) -> Column:
    """Rolling hash of every run of k words; the hash of the whole sequence when it is shorter."""

    def grams(hashes: Column) -> Column:
        def at(i: Column) -> Column:
            mixed = _rotated(F.get(hashes, i), k - 1)
            for j in range(1, k):
                mixed = mixed.bitwiseXOR(_rotated(F.get(hashes, i + j), k - 1 - j))
            return mixed

        size = F.size(hashes)
        return (
            F.when(size == 0, hashes)
            .when(size < k, F.array(F.xxhash64(hashes)))
            .otherwise(F.transform(F.sequence(F.lit(0), size - k), at))
        )

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), grams)


def winnow(text: Column, k: int = 5, window: int = 8) -> Column:
    """Fingerprint as struct(hashes array<bigint>, positions array<int>), in text order.

    Hashes are ordered by their leading 36 bits; positions count grams (words) from 0.
    """

    def chosen(grams: Column) -> Column:
        keys = F.transform(
            grams, lambda h, i: h.bitwiseAND(F.lit(~POSITION)).bitwiseOR(F.lit(POSITION).cast("bigint") - i)
        )
        smallest = let(
            keys,
            lambda ks: F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(ks) - window, F.lit(0))),
                lambda i: F.array_min(F.slice(ks, i + 1, F.lit(window))),
            ),
        )
        return F.transform(
            F.array_distinct(smallest),
            lambda x: (F.lit(POSITION).cast("bigint") - x.bitwiseAND(F.lit(POSITION).cast("bigint"))).cast("int"),
        )

    def picked(grams: Column) -> Column:
        positions = F.when(F.size(grams) == 0, F.array().cast("array<int>")).otherwise(chosen(grams))
        return let(
            positions,
            lambda ps: F.struct(F.transform(ps, lambda p: F.get(grams, p)).alias("hashes"), ps.alias("positions")),
        )

    return let(gram_hashes(words(text), k), picked)


def as_text(fingerprint: Column) -> Column:
    """``hash@position`` marks in text order, separated by spaces."""
    return F.array_join(
        F.zip_with(
            fingerprint["hashes"], fingerprint["positions"], lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p)
        ),
        " ",
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash lists; 1.0 when both are empty."""
    return let(
        F.size(F.array_union(a, b)),
        lambda union: F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union),
    )


def fingerprints(docs: DataFrame, text: str = "text", k: int = 5, window: int = 8, name: str = "fingerprint") -> DataFrame:
    """The table with the winnowed fingerprint of every whole text as an added struct column."""
    return docs.withColumn(name, winnow(F.col(text), k, window))


def with_next(
    df: DataFrame,
    order: str,
    columns: list[str],
    derive: Callable[[DataFrame], DataFrame] = lambda dealt: dealt,
    derived: list[str] | None = None,
    first_after_last: bool = True,
) -> DataFrame:
    """Add ``next_<column>``: the values of the row that follows in ascending order.

    The order is cut into slices at values that occur in it, so a slice is one window and the first row of
    a slice is known to hold the cut value: it is sent to the slice before it as well, as a guard row. The
    first row of all closes the last slice. Rows with equal order values follow each other by the hash of
    the columns; NULL comes first. ``derive`` may add the ``derived`` columns; it runs after the shuffle, so
    that only the given columns travel.
    """
    derived = derived or []
    points = split_points(df, order)
    value = F.col(order).cast("double")
    slice_, guard, tie = hidden(df, "slice"), hidden(df, "guard"), hidden(df, "tie")
    least = df.agg(F.min(F.struct(F.col(order).isNotNull(), F.col(order))).alias("x")).select("x.*").first()
    number = slice_of(F.coalesce(value, F.lit(float("-inf"))), points)
    opens = F.array_contains(F.split(F.lit(",".join(map(repr, points))), ",").cast("array<double>"), value) if points else F.lit(False)
    is_first = F.col(order).isNull() if least[1] is None else F.col(order) == F.lit(least[1])
    places = F.array(
        F.struct(number.alias(slice_), F.lit(0).alias(guard)),
        F.when(opens & (number > 0), F.struct((number - 1).alias(slice_), F.lit(1).alias(guard))),
        *([F.when(is_first, F.struct(F.lit(len(points)).alias(slice_), F.lit(2).alias(guard)))] if first_after_last else []),
    )
    narrow = df.withColumn(tie, F.xxhash64(*columns))
    dealt = narrow.select("*", F.inline(F.filter(places, lambda p: p.isNotNull())))
    dealt = derive(dealt.repartition(slice_))
    following = Window.partitionBy(slice_).orderBy(guard, F.col(order).asc_nulls_first(), tie)
    led = dealt.select("*", F.lead(F.struct(*columns, *derived)).over(following).alias("_following"))
    return (
        led.where(F.col(guard) == 0)
        .select(*df.columns, *derived, *[F.col(f"_following.{c}").alias(f"next_{c}") for c in [*columns, *derived]])
    )


def edited_fingerprints(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text is the text with its last quarter of code points replaced by the first as many (or all)
    of the next document. The only shuffle carries each text once.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def marked(dealt: DataFrame) -> DataFrame:
        return fingerprints(dealt, "text", k, window, "fp").select("*", "fp.hashes", "fp.positions").drop("fp")

    after = with_next(plain, "doc_id", ["text"], marked, ["hashes", "positions"])
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = after.select(
        "*",
        F.length("text").cast("bigint").alias("n_chars"),
        F.concat(
            F.substring(F.col("text"), F.lit(1), F.length("text") - quarter),
            F.substring(F.col("next_text"), F.lit(1), quarter),
        ).alias("edited"),
    )
    return fingerprints(edited, "edited", k, window, "edited_fp")
