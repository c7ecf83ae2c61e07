"""Note cohorts, entity counts, word and note vectors, similarity, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.scalars import has_prefix, lacks_prefix
from wardlens.operators.arrays import add_rows, flat, giving_back, list_column, runs, starts_of, sums_of_rows
from wardlens.operators.nearest import nearest_rows, similarities
from wardlens.plans.features import shuffled
from wardlens.session import cut_lineage

TOKEN = r"[\p{L}\p{N}]+"
#: Notes, or else their tokens, that meet the vectors of their words together.
ROWS_IN_BLOCK = 1 << 14
TOKENS_IN_BLOCK = 1 << 22
#: Columns of the vectors sent in one pass.
COLUMNS_AT_ONCE = 50
#: Rows handled at once inside a task.
ROWS_AT_ONCE = 256


# ---- cohorts ----------------------------------------------------------------


def _copies(diagnoses: DataFrame, wanted: Column) -> DataFrame:
    return (
        diagnoses.where(F.col("icd9_code").isNotNull() & wanted)
        .groupBy("hadm_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def note_cohort(
    notes: DataFrame, diagnoses: DataFrame, *prefixes: str, negate: bool = False, distinct: bool = False
) -> DataFrame:
    """Notes of admissions with a matching code.

    A note counts once per matching diagnosis row. That fan-out is carried as ``copies`` rather than
    as repeated texts, so a hot admission is not multiplied; ``distinct`` sets it to 1.
    """
    wanted = (lacks_prefix if negate else has_prefix)("icd9_code", *prefixes)
    joined = notes.join(_copies(diagnoses, wanted), "hadm_id")
    return joined.withColumn("copies", F.lit(1).cast("bigint")) if distinct else joined


def repeated(cohort: DataFrame) -> DataFrame:
    """One row per copy."""
    return cohort.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


def cohort_sizes(notes: DataFrame, diagnoses: DataFrame, cohorts: dict[str, str]) -> DataFrame:
    """Row counts (with fan-out) of several prefix cohorts, in one pass; 0 for an empty cohort."""
    named = F.filter(
        F.array(*[F.when(has_prefix("icd9_code", p), F.lit(n)) for n, p in cohorts.items()]),
        lambda x: x.isNotNull(),
    )
    per_admission = (
        diagnoses.select("hadm_id", F.explode(named).alias("cohort"))
        .groupBy("hadm_id", "cohort")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    per_note = notes.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("notes"))
    return (
        per_admission.join(per_note, "hadm_id")
        .select("cohort", (F.col("notes") * F.col("copies")).alias("rows"))
        .unionByName(
            notes.sparkSession.range(1).select(
                F.explode(F.array(*[F.lit(n) for n in cohorts])).alias("cohort"), F.lit(0).cast("bigint").alias("rows")
            )
        )
        .groupBy("cohort")
        .agg(F.sum("rows").alias("note_rows"))
    )


def labelled_notes(
    notes: DataFrame, diagnoses: DataFrame, *prefixes: str, per_class: int | None = None
) -> DataFrame:
    """Positive and negative notes in seeded random order, the label travelling with the row.

    The negation works on diagnosis rows, so a note with both kinds of code is in both classes. A
    note's fan-out is its ``copies``; with ``per_class`` the first n copies of each class, in note
    order, are rows of their own.
    """
    hit = has_prefix("icd9_code", *prefixes)
    sides = diagnoses.where(F.col("icd9_code").isNotNull()).groupBy("hadm_id").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    classes = F.array(
        F.struct(F.lit(1).alias("label"), F.col("pos").alias("copies")),
        F.struct(F.lit(0).alias("label"), F.col("neg").alias("copies")),
    )
    both = (
        notes.join(sides, "hadm_id")
        .select("row_id", "text", F.inline(classes))
        .where(F.col("copies") > 0)
    )
    key = F.col("row_id") * 2 + F.col("label")
    if per_class is None:
        return shuffled(both, key)
    parts = [
        repeated(
            both.where(F.col("label") == label)
            .orderBy("row_id")
            .limit(per_class)
            .withColumn("copies", F.least(F.col("copies"), F.lit(per_class)))
        )
        .orderBy("row_id", "copy")
        .limit(per_class)
        for label in (1, 0)
    ]
    return shuffled(
        parts[0].unionByName(parts[1]), key + F.col("copy") * 15485863, ties=("row_id", "label", "copy")
    )


def preview(notes: DataFrame, n: int = 10) -> DataFrame:
    return notes.orderBy("row_id").limit(n)


# ---- tokens and entities ----------------------------------------------------


def tokens(text: Column | str) -> Column:
    """Lower-cased words and numbers, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column | str, n: int) -> Column:
    """All runs of n neighbouring words, joined by a blank."""
    c = F.col(words) if isinstance(words, str) else words
    if n == 1:
        return c
    starts = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(c, i, n), " "))


def token_counts(notes: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    weight = F.lit(1) if weight is None else weight
    return (
        notes.where(F.col(text).isNotNull())
        .select(F.explode(tokens(text)).alias("word"), weight.alias("_w"))
        .groupBy("word")
        .agg(F.sum("_w").alias("n"))
    )


def term_entities(notes: DataFrame, terms: DataFrame, longest: int = 2, text: str = "text") -> DataFrame:
    """Mentions of dictionary terms (term, label), weighted by the copies of a note.

    N-grams are counted before they meet the dictionary, so a word that makes up a third of the text
    reaches the join as one row per map task.
    """
    weighted = notes if "copies" in notes.columns else notes.withColumn("copies", F.lit(1))
    grams = F.concat(*[ngrams(F.col("_t"), n) for n in range(1, longest + 1)])
    counted = (
        weighted.where(F.col(text).isNotNull())
        .select(tokens(text).alias("_t"), "copies")
        .select(F.explode(grams).alias("term"), "copies")
        .groupBy("term")
        .agg(F.sum("copies").alias("n"))
    )
    return counted.join(terms, "term").select(F.col("term").alias("entity"), "label", "n")


def _tagged(label: str) -> Callable[[Column], Column]:
    return lambda found: F.struct(found.alias("entity"), F.lit(label).alias("label"))


def pattern_entities(notes: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Mentions of regular-expression classes, weighted by the copies of a note."""
    weighted = notes if "copies" in notes.columns else notes.withColumn("copies", F.lit(1))
    found = F.concat(
        *[
            F.transform(
                F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)),
                _tagged(label),
            )
            for label, p in patterns.items()
        ]
    )
    return (
        weighted.where(F.col(text).isNotNull())
        .select("copies", F.inline(found))
        .groupBy("entity", "label")
        .agg(F.sum("copies").alias("n"))
    )


def entity_counts(
    notes: DataFrame, terms: DataFrame, patterns: dict[str, str], longest: int = 2, ordered: bool = True
) -> DataFrame:
    """Entities with label and count, most frequent first."""
    both = term_entities(notes, terms, longest).unionByName(pattern_entities(notes, patterns))
    return both.orderBy(F.desc("n"), "entity", "label") if ordered else both


# ---- word vectors -----------------------------------------------------------


def frequent_word_vectors(notes: DataFrame, vectors: DataFrame, n: int = 1000) -> DataFrame:
    """Vectors of the n most frequent words of the vocabulary, with their number in these notes."""
    return token_counts(notes).join(vectors.select("word", "vector"), "word").orderBy(F.desc("n"), "word").limit(n)


def token_vectors(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """A vector for every token of every note that is in the vocabulary."""
    placed = notes.where(F.col("text").isNotNull()).select(
        "row_id", F.posexplode(tokens("text")).alias("pos", "word")
    )
    return placed.join(vectors.select("word", "vector"), "word")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def nearest_words(vectors: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest words of each term of a table (term); a term without a vector stays with no word.

    Terms are looked up by a join and compared with the vocabulary in blocks.
    """
    asked = vectors.join(terms.select(F.col("term").alias("word")).distinct(), "word", "left_semi")
    near = nearest_rows(asked, vectors, "word", "vector", k)
    return terms.distinct().join(near.withColumnsRenamed({"query": "term", "neighbour": "word"}), "term", "left")


def terms_table(spark, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in terms], "term string")


# ---- note vectors -----------------------------------------------------------


def embed(notes: DataFrame, make_encoder: Callable, dims: int, batch: int = 64, text: str = "text") -> DataFrame:
    """Add a vector per note from any batch encoder.

    ``make_encoder`` runs once per Python worker and returns a function from an array of texts to a
    (rows, dims) array, so a model is loaded once and fed whole texts in batches.
    """
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)
    return notes.withColumn("vector", encode(F.coalesce(F.col(text), F.lit(""))))


def letter_encoder():
    """Shares of the letters a to z: a tiny encoder that needs no model file."""

    def encode(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), 26))
        for i, s in enumerate(texts):
            codes = np.frombuffer(str(s).encode("ascii", "ignore"), dtype=np.uint8)
            letters = codes[(codes >= 97) & (codes <= 122)] - 97
            if len(letters):
                out[i] = np.bincount(letters, minlength=26) / len(letters)
        return out

    return encode


def _words_of_blocks(listed: DataFrame, key: str) -> DataFrame:
    """Notes in blocks of neighbouring rows: (block, keys) once, and (block, word, slots, ns) for every word of a block.

    Slots are places of a block's notes, ns the number of times that the word is in each.
    """
    kind = listed.schema[key].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held, rows, held_tokens = [], 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            keys = pa.concat_arrays([x.column(0) for x in held])
            lengths = np.concatenate([x.column(1).value_lengths().to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
            words = pa.chunked_array([x.column(1).flatten() for x in held]).dictionary_encode().unify_dictionaries()
            held.clear()
            if not words.num_chunks:
                return
            names = words.chunk(0).dictionary
            codes = np.concatenate([x.indices.to_numpy() for x in words.chunks]).astype(np.int64)
            del words
            codes *= len(keys)
            codes += np.repeat(np.arange(len(keys)), lengths)
            codes, ns = np.unique(codes, return_counts=True)
            word, slots = np.divmod(codes, max(1, len(keys)))
            begins = starts_of(word)
            ends = pa.array([*begins, len(word)] if len(word) else [0], pa.int32())
            number = pa.array(np.full(len(begins), task << 32 | made), pa.int64())
            columns = [names.take(pa.array(word[begins])).cast(pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (slots, ns))]
            yield pa.RecordBatch.from_arrays([number, pa.nulls(len(begins), pa.list_(keys.type)), *columns], names=fields)
            own = [pa.array([task << 32 | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(1, x.type) for x in columns)], names=fields)

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                held.append(batch.slice(i, ROWS_AT_ONCE))
                rows += held[-1].num_rows
                held_tokens += len(held[-1].column(1).flatten())
                if rows >= ROWS_IN_BLOCK or held_tokens >= TOKENS_IN_BLOCK:
                    yield from block()
                    made, rows, held_tokens = made + 1, 0, 0
        if held:
            yield from block()

    fields = ["block", "keys", "word", "slots", "ns"]
    split = listed.select(key, tokens("text").alias("words"))
    return split.mapInArrow(giving_back(run), f"block bigint, keys array<{kind.simpleString()}>, word string, slots array<int>, ns array<int>")


def _sums_of_blocks(words: DataFrame, size: int, key: str) -> DataFrame:
    """(key, sums, n) of the notes of each block, from rows (block, keys) and (block, slots, ns, vector)."""
    kind = words.schema["keys"].dataType.elementType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, keys, total, n = None, None, None, None

        def ended() -> Iterator[pa.RecordBatch]:
            found = np.flatnonzero(n)
            for i in range(0, len(found), ROWS_AT_ONCE):
                some = found[i : i + ROWS_AT_ONCE]
                columns = [keys.take(pa.array(some)), list_column(list(total[some]), pa.float64()), pa.array(n[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "sums", "n"])

        for (block,), rows in runs(batches, 1, parts=True):
            if block != here:
                if here is not None:
                    yield from ended()
                here, keys = block, rows.column("keys")[0].values
                total, n = np.zeros((len(keys), size)), np.zeros(len(keys), np.int64)
                rows = rows.slice(1)
            if rows.num_rows:
                slots, ns = flat(rows.column("slots")), flat(rows.column("ns"))
                lengths = np.concatenate([x.value_lengths().to_numpy() for x in rows.column("slots").chunks])
                to, found = sums_of_rows(slots, np.repeat(np.arange(rows.num_rows), lengths), ns, flat(rows.column("vector")).reshape(-1, size))
                add_rows(total, to, found)
                n += np.bincount(slots, ns, len(n)).astype(np.int64)
        if here is not None:
            yield from ended()

    dealt = words.select("block", "keys", "slots", "ns", "vector").repartition("block").sortWithinPartitions("block", F.col("keys").isNull())
    return dealt.mapInArrow(giving_back(run), f"{key} {kind.simpleString()}, sums array<double>, n bigint")


def word_mean_vectors(vectors: DataFrame, notes: DataFrame, size: int, text: str = "text", key: str = "row_id") -> DataFrame:
    """Notes with text and ``vector``, the mean over their tokens in the vocabulary; zeros if there are none.

    A word's vector is sent once to every block of notes that has the word, not once to every note, in passes over some
    columns; a block's sums are added up in its task, and rows with one key share theirs.
    """
    listed = notes.where(F.col(text).isNotNull())
    keyed = listed.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text"))
    found = cut_lineage(_words_of_blocks(keyed, key))
    keys = found.where(F.col("word").isNull()).select("block", "keys")
    words = found.where(F.col("word").isNotNull()).select("block", "word", "slots", "ns")
    parts = []
    for begin in range(0, size, COLUMNS_AT_ONCE):
        columns = range(begin, min(size, begin + COLUMNS_AT_ONCE))
        numbers = [F.coalesce(F.get("vector", F.lit(i)).cast("double"), F.lit(0.0)) for i in columns]
        met = words.join(vectors.select("word", F.array(*numbers).alias("vector")), "word")
        sums = cut_lineage(_sums_of_blocks(keys.unionByName(met, allowMissingColumns=True), len(columns), key))
        parts.append(sums.withColumn("begin", F.lit(begin)))
    of = [F.when(F.col("begin") == i - i % COLUMNS_AT_ONCE, F.get("sums", F.lit(i % COLUMNS_AT_ONCE))) for i in range(size)]
    n = F.sum(F.when(F.col("begin") == 0, F.col("n")))
    means = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.array(*[F.sum(x) / n for x in of]).alias("vector"))
    nothing = F.array_repeat(F.lit(0.0), size)
    return listed.join(means, key, "left").withColumn("vector", F.coalesce("vector", nothing))


# ---- similarity -------------------------------------------------------------


def similarity_to(vectors: DataFrame, anchors: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine of every vector with every anchor, a table with the same two columns, as (key, anchor, similarity).

    If the anchors are rows, those rows form the similarity matrix of the anchors. A zero vector has similarity 0.
    """
    found = similarities(anchors, vectors, key, vector)
    return found.select(F.col("neighbour").alias(key), F.col("query").alias("anchor"), "similarity")


def similarity_to_first(vectors: DataFrame, key: str, vector: str, n: int = 10) -> DataFrame:
    """As :func:`similarity_to`, with the n first vectors in key order as anchors."""
    return similarity_to(vectors, vectors.orderBy(key).limit(n), key, vector)


def group_similarity(vectors: DataFrame, pairs: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """Mean cosine between the members of two groups, for (group_a, group_b) pairs, from one vector sum per group.

    The mean over all pairs equals the dot product of the summed unit vectors over the product of
    the group sizes, so no pair is formed. Pairs of a vector with itself count, as in a full matrix; a zero
    vector has similarity 0 with all. Pairs that name an unknown group have no row.
    """
    length = norm(F.col(vector))
    sums = vectors.withColumn("_len", length).groupBy(F.col(group).alias("g")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(
            *[F.sum(F.coalesce(F.try_divide(F.get(F.col(vector), F.lit(i)), F.col("_len")), F.lit(0.0))) for i in range(dims)]
        ).alias("s"),
    )
    a = sums.select(F.col("g").alias("group_a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    b = sums.select(F.col("g").alias("group_b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    return (
        pairs.select("group_a", "group_b")
        .join(a, "group_a")
        .join(b, "group_b")
        .select("group_a", "group_b", (dot(F.col("s_a"), F.col("s_b")) / (F.col("n_a") * F.col("n_b"))).alias("mean_similarity"))
    )


# ---- projection and clusters ------------------------------------------------


def centred(vectors: DataFrame, vector: str, dims: int, scale: bool = False) -> DataFrame:
    """Column-wise centring and, with ``scale``, division by the population deviation."""
    at = [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(dims)]
    stats = vectors.agg(
        F.struct(
            F.array(*[F.avg(c) for c in at]).alias("mean"), F.array(*[F.stddev_pop(c) for c in at]).alias("std")
        )
    ).scalar()
    with_stats = vectors.withColumn("_stats", stats)
    moved = F.zip_with(vector, "_stats.mean", lambda x, m: x - m)
    if scale:
        moved = F.zip_with(moved, F.col("_stats.std"), lambda x, s: x / F.when(s > 0, s).otherwise(F.lit(1.0)))
    return with_stats.withColumn(vector, moved).drop("_stats")


def project(vectors: DataFrame, vector: str, dims: int, k: int = 2, scale: bool = False) -> DataFrame:
    """Principal components; the sign of a component is arbitrary."""
    ready = centred(vectors, vector, dims, scale).withColumn("_v", array_to_vector(F.col(vector)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready)
    out = model.transform(ready).withColumn("_p", vector_to_array("_p"))
    return out.select(
        *vectors.columns, *[F.get("_p", F.lit(i)).alias(f"pca{i + 1}") for i in range(k)]
    )


def clusters(vectors: DataFrame, columns: list[str] | str, k: int, seed: int = 42) -> DataFrame:
    """K-means over plain columns or one array column; adds ``cluster``."""
    array = F.col(columns) if isinstance(columns, str) else F.array(*columns)
    ready = vectors.withColumn("_v", array_to_vector(array))
    model = Pipeline(stages=[KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster")]).fit(ready)
    return model.transform(ready).drop("_v")


def cross_table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def cross_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long cross table (row, column, n) of every value of either, NULL included; 0 where a pair is absent."""
    found = cut_lineage(df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")))
    others = found.agg(F.collect_set(F.struct(column))).scalar()
    cells = found.select(row).distinct().select(row, F.inline(others)).withColumn("n", F.lit(0).cast("bigint"))
    return found.unionByName(cells).groupBy(row, column).agg(F.sum("n").alias("n"))
