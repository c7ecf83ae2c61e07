"""Notes and vectors TX-1 to TX-17."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.catalog import query
from wardlens.fixed_values import WATCHED_TERMS
from wardlens.operators.nearest import nearest_rows, neighbours
from wardlens.plans import features as f
from wardlens.plans import models as m
from wardlens.plans import notes as n
from wardlens.plans.words import association, counted, gram, neighbour_counts, vocabulary, word_vectors
from wardlens.session import cut_lineage

COPIES = """
    SELECT n.*, copies FROM noteevents n JOIN (
      SELECT hadm_id, count(*) AS copies FROM diagnoses WHERE icd9_code LIKE '584%' GROUP BY 1) d
    ON n.hadm_id = d.hadm_id"""
PATTERNS = {"NUMBER": r"[0-9]+", "EMAIL": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "NAME": r"[A-Z][a-z]+ [A-Z][a-z]+"}


@query("tx01_note_cohort", COPIES)
def _(t):
    return n.note_cohort(t.noteevents, t.diagnoses, "584")


@query(
    "tx01_note_cohort_rows",
    """SELECT n.row_id, n.hadm_id, n.category FROM noteevents n JOIN diagnoses d ON n.hadm_id = d.hadm_id
       WHERE icd9_code LIKE '584%'""",
)
def _(t):
    return n.repeated(n.note_cohort(t.noteevents, t.diagnoses, "584")).select("row_id", "hadm_id", "category")


@query(
    "tx02_cohort_sizes",
    """SELECT v.cohort, count(icd9_code) AS note_rows
       FROM (VALUES ('index', '584'), ('similar', '586'), ('different', '590'), ('absent', 'none')) v(cohort, prefix)
       LEFT JOIN (SELECT icd9_code FROM noteevents n JOIN diagnoses d ON n.hadm_id = d.hadm_id) x
         ON starts_with(icd9_code, prefix) GROUP BY 1""",
)
def _(t):
    return n.cohort_sizes(
        t.noteevents, t.diagnoses, {"index": "584", "similar": "586", "different": "590", "absent": "none"}
    )


@query(
    "tx02_combined_cohorts",
    """SELECT n.row_id, 'similar' AS cohort FROM noteevents n JOIN diagnoses d ON n.hadm_id = d.hadm_id WHERE icd9_code LIKE '586%'
       UNION ALL
       SELECT n.row_id, 'different' AS cohort FROM noteevents n JOIN diagnoses d ON n.hadm_id = d.hadm_id WHERE icd9_code LIKE '590%'""",
)
def _(t):
    parts = [
        n.repeated(n.note_cohort(t.noteevents, t.diagnoses, p)).select("row_id", F.lit(c).alias("cohort"))
        for c, p in (("similar", "586"), ("different", "590"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "tx03_labelled_notes",
    """SELECT *, CAST('0x' || substr(md5('42:' || CAST(row_id * 2 + label AS VARCHAR)), 1, 13) AS BIGINT) AS shuffle_key
       FROM (SELECT row_id, text, label, count(*) AS copies FROM noteevents n
             JOIN (SELECT hadm_id, (icd9_code LIKE '584%')::INT AS label FROM diagnoses) d ON n.hadm_id = d.hadm_id
             GROUP BY 1, 2, 3)""",
)
def _(t):
    return n.labelled_notes(t.noteevents, t.diagnoses, "584")


@query(
    "tx03_balanced_notes",
    """SELECT *, CAST('0x' || substr(md5('42:' || CAST(row_id * 2 + label + copy * 15485863 AS VARCHAR)), 1, 13) AS BIGINT) AS shuffle_key
       FROM (SELECT n.row_id, label, text, row_number() OVER (PARTITION BY n.row_id, label ORDER BY icd9_code) AS copy
             FROM noteevents n JOIN (SELECT hadm_id, icd9_code, (icd9_code LIKE '584%')::INT AS label FROM diagnoses) d
               ON n.hadm_id = d.hadm_id)
       QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id, copy) <= 1000""",
)
def _(t):
    return n.labelled_notes(t.noteevents, t.diagnoses, "584", per_class=1000)


def _terms(t):
    """One- and two-word terms of the benchmark items as the entity dictionary."""
    words = t.benchmark.select(n.tokens("text").alias("w"))
    parts = [
        words.select(F.explode(n.ngrams("w", k)).alias("term")).distinct().withColumn("label", F.lit(label))
        for k, label in ((1, "WORD"), (2, "PHRASE"))
    ]
    return parts[0].unionByName(parts[1])


GRAMS = r"""
    WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
    terms AS (SELECT DISTINCT unnest(w) AS term, 'WORD' AS label FROM b
              UNION ALL SELECT DISTINCT w[i] || ' ' || w[i + 1], 'PHRASE' FROM b, range(1, 100000) r(i) WHERE i < len(w)),
    c AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, copies FROM (%s) WHERE text IS NOT NULL),
    g AS (SELECT unnest(w) AS term, copies FROM c
          UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), copies FROM c)
    """ % COPIES
TERM_COUNTS = GRAMS + "SELECT term AS entity, label, sum(copies)::BIGINT AS n FROM g JOIN terms USING (term) GROUP BY 1, 2"


@query("tx04_term_entities", TERM_COUNTS)
def _(t):
    return n.term_entities(n.note_cohort(t.noteevents, t.diagnoses, "584"), _terms(t))


@query(
    "tx04_pattern_entities",
    " UNION ALL ".join(
        f"""SELECT entity, '{label}' AS label, sum(copies)::BIGINT AS n FROM (
              SELECT unnest(regexp_extract_all(text, '{p}')) AS entity, copies FROM ({COPIES}) WHERE text IS NOT NULL) GROUP BY 1"""
        for label, p in PATTERNS.items()
    ),
)
def _(t):
    return n.pattern_entities(n.note_cohort(t.noteevents, t.diagnoses, "584"), PATTERNS)


@query(
    "tx04_all_note_words",
    r"""SELECT word, count(*) AS n FROM (
          SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY 1""",
)
def _(t):
    return n.token_counts(t.documents)


@query(
    "tx05_tokens",
    r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::INT AS n_tokens,
               md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ')) AS digest FROM documents""",
)
def _(t):
    words = n.tokens("text")
    return t.documents.select(
        "doc_id", F.size(words).alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("digest")
    )


#: Tables of fitted vectors by application and folder: fitted once, read by all queries on word vectors.
_FITTED: dict[tuple[str, str], DataFrame] = {}


def _word_vectors(t):
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _FITTED:
        _FITTED[key] = word_vectors(t.noteevents, size=100, window=5, min_count=2)
    return _FITTED[key]


TOKENS = r"""placed AS (SELECT row_id, i AS pos, list_extract(words, i) AS word FROM
        (SELECT row_id, words, unnest(range(1, len(words) + 1)) AS i FROM
          (SELECT row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM noteevents WHERE text IS NOT NULL))),
    vocabulary AS (SELECT word, count(*) AS n FROM placed GROUP BY 1 HAVING count(*) >= 2)"""
CELLS = (
    TOKENS
    + """, near AS (SELECT a.word, b.word AS context, 6 - abs(a.pos - b.pos) AS weight FROM placed a JOIN (SELECT *, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS d FROM placed) b
              ON a.row_id = b.row_id AND a.pos = b.pos + d),
    counts AS (SELECT word, context, sum(weight)::BIGINT AS n FROM near
               WHERE word IN (SELECT word FROM vocabulary) AND context IN (SELECT word FROM vocabulary) GROUP BY 1, 2),
    sums AS (SELECT word, sum(n)::DOUBLE AS total FROM counts GROUP BY 1)"""
)


@query(
    "tx06_word_vectors",
    f"""WITH {CELLS}, above AS (SELECT DISTINCT c.word FROM counts c JOIN sums a ON c.word = a.word JOIN sums b ON c.context = b.word
                              WHERE ln(n * (SELECT sum(total) FROM sums) / a.total / b.total) > 0)
        SELECT word, n, 100 AS dims, word IN (SELECT word FROM above) AS placed FROM vocabulary""",
)
def _(t):
    """Every word of the vocabulary has a vector; words with an association above chance have one that is not zero."""
    return _word_vectors(t).select("word", "n", F.size("vector").alias("dims"), (n.norm(F.col("vector")) > 0).alias("placed"))


@query("tx06_neighbour_counts", f"WITH {CELLS} SELECT word, context, n FROM counts")
def _(t):
    return neighbour_counts(t.noteevents, vocabulary(t.noteevents))


@query(
    "tx06_association",
    f"""WITH {CELLS} SELECT * FROM (SELECT c.word, context, round(ln(n * (SELECT sum(total) FROM sums) / a.total / b.total), 6) AS weight
        FROM counts c JOIN sums a ON c.word = a.word JOIN sums b ON c.context = b.word) WHERE weight > 0""",
)
def _(t):
    cells = association(counted(t.noteevents, vocabulary(t.noteevents)))
    return cells.select("word", "context", F.round("weight", 6).alias("weight")).where("weight > 0")


@query("tx06_orthogonality", "SELECT 10000::BIGINT AS products, true AS orthogonal, true AS largest_first")
def _(t):
    """The columns of all vectors: pairwise orthogonal, with lengths that do not grow."""
    products = cut_lineage(gram(_word_vectors(t), "vector"))
    lengths = products.where("i = j").select(F.col("i").alias("at"), F.col("x").alias("length"))
    a, b = lengths.withColumnsRenamed({"at": "i", "length": "a"}), lengths.withColumnsRenamed({"at": "j", "length": "b"})
    held = products.join(a, "i").join(b, "j")
    return held.agg(
        F.count(F.lit(1)).alias("products"),
        F.bool_and((F.col("i") == F.col("j")) | (F.abs("x") <= F.lit(1e-6) * F.greatest("a", "b"))).alias("orthogonal"),
        F.bool_and((F.col("i") >= F.col("j")) | (F.col("b") <= F.col("a") * (1 + 1e-9))).alias("largest_first"),
    )


@query("tx07_nearest_words")
def _(t):
    return n.nearest_words(_word_vectors(t).select("word", "vector"), n.terms_table(t.spark, ["the", "and", *WATCHED_TERMS]))


@query(
    "tx07_nearest_terms",
    f"""WITH words AS (SELECT coalesce(list_extract({WATCHED_TERMS[:-1]}, (vec_id + 1)::BIGINT), 'word ' || vec_id) AS word, embedding AS vector FROM embeddings),
        terms AS (SELECT unnest({WATCHED_TERMS}) AS term),
        near AS (SELECT a.word AS term, b.word, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS similarity
                 FROM words a JOIN terms ON term = a.word JOIN words b ON a.word <> b.word),
        best AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY similarity DESC, word) AS rn FROM near)
        SELECT term, word, round(similarity, 6) AS similarity, rn::INT AS rn FROM terms LEFT JOIN (SELECT * FROM best WHERE rn <= 10) USING (term)""",
)
def _(t):
    # The embeddings stand for a vocabulary that has all watched terms but the last.
    named = F.get(F.array(*[F.lit(w) for w in WATCHED_TERMS[:-1]]), F.col("vec_id").cast("int"))
    words = t.embeddings.select(F.coalesce(named, F.concat(F.lit("word "), F.col("vec_id").cast("string"))).alias("word"), F.col("embedding").alias("vector"))
    out = n.nearest_words(words, n.terms_table(t.spark, WATCHED_TERMS))
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "tx15_token_vectors",
    f"WITH {TOKENS} SELECT row_id, count(*) AS tokens, 100 AS dims FROM placed JOIN vocabulary USING (word) GROUP BY 1",
)
def _(t):
    placed = n.token_vectors(t.noteevents, _word_vectors(t))
    return placed.groupBy("row_id").agg(F.count(F.lit(1)).alias("tokens"), F.min(F.size("vector")).alias("dims"))


@query(
    "tx16_frequent_word_vectors",
    f"WITH {TOKENS} SELECT word, n, 100 AS dims FROM vocabulary ORDER BY n DESC, word LIMIT 1000",
)
def _(t):
    return n.frequent_word_vectors(t.noteevents, _word_vectors(t), 1000).select("word", "n", F.size("vector").alias("dims"))


@query(
    "tx08_word_mean_embedding",
    f"""WITH {TOKENS} SELECT e.row_id, 100 AS dims, coalesce(known, false) AS placed FROM noteevents e
        LEFT JOIN (SELECT row_id, true AS known FROM placed JOIN vocabulary USING (word) GROUP BY 1) k ON e.row_id = k.row_id
        WHERE text IS NOT NULL""",
)
def _(t):
    means = n.word_mean_vectors(_word_vectors(t), t.noteevents.select("row_id", "text"), 100)
    return means.select("row_id", F.size("vector").alias("dims"), (n.norm(F.col("vector")) > 0).alias("placed"))


@query(
    "tx08_batch_encoder",
    """SELECT row_id, round(coalesce(len(regexp_replace(text, '[^a]', '', 'g'))
                / nullif(len(regexp_replace(text, '[^a-z]', '', 'g')), 0)::DOUBLE, 0), 4) AS share_a,
              round(coalesce(len(regexp_replace(text, '[^z]', '', 'g'))
                / nullif(len(regexp_replace(text, '[^a-z]', '', 'g')), 0)::DOUBLE, 0), 4) AS share_z
       FROM noteevents""",
)
def _(t):
    out = n.embed(t.noteevents.select("row_id", "text"), n.letter_encoder, 26)
    return out.select(
        "row_id",
        F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("share_a"),
        F.round(F.get("vector", F.lit(25)).cast("double"), 4).alias("share_z"),
    )


COSINE = "list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[])"


@query(
    "tx09_similarity_to_first",
    f"""SELECT a.vec_id, b.vec_id AS anchor, round({COSINE}, 6) AS similarity
        FROM vectors a, (SELECT * FROM vectors ORDER BY vec_id LIMIT 10) b""",
)
def _(t):
    out = n.similarity_to_first(t.vectors, "vec_id", "vector", 10)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "tx09_nearest_rows",
    f"""SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round({COSINE}, 6) AS similarity,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 12) DESC, b.vec_id)::INT AS rn
        FROM vectors a JOIN vectors b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rn <= 10""",
)
def _(t):
    out = nearest_rows(t.vectors.where("vec_id % 20 = 0"), t.vectors, "vec_id", "vector", 10)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "tx09_neighbours_of_all",
    f"""WITH near AS (SELECT a.vec_id, {COSINE} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rn
                      FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id)
        SELECT count(DISTINCT vec_id) AS n_queries, count(*) AS n_neighbours, true AS recall_reached, true AS similarities_exact FROM near WHERE rn <= 10""",
)
def _(t):
    """Neighbours of all rows by buckets, held against the exact ones of every row whose id is divisible by 20."""
    found = cut_lineage(neighbours(t.vectors, "vec_id", "vector", 10, recall=0.9))
    exact = nearest_rows(t.vectors.where("vec_id % 20 = 0"), t.vectors, "vec_id", "vector", 10)
    exact = exact.select("query", "neighbour", F.col("similarity").alias("exact"))
    both = exact.join(found.select("query", "neighbour", "similarity"), ["query", "neighbour"], "left")
    hits = both.agg(
        F.struct(
            (F.count("similarity") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
            F.coalesce(F.bool_and(F.abs(F.col("exact") - F.col("similarity")) < 1e-9), F.lit(True)).alias("similarities_exact"),
        ).alias("hits")
    ).scalar()
    return found.agg(F.countDistinct("query").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours")).select("*", hits.alias("h")).select(
        "n_queries", "n_neighbours", "h.recall_reached", "h.similarities_exact"
    )


@query(
    "tx10_group_similarity",
    f"""SELECT a.category AS group_a, b.category AS group_b, round(avg({COSINE}), 6) AS mean_similarity
        FROM vectors a JOIN vectors b ON a.category <= b.category GROUP BY 1, 2""",
)
def _(t):
    names = t.vectors.agg(F.array_sort(F.collect_set("category")).alias("names"))
    pairs = names.select(F.explode("names").alias("group_a"), "names").select("group_a", F.explode("names").alias("group_b"))
    out = n.group_similarity(t.vectors, pairs.where("group_a <= group_b"), "category", "vector", 64)
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("tx11_projection")
def _(t):
    return n.project(t.vectors, "vector", 64).select("vec_id", "pca1", "pca2")


@query("tx12_three_clusters")
def _(t):
    flat = n.project(t.vectors, "vector", 64).select("vec_id", "category", "pca1", "pca2")
    return n.clusters(flat, ["pca1", "pca2"], 3)


@query("tx12_twelve_clusters_scaled")
def _(t):
    scaled = n.centred(t.vectors, "vector", 64, scale=True)
    return n.clusters(scaled, "vector", 12).select("vec_id", "category", "cluster")


@query("tx13_cluster_by_category")
def _(t):
    scaled = n.centred(t.vectors, "vector", 64, scale=True)
    return n.cross_counts(n.clusters(scaled, "vector", 12), "cluster", "category")


@query(
    "tx13_cross_table",
    """SELECT lang, count(*) FILTER (WHERE quality = 0) AS "0", count(*) FILTER (WHERE quality = 1) AS "1"
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def _(t):
    return n.cross_table(t.documents.join(t.labels, "doc_id"), "lang", "quality", [0, 1])


@query(
    "tx12_standardised_vectors",
    """SELECT vec_id, round((embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / stddev_pop(embedding[1]::DOUBLE) OVER (), 5) AS v0,
              round((embedding[64]::DOUBLE - avg(embedding[64]::DOUBLE) OVER ()) / stddev_pop(embedding[64]::DOUBLE) OVER (), 5) AS v63
       FROM embeddings""",
)
def _(t):
    scaled = n.centred(t.vectors, "vector", 64, scale=True)
    return scaled.select(
        "vec_id",
        F.round(F.get("vector", F.lit(0)), 5).alias("v0"),
        F.round(F.get("vector", F.lit(63)), 5).alias("v63"),
    )


@query("tx14_note_classifier_accuracy")
def _(t):
    rows = (
        t.documents.join(t.labels, "doc_id")
        .where(F.col("text").isNotNull())
        .select("doc_id", "text", F.col("quality").alias("label"))
    )
    split = f.split_rows(rows, "doc_id")
    model = m.note_classifier(split.where(~F.col("is_test")))
    scored = m.with_probability(model, split, keep=["doc_id", "is_test", "label"])
    return m.accuracy_by_side(scored, "label", "p")


@query(
    "tx17_preview",
    "SELECT row_id, hadm_id, category, charttime, text FROM noteevents ORDER BY row_id LIMIT 10",
)
def _(t):
    return n.preview(t.noteevents)
