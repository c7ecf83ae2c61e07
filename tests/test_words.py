"""Word vectors against plain numpy, on small notes, several blocks and degenerate inputs."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from wardlens.plans import notes as n
from wardlens.plans import words as wd
from wardlens.plans.words import association, counted, gram, neighbour_counts, vocabulary, word_vectors

TEXTS = [
    "Acute kidney injury with oliguria, creatinine rising; dialysis started.",
    "Creatinine falls after dialysis. Kidney kidney function stable, no dialysis now",
    "acute renal failure and oliguria; creatinine up",
    None,
    "",
    "fever and cough and fever, lung clear",
    "lung lung lung cough fever",
    "acute kidney injury with oliguria, creatinine rising; dialysis started.",
] + [f"w{i % 7} w{i % 5} x{i % 3} w{(i * i) % 7} x{i % 2}" for i in range(60)]


def plain_counts(texts, window, min_count):
    lists = [re.findall(r"[^\W_]+", t.lower()) for t in texts if t is not None]
    words = {w for w, k in Counter(w for x in lists for w in x).items() if k >= min_count}
    counts = Counter()
    for x in lists:
        for i, a in enumerate(x):
            for j in range(max(0, i - window), min(len(x), i + window + 1)):
                if i != j and a in words and x[j] in words:
                    counts[a, x[j]] += window + 1 - abs(i - j)
    return words, counts


def plain_matrix(words, counts):
    names = sorted(words)
    sums = Counter()
    for (a, _), k in counts.items():
        sums[a] += k
    total = sum(sums.values())
    matrix = np.zeros((len(names), len(names)))
    for (a, b), k in counts.items():
        matrix[names.index(a), names.index(b)] = max(0.0, math.log(k * total / sums[a] / sums[b]))
    return names, matrix


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")


@pytest.mark.parametrize("window", [1, 5, 20])
def test_counts_and_association(notes, window):
    words, counts = plain_counts(TEXTS, window, 2)
    found = neighbour_counts(notes, vocabulary(notes, 2), window)
    assert {(r.word, r.context): r.n for r in found.collect()} == counts
    names, matrix = plain_matrix(words, counts)
    weights = {(r.word, r.context): r.weight for r in association(found).collect()}
    expected = {(names[i], names[j]): matrix[i, j] for i, j in zip(*np.nonzero(matrix > 0))}
    assert weights.keys() == expected.keys()
    assert all(abs(weights[k] - expected[k]) < 1e-9 for k in expected)


@pytest.mark.parametrize("size, block_words, power", [(6, 8192, 6), (200, 2, 0)])
def test_vectors_are_the_leading_eigenvectors(notes, size, block_words, power):
    """With 2 words to a block there are more blocks than one step adds up, and the whole span is found at once."""
    words, counts = plain_counts(TEXTS, 5, 2)
    names, matrix = plain_matrix(words, counts)
    vectors = word_vectors(notes, size=size, extra=30, power=power, block_words=block_words).collect()
    assert sorted(r.word for r in vectors) == names
    assert all(len(r.vector) == size for r in vectors)
    got = np.array([r.vector for r in sorted(vectors, key=lambda r: r.word)])
    values, axes = np.linalg.eigh(matrix)
    best = np.argsort(-np.abs(values))[:size]
    expected = (axes[:, best] * np.abs(values[best])) @ axes[:, best].T
    assert np.allclose(got @ got.T, expected, atol=1e-6)
    assert np.allclose(got.T @ got, np.diag(np.diag(got.T @ got)), atol=1e-8)


def test_repeated_fits_agree(notes):
    a, b = ({r.word: r.vector for r in word_vectors(notes, size=4, power=1).collect()} for _ in range(2))
    assert a.keys() == b.keys() and all(np.allclose(a[w], b[w], atol=1e-8) for w in a)


def test_no_notes_and_words_alone(spark):
    none = spark.createDataFrame([], "row_id long, text string")
    assert word_vectors(none, size=3).collect() == []
    alone = spark.createDataFrame([(1, "one"), (2, "one"), (3, None), (4, "two")], "row_id long, text string")
    assert [tuple(r) for r in word_vectors(alone, size=3).collect()] == [("one", 2, [0.0, 0.0, 0.0])]


def test_inner_products_of_columns(spark):
    rows = [[1.0, 2.0], [3.0, 4.0], [0.0, -1.0]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>").repartition(3)
    got = {(r.i, r.j): r.x for r in gram(df, "v").collect()}
    matrix = np.array(rows).T @ np.array(rows)
    assert got == {(i, j): matrix[i, j] for i in range(2) for j in range(2)}


def test_note_means(spark, notes):
    vectors = spark.createDataFrame([("lung", 4, [1.0, 0.0]), ("cough", 2, [0.0, 2.0])], "word string, n long, vector array<double>")
    means = {r.row_id: r.vector for r in n.word_mean_vectors(vectors, notes, 2).collect()}
    assert means[6] == [0.75, 0.5] and means[5] == [0.5, 1.0] and means[4] == [0.0, 0.0]
    assert 3 not in means and len(means) == len(TEXTS) - 1


def test_counts_of_long_notes_in_many_groups(spark, monkeypatch):
    """Notes longer than a chunk, words in several hash classes; pairs meet the vocabulary without a join of single pairs."""
    texts = [" ".join(f"v{(i * i + k) % 41}" for i in range(length)) for k, length in enumerate((999, 1000, 1001, 1004, 2600, 1, 0))]
    notes = spark.createDataFrame(list(enumerate([*texts, None])), "row_id long, text string")
    monkeypatch.setattr(wd, "PAIRS_IN_GROUP", 1000)
    words, counts = plain_counts(texts, 5, 2)
    found = neighbour_counts(notes, vocabulary(notes, 2), 5)
    assert {(r.word, r.context): r.n for r in found.collect()} == counts
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


def test_association_of_listed_counts(spark, notes, monkeypatch):
    """Lists of counts in many groups give the associations of the table of counts, words beside themselves included."""
    monkeypatch.setattr(wd, "PAIRS_IN_GROUP", 100)
    listed = counted(notes, vocabulary(notes, 2), 5)
    assert listed.grid > 2
    words, counts = plain_counts(TEXTS, 5, 2)
    names, matrix = plain_matrix(words, counts)
    found = association(listed)
    got = {(r.word, r.context): (r.n, r.weight) for r in found.collect()}
    expected = {(names[i], names[j]): matrix[i, j] for i, j in zip(*np.nonzero(matrix > 0))}
    assert got.keys() == expected.keys() and any(a == b for a, b in got)
    assert all(got[k][0] == counts[k] and abs(got[k][1] - expected[k]) < 1e-9 for k in expected)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("front, block_words", [(1, 3), (5, 4), (5, 8192)])
def test_vectors_when_few_words_are_in_front(notes, monkeypatch, front, block_words):
    """Words outside the front give their share by symmetry; only rows in front go to every block."""
    monkeypatch.setattr(wd, "PAIRS_IN_GROUP", 500)
    words, counts = plain_counts(TEXTS, 5, 2)
    names, matrix = plain_matrix(words, counts)
    vectors = word_vectors(notes, size=200, extra=0, power=0, block_words=block_words, front=front).collect()
    got = np.array([r.vector for r in sorted(vectors, key=lambda r: r.word)])
    values, axes = np.linalg.eigh(matrix)
    assert np.allclose(got @ got.T, (axes * np.abs(values)) @ axes.T, atol=1e-6)


def _fixed(spark):
    return spark.createDataFrame([("lung", 4, [1.0, 0.0]), ("cough", 2, [0.0, 2.0]), ("fever", 3, [4.0, 4.0])], "word string, n long, vector array<double>")


@pytest.mark.parametrize("rows, tokens", [(1, 1 << 22), (2, 3), (1 << 14, 1 << 22)])
def test_note_means_in_blocks(spark, monkeypatch, rows, tokens):
    """Repeated keys share one mean over all their tokens, across blocks; rows without a key have zeros."""
    monkeypatch.setattr(n, "ROWS_IN_BLOCK", rows)
    monkeypatch.setattr(n, "TOKENS_IN_BLOCK", tokens)
    monkeypatch.setattr(n, "ROWS_AT_ONCE", 1)
    monkeypatch.setattr(n, "COLUMNS_AT_ONCE", 1)
    texts = [(1, "lung lung cough"), (1, "fever"), (2, "absent"), (None, "lung"), (3, ""), (4, "Cough, lung"), (5, None), (2, "none")]
    notes = spark.createDataFrame(texts, "row_id long, text string").coalesce(1)
    found = sorted((r.row_id or 0, r.text, r.vector) for r in n.word_mean_vectors(_fixed(spark), notes, 2).collect())
    assert found == [
        (0, "lung", [0.0, 0.0]), (1, "fever", [1.5, 1.5]), (1, "lung lung cough", [1.5, 1.5]), (2, "absent", [0.0, 0.0]),
        (2, "none", [0.0, 0.0]), (3, "", [0.0, 0.0]), (4, "Cough, lung", [0.5, 1.0]),
    ]


def test_note_means_send_a_vector_once_to_a_block(spark, monkeypatch):
    """A word in all notes of a block meets its vector in one row, not in one for every note."""
    notes = spark.createDataFrame([(i, "lung cough lung") for i in range(500)], "row_id string, text string").coalesce(1)
    found = n._words_of_blocks(notes, "row_id").collect()
    assert sorted((r.word or "", len(r.slots or r["keys"])) for r in found) == [("", 500), ("cough", 500), ("lung", 500)]
    means = n.word_mean_vectors(_fixed(spark), notes, 2).collect()
    assert {r.row_id for r in means} == {str(i) for i in range(500)} and all(np.allclose(r.vector, [2 / 3, 2 / 3]) for r in means)


def test_a_product_in_passes_is_held_by_pairs_of_blocks(notes, monkeypatch):
    """Columns multiplied in several passes give the same vectors, and a task's rows of cells and words are small."""
    monkeypatch.setattr(wd, "PAIRS_IN_GROUP", 500)
    monkeypatch.setattr(wd, "LISTED", 3)
    monkeypatch.setattr(wd, "PIECE", 2)
    whole = sorted((r.word, r.vector) for r in word_vectors(notes, size=6, extra=4, power=1, block_words=8, front=5).collect())
    monkeypatch.setattr(wd, "PASS_BYTES", 300)
    sizes, write = [], wd.cut_lineage

    def written(df):
        out = write(df)
        for column in {"slot", "n"} & {c for c, kind in out.dtypes if kind.startswith("array")}:
            sizes.extend(r.k for r in out.select(n.F.size(column).alias("k")).collect())
        return out

    monkeypatch.setattr(wd, "cut_lineage", written)
    parts = sorted((r.word, r.vector) for r in word_vectors(notes, size=6, extra=4, power=1, block_words=8, front=5).collect())
    assert max(sizes) <= 3 and len(sizes) > 10
    a, b = (np.array([v for _, v in x]) for x in (whole, parts))
    assert [w for w, _ in whole] == [w for w, _ in parts] and np.allclose(a @ a.T, b @ b.T, atol=1e-8)  # signs are arbitrary
