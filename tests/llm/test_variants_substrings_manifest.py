"""Spelling variants, substring dedup and the Merkle manifest against plain Python versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wardlens.llm import fm_index, merkle, queries, spelling, substrings

pytest.importorskip("xxhash")
random.seed(11)
WORDS = ["".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(60)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


PASSAGE, OTHER = prose(60), prose(30)
TEXTS = [
    None, "", " \n\t", "one", prose(40), PASSAGE, PASSAGE, PASSAGE + " end", "start " + PASSAGE, prose(20) + " " + PASSAGE + " " + prose(20),
    PASSAGE.replace(" ", "\n", 5), "same line " * 40, "same line " * 40 + prose(9), OTHER + " " + OTHER, prose(3000), OTHER, "ä ß é " * 9, "É a b\x1cc " * 9,
    "Länge länge längen lange Lange langes lage LANGE längé", "x" * 700 + " " + "x" * 699 + "y " + "x" * 701,
] + [f"{prose(6)} {PASSAGE[:90]} {prose(6)}" for _ in range(30)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` int, leaf string, tie string, word string, _run string"


def rows_of(texts):
    langs = ["en", "en", "en", "de", None, "", "fr"]
    return [(i, t, langs[i % 7], None if i % 5 == 0 else "s", None if t is None else len(t), i, "x", "y", "z", "r") for i, t in enumerate(texts)]


ROWS = rows_of(TEXTS)
# Rows repeated as a whole, a doc_id with two texts, and rows without a doc_id.
ROWS += [ROWS[9], (9, PASSAGE + " again", "en", "s", 3, 0, "x", "y", "z", "r"), (None, PASSAGE, "en", None, 1, 0, "x", "y", "z", "r"), (None, None, None, None, None, 0, "x", "y", "z", "r")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with the documents as a table, and one with an empty table."""
    path = str(tmp_path_factory.mktemp("docs"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/empty/documents.parquet")
    return path


def run(spark, folder, name, which="full"):
    return sorted((tuple(r) for r in queries.QUERIES[name](spark, f"{folder}/{which}").collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_substring_dedup", "op13_merkle_manifest"])
def test_empty_table_gives_no_rows(spark, folder, name):
    assert run(spark, folder, name, "empty") == []


def plain_repeats(rows, length):
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    least = {}
    for d, words in split:
        for i in range(len(words) - length + 1):
            if d is not None:
                w = tuple(words[i : i + length])
                least[w] = min(d, least.get(w, d))
    for d, words in split:
        gone = set()
        for i in range(len(words) - length + 1):
            if d is not None and least[tuple(words[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        yield d, len(words), len(gone), hashlib.sha256(kept).hexdigest()


def test_substring_dedup_equals_plain_version(spark, folder):
    want = list(plain_repeats(ROWS, 13))
    assert sum(r[2] for r in want) > 500
    assert run(spark, folder, "op12_substring_dedup") == ordered(want)


@pytest.mark.parametrize("length", [1, 2, 5])
def test_substring_dedup_of_other_lengths(spark, length):
    rows = rows_of([prose(random.randint(0, 90)) for _ in range(40)])
    docs = spark.createDataFrame(rows, SCHEMA)
    left = substrings.without_repeats(docs, length).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in left]
    assert ordered(got) == ordered(plain_repeats(rows, length))
    assert all(sum(s.words for s in r.spans) == r.n_removed for r in left)


def test_hot_anchors_change_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ROWS", 10)
    monkeypatch.setattr(substrings, "HOT_SHARE", 1 << 60)
    assert run(spark, folder, "op12_substring_dedup") == ordered(plain_repeats(ROWS, 13))


def test_shard_of_segments_equals_plain_search():
    random.seed(3)
    pieces = [[random.choice("ab") for _ in range(random.randint(4, 12))] for _ in range(60)]
    docs = np.array([random.randint(0, 20) for _ in pieces])
    counts = np.array([len(p) - 3 for p in pieces])
    places = substrings.place(np.arange(60) * 100, counts, np.zeros(60, np.int64))
    got = set()
    for d, p in zip(*substrings.found_in_shard(docs, places, [" ".join(x).encode() for x in pieces], 4)):
        start, count, _ = substrings.parts(p)
        got |= {(int(d), int(start) + i) for i in range(count)}
    windows = [(int(docs[k]), k * 100 + i, tuple(p[i : i + 4])) for k, p in enumerate(pieces) for i in range(len(p) - 3)]
    assert got == {(d, at) for d, at, w in windows if any(e < d and w == v for e, _, v in windows)}


def test_matching_statistics_equal_plain_ones():
    random.seed(4)
    text = np.array([random.randint(1, 3) if random.random() < 0.9 else 0 for _ in range(400)] + [0])
    index = fm_index.Index(text, 6)
    ends = np.flatnonzero(text > 0)

    def occurs_twice(piece):
        return 0 not in piece and sum(1 for i in range(len(text) - len(piece) + 1) if list(text[i : i + len(piece)]) == piece) > 1

    for end, got in zip(ends, index.matching(text, ends, 6)[0]):
        want = 0
        while want < 6 and end - want >= 0 and occurs_twice(list(text[end - want : end + 1])):
            want += 1
        assert got == want, end


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None


def test_spelling_query_equals_plain_version(spark, folder):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = collections.Counter()
    for d, t, *_ in ROWS:
        for word in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = word.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert run(spark, folder, "op11_spelling_variants") == ordered(plain_variants(counts))


def test_variants_of_dense_words(spark):
    random.seed(8)
    words = {"".join(random.choice("abä") for _ in range(random.randint(2, 6))) for _ in range(300)} | {"a" * 60, "a" * 61, "a" * 59 + "b", "a" * 40, "a" * 41}
    counts = {w: 2 ** random.randint(1, 12) for w in words}
    df = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert ordered(got) == ordered(plain_variants(counts))
    assert max(len(w) for w, *_ in got) == 61 and any(r[1] != r[2] for r in got)


def plain_manifest(rows, fan, tampered):
    def H(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(doc_id, text, lang, source, n_chars):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def climb(nodes):
        """Root and, per node, its (before, after) pairs."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = i // fan * fan
                ways[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fan])))
                at[k] = i // fan
            nodes = [H("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        return nodes[0], ways

    groups = collections.defaultdict(list)
    for d, t, lang, source, n, *_ in rows:
        groups[(lang is not None, (lang or "").encode())].append((d is not None, d or 0, leaf(d, t, lang, source, n), leaf(d, tampered(d, t), lang, source, n), d))
    keys = sorted(groups)
    built = [climb([x[2] for x in sorted(groups[k])]) for k in keys]
    root, tops = climb([b[0] for b in built])
    for k, (subroot, ways), top in zip(keys, built, tops):
        for (_, _, own, claimed, d), way in zip(sorted(groups[k]), ways):
            node = claimed
            for before, after in way + top:
                node = H(before + node + after)
            yield d, own, subroot, root, H("".join(b + a for b, a in way + top)), node, node == root


def test_manifest_query_equals_plain_version(spark, folder):
    def tampered(d, t):
        if t is None or d is None or zlib.crc32(str(d).encode()) % 3:
            return t
        return re.sub("[A-Z]+", lambda m: m[0].lower(), t)

    want = list(plain_manifest(ROWS, 8, tampered))
    assert {r[-1] for r in want} == {True, False}
    assert run(spark, folder, "op13_merkle_manifest") == ordered(want)


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest_of_other_fans(spark, fan):
    rows = [(i, f"t{i}", f"l{i % 5}" if i < 30 else "l0", None, i) for i in range(67)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.documents_manifest(docs, fan=fan)
    names = ["leaf", "subroot", "root"]
    got = [(r.doc_id, *[bytes(r[c]).hex() for c in names], bytes(r.proof).hex(), bytes(r.folded_root).hex(), r.verified) for r in found.withColumn("proof", merkle.proof_digest(found.path)).collect()]
    assert ordered(got) == ordered(plain_manifest(rows, fan, lambda d, t: t))


CLASHES = ["_text", "_told", "_told_score", "_own_0", "_own_1", "est", "kept", "distance", "words", "length", "score", "lang_pred"]


def test_stages_keep_columns_with_clashing_names(spark):
    """The filtering stages of the pipeline return the rows as they were, whatever further columns are called."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    random.seed(2)
    texts = [" ".join(random.choice(WORDS) for _ in range(80)) for _ in range(30)] + [None, "", "x"]
    rows = [(i, t, "en", "s", None if t is None else len(t), *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        left = [tuple(r) for r in out.collect()]
        assert 20 <= len(left) and set(left) <= set(rows), name


def test_encoders_keep_columns_with_clashing_names(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from wardlens.llm import bpe, sentence_pieces

    docs = spark.createDataFrame([(1, "a b", "own")], "doc_id long, text string, _text string")
    counted = bpe.token_counts(docs, tokenizers.path("byte_bpe_50k.json"), ["doc_id", "_text"]).first()
    assert (counted["_text"], counted["n_tokens"]) == ("own", 2)
    assert sentence_pieces.encode(docs, tokenizers.path("piece_bpe_32k.model"), ["doc_id", "_text"]).first()["_text"] == "own"
