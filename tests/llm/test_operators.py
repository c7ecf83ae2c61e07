"""Each operator against a plain Python version, on texts with every awkward case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.llm import (
    bpe,
    fingerprints,
    jaccard_join,
    language,
    line_templates,
    packing,
    quality,
    sentence_pieces,
    token_files,
    url_filters,
)

tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
AWKWARD = [
    None, "", " ", "\n\n", "a", "  two  blanks ", "a\tb\r\nc", "x\n y", "end ", "\nstart", "don't I'll 12³ ½ ünï ſ K", "▁mark a▁b",
    "日本語 テスト 😀 é e\u0301", "<|endoftext|> in <|endoftext|><|endoftext|> text", "</s> <s> <unk> <0x0A>", "\x00 \x1c \x85 \xa0x \u3000y",
    BASE, BASE, BASE + " end", prose(3000), "same line here now\n" * 5 + prose(30), "one two three four five " * 8,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "s", 7 if t is None else len(t), i) for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_tokens_and_pieces_equal_the_libraries(spark, docs, empty, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in AWKWARD]
    counted = by_id(bpe.token_counts(docs, BPE, ["doc_id"]))
    assert [counted[i].n_tokens for i in range(len(want))] == [len(w) for w in want]
    encoded = by_id(sentence_pieces.encode(docs, PIECES, ["doc_id"]))
    digests = by_id(sentence_pieces.encode_digests(docs, PIECES, ["doc_id"]))
    for i, t in enumerate(AWKWARD):
        ids = [*pieces.encode(t or ""), pieces.eos_id()]
        assert (encoded[i].ids, encoded[i].decoded) == (ids, pieces.decode(ids)), t
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    token_files.write_ids(docs, BPE, f"{tmp_path}/b", block_ids=500)
    got = by_id(token_files.read_documents(token_files.read_blocks(spark, f"{tmp_path}/b"), with_ids=True))
    start = 0
    for i, ids in enumerate(want):
        whole = np.array([*ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (start, len(whole), zlib.crc32(whole.tobytes()), whole.tolist())
        start += len(whole)
    token_files.write_ids(empty, BPE, f"{tmp_path}/e")
    assert token_files.read_documents(token_files.read_blocks(spark, f"{tmp_path}/e")).count() == 0
    assert bpe.token_counts(empty, BPE, ["doc_id"]).count() == 0


def test_latin_split_equals_the_library_for_every_character():
    b = bpe.loaded(BPE)
    for point in range(ord(bpe.LATIN_END)):
        for text in (f"a{chr(point)}b", f" {chr(point)}", f"1{chr(point)}{chr(point)}!", chr(point)):
            assert b.split(text) == [p for p, _ in b.library_split(text)], (point, text)


def test_plain_words_are_encoded_without_the_pattern(monkeypatch):
    """Words of Latin letters, alone or with one sign after them; all other chunks go through the pattern."""
    from tokenizers import Tokenizer

    tokenizer, text = Tokenizer.from_file(BPE), "x word, 'no don't l'été. über ºª ſtraße! Ƀɏ? a1 b2. c\td e'' f\" «g» hɐ日本.\nend. я,"
    encode, seen = bpe.Encoder(bpe.loaded(BPE)), []
    monkeypatch.setattr(encode, "plain", lambda t, plain=encode.plain: seen.append(t) or plain(t))
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not {" word,", " über", " ºª", " ſtraße!", " Ƀɏ?"} & set(seen) and {" don't", " a1", " c\td", " e''", " hɐ日本."} <= set(seen)


def test_distinct_chunks_of_a_slice_are_looked_up_once():
    class Seen(bpe.Bounded):
        asked = ()

        def __getitem__(self, key):
            self.asked = *self.asked, key
            return super().__getitem__(key)

    encode = bpe.Encoder(bpe.loaded(BPE))
    encode.chunks = Seen(encode.chunk, 100)
    assert set(encode.texts(["a b a b a b\nc"] * 50)) == {encode("a b a b a b\nc")}
    assert encode.chunks.asked == (b"a", b" b", b" a", b"\nc") * 2


def test_a_full_table_keeps_the_chunks_of_the_last_texts(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 3)
    encode, worked = bpe.Encoder(bpe.loaded(BPE)), []
    monkeypatch.setattr(encode.chunks, "compute", lambda p: worked.append(p) or encode.chunk(p))
    for text in (" one two three four", " one two three four five"):
        encode(text)
    assert len(worked) == 5


@pytest.mark.parametrize("size", [1, 40, 1 << 23])
def test_texts_are_encoded_alike_in_any_slices(monkeypatch, size):
    from tokenizers import Tokenizer

    tokenizer, more = Tokenizer.from_file(BPE), [None, "", " ", "\n", " a", "a\n", "a \nb", "\u2028a\u2003 b", "é\tü ß, 日本 語", "<|endoftext|>a b<|endoftext|>", " x'"]
    monkeypatch.setattr(bpe, "SLICE", size)
    monkeypatch.setattr(bpe, "CHUNKS", 3)
    texts = [*more, *AWKWARD, *more]
    got = [np.frombuffer(i, "<u4").tolist() for i in bpe.Encoder(bpe.loaded(BPE)).texts(texts)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packed_ids_come_back():
    for ids in ([], [5], [7] * 1000, list(range(70_000)) * 2):
        given = np.array(ids, "<u4")
        assert (token_files.unpack(len(ids), *token_files.pack(given)) == given).all()


def test_fingerprints(docs, empty):
    found = by_id(fingerprints.edited_fingerprints(docs))
    order = [t or "" for t in AWKWARD]
    for i, t in enumerate(order):
        q = len(t) // 4
        assert found[i].edited == t[: len(t) - q] + order[(i + 1) % len(order)][:q]
        assert found[i].n_chars == len(t)
        n = len(WORD.findall(t))
        positions = found[i].positions
        grams = max(n - 4, min(n, 1))
        assert positions == sorted(set(positions)) and all(0 <= p < grams for p in positions)
        # Every window of eight grams has a kept one.
        assert all(any(w <= p < w + 8 for p in positions) for w in range(max(grams - 7, min(grams, 1))))
    assert found[16].hashes == found[17].hashes and len(set(found[16].hashes) & set(found[18].hashes)) > 10
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_rightmost_of_equal_hashes_is_kept(spark):
    text = "w " * 30
    row = spark.range(1).select(fingerprints.winnow(F.lit(text)).alias("f")).first().f
    assert row.positions == list(range(7, 26))


def test_quality_counts(docs, empty):
    found = by_id(quality.statistics(docs))
    for i, t in enumerate(AWKWARD):
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        often = collections.Counter(windows)
        inside = {j + k for j, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(inside))
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words))
    assert quality.kept_documents(empty).count() == 0
    assert quality.kept_documents(docs).columns == docs.columns


def test_outliers_of_their_group_are_rejected(spark):
    clean = [(i, prose(60 + i % 40) + ".", "en", "s") for i in range(80)]
    junk = [(100 + i, " ".join(w + "$$$ %%%" for w in prose(50).split()), "en", "s") for i in range(6)]
    rows = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.kept_documents(rows).collect()}
    assert kept == {i for i, *_ in clean}


def test_rows_of_small_groups_are_compared_with_larger_ones(spark):
    """Every source is small; language "fr" is small too, so only all rows can judge it."""
    made = [(prose(60 + i % 40) + ".", "fr" if i % 20 == 0 else ["en", "de", None][i % 3], f"s{i % 23}") for i in range(200)]
    junk = [(" ".join(w + "$$$ %%%" for w in prose(50).split()), lang, f"junk{i}") for i, lang in enumerate(["en", "de", None, "fr"])]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(made + junk)], "doc_id long, text string, lang string, source string")
    rows = quality.statistics(table).select("doc_id", "lang", "source", "base_failed", *quality.STATS)
    got = by_id(quality.judged(rows, quality.estimate(rows)))
    assert all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(200, 204))
    assert {r.doc_id for r in quality.kept_documents(table).collect()} == set(range(200))
    large = table.where("doc_id < 200").withColumn("source", F.lit("s"))
    both = quality.statistics(large.unionAll(table.where("doc_id >= 200"))).select(*rows.columns)
    own = {r.group for r in quality.estimate(both).select("group").collect()}
    assert own == {*('{"lang":%s,"source":"s"}' % x for x in ('"en"', '"de"', "null")), *('{"lang":%s}' % x for x in ('"en"', '"de"', "null")), "{}"}
    assert quality.judged(both, quality.estimate(both)).where("NOT kept").count() == 4


def test_similar_documents_equal_all_pairs(spark, docs):
    base = prose(150).split()
    family = []
    for _ in range(60):
        copy = list(base)
        for _ in range(random.randint(0, 9)):
            copy[random.randrange(len(copy))] = random.choice(VOCABULARY)
        family.append(" ".join(copy))
    texts = AWKWARD + family + [prose(40) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, percent in ((3, 90), (5, 80)):
        sets = {}
        for i, t in enumerate(texts):
            w = [x.lower() if x.isascii() else "".join(c.lower() if c < "\x7f" else c for c in x) for x in WORD.findall(t or "")]
            sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        names = {i: i for i in sets}

        def root(x):
            while names[x] != x:
                x = names[x]
            return x

        for i in sets:
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((root(i), root(j)))
                    names[b] = a
        got = by_id(jaccard_join.similar_documents(rows, size, percent))
        assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), root(i)) for i in sets}
    assert jaccard_join.similar_documents(rows.limit(0)).count() == 0
    kept = by_id(jaccard_join.one_of_each(docs))
    assert 16 in kept and 17 not in kept and 18 not in kept and docs.columns == list(kept[16].asDict())


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("b.example.org", "/es/x", "allow"), ("org", "/es/xyz/uvw/", "block")]
    urls = [None, "", "no scheme", "http://org/", "http://A.Example.ORG/es/1", "https://b.example.org/es/xyz?q", "http://b.example.org?es",
            "http://xorg/", "http://c.b.example.org/es/xyz/uvw/a#f", "http://example.org", "http://example.orga/es/", "x://a.org/es/xyz/uvw/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "doc_id long, url string").withColumn("verdict", F.lit("clash"))
    got = by_id(url_filters.judge_urls(pages, url_filters.rules_table(spark, rules)))
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        want = max(fits)[2:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host.lower(), path, *want), u
    assert url_filters.judge_urls(pages.limit(0), url_filters.rules_table(spark, rules)).count() == 0


def test_lines_that_recur_are_dropped_after_the_first_document(spark, docs):
    texts = [prose(12) + f"\nCall us at number {i}00 any day\nAll rights reserved here\n" + prose(9) for i in range(6)]
    rows = spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "doc_id long, text string")
    got = by_id(line_templates.drop_recurring_lines(rows, removed="n"))
    assert got[0].text == texts[0] and got[9].text is None and got[10].text == ""
    for i in range(1, 6):
        first, *_, last = texts[i].split("\n")
        assert (got[i].text, got[i].n) == (f"{first}\n{last}", 2)
    assert line_templates.documents_with_new_lines(docs).columns == docs.columns
    assert line_templates.documents_with_new_lines(docs.limit(0)).count() == 0


def test_long_lines_of_two_documents_are_dropped(spark):
    long, tabs, short = prose(50), "\t".join(prose(60).split()), prose(49)
    texts = [f"{prose(9)}\n{long}\n{tabs}\n{short}", f"{short}\n{long} \n{prose(8)}\n{tabs}", prose(50)]
    rows = spark.createDataFrame([*enumerate(texts), (3, prose(50) + "\n" + texts[2]), (3, texts[2])], "doc_id long, text string")
    got = {(r.doc_id, r.text, r.n) for r in line_templates.drop_recurring_lines(rows, removed="n").collect()}
    _, _, kept, _ = texts[1].split("\n")
    fourth = rows.where("doc_id = 3").first().text.split("\n")[0]
    assert got == {(0, texts[0], 0), (1, f"{short}\n{kept}", 2), (2, texts[2], 0), (3, fourth, 1), (3, "", 1)}


def test_long_lines_are_generalised_token_by_token(spark):
    """Four varying words, far from each other, in 80."""
    line = prose(80).split()
    changed = [[f"new{chr(97 + i)}{w}" if j in (15, 35, 55, 75) else w for j, w in enumerate(line)] for i in range(4)]
    texts = [prose(7) + "\n" + " ".join(c) for c in changed] + [" ".join([*line[:4], *prose(76).split()])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(line_templates.drop_recurring_lines(rows, removed="n"))
    assert [got[i].n for i in range(5)] == [0, 1, 1, 1, 0]
    assert [got[i].text for i in (1, 2, 3)] == [texts[i].split("\n")[0] for i in (1, 2, 3)]


def test_lines_of_masked_tokens_have_no_template(spark):
    """Table rows differ in three documents; only what is the same, or has words enough, recurs."""
    texts = [f"{i}2 03 20{i}4\nTotal {i} {i}5 7{i} {i}\n11 22 33\nit rose by {i} per cent" for i in range(4)]
    rows = spark.createDataFrame([*enumerate(texts), (4, "41 5 6\n7 8 9")], "doc_id long, text string")
    got = by_id(line_templates.drop_recurring_lines(rows, removed="n"))
    assert got[0].text == texts[0] and got[4].text == "41 5 6\n7 8 9"
    for i in range(1, 4):
        assert (got[i].text, got[i].n) == ("\n".join(texts[i].split("\n")[:2]), 2)
    assert line_templates.documents_with_new_lines(rows).count() == 5
    assert line_templates.drop_recurring_lines(rows, removed="n", similarity=0.0).where("doc_id = 4").first().n == 0


def test_paths_of_lines_need_their_first_tokens_only(spark):
    """Token counts, paths and long lines as by masking and splitting whole lines."""
    lines = ["", "a", "a b", "a  b 1c d e", "x\ty1 z\t2 3", "1 2 3 4 5", "<*> <*> <*> <*> 6", "é1 日本 b7 c\x0bd9 e", "a b c d e1", "a b c d f", " ".join("w" * 50), " ".join("w" * 49),
             "\t".join("w" * 50), "  ".join("w" * 49), "  ".join("w" * 50), " \t".join("w" * 50), "w" * 120, " ".join(["é"] * 50), " ".join(["é"] * 49) + "\re"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, l string")
    got = by_id(rows.select(F.col("i").alias("doc_id"), F.inline(F.array(line_templates._line_facts(F.col("l"), 4, 50)))))
    placed = by_id(rows.select(F.col("i").alias("doc_id"), F.inline(F.array(line_templates._placed_line(F.col("l"), 4)))))
    paths = {}
    for i, line in enumerate(lines):
        tokens = re.sub(r"[^ \t\n\x0b\f\r]*[0-9][^ \t\n\x0b\f\r]*", "<*>", line).split(" ")
        assert (got[i].n, got[i].long) == (len(tokens), len(WORD.findall(line)) >= 50), line
        assert (placed[i].n, placed[i].leaf, placed[i].text) == (got[i].n, got[i].leaf, line)
        paths.setdefault(got[i].leaf, set()).add((len(tokens), *tokens[:4]))
    assert all(len(p) == 1 for p in paths.values()) and len(paths) == len({p for s in paths.values() for p in s})


def test_packing(spark):
    sizes = [random.choice([1, 3, 60, 200, 500, 700, 1500, 4095, 4096, 9000]) for _ in range(400)] + [0, None]
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int")
    found = packing.pack(rows, "n").collect()
    per_doc, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        per_doc[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append((r.bin_offset, r.length, r.bin_capacity, r.bin_used))
    for i, n in enumerate(sizes):
        spans = sorted(per_doc.get(i, []))
        assert sum(b for _, b in spans) == (n or 0) and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b, *_), (c, *_) in zip(parts, parts[1:]))
        used = parts[-1][0] + parts[-1][1]
        assert parts[0][3] == used and parts[0][2] == min(c for c in packing.LENGTHS if c >= used)
    assert sorted(bins) == list(range(len(bins)))
    assert packing.pack(rows.limit(0), "n").count() == 0


def test_runs_of_equal_bins_pack_as_piece_by_piece():
    histogram = {k: random.randint(1, 9) for k in random.sample(range(1, 101), 40)}
    plan = packing.best_fit(histogram, [100], 100, 0)
    rooms = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fitting = [r for r in rooms if r >= size]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - size)
            else:
                rooms.append(100 - size)
    assert collections.Counter(100 - r for r in rooms) == collections.Counter({u: 0 for u in ()}) + sum(
        (collections.Counter({used: n}) for _, n, used in plan.runs), collections.Counter()
    )


def test_language(spark, docs, empty):
    words = {"xx": ["the", "and", "with", "that", "for"], "yy": ["der", "und", "mit", "dass", "für"]}
    rows = [(i, " ".join(random.choice(words[k]) for _ in range(20)), k) for i in range(40) for k in [("xx", "yy")[i % 2]]]
    table = spark.createDataFrame([*rows, (90, None, "xx"), (91, "12 34 !", "yy"), (92, "und", None)], "doc_id long, text string, lang string")
    marked = table.withColumn("held_out", language.held_out(F.col("doc_id")))
    got = by_id(language.predict(marked, language.learn(marked.where("NOT held_out")), ["doc_id", "held_out"]))
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und", "und", "yy"] and got[90].score == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert language.learn(empty) == {} and language.predict(empty, {}, ["doc_id"]).count() == 0
    assert language.in_stated_language(docs).columns == docs.columns


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(40 + i) if i % 10 else "bad", "en", "s", 1, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, "")
        assert done.columns == docs.columns, name
        done.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 54
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == {i for i in range(60) if i % 10}
