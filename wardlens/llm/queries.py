"""The registered queries of the subpackage: each is thin, the work is in the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_fingerprints")
def _(spark, sf_dir):
    from wardlens.llm import fingerprints as fp

    found = fp.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fp.as_text(F.struct("hashes", "positions")).alias("fingerprint"),
        fp.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fp.likeness(F.col("hashes"), F.col("edited_fp.hashes")).alias("near_edited"),
        fp.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


@query("op4_quality_rules")
def _(spark, sf_dir):
    from wardlens.llm import quality
    from wardlens.session import cut_lineage

    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality.statistics(table(spark, sf_dir, "documents"))
    rows = cut_lineage(rows.select(*counts, "lang", "source", *quality.STATS))
    return quality.judged(rows, quality.estimate(rows)).select(*counts, "kept", "distance")


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    "op8_url_filters",
    r"""WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM parts),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS v
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
)
def _(spark, sf_dir):
    from wardlens.llm import url_filters as u

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = u.judge_urls(pages, u.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_sentence_pieces")
def _(spark, sf_dir):
    from wardlens.llm import sentence_pieces as sp

    return sp.encode_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])


@query("op7_token_counts")
def _(spark, sf_dir):
    from wardlens.llm import bpe

    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    counted = bpe.token_counts(docs, tokenizer_file("byte_bpe_50k.json"), ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op9_token_files")
def _(spark, sf_dir):
    from wardlens.llm import token_files as tf
    from wardlens.session import scratch_path

    folder = scratch_path(spark, "token_blocks")
    tf.write_ids(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder, end_id=0)
    return tf.read_documents(tf.read_blocks(spark, folder))


@query("op10_language")
def _(spark, sf_dir):
    from wardlens.llm import language

    docs = table(spark, sf_dir, "documents")
    marked = docs.withColumn("held_out", language.held_out(F.col("doc_id")))
    profiles = language.learn(marked.where(~F.col("held_out")))
    return language.predict(marked, profiles, ["doc_id", "held_out"])


@query("op6_ngram_jaccard")
def _(spark, sf_dir):
    from wardlens.llm import jaccard_join as jj

    return jj.similar_documents(table(spark, sf_dir, "documents"), size=3, percent=90).drop("node")


@query("op5_line_templates")
def _(spark, sf_dir):
    from wardlens.llm import line_templates as lt

    left = lt.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_dropped")
    return left.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"),
        "n_dropped",
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"),
    )


@query("op3_best_fit_packing")
def _(spark, sf_dir):
    from wardlens.llm import packing
    from wardlens.llm.native import words

    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", (F.size(words(F.col("text"))) + 1).alias("length")), "length")


#: DuckDB: a table of one row with the 256 values that crc32 is computed with.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
      lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_steps)"""


def crc_sql(text: str) -> str:
    """DuckDB: unsigned crc32 of the UTF-8 bytes of a text, beside ``crc_table`` in the FROM clause."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c // 256, crc_steps[xor(c % 256, b) + 1])), 4294967295)"


def merkle_sql(levels: int = 10, fan: int = 8) -> str:
    """Levels are spelled out; ten hold a thousand million rows of a language."""

    def leaf(text: str) -> str:
        values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        CRC_TABLE,
        f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf,
          CASE WHEN {crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS claimed FROM documents, crc_table)""",
        """n0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS at0 FROM leaves)""",
    ]

    def climb(name: str, start: str, tree: str, node: str, at: str) -> tuple[str, str]:
        """CTEs name0 .. of (tree, pos, size, node, before, after) and the last name."""
        previous = f"SELECT {tree} AS tree, {at} AS pos, count(*) OVER (PARTITION BY {tree}) AS size, {node} AS node FROM {start}"
        for k in range(levels):
            run = f"PARTITION BY tree, pos // {fan} ORDER BY pos ROWS BETWEEN"
            ctes.append(
                f"{name}{k} AS (SELECT *, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
                f"coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM ({previous}))"
            )
            previous = (
                f"SELECT tree, pos // {fan} AS pos, (size + {fan - 1}) // {fan} AS size, sha256(node || after) AS node FROM {name}{k} "
                f"WHERE size > 1 AND pos % {fan} = 0"
            )
        return name

    climb("l", "n0", "tree", "leaf", "at0")
    ctes.append(
        "tops AS (" + " UNION ALL ".join(f"SELECT tree, node AS subroot FROM l{k} WHERE size = 1" for k in range(levels)) + ")"
    )
    ctes.append("t0 AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS at1 FROM tops)")
    climb("u", "t0", "''", "subroot", "at1")
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT node AS root FROM u{k} WHERE size = 1" for k in range(levels)) + ")")
    lower = [f"l{k}" for k in range(levels)]
    upper = [f"u{k}" for k in range(levels)]
    joins = " ".join(
        [f"LEFT JOIN {n} ON {n}.tree = n0.tree AND {n}.pos = n0.at0 // {fan**k} AND {n}.size > 1" for k, n in enumerate(lower)]
        + [f"LEFT JOIN {n} ON {n}.pos = t0.at1 // {fan**k} AND {n}.size > 1" for k, n in enumerate(upper)]
    )
    proof = " || ".join(f"coalesce({n}.before || {n}.after, '')" for n in [*lower, *upper])
    ctes.append(f"f0 AS (SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, claimed AS node, "
                + ", ".join(f"{n}.before AS b_{n}, {n}.after AS a_{n}" for n in [*lower, *upper])
                + f" FROM n0 JOIN t0 USING (tree) CROSS JOIN root {joins})")
    last = "f0"
    for n in [*lower, *upper]:
        ctes.append(f"f_{n} AS (SELECT * REPLACE (CASE WHEN b_{n} IS NULL THEN node ELSE sha256(b_{n} || node || a_{n}) END AS node) FROM {last})")
        last = f"f_{n}"
    return "WITH " + ", ".join(ctes) + (
        f" SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {last}"
    )


@query("op13_merkle_manifest", merkle_sql())
def _(spark, sf_dir):
    from wardlens.llm import merkle

    tampered = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = F.when(tampered, lowered).otherwise(F.col("text"))
    found = merkle.documents_manifest(table(spark, sf_dir, "documents"), {"text": told})
    return found.select(
        "doc_id",
        *[merkle.as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.as_text(merkle.proof_digest(F.col("path"))).alias("proof_sha256"),
        merkle.as_text(F.col("folded_root")).alias("folded_root"),
        "verified",
    )


LETTERS = r"[A-Za-z\u00C0-\u00FF]"


@query(
    "op11_spelling_variants",
    f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM documents),
hashed AS (SELECT run, m, {crc_sql("(doc_id || ':' || run)")} AS h
           FROM (SELECT doc_id, run, count(*) AS m FROM runs GROUP BY ALL), crc_table),
words AS (SELECT word, sum(m)::BIGINT AS n FROM (
            SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
          UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
                 CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS top FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.top WHERE form IS NOT NULL)
SELECT forms.word, forms.form, walk.top AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN walk USING (word) JOIN forms ends ON ends.word = walk.top WHERE ends.form IS NULL""",
)
def _(spark, sf_dir):
    from wardlens.llm import spelling as sp

    runs = sp.word_runs(table(spark, sf_dir, "documents"), LETTERS, ["doc_id"], min_length=5)  # a slip only shortens a run
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.select("run", F.crc32(F.encode(named, "UTF-8")).alias("h"))
    slip = sp.without_code_point(F.col("run"), F.col("h") % F.length("run"))
    return sp.variants(sp.word_counts(hashed, F.when(F.col("h") % 97 == 0, slip).otherwise(F.col("run"))))


@query(
    "op12_substring_dedup",
    r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT win, min(doc_id) AS least FROM wins GROUP BY win),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM wins JOIN least USING (win) WHERE least < doc_id)),
words AS (SELECT r, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, (coalesce(len(ws), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)""",
)
def _(spark, sf_dir):
    from wardlens.llm import substrings

    left = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
