"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, words bounded by a
blank). A text's own most frequent n-grams are compared with each profile by the out-of-place distance: the
sum of the differences of rank, and the length of a profile for an n-gram that it lacks. The nearest profile
wins.

Profiles are learned from a bounded sample of labelled rows: ``sample_rows`` per language, those with the
smallest hash of their key. Predictions use whole texts.

Defined results: texts that are NULL or have no letter are ``und`` with score 0; equal counts are ranked by
code point, equal distances by the language's name; with no labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from wardlens.llm.native import hidden
from wardlens.llm.tables import map_texts
from wardlens.operators.ordered import first_rows

RANKS = 300
SAMPLE_ROWS = 2000
MAX_LANGUAGES = 1000
BLANK = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case letter; a blank for everything else."""
    table = np.full(0x110000, BLANK, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three letters, 21 bits a character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate([[BLANK], _letters()[points], [BLANK]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != BLANK) | (s[:-1] != BLANK)])]
    if len(s) < 3:
        return np.empty(0, np.int64)
    three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] != BLANK]
    return np.concatenate([s[s != BLANK], s[:-1] << 21 | s[1:], three])


def most_frequent(text: str | None, ranks: int = RANKS) -> np.ndarray:
    """Codes of the most frequent n-grams, the commonest first."""
    codes, counts = np.unique(ngrams(text or ""), return_counts=True)
    if len(codes) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        kept = counts >= least
        codes, counts = codes[kept], counts[kept]
    return codes[np.argsort(-counts, kind="stable")][:ranks]


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that no profile may learn from: crc32 of the key as text divisible by the folds."""
    return F.coalesce(F.crc32(key.cast("string")), F.lit(0)) % folds == 0


def learn(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", ranks: int = RANKS, sample_rows: int = SAMPLE_ROWS
) -> dict[str, np.ndarray]:
    """Profiles from the rows of ``docs`` that have a language and a text.

    The rows of the sample are found by one cut of the key's hash per language, so no text is shuffled.
    """
    order = F.xxhash64(F.col(key).cast("string"))
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    narrow = labelled.select(F.col(lang).alias("lang"), order.alias("h"))
    cuts = first_rows(narrow, ["lang"], ["h"], sample_rows).groupBy("lang").agg(F.max("h").alias("cut")).limit(MAX_LANGUAGES + 1).collect()
    if len(cuts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang} a language column?")
    if not cuts:
        return {}
    cut_of = F.create_map(*[F.lit(v) for row in cuts for v in (row["lang"], row["cut"])])
    sample = labelled.where(order <= cut_of[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(ngrams(value))
            for name, grams in by.items():
                codes, counts = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = first_rows(counted, ["lang"], [F.desc("n"), F.col("gram")], ranks)
    profiles: dict[str, list] = {}
    for row in best.orderBy("lang", "rn").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {name: np.array(grams, np.int64) for name, grams in profiles.items()}


class Judge:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], ranks: int = RANKS):
        self.names = sorted(profiles)
        self.ranks = ranks
        self.codes = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)])) if profiles else np.empty(0, np.int64)
        #: Rank of a code in each profile; -1 where the profile lacks it. The last row is for unknown codes.
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = most_frequent(text, self.ranks)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = self.rank[np.where(self.codes[at] == own, at, len(self.codes))]
        apart = np.where(rank < 0, self.ranks, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (self.ranks * len(own)))


def predict(
    docs: DataFrame,
    profiles: dict[str, np.ndarray],
    keys: list[str],
    text: str = "text",
    ranks: int = RANKS,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) of every whole text, beside the key columns.

    The profiles travel with the function: at most ranks x MAX_LANGUAGES codes.
    """
    schema = StructType([docs.schema[k] for k in keys]).add(names[0], StringType()).add(names[1], DoubleType())

    def work():
        judge = Judge(profiles, ranks)

        def run(texts: list) -> list[pa.Array]:
            found = list(map(judge, texts))
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return run

    held = hidden(docs, "text")
    return map_texts(docs.select(*keys, F.col(text).alias(held)), held, schema, work)


def in_stated_language(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told and is the stated one (NULL: any), with their columns."""
    told, score = hidden(docs, "told"), hidden(docs, "told_score")
    found = predict(docs, learn(docs), docs.columns, names=(told, score))
    stated = F.coalesce(F.col(told) == F.col("lang"), F.lit(True))
    return found.where((F.col(told) != UNKNOWN) & stated).select(*docs.columns)
