"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of the model holds a whitespace marker after another character, and none holds a line break,
pieces cannot cross the places before a space and around a line break. A text is cut there, each distinct
marked word is segmented and decoded once per task (the table has a bounded size), and the ids are joined
back by position. Texts where a cut could fall inside a run of markers (two spaces in a row, a leading
space, the marker character itself) are given to the library whole, as are all texts when the model does
not have these properties.

Defined results: NULL and empty texts have the end id alone and decode to the empty text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from wardlens.llm.native import hidden
from wardlens.llm.tables import Bounded, map_texts

CHUNKS = 250_000
MARK = "▁"


class Pieces:
    """A model with its table; one per Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path, num_threads=1)
        self.end = self.model.eos_id()
        self.lead = self.model.encode("\n")
        self.chunks = Bounded(self.segment, CHUNKS)
        self.cuttable = self._cuttable()

    def _cuttable(self) -> bool:
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        # The words are given after a line break; the normalizer must leave both as they are.
        plain = self.model.decode(self.model.encode("\n a ﬁ b ")) == "\n a ﬁ b "
        return not crossing and plain and len(self.lead) == 2 and self.model.decode(self.lead) == "\n"

    def segment(self, piece: str) -> tuple[int, str, str]:
        """Ids of a chunk and what they decode to, found behind a line break that is taken off again."""
        ids = self.model.encode("\n" + (piece if piece.startswith("\n") else " " + piece))
        return len(ids) - 2, " ".join(map(str, ids[2:])), self.model.decode(ids)[1:]

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, the ids in decimals, the text they decode to."""
        if not text:
            return 1, str(self.end), self.model.decode([self.end])
        if not self.cuttable or "  " in text or text[0] == " " or MARK in text:
            ids = [*self.model.encode(text), self.end]
            return len(ids), " ".join(map(str, ids)), self.model.decode(ids)
        found = list(map(self.chunks.__getitem__, text.replace("\n", " \n").split(" ")))
        ids = [f[1] for f in found]
        ids.append(str(self.end))
        # The marker that the model puts before a text is not decoded.
        return sum([f[0] for f in found]) + 1, " ".join(ids), "".join([f[2] for f in found])[1:]


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, keys: list[str], text: str = "text") -> DataFrame:
    """Ids (with the end id) and the decoded text of every whole text, beside the key columns."""
    schema = StructType([docs.schema[k] for k in keys]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())

    def work():
        pieces = loaded(path)

        def run(texts: list) -> list[pa.Array]:
            found = [pieces.encode(t) for t in texts]
            ids = [list(map(int, f[1].split(" "))) for f in found]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.string())]

        return run

    held = hidden(docs, "text")
    return map_texts(docs.select(*keys, F.col(text).alias(held)), held, schema, work)


def encode_digests(docs: DataFrame, path: str, keys: list[str], text: str = "text") -> DataFrame:
    """As ``encode``, with the number of ids and digests in place of ids and texts."""
    schema = (
        StructType([docs.schema[k] for k in keys])
        .add("n_tokens", LongType())
        .add("ids_sha256", StringType())
        .add("decoded_sha256", StringType())
    )

    def work():
        pieces = loaded(path)

        def run(texts: list) -> list[pa.Array]:
            counts, ids, decoded = [], [], []
            for value in texts:
                n, numbers, back = pieces.encode(value)
                counts.append(n)
                ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

        return run

    held = hidden(docs, "text")
    return map_texts(docs.select(*keys, F.col(text).alias(held)), held, schema, work)
