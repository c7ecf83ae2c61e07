"""Byte-level BPE of the ``tokenizers`` library over many texts.

A text without two blanks in a row is cut before every space and line break. No match of the pattern that
splits text before the merges can hold a blank after another character, and what it matches inside such a
chunk does not depend on what follows it (the next character is a blank). So a chunk has the same pre-tokens
alone as in its text, and each task keeps a table of distinct chunks. Texts with runs of blanks go through
the library's own pre-tokenizer, texts with special strings are cut at these first, as the library does.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from wardlens.llm.native import hidden
from wardlens.llm.tables import Bounded, map_texts

CHUNKS, PRE_TOKENS = 600_000, 400_000
#: Characters of texts that are encoded together.
SLICE = 1 << 23
TWO_BLANKS = re.compile(r"\s\s")
#: Below this code point the categories are the same in all versions of Unicode, so the pattern of the
#: library can be stated with plain character classes; other chunks are split by the library.
LATIN_END = "\u0250"


def _class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(ord(LATIN_END)) if unicodedata.category(chr(c))[0] in kinds)


def _blanks() -> str:
    return "".join(re.escape(chr(c)) for c in (*range(9, 14), 32, 0x85, 0xA0))


L, N, S = _class("L"), _class("N"), _blanks()
#: The byte-level pattern (fixed value) on these classes.
LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
)


def _byte_letters() -> str:
    """The letter that stands for each byte: itself if it prints, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in shown else chr(next(free)) for b in range(256))


BYTE_LETTERS = _byte_letters()


def _letters(text: str) -> str:
    """A text in the letters of the vocabulary, one for each byte."""
    return charmap_decode(text.encode(), "strict", BYTE_LETTERS)[0]


class Bpe:
    """A tokenizer file with tables of bounded size; one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level tokenizer without a normalizer")
        if tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError(f"{path}: a prefix space is not supported")
        self.library_split, self.merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        #: Vocabulary strings that the merges give back as one token: no need to merge them again.
        self.whole = {
            piece: number
            for piece, number in tokenizer.get_vocab(with_added_tokens=False).items()
            if [t.id for t in self.merge(piece)] == [number]
        }

        #: Each id as four bytes, least significant first.
        self.bytes_of = [i.to_bytes(4, "little") for i in range(max([*self.whole.values(), *added.values()]) + 1)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens in the letters of the vocabulary."""
        if text.isascii() or max(text) < LATIN_END:
            if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                return [_letters(text)]
            return [_letters(p) for p in LATIN.findall(text)]
        return [p for p, _ in self.library_split(text)]

    def encoded(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        number = self.whole.get(piece)
        if number is not None:
            return self.bytes_of[number]
        return b"".join([self.bytes_of[t.id] for t in self.merge(piece)])

    def parts(self, text: str):
        """Plain parts and ids of special strings, in order."""
        if self.special is None:
            return [text] if text else []
        found = self.special.split(text)
        return [self.added[p] if i % 2 else p for i, p in enumerate(found) if p]


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


#: Signs that are neither letter, digit nor blank; each is its own byte letter.
SIGNS = frozenset(string.punctuation)


def _chunk(piece: str) -> str:
    return piece if piece.startswith("\n") else " " + piece


def _cut(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of texts that are not empty, in UTF-8, and the number of chunks before each text and after the last."""
    _, ends, data = pa.array(texts, pa.string()).buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1)
    letters = np.frombuffer(data, np.uint8, ends[-1])
    opens = (letters == ord(" ")) | (letters == ord("\n"))
    opens[ends[:-1]] = True
    edges = np.append(np.flatnonzero(opens), ends[-1]).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), data])
    return chunks.dictionary_encode(), np.searchsorted(edges, ends)


class Counter:
    """Number of tokens of a text."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.merged = Bounded(lambda p: len(bpe.merge(p)), PRE_TOKENS)
        self.chunks = Bounded(lambda p: self.plain(_chunk(p)), CHUNKS)

    def plain(self, text: str) -> int:
        whole, merged = self.bpe.whole, self.merged
        return sum(1 if p in whole else merged[p] for p in self.bpe.split(text))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.bpe.special is not None and self.bpe.special.search(text):
            return sum(self.part(p) if isinstance(p, str) else 1 for p in self.bpe.parts(text))
        return self.part(text)

    def part(self, text: str) -> int:
        if TWO_BLANKS.search(text):
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.plain(first) if first else 0) + sum(map(self.chunks.__getitem__, rest))


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    The texts of a slice are cut into chunks together; each distinct one is looked up once a slice.
    """

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.pre = Bounded(bpe.encoded, PRE_TOKENS)
        self.chunks = Bounded(self.chunk, 2 * CHUNKS)

    def chunk(self, piece: bytes) -> bytes:
        """A chunk in UTF-8; of a space and letters, and one sign at most after them, without the pattern."""
        text = piece.decode()
        if text[0] == " " and (text.isascii() or max(text) < LATIN_END):
            if text[1:].isalpha():
                return self.bpe.encoded(charmap_decode(piece, "strict", BYTE_LETTERS)[0])
            if text[-1] in SIGNS and text[1:-1].isalpha():
                return self.chunks[piece[:-1]] + self.pre[text[-1]]
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        return b"".join([self.pre[p] for p in self.bpe.split(text)])

    def __call__(self, text: str | None) -> bytes:
        return next(self.texts([text]))

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        start = held = 0
        for i, text in enumerate(texts):
            size = len(text or "")
            if held + size > SLICE and i > start:
                yield from self.slice(texts[start:i])
                start, held = i, 0
            held += size
        yield from self.slice(texts[start:])

    def slice(self, texts: list[str | None]) -> list[bytes]:
        out, places, usual, special = [b""] * len(texts), [], [], self.bpe.special
        for i, text in enumerate(texts):
            if not text:
                continue
            if special is not None and special.search(text):
                parts = self.bpe.parts(text)
                ids = self.texts([p for p in parts if isinstance(p, str)])
                out[i] = b"".join([next(ids) if isinstance(p, str) else self.bpe.bytes_of[p] for p in parts])
            elif TWO_BLANKS.search(text):
                out[i] = self.plain(text)
            else:
                places.append(i)
                usual.append(text)
        if usual:
            for i, ids in zip(places, self.by_chunks(usual), strict=True):
                out[i] = ids
        return out

    def by_chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are neither empty nor hold two blanks in a row."""
        found, bounds = _cut(texts)
        keys = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.chunks.__getitem__, keys))
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
            self.chunks.update(zip(keys, values, strict=True))
        _, starts, ids = pa.array(values, pa.large_binary()).take(found.indices).buffers()
        ends, ids = np.frombuffer(starts, np.int64)[bounds].tolist(), memoryview(ids)
        return [ids[a:b].tobytes() for a, b in pairwise(ends)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(loaded(path))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(loaded(path))


def token_counts(docs: DataFrame, path: str, keys: list[str], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Number of tokens of every whole text (0 for NULL and empty ones), beside the key columns.

    Strings of special tokens inside a text count as one token, as the library does by default. Vocabulary
    strings that encode alone as one token are counted without merging; the rest is merged once per task
    and distinct pre-token.
    """
    schema = StructType([docs.schema[k] for k in keys]).add(name, LongType())

    def work():
        count = counter(path)
        return lambda texts: [pa.array(list(map(count, texts)), pa.int64())]

    held = hidden(docs, "text")
    return map_texts(docs.select(*keys, F.col(text).alias(held)), held, schema, work)
