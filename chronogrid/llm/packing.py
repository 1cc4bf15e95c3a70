"""Packing by power-of-two decomposition.

A document of n ids is cut into whole sequences of the longest length and then
into the binary digits of the rest, longest first. A piece is a sequence of its
own: its length is a power of two, so it needs no padding, and no sequence
holds ids of two documents. A length is a bucket: its sequences have numbers of
their own range, given out where the pieces are made, so no id is shuffled.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 4096
END_ID = 2
CACHE_WORDS = 600_000
BLOCK_WORDS = 200_000
BLOCK_IDS = 1 << 20

_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
# Latin letters whose lower case does not depend on their neighbours, then marks that no contraction begins with
_PLAIN = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)")
_encoders: dict[str, "WordEncoder"] = {}


def _byte_symbols() -> dict[int, int]:
    """Byte-level vocabularies write a printable byte as itself and the n-th of the others as symbol 256 + n."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


class WordEncoder:
    """Ids of a text, word by word, with a bounded store of the words seen first.

    The tokenizer drops white space and never joins what it separates, so the
    ids of a text are those of its words in a row. It also parts letters from
    marks and ignores case, so a plain word is looked up by its lower-case
    letters; those that are new go to the merges directly, all other words
    through the whole tokenizer.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.merges = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.known: dict[str, bytes] = {}

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """Ids of consecutive blocks of words, so that memory does not follow the length of a text."""
        # split() also parts at U+001C to U+001F, which are no white space to the tokenizer
        words = _SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        for start in range(0, len(words), BLOCK_WORDS):
            block = words[start : start + BLOCK_WORDS]
            found = [ids if ids is not None else self.word(w) for w, ids in zip(block, map(self.known.get, block))]
            yield np.frombuffer(b"".join(found), "<u4")

    def word(self, word: str) -> bytes:
        """Little-endian ids of one word."""
        ids = self.known.get(word)
        if ids is not None:
            return ids
        plain = _PLAIN.fullmatch(word)
        if plain and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            letters, marks = plain[1].lower(), plain[2]
            if letters == word:
                seen = word.encode().decode("latin-1").translate(self.symbols)
                ids = struct.pack(f"<{len(t := self.merges.tokenize(seen))}I", *[x.id for x in t])
            else:
                ids = self.word(letters) + (self._whole(marks) if marks else b"")
        else:
            ids = self._whole(word)
        if len(self.known) < CACHE_WORDS:
            self.known[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        ids = self.known.get(text)
        if ids is None:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.known) < CACHE_WORDS:
                self.known[text] = ids
        return ids


def encoder(name: str = TOKENIZER) -> WordEncoder:
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    return np.concatenate([*encoder(name).blocks(text or ""), np.array([END_ID], "<u4")]).astype("<u4")


def piece_lengths(n: int, longest: int = MAX_TOKENS) -> list[int]:
    """``longest`` as often as it fits, then the binary digits of the rest from the highest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, longest: int = MAX_TOKENS
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, ids): the pieces of every document; the figures are those of the ids beside them."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest has to be a power of two")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, n_held = [], [], 0
            for at, t in enumerate(batch.column(1)):
                ids, start = token_ids(t.as_py(), name), 0
                for length in piece_lengths(len(ids), longest):
                    part = ids[start : start + length]
                    rows.append((at, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    held.append(part)
                    start += length
                    n_held += length
                    if n_held >= BLOCK_IDS:
                        yield _piece_batch(batch.column(0), rows, held)
                        rows, held, n_held = [], [], 0
            if rows:
                yield _piece_batch(batch.column(0), rows, held)

    return rows.mapInArrow(
        work, f"k {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids array<int>"
    ).withColumnRenamed("k", key)


def _piece_batch(keys: pa.Array, rows: list[tuple], held: list[np.ndarray]) -> pa.RecordBatch:
    """The pieces of some documents with their ids as lists."""
    at, *numbers = np.array(rows, np.int64).T
    columns = {"k": keys.take(pa.array(at))} | {n: pa.array(c) for n, c in zip(["start", "length", "ids_crc32", "doc_tokens"], numbers)}
    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view("<i4")))
    return pa.RecordBatch.from_pydict(columns)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, longest: int = MAX_TOKENS
) -> DataFrame:
    """Every piece with sequence_id, offset (always 0) and its ids.

    Null text counts as empty: a document of the closing id alone. Rows with
    equal or null keys are packed each on its own. An empty table gives an
    empty result. Other columns are not read. Names of special tokens in a text
    become those tokens. sequence_id is unique and need not be dense; all ids of
    a length lie together, longer ones first. It depends on the files that are
    read, so the result is to be written once (``stored``) where it is used twice.
    """
    buckets = longest.bit_length()  # one for each of the lengths 1, 2, 4, ... longest
    bucket = F.lit(buckets) - F.length(F.bin("length"))
    number = F.monotonically_increasing_id() + F.lit(1 << (63 - buckets.bit_length())) * bucket
    return pieces(docs, key, text, name, longest).select(
        key,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        number.alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        "ids",
    )
