"""Byte-level BPE encoding of a whole corpus.

The encoding of a word is read from states of its prefixes: the state of a prefix is the last token of the prefix's own
encoding. A token t may end the encoding of w[:i] exactly if the pair (last token of w[:i-len(t)], t) would not be merged or
split otherwise by BPE; one such token exists at every position. Distinct words are visited in byte order, which is a
depth-first walk through their trie: the states along the current path form a stack, and what a word shares with the word
before it is kept. So a shared prefix is encoded once, and no step depends on merging pair after pair.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_size

# Fixed value: the public pattern that splits a text into words before byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers; beyond it starts anew (only speed depends on it).
REMEMBERED = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: one token a line, in base 64, followed by its id; ids rise with merge order."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixEncoder:
    """Encodes words given in byte order, with states shared along the trie's path."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.text_of = {v: k for k, v in ranks.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.path = b""
        self.last: list[int] = []  # last token of each prefix of the path, shortest first
        self.back: list[int] = []  # where that token begins

    def merged(self, text: bytes) -> list[bytes]:
        """BPE by definition; used on two tokens at a time."""
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, first: int, second: int) -> bool:
        known = self.compatible.get((first, second))
        if known is None:
            a, b = self.text_of[first], self.text_of[second]
            known = self.compatible[first, second] = self.merged(a + b) == [a, b]
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
        return known

    def encode(self, word: bytes) -> list[int]:
        shared, most = 0, min(len(word), len(self.path))
        while shared < most and word[shared] == self.path[shared]:
            shared += 1
        del self.last[shared:], self.back[shared:]
        self.path = word
        ranks, last, back = self.ranks, self.last, self.back
        for end in range(shared + 1, len(word) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = ranks.get(word[begin:end])
                if token is not None and (begin == 0 or self.fits(last[begin - 1], token)):
                    last.append(token)
                    back.append(begin)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        ids, at = [], len(word)
        while at:
            ids.append(last[at - 1])
            at = back[at - 1]
        return ids[::-1]

    def encode_all(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of the distinct words, by one depth-first walk."""
        return {w: self.encode(w) for w in sorted(set(words))}


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> tuple[PrefixEncoder, dict[str, list[int]]]:
    return PrefixEncoder(read_ranks(data)), {}


def _mapper(vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder, known = _encoder(vocabulary.value)
        split = regex.compile(SPLIT).findall
        for batch in by_size(batches, 1):
            words_of = [split(t) if t else () for t in batch.column(1).to_pylist()]
            new = {w for words in words_of for w in words if w not in known}
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {w for words in words_of for w in words}
            fresh = encoder.encode_all(w.encode() for w in new)
            known.update((w, fresh[w.encode()]) for w in new)
            ids: list[int] = []
            offsets = [0]
            for words in words_of:
                for w in words:
                    ids += known[w]
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_id", "ids"])

    return encode


def encode_corpus(docs: DataFrame, row_id: str, text: str, vocabulary_path: str) -> DataFrame:
    """Token ids of every row: row_id, ids (array of int).

    ``vocabulary_path``: a rank file (see ``read_ranks``) that the driver reads and broadcasts (some 100 kB; fixed by the
    tokenizer, not by the data). No special tokens are added, and their spellings in a text are ordinary text. Null and empty
    texts give an empty list, blank texts their tokens. Each row is encoded where it is: no shuffle, whole texts, repeated
    rows each; an empty table gives no rows. Columns other than these two are not read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    rows = docs.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_mapper(vocabulary), f"_id {kind}, ids array<int>").withColumnRenamed("_id", row_id)
