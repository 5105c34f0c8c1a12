"""Evaluation texts inside training text: which documents hold which test items.

The training text is stored as a positional inverted index in segments. A segment covers a range of documents: the terms in it,
sorted, and for each the sorted positions of its postings. Segments are built where the documents lie and written once, so
nothing is shuffled and no frequent term gathers in one task: its list is split by documents. Any number of test items is then
looked up in the stored index, in blocks that are sent to the segments; the text is not read again. In each segment the passages
whose terms all occur are looked up from their rarest term; the lists of the other terms, shifted by their place in the passage,
are intersected with it from the rarer to the more frequent ones. What survives stands in the text word for word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import by_size
from tidemark.session import cut

#: Bytes of item texts that are sent to the segments at once, and of documents in one segment.
BLOCK_BYTES, SEGMENT_BYTES = 16_000_000, 4_000_000
_DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")
_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case, without combining marks and invisible format characters."""
    if not text:
        return []
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFD", text.casefold()))
    return _WORDS.findall(text.lower())


def _numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms (64-bit hashes, sorted), the number of the term of each word of all texts in a row, and the words of each text."""
    seen: dict[str, int] = {}
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    number = seen.setdefault
    for k, text in enumerate(texts):
        found = words(text)
        sizes[k] = len(found)
        flat += [number(w, len(seen)) for w in found]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in seen], np.uint64).view(np.int64)
    terms, place = np.unique(hashes, return_inverse=True)
    return terms, place.ravel()[np.array(flat, np.int64)] if flat else np.empty(0, np.int64), sizes


def _positions(sizes: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins if ``gap`` free places are left between texts, and the position of each word."""
    starts = np.r_[0, np.cumsum(sizes + gap)[:-1]] if len(sizes) else np.empty(0, np.int64)
    return starts, np.arange(sizes.sum()) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else np.empty(0, np.int64)


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first+count: which range, and each member."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which]


#: Free places between the documents of a segment; no passage that is looked up may be longer.
GAP = 1024


def _indexer(segment_bytes: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each segment: its documents and their starts, terms, ends of their lists, positions."""
        for batch in by_size(batches, 1, segment_bytes):
            terms, numbers, sizes = _numbered(batch.column(1).to_pylist())
            starts, at = _positions(sizes, GAP)
            order = np.argsort(numbers, kind="stable")
            ends = np.cumsum(np.bincount(numbers, minlength=len(terms))) if len(terms) else np.empty(0, np.int64)
            columns = [(batch.column(0), batch.column(0).type), (starts, pa.int64()), (terms, pa.int64()), (ends, pa.int64()), (at[order], pa.int64())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, t)) for c, t in columns]
            yield pa.RecordBatch.from_arrays(lists, names=["docs", "starts", "terms", "ends", "postings"])

    return index


class Segment:
    """A stored segment: sorted keys of term and position, and where each term's keys begin."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, postings: np.ndarray) -> None:
        self.terms, self.postings = terms, postings
        self.begin = np.r_[0, ends]
        self.size = int(postings.max()) + 2 * GAP if len(postings) else 1
        self.keys = np.repeat(np.arange(len(terms)), np.diff(self.begin)) * self.size + postings

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term in this segment, -1 where it does not occur."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def held(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term stands at each position."""
        wanted = term * self.size + position
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (position >= 0) & (self.keys[at] == wanted)


class Items:
    """A block of test items: what the segments are asked for."""

    def __init__(self, items: list[tuple], length: int) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.terms, self.flat, sizes = _numbered([t for _, t in items])
        self.owner = np.repeat(np.arange(len(items)), sizes)
        self.length = length

    def passages(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Begins (in ``flat``) of the passages whose terms all occur in the segment, and the terms of all words there."""
        known = segment.numbers(self.terms)[self.flat] if len(self.flat) else np.empty(0, np.int64)
        n = len(known) - self.length + 1
        if n <= 0:
            return np.empty(0, np.int64), known
        missing = np.r_[0, np.cumsum(known < 0)]
        begin = np.arange(n)
        return np.flatnonzero((missing[begin + self.length] == missing[begin]) & (self.owner[begin] == self.owner[begin + self.length - 1])), known


def exact_matches(items: Items, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
    """Passages (begins in the items) and the positions in the segment where they stand."""
    begin, known = items.passages(segment)
    passage = known[begin[:, None] + np.arange(items.length)]
    frequency = np.diff(segment.begin)[passage]
    rarity = np.argsort(frequency, axis=1, kind="stable")
    anchor = rarity[:, 0] if len(begin) else np.empty(0, np.int64)
    term = passage[np.arange(len(begin)), anchor]
    which, member = _expand(segment.begin[term], segment.begin[term + 1] - segment.begin[term])
    at = segment.postings[member] - anchor[which]
    for k in range(1, items.length):
        place = rarity[which, k]
        kept = segment.held(passage[which, place], at + place)
        which, at = which[kept], at[kept]
    return begin[which], at


def near_matches(items: Items, segment: Segment, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages whose words stand in order with at most ``slop`` other words between them, and where they begin."""
    begin, known = items.passages(segment)
    passage = known[begin[:, None] + np.arange(items.length)]
    frequency = np.diff(segment.begin)[passage]
    reach = items.length + slop
    rare = frequency.argmin(axis=1) if len(begin) else np.empty(0, np.int64)
    term = passage[np.arange(len(begin)), rare]
    which, member = _expand(segment.begin[term], segment.begin[term + 1] - segment.begin[term])
    seen = segment.postings[member]
    # Only first words that have the passage's rarest term at hand, within reach and not before its place.
    first = passage[which, 0] * segment.size
    low = np.searchsorted(segment.keys, first + np.maximum(seen - reach + 1, 0))
    high = np.searchsorted(segment.keys, first + np.maximum(seen - rare[which], -1), side="right")
    of, member = _expand(low, np.maximum(high - low, 0))
    pairs = np.unique(np.stack([which[of], segment.postings[member]], axis=1), axis=0)
    which, start = pairs[:, 0], pairs[:, 1]
    at = start
    for k in range(1, items.length):
        term = passage[which, k]
        found = np.searchsorted(segment.keys, term * segment.size + at + 1)
        inside = found < segment.begin[term + 1]
        at = segment.postings[np.minimum(found, len(segment.postings) - 1)]
        kept = inside & (at - start < reach)
        which, start, at = which[kept], start[kept], at[kept]
    return begin[which], start


def _searcher(shared, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for row in range(batch.num_rows):
                values = {c: column[c][row].values for c in column}
                starts = values["starts"].to_numpy()
                segment = Segment(*(values[c].to_numpy() for c in ("terms", "ends", "postings")))
                if not len(segment.keys):
                    continue
                begin, at = exact_matches(items, segment)
                exact = np.ones(len(begin), bool)
                if slop:
                    other = near_matches(items, segment, slop)
                    begin, at, exact = np.r_[begin, other[0]], np.r_[at, other[1]], np.r_[exact, np.zeros(len(other[0]), bool)]
                hits = np.unique(np.stack([np.searchsorted(starts, at, side="right") - 1, items.owner[begin], ~exact], axis=1), axis=0) if len(begin) else np.empty((0, 3), np.int64)
                hits = hits[np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(axis=1)]] if len(hits) else hits
                yield pa.RecordBatch.from_arrays([values["docs"].take(pa.array(hits[:, 0])), pa.array(items.ids[hits[:, 1]]), pa.array(hits[:, 2] == 0)], names=["_doc", "_item", "exact"])

    return search


def build_index(docs: DataFrame, doc_id: str, text: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index of all texts: docs, starts, terms, ends, postings, one row for each segment.

    Terms are 64-bit hashes of words. Null texts have no postings. The index is written when this is called, once.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").cast("string").alias("_text")).where("_text is not null")
    kind = rows.schema["_doc"].dataType.simpleString()
    return cut(rows.mapInArrow(_indexer(segment_bytes), f"docs array<{kind}>, starts array<bigint>, terms array<bigint>, ends array<bigint>, postings array<bigint>"))


def search_index(index: DataFrame, items: DataFrame, item_id: str, item_text: str, length: int = 10, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of a stored index that hold passages of the items: _doc, _item, exact; see ``leaked_items``."""
    if length + slop > GAP:
        raise ValueError(f"length and slop may be {GAP} words together")
    chosen = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    blocks = int((chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes) + 1
    kind = index.schema["docs"].dataType.elementType.simpleString()
    result = None
    for k in range(blocks):
        part = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        shared = index.sparkSession.sparkContext.broadcast(Items(sorted(map(tuple, part.collect())), length))
        found = index.mapInArrow(_searcher(shared, slop), f"_doc {kind}, _item bigint, exact boolean")
        result = found if result is None else result.unionAll(found)
    return result


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, length: int = 10, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold ``length`` or more consecutive words of an item: doc_id, item_id, exact; one row for each pair.

    Words are runs of letters and digits; case, combining marks and invisible format characters do not matter. With ``slop`` also
    passages with up to so many other words between the item's words, marked exact = false. Null, empty and shorter texts match
    nothing; every row of equal documents is reported; empty tables give no rows. Items whose id is null are not searched;
    ids are bigint. The documents are read once, to be indexed; of the items about ``block_bytes`` bytes of text are collected
    and sent to the segments at a time (as 16 bytes for each word), and each block is one scan of the index.
    """
    found = search_index(build_index(docs, doc_id, text), items, item_id, item_text, length, slop, block_bytes)
    return found.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "exact")
