"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

Texts are compared as bytes, ASCII lower case, runs of ASCII white space as one blank. Every
item is cut into windows of about 100 bytes, and a window of m bytes is found where a region of a
text is within  e = 0.08 m  edits. By the q-gram lemma such a region shares at least
m - q + 1 - q e  q-grams with the window, on diagonals no more than e apart. So shared q-grams
are counted in overlapping diagonal bands, twice as wide as e at least and half overlapping; bands
with enough of them are verified by an alignment within the band. A window's most common q-grams
are not counted, and as many fewer are asked of a band, so nothing is lost by it.

Items are sent to the tasks in blocks of bounded size; each block is one pass over the documents.

Edge cases: null and empty texts and items match nothing, nor do items of fewer than q bytes;
equal items are each reported; rows that repeat an id are reported once for each item.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import bytes_of, in_slices, packed

#: Length of q-grams, window length and step, edits per byte of a window, width of a band.
Q, WINDOW, STEP, EDITS, BAND = 8, 100, 50, 0.08, 32
#: Shared q-grams asked of a band at least: what a window has to share beyond is spent on leaving
#: its q-grams that most windows have out of the index.
ASKED = 6
#: Bytes of items sent to the tasks at a time; bytes of documents looked at together, and whose
#: q-grams a task has as numbers at a time.
BLOCK_BYTES, TEXT_BYTES, CODED = 16_000_000, 4_000_000, 1 << 18
_FILTER = 20


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def windows(item: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """The whole item up to size + step / 2 bytes, else windows of ``size``, the last flush with the end."""
    if len(item) <= size + step // 2:
        return [item] if len(item) >= Q else []
    starts = [*range(0, len(item) - size, step), len(item) - size]
    return [item[s:s + size] for s in starts]


def budget(m: int) -> int:
    """Edits allowed to a window of m bytes: few enough for at least one shared q-gram."""
    return max(0, min(int(EDITS * m), (m - Q) // Q, BAND // 2 - 1))


def codes(a: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each byte, as a 64-bit number."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    two = a[:-1].astype(np.uint64) | a[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def _slot(c: np.ndarray) -> np.ndarray:
    return (c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _FILTER)).astype(np.int64)


class Patterns:
    """Windows of the items, and their q-grams sorted by code."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item, self.text = [], []
        for key, t in items:
            for w in windows(t):
                self.item.append(key)
                self.text.append(np.frombuffer(w, np.uint8))
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([budget(m) for m in self.length.tolist()], np.int64)
        self.need = self.length - Q + 1 - Q * self.edits
        each = [codes(t) for t in self.text]
        code = np.concatenate(each) if each else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(each)), [len(c) for c in each])
        at = np.concatenate([np.arange(len(c)) for c in each]) if each else np.zeros(0, np.int64)
        _, kind, often = np.unique(code, return_inverse=True, return_counts=True)
        # within a window the most common q-grams come first; those are left out of the index
        order = np.lexsort((at, -often[kind], owner))
        spare = np.maximum(self.need - ASKED, 0)
        starts = np.cumsum([0, *(len(c) for c in each)])[:-1]
        rank = np.arange(len(code)) - np.repeat(starts, [len(c) for c in each])
        order = order[rank >= spare[owner[order]]] if len(order) else order
        self.need = self.need - spare
        code, owner, at = code[order], owner[order], at[order]
        order = np.argsort(code, kind="stable")
        self.owner, self.at = owner[order], at[order]
        self.code, self.first = np.unique(code[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(code)))
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[_slot(self.code)] = True

    def shared(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the q-gram) of every q-gram of the index in the text."""
        wheres, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(text) if len(self.code) else 0, CODED):
            c = codes(text[at:at + CODED + Q - 1])
            where = np.flatnonzero(self.filter[_slot(c)])
            place = np.minimum(np.searchsorted(self.code, c[where]), len(self.code) - 1)
            same = self.code[place] == c[where]
            wheres.append(where[same] + at)
            places.append(place[same])
        return np.concatenate(wheres), np.concatenate(places)

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal) of the bands with enough shared q-grams."""
        where, place = self.shared(text)
        if not len(where):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = self.count[place]
        rows = np.repeat(self.first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, diagonal = self.owner[rows], np.repeat(where, n) - self.at[rows] + WINDOW * 2
        half = BAND // 2
        steps = (len(text) + 4 * WINDOW) // half + 2
        block = owner * steps + diagonal // half  # half bands; a band is one and the next
        kinds, hits = np.unique(block, return_counts=True)
        after = np.searchsorted(kinds, kinds + 1)
        follows = (after < len(kinds)) & (kinds[np.minimum(after, len(kinds) - 1)] == kinds + 1)
        total = hits + np.where(follows, hits[np.minimum(after, len(kinds) - 1)], 0)
        before = np.setdiff1d(kinds - 1, kinds)  # bands whose first half has no hit
        kinds = np.concatenate([kinds, before])
        total = np.concatenate([total, hits[np.searchsorted(kinds[:len(hits)], before + 1)]])
        keep = total >= self.need[kinds // steps]
        kinds = kinds[keep]
        return kinds // steps, (kinds % steps) * half - WINDOW * 2

    def distances(self, text: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits between each window and a part of the text in its band, and where that part ends.

        Column j of row i stands for text position diagonal + i + j; rows are the window's bytes.
        """
        best, end = np.full(len(window), 1 << 20), np.zeros(len(window), np.int64)
        width = BAND + 1
        for m in np.unique(self.length[window]).tolist():
            for rows in np.array_split(some := np.flatnonzero(self.length[window] == m), len(some) // 5000 + 1):
                pattern = np.stack([self.text[w] for w in window[rows]])
                place = diagonal[rows, None] + np.arange(m + width)[None, :]
                inside = (place >= 0) & (place < len(text))
                region = np.where(inside, text[np.clip(place, 0, len(text) - 1)], 0)
                step = np.arange(width)
                d = np.zeros((len(rows), width), np.int64)
                for i in range(m):
                    match = d + (region[:, i:i + width] != pattern[:, i:i + 1])
                    match[:, :-1] = np.minimum(match[:, :-1], d[:, 1:] + 1)
                    d = np.minimum.accumulate(match - step, axis=1) + step
                best[rows] = d.min(1)
                end[rows] = diagonal[rows] + m + d.argmin(1)
        return best, end


def look(patterns: Patterns, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, window, edits, end in the normalised text) of every found window."""
    gap = b"\x00" * (2 * BAND)  # no alignment within the budget crosses it
    whole = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    starts = np.cumsum([len(gap), *(len(t) + len(gap) for t in texts[:-1])])
    window, diagonal = patterns.candidates(whole)
    edits, end = patterns.distances(whole, window, diagonal)
    ok = edits <= patterns.edits[window]
    window, edits, end = window[ok], edits[ok], end[ok]
    doc = np.searchsorted(starts, end - 1, side="right") - 1
    return doc, window, edits, end - starts[doc]


def in_chunks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, normalised texts) of runs of texts of bounded size."""
    first, some, size = 0, [], 0
    for t in texts:
        some.append(normal(t))
        size += len(some[-1])
        if size >= TEXT_BYTES:
            yield first, some
            first, some, size = first + len(some), [], 0
    if some:
        yield first, some


FOUND = "doc_id long, item_id long, edits int, at long"


def matches(docs: DataFrame, items: list[tuple[int, bytes]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each found window: doc_id, item_id, edits, and where it ends in the normalised text."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("at", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(shared.value)
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, some in in_chunks(t.as_py() for t in b.column(1)):
                doc, window, edits, at = look(patterns, some)
                yield packed({"doc_id": [keys[first + i] for i in doc], "item_id": [patterns.item[w] for w in window], "edits": edits, "at": at}, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), bytes_of(text).alias("text")).mapInArrow(part, FOUND)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size."""
    good = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    volume = good.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = int(volume) // BLOCK_BYTES + 1
    for k in range(blocks):
        own = good if blocks == 1 else good.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r["item_id"], normal(bytes(r["text"]))) for r in own.collect()]


def find_passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, edits (fewest) and first_end of every document and item that share a window."""
    found = None
    for items in item_blocks(benchmark):
        part = matches(docs, items, doc_id, text)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.min("edits").alias("edits"), F.min("at").alias("first_end"))


def without_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no passage of the benchmark is found, with all their columns, in their own tasks."""
    at = docs.columns.index(text)
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = Patterns(shared.value)
            for b in in_slices(batches, 1000):
                clean = np.ones(b.num_rows, bool)
                for first, some in in_chunks((t.as_py() or "").encode() for t in b.column(at)):
                    clean[first + look(patterns, some)[0]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(part, docs.schema)
    return docs
