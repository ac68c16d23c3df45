"""Packing of tokenised documents into windows of fixed length: best-fit decreasing.

Every task tokenises its documents, cuts full windows from the front of each and packs the
remainders of a block of documents by best-fit decreasing. A segment tree over the remaining
capacities 1 .. window finds the tightest open window that still holds a piece. Nothing is
shuffled; window numbers carry the partition, which a retried task has again.

Edge cases: a null or empty text is one piece with only the end id; a null id stays null; rows
that repeat an id are packed each on its own; an empty table gives no rows.
"""
from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import in_slices, packed, text_of

WINDOW, END_ID = 2048, 1
#: Remainders packed together, which bounds a task's memory.
BLOCK = 1 << 17
#: Words whose ids are remembered by a task.
MEMORY = 400_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity; the tree holds the number of windows below each node."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list] = [[] for _ in range(self.size)]

    def add(self, capacity: int, item) -> None:
        self.at[capacity].append(item)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int):
        """Remove and return (capacity, item) of the smallest capacity that is at least ``need``."""
        node, count = need + self.size, self.count
        while not count[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[tuple[int, int]], int]:
    """(window number, offset) of each piece, and how many windows were opened."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    opened, windows = 0, OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = windows.tightest(n)
        if found is None:
            free, number = window, opened
            opened += 1
        else:
            free, number = found
        out[i] = (number, window - free)
        if free > n:
            windows.add(free - n, number)
    return out, opened


class _Blank(Exception):
    """A piece of a text has blanks of its own."""


class _Known(dict):
    """Ids of pieces that follow a space, remembered up to a bound."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Blank
        if len(self) >= MEMORY:
            self.clear()
        ids = self[piece] = self.encode(" " + piece)
        return ids


class WordIds:
    """Token ids of a text as little-endian 32-bit numbers.

    The pre-tokeniser never joins what lies on both sides of a single space between other
    characters, except that the space goes with what follows. So texts are cut there, and the
    ids of each piece are remembered; texts with other runs of blanks are encoded whole.

    ``added`` has the ids of tokens found before all else: what lies between them is encoded by itself.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.whole)
        self.added = {t: i.to_bytes(4, "little") for t, i in (added or {}).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def whole(self, text: str) -> bytes:
        ids = self.encoding.encode_ordinary(text)  # does not look for special tokens, of which there are none, at every character
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added[t] if k % 2 else self.between(t) for k, t in enumerate(self.split(text)))
        return self.between(text)

    def between(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.known.__getitem__, rest))
        except _Blank:
            return self.whole(text)


def added_tokens(tokenizer: str) -> dict[str, int]:
    """Ids of the added tokens of the JSON file of the same name, which ``tokenizers`` finds inside texts."""
    import public_tokenizers
    with open(public_tokenizers.path(tokenizer.rsplit(".", 1)[0] + ".json"), encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError(f"added tokens of {tokenizer} take in or need characters beside them")
    return {t["content"]: t["id"] for t in tokens}


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
         tokenizer: str = "byte_bpe_50k.tiktoken", block: int = BLOCK, find_added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` names a public vocabulary of ranks, whose ids are those of the JSON file of the
    same name read by ``tokenizers`` (tests hold them against each other): with ``find_added`` as
    it reads texts unless told otherwise, <|endoftext|> in a text being one id; without, as with its
    ``encode_special_tokens``, all text being plain. The query and the pipeline find them. The ids
    stay in the task; a caller that wants them stored encodes the rows of a sequence again by ``start``.
    """
    added = added_tokens(tokenizer) if find_added else {}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        words = WordIds(public_tokenizers.path(tokenizer), public_tokenizers.PATTERN, added)
        end = end_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 36
        rests: list[tuple] = []
        out: dict[str, list] = {f.name: [] for f in SCHEMA}

        def put(*row) -> None:
            for column, v in zip(out.values(), row):
                column.append(v)

        def flush() -> int:
            places, opened = best_fit_decreasing([r[2] for r in rests], window)
            for row, (w, at) in zip(rests, places):
                put(*row, number + w, at)
            rests.clear()
            return opened

        for b in batches:
            for key, t in ((key, t) for s in in_slices([b]) for key, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist())):
                ids = words.of(t) + end
                n = len(ids) // 4
                view = memoryview(ids)
                for start in range(0, n - window + 1, window):
                    put(key, start, window, zlib.crc32(view[4 * start:4 * (start + window)]), n, number, 0)
                    number += 1
                start = n - n % window
                if start < n:
                    rests.append((key, start, n - start, zlib.crc32(view[4 * start:]), n))
            if len(rests) >= block:
                number += flush()
            if out["doc_id"]:
                yield packed(out, SCHEMA)
                for column in out.values():
                    column.clear()
        flush()
        yield packed(out, SCHEMA)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(part, DDL)
