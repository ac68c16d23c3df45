"""Packing of tokenised documents into few sequences by linear grouping.

Documents longer than a sequence are cut into full pieces behind a first, shorter one; full pieces
are sequences by themselves. Of the others only the number of each length, a bounded table, is
looked at in one place: the large lengths, in falling order, fall into groups of equal cardinality and
are rounded up to the longest of their group; with so few sizes, the best mix of configurations
(how many of each size a sequence takes) is a linear program, solved by column generation: a basis
of as many configurations as sizes, and a knapsack over the duals that finds the next one. Its
whole part and a best-fit packing of the few sizes left over give the number of each configuration.

Then the documents take the places: a document's rank in its group names its configuration, the
sequence among those of that configuration and the place in it. Ranks come from numbers within
task and length and the counts of (task, length). Sequences and small documents are dealt evenly
to shards of bounded size, where small documents go, longest first, to the sequence with the
least room that holds them: room that rounding left is used, too.

Edge cases: a null or empty text is one piece with only the end id; a null id stays null; rows
that repeat an id are packed each on its own; an empty table gives no rows; other columns are not
read.
"""
from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.llm.common import hold, packed, release, text_of
from corpuscope.llm.packing import WordIds, added_tokens

WINDOW, END_ID = 1024, 2
#: Sizes after rounding; lengths up to this share of a sequence are small.
GROUPS, SMALL = 192, 4
#: How far from the optimum the linear program may stop, and after how many steps at most; neither changes what is packed.
GAP, STEPS = 2e-4, 10_000
#: Pieces of a shard, which bounds a task of the last step.
SHARD = 1 << 15
#: Sequences of full pieces are numbered from here on, those opened by small documents from half of it.
FULL = 1 << 62
#: Pieces whose ids a task remembers; marks that may follow a word, and the first letter that is not taken for Latin.
REMEMBERED, MARKS, BEYOND_LATIN = 600_000, ".,;:!?%&#$*", "\u0250"
PIECES = pa.schema([("task", pa.int32()), ("local", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "task int, local long, doc_id long, piece int, start long, length long, ids_crc32 long"
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class _Odd(Exception):
    """A piece between spaces that cannot be encoded by itself."""


class _Known(dict):
    """Token ids of pieces with the space before them.

    A word of Latin letters is one match of the pre-tokeniser, marks behind it are the next one.
    """

    def __init__(self, encoding):
        super().__init__()
        self.encoding, self.marks = encoding, {}

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        if len(self) >= REMEMBERED:
            self.clear()
        word = piece.rstrip(MARKS)
        if not (word.isalpha() and (word.isascii() or max(word) < BEYOND_LATIN)):
            ids = array("I", self.encoding.encode_ordinary(" " + piece)).tobytes()
        elif len(word) == len(piece):
            ids = array("I", self.encoding._encode_single_piece(" " + piece)).tobytes()
        else:
            tail = piece[len(word):]
            if tail not in self.marks:
                if len(self.marks) >= REMEMBERED:
                    self.marks.clear()
                self.marks[tail] = array("I", self.encoding._encode_single_piece(tail)).tobytes()
            ids = self[word] + self.marks[tail]
        self[piece] = ids
        return ids


class PieceIds(WordIds):
    """Ids of texts as in ``WordIds``, looked up without a step of Python for each piece."""

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are written as little-endian 32-bit numbers")
        super().__init__(path, pattern, added)
        self.known = _Known(self.encoding)

    def between(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.known.__getitem__, rest))
        except _Odd:
            return self.whole(text)


def cut_pieces(docs: DataFrame, doc_id: str, text: str, window: int, end_id: int, tokenizer: str, find_added: bool) -> DataFrame:
    """The pieces of all documents, numbered within task and length."""
    added = added_tokens(tokenizer) if find_added else {}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        words = PieceIds(public_tokenizers.path(tokenizer), public_tokenizers.PATTERN, added)
        end, task = end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                view = memoryview(words.of(t) + end)
                n = len(view) // 4
                at = 0
                for piece in range(-(-n // window)):
                    length = n - (-(-n // window) - 1) * window if piece == 0 else window
                    for column, v in zip(out.values(), (task, seen[length], key, piece, at, length, zlib.crc32(view[4 * at:4 * (at + length)]))):
                        column.append(v)
                    seen[length] += 1
                    at += length
            yield packed(out, PIECES)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(f"`{text}`").alias("text")).mapInArrow(part, PIECES_DDL)


def knapsack(sizes: np.ndarray, values: np.ndarray, window: int) -> np.ndarray:
    """The configuration of the greatest value; any number of each size.

    Room below the least size is decided at once: what fits there was decided before.
    """
    least = int(sizes.min())
    best, took = np.zeros(window + 1), np.full(window + 1, -1)
    for c in range(least, window + 1, least):
        rooms = np.arange(c, min(c + least, window + 1))
        before = rooms[None, :] - sizes[:, None]
        value = np.where(before >= 0, best[np.maximum(before, 0)] + values[:, None], -1.0)
        which = value.argmax(axis=0)
        value = value[which, np.arange(len(rooms))]
        reached = np.maximum.accumulate(np.append(best[c - 1], value))
        best[rooms] = reached[1:]
        took[rooms] = np.where(value > reached[:-1], which, -1)  # -1: as good with one token less
    out, room = np.zeros(len(sizes), np.int64), window
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            out[took[room]] += 1
            room -= int(sizes[took[room]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, window: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(configurations as columns, how often each is used, with fractions) within ``gap`` of the linear program's optimum."""
    base = np.diag(window // sizes).astype(float)
    inverse, used = np.linalg.inv(base), demand / np.diag(base)
    for step in range(STEPS):
        prices = inverse.sum(axis=0)
        column = knapsack(sizes, prices, window).astype(float)
        if column @ prices <= 1 + gap:  # the optimum is at least the present value over this
            break
        change = inverse @ column
        can = change > 1e-9
        ratio = np.where(can, used / np.where(can, change, 1), np.inf)
        leaves = int(np.argmin(ratio))
        used = np.maximum(used - ratio[leaves] * change, 0)
        used[leaves] = ratio[leaves]
        base[:, leaves] = column
        if step % 64 == 63:
            inverse = np.linalg.inv(base)
        else:
            row = inverse[leaves] / change[leaves]
            inverse = inverse - np.outer(change, row)
            inverse[leaves] = row
    return base.astype(np.int64), used


def best_fit(lengths: list[int], room: list[int], window: int) -> list[int]:
    """A sequence for each length: the one with the least room that holds it, or a new one. ``room`` is kept."""
    at: list[list[int]] = [[] for _ in range(window + 1)]
    open_rooms = 0  # bit r is set while a sequence has room for r
    for i, r in enumerate(room):
        at[r].append(i)
        open_rooms |= 1 << r
    out = []
    for n in lengths:
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            i = at[r].pop()
            if not at[r]:
                open_rooms ^= 1 << r
        else:
            i, r = len(room), window
            room.append(window)
        r -= n
        room[i] = r
        at[r].append(i)
        open_rooms |= 1 << r
        out.append(i)
    return out


class Seats:
    """Where each large piece goes, by its rank among the large ones, longest first."""

    def __init__(self, counts: np.ndarray, window: int, groups: int):
        self.above = np.append(np.cumsum(counts[::-1])[::-1][1:], 0)  # pieces longer than each length
        large = int(counts.sum())
        self.cardinality = max(1, -(-large // groups))
        firsts = np.arange(0, large, self.cardinality)
        self.sizes = window - np.searchsorted(np.cumsum(counts[::-1]), firsts, side="right")
        demand = np.minimum(self.cardinality, large - firsts)
        self.table, self.number = np.zeros((0, len(firsts)), np.int64), np.zeros(0, np.int64)
        if large:
            base, used = configurations(self.sizes, demand.astype(float), window)
            times = np.floor(used + 1e-9).astype(np.int64)
            for p in np.argsort(-times):  # rounding errors must not use more of a size than there is
                over = [int((demand[g] - base[g] @ times + base[g, p] * times[p]) // base[g, p]) for g in np.flatnonzero(base[:, p])]
                times[p] = max(0, min([times[p], *over]))
            left = demand - base @ times
            rest = np.repeat(np.arange(len(firsts)), left)
            places = np.array(best_fit(self.sizes[rest].tolist(), [], window), np.int64)
            more = np.zeros((places.max(initial=-1) + 1, len(firsts)), np.int64)
            np.add.at(more, (places, rest), 1)
            keep = times > 0
            self.table = np.concatenate([base.T[keep], more])
            self.number = np.concatenate([times[keep], np.ones(len(more), np.int64)])
        self.first_sequence = np.append(0, np.cumsum(self.number))
        taken = self.table * self.number[:, None]
        self.first_rank = np.concatenate([np.zeros((1, taken.shape[1]), np.int64), np.cumsum(taken, axis=0)])

    @property
    def sequences(self) -> int:
        return int(self.first_sequence[-1])

    def of(self, rank: np.ndarray) -> np.ndarray:
        """Sequence numbers of large pieces by rank."""
        group, within = rank // self.cardinality, rank % self.cardinality
        out = np.empty(len(rank), np.int64)
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            p = np.searchsorted(self.first_rank[:, g], within[rows], side="right") - 1
            out[rows] = self.first_sequence[p] + (within[rows] - self.first_rank[p, g]) // self.table[p, g]
        return out


def pack_grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
                 tokenizer: str = "byte_bpe_50k.tiktoken", groups: int = GROUPS, small: int | None = None, shard: int = SHARD,
                 find_added: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``small`` is the longest length that is fitted in after the others (a quarter of the window by
    default). ``tokenizer`` names a file of ranks and ``find_added`` says whether tokens that the JSON
    file of the same name adds are found inside texts, as ``tokenizers`` does.
    """
    small = window // SMALL if small is None else small
    pieces = hold(cut_pieces(docs, doc_id, text, window, end_id, tokenizer, find_added))
    part_full = pieces.filter(F.col("length") >= window)
    open_pieces = pieces.filter(F.col("length") < window)
    counted = hold(open_pieces.groupBy("task", "length").agg(F.max("local").alias("last")))
    counts = np.zeros(window + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n")).collect():  # at most ``window`` rows
        counts[r["length"]] = r["n"]
    total = int(counts.sum())
    seats = Seats(np.where(np.arange(window + 1) > small, counts, 0), window, groups)
    longer = np.append(np.cumsum(counts[::-1])[::-1][1:], 0)
    shards = max(1, -(-total // shard))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("task", "length", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = open_pieces.join(offsets, ["task", "length"]).select(*columns, (F.col("before") + F.col("local")).alias("rank"))
    schema = pa.schema([*(PIECES.field(c) for c in columns), ("sequence", pa.int64()), ("shard", pa.int32())])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            large = length > small
            sequence = np.full(len(rank), -1, np.int64)
            rank = rank + longer[length]
            if large.any():
                sequence[large] = seats.of(rank[large])
            place = np.where(large, sequence, rank) % shards
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(place, pa.int32())], schema=schema)

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        number = key[0].as_py()
        length, sequence = t.column("length").to_numpy(), t.column("sequence").to_numpy()
        order = np.lexsort((t.column("start").to_numpy(), t.column("ids_crc32").to_numpy(), -length, sequence))
        order = np.concatenate([order[sequence[order] >= 0], order[sequence[order] < 0]])
        length, sequence = length[order], sequence[order]
        n_large = int((sequence >= 0).sum())
        names, own = np.unique(sequence[:n_large], return_inverse=True)
        room = (window - np.bincount(own, weights=length[:n_large], minlength=len(names)).astype(np.int64)).tolist()
        given = best_fit(length[n_large:].tolist(), room, window)
        opened = np.arange(len(room) - len(names), dtype=np.int64) * shards + number + (FULL >> 1)
        local = np.concatenate([own, np.array(given, np.int64)])
        by = np.argsort(local, kind="stable")
        ends = np.cumsum(length[by])
        new = np.append(True, local[by][1:] != local[by][:-1])
        offset = np.empty(len(by), np.int64)
        starts = ends - length[by]
        offset[by] = starts - np.maximum.accumulate(np.where(new, starts, 0))
        out = t.select(columns).take(pa.array(order))
        return out.append_column("sequence_id", pa.array(np.concatenate([names, opened])[local], pa.int64())).append_column("offset", pa.array(offset))

    filled = ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence long, shard int").groupBy("shard").applyInArrow(fill, DDL)
    whole = part_full.select(*columns, (F.lit(FULL) + F.call_function("shiftleft", F.col("task").cast("long"), F.lit(36)) + F.col("local")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return filled.unionByName(whole)
