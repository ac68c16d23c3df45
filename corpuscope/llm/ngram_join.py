"""Jaccard self-join on word 5-shingles with token-combination prefixes, and its components.

A document is the set of its shingles. Sets x and y link when 100 |x & y| >= 75 |x u y|; then at
most ``missing(x)`` shingles of x are not in y. Shingles have one global order, rare first: by how
often they and then their words occur, those in the *frequent* class last; both come from count
sketches over all documents. A prefix of that order is indexed: rare shingles one by one, frequent ones as
pairs within each of 64 subclasses. The prefix is extended until

    (rare shingles) + sum over subclasses of (its frequent shingles - 1)  >  missing(x)

so that whatever shingles are missing, two linked sets share an indexed token or pair: within
the shorter of two prefixes every shingle they share lies in both, more than ``missing`` would
have to go to break every single and leave at most one of each subclass. Subclasses need a
certain size for that, so sets below ``SHORT`` index frequent shingles one by one, and sets a
little above do both. An entry carries its *rank*, the left side of that sum before it. Two sets
of known sizes must share ``ceil(3 (|x| + |y|) / 7)`` shingles, so fewer can be missing than towards
the smallest partner: they are compared only if the rank of their entry is within that number in
both. What a set has for itself alone comes first in the order, so a set too far from all others
of its family meets none of them.

Candidates share an entry. An upper bound on the overlap from bitmaps drops most of the others,
the rest is verified on the whole sets. Entries with many sets do not give all pairs: the set
with the lowest rank, the one with the least of its own, is tested against all others, then two
more hubs against those not yet linked; afterwards only sets outside the largest component of
their entry meet the sets of other components. Equal sets
are one node throughout.

Shingles and sets are known by 64-bit hashes. Edge cases: fewer than five words make one shingle;
no words or null text make an empty set, linked with nothing; a null id has no part in
``component_id`` unless its component has no other; rows that repeat an id are separate rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.common import bytes_of, hold, in_slices, packed, release, whole_rows

#: Cells of the count sketches; a shingle is frequent when its cell has so many times the mean.
CELLS, FREQUENT = 1 << 20, 8
#: Subclasses of frequent shingles; sets smaller than SHORT index them singly.
SUBCLASSES, SHORT = 64, 96
#: Entries with at most so many sets give all their pairs; others work by a hub.
FEW = 6
#: Entries of a set that its rows carry along, so that a pair comes out of one of those it shares.
CARRIED = 32
#: Index entries per task, texts handled before a task hands on its entries.
ENTRIES, TEXTS = 1_000_000, 1000
#: Bits of the filter of needed documents for each of them, and at most; a full filter lets more texts be read into sets.
BITS_EACH, FILTER_BITS = 16, 1 << 28
#: Parts of a key that many rows share; sketches of so many tasks are added up together.
SALTS, PARTS, FAN = 32, 8, 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the 5-shingles, in order; one shingle for one to four words."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h)
    if n == 0:
        return h, h
    if n < 5:
        return h, _mix(np.array([(h * _ODD[:n]).sum() + np.uint64(n)], dtype=np.uint64))
    s = h[:n - 4] * _ODD[0]
    for j in range(1, 5):
        s += h[j:n - 4 + j] * _ODD[j]
    return h, _mix(s)


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit id of a sorted set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def bitmap(shingles: np.ndarray) -> bytes:
    """Marks of the shingles in the smallest power of two of at least two bits a shingle."""
    bits = np.zeros(max(64, 1 << (2 * len(shingles) - 1).bit_length()), np.uint8)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def can_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only if the bitmaps show that too many shingles of one set are missing in the other."""
    x, y = np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8))
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    both = min(na - int((x & (1 - y)).sum()), nb - int((y & (1 - x)).sum()))
    return 100 * both >= 75 * (na + nb - both)


SETS = "doc_id long, n int, set_id long, bits binary, sketch int, part int, cells binary"


def read_sets(docs: DataFrame) -> DataFrame:
    """Per document its set's size, id and bitmap; per task the blocks of both count sketches."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set_id", pa.int64()), ("bits", pa.binary()), ("sketch", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])
    block = 1 << 14

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * CELLS, np.uint32)
        for b in in_slices(batches, 2000):
            ids = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            out: dict[str, list] = {"doc_id": ids, "n": [], "set_id": [], "bits": []}
            gathered: list[np.ndarray] = []
            for t in texts:
                w, s = shingle_hashes(t)
                s = np.unique(s)
                out["n"].append(len(s))
                out["set_id"].append(set_id(s) if len(s) else None)
                out["bits"].append(bitmap(s) if len(s) else None)
                gathered += [(w >> np.uint64(44)).astype(np.int64), (s >> np.uint64(44)).astype(np.int64) + CELLS]
                if len(gathered) >= 4000:
                    counts += np.bincount(np.concatenate(gathered), minlength=2 * CELLS).astype(np.uint32)
                    gathered = []
            if gathered:
                counts += np.bincount(np.concatenate(gathered), minlength=2 * CELLS).astype(np.uint32)
            yield packed(out | {"sketch": [None] * len(ids), "part": [None] * len(ids), "cells": [None] * len(ids)}, schema)
        for first in range(0, 2 * CELLS, 16 * block):  # some blocks at a time
            places = range(first, min(first + 16 * block, 2 * CELLS), block)
            none = [None] * len(places)
            yield packed({"doc_id": none, "n": none, "set_id": none, "bits": none, "sketch": [i // block for i in places],
                          "part": [TaskContext.get().partitionId()] * len(places), "cells": [counts[i:i + block].astype(np.uint64).tobytes() for i in places]}, schema)

    return docs.mapInArrow(part, SETS)


def _sketches(held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level of each word cell, how common each shingle cell is, whether it is frequent): a byte a cell.

    A shingle is as common as its cell exceeds the mean, in half powers of two.
    """
    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c, np.uint64) for c in t.column("cells").to_pylist()], axis=0)
        return pa.table({"sketch": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    rows = held.filter("sketch is not null").select("sketch", "part", "cells")
    tasks = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > 1:  # a tree, so that no group has more than FAN blocks
        rows = rows.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).groupBy("sketch", "part").applyInArrow(add, "sketch int, part int, cells binary")
        tasks = -(-tasks // FAN)
    counts = np.zeros(2 * CELLS, np.uint64)
    for r in rows.collect():  # 16 MB
        counts[r["sketch"] << 14:(r["sketch"] + 1) << 14] = np.frombuffer(bytes(r["cells"]), np.uint64)
    words, shingles = counts[:CELLS], counts[CELLS:]
    level = np.round(4 * np.log2(words.astype(float) + 1)).astype(np.uint8)
    mean = max(shingles.mean(), 1.0)
    common = np.round(np.clip(2 * np.log2(np.maximum(shingles / mean, 1.0)), 0, 255)).astype(np.uint8)
    return level, common, shingles > FREQUENT * mean


def missing(n: int) -> int:
    """How many shingles of a set of n may be absent from a linked set."""
    return n - (3 * n + 3) // 4


def entries(shingles: np.ndarray, order: np.ndarray, frequent: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set in global order, and the rank of each."""
    need = missing(len(shingles))
    s, f = shingles[order], frequent[order]
    if short or not f.any():
        chosen = s[:need + 1]
        return (chosen if not short else _mix(chosen ^ np.uint64(0x5555))), np.arange(len(chosen))
    sub = ((s >> np.uint64(38)) & np.uint64(SUBCLASSES - 1)).astype(np.int64)
    gains = np.ones(len(s), np.int64)
    first_of: dict[int, int] = {}
    for i in np.flatnonzero(f).tolist():  # the first frequent shingle of a subclass gains nothing
        if sub[i] not in first_of:
            first_of[sub[i]] = i
            gains[i] = 0
    gained = np.cumsum(gains)
    end = int(np.searchsorted(gained, need + 1)) + 1
    before = gained - gains
    single = np.flatnonzero(~f[:end])
    out, ranks = [s[single]], [before[single]]
    for c in first_of:
        at = np.flatnonzero(f[:end] & (sub[:end] == c))
        if len(at) > 1:
            i, j = np.triu_indices(len(at), 1)
            low, high = np.minimum(s[at[i]], s[at[j]]), np.maximum(s[at[i]], s[at[j]])
            out.append(_mix(low * _ODD[1] + high * _ODD[2]))
            ranks.append(before[np.maximum(at[i], at[j])])
    return np.concatenate(out), np.concatenate(ranks)


def index(docs: DataFrame, level: np.ndarray, common: np.ndarray, hot: np.ndarray, buckets: int) -> DataFrame:
    """Index entries, dealt to buckets by their hash: arrays of (entry, set, its size, rank of the entry)."""
    schema = pa.schema([("bucket", pa.int32()), ("entry", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary()), ("ranks", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast((level, common, hot))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, common, hot = shared.value
        seen = set()
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                found, ids, sizes, ranks = [], [], [], []
                for t in b.column(1).slice(at, TEXTS).to_pylist():
                    w, s = shingle_hashes(t)
                    if not len(s):
                        continue
                    s, place = np.unique(s, return_index=True)
                    key = set_id(s)
                    if key in seen:
                        continue
                    seen.add(key)
                    lw = level[(w >> np.uint64(44)).astype(np.int64)].astype(np.int64)
                    ls = sum(lw[j:len(lw) - 4 + j] for j in range(5)) if len(w) >= 5 else np.array([lw.sum()])
                    cell = (s >> np.uint64(44)).astype(np.int64)
                    f = hot[cell]
                    order = np.lexsort((s, ls[place], common[cell], f))
                    n = len(s)
                    e = [entries(s, order, f, True)] if 3 * n < 4 * SHORT else []
                    if n >= SHORT:
                        e.append(entries(s, order, f, False))
                    found += [x for x, _ in e]
                    sizes += [np.full(len(x), n, np.int32) for x, _ in e]
                    ranks += [r.astype(np.int32) for _, r in e]
                    ids.append(np.full(sum(len(x) for x, _ in e), key, np.int64))
                if not found:
                    continue
                e, i, z, r = np.concatenate(found), np.concatenate(ids), np.concatenate(sizes), np.concatenate(ranks)
                bucket = (_mix(e) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                e, i, z, r = e[order], i[order], z[order], r[order]
                names, starts = np.unique(bucket[order], return_index=True)
                ends = np.append(starts[1:], len(e))
                yield packed({"bucket": names, "entry": [e[x:y].tobytes() for x, y in zip(starts, ends)], "sets": [i[x:y].tobytes() for x, y in zip(starts, ends)],
                              "sizes": [z[x:y].tobytes() for x, y in zip(starts, ends)], "ranks": [r[x:y].tobytes() for x, y in zip(starts, ends)]}, schema)

    return docs.mapInArrow(part, "bucket int, entry binary, sets binary, sizes binary, ranks binary")


def _fits(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b can link by an entry of these ranks in them."""
    need = (3 * (a + b) + 6) // 7
    return (np.minimum(a, b) >= need) & (ra <= a - need) & (rb <= b - need)


def shared_entries(indexed: DataFrame) -> DataFrame:
    """Pairs of sets that share an entry (entry null), and members of entries with many sets (b null)."""
    schema = pa.schema([("entry", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("rank", pa.int32())])

    def within(key: tuple, t: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])
        e, i, z, k = column("entry", np.uint64), column("sets", np.int64), column("sizes", np.int32), column("ranks", np.int32)
        order = np.lexsort((k, i, e))
        e, i, z, k = e[order], i[order], z[order], k[order]
        new = np.append(True, (e[1:] != e[:-1]) | (i[1:] != i[:-1]))  # the lowest rank of a set in an entry
        e, i, z, k = e[new], i[new], z[new], k[new]
        starts = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        counts = np.diff(np.append(starts, len(e)))
        a, b = [], []
        for m in range(2, FEW + 1):
            s = starts[counts == m]
            for x in range(m):
                for y in range(x + 1, m):
                    ok = _fits(z[s + x], k[s + x], z[s + y], k[s + y])
                    a.append(i[s + x][ok])
                    b.append(i[s + y][ok])
        many = counts > FEW
        size = counts[many]
        rows = np.repeat(starts[many] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if many.any() else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
        p, r = len(pairs), len(rows)
        return pa.table([pa.array(np.append(np.zeros(p, np.int64), e[rows].view(np.int64)), mask=np.append(np.ones(p, bool), np.zeros(r, bool))),
                         pa.array(np.append(pairs[:, 0], i[rows])), pa.array(np.append(pairs[:, 1], np.zeros(r, np.int64)), mask=np.append(np.zeros(p, bool), np.ones(r, bool))),
                         pa.array(np.append(np.zeros(p, np.int32), z[rows])), pa.array(np.append(np.zeros(p, np.int32), k[rows]))], schema=schema)

    return indexed.groupBy("bucket").applyInArrow(within, "entry long, a long, b long, size int, rank int")


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = [t.column(i).to_pylist() for i in range(6)]
            ok = pa.array([can_link(x, y, m, n) for x, y, m, n in zip(*c[2:])], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], schema=schema).filter(ok)

    one = sets.select(F.col("set_id").alias("a"), F.col("bits").alias("x"), F.col("n").alias("m"))
    two = sets.select(F.col("set_id").alias("b"), F.col("bits").alias("y"), "n")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(part, "a long, b long")


def whole_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(set_id, shingles) of the needed sets: ``needed`` has (set_id, doc_id) of one document of each.

    Tasks make sets only of documents in a Bloom filter, whose size is bounded.
    """
    count = needed.count()
    n_bits = min(FILTER_BITS, 1 << max(16, (BITS_EACH * count - 1).bit_length()))
    mask = n_bits - 1
    h = F.xxhash64("doc_id")
    bit = F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftright(h, 32).bitwiseAND(F.lit(mask))))
    rows = needed.select(bit.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v")).toArrow()  # at most FILTER_BITS bits
    bits = np.zeros(n_bits // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("set_id", pa.int64()), ("shingles", pa.binary())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            h = b.column(2).to_numpy()
            p, q = h & mask, (h >> 32) & mask
            wanted = ((bits[p >> 6] >> (p & 63)) & (bits[q >> 6] >> (q & 63)) & 1).astype(bool)
            texts = b.column(1).filter(pa.array(wanted))
            for at in range(0, len(texts), TEXTS):
                out: dict[str, list] = {"set_id": [], "shingles": []}
                for t in texts.slice(at, TEXTS).to_pylist():
                    s = np.unique(shingle_hashes(t)[1])
                    if len(s):
                        out["set_id"].append(set_id(s))
                        out["shingles"].append(s.tobytes())
                yield packed(out, schema)

    found = docs.select("doc_id", "text", h.alias("h")).mapInArrow(part, "set_id long, shingles binary")
    return found.join(needed.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by the whole sets of the documents; ``sets`` names a document of each set."""
    needed = hold(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().join(sets.select("set_id", "doc_id"), "set_id"))
    sets = whole_sets(docs, needed)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], schema=schema).filter(pa.array(ok, pa.bool_()))

    one, two = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(part, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a link: the smallest node that links reach.

    Every node takes the smallest root around it, then the root of its root, until nothing
    changes; the number of rounds grows with the logarithm of the longest path. Copies of a
    node's root needed by many links are made by a join on narrow rows that Spark can split.
    """
    both = hold(links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a")).distinct())
    roots = hold(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        around = both.join(roots.select(F.col("node").alias("near"), F.col("root").alias("r")), "near").groupBy("node").agg(F.min("r").alias("r"))
        lower = hold(roots.join(around, "node").select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")))
        jumped = hold(lower.join(lower.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
                      .select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "moved"))
        release(lower, roots)
        if not jumped.filter("moved").head(1):
            release(both)
            return jumped.select("node", "root")
        roots = jumped


def _distinct_entries(members: DataFrame) -> DataFrame:
    """Members of one entry of each member list, with their lowest ranks: what sets share of a passage gives many alike."""
    lists = members.groupBy("entry").agg(F.bit_xor(F.xxhash64("a", "size")).alias("x"), F.bit_xor(F.xxhash64("size", "a")).alias("y"), F.count("*").alias("n"))
    named = hold(lists.select("entry", F.xxhash64("x", "y", "n").alias("list")))
    return members.join(named, "entry").groupBy(F.col("list").alias("entry"), "a").agg(F.first("size").alias("size"), F.min("rank").alias("rank"))


def _meet(n: str, rank: str, other_n: str, other_rank: str) -> Column:
    """``_fits`` over columns."""
    need = F.floor((3 * (F.col(n) + F.col(other_n)) + 6) / 7)
    return (F.least(n, other_n) >= need) & (F.col(rank) <= F.col(n) - need) & (F.col(other_rank) <= F.col(other_n) - need)


def _dealt(members: DataFrame) -> DataFrame:
    """Members of an entry in parts, so that an entry of many sets is no single task."""
    return members.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int"))


def _everywhere(few: DataFrame) -> DataFrame:
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their component, of the entries that hold several components."""
    placed = members.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    still = placed.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("entry")
    return placed.join(still, "entry", "left_semi").select("entry", "a", "size", "rank", "root")


#: What the hub of an entry has the least of, round by round: first its rank, then a hash, so that entries of
#: the same sets have the same hub, and any set of a family is as likely as another.
HUBS = [lambda: F.struct("rank", -F.col("size"), "a"), lambda: F.struct(F.xxhash64("a"), "rank", "a"), lambda: F.struct(F.xxhash64("a", F.lit(7)), "rank", "a")]


def _hub_pairs(members: DataFrame, least: Column) -> DataFrame:
    """Pairs of the hub of each entry with its sets of other components."""
    hubs = members.groupBy("entry").agg(F.min_by(F.struct("a", "size", "rank", "root"), least).alias("h")).select(
        "entry", F.col("h.a").alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.rank").alias("hub_rank"), F.col("h.root").alias("hub_root"))
    met = _dealt(members).join(_everywhere(hubs), ["entry", "salt"]).filter((F.col("root") != F.col("hub_root")) & _meet("size", "rank", "hub_size", "hub_rank"))
    return met.select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")).distinct()


def _apart_rows(members: DataFrame) -> DataFrame:
    """Pairs of each entry's sets outside its largest component with its sets of other components.

    Sets of a family share most of their entries. A pair is left out of an entry if an earlier one
    that both carry gives it, so only what neither carries can give it again.
    """
    own = members.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("entry", "rank"))), 1, CARRIED).alias("own"))
    counts = members.groupBy("entry", "root").agg(F.count("*").alias("k"))
    largest = counts.groupBy("entry").agg(F.max(F.struct("k", "root")).alias("m")).select("entry", F.col("m.root").alias("main"))
    rows = members.join(own, "a")
    few = rows.join(largest, "entry").filter("root != main").select(
        "entry", "main", F.col("a").alias("b"), F.col("size").alias("b_size"), F.col("rank").alias("b_rank"), F.col("root").alias("b_root"), F.col("own").alias("b_own"))
    need = F.floor((3 * (F.col("size") + F.col("b_size")) + 6) / 7)
    earlier = F.exists("own", lambda x: (x["entry"] < F.col("entry")) & (x["rank"] <= F.col("size") - need) & F.exists(
        "b_own", lambda y: (y["entry"] == x["entry"]) & (y["rank"] <= F.col("b_size") - need)))
    once = (F.col("root") == F.col("main")) | (F.col("a") < F.col("b"))  # two sets outside meet from both sides
    met = _dealt(rows).join(_everywhere(few), ["entry", "salt"]).filter(
        (F.col("root") != F.col("b_root")) & once & _meet("size", "rank", "b_size", "b_rank") & ~earlier)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links_and_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their set ids, (node, root) of the sets that link with another set)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), bytes_of(text).alias("text"))
    read = hold(read_sets(rows))
    per_doc = read.filter("sketch is null").select("doc_id", "n", "set_id", "bits")
    level, common, hot = _sketches(read)
    total = per_doc.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = hold(shared_entries(index(rows, level, common, hot, max(12, int(0.3 * total) // ENTRIES + 1))))
    sets = per_doc.filter("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("doc_id").alias("doc_id"))
    members = hold(_distinct_entries(found.filter("b is null").select("entry", "a", "size", "rank")))
    links = roots = None
    still = members.withColumn("root", F.col("a"))
    for step in [*HUBS, None]:
        pairs = _apart_rows(still).distinct() if step is None else _hub_pairs(still, step())
        if links is None:
            pairs = pairs.union(found.filter("b is not null").select("a", "b")).distinct()
        some = hold(_bounded(pairs, sets))
        if links is None or some.head(1):
            more = hold(verified(some, rows, sets))
            links = more if links is None else links.union(more)
            roots = components(links)
        release(some)
        if step is not None:
            left = hold(_open(members, roots))
            release(still)
            still = left
            if not still.head(1):
                break
    release(found, members, still)
    return per_doc.select("doc_id", "n", "set_id"), roots


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Many rows may share a set, so rows meet their component by set and salt.
    """
    per_doc, roots = links_and_sets(docs, doc_id, text)
    salted = per_doc.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = salted.filter("n > 0").groupBy("set_id", "salt").agg(F.min("doc_id").alias("low"))
    nodes = parts.groupBy("set_id").agg(F.min("low").alias("low"), F.collect_list("salt").alias("salts"))
    rooted = nodes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_set = rooted.join(lowest, "root").select("set_id", "component_id", F.explode("salts").alias("salt"))
    full = salted.filter("n > 0").join(of_set, ["set_id", "salt"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = per_doc.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that have the smallest id of their component, with all their columns.

    Rows without an id stay; rows that share an id go or stay together.
    """
    gone = ngram_components(docs, doc_id, text).filter("doc_id != component_id").select(F.col("doc_id").alias("gone"))
    return whole_rows(docs, id=F.col(doc_id)).join(gone, F.col("id") == F.col("gone"), "left_anti").select("_doc.*")
