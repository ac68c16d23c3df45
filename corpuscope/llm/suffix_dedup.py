"""Removal of repeated byte strings by difference-cover sampling of suffixes.

A byte goes when it lies in a string of ``length`` bytes that starts at a second place too. Only
the first ``length`` bytes of a suffix matter, so suffixes are sorted to that depth:

1. *Sampled triples.* Positions whose residue modulo v lies in a difference cover D are sampled:
   any two suffixes have a shift below v at which both are sampled. A sampled suffix is named by
   the triple of its next three blocks of ``block`` bytes. Names are sorted in hash ranges, and
   suffixes with a name of their own are left out of everything that follows: no longer prefix
   of them can repeat.
2. *Recursion on names.* The rest are named again, by all bytes that a string through them can
   reach. Equal second names settle all those strings at once; a first name with one second name
   only needs no more.
3. *Remaining suffixes.* Between different second names under one first name, the suffixes up to
   v - 1 before the sampled one are merged in: each is sorted by first name, distance and its
   ``length``-byte prefix, and neighbours with equal prefixes are repeated. First names that very
   many second names share are merged by a Spark aggregation instead of inside a task.

Names are 64-bit fingerprints instead of dense ranks, so that blocks of bytes can be named where
they are read; the cover has a large v, so that few positions are sampled (18 of 307).

Equal texts are one node. Edge cases: null text is empty; a text shorter than ``length`` loses
nothing; the copies of a text of at least ``length`` bytes lose everything; rows that repeat an
id are separate rows, and a null id stays null.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import bytes_of, hold, packed, release

LENGTH = 400
#: Prime of the cover: v = q * q + q + 1, of which q + 1 residues are sampled.
COVER_PRIME = 17
#: Sampled suffixes, and contexts, that a task sorts together; second names from which Spark merges.
SORTED, CONTEXTS, MANY = 1_000_000, 4000, 2000
#: Texts handled before a task hands on its names; bits of the filter of texts with repeats.
TEXTS, FILTER_BITS = 1000, 1 << 24
SALTS = 32


def difference_cover(q: int) -> tuple[int, list[int]]:
    """(v, D) for a prime q, by Singer: powers of a generator of GF(q^3) that lie in a plane."""
    v, order = q * q + q + 1, q**3 - 1
    primes = [p for p in range(2, order + 1) if order % p == 0 and all(p % d for d in range(2, int(p**0.5) + 1))] if order < 20_000 else []

    def times(a, b, c):
        r = [sum(a[i] * b[k - i] for i in range(3) if 0 <= k - i < 3) for k in range(5)]
        for k in (4, 3):
            for t in range(3):
                r[k - 3 + t] += r[k] * c[t]
        return tuple(x % q for x in r[:3])

    def power(e, c):
        r, x = (1, 0, 0), (0, 1, 0)
        while e:
            r, x, e = times(r, x, c) if e & 1 else r, times(x, x, c), e >> 1
        return r

    for c in itertools.product(range(q), repeat=3):
        if c[0] and power(order, c) == (1, 0, 0) and all(power(order // p, c) != (1, 0, 0) for p in primes):
            at, out = (1, 0, 0), []
            for i in range(v):
                if at[2] == 0:
                    out.append(i)
                at = times(at, (0, 1, 0), c)
            return v, out
    raise ValueError("q must be a prime")


class Fingerprints:
    """Fingerprints of substrings from running sums over bytes, modulo 2**64."""

    base = 0x9E3779B97F4A7C15

    def __init__(self):
        self.byte = np.random.default_rng(11).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.zeros(0, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.full(n, self.base, np.uint64))
            self.down = np.cumprod(np.full(n, pow(self.base, -1, 1 << 64), np.uint64))

    def sums(self, a: np.ndarray) -> np.ndarray:
        self.grow(len(a) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[a] * self.up[:len(a)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[start])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Shape:
    """Sizes that follow from the string length and the cover."""

    def __init__(self, length: int, prime: int):
        self.length = length
        while prime > 2 and prime * prime + prime + 1 > length - 2:
            prime = max(p for p in range(2, prime) if all(p % d for d in range(2, p)))
        self.v, cover = difference_cover(prime)
        self.block = (length - self.v + 1) // 3
        if self.block < 1:
            raise ValueError("length is too small for a difference cover")
        self.cover = np.zeros(self.v, bool)
        self.cover[cover] = True

    def sampled(self, n: int) -> np.ndarray:
        """Sampled positions of a text of n bytes that have a whole triple."""
        last = n - 3 * self.block
        return np.flatnonzero(np.tile(self.cover, last // self.v + 1)[:last + 1]) if last >= 0 else np.zeros(0, np.int64)

    def reach(self, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance from a string's start to the sampled position p in it."""
        return np.maximum(0, p + self.length - n), np.minimum(self.v - 1, p)


def sampled_names(texts: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """Names of the sampled suffixes of every text, dealt to buckets of names."""
    schema = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("digests", pa.binary()), ("places", pa.binary())])
    b = shape.block

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, seen = Fingerprints(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                names, keys, places = [], [], []
                some = batch.slice(at, TEXTS)
                for key, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if len(t) < shape.length or key in seen:
                        continue
                    seen.add(key)
                    sums = prints.sums(np.frombuffer(t, np.uint8))
                    p = shape.sampled(len(t))
                    triple = [prints.of(sums, p + k * b, p + (k + 1) * b) for k in range(3)]
                    names.append(_mix(triple[0] + _mix(triple[1] + _mix(triple[2]))))
                    keys.append(np.full(len(p), key, np.int64))
                    places.append(p.astype(np.int32))
                if not names:
                    continue
                h, k, p = np.concatenate(names), np.concatenate(keys), np.concatenate(places)
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                h, k, p = h[order], k[order], p[order]
                kinds, starts = np.unique(bucket[order], return_index=True)
                cuts = list(zip(starts, np.append(starts[1:], len(h))))
                yield packed({"bucket": kinds, "names": [h[x:y].tobytes() for x, y in cuts], "digests": [k[x:y].tobytes() for x, y in cuts],
                              "places": [p[x:y].tobytes() for x, y in cuts]}, schema)

    return texts.mapInArrow(part, "bucket int, names binary, digests binary, places binary")


def repeated_names(named: DataFrame) -> DataFrame:
    """(digest, name, place) of the sampled suffixes whose name occurs at two places."""
    schema = pa.schema([("digest", pa.int64()), ("name", pa.int64()), ("place", pa.int32())])

    def within(key: tuple, t: pa.Table) -> pa.Table:
        h, k, p = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("names", np.uint64), ("digests", np.int64), ("places", np.int32)))
        order = np.argsort(h, kind="stable")
        h, k, p = h[order], k[order], p[order]
        again = h[1:] == h[:-1]
        keep = np.append(again, False) | np.append(False, again)
        h, k, p = h[keep], k[keep], p[keep]
        order = np.lexsort((p, k, h))  # tasks that met the same text gave the same suffixes
        h, k, p = h[order], k[order], p[order]
        new = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])) if len(h) else np.zeros(0, bool)
        h, k, p = h[new], k[new], p[new]
        again = h[1:] == h[:-1]
        keep = np.append(again, False) | np.append(False, again) if len(h) else np.zeros(0, bool)
        return pa.table([pa.array(k[keep]), pa.array(h[keep].view(np.int64)), pa.array(p[keep])], schema=schema)

    return named.groupBy("bucket").applyInArrow(within, "digest long, name long, place int")


def texts_with_repeats(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(digest, text) of the texts that have a suffix in ``suffixes``, each once.

    Tasks leave out texts that are not in a Bloom filter of fixed size, before anything is shuffled.
    """
    wanted = suffixes.select("digest").distinct()
    mask = FILTER_BITS - 1
    marks = wanted.select(F.explode(F.array(F.col("digest").bitwiseAND(F.lit(mask)), F.shiftright("digest", 24).bitwiseAND(F.lit(mask)))).alias("p"))
    rows = marks.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v")).collect()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        words[r["w"]] = r["v"]
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = shared.value, set()

        def first(key: int) -> bool:
            if key in seen or not all((int(words[p >> 6]) >> (p & 63)) & 1 for p in (key & mask, (key >> 24) & mask)):
                return False
            seen.add(key)
            return True

        for b in batches:
            yield b.filter(pa.array([first(k) for k in b.column(0).to_pylist()], pa.bool_()))

    found = texts.mapInArrow(part, "digest long, text binary")
    return found.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))


def second_names(texts: DataFrame, suffixes: DataFrame, shape: Shape) -> DataFrame:
    """(digest, place, name, low, high, second): the name of all bytes in reach of each suffix."""
    schema = pa.schema([("digest", pa.int64()), ("place", pa.int32()), ("name", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("second", pa.int64())])
    lists = suffixes.groupBy("digest").agg(F.collect_list("name").alias("names"), F.collect_list("place").alias("places"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for b in batches:
            for i in range(b.num_rows):
                t = np.frombuffer(b.column(1)[i].as_py(), np.uint8)
                names, p = b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy().astype(np.int64)
                low, high = shape.reach(p, len(t))
                ok = low <= high
                names, p, low, high = names[ok], p[ok], low[ok], high[ok]
                whole = prints.of(prints.sums(t), p - high, p - low + shape.length)
                yield packed({"digest": np.full(len(p), b.column(0)[i].as_py()), "place": p, "name": names, "low": low, "high": high,
                              "second": _mix(whole + (low * 1024 + high).astype(np.uint64)).view(np.int64)}, schema)

    return (texts.join(lists, "digest").select("digest", "text", "names", "places")
            .mapInArrow(part, "digest long, place int, name long, low int, high int, second long"))


def _contexts(texts: DataFrame, chosen: DataFrame, shape: Shape) -> DataFrame:
    """The bytes in reach of each chosen suffix."""
    schema = pa.schema([("name", pa.int64()), ("digest", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("alone", pa.bool_()), ("bytes", pa.binary())])
    lists = chosen.groupBy("digest").agg(F.collect_list(F.struct("name", "place", "low", "high", "alone")).alias("s"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, s = b.column(1)[i].as_py(), b.column(2)[i].values
                c = {f: s.field(f) for f in ("name", "place", "low", "high", "alone")}
                cut = [t[p - h:p - low + shape.length] for p, low, h in zip(*(c[f].to_pylist() for f in ("place", "low", "high")))]
                yield packed({**c, "digest": np.full(len(cut), b.column(0)[i].as_py()), "bytes": cut}, schema)

    return texts.join(lists, "digest").select("digest", "text", "s").mapInArrow(part, "name long, digest long, place int, low int, high int, alone boolean, bytes binary")


def _prefixes(prints: Fingerprints, length: int, text: bytes, low: int, high: int) -> np.ndarray:
    """Fingerprints of the strings that start ``high`` .. ``low`` bytes before the sampled suffix, in that order."""
    start = np.arange(high - low + 1)
    return prints.of(prints.sums(np.frombuffer(text, np.uint8)), start, start + length)


def merged_in_tasks(contexts: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """(digest, first, last): runs of starts of repeated strings, by sorting within buckets of names."""
    schema = pa.schema([("digest", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def within(key: tuple, t: pa.Table) -> pa.Table:
        prints = Fingerprints()
        c = {f: t.column(f).to_pylist() for f in t.column_names if f != "bucket"}
        n = [h - low + 1 for low, h in zip(c["low"], c["high"])]
        row = np.repeat(np.arange(len(n)), n)
        distance = np.concatenate([np.arange(h, low - 1, -1) for low, h in zip(c["low"], c["high"])])
        prefix = np.concatenate([_prefixes(prints, shape.length, x, low, h) for x, low, h in zip(c["bytes"], c["low"], c["high"])])
        name = np.array(c["name"], np.int64).view(np.uint64)[row]
        entry = _mix(prefix + _mix(name + distance.astype(np.uint64)))
        order = np.argsort(entry, kind="stable")
        same = entry[order][1:] == entry[order][:-1]
        hit = np.zeros(len(entry), bool)
        hit[order[np.append(same, False) | np.append(False, same)]] = True
        hit &= np.array(c["alone"], bool)[row]
        start = np.array(c["place"])[row] - distance
        # starts of a row ascend; a run ends where the next hit is of another row or not the next start
        row, start = row[hit], start[hit]
        cut = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        return pa.table([pa.array([c["digest"][i] for i in row[first]], pa.int64()), pa.array(start[first], pa.int32()), pa.array(start[last], pa.int32())], schema=schema)

    return (contexts.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int")).groupBy("bucket")
            .applyInArrow(within, "digest long, first int, last int"))


def merged_by_spark(contexts: DataFrame, shape: Shape) -> DataFrame:
    """The same for names with many second names: a row for each string, counted by Spark."""
    schema = pa.schema([("entry", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("alone", pa.bool_())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for b in batches:
            for r in b.to_pylist():
                distance = np.arange(r["high"], r["low"] - 1, -1)
                name = np.array([r["name"]], np.int64).view(np.uint64)
                entry = _mix(_prefixes(prints, shape.length, r["bytes"], r["low"], r["high"]) + _mix(name + distance.astype(np.uint64)))
                k = len(distance)
                yield packed({"entry": entry.view(np.int64), "digest": np.full(k, r["digest"]), "start": r["place"] - distance, "alone": np.full(k, r["alone"])}, schema)

    strings = hold(contexts.mapInArrow(part, "entry long, digest long, start int, alone boolean"))
    twice = strings.groupBy("entry").count().filter("count >= 2").select("entry")
    return strings.filter("alone").join(twice, "entry").select("digest", F.col("start").alias("first"), F.col("start").alias("last"))


def cut_texts(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256, kept) of the texts with runs of repeated strings."""
    schema = pa.schema([("digest", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    lists = runs.groupBy("digest").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py()
                change = np.zeros(len(t) + 1, np.int64)
                np.add.at(change, b.column(2)[i].values.to_numpy(), 1)
                np.add.at(change, b.column(3)[i].values.to_numpy() + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                out["digest"].append(b.column(0)[i].as_py())
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone & ~np.append(False, gone[:-1])).sum()))
                out["kept_sha256"].append(hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
            yield packed(out, schema)

    return texts.join(lists, "digest").select("digest", "text", "first", "last").mapInArrow(part, "digest long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, prime: int = COVER_PRIME) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    shape = Shape(length, prime)
    raw = docs.select(F.col(doc_id).alias("doc_id"), bytes_of(text).alias("text"))
    rows = hold(raw.select("doc_id", F.xxhash64("text").alias("digest"), F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    texts = raw.filter(F.length("text") >= length).select(F.xxhash64("text").alias("digest"), "text")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(12, int(total * shape.cover.mean()) // SORTED + 1)
    suffixes = hold(repeated_names(sampled_names(texts, shape, buckets)))
    some = hold(texts_with_repeats(texts, suffixes))
    named = hold(second_names(some, suffixes, shape))
    release(suffixes)
    groups = named.groupBy("name", "second").agg(F.count("*").alias("n"), F.min(F.struct("digest", "place")).alias("one"))
    settled = named.join(groups.filter("n >= 2").select("name", "second"), ["name", "second"]).select(
        "digest", (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low")).alias("last"))
    kinds = groups.groupBy("name").agg(F.count("*").alias("kinds")).filter("kinds >= 2")
    chosen = hold(groups.join(kinds, "name").select("name", "second", "kinds", (F.col("n") == 1).alias("alone"), F.col("one.digest").alias("digest"), F.col("one.place").alias("place"))
                  .join(named, ["name", "second", "digest", "place"]).select("name", "digest", "place", "low", "high", "alone", "kinds"))
    n_chosen = chosen.count()
    few = _contexts(some, chosen.filter(F.col("kinds") <= MANY), shape)
    many = _contexts(some, chosen.filter(F.col("kinds") > MANY), shape)
    merged = hold(merged_in_tasks(few, shape, max(12, n_chosen // CONTEXTS + 1)).union(merged_by_spark(many, shape)))
    release(chosen)
    runs = settled.union(merged)
    cut = hold(cut_texts(some, runs, length))
    release(named, merged, some)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = salted.groupBy("digest", "salt").agg(F.count("*").alias("n"))
    whole = parts.groupBy("digest").agg(F.sum("n").alias("copies"), F.collect_list("salt").alias("salts")).join(cut, "digest", "left")
    per_salt = whole.select("digest", F.explode("salts").alias("salt"), "copies", "n_removed", "n_spans", "kept_sha256")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return salted.join(per_salt, ["digest", "salt"]).select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
