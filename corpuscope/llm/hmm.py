"""A hidden Markov language model of documents.

Words (ASCII lower case, cut at ASCII white space, one end token behind each document) fall into
classes: every frequent word is a class of its own, all others share classes by their last three
bytes. Latent states emit classes; a class emits its words by their smoothed counts:

    P(text) = sum over state paths of  prod A[s', s] E[s, class(w)] * (c(w) + 0.5) / total(class(w))

where a shared class has 0.5 set aside for unknown words. Word counts cover all training texts
and stay a distributed table: only the ``known_words`` most frequent are sent to the tasks, the
rest meet their counts in a join. Baum-Welch starts from a bounded sample of segments and then
runs over all training texts: every task counts, Spark adds the counts, the driver gets one
table of states by classes. Scores come from the scaled forward recursion over whole texts; many
texts advance in step, so a long one costs no more per token.

Edge cases: a null or empty text is the end token alone; rows that repeat an id are separate;
without training texts every word is unknown and all scores are finite.
"""
from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import bytes_of, fold, hold, packed

#: Latent states; words with a class of their own; words whose counts every task knows; shared classes.
STATES, OWN, KNOWN, SHARED = 8, 20_000, 200_000, 2048
#: Passes of Baum-Welch over all training texts, and over the sample before (this many segments of so many tokens).
PASSES, FIRST_PASSES, SAMPLE, SEGMENT = 2, 20, 1024, 256
#: Distinct words counted, and tokens advanced in step, before a task hands on what it has.
MOST_WORDS, MOST_TOKENS = 600_000, 4_000_000
END = b""
_LONG = 24


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def key_of(word: bytes) -> bytes:
    """The word, or for a long one its digest behind a byte that no UTF-8 text has."""
    return word if len(word) <= _LONG else b"\xff" + hashlib.blake2b(word, digest_size=16).digest()


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts; the end token is the empty word."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                count.update(words(t))
            count[END] += b.num_rows
            if len(count) > MOST_WORDS:
                yield packed({"word": [key_of(w) for w in count], "c": list(count.values())}, schema)
                count.clear()
        yield packed({"word": [key_of(w) for w in count], "c": list(count.values())}, schema)

    return training.select("text").mapInArrow(part, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _shared_class(own: int, shared: int):
    return (F.lit(own) + F.crc32(F.expr("substring(word, -3, 3)")) % shared).cast("int")


class Classes:
    """Class and count of the words that every task knows; totals of all classes."""

    def __init__(self, vocab: DataFrame, own: int, known: int, shared: int):
        short = vocab.filter(F.length("word") <= _LONG)
        # the least count of the known words, from the number of words of each count
        least, total = 1 << 62, 0
        for r in short.groupBy("c").count().orderBy(F.desc("c")).limit(known).collect():
            total += r["count"]
            if total > known:
                break
            least = r["c"]
        top = sorted(short.filter(F.col("c") >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
        self.count = {bytes(r["word"]): r["c"] for r in top}
        names = [END] + [w for w in list(self.count)[:own] if w != END]
        self.own = {w: i for i, w in enumerate(names)}
        self.first, self.n = len(names), len(names) + shared
        self.shared = shared
        self.total = np.full(self.n, 0.5)
        for w, i in self.own.items():
            self.total[i] = self.count.get(w, 0) + 0.5
        grouped = vocab.groupBy(_shared_class(self.first, shared).alias("class")).agg((F.sum("c") + 0.5 * F.count("*")).alias("t")).collect()
        for r in grouped:
            self.total[r["class"]] += r["t"]
        for w, i in self.own.items():  # words with a class of their own were added to the shared ones
            if w in self.count:
                self.total[self.first + zlib.crc32(w[-3:]) % shared] -= self.count[w] + 0.5
        self.total[self.first:] = np.maximum(self.total[self.first:], 0.5)

    def of(self, key: bytes) -> int:
        i = self.own.get(key)
        return i if i is not None else self.first + zlib.crc32(key[-3:]) % self.shared


SEQUENCES = "doc_id long, held_out boolean, classes array<int>, n_tokens long, n_known long, weight double, rare array<binary>, times array<int>"


def sequences(docs: DataFrame, classes: Classes) -> DataFrame:
    """Per document its classes, the sum of log10(c + 0.5) over words known to all tasks, and its other words."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("classes", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("weight", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((classes.count, classes.own, classes.first, classes.shared))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, own, first, n_shared = shared.value
        end_weight = float(np.log10(count.get(END, 0) + 0.5))
        end_known = int(END in count)
        known = {w: (own[w] if w in own else first + zlib.crc32(w[-3:]) % n_shared, float(np.log10(c + 0.5)), None) for w, c in count.items()}
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # few texts at a time: their classes take more room than they do
                b = batch.slice(at, 1000)
                at += 1000
                out: dict[str, list] = {f.name: [] for f in schema}
                for t in b.column(2).to_pylist():
                    ids, weight, seen, rare = [], end_weight, end_known, Counter()
                    for w in words(t):
                        hit = known.get(w)
                        if hit is None:
                            key = key_of(w)
                            ids.append(first + zlib.crc32(key[-3:]) % n_shared)
                            rare[key] += 1
                        else:
                            ids.append(hit[0])
                            weight += hit[1]
                            seen += 1
                    ids.append(0)
                    for name, v in (("classes", ids), ("n_tokens", len(ids)), ("n_known", seen), ("weight", weight), ("rare", list(rare)), ("times", list(rare.values()))):
                        out[name].append(v)
                out["doc_id"], out["held_out"] = b.column(0), b.column(1)
                yield packed(out, schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(part, SEQUENCES)


def segments(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int = SEGMENT) -> list[tuple[int, int]]:
    """(start, length) of pieces of at most ``size`` tokens, longest first."""
    out = [(s + i, min(size, n - i)) for s, n in zip(starts.tolist(), lengths.tolist()) for i in range(0, n, size)]
    return sorted(out, key=lambda x: -x[1])


def expected_counts(flat: np.ndarray, pieces: list[tuple[int, int]], model: tuple, n_classes: int) -> np.ndarray:
    """Baum-Welch counts of the pieces in one vector: log10 likelihood, starts, transitions, emissions."""
    pi, a, e = model
    k = len(pi)
    out_pi, out_a, out_e, fit = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes)), 0.0
    by_class = np.ascontiguousarray(e.T)
    for at in range(0, len(pieces), 1024):
        some = pieces[at:at + 1024]
        start, length = np.array([p[0] for p in some]), np.array([p[1] for p in some])
        width = int(length[0])
        inside = np.arange(width)[:, None] < length[None, :]
        obs = flat[np.where(inside, start[None, :] + np.arange(width)[:, None], start[None, :])]
        seen = by_class[obs]
        seen[~inside] = 1.0
        active = inside.sum(1)
        alpha, scale = np.zeros_like(seen), np.ones(seen.shape[:2])
        for t in range(width):
            n = active[t]
            x = (pi if t == 0 else alpha[t - 1, :n] @ a) * seen[t, :n]
            scale[t, :n] = x.sum(1)
            alpha[t, :n] = x / scale[t, :n, None]
        beta = np.ones_like(seen)
        ahead = np.zeros_like(seen)
        for t in range(width - 2, -1, -1):
            n = active[t + 1]
            ahead[t + 1, :n] = seen[t + 1, :n] * beta[t + 1, :n] / scale[t + 1, :n, None]
            beta[t, :n] = ahead[t + 1, :n] @ a.T
        gamma = alpha * beta
        out_pi += gamma[0].sum(0)
        out_a += alpha[:-1].reshape(-1, k).T @ ahead[1:].reshape(-1, k) * a
        places = obs[inside]
        for s in range(k):
            out_e[s] += np.bincount(places, gamma[:, :, s][inside], n_classes)
        fit += np.log10(scale).sum()
    return np.concatenate([[fit], out_pi, out_a.ravel(), out_e.ravel()])


def estimate(counts: np.ndarray, prior: np.ndarray, k: int) -> tuple:
    """Starts, transitions and emissions from counts; the prior keeps every class possible."""
    pi, a, e = counts[1:1 + k] + 0.1, counts[1 + k:1 + k + k * k].reshape(k, k) + 0.1, counts[1 + k + k * k:].reshape(k, -1) + 20 * prior[None, :]
    return pi / pi.sum(), a / a.sum(1, keepdims=True), e / e.sum(1, keepdims=True)


def all_counts(seqs: DataFrame, model: tuple, n_classes: int) -> np.ndarray:
    """Baum-Welch counts over all rows: summed in the tasks, then by blocks of the vector."""
    k = len(model[0])
    size, block = 1 + k + k * k + k * n_classes, 8192
    ddl, schema = "block int, part array<double>", pa.schema([("block", pa.int32()), ("part", pa.list_(pa.float64()))])
    shared = seqs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                lists = b.column(0).slice(at, 1000)
                flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
                lengths = np.diff(ends, prepend=0)
                total += expected_counts(flat, segments(flat, ends - lengths, lengths), shared.value, n_classes)
        cuts = range(0, size, block)
        yield packed({"block": [i // block for i in cuts], "part": [total[i:i + block] for i in cuts]}, schema)

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in t.column("part").combine_chunks()], axis=0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total], pa.list_(pa.float64()))})

    out = np.zeros(size)
    for r in seqs.select("classes").mapInArrow(part, ddl).groupBy("block").applyInArrow(add, ddl).collect():
        out[r["block"] * block:r["block"] * block + len(r["part"])] = r["part"]
    shared.unpersist()
    return out


def train(seqs: DataFrame, classes: Classes, states: int = STATES, passes: int = PASSES) -> tuple:
    """Starts, transitions and emissions. ``seqs`` holds the training rows only."""
    prior = classes.total / classes.total.sum()
    noise = np.random.default_rng(7)
    e = prior[None, :] * noise.gamma(2.0, 1.0, (states, classes.n))
    a = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(a, 0.9)
    model = np.full(states, 1 / states), a / a.sum(1, keepdims=True), e / e.sum(1, keepdims=True)
    chosen = [r["row"] for r in seqs.select("row", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(SAMPLE).select("row").collect()]
    rows = seqs.filter(F.col("row").isin(chosen)).orderBy("row").select(F.slice("classes", 1, SEGMENT).alias("c")).collect()
    if not rows:
        return model
    flat, lengths = np.concatenate([np.array(r["c"]) for r in rows]), np.array([len(r["c"]) for r in rows])
    pieces = segments(flat, np.cumsum(lengths) - lengths, lengths)
    for _ in range(FIRST_PASSES):
        model = estimate(expected_counts(flat, pieces, model, classes.n), prior, states)
    for _ in range(passes):
        model = estimate(all_counts(seqs, model, classes.n), prior, states)
    return model


def forward(seqs: DataFrame, model: tuple, classes: Classes) -> DataFrame:
    """row and the log10 likelihood of its classes times what classes give their words, but for log10(c + 0.5)."""
    schema = pa.schema([("row", pa.int64()), ("path", pa.float64())])
    pi, a, e = model
    # a word of a shared class has (c + 0.5) / total of it; a class of one word gives it surely
    give = np.log10(classes.total)
    shared = seqs.sparkSession.sparkContext.broadcast((pi, a, np.ascontiguousarray(e.T), give))

    def run(rows: list, lists: list) -> pa.RecordBatch:
        pi, a, by_class, give = shared.value
        flat = np.concatenate([x.flatten().to_numpy() for x in lists])
        lengths = np.concatenate([x.value_lengths().to_numpy() for x in lists])
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        start, length = starts[order], lengths[order]
        path = -np.add.reduceat(give[flat], starts)
        fit, alpha = np.zeros(len(order)), np.tile(pi, (len(order), 1))
        active = len(order) - np.searchsorted(length[::-1], np.arange(1, int(length[0]) + 1))
        for t, n in enumerate(active.tolist()):
            x = alpha[:n] if t == 0 else alpha[:n] @ a
            x = x * by_class[flat[start[:n] + t]]
            c = x.sum(1)
            fit[:n] += np.log10(c)
            alpha[:n] = x / c[:, None]
        path[order] += fit
        return packed({"row": np.concatenate(rows), "path": path}, schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, lists, tokens = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            rows.append(b.column(0).to_numpy())
            lists.append(b.column(1))
            tokens += len(b.column(1).flatten())
            if tokens >= MOST_TOKENS:
                yield run(rows, lists)
                rows, lists, tokens = [], [], 0
        if rows:
            yield run(rows, lists)

    return seqs.select("row", "classes").mapInArrow(part, "row long, path double")


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1, states: int = STATES, own: int = OWN,
                    known: int = KNOWN, shared: int = SHARED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), bytes_of().alias("text"))
    vocab = hold(vocabulary(rows.filter("not held_out")))
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    classes = Classes(vocab, own, known, shared)
    seqs = hold(sequences(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"), classes).withColumn("row", F.monotonically_increasing_id()))
    model = train(seqs.filter("not held_out"), classes, states)
    other = seqs.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("n"))
    counted = other.join(vocab, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = counted.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_weight"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    paths = forward(seqs, model, classes)
    joined = (seqs.select("row", "doc_id", "held_out", "n_tokens", "n_known", "weight").join(paths, "row").join(rare, "row", "left")
              .withColumn("all_weight", F.col("weight") + F.coalesce("rare_weight", F.lit(0.0))))
    below = float(np.log10(n + 0.5 * (v + 1)))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                         F.lit(n).cast("long").alias("train_tokens"), (F.col("all_weight") - F.col("n_tokens") * below).alias("base_score"),
                         (F.col("all_weight") + F.col("path")).alias("score"))
