"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters, lower case), each known by its 32-bit hash. The
machine scores a set x by  w0 + sum w_i + sum_{i<j} <v_i, v_j>  over the terms it knows, so that
pairs such as an insult and the mention of a group count beyond their single weights. Terms,
weights and factors are learned from a bounded sample of labelled rows, in which a row counts as
many times as its label has learning rows for each one sampled; gradients are summed by Spark over
the sample's partitions. Scoring reads every whole text once and shuffles nothing.

Edge cases: a null, empty or wordless text scores by the bias alone; labels that are null or
neither 0 nor 1, and labels without a document, teach nothing; without both labels every score
is the share of label 1 (0 without any label); a null id is scored like others.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.common import adam, bounded_sample, bytes_of, hold, in_few_files, packed, release, summed_gradient

#: At most so many labelled rows of each label teach; so many terms are known; rank of the pairs.
SAMPLE, TERMS, RANK = 6000, 512, 8
#: A small sample supports fewer terms: one for so many rows, but so many at least.
ROWS_PER_TERM, LEAST_TERMS = 6, 64
STEPS, RATE, PENALTY = 40, 0.1, 5e-4
#: Terms in fewer documents of the sample, or than this share of them, are not learned.
LEAST, LEAST_SHARE = 8, 0.001
#: A row of the rarer label 1 counts as many times as there are rows of label 0 to it, up to this.
MOST_WEIGHT = 3.0
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: bytes) -> set[int]:
    """Hashes of the distinct terms of a UTF-8 text."""
    return {zlib.crc32(t) for t in set(_WORD.findall(text.lower()))}


def learning_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id and y (0 or 1) of every id whose label teaches."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    return good.filter(learn).dropDuplicates(["doc_id"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, n: int = SAMPLE) -> DataFrame:
    """Texts and labels y of at most ``n`` labelled rows of each label, by the hash of their id.

    ``stands_for`` is the number of all learning labels of a row's label for each one sampled (1
    where none was left out). Only ids and labels are sampled, so texts meet at most 2n rows,
    which are broadcast.
    """
    good = learning_labels(labels, label, learn)
    count = dict(good.groupBy("y").count().collect())
    each = [max(count.get(y, 0) / n, 1.0) for y in (0, 1)]
    some = bounded_sample(good.filter("y = 1"), F.col("doc_id"), n).unionByName(bounded_sample(good.filter("y = 0"), F.col("doc_id"), n))
    some = some.withColumn("stands_for", F.when(F.col("y") == 1, each[1]).otherwise(each[0]))
    return docs.select("doc_id", bytes_of().alias("text")).join(F.broadcast(some), "doc_id")


def _term_table(sample: DataFrame) -> DataFrame:
    schema = pa.schema([("y", pa.int32()), ("terms", pa.list_(pa.int64())), ("stands_for", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield packed({"y": b.column(1).to_pylist(), "terms": [list(terms(t)) for t in b.column(0).to_pylist()], "stands_for": b.column(2)}, schema)

    return sample.select("text", "y", "stands_for").mapInArrow(part, "y int, terms array<long>, stands_for double")


def _by_label(rows: DataFrame) -> list[tuple[int, float]]:
    """For label 0 and label 1: rows of the sample, and for how many learning rows each stands."""
    found = {y: (n, each) for y, n, each in rows.groupBy("y").agg(F.count("*"), F.max("stands_for")).collect()}
    return [found.get(y, (0, 1.0)) for y in (0, 1)]


def choose_terms(rows: DataFrame, n: int = TERMS) -> dict[int, float]:
    """Hash and inverse document frequency (1 for the rarest) of the terms to learn.

    Half are chosen by the chi-square of term and label, half by document frequency; both are of
    the learning rows that the sample stands for.
    """
    (n0, each0), (n1, each1) = _by_label(rows)
    if not n0 + n1:
        return {}
    n = min(n, max(LEAST_TERMS, (n0 + n1) // ROWS_PER_TERM))
    total = n0 * each0 + n1 * each1
    share = n1 * each1 / total
    counts = (rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("found"), F.sum("y").alias("pos"))
              .filter(F.col("found") >= LEAST)
              .withColumn("pos", F.col("pos") * each1).withColumn("df", (F.col("found") - F.col("pos") / each1) * each0 + F.col("pos"))
              .filter(F.col("df") >= LEAST_SHARE * total).withColumn("chi", F.pow(F.col("pos") - F.col("df") * share, 2) / F.col("df")))
    telling = counts.orderBy(F.desc("chi"), "term").limit(n // 2).select("term", "df")
    common = counts.orderBy(F.desc("df"), "term").limit(n // 2).select("term", "df")
    chosen = telling.union(common).distinct().collect()
    rarest = np.log(total / min((r["df"] for r in chosen), default=1))
    return {r["term"]: float(np.log(total / r["df"]) / max(rarest, 1e-9)) for r in sorted(chosen)}


class Machine:
    """Parameters w0, w (n) and v (n x rank) in one vector; scores and gradients of batches of sets.

    ``value`` is what each term counts: its inverse document frequency, 1 for the rarest.
    """

    def __init__(self, value: np.ndarray, rank: int):
        self.value, self.n, self.rank = value, len(value), rank
        self.size = 1 + self.n + self.n * rank

    def split(self, p: np.ndarray):
        return p[0], p[1:1 + self.n], p[1 + self.n:].reshape(self.n, self.rank)

    def margins(self, p: np.ndarray, ids: np.ndarray, row: np.ndarray, rows: int):
        w0, w, v = self.split(p)
        x = self.value[ids]
        picked = v[ids] * x[:, None]
        sums = np.stack([np.bincount(row, picked[:, f], rows) for f in range(self.rank)], 1) if len(ids) else np.zeros((rows, self.rank))
        squares = np.bincount(row, (picked * picked).sum(1), rows) if len(ids) else np.zeros(rows)
        linear = np.bincount(row, w[ids] * x, rows) if len(ids) else np.zeros(rows)
        return w0 + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, picked

    def gradient(self, p: np.ndarray, ids: np.ndarray, row: np.ndarray, y: np.ndarray, positive: float = 1.0) -> np.ndarray:
        """Of the logistic loss, in which a row of label 1 counts ``positive`` times."""
        z, sums, picked = self.margins(p, ids, row, len(y))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y == 1, positive, 1.0)
        g = np.zeros(self.size)
        g[0] = d.sum()
        if len(ids):
            each = d[row] * self.value[ids]
            g[1:1 + self.n] = np.bincount(ids, each, self.n)
            pair = each[:, None] * (sums[row] - picked)
            g[1 + self.n:] = np.stack([np.bincount(ids, pair[:, f], self.n) for f in range(self.rank)], 1).ravel()
        return g


def train(sample: DataFrame, n_terms: int = TERMS, rank: int = RANK, steps: int = STEPS) -> tuple[dict[int, float], np.ndarray, int]:
    """(values of the known terms by hash, parameters, rank)."""
    rows = hold(_term_table(sample))
    (n0, each0), (n1, each1) = _by_label(rows)
    if not n0 or not n1:  # nothing to tell apart
        release(rows)
        return {}, np.array([30.0 if n1 else -30.0]), rank
    known = choose_terms(rows, n_terms)
    machine = Machine(np.array(list(known.values())), rank)
    # of all learning rows first, then against a row of label 0 of the sample
    weight = float(np.clip(n0 * each0 / (n1 * each1), 1, MOST_WEIGHT)) * each1 / each0
    whole = n0 + weight * n1
    start = np.random.default_rng(1).normal(0, 0.01, machine.size)
    start[:1 + machine.n] = 0
    start[0] = np.log(weight * n1 / n0)
    lookup = np.array(list(known), dtype=np.int64)
    schema = pa.schema([("y", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                t = np.array(t, dtype=np.int64)
                at = np.searchsorted(lookup, t)
                found.append(at[(at < len(lookup)) & (lookup[np.minimum(at, len(lookup) - 1)] == t)].astype(np.int32) if len(lookup) else t[:0])
            yield packed({"y": b.column(0).to_pylist(), "ids": found}, schema)

    indexed = in_few_files(rows.mapInArrow(index, "y int, ids array<int>"))
    release(rows)
    def gradient(p: np.ndarray) -> np.ndarray:
        def of(batch: dict[str, np.ndarray]) -> np.ndarray:
            y = batch["y"].astype(np.int64)
            lengths = np.array([len(x) for x in batch["ids"]])
            ids = np.concatenate(list(batch["ids"])).astype(np.int64) if len(y) else np.zeros(0, np.int64)
            return machine.gradient(p, ids, np.repeat(np.arange(len(y)), lengths), y, weight)
        return summed_gradient(indexed, ["y", "ids"], of, machine.size) / whole + PENALTY * np.concatenate([[0.0], p[1:]])

    out = adam(start, gradient, steps, RATE)
    release(indexed)
    return known, out, rank


def score(docs: DataFrame, model: tuple[dict[int, float], np.ndarray, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    known, p, rank = model
    machine = Machine(np.array(list(known.values())), rank)
    place = {h: i for i, h in enumerate(known)}
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[place[h] for h in terms(t) if h in place] for t in b.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            ids = np.array([i for x in found for i in x], dtype=np.int64)
            z, _, _ = machine.margins(p, ids, row, len(found))
            yield packed({"doc_id": b.column(0), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), bytes_of(text).alias("text")).mapInArrow(part, "doc_id long, score double")
