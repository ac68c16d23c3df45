"""Document quality by Bradley-Terry ranking of preference pairs, cut at a score quantile.

Each text has a short vector of measures (shares of character classes, repetition, word shapes).
Every labelled good document of a bounded sample is preferred to several bad ones; the strengths
w.x are fitted by logistic loss on the differences of the two vectors. The cut is the quantile of
the strengths of all labelled learning rows at their share of bad documents (``learn``; its rank is
off by at most 1 in ``ACCURACY`` of the rows), and the score is a logistic curve
through the cut, where it equals ``cut_score``.

Edge cases: a null or empty text has zero measures and is scored by them; labels that are null or
neither 0 nor 1 teach nothing; with one label only, or none, every score is 1 (nothing is known
to be bad) or, where all labels are 0, 0.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuscope.llm.common import adam, bytes_of, hold, in_few_files, in_slices, packed, release, summed_gradient
from corpuscope.llm.toxicity import SAMPLE, labelled_sample, learning_labels

#: Pairs made of each good document of the sample; the score at the cut.
PAIRS, CUT_SCORE = 4, 0.3
STEPS, RATE, PENALTY = 60, 0.2, 1e-4
#: Of the quantiles of strengths.
ACCURACY = 100_000
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_STOP = b".,;:'\"()-"


def measures(text: bytes) -> list[float]:
    """Measures of one UTF-8 text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * N_MEASURES
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit = (int(count[r.start:r.stop].sum()) for r in (_UPPER, _LOWER, _DIGIT))
    high, blank = int(count[128:].sum()), int(count[9:14].sum() + count[32])
    stops = int(count[list(_STOP)].sum())
    odd = n - upper - lower - digit - high - blank - stops
    m = len(words)
    kinds = len(set(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, m)
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 1
    letters = max(upper + lower + high, 1)
    return [np.log(n), np.log(m), upper / letters, digit / n, high / n, blank / n, stops / n, odd / n, np.sqrt(odd / n),
            count[124] / n, count[33] / n, kinds / m, np.log(kinds) / np.log(m + 1), pairs / max(m - 1, 1), sizes.mean(), sizes.std(),
            np.log(sizes.max()), (sizes == 1).mean(), len(set(lines)) / len(lines), np.log(n / len(lines)), float((count > 0).sum()) / 100,
            (count[46] + count[63]) / m]


N_MEASURES = 22


def measure_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the array x of every document; ``text`` must be binary and last."""
    types = [(f.name, f.dataType.simpleString()) for f in docs.select(*keep).schema]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            x = pa.array([measures(t) for t in b.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), x], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(part, ", ".join(f"{n} {t}" for n, t in [*types, ("x", "array<double>")]))


def _expand(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised measures, clipped, and their squares."""
    z = np.clip((x - centre) / spread, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def preference_pairs(rows: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(good, bad) vectors: every good document against ``pairs`` bad ones, chosen by its number.

    ``rows`` is a bounded sample, so numbering a label's rows in one task is bounded as well.
    """
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)
    bad = numbered.filter("y = 0").select(F.col("i").alias("j"), F.col("x").alias("bad"))
    n_bad = bad.count()
    good = numbered.filter("y = 1").select("i", F.col("x").alias("good"), F.explode(F.array(*[F.lit(k) for k in range(pairs)])).alias("k"))
    return good.withColumn("j", F.pmod(F.col("i") * F.lit(pairs) + F.col("k"), F.lit(max(n_bad, 1)))).join(bad, "j").select("good", "bad")


def train(sample: DataFrame, pairs: int = PAIRS, steps: int = STEPS, cut_score: float = CUT_SCORE) -> dict:
    """Model from the rows (doc_id, text, y) of a bounded sample, cut at the quantile of its own rows."""
    rows = hold(measure_table(sample, ["doc_id", "y"]))
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if good in (0, n):
        release(rows)
        return {"constant": 0.0 if n and not good else 1.0}
    parts = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("c"), F.stddev_pop("v").alias("s")).orderBy("at").collect()
    centre, spread = np.array([r["c"] for r in parts]), np.array([max(r["s"], 1e-9) for r in parts])
    pair_rows = in_few_files(preference_pairs(rows, pairs))
    n_pairs = pair_rows.count()

    def gradient(w: np.ndarray) -> np.ndarray:
        def of(batch: dict[str, np.ndarray]) -> np.ndarray:
            d = _expand(np.stack(batch["good"]), centre, spread) - _expand(np.stack(batch["bad"]), centre, spread)
            return -((1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) @ d)
        return summed_gradient(pair_rows, ["good", "bad"], of, len(w)) / n_pairs + PENALTY * w

    w = adam(np.zeros(2 * N_MEASURES), gradient, steps, RATE)
    release(pair_rows)
    model = {"w": w, "centre": centre, "spread": spread}
    out = _with_cut(model, rows.select("y", "x").mapInArrow(_strengths(model), "y int, s double"), cut_score)
    release(rows)
    return out


def learn(docs: DataFrame, labels: DataFrame, which: Column, n: int = SAMPLE, cut_score: float = CUT_SCORE) -> dict:
    """Model from at most ``n`` of each label's rows for which ``which`` holds, cut at the quantile of all of them.

    Texts are measured where they are; only ids, strengths and labels are joined.
    """
    model = train(labelled_sample(docs, labels, "quality", which, n), cut_score=cut_score)
    if "constant" in model:
        return model
    schema = pa.schema([("doc_id", pa.int64()), ("s", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            if b.num_rows:
                x = np.array([measures(t) for t in b.column(1).to_pylist()])
                yield packed({"doc_id": b.column(0), "s": _expand(x, model["centre"], model["spread"]) @ model["w"]}, schema)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("text")).filter("doc_id is not null")
    strengths = hold(known.mapInArrow(part, "doc_id long, s double").join(learning_labels(labels, "quality", which), "doc_id").select("y", "s"))
    out = _with_cut(model, strengths, cut_score)
    release(strengths)
    return out


def _with_cut(model: dict, strengths: DataFrame, cut_score: float) -> dict:
    """The model with its cut at the quantile of the strengths s at the share of label 0."""
    n, good = strengths.agg(F.count("*"), F.sum("y")).first()
    cut, low, high = strengths.agg(F.percentile_approx("s", [1 - good / n, 0.25, 0.75], ACCURACY)).first()[0]
    return model | {"cut": cut, "slope": 4.0 / max(high - low, 1e-9), "at_cut": float(np.log(cut_score / (1 - cut_score)))}


def _strengths(model: dict):
    schema = pa.schema([("y", pa.int32()), ("s", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False))
                yield packed({"y": b.column(0), "s": _expand(x, model["centre"], model["spread"]) @ model["w"]}, schema)
    return part


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    s = _expand(x, model["centre"], model["spread"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip((s - model["cut"]) * model["slope"] + model["at_cut"], -30, 30)))


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            if b.num_rows:
                x = np.array([measures(t) for t in b.column(1).to_pylist()])
                yield packed({"doc_id": b.column(0), "score": scores(model, x)}, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), bytes_of(text).alias("text")).mapInArrow(part, "doc_id long, score double")


def keep_good(docs: DataFrame, model: dict, text: str = "text", cut_score: float = CUT_SCORE) -> DataFrame:
    """The documents with a score of ``cut_score`` or more, with all their columns, in their own tasks."""
    names = docs.columns
    at = names.index(text)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            if b.num_rows:
                x = np.array([measures((t or "").encode()) for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(scores(model, x) >= cut_score))

    return docs.mapInArrow(part, docs.schema)
