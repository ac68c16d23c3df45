"""Language identification with a string kernel.

The kernel is the blended spectrum of presence: texts are the sets of their 1-, 2- and 3-grams of
bytes (ASCII letters lower case, other ASCII characters one blank), and two texts are as similar
as the cosine of their sets. Landmark texts from a bounded sample give the Nystroem features
K(x, landmarks) K_mm^(-1/2); kernel ridge regression, one language against the rest, is solved
from their moments, which Spark adds up over the sample. The sample is taken from each language by
itself, all rows of a rare one, and a row counts as often as its language has learning rows for
each one sampled. Scoring multiplies batches of presence
vectors with the landmarks and the weights.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; rows without a
language or an id teach nothing; with no language learned every text gets ``und``.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpuscope.llm.common import hold, in_few_files, packed, release, summed_gradient

#: Rows of the sample of each language (about so many at most, chosen by the hash of the id), landmarks among all, n-gram slots.
SAMPLE, LANDMARKS, SLOTS = 6000, 192, 8192
#: Ridge penalty, and the sharpness of the scores.
PENALTY, SHARPNESS = 1e-2, 6.0
#: Texts multiplied at a time.
BATCH = 256
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(32 if not (chr(b).isalpha() and b < 128) and b < 128 else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def presence(text: bytes, out: np.ndarray) -> None:
    """Mark the slots of the text's 1-, 2- and 3-grams in ``out`` (float32, zeros)."""
    b = np.frombuffer((b" " + text + b" ").translate(_FOLD), np.uint8).astype(np.uint32)
    out[b] = 1
    two = b[:-1] * 256 + b[1:]
    out[256 + (two * np.uint32(2654435761) >> 16) % np.uint32(SLOTS // 4 - 256)] = 1
    three = two[:-1] * 256 + b[2:]
    out[SLOTS // 4 + (three * np.uint32(2654435761) >> 14) % np.uint32(SLOTS - SLOTS // 4)] = 1


def vectors(texts: list[bytes]) -> np.ndarray:
    """Unit presence vectors, one row per text."""
    x = np.zeros((len(texts), SLOTS), np.float32)
    for t, row in zip(texts, x):
        presence(t, row)
    x /= np.sqrt(x.sum(1, keepdims=True))
    return x


def _features(landmarks: np.ndarray, root: np.ndarray, texts: list[bytes]) -> np.ndarray:
    return (vectors(texts) @ landmarks.T).astype(np.float64) @ root


def train(docs: DataFrame, learn: Column, n: int = SAMPLE, n_landmarks: int = LANDMARKS) -> dict | None:
    """Model from the rows for which ``learn`` holds and whose lang is known; None without any.

    A language with at most ``n`` such rows teaches all of them, others the rows whose hash is
    below n / rows of the language, which are n on average.
    """
    good = docs.filter(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = {lang: count for lang, count in good.groupBy("lang").count().collect()}
    if not rows:
        return None
    shares = good.sparkSession.createDataFrame([(lang, n / count) for lang, count in rows.items()], "lang string, share double")
    picked = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)) < F.col("share")
    found = hold(good.join(F.broadcast(shares), "lang").filter(picked).select("doc_id", "lang", F.col("text").cast("binary").alias("text")))
    sample = in_few_files(found)
    release(found)
    stands_for = {lang: rows[lang] / count for lang, count in sample.groupBy("lang").count().collect()}
    langs = sorted(stands_for)
    each = -(-n_landmarks // len(langs))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = [r["text"] for r in sample.withColumn("first", first).filter(F.col("first") <= each).orderBy("lang", "first").collect()]
    landmarks = vectors([bytes(t) for t in chosen])
    values, axes = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good_axes = values > 1e-4
    root = axes[:, good_axes] / np.sqrt(values[good_axes])
    m, k = root.shape[1] + 1, len(langs)
    place = {lang: i for i, lang in enumerate(langs)}

    def moments(batch: dict[str, np.ndarray]) -> np.ndarray:
        total = np.zeros((m, m + k))
        for at in range(0, len(batch["lang"]), BATCH):
            f = _features(landmarks, root, [bytes(t) for t in batch["text"][at:at + BATCH]])
            f = np.concatenate([f, np.ones((len(f), 1))], 1)
            y = -np.ones((len(f), k))
            y[np.arange(len(f)), [place[x] for x in batch["lang"][at:at + BATCH]]] = 1
            weight = np.array([stands_for[x] for x in batch["lang"][at:at + BATCH]])
            total += (f * weight[:, None]).T @ np.concatenate([f, y], 1)
        return total.ravel()

    total = summed_gradient(sample, ["lang", "text"], moments, m * (m + k)).reshape(m, m + k)
    release(sample)
    weights = np.linalg.solve(total[:, :m] + PENALTY * np.eye(m), total[:, m:])
    # score = f(x) W + b, with f(x) = K(x, landmarks) root: both matrices in one
    return {"langs": langs, "landmarks": landmarks, "weights": (root @ weights[:-1]).astype(np.float32), "bias": weights[-1]}


def predict(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    if model is not None:
        langs = np.array([*model["langs"], "und"], dtype=object)
        by_slot = np.ascontiguousarray((model["weights"].T @ model["landmarks"]).T)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if model is not None and t is not None and _LETTER.search(t)]
            for at in range(0, len(some), BATCH):
                rows = some[at:at + BATCH]
                s = vectors([texts[i].encode() for i in rows]) @ by_slot + model["bias"]
                e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
                best[rows], score[rows] = s.argmax(1), e.max(1) / e.sum(1)
            yield packed({"doc_id": b.column(0), "lang_pred": list(langs[best]) if model is not None else ["und"] * len(texts), "score": score}, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(part, "doc_id long, lang_pred string, score double")
