"""Learned operators: held-out accuracy, exact likelihoods, odd rows."""
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import hmm, langid, quality, queries, toxicity
from corpuscope.llm.common import fold

SF = "/root/testdata/sf0.01"


def area(rows) -> float:
    """Chance that a row of label 1 scores above one of label 0."""
    one, zero = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


@pytest.mark.parametrize("query, label, least", [(queries.op1_toxicity, "toxic", 0.85), (queries.op2_quality, "quality", 0.97)])
def test_held_out_labels(spark, query, label, least):
    got = query(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    rows = got.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", label).collect()
    assert area(rows) > least


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op6_language(spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_rare_language_is_learned(spark):
    """Six of 6000 texts have a language of their own: a sample of 100 rows a language knows it."""
    rows = [(i, f"the house and water {i % 50} of people", "en") for i in range(3000)] + \
           [(i, f"das haus und wasser {i % 50} der leute", "de") for i in range(3000, 5994)] + \
           [(i, f"дом и вода {i % 50} людей", "ru") for i in range(5994, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs, F.lit(True), 100)).join(docs, "doc_id")
    assert got.filter("lang_pred <> lang").count() == 0


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


@pytest.mark.parametrize("rows, score", [([], 0.0), ([(1, 0, 0), (2, 0, 0)], 0.0), ([(4, 1, 1)], 1.0), ([(4, None, 1), (99, 1, 1), (None, 1, 1)], 0.0)])
def test_toxicity_with_few_labels(spark, odd_docs, rows, score):
    model = toxicity.train(toxicity.labelled_sample(odd_docs, labels_of(spark, rows), "toxic", F.lit(True)))
    got = [r["score"] for r in toxicity.score(odd_docs, model).collect()]
    assert len(got) == odd_docs.count() and all(abs(s - score) < 1e-6 for s in got)


def test_thinned_labels_keep_the_share_of_toxic(spark):
    """Wordless texts score by the bias alone: it has to be the same however small the sample is."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("!!!").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    for n in (1000, 40, 20):
        model = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), n))
        assert abs(toxicity.score(docs, model).first()["score"] - 3 * 40 / (3 * 40 + 360)) < 0.01


def test_small_sample_flags_as_many(spark):
    """A word in 40 % of toxic and 20 % of other texts, one in ten toxic: no text is more likely toxic than not."""
    i = F.col("id")
    word = F.floor(i / 10) % 5 < F.when(i % 10 == 0, 2).otherwise(1)
    docs = spark.range(2000).select(i.alias("doc_id"), F.when(word, "some bad").otherwise("some").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    for n in (6000, 200):
        model = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), n))
        assert toxicity.score(docs, model).filter("score >= 0.5").count() == 0


def test_labels_of_odd_documents(spark, odd_docs, no_docs):
    labels = labels_of(spark, [(i, i % 2, i % 2) for i in range(1, 14)] + [(4, 0, 0), (5, 7, 7)])
    for learn, label in ((toxicity, "toxic"), (quality, "quality")):
        model = learn.train(toxicity.labelled_sample(odd_docs, labels, label, F.lit(True)))
        got = [r["score"] for r in learn.score(odd_docs, model).collect()]
        assert len(got) == odd_docs.count() and all(0 <= s <= 1 for s in got)
        assert learn.score(no_docs, model).count() == 0
        learn.train(toxicity.labelled_sample(no_docs, labels, label, F.lit(True)))


def test_quality_with_one_label(spark, odd_docs):
    for rows, score in (([], 1.0), ([(4, 0, 1)], 1.0), ([(4, 0, 0)], 0.0)):
        model = quality.train(toxicity.labelled_sample(odd_docs, labels_of(spark, rows), "quality", F.lit(True)))
        assert {r["score"] for r in quality.score(odd_docs, model).collect()} == {score}
        assert quality.keep_good(odd_docs, model).count() == (odd_docs.count() if score else 0)


def test_cut_is_the_quantile(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.labelled_sample(docs, labels, "quality", F.lit(True))
    model = quality.train(sample)
    rows = quality.score(sample, model).collect()
    bad = labels.filter("quality = 0").count()
    assert abs(sum(r["score"] < quality.CUT_SCORE for r in rows) - bad) <= 2


@pytest.mark.parametrize("n", [6000, 100, 40])
def test_cut_is_the_quantile_of_all_rows(spark, n):
    """However few of each label are sampled, as many labelled rows lie below the cut as are bad."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, F.lit(True), n)
    scored = quality.score(docs, model).join(labels.select("doc_id", "quality").filter("quality in (0, 1)"), "doc_id")
    below, bad = scored.agg(F.count_if(F.col("score") < quality.CUT_SCORE), F.count_if(F.col("quality") == 0)).first()
    assert abs(below - bad) <= 2


def test_machine_gradient():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(rng.uniform(0.2, 1, 7), 3)
    p, ids, row, y = rng.normal(size=m.size), np.array([0, 3, 6, 1, 3, 5]), np.array([0, 0, 0, 2, 2, 2]), np.array([1, 0, 0])

    def loss(p):
        z = m.margins(p, ids, row, 3)[0]
        return (np.log1p(np.exp(-z)) * np.where(y == 1, 2.0, 0) + np.log1p(np.exp(z)) * (y == 0)).sum()
    w0, w, v = m.split(p)
    pair = sum(v[i] @ v[j] * m.value[i] * m.value[j] for i, j in itertools.combinations([0, 3, 6], 2))
    assert math.isclose(m.margins(p, ids, row, 3)[0][0], w0 + (w * m.value)[[0, 3, 6]].sum() + pair)
    g = m.gradient(p, ids, row, y, 2.0)
    steps = np.eye(m.size) * 1e-6
    assert np.allclose(g, [(loss(p + s) - loss(p - s)) / 2e-6 for s in steps], atol=1e-5)


def test_language_of_odd_documents(odd_docs, no_docs):
    model = langid.train(odd_docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(odd_docs, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[11]["lang_pred"] == "und" and got[12]["lang_pred"] == "en"
    assert langid.train(no_docs, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(odd_docs, None).collect()} == {"und"} and langid.predict(no_docs, model).count() == 0


def test_language_model(odd_docs, no_docs):
    """Base score and counts as defined; the score never depends on how rows are shared out."""
    got = hmm.score_documents(odd_docs, own=50, known=100, shared=16).collect()
    rows = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b""]) for r in odd_docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = [(i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in rows]
    order = lambda x: (str(x[0]), x[2], x[5])
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    again = hmm.score_documents(odd_docs.repartition(5), own=50, known=100, shared=16).collect()
    assert np.allclose(sorted(r["score"] for r in got), sorted(r["score"] for r in again), rtol=1e-6)
    assert hmm.score_documents(no_docs).count() == 0


def test_language_model_beats_single_words(spark):
    r = queries.op4_language_model(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_language_model_without_training(odd_docs):
    got = hmm.score_documents(odd_docs, folds=1, held_out=0).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)


def test_counts_and_forward_are_exact():
    """Expected counts and likelihood of short sequences against the sum over all paths."""
    rng = np.random.default_rng(4)
    pi, a, e = (x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 5))))
    flat, pieces = rng.integers(0, 5, 9).astype(np.int32), [(0, 5), (5, 4)]
    got = hmm.expected_counts(flat, pieces, (pi, a, e), 5)
    want = np.zeros_like(got)
    for s, n in pieces:
        obs, paths = flat[s:s + n], list(itertools.product(range(3), repeat=n))
        p = np.array([pi[q[0]] * np.prod([a[x, y] for x, y in zip(q, q[1:])]) * np.prod([e[x, o] for x, o in zip(q, obs)]) for q in paths])
        want[0] += np.log10(p.sum())
        for q, w in zip(paths, p / p.sum()):
            want[1 + q[0]] += w
            for x, y in zip(q, q[1:]):
                want[4 + 3 * x + y] += w
            for x, o in zip(q, obs):
                want[13 + 5 * x + o] += w
    assert np.allclose(got, want)
