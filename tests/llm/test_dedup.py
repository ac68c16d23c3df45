"""Exact, near and substring deduplication against brute force."""
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from made_up import words

from corpuscope.llm import exact_dedup, licenses, ngram_join, suffix_dedup


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact(odd_docs):
    got = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    groups = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts(odd_docs))
    digests = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in groups.items()}
    assert all(digests[r["text_sha256"]] == r["group_size"] for r in got)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(digests.keys())
    body = [r for r in got if r["doc_id"] == 4][0]
    assert body["group_size"] == 5 and body["kept"] and all(r["keep_id"] == 4 for r in got if r["text_sha256"] == body["text_sha256"])


def test_exact_rows_stay_once(odd_docs, no_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts(odd_docs)})
    assert exact_dedup.keep_first(no_docs).count() == 0 and exact_dedup.exact_dedup(no_docs).count() == 0


def test_full_filter_loses_nothing(small):
    """A filter far too small lets rows through but changes no result."""
    a = exact_dedup.exact_dedup(small, max_cells=64)
    b = exact_dedup.exact_dedup(small)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = find(i)
            ids[r] = min(ids.get(r, key), key)
    return sorted(((key, len(s), ids.get(find(i), None)) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("few, frequent", [(ngram_join.FEW, ngram_join.FREQUENT), (1, 0)])
def test_components(spark, odd_docs, small, monkeypatch, few, frequent):
    """Also with every shingle in the frequent class and every entry worked by hubs."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    base = words(5, 120)
    near = [(1000 + i, " ".join(base[:i % 9] + ["x"] + base[i % 9 + 1:100 + i % 20])) for i in range(25)]
    docs = odd_docs.select("doc_id", "text").union(small.select("doc_id", "text").filter("doc_id < 100").selectExpr("doc_id + 5000", "text")).union(
        spark.createDataFrame(near, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()), key=str)
    assert got == brute_components(texts(docs))


@pytest.mark.parametrize("carried", [ngram_join.CARRIED, 2])
def test_a_pair_comes_from_one_of_its_entries(spark, monkeypatch, carried):
    """Sets that share many entries meet once, and none of the pairs that ranks allow is lost."""
    monkeypatch.setattr(ngram_join, "CARRIED", carried)
    rng = np.random.default_rng(2)
    size, root, ranks = 100, rng.integers(0, 12, 30), rng.integers(0, 26, (30, 20))
    held = [(e * 7 - 50, a) for e in range(20) for a in range(30) if rng.random() < .8]
    members = spark.createDataFrame([(e, a, size, int(ranks[a, (e + 50) // 7]), int(root[a])) for e, a in held], "entry long, a long, size int, rank int, root long")
    got = [(r["a"], r["b"]) for r in ngram_join._apart_rows(members).collect()]
    spare = size - (6 * size + 6) // 7
    met = [(a, b) for e, a in held for f, b in held if e == f and a < b and root[a] != root[b] and max(ranks[a, (e + 50) // 7], ranks[b, (e + 50) // 7]) <= spare]
    assert set(got) == set(met)
    assert carried == 2 or len(got) == len(set(got)) < len(met) / 2


def test_components_of_nothing(no_docs):
    assert ngram_join.ngram_components(no_docs).count() == 0
    assert ngram_join.keep_one(no_docs).columns == no_docs.columns


def test_near_copies_keep_one(odd_docs):
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 4 in ids and 5 not in ids and 6 not in ids and 7 in ids and 8 not in ids and 9 in ids and 10 not in ids and {1, 2, 3} <= set(ids)


def test_index_shares_an_entry():
    """Any two linked sets share an index entry, whatever the order and the frequent class."""
    rng = np.random.default_rng(3)
    for case in range(300):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        m = ngram_join.missing(len(x))
        y = np.unique(np.concatenate([rng.permutation(x)[:len(x) - m // 2], rng.integers(0, 2**63, m // 3).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        hot = lambda s: (s % np.uint64(10)) < np.uint64(case % 11)
        sides = []
        for s in (x, y):
            f = hot(s)
            e = [ngram_join.entries(s, np.lexsort((s, f)), f, True)] if 3 * len(s) < 4 * ngram_join.SHORT else []
            if len(s) >= ngram_join.SHORT:
                e.append(ngram_join.entries(s, np.lexsort((s, f)), f, False))
            sides.append(list(zip(np.concatenate([a for a, _ in e]).tolist(), np.concatenate([b for _, b in e]).tolist())))
        lowest = [{}, {}]
        for own, low in zip(sides, lowest):
            for entry, rank in own:
                low[entry] = min(rank, low.get(entry, rank))
        both = [k for k in lowest[0] if k in lowest[1]]
        fits = ngram_join._fits(np.full(len(both), len(x)), np.array([lowest[0][k] for k in both]), np.full(len(both), len(y)), np.array([lowest[1][k] for k in both]))
        assert fits.any()


def family(rng, n, size, change):
    """Sets that share a base of which each replaces a share by shingles of its own."""
    base = rng.integers(0, 2**63, size)
    return [np.unique(np.where(rng.random(size) < change, rng.integers(0, 2**63, size), base).astype(np.uint64)) for _ in range(n)]


@pytest.mark.parametrize("change, share", [(.2, 0), (.25, 0), (.4, 0)])
def test_far_families_do_not_meet(change, share):
    """Sets of a family that are far from each other share entries, but at ranks that rule a link out."""
    sets = family(np.random.default_rng(5), 40, 400, change)
    count = Counter(v for s in sets for v in s.tolist())
    met = 0
    entries = []
    for s in sets:
        common = np.array([count[v] > 1 for v in s.tolist()])
        e, r = ngram_join.entries(s, np.lexsort((s, common)), np.zeros(len(s), bool), False)
        entries.append(dict(zip(e.tolist(), r.tolist())))
    for i in range(40):
        for j in range(i):
            both = [k for k in entries[i] if k in entries[j]]
            n = len(both)
            met += bool(ngram_join._fits(np.full(n, len(sets[i])), np.array([entries[i][k] for k in both]), np.full(n, len(sets[j])), np.array([entries[j][k] for k in both])).any()) if n else 0
    assert met <= share * 780


def brute_cut(rows, length):
    count = Counter(b[i:i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for key, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, many", [(400, 2000), (400, 1), (60, 2000)])
def test_repeats(spark, odd_docs, small, monkeypatch, length, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    run = " ".join(words(8, 90))
    extra = [(900, run + " a " + run), (901, "b " + run[3:]), (902, run[:399]), (903, "é" * 250), (904, "xé" * 150 + "é" * 200)]
    docs = odd_docs.filter("doc_id is null or doc_id not in (7, 8)").select("doc_id", "text").union(
        small.select("doc_id", "text").filter("doc_id < 60").selectExpr("doc_id + 5000", "substr(text, 1, 3000)")).union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, length=length).collect()), key=str)
    assert got == brute_cut(texts(docs), length)


def test_planted_passages(spark):
    """Passages shared by two documents go exactly from 400 bytes on, whatever their number of words."""
    rows, want = [], {}
    for i, n in enumerate([300, 350, 380, 399, 400, 401, 430, 500, 650, 800]):
        passage = " ".join(words(500 + i, 300))[:n]
        for k in range(2):
            key = 2 * i + k
            rows.append((key, " ".join(words(900 + key, 40)) + f"<{k}" + passage + f"{k}>" + " ".join(words(1900 + key, 40))))
            want[key] = n if n >= 400 else 0
    assert all(len(" ".join(words(500 + i, 300))[:n].split()) > 50 for i, n in enumerate([300, 350]))  # over 50 words, and shorter than 400 bytes
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_repeats_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_cover_has_every_difference():
    for q in (2, 3, 5, 17):
        v, d = suffix_dedup.difference_cover(q)
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) == q + 1


def test_licenses(odd_docs, no_docs):
    spark = odd_docs.sparkSession
    rows = [(1, "x " * 40 + "Released under the MIT license" + " y" * 40), (2, "released under the MIT"), (3, None),
            (4, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met"), (5, "")]
    got = {(r["doc_id"], r["license"]) for r in licenses.find_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (4, "BSD-3-Clause")}
    assert licenses.find_notices(odd_docs).count() == 0 and licenses.find_notices(no_docs).count() == 0
    assert licenses.find_notices(odd_docs, templates=[("short", "too few words")]).count() == 0
