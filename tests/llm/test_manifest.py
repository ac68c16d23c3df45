"""Merkle proofs against a tree built in one place."""
import hashlib
import zlib

import pytest

from corpuscope.llm import manifest, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """(last node, per leaf the list of (position, siblings) level by level)."""
    proofs = [[] for _ in leaves]
    at = list(range(len(leaves)))
    nodes = leaves
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 16 * 16:a // 16 * 16 + 16]
            proofs[i].append((a % 16, run[:a % 16] + run[a % 16 + 1:]))
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([d[1] for d in done])
    out = []
    for (own, subroot, proofs), up in zip(done, upper):
        for r, p in zip(own, proofs):
            p = p + up
            text, f = r[4], leaf(r)
            if r[0] is not None and text and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                f = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
            for at, s in p:
                f = h(*s[:at], f, *s[at:])
            out.append((r[0], leaf(r), subroot, root, h(*[x for _, s in p for x in s]), f, f == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, tasks", [(13, 1 << 12), (3, 40), (5, 64), (0, 17)])
def test_proofs(spark, monkeypatch, bits, tasks):
    """However the leaves are cut into parts and tasks."""
    monkeypatch.setattr(manifest, "PART_BITS", bits)
    monkeypatch.setattr(manifest, "LEAST_LEAVES", tasks)
    rows = [(i, f"s{i % 37}" if i % 3 else "hot", "en" if i % 2 else None, i % 7, f"Text {i} É\n") for i in range(700)]
    rows += [(None, "hot", None, None, None), (5, "hot", None, None, ""), (5, "hot", None, None, ""), (5, "hot", None, None, None), (9001, "", "x", 1, "A" * 100_000), (9002, "é", "", 0, "B"),
             (9003, None, None, None, "C"), (9004, None, None, None, "D"), (-3, "z", None, None, "Q")]
    df = spark.createDataFrame([r + (1, 2, 3, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, mid int, part int, n int, leaf string, proof string")
    got = sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in manifest.digest_table(df.repartition(5)).collect()), key=str)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_small_trees(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "PART_BITS", 2)
    for source in (lambda i: "one", lambda i: f"s{i:04}"):
        rows = [(i, source(i), None, None, "T") for i in range(n)]
        got = manifest.digest_table(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_nothing(spark, no_docs, odd_docs):
    assert manifest.digest_table(no_docs).count() == 0
    assert manifest.digest_table(odd_docs).count() == odd_docs.count()


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op12_manifest(spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_least_union():
    """Nothing fetched can be derived from the leaves and the rest, and what is fetched suffices."""
    for n in (1, 5, 16, 17, 100, 4097):
        for lo, hi in ((0, 1), (0, n), (n // 3, n // 2 + 1), (n - 1, n)):
            need = manifest.missing(lo, hi, n)
            assert len(set(need)) == len(need) and all(not lo >> 4 * k <= i <= (hi - 1) >> 4 * k for k, i in need)
            levels, last = manifest.shared_levels(lo, [f"{i:064}" for i in range(lo, hi)], n, {c: f"{c[1]:064}" for c in need})
            assert len(levels) == manifest.levels_of(n) and len(last) == 64
