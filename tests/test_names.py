"""Names in texts: the automaton, its blocks, and the counts that documents get from it."""
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import names as NM, quality as Q, repair as RP

NAMES = ["a", "ab", "order_search", "Order Search", "Order", "é", "né", "zz top", "FR-1", "x" * 300, "never there"]
TEXTS = ["reorder_searching", "Order Searches", "", None, "née", "b" * 50 + "ab", "y" + "x" * 301, "zz  top zz top", "FR-12", "nothing"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20, 1])
def test_names_as_by_search(spark, block_bytes):
    docs = spark.createDataFrame([(f"d{i}", "r", t, 7) for i, t in enumerate(TEXTS)], "doc_key string, repo string, text string, more int")
    names = spark.createDataFrame([(n,) for n in [*NAMES, "", None, "a"]], "name string")
    got = {r["doc_key"]: sorted(r["names"]) for r in NM.with_names(docs, names, block_bytes=block_bytes).collect()}
    assert got == {f"d{i}": sorted(n for n in NAMES if n in (t or "")) for i, t in enumerate(TEXTS)}


def test_without_the_automaton_package(spark, monkeypatch):
    import builtins
    plain = builtins.__import__
    docs = spark.createDataFrame([("d", "xaby")], "doc_key string, text string")
    names = spark.createDataFrame([("ab",), ("by",), ("q",)], "name string")
    monkeypatch.setattr(builtins, "__import__", lambda n, *a, **k: (_ for _ in ()).throw(ImportError(n)) if n == "ahocorasick" else plain(n, *a, **k))
    assert NM.with_names(docs, names).first()["names"] == ["ab", "by"]


def _inputs(spark, n=60):
    docs = spark.createDataFrame([(f"d{i}", "hot" if i % 3 else f"r{i % 5}", f"text {i} Order Search FR-12 " + ("user login" if i % 2 else "")) for i in range(n)],
                                 "doc_key string, repo string, text string")
    feats = spark.createDataFrame([(r, f"f{k}", name, k) for r in ("hot", "r0", "r1") for k, name in enumerate(["order_search", "user login", "lost_thing", ""])],
                                  "repo string, feature_id string, name string, ord int")
    frs = spark.createDataFrame([(r, f"FR-{k}", name, k) for r in ("hot", "r1", "r2") for k, name in ((1, "order_search"), (2, "user login"), (12, "lost_thing"))],
                                "repo string, req_id string, linked_feature string, ord int")
    return docs, feats, frs


def test_traceability_by_pairs(spark):
    """Counts and lists equal those of looking for every name and id in every document of its repository."""
    docs, feats, frs = _inputs(spark)
    missing, score = set(), {}
    for d in docs.collect():
        own = [(f["name"], f["name"].replace("_", " ").title()) for f in feats.collect() if f["repo"] == d["repo"] and f["name"]]
        ids = [r["req_id"] for r in frs.collect() if r["repo"] == d["repo"]]
        lost = [("feature", s) for n, s in own if n not in d["text"] and s not in d["text"]] + [("requirement", i) for i in ids if i not in d["text"]]
        missing |= {(d["doc_key"], *x) for x in lost}
        total = len(own) + len(ids)
        score[d["doc_key"]] = (10000 if not total else (2 * 10000 * (total - len(lost)) + total) // (2 * total), len(lost))
    assert {tuple(r) for r in Q.missing_references(docs, feats, frs).collect()} == missing
    assert {r["doc_key"]: (r["traceability"], r["n_missing"]) for r in Q.score_traceability(docs, feats, frs).collect()} == score


@pytest.mark.parametrize("keys", ["own", "shared"])
def test_appendix_of_own_and_shared_keys(spark, monkeypatch, keys):
    """Both ways list the same, and only keys that are not a document's own meet the features row by row."""
    docs, feats, frs = _inputs(spark)
    docs = docs.withColumn("text", F.when(F.col("doc_key") == "d4", None).when(F.col("doc_key") == "d5", "lost_thing and FR-2").otherwise(F.col("text")))
    frs = frs.unionByName(spark.createDataFrame([("hot", "FR-13", "elsewhere", 13), ("hot", "FR-14", "order_search", 14), ("hot", None, "lost_thing", 15), ("hot", "FR-1", "lost_thing", 16)], frs.schema))
    refs, linked = Q.references(docs, feats), frs.select("repo", F.col("linked_feature").alias("name"), "req_id", F.col("ord").alias("fr_ord"))
    plain = sorted(map(tuple, RP._shared_appendix(refs, feats, linked, frs).collect()))
    met, lacking = [], Q.lacking_features
    monkeypatch.setattr(Q, "lacking_features", lambda r, f: met.extend(x["doc_key"] for x in r.collect()) or lacking(r, f))
    if keys == "own":
        assert sorted(map(tuple, RP.traceability_appendix(docs, feats, frs).collect())) == plain and not met
        assert {(0, "| Order Search | FR-1, FR-14 | — |"), (2, "| Lost Thing | FR-12, FR-1 | — |")} <= {x[1:] for x in plain if x[0] == "d4"}
        return
    more = docs.unionByName(docs.filter("doc_key in ('d5', 'd7')")).unionByName(docs.filter("doc_key in ('d8', 'd10')").withColumn("doc_key", F.lit(None).cast("string")))
    want = sorted(map(repr, map(tuple, RP._shared_appendix(Q.references(more, feats), feats, linked, frs).collect())))
    met.clear()
    assert sorted(map(repr, map(tuple, RP.traceability_appendix(more, feats, frs).collect()))) == want and set(met) == {"d5", "d7", None}


def _joins_with_text(df):
    """Joins of the plan with a text below them; held tables do not have it any more."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Join" in plan and re.search(r"\btext#", plan)


def test_no_join_carries_text(spark):
    docs, feats, frs = _inputs(spark)
    assert not _joins_with_text(Q.missing_references(docs, feats, frs)) and not _joins_with_text(Q.score_traceability(docs, feats, frs))
    assert not _joins_with_text(RP.traceability_appendix(docs, feats, frs))


def test_issue_texts(spark):
    docs, feats, frs = _inputs(spark, 4)
    ev = spark.createDataFrame([("hot", *[False] * 8)], "repo string, has_kubernetes boolean, has_docker boolean, has_gdpr_mention boolean, has_http_api boolean, has_grpc boolean, has_android boolean, has_ios boolean, other boolean")
    more = docs.withColumn("text", F.concat("text", F.lit("\nFR-77 maybe\nNFR-3 TBD\nRuns on Docker and is user friendly\n## 1. Executive Summary\nshort\n## 4. Stakeholders\n| Role |\n| Admin | x |\n")))
    got = {(r["dimension"], r["issue"]) for r in Q.document_issues(more, feats, frs, ev).filter("doc_key = 'd1'").collect()}
    assert {(3, "BRD references 'FR-77' which is NOT present in the input functional requirements. Potential hallucination."),
            (2, "Feature 'Lost Thing' from input is not referenced in the BRD."),
            (2, "Functional requirement 'FR-2' from input is not referenced in the BRD."),
            (8, "Executive Summary is too shallow (1 words). Should be ≥ 60 words with project-specific content."),
            (9, "[GROUNDING] BRD mentions 'Docker' but evidence key 'has_docker' is False. This claim may not be supported by the repository.")} <= got
    assert any(d == 5 and i.startswith("FR-77 does not contain a testable verb") for d, i in got) and any(d == 6 and i.startswith("NFR-3 contains") for d, i in got)
    assert any(d == 7 and "generic roles" in i for d, i in got)


@pytest.mark.parametrize("reader", ["names", "matcher"])
def test_a_task_has_a_piece_of_a_batch_at_a_time(spark, monkeypatch, reader):
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from corpuscope.operators import matcher
    sent = []
    monkeypatch.setattr(Classic, "mapInArrow", lambda df, part, schema: sent.append(part) or df)
    n = 1000
    if reader == "names":
        docs = spark.createDataFrame([("d", "r", "t")], "doc_key string, repo string, text string")
        NM._matched(docs, spark.createDataFrame([("order",)], "name string"), "text", "names")
        batch = pa.record_batch({"text": ["no order"] * n, "doc_key": [str(i) for i in range(n)], "repo": ["r"] * n})
    else:
        files = spark.createDataFrame([("r", "p", ".py", True, "t")], "repo string, path string, ext string, in_web boolean, content string")
        matcher.tagged_matches(files, [matcher.Search("f", "s", "order", "in_web")])
        batch = pa.record_batch({"repo": ["r"] * n, "path": [str(i) for i in range(n)], "ext": [".py"] * n, "in_web": [True] * n, "content": ["no order"] * n})
    out = list(sent[0](iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= NM.PIECE_ROWS
    assert [x for b in out for x in b.column(0 if reader == "names" else 1).to_pylist()] == [str(i) for i in range(n)]
    assert all(len(x) == 1 for b in out for x in b.column(b.num_columns - 1).to_pylist())


def test_fixed_rows_need_no_python_task(spark):
    from corpuscope.session import fixed_rows
    rows = [(1, "a", True), (2, None, False)]
    df = fixed_rows(spark, rows, "i int, s string, b boolean")
    assert [tuple(r) for r in df.collect()] == rows and df.dtypes == [("i", "int"), ("s", "string"), ("b", "boolean")]
    assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()
