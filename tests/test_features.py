"""Features, numbering, documents, reports."""
from pyspark.sql import functions as F

from corpuscope.operators import features as FT, numbering as N, quality as Q, repair as RP, report as R, requirements as RQ
from corpuscope.plans import analyze as A
from corpuscope.queries import Tables
from corpuscope.rules import documents as D, packs as P
from corpuscope.sources import sinks

FLAGS = ["has_http_api", "has_grpc", "has_docker", "has_kubernetes", "has_android", "has_ios", "has_gdpr_mention"]
NO_FEATURES = "repo string, name string, ord int"
NO_FRS = "repo string, req_id string, linked_feature string, ord int"


def _ev(spark, **true):
    return spark.createDataFrame([("r", *[bool(true.get(f)) for f in FLAGS])], "repo string, " + ", ".join(f"{f} boolean" for f in FLAGS))


def _doc(spark, text):
    return spark.createDataFrame([("d", "r", text)], "doc_key string, repo string, text string")


def test_big_groups_are_numbered_like_small_ones(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))).alias("k"),
                                  F.sha1(F.col("id").cast("string")).alias("v"))
    small = N.number_rows(df, ["k"], ["v"])
    big = N.number_rows(df, ["k"], ["v"], hot_rows=10)
    assert small.exceptAll(big).count() == 0 and big.exceptAll(small).count() == 0


def test_batches(spark):
    df = spark.range(20).select(F.lit("r").alias("repo"), "id")
    assert [r["count"] for r in N.batches(df, ["repo"], ["id"], 8).groupBy("batch").count().orderBy("batch").collect()] == [8, 8, 4]


def test_keywords_are_found_in_whole_files(spark, files):
    """A keyword behind the first 500 characters counts; a file counts once for a feature; hot words by brute force."""
    tree = {"hot": {f"src/f{i}.py": "x " * 300 + ("service " if i % 2 else "") + ("Billing\n" if i % 3 else "") + ("invoice service" if i % 5 == 0 else "") for i in range(30)},
            "r2": {"tests/test_a.py": "billing", "b.py": "nothing here"}}
    data = files(tree)
    names = ["Billing Service", "Invoice Service", "Service", "Lost", "a_b", "billing invoice"]
    feats = spark.createDataFrame([(r, f"f{k}", n, k) for r in ("hot", "r2") for k, n in enumerate(names)], "repo string, feature_id string, name string, ord int")
    rows = [(r.repo, r.path, (r.path + "\n" + r.content).lower()) for r in data.collect()]
    want = {}
    for repo in ("hot", "r2"):
        for k, n in enumerate(names):
            words = [w for w in n.lower().replace(" ", "_").split("_") if len(w) >= 3]
            hit = [p for r, p, t in rows if r == repo and any(w in t for w in words)]
            if hit:
                want[repo, f"f{k}"] = (len(hit), sum("test" in p for p in hit))
    assert {(r.repo, r.feature_id): (r.n_files, r.n_negative) for r in FT.feature_file_counts(feats, data).collect()} == want
    assert FT.feature_file_counts(feats, data, head=500).filter("repo = 'hot'").count() == 0
    plan = FT.feature_file_counts(feats, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan  # texts end in the row of their file


def test_contains_join_equals_cross_check(spark):
    hay = [("r", w) for w in ("ab", "abc", "controller", "x", "aaa", "service_api")]
    needles = [("r", n, i) for i, n in enumerate(("a", "ab", "roll", "controller", "zz", "aa", "api"))]
    h = spark.createDataFrame(hay, "repo string, w string")
    n = spark.createDataFrame(needles, "repo string, n string, i int")
    got = sorted((r.w, r.n) for r in FT.contains_join(h, "w", n, "n", ["repo"]).collect())
    assert got == sorted((w, x) for _, w in hay for _, x, _ in needles if x in w)


FEATURE_NAMES = [
    "container_orchestration_config", "ci_cd_pipeline_config", "token_based_authentication",
    "secret_credential_management", "domain_entity_modelling", "domain_service_layer",
    "Order Search", "order search", "User Login", "USER LOGIN", "dashboard_report", "test_suite_runner",
]


def _seed(spark):
    """Twelve features of three repositories, with case variants and members of merge groups."""
    rows = [(f"src{r}", f"in-{n:02d}", name, f"Feature {name}.", 30 + (17 * n + 5 * r) % 70, n) for r in range(3) for n, name in enumerate(FEATURE_NAMES, 1)]
    return spark.createDataFrame(rows, "repo string, feature_id string, name string, description string, conf int, ord int")


def test_merging_by_hand(spark):
    """Case variants become one row with the best member; synonyms become one group; ids follow confidence."""
    seed = _seed(spark)
    deduped = {(r.repo, r.name.lower()): r for r in FT.dedupe_features(seed).collect()}
    assert len(deduped) == 3 * 10 and deduped["src0", "order search"].members == 2
    best = max((r for r in seed.collect() if r.repo == "src0" and r.name.lower() == "user login"), key=lambda r: (r.conf, -r.ord))
    assert (deduped["src0", "user login"].name, deduped["src0", "user login"].conf) == (best.name, best.conf)
    done = FT.validate_features(seed).collect()
    groups = {n for n in FEATURE_NAMES if n in P.MERGE_GROUPS}
    assert groups and all(sum(r.members for r in done if r.repo == f"src{k}") == 12 for k in range(3))
    for k in range(3):
        own = sorted((r for r in done if r.repo == f"src{k}"), key=lambda r: r.ord)
        assert [r.feature_id for r in own] == [f"feat-{i:03d}" for i in range(1, len(own) + 1)]
        assert [(-r.conf, r.name) for r in own] == sorted((-r.conf, r.name) for r in own)
    members = FT.merge_members(seed, FT.validate_features(seed))
    assert members.count() == 36 and members.select("repo", "merged_id").distinct().count() == 36


def test_dedupe_is_idempotent(spark):
    once = FT.dedupe_features(_seed(spark))
    twice = FT.dedupe_features(once)
    cols = ["repo", "name", "description", "conf", "members"]
    assert once.select(cols).exceptAll(twice.select(cols)).count() == 0


def test_grounding_scores(spark):
    cases = [("Plain text", {}, 10000), ("Runs on Kubernetes", {}, 0), ("Runs on Kubernetes", {"has_kubernetes": True}, 10000),
             ("Docker and gRPC", {"has_docker": True}, 5000), ("scenarios", {}, 10000), ("GDPR rules", {}, 0), ("iOS clients", {"has_ios": True}, 10000)]
    for text, flags, points in cases:
        row = Q.grounding_scores(Q.text_scores(_doc(spark, text)), _ev(spark, **flags)).first()
        assert row.grounding == points, text
    nobody = _ev(spark).filter("repo = 'other'")
    assert Q.grounding_scores(Q.text_scores(_doc(spark, "Kubernetes")), nobody).first().grounding == 10000


def test_ungrounded_claim_lowers_the_score(spark):
    text = "\n".join(h + "\n" + "word " * 70 for h in D.HEADINGS) + "\nKubernetes"
    feats, frs = spark.createDataFrame([], NO_FEATURES), spark.createDataFrame([], NO_FRS)
    good = Q.score_document(_doc(spark, text), feats, frs, _ev(spark, has_kubernetes=True)).first()
    bad = Q.score_document(_doc(spark, text), feats, frs, _ev(spark)).first()
    assert bad.score < good.score and bad.needs_revision


def test_repair_clears_phrases_and_claims(spark):
    """Repair never lowers completeness, clarity or grounding. The mean may fall: a stub for a
    missing section makes that section count as shallow."""
    t = Tables(spark, "/root/testdata/sf0.001")
    docs = t.docs.filter("doc_key like 'doc1%'")
    first = {r.doc_key: r for r in Q.score_document(docs, t.features, t.frs, t.evidence).collect()}
    rows = RP.repair_loop(docs, t.features, t.frs, t.evidence).collect()
    assert len(rows) == len(first) > 0 and all(0 <= r.iterations <= 2 for r in rows)
    for r in rows:
        for d in ("completeness", "clarity", "grounding"):
            assert r[d] >= first[r.doc_key][d]
        assert r.iterations == 0 or (r.clarity == 1.0 and r.grounding == 1.0)
    assert any(r.iterations for r in rows)


def test_revision_log_replays(spark):
    """Edits are rows whose offsets point at the old text, and replaying them gives the repaired text."""
    texts = ["User-friendly and USER-FRIENDLY, as needed.\n\n\n\nDocker and Docker\n| a | Kubernetes | b |\n", "", None, "  plain  ", "etc. etc.\n" * 3]
    docs = spark.createDataFrame([(f"d{i}", "r", t) for i, t in enumerate(texts)], "doc_key string, repo string, text string").na.fill("", ["text"])
    ev = _ev(spark)
    log = RP.revision_log(docs, ev)
    done = {r.doc_key: r.text for r in RP.logged_pass(docs, ev).collect()}
    marked = docs.withColumn("iterations", F.lit(0))
    scores = docs.select("doc_key", F.lit(True).alias("needs_revision"))
    assert done == {r.doc_key: r.text for r in RP.repair_pass(marked, scores, ev).collect()}
    assert done == {r.doc_key: r.text for r in RP.replay(docs, log).collect()}
    first = [r for r in log.filter("doc_key = 'd0' and kind = 'clarity'").orderBy("step", "n").collect()]
    assert [(r.old, r.at, r.n) for r in first][:2] == [("User-friendly", 1, 1), ("USER-FRIENDLY", 1 + len("User-friendly and "), 2)]
    assert log.filter("doc_key = 'd4' and old = 'etc.'").count() == 6
    t = Tables(spark, "/root/testdata/sf0.001")
    assert RP.replay(t.docs, RP.revision_log(t.docs, t.evidence)).exceptAll(RP.logged_pass(t.docs, t.evidence).select("doc_key", "repo", "text")).count() == 0


def test_full_run_and_report_parts(spark, files, tmp_path):
    tree = {"one": {"README.md": "# one\nGDPR", "src/main.py": '"""Doc."""\n@app.get("/orders/list")\ndef x(): pass\n', "Dockerfile": "FROM x",
                    "src/user_service.py": "class UserService: pass", "requirements.txt": "flask==2\nmysqlclient==1"},
            "two": {"lib/a.kt": "data class Pet(val id: Long, val name: String)", "notes.txt": "n"}}
    run = A.full_run(files(tree), "January 01, 2026")
    docs = {r.repo: r for r in run["documents"].collect()}
    assert set(docs) == {"one", "two"} and all(h in docs["one"].text for h in D.HEADINGS)
    assert docs["one"].completeness == 1.0 and docs["one"].traceability == 1.0 and docs["one"].phantom_ids == 1.0
    whole = {r.repo: r.text for r in R.render_report(run["lines"]).collect()}
    parts = R.render_report(run["lines"], part_lines=7).collect()
    for repo, text in whole.items():
        assert "\n".join(p.text for p in sorted((p for p in parts if p.repo == repo), key=lambda p: p.part)) == text
    sinks.write_documents(run["lines"], str(tmp_path / "docs"))
    read = spark.read.text(str(tmp_path / "docs")).filter("repo = 'one'").count()
    assert read == len(whole["one"].split("\n"))
    done = A.convert(A.extract(files(tree)))
    assert done["requirements"].count() == done["features"].count() > 0 and done["summary"].count() == 2


def test_priorities(spark):
    df = spark.createDataFrame([("api", 15), ("api", 90), ("feature_detection", 15), ("unknown", 90)], "c string, conf int")
    assert [r.p for r in df.select(RQ.requirement_priority(F.col("c"), F.col("conf")).alias("p")).collect()] == ["Medium", "High", "Low", "Low"]


def test_a_long_report_is_scored_and_repaired(spark, files):
    """A report of more than 20,000 lines is one document and passes through the repair like others."""
    run = A.full_run(files({"one": {"src/a.py": "x"}}), "January 01, 2026")
    lines = run["lines"]
    more = spark.range(25_000).select(F.col("id").alias("k")).crossJoin(lines.limit(1)).withColumn("ord", (F.col("k") + 1000).cast(lines.schema["ord"].dataType)) \
        .withColumn("line", F.concat(F.lit("row "), F.col("k").cast("string"))).select(*lines.columns)
    r = R.render_report(lines.unionByName(more)).first()
    assert r.part == 0 and r.n_lines > 25_000 and r.text.count("\n") == r.n_lines - 1


def test_repair_loop_reads_changed_texts_only(spark, monkeypatch):
    """The scoring after a pass meets the documents whose text it changed; the others keep their scores."""
    docs = spark.createDataFrame([("d0", "r", "User-friendly, etc.\n\n\n\nFR-9 runs"), ("d1", "r", "  plain  "), ("d2", "r", "")], "doc_key string, repo string, text string")
    features = spark.createDataFrame([("r", "feat-001", "order_search", 1)], "repo string, feature_id string, name string, ord int")
    frs = spark.createDataFrame([("r", "FR-1", "order_search", 1)], "repo string, req_id string, linked_feature string, ord int")
    asked, score = [], Q.score_document
    monkeypatch.setattr(Q, "score_document", lambda d, *rest: asked.append(d.count()) or score(d, *rest))
    rows = RP.repair_loop(docs, features, frs, _ev(spark)).collect()
    assert [r.iterations for r in rows] == [2, 2, 2] and asked == [3, 3, 0]
    assert {r.doc_key: r.score for r in rows} == {r.doc_key: r.score for r in score(docs.sparkSession.createDataFrame([(r.doc_key, r.repo, r.text) for r in rows], "doc_key string, repo string, text string"), features, frs, _ev(spark)).collect()}
