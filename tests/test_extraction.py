"""Hand-checked cases for scanning, classification, extraction and evidence."""
import pytest
from pyspark.sql import functions as F

from corpuscope.functions import text as TX
from corpuscope.operators import chunks as C, classify as CL, code, evidence as E, learn as L, manifests as M, modules as MO, signals as S
from corpuscope.rules.languages import REGISTRY
from corpuscope.sources import files as FS, registry as RG, sinks
from corpuscope.streaming import files as stream


def test_registry_sizes():
    assert len(REGISTRY.languages) == 49 and len(REGISTRY.entry_points) == 69 and len(REGISTRY.build_files) == 65


@pytest.mark.parametrize("ext,language", [(".py", "python"), (".kt", "kotlin"), (".cbl", "cobol"), (".pbl", "powerbuilder"),
                                          (".tsx", "tsx"), (".swift", "swift"), (".m", "objective_c"), (".xyz", "unknown")])
def test_language(spark, ext, language):
    df = spark.createDataFrame([(ext,)], "ext string")
    assert CL.with_language(df).first().language == language


def test_registry_file_and_tiers(spark, tmp_path):
    path = tmp_path / "reg.json"
    path.write_text('{"languages": {"aa": {"extensions": [".A1"], "role": "backend", "entry_points": ["Go.a1"], "build_files": []}},'
                    '"inferred": {"_note": {"extensions": []}, "zz": {"extensions": [".a1", ".z9"], "role": "docs"}}}')
    rows = {r.ext: (r.language, r.tier) for r in RG.load_language_registry(spark, str(path)).collect()}
    assert rows == {".a1": ("aa", "curated"), ".z9": ("zz", "inferred")}
    reg = RG.registry_from(spark, str(path))
    assert reg.entry_points == ("go.a1",) and len(reg.lang_ext) == 2


def test_archetype_and_pack_files(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text('{"archetypes": {"x": {"keywords": ["k1", "k2"], "display": "X", "fragment": "an x"}}}')
    assert RG.archetypes_from(RG.load_archetypes(spark, str(a))) == {"x": (["k1", "k2"], "X", "an x")}
    p = tmp_path / "p.json"
    p.write_text('{"packs": {"q": {"evidence_flags": ["has_docker"], "dependency_keywords": ["d"], "file_patterns": ["**/x"], "confidence_threshold": 0.5}}}')
    assert RG.packs_from(RG.load_pack_rules(spark, str(p))) == {"q": (0.5, ["has_docker"], ["d"], ["**/x"])}


def test_read_tree_drops_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "one" / "blob.dat").write_bytes(b"\xff\xfe\x00\x81")
    out = FS.drop_binary(FS.scan_files(FS.read_tree(spark, str(tmp_path))))
    assert [(r.repo, r.path, r.ext, r.size) for r in out.collect()] == [("one", "src/a.py", ".py", 6)]


def test_chunks_join_back_and_cut_on_lines(files):
    text = "a" * 1999 + "\n" + "b" * 1499 + "\n" + "c\n"
    rows = C.chunk_lines(CL.classify_files(files({"x.py": text, "long.txt": "z" * 9000, "empty.txt": ""}))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.chunk_no):
        by.setdefault(r.path, []).append(r.content)
    assert [len(c) for c in by["x.py"]] == [3500, 2] and "".join(by["x.py"]) == text
    assert len(by["long.txt"]) == 1 and "empty.txt" not in by


def test_entities(files):
    out = code.entities(files({"a/User.kt": "data class User(val id: Long, val name: String)",
                               "b/Acc.java": '@Entity @Table(name="users") class Acc {\n private Long id;\n}',
                               "b/AccTest.java": "@Entity class Hidden {}", "c/T.kt": "data class Tiny(val a: Int)"}))
    got = {r.name: (r.entity_type, r.table_name, r.fields) for r in out.collect()}
    assert got == {"User": ("data_class", None, ["id", "name"]), "Acc": ("jpa_entity", "users", ["id"])}


def test_request_mapping_and_handler(files):
    src = '@Controller\nclass Web {\n@RequestMapping(method = RequestMethod.GET, value = "/x")\nfun load() {}\n@GetMapping("")\n}'
    rows = code.spring_endpoints(files({"app/Web.kt": src, "app/test/T.kt": src})).collect()
    assert sorted((r.method, r.path, r.handler) for r in rows) == [("GET", "/", "Web"), ("GET", "/x", "Web.load")]


def test_dependencies_first_wins(files):
    out = M.dependencies(files({"build.gradle": 'id("org.jetbrains.kotlin.jvm") version "1.9.0"\nimplementation("g:a:1.0")',
                                "pom.xml": "<parent><artifactId>boot</artifactId><version>2</version></parent>",
                                "requirements.txt": "A==1\na == 1\n# c\nb\n", "sub/requirements.txt": "a==1"}))
    got = sorted((r.name, r.version, r.category) for r in out.collect())
    assert got == [("A", "1", "library"), ("b", "unspecified", "library"), ("boot", "2", "framework"), ("g:a", "1.0", "library"), ("jvm", "1.9.0", "build")]


@pytest.mark.parametrize("tree,expected", [
    ({"a.txt": "x"}, {"platform": "library", "has_docker": False, "has_tests": False, "has_auth": False}),
    ({"app/src/main/AndroidManifest.xml": "<m/>"}, {"has_android": True, "platform": "android"}),
    ({"Dockerfile": "FROM x"}, {"has_docker": True, "has_kubernetes": False}),
    ({"k8s/deployment.yaml": "kind: Deployment\n"}, {"has_kubernetes": True}),
    ({"ops/s.yml": "a: 1\nkind: Service\n"}, {"has_kubernetes": True}),
    ({"README.md": "We follow GDPR."}, {"has_gdpr_mention": True}),
    ({"README.md": "We follow habits."}, {"has_gdpr_mention": False}),
    ({"requirements.txt": "spring-security-core==1"}, {"has_auth": True, "has_database": False}),
    ({"requirements.txt": "mysql-connector-java==8"}, {"has_database": True, "build_tool": "pip", "primary_language": "python"}),
    ({"c/A.java": '@RestController class A {\n@GetMapping("/a")\n@PostMapping("/b")\n}'}, {"has_http_api": True, "n_endpoints": 2, "platform": "server"}),
])
def test_evidence(evidence_of, tree, expected):
    ev = evidence_of(tree)
    assert {k: ev[k] for k in expected} == expected


def test_rule_tests_agree_with_regexes(spark):
    """The cheap form of every ignore-case rule gives what the regex itself gives."""
    from corpuscope.rules import signals as R
    samples = ["KFold", "x.ACC y", "boto3 client('s3')", "Assert  len(x)", "f1 ", "app.use(handle, err)", "JWT.verify", "BLEU", "nothing",
               "class A(nn.Module)", "perplexity", "@app.post predict", "Authorization:  Basic", "rate-limit", "FOR   epoch", "ppl", "GS://b"]
    df = spark.createDataFrame([(s,) for s in samples], "content string").withColumn("lowered", F.lower("content"))
    regexes = sorted({r.regex for r in R.presence_rules()})
    pairs = df.select(*[F.expr(TX.occurs(rx)).alias(f"a{i}") for i, rx in enumerate(regexes)],
                      *[F.col("content").rlike(rx).alias(f"b{i}") for i, rx in enumerate(regexes)]).collect()
    for row in pairs:
        for i, rx in enumerate(regexes):
            assert row[f"a{i}"] == row[f"b{i}"], rx


def test_dummy_repo_features(files):
    tree = {"README.md": "# demo", "src/auth.py": "def login(): pass", "src/db.py": "import sql", "package.json": "{}"}
    got = {r.feature for r in C.keyword_features(files(tree)).collect()}
    assert {"Authentication", "Database"} <= got


def test_learning(spark, files):
    tree = {"a/p.abcml": "PROGRAM DIVISION.\n" + "x" * 1500, "b/q.xyz": "?", "c/r.py": "x"}
    classified = CL.classify_files(files(tree))
    snips = L.unknown_extensions(classified, RG.lang_ext(spark)).collect()
    assert {r.ext for r in snips} == {".abcml", ".xyz"} and max(len(r.snippet) for r in snips) <= 800
    scored = spark.createDataFrame([(".a", "Lang", "odd", 0.9, "t"), (".b", "Low", "backend", 0.5, ""), (".c", "unknown", "docs", 0.9, "")],
                                   "ext string, language string, role string, confidence double, evidence string")
    kept = L.accept_inferences(scored)
    assert [(r.ext, r.role) for r in kept.collect()] == [(".a", "backend")]
    cache = spark.createDataFrame([(".a", "Old", "docs", 0.8)], "ext string, language string, role string, confidence double")
    assert [r.language for r in L.upsert_inferences(cache, kept).collect()] == ["Old"]


def test_scorer_hook(spark, files):
    snips = L.unknown_extensions(CL.classify_files(files({"a/p.abcml": "zzz"})), RG.lang_ext(spark))

    def scorer(frames):
        for f in frames:
            yield f.assign(language="mine", role="docs", confidence=0.8, evidence="zzz")[["ext", "language", "role", "confidence", "evidence"]]

    assert L.infer_languages(snips, scorer=scorer).first().language == "mine"


def test_uuid5(spark):
    import uuid
    df = spark.createDataFrame([("src",), ("naïve",)], "n string")
    for r in df.select("n", TX.uuid5(F.col("n")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n))


def test_title_like_python(spark):
    words = ["k8s api", "o'neil x2y", "ÉCOLE le", "a-b_c"]
    df = spark.createDataFrame([(w,) for w in words], "n string")
    for r in df.select("n", TX.title(F.col("n")).alias("t")).collect():
        assert r.t == r.n.title()


def test_writers_and_stream(spark, files, tmp_path):
    tree = {"one": {"a.py": "import torch\nmodel.fit()"}, "two": {"b.py": "x"}}
    data = files(tree).select("repo", "path", "ext", "size", "content")
    sinks.write_stage(data, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 2
    data.write.parquet(str(tmp_path / "in"))
    q = stream.stream_signals(stream.read_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sig").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.path, r.signal) for r in spark.table("sig").collect()}
    assert got == {tuple(r) for r in S.presence_signals(data).select("path", "signal").collect()} and got


def test_chunking_is_linear(spark, files):
    """Time per byte stays flat from 0.2 to 3.2 MB in one row, and the chunks give the content back."""
    import time
    line = "def f(x): return x + 1  # a line of some length\n"
    took = {}
    for size in (200_000, 200_000, 3_200_000):
        text = line * (size // len(line))
        df = files({"a.py": text}).select(C.chunk_array(F.col("content")).alias("c"), "content")
        start = time.time()
        r = df.select((F.array_join("c", "") == F.col("content")).alias("same"), F.size("c").alias("n"), C.chunk_count(F.col("content")).alias("k")).first()
        took[size] = time.time() - start
        assert r.same and r.n == r.k > size // 4000
    assert took[3_200_000] < 16 * max(took[200_000], 0.25) * 2


def test_no_size_limit_on_signals(spark, files):
    big = "x = 1\n" * 400_000 + "import torch\nmodel.fit()\n"
    assert len(big) > 2_000_000
    found = S.presence_signals(files({"train.py": big}), ["stage"]).count()
    assert found and found == S.presence_signals(files({"train.py": "import torch\nmodel.fit()\n"}), ["stage"]).count()


def test_every_markdown_file_counts(files):
    tree = {f"docs/{i:02d}.md": "text" for i in range(30)} | {"docs/99.md": "We follow GDPR."}
    assert E.compliance_mentions(files(tree)).first().has_gdpr_mention


def test_all_fields_are_kept(files):
    body = ", ".join(f"val f{i}: Int" for i in range(40))
    assert len(code.kotlin_data_classes(files({"A.kt": f"data class A({body})"})).first().fields) == 40


def test_root_with_regex_signs(spark, tmp_path):
    from corpuscope.sources.files import read_tree
    root = tmp_path / "c++ (x)"
    (root / "repo" / "src").mkdir(parents=True)
    (root / "repo" / "src" / "a.py").write_text("x")
    assert [(r.repo, r.path) for r in read_tree(spark, str(root)).collect()] == [("repo", "src/a.py")]


def test_known_extensions_go_after_grouping(spark, files):
    """Contents never meet the known extensions in a join, which would deal them by extension."""
    tree = {"b/q.abcml": "later", "a/p.abcml": "  first " + "x" * 2000, "a/x.py": "print()", "a/z.qqq": " "}
    snips = L.unknown_extensions(CL.classify_files(files(tree)), RG.lang_ext(spark).filter("ext <> '.abcml'"))
    assert {(r.ext, r.path, r.snippet) for r in snips.collect()} == {(".abcml", "a/p.abcml", ("first " + "x" * 2000)[:798])}
    plan = snips._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join LeftAnti") < plan.index("min_by(")
