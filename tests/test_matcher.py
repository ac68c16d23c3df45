"""The shared scan against every regex by itself."""
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import matcher as MT, signals as S
from corpuscope.plans import analyze as A
from corpuscope.rules import signals as SR


def test_anchors_are_in_every_match():
    """Whatever a rule of the tables matches holds one of its anchors; the listed texts match every rule family."""
    assert MT.anchors(r"(?i)jwt\.decode|Bearer\s+token") == ["jwt.decode", "bearer"] or set(MT.anchors(r"(?i)jwt\.decode|Bearer\s+token")) == {"jwt.decode", "bearer"}
    assert set(MT.anchors(r"(?i)@(?:asset|op)\b")) == {"asset", "op"} or MT.anchors(r"(?i)@(?:asset|op)\b") == ["@"]
    assert MT.anchors(r"\w+") is None and MT.anchors(r"(abc)?x*") is None and MT.anchors(r"(?:ab)+c") == ["ab"]
    samples = ["@app.get('/x')", "router.post(\"/v1\", h)", "@GetMapping(\"/a\")", "r.PATCH('/p')", "rpc Get (", "R²", "req.session", "api-key", "HTTPBasic", "f1 ", "auc)",
               "DAG( 'd'", "{{ ref('a') }}", "{{ source('a'", "@Task", "class A(luigi.Task)", "boto3.client('s3", "assert  x ==", "class N(nn.Module)", "for  epoch",
               "class Main: Fragment", "struct A : View", "class HomePage extends StatelessWidget", "const LoginScreen", "@Composable fun XView (", '<uses-permission android:name="a"', "<key>NSxUsageDescription</key>"]
    hit = set()
    for s in S.searches():
        known = MT.anchors(s.regex)
        assert known, s.regex  # no rule of the tables has to run on every file
        for text in samples:
            for m in re.finditer(s.regex, text, re.ASCII):
                hit.add(s.family)
                assert any(a in m.group(0).lower() for a in known), (s.regex, m.group(0))
    assert {"route", "rpc", "auth_count", "pipeline", "screen", "permission"} <= hit


@pytest.fixture(scope="module")
def corpus(spark):
    from corpuscope.queries import Tables
    return Tables(spark, "/root/testdata/sf0.001").scan


def test_matches_equal_single_regexes(corpus):
    """Each search alone in the engine's regexes finds the same files, matches and groups."""
    got = S.tagged(corpus).select("path", F.explode("hits").alias("h")).select("path", "h.*").collect()
    wanted = S.searches()
    files = S.notebook_code(corpus).select("path", "ext", "content", *[S.pack_filter(p).alias(f"in_{p}") for p in ("web", "data", "ml", "mobile")]).collect()
    plain = set()
    for f in files:
        for i, s in enumerate(wanted):
            if f[s.where] and (not s.exts or f["ext"] in s.exts):
                found = list(re.finditer(s.regex, f["content"], re.ASCII))
                if found and s.groups == 0:
                    plain.add((f["path"], i, 1, None, None))
                elif found and s.groups < 0:
                    plain.add((f["path"], i, len(found), None, None))
                else:
                    plain |= {(f["path"], i, 1, m.group(1), m.group(2) if s.groups > 1 else None) for m in found}
    assert {(r["path"], r["search"], r["n"], r["one"], r["two"]) for r in got} == plain and plain


def test_one_scan_serves_all_families(spark, corpus):
    """The pack features read no content once the scan is held."""
    plan = A.pack_features(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert "hits" in plan and "MapInArrow" not in plan
    whole = S.tagged(corpus)
    for alone, shared in ((S.http_contracts, S.http_contracts), (S.auth_signals, S.auth_signals), (S.app_screens, S.app_screens), (S.middleware_signals, S.middleware_signals)):
        a, b = alone(corpus).drop("pos"), shared(whole).drop("pos")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_limits_are_parameters(files):
    df = files({"a.py": "api_key api_key api_key api_key jwt_required\n", "b.py": "accuracy", "c.py": "accuracy"})
    assert {(r["auth_type"], r["hits"]) for r in S.auth_hits(df).collect()} == {("api_key", 3), ("jwt", 1)}
    assert {(r["auth_type"], r["hits"]) for r in S.auth_hits(df, most=100).collect()} == {("api_key", 4), ("jwt", 1)}
    assert S.eval_metrics(df, files=1).count() == 1
    assert any(r[0] == "accuracy" for r in SR.METRIC_RULES)
