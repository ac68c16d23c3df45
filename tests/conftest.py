import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "checks"))


@pytest.fixture(scope="session")
def spark():
    from compare import session
    return session()


@pytest.fixture(scope="session")
def files(spark):
    """Makes a files table from {path: content} or {repo: {path: content}}."""
    from corpuscope.sources.files import scan_files

    def make(tree):
        if tree and not isinstance(next(iter(tree.values())), dict):
            tree = {"r": tree}
        rows = [(repo, path, text) for repo, paths in tree.items() for path, text in paths.items()]
        return scan_files(spark.createDataFrame(rows, "repo string, path string, content string"))
    return make


@pytest.fixture
def evidence_of(files):
    from corpuscope.operators import code, evidence as E, manifests as M

    def make(tree):
        f = files(tree)
        out = E.evidence(f, code.spring_endpoints(f), code.proto_rpcs(f), M.dependencies(f), M.build_facts(f))
        return out.first().asDict()
    return make
