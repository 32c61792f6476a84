"""Path discovery on small graphs: what is found, how it is scored and whose it is."""

import pytest

from basaltine.operators import discovery
from basaltine.operators.rules import Catalog, Rule

CATALOG = Catalog([Rule("A", "Alpha", "A03", "CWE-1", sources=["req"], sinks=["run"], sanitizers=["escape"]), Rule("B", "Beta", sources=["env"], sinks=["send", "run"])])
NODES = "node string, ord int, type string, name string, role string, scope string, file string, line int, source_code string"


def graph(spark, nodes, edges):
    rows = [(n, k, t, name, role, scope, file, line, None) for k, (n, t, name, role, scope, file, line) in enumerate(nodes)]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(a, b, k, t) for k, (a, b, t) in enumerate(edges)], "src string, dst string, ord int, type string")


def test_shared_rule_scores_and_attribution(spark):
    nodes, edges = graph(
        spark,
        [("s", "CALL", "req.body", None, "f", "a.js", 1), ("k", "CALL", "run", None, "f", "a.js", 2), ("e", "CALL", "env", None, "g", "b.js", 7), ("m", "CALL", "escape", None, None, "b.js", 8),
         ("o", "CALL", "send", "sink", "g", "b.js", 9), ("x", "CALL", "req", None, None, "a.js", 5), ("y", "CALL", "send", None, None, "a.js", 6)],
        [("s", "k", "DFG_FLOW"), ("e", "m", "DFG_FLOW"), ("m", "o", "CALL_GRAPH"), ("x", "y", "CFG_NEXT"), ("s", "o", "AUTH_COVERAGE")],
    )
    got = {(r.source, r.sink): r for r in discovery.discover(nodes, edges, CATALOG, threshold=0).collect()}
    assert set(got) == {("s", "k"), ("e", "o"), ("s", "o")}
    r = got["s", "k"]
    assert r.rule_id == "A" and r.cwe == "CWE-1" and (r.start_line, r.end_line, r.crossings) == (1, 2, 0)
    assert r.score == pytest.approx(0.35 / 3 + 0.25 / 2 + 0.1 + 0.05)
    r = got["e", "o"]
    assert r.rule_id == "B" and (r.explicit, r.heuristic, r.calls) == (0, 1, 1)
    assert r.score == pytest.approx((0.35 / 4 + 0.25 / 3 + 0.1 * 0.4 + 0.1 * 0.7) * 0.95)
    r = got["s", "o"]
    assert r.rule_id == "PATH_DISCOVERY" and r.cwe is None and r.covered == 1 and r.crossings == 2 and r.hops == 1
    assert len(discovery.discover(nodes, edges, CATALOG).collect()) == 2 and discovery.discover(nodes, edges, CATALOG, 0, best=1).count() == 1  # below the threshold: the sanitized one


@pytest.mark.parametrize("files,found", [(3, True), (4, False)])
def test_file_crossings_are_bounded(spark, files, found):
    nodes = [(str(k), "CALL", "req" if k == 0 else "run" if k == files - 1 else "x", None, None, f"f{k}", k + 1) for k in range(files)]
    n, e = graph(spark, nodes, [(str(k), str(k + 1), "DFG_FLOW") for k in range(files - 1)])
    assert (discovery.discover(n, e, CATALOG, threshold=0).count() == 1) == found


def test_snippets(spark):
    nodes, edges = graph(spark, [("s", "CALL", "req", None, None, "a.js", 1), ("k", "CALL", "run", None, None, "b.js", 2)], [("s", "k", "DFG_FLOW"), ("s", "k", "CALL_GRAPH")])
    files = spark.createDataFrame([("a.js", "one\ntwo\nthree\nfour\nfive"), ("b.js", "x\ny")], "file string, content string")
    out = discovery.path_snippets(discovery.discover(nodes, edges, CATALOG, threshold=0), nodes, edges, files).first()
    assert out.snippet == (
        "PATH NODES:\nreq -> run\nPATH EDGES:\nCALL_GRAPH|DFG_FLOW\n\nFILE: a.js\n>>>    1 | one\n       2 | two\n       3 | three\n       4 | four\n\n"
        "FILE: b.js\n       1 | x\n>>>    2 | y"
    )


def test_nothing(spark):
    nodes, edges = graph(spark, [("s", "CALL", "req", None, None, None, None)], [("s", "s", "DFG_FLOW")])
    assert discovery.discover(nodes, edges, CATALOG).count() == 0 and discovery.discover(nodes.limit(0), edges.limit(0), Catalog([])).count() == 0
