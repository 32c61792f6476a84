"""Rules from code to findings: text -> graph -> sources and sinks -> paths -> slices."""

import pytest

from basaltine.operators import execution
from basaltine.operators.rules import Catalog, Rule, scan
from basaltine.sources import python_graph

APP = """import os
from flask import request

def handler(cursor):
    name = request.args
    query = name
    cursor.execute(query)

def safe(cursor):
    name = request.args
    clean = escape(name)
    cursor.execute(clean)

def nothing(cursor):
    cursor.execute("SELECT 1")
"""
RULES = [
    Rule("SQL", "SQL injection", "A03", "CWE-89", severity="critical", confidence="high", sources=["request.args"], sinks=["cursor.execute"], sanitizers=["escape"], patterns=["DFG_FLOW"], regex_patterns=[r"cursor\.execute\(\w+\)"]),
    Rule("GUARDED", sources=["request.args"], sinks=["cursor.execute"], required_guards=["escape"], patterns=["DFG_FLOW AND NOT exists(check)"]),
    Rule("TEXT_ONLY", sources=["never"], sinks=["cursor.execute"], patterns=["CALL(execute)", "ASSIGNMENT(query)", "LITERAL(x)"]),
]


@pytest.fixture(scope="module")
def app(spark):
    files = spark.createDataFrame([("app.py", APP)], "rel_path string, content string")
    return files, python_graph.nodes(files).cache()


def test_code_to_findings(spark, app):
    files, n = app
    nodes, edges = python_graph.execution_nodes(n), python_graph.execution_edges(n)
    found = [r for r in execution.slices(nodes, edges, Catalog(RULES)).collect()]
    assert {r.rule_id for r in found} == {"SQL"}  # GUARDED has its guard, TEXT_ONLY no source
    by_lines = {(r.start_line, r.end_line): r for r in found if r.sink_label == "cursor.execute"}
    assert by_lines[5, 7].severity == "critical" and by_lines[5, 7].sanitizers == 0
    assert by_lines[10, 12].severity == "medium" and by_lines[10, 12].confidence == "low" and by_lines[10, 12].sanitizers >= 1
    assert "Sanitizers observed" in by_lines[10, 12].reason and "flows to dangerous sink 'cursor.execute'" in by_lines[5, 7].reason
    assert not any(r.end_line > 12 for r in found)
    every = execution.execute(nodes, edges, files.withColumnRenamed("rel_path", "file"), Catalog(RULES)).collect()
    texts = [(r.rule_id, r.start_line) for r in every if r.pattern == "REGEX"]
    assert ("SQL", 7) in texts and ("TEXT_ONLY", 6) in texts  # the first match of each pattern
    assert len({(r.rule_id, r.sink_label, r.file, r.start_line, r.end_line) for r in every if r.rule_id == "SQL"}) == len([r for r in every if r.rule_id == "SQL"])


def test_patterns_of_sources_and_sinks(spark):
    rows = [
        ("a", "PARAMETER", "user", None, None, None), ("b", "PARAMETER", "x", None, "source", None), ("c", "PARAMETER", "x", None, None, None),
        ("d", "CALL", "parameter", None, None, None), ("e", "SUBSCRIPT", "os.environ['k']", None, None, None), ("f", "CALL", "executed", None, None, None),
        ("g", "LITERAL", None, "via INPUT here", None, None), ("h", "CALL", "db.execute", None, None, '{"from":"input"}'), ("input", "CALL", "", None, None, None),
    ]
    nodes = spark.createDataFrame(rows, "node string, type string, name string, value string, role string, metadata string")

    def hits(condition):
        return {r.node for r in nodes.where(condition).collect()}

    assert hits(execution.is_source("PARAMETER")) == {"a", "b", "d"}
    assert hits(execution.is_source("input")) == {"a", "b", "c", "g", "h", "input"}
    assert hits(execution.is_source("environ")) == {"e"}
    assert hits(execution.is_sink("PARAMETER")) == {"a", "b", "c", "d"}
    assert hits(execution.is_sink("execute")) == {"h"} and hits(execution.is_sink("input")) == {"input"}


def test_macros_lines_and_labels(spark):
    files = spark.createDataFrame([(1, "a\nb = md5 (\n  x)\n"), (2, None), (3, "")], "id int, text string")
    rule = Rule("R", sinks=["sha1", "MD5"], patterns=["CALL(md5)", "ASSIGNMENT(b)", "LITERAL(q)", "DFG_FLOW"], regex_patterns=[r"(?s)md5.*x"])
    got = {(r.id, r.pattern): (r.hits, r.first_line, r.sink_label) for r in scan(files, Catalog([rule]), "text").collect()}
    assert got == {(1, r"(?s)md5.*x"): (1, 2, "MD5"), (1, r"md5\s*\("): (1, 2, "MD5"), (1, r"b\s*=\s*"): (1, 2, "b =")}
    assert scan(files, Catalog([]), "text").count() == 0
