"""Enrichment, routes of pages, projections."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from basaltine.operators import enrich, projections, routes
from basaltine.operators.rules import Catalog, Rule


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_subtypes(spark):
    texts = ["eval(x)", "os.system('a')", "requests.get(u)", "db.execute(q)", "len(x)", "subprocess.run(eval(y))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(enrich.call_kind(F.col("t"))).collect()] == ["EVAL_CALL", "SYSTEM_CALL", "EXTERNAL_CALL", "ORM_QUERY", "CALL_EXPRESSION", "EVAL_CALL"]
    one = spark.range(1).select(
        enrich.string_kind(F.lit(" f'{x}'")), enrich.string_kind(F.lit("'SELECT a'")), enrich.string_kind(F.lit("'x'")), enrich.binary_kind(F.lit("a + 'b'")),
        enrich.binary_kind(F.lit("a + b")), enrich.decorator_kind(F.lit("@app.route('/x')")), enrich.decorator_kind(F.lit("@login_required")), enrich.decorator_kind(F.lit("@cache")),
    )
    assert tuple(one.first()) == ("FSTRING", "SQL_QUERY", "LITERAL", "STRING_CONCAT", "BINARY_OP", "ROUTE_DECORATOR", "AUTH_GUARD", "EXPRESSION")


@pytest.fixture(scope="module")
def app(spark):
    nodes = [
        (1, "ROUTE_DECORATOR", "decorator", None, "@app.route('/a')", "a.py", 1), (2, "AUTH_GUARD", "decorator", None, "@login_required", "a.py", 2),
        (3, "FUNCTION", "handler", None, None, "a.py", 3), (4, "PARAMETER", "q", None, None, "a.py", 3), (5, "CALL_EXPRESSION", "escape", None, "escape(q)", "a.py", 4),
        (6, "IDENTIFIER", "q", None, None, "a.py", 4), (7, "CALL_EXPRESSION", "cursor.execute", None, "cursor.execute(sql)", "a.py", 6), (8, "IDENTIFIER", "sql", None, None, "a.py", 6),
        (9, "IDENTIFIER", "cursor", None, None, "a.py", 6), (10, "LITERAL", None, "'select 1 from t'", None, "a.py", 5), (11, "ASSIGNMENT", "sql", None, None, "a.py", 5),
        (12, "MIDDLEWARE", "mw", None, None, "a.py", 30), (13, "FUNCTION", "other", None, None, "b.py", 3), (14, "LITERAL", None, "'delete from t'", None, "a.py", 40),
    ]
    n = spark.createDataFrame([(*x, 0) for x in nodes], "node long, type string, name string, value string, source_code string, file string, line int, col int")
    syntax = spark.createDataFrame([(5, 6), (7, 8), (7, 9), (11, 10), (3, 11), (3, 7)], "src long, dst long")
    flows = spark.createDataFrame([(4, 6, "DFG_FLOW"), (6, 5, "CALL_ARG"), (8, 7, "CALL_ARG"), (4, 8, "DFG_FLOW"), (3, 4, "CFG_NEXT")], "src long, dst long, type string")
    return n, syntax, flows


def test_passes(app):
    n, syntax, flows = app
    assert rows(enrich.call_arguments(n, syntax)) == {(5, 6), (7, 8)}
    taint = rows(enrich.taint_edges(n, syntax, flows))
    assert {x for x in taint if x[2] == "TAINT_FLOW"} == {(4, 7, "TAINT_FLOW")} and (6, 5, "SANITIZED") in taint
    assert (4, 4, "TAINT_SOURCE") in taint and (7, 7, "TAINT_SINK") in taint
    assert rows(enrich.http_edges(n)) == {(1, 3, "HTTP_ROUTE"), (12, 3, "HTTP_MIDDLEWARE"), (3, 2, "AUTH_COVERAGE"), (2, 3, "PERMISSION_FLOW")}
    assert rows(enrich.database_edges(n, syntax)) == {(8, 7, "SQL_PARAM"), (10, 7, "ORM_FLOW"), (10, 11, "SQL_PARAM")}


def test_statistics_and_path_features(spark):
    e = spark.createDataFrame([(1, 2, "A", 1.0), (2, 3, "A", 0.5), (2, 3, "B", None)], "src int, dst int, type string, confidence double")
    assert rows(enrich.edge_statistics(e)) == {("A", 2, 1), ("B", 1, 0)}
    p = spark.createDataFrame([("p", [1, 2, 3]), ("q", [3])], "id string, path array<int>")
    assert rows(enrich.path_features(p, e)) == {("p", "A", 2), ("p", "B", 1)}


def test_routes(spark):
    code = ["@app.route('/a')", "@bp.route(\"/b/<int:id>\")", "@router.get('/c/')", "app.post('/d', h)", "path('e/', view)", "@app.route('/a')", "x = 1", None]
    nodes = spark.createDataFrame([(k, k, c) for k, c in enumerate(code)], "node int, ord int, source_code string")
    table = routes.route_table(nodes)
    assert rows(table) == {("/a", 5), ("/b/<int:id>", 1), ("/c/", 2), ("/d", 3), ("e/", 4)}
    actions = spark.createDataFrame([("/a",), ("c",), ("/b/7",), ("/b/x",), ("/e",), ("",)], "action string")
    assert rows(routes.resolve_actions(actions, table)) == {("/a", 5), ("c", 2), ("/b/7", 1), ("/b/x", None), ("/e", 4), ("", None)}
    handlers = spark.createDataFrame([("n", "fetch('/d')"), ("m", "go()")], "node string, code string")
    assert rows(routes.handler_routes(handlers, table)) == {("n", "/d", 3)}
    t = routes.template_table(spark.createDataFrame([("return render_template('x.html', u=u)", "a.py"), ("render(request, \"y.html\")", "b.py")], "source_code string, file string"))
    assert rows(t) == {("x.html", "a.py"), ("y.html", "b.py")}
    variables = spark.createDataFrame([(1, "a.py", "user"), (2, "a.py", "other"), (3, "b.py", "user")], "node int, file string, name string")
    assert rows(routes.template_flows(variables, t, spark.createDataFrame([("x.html", "user.name")], "template string, name string"))) == {(1, "x.html", "user")}


def test_projections(spark, tmp_path):
    catalog = Catalog([Rule("A", "Alpha", asvs_controls=["V1.1.1", "V1.1.2"], finding_polarity="compliant"), Rule("B", "Beta", asvs_controls=["V1.1.2", "V2.1.1"])])
    f = spark.createDataFrame(
        [("s", 1, "id1", "A", "Alpha", "high", 0.876, ["B"], "f.py", 3, 5), ("s", 2, "id2", "PATH", "Path", "low", 0.5, None, None, None, None)],
        "scan_id string, ord int, slice_id string, rule_id string, rule_name string, final_severity string, final_confidence double, contributing_rule_ids array<string>, file string, start_line int, end_line int",
    )
    f = f.withColumns({c: F.lit("x") for c in ("owasp", "cwe", "source_label", "sink_label", "pattern_type", "code_snippet")}).withColumn("path_nodes", F.array(F.lit("n")))
    docs = projections.finding_documents(f, catalog, F.lit(7.5))
    a, b = [r.document for r in docs.orderBy("ord").collect()]
    assert a.asvs_controls == ["V1.1.1", "V1.1.2", "V2.1.1"] and a.confidence == 0.88 and a.asvs_finding_polarity == "compliant" and [r.rule_id for r in a.contributing_rules] == ["B"]
    assert b.needs_manual_triage and not a.needs_manual_triage and b.asvs_finding_polarity == "vulnerable" and b.location.file == "unknown"
    assert {r.control_id for r in projections.evidence(docs).collect()} == {"V1.1.1", "V1.1.2", "V2.1.1"} and ("V1.1.2", "B") in projections.rule_controls(catalog)
    one = spark.range(1).select(
        projections.type_group(F.lit("Blind SQL Injection")), projections.type_group(F.lit("Weak-Hash Use")), projections.sink_line(F.lit("    12 | a\n>>> 13 | run(x)"), F.lit("run"), F.lit(1), F.lit(9)),
        projections.sink_line(F.lit("x"), F.lit("regex"), F.lit(4), F.lit(0)), projections.escape_xml(F.lit("<a&b>")), projections.valid_control(F.lit("V1.2.3")), projections.valid_control(F.lit("1.2.3")),
    )
    assert tuple(one.first()) == ("sql_injection", "weak_hash_use", 13, 4, "&lt;a&amp;b&gt;", True, False)
    day = dt.datetime(2024, 1, 1)
    reports = spark.createDataFrame([("a", 1, day, ["x"]), ("b", 2, day + dt.timedelta(1), ["y"])], "scan_id string, repo_id int, created_at timestamp, tags array<string>")
    ids = lambda df: [r.scan_id for r in df.collect()]
    assert ids(projections.report_list(reports)) == ["b", "a"] and ids(projections.report_list(reports, tag="x")) == ["a"] and ids(projections.report_list(reports, repo_id=2, date_from=day)) == ["b"]
    scans = spark.createDataFrame([("a", "u", day, "RUNNING", 3, 1)], "scan_id string, user_id string, created_at timestamp, state string, total_files int, files_scanned int")
    r = projections.scan_list(scans, spark.createDataFrame([("a", None, 5, 5)], "scan_id string, state string, total_files int, files_scanned int")).first()
    assert (r.state, r.total_files, r.files_scanned) == ("RUNNING", 5, 5)
    users = spark.createDataFrame([("u", "e", "n", "admin", None, day)], "id string, email string, full_name string, role string, is_active boolean, created_at timestamp")
    assert projections.user_list(users).first().status == "inactive"
    asked = spark.createDataFrame([("x\n" * 400, None, None), ("x", 1, None), (None, None, None), ("x", None, ["p"]), ("x", None, None), (" ", 1, ["p"])], "code string, repo_id int, paths array<string>")
    assert [r.error is None for r in projections.start_errors(asked).collect()] == [False, False, False, False, True, True]
    nodes = spark.createDataFrame([(1, 0, "CALL")], "node int, ord int, type string")
    edges = spark.createDataFrame([(1, 2, 0, "AST")], "src int, dst int, ord int, type string")
    assert [json.loads(r.json) for r in projections.graph_json(nodes, edges).orderBy("part", "ord").collect()] == [{"node": 1, "type": "CALL"}, {"from": 1, "to": 2, "type": "AST"}]
    with pytest.raises(ValueError, match="json, csv, sarif"):
        projections.export(f, str(tmp_path / "x"), "pdf")
    projections.export(f, str(tmp_path / "x"), "json")
    assert spark.read.json(str(tmp_path / "x")).count() == 2
