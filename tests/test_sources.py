import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from basaltine import sinks
from basaltine.functions import html
from basaltine.operators import config_checks
from basaltine.sources import code, directives, manifests, python_graph


def test_tree(spark, tmp_path):
    for name in ("a.py", "sub/b.js", "node_modules/c.js", "d.txt", "e.min.js"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    got = {r.rel_path: r.language for r in code.tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "sub/b.js": "javascript"}
    only = spark.createDataFrame([("a.py",)], "rel_path string")
    assert [r.rel_path for r in code.tree(spark, str(tmp_path), only=only).collect()] == ["a.py"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a/b.py", "1")
    assert [(r.name, bytes(r.content)) for r in code.archive_members(spark, str(tmp_path)).collect()] == [("a/b.py", b"1")]
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        entry = tarfile.TarInfo("link")
        entry.type, entry.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(entry)
    with pytest.raises(ValueError):
        list(code._members("x.tar", raw.getvalue()))
    for bad in ("../x", "/x", "a/../../x", "C:\\x", ""):
        assert not code.safe_member(bad)


def test_manifests(spark):
    files = [
        ("r", "requirements.txt", "a==1.0\n# b==2\nc>=1\n-r x\nA==1.0"),
        ("r", "package.json", '{"dependencies": {"x": "^1.2.0", "y": "git+ssh://z"}}'),
        ("s", "package.json", '{"dependencies": {"x": "^1.2.0"}}'),
        ("s", "package-lock.json", '{"packages": {"": {}, "node_modules/x": {"version": "1.2.3"}, "node_modules/x/node_modules/@o/y": {"version": "2.0.0"}}}'),
        ("t", "package-lock.json", '{"dependencies": {"p": {"version": "1.0.0", "dependencies": {"q": {"version": "2.0.0"}}}}}'),
        ("t", "pipfile.lock", '{"default": {"k": {"version": "==3.1"}}}'),
        ("t", "pyproject.toml", '[project]\ndependencies = ["m==1.1", "n>2"]'),
        ("t", "requirements.txt", None),
    ]
    df = spark.createDataFrame([(r, n, n, c) for r, n, c in files], "repo_id string, path string, name string, content string")
    got = {(r.repo_id, r.package.lower(), r.version) for r in code.dependency_refs(df).collect()}
    assert got == {("r", "a", "1.0"), ("r", "x", "1.2.0"), ("s", "x", "1.2.3"), ("s", "@o/y", "2.0.0"), ("t", "p", "1.0.0"), ("t", "q", "2.0.0"), ("t", "k", "3.1"), ("t", "m", "1.1")}
    advisories = spark.createDataFrame(
        [("npm", "x", "1.2.0", "V1", "high", None, "2024-01-01T00:00:00Z"), ("npm", "x", "1.2.3", "V2", None, "9.8", "bad"), ("PyPI", "k", "3.1", "V3", "?", None, None)],
        "ecosystem string, name string, version string, vuln_id string, db_severity string, cvss_v3 string, published string",
    )
    found = code.dependency_findings(code.dependency_refs(df), advisories, F.to_timestamp(F.lit("2024-03-01T00:00:00Z")))
    rows = {r.vuln_id: (r.severity, r.days_since_published, r.breached_sla) for r in found.collect()}
    assert rows == {"V1": ("HIGH", 60, True), "V2": ("CRITICAL", None, False), "V3": ("MODERATE", None, False)}
    verdicts = {r.repo_id: r.verdict for r in code.dependency_verdict(df, found).collect()}
    assert verdicts == {"r": "fail", "s": "manual_review", "t": "manual_review"}


def test_requirements_and_locks_by_their_grammar():
    text = "a[x, y] == 1.0 ; python_version < '3.9'\n(b)==2\nc (==3.0)\nd==1.*\ne==1,<2\nf === 4.0+local  # note\n-e ./here\ng==1.0 \\\n  --hash=sha256:ab\nh @ https://x/y==1\n\nurl#egg==2"
    assert manifests.references("Requirements.txt", text) == [("a", "1.0", "PyPI"), ("c", "3.0", "PyPI"), ("f", "4.0+local", "PyPI"), ("g", "1.0", "PyPI")]
    project = '[project]\ndependencies = ["a==1"]\n[project.optional-dependencies]\nt = ["b==2", "c>1"]'
    assert manifests.references("pyproject.toml", project) == [("a", "1", "PyPI"), ("b", "2", "PyPI")]
    package = '{"dependencies": {"a": ">= 1.2 <2", "b": "*", "c": "~3.0", "d": "file:../d", "e": null}, "devDependencies": {"f": "4 || 5"}}'
    assert manifests.references("package.json", package) == [("a", "1.2", "npm"), ("c", "3.0", "npm"), ("f", "4", "npm")]
    deep = '{"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2", "dependencies": {"c": {"version": "3"}}}}}}}'
    assert {x[:2] for x in manifests.references("package-lock.json", deep)} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert manifests.references("package.json", "[") == manifests.references("pipfile.lock", "[]") == manifests.references("other", "a==1") == []


def test_config(spark):
    good = 'server {\n  add_header Strict-Transport-Security "max-age=63072000";\n  charset utf-8;\n  server_tokens off;\n  ssl_ciphers HIGH:!RC4;\n}'
    weak = 'server {\n  add_header Strict-Transport-Security "max-age=300";\n  server_tokens on;\n  autoindex on;\n  ssl_ciphers RC4;\n}'
    df = spark.createDataFrame([("g", "nginx.conf", good), ("w", "nginx.conf", weak), ("n", "x.conf", None)], "repo_id string, name string, content string")
    got = {(r.repo_id, r.control_id): (r.verdict, r.line) for r in config_checks.inspect(df).collect()}
    assert got["g", "V3.4.1"] == ("pass", 2) and got["w", "V3.4.1"] == ("fail", 2)
    assert got["g", "V4.1.1"] == ("pass", 3) and got["w", "V4.1.1"] == ("fail", None)
    assert got["g", "V12.1.2"][0] == "pass" and got["w", "V12.1.2"][0] == "fail"
    assert got["w", "V13.4.3"][0] == "fail" and got["g", "V13.4.3"][0] == "pass"
    assert ("g", "V3.2.1") not in got and not any(k[0] == "n" for k in got)
    pins = spark.createDataFrame(
        [("a", "package.json", '{"@o/x": "1"}'), ("a", ".npmrc", "@o:registry=https://r"), ("b", "package.json", '{"@o/x": "1"}')],
        "repo_id string, name string, content string",
    )
    assert {r.repo_id: r.verdict for r in config_checks.registry_pins(pins).collect()} == {"a": "pass", "b": "fail"}


NGINX = """http {
  # charset gone;
  server { listen 80; add_header Content-Security-Policy "default-src 'self';
     object-src 'none'; base-uri 'self'";
    location ~* \\.(jpg|png)$ { expires 1d; }
    location /upload { fastcgi_pass php; }
    location /api/ { return 301 https://x; }
    ssl_ciphers "HIGH:!RC4:DES-CBC3-SHA";
    location /admin { add_header Cache-Control no-store; }
  }
"""


def test_directives():
    rows = directives.block_directives(NGINX)
    assert [(r["name"], r["line"]) for r in rows] == [
        ("http", 1), ("server", 3), ("listen", 3), ("add_header", 3), ("location", 5), ("expires", 5), ("location", 6), ("fastcgi_pass", 6),
        ("location", 7), ("return", 7), ("ssl_ciphers", 8), ("location", 9), ("add_header", 9),
    ]
    assert rows[7]["context"] == "http > server > location /upload" and rows[3]["value"].startswith("Content-Security-Policy default-src 'self'")
    assert directives.block_directives("") == [] and directives.block_directives("} a b") == [{"name": "a", "value": "b", "context": "", "line": 1}]
    pairs = directives.assignments('# x=1\nexport A=1\nENV MAX_BODY_SIZE 5\nmin-port = 3\nFROM image\nverbose\nB="q"')
    assert [(r["name"], r["value"], r["line"]) for r in pairs] == [("a", "1", 2), ("max_body_size", "5", 3), ("min-port", "3", 4), ("verbose", "", 6), ("b", "q", 7)]


def test_checks_of_directives(spark):
    turn = "realm=x\nmin-port=1\nmax-port=2\ntotal-quota=3\ncipher-list=RC4"
    df = spark.createDataFrame([("n", "nginx.conf", NGINX), ("t", "turn.cfg", turn), ("e", ".env", "MAX_BODY_SIZE=5"), ("y", "a.yaml", "kind: Role\nresources: ['*']")], "repo_id string, name string, content string")
    got = {(r.repo_id, r.control_id): r.verdict for r in config_checks.inspect(df).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "n" and v == "pass"} == {"V3.4.3": "pass", "V13.4.3": "pass", "V14.3.2": "pass", "V13.4.7": "pass"}
    assert got["n", "V5.3.1"] == got["n", "V4.1.2"] == got["n", "V12.1.2"] == got["n", "V14.2.5"] == "fail" and ("n", "V13.2.5") not in got
    assert got["t", "V17.1.2"] == "pass" and got["t", "V17.1.1"] == "fail" and got["t", "V17.2.2"] == "fail" and got["e", "V5.2.1"] == "pass"
    assert got["y", "V16.4.2"] == "fail"


SOURCE = """
def save(q):
    run(q)

def main(request):
    x = request.args
    y = x
    save(y)
    return y
"""


def test_python_graph(spark):
    files = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "rel_path string, content string")
    n = python_graph.nodes(files).cache()
    kinds = {r.type for r in n.collect()}
    assert {"MODULE", "FUNCTION", "PARAMETER", "CALL", "ASSIGNMENT", "IDENTIFIER", "RETURN"} <= kinds
    names = {r["id"]: r["name"] for r in n.select(python_graph._ref("file", "node").alias("id"), "name").collect()}
    found = {(r.type, names[r.src], names[r.dst]) for r in python_graph.edges(n).collect()}
    assert ("CALL_GRAPH", "save", "save") in found
    assert ("DFG_PARAM_PASS", "y", "q") in found
    assert ("DFG_FLOW", "x", "x") in found and ("DFG_FLOW", "y", "y") in found and ("DFG_FLOW", "q", "q") in found


FLOW = """def f(a, b):
    if a:
        x = f'{a} {b.c}'
        y = 1
    else:
        y = 2
    for k in b:
        try:
            g(k)
        except ValueError:
            raise
    return y


def g(k):
    return k
"""


def test_control_flow_of_python(spark):
    n = python_graph.nodes(spark.createDataFrame([("m.py", FLOW)], "rel_path string, content string")).cache()
    rows = {r.node: r for r in n.collect()}
    for k, r in rows.items():  # numbers are those of a walk
        below = {k} | {j for j, x in rows.items() if any(p == k for p in _above(rows, j))}
        assert below == set(range(k, r["last"] + 1))
    at = {r["id"]: (r.type, r.line) for r in n.select(python_graph._ref("file", "node").alias("id"), "type", "line").collect()}
    edges = python_graph.edges(n).collect()
    found = {(r.type, at[r.src], at[r.dst]) for r in edges}
    assert ("CFG_BRANCH_TRUE", ("BRANCH", 2), ("ASSIGNMENT", 3)) in found
    assert ("CFG_BRANCH_FALSE", ("BRANCH", 2), ("RETURN", 12)) in found
    assert ("CFG_LOOP_ENTRY", ("LOOP", 7), ("TRY", 8)) in found and ("CFG_LOOP_EXIT", ("LOOP", 7), ("RETURN", 12)) in found
    assert ("CFG_NEXT", ("RAISE", 11), ("LOOP", 7)) in found
    assert ("CFG_EXCEPTION", ("TRY", 8), ("EXCEPT_HANDLER", 10)) in found
    assert ("CONTROL_FLOW", ("FUNCTION", 1), ("RAISE", 11)) in found
    assert ("CALL_RETURN", ("FUNCTION", 15), ("RETURN", 16)) in found and ("DEFINES", ("MODULE", 1), ("FUNCTION", 15)) in found
    assert ("DFG_INTERP", ("IDENTIFIER", 3), ("TEMPLATE", 3)) in found and ("DFG_PROPERTY", ("IDENTIFIER", 3), ("MEMBER", 3)) in found
    order = [r.ord for r in edges if at[r.src] == ("FUNCTION", 1) and r.type == "AST"]
    assert len(order) == len(set(order)) and max(order) < python_graph.FAMILY
    first = {(r.src, r.dst): r.ord for r in edges if r.type == "AST"}
    assert all(a < b for (s, d), a in first.items() for (t, e), b in first.items() if s == t and int(d.split("_")[1]) < int(e.split("_")[1]))


def _above(rows, k):
    while (k := rows[k].parent) >= 0:
        yield k


def test_html(spark):
    page = '<form action="/x" method="post"><input name="q" onclick="go()"></form><p>{{ user.name }}</p>'
    df = spark.createDataFrame([(page,)], "html string").select(
        html.attributes(F.col("html"), "form", "action").alias("a"),
        html.attributes(F.col("html"), "input", "name").alias("i"),
        html.handlers(F.col("html")).alias("h"),
        html.template_variables(F.col("html")).alias("v"),
        html.template_engine(F.lit("x.html"), F.col("html")).alias("e"),
    )
    r = df.first()
    assert (r.a, r.i, r.h, r.v, r.e) == (["/x"], ["q"], ['onclick="go()"'], ["user.name"], "jinja2")


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame(
        [("s", 2, "XSS", "", "high", "a.js", 0, "m1", "c1", 0.5), ("s", 1, "SQLI", "CWE-89", "low", "b.py", 7, "m2", "c2", 0.6)],
        "scan_id string, ord long, type string, cwe string, severity string, file string, line int, message string, code string, confidence double",
    )
    doc = json.loads(sinks.to_sarif(f).first().sarif)
    assert [r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]] == ["CWE-89", "XSS"]
    assert [r.get("helpUri") for r in doc["runs"][0]["tool"]["driver"]["rules"]] == ["https://cwe.mitre.org/data/definitions/89.html", None]
    more = f.withColumns({"end_line": F.col("line") + 2, "owasp": F.lit("A03")})
    run = json.loads(sinks.to_sarif(more).first().sarif)["runs"][0]
    assert run["tool"]["driver"]["rules"][0]["properties"]["tags"] == ["security", "A03"]
    assert [x["locations"][0]["physicalLocation"]["region"]["endLine"] for x in run["results"]] == [9, 2]
    results = doc["runs"][0]["results"]
    assert [r["level"] for r in results] == ["note", "error"]
    assert results[1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    sinks.to_csv(f, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == sinks.CSV_COLUMNS
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq long, v string")
    assert {r.k: r.v for r in sinks.latest(log, ["k"], ["seq"]).collect()} == {"a": "y", "b": "z"}
    for rows in ([("a", 1, "x"), ("b", 1, "z")], [("b", 2, "w")]):
        sinks.upsert(spark, spark.createDataFrame(rows, "k string, seq long, v string"), str(tmp_path / "t"), "k")
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a": "x", "b": "w"}
