"""Nested sets, scope chains, taint met in the middle and incremental builds, against plain code."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basaltine.operators import chains, enrich, graph, linking, taint, trees
from basaltine.operators.repository import RepositoryGraph
from basaltine.plans import repository_queries as R

KINDS = ["IF_STATEMENT", "FOR_STATEMENT", "WHILE_STATEMENT", "TRY_STATEMENT", "EXCEPT_HANDLER", "RAISE", "FUNCTION", "METHOD", "ASSIGNMENT", "IDENTIFIER", "LITERAL", "CALL_EXPRESSION", "RETURN", "FSTRING", "MEMBER_ACCESS"]


def grown(rng, file, n):
    """A random tree in document order: (file, node, parent, type, line, col, open, close, depth)."""
    rows, at = [], [0]

    def grow(parent, depth, budget):
        node = f"{file}.{len(rows)}"
        row = [file, node, parent, rng.choice(KINDS) if parent else "FILE", at[0] // 3, at[0] % 3, at[0], None, depth]
        rows.append(row)
        while budget > 0 and depth < 9:
            at[0] += rng.choice([0, 1, 1, 2]) if len(rows) > 1 and rows[-1] is row else rng.choice([1, 1, 2])
            part = rng.randrange(1, budget + 1)
            grow(node, depth + 1, part - 1)
            budget -= part
        row[7] = at[0]

    grow(None, 0, n)
    return [tuple(r) for r in rows]


SCHEMA = "file string, node string, parent string, type string, line long, col long, open long, close long, depth int"


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(4)
    return [r for k in range(12) for r in grown(rng, f"f{k}", rng.choice([0, 1, 5, 40, 90]))]


@pytest.fixture(scope="module", params=[1 << 20, 7])
def numbered(spark, forest, request):
    t = trees.nested_sets(spark.createDataFrame(forest, SCHEMA).repartition(4), request.param)
    return t.cache()


def below(forest):
    kids = defaultdict(list)
    for r in forest:
        kids[r[2]].append(r)

    def walk(node):
        for k in kids[node]:
            yield k
            yield from walk(k[1])

    return kids, {r[1]: list(walk(r[1])) for r in forest}


def test_numbers_are_those_of_a_walk(numbered, forest):
    _, under = below(forest)
    place = defaultdict(int)
    for r in numbered.collect():
        place[r.node] = r["first"]
        assert r["last"] - r["first"] == len(under[r.node])
    for node, nodes in under.items():
        assert [place[k[1]] for k in nodes] == list(range(place[node] + 1, place[node] + 1 + len(nodes)))


def test_control_flow_like_plain_code(numbered, forest):
    kids, under = below(forest)
    of = {r[1]: r for r in forest}
    want = set()
    for parent, row in kids.items():
        if parent is None:
            continue
        row = sorted(row, key=lambda r: (r[4], r[5]))
        run = [r for r in row if r[3] not in trees.NOT_EXECUTED]
        want |= {(a[1], b[1], "CFG_NEXT", None) for a, b in zip(run, run[1:])}
        for r in run:
            body = [d for d in sorted(under[r[1]], key=lambda d: (d[4], d[5])) if d[4] > r[4]]
            rest = [d for d in row if d[4] > r[4]]
            if r[3] == "IF_STATEMENT":
                want |= {(r[1], d[1], "CFG_BRANCH_TRUE", "true") for d in body[:1]} | {(r[1], d[1], "CFG_BRANCH_FALSE", "false") for d in rest[-1:]}
            elif r[3] in trees.LOOPS:
                want |= {(r[1], d[1], "CFG_LOOP_ENTRY", "loop") for d in body[:1]} | {(d[1], r[1], "CFG_NEXT", None) for d in body[-1:]} | {(r[1], d[1], "CFG_LOOP_EXIT", "exit") for d in rest[-1:]}
            elif r[3] in trees.TRIES:
                want |= {(r[1], d[1], "CFG_EXCEPTION", "exception") for d in under[r[1]] if d[3] in trees.CATCHES}
    for r in forest:
        up = r[2]
        while r[3] in trees.CONTROL and up and of[up][3] not in trees.CALLABLE:
            up = of[up][2]
        if r[3] in trees.CONTROL and up:
            want.add((up, r[1], "CONTROL_FLOW", None))
    got = [tuple(r) for r in trees.control_flow(numbered).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {t for _, _, t, _ in want} >= {"CFG_BRANCH_TRUE", "CFG_LOOP_EXIT", "CFG_EXCEPTION"}


def test_no_closure_and_no_nested_loop_in_the_plan(numbered):
    plan = trees.control_flow(numbered)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_flow_and_returns_like_plain_code(spark, numbered, forest):
    kids, under = below(forest)

    def backwards(node):
        for k in reversed(kids[node]):
            yield k
            yield from backwards(k[1])

    want = set()
    for r in forest:
        leaves = [d for d in backwards(r[1]) if d[3] in trees.LEAVES]
        if r[3] == "FSTRING":
            want |= {(d[1], r[1], "DFG_INTERP") for d in leaves if d[3] != "LITERAL"}
        if r[3] == "MEMBER_ACCESS" and leaves:
            want |= {(leaves[0][1], r[1], "DFG_PROPERTY"), (leaves[0][1], r[1], "DFG_ATTR")}
    assert {(r.src, r.dst, r.type) for r in trees.text_flow(numbered).collect()} == want
    functions = [r[1] for r in forest if r[3] in trees.CALLABLE]
    calls = spark.createDataFrame([("c", f) for f in functions[::2]] * 2, "call string, function string")
    got = sorted((r.src, r.dst) for r in trees.call_returns(numbered, calls).collect())
    assert got == sorted((f, d[1]) for f in functions[::2] for d in under[f] if d[3] == "RETURN")


def test_within_finds_each_pair_once(spark):
    rng = random.Random(8)
    points = [(k % 2, rng.randrange(200)) for k in range(150)]
    ranges = [(k % 2, a, a + rng.choice([-1, 0, 1, 7, 31, 150])) for k, a in enumerate(rng.randrange(200) for _ in range(80))]
    p = spark.createDataFrame([(k, i, x) for i, (k, x) in enumerate(points)], "k int, i int, x long")
    r = spark.createDataFrame([(k, j, a, b) for j, (k, a, b) in enumerate(ranges)], "k int, j int, a long, b long")
    got = sorted((x.i, x.j) for x in trees.within(p, r, ["k"], "x", "a", "b").collect())
    assert got == sorted((i, j) for i, (k, x) in enumerate(points) for j, (m, a, b) in enumerate(ranges) if k == m and a <= x <= b)
    assert trees.within(p, r.where("false"), ["k"], "x", "a", "b").count() == 0


def test_chains_end_and_cycles_too(spark):
    links = [(f"a{k}", f"a{k + 1}") for k in range(10)] + [("b0", "b1"), ("b1", "b2"), ("b2", "b0"), ("b3", "b0"), ("self", "self"), ("c", "a4"), (None, "a1"), ("n", None)]
    got = {(r.src, r.final, r.hops) for r in chains.final_targets(spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == {(f"a{k}", "a10", 10 - k) for k in range(10)} | {("c", "a10", 7)}
    assert chains.final_targets(spark.createDataFrame([], "src string, dst string")).count() == 0
    edges = spark.createDataFrame([("a0", "x", 0.5), ("y", "a9", None), ("a10", "x", 1.0), ("b0", "x", 1.0), ("c", "a10", 1.0), ("a1", "z", 2.0)], "src string, dst string, confidence double")
    lifted = {tuple(r) for r in chains.lift(edges, spark.createDataFrame(links, "src string, dst string")).collect()}
    assert lifted == {("y", "a10", 0.8), ("a10", "z", 1.0)}


def test_scopes_like_plain_code(spark):
    rng = random.Random(6)
    parent = {f"s{k}": (f"s{rng.randrange(k)}" if k else "global") for k in range(40)}
    parent |= {"loop1": "loop2", "loop2": "loop1"}
    place = lambda: rng.choice([*parent, None, "lost", "global"])
    definitions = [(f"d{k:03}", f"n{rng.randrange(4)}", place(), rng.randrange(30)) for k in range(150)]
    uses = [(f"u{k:03}", f"n{rng.randrange(5)}", place(), rng.randrange(30)) for k in range(150)]

    def chain(scope):
        out = []
        while scope and scope not in out:
            out.append(scope)
            scope = parent.get(scope)
        return out

    found = chains.scope_chains(spark.createDataFrame(list(parent.items()), "scope string, parent string")).cache()
    assert {r.scope: r.chain for r in found.collect()} == {s: chain(s) for s in parent}
    want = {}
    for u, name, scope, line in uses:
        seen = [(-ln, d) for d, n, s, ln in definitions if n == name and ln < line and (s is None or scope is None or s in chain(scope))]
        want[u] = min(seen)[1] if seen else None
    schema = "name string, scope string, line int"
    got = chains.reaching_definitions(spark.createDataFrame(uses, f"use string, {schema}"), spark.createDataFrame(definitions, f"def string, {schema}"), found)
    assert {r.use: r["def"] for r in got.collect()} == want and any(want.values())


def test_callbacks_resolve_by_the_chain(spark):
    scopes = spark.createDataFrame([("inner", "outer"), ("outer", "global")], "scope string, parent string")
    symbols = spark.createDataFrame([("inner", "cb", None), ("outer", "cb", "f_outer"), ("global", "cb", "f_global"), ("global", "g", None)], "scope string, name string, function string")
    uses = spark.createDataFrame([("u1", "cb", "inner"), ("u2", "cb", "other"), ("u3", "cb", None), ("u4", "g", "inner"), ("u5", "none", "inner")], "use string, name string, scope string")
    assigned = spark.createDataFrame([("g", 2, "late"), ("g", 1, "early"), ("g", 0, None)], "name string, ord int, function string")
    found = chains.resolve_functions(uses, symbols, chains.scope_chains(scopes), assigned)
    assert {r.use: r.function for r in found.collect()} == {"u1": "f_outer", "u2": None, "u3": "f_global", "u4": "early", "u5": None}
    passed = found.where("function is not null").select(F.lit("callee").alias("callee"), F.lit(0).alias("pos"), F.col("function").alias("callback"))
    parameters = spark.createDataFrame([("callee", 0, "fn", "p"), ("f_outer", 0, "x", "x1"), ("early", 0, "y", "y1")], "function string, pos int, name string, node string")
    inside = spark.createDataFrame([("callee", "fn", 0, "value")], "function string, name string, pos int, arg string")
    assert {(r.src, r.dst) for r in linking.callback_flows(passed, parameters, inside).collect()} == {("value", "x1"), ("value", "y1")}


def test_taint_meets_in_the_middle(spark):
    rng = random.Random(12)
    e = {(rng.randrange(120), rng.randrange(120)) for _ in range(190)} | {(k, k + 1) for k in range(200, 214)}
    sources, sinks = [0, 3, 7, 50, 200, 205], [9, 50, 77, 100, 209, 214, 999]
    near = {}
    for s in sources:
        near[s] = {s: 0}
        level = [s]
        for depth in range(1, 500):
            level = [b for a in level for x, b in e if x == a and b not in near[s]]
            near[s] |= {b: depth for b in level}
    df = spark.createDataFrame(list(e), "src long, dst long")
    a, b = (spark.createDataFrame([(x,) for x in n], "node long") for n in (sources, sinks))
    for most in (1, 4, 9):
        got = {(r.source, r.sink): r.depth for r in taint.flows(df, a, b, most).collect()}
        assert got == {(s, t): near[s][t] for s in sources for t in sinks if near[s].get(t, 99) <= most}
    kept = {tuple(r) for r in taint.between(df, a, b).collect()}
    assert len(kept) < len(e)
    reach = {(r.start, r.node) for r in graph.closure(spark.createDataFrame(list(kept), "src long, dst long"), a).join(b, "node").collect()}
    assert reach == {(s, t) for s in sources for t in sinks if t in near[s]}


def test_taint_rules(spark):
    rows = [("PARAMETER", None, "function_parameter", None), ("CALL_EXPRESSION", "Request.GET", "http_request_data", None), ("CALL_EXPRESSION", "raw_input", "user_input", "sql_execution")]
    rows += [("CALL_EXPRESSION", "os.popen", "file_read", "command_execution"), ("CALL_EXPRESSION", None, None, None), ("IDENTIFIER", "open", None, None), ("CALL_EXPRESSION", "f.write", None, "file_write")]
    df = spark.createDataFrame(rows, "type string, name string, a string, b string")
    got = df.select("a", "b", taint.rule_of(F.col("type"), F.col("name"), taint.SOURCES).alias("x"), taint.rule_of(F.col("type"), F.col("name"), taint.SINKS).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(r.a, r.b) for r in got]


def test_taint_edges_go_only_where_sinks_are(spark):
    nodes = [(0, "PARAMETER", "p", 1), (1, "IDENTIFIER", "x", 2), (2, "CALL_EXPRESSION", "cursor.execute", 3), (3, "IDENTIFIER", "dead", 4)]
    n = spark.createDataFrame([(i, t, m, None, None, "f", ln, 0) for i, t, m, ln in nodes], "node long, type string, name string, value string, source_code string, file string, line int, col int")
    e = spark.createDataFrame([(0, 1, "DFG_FLOW"), (1, 2, "DFG_RET"), (0, 3, "DFG_FLOW"), (2, 0, "OTHER")], "src long, dst long, type string")
    none = spark.createDataFrame([], "src long, dst long")
    got = {tuple(r) for r in enrich.taint_edges(n, none, e).collect()}
    assert got == {(0, 0, "TAINT_SOURCE"), (2, 2, "TAINT_SINK"), (0, 2, "TAINT_FLOW")}


def pages(spark, rows):
    return spark.createDataFrame([(p, "html", c) for p, c in rows], "path string, language string, content string")


def state(b):
    return tuple(sorted(map(repr, map(tuple, df.select(*cols).collect()))) for df, cols in ((b.files, ["path", "hash"]), (b.nodes, ["path", "node", "type", "name", "value"]), (b.edges, ["path", "src", "dst", "type"]), (b.links, ["path", "ref", "target"])))


def test_builds_parse_and_link_only_what_changed(spark, tmp_path):
    link = lambda *refs: "".join(f'<a href="{r}">x</a>' for r in refs)
    form = '<form id="f"><input name="n" onclick="g()">{{ user.name }}</form>'
    first = [("http://h/a/1", link("/b", "/c")), ("http://h/b/1", form), ("http://h/b/2", form), ("http://h/d/1", link("/a", "/gone", "/b")), ("http://h/e", None)]
    second = [("http://h/a/1", link("/b", "/c")), ("http://h/b/2", form + "<p>"), ("http://h/d/1", link("/a", "/gone", "/b")), ("http://h/c/9", form), ("http://h/e", None), ("http://h/f", link("/a"))]
    third = [*second[:-1], ("http://h/f", link("/a", "/a"))]
    g = R.page_graph(spark, str(tmp_path / "kept"))
    made = g.build(pages(spark, first))
    assert (made.parsed, made.relinked) == (4, 5)
    made = g.build(pages(spark, second))
    # parsed: the longer form and f; linked anew: those two, c, and a and d, which name b, of which a page went, or c, which came
    assert (made.parsed, made.relinked) == (2, 5)
    assert state(made) == state(R.page_graph(spark, str(tmp_path / "new")).build(pages(spark, second)))
    assert {(r.path, r.ref): r.target for r in made.links.collect()}["http://h/a/1", "/c"] == "http://h/c/9"
    again = R.page_graph(spark, str(tmp_path / "kept"))
    assert again.version == 2
    made = again.build(pages(spark, second))
    assert (made.parsed, made.relinked) == (0, 0)
    made = again.build(pages(spark, third))
    assert (made.parsed, made.relinked) == (1, 1)
    assert state(made) == state(R.page_graph(spark, str(tmp_path / "newer")).build(pages(spark, third)))


def test_builds_take_all_contents_of_a_path(spark, tmp_path):
    link = lambda *refs: "".join(f'<a href="{r}">x</a>' for r in refs)
    first = [("http://h/a/1", link("/b", "/c")), ("http://h/a/1", link("/b", "/d")), ("http://h/b/1", ""), ("http://h/b/1", None), ("http://h/e", link("/x"))]
    second = [("http://h/a/1", link("/b", "/c")), ("http://h/a/1", link("/b", "/d")), ("http://h/b/1", ""), ("http://h/e", link("/x")), ("http://h/e", link("/a"))]
    third = second[1:4]
    g = R.page_graph(spark, str(tmp_path / "kept"))
    made = g.build(pages(spark, first))
    assert (made.parsed, made.relinked) == (4, 3)
    rows = sorted(map(tuple, made.links.collect()))
    assert rows == [("http://h/a/1", "/b", "http://h/b/1"), ("http://h/a/1", "/c", None), ("http://h/a/1", "/d", None), ("http://h/e", "/x", None)]
    for snapshot, counts in ((second, (1, 2)), (second, (0, 2)), (third, (0, 2)), (third, (0, 0))):  # a path with two contents is linked anew
        made = g.build(pages(spark, snapshot))
        assert (made.parsed, made.relinked) == counts
        if snapshot == second:
            assert made.links.count() == 5 and made.files.count() == 5
    assert state(made) == state(R.page_graph(spark, str(tmp_path / "new")).build(pages(spark, third)))


def test_builds_of_nothing_and_after_a_break(spark, tmp_path):
    g = R.page_graph(spark, str(tmp_path / "s"))
    assert g.build(pages(spark, [])).links.count() == 0
    rows = pages(spark, [("http://h/a/1", '<a href="/a">x</a>'), ("http://h/b", "")])
    broken = RepositoryGraph(spark, str(tmp_path / "s"), g.parse, g.edges_of, lambda n: n.select("hash", F.raise_error(F.lit("broken off")).cast("string").alias("ref")), g.keys, digits=1)
    with pytest.raises(Exception, match="broken off"):
        broken.build(rows)
    made = R.page_graph(spark, str(tmp_path / "s")).build(rows)
    assert made.parsed == 2 and state(made) == state(R.page_graph(spark, str(tmp_path / "t")).build(rows))
