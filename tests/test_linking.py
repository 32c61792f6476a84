"""Imports, exports, links between modules, and flows between functions."""

import pytest

from basaltine.operators import linking
from basaltine.sources import modules

SOURCES = {
    "app/main.js": """import Base, { helper as h, other } from './lib/tools';
import * as ns from '../shared/util';
import './effects';
const fs = require('fs');
const { read, write: put } = require("./lib/io.js");
// import gone from './gone'
/* export const hidden = 1 */
export default class Main {}
export const version = 1, more = 2;
export { h as helperAgain, other };
export { deep } from './lib/deep';
export * from './lib/all';
export * as every from './lib/every';
""",
    "app/lib/tools.ts": "export default function build() {}\nexport async function helper() {}\nexport type Kind = string;\nexport interface Shape {}\n",
    "app/lib/io.js": "module.exports = { read, write: writeAll };\nexports.extra = 3;\n",
    "app/lib/one.js": "module.exports = Single;\n",
    "app/lib/eq.ts": "export = Whole;\n",
    "shared/util/index.js": "export function util() {}\n",
    "pkg/a.py": "import os, pkg.b as bee\nfrom .b import (one,\n    two as deux)\nfrom ..other.c import *\nfrom pkg import b\n# import gone\ndef f(): pass\nclass C: pass\nX: int = 1\nY == 2\n_private = 3\n",
    "pkg/b.py": "__all__ = ['one', \"two\"]\ndef one(): pass\ndef two(): pass\ndef three(): pass\n",
    "pkg/__init__.py": "",
    "other/c.py": "async def go(): pass\n",
}


@pytest.fixture(scope="module")
def files(spark):
    kinds = {"py": "python", "js": "javascript", "ts": "typescript"}
    rows = [(p, k, kinds[p.rsplit(".", 1)[1]], t) for k, (p, t) in enumerate(SOURCES.items())] + [("empty.py", 98, "python", None), ("x.go", 99, "go", "import x")]
    return spark.createDataFrame(rows, "file string, ord int, language string, content string")


def test_imports(files):
    got = {}
    for r in modules.imports(files).collect():
        got.setdefault(r.file, set()).add((r.module, r.name, r.local))
    assert got == {
        "app/main.js": {
            ("./lib/tools", "default", "Base"), ("./lib/tools", "helper", "h"), ("./lib/tools", "other", "other"), ("../shared/util", "*", "ns"),
            ("./effects", None, None), ("fs", "*", "fs"), ("./lib/io.js", "read", "read"), ("./lib/io.js", "write", "put"),
        },
        "pkg/a.py": {
            ("os", "*", "os"), ("pkg.b", "*", "bee"), (".b", "one", "one"), (".b", "two", "deux"), ("..other.c", "*", "*"), ("pkg", "b", "b"),
        },
    }


def test_exports(files):
    got = {}
    for r in modules.exports(files).collect():
        got.setdefault(r.file, set()).add((r.name, r.local, r.is_default, r.module))
    assert got["app/main.js"] == {
        ("default", "Main", True, None), ("version", "version", False, None), ("helperAgain", "h", False, None), ("other", "other", False, None),
        ("deep", "deep", False, "./lib/deep"), ("*", "*", False, "./lib/all"), ("every", "*", False, "./lib/every"),
    }
    assert {x[0] for x in got["app/lib/tools.ts"]} == {"default", "helper", "Kind", "Shape"}
    assert got["app/lib/io.js"] == {("read", "read", False, None), ("write", "writeAll", False, None), ("extra", "extra", False, None)}
    assert got["app/lib/one.js"] == {("default", "Single", True, None)} and got["app/lib/eq.ts"] == {("default", "Whole", True, None)}
    assert {x[0] for x in got["pkg/a.py"]} == {"f", "C", "X", "_private"} and {x[0] for x in got["pkg/b.py"]} == {"one", "two"}
    assert set(got) == set(SOURCES) - {"pkg/__init__.py"}


def test_resolution_and_links(files):
    found = linking.resolve_imports(modules.imports(files), files)
    target = {(r.file, r.module): r.target for r in found.collect()}
    assert target == {
        ("app/main.js", "./lib/tools"): "app/lib/tools.ts",
        ("app/main.js", "../shared/util"): "shared/util/index.js",
        ("app/main.js", "./effects"): None,
        ("app/main.js", "fs"): None,
        ("app/main.js", "./lib/io.js"): "app/lib/io.js",
        ("pkg/a.py", "os"): None,
        ("pkg/a.py", "pkg.b"): "pkg/b.py",
        ("pkg/a.py", ".b"): "pkg/b.py",
        ("pkg/a.py", "..other.c"): "other/c.py",
        ("pkg/a.py", "pkg"): "pkg/__init__.py",
    }
    links = {(r.file, r.local, r.target, r.export) for r in linking.link_exports(found, modules.exports(files)).collect()}
    assert {x for x in links if x[0] == "app/main.js"} == {
        ("app/main.js", "Base", "app/lib/tools.ts", "default"), ("app/main.js", "h", "app/lib/tools.ts", "helper"), ("app/main.js", "ns", "shared/util/index.js", "util"),
        ("app/main.js", "read", "app/lib/io.js", "read"), ("app/main.js", "put", "app/lib/io.js", "write"),
    }
    assert ("pkg/a.py", "bee", "pkg/b.py", "two") in links and ("pkg/a.py", "*", "other/c.py", "go") in links


def test_tails_of_either_side_and_first_file_wins(spark):
    files = spark.createDataFrame([("src/deep/utils/helper.js", 2), ("lib/utils/helper.js", 1), ("core.py", 3)], "file string, ord int")
    imports = spark.createDataFrame([("m", "utils/helper"), ("m", "company.core"), ("m", "tils.helper"), ("m", "")], "file string, module string")
    got = {r.module: r.target for r in linking.resolve_imports(imports, files).collect()}
    assert got == {"utils/helper": "lib/utils/helper.js", "company.core": "core.py", "tils.helper": None, "": None}


def test_uses_and_calls(spark):
    links = spark.createDataFrame([("m.js", "h", "t.js", "helper", "helper")], "file string, local string, target string, name string, export string")
    ids = spark.createDataFrame([("m.js", "h", 1, True), ("m.js", "h", 5, False), ("m.js", "h", 9, None), ("n.js", "h", 7, False)], "file string, name string, node long, in_import boolean")
    uses = linking.export_uses(links, ids)
    assert {r.node for r in uses.collect()} == {5, 9}
    syntax = spark.createDataFrame([(4, 5), (8, 9)], "src long, dst long")
    nodes = spark.createDataFrame([(4, "CALL"), (8, "ASSIGNMENT")], "node long, type string")
    assert [tuple(r) for r in linking.use_calls(uses, syntax, nodes).collect()] == [(4, "t.js", "helper")]


def test_flows_between_functions(spark):
    calls = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "callee string, call long")
    returns = spark.createDataFrame([("f", 10), ("f", 11), ("f", None), ("h", 12)], "function string, value long")
    assert {tuple(r) for r in linking.return_flows(calls, returns).collect()} == {(10, 1), (10, 2), (11, 1), (11, 2)}
    functions = spark.createDataFrame([("inner", "outer"), ("other", "outer")], "function string, parent_scope string")
    definitions = spark.createDataFrame([("outer", "x", 1), ("outer", "y", 2), ("inner", "y", 3)], "scope string, name string, node long")
    uses = spark.createDataFrame([("inner", "x", 5), ("inner", "y", 6), ("other", "y", 7), ("other", "z", 8)], "function string, name string, node long")
    assert {tuple(r) for r in linking.closure_flows(functions, definitions, uses).collect()} == {("inner", "x", 1, 5), ("other", "y", 2, 7)}
    passed = spark.createDataFrame([("process", 1, "cb")], "callee string, pos int, callback string")
    parameters = spark.createDataFrame([("process", 0, "data", 20), ("process", 1, "done", 21), ("cb", 0, "out", 30), ("cb", 1, "more", 31)], "function string, pos int, name string, node long")
    invocations = spark.createDataFrame([("process", "done", 0, 40), ("process", "log", 0, 41)], "function string, name string, pos int, arg long")
    assert [tuple(r) for r in linking.callback_flows(passed, parameters, invocations).collect()] == [(40, 30, 0.8)]
