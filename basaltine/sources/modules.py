"""What modules import and export, read from the statements of Python, JavaScript and TypeScript files.

A grammar is a list of statement forms; a form is a pattern for the whole text with groups for a name, a list of names
and a module. Every form is one expression over the text, so a file is read once and nothing leaves the JVM. Files are
(file, language, content). Comments are blanked first. Texts without statements, empty and null texts give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPORT = "struct<module:string,name:string,local:string>"
EXPORT = "struct<name:string,local:string,is_default:boolean,module:string>"
#: A name of a script; the sign $ is a part of it.
NAME = r"[\w$]+"
FROM = r"""from\s*['"]([^'"]+)['"]"""
REQUIRED = r"""=\s*require\(\s*['"]([^'"]+)['"]\s*\)"""


def none() -> Column:
    return F.lit(None).cast("string")


def _script(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", " "), r"(?m)(^|[^:'\"`])//[^\n]*", "$1")


def _python(content: Column) -> Column:
    return F.regexp_replace(content, r"(?m)(^|\s)#[^\n]*", "$1")


def _matches(text: Column, pattern: str, groups: int) -> Column:
    """One struct (g1, g2, ...) for each match; groups that took no part are empty."""
    found = [F.regexp_extract_all(text, F.lit(f"(?m){pattern}"), F.lit(k)) for k in range(1, groups + 1)]
    return F.transform(found[0], lambda g, i: F.struct(g.alias("g1"), *[F.get(f, i).alias(f"g{k}") for k, f in enumerate(found[1:], 2)]))


def _names(listed: Column, alias: str) -> Column:
    """(name, local) of a list of names, each with an alias or not; local is name where there is none."""
    items = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^type ", "")), lambda x: x.rlike(r"^[\w$*.]"))
    name = lambda x: F.regexp_extract(x, r"^([\w$.]+|\*)", 1)
    return F.transform(items, lambda x: F.struct(name(x).alias("name"), F.coalesce(F.nullif(F.regexp_extract(x, alias, 1), F.lit("")), name(x)).alias("local")))


def _all(parts: list[Column], kind: str) -> Column:
    empty = F.array().cast(f"array<{kind}>")
    return reduce(lambda a, b: F.concat(a, F.coalesce(b.cast(f"array<{kind}>"), empty)), parts, empty)


AS, COLON = rf"\bas ({NAME})$", rf":\s?({NAME})"


def script_imports(text: Column) -> Column:
    def one(pattern: str, groups: int, module: str, name: str) -> Column:
        return F.transform(_matches(text, pattern, groups), lambda m: F.struct(m[module].alias("module"), F.lit(name).alias("name"), F.nullif(m["g1"], F.lit("")).alias("local")))

    def many(pattern: str, groups: int, module: str, listed: str, alias: str) -> Column:
        return F.flatten(F.transform(_matches(text, pattern, groups), lambda m: F.transform(_names(m[listed], alias), lambda n: F.struct(m[module].alias("module"), n["name"].alias("name"), n["local"].alias("local")))))

    start = r"^\s*import\s+(?:type\s+)?"
    only = F.transform(_matches(text, r"""^\s*import\s*['"]([^'"]+)['"]""", 1), lambda m: F.struct(m["g1"].alias("module"), none().alias("name"), none().alias("local")))
    return _all(
        [
            one(start + rf"({NAME})\s*(?:,\s*(?:\{{[^}}]*\}}|\*\s+as\s+{NAME})\s*)?" + FROM, 2, "g2", "default"),
            many(start + rf"(?:{NAME}\s*,\s*)?\{{([^}}]*)\}}\s*" + FROM, 2, "g2", "g1", AS),
            one(start + rf"(?:{NAME}\s*,\s*)?\*\s+as\s+({NAME})\s+" + FROM, 2, "g2", "*"),
            only,
            one(rf"\b(?:const|let|var|import)\s+({NAME})\s*" + REQUIRED, 2, "g2", "*"),
            many(r"\b(?:const|let|var)\s+\{([^}]*)\}\s*" + REQUIRED, 2, "g2", "g1", COLON),
        ],
        IMPORT,
    )


def script_exports(text: Column) -> Column:
    """Names that a module gives, with those it passes on from another module; the name * passes on all."""

    def row(name: Column, local: Column, default: bool | Column = False, module: Column | None = None) -> Column:
        is_default = F.lit(default) if isinstance(default, bool) else default
        return F.struct(name.alias("name"), local.alias("local"), is_default.alias("is_default"), (none() if module is None else module).alias("module"))

    def one(pattern: str, default: bool) -> Column:
        return F.transform(_matches(text, pattern, 1), lambda m: row(F.lit("default") if default else m["g1"], F.nullif(m["g1"], F.lit("")), default))

    words = r"(?:function\*?|class|const|let|var|interface|type|enum|namespace)"
    listed = F.flatten(
        F.transform(
            _matches(text, r"^\s*export\s+(?:type\s+)?\{([^}]*)\}(?:\s*" + FROM + ")?", 2),
            lambda m: F.transform(_names(m["g1"], AS), lambda n: row(n["local"], n["name"], n["local"] == "default", F.nullif(m["g2"], F.lit("")))),
        )
    )
    passed = F.transform(_matches(text, rf"^\s*export\s+\*\s*(?:as\s+({NAME})\s+)?" + FROM, 2), lambda m: row(F.coalesce(F.nullif(m["g1"], F.lit("")), F.lit("*")), F.lit("*"), False, m["g2"]))
    common = F.flatten(F.transform(_matches(text, r"^\s*module\.exports\s*=\s*\{([^}]*)\}", 1), lambda m: F.transform(_names(m["g1"], COLON), lambda n: row(n["name"], n["local"]))))
    return _all(
        [
            one(r"^\s*export\s+default\b[ \t]*(?:async\s+)?(?:(?:function\*?|class)\b[ \t]*)?([\w$]*)", True),
            one(r"^\s*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?" + words + rf"\s+({NAME})", False),
            listed,
            passed,
            common,
            one(rf"^\s*(?:module\.)?exports\.({NAME})\s*=", False),
            one(r"^\s*(?:module\.exports|exports|export)\s*=(?!=|\s*(?:\{|require\b))\s*(?:new\s+)?(?:async\s+)?(?:(?:function\*?|class)\b[ \t]*)?([\w$]*)", True),
        ],
        EXPORT,
    )


def python_imports(text: Column) -> Column:
    plain = F.flatten(
        F.transform(
            _matches(text, r"^[ \t]*import[ \t]+([\w., \t]+)$", 1),
            lambda m: F.transform(_names(m["g1"], AS), lambda n: F.struct(n["name"].alias("module"), F.lit("*").alias("name"), F.split(n["local"], r"\.")[0].alias("local"))),
        )
    )
    parts = F.flatten(
        F.transform(
            _matches(text, r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n(]+))", 3),
            lambda m: F.transform(_names(F.concat(m["g2"], m["g3"]), AS), lambda n: F.struct(m["g1"].alias("module"), n["name"].alias("name"), n["local"].alias("local"))),
        )
    )
    return _all([plain, parts], IMPORT)


def python_exports(text: Column) -> Column:
    """Names defined at the top level; where __all__ is set, only those it lists."""
    found = F.array_distinct(F.concat(
        F.regexp_extract_all(text, F.lit(r"(?m)^(?:async[ \t]+)?(?:def|class)[ \t]+(\w+)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(?m)^(\w+)[ \t]*(?::[^=\n]+)?=(?!=)"), F.lit(1)),
    ))
    listed = F.regexp_extract_all(text, F.lit(r"(?m)^__all__[ \t]*=[ \t]*[\[(]([^\])]*)[\])]"), F.lit(1))
    names = F.regexp_extract_all(F.array_join(listed, ","), F.lit(r"""['"](\w+)['"]"""), F.lit(1))
    kept = F.filter(found, lambda x: (x != "__all__") & ((F.size(listed) == 0) | F.array_contains(names, x)))
    return F.transform(kept, lambda x: F.struct(x.alias("name"), x.alias("local"), F.lit(False).alias("is_default"), none().alias("module")))


def _by_language(python: Column, script: Column, kind: str) -> Column:
    return F.when(F.col("language") == "python", python.cast(f"array<{kind}>")).when(F.col("language").isin("javascript", "typescript"), script.cast(f"array<{kind}>"))


def imports(files: DataFrame) -> DataFrame:
    """(file, ord, module, name, local): name is * for a whole module, default, a name, or null for its effects alone."""
    content = F.coalesce("content", F.lit(""))
    found = _by_language(python_imports(_python(content)), script_imports(_script(content)), IMPORT)
    return files.select("file", F.posexplode(found).alias("ord", "i")).select("file", "ord", "i.*")


def exports(files: DataFrame) -> DataFrame:
    """(file, ord, name, local, is_default, module): module is set where a name is passed on from it."""
    content = F.coalesce("content", F.lit(""))
    found = _by_language(python_exports(_python(content)), script_exports(_script(content)), EXPORT)
    return files.select("file", F.posexplode(found).alias("ord", "e")).select("file", "ord", "e.*").dropDuplicates(["file", "name", "module"])
