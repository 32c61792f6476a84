"""Text predicates and transformations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def label_matches(label: Column, pattern: Column) -> Column:
    """Whether a pattern names a whole token of a label; patterns with . ( ) ' or " match as substrings.

    Both are compared as they are; lower-case them first. An empty label or pattern never matches.
    """
    whole = F.array_contains(F.split(label, WORD_BREAK), pattern)
    part = label.contains(pattern)
    found = F.when(pattern.rlike(r"[.()'\"]"), part).otherwise(whole)
    return F.coalesce((label != "") & (pattern != "") & found, F.lit(False))


def normalize_sink(sink: Column) -> Column:
    """A sink's comparable name: the callee in lower case, without self. or this."""
    low = F.lower(F.trim(sink))
    callee = F.when(low.rlike(r"^[\w.]+\s*\("), F.regexp_extract(low, r"^([\w.]+)\s*\(", 1)).otherwise(
        F.regexp_replace(low, r"[();]+$", "")
    )
    return F.regexp_replace(F.trim(callee), r"^(self|this)\.", "")


def slashes(path: Column) -> Column:
    """A path with forward slashes and without ./ in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def same_path(a: Column, b: Column) -> Column:
    """Whether one path is the other or a tail of it."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def first_line_of(text: Column, pattern: Column) -> Column:
    """Number of the first line that a single-line pattern matches, from 1; 0 if none."""
    return F.array_position(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_like(x, pattern)), True)


def snippet(text: Column, start: Column, end: Column, context: int) -> Column:
    """Numbered lines around start to end; flagged ones are marked."""
    lines = F.split(text, "\n", -1)
    low = F.greatest(F.lit(1), start - context)
    high = F.least(F.size(lines), end + context)

    def show(i: Column) -> Column:
        mark = F.when((i >= start) & (i <= end), F.lit(">>> ")).otherwise(F.lit("    "))
        return F.format_string("%s%4d | %s", mark, i, F.get(lines, i - 1))

    return F.when(low <= high, F.array_join(F.transform(F.sequence(low, high), show), "\n")).otherwise(F.lit(""))


def count_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


#: File extensions and their languages.
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "html": "html",
    "htm": "html",
    "java": "java",
    "go": "go",
    "rb": "ruby",
    "php": "php",
    "c": "c",
}


def language_of(path: Column) -> Column:
    """Language by extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1)))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path is left out: plain patterns are substrings of it, those with * or ? are globs on the file name."""
    out = F.lit(False)
    name = F.element_at(F.split(path, "/"), -1)
    for p in patterns:
        if "*" in p or "?" in p:
            regex = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in p)
            out = out | name.rlike(f"^{regex}$")
        else:
            out = out | path.contains(p)
    return out
