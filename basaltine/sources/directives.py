"""Configuration files of directives as rows: nginx-like blocks, and files of KEY=VALUE lines.

A file becomes an array of (name, value, context, line): the directive's name in lower case, its arguments, the headers
of the blocks it stands in from the outside in, and its first line. A block is a directive of its own. Checks look at
the rows; none of them reads the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROW = "struct<name:string,value:string,context:string,line:int>"
_SHAPE = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("context", pa.string()), ("line", pa.int32())]))


def tokens(text: str) -> Iterator[tuple[str, int]]:
    """Words, quoted strings without their quotes, and the signs ; { } with the line they begin on. # begins a comment."""
    at, line, size = 0, 1, len(text)
    while at < size:
        sign = text[at]
        if sign == "\n":
            line, at = line + 1, at + 1
        elif sign.isspace():
            at += 1
        elif sign == "#":
            end = text.find("\n", at)
            at = size if end < 0 else end
        elif sign in ";{}":
            yield sign, line
            at += 1
        elif sign in "\"'":
            end = text.find(sign, at + 1)
            end = size if end < 0 else end
            yield "\x00" + text[at + 1 : end], line  # quoted, so never a sign
            line += text.count("\n", at, end)
            at = end + 1
        else:
            end = at
            while end < size and not text[end].isspace() and text[end] not in ";{}":
                end += 1
            yield text[at:end], line
            at = end


def block_directives(text: str) -> list[dict]:
    """The directives of a file with blocks; what is not closed ends with the file."""
    rows: list[dict] = []
    context: list[str] = []
    words: list[str] = []
    began = 1

    def flush(opens: bool) -> None:
        if words:
            plain = [w.lstrip("\x00") for w in words]
            rows.append({"name": plain[0].lower(), "value": " ".join(plain[1:]), "context": " > ".join(context), "line": began})
            if opens:
                context.append(" ".join(plain).lower())
        elif opens:
            context.append("")
        words.clear()

    for word, line in tokens(text):
        if word == ";" or word == "{":
            flush(word == "{")
        elif word == "}":
            flush(False)
            if context:
                context.pop()
        else:
            if not words:
                began = line
            words.append(word)
    flush(False)
    return rows


def assignments(text: str) -> list[dict]:
    """KEY=VALUE lines; a leading ENV or export is left out, and so are comments. A key alone has an empty value."""
    rows = []
    for number, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if not bare or bare[0] == "#":
            continue
        first, _, rest = bare.partition(" ")
        if first.lower() in ("env", "export", "arg"):
            bare = rest.strip()
        elif " " in first or ("=" not in bare and rest):
            continue
        cut = next((k for k, c in enumerate(bare) if c in "= "), len(bare))
        rows.append({"name": bare[:cut].strip().lower(), "value": bare[cut + 1 :].strip(" =\"'"), "context": "", "line": number})
    return rows


#: Which reader a kind of file has.
READERS = {"nginx": block_directives, "coturn": assignments, "env": assignments, "dockerfile": assignments}


def with_directives(files: DataFrame, kind: str, content: str, name: str) -> DataFrame:
    """files with a column of rows; empty for kinds that have no directives."""
    at_kind, at_text = files.columns.index(kind), files.columns.index(content)
    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + f", `{name}` array<{ROW}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(at_kind).to_pylist(), b.column(at_text).to_pylist())
            rows = [READERS[k](t or "") if k in READERS else [] for k, t in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _SHAPE)], names=[*b.schema.names, name])

    return files.mapInArrow(run, schema)
