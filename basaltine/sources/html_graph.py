"""Pages as a graph: elements, event handlers and template variables as nodes; which form a field feeds as edges.

Pages are read by the standard library's parser, which takes any text. Nodes are (file, node, parent, type, name, value,
line); a field belongs to the form it stands in or names by its form attribute, a handler to its element, a variable to
the element around it. Null and empty pages have no nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "file string, node int, parent int, type string, name string, value string, line int, form string"
#: Elements that are nodes, and the attributes that name them and give their value.
ELEMENTS = {
    "form": ("FORM", "id", "action"),
    "input": ("INPUT", "name", "type"),
    "textarea": ("TEXTAREA", "name", None),
    "select": ("SELECT", "name", None),
    "button": ("BUTTON", "name", "type"),
    "a": ("LINK", "id", "href"),
    "script": ("SCRIPT", "id", "src"),
    "iframe": ("FRAME", "name", "src"),
}
FIELDS = ["INPUT", "TEXTAREA", "SELECT", "BUTTON"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
VARIABLE = re.compile(r"\{\{\s*([A-Za-z_][\w.]*)|\$\{\s*([A-Za-z_][\w.]*)|\ue000%[=-]\s*([A-Za-z_][\w.]*)")


class _Reader(HTMLParser):
    def __init__(self, file: str):
        super().__init__(convert_charrefs=True)
        self.file, self.rows, self.open = file, [], [("", -1)]

    def add(self, kind: str, name: str | None, value: str | None, form: str | None = None) -> int:
        self.rows.append((self.file, len(self.rows), self.open[-1][1], kind, name, value, self.getpos()[0], form))
        return len(self.rows) - 1

    def variables(self, text: str) -> None:
        for m in VARIABLE.finditer(text):
            self.add("TEMPLATE_VARIABLE", next(g for g in m.groups() if g), None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        node = self.open[-1][1]
        if tag in ELEMENTS or any(k.startswith("on") for k in given):
            kind, name, value = ELEMENTS.get(tag, ("ELEMENT", "id", None))
            node = self.add(kind, given.get(name), given.get(value) if value else None, given.get("form"))
        self.open.append((tag, node))
        for k, v in attrs:
            if k.startswith("on") and v:
                self.add("EVENT_HANDLER", k, v)
            elif v:
                self.variables(v)
        if tag in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.variables(data)


def parsed(file: str, page: str | None) -> list[tuple]:
    reader = _Reader(file)
    reader.feed((page or "").replace("<%", "\ue000%"))  # a template's own signs, which the parser would cut
    reader.close()
    return reader.rows


#: Nodes after which a worker hands on what it has; a frame for each page would cost more than reading the page.
CHUNK = 10_000


def nodes(pages: DataFrame, path: str = "file", content: str = "content") -> DataFrame:
    """The nodes of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODES.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for p, text in zip(b[path], b[content]):
                rows += parsed(p, text)
                if len(rows) >= CHUNK:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return pages.select(path, content).mapInPandas(run, NODES)


def edges(n: DataFrame) -> DataFrame:
    """(file, src, dst, type): fields to their form, handlers to their element, variables to what they stand in."""
    forms = n.where("type = 'FORM'").select("file", F.col("node").alias("dst"), F.col("name").alias("form"))
    fields = n.where(F.col("type").isin(FIELDS)).select("file", F.col("node").alias("src"), "parent", "form")
    named = fields.where("form is not null").join(forms, ["file", "form"]).select("file", "src", "dst")
    inside = fields.where("form is null").select("file", "src", F.col("parent").alias("dst")).join(forms.drop("form"), ["file", "dst"], "left_semi").select("file", "src", "dst")
    owned = n.where(F.col("type").isin("EVENT_HANDLER", "TEMPLATE_VARIABLE") & (F.col("parent") >= 0))
    kind = F.when(F.col("type") == "EVENT_HANDLER", "EVENT_TRIGGER").otherwise("TEMPLATE_FLOW")
    return named.unionByName(inside).select("file", "src", "dst", F.lit("INPUT_TO_FORM").alias("type")).unionByName(
        owned.select("file", F.col("node").alias("src"), F.col("parent").alias("dst"), kind.alias("type"))
    )
