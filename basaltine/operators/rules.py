"""The rule catalog and its scan over texts.

Rules are a small in-code or JSON catalog (bounded by its author); they go into the plan as constants, so a scan is
one pass over the texts without any join, and every pattern is compiled once. Invalid patterns are dropped when a rule is registered.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "rule_id string, name string, owasp string, cwe string, description string, severity string, confidence string, "
    "finding_polarity string, sources array<string>, sinks array<string>, patterns array<string>, sanitizers array<string>, "
    "required_guards array<string>, regex_patterns array<string>, asvs_controls array<string>, languages array<string>, "
    "file_patterns array<string>, note string"
)


@dataclass
class Rule:
    rule_id: str
    name: str = ""
    owasp: str = ""
    cwe: str = ""
    description: str = ""
    severity: str = "medium"
    confidence: str = "medium"
    finding_polarity: str = "violation"
    sources: list[str] = field(default_factory=list)
    sinks: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    sanitizers: list[str] = field(default_factory=list)
    required_guards: list[str] = field(default_factory=list)
    regex_patterns: list[str] = field(default_factory=list)
    asvs_controls: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    file_patterns: list[str] = field(default_factory=list)
    note: str = ""

    def all_patterns(self) -> list[str]:
        """The patterns for texts: the rule's own, and those that CALL(x), ASSIGNMENT(x) and LITERAL(x) stand for."""
        macros = {"CALL": r"{}\s*\(", "ASSIGNMENT": r"{}\s*=\s*", "LITERAL": r"['\"]{}['\"]"}
        made = [(m[1], m[2]) for p in self.patterns if (m := re.fullmatch(r"(CALL|ASSIGNMENT|LITERAL)\((.*)\)", p))]
        return [*self.regex_patterns, *[q for k, x in made if _compiles(q := macros[k].replace("{}", x))]]

    def checked(self) -> Rule:
        """The rule without patterns that don't compile or can run away (a quantified group with a quantifier inside)."""
        good = [p for p in self.regex_patterns if _compiles(p) and not re.search(r"\([^()]*[+*][^()]*\)[+*]", p)]
        return Rule(**{**asdict(self), "regex_patterns": good, "file_patterns": [p for p in self.file_patterns if _compiles(p)]})


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


class Catalog:
    """Rules by id."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules: dict[str, Rule] = {}
        for r in rules or []:
            self.register(r)

    def register(self, rule: Rule) -> None:
        self.rules[rule.rule_id] = rule.checked()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(getattr(r, f.name) for f in fields(Rule)) for r in self.rules.values()]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    @staticmethod
    def from_json(spark: SparkSession, path: str) -> Catalog:
        """A catalog file: one object of rules by id. Rules that can't be read are skipped."""
        text = spark.read.text(path, wholetext=True)
        entries = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("rule_id", "body"))
        rows = entries.select("rule_id", F.from_json("body", RULE_SCHEMA).alias("r")).where("r is not null").collect()
        out = []
        for row in rows:
            given = {k: v for k, v in row.r.asDict().items() if v is not None}
            out.append(Rule(**{**given, "rule_id": row.rule_id}))
        return Catalog(out)


def downgraded(severity: Column, confidence: Column, sanitized: Column, polarity: Column) -> tuple[Column, Column]:
    """Severity and confidence of a hit in a file that has a sanitizer somewhere; compliant rules keep theirs."""
    weak = sanitized & (polarity != "compliant")
    lower = F.when(weak & severity.isin("critical", "high"), F.lit("medium")).otherwise(severity)
    return lower, F.when(weak, F.lit("low")).otherwise(confidence)


def scan(files: DataFrame, catalog: Catalog, text: str, language: str | None = None, path: str | None = None) -> DataFrame:
    """files' columns but the text, with rule_id, pattern, hits, first_line, sink_label, severity, confidence: a row a hit.

    Each rule and pattern is an expression of its own with the pattern as a constant, so it is compiled once. Matches are
    counted first, in columns of their own, so a text without a match is read once for a pattern and its place and label
    are only looked for where there is one. The line is that of the first match's first sign, also if the match runs over several
    lines. The sink's label is the first of the rule's sinks in the match, else 80 signs of the match.
    """
    names = [c for c in files.columns if c != text]
    rules = [(r, p) for r in catalog.rules.values() for p in r.all_patterns()]
    if not rules:
        empty = "array<struct<rule_id:string,pattern:string,hits:bigint,first_line:bigint,sink_label:string,severity:string,confidence:string>>"
        return files.select(*names, F.inline(F.array().cast(empty)))

    def gate(r: Rule) -> Column:
        out = F.lit(True)
        if language and r.languages:
            lang = F.col(language)
            out = lang.isNull() | (lang == "") | lang.isin(r.languages)
        if path and r.file_patterns:
            out = out & reduce(Column.__or__, [F.regexp_like(F.col(path), F.lit(p)) for p in r.file_patterns])
        return out

    body, low = F.col(text), F.col("lower text")
    counted = [F.when(gate(r), F.regexp_count(body, F.lit(p))).otherwise(0).cast("long").alias(f"hits of {k}") for k, (r, p) in enumerate(rules)]
    wide = files.select("*", F.lower(text).alias("lower text"), *counted)
    found = []
    for k, (r, p) in enumerate(rules):
        hits = F.col(f"hits of {k}")
        sanitized = reduce(Column.__or__, [F.contains(low, F.lit(s.lower())) for s in r.sanitizers if s], F.lit(False))
        severity, confidence = downgraded(F.lit(r.severity), F.lit(r.confidence), sanitized, F.lit(r.finding_polarity))
        before = F.substring(body, F.lit(1), F.regexp_instr(body, F.lit(p)) - 1)
        line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        match = F.regexp_substr(body, F.lit(p))
        sink = [F.when(F.contains(F.lower(match), F.lit(s.lower())), F.lit(s)) for s in r.sinks if s]
        label = F.coalesce(*sink, F.nullif(F.substring(F.trim(match), 1, 80), F.lit("")), F.lit("regex"))
        row = F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(p).alias("pattern"),
            hits.alias("hits"),
            line.cast("long").alias("first_line"),
            label.alias("sink_label"),
            severity.alias("severity"),
            confidence.alias("confidence"),
        )
        found.append(F.when(hits > 0, row))
    return wide.select(*names, F.inline(F.array_compact(F.array(*found))))
