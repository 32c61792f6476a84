"""What a model answers, as JSON; and how times and chapters are written and put in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload(text: Column) -> Column:
    """From the first brace to the last one behind an opening fence, which need not be closed; null if there is none."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def answer(text: Column, schema: str) -> Column:
    """The payload as a struct: commas before a closing bracket and line ends within strings are let pass; null if it is no JSON."""
    tidy = F.regexp_replace(payload(text), r",\s*([}\]])", "$1")
    found = F.from_json(tidy, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "allowUnquotedControlChars": "true"})
    return F.when(found["__bad"].isNull(), found.dropFields("__bad"))


def iso(at: Column) -> Column:
    """A time as text, with the zone's sign for UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def chapter_number(chapter: Column) -> Column:
    """The number of a chapter's id, to sort by; ids without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(chapter, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(2**31 - 1))
