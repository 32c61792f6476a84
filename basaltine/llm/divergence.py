"""Source divergence audit: how far the word use of each source of a language is from the others, by inclusion-exclusion over supports.

A term of a source with count c among N occurrences of the V kept terms has p = 1 + floor(scale * (c + pseudo) /
(N + pseudo * V)). The distance of two sources is the sum of |p - q| over all kept terms, but no source is ever laid out
over all of them:

* terms that one source lacks have the one value q0 there, so all terms of the other with the same count cost the same:
  a histogram of each source's counts prices its whole support against any other source's q0;
* terms that both have were priced twice so, and wrongly: a join of the postings of the terms (who has it, how often)
  corrects each such pair of counts;
* terms that both lack cost |p0 - q0| each, a constant times V less the two supports (plus the overlap, which the
  correction gives back).

Counting is combined on the map side in bounded tables, whole texts in pieces, so a source with a third of all rows is
no larger than its vocabulary by the time of the shuffle. Sums over (language, term) and (language, source) follow from
the counted rows. Postings are joined by (language, term), each with one row for a source at most. All numbers are
integers; products are decimals of 38 digits, so they are exact.

Null text, language and source are empty ones. A group without terms takes part with N = 0; a language without kept
terms has distances of 0 and no term rows. Ties go by the item's UTF-8 bytes. Repeated rows count as documents of their
own. An empty table gives an empty result. Further columns have no part in it, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltine.llm.common import written

#: Terms are what [^\x00-\x40\x5B-\x60\x7B-\x7F]+ matches, with A-Z lower-cased: letters and all signs beyond ASCII.
_BORDERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are cut into terms at a time, and counts that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 200_000

COUNTS = "lang string, source string, term string, n long, docs long"


def pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end at a border."""
    plain = raw.translate(_BORDERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _rows(groups: dict, sizes: Counter) -> Iterator[pa.RecordBatch]:
    """What a task has counted: a row for each group and term, and one without term for each group."""
    for (lang, source), docs in sizes.items():
        n, held = groups.get((lang, source), (Counter(), Counter()))
        terms = list(n)
        columns = [
            pa.array([lang] * (len(terms) + 1), pa.string()),
            pa.array([source] * (len(terms) + 1), pa.string()),
            pa.array([*terms, None], pa.binary()).view(pa.string()),
            pa.array([*n.values(), 0], pa.int64()),
            pa.array([*map(held.__getitem__, terms), docs], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups, sizes, held = defaultdict(lambda: (Counter(), Counter())), Counter(), 0
    for rows in batches:
        for k, (lang, source) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())):
            n, docs = groups[lang, source]
            before, own = len(n), set()
            for words in pieces(rows.column(0)[k].as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
            sizes[lang, source] += 1
            held += len(n) - before + (sizes[lang, source] == 1)
            if held > HELD:
                yield from _rows(groups, sizes)
                groups.clear(), sizes.clear()
                held = 0
    yield from _rows(groups, sizes)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; term is null for the group itself."""
    plain = [F.coalesce(docs[c].cast("string"), F.lit("")) for c in (text, lang, source)]
    rows = docs.select(plain[0].cast("binary").alias("text"), plain[1].alias("lang"), plain[2].alias("source"))
    counted = rows.mapInArrow(_count, COUNTS)
    # dealt by language and term, so that what is grouped and joined by these next need not move
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, v: Column, pseudo: int, scale: int) -> Column:
    """1 + floor(scale * (n + pseudo) / (total + pseudo * v)), exactly; 1 where nothing is kept."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(scale).cast("decimal(18,0)") * wide(n + pseudo)
    below = wide(total + F.lit(pseudo) * v)
    return F.lit(1) + F.coalesce(F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(19,0)"))), F.lit(0))


class Audit:
    """Counts of a corpus and what is derived from them: `pairs` and `terms`."""

    def __init__(self, docs: DataFrame, text="text", lang="lang", source="source", min_docs: int = 30, pseudo: int = 5, scale: int = 10**9):
        self.pseudo, self.scale = pseudo, scale
        counts = written(term_counts(docs, text, lang, source), "term-counts")
        kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere"))
        kept = kept.where(F.col("docs") >= min_docs).drop("docs")
        #: (lang, term, everywhere, source, n): the postings of the kept terms.
        self.postings = written(kept.join(counts.select("lang", "source", "term", "n"), ["lang", "term"]), "term-postings")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("everywhere").alias("all_n"))
        own = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
        groups = counts.where(F.col("term").isNull()).select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left")
        #: (lang, source, v, all_n, total, support, p0): a row for each group, also without terms.
        self.groups = written(
            groups.na.fill(0, ["v", "all_n", "total", "support"]).withColumn("p0", self.share(F.lit(0), F.col("total"), F.col("v"))), "audit-groups"
        )

    def share(self, n: Column, total: Column, v: Column) -> Column:
        return _share(n, total, v, self.pseudo, self.scale)

    def _priced(self) -> DataFrame:
        """The postings with p and p0 of their group and p of the whole language as q."""
        found = self.postings.join(self.groups, ["lang", "source"])
        p, q = self.share(F.col("n"), F.col("total"), F.col("v")), self.share(F.col("everywhere"), F.col("all_n"), F.col("v"))
        return found.select("lang", "source", "term", "n", "p0", p.alias("p"), q.alias("q"))

    def pairs(self) -> DataFrame:
        """(lang, source, other, value) for both orders of every two sources of a language."""
        others = self.groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("support").alias("others"))
        met = self.groups.join(others, "lang").where(F.col("source") != F.col("other"))
        neither = met.select("lang", "source", "other", (F.abs(F.col("p0") - F.col("q0")) * (F.col("v") - F.col("support") - F.col("others"))).alias("value"))

        histogram = self._priced().groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
        against = histogram.join(others, "lang").where(F.col("source") != F.col("other"))
        one_sided = against.groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("q0"))).alias("value"))

        a = self._priced().select("lang", "term", "source", "p", "p0")
        b = a.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
        gap = lambda x, y: F.abs(F.col(x) - F.col(y))
        correction = gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")
        both = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("other")).groupBy("lang", "source", "other").agg(F.sum(correction).alias("value"))

        turned = lambda df: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
        parts = neither.unionByName(one_sided).unionByName(turned(one_sided)).unionByName(both).unionByName(turned(both))
        return parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """(lang, source, term, value): the kept terms that a group uses more than its language, and by how much."""
        return self._priced().where(F.col("p") > F.col("q")).select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50, pseudo: int = 5, scale: int = 10**9) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks a source's distances to all others, part `term` its top terms."""
    audit = Audit(docs, text, lang, source, min_docs, pseudo, scale)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(order))
    terms = audit.terms().withColumnRenamed("term", "item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
