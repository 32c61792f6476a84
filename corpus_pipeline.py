"""A training-data pipeline over documents: classify, drop shared lines, near-dedup, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and gives a table; all but the last give the columns of documents. Rows with
nulls, empty or repeated texts pass as the operators define it: documents without words stay until the last stage,
where they have no tokens. Very long texts are read whole in every stage. Ties are decided by the operators: equal keys
of the draw stay together, a line in exactly ten documents goes, the smallest id of a group stays, a similarity of exactly
0.75 is a hit. Columns of the input beyond those of documents are passed on by the first four stages, whatever their
names (the line stage takes n_lines and n_dropped for its own). An empty table gives an empty result.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.llm.bpe import encode_decode
from basaltine.llm.common import written
from basaltine.llm.decontaminate import decontaminated
from basaltine.llm.importance import resample
from basaltine.llm.line_dedup import dedup_lines
from basaltine.llm.minhash import deduplicated
from basaltine.session import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier draws; those without words have a ratio of 1 and stay or go with the draw, repeated rows together."""
    return resample(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less the lines found in ten or more of them; n_chars is counted anew. Null texts become empty ones."""
    out = dedup_lines(docs, min_docs=10, min_chars=1).drop("n_lines", "n_dropped")
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.char_length("text").cast(kind)) if kind else out


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; those without words all stay, so do repeated rows of the one."""
    return deduplicated(docs, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, verbatim or nearly; items without words are in none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, their number, and what they decode to; none for null and empty texts."""
    path = os.environ.get("BASALTINE_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(docs, path, outputs=("n_tokens", "ids", "decoded"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: No SQL: hashed models, seeded draws and tokenisation are beyond it. tests/llm holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
