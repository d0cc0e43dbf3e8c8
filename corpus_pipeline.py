"""Corpus cleaning: quality rules, line dedup, near-duplicates, decontamination, and byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`n_chars` follows the text where a stage changes it.  An empty table gives an empty one in every stage.  Nulls in other
columns than id and text are kept as they are, and columns beyond those of documents are kept too, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontaminate, linededup, neardup, quality
from lumenframe.llm.common import fresh_name, read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a rule of the cascade go.

    Null and empty texts go, having no words; a null id is kept; repeated rows have one fate."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines one occurrence stays; documents stay, with fewer lines.

    Null and empty texts stay as they are.  Of like lines that with the smallest (id, text hash, line number) stays, a
    null id after all others; rows equal in id and text count as one document and get the same text."""
    found = linededup.dedup(docs, counts=fresh_name(docs, "line_counts"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, a null id after all others.

    Null and empty texts are one group, and of repeated rows one stays."""
    return neardup.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that a benchmark's windows make up a twentieth of, or more.

    Null and empty texts stay, having no words; repeated rows have one fate."""
    out = fresh_name(docs, "found")
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), out=out)
    return found.filter(~decontaminate.contaminated(decontaminate.hit_words(F.col(out)), F.col(f"{out}.n_words"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): the ids of each text, and whether they decode to it.

    A null text is an empty one, without ids; repeated rows are all encoded."""
    out = fresh_name(docs, "bpe")
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), out=out)
    return found.select("doc_id", "lang", "source", F.size(f"{out}.ids").cast("long").alias("n_tokens"), F.col(f"{out}.ids").alias("ids"), F.col(f"{out}.exact").alias("exact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The fingerprints, links and ids of these stages are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each written before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
