"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a text.  Before the cascade is built, every rule's cost and share of rejections are estimated on a random
sample of SAMPLE_ROWS rows or so from the whole table: it is evaluated REPEATS times on each row, and what a job takes
that evaluates no rule is taken off.  The rules are then tried in order of rejections per cost, and a row stops at the
first rule that rejects it.  The order decides only the work, never the verdict: a row is kept when no rule rejects it.
Where only rows to keep are asked for, the base rules are rules of the cascade like the others.

A null text is an empty one and, having no words, fails the base rules.  Texts of any length are handled as a whole:
every step is linear in the words but for one sort of the text's own word windows.  Repeated rows get equal results,
an empty table gives an empty table, and columns of the input other than the id and the text are not looked at.
Equality of word windows is that of their 64-bit hashes within one text.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import BLANK, let, read, written

#: Rows on which cost and selectivity are estimated; only the order of the rules depends on them.
SAMPLE_ROWS, REPEATS = 1000, 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK, F.lit(""))).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", F.lit(""))).cast("long")


def capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^A-Z]+", F.lit(""))).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more: sort the windows, keep those equal to a neighbour,
    and measure the union of their intervals."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")),
        )

    def twice(s: Column) -> Column:
        n = F.size(s)
        return F.filter(
            s,
            lambda x, k: F.when((k > 0) & (F.get(s, k - 1)["h"] == x["h"]), True).otherwise(F.when(k < n - 1, F.get(s, k + 1)["h"] == x["h"]).otherwise(False)),
        )

    def covered(p: Column) -> Column:
        n = F.size(p)
        return F.aggregate(
            F.transform(p, lambda x, k: F.when(k < n - 1, F.least(F.lit(3), F.get(p, k + 1) - x)).otherwise(3)),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    found = let(F.sort_array(windows(words)), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    return F.when(F.size(words) >= 3, let(found, covered)).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """A rule's name and what it rejects, given the text."""

    name: str
    rejects: object


#: The method's own rules.  They speak of whole texts and leave ordinary prose alone.
RULES = [
    Rule("symbols", lambda t: 10 * symbols(t) > F.size(words_of(t))),
    Rule("capitals", lambda t: 2 * capitals(t) > word_chars(t)),
    Rule("lines", lambda t: let(lines_of(t), lambda x: 2 * duplicate_lines(x) > F.size(x))),
    Rule("word_length", lambda t: let(F.size(words_of(t)), lambda n: (word_chars(t) < 2 * n) | (word_chars(t) > 15 * n))),
]

#: The base rules, for cascades that give no counts.
BASE_RULES = [
    Rule("few_words", lambda t: F.size(words_of(t)) < MIN_WORDS),
    Rule("repeats", lambda t: let(words_of(t), lambda w: 100 * repeated_words(w) > MAX_REPEAT_PERCENT * F.size(w))),
]


def estimate(df: DataFrame, rules: list[Rule], text: str = "text") -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) on a random sample of about SAMPLE_ROWS rows."""
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, df.count()))
    sample = written(df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(False, share, 7), "quality-sample")
    n = max(1, sample.count())
    again = sample.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(value: Column) -> tuple[float, float]:
        took, rejected = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            rejected = again.agg(F.avg(value.cast("double"))).first()[0] or 0.0
            took = min(took, time.perf_counter() - began)
        return took, rejected

    idle, _ = timed(F.length("t") < 0)
    found = []
    for rule in rules:
        took, rejected = timed(rule.rejects(F.col("t")))
        found.append((rule.name, max(took - idle, 1e-4) / (n * REPEATS), rejected))
    return found


def ordered(rules: list[Rule], estimates: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejections per cost, highest first; ties keep the given order."""
    worth = {name: share / max(seconds, 1e-12) for name, seconds, share in estimates}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(text: Column, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the text, or null; later rules are then not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text), F.lit(rule.name)).otherwise(verdict)
    return verdict


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.select(
        key, "text",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        word_chars(F.col("text")).alias("word_chars"),
        symbols(F.col("text")).alias("n_symbols"),
        let(lines_of(F.col("text")), duplicate_lines).alias("n_dup_lines"),
    )
    named = counted.select(key, "text", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    return named.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: the features, base_failed, the rule that rejected it (null if none) and kept."""
    rules = ordered(rules or RULES, estimate(df, rules or RULES, text))
    judged = features(df, key, text).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(F.col("text"), rules)))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("text")


def keep(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of df that no rule of the cascade rejects, the base rules among them, with their columns."""
    rules = [*(RULES if rules is None else rules), *BASE_RULES]
    return df.filter(cascade(F.coalesce(F.col(text), F.lit("")), ordered(rules, estimate(df, rules, text))).isNull())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS u FROM documents
), f AS (
  SELECT u, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT u, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT u, w, unnest(range(1, len(w) - 1)) AS i FROM f)
), c AS (
  SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, x) AS n FROM g) WHERE n > 1
), r AS (
  SELECT u, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2]) AS k) GROUP BY u
), m AS (
  SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS caps
  FROM f LEFT JOIN r ON f.u = r.u
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * caps > word_chars OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
