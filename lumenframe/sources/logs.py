"""Operation history and log lines as tables, and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The forms of history and log lines.
HISTORY = r"\[(.*?)\] (.*?) \((\d+\.\d{2}) ms\)"
LOG = r"\[(.*?)\] \[(.*?)\] (.*)"


def parse_history(lines: DataFrame, line: str = "line") -> DataFrame:
    """(time, operation, elapsed); a line of another form is an operation of its own."""
    t, fits = F.col(line), F.col(line).rlike(HISTORY)
    part = lambda i, other: F.when(fits, F.regexp_extract(t, HISTORY, i)).otherwise(other)
    return lines.select(part(1, F.lit("")).alias("time"), part(2, t).alias("operation"), part(3, F.lit("")).alias("elapsed"))


def parse_log(text: DataFrame, column: str = "line") -> DataFrame:
    """(time, level, message) of each line that is not blank; a line of another form is a message of its own."""
    lines = text.select(F.explode(F.split(column, "\n")).alias("t")).select(F.trim(F.regexp_replace("t", "\r", "")).alias("t")).filter("t <> ''")
    t, fits = F.col("t"), F.col("t").rlike(LOG)
    part = lambda i, other: F.when(fits, F.regexp_extract(t, LOG, i)).otherwise(other)
    return lines.select(part(1, F.lit("")).alias("time"), part(2, F.lit("")).alias("level"), part(3, t).alias("message"))


def export_csv(rows: DataFrame, path: str) -> None:
    """UTF-8 with a header; quotes are doubled, so any text reads back as it was."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"').csv(path)
