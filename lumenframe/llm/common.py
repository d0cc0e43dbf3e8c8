"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.storage import fresh_path, shared_dir, small, written

__all__ = ["BLANK", "WORD", "fresh_name", "fresh_path", "let", "read", "shared_dir", "small", "written"]

#: Java form of the word class [^\x20\x09-\x0D]+ and of its complement.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever body does with it."""
    return F.transform(F.array(value), body)[0]
