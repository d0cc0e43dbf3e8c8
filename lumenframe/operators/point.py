"""Operators on single pixels: projections that Catalyst fuses with what stands around them.

An empty table gives an empty one, a null value becomes 0, and a pixel that is there twice is there twice in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.pixels import channels, clamp


def brightness(df: DataFrame, value: int) -> DataFrame:
    for c in channels(df):
        df = df.withColumn(c, clamp(F.col(c) + value))
    return df


def binarize(df: DataFrame, threshold: int = 128) -> DataFrame:
    """Above the threshold 255, else 0; a threshold of -1 is each image's own, by Otsu's method."""
    if threshold == -1:
        from lumenframe.operators.histogram import otsu_binarize

        return otsu_binarize(df)
    for c in channels(df):
        df = df.withColumn(c, F.when(F.col(c) > threshold, 255).otherwise(0))
    return df
