"""Histograms, their statistics, Otsu's threshold and equalisation.

Counts are partially aggregated before they are shuffled; everything after works on 256 rows an image at most.  Tables
that pixels are looked up in are written first, so that pixels are not shuffled where they are small enough to broadcast.

An empty table gives an empty one.  A null value is counted as a value of its own by `histogram`, belongs to no bin of the
dense one, and takes no part in statistics, thresholds and equalisation, which leave such pixels out.  A pixel that is
there twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.pixels import COLOR, gray, split_channels
from lumenframe.storage import small, written


def histogram(df: DataFrame) -> DataFrame:
    """(image_id, v, count) of the values that occur."""
    return gray(df).groupBy("image_id", "v").agg(F.count("*").alias("count"))


def histogram_dense(df: DataFrame) -> DataFrame:
    """(image_id, v, count) for v from 0 to 255."""
    found = histogram(df)
    bins = found.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return bins.join(found, ["image_id", "v"], "left").select("image_id", "v", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def channel_histograms(df: DataFrame) -> DataFrame:
    """(image_id, channel, v, count), all channels in one pass."""
    return split_channels(df).groupBy("image_id", "channel", "v").agg(F.count("*").alias("count"))


def statistics(df: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per image: mean and population deviation, median, mode, least, greatest and range of values, and the tallest bin.

    The median is the first value whose cumulated count reaches half the pixels, rounded down.  images: (image_id) of
    images that are to have a row even if they have no pixels; all of it is null then."""
    h = histogram(df).filter("v is not null")
    up = Window.partitionBy("image_id").orderBy("v")
    whole = Window.partitionBy("image_id")
    h = h.withColumn("cum", F.sum("count").over(up)).withColumn("n", F.sum("count").over(whole))
    # bins below the first that occurs reach half only where half is nothing
    reached = F.when(F.expr("n div 2") == 0, F.lit(0)).when(F.col("cum") >= F.expr("n div 2"), F.col("v"))
    s, q = F.sum(F.col("v") * F.col("count")), F.sum(F.col("v") * F.col("v") * F.col("count"))
    n = F.sum("count")
    found = h.groupBy("image_id").agg(
        (s / n).alias("mean"), F.sqrt((n * q - s * s) / (n * n)).alias("std"), F.min(reached).alias("median"),
        F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.max("v") - F.min("v")).alias("range"), F.max("count").alias("max_count"),
    )
    return found if images is None else images.select("image_id").distinct().join(found, "image_id", "left")


def otsu_threshold(df: DataFrame) -> DataFrame:
    """(image_id, threshold): the first value that separates the image best, 0 if none does."""
    up, whole = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")
    h = histogram(df).filter("v is not null")
    h = h.select(
        "image_id", "v", F.sum("count").over(up).alias("wb"), F.sum(F.col("v") * F.col("count")).over(up).alias("sb"),
        F.sum("count").over(whole).alias("n"), F.sum(F.col("v") * F.col("count")).over(whole).alias("s"),
    )
    split = h.withColumn("wf", F.col("n") - F.col("wb"))
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.when(F.col("wf") > 0, F.col("wf"))
    var = F.col("wb").cast("double") * F.col("wf").cast("double") * gap * gap
    best = split.withColumn("var", F.coalesce(var, F.lit(0.0))).groupBy("image_id").agg(F.min(F.struct(-F.col("var"), F.col("v"))).alias("s"))
    return best.select("image_id", F.when(F.col("s.col1") < 0, F.col("s.v")).otherwise(0).cast("int").alias("threshold"))


def otsu_binarize(df: DataFrame) -> DataFrame:
    px = gray(df)
    return px.filter("v is not null").join(small(written(otsu_threshold(px), "otsu")), "image_id").select("image_id", "y", "x", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def _remap(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v and its equalised value."""
    up, whole = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    h = counts.withColumn("cdf", F.sum("count").over(up)).withColumn("n", F.sum("count").over(whole))
    h = h.withColumn("low", F.min("cdf").over(whole))
    scaled = F.round((F.col("cdf") - F.col("low")) / F.when(F.col("n") > F.col("low"), F.col("n") - F.col("low")) * 255).cast("int")
    return h.select(*keys, "v", F.coalesce(scaled, F.lit(0)).alias("e"))


def equalize(df: DataFrame) -> DataFrame:
    """Histogram equalisation of a gray image; an image of one value becomes 0."""
    px = gray(df)
    maps = _remap(histogram(px).filter("v is not null"), ["image_id"]).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "e"))).alias("__e"))
    maps = small(written(maps, "equalized"), 2000)
    return px.filter("v is not null").join(maps, "image_id").withColumn("e", F.element_at("__e", F.col("v"))).select("image_id", "y", "x", F.col("e").alias("v"))


def equalize_color(df: DataFrame) -> DataFrame:
    """Blue, green and red equalised each by itself; alpha becomes 255."""
    table = _remap(channel_histograms(df).filter("channel <> 'A' and v is not null"), ["image_id", "channel"])
    maps = table.groupBy("image_id").pivot("channel", ["B", "G", "R"]).agg(F.map_from_entries(F.collect_list(F.struct("v", "e"))))
    maps = small(written(maps.select("image_id", *[F.col(c.upper()).alias(f"__{c}") for c in COLOR]), "equalized"), 2000)
    looked = df.join(maps, "image_id")
    return looked.select("image_id", "y", "x", *[F.element_at(f"__{c}", F.col(c)).alias(c) for c in COLOR], F.lit(255).alias("a"))
