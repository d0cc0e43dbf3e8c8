"""Pixel tables: layout, channels, cropping, padding, scaling, and images as binary rows.

A gray image is rows (image_id, y, x, v), a colour image rows (image_id, y, x, b, g, r, a); values are 0 to 255.

Empty tables give empty ones.  Operators that move or recolour pixels do so row by row: a null value stays null, and a
pixel that is there twice is there twice in the result.  Blocks and binary rows take a null value for none and for 0,
and of a pixel that is there twice both (blocks) or one (binary rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAY, COLOR = ("v",), ("b", "g", "r")


def is_color(df: DataFrame) -> bool:
    return "b" in df.columns


def channels(df: DataFrame) -> tuple[str, ...]:
    return COLOR if is_color(df) else GRAY


def solid(df: DataFrame) -> DataFrame:
    """df with 0 for null values."""
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in channels(df)})


def clamp(value: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), value)).cast("int")


def truncated(value: Column) -> Column:
    """A filter result as a pixel: rounding noise removed, clamped to 0..255, cut to an integer."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(value, 6))).cast("int")


def colocated(df: DataFrame, parts: int | None = None) -> DataFrame:
    """All pixels of an image in one partition: for tables of many small images, one shuffle then serves every filter."""
    return df.repartition(parts, "image_id") if parts else df.repartition("image_id")


def rows_of() -> Window:
    return Window.partitionBy("image_id", "y").orderBy("x")


def columns_of() -> Window:
    return Window.partitionBy("image_id", "x").orderBy("y")


def extent(df: DataFrame) -> DataFrame:
    """(image_id, w, h)."""
    return df.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def gray(df: DataFrame) -> DataFrame:
    """Colour to gray by the BT.601 weights, in integers; a gray image is left as it is."""
    if not is_color(df):
        return df
    return df.select("image_id", "y", "x", F.expr("cast((299 * r + 587 * g + 114 * b) div 1000 as int)").alias("v"))


def split_channels(df: DataFrame) -> DataFrame:
    """(image_id, y, x, channel, v), a row for each channel."""
    return df.selectExpr("image_id", "y", "x", "stack(4, 'B', b, 'G', g, 'R', r, 'A', a) as (channel, v)")


def merge_channels(df: DataFrame) -> DataFrame:
    """Planes (channel, v) to a colour image; alpha becomes 255."""
    pick = [F.max(F.when(F.col("channel") == c.upper(), F.col("v"))).alias(c) for c in COLOR]
    return df.groupBy("image_id", "y", "x").agg(*pick).withColumn("a", F.lit(255))


def crop(df: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """The pixels of a rectangle, moved to the origin; edges are rounded down."""
    x0, y0, w, h = (int(np.floor(k)) for k in (x, y, width, height))
    inside = F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1)
    return df.filter(inside).withColumn("x", (F.col("x") - x0).cast("int")).withColumn("y", (F.col("y") - y0).cast("int"))


def pad(df: DataFrame, p: int) -> DataFrame:
    """p more pixels on each side, copies of the nearest edge pixel; border pixels multiply, others only move."""
    at = df.withColumn("w", F.max("x").over(Window.partitionBy("image_id", "y"))).withColumn("h", F.max("y").over(Window.partitionBy("image_id", "x")))

    def places(c: str, last: str) -> Column:
        low = F.when(F.col(c) == 0, 0).otherwise(F.col(c) + p)
        high = F.when(F.col(c) == F.col(last), F.col(c) + 2 * p).otherwise(F.col(c) + p)
        return F.explode(F.sequence(low, high))

    wide = at.withColumn("x2", places("x", "w"))
    return wide.withColumn("y2", places("y", "h")).select("image_id", F.col("y2").cast("int").alias("y"), F.col("x2").cast("int").alias("x"), *[c for c in ("v", "b", "g", "r", "a") if c in df.columns])


def unpad(df: DataFrame, p: int) -> DataFrame:
    size = extent(df)
    inside = F.col("x").between(p, F.col("w") - 1 - p) & F.col("y").between(p, F.col("h") - 1 - p)
    return df.join(size, "image_id").filter(inside).withColumn("x", F.col("x") - p).withColumn("y", F.col("y") - p).drop("w", "h")


def _power(n: Column) -> Column:
    """The least power of two that is n or more, for n up to 2**30."""
    out = F.lit(1 << 30)
    for k in range(29, -1, -1):
        out = F.when(n <= (1 << k), F.lit(1 << k)).otherwise(out)
    return out


def pad_power(df: DataFrame) -> DataFrame:
    """A gray image in the middle of a black one whose sides are powers of two."""
    size = extent(df).select("image_id", _power(F.col("w")).alias("pw"), _power(F.col("h")).alias("ph"), "w", "h")
    shifted = df.join(size, "image_id").select(
        "image_id", (F.col("y") + F.floor((F.col("ph") - F.col("h")) / 2)).cast("int").alias("y"), (F.col("x") + F.floor((F.col("pw") - F.col("w")) / 2)).cast("int").alias("x"), "v"
    )
    rows = size.select("image_id", F.explode(F.sequence(F.lit(0), F.col("ph") - 1)).alias("y"), "pw")
    grid = rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("pw") - 1)).alias("x"))
    return grid.join(shifted, ["image_id", "y", "x"], "left").select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce("v", F.lit(0)).alias("v"))


def unpad_power(df: DataFrame, size: DataFrame) -> DataFrame:
    """The middle part of size (image_id, w, h) again."""
    whole = extent(df).select("image_id", F.col("w").alias("pw"), F.col("h").alias("ph"))
    at = df.join(whole, "image_id").join(size, "image_id")
    at = at.withColumn("y", (F.col("y") - F.floor((F.col("ph") - F.col("h")) / 2)).cast("int")).withColumn("x", (F.col("x") - F.floor((F.col("pw") - F.col("w")) / 2)).cast("int"))
    return at.filter("x between 0 and w - 1 and y between 0 and h - 1").drop("pw", "ph", "w", "h")


def downscale(df: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor blocks, in integers."""
    block = [F.expr(f"cast({c} div {int(factor)} as int)").alias(c) for c in ("y", "x")]
    return df.groupBy("image_id", *block).agg(*[F.expr(f"cast(sum({c}) div count(*) as int)").alias(c) for c in ("v", "b", "g", "r", "a") if c in df.columns])


def draw_box(df: DataFrame, match: DataFrame, width: int, height: int) -> DataFrame:
    """A gray or colour image as colour, with a red two-pixel outline and a faint red filling over each match (best_y, best_x)."""
    base = df if is_color(df) else df.select("image_id", "y", "x", *[F.col("v").alias(c) for c in COLOR], F.lit(255).alias("a"))
    at = base.join(match.select("image_id", "best_y", "best_x"), "image_id", "left")
    dx, dy = F.col("x") - F.col("best_x"), F.col("y") - F.col("best_y")
    inside = dx.between(0, width - 1) & dy.between(0, height - 1)
    line = inside & ((dx < 2) | (dy < 2) | (dx >= width - 2) | (dy >= height - 2))

    def blend(c: str, red: int) -> Column:
        mixed = F.expr(f"cast(({c} * 191 + {red} * 64) div 255 as int)")
        return F.when(line, F.lit(red)).when(inside, mixed).otherwise(F.col(c)).cast("int").alias(c)

    return at.select("image_id", "y", "x", blend("b", 0), blend("g", 0), blend("r", 255), F.lit(255).alias("a"))


def from_blobs(images: DataFrame) -> DataFrame:
    """(image_id, y, x, b, g, r, a) of rows (image_id, height, width, n_channels, data); gray bytes give equal b, g and r."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels).astype(np.int32)
                if r.n_channels == 1:
                    px = np.repeat(px, 3, axis=2)
                if px.shape[2] == 3:
                    px = np.concatenate([px, np.full((r.height, r.width, 1), 255, np.int32)], axis=2)
                step = max(1, 500_000 // max(1, r.width))
                for y in range(0, r.height, step):
                    part = px[y : y + step]
                    ys, xs = np.mgrid[y : y + len(part), 0 : r.width]
                    yield pd.DataFrame({"image_id": r.image_id, "y": ys.ravel(), "x": xs.ravel(), **{c: part[..., i].ravel() for i, c in enumerate("bgra")}})

    columns = images.select("image_id", "height", "width", "n_channels", "data").filter("height > 0 and width > 0")
    return columns.mapInPandas(run, "image_id long, y int, x int, b int, g int, r int, a int")


def to_blobs(df: DataFrame) -> DataFrame:
    """(image_id, height, width, n_channels, data): each image's bytes, row by row, in the order b, g, r, a."""
    names = ("b", "g", "r", "a") if is_color(df) else ("v",)
    count = len(names)

    def run(px: pd.DataFrame) -> pd.DataFrame:
        h, w = int(px["y"].max()) + 1, int(px["x"].max()) + 1
        out = np.zeros((h, w, count), np.uint8)
        for i, c in enumerate(names):
            out[px["y"], px["x"], i] = px[c].fillna(0)
        return pd.DataFrame({"image_id": [px["image_id"].iloc[0]], "height": [h], "width": [w], "n_channels": [count], "data": [out.tobytes()]})

    return df.groupBy("image_id").applyInPandas(run, "image_id long, height int, width int, n_channels int, data binary")
