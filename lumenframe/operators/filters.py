"""Neighbourhood operators: convolution, blurs, edges and morphology.

A neighbour outside the image is the nearest pixel inside.  Every operator takes two window passes, along rows and
along columns, whatever the kernel: no pixel is multiplied by its neighbours.  Disks are sets of row runs, one for
each dy.  Sums of integers stay integers; sums of doubles are rounded to six places before they are cut.

Empty tables give empty ones, and null values count as 0.  An image has one row for each place: rows that repeat a place
are taken for neighbours of each other in their row and column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.pixels import channels, columns_of, gray, rows_of, solid, truncated


def odd(size: int) -> int:
    return size if size % 2 else size + 1


def square(size: int) -> dict[int, int]:
    """Half widths of the rows of a square kernel."""
    c = odd(size) // 2
    return dict.fromkeys(range(-c, c + 1), c)


def disk(size: int) -> dict[int, int]:
    c = odd(size) // 2
    return {dy: math.isqrt(c * c - dy * dy) for dy in range(-c, c + 1)}


def _carried(df: DataFrame, names: tuple[str, ...], made: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, *made)


def _shifted(value: Column, by: int, w) -> Column:
    """value at an offset along w, the edge's beyond the edge."""
    if by == 0:
        return value
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(value, by).over(w), F.last(value).over(whole)) if by > 0 else F.coalesce(F.lag(value, -by).over(w), F.first(value).over(whole))


def convolve(df: DataFrame, kernel: dict[tuple[int, int], float], divide: bool = True) -> DataFrame:
    """Weighted sums of neighbours, divided by the weights' sum if that is neither 0 nor 1; kernel: (dy, dx) to weight."""
    df, names, total = solid(df), channels(df), sum(kernel.values())
    kernel = {k: w for k, w in sorted(kernel.items()) if w}
    dxs, dys = sorted({dx for _, dx in kernel}), sorted({dy for dy, _ in kernel})
    name = "__{}_{}_{}".format
    across = _carried(df, (), [_shifted(F.col(c), dx, rows_of()).alias(name(c, "h", dx)) for c in names for dx in dxs])

    def line(c: str, dy: int) -> Column:
        out = None
        for dx in dxs:
            if (dy, dx) in kernel:
                term = F.col(name(c, "h", dx)) * F.lit(float(kernel[dy, dx]))
                out = term if out is None else out + term
        return out

    lines = across.select(*df.columns, *[line(c, dy).alias(name(c, "l", dy)) for c in names for dy in dys])
    summed = lines.select(*df.columns, *[_shifted(F.col(name(c, "l", dy)), dy, columns_of()).alias(name(c, "d", dy)) for c in names for dy in dys])
    scale = total if divide and abs(total) > 1e-12 and abs(total - 1) > 1e-12 else 1.0

    def value(c: str) -> Column:
        out = F.col(name(c, "d", dys[0]))
        for dy in dys[1:]:
            out = out + F.col(name(c, "d", dy))
        return truncated(out / F.lit(float(scale))).alias(c)

    return summed.select(*[value(c) if c in names else F.col(c) for c in df.columns])


def _box(df: DataFrame, shape: dict[int, int], finish) -> DataFrame:
    """Integer sums over a shape of row runs; finish(sum, value) gives the pixel."""
    df, names, widths = solid(df), channels(df), sorted(set(shape.values()))
    name = "__{}_{}".format
    w = rows_of()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def run(c: str, k: int) -> Column:
        inside = F.sum(F.col(c).cast("long")).over(w.rowsBetween(-k, k))
        left = F.greatest(F.lit(0), F.lit(k) - F.col("x")) * F.first(c).over(whole)
        right = F.greatest(F.lit(0), F.lit(k) - (F.max("x").over(whole) - F.col("x"))) * F.last(c).over(whole)
        return (inside + left + right).alias(name(c, k))

    across = _carried(df, (), [run(c, k) for c in names for k in widths])
    parts = {c: [_shifted(F.col(name(c, shape[dy])), dy, columns_of()) for dy in sorted(shape)] for c in names}

    def value(c: str) -> Column:
        out = parts[c][0]
        for p in parts[c][1:]:
            out = out + p
        return out.alias(name(c, "sum"))

    summed = across.select(*df.columns, *[value(c) for c in names])
    return summed.select(*[finish(F.col(name(c, "sum")), F.col(c)).cast("int").alias(c) if c in names else F.col(c) for c in df.columns])


def average_blur(df: DataFrame, size: int = 3, circular: bool = False) -> DataFrame:
    shape = disk(size) if circular else square(size)
    count = sum(2 * k + 1 for k in shape.values())
    return _box(df, shape, lambda total, _: F.floor(total / count))


def laplacian(df: DataFrame, size: int = 3) -> DataFrame:
    """Sum of the neighbourhood less its count times the middle, on gray."""
    count = odd(size) ** 2
    return _box(gray(df), square(size), lambda total, v: F.least(F.lit(255), F.greatest(F.lit(0), total - count * v)))


def gaussian_kernel(sigma: float, size: int, circular: bool = False) -> dict[tuple[int, int], float]:
    if size % 2 == 0:
        raise ValueError("a Gaussian kernel has an odd size")
    c = size // 2
    raw = {(dy, dx): math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma) for dy in range(-c, c + 1) for dx in range(-c, c + 1) if not circular or dy * dy + dx * dx <= c * c}
    total = sum(raw.values())
    return {k: w / total for k, w in raw.items()}


def gaussian_blur(df: DataFrame, sigma: float = 1.0, size: int = 3, circular: bool = False) -> DataFrame:
    return convolve(df, gaussian_kernel(sigma, size, circular), divide=False)


def sobel_weights(size: int) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], float]]:
    """Gradient weights dx / r^2 and dy / r^2."""
    c = odd(size) // 2
    at = [(dy, dx) for dy in range(-c, c + 1) for dx in range(-c, c + 1) if dy or dx]
    return {k: k[1] / (k[0] ** 2 + k[1] ** 2) for k in at if k[1]}, {k: k[0] / (k[0] ** 2 + k[1] ** 2) for k in at if k[0]}


def sobel(df: DataFrame, size: int = 3) -> DataFrame:
    """Length of the gradient, on gray."""
    df, c = solid(gray(df)), odd(size) // 2
    gx, gy = sobel_weights(size)
    span = range(-c, c + 1)
    across = df.select("*", *[_shifted(F.col("v"), dx, rows_of()).alias(f"__h_{dx}") for dx in span])

    def line(kernel: dict, dy: int) -> Column:
        out = F.lit(0.0)
        for dx in span:
            if (dy, dx) in kernel:
                out = out + F.col(f"__h_{dx}") * F.lit(kernel[dy, dx])
        return out

    lines = across.select(*df.columns, *[F.struct(line(gx, dy).alias("x"), line(gy, dy).alias("y")).alias(f"__l_{dy}") for dy in span])
    placed = lines.select(*df.columns, *[_shifted(F.col(f"__l_{dy}"), dy, columns_of()).alias(f"__d_{dy}") for dy in span])
    sums = [sum((F.col(f"__d_{dy}.{k}") for dy in span), F.lit(0.0)) for k in ("x", "y")]
    return placed.withColumn("v", truncated(F.sqrt(sums[0] * sums[0] + sums[1] * sums[1]))).select(*df.columns)


def differential(df: DataFrame) -> DataFrame:
    """Differences to the right and lower neighbours, on gray; the last row and column are 0."""
    df = solid(gray(df))
    near = df.withColumn("__r", F.lead("v").over(rows_of())).withColumn("__d", F.lead("v").over(columns_of()))
    total = F.abs(F.col("__r") - F.col("v")) + F.abs(F.col("__d") - F.col("v"))
    edge = F.col("__r").isNull() | F.col("__d").isNull()
    return near.withColumn("v", F.when(edge, 0).otherwise(F.least(F.lit(255), total)).cast("int")).drop("__r", "__d")


def _extreme(df: DataFrame, shape: dict[int, int], pick, among) -> DataFrame:
    """Greatest or least values over a shape; neighbours outside need no care, as the nearest inside is in the shape."""
    df, names, widths = solid(df), channels(df), sorted(set(shape.values()))
    name = "__{}_{}".format
    across = df.select("*", *[pick(c).over(rows_of().rowsBetween(-k, k)).alias(name(c, k)) for c in names for k in widths])
    if len(widths) == 1:
        reach = max(shape)
        made = {c: pick(name(c, widths[0])).over(columns_of().rowsBetween(-reach, reach)) for c in names}
    else:
        made = {c: among(*[F.col(name(c, shape[dy])) if dy == 0 else F.lead(name(c, shape[dy]), dy).over(columns_of()) if dy > 0 else F.lag(name(c, shape[dy]), -dy).over(columns_of()) for dy in sorted(shape)]) for c in names}
    return across.select(*[made[c].alias(c) if c in names else F.col(c) for c in df.columns])


def dilate(df: DataFrame, size: int = 3, circular: bool = False) -> DataFrame:
    return _extreme(df, disk(size) if circular else square(size), F.max, F.greatest)


def erode(df: DataFrame, size: int = 3, circular: bool = False) -> DataFrame:
    return _extreme(df, disk(size) if circular else square(size), F.min, F.least)


def opening(df: DataFrame, size: int = 3, circular: bool = False) -> DataFrame:
    return dilate(erode(df, size, circular), size, circular)


def closing(df: DataFrame, size: int = 3, circular: bool = False) -> DataFrame:
    return erode(dilate(df, size, circular), size, circular)
