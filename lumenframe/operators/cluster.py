"""k-means segmentation by colour, or by colour and place.

Points are written once and the centroids after each step, k rows an image, so a plan is as long at the hundredth step
as at the first.  A step joins the centroids of an image as one array (broadcast if there are few images, checked),
assigns each pixel by an expression and adds up sums partially; it is exact for integer colours, and nothing is
collected.  Seeds are given, or drawn by a seeded hash: for colours one after another, with a probability in proportion
to the squared distance from the nearest drawn before, and for colour and place uniformly.

An empty table gives an empty one.  Pixels with a null colour belong to no cluster and are left out.  A pixel that is
there twice counts twice.  An image of fewer than k different colours gets fewer clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.pixels import is_color
from lumenframe.storage import has_at_most, written

DIMS = ("f0", "f1", "f2", "f3", "f4")
#: Rows of centroids up to which they are broadcast.
BROADCAST_ROWS = 200_000


def points(df: DataFrame, location: bool) -> DataFrame:
    """Pixels with their coordinates in colour space, or scaled colour and place."""
    if not is_color(df):
        df = df.select("image_id", "y", "x", *[F.col("v").alias(c) for c in "bgr"], F.lit(255).alias("a"))
    df = df.filter(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull())
    if not location:
        return df.select("*", *[F.col(c).cast("double").alias(d) for c, d in zip("rgb", DIMS, strict=False)])
    whole = df.groupBy("image_id").agg(F.greatest(F.lit(1), F.max("x")).alias("__w"), F.greatest(F.lit(1), F.max("y")).alias("__h"))
    at = df.join(whole, "image_id")
    scaled = [(F.col(c) / F.lit(255.0)).alias(d) for c, d in zip("rgb", DIMS, strict=False)]
    return at.select(*df.columns, *scaled, (F.col("x") / F.col("__w")).alias("f3"), (F.col("y") / F.col("__h")).alias("f4"))


def _dims(location: bool) -> tuple[str, ...]:
    return DIMS if location else DIMS[:3]


def first_pixels(px: DataFrame, k: int, location: bool) -> DataFrame:
    """Seeds: the first k pixels of each image in row order."""
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x"))
    low = px.filter(F.col("y") < k)  # an image of k rows or more has its first k pixels there, and a lower one is there whole
    return low.withColumn("cid", n - 1).filter(F.col("cid") < k).select("image_id", "cid", *_dims(location))


def _drawn_hash(seed: int, draw: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(draw), "y", "x")


def drawn_pixels(px: DataFrame, k: int, location: bool, seed: int) -> DataFrame:
    """Seeds: k pixels of each image, drawn uniformly: those with the least hash under a seed.

    Each of 64 parts of an image keeps its k least before they are ranked, so no task sorts an image."""
    spread = px.withColumn("__s", F.pmod(_drawn_hash(seed, 1), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("image_id", "__s").orderBy(_drawn_hash(seed, 0), "y", "x"))
    few = spread.withColumn("__r", rank).filter(F.col("__r") <= k)
    last = F.row_number().over(Window.partitionBy("image_id").orderBy(_drawn_hash(seed, 0), "y", "x"))
    return few.withColumn("cid", last - 1).filter(F.col("cid") < k).select("image_id", "cid", *_dims(location))


def spread_pixels(px: DataFrame, k: int, location: bool, seed: int) -> DataFrame:
    """Seeds: k pixels of each image, each drawn with a probability in proportion to its squared distance from the nearest
    of those before.

    A draw is a minimum of exponential variates, -ln(u) / weight with u of a hash, so it takes one partial aggregation."""
    dims = _dims(location)
    found = None
    for draw in range(k):
        u = (F.pmod(_drawn_hash(seed, draw), F.lit((1 << 40) - 1)) + 1) / F.lit(float(1 << 40))
        if found is None:
            weighed = px.withColumn("__k", -F.log(u))
        else:
            weighed = _joined(px, found, location).withColumn("__far", F.array_min(F.transform("__centroids", lambda c: _far(c, location))))
            weighed = weighed.filter("__far > 0").withColumn("__k", -F.log(u) / F.col("__far"))
        best = weighed.groupBy("image_id").agg(F.min(F.struct("__k", "y", "x", *dims)).alias("s"))
        one = best.select("image_id", F.lit(draw).alias("cid"), *[F.col(f"s.{d}").alias(d) for d in dims])
        found = written(one if found is None else found.union(one), "kmeans-seeds")
    return found


def _far(c: Column, location: bool) -> Column:
    out = None
    for d in _dims(location):
        gap = F.col(d) - c[d]
        out = gap * gap if out is None else out + gap * gap
    return out


def _nearest(location: bool) -> Column:
    return F.array_min(F.transform("__centroids", lambda c: F.struct(_far(c, location).alias("far"), c["cid"].alias("cid"))))["cid"]


def _joined(px: DataFrame, centroids: DataFrame, location: bool) -> DataFrame:
    """Pixels with their image's centroids as an array of k structs."""
    packed = centroids.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cid", *_dims(location)))).alias("__centroids"))
    return px.join(F.broadcast(packed) if has_at_most(centroids, BROADCAST_ROWS) else packed, "image_id")


def _with(px: DataFrame, centroids: DataFrame, location: bool) -> DataFrame:
    return _joined(px, centroids, location).withColumn("cid", _nearest(location))


def steps(px: DataFrame, centroids: DataFrame, iterations: int, location: bool) -> tuple[DataFrame, DataFrame]:
    """(assigned pixels of the last step, centroids after it); an empty cluster keeps its centroid."""
    assigned = None
    if iterations > 1:
        px = written(px, "kmeans-points")
    centroids = written(centroids, "kmeans-centroids")
    for _ in range(iterations):
        assigned = _with(px, centroids, location)
        means = assigned.groupBy("image_id", "cid").agg(*[(F.sum(d) / F.count("*")).alias(f"__{d}") for d in _dims(location)])
        moved = centroids.join(means, ["image_id", "cid"], "left").select("image_id", "cid", *[F.coalesce(f"__{d}", d).alias(d) for d in _dims(location)])
        centroids = written(moved, "kmeans-centroids")
    return assigned, centroids


def kmeans(df: DataFrame, k: int = 2, iterations: int = 20, location: bool = False, centroids: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Each pixel in its cluster's colour, cut to integers; k or iterations of 0 leave the image as it is.

    centroids: (image_id, cid, f0..) to start from.  The colour is that of the centroids after the last step, the
    cluster that of the step before, as the method paints."""
    if k <= 0 or iterations <= 0:
        return df
    px = points(df, location)
    start = centroids if centroids is not None else (drawn_pixels if location else spread_pixels)(px, k, location, seed)
    assigned, last = steps(px, start, iterations, location)
    scale = 255.0 if location else 1.0
    color = [F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(F.col(f"c.n_{d}") * scale, 6))).cast("int").alias(c) for c, d in zip("rgb", DIMS, strict=False)]
    # colours come as an array of the image's, so pixels are joined by image as in a step, and not by cluster
    named = last.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("cid", F.struct(*[F.col(d).alias(f"n_{d}") for d in DIMS[:3]])))).alias("__colors"))
    named = F.broadcast(named) if has_at_most(last, BROADCAST_ROWS) else named
    painted = assigned.join(named, "image_id").withColumn("c", F.element_at("__colors", F.col("cid")))
    by = {c: v for c, v in zip("rgb", color, strict=True)}
    if not is_color(df):
        return painted.select("image_id", "y", "x", by["r"].alias("v"))
    return painted.select("image_id", "y", "x", by["b"].alias("b"), by["g"].alias("g"), by["r"].alias("r"), "a")
