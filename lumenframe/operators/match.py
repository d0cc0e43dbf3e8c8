"""Template matching: the position where a small image fits a large one best.

A template is read once.  Up to LITERALS pixels it becomes literals of the plan and is laid over the image in two window
passes: along a row for the template's rows, along a column for their sum.  A larger one is shipped as an array, and
images are cut into bands of rows that overlap by the template's height: correlations of a band take a Fourier
transform, absolute differences a pass for each pixel of the template or, where that is less work, a transform for each
gray level.  Both ways give the same scores, sums of integers being exact.

An empty table has no scores; a template without pixels is refused.  A null pixel leaves the places without a score that
hold it.  Images have one row for each pixel; of a template's pixel that is there twice one is taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.pixels import columns_of, downscale, draw_box, extent, gray, rows_of

LITERALS, BAND = 256, 64
METHODS = ("SAD", "SSD", "NCC")


def template_rows(template: DataFrame) -> list[list[int]]:
    """The gray values of a template (ty, tx, tv), or of a pixel table, row by row."""
    if "tv" not in template.columns:
        template = gray(template).select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("v").alias("tv"))
    found = template.select("ty", "tx", "tv").collect()
    if not found:
        raise ValueError("a template has a pixel at least")
    h, w = max(r.ty for r in found) + 1, max(r.tx for r in found) + 1
    out = [[0] * w for _ in range(h)]
    for r in found:
        out[r.ty][r.tx] = r.tv
    return out


def _windows(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of all windows of h x w, of integers."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1), np.int64)
    total[1:, 1:] = x.astype(np.int64).cumsum(0).cumsum(1)
    return total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]


def _correlated(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sums of products of t and each window, of integers."""
    shape = tuple(1 << (n - 1).bit_length() for n in x.shape)
    f = np.fft.irfft2(np.fft.rfft2(x, shape) * np.conj(np.fft.rfft2(t, shape)), shape)
    return np.rint(f[: x.shape[0] - t.shape[0] + 1, : x.shape[1] - t.shape[1] + 1]).astype(np.int64)


def _apart(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of t and each window."""
    h, w = t.shape
    rows, columns = x.shape[0] - h + 1, x.shape[1] - w + 1
    if t.size * rows * columns <= 256 * 60 * x.size:
        out = np.zeros((rows, columns), np.int64)
        for dy in range(h):
            for dx in range(w):
                out += np.abs(x[dy : dy + rows, dx : dx + columns] - t[dy, dx])
        return out
    # |a - b| is the number of levels that one of them is above and the other is not
    out = np.zeros((rows, columns), np.int64)
    for level in range(int(min(x.min(), t.min())), int(max(x.max(), t.max()))):
        a, b = (x > level).astype(np.int64), (t > level).astype(np.int64)
        out += _windows(a, h, w) + int(b.sum()) - 2 * _correlated(a, b)
    return out


def scores(x: np.ndarray, t: np.ndarray, method: str) -> np.ndarray:
    """The score of each place of t in x."""
    if method == "SAD":
        return _apart(x, t)
    both, squares = _correlated(x, t), _windows(x * x, *t.shape)
    if method == "SSD":
        return squares - 2 * both + int((t * t).sum())
    n, s, st = t.size, _windows(x, *t.shape), int(t.sum())
    below = (n * squares - s * s).astype(np.float64) * float(n * int((t * t).sum()) - st * st)
    return np.where(below > 0, (n * both - s * st) / np.sqrt(np.where(below > 0, below, 1)), 0.0)


def _in_bands(df: DataFrame, template: list[list[int]], method: str) -> DataFrame:
    t = np.array(template, np.int64)
    h, w = t.shape
    tall = max(BAND, h)
    bands = F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - (h - 1)) / tall)), F.floor(F.col("y") / tall))
    dealt = df.select("image_id", "y", "x", "v", F.explode(bands).alias("band"))

    def run(px: pd.DataFrame) -> pd.DataFrame:
        y, x = px["y"].to_numpy(), px["x"].to_numpy()
        first = int(px["band"].iloc[0]) * tall
        image, missing = np.zeros((int(y.max()) - first + 1, int(x.max()) + 1), np.int64), np.ones((int(y.max()) - first + 1, int(x.max()) + 1), np.int64)
        known = px["v"].notna().to_numpy()
        image[y[known] - first, x[known]] = px["v"].to_numpy()[known].astype(np.int64)
        missing[y[known] - first, x[known]] = 0
        if image.shape[0] < h or image.shape[1] < w:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("image_id", "y", "x", "score")})
        found = scores(image, t, method)
        at = np.nonzero(_windows(missing, h, w) == 0)
        at = tuple(a[at[0] < tall] for a in at)
        return pd.DataFrame({"image_id": px["image_id"].iloc[0], "y": at[0] + first, "x": at[1], "score": found[at]})

    return dealt.groupBy("image_id", "band").applyInPandas(run, f"image_id long, y int, x int, score {'double' if method == 'NCC' else 'long'}")


def score_map(df: DataFrame, template: list[list[int]], method: str = "SAD") -> DataFrame:
    """(image_id, y, x, score) of every place the template fits in."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    df, h, w = gray(df), len(template), len(template[0])
    if h * w > LITERALS:
        return _in_bands(df, template, method)
    near = df.select("*", *[F.lead("v", tx).over(rows_of()).cast("long").alias(f"__x{tx}") for tx in range(w)]).filter(F.col(f"__x{w - 1}").isNotNull())

    def summed(term: Callable[[int], Column]) -> Column:
        out = term(0)
        for tx in range(1, w):
            out = out + term(tx)
        return out

    def line(ty: int) -> Column:
        t = template[ty]
        i = lambda tx: F.col(f"__x{tx}")
        if method == "SAD":
            return F.struct(summed(lambda tx: F.abs(i(tx) - t[tx])).alias("a"))
        if method == "SSD":
            return F.struct(summed(lambda tx: (i(tx) - t[tx]) * (i(tx) - t[tx])).alias("a"))
        return F.struct(summed(lambda tx: i(tx) * t[tx]).alias("a"))

    sums = [F.struct(summed(lambda tx: F.col(f"__x{tx}")).alias("s"), summed(lambda tx: F.col(f"__x{tx}") * F.col(f"__x{tx}")).alias("q")).alias("__own")] if method == "NCC" else []
    lines = near.select("image_id", "y", "x", *[line(ty).alias(f"__l{ty}") for ty in range(h)], *sums)
    down = lambda c, ty: F.lead(c, ty).over(columns_of()) if ty else F.col(c)
    placed = lines.select("image_id", "y", "x", *[down(f"__l{ty}", ty).alias(f"__d{ty}") for ty in range(h)], *([down("__own", ty).alias(f"__o{ty}") for ty in range(h)] if sums else []))
    placed = placed.filter(F.col(f"__d{h - 1}").isNotNull())
    total = lambda c, k: sum((F.col(f"{c}{ty}.{k}") for ty in range(1, h)), F.col(f"{c}0.{k}"))
    score = total("__d", "a")
    if method == "NCC":
        n, t = h * w, [v for r in template for v in r]
        st, qt = sum(t), sum(v * v for v in t)
        s, q = total("__o", "s"), total("__o", "q")
        below = (n * q - s * s).cast("double") * F.lit(float(n * qt - st * st))
        score = F.when(below > 0, (n * score - s * st).cast("double") / F.sqrt(below)).otherwise(0.0)
    return placed.select("image_id", "y", "x", score.alias("score"))


def match_template(df: DataFrame, template: DataFrame, method: str = "SAD", max_dim: int | None = None) -> DataFrame:
    """(image_id, best_y, best_x, score): the first best place in row order, (0, 0) without a score where nothing fits.

    max_dim: search images reduced by a whole factor so that no side is longer, and scale the place back (approximate)."""
    factor = 1
    if max_dim:
        longest = extent(df).agg(F.max(F.greatest("w", "h"))).first()[0] or 1
        factor = max(1, math.ceil(longest / max_dim))
    if factor > 1:
        small = template if "tv" not in template.columns else template.select(F.lit(0).alias("image_id"), F.col("ty").alias("y"), F.col("tx").alias("x"), F.col("tv").alias("v"))
        df, template = downscale(gray(df), factor), downscale(gray(small), factor)
    found = score_map(df, template_rows(template), method)
    key = -F.col("score") if method == "NCC" else F.col("score")
    best = found.groupBy("image_id").agg(F.min(F.struct(key.alias("k"), F.col("y"), F.col("x"), F.col("score"))).alias("s"))
    every = df.select("image_id").distinct().join(best, "image_id", "left")
    place = lambda c: (F.coalesce(F.col(f"s.{c}"), F.lit(0)) * factor).cast("int").alias(f"best_{c}")
    return every.select("image_id", place("y"), place("x"), F.col("s.score").cast("double").alias("score"))


def match_and_draw(df: DataFrame, template: DataFrame, method: str = "SAD", max_dim: int | None = None) -> DataFrame:
    rows = template_rows(template)
    return draw_box(df, match_template(df, template, method, max_dim), len(rows[0]), len(rows))
