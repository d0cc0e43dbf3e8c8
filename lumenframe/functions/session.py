"""An editing session: the current image, undo and redo, timing, history and log."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.commands import Parameters, command
from lumenframe.storage import written


class UndoRedo:
    """Two stacks of images; a new state empties the second.  States are DataFrames, so the stacks hold no pixels."""

    def __init__(self):
        self.undone: list[DataFrame] = []
        self.done: list[DataFrame] = []

    def add(self, state: DataFrame) -> None:
        self.done.append(state)
        self.undone.clear()

    def undo(self, now: DataFrame) -> DataFrame:
        if not self.done:
            return now
        self.undone.append(now)
        return self.done.pop()

    def redo(self, now: DataFrame) -> DataFrame:
        if not self.undone:
            return now
        self.done.append(now)
        return self.undone.pop()

    def clear(self) -> None:
        self.done.clear()
        self.undone.clear()


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """(result, milliseconds) of an action; a lazy plan has to be run by it to be timed."""
    began = time.perf_counter()
    out = action()
    return out, (time.perf_counter() - began) * 1000


class Session:
    def __init__(self, image: DataFrame, clock: Callable[[], datetime] = datetime.now):
        self.before = self.image = image
        self.states, self.clock = UndoRedo(), clock
        self.history: list[str] = []
        self.log: list[str] = []

    def apply(self, name: str, parameters: Parameters | None = None) -> DataFrame:
        """Run a command on the current image; the result is written once, and read from there by the steps that follow."""
        step = command(name, parameters)
        self.states.add(self.image)
        self.image, ms = timed(lambda: written(step(self.image), "session"))
        self.history.insert(0, f"[{self.clock():%H:%M:%S}] {name} ({ms:.2f} ms)")
        self.log.append(f"[{self.clock():%Y-%m-%d %H:%M:%S}] [INFO] {name} applied.")
        return self.image

    def undo(self) -> DataFrame:
        self.image = self.states.undo(self.image)
        return self.image

    def redo(self) -> DataFrame:
        self.image = self.states.redo(self.image)
        return self.image

    def lines(self, spark: SparkSession, what: str = "history") -> DataFrame:
        return spark.createDataFrame([(x,) for x in getattr(self, what)], "line string")


def zoom(scale: float, offset: float, at: float, inward: bool) -> tuple[float, float]:
    """(scale, offset) after a zoom step of 1.1 about a point, kept between 0.05 and 50."""
    new = min(50.0, max(0.05, scale * 1.1 if inward else scale / 1.1))
    return (scale, offset) if abs(new - scale) < 0.001 else (new, offset + at * (scale - new))


def fit(view_w: float, view_h: float, w: float, h: float) -> float:
    return min(view_w / w, view_h / h)


def viewport(view_x: float, view_y: float, view_w: float, view_h: float, scale: float, w: float, h: float, map_scale: float) -> tuple[float, float, float, float]:
    """The part of a w x h image that a view shows, as a rectangle of its minimap."""
    x0, y0 = max(0.0, -view_x / scale), max(0.0, -view_y / scale)
    x1, y1 = min(w, (view_w - view_x) / scale), min(h, (view_h - view_y) / scale)
    return x0 * map_scale, y0 * map_scale, max(0.0, x1 - x0) * map_scale, max(0.0, y1 - y0) * map_scale


def zoom_label(scale: float, first: float) -> str:
    """The scale as a percentage of the one that an image was opened with."""
    return f"{scale / first * 100:.0f}%" if first else "100%"


def short(count: Column) -> Column:
    """A count as text, thousands and millions with a tenth at most."""

    def scaled(unit: int, suffix: str) -> Column:
        tenths = F.floor((count * 10 + unit // 2) / unit)
        whole = F.floor(tenths / 10).cast("string")
        return F.concat(whole, F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))), F.lit(suffix))

    return F.when(count >= 1_000_000, scaled(1_000_000, "M")).when(count >= 1000, scaled(1000, "K")).otherwise(count.cast("string"))


def bars(hist: DataFrame, height: float) -> DataFrame:
    """A histogram with the height of each bar and a short label of its count."""
    top = hist.groupBy("image_id").agg(F.max("count").alias("__top"))
    return hist.join(top, "image_id").select("image_id", "v", "count", (F.col("count") / F.col("__top") * height).alias("height"), short(F.col("count")).alias("label"))


def value_ticks(n: int = 5) -> list[int]:
    """Values to be written along a histogram, evenly spread from 0 to 255."""
    return [round(255 * k / (n - 1)) for k in range(n)]


def count_ticks(hist: DataFrame, n: int = 4) -> DataFrame:
    """(image_id, tick, count, label): counts to be written beside a histogram, from the tallest bar down to 0."""
    top = hist.groupBy("image_id").agg(F.max("count").alias("__top"))
    each = top.select("image_id", "__top", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tick"))
    counted = each.select("image_id", "tick", F.floor(F.col("__top") * (n - 1 - F.col("tick")) / (n - 1)).alias("count"))
    return counted.withColumn("label", short(F.col("count")))
