"""Image files in and out.

Reading uses Spark's image source (PNG, BMP, JPEG, GIF, TIFF as the JVM decodes them).  Writing has two forms: encoded
bytes as a column, for any table format, and files through a Python data source whose tasks each write their own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lumenframe.operators.pixels import from_blobs, to_blobs
from lumenframe.sources.codecs import encode

BLOB = "image_id long, origin string, height int, width int, n_channels int, mode int, data binary"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, origin, height, width, n_channels, mode, data) of the files under path; broken files are left out.

    image_id is a hash of the origin, so it stays the same from read to read."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return found.select(
        F.xxhash64("image.origin").alias("image_id"), "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.mode", "image.data"
    )


def standardize(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gray pixels, colour pixels): one-channel images stay gray, all others become b, g, r, a."""
    one = from_blobs(images.filter("n_channels = 1")).select("image_id", "y", "x", F.col("b").alias("v"))
    return one, from_blobs(images.filter("n_channels <> 1"))


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    from lumenframe.operators.pixels import gray

    one, color = standardize(read_images(spark, path))
    return one.union(gray(color))


def encoded(pixels: DataFrame, kind: str = "png") -> DataFrame:
    """(image_id, content): each image as the bytes of a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [encode(kind, r.height, r.width, r.n_channels, r.data) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"image_id": b["image_id"], "content": content})

    return to_blobs(pixels).mapInPandas(run, "image_id long, content binary")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ImageWriter(DataSourceWriter):
    """Writes (image_id, content) rows as files image_id.kind; a retried task writes the same names again."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.removeprefix("file://"), kind

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        files = []
        for r in rows:
            at = os.path.join(self.path, f"{r.image_id}.{self.kind}")
            with open(at + ".part", "wb") as f:
                f.write(bytes(r.content))
            os.replace(at + ".part", at)
            files.append(at)
        return Written(files)

    def commit(self, messages) -> None:
        return None

    def abort(self, messages) -> None:
        for m in messages:
            for at in m.files if m else ():
                if os.path.exists(at):
                    os.remove(at)


class ImageFiles(DataSource):
    """Sink `image_files`: options path (a folder every executor sees) and kind (png, bmp or jpg)."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "image_id long, content binary"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], self.options.get("kind", "png"))


def save_images(pixels: DataFrame, path: str, kind: str = "png") -> None:
    """Each image of a pixel table as a file under path."""
    pixels.sparkSession.dataSource.register(ImageFiles)
    encoded(pixels, kind).write.format("image_files").mode("append").option("path", path).option("kind", kind).save()
