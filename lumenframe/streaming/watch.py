"""Images that arrive as files: histograms that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.operators.histogram import histogram


def pixel_stream(spark: SparkSession, path: str, schema: str = "image_id long, y int, x int, v int", files_per_batch: int = 100) -> DataFrame:
    """Pixel tables written under path, as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, v, count) so far; state is 256 rows an image at most."""
    return pixels.groupBy("image_id", "v").agg(F.count("*").alias("count"))


def follow(pixels: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch's histograms to a table, each batch under its own number so a repeated one replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        histogram(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def gathered(pixels: DataFrame, out: str) -> DataFrame:
    """(image_id, v, count) of all that a stream has to give now, by way of a table of its batches under out."""
    follow(pixels, f"{out}/batches", f"{out}/state").awaitTermination()
    return pixels.sparkSession.read.parquet(f"{out}/batches").groupBy("image_id", "v").agg(F.sum("count").alias("count"))
