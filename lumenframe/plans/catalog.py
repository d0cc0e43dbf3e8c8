"""Registered image queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import session
from lumenframe.functions.commands import Parameters, command, pipeline
from lumenframe.operators import cluster, filters, frequency, histogram, match, pixels, point
from lumenframe.plans import fixtures, oracle
from lumenframe.sources import images, logs
from lumenframe.storage import fresh_path
from lumenframe.streaming import watch


def _on(image, op):
    return lambda spark, sf_dir: op(image(spark, sf_dir))


def _small(op):
    """Tables of small images are dealt out once, by image."""
    return lambda spark, sf_dir: op(pixels.colocated(fixtures.em(spark, sf_dir)))


def _matched(method: str, size: int = 8):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = match.match_template(fixtures.ev(spark, sf_dir), fixtures.template(spark, sf_dir, size), method)
        return found.withColumn("score", F.round("score", 9))

    return run


def _score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.score_map(fixtures.ev(spark, sf_dir), match.template_rows(fixtures.template(spark, sf_dir)), "SAD")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_and_draw(fixtures.ev(spark, sf_dir), fixtures.template(spark, sf_dir), "SAD")


def _statistics(*names: str):
    return _small(lambda d: histogram.statistics(d).select("image_id", *[F.round(n, 6).alias(n) if n in ("mean", "std") else n for n in names]))


def _centroids(location: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = cluster.points(fixtures.rg(spark, sf_dir), location)
        _, last = cluster.steps(px, cluster.first_pixels(px, 4, location), 3, location)
        return last.select("image_id", "cid", *[F.round(c, 6).alias(c) for c in last.columns[2:]])

    return run


def _painted(iterations: int, location: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        image = fixtures.rg(spark, sf_dir)
        return cluster.kmeans(image, 4, iterations, location, cluster.first_pixels(cluster.points(image, location), 4, location))

    return run


def _command(image, name: str, **more):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        template = {"template": fixtures.template(spark, sf_dir)} if name in match.METHODS else {}
        return image(spark, sf_dir).transform(command(name, Parameters(**more, **template)))

    return run


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour image written as a PNG file and read back, gray."""
    path = fresh_path(spark, "images")
    images.save_images(fixtures.rg(spark, sf_dir), path)
    return images.read_gray(spark, path).select("y", "x", "v")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks written as CSV and read back."""
    path = fresh_path(spark, "csv")
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    logs.export_csv(t.select(F.col("event_id").cast("string").alias("event_id"), F.concat("event_type", F.lit('",\n'), "event_type").alias("text")), path)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of the event image, its pixels coming as a stream of files."""
    path = fresh_path(spark, "stream")
    fixtures.ev(spark, sf_dir).repartition(4).write.parquet(path)
    pixels = spark.readStream.schema("image_id long, y int, x int, v int").parquet(path)
    return watch.gathered(pixels, fresh_path(spark, "streamed"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.format_string("[%s] %s (%.2f ms)", F.date_format("ts", "HH:mm:ss"), "event_type", "value")
    return logs.parse_history(t.select(line.alias("line")).union(spark.sql("select 'no such form'")))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.format_string("[%s] [INFO] %s applied.\r\n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type")
    return logs.parse_log(t.select(line.alias("line")).union(spark.sql("select 'no such form'")))


def _blobs(d: DataFrame) -> DataFrame:
    return pixels.from_blobs(pixels.to_blobs(d)).select("image_id", "y", "x", F.col("b").alias("v"))


SHARPEN = {(0, 0): 5, (-1, 0): -1, (1, 0): -1, (0, -1): -1, (0, 1): -1}
CORNER = {(0, 0): 2, (-1, 0): 1, (0, 1): 1}
EV, EM, MX, RG = fixtures.ev, fixtures.em, fixtures.mx, fixtures.rg

QUERIES = {
    "brightness_clamp": _on(EV, lambda d: point.brightness(d, 100)),
    "binarize_128": _on(EV, point.binarize),
    "otsu_threshold": _on(EM, histogram.otsu_threshold),
    "otsu_binarize": _on(EV, histogram.otsu_binarize),
    "grayscale": _on(RG, pixels.gray),
    "channel_unpivot": _on(RG, pixels.split_channels),
    "channel_merge": _on(RG, lambda d: pixels.merge_channels(pixels.split_channels(d))),
    "crop_roi": _on(EV, lambda d: pixels.crop(d, 5.7, 3.2, 15, 20.9)),
    "pad_replicate": _small(lambda d: pixels.pad(d, 2)),
    "unpad": _small(lambda d: pixels.unpad(d, 2)),
    "pad_pow2_center": _on(EV, pixels.pad_power),
    "downscale_4": _on(EV, lambda d: pixels.downscale(d, 4)),
    "histogram_gray": _on(EV, histogram.histogram),
    "histogram_dense_256": _on(EM, histogram.histogram_dense),
    "histogram_channels": _on(RG, histogram.channel_histograms),
    "hist_stats": _statistics("mean", "std"),
    "hist_median_mode_range": _statistics("median", "mode", "min", "max", "range", "max_count"),
    "equalize_gray": _on(EV, histogram.equalize),
    "equalize_color": _on(RG, histogram.equalize_color),
    "differential": _on(EV, filters.differential),
    "average_blur_3": _on(EV, filters.average_blur),
    "average_blur_5": _on(EV, lambda d: filters.average_blur(d, 5)),
    "average_blur_disk_5": _small(lambda d: filters.average_blur(d, 5, circular=True)),
    "average_blur_color_3": _on(RG, filters.average_blur),
    "gaussian_3": _on(EV, filters.gaussian_blur),
    "gaussian_disk_5": _on(EV, lambda d: filters.gaussian_blur(d, 1.5, 5, circular=True)),
    "gaussian_color_3": _on(RG, filters.gaussian_blur),
    "convolve_sharpen": _on(EV, lambda d: filters.convolve(d, SHARPEN)),
    "convolve_color": _on(RG, lambda d: filters.convolve(d, CORNER)),
    "sobel_3": _on(EV, filters.sobel),
    "sobel_5": _on(EV, lambda d: filters.sobel(d, 5)),
    "laplacian_3": _on(EV, filters.laplacian),
    "laplacian_5": _on(EV, lambda d: filters.laplacian(d, 5)),
    "dilate_3": _on(EV, filters.dilate),
    "erode_3": _on(EV, filters.erode),
    "dilate_disk_5": _on(EV, lambda d: filters.dilate(d, 5, circular=True)),
    "erode_disk_5": _on(EV, lambda d: filters.erode(d, 5, circular=True)),
    "dilate_color_3": _on(RG, filters.dilate),
    "erode_color_3": _on(RG, filters.erode),
    "opening_3": _on(EV, filters.opening),
    "closing_3": _on(EV, filters.closing),
    "match_sad": _matched("SAD"),
    "match_ssd": _matched("SSD"),
    "match_ncc": _matched("NCC"),
    "match_ncc_32": _matched("NCC", 32),
    "match_sad_65": _matched("SAD", 65),
    "match_ssd_65": _matched("SSD", 65),
    "match_score_map_sad": _score_map,
    "draw_box": _drawn,
    "fft_lowpass": _on(EM, lambda d: frequency.low_pass(d, 0.5)),
    "fft_highpass": _on(EM, lambda d: frequency.high_pass(d, 0.5)),
    "fft_bandstop": _on(EM, lambda d: frequency.axial_band_stop(d, 1.5, 4)),
    "fft_spectrum": _on(EM, frequency.fft_spectrum),
    "fft_phase": _on(EM, frequency.fft_phase),
    "fft_lowpass_padded": _on(EV, lambda d: frequency.low_pass(d, 0.2)),
    "fft_highpass_mixed": _on(MX, lambda d: frequency.high_pass(d, 0.5)),
    "fft_spectrum_mixed": _on(MX, frequency.fft_spectrum),
    "fft_phase_mixed": _on(MX, frequency.fft_phase),
    "fft_color": _on(RG, frequency.fft_color),
    "kmeans_rgb_3iter": _painted(3),
    "kmeans_rgb_20iter": _painted(20),
    "kmeans_rgbxy_painted": _painted(3, True),
    "kmeans_rgb_centroids": _centroids(False),
    "kmeans_rgbxy_3iter": _centroids(True),
    "history_parse": _history,
    "log_parse": _log,
    "pipeline_gray_blur_otsu": _on(RG, lambda d: pipeline(d, "Gray", "Average", "Bin_Otsu")),
    "blob_round_trip": _on(EM, _blobs),
    "image_files": _saved,
    "csv_export": _exported,
    "stream_histograms": _streamed,
    "histogram_bars": _on(EM, lambda d: session.bars(histogram.histogram(d), 200).select("image_id", "v", "count", F.round("height", 6).alias("height"), "label")),
    "histogram_ticks": _on(EV, lambda d: session.count_ticks(histogram.histogram(d))),
    "command_Bright": _command(EV, "Bright", brightness=100),
    **{f"command_{n}": _command(EV, n) for n in ("Bin", "Bin_Otsu", "Equal", "Diff", "Sobel", "Laplace", "Average", "Gaussian", "Dilation", "Erosion", "Opening", "Closing", *match.METHODS)},
    **{f"command_{n}": _command(RG, n) for n in ("Gray", "Equal_color")},
    "command_FFT": _command(EM, "FFT"),
    "command_FFT_Low": _command(EM, "FFT_Low", radius_ratio=0.5),
    "command_FFT_High": _command(EM, "FFT_High", radius_ratio=0.5),
    "command_FFT_Band": _command(EM, "FFT_Band", low_freq_radius=1.5, magnitude_threshold=4),
}

ORACLE_SQL = oracle.build()
