import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import commands, session
from lumenframe.operators import pixels
from lumenframe.sources import codecs, images, logs
from lumenframe.streaming import watch


def color_table(spark, px, image_id=1):
    rows = [(image_id, y, x, *map(int, px[y, x])) for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, b int, g int, r int, a int")


def test_files_out_and_in(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    df = color_table(spark, px)
    images.save_images(df, str(tmp_path / "out"), "png")
    images.save_images(df.select("image_id", "y", "x", F.col("b").alias("v")), str(tmp_path / "gray"), "bmp")
    (tmp_path / "out" / "broken.png").write_bytes(b"no image")
    back = images.read_images(spark, str(tmp_path / "out"))
    assert back.count() == 1
    _, color = images.standardize(back)
    assert sorted(tuple(r)[1:] for r in color.collect()) == sorted(tuple(r)[1:] for r in df.collect())
    gray = images.read_gray(spark, str(tmp_path / "gray"))
    assert sorted((r.y, r.x, r.v) for r in gray.collect()) == sorted((y, x, int(px[y, x, 0])) for y in range(5) for x in range(7))
    with pytest.raises(ValueError):
        codecs.encode("gif", 1, 1, 1, b"x")


def test_jpeg_files(spark, tmp_path):
    y, x = np.mgrid[0:45, 0:70]
    smooth = np.stack([x * 3, y * 5, 255 - x * 2, np.full(x.shape, 255)], 2).astype(np.uint8)
    noise = np.random.default_rng(3).integers(0, 256, (19, 9, 4)).astype(np.uint8)
    flat = np.full((3, 2, 4), 77, np.uint8)
    for name, px, most in (("smooth", smooth, 6), ("noise", noise, 30), ("flat", flat, 2)):
        images.save_images(color_table(spark, px), str(tmp_path / name), "jpg")
        _, back = images.standardize(images.read_images(spark, str(tmp_path / name)))
        got = np.zeros(px.shape, int)
        for r in back.collect():
            got[r.y, r.x] = (r.b, r.g, r.r, r.a)
        assert np.abs(got[..., :3] - px[..., :3].astype(int)).mean() < most, name
        images.save_images(color_table(spark, px).select("image_id", "y", "x", F.col("g").alias("v")), str(tmp_path / (name + "g")), "jpg")
        gray = images.read_gray(spark, str(tmp_path / (name + "g"))).collect()
        assert np.mean([abs(r.v - int(px[r.y, r.x, 1])) for r in gray]) < most


def test_tiff_files(spark, tmp_path):
    """An uncompressed gray TIFF of one strip, written by hand."""
    import struct

    px = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    tags = [(256, 4), (257, 3), (258, 8), (259, 1), (262, 1), (273, 8), (277, 1), (278, 3), (279, 12)]
    body = b"".join(struct.pack("<HHII", t, 3 if t not in (273, 279) else 4, 1, v) for t, v in tags)
    (tmp_path / "tiff").mkdir()
    (tmp_path / "tiff" / "a.tif").write_bytes(b"II*\0" + struct.pack("<I", 20) + px.tobytes() + struct.pack("<H", len(tags)) + body + b"\0\0\0\0")
    assert sorted((r.y, r.x, r.v) for r in images.read_gray(spark, str(tmp_path / "tiff")).collect()) == sorted((y, x, int(px[y, x])) for y in range(3) for x in range(4))


def test_csv_keeps_quotes(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi", you', "é"), ("", "b")], "a string, b string")
    logs.export_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert {(r.a or "", r.b) for r in back} == {('say "hi", you', "é"), ("", "b")}


def test_session(spark):
    px = np.random.default_rng(2).integers(0, 256, (6, 6, 4)).astype(np.uint8)
    s = session.Session(color_table(spark, px))
    s.apply("Gray")
    first = s.image
    s.apply("Laplace")
    assert s.undo() is first and s.redo() is not first and len(s.history) == 2
    s.undo()
    s.apply("Bin")
    assert s.redo() is s.image
    parsed = logs.parse_history(s.lines(spark)).collect()
    assert [r.operation for r in parsed] == ["Bin", "Laplace", "Gray"]
    assert logs.parse_log(s.lines(spark, "log")).first().level == "INFO"
    assert session.zoom(1, 0, 10, True) == (1.1, pytest.approx(-1.0)) and session.fit(100, 50, 200, 50) == 0.5
    assert session.viewport(-10, 0, 50, 50, 2, 100, 100, 0.5) == (2.5, 0, 12.5, 12.5)


def test_every_command(spark):
    px = np.random.default_rng(4).integers(0, 256, (8, 8, 4)).astype(np.uint8)
    df = color_table(spark, px)
    small = pixels.crop(pixels.gray(df), 2, 2, 3, 3)
    p = commands.Parameters(template=small)
    assert len(commands.COMMANDS) == 24
    for name in commands.COMMANDS:
        assert df.transform(commands.command(name, p)).count() == 64, name
    with pytest.raises(ValueError):
        commands.command("Nothing")
    bars = session.bars(commands.histogram.histogram(df), 100).collect()
    assert max(r.height for r in bars) == 100
    assert session.value_ticks() == [0, 64, 128, 191, 255]
    counts = spark.createDataFrame([(0, 3, c) for c in (7, 999, 1000, 1049, 1050, 1_250_000)], "image_id long, v int, count long")
    assert [r.label for r in counts.select(session.short(F.col("count")).alias("label")).collect()] == ["7", "999", "1K", "1K", "1.1K", "1.3M"]
    assert [(r["count"], r.label) for r in session.count_ticks(counts).orderBy("tick").collect()] == [(1_250_000, "1.3M"), (833_333, "833.3K"), (416_666, "416.7K"), (0, "0")]
    assert session.zoom_label(0.75, 0.5) == "150%" and session.zoom_label(2, 0) == "100%"


def test_stream_of_pixels(spark, tmp_path):
    px = np.random.default_rng(6).integers(0, 9, (4, 4, 4)).astype(np.uint8)
    gray = pixels.gray(color_table(spark, px))
    gray.write.parquet(str(tmp_path / "in"))
    stream = watch.pixel_stream(spark, str(tmp_path / "in"))
    watch.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.v, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("v").agg(F.sum("count").alias("count")).collect()}
    assert got == {(r.v, r["count"]) for r in commands.histogram.histogram(gray).collect()}
    q = watch.running_histogram(watch.pixel_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.v, r["count"]) for r in spark.table("running").collect()} == got
