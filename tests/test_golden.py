"""The 5 x 5 example, computed by hand from the operators' rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import cluster, filters, frequency, histogram, match, pixels, point

IMAGE = [[10] * 5, [10, 50, 60, 70, 10], [10, 80, 200, 90, 10], [10, 100, 110, 120, 10], [10, 10, 10, 10, 255]]
GOLDEN = {
    "bin": [[0] * 5, [0] * 5, [0, 0, 255, 0, 0], [0] * 5, [0, 0, 0, 0, 255]],
    "avg": [[14, 20, 26, 22, 16], [22, 48, 64, 52, 25], [32, 70, 97, 75, 37], [27, 60, 81, 90, 85], [20, 31, 43, 87, 131]],
    "avgdisk": [[10, 18, 20, 22, 10], [18, 42, 78, 48, 22], [24, 88, 108, 98, 26], [28, 62, 108, 68, 81], [10, 28, 30, 81, 157]],
    "gauss": [[13, 18, 23, 21, 14], [20, 47, 67, 52, 23], [28, 75, 108, 82, 32], [26, 63, 89, 87, 78], [16, 28, 37, 79, 147]],
    "laplace": [[40, 90, 150, 110, 60], [110, 0, 40, 0, 140], [200, 0, 0, 0, 250], [160, 0, 0, 0, 255], [90, 190, 255, 255, 0]],
    "sobel": [[28, 69, 100, 88, 42], [82, 219, 255, 227, 107], [137, 255, 104, 255, 166], [129, 255, 255, 89, 255], [63, 148, 200, 255, 255]],
    "dilate": [[50, 60, 70, 70, 70], [80, 200, 200, 200, 90], [100, 200, 200, 200, 120], [100, 200, 200, 255, 255], [100, 110, 120, 255, 255]],
    "erode": [[10] * 5, [10] * 5, [10, 10, 50, 10, 10], [10] * 5, [10] * 5],
    "dilatedisk": [[10, 50, 60, 70, 10], [50, 80, 200, 90, 70], [80, 200, 200, 200, 90], [100, 110, 200, 120, 255], [10, 100, 110, 255, 255]],
    "diff": [[0, 40, 50, 60, 0], [40, 40, 150, 80, 0], [70, 140, 200, 110, 0], [90, 100, 110, 220, 0], [0] * 5],
    "equalize": [[0] * 5, [0, 26, 51, 77, 0], [0, 102, 230, 128, 0], [0, 153, 179, 204, 0], [0, 0, 0, 0, 255]],
}
OPERATORS = {
    "bin": point.binarize, "avg": filters.average_blur, "avgdisk": lambda d: filters.average_blur(d, 3, True), "gauss": filters.gaussian_blur,
    "laplace": filters.laplacian, "sobel": filters.sobel, "dilate": filters.dilate, "erode": filters.erode,
    "dilatedisk": lambda d: filters.dilate(d, 3, True), "diff": filters.differential, "equalize": histogram.equalize,
}


def table(spark, image, image_id=0):
    return spark.createDataFrame([(image_id, y, x, int(v)) for y, row in enumerate(image) for x, v in enumerate(row)], "image_id long, y int, x int, v int")


def grid(df, c="v"):
    rows = df.collect()
    out = [[None] * (max(r.x for r in rows) + 1) for _ in range(max(r.y for r in rows) + 1)]
    for r in rows:
        out[r.y][r.x] = r[c]
    return out


@pytest.fixture(scope="module")
def image(spark):
    return table(spark, IMAGE)


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(image, name):
    assert grid(OPERATORS[name](image)) == GOLDEN[name]


def test_statistics(image):
    r = histogram.statistics(image).first()
    assert (r.median, r["mode"], r.min, r.max, r.range, r.max_count) == (10, 10, 10, 255, 245, 15)
    assert abs(r["mean"] - 51.4) < 1e-9 and abs(r["std"] - 64.02374559489627) < 1e-9
    assert histogram.otsu_threshold(image).first().threshold == 80
    assert histogram.statistics(image.filter("x = 0 and y = 0")).first().median == 0


def test_matching(spark, image):
    small = spark.createDataFrame([(0, 0, 200), (0, 1, 90), (1, 0, 110), (1, 1, 120)], "ty int, tx int, tv int")
    assert grid(match.score_map(image, match.template_rows(small), "SAD"), "score") == [[440, 390, 370, 420], [370, 290, 280, 340], [320, 250, 0, 310], [410, 330, 330, 395]]
    assert grid(match.score_map(image, match.template_rows(small), "SSD"), "score")[0] == [57400, 49700, 47500, 56200]
    ncc = np.array(grid(match.score_map(image, match.template_rows(small), "NCC"), "score"))
    assert np.allclose(ncc[0], [-0.138013, -0.341103, -0.344864, -0.276026], atol=1e-6) and ncc[2][2] == pytest.approx(1)
    for m in match.METHODS:
        r = match.match_template(image, small, m).first()
        assert (r.best_y, r.best_x) == (2, 2)
    large = table(spark, [[1] * 9] * 9)
    with pytest.raises(ValueError):
        match.match_template(image, small.limit(0))
    r = match.match_template(image, large).first()
    assert (r.best_y, r.best_x, r.score) == (0, 0, None)
    flat = match.match_template(table(spark, [[7] * 4] * 4), spark.createDataFrame([(0, 0, 7), (0, 1, 7)], "ty int, tx int, tv int"), "NCC").first()
    assert (flat.best_y, flat.best_x, flat.score) == (0, 0, 0.0)


def test_properties(spark):
    rng = np.random.default_rng(3)
    px = rng.integers(0, 256, (13, 11))
    df = table(spark, px)
    for k in (3, 4, 5):
        for circular in (False, True):
            low, high = np.array(grid(filters.erode(df, k, circular))), np.array(grid(filters.dilate(df, k, circular)))
            assert (low <= px).all() and (px <= high).all()
            inverted = table(spark, 255 - px)
            assert (high == 255 - np.array(grid(filters.erode(inverted, k, circular)))).all()
    once = filters.opening(df, 3)
    assert grid(filters.opening(once, 3)) == grid(once)
    again = filters.closing(filters.closing(df, 3), 3)
    assert grid(again) == grid(filters.closing(df, 3))
    assert grid(pixels.unpad(pixels.pad(df, 3), 3)) == px.tolist()
    size = pixels.extent(df)
    assert grid(pixels.unpad_power(pixels.pad_power(df), size)) == px.tolist()
    assert grid(frequency.low_pass(df, 4.0)) == px.tolist()
    assert np.array(grid(frequency.high_pass(df, 4.0))).max() == 0
    assert histogram.histogram_dense(df).agg(F.sum("count")).first()[0] == px.size
    assert grid(histogram.equalize(table(spark, [[9, 9], [9, 9]]))) == [[0, 0], [0, 0]]
    assert grid(point.brightness(df, 300)) == [[255] * 11] * 13
    with pytest.raises(ValueError):
        filters.gaussian_blur(df, 1.0, 4)
    assert len(frequency.fft(np.arange(8))) == 8 and np.allclose(frequency.fft(frequency.fft(np.arange(8)), True), np.arange(8))


def test_convolution_agrees_with_numpy(spark):
    rng = np.random.default_rng(5)
    px = rng.integers(0, 256, (9, 12))
    kernel = {(dy, dx): float(rng.integers(-3, 5)) for dy in (-2, -1, 0, 1) for dx in (-1, 0, 2)}
    padded = np.pad(px, 2, mode="edge")
    total = sum(kernel.values())
    raw = sum(w * padded[2 + dy : 11 + dy, 2 + dx : 14 + dx] for (dy, dx), w in kernel.items())
    want = np.trunc(np.clip(np.round(raw / (total if total not in (0, 1) else 1), 6), 0, 255))
    assert grid(filters.convolve(table(spark, px), kernel)) == want.astype(int).tolist()


def test_clusters(spark):
    df = spark.createDataFrame([(0, y, x, 10 + x, 20, 200 * (x > 2), 7) for y in range(3) for x in range(6)], "image_id long, y int, x int, b int, g int, r int, a int")
    out = cluster.kmeans(df, 2, 5)
    assert {(r.r, r.g, r.b, r.a) for r in out.collect()} == {(0, 20, 11, 7), (200, 20, 14, 7)}
    assert cluster.kmeans(df, 0) is df
    assert cluster.kmeans(df, 2, 3, location=True).count() == 18
    assert cluster.kmeans(table(spark, IMAGE), 2, 5).columns == ["image_id", "y", "x", "v"]


def test_plans_of_clusters_do_not_grow(spark):
    df = spark.createDataFrame([(0, y, x, 10 + x, 20, 200 * (x > 2), 7) for y in range(3) for x in range(6)], "image_id long, y int, x int, b int, g int, r int, a int")
    sizes = [len(cluster.kmeans(df, 3, n)._jdf.queryExecution().toString()) for n in (2, 20)]
    assert sizes[1] < 1.2 * sizes[0]


def test_spread_seeds(spark):
    rows = [(i, y, x, *([250, 250, 250] if i == 0 and y == x == 3 else [y % 2, 0, 0]), 255) for i in range(2) for y in range(40) for x in range(40)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, b int, g int, r int, a int")
    px = cluster.points(df, False)
    hits = 0
    for seed in range(6):
        drawn = cluster.spread_pixels(px, 2, False, seed).collect()
        assert sorted((r.image_id, r.cid) for r in drawn) == [(0, 0), (0, 1), (1, 0), (1, 1)]
        hits += any(r.f0 == 250 for r in drawn if r.image_id == 0)
    assert hits == 6  # one of 1600 pixels has nearly all of the squared distance
    assert cluster.spread_pixels(px, 5, False, 1).groupBy("image_id").count().filter("count > 3").count() == 0  # no colour twice
    uniform = cluster.drawn_pixels(px, 3, False, 2)
    assert uniform.count() == 6 and uniform.collect() == cluster.drawn_pixels(px, 3, False, 2).collect()


def test_large_templates_score_as_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(11)
    px = rng.integers(0, 256, (90, 33))
    df = table(spark, px)
    small = spark.createDataFrame([(y, x, int(px[70 + y, 9 + x])) for y in range(6) for x in range(5)], "ty int, tx int, tv int")
    rows = match.template_rows(small)
    plain = {m: sorted(map(tuple, match.score_map(df, rows, m).collect())) for m in match.METHODS}
    monkeypatch.setattr(match, "LITERALS", 0)
    for m in match.METHODS:
        got = sorted(map(tuple, match.score_map(df, rows, m).collect()))
        assert [r[:3] for r in got] == [r[:3] for r in plain[m]]
        assert np.allclose([r[3] for r in got], [r[3] for r in plain[m]], atol=1e-9)
        assert match.match_template(df, small, m).first()[1:3] == (70, 9)
    x, t = rng.integers(0, 256, (70, 70)), rng.integers(0, 256, (66, 66))
    want = np.array([[np.abs(x[y : y + 66, z : z + 66] - t).sum() for z in range(5)] for y in range(5)])
    assert (match._apart(x, t) == want).all()
    by_levels = sum(match._windows((x > k).astype(int), 66, 66) + int((t > k).sum()) - 2 * match._correlated((x > k).astype(int), (t > k).astype(int)) for k in range(255))
    assert (by_levels == want).all()


def test_chequered_templates_do_not_overflow(spark):
    px = np.indices((40, 40)).sum(0) % 2 * 255
    df = table(spark, px)
    for n in (21, 32, 36):
        part = spark.createDataFrame([(y, x, int(px[y + 1, x])) for y in range(n) for x in range(n)], "ty int, tx int, tv int")
        r = match.match_template(df, part, "NCC").first()
        assert (r.best_y, r.best_x) == (0, 1) and r.score == pytest.approx(1)


def test_transforms_of_many_images(spark, monkeypatch):
    rng = np.random.default_rng(12)
    shapes = [(3, 5), (8, 8), (3, 5), (1, 1), (6, 2)] * 3
    stacks = [rng.integers(0, 256, s) for s in shapes]
    df = spark.createDataFrame([(i, y, x, int(v)) for i, p in enumerate(stacks) for (y, x), v in np.ndenumerate(p)], "image_id long, y int, x int, v int").repartition(4)
    color = df.select("image_id", "y", "x", F.col("v").alias("b"), (255 - F.col("v")).alias("g"), F.lit(9).alias("r"), F.lit(1).alias("a"))

    def padded(p, made):
        h, w = (1 << max(0, n - 1).bit_length() for n in p.shape)
        top, left = (h - p.shape[0]) // 2, (w - p.shape[1]) // 2
        whole = np.zeros((h, w))
        whole[top : top + p.shape[0], left : left + p.shape[1]] = p
        return made(whole)[top : top + p.shape[0], left : left + p.shape[1]]

    got = {(r.image_id, r.y, r.x): r.v for r in frequency.fft_spectrum(df).collect()}
    assert got == {(i, y, x): v for i, p in enumerate(stacks) for (y, x), v in np.ndenumerate(padded(p, frequency.spectrum))}
    got = {(r.image_id, r.y, r.x): (r.b, r.g, r.r, r.a) for r in frequency.fft_color(color, as_phase=True).collect()}
    for i, p in enumerate(stacks):
        b, g, r = (padded(q, frequency.phase) for q in (p, 255 - p, np.full(p.shape, 9)))
        assert all(got[i, y, x] == (b[y, x], g[y, x], r[y, x], 255) for y, x in np.ndindex(*p.shape))


def test_nulls_and_repeated_pixels(spark):
    rows = [(0, 0, 0, 10), (0, 0, 1, None), (0, 1, 0, 200), (0, 1, 1, 200), (0, 1, 1, 200)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, v int")
    s = histogram.statistics(df, spark.createDataFrame([(0,), (7,)], "image_id long")).orderBy("image_id").collect()
    assert (s[0].mean, s[0]["max_count"], s[0].min) == (152.5, 3, 10) and s[1].image_id == 7 and s[1].mean is None
    assert sorted((r.y, r.x, r.v) for r in histogram.otsu_binarize(df).collect()) == [(0, 0, 0), (1, 0, 255), (1, 1, 255), (1, 1, 255)]
    assert histogram.equalize(df).count() == 4
    assert frequency.low_pass(df, 4.0).count() == 5
    assert cluster.kmeans(df, 2, 2).count() == 4


def test_intermediate_tables_can_be_cleared(spark):
    from lumenframe import storage

    kept = storage.written(spark.range(3), "kept")
    assert kept.count() == 3 and storage.clear(spark) > 0 and storage.clear(spark) == 0
    with pytest.raises(Exception):
        kept.count()


def test_a_shared_folder_has_to_be_named_on_a_cluster():
    from types import SimpleNamespace

    from lumenframe import storage

    cluster_session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        storage.shared_dir(cluster_session)


def test_empty_tables(spark):
    empty = table(spark, IMAGE).limit(0)
    for op in OPERATORS.values():
        assert op(empty).count() == 0
    assert histogram.statistics(empty).count() == 0 and frequency.low_pass(empty).count() == 0
