"""DuckDB SQL of the registered image queries, written as joins on offsets and plain sums.

Nothing here comes from the operators: kernels are formulas over offsets, transforms are sums of cosines and sines.
"""

from __future__ import annotations

from lumenframe.plans.fixtures import EM, EV, MX, RG, template_sql

IMAGES = {"ev": EV, "em": EM, "mx": MX, "rg": RG}
COLOR = ("b", "g", "r")


def query(images: str, body: str, more: str = "") -> str:
    """body over the named images, with more common tables after them."""
    return "WITH " + ", ".join([*(IMAGES[i] for i in images.split()), *([more] if more else [])]) + "\n" + body


def over(image: str, offsets: str, values: str, columns: tuple[str, ...] = ("v",), more: str = "") -> str:
    """Per pixel, `values` over its neighbours n at the given (dy, dx, ...) offsets o, the nearest pixel standing in outside."""
    rest = ", any_value(p.a) AS a" if columns != ("v",) else ""
    extra = f"""d AS (SELECT image_id, max(y) AS my, max(x) AS mx FROM {image} GROUP BY image_id),
o AS ({offsets}),
p AS (SELECT i.*, o.w, o.u, least(greatest(y + dy, 0), my) AS ny, least(greatest(x + dx, 0), mx) AS nx FROM {image} i JOIN d USING (image_id), o)""" + (", " + more if more else "")
    return query(image, f"""SELECT p.image_id, p.y, p.x, {values}{rest}
FROM p JOIN {image} n ON n.image_id = p.image_id AND n.y = p.ny AND n.x = p.nx
GROUP BY p.image_id, p.y, p.x""", extra)  # fmt: skip


def grid(size: int, where: str = "true", w: str = "1", u: str = "0") -> str:
    """Offsets of a square kernel that satisfy a condition, with two weights."""
    span = f"(SELECT unnest(range(-{size // 2}, {size // 2 + 1})) AS"
    return f"SELECT dy, dx, {w} AS w, {u} AS u FROM {span} dy), {span} dx) WHERE {where}"


def disk(size: int) -> str:
    return f"dy * dy + dx * dx <= {(size // 2) ** 2}"


def listed(weights: list[tuple[int, int, int]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({dy}, {dx}, {w}, 0)" for dy, dx, w in weights) + ") AS o(dy, dx, w, u)"


def each(columns: tuple[str, ...], text: str) -> str:
    return ", ".join(text.replace("#", c) + f" AS {c}" for c in columns)


def average(image: str, offsets: str, columns: tuple[str, ...] = ("v",)) -> str:
    return over(image, offsets, each(columns, "CAST(sum(n.#) // count(*) AS INTEGER)"), columns)


def extreme(image: str, offsets: str, name: str, columns: tuple[str, ...] = ("v",)) -> str:
    return over(image, offsets, each(columns, f"{name}(n.#)"), columns)


def gaussian(image: str, sigma: float, size: int, where: str = "true", columns: tuple[str, ...] = ("v",)) -> str:
    offsets = grid(size, where, f"exp(-(dy * dy + dx * dx) / (2.0 * {sigma} * {sigma}))")
    return over(image, offsets, each(columns, "CAST(trunc(least(255, greatest(0, round(sum(p.w * n.#) / sum(p.w), 6)))) AS INTEGER)"), columns)


def sobel(image: str, size: int) -> str:
    offsets = grid(size, "dy <> 0 OR dx <> 0", "CAST(dx AS DOUBLE) / (dy * dy + dx * dx)", "CAST(dy AS DOUBLE) / (dy * dy + dx * dx)")
    return over(image, offsets, "CAST(trunc(least(255, round(sqrt(power(sum(p.w * n.v), 2) + power(sum(p.u * n.v), 2)), 6))) AS INTEGER) AS v")


def twice(image: str, size: int, first: str, second: str) -> str:
    """Opening or closing: two extremes over a square."""
    c = size // 2
    return query(image, f"""SELECT p.image_id, p.y, p.x, {second}(n.v) AS v FROM f p JOIN f n
ON n.image_id = p.image_id AND n.y BETWEEN p.y - {c} AND p.y + {c} AND n.x BETWEEN p.x - {c} AND p.x + {c} GROUP BY p.image_id, p.y, p.x""",
        f"""f AS (SELECT p.image_id, p.y, p.x, {first}(n.v) AS v FROM {image} p JOIN {image} n
ON n.image_id = p.image_id AND n.y BETWEEN p.y - {c} AND p.y + {c} AND n.x BETWEEN p.x - {c} AND p.x + {c} GROUP BY p.image_id, p.y, p.x)""")  # fmt: skip


HIST = "h AS (SELECT image_id, v, count(*) AS c FROM {0} GROUP BY image_id, v)"
OTSU = (
    HIST
    + """, s AS (SELECT image_id, v, sum(c) OVER u AS wb, sum(v * c) OVER u AS sb, sum(c) OVER a AS n, sum(v * c) OVER a AS st FROM h
  WINDOW u AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id)),
q AS (SELECT image_id, v, CASE WHEN n > wb THEN CAST(wb AS DOUBLE) * CAST(n - wb AS DOUBLE)
  * power(CAST(sb AS DOUBLE) / CAST(wb AS DOUBLE) - CAST(st - sb AS DOUBLE) / CAST(n - wb AS DOUBLE), 2) ELSE 0 END AS var FROM s),
k AS (SELECT image_id, CASE WHEN max(var) > 0 THEN min(v) FILTER (var = m) ELSE 0 END AS threshold
  FROM (SELECT *, max(var) OVER (PARTITION BY image_id) AS m FROM q) GROUP BY image_id)"""
)
PLANES = "pl AS (SELECT image_id, y, x, 'B' AS channel, b AS v FROM rg UNION ALL SELECT image_id, y, x, 'G', g FROM rg UNION ALL SELECT image_id, y, x, 'R', r FROM rg UNION ALL SELECT image_id, y, x, 'A', a FROM rg)"


def remap(keys: str) -> str:
    return f"""e AS (SELECT {keys}, v, CASE WHEN n > low THEN CAST(round(CAST(cdf - low AS DOUBLE) / CAST(n - low AS DOUBLE) * 255) AS INTEGER) ELSE 0 END AS e
  FROM (SELECT *, min(cdf) OVER (PARTITION BY {keys}) AS low FROM (SELECT {keys}, v, sum(c) OVER (PARTITION BY {keys} ORDER BY v) AS cdf,
  sum(c) OVER (PARTITION BY {keys}) AS n FROM h)))"""


def places(method: str, size: int = 8) -> str:
    """Scores of all places of the template in the event image."""
    score = {
        "SAD": "CAST(sum(abs(p.v - t.tv)) AS BIGINT)",
        "SSD": "CAST(sum((p.v - t.tv) * (p.v - t.tv)) AS BIGINT)",
        "NCC": """CASE WHEN (count(*) * sum(p.v * p.v) - sum(p.v) * sum(p.v)) * (count(*) * sum(t.tv * t.tv) - sum(t.tv) * sum(t.tv)) > 0
  THEN CAST(count(*) * sum(p.v * t.tv) - sum(p.v) * sum(t.tv) AS DOUBLE) / sqrt(CAST((count(*) * sum(p.v * p.v) - sum(p.v) * sum(p.v))
  * (count(*) * sum(t.tv * t.tv) - sum(t.tv) * sum(t.tv)) AS DOUBLE)) ELSE 0 END""",
    }[method]
    return template_sql(size) + f""", sc AS (SELECT p.image_id, CAST(p.y - t.ty AS INTEGER) AS y, CAST(p.x - t.tx AS INTEGER) AS x, {score} AS score FROM ev p CROSS JOIN t
  WHERE p.y >= t.ty AND p.x >= t.tx GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM t))"""  # fmt: skip


def best(method: str, size: int = 8) -> str:
    order = "round(score, 9) DESC" if method == "NCC" else "score"
    return places(method, size) + f", bm AS (SELECT image_id, y AS best_y, x AS best_x, score FROM sc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {order}, y, x) = 1)"


#: The 8 x 8 transform of the embedding images as sums of cosines and sines.
DFT = """s8 AS (SELECT unnest(range(8)) AS k),
f AS (SELECT image_id, u.k AS ky, w.k AS kx, sum(v * cos(2 * pi() * (u.k * y + w.k * x) / 8)) AS re, -sum(v * sin(2 * pi() * (u.k * y + w.k * x) / 8)) AS im
  FROM em, s8 u, s8 w GROUP BY image_id, u.k, w.k),
m AS (SELECT *, sqrt(re * re + im * im) AS mag, sqrt(power((kx + 4) % 8 - 4, 2) + power((ky + 4) % 8 - 4, 2)) AS dist FROM f)"""


def filtered(keep: str) -> str:
    return query("em", f"""SELECT p.image_id, p.y, p.x, CAST(trunc(least(255, greatest(0, round(coalesce(z.v, 0), 6)))) AS INTEGER) AS v FROM em p LEFT JOIN z
ON z.image_id = p.image_id AND z.y = p.y AND z.x = p.x""", DFT + f""", z AS (SELECT image_id, y.k AS y, x.k AS x,
  sum(re * cos(2 * pi() * (ky * y.k + kx * x.k) / 8) - im * sin(2 * pi() * (ky * y.k + kx * x.k) / 8)) / 64 AS v
  FROM m, s8 y, s8 x WHERE {keep} GROUP BY image_id, y.k, x.k)""")  # fmt: skip


def dft(image: str, value: str = "v") -> str:
    """The transform of images of any size in the middle of black ones whose sides are powers of two, row by row and then
    column by column: dm (sides), f (ky, kx, re, im), m (with magnitude and distance from the middle, shifted)."""
    power = lambda n: f"CAST(power(2, ceil(log2({n}))) AS BIGINT)"
    return f"""ds AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, {power('max(y) + 1')} AS ph, {power('max(x) + 1')} AS pw FROM {image} GROUP BY image_id),
dm AS (SELECT *, (ph - h) // 2 AS top, (pw - w) // 2 AS lft FROM ds), ks AS (SELECT unnest(range(0, (SELECT max(greatest(ph, pw)) FROM dm))) AS k),
fr AS MATERIALIZED (SELECT i.image_id, y + top AS yy, k AS kx, sum({value} * cos(2 * pi() * k * (x + lft) / pw)) AS re, -sum({value} * sin(2 * pi() * k * (x + lft) / pw)) AS im
  FROM {image} i JOIN dm ON dm.image_id = i.image_id JOIN ks ON k < pw GROUP BY ALL),
f AS MATERIALIZED (SELECT fr.image_id, k AS ky, kx, sum(re * cos(2 * pi() * k * yy / ph) + im * sin(2 * pi() * k * yy / ph)) AS re,
  sum(im * cos(2 * pi() * k * yy / ph) - re * sin(2 * pi() * k * yy / ph)) AS im FROM fr JOIN dm ON dm.image_id = fr.image_id JOIN ks ON k < ph GROUP BY ALL),
m AS (SELECT f.*, ph, pw, sqrt(re * re + im * im) AS mag, (ky + ph // 2) % ph AS sy, (kx + pw // 2) % pw AS sx,
  sqrt(power((kx + pw // 2) % pw - pw // 2, 2) + power((ky + ph // 2) % ph - ph // 2, 2)) AS dist FROM f JOIN dm ON dm.image_id = f.image_id)"""  # fmt: skip


def passed(image: str, keep: str) -> str:
    """An image of the bins that are kept."""
    return query(image, f"""SELECT p.image_id, p.y, p.x, CAST(trunc(least(255, greatest(0, round(coalesce(z.v, 0), 6)))) AS INTEGER) AS v
FROM {image} p LEFT JOIN z ON z.image_id = p.image_id AND z.y = p.y AND z.x = p.x""", dft(image) + f""",
zc AS MATERIALIZED (SELECT m.image_id, i.y, kx, sum(re * cos(2 * pi() * ky * (i.y + top) / m.ph) - im * sin(2 * pi() * ky * (i.y + top) / m.ph)) AS re,
  sum(re * sin(2 * pi() * ky * (i.y + top) / m.ph) + im * cos(2 * pi() * ky * (i.y + top) / m.ph)) AS im
  FROM m JOIN dm ON dm.image_id = m.image_id JOIN (SELECT DISTINCT image_id, y FROM {image}) i ON i.image_id = m.image_id WHERE {keep} GROUP BY ALL),
z AS (SELECT zc.image_id, zc.y, i.x, sum(re * cos(2 * pi() * kx * (i.x + lft) / pw) - im * sin(2 * pi() * kx * (i.x + lft) / pw)) / (any_value(ph) * any_value(pw)) AS v
  FROM zc JOIN dm ON dm.image_id = zc.image_id JOIN (SELECT DISTINCT image_id, x FROM {image}) i ON i.image_id = zc.image_id GROUP BY ALL)""")  # fmt: skip


#: Pixels of the spectrum and of the phase, before they are cut back.
SPECTRUM = "CAST(trunc(round(CASE WHEN max(mag) OVER (PARTITION BY image_id) > 0 THEN log10(1 + mag) / max(log10(1 + mag)) OVER (PARTITION BY image_id) * 255 ELSE 0 END, 6)) AS INTEGER)"
PHASE = "CAST(trunc(round((CASE WHEN mag < 1e-6 THEN 0 ELSE atan2(CASE WHEN abs(im) < 1e-9 THEN 0.0 ELSE im END, re) END + pi()) / (2 * pi()) * 255, 6)) AS INTEGER)"


def shown(image: str, value: str, y: str, x: str) -> str:
    """Pixels of a transform at the image's own places."""
    return f"""SELECT i.image_id, i.y, i.x, s.v FROM (SELECT DISTINCT image_id, y, x FROM {image}) i JOIN dm ON dm.image_id = i.image_id
JOIN (SELECT image_id, {y} AS yy, {x} AS xx, {value} AS v FROM m) s ON s.image_id = i.image_id AND s.yy = i.y + top AND s.xx = i.x + lft"""  # fmt: skip


def label(count: str) -> str:
    """A count as text, thousands and millions with a tenth at most."""
    tenths = lambda unit, suffix: f"regexp_replace(CAST(CAST(({count} * 10 + {unit // 2}) // {unit} AS DECIMAL(18, 1)) / 10 AS VARCHAR), '\\.0*$', '') || '{suffix}'"
    return f"CASE WHEN {count} >= 1000000 THEN {tenths(1000000, 'M')} WHEN {count} >= 1000 THEN {tenths(1000, 'K')} ELSE CAST({count} AS VARCHAR) END"


def lloyd(image: str, k: int, iterations: int, location: bool) -> tuple[str, str]:
    """(common tables, name of the last step): assignments a1.. and centroids c1.. from the first k pixels."""
    f = ["f0", "f1", "f2", "f3", "f4"][: 5 if location else 3]
    color = ", ".join(f"CAST({c} AS DOUBLE){' / 255.0' if location else ''} AS f{i}" for i, c in enumerate("rgb"))
    place = ", CAST(x AS DOUBLE) / (SELECT greatest(1, max(x)) FROM {0}) AS f3, CAST(y AS DOUBLE) / (SELECT greatest(1, max(y)) FROM {0}) AS f4".format(image) if location else ""
    out = [f"px AS (SELECT *, {color}{place} FROM {image})", f"c0 AS (SELECT row_number() OVER (ORDER BY y, x) - 1 AS cid, {', '.join(f)} FROM px ORDER BY y, x LIMIT {k})"]
    for n in range(1, iterations + 1):
        far = " + ".join(f"(p.{d} - c.{d}) * (p.{d} - c.{d})" for d in f)
        out.append(f"a{n} AS MATERIALIZED (SELECT image_id, y, x, {', '.join(f)}, cid FROM (SELECT p.*, c.cid, row_number() OVER (PARTITION BY p.y, p.x ORDER BY {far}, c.cid) AS rn FROM px p, c{n - 1} c) WHERE rn = 1)")
        out.append(f"c{n} AS (SELECT c.cid, {', '.join(f'coalesce(avg_{d}, c.{d}) AS {d}' for d in f)} FROM c{n - 1} c LEFT JOIN (SELECT cid, {', '.join(f'sum({d}) / count(*) AS avg_{d}' for d in f)} FROM a{n} GROUP BY cid) s ON s.cid = c.cid)")
    return ", ".join(out), str(iterations)


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["brightness_clamp"] = query("ev", "SELECT image_id, y, x, CAST(least(255, greatest(0, v + 100)) AS INTEGER) AS v FROM ev")
    q["binarize_128"] = query("ev", "SELECT image_id, y, x, CASE WHEN v > 128 THEN 255 ELSE 0 END AS v FROM ev")
    q["otsu_threshold"] = query("em", "SELECT image_id, threshold FROM k", OTSU.format("em"))
    q["otsu_binarize"] = query("ev", "SELECT image_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM ev JOIN k USING (image_id)", OTSU.format("ev"))
    q["grayscale"] = query("rg", "SELECT image_id, y, x, CAST((299 * r + 587 * g + 114 * b) // 1000 AS INTEGER) AS v FROM rg")
    q["channel_unpivot"] = query("rg", "SELECT image_id, y, x, channel, v FROM pl", PLANES)
    q["channel_merge"] = query("rg", "SELECT image_id, y, x, b, g, r, 255 AS a FROM rg")
    q["crop_roi"] = query("ev", "SELECT image_id, y - 3 AS y, x - 5 AS x, v FROM ev WHERE y BETWEEN 3 AND 22 AND x BETWEEN 5 AND 19")
    q["pad_replicate"] = query("em", """SELECT image_id, yy AS y, xx AS x, v FROM (SELECT image_id, CAST(a AS INTEGER) AS yy, CAST(b AS INTEGER) AS xx FROM (SELECT DISTINCT image_id FROM em),
(SELECT unnest(range(12)) AS a), (SELECT unnest(range(12)) AS b)) g JOIN em USING (image_id) WHERE y = least(7, greatest(0, yy - 2)) AND x = least(7, greatest(0, xx - 2))""")  # fmt: skip
    q["unpad"] = query("em", "SELECT image_id, y - 2 AS y, x - 2 AS x, v FROM em WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
    q["pad_pow2_center"] = query("ev", "SELECT CAST(0 AS BIGINT) AS image_id, gy AS y, gx AS x, coalesce(v, 0) AS v FROM g LEFT JOIN ev ON ev.y = gy - top AND ev.x = gx - lft",
        "s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w, CAST(power(2, ceil(log2(max(y) + 1))) AS BIGINT) AS ph, CAST(power(2, ceil(log2(max(x) + 1))) AS BIGINT) AS pw FROM ev), g AS (SELECT CAST(a AS INTEGER) AS gy, CAST(b AS INTEGER) AS gx, (ph - h) // 2 AS top, (pw - w) // 2 AS lft FROM s, (SELECT unnest(range(ph)) AS a FROM s), (SELECT unnest(range(pw)) AS b FROM s))")
    q["downscale_4"] = query("ev", "SELECT image_id, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, CAST(sum(v) // count(*) AS INTEGER) AS v FROM ev GROUP BY ALL")
    q["histogram_gray"] = query("ev", "SELECT image_id, v, c AS count FROM h", HIST.format("ev"))
    q["histogram_dense_256"] = query("em", "SELECT i.image_id, b.v, coalesce(c, 0) AS count FROM (SELECT DISTINCT image_id FROM em) i, (SELECT CAST(unnest(range(256)) AS INTEGER) AS v) b LEFT JOIN h ON h.image_id = i.image_id AND h.v = b.v", HIST.format("em"))
    q["histogram_channels"] = query("rg", "SELECT image_id, channel, v, count(*) AS count FROM pl GROUP BY ALL", PLANES)
    q["hist_stats"] = query("em", "SELECT image_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM em GROUP BY image_id")
    q["hist_median_mode_range"] = query("em", """SELECT image_id, min(CASE WHEN n // 2 = 0 THEN 0 WHEN cum >= n // 2 THEN v END) AS median, arg_min(v, -c * 1000 + v) AS mode, min(v) AS min, max(v) AS max,
CAST(max(v) - min(v) AS INTEGER) AS range, max(c) AS max_count FROM (SELECT *, sum(c) OVER (PARTITION BY image_id ORDER BY v) AS cum, sum(c) OVER (PARTITION BY image_id) AS n FROM h) GROUP BY image_id""", HIST.format("em"))  # fmt: skip
    q["equalize_gray"] = query("ev", "SELECT image_id, y, x, e AS v FROM ev JOIN e USING (image_id, v)", HIST.format("ev") + ", " + remap("image_id"))
    q["equalize_color"] = query("rg", "SELECT rg.image_id, y, x, eb.e AS b, eg.e AS g, er.e AS r, 255 AS a FROM rg JOIN e eb ON eb.channel = 'B' AND eb.v = b JOIN e eg ON eg.channel = 'G' AND eg.v = g JOIN e er ON er.channel = 'R' AND er.v = r",
        PLANES + ", h AS (SELECT image_id, channel, v, count(*) AS c FROM pl GROUP BY ALL), " + remap("image_id, channel"))
    q["differential"] = query("ev", "SELECT p.image_id, p.y, p.x, CASE WHEN r.v IS NULL OR d.v IS NULL THEN 0 ELSE least(255, abs(r.v - p.v) + abs(d.v - p.v)) END AS v FROM ev p LEFT JOIN ev r ON r.y = p.y AND r.x = p.x + 1 LEFT JOIN ev d ON d.y = p.y + 1 AND d.x = p.x")
    for k in (3, 5):
        q[f"average_blur_{k}"] = average("ev", grid(k))
        q[f"laplacian_{k}"] = over("ev", grid(k), "CAST(least(255, greatest(0, sum(n.v) - count(*) * any_value(p.v))) AS INTEGER) AS v")
        q[f"sobel_{k}"] = sobel("ev", k)
    q["average_blur_disk_5"] = average("em", grid(5, disk(5)))
    q["average_blur_color_3"] = average("rg", grid(3), COLOR)
    q["gaussian_3"] = gaussian("ev", 1.0, 3)
    q["gaussian_disk_5"] = gaussian("ev", 1.5, 5, disk(5))
    q["gaussian_color_3"] = gaussian("rg", 1.0, 3, columns=COLOR)
    q["convolve_sharpen"] = over("ev", listed([(0, 0, 5), (-1, 0, -1), (1, 0, -1), (0, -1, -1), (0, 1, -1)]), "CAST(least(255, greatest(0, sum(p.w * n.v))) AS INTEGER) AS v")
    q["convolve_color"] = over("rg", listed([(0, 0, 2), (-1, 0, 1), (0, 1, 1)]), each(COLOR, "CAST(sum(p.w * n.#) // 4 AS INTEGER)"), COLOR)
    for name, fn in (("dilate", "max"), ("erode", "min")):
        q[f"{name}_3"] = extreme("ev", grid(3), fn)
        q[f"{name}_disk_5"] = extreme("ev", grid(5, disk(5)), fn)
        q[f"{name}_color_3"] = extreme("rg", grid(3), fn, COLOR)
    q["opening_3"], q["closing_3"] = twice("ev", 3, "min", "max"), twice("ev", 3, "max", "min")
    q["match_score_map_sad"] = query("ev", "SELECT image_id, y, x, score FROM sc", places("SAD"))
    for m, size in (("SAD", 8), ("SSD", 8), ("NCC", 8), ("NCC", 32), ("SAD", 65), ("SSD", 65)):
        q[f"match_{m.lower()}" + (f"_{size}" if size > 8 else "")] = query("ev", "SELECT image_id, best_y, best_x, round(CAST(score AS DOUBLE), 9) AS score FROM bm", best(m, size))
    q["draw_box"] = query("ev", """SELECT ev.image_id, y, x, CAST(CASE WHEN i AND l THEN 0 WHEN i THEN v * 191 // 255 ELSE v END AS INTEGER) AS b, CAST(CASE WHEN i AND l THEN 0 WHEN i THEN v * 191 // 255 ELSE v END AS INTEGER) AS g,
CAST(CASE WHEN i AND l THEN 255 WHEN i THEN (v * 191 + 255 * 64) // 255 ELSE v END AS INTEGER) AS r, 255 AS a
FROM (SELECT ev.*, y - best_y BETWEEN 0 AND 7 AND x - best_x BETWEEN 0 AND 7 AS i, y - best_y < 2 OR y - best_y > 5 OR x - best_x < 2 OR x - best_x > 5 AS l FROM ev JOIN bm USING (image_id)) ev""", best("SAD"))  # fmt: skip
    q["fft_lowpass"], q["fft_highpass"] = filtered("dist <= 2"), filtered("dist > 2")
    q["fft_bandstop"] = filtered("NOT (dist > 1.5 AND mag > 0 AND ln(mag) > 4)")
    q["fft_spectrum"] = query("em", "SELECT image_id, CAST((ky + 4) % 8 AS INTEGER) AS y, CAST((kx + 4) % 8 AS INTEGER) AS x, CAST(trunc(round(log10(1 + mag) / max(log10(1 + mag)) OVER (PARTITION BY image_id) * 255, 6)) AS INTEGER) AS v FROM m", DFT)
    q["fft_phase"] = query("em", """SELECT image_id, CAST(ky AS INTEGER) AS y, CAST(kx AS INTEGER) AS x,
CAST(trunc(round((CASE WHEN mag < 1e-6 THEN 0 ELSE atan2(CASE WHEN abs(im) < 1e-9 THEN 0.0 ELSE im END, re) END + pi()) / (2 * pi()) * 255, 6)) AS INTEGER) AS v FROM m""", DFT)  # fmt: skip
    q["fft_lowpass_padded"], q["fft_highpass_mixed"] = passed("ev", "dist <= least(m.ph, m.pw) / 2.0 * 0.2"), passed("mx", "dist > least(m.ph, m.pw) / 2.0 * 0.5")
    q["fft_spectrum_mixed"] = query("mx", shown("mx", SPECTRUM, "sy", "sx"), dft("mx"))
    q["fft_phase_mixed"] = query("mx", shown("mx", PHASE, "ky", "kx"), dft("mx"))
    planes = " UNION ALL ".join(f"SELECT '{c.upper()}' AS image_id, y, x, {c} AS v FROM rg" for c in COLOR)
    q["fft_color"] = query("rg", f"SELECT CAST(0 AS BIGINT) AS image_id, y, x, any_value(v) FILTER (image_id = 'B') AS b, any_value(v) FILTER (image_id = 'G') AS g, any_value(v) FILTER (image_id = 'R') AS r, 255 AS a FROM ({shown('c3', SPECTRUM, 'sy', 'sx')}) GROUP BY y, x",
        f"c3 AS ({planes}), " + dft("c3"))
    with_rgb, n = lloyd("rg", 4, 20, False)
    paint = ", ".join(f"CAST(trunc(round(c.f{i} * {{0}}, 6)) AS INTEGER) AS {c}" for i, c in enumerate("rgb"))
    q["kmeans_rgb_20iter"] = query("rg", f"SELECT p.image_id, p.y, p.x, {paint.format('1.0')}, rg.a FROM a{n} p JOIN c{n} c ON c.cid = p.cid JOIN rg ON rg.y = p.y AND rg.x = p.x", with_rgb)
    with_xy, n = lloyd("rg", 4, 3, True)
    q["kmeans_rgbxy_painted"] = query("rg", f"SELECT p.image_id, p.y, p.x, {paint.format('255.0')}, rg.a FROM a{n} p JOIN c{n} c ON c.cid = p.cid JOIN rg ON rg.y = p.y AND rg.x = p.x", with_xy)
    with_rgb, n = lloyd("rg", 4, 3, False)
    paint = ", ".join(f"CAST(trunc(round(c.f{i} * {{0}}, 6)) AS INTEGER) AS {c}" for i, c in enumerate("rgb"))
    q["kmeans_rgb_3iter"] = query("rg", f"SELECT p.image_id, p.y, p.x, {paint.format('1.0')}, rg.a FROM a{n} p JOIN c{n} c ON c.cid = p.cid JOIN rg ON rg.y = p.y AND rg.x = p.x", with_rgb)
    q["kmeans_rgb_centroids"] = query("rg", f"SELECT CAST(0 AS BIGINT) AS image_id, CAST(cid AS INTEGER) AS cid, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM c{n}", with_rgb)
    with_xy, n = lloyd("rg", 4, 3, True)
    q["kmeans_rgbxy_3iter"] = query("rg", f"SELECT CAST(0 AS BIGINT) AS image_id, CAST(cid AS INTEGER) AS cid, {', '.join(f'round({d}, 6) AS {d}' for d in ('f0', 'f1', 'f2', 'f3', 'f4'))} FROM c{n}", with_xy)
    line = "'[' || strftime(ts, '%H:%M:%S') || '] ' || event_type || ' (' || printf('%.2f', value) || ' ms)'"
    q["history_parse"] = f"WITH l AS (SELECT {line} AS t FROM events UNION ALL SELECT 'no such form') SELECT CASE WHEN m THEN regexp_extract(t, '\\[(.*?)\\] (.*?) \\((\\d+\\.\\d{{2}}) ms\\)', 1) ELSE '' END AS time, CASE WHEN m THEN regexp_extract(t, '\\[(.*?)\\] (.*?) \\((\\d+\\.\\d{{2}}) ms\\)', 2) ELSE t END AS operation, CASE WHEN m THEN regexp_extract(t, '\\[(.*?)\\] (.*?) \\((\\d+\\.\\d{{2}}) ms\\)', 3) ELSE '' END AS elapsed FROM (SELECT t, regexp_matches(t, '\\[(.*?)\\] (.*?) \\((\\d+\\.\\d{{2}}) ms\\)') AS m FROM l)"
    q["log_parse"] = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 'INFO' AS level, event_type || ' applied.' AS message FROM events UNION ALL SELECT '', '', 'no such form'"
    gray_blur = "g AS (SELECT image_id, y, x, CAST((299 * r + 587 * g + 114 * b) // 1000 AS INTEGER) AS v FROM rg), gd AS (SELECT max(y) AS my, max(x) AS mx FROM g), gb AS (SELECT p.image_id, p.y, p.x, CAST(sum(n.v) // 9 AS INTEGER) AS v FROM (SELECT g.*, least(greatest(y + dy, 0), my) AS ny, least(greatest(x + dx, 0), mx) AS nx FROM g, gd, (SELECT unnest([-1, 0, 1]) AS dy) oy, (SELECT unnest([-1, 0, 1]) AS dx) ox) p JOIN g n ON n.y = p.ny AND n.x = p.nx GROUP BY p.image_id, p.y, p.x), "
    q["pipeline_gray_blur_otsu"] = query("rg", "SELECT image_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM gb JOIN k USING (image_id)", gray_blur + OTSU.format("gb"))
    q["blob_round_trip"] = query("em", "SELECT image_id, y, x, v FROM em")
    q["histogram_bars"] = query("em", f"SELECT image_id, v, c AS count, round(CAST(c AS DOUBLE) / max(c) OVER (PARTITION BY image_id) * 200, 6) AS height, {label('c')} AS label FROM h", HIST.format("em"))
    q["histogram_ticks"] = query("ev", f"SELECT image_id, tick, count, {label('count')} AS label FROM (SELECT image_id, tick, CAST(m * (3 - tick) // 3 AS BIGINT) AS count FROM (SELECT image_id, max(c) AS m FROM h GROUP BY image_id), (SELECT CAST(unnest(range(4)) AS INTEGER) AS tick))", HIST.format("ev"))
    q["image_files"] = query("rg", "SELECT y, x, CAST((299 * r + 587 * g + 114 * b) // 1000 AS INTEGER) AS v FROM rg")
    q["csv_export"] = "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type || chr(34) || ',' || chr(10) || event_type AS text FROM events"
    q["stream_histograms"] = q["histogram_gray"]
    # commands by name, with the parameters that the catalog gives them
    own = {
        "Bin": "binarize_128", "Bright": "brightness_clamp", "Bin_Otsu": "otsu_binarize", "Equal": "equalize_gray", "Diff": "differential", "Sobel": "sobel_3", "Laplace": "laplacian_3",
        "Average": "average_blur_3", "Gaussian": "gaussian_3", "Dilation": "dilate_3", "Erosion": "erode_3", "Opening": "opening_3", "Closing": "closing_3", "Gray": "grayscale",
        "Equal_color": "equalize_color", "FFT": "fft_spectrum", "FFT_Low": "fft_lowpass", "FFT_High": "fft_highpass", "FFT_Band": "fft_bandstop",
    }
    q |= {f"command_{name}": q[sql] for name, sql in own.items()}
    for m in ("NCC", "SAD", "SSD"):
        q[f"command_{m}"] = q["draw_box"].replace(best("SAD"), best(m))
    return q
