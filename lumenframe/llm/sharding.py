"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame expressions only.

Every shard owns `vnodes` points of a ring of 64-bit hashes, and every row a point given by its id (rows without an
id: by their text).  A row belongs to the next point clockwise.  Rows enter in ring order; one whose shard is full
goes on clockwise to the next point whose shard has room.  Capacities add up to the rows exactly and differ by one at
most, so the counts of the shards do too (the law `rows`).

Only counts of ring cells reach the driver, at most `CELLS + shards * vnodes` of them whatever the input; the table
of placements that is broadcast back is bounded likewise.  Ranks are taken inside a cell.  A cell of more than `hot_rows` rows, as many
rows of one id make it, or many of one text without an id, is cut into STRANDS strands, by a hash of the rows' places in the table, which enter one after
another; so no task gathers more than a strand.  Nulls in the id or the text, equal texts and empty tables need no care;
rows that agree in id and text are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import read, written

SHARDS, VNODES, CELLS, STRANDS, HOT_ROWS = 24, 128, 1 << 14, 64, 1_000_000


def ring(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, in ring order."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("s"), F.floor(F.col("id") / shards).cast("int").alias("v"))
    return sorted((r.p, r.s) for r in nodes.select(F.xxhash64(F.lit("node"), "s", "v").alias("p"), "s").collect())


def place(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each arc, (first rank, end rank, shard, slot of the first) of the runs its rows are cut into.

    Arcs are taken in ring order; what a full shard can't take goes on clockwise."""
    m, used, onward = len(owners), [0] * len(room), list(range(len(owners)))

    def open_from(i: int) -> int:
        path = []
        while room[owners[i]] == used[owners[i]]:
            path.append(i)
            i = (onward[i] if onward[i] != i else i + 1) % m
        for j in path:
            onward[j] = i
        return i

    runs = []
    for arc, n in enumerate(counts):
        done, own = 0, []
        at = arc
        while done < n:
            at = open_from(at)
            shard = owners[at]
            take = min(n - done, room[shard] - used[shard])
            own.append((done, done + take, shard, used[shard]))
            used[shard] += take
            done += take
        runs.append(own)
    return runs


def _cell(point: Column) -> Column:
    """The ring in CELLS equal parts, in ring order: the high bits of the point with the sign turned."""
    return (F.shiftright(point, 50) + F.lit(CELLS // 2)).cast("int")


def assign(df: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of df."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(key),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit("row"), F.col(key), F.when(F.col(key).isNull(), body)).alias("p"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(STRANDS)).cast("int").alias("s"),
    )
    narrow = written(narrow, "shard-rows")

    nodes = ring(spark, shards, vnodes)
    points = [p for p, _ in nodes]
    # a cell that holds points is cut at them: (cell, points in it, arc of its start)
    inside: dict[int, list[int]] = {}
    for p in points:
        inside.setdefault((p >> 50) + CELLS // 2, []).append(p)
    cells, before = [], 0
    for c in range(CELLS):
        own = inside.get(c, [])
        cells.append((c, own, before))
        before += len(own)
    table = spark.createDataFrame(cells, "c int, cuts array<long>, arc0 int")
    at = narrow.withColumn("c", _cell(F.col("p"))).join(F.broadcast(table), "c")
    # the arc's last point is the first one not below the row; beyond the last point the ring begins anew
    arced = at.withColumn("arc", (F.col("arc0") + F.size(F.filter("cuts", lambda x: x < F.col("p")))) % F.lit(len(points))).drop("cuts", "arc0")

    # in ring order the cells after the last point come before the others of arc 0
    wraps = (points[-1] >> 50) + CELLS // 2
    counted = arced.groupBy("arc", "c").count().collect()
    hot = [(r["arc"], r["c"]) for r in counted if r["count"] > hot_rows]
    cut = spark.createDataFrame([(a, c, True) for a, c in hot], "arc int, c int, hot boolean")
    arced = arced.join(F.broadcast(cut), ["arc", "c"], "left").withColumn("s", F.when(F.col("hot"), F.col("s")).otherwise(0)).drop("hot")
    if hot:
        parts = arced.join(F.broadcast(cut), ["arc", "c"], "left_semi").groupBy("arc", "c", "s").count().collect()
        counted = [(r["arc"], r["c"], 0, r["count"]) for r in counted if (r["arc"], r["c"]) not in set(hot)] + [tuple(r) for r in parts]
    else:
        counted = [(r["arc"], r["c"], 0, r["count"]) for r in counted]
    by_arc: dict[int, list[tuple[int, int, int]]] = {}
    for arc, c, strand, n in counted:
        by_arc.setdefault(arc, []).append((c, strand, n))
    total = sum(r[3] for r in counted)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    runs = place([sum(n for _, _, n in by_arc.get(a, [])) for a in range(len(points))], [s for _, s in nodes], room)
    placed = []
    for arc, own in by_arc.items():
        first = 0
        for c, strand, n in sorted(own, key=lambda x: (arc == 0 and x[0] < wraps, x)):
            placed.append((arc, c, strand, first, [r for r in runs[arc] if r[0] < first + n and r[1] > first]))
            first += n
    plan = spark.createDataFrame(placed, "arc int, c int, s int, first long, runs array<struct<a:long,b:long,shard:int,slot:long>>")

    ranked = arced.withColumn("k", F.row_number().over(Window.partitionBy("arc", "c", "s").orderBy("p", key, "size", "text_crc32")) - 1)
    joined = ranked.join(F.broadcast(plan), ["arc", "c", "s"]).withColumn("rank", F.col("first") + F.col("k"))
    run = F.filter("runs", lambda r: (F.col("rank") >= r["a"]) & (F.col("rank") < r["b"]))[0]
    return joined.withColumn("run", run).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"),
        (F.col("run.slot") + F.col("rank") - F.col("run.a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))
