import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lumenframe.llm import sharding


def brute(spark, df, shards, vnodes):
    nodes = sharding.ring(spark, shards, vnodes)
    points = [p for p, _ in nodes]
    rows = df.select("doc_id", "text", F.xxhash64(F.lit("row"), "doc_id", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))).alias("p")).collect()
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    last = points[-1]
    load, out = [0] * shards, Counter()
    for r in sorted(rows, key=lambda r: (r.p <= last, r.p)):
        at = next((i for i, p in enumerate(points) if p >= r.p), 0)
        while load[nodes[at][1]] == room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        out[r.doc_id, nodes[at][1]] += 1
        load[nodes[at][1]] += 1
    return out


def check(spark, df, n, shards=24, vnodes=16):
    got = sharding.assign(df, shards, vnodes).collect()
    assert len(got) == n
    loads = Counter(r.shard for r in got)
    assert n == 0 or max(loads[s] for s in range(shards)) - min(loads[s] for s in range(shards)) <= 1
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(loads[s]))
    assert Counter((r.doc_id, r.shard) for r in got) == brute(spark, df, shards, vnodes)
    return got


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in check(spark, df, len(texts)):
        assert r.size == len(texts[r.doc_id].encode()) + 8
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None


def test_edges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, i]), rng.choice([None, "", "same", "t%d" % i]), "x", 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, c int")
    check(spark, df, 300, 7, 4)
    check(spark, df.limit(0), 0)
    check(spark, df.limit(3), 3)


def test_little_moves_when_a_shard_is_added(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = {r.doc_id: r.shard for r in sharding.assign(df, 24).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign(df, 25).collect()}
    moved = sum(before[d] != after[d] for d in before)
    assert moved < 0.1 * len(before)  # 4 % have to


def test_hot_cells_are_cut_in_strands(spark):
    rows = [(None, "same")] * 700 + [(5, "t%d" % i) for i in range(300)] + [(i, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sharding.assign(df, 7, 16, hot_rows=50).collect()
    loads = Counter(r.shard for r in got)
    assert len(got) == 2000 and max(loads.values()) - min(loads.values()) <= 1
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(loads[s]))
    # cells that are not hot go where they went
    plain = {(r.doc_id, r.shard) for r in sharding.assign(df, 7, 16).collect() if r.doc_id not in (None, 5)}
    assert len(plain & {(r.doc_id, r.shard) for r in got}) == 999
