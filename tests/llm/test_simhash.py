import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from lumenframe.llm import simhash
from lumenframe.llm.graph import Union, components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    x = np.array(distinct, np.uint64)
    union = Union()
    for i, p in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(x ^ np.uint64(p)) <= 2):
            union.join(i, int(j))
    roots = [union.find(distinct.index(p)) for p in prints]
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, format(p, "016x"), least.get(r)) for (d, _), p, r in zip(rows, prints, roots, strict=True)), key=str)


def got(spark, df):
    from pyspark.sql import functions as F

    found = simhash.near_duplicates(df)
    return sorted((tuple(r) for r in found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()), key=str)


def test_documents(spark):
    from lumenframe.llm.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op10_simhash"](spark, sf)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_edges(spark):
    rng = random.Random(1)
    base = ["w%d" % rng.randrange(50) for _ in range(300)]
    rows = [(None, None), (3, ""), (7, " \n"), (8, "one"), (8, "one"), (9, "ONE"), (10, "one two"), (None, "é È"), (11, "x " * 50000), (None, "lone words here and there")]
    for i in range(120):
        words = base[:]
        words[rng.randrange(300)] = "changed%d" % i
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, fp int, root string")
    assert got(spark, df) == brute(rows)
    assert got(spark, df.limit(0)) == []


def points(seed, n, spread):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64) if not out or rng.random() < 0.05 else rng.choice(sorted(out)[:50])
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def joined(pairs):
    union = Union()
    for a, b in pairs:
        union.join(a, b)
    return union


def test_every_close_pair_meets_at_an_anchor():
    x = points(4, 400, 4)
    row, anchor = simhash.anchors(x)
    at = {}
    for r, a in zip(row.tolist(), anchor.tolist(), strict=True):
        at.setdefault(r, set()).add(a)
    assert max(map(len, at.values())) <= 29
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2):
            assert at[i] & at[int(j)]


def test_large_groups_are_linked_alike(monkeypatch):
    x = points(9, 700, 4)
    want = joined((int(a), int(b)) for a in x for b in x[np.bitwise_count(x ^ a) <= 2] if a != b)
    small = joined(simhash.linked(x))
    monkeypatch.setattr(simhash, "HOT_GROUP", 100)
    keys = np.zeros(len(x), np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 90]), pa.array(x[i : i + 90].view(np.int64))], names=["k", "fp"]) for i in range(0, len(x), 90)]
    batches.append(pa.RecordBatch.from_arrays([pa.array(np.array([5, 5])), pa.array(np.array([1, 2]))], names=["k", "fp"]))
    out = pa.Table.from_batches(list(simhash._compare(iter(batches)))).to_pylist()
    assert [r for r in out if r["z"] is None] == [{"z": None, "a": 1, "b": 2}]
    dealt = sorted((r["z"], r["a"]) for r in out if r["z"] is not None)
    again = list(simhash._meet(iter([pa.RecordBatch.from_arrays([pa.array([z for z, _ in dealt]), pa.array([a for _, a in dealt])], names=["z", "a"])])))
    hot = joined((int(np.int64(r["a"]).view(np.uint64)), int(np.int64(r["b"]).view(np.uint64))) for r in pa.Table.from_batches(again).to_pylist())
    for v in x.tolist():
        assert small.find(v) == want.find(v) == hot.find(v)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(rng.randrange(2000, 4000), rng.randrange(2000, 4000)) for _ in range(900)] + [(-5, 7777)]
    want = joined(pairs)
    found = components(spark.createDataFrame(pairs, "a long, b long").repartition(40)).collect()
    assert len({r.node for r in found}) == len(found)
    assert {r.node: r.root for r in found} == {v: want.find(v) for p in pairs for v in p if p[0] != p[1] or want.up.get(v, v) != v or any(want.find(u) == v for u in want.up if u != v)}
