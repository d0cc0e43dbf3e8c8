import hashlib
import random
import re
import resource
import time

import pyarrow as pa
from oracle import same

from pyspark.sql import functions as F

from lumenframe.llm import decontaminate as dc
from lumenframe.llm.registry import ORACLE_SQL, QUERIES


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(docs, bench, **more):
    f = dc.contamination(docs, bench, **more).withColumn("n_hit", dc.hit_words(F.col("found")))
    f = f.select("doc_id", "found.n_words", "n_hit", F.size("found.items"), F.sha2(F.array_join(F.array_sort("found.items"), ","), 256), dc.contaminated(F.col("n_hit"), F.col("found.n_words")))
    return sorted((tuple(r) for r in f.collect()), key=str)


def test_matches_sql(spark):
    assert same(spark, QUERIES["op9_decontaminate"], ORACLE_SQL["op9_decontaminate"], "/root/testdata/sf0.001") > 0


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["a", "b", "C", "é", "dd", "x1", "ÉÀ"]
    items = [(i % 37 if i else None, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 6, 7, 12, 13, 14, 30, 60])))) for i in range(60)]
    items = [(i, t) for i, t in items if len(words(t)) != 1] + [(None, None), (5, "..."), (500, "Rare-Word")]
    docs = [(None, None), (1, ""), (1, "  ..  "), (2, "rare word"), (3, "x" * 700000 + " rare WORD, end"), (4, "a " * 3000)]
    for d in range(150):
        t = [rng.choice(vocab + ["q%d" % rng.randrange(500)] * 6) for _ in range(rng.randrange(120))]
        if rng.random() < 0.6:
            own = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(len(own) + 1)
            at = rng.randrange(len(t) + 1)
            t[at:at] = own[cut:] if rng.random() < 0.5 else own
        docs.append((10 + d // 2, rng.choice([" ", "\n", "-"]).join(t)))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, found string")
    assert result(df, bench) == brute(docs, items)
    assert result(df, bench, block_words=300) == brute(docs, items)
    assert result(df, bench.limit(0)) == brute(docs, [])
    assert result(df.limit(0), bench) == []


def test_texts_and_items_that_repeat_themselves():
    block = dc.Block(["a", "b", "c"], ["so " * 5000, "so " * 12, "no " * 40])
    data, bounds = dc.text_bytes(pa.array(["so " * 20_000 + "yes", "no", "no " * 13]))
    began = time.process_time()
    starts, ends, first = dc.spans(data, bounds, dc.ALPHANUMERIC)
    begun, size, items = block.meet(dc.word_hashes(data, starts, ends, True), first)
    assert time.process_time() - began < 5
    assert items == [{0, 1}, set(), {2}]
    assert dc.intervals(begun, size) == [(0, 20_000), (20_002, 20_015)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 4_000_000


def test_many_blocks_give_what_one_gives(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda words: sorted((r.doc_id, r.n, [(s.a, s.b) for s in r.spans], sorted(r.items)) for r in dc.contamination(docs, items, block_words=words).selectExpr("doc_id", "found.n_words as n", "found.spans", "found.items").collect())
    assert rows(500) == rows(1_000_000)
