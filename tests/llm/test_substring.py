import hashlib
import random
import re

import numpy as np
from oracle import same

from lumenframe.llm import substring as ss
from lumenframe.llm.registry import ORACLE_SQL, QUERIES


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 49) if d is not None else ():
            x = tuple(w[i : i + 50])
            least[x] = min(d, least.get(x, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - 49) if d is not None and least[tuple(w[i : i + 50])] < d for j in range(50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_sql(spark):
    assert same(spark, QUERIES["op6_substring"], ORACLE_SQL["op6_substring"], "/root/testdata/sf0.001") > 0


def test_index_finds_the_least_value_of_each_window():
    rng = random.Random(1)
    for window in (1, 2, 3, 5, 50):
        for most in (1, 2, 9):
            seqs = [[rng.randrange(1, most + 1) for _ in range(rng.randrange(1, 120))] for _ in range(40)]
            values = [rng.randrange(1000) for _ in seqs]
            index = ss.Index(np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs]), np.array(values), window)
            least = {}
            for s, v in zip(seqs, values, strict=True):
                for i in range(len(s) - window + 1):
                    least[tuple(s[i : i + window])] = min(v, least.get(tuple(s[i : i + window]), v))
            for s, found in zip(seqs, index.stream(), strict=True):
                assert found.tolist() == [least[tuple(s[i : i + window])] for i in range(len(s) - window + 1)]


def odd_rows():
    rng = random.Random(7)
    passage = ["p%d" % i for i in range(130)]
    rows = [(None, None), (None, " ".join(passage)), (1, ""), (2, "x " * 3000), (3, "x " * 60), (4, "x " * 49), (5, "\t".join(passage[:50])), (5, " ".join(passage)), (9, "a\x0b" * 51 + " é ü")]
    for i in range(60):
        a = rng.randrange(80)
        rows.append((rng.choice([6, 20 + i]), " ".join(["l%d" % rng.randrange(99) for _ in range(rng.randrange(40))] + passage[a : a + rng.randrange(30, 90)] + ["r%d" % rng.randrange(99) for _ in range(rng.randrange(60))])))
    return rows + [rows[20], (100, "x y " * 400), (101, "y x " * 40)]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_edges(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_words int, spans string").repartition(7)
    found = ss.dedup(df)
    assert result(found) == brute(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found.collect())
    assert result(ss.dedup(df.limit(0))) == []


def test_many_anchors_take_the_other_way(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(ss, "BROADCAST_ROWS", 0)
    assert result(ss.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_anchors_are_cut(spark, monkeypatch):
    rng = random.Random(4)
    passage = ["p%d" % i for i in range(120)]
    rows = odd_rows()
    for i in range(200):  # one passage, its ends in other words each time
        rows.append((1000 + i, " ".join(["l%d" % rng.randrange(10**6) for _ in range(60)] + passage[rng.randrange(5) : 120 - rng.randrange(5)] + ["r%d" % rng.randrange(10**6) for _ in range(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ss, "HOT", 20)
    sizes = []
    plain = ss._cooled
    monkeypatch.setattr(ss, "_cooled", lambda forms: sizes.append((forms, found := plain(forms))) or found)
    assert result(ss.dedup(df)) == brute(rows)
    (forms, (cut, _)), = sizes
    largest = lambda d: d.groupBy("k").count().agg({"count": "max"}).first()[0]
    assert largest(forms) > 150 and largest(cut) < 40


def common_passage(n):
    """Documents that share a passage, in other words before and after it, and some that repeat the anchor or share less."""
    rng = random.Random(11)
    passage = ["p%d" % i for i in range(120)]
    rows = [(i, " ".join(["l%d" % rng.randrange(10**6) for _ in range(60)] + passage[rng.randrange(40) : 120 - rng.randrange(40)] + ["r%d" % rng.randrange(10**6) for _ in range(60)])) for i in range(n)]
    for i in range(60):  # the same words again and again, and words with bytes that sort before the blank
        rows.append((2000 + i, " ".join((passage[30:42] * 9)[rng.randrange(12) :] + ["e\x01"] * (i % 3) + passage[20:100])))
        rows.append((3000 + i, " ".join(["e"] * (i % 4) + passage[10 + i % 7 : 75 - i % 5] + ["p75\x01", "p76"][: i % 3] + passage[76:120])))
    return rows


def test_hot_anchors_take_few_rows(spark, monkeypatch):
    """The grams of each stretch, a row each, would be dozens of rows a stretch."""
    frame = type(spark.range(0))
    made, plain = {}, frame.mapInArrow

    def counting(self, f, schema):
        n = made.setdefault(f.__name__ + schema[:12], spark.sparkContext.accumulator(0))

        def run(batches):
            for batch in f(batches):
                n.add(len(batch))
                yield batch

        return plain(self, run, schema)

    monkeypatch.setattr(ss, "HOT", 20)
    monkeypatch.setattr(frame, "mapInArrow", counting)
    rows = common_passage(200)
    assert result(ss.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert max(n.value for n in made.values()) < 20 * len(rows), made


def test_ends_of_ranges_stay_whole(spark, monkeypatch):
    rows = odd_rows() + common_passage(60)
    monkeypatch.setattr(ss, "HOT", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(ss.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
