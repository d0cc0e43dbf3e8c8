import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import linededup as ld
from lumenframe.llm.graph import Union
from lumenframe.llm.registry import QUERIES


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def form(line):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", line.encode())
    return re.sub(rb"[0-9]", b"0", b" ".join(words)).lower().decode() if words else None


def forms_of(texts):
    return sorted({f for t in texts for line in (t or "").split("\n") if (f := form(line)) is not None}, key=lambda f: (len(f), f))


def close_pairs(forms):
    """All pairs of edit similarity 0.8, by lengths, character counts and then the distance."""
    long, bags = np.array([len(f) for f in forms]), np.stack([np.bincount([ord(c) % 128 for c in f], minlength=128) for f in forms]).astype(np.int16)
    for i in range(1, len(forms)):
        most = int(0.2 * long[i] + 1e-9)
        lo = int(np.searchsorted(long, long[i] - most))
        over = bags[lo:i] - bags[i]  # the distance is no less than either sum
        for j in lo + np.flatnonzero(np.maximum(np.maximum(over, 0).sum(1), np.maximum(-over, 0).sum(1)) <= most):
            if ld.distance(forms[i], forms[j], most) <= most:
                yield i, int(j)


def looked_at(forms):
    """Which pairs of normal forms are to be checked: a function of two numbers."""
    found = of(forms)
    fp, (keys, s) = found.prints(), found.sketches()

    def check(i, j):
        close = int(fp[i] ^ fp[j]).bit_count() <= ld.SURE_BITS or bool((keys[i] >> np.uint64(16) == keys[j] >> np.uint64(16)).any())
        return close and int(ld.agreeing(s[i : i + 1], s[j : j + 1])[0]) >= ld.AGREE and ld.similar(forms[i], forms[j])

    return check


def brute(docs):
    """(doc_id, n_lines, n_removed, sha) by comparing all pairs of normal forms that are to be checked."""
    return sorted(((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in judged(docs)), key=str)


def without_lines(docs):
    return [(d, t) for d, _, _, t in judged(docs)]


def judged(docs):
    forms = forms_of(t for _, t in docs)
    union = Union()
    check = looked_at(forms) if forms else None
    for i, j in close_pairs(forms) if forms else ():
        if check(i, j):
            union.join(i, j)
    number = {f: i for i, f in enumerate(forms)}
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    first = {}
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if (f := form(line)) is not None:
                r, place = union.find(number[f]), (d is None, d or 0, hashes[t or ""], n)
                first[r] = min(first.get(r, place), place)
    out = []
    for d, t in docs:
        kept, n_lines, gone = [], 0, 0
        for n, line in enumerate((t or "").split("\n")):
            f = form(line)
            n_lines += f is not None
            if f is not None and first[union.find(number[f])] != (d is None, d or 0, hashes[t or ""], n):
                gone += 1
            else:
                kept.append(line)
        out.append((d, n_lines, gone, "\n".join(kept)))
    return out


def rows(df):
    from pyspark.sql import functions as F

    found = ld.dedup(df)
    assert set(found.columns) == {*df.columns, "line_counts"}
    return sorted((tuple(r) for r in found.select("doc_id", "line_counts.n_lines", "line_counts.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()), key=str)


def of(texts):
    data = "\n".join(texts).encode()
    return ld.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


def test_distance():
    rng = random.Random(6)
    for _ in range(500):
        a = "".join(rng.choice("abc é") for _ in range(rng.randrange(90)))
        b = "".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.5 else "".join(rng.choice("abc é") for _ in range(rng.randrange(30)))
        d = plain_distance(a, b)
        assert ld.distance(a, b) == d
        assert all(ld.at_most(a.split(" "), b.split(" "), limit) >= d for limit in (0, 5, 99))
        for limit in (0, 3, 20):
            assert (ld.distance(a, b, limit) <= limit) == (d <= limit)
        like = d <= 0.2 * max(len(a), len(b)) + 1e-9
        assert ld.similar(a, b) <= like
        assert ld.similar(a, b) == like or ld.shared(a, b) < ld.SHARED


def test_prints_count_every_telling_word():
    rng = random.Random(12)
    words = ["of", "the", "word", "longer", "éé", "ÜBERALL", "x" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 254, 255, 256, 700, 5, 1100)] + ["of the of", "a"]
    found = of(texts)
    h = ld.word_hashes(found.data, found.starts, found.ends, True, ld.LOOSE).tolist()
    for line, a, b, fp in zip(texts, found.first.tolist(), found.last.tolist(), found.prints().tolist(), strict=True):
        own = [(x, min(len(w), 12)) for x, w in zip(h[a:b], line.split(), strict=True)]
        own = [(x, w) for x, w in own if w >= ld.SHORT] or own
        assert fp == sum(1 << k for k in range(64) if 2 * sum(w for x, w in own if x >> k & 1) > sum(w for _, w in own))


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op8_linededup"](spark, sf).collect()), key=str) == brute(docs)


def odd_rows():
    rng = random.Random(2)
    base = ["word%s" % "abcdefghijklmnop"[i % 16] * (1 + i % 3) for i in range(60)]
    docs = [(None, None), (None, "same line here\nx"), (1, ""), (2, "\n\n--\n"), (3, "Same  line, HERE\nother\nother"), (3, "Same  line, HERE\nother\nother"), (4, "page 12 of 99\r\npage 34 of 77\n***"), (5, "é" * 30 + "\n" + "y" * 2000 + "\n" + "z " * 900)]
    for i in range(150):
        words = base[:]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = rng.choice(["stupid", "changed", "q%s" % chr(97 + i % 26)])
        docs.append((10 + i, "intro line %s\n" % chr(97 + i % 26) * 2 + " ".join(words)))
    return docs


def test_edges_and_large_groups(spark):
    docs = odd_rows()
    df = spark.createDataFrame([(d, t, 5, "g", 7, None) for d, t in docs], "doc_id long, text string, n long, g string, __h long, __gone string")
    got = rows(df)
    assert got == brute(docs)
    assert sum(r[2] for r in got) > 150
    assert rows(df.limit(0)) == []


def test_large_sides_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = odd_rows()
    monkeypatch.setattr(ld, "small", lambda df: df)
    monkeypatch.setattr(ld, "BROADCAST_LINES", 0)
    assert rows(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def members_of(fp, s, g):
    """The sets of members that the packed tables of fingerprints report."""
    keys = np.zeros((len(g), ld.BANDS), np.uint64)
    keys[:] = np.arange(len(g), dtype=np.uint64)[:, None] << np.uint64(32)  # no two share a band
    batch = pa.RecordBatch.from_arrays([pa.array(g), pa.array(fp.view(np.int64)), pa.array(s.view(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary())], names=["g", "fp", "s", "keys"])
    dealt = pa.Table.from_batches(list(ld._dealt(5)(iter([batch])))).sort_by("bucket")
    out = {}
    for b in ld._buckets(iter(dealt.to_batches(max_chunksize=7))):
        for c, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            out.setdefault(c, set()).add(x)
    return list(out.values())


def test_each_close_pair_is_looked_at():
    rng = random.Random(3)
    x = np.array([rng.getrandbits(64)] * 200, np.uint64)
    for i in range(200):
        for _ in range(rng.randrange(4)):
            x[i] ^= np.uint64(1 << rng.randrange(64))
    x = np.unique(x)
    g = np.arange(len(x), dtype=np.int64) * 3
    sets = members_of(x, np.zeros(len(x), np.uint64), g)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= ld.SURE_BITS).tolist():
            assert any(g[i] in m and g[j] in m for m in sets)


def test_hot_buckets_are_cut_in_slices(monkeypatch):
    monkeypatch.setattr(ld, "HOT", 40)
    x = np.zeros(500, np.uint64)
    sets = members_of(x, x, np.arange(500, dtype=np.int64))
    assert max(map(len, sets)) <= 40 and set().union(*sets) == set(range(500))
    assert len(set.intersection(*sets)) >= ld.PIVOTS - 1  # what links the slices


def test_agreement_of_sketches():
    rng = random.Random(8)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for place in rng.sample(range(16), rng.randrange(17)):
            b ^= rng.randrange(1, 16) << 4 * place
        same = sum((a ^ b) >> 4 * p & 15 == 0 for p in range(16))
        assert ld.agreeing(np.array([a], np.uint64), np.array([b], np.uint64)).tolist() == [same]


CLASSES = [(1, 5), (5, 10), (10, 20), (20, 50), (50, 10**6)]


def recalls(df, pairs):
    """By number of words, the share of pairs of normal forms that end in one group."""
    union = Union()
    for r in ld.links(df, ld.written(ld.lines(df), "lines")).collect():
        union.join(r.a, r.b)
    g = lambda f: int(of([f]).g.view(np.int64)[0])
    out = {}
    for a, b in pairs:
        k = next(c for c in CLASSES if c[0] <= max(len(a.split()), len(b.split())) < c[1])
        found, n = out.get(k, (0, 0))
        out[k] = found + (union.find(g(a)) == union.find(g(b))), n + 1
    return out


def enough(found):
    """A recall of 0.9 over all, and in each class of 20 pairs or more."""
    return sum(h for h, _ in found.values()) >= 0.9 * sum(n for _, n in found.values()) and all(h >= 0.9 * n for h, n in found.values() if n >= 20)


def pairs_with_words_in_common(texts):
    """Pairs of edit similarity 0.8 among those with half of the words, by length, in common."""
    forms = forms_of(texts)
    where, sets = {}, [set(f.split()) for f in forms]
    for i, own in enumerate(sets):
        for w in own:
            where.setdefault(w, []).append(i)
    where = {w: np.array(x) for w, x in where.items()}
    weight = np.array([sum(map(len, s)) for s in sets])
    for i, own in enumerate(sets):
        both = np.zeros(len(forms), np.int64)
        for w in own:
            both[where[w]] += len(w)
        for j in np.flatnonzero(2 * both[:i] >= np.maximum(weight[:i], weight[i])).tolist():
            most = int(0.2 * max(len(forms[i]), len(forms[j])) + 1e-9)
            if ld.distance(forms[i], forms[j], most) <= most:
                yield forms[i], forms[j]


def test_recall_of_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    forms = forms_of(r.text for r in df.select("text").collect())
    found = recalls(df, [(forms[i], forms[j]) for i, j in close_pairs(forms)])
    assert sum(n for _, n in found.values()) > 30 and enough(found), found
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = recalls(df, list(pairs_with_words_in_common(r.text for r in df.select("text").collect())))
    print("recall of all pairs of sf0.01 by words:", found)
    assert sum(n for _, n in found.values()) > 300 and enough(found), found


@pytest.mark.parametrize("share", [0, 0.19])
def test_recall_of_changed_lines(spark, share):
    """Lines of the test data with one word replaced, or as many as make up a fifth of the characters."""
    rng = random.Random(8)
    lines = [f for f in forms_of(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()) if len(f) > 12]
    rng.shuffle(lines)
    words = [w for line in lines[:500] for w in line.split()]
    pairs = []
    for line in lines[:2500]:
        own = line.split()
        spent = 0
        for i in rng.sample(range(len(own)), len(own)):
            new = rng.choice(words)
            cost = max(len(own[i]), len(new))
            if new == own[i] or spent + cost > max(0.2, share) * len(line) - 1:
                continue
            own[i], spent = new, spent + cost
            if not share:
                break
        if spent:
            pairs.append((line, " ".join(own)))
    df = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    found = recalls(df, pairs)
    print("recall of changed lines by words:", found)
    assert len(pairs) > 1500
    assert enough(found), found


def one_bucket():
    """Lines that agree in every bucket, as their short words do not tell there, and are like one other only."""
    rng = random.Random(21)
    common = ["wordword%s" % c * 2 for c in "abcdefghijkl"]
    short = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3))
    docs = []
    for i in range(60):
        own = [short() for _ in range(30)]
        docs += [(i, " ".join([*common, *own])), (1000 + i, " ".join([*common, *own[:-1], short()]))]
    return docs


def connected(df):
    """The groups of lines, by hash of the normal form."""
    union = Union()
    for r in ld.links(df, ld.written(ld.lines(df), "lines")).collect():
        union.join(r.a, r.b)
    out = {}
    for g in union.up:
        out.setdefault(union.find(g), set()).add(g)
    return sorted(map(sorted, out.values()))


@pytest.fixture
def by_value():
    """Workers get the module as it is patched here."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(ld)
    yield
    cloudpickle.unregister_pickle_by_value(ld)


def test_lines_of_hot_buckets_lose_no_link(spark, monkeypatch, by_value):
    docs = one_bucket()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = connected(df)
    assert [len(x) for x in want] == [2] * 60
    monkeypatch.setattr(ld, "HOT", 20)
    assert connected(df) == want
    monkeypatch.setattr(ld, "PART", 7)
    assert connected(df) == want
