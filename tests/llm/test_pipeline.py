import random
import re
import uuid
from pathlib import Path

import public_tokenizers
import test_decontaminate
import test_linededup
import test_quality
import test_simhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import bpe, decontaminate
from lumenframe.llm.common import read, written
from lumenframe.llm.graph import Union


def capitals_rule(text):
    w = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    chars = len(re.sub(r"[\x20\x09-\x0D]+", "", text))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return 10 * len(re.findall(r"[#*$%&|<>]", text)) > w or 2 * len(re.findall("[A-Z]", text)) > chars or 2 * (len(lines) - len(set(lines))) > len(lines) or not 2 * w <= chars <= 15 * w


def brute(docs, items):
    """(doc_id, ids) of the documents that stay, stage by stage."""
    kept = []
    for d, t in docs:
        n, _, _, _, again = test_quality.brute(t)
        if n >= 50 and 100 * again <= 50 * n and not capitals_rule(t or ""):
            kept.append((d, t))
    kept = test_linededup.without_lines(kept)
    kept = dict(kept)
    groups = {r[0]: r[2] for r in test_simhash.brute(list(kept.items()))}
    union = Union()
    for d, least in groups.items():
        union.join(d, least)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in kept.items() for w in [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]}
    where = {}
    for d, own in sets.items():
        for x in own:
            where.setdefault(x, []).append(d)
    for d, own in sets.items():
        for e in {e for x in own for e in where[x] if e < d}:
            if len(own & sets[e]) >= 0.8 * len(own | sets[e]):
                union.join(d, e)
    kept = {d: t for d, t in kept.items() if union.find(d) == d}
    bad = {r[0] for r in test_decontaminate.brute(list(kept.items()), items) if r[5]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in kept.items() if d not in bad}


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    found = corpus_pipeline.run(spark, sf).collect()
    want = brute(docs, items)
    assert {r.doc_id: r.ids for r in found} == want and len(found) == len(want)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in found)
    assert 0 < len(found) < len(docs)


def test_stages_take_odd_rows(spark):
    clean = " ".join("plain%s" % chr(97 + i % 26) * (1 + i % 2) + chr(97 + i // 26) for i in range(90))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, clean, "en", "s", 5), (2, clean, "en", "s", 5), (None, clean[::-1], None, "s", None)]
    rows = [(*r, "a", "b", 3) for r in rows]  # names that stages use themselves
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string, line_counts string, bpe int")
    for frame, left in ((df, 2), (df.limit(0), 0)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == df.columns
            docs = written(out, "stage")
        assert corpus_pipeline.encoding(spark, docs, "").count() == left


def test_near_dedup_takes_near_copies(spark):
    rng = random.Random(4)
    docs = []
    for i in range(40):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(120)]
        near, far = words[:], words[:]
        near[30], near[80] = "new", "other"  # 106 of 126 shingles stay
        for at in range(10, 110, 10):
            far[at] = "far%d" % at  # 66 of 166
        docs += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [i for i in range(120) if i % 3 != 1]


def test_near_dedup_of_odd_rows(spark):
    clean = " ".join("plain%s" % chr(97 + i % 26) * (1 + i % 2) + chr(97 + i // 26) for i in range(90))
    rows = [(None, clean, "x"), (7, clean, "y"), (7, clean, "y"), (7, clean + " end", "z"), (9, " ".join([*clean.split()[:50], "other", *clean.split()[51:]]), None), (3, None, "n"), (4, "", "n"), (None, "", "n"), (5, "a b", "s"), (5, "a b", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = sorted((r.doc_id, r.t) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert len(got) == 3 and got[0] == (3, "n") and got[1] == (5, "s") and got[2][0] == 7


def test_large_groups_are_compared_once(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(150)]
    docs = []
    for i in range(700):
        words = base[:]
        words[rng.randrange(150)] = "w%d" % i
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()] == [0]


def test_near_copies_in_hot_bands_lose_no_link(spark, monkeypatch):
    """Bands that pairs of near copies share with many other texts, which are no copies."""
    import random

    from lumenframe.llm import neardup

    from pyspark import cloudpickle

    rng = random.Random(5)
    docs = []
    for i in range(120):
        own = ["w%d" % rng.randrange(10**6) for _ in range(60)]
        docs += [(i, " ".join(own)), (1000 + i, " ".join([*own, "more"]))]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = neardup.keys
    monkeypatch.setattr(neardup, "keys", lambda h, heads: plain(h, heads) % 3)
    cloudpickle.register_pickle_by_value(neardup)
    try:
        assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == list(range(120))
        monkeypatch.setattr(neardup, "HOT", 20)
        assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == list(range(120))
        monkeypatch.setattr(neardup, "PART", 50)
        assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == list(range(120))
    finally:
        cloudpickle.unregister_pickle_by_value(neardup)


def worker_mb(spark, made):
    """(most, afterwards): MB of the Python workers, started for this, that make a table."""
    context = spark.sparkContext
    context.environment["LUMENFRAME_WORKERS"] = mark = uuid.uuid4().hex
    try:
        made().write.format("noop").mode("overwrite").save()
    finally:
        del context.environment["LUMENFRAME_WORKERS"]
    most, after = 0, 0
    for p in Path("/proc").iterdir():
        try:
            if p.name.isdigit() and mark in (p / "environ").read_bytes().decode(errors="replace"):
                state = dict(x.split(":", 1) for x in (p / "status").read_text().splitlines())
                most, after = max(most, int(state["VmHWM"].split()[0]) >> 10), max(after, int(state["RssAnon"].split()[0]) >> 10)
        except OSError:
            continue
    return most, after


def test_workers_hold_little_beside_a_batch(spark):
    text = " ".join(f"w{i * i % 9973} of" for i in range(420))
    df = spark.range(0, 10_000, 1, 1).select("id", F.concat(F.col("id").cast("string"), F.lit(f" {text} "), F.col("id").cast("string")).alias("text"))
    bench = spark.createDataFrame([("a", text[:300]), ("b", "short item")], "item_id string, text string")
    for step, (most, after) in {
        "decontamination": worker_mb(spark, lambda: decontaminate.contamination(df, bench)),
        "encoding": worker_mb(spark, lambda: bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.json"))),
    }.items():
        print(step, most, after)
        assert most < 260 and after < 120, step
