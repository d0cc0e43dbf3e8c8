import re
from collections import Counter

from oracle import same

from lumenframe.llm import quality
from lumenframe.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_matches_sql(spark):
    assert same(spark, QUERIES["op3_quality"], ORACLE_SQL["op3_quality"], SF) > 0


def test_edges(spark):
    texts = [None, "", " \n ", "a", "a b c a b c", "a a a a a", "x\r\nx\r\ny\n\n\nx", "é ü # $", "word " * 4000, "b c d " * 30 + "e f g", "  \x1f a"]
    df = spark.createDataFrame([(None if i == 1 else i // 2, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    rows = quality.judge(df)
    got = Counter(tuple(r) for r in rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((None if i == 1 else i // 2, *brute(t)) for i, t in enumerate(texts))
    for r in rows.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.judge(df.limit(0)).count() == 0


def test_order_changes_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    kept = {r.doc_id for r in quality.keep(docs, rules=quality.RULES[::-1]).collect()}
    assert kept == {d for d, k in verdict.items() if k}
    assert quality.ordered(quality.RULES, [("symbols", 1, 0.1), ("capitals", 0.1, 0.1), ("lines", 1, 0.5), ("word_length", 1, 0.0)])[0].name == "capitals"
