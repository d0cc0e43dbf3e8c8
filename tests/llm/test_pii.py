import hashlib
import random
import re

from lumenframe.llm import pii
from lumenframe.llm.registry import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])))


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op5_pii"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert r.n_spans == len(spans)
        # beyond the base the generated documents hold tokens of 40 hexadecimal digits, and nothing else is added
        secrets = [f"secret:{m.start()}:{m.end()}" for m in re.finditer(r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])", texts[r.doc_id] or "")]
        assert sorted(spans) == sorted([x for x in joined(want).split(",") if x] + secrets)


def test_base_patterns_on_edges(spark):
    rng = random.Random(11)
    texts = [None, "", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.001.0 999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (988) 555-2485", "+1(((((", "é@x.y ü a@é.b a.@-.-", "1" * 40000, "a" * 40000 + "@", "+1" * 9000, "x@y.z " * 2000, "1.1.1.1 " * 1500]
    pool = "ab1209.@+- ()%_\n:/é"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(90))) for _ in range(600)]
    texts += ["".join(rng.choice("0123456789 -+.") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(None if i == 2 else i, t, "e", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, h int")
    got = {r.doc_id: [(s.kind, s.a, s.b) for s in r.base] for r in pii.find(df).select("doc_id", "base").collect()}
    for i, t in enumerate(texts):
        assert sorted(got[None if i == 2 else i]) == sorted(brute(t)), t and t[:80]
    assert pii.find(df.limit(0)).count() == 0


def test_contexts_discover_what_the_base_misses(spark):
    rng = random.Random(4)
    words = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(40)]
    rows = []
    for d in range(120):
        t = [rng.choice(words) for _ in range(60)]
        if d < 40:
            t[20:20] = ["telephone:", "+1 (%d) 555-%04d" % (100 + d, rng.randrange(10000))]
        elif d < 50:
            t[20:20] = ["telephone:", "0%d/55-%d" % (200 + d, 1000 + d)]
        elif d < 60:
            t[20:20] = [rng.choice(words), "room-%d-%d" % (d, 7000 + d)]
        rows.append((d, " ".join(t)))
    rows.append(rows[45])
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        assert len(r.base) == (r.doc_id < 40)
        if 40 <= r.doc_id < 50:
            (s,) = r.more
            assert s.kind == "phone" and texts[r.doc_id][s.a : s.b] == "0%d/55-%d" % (200 + r.doc_id, 1000 + r.doc_id)
        else:
            assert not r.more


MARKS = str.maketrans("", "", pii.MARKS)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(MARKS).lower()) if w]


def beside(gaps, i):
    """The contexts of the match between gaps i and i + 1."""
    b, a = words_of(gaps[i]), words_of(gaps[i + 1])
    out = ["b1 " + b[-1]] * (len(b) > 0) + ["b2 " + " ".join(b[-2:])] * (len(b) > 1)
    return out + ["a1 " + a[0]] * (len(a) > 0) + ["a2 " + " ".join(a[:2])] * (len(a) > 1)


def met_in(text):
    """(kind or None, start, end, string, contexts) of seeds and of identifier-like strings."""
    import regex

    for kind, p in [*((k, pii.PATTERNS[k]) for k in pii.KINDS), (None, pii.CANDIDATE)]:
        found = list(regex.finditer(p, text))
        gaps = [text[a:b] for a, b in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(text)])]
        for i, m in enumerate(found):
            s = m[0] if kind else m[0].rstrip(".:/(-")
            if kind in PLAIN and (kind, m.start(), m.end()) not in brute(text):
                continue
            yield kind, m.start(), m.start() + len(s), s, beside(gaps, i)


def brute_bootstrap(texts):
    """Spans added to each text, by plain loops."""
    import math
    from collections import Counter, defaultdict

    met = [[x for x in met_in(t)] for t in texts]
    count = Counter()
    for t in texts:
        w = words_of(t)
        count.update(w)
        count.update(f"{a} {b}" for a, b in zip(w, w[1:]))
    mentions, kinds = defaultdict(lambda: [0, 0]), {}
    for of in met:
        for kind, _, _, s, contexts in of:
            if kind:
                kinds[s] = min(kind, kinds.get(s, "z")) if s in kinds else kind
            for c in contexts:
                mentions[c, s][kind is not None] += 1
    support = defaultdict(set)
    for c, s in mentions:
        support[c].add(s)
    edges = {(c, s): max(k) for (c, s), k in mentions.items() if len(support[c]) >= pii.MIN_SUPPORT}
    every = Counter()
    for (c, _), k in edges.items():
        every[c] += k
    known = {s: k for s, k in kinds.items() if any(x == s for _, x in edges)}
    while True:
        hits, different = Counter(), defaultdict(set)
        for (c, s), k in edges.items():
            if s in known:
                hits[c, known[s]] += k
                different[c, known[s]].add(s)
        patterns = {}
        for (c, kind), k in hits.items():
            share = k / max(count[c[3:]], every[c])
            score = share * math.log2(len(different[c, kind]))
            if len(different[c, kind]) >= pii.MIN_SUPPORT and share >= pii.MIN_CONFIDENCE and score >= pii.MIN_SCORE:
                patterns[c] = max(patterns.get(c, (0, "")), (score, kind))
        fresh = {}
        for c, s in edges:
            if c in patterns and s not in known:
                fresh[s] = max(fresh.get(s, (0, "")), patterns[c])
        if not fresh:
            break
        known.update({s: kind for s, (_, kind) in fresh.items()})
    out = []
    for of in met:
        seeds = [(k, a, b) for k, a, b, _, _ in of if k]
        found = {(known[s], a, b) for k, a, b, s, contexts in of if k is None and s in known and any(c in patterns for c in contexts)}
        out.append(sorted({x for x in found if not any(a < x[2] and x[1] < b for _, a, b in seeds)} | {x for x in seeds if x[0] == "secret"}))
    return out


def planted(rng, n):
    """Texts with identifiers of each kind after telling words, some of a form the base patterns miss, and clean texts.

    Gives the texts and what is to be found beyond the base in each."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    forms = [
        ("telephone:", lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: rng.choice([f"({digits(3)}) 555-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)}-{digits(2)}"])),
        ("write to", lambda: f"x{digits(4)}@mail{digits(1)}.example.com", lambda: f"x{digits(4)}@intranet"),
        ("host address", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: f"fe80::{digits(4)}:{digits(3)}f"),
        ("token =", lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f'"pw{digits(6)}z"'),
    ]
    texts, want = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(40)]
        extra = []
        if i % 3 < 2:
            before, seed, unseen = forms[i // 3 % 4]
            hidden = i % 9 == 0
            s = unseen() if hidden else seed()
            t[20:20] = [before, s, "and", "so"]
            if hidden:
                extra.append(s.strip('"'))
        elif i % 2:
            t[20:20] = [rng.choice(["room", "chapter", "in"]), f"{digits(2)}-{digits(3)}", rng.choice(words)]
        texts.append(" ".join(t))
        want.append(extra)
    return texts, want


def test_bootstrap_equals_brute_force_and_finds_what_is_planted(spark):
    texts, want = planted(random.Random(9), 900)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    more = {r.doc_id: sorted((s.kind, s.a, s.b) for s in r.more) for r in pii.find(df).collect()}
    assert [more[i] for i in range(len(texts))] == brute_bootstrap(texts)
    hidden = [(i, x) for i, of in enumerate(want) for x in of]
    found = {(i, texts[i][a:b]) for i, of in more.items() for _, a, b in of}
    assert len(hidden) > 90 and sum(x in found for x in hidden) >= 0.9 * len(hidden)
    seeds = {(i, texts[i][a:b]) for i, of in more.items() for k, a, b in of if k == "secret" and re.fullmatch("[0-9a-f]{40}", texts[i][a:b])}
    assert found - seeds <= set(hidden)  # nothing in texts without a planted one


def test_many_identifiers_in_one_text(spark):
    text = " ".join(f"call 0{i % 900 + 100}-{i} x@y.z 1.1.1.1" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, text[:300]), (None, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (len(r.base), len(r.more)) for r in pii.find(df).collect()}
    assert got[1][0] == 40_000 and got[3] == got[None] == (0, 0)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or +1 (988) 555-2485, é 1.2.3.4"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["mail [email] or [phone], é [ip]", ""]
