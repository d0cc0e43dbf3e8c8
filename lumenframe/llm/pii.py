"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers, and SECRET finds keys and tokens of
published formats.  These are the seeds of a bootstrap.  A lexical pattern is the one or two words before an entity, or
after it, in lower case and without punctuation marks.  Patterns and the identifier-like strings they meet make a graph:
a pattern's confidence is the share of its words' occurrences in the corpus that stand beside a known identifier of a
kind, and its score that share times the logarithm of how many different ones it has met.  Identifier-like strings
(with a digit or @; groups of digits may be joined by blanks, dots, hyphens, slashes and parentheses) that no base
pattern finds, met by a pattern of high confidence, become identifiers of its kind, and so induce and support further
patterns, until none is new.  An occurrence is reported where both its identifier and a pattern beside it are accepted,
unless it overlaps a base span.

Only contexts of identifier-like strings are counted, and of these only such as meet MIN_SUPPORT different ones.  Tables
of contexts, patterns and identifiers are broadcast if they have BROADCAST_ROWS rows or fewer and joined by a shuffle else.  Texts are never shuffled.

A null text is an empty one.  Work is linear in the text: runs are entered at their start only, and contexts are taken
from the pieces between matches, so a string right beside another one has no context on that side.  Rows are told apart
by id and text; rows equal in both get the same spans, rows without an id too.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import BLANK, let, read, small, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 5, 0.5, 1.5
BROADCAST_ROWS = 100_000

#: The base patterns.  Possessive, and entered at the start of a run or where the match before has ended, they match
#: what the plain patterns match leftmost, without trying a run from each of its characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # hexadecimal digests, and keys with the prefixes of cloud, code hosting, payment and chat services
    "secret": r"(?<![0-9A-Za-z_-])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{24,}+|xox[abprs]-[0-9A-Za-z-]{10,}+)(?![0-9A-Za-z_-])",
}
_TOKEN = r"A-Za-z._+/#:"
_GROUP = r"[0-9][0-9()./-]*+"
CANDIDATE = rf"(?<![{_TOKEN}0-9@(-])(?:[(+]?+{_GROUP}(?:\x20[(]?+{_GROUP})++|[{_TOKEN}-]*+[0-9@][{_TOKEN}0-9@-]*+)"
#: Marks that are no part of a context's words.
MARKS = ",;:.!?\"'()[]{}<>"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_BLOCK = 256


def luhn(digits: Column) -> Column:
    def worth(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: worth(F.coalesce(c.try_cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", F.lit(""))
    if kind == "ip":
        return match.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def plain_words(text: Column) -> Column:
    """Words in lower case, without marks."""
    return F.array_remove(F.split(F.lower(F.translate(text, MARKS, "")), BLANK), "")


def _beside(before: Column, after: Column) -> Column:
    """The contexts between two pieces of text: `b1`, `b2`, `a1` and `a2`, one or two words before and after."""

    def of(words: Column, side: str, last: bool) -> Column:
        n = F.size(words)
        one = F.element_at(words, -1 if last else 1)
        two = F.concat_ws(" ", F.slice(words, -2 if last else 1, 2))
        return F.concat(
            F.when(n >= 1, F.array(F.concat(F.lit(side + "1 "), one))).otherwise(F.array().cast("array<string>")),
            F.when(n >= 2, F.array(F.concat(F.lit(side + "2 "), two))).otherwise(F.array().cast("array<string>")),
        )

    return F.concat(let(plain_words(before), lambda w: of(w, "b", True)), let(plain_words(after), lambda w: of(w, "a", False)))


def located(text: Column, pattern: str, contexts: bool = False) -> Column:
    """Matches as (a, b, m), and c, their contexts, if asked for; code points, end exclusive.  Lengths of the pieces
    between matches and of the matches are added up block by block, so the work per match is bounded."""
    none = F.array().cast("array<struct<a:bigint,b:bigint,m:string" + ",c:array<string>" * contexts + ">>")

    def places(x: Column) -> Column:
        gaps, found = x["g"], x["m"]
        steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))

        def with_blocks(s: Column) -> Column:
            last = F.floor((F.size(s) - 1) / _BLOCK).cast("int")
            sums = F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(s, b * _BLOCK + 1, _BLOCK)))

            def place(totals: Column) -> Column:
                begun = F.transform(totals, lambda _, b: _sum(F.slice(totals, F.lit(1), b)))

                def each(starts: Column) -> Column:
                    def one(m: Column, i: Column) -> Column:
                        block = F.floor(i / _BLOCK).cast("int")
                        end = F.get(starts, block) + _sum(F.slice(s, block * _BLOCK + 1, i - block * _BLOCK + 1))
                        more = [_beside(F.get(gaps, i), F.get(gaps, i + 1)).alias("c")] if contexts else []
                        return F.struct((end - F.length(m)).alias("a"), end.alias("b"), m.alias("m"), *more)

                    return F.transform(found, one)

                return let(begun, each)

            return let(sums, place)

        return F.when(F.size(found) > 0, let(steps, with_blocks)).otherwise(none)

    whole = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(text.rlike(pattern), let(whole, places)).otherwise(none)


def base_spans(text: Column, kind: str, contexts: bool = False) -> Column:
    return F.filter(located(text, PATTERNS[kind], contexts), lambda x: valid(kind, x["m"]))


def _of_kind(spans: Column, kind: str | None, contexts: bool = False) -> Column:
    more = (lambda x: [x["c"].alias("c")]) if contexts else lambda x: []
    return F.transform(spans, lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x["a"].alias("a"), x["b"].alias("b"), x["m"].alias("m"), *more(x)))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, met) of every row: what is met where, as (kind, a, b, m, contexts): seeds, and with a null for the kind
    every identifier-like string, those of the seeds among them."""
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    trimmed = F.transform(
        located(F.col("t"), CANDIDATE, True),
        lambda x: let(F.regexp_replace(x["m"], r"[.:/(-]+\z", F.lit("")), lambda m: F.struct(x["a"].alias("a"), (x["a"] + F.length(m)).alias("b"), m.alias("m"), x["c"].alias("c"))),
    )
    met = F.concat(*[_of_kind(base_spans(F.col("t"), k, True), k, True) for k in KINDS], _of_kind(trimmed, None, True))
    return rows.select("doc_id", F.xxhash64("t").alias("h"), met.alias("met"))


def occurrences(df: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(w, n): how often each wanted word, or pair of words, occurs over all texts."""
    rows = df.select(plain_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    two = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    counted = rows.select(F.explode(F.concat("w", F.slice(two, F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))).alias("w"))
    if wanted.count() <= BROADCAST_ROWS:
        return counted.join(F.broadcast(wanted), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    return counted.groupBy("w").agg(F.count("*").alias("n")).join(wanted, "w", "left_semi")


def _words(c: Column) -> Column:
    """The words of a context."""
    return F.substring(c, 4, 1 << 30)


def bootstrap(met: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted (c, kind, score) patterns and (m, kind) identifiers, given what is met where (kind, m, c; a null kind is
    a mention of any identifier-like string) and how often words occur (w, n).

    Words written together with an identifier are no words of their own; n is no less than the mentions beside them."""
    spark = met.sparkSession
    tied = met.groupBy("c", "m").agg(F.max(F.struct(F.col("kind").isNotNull().alias("is"), "kind")).alias("s"), F.greatest(F.sum(F.when(F.col("kind").isNull(), 1).otherwise(0)), F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0))).alias("k"))
    edges = written(tied.select("c", "m", "s.kind", "k"), "pii-edges")
    sizes = edges.groupBy("c").agg(F.sum("k").alias("all"))
    wide = sizes.join(counts, _words(F.col("c")) == F.col("w"), "left").select("c", F.greatest(F.coalesce("n", F.lit(0)), "all").alias("n"))
    graph = written(edges.join(small(written(wide, "pii-wide"), BROADCAST_ROWS), "c"), "pii-graph")
    known = written(graph.filter("kind is not null").groupBy("m").agg(F.min("kind").alias("kind")), "pii-known")
    patterns = spark.createDataFrame([], "c string, kind string, score double")
    while True:
        hits = graph.drop("kind").join(known, "m").groupBy("c", "kind").agg(F.countDistinct("m").alias("f"), F.sum("k").alias("hits"), F.first("n").alias("n"))
        confidence = F.col("hits") / F.col("n")
        scored = hits.filter((F.col("f") >= MIN_SUPPORT) & (confidence >= MIN_CONFIDENCE)).withColumn("score", confidence * F.log2(F.col("f")))
        best = scored.filter(F.col("score") >= MIN_SCORE).groupBy("c").agg(F.max(F.struct("score", "kind")).alias("s"))
        patterns = written(best.select("c", "s.kind", "s.score"), "pii-patterns")
        # an identifier's kind is that of the best pattern that meets it
        fresh = graph.filter("kind is null").select("c", "m").join(small(patterns, BROADCAST_ROWS), "c").groupBy("m").agg(F.max(F.struct("score", "kind")).alias("s")).select("m", "s.kind")
        fresh = written(fresh.join(known, "m", "left_anti"), "pii-fresh")
        if fresh.isEmpty():
            return patterns, known
        known = written(known.union(fresh), "pii-known")


def _free(found: DataFrame) -> DataFrame:
    """Of (doc_id, h, kind, a, b, base), the rows not of the base that overlap none that is."""
    row = Window.partitionBy("doc_id", "h").orderBy("a", "b")
    ended = F.max(F.when(F.col("base"), F.col("b"))).over(row.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("base"), F.col("a"))).over(row.rowsBetween(1, Window.unboundedFollowing))
    marked = found.withColumn("ended", ended).withColumn("begins", begins)
    return marked.filter(~F.col("base") & (F.coalesce("ended", F.lit(0)) <= F.col("a")) & (F.coalesce(F.col("begins"), F.col("b")) >= F.col("b"))).select("doc_id", "h", "kind", "a", "b")


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, more) for every row: base spans, and secrets and what the bootstrap adds, as arrays of (kind, a, b)."""
    scanned = written(scan(df, key, text), "pii-scan")
    each = scanned.select("doc_id", "h", F.explode("met").alias("x")).select("doc_id", "h", "x.kind", "x.a", "x.b", "x.m", F.explode_outer("x.c").alias("c"))
    tied = each.filter("c is not null")
    wanted = written(tied.groupBy("c").agg(F.countDistinct("m").alias("f")).filter(F.col("f") >= MIN_SUPPORT).select("c"), "pii-contexts")
    counts = written(occurrences(df, wanted.select(_words(F.col("c")).alias("w")).distinct(), text), "pii-counts")
    patterns, known = bootstrap(tied.join(small(wanted, BROADCAST_ROWS), "c", "left_semi").select("kind", "m", "c"), counts)
    named = known.withColumnRenamed("kind", "of")
    added = tied.filter("kind is null").join(small(patterns.select("c"), BROADCAST_ROWS), "c", "left_semi").join(small(named, BROADCAST_ROWS), "m").select("doc_id", "h", F.col("of").alias("kind"), "a", "b", F.lit(False).alias("base"))
    seeds = scanned.select("doc_id", "h", F.explode("met").alias("x")).filter("x.kind is not null").select("doc_id", "h", "x.kind", "x.a", "x.b", F.lit(True).alias("base"))
    more = _free(added.union(seeds).distinct()).groupBy("doc_id", "h").agg(F.collect_set(F.struct("kind", "a", "b")).alias("found"))
    own = F.transform(F.filter("met", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["a"].alias("a"), x["b"].alias("b")))
    base = scanned.select("doc_id", "h", own.alias("own"))
    joined = base.join(more.withColumnRenamed("doc_id", "id").withColumnRenamed("h", "g"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left")
    none = F.array().cast("array<struct<kind:string,a:bigint,b:bigint>>")
    return joined.select(
        "doc_id", F.filter("own", lambda x: x["kind"] != "secret").alias("base"), F.concat(F.filter("own", lambda x: x["kind"] == "secret"), F.coalesce("found", none)).alias("more")
    )


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows as (key, text) with every base span's kind in its place; the mask is [kind]."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*[_of_kind(base_spans(t, k), k) for k in BASE])
    spans = F.sort_array(F.transform(every, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["kind"].alias("kind"))))
    cut = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["a"] < s["at"], s).otherwise(
            F.struct(x["b"].alias("at"), F.concat(s["out"], F.substring(t, (s["at"] + 1).cast("int"), (x["a"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out"))
        ),
        lambda s: F.concat(s["out"], F.substring(t, (s["at"] + 1).cast("int"), F.length(t))),
    )
    return df.select(key, cut.alias(text))


def listed(spans: Column) -> Column:
    """kind:start:end of spans (kind, a, b), by kind as listed, then start, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("r"), x["a"].alias("a"), x["b"].alias("b"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["b"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    every = F.concat("base", "more")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
