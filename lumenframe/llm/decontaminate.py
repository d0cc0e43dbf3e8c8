"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words, but not none, is one window.  In
each window of words the least hash of its K-word grams is its fingerprint (the rightmost of equal ones is kept), in
items and documents alike, so every shared window selects the same gram on both sides.  Kept grams of documents are
joined with those of the items, and each match is extended to the windows around it, which count where an item has them.
Windows of short items are compared as a whole.  Words and windows are compared by 64-bit hashes.  A gram's places in
items are not paired with its places in a document, so texts and items that repeat themselves cost no more than others.

The benchmark side is broadcast in blocks of at most BLOCK_WORDS words (about 100 MB in a worker).  Documents are read
once and not shuffled: a benchmark of more than one block is met block after block by HELD_BYTES of documents at a time,
so nothing is cut off and nothing grows with the corpus.

Nulls have no words; documents without words are never hit and items without words have no window.  Repeated items
and item ids count once in n_items, a null item id is written as `null`, repeated documents get equal results, and
other columns are carried along or left alone.  Very long texts are handled as a whole, in arrays of a few words' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import read
from lumenframe.llm.tokens import ALPHANUMERIC, SHARED_BYTES, groups, rolling, sliding_min, spans, text_bytes, thrifty, word_hashes

WINDOW, K, BLOCK_WORDS, HELD_BYTES = 13, 5, 1_000_000, 64 << 20
FOUND = "struct<n_words:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>>"
_FOUND = pa.struct({"n_words": pa.int64(), "spans": pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()})), "items": pa.list_(pa.string())})


def picked(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, positions of the kept ones) of the texts whose words have the hashes h; bounds: first words of texts."""
    grams = rolling(h, K)
    width = WINDOW - K + 1
    least = sliding_min(grams, width)
    if not len(least):
        return grams, np.zeros(0, np.int64)
    inside = np.ones(len(least), bool)  # windows that do not cross into the next text
    for j in range(1, WINDOW):
        cross = bounds[1:-1] - j
        inside[cross[(cross >= 0) & (cross < len(least))]] = False
    kept = np.zeros(len(grams), bool)
    at = np.flatnonzero(inside)
    place = np.zeros(len(at), np.int64)
    for o in range(width):
        place[grams[at + o] == least[at]] = o
        # later offsets win: the rightmost
    kept[at + place] = True
    return grams, np.flatnonzero(kept)


class Block:
    """A block of items, ready to be met by documents: kept grams, and for each size of window which items have it."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        data, bounds = text_bytes(pa.array(texts, pa.large_string()))
        starts, ends, first = spans(data, bounds, ALPHANUMERIC)
        h = word_hashes(data, starts, ends, True)
        sizes = np.diff(first)
        self.ids = ids
        grams, kept = picked(h, first)
        self.prints = np.unique(grams[kept])
        item, end = np.repeat(np.arange(len(ids)), sizes), np.repeat(first[1:], sizes)
        at = np.flatnonzero(np.arange(len(h)) + WINDOW <= end)
        self.windows = {WINDOW: self._listed(rolling(h, WINDOW)[at], item[at])} if len(at) else {}
        for n in sorted({int(s) for s in sizes if 0 < s < WINDOW}):
            own = np.flatnonzero(sizes == n)
            self.windows[n] = self._listed(np.array([rolling(h[first[i] : first[i] + n], n)[0] for i in own.tolist()], np.uint64), own)

    @staticmethod
    def _listed(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different windows, where the items of each begin, items)."""
        order = np.lexsort((items, windows))
        windows, items = windows[order], items[order]
        new = np.concatenate([[True], (windows[1:] != windows[:-1]) | (items[1:] != items[:-1])])
        windows, items = windows[new], items[new]
        head = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
        return windows[head], np.append(head, len(windows)), items

    def meet(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """(starts, lengths) of the hit windows of documents, and the items that each document has windows of."""
        begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
        out: list[tuple[np.ndarray, int]] = []
        items: list[set[int]] = [set() for _ in range(len(first) - 1)]
        for n, (keys, head, listed) in self.windows.items():
            whole = rolling(h, n)
            if n == WINDOW:
                grams, kept = picked(h, first)
                kept = kept[np.isin(grams[kept], self.prints)]
                at = np.zeros(len(whole), bool)  # windows around a match
                for o in range(WINDOW - K + 1):
                    s = kept - o
                    at[s[(s >= begin[kept]) & (s + WINDOW <= end[kept])]] = True
                at = np.flatnonzero(at)
            else:
                at = np.arange(len(whole))
            at = at[at + n <= end[at]]
            at = at[np.isin(whole[at], keys)]
            if not len(at):
                continue
            out.append((at, n))
            met = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, np.searchsorted(keys, whole[at])], 1), axis=0)
            for d, k in met.tolist():
                items[d].update(listed[head[k] : head[k + 1]].tolist())
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), items
        return np.concatenate([a for a, _ in out]), np.concatenate([np.full(len(a), n) for a, n in out]), items


def intervals(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The union of windows as disjoint intervals."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), (starts + lengths).tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _found(texts: pa.Array, block: Block) -> list[dict]:
    data, bounds = text_bytes(texts)
    rows: list[dict] = []
    for a, b in groups(bounds, SHARED_BYTES):
        part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        starts, ends, first = spans(part, own, ALPHANUMERIC)
        begun, size, items = block.meet(word_hashes(part, starts, ends, True), first)
        made = [{"n_words": n, "spans": [], "items": sorted({block.ids[i] for i in of})} for n, of in zip(np.diff(first).tolist(), items, strict=True)]
        if len(begun):
            doc = np.searchsorted(first, begun, "right") - 1
            order = np.argsort(doc, kind="stable")
            for own_rows in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                d = int(doc[own_rows[0]])
                made[d]["spans"] = [{"a": x, "b": y} for x, y in intervals(begun[own_rows] - first[d], size[own_rows])]
        rows += made
    return rows


def _both(a: dict, b: dict) -> dict:
    """What a document has of two blocks."""
    lengths = lambda x: np.array([s["b"] - s["a"] for s in x["spans"]], np.int64)
    starts = np.array([s["a"] for x in (a, b) for s in x["spans"]], np.int64)
    return {"n_words": a["n_words"], "spans": [{"a": x, "b": y} for x, y in intervals(starts, np.concatenate([lengths(a), lengths(b)]))], "items": sorted({*a["items"], *b["items"]})}


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """Items, streamed to the driver in blocks of about `limit` words."""
    ids, texts, size = [], [], 0
    for i, t in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), text).toLocalIterator():
        ids.append(i)
        texts.append(t)
        size += len(t or "") // 2 + 1
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "found", block_words: int = BLOCK_WORDS) -> DataFrame:
    """df with a struct: n_words, the hit words as intervals (spans a to b, end exclusive), and the ids of the items hit."""
    context = df.sparkSession.sparkContext
    shared = [context.broadcast(b) for b in blocks(benchmark, item, item_text, block_words)]

    def met(held: list[pa.Array], block: Block | None) -> Iterator[pa.Array]:
        found: list[list[dict]] = []
        for part in shared:
            block = block or Block(*part.value)
            own = [_found(texts, block) for texts in held]
            found = [[_both(a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(found, own, strict=True)] if found else own
            block = None
        for rows in found:
            yield pa.array(rows, _FOUND)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only = Block(*shared[0].value) if len(shared) == 1 else None
        held: list[pa.Array] = []
        for texts in batches:
            held.append(texts)
            if only or sum(x.nbytes for x in held) >= HELD_BYTES:
                yield from met(held, only)
                held = []
        yield from met(held, only)

    return df.withColumn(out, F.arrow_udf(thrifty(run), FOUND)(F.col(text)))


def hit_words(found: Column) -> Column:
    """Words inside the intervals, which may overlap."""
    return F.aggregate(
        F.sort_array(found["spans"]),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "found", hit_words(F.col("found")).alias("n_hit"))
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), "n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("found.n_words")).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT u, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS u, doc_id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), q AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS x
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), z AS (
  SELECT DISTINCT n FROM q
), p AS (
  SELECT u, n, i, array_to_string(w[i : i + n - 1], ' ') AS x
  FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z)
), h AS (
  SELECT p.u, p.i, p.n, q.item_id FROM p JOIN q ON p.n = q.n AND p.x = q.x
), c AS (
  SELECT u, count(DISTINCT k) AS n_hit FROM (SELECT u, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT u, i, n FROM h)) GROUP BY u
), e AS (
  SELECT u, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY u
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.u = c.u LEFT JOIN e ON d.u = e.u
"""
