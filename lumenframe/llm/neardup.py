"""One document of each group of near-duplicates, for the pipeline.

Two texts are linked when their SimHashes are within the bits of op10_simhash, or when the Jaccard similarity of their
sets of five-word shingles is JACCARD or more.  Pairs of the second kind are found by MinHash: texts of similarity 0.8
agree in one of BANDS bands of ROWS minima with a probability of 99.6 %, and each such pair is checked on its shingles
unless connected already.  Of every connected group a row with the smallest id stays; a null id comes after all others.

Bands of the same members are checked once, and bands of the same least member together; a band of more than HOT texts
is cut into slices that have some texts in common, so no task gets it whole; texts that this leaves outside of the band's
largest group then meet all texts of the band, in tasks of two parts of it, so no link is lost.  Texts are shuffled only where they have a
partner to be checked with, or are in rows that are repeated; which rows go is broadcast if they are few, else joined.

Null and empty texts are alike, having the SimHash zero.  Texts of under five words have no shingles.  Rows equal in id
and text count once.  Texts are told apart, and shingles compared, by 64-bit hashes.  Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import simhash
from lumenframe.llm.common import fresh_name, small, written
from lumenframe.llm.graph import Linked, Union, apart, components, tasks
from lumenframe.llm.linededup import named, runs
from lumenframe.llm.tokens import NOT_BLANK, SHARED_BYTES, groups, rolling, spans, text_bytes, thrifty, word_hashes

SHINGLE, JACCARD, HOT, PART = 5, 0.8, 500, 250
BANDS, ROWS = 14, 5
_ODD = 0xC2B2AE3D27D4EB4F
#: Odd factors, one for each minimum.
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * r + 1) ^ r << 33) % (1 << 64) | 1 for r in range(BANDS * ROWS)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD)
    return x ^ (x >> np.uint64(32))


def _shingled(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of shingles, bounds of each text's) of groups of texts."""
    data, bounds = text_bytes(texts)
    for a, b in groups(bounds, SHARED_BYTES):
        part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        starts, ends, first = spans(part, own, NOT_BLANK)
        h = rolling(word_hashes(part, starts, ends, True), SHINGLE)
        count = np.maximum(np.diff(first) - (SHINGLE - 1), 0)
        at = np.repeat(first[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        yield a, h[at], np.concatenate([[0], np.cumsum(count)])


def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of shingle hashes of each text, sorted."""
    for _, h, bounds in _shingled(texts):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(h[a:b])


def keys(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The keys of the bands of texts, whose shingles begin at heads."""
    out = np.empty((len(heads), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(heads), b, np.uint64)
        for r in range(b * ROWS, b * ROWS + ROWS):
            key = _mixed(key * np.uint64(_ODD) + np.minimum.reduceat(h * _FACTORS[r], heads))
        out[:, b] = key
    return out


@thrifty
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, t) of texts (t, x); equal ones of a batch count once."""
    for batch in batches:
        t = batch.column(0).to_numpy(zero_copy_only=False)
        for first, h, bounds in _shingled(batch.column(1)):
            has = np.flatnonzero(np.diff(bounds))
            _, new = np.unique(t[first + has], return_index=True)
            if len(has):
                found = keys(h, bounds[has])[new]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(t[first + has][new], BANDS))], names=["k", "t"])


@thrifty
def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, c, t, b) of bands that different texts share; b names those cut in slices, and is null elsewhere."""
    for batch in runs(batches):
        k, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
        k, t = k[new], t[new]
        same, hit = np.flatnonzero(k[1:] == k[:-1]), np.zeros(len(k), bool)
        hit[same] = hit[same + 1] = True
        if hit.any():
            p, c, take, b = named(k[hit], t[hit], HOT)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c), pa.array(t[hit][take]), pa.array(b, mask=b == 0)], names=["p", "c", "t", "b"])


class Checked(Linked):
    """Texts of bands that are checked together."""

    def __init__(self, names: list[int], sets: list[np.ndarray]):
        super().__init__(names)
        self.sets, self.size = sets, np.array([len(x) for x in sets])

    def hopeful(self, i: int, among: np.ndarray) -> np.ndarray:
        return among[np.minimum(self.size[among], self.size[i]) >= JACCARD * np.maximum(self.size[among], self.size[i]) - 1e-9]

    def like(self, i: int, j: int) -> bool:
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return both >= JACCARD * (self.size[i] + self.size[j] - both) - 1e-9


@thrifty
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of texts (p, t, x, c), whose bands c are told."""
    for batch in runs(batches):
        p = batch.column(0).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])).tolist()
        t, out, union = batch.column(1).to_pylist(), [], Union()
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            checked = Checked(t[s:e], list(shingles(batch.column(2).slice(s, e - s))))
            of: dict[int, list[int]] = {}
            for i, own in enumerate(batch.column(3).slice(s, e - s).to_pylist()):
                for c in own:
                    of.setdefault(c, []).append(i)
            for rows in sorted(of.values()):
                checked.bucket(np.array(rows))
            out += [x for x in checked.links if union.join(*x)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


@thrifty
def _verify_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links between texts (t, odd, g, root, x), in order of t, of different groups."""
    for batch in runs(batches):
        for rows, odd, others, root in tasks(batch):
            checked = Checked(rows.column(2).to_pylist(), list(shingles(rows.column(4))))
            checked.root = root
            for i in odd.tolist():
                checked.against(i, others)
            if checked.links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*checked.links, strict=True)], names=["a", "b"])


def links(df: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links between text hashes that connect what the pairs of JACCARD or more connect."""
    texts = df.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), F.col(text).alias("x"))
    dealt = texts.mapInArrow(_keyed, "k long, t long").repartition(F.col("k")).sortWithinPartitions("k", "t")
    buckets = written(dealt.mapInArrow(_partners, "p long, c long, t long, b long").groupBy("p", "t").agg(F.collect_set("c").alias("c"), F.max("b").alias("b")), "near-buckets")
    wanted = written(buckets.select("t").distinct(), "near-wanted")
    wanted = texts.join(small(wanted), "t", "left_semi").groupBy("t").agg(F.first("x").alias("x"))
    checked = buckets.join(wanted, "t").select("p", "t", "x", "c").repartition(F.col("p")).sortWithinPartitions("p", "t")
    first = checked.mapInArrow(_verify, "a long, b long")
    hot = buckets.filter("b is not null").select("b", F.col("t").alias("g")).distinct()
    if hot.isEmpty():
        return first
    first = written(first, "near-links")
    left = written(apart(hot, first, PART), "near-apart")
    own = texts.join(small(left.select(F.col("g").alias("t")).distinct()), "t", "left_semi").groupBy("t").agg(F.first("x").alias("x"))
    again = left.join(own.withColumnRenamed("t", "g"), "g").select("t", "odd", "g", "root", "x").repartition(F.col("t")).sortWithinPartitions("t", "odd", "g")
    return first.union(again.mapInArrow(_verify_apart, "a long, b long"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows of one document per group: that with the smallest id, and of repeated rows one."""
    rows = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), F.col(text).alias("x"))

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(simhash._column(batch.column(2)))], names=["doc_id", "t", "fp"])

    prints = written(rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, t long, fp long"), "near-prints")
    close = prints.select("t", "fp").distinct().join(simhash.classes(prints.select("doc_id", "fp")), "fp").select(F.col("t").alias("a"), F.col("root").alias("b"))
    close = written(close, "near-close")
    several = close.groupBy("b").count().filter("count > 1").select("b")  # texts meet in the root of their fingerprints
    reached = components(close.join(several, "b", "left_semi").select("a", "b").union(links(df, text))).withColumnRenamed("node", "t")
    # texts that are alone stay out of what follows
    again = prints.groupBy("t").count().filter("count > 1").select("t")
    shared = written(again.join(reached, "t", "full_outer").select("t", F.coalesce("root", "t").alias("root")), "near-shared")
    rooted = written(prints.select("doc_id", "t").join(small(shared), "t"), "near-rooted")
    place = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("d"), F.col("t").alias("t"))
    firsts = written(rooted.groupBy("root").agg(F.min(place).alias("first")), "near-firsts")
    goes = rooted.join(firsts, "root").filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "t")
    goes = written(written(goes, "near-goes").distinct(), "near-gone")
    twice = written(rooted.groupBy("doc_id", "t").count().filter("count > 1").select("doc_id", "t"), "near-twice")
    own = fresh_name(df, "__text")
    marked = df.withColumn(own, F.xxhash64(F.coalesce(text, F.lit(""))))

    def without(df: DataFrame, these: DataFrame, how: str) -> DataFrame:
        named = small(these).alias("these")
        return df.join(named, (F.col(own) == F.col("these.t")) & F.col(f"all.{key}").eqNullSafe(F.col("these.doc_id")), how)

    left = without(marked.alias("all"), goes, "left_anti")
    once = without(left.alias("all"), twice, "left_anti")
    return once.union(without(left.alias("all"), twice, "left_semi").dropDuplicates([key, own])).drop(own)
