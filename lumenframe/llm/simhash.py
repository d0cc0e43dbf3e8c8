"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set where over half the hashes of the text's three-word shingles have it.  The anchors are the
words of a covering code: nine blocks of the perfect [7,4] Hamming code (covering radius one each) and one free bit.
Each 64-bit point has one nearest anchor.  Two fingerprints that differ in two bits or fewer have a point between them
at one bit or less from both, so both are within one bit of that point's cell: replicating a fingerprint to the
anchors of its own cell and of the cells one flip away (26 or fewer, all within covering radius plus threshold) lets
every such pair meet.  Fingerprints are compared per anchor, equal ones only once.  Anchors that many different
fingerprints share are not compared in pairs: fingerprints of a group are linked through the points one flip away from
them, which costs 65 values each; a group above HOT_GROUP is dealt out again by these points, which at most 65
fingerprints share.

Null and empty texts have the fingerprint zero and are linked like any other.  Texts of any length are hashed in
sections.  Rows without an id take part in the links but name no component (a component of such rows only has a null
id).  Repeated rows get equal results; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import read, written
from lumenframe.llm.graph import Union, components
from lumenframe.llm.tokens import text_bytes

SEED, SHINGLE, THRESHOLD = 42, 3, 2
SECTION, HOT_GROUP = 1 << 15, 50_000


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, SECTION):
        part = words[at : at + SECTION + SHINGLE - 1]
        count = len(part) - SHINGLE + 1
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(part, part[1:], part[2:], strict=False)), repeat(SEED)), np.uint64, count)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the id of each row and its fingerprint as a signed long."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_column(batch.column(1)))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def _column(texts: pa.Array) -> np.ndarray:
    data, bounds = text_bytes(texts)
    whole = memoryview(data) if len(data) else memoryview(b"")
    found = [fingerprint(bytes(whole[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.array(found, np.uint64).view(np.int64)


def hamming_tables() -> tuple[np.ndarray, list[list[int]]]:
    """For each 7-bit block: the index of its nearest code word, and those of the other cells one flip away."""

    def encode(d: int) -> int:
        a, b, c, e = (d >> i & 1 for i in range(4))
        return d | (a ^ b ^ c) << 4 | (a ^ b ^ e) << 5 | (a ^ c ^ e) << 6

    words = [encode(d) for d in range(16)]
    nearest = np.array([min(range(16), key=lambda d: (words[d] ^ x).bit_count()) for x in range(128)], np.uint64)
    others = [sorted({int(nearest[x ^ 1 << b]) for b in range(7)} - {int(nearest[x])}) for x in range(128)]
    return nearest, others


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors that each fingerprint is replicated to."""
    nearest, others = hamming_tables()
    most = max(map(len, others))
    table = np.array([o + [99] * (most - len(o)) for o in others], np.uint64)
    blocks = [(fp >> np.uint64(7 * j)) & np.uint64(127) for j in range(9)]
    free = (fp >> np.uint64(63)) << np.uint64(36)
    home = free.copy()
    for j, b in enumerate(blocks):
        home |= nearest[b] << np.uint64(4 * j)
    rows, found = [np.arange(len(fp))] * 2, [home, home ^ np.uint64(1 << 36)]
    for j, b in enumerate(blocks):
        cleared = home & ~np.uint64(15 << 4 * j)
        for c in range(most):
            other = table[b, c]
            has = np.flatnonzero(other != 99)
            rows.append(has)
            found.append(cleared[has] | other[has] << np.uint64(4 * j))
    return np.concatenate(rows), np.concatenate(found)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fp), 1 << 13):
            part = fp[at : at + (1 << 13)]
            row, anchor = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[row].view(np.int64))], names=["k", "fp"])


_FLIPS = np.array([0, *(1 << b for b in range(64))], np.uint64)


def linked(group: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is connected among different fingerprints at two bits or fewer, one less than members at most."""
    if len(group) == 2:
        return [tuple(group.tolist())] if int(group[0] ^ group[1]).bit_count() <= THRESHOLD else []
    union, out = Union(), []
    if len(group) <= 48:
        a, b = np.nonzero(np.triu(np.bitwise_count(group[:, None] ^ group[None, :]) <= THRESHOLD, 1))
        pairs = zip(group[a].tolist(), group[b].tolist(), strict=True)
        return [p for p in pairs if union.join(*p)]
    passes = 1 + len(group) * 65 // (1 << 22)
    for p in range(passes):
        near = (group[:, None] ^ _FLIPS[None, :]).ravel()
        who = np.repeat(np.arange(len(group)), 65)
        if passes > 1:
            own = (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == p
            near, who = near[own], who[own]
        order = np.argsort(near, kind="stable")
        near, who = near[order], who[order]
        same = np.flatnonzero(near[1:] == near[:-1])
        ends = np.unique(np.stack([who[same], who[same + 1]], 1), axis=0)
        out += [pair for pair in zip(group[ends[:, 0]].tolist(), group[ends[:, 1]].tolist(), strict=True) if union.join(*pair)]
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Whole groups of a partition sorted by its first column: (keys, fingerprints) of many groups, and whether it is part of one that is too large."""
    held_k, held_x, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        x = np.concatenate([held_x, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(k):
            continue
        if hot is not None:
            n = int(np.searchsorted(k, hot, "right"))
            if n:
                yield k[:n], x[:n], True
            k, x = k[n:], x[n:]
            if len(k):
                hot = None
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if last:
            yield k[:last], x[:last], False
        held_k, held_x = k[last:], x[last:]
        if len(held_k) > HOT_GROUP:
            hot = held_k[0]
            yield held_k, held_x, True
            held_k, held_x = held_k[:0], held_x[:0]
    if len(held_k):
        yield held_k, held_x, False


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(z, a, b): edges, where z is null; fingerprints a of too large groups with each point z at one flip or none."""

    def out(z, a, b):
        return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["z", "a", "b"])

    for k, x, hot in _grouped(batches):
        if hot:
            for at in range(0, len(x), 1 << 12):
                part = x[at : at + (1 << 12)]
                yield out((part[:, None] ^ _FLIPS[None, :]).ravel().view(np.int64), np.repeat(part, 65).view(np.int64), pa.nulls(65 * len(part), pa.int64()))
            continue
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        near = two[np.bitwise_count(x[two] ^ x[two + 1]) <= THRESHOLD]
        pairs = list(zip(x[near].tolist(), x[near + 1].tolist(), strict=True))
        for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            pairs += linked(x[at : at + n])
        if pairs:
            ends = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
            yield out(pa.nulls(len(ends), pa.int64()), ends[:, 0].copy(), ends[:, 1].copy())


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between neighbours among the fingerprints of a point."""
    last_z = last_x = None
    for batch in batches:
        z, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(z):
            continue
        if last_z is not None:
            z, x = np.concatenate([[last_z], z]), np.concatenate([[last_x], x])
        same = np.flatnonzero((z[1:] == z[:-1]) & (x[1:] != x[:-1]))
        last_z, last_x = z[-1], x[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[same]), pa.array(x[same + 1])], names=["a", "b"])


def edges(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect the different fingerprints of distinct (fp) as all pairs at two bits or fewer do."""
    dealt = distinct.select("fp").mapInArrow(_replicas, "k long, fp long").repartition(F.col("k")).sortWithinPartitions("k", "fp")
    found = written(dealt.mapInArrow(_compare, "z long, a long, b long"), "links")
    again = found.filter("z is not null").select("z", "a").repartition(F.col("z")).sortWithinPartitions("z", "a").mapInArrow(_meet, "a long, b long")
    return found.filter("z is null").select("a", "b").union(again)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of prints (doc_id, fp): the least fingerprint and the smallest id that can be reached."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    reached = components(edges(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(reached, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(whole, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of df."""
    prints = written(fingerprints(df, key, text), "simhash")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "root", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
