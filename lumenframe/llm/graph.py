"""Connected components of an edge table, by alternating large and small stars.

Edges are first replaced by the stars of a union-find inside each partition, then contracted until nothing changes;
every round is written to the shared folder, so a lost executor costs one round at most.  A node of very many edges
is met only by an aggregate and a join that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import small, written


class Union:
    """Union-find with the least member as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


class Linked:
    """Links among candidates, bucket by bucket: no pair is tested twice, and none that is connected already.

    hopeful(i, among) gives those of `among` that may be like i, and like(i, j) decides."""

    def __init__(self, names: list[int]):
        self.names, self.root, self.unlike, self.links = names, np.arange(len(names)), set(), []

    def hopeful(self, i: int, among: np.ndarray) -> np.ndarray:
        return among

    def like(self, i: int, j: int) -> bool:
        raise NotImplementedError

    def against(self, i: int, among: np.ndarray) -> None:
        """Find links that connect row i with all groups that it has a link with, among these rows."""
        for j in self.hopeful(i, among[self.root[among] != self.root[i]]).tolist():
            pair = (min(i, j), max(i, j))
            if self.root[j] == self.root[i] or pair in self.unlike:
                continue
            if self.like(i, j):
                self.links.append((self.names[i], self.names[j]))
                self.root[self.root == max(self.root[i], self.root[j])] = min(self.root[i], self.root[j])
            else:
                self.unlike.add(pair)

    def bucket(self, rows: np.ndarray) -> None:
        """Find links that connect what all links among the rows connect.

        A row is compared with one of each group first, and then, where groups are left apart, with the others."""
        heads = [int(rows[0])]
        for n in range(1, len(rows)):
            i = int(rows[n])
            for among in (np.array(heads), rows[:n]):
                self.against(i, among)
                if len({int(self.root[h]) for h in heads}) == 1 and self.root[i] == self.root[heads[0]]:
                    break
            heads = sorted({int(self.root[h]): h for h in (i, *heads[::-1])}.values())


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as (member, root) of its own components."""
    union = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_numpy(zero_copy_only=False).tolist(), batch.column(1).to_numpy(zero_copy_only=False).tolist(), strict=True):
            union.join(a, b)
    members = [x for x in union.up if union.find(x) != x]
    for at in range(0, len(members), 1 << 16):
        part = members[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([union.find(x) for x in part], pa.int64())], names=["a", "b"])


def apart(hot: DataFrame, first: DataFrame, part: int) -> DataFrame:
    """(t, odd, g, root, and the other columns of hot): tasks in which the rows of hot buckets meet that links leave apart.

    hot: (b, g, ...), the rows g of each bucket b, whose other columns go with g; first: (a, b), links found so far, written.
    Rows outside of a bucket's largest group (odd) meet all of its rows, part by part; buckets of the same largest group
    are taken as one, and those of one group left out.  Rows of equal root are connected already."""
    more = [x for x in hot.columns if x not in ("b", "g")]
    reached = components(first).withColumnRenamed("node", "g")
    rooted = written(hot.join(reached, "g", "left").select("b", "g", F.coalesce("root", "g").alias("root"), *more), "hot-rooted")
    sizes = rooted.groupBy("b", "root").count()
    most = sizes.groupBy("b").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    most = written(most.select("b", "main"), "hot-groups")
    rows = rooted.join(small(most), "b").select("main", "g", "root", *more).distinct()
    rows = written(rows.withColumn("odd", F.col("root") != F.col("main")), "hot-rows")
    size = lambda n: F.ceil(n / part).cast("int")
    parts = rows.groupBy("main").agg(size(F.count("*")).alias("n"), size(F.count_if("odd")).alias("m"))
    own, out = F.pmod(F.xxhash64("g"), F.col("n")).cast("int"), F.pmod(F.xxhash64("g", F.lit(1)), F.col("m")).cast("int")
    task = lambda odd, i, j: F.struct(F.xxhash64("main", i, j).alias("t"), F.lit(odd).alias("odd"))
    every = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: task(False, i, own))
    again = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: task(True, out, j))
    met = rows.join(small(parts), "main").select("g", "root", *more, F.explode(F.when(F.col("odd"), F.concat(every, again)).otherwise(every)).alias("e"))
    return met.select("e.t", "e.odd", "g", "root", *more)


def tasks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, odd ones, others, groups) of each task in rows (t, odd, g, root, ...) in order of t; groups as in Linked.root."""
    t = batch.column(0).to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows = batch.slice(a, b - a)
        odd = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
        _, first, which = np.unique(rows.column(3).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        yield rows, np.flatnonzero(odd), np.flatnonzero(~odd), first[which]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); the root is the least node of the component."""
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(stars, "a long, b long").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        pairs = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
        now = written(pairs.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

