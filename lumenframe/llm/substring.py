"""Substring deduplication with an FM-index per shard.

A window is WINDOW consecutive words of a document.  A word goes when a window covers it whose word sequence also starts
in a document with a smaller doc_id, as the input stands.

Every window has an anchor, the least hash of its K-word grams, so equal windows have equal anchors wherever they are.
Anchors met in one document only are left aside; of the others the stretches of windows they anchor are collected,
equal stretches once with their smallest doc_id, and dealt out by anchor.  Where an anchor has more than HOT different
stretches, as at the ends of a passage that many documents share, the words on either side of the anchor are put in
order, one row a side, so that those with the most words in common are neighbours; a window stays only if it reaches no
farther to either side than that, or if its stretch is in two documents.  What is left is cut out and dealt out, equal
pieces once.  Rows that begin or end a range of this order stay whole.  A shard takes
whole anchors up to SHARD_WORDS words (a larger anchor is a shard of its own) and builds a compressed FM-index of its stretches: suffix order by prefix
doubling as deep as a window, and the Burrows-Wheeler transform in a wavelet matrix of packed bits with sampled ranks.
Classes of suffixes are packed bits too, with a number for each class; the index of a shard takes some 3 bytes a word
beside the words themselves and 12 bytes for each different window.
All stretches are then streamed through backward search, right to left, keeping the longest match up to a window's
length; where it is a window long, the suffixes in its interval tell the smallest document that has it, and the
intervals above the threshold are reported.

Anchors are broadcast to the second scan if there are BROADCAST_ROWS or fewer, and joined by document else.  Words,
grams and stretches are told apart by 64-bit hashes.  Null texts have no words.  A row without an id neither removes
nor loses words; rows with equal ids do not remove from each other; rows equal in id and text get equal results.
Texts of fewer words than a window are kept whole.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import read, small, written
from lumenframe.llm.linededup import runs
from lumenframe.llm.tokens import NOT_BLANK, groups, rolling, sliding_min, spans, text_bytes, word_hashes

WINDOW, K, STRETCH = 50, 8, 48
#: Words of a window beside its anchor.
REACH = WINDOW - K
SHARD_WORDS, BROADCAST_ROWS, HOT = 300_000, 4_000_000, 200


# --- index


class Bits:
    """A bit vector packed in 64-bit words, with the ones before each word counted."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part).astype(np.int64)


class Wavelet:
    """A wavelet matrix: how often a symbol occurs among the first i."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(most).bit_length()) - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            zeros = len(bit) - int(bit.sum())
            self.levels.append((level, Bits(bit), zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        at, begin = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.ones(at), bits.ones(begin)
            at, begin = np.where(one, zeros + a, at - a), np.where(one, zeros + b, begin - b)
        return at - begin


class Classes:
    """Runs of suffixes that begin alike: one packed bit a suffix, and where each run begins."""

    def __init__(self, changed: np.ndarray):
        self.bits = Bits(changed.astype(np.uint8))
        self.heads = np.append(np.flatnonzero(changed), len(changed)).astype(np.int32)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The number of the run that holds each suffix."""
        return self.bits.ones(at + 1) - 1


class Index:
    """FM-index of word sequences (symbols from 1) that bear a value each; windows are looked up with the least value."""

    def __init__(self, sequences: np.ndarray, sizes: np.ndarray, values: np.ndarray, window: int):
        self.window, n = window, int(sizes.sum()) + len(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = np.zeros(n, np.int32)  # 0 ends each sequence
        inside = np.ones(n, bool)
        inside[starts + sizes] = False
        text[inside] = sequences
        self.text, self.starts, self.sizes = text, starts, sizes
        ranks, depth = [np.unique(text, return_inverse=True)[1].astype(np.int32)], 1
        while depth < window:
            ahead = np.zeros(n, np.int64)
            ahead[: n - depth] = ranks[-1][depth:] + 1
            ranks.append(np.unique(ranks[-1] * np.int64(n + 1) + ahead, return_inverse=True)[1].astype(np.int32))
            depth *= 2
        order = np.argsort(ranks[-1], kind="stable").astype(np.int32)
        self.most = int(text.max())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.most + 1))])
        self.wavelet = Wavelet(text[order - 1], self.most)
        self.whole, self.shorter = (Classes(self._changed(ranks, order, d)) for d in (window, window - 1))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        self.least = np.minimum.reduceat(values[owner[order]], self.whole.heads[:-1])

    @staticmethod
    def _changed(ranks: list[np.ndarray], order: np.ndarray, depth: int) -> np.ndarray:
        """Where in suffix order the first `depth` symbols change."""
        changed, at = np.zeros(len(order), bool), 0
        changed[0] = True
        for level in range(len(ranks) - 1, -1, -1):
            if depth >> level & 1:
                own = np.full(len(order), -1, np.int32)
                reach = order + at < len(order)
                own[reach] = ranks[level][order[reach] + at]
                changed[1:] |= own[1:] != own[:-1]
                at += 1 << level
        return changed

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of symbol before what [lo, hi) stands for."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.smaller[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def stream(self, which: np.ndarray | None = None) -> list[np.ndarray]:
        """For each sequence the least value of every window, by matching it right to left."""
        which = np.arange(len(self.sizes)) if which is None else which
        sizes, starts = self.sizes[which], self.starts[which]
        out = [np.zeros(max(0, int(s) - self.window + 1), np.int64) for s in sizes]
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.text), np.int64)
        length = np.zeros(len(which), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            on = np.flatnonzero(sizes >= back)
            full = on[length[on] == self.window]  # a match of a window's length is cut before it grows
            run = self.shorter.of(lo[full])
            lo[full], hi[full] = self.shorter.heads[run], self.shorter.heads[run + 1]
            length[full] -= 1
            at = sizes[on] - back
            lo[on], hi[on] = self.step(self.text[starts[on] + at], lo[on], hi[on])
            length[on] += 1
            done = length[on] == self.window
            for i, a, v in zip(on[done].tolist(), at[done].tolist(), self.least[self.whole.of(lo[on[done]])].tolist(), strict=True):
                out[i][a] = v
        return out


# --- windows and stretches


class Anchored:
    """The words of a group of texts, and the anchor of each window (where `inside`)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = data
        self.starts, self.ends, self.first = spans(data, bounds, NOT_BLANK)
        self.hashes = word_hashes(data, self.starts, self.ends, False)
        self.anchor = sliding_min(rolling(self.hashes, K), WINDOW - K + 1).view(np.int64)
        n = len(self.anchor)
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))[:n]
        self.inside = np.arange(n) + WINDOW <= self.first[1:][self.row] if n else np.zeros(0, bool)

    def stretches(self, shared: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first window, end window, row) of runs of windows with one shared anchor, STRETCH windows or fewer."""
        if not len(shared) or not len(self.anchor):
            return
        at = np.minimum(np.searchsorted(shared, self.anchor), len(shared) - 1)
        good = self.inside & (shared[at] == self.anchor)
        same = good[1:] & good[:-1] & (self.anchor[1:] == self.anchor[:-1]) & (self.row[1:] == self.row[:-1])
        heads = np.flatnonzero(good & ~np.concatenate([[False], same]))
        tails = np.flatnonzero(good & ~np.concatenate([same, [False]])) + 1
        for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
            for s in range(a, b, STRETCH):
                yield s, min(b, s + STRETCH), int(self.row[a])

    def words(self, a: int, b: int) -> bytes:
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes()


def _anchored(texts: pa.Array) -> Iterator[tuple[int, int, Anchored]]:
    data, bounds = text_bytes(texts)
    for a, b in groups(bounds):
        yield a, b, Anchored(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("t")).filter("doc_id is not null")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, doc_id, h): the different anchors of each text."""
    for batch in batches:
        for a, _, found in _anchored(batch.column(2)):
            keep = np.flatnonzero(found.inside)
            if not len(keep):
                continue
            new = np.ones(len(keep), bool)
            new[1:] = (found.anchor[keep[1:]] != found.anchor[keep[:-1]]) | (found.row[keep[1:]] != found.row[keep[:-1]])
            keep = keep[new]
            take = pa.array(found.row[keep] + a)
            yield pa.RecordBatch.from_arrays([pa.array(found.anchor[keep]), batch.column(0).take(take), batch.column(1).take(take)], names=["k", "doc_id", "h"])


def _stretches(shared) -> object:
    """Rows (k, g, doc_id, h, s, x): stretches with their text; the anchors to look for are shared, or in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = batch.column(3).to_pylist() if shared is None else None
            for a, b, found in _anchored(batch.column(2)):
                wanted = shared.value if own is None else np.unique(np.array([x for r in own[a:b] for x in r or ()], np.int64))
                rows: list[tuple] = []
                for s, e, r in found.stretches(wanted):
                    x = b" ".join(found.words(s, e + WINDOW - 1).split())
                    rows.append((int(found.anchor[s]), xxhash.xxh3_64_intdigest(x) - (1 << 63), ids[a + r], hashes[a + r], s - int(found.first[r]), x))
                    if len(rows) == 8192:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64() if i < 5 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=["k", "g", "doc_id", "h", "s", "x"])


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, a, b, least): windows a to b of stretch g start in document least first, shard by shard."""
    k, g, least, texts, words = [], [], [], [], 0
    for batch in runs(batches):
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        own_g, own_least, own_x = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            g += own_g[a:b]
            least += own_least[a:b]
            texts += own_x[a:b]
            words += sum(x.count(b" ") + 1 for x in own_x[a:b])
            if words >= SHARD_WORDS:
                yield from _shard(g, least, texts)
                g, least, texts, words = [], [], [], 0
    if g:
        yield from _shard(g, least, texts)


def _shard(g: list[int], least: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    data, bounds = text_bytes(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    starts, ends, first = spans(data, bounds, NOT_BLANK)
    symbols = np.unique(word_hashes(data, starts, ends, False), return_inverse=True)[1].astype(np.int64) + 1
    values = np.array(least, np.int64)
    index = Index(symbols, np.diff(first), values, WINDOW)
    rows: list[tuple[int, int, int, int]] = []
    for name, found in zip(g, index.stream(), strict=True):
        cut = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
        rows += [(name, a, b, int(found[a])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["g", "a", "b", "least"])


def _grams(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashes of the K-word grams of each stretch."""
    data, bounds = text_bytes(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    starts, ends, first = spans(data, bounds, NOT_BLANK)
    h = word_hashes(data, starts, ends, False)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield rolling(h[a:b], K)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, side, words, g, at): of stretches (k, g, x), what windows can have on either side of the anchor at word `at`.

    side 0 are the words before it, read backwards, and side 1 those after it, a blank after each word.  A window goes by
    the first anchor in it, so an anchor that follows another has no more words before it than up to that one."""
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column(2).to_pylist()
        for k, g, x, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, _grams(texts), strict=True):
            words, last = x.split(b" "), -1
            for at in np.flatnonzero(grams.view(np.int64) == k).tolist():
                lo = max(last + 1, at - REACH)
                last = at
                if lo > len(words) - WINDOW:  # no window has it first
                    break
                before, after = words[lo:at][::-1], words[at + K : at + WINDOW]
                rows += [(k, side, b"".join(w + b" " for w in own), g, at) for side, own in enumerate((before, after))]
        yield _table(rows, {"k": pa.int64(), "side": pa.int32(), "words": pa.binary(), "g": pa.int64(), "at": pa.int32()})


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, at, side, n): how many words rows of _sides, in order, begin with that another of the same anchor and side begins with.

    The most are had in common with a neighbour.  What lies beyond the first and the last row is not known; these count whole."""
    held: tuple | None = None
    before = 0  # what the row held has in common with the one before it
    for batch in batches:
        rows: list[tuple] = []
        for k, side, words, g, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = words.split(b" ")[:-1]
            if held is None:
                same = len(own)
            else:
                same = _leading(held[2], own) if held[:2] == (k, side) else 0
                rows.append((*held[3:], held[1], max(before, same)))
            held, before = (k, side, own, g, at), same
        yield _table(rows, _ALIKE)
    if held:
        yield _table([(*held[3:], held[1], len(held[2]))], _ALIKE)


_ALIKE = {"g": pa.int64(), "at": pa.int32(), "side": pa.int32(), "n": pa.int32()}


def _leading(a: list[bytes], b: list[bytes]) -> int:
    """How many words both begin with."""
    for n, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return n
    return min(len(a), len(b))


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, first, k, piece, x): what stays of stretches (k, g, x, twice, places); all of those that are in two documents,
    and of others the windows that reach no farther from their anchor than another stretch goes along."""
    for batch in batches:
        rows: list[tuple] = []
        for k, g, x, twice, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = x.split(b" ")
            good = np.full(len(words) - WINDOW + 1, twice)
            for p in places or ():
                good[p["at"] - p["l"] : max(0, min(p["at"], p["at"] + p["r"] - REACH) + 1)] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                piece = b" ".join(words[a : b + WINDOW - 1])
                rows.append((g, a, k, xxhash.xxh3_64_intdigest(piece) - (1 << 63), piece))
        yield _table(rows, {"g": pa.int64(), "first": pa.int64(), "k": pa.int64(), "piece": pa.int64(), "x": pa.binary()})


def _cooled(forms: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(stretches to index, pieces of those of hot anchors), or None where no anchor is hot.  forms: (k, g, least, most, x)."""
    counts = forms.groupBy("k").count().filter(F.col("count") > HOT).select("k")
    hot = written(counts, "hot-anchors")
    if hot.isEmpty():
        return None
    hot = small(hot)
    many = written(forms.join(hot, "k", "left_semi"), "hot-stretches")
    sides = written(many.select("k", "g", "x").mapInArrow(_sides, "k long, side int, words binary, g long, at int"), "hot-sides")
    order = ["k", "side", "words", "g", "at"]  # a range may begin anywhere, so no anchor has to be in one task
    alike = sides.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_alike, "g long, at int, side int, n int")
    reach = alike.groupBy("g", "at").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    places = reach.groupBy("g").agg(F.collect_list(F.struct("at", "l", "r")).alias("places"))
    rows = many.withColumn("twice", F.col("least") < F.col("most")).join(places, "g", "left").select("k", "g", "x", "twice", "places")
    pieces = written(rows.mapInArrow(_pieces, "g long, first long, k long, piece long, x binary"), "pieces")
    cut = pieces.select("g", "k", "piece", "x").join(many.select("g", "least"), "g").groupBy("k", "piece").agg(F.min("least").alias("least"), F.first("x").alias("x"))
    rest = forms.join(hot, "k", "left_anti").select("k", "g", "least", "x")
    return rest.union(cut.select("k", F.col("piece").alias("g"), "least", "x")), pieces


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, spans): for documents with repeated words, the intervals of words that go (a to b, end exclusive, may overlap)."""
    spark = df.sparkSession
    rows = _rows(df, key, text)
    met = rows.mapInArrow(_anchors, "k long, doc_id long, h long")
    shared = written(met.groupBy("k").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("n")).filter("m < n").select("k"), "anchors")
    n = shared.count()
    if n <= BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in shared.toLocalIterator()), np.int64, n)))
        found = rows.mapInArrow(_stretches(known), "k long, g long, doc_id long, h long, s long, x binary")
    else:
        own = met.join(shared, "k").groupBy("doc_id", "h").agg(F.collect_set("k").alias("own"))
        found = rows.join(own, ["doc_id", "h"]).select("doc_id", "h", "t", "own").mapInArrow(_stretches(None), "k long, g long, doc_id long, h long, s long, x binary")
    found = written(found, "stretches")
    forms = written(found.groupBy("k", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("x").alias("x")), "forms")
    cooled = _cooled(forms)
    indexed = cooled[0] if cooled else forms.select("k", "g", "least", "x")
    dealt = indexed.repartition(F.col("k")).sortWithinPartitions("k", "g")
    told = written(dealt.mapInArrow(_reported, "g long, a long, b long, least long"), "reported")
    if cooled:  # what is said of a piece goes for every stretch it is cut from
        own = cooled[1].select("g", "first", "piece").join(told.withColumnRenamed("g", "piece"), "piece")
        hot = cooled[1].select("piece").distinct()
        told = told.join(hot, told.g == hot.piece, "left_anti").union(own.select("g", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"), "least"))
        told = written(told, "reported")
    hits = found.select("g", "doc_id", "h", "s").join(told, "g").filter("least < doc_id")
    return hits.select("doc_id", "h", F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + F.lit(WINDOW - 1)).alias("b")).alias("x")).groupBy("doc_id", "h").agg(F.collect_set("x").alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, gone, texts = [], [], []
        for text, own in zip(batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or "").encode().split()
            intervals = own.as_py()
            count.append(len(words))
            if intervals:
                keep = np.ones(len(words), bool)
                for x in intervals:
                    keep[x["a"] : x["b"]] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            gone.append(count[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        yield batch.select(["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and kept, the words that stay joined by spaces, if texts) for every row of df."""
    found = repeats(df, key, text).withColumnRenamed("doc_id", "__id").withColumnRenamed("h", "__h")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__key"))
    joined = rows.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__h")), "left").select("doc_id", "t", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return joined.mapInArrow(_kept if texts else _digests, schema + ", kept string" * texts)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"), texts=False)


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT u, doc_id, i, array_to_string(w[i : i + 49], ' ') AS x FROM (SELECT u, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), m AS (
  SELECT u, i FROM (SELECT u, i, doc_id, min(doc_id) OVER (PARTITION BY x) AS least FROM p) WHERE least < doc_id
), g AS (
  SELECT DISTINCT u, k FROM (SELECT u, unnest(range(i, i + 50)) AS k FROM m)
), k AS (
  SELECT d.u, count(g.k) AS gone, string_agg(e.x, ' ' ORDER BY e.k) FILTER (g.k IS NULL) AS kept
  FROM d JOIN (SELECT u, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) e ON d.u = e.u LEFT JOIN g ON e.u = g.u AND e.k = g.k GROUP BY d.u
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.u = k.u
"""
