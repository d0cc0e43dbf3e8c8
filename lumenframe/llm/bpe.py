"""Byte-pair encoding and decoding with a published byte-level vocabulary.

A text is cut into special tokens and pieces, each piece is merged by a priority queue of merge ranks over a doubly
linked list of symbols (entries whose symbols have changed meanwhile are skipped), and ids are decoded by joining
vocabulary strings.  The vocabulary (1 to 3 MB, a fixed file) is read on the driver and broadcast; rows never leave
their partition, so a lost task is simply run again.

Nulls are empty texts.  Empty texts have no ids.  Very long texts are encoded in sections cut between pieces, so the
memory in use does not follow the text.  Repeated rows give repeated results and other columns are untouched.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import read
from lumenframe.llm.tokens import pieces, thrifty

#: The pieces of byte-level pre-tokenisation, as published with the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters in a section of a long text, and pieces whose ids are remembered.
SECTION, REMEMBERED, LONGEST_REMEMBERED = 1 << 18, 1 << 19, 48


def byte_characters() -> dict[int, str]:
    """Printable bytes stand for themselves; the others, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Remembered(dict):
    """For each piece (ids, the ids in decimals, the bytes they stand for); pieces met often are merged once."""

    def __init__(self, codec: Codec, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str, bytes]:
        made = self.codec.described(self.codec.merge(piece))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.clear()
            self[piece] = made
        return made


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: dict, remembered: int = REMEMBERED):
        self.vocab: dict[str, int] = spec["vocab"]
        self.special: dict[str, int] = spec["special"]
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        chars = byte_characters()
        back = {c: b for b, c in chars.items()}
        self.first = [self.vocab[chars[b]] for b in range(256)]
        # a character that stands for no byte is kept as it is
        self.strings = {i: b"".join(bytes([back[c]]) if c in back else c.encode() for c in s) for i, s in names.items()}
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: rank for rank, (a, b) in enumerate(spec["merges"])}
        self.made = [self.vocab[a + b] for a, b in spec["merges"]]
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile(r"(?<=\S)(?= \S)")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Remembered(self, remembered)

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece: the lowest rank, and of equal ranks the leftmost, is merged first."""
        first, ranks, made = self.first, self.ranks.get, self.made
        ids = [first[b] for b in piece.encode("utf-8")]
        n = len(ids)
        if n == 1:
            return (ids[0],)
        now = [ranks(a << 20 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]  # rank of the pair that begins at i
        queue = [rank << 32 | i for i, rank in enumerate(now) if rank >= 0]
        now.append(-1)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if now[i] != rank:
                continue  # stale: one of the two symbols has been merged since
            j = right[i]
            symbol = ids[i] = made[rank]
            ids[j] = now[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                rank = now[i] = ranks(symbol << 20 | ids[k], -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << 32 | i)
            else:
                now[i] = -1
            h = left[i]
            if h >= 0:
                rank = now[h] = ranks(ids[h] << 20 | symbol, -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def sections(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SECTION:
            found = self.cut.search(text, at + SECTION)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def described(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str, bytes]:
        return ids, ",".join([str(i) for i in ids]), b"".join([self.strings[i] for i in ids])

    def encode_parts(self, text: str) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """The pieces of a text as `described`, a section at a time."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield [self.described((self.special[part],))]
                continue
            for section in self.sections(part):
                if pieces := self.pieces.findall(section):
                    yield list(map(self.known.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.encode_parts(text or "") for ids, _, _ in part for i in ids]

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def codec_of(spec: dict) -> Codec:
    """The codec of a vocabulary; a worker keeps the last one, and the pieces it remembers, from task to task."""
    if spec["digest"] not in _codecs:
        _codecs.clear()
        _codecs[spec["digest"]] = Codec(spec)
    return _codecs[spec["digest"]]


def load(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs."""
    with open(path, "rb") as f:
        content = f.read()
    whole = json.loads(content)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in whole["model"]["merges"]]
    return {"digest": hashlib.sha256(content).hexdigest(), "vocab": whole["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in whole["added_tokens"]}}


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text in a new array column; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(shared.value)
        for texts in batches:
            yield pd.Series([codec.encode(x) for x in texts], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<int>")(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each id array in a new column; null arrays give empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(shared.value)
        for arrays in batches:
            yield pd.Series([codec.decode(x) for x in arrays], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "bpe", remembered: int = 1 << 16) -> DataFrame:
    """df with a struct: the ids of each text, and whether they decode to it (exact).

    Encoder and decoder share a worker, handle a piece of a batch at a time, and remember fewer pieces, for one task
    only: where other stages share the executors, memory is dearer than the merges it saves."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value, remembered)
        for batch in batches:
            for part in pieces(batch):
                texts = part.to_pylist()
                ids = [codec.encode(x) for x in texts]
                exact = [codec.decode(i) == x for i, x in zip(ids, texts, strict=True)]
                yield pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())], names=["ids", "exact"])

    made = F.arrow_udf(thrifty(run), "struct<ids:array<int>,exact:boolean>")
    return df.withColumn(out, made(F.coalesce(F.col(text), F.lit(""))))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass and return (key, n_tokens, ids_sha256, decoded_sha256).

    The fused form of encode() and decode() for callers that need proof rather than the ids themselves: the ids stay
    in the worker, a section at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            counts, hashed, decoded = [], [], []
            for text in batch.column(1):
                n, of_ids, of_text, characters = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
                for pieces in codec.encode_parts(text.as_py() or ""):
                    of_ids.update(("," * (n > 0) + ",".join([decimal for _, decimal, _ in pieces])).encode())
                    of_text.update(characters.decode(b"".join([own for _, _, own in pieces])).encode())
                    n += sum([len(ids) for ids, _, _ in pieces])
                of_text.update(characters.decode(b"", True).encode())
                counts.append(n)
                hashed.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
