import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  two  spaces \n\n x", "don't we'll I'M", "a<|endoftext|>b <|endoftext|>", "naïve café ñandú 東京 🙂‍↔️ é", " x y​z\x1c\x1d w\x85v", "x" * 3000, "ab " * 120000, "\t\r\n \x0b\x0c", "1234567 89²³ ¼ Ⅷ", "퟿￿\U0010ffff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_matches_the_library(library):
    codec = bpe.Codec(bpe.load(PATH))
    rng = random.Random(5)
    pool = "abc theing  \n\t'sré1２!?-_<|>終  　\x1f"
    more = ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(800)]
    more += ["".join(chr(rng.choice((rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x11000)))) for _ in range(30)) for _ in range(300)]
    for text in TEXTS + more:
        ids, decoded = expected(library, text)
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == decoded


def test_every_document(spark, library):
    from lumenframe.llm.registry import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, decoded = expected(library, d.text)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_columns_and_edge_rows(spark, library):
    df = spark.createDataFrame([(i % 3 or None, t, "kept", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, ids int")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    for r in rows:
        assert r.n_tokens == "kept"
        assert (r.ids, r.decoded) == expected(library, r.text)
    assert bpe.digests(df, PATH).count() == len(TEXTS)
    for r in bpe.round_trip(df, PATH).collect():
        assert (r.bpe.ids, r.bpe.exact) == (expected(library, r.text)[0], True)
    assert bpe.digests(df.limit(0), PATH).count() == 0
