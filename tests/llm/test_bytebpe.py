import hashlib
import random
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lithoframe.llm import bytebpe, catalog

TEXTS = [
    None, "", " ", "  \n\n \t x ", "a" * 3000, "ab" * 2000, " " * 500 + "x", "it's they'LL 'tis I'd", "é ﬁ 😀 \x00 ß 天地 ́x", "<|endoftext|>a <|endoftext|>  b<|endof", "x<|endoftext|>",
    "12,345.67 +-*/ ___ !!!", "  wide　blanks\x1c\x1d", "The quick brown fox",
]


@cache
def theirs():
    return Tokenizer.from_file(bytebpe.VOCABULARY)


@cache
def own():
    return bytebpe.Coder(bytebpe.read_vocabulary())


@pytest.fixture(scope="module")
def library():
    return theirs()


@pytest.fixture(scope="module")
def coder():
    return own()


def same(coder, library, text):
    want = library.encode(text or "", add_special_tokens=False).ids
    assert coder.encode(text) == want, repr(text)
    assert coder.decode(np.array(want, np.int32)) == library.decode(want, skip_special_tokens=False) == (text or "")


def test_equals_the_library(coder, library):
    r = random.Random(5)
    kinds = ["abcde  \n.,'sßAB12", "ab", "theraoningst ", "".join(map(chr, range(0x20, 0x250))), "天地玄黃😀́é "]
    for text in TEXTS + ["".join(r.choice(k) for _ in range(r.randint(1, 400))) for k in kinds for _ in range(100)]:
        same(coder, library, text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_equals_the_library(text):
    same(own(), theirs(), text)


def test_every_character_splits_as_in_the_library(coder, library):
    for point in [*range(0x20, 0x3100), *range(0xFE00, 0x10000), *range(0x10000, 0x12000), *range(0x1D400, 0x1FB00)]:
        text = f"a{chr(point)}a 1{chr(point)}1 .{chr(point)}."
        assert len(coder.split(text)) == len(library.pre_tokenizer.pre_tokenize_str(text)), hex(point)


def test_every_token_is_itself(coder):
    tokens = bytebpe.read_vocabulary()["tokens"]
    assert all(coder.encode_bytes(t) == [k] for k, t in enumerate(tokens))


def merged(coder, piece):
    """The merges, one after the other: the first of the lowest pairs."""
    out = [next(k for k in range(256) if byte_of_token(coder, k) == b) for b in piece]
    while True:
        best = min(((coder.merged.get(p, 1 << 30), i) for i, p in enumerate(zip(out, out[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return out
        out[best[1] : best[1] + 2] = [best[0]]


def byte_of_token(coder, k):
    i = coder.ids[k]
    return coder.pool[coder.at[i]]


def test_backtracking_equals_the_merges(coder):
    r = random.Random(9)
    for _ in range(200):
        piece = bytes(r.choice(b"therainogs") for _ in range(r.randint(1, 40)))
        assert coder.encode_bytes(piece) == merged(coder, piece)


def test_bounded_memory_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "KNOWN_PIECES", 3)
    monkeypatch.setattr(bytebpe, "KNOWN_PAIRS", 3)
    small = bytebpe.Coder(bytebpe.read_vocabulary())
    same(small, library, "several different words, several times; several different pairs " * 3)
    assert len(small.pieces) <= 3 and len(small.pairs) <= 3


def test_ids_out_of_range_and_broken_bytes(coder, library):
    ids = [50256, 99999, -1, 222, 50256]
    assert coder.decode(np.array(ids)) == library.decode([i for i in ids if 0 <= i < 50257], skip_special_tokens=False)
    assert coder.decode(np.array([], np.int32)) == ""


def test_round_trip_of_a_table(docs_of, library, monkeypatch):
    rows = [*enumerate(TEXTS), (None, "no id"), (4, TEXTS[4]), (99, "long words and more " * 30_000)]
    encoded = bytebpe.encode(docs_of(rows))
    back = sorted((str(r.doc_id), r.text, r.ids) for r in bytebpe.decode(encoded.withColumn("text", F.lit("clash"))).collect())
    assert back == sorted((str(i), t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    odd = encoded.sparkSession.createDataFrame([(1, None), (2, []), (3, [None, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bytebpe.decode(odd).collect()} == {1: None, 2: "", 3: "a"}
    assert bytebpe.encode(docs_of([])).count() == bytebpe.bpe_digest(docs_of([])).count() == 0


def test_query_equals_the_library(spark, sf_dir, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in catalog.queries()["op13_bpe_encoding"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
