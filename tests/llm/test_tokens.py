from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auctionlake.llm import byte_bpe, token_counts, vocab
from auctionlake.llm.common import pack_ints, unpack_ints

CASES = [(-1, None), (-2, ""), (-3, "a\x1cb\x85c  d<|endoftext|> x<|endoftext|>"), (None, "  \n\n x"), (-4, " 　  ​foo"), (-4, "😀 é ñ 中文 漢字 1234½Ⅷ"), (-5, "same"), (-5, "same"), (-6, "x" * 50_000), (-7, "ab " * 40_000)]


def with_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.union(spark.createDataFrame(CASES, "doc_id long, text string"))


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("block_chars", [20_000, byte_bpe.BLOCK_CHARS])
def test_encode_and_decode_as_the_library(spark, sf_dir, block_chars):
    docs = with_cases(spark, sf_dir)
    library = vocab.encoding(byte_bpe.RANKS)
    expected = [(r.doc_id, len((r.text or "").encode()), library.encode_ordinary(r.text or "")) for r in docs.collect()]
    encoded = byte_bpe.encode(docs, block_chars=block_chars)
    assert by_text([tuple(r) for r in encoded.collect()]) == by_text(expected)
    texts = sorted(bytes(r.decoded) for r in byte_bpe.decode(encoded).collect())
    assert texts == sorted((r.text or "").encode() for r in docs.collect())


def test_digests(spark):
    docs = spark.createDataFrame(CASES[:6], "doc_id long, text string")
    library = vocab.encoding(byte_bpe.RANKS)
    expected = []
    for k, text in CASES[:6]:
        ids = library.encode_ordinary(text or "")
        expected.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert by_text([tuple(r) for r in byte_bpe.digests(byte_bpe.encode(docs, decoded=True)).collect()]) == by_text(expected)


def test_counts_as_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = with_cases(spark, sf_dir)
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    expected = []
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    for size in (30_000, token_counts.BLOCK_CHARS):
        assert by_text([tuple(r) for r in token_counts.count_tokens(docs, block_chars=size).collect()]) == by_text(expected)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, ids int, block int, bucket int")
    assert byte_bpe.encode(none, decoded=True).count() == 0 and token_counts.count_tokens(none).count() == 0
    some = spark.createDataFrame([(1, "a b", 3, 4, 5)], none.schema)
    assert byte_bpe.encode(some).first().ids and token_counts.count_tokens(some).first().n_tokens == 2
    with pytest.raises(ValueError, match="column already"):
        byte_bpe.decode(some.withColumnRenamed("block", "decoded"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_are_those_of_the_libraries(text):
    text = text.encode("utf-8", "ignore").decode()
    library = vocab.encoding(byte_bpe.RANKS)
    pieces = vocab.splitter(public_tokenizers.PATTERN)(text)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_packed_integers():
    rng = random.Random(5)
    for n in (0, 1, 7, 1000, (1 << 19) + 5):
        values = np.array([rng.randrange(1 << rng.choice((7, 14, 21, 28))) for _ in range(n)], np.int64)
        assert (unpack_ints(pack_ints(values)) == values).all()
    for wrong in (-1, 1 << 28):
        with pytest.raises(OverflowError):
            pack_ints(np.array([0, wrong]))


def test_a_word_beyond_what_a_task_remembers_is_encoded_again(spark, sf_dir, monkeypatch):
    from auctionlake.llm import word_blocks

    docs = with_cases(spark, sf_dir)
    expected = by_text(tuple(r) for r in byte_bpe.encode(docs).collect())
    for name, value in (("LIST_WORDS", 50), ("KNOWN_WORDS", 100), ("BUCKET_CHARS", 50_000)):
        monkeypatch.setattr(word_blocks, name, value)
    assert by_text(tuple(r) for r in byte_bpe.encode(docs, block_chars=50_000).collect()) == expected
