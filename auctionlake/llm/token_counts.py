"""Token counts from per-document pre-token frequencies, without ever making a document's ids."""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.llm import vocab
from auctionlake.llm.word_blocks import Block, blocks, encode_words, per_block, sizes_for

TOKENIZER = "byte_bpe_50k.json"
#: Frequencies are small beside texts, so blocks can be small too, and their memory with them.
BLOCK_CHARS = 8_000_000


def _split(tokenizer: str):
    """Pre-tokens as the tokenizer makes them: its added tokens are found first and stay whole."""

    def make():
        with open(vocab.path(tokenizer), encoding="utf-8") as f:
            added = [x["content"] for x in json.load(f)["added_tokens"]]
        find = regex.compile(public_tokenizers.PATTERN).findall
        if not added:
            return find
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split

        def split(text: str) -> list[str]:
            if not any(a in text for a in added):
                return find(text)
            out = []
            for k, part in enumerate(cut(text)):
                out += [part] if k % 2 else find(part)
            return out

        return split

    return make


def _pieces(tokenizer: str):
    def make():
        t = vocab.tokenizer(tokenizer)

        def encode(words: list[str]):
            n = [len(e) for k in range(0, len(words), 1000) for e in t.encode_batch_fast(words[k : k + 1000], add_special_tokens=False)]
            return np.array(n, np.int64), np.ones(len(n), np.int64)

        return encode

    return make


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = 1024, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text for a byte-level BPE ``.json`` tokenizer.

    Pieces are counted once for each distinct pre-token, joined to the documents' pre-token frequencies
    and summed. Null text: zero bytes and tokens. Repeated rows and null or repeated ids give a row each;
    an empty table gives none; other columns are not read; nothing is truncated.
    """
    buckets, tasks = sizes_for(df, text_col, block_chars)
    written = blocks(df, id_col, text_col, _split(tokenizer), buckets, True, block_chars)
    encoded = encode_words(written, _pieces(tokenizer), buckets)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(b: Block) -> pa.Table:
        n = np.zeros(len(b.lengths), np.int64)
        for documents, codes in b.slices():
            document = np.repeat(np.arange(documents.stop - documents.start), b.lengths[documents])
            pieces = b.times[codes] * b.values[b.codes[codes]].astype(np.int64)
            n[documents] = np.bincount(document, weights=pieces, minlength=documents.stop - documents.start)
        return pa.table({id_col: b.ids, "n_bytes": b.sizes, "n_tokens": pa.array(n)})

    return per_block(written, encoded, run, schema, tasks).withColumn("over_limit", F.col("n_tokens") > limit)
