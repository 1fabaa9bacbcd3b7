"""Byte-level BPE encoding and decoding by a global shuffle of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.llm import vocab
from auctionlake.llm.common import fresh, gather, list_array, return_freed_memory
from auctionlake.llm.word_blocks import BLOCK_CHARS, Block, blocks, encode_words, per_block, sizes_for

RANKS = "byte_bpe_multi_50k.tiktoken"


def _encoder(ranks: str):
    def make():
        one = vocab.encoding(ranks).encode_ordinary

        def encode(words: list[str]):
            ids = [one(w) for w in words]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum())), lengths

        return encode

    return make


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, decoded: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Token ids of every whole text: (id, n_bytes, ids), and with ``decoded`` the bytes that they decode to.

    Pre-tokens are exploded with their positions block by block, each distinct one is encoded once, ids
    are joined back by block and reassembled by position, one row for each input row. A null text is an empty one (no ids); repeated
    rows and null or repeated ids each give their own row; an empty table gives none; other columns are
    not read. Very long texts are one document of a block and are never cut.
    """
    pattern = public_tokenizers.PATTERN
    buckets, tasks = sizes_for(df, text_col, block_chars)
    written = blocks(df, id_col, text_col, lambda: vocab.splitter(pattern), buckets, False, block_chars)
    encoded = encode_words(written, _encoder(ranks), buckets)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add("decoded", T.BinaryType())

    def run(b: Block) -> pa.Table:
        return_freed_memory()
        lists, texts = [], []
        for documents, codes in b.slices():
            at, sizes = gather(b.offsets, b.codes[codes])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            stops = np.concatenate([[0], np.cumsum(b.lengths[documents])])
            ids, counts = b.values[at].astype(np.int32), ends[stops[1:]] - ends[stops[:-1]]
            lists.append(list_array(ids, counts, pa.int32()))
            if decoded:
                texts.append(pa.array(_bytes_of(ids, counts, ranks), pa.binary()))
        out = {id_col: b.ids, "n_bytes": b.sizes, "ids": pa.chunked_array(lists, pa.list_(pa.int32()))}
        return pa.table(out | ({"decoded": pa.chunked_array(texts, pa.binary())} if decoded else {}))

    return per_block(written, encoded, run, schema, tasks)


def _bytes_of(values: np.ndarray, counts: np.ndarray, ranks: str) -> list[bytes]:
    """The bytes of each list of ids: a lookup join with the token-byte table.

    The table has one row for each token, a number that the vocabulary fixes, so every task has it whole; a
    shuffle of every id with its position to a table of 50,000 rows would move the corpus for nothing.
    """
    table, starts = vocab.token_bytes(ranks)
    if len(values) and (values.min() < 0 or values.max() >= len(starts) - 1):
        raise IndexError("an id is not in the vocabulary")
    stops = np.concatenate([[0], np.cumsum(counts)])
    out, at = [], 0
    while at < len(counts):  # some hundred thousand ids at a time
        stop = max(at + 1, int(np.searchsorted(stops, stops[at] + 300_000, "right")) - 1)
        where, sizes = gather(starts, values[stops[at] : stops[stop]])
        data = table[where].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[stops[at : stop + 1] - stops[at]].tolist()
        out += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        at = stop
    return out


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """Adds the bytes of each id list, joined on the token-byte table.

    Null or empty lists give empty bytes. Ids outside the vocabulary raise IndexError. ``out_col`` must be new.
    """
    if out_col not in fresh(df, out_col):
        raise ValueError(f"{out_col} is a column already")
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])
    place = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_bytes_of(values, counts, ranks), pa.binary())], [*batch.schema.names, out_col])

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token counts and SHA-256 digests of the ids and of the decoded bytes."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
