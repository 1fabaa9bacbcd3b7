"""Pre-tokens of a corpus: every distinct one is handled once, documents refer to it by number.

Documents are read in blocks. A block numbers its distinct pre-tokens by falling frequency and writes
its documents as those numbers, one to three bytes for each position. The distinct pre-tokens go out
by hash to buckets, where equal ones of all blocks meet and are encoded once; the answers go back to
the blocks. A block's size is a parameter; buckets stream through their tasks in short lists and forget
what they know beyond a limit, so no task holds more whatever the input, and the numbers of buckets and
of tasks follow the input's size.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm.common import gather, materialize, pack_ints, return_freed_memory, texts_of, unpack_ints

BLOCK_CHARS = 32_000_000
BLOCK_DOCS = 200_000
#: A bucket for so many characters of text, within MOST_BUCKETS.
BUCKET_CHARS, MOST_BUCKETS = 16_000_000, 1 << 14
#: Words of one list, and words that a task remembers; one beyond that may be encoded again.
LIST_WORDS, KNOWN_WORDS = 8192, 1_000_000
_SEPARATOR = b"\xff"  # never part of UTF-8

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Numbers(dict):
    def __init__(self):
        self._next = count().__next__

    def __missing__(self, word):
        number = self[word] = self._next()
        return number


def _bucket_of(words: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % buckets


def _frequencies(flat: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Distinct codes of each document in rising order: how many, their steps, and how often each stands there."""
    ends = np.cumsum(lengths)
    sizes, steps, times, at = [], [], [], 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + (1 << 19), "right")))
        document = np.repeat(np.arange(stop - at), lengths[at:stop])
        pairs, often = np.unique(document << 32 | flat[before : int(ends[stop - 1])].astype(np.int64), return_counts=True)
        document, code = pairs >> 32, pairs & 0xFFFFFFFF
        rising = np.diff(code, prepend=0)
        first = np.diff(document, prepend=-1) != 0
        rising[first] = code[first]
        sizes.append(np.bincount(document, minlength=stop - at))
        steps.append(pack_ints(rising))
        times.append(pack_ints(often))
        at = stop
    return pack_ints(np.concatenate(sizes)), b"".join(steps), b"".join(times)


def _pack(*parts: bytes) -> bytes:
    head = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.compress(head + b"".join(parts), 9)


def _unpack(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(data)
    at, out = 4 * n, []
    for size in np.frombuffer(raw[: 4 * n], "<u4").tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def blocks(df: DataFrame, id_col: str, text_col: str, split: Callable[[], Callable[[str], list[str]]], buckets: int, frequencies: bool, block_chars: int) -> DataFrame:
    """The written block table: a row for each block's documents (bucket -1) and for each of its word lists.

    With ``frequencies`` a document is its distinct words with their counts, else its words in order.
    """
    id_type = df.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        find = split()
        base = TaskContext.get().partitionId() << 32
        seq = count()
        names = ["block", "bucket", "ids", "sizes", "payload"]

        def start():
            return _Numbers(), [], [], []

        numbers, codes, ids, sizes = start()
        chars = 0

        def flush():
            block = base + next(seq)
            lengths = np.array([len(c) for c in codes], np.int64)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            codes.clear()
            falling = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(numbers), np.int32)
            rank[falling] = np.arange(len(numbers))
            flat = rank[flat]
            if frequencies:
                payload = _pack(*_frequencies(flat, lengths))
            else:
                payload = _pack(pack_ints(lengths), pack_ints(flat), b"")
            del flat
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([ids], pa.list_(arrow_id)),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], names)
            words = list(numbers)
            numbers.clear()
            words = [words[k] for k in falling.tolist()]
            where = _bucket_of(words, buckets)
            rows, heads = [], []
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[by])) + 1
            for part in np.split(by, cuts) if len(by) else []:
                for first in range(0, len(part), LIST_WORDS):
                    some = part[first : first + LIST_WORDS]
                    heads.append(int(where[some[0]]))
                    listed = _SEPARATOR.join([words[k].encode("utf-8", "surrogatepass") for k in some.tolist()])
                    rows.append(_pack(pack_ints(np.diff(some, prepend=0)), listed))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(rows), pa.int64()), pa.array(heads, pa.int32()), pa.nulls(len(rows), pa.list_(arrow_id)),
                    pa.nulls(len(rows), pa.list_(pa.int64())), pa.array(rows, pa.binary()),
                ], names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found = find(text)
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(key)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                chars += len(text)
                if chars >= block_chars or len(ids) >= BLOCK_DOCS:
                    yield from flush()
                    numbers, codes, ids, sizes = start()
                    chars = 0
        if ids:
            yield from flush()

    return materialize(df.select(id_col, text_col).mapInArrow(run, schema), "blocks")


def encode_words(written: DataFrame, encoder: Callable[[], Encoder], buckets: int) -> DataFrame:
    """For each word list of a block, its words' numbers and values; a word is encoded once in its bucket.

    ``encoder()`` gives a function from distinct words to (flat values, number of values of each word).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        known: dict[bytes, int] = {}
        values, ends = array("I"), array("q", [0])
        bucket = None
        for batch in batches:
            out = []
            for own, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != bucket or len(known) > KNOWN_WORDS:
                    bucket, known, values, ends = own, {}, array("I"), array("q", [0])
                numbered, listed = _unpack(data, 2)
                words = listed.split(_SEPARATOR)
                new = [w for w in words if w not in known]
                if new:
                    flat, lengths = encode([w.decode("utf-8", "surrogatepass") for w in new])
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    values.frombytes(flat.astype(np.uint32).tobytes())
                    ends.frombytes((ends[-1] + np.cumsum(lengths, dtype=np.int64)).tobytes())
                at, sizes = gather(np.array(ends), np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                out.append(_pack(numbered, pack_ints(sizes), np.array(values)[at].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "payload"])

    words = written.filter("bucket >= 0").select("block", "bucket", "payload")
    return words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, payload binary")


class Block:
    """One block read back: its documents' word numbers and the encoded values of every word."""

    def slices(self, codes: int = 1 << 18) -> Iterator[tuple[slice, slice]]:
        """Runs of documents with about so many codes, and where their codes are."""
        ends = np.cumsum(self.lengths)
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + codes, "right")))
            yield slice(at, stop), slice(before, int(ends[stop - 1]))
            at = stop

    def __init__(self, t: pa.Table):
        values, numbers, sizes = [], [], []
        self.documents = None
        for bucket, ids, size, payload in zip(t["bucket"].to_pylist(), t["ids"], t["sizes"], t["payload"].to_pylist(), strict=True):
            if bucket < 0:
                self.ids, self.sizes = ids.values, size.values
                self.documents = _unpack(payload, 3)
            else:
                steps, lengths, flat = _unpack(payload, 3)
                numbers.append(np.cumsum(unpack_ints(steps)))
                sizes.append(unpack_ints(lengths))
                values.append(np.frombuffer(flat, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel())
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        flat = np.concatenate(values) if values else np.zeros(0, np.uint32)
        starts = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(number, kind="stable")
        at, lengths = gather(starts, order)
        self.values, self.offsets = flat[at], np.concatenate([[0], np.cumsum(lengths)])
        lengths, codes, self.times = (unpack_ints(x) for x in self.documents)
        self.lengths, self.codes = lengths, codes
        if len(self.times):
            steps = codes.astype(np.int64)
            total = np.cumsum(steps)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            has = lengths > 0
            self.codes = total - np.repeat((total - steps)[np.minimum(first, len(steps) - 1)][has], lengths[has])


def per_block(written: DataFrame, encoded: DataFrame, run: Callable[[Block], pa.Table], schema: T.StructType, tasks: int) -> DataFrame:
    """``run`` on every block, its documents and encoded words brought together by the block's number."""
    both = written.filter("bucket < 0").unionByName(encoded, allowMissingColumns=True)
    return both.repartition(tasks, "block").groupBy("block").applyInArrow(lambda t: run(Block(t)), schema)


def sizes_for(df: DataFrame, text_col: str, block_chars: int) -> tuple[int, int]:
    """Numbers of buckets and of tasks over blocks: in proportion to the characters of all texts."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chars = df.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    return max(1, min(MOST_BUCKETS, max(least, chars // BUCKET_CHARS))), max(least, 2 * chars // block_chars)
