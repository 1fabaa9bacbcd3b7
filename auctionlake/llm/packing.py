"""Packing of token ids into sequences by the sum-of-squares rule, online and in each task alone."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm import vocab
from auctionlake.llm.common import texts_of

RANKS, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
LENGTH, END = 1024, 0
#: Partly filled windows that a task holds (4 KB of ids each at 1024). Beyond, all are closed and the levels start anew.
MOST_OPEN = 4096

#: A part of a document: its row, the ids before it, its ids, all ids of its document.
Piece = tuple[object, int, np.ndarray, int]


class Levels:
    """Partly filled windows by fill level, and how many there are at each."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The level (0: a new window) at which ``size`` more ids leave the least sum of squared counts; the fullest of equals.

        A window that becomes full is no longer counted.
        """
        n, top = self.counts, self.length - size
        grown = np.where(n[1 : top + 1] > 0, 2 * (n[size + 1 : self.length + 1] - n[1 : top + 1]) + 2, np.iinfo(np.int64).max)
        if top and n[top] > 0:
            grown[-1] -= 1
        best = top - int(np.argmin(grown[::-1])) if top else 0
        return best if best and grown[best - 1] <= 2 * n[size] + 1 else 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece shorter than a window to its level; the window, if that fills it."""
        size = len(piece[2])
        level = self.level_for(size)
        window = self.windows[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.length:
            return window
        self.counts[level + size] += 1
        self.windows.setdefault(level + size, []).append(window)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """All windows, none with padding: pieces of the emptiest are cut to fill the fullest, and the last is cut at powers of two."""
        rest = [w for level in sorted(self.windows, reverse=True) for w in self.windows[level]]
        self.counts[:] = 0
        self.windows.clear()
        first, last = 0, len(rest) - 1
        while first < last:
            gap = self.length - sum(len(p[2]) for p in rest[first])
            if not gap:
                yield rest[first]
                first += 1
                continue
            key, start, ids, total = rest[last].pop()
            rest[first].append((key, start, ids[:gap], total))
            if len(ids) > gap:
                rest[last].append((key, start + gap, ids[gap:], total))
            if not rest[last]:
                last -= 1
        if first == last:
            yield from at_powers_of_two(rest[first])


def at_powers_of_two(window: list[Piece]) -> Iterator[list[Piece]]:
    left = sum(len(p[2]) for p in window)
    todo = window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            key, start, ids, total = todo.pop()
            out.append((key, start, ids[:size], total))
            if len(ids) > size:
                todo.append((key, start + size, ids[size:], total))
            size -= min(size, len(ids))
        yield out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, special: dict[str, int] | None = None, length: int = LENGTH, end: int = END, most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents, in sequences of ``length`` ids at most.

    A document is its ids and the id ``end``. As many whole windows as it has are cut from it; the rest, never cut, goes to the
    window of the fill level at which the squared counts of partly filled windows then have the least sum. What is partly filled
    as a task ends is filled with pieces cut from the emptiest windows, and the last one is cut at powers of two, so no sequence
    has padding. Documents are placed as they come, in the task that reads them, so nothing is shuffled; a task holds its partly
    filled windows, ``most_open`` of them at most.

    A null or empty text has the one id ``end``. Repeated rows and null or repeated ids are documents of their own;
    ``sequence_id`` tells sequences apart within one reading of ``df``, whose rows must come in the same order when a task runs
    again (files do). An empty table gives no rows; other columns are not read.
    """
    id_type = df.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    special = SPECIAL if special is None else special
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n in names[1:-1]), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocab.encoding(ranks, tuple(special.items())).encode_to_numpy
        levels, sequence, done = Levels(length), TaskContext.get().partitionId() << 33, []

        def flush() -> pa.RecordBatch:
            nonlocal done
            ids = [p[2] for p, _, _ in done]
            lengths = np.array([len(x) for x in ids], np.int32)
            columns = [
                pa.array([p[0] for p, _, _ in done], arrow_id), pa.array([p[1] for p, _, _ in done], pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([p[3] for p, _, _ in done], pa.int64()),
                pa.array([s for _, s, _ in done], pa.int64()), pa.array([o for _, _, o in done], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
            ]
            done = []
            return pa.RecordBatch.from_arrays(columns, names)

        def write(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for piece in window:
                done.append((piece, sequence, offset))
                offset += len(piece[2])
            sequence += 1

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.append(encode(text, allowed_special="all", disallowed_special=()), np.uint32(end))
                whole = len(ids) - len(ids) % length
                for start in range(0, whole, length):
                    write([(key, start, ids[start : start + length], len(ids))])
                if whole < len(ids) and (full := levels.place((key, whole, ids[whole:].copy(), len(ids)))):
                    write(full)
                if len(done) >= 1000:
                    yield flush()
            if levels.counts.sum() > most_open:
                for window in levels.close():
                    write(window)
        for window in levels.close():
            write(window)
        if done:
            yield flush()

    return df.select(id_col, text_col).mapInArrow(run, schema)
