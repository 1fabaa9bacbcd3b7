"""Tokens of two vocabularies aligned by their bytes, and how many documents hold each linked pair of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm import vocab
from auctionlake.llm.common import SHARE, gather, materialize, return_freed_memory, texts_of

RANKS, MODEL = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Texts of a block in bytes, and of a slice that is aligned at once; documents of a block are numbered in 16 bits.
BLOCK_BYTES, SLICE_BYTES, BLOCK_DOCS = 8_000_000, 1_000_000, 1 << 16
#: A pair of ids in one number: 15 bits for the B id (32,768 of them at most), above it the A id.
B_BITS = 15
#: Distinct pairs, or documents of any blocks, that a task sums before it passes them on.
HELD = 2_000_000
BATCH_BYTES = 16 << 20

COUNT_FIELDS = ["n_a", "n_b", "n_groups", "n_links"]
FIGURES = [*COUNT_FIELDS, "n_best", "count_sum", "groups_sha256"]


# --- one slice of documents ----------------------------------------------------------------------


@lru_cache(2)
def _numerals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decimal ids, each with one of three separators behind it; entry 3 * id + separator."""
    data = [f"{k}{sep}".encode() for k in range(size) for sep in ",|;"]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def _agree(raw: list[bytes], ids: list[np.ndarray], table: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts are what their tokens' bytes join to."""
    flat = np.concatenate(ids)
    where, sizes = gather(starts, flat)
    joined, ends = table[where].tobytes(), np.concatenate([[0], np.cumsum(sizes)])
    cuts = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
    return np.array([joined[a:b] == x for x, a, b in zip(raw, cuts, cuts[1:], strict=False)], bool)


def align(texts: list[str], ranks: str = RANKS, model: str = MODEL) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Counts of each text, digests of its groups, and of all links the text's place and the pair of ids.

    A text that is empty, or that the tokens of either side do not join to, has none.
    """
    out = {name: np.zeros(len(texts), np.int64) for name in COUNT_FIELDS}
    digests = [""] * len(texts)
    none = np.zeros(0, np.int64)
    place = [k for k, t in enumerate(texts) if t]
    if not place:
        return out, digests, none, none
    raw = [(" " + texts[k]).encode("utf-8", "surrogatepass") for k in place]
    encode = vocab.encoding(ranks).encode_to_numpy
    a_ids = [encode(" " + texts[k], disallowed_special=()).astype(np.int64) for k in place]
    b_ids = [np.array(x, np.int64) for x in vocab.pieces(model)[0].encode([texts[k] for k in place], num_threads=1)]
    a_table, b_table = vocab.token_bytes(ranks), vocab.piece_bytes(model)
    if len(b_table[1]) > 1 << B_BITS:
        raise OverflowError(f"{model} has more than {1 << B_BITS} pieces")
    sound = np.flatnonzero(_agree(raw, a_ids, *a_table) & _agree(raw, b_ids, *b_table)).tolist()
    if not sound:
        return out, digests, none, none
    place = np.array(place)[sound]
    a, b = np.concatenate([a_ids[k] for k in sound]), np.concatenate([b_ids[k] for k in sound])
    document_end = np.cumsum([len(raw[k]) for k in sound])
    total = int(document_end[-1])
    a_end, b_end = np.cumsum(np.diff(a_table[1])[a]), np.cumsum(np.diff(b_table[1])[b])
    at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    at_a[a_end] = at_b[b_end] = True
    a_before, b_before, g_before = (np.cumsum(x, dtype=np.int32) for x in (at_a, at_b, at_a & at_b))  # ends up to each byte, it included

    # between two ends that follow each other lies one link: that of the tokens which cover it
    ends = np.flatnonzero(at_a | at_b)
    links = a[a_before[ends - 1]] << B_BITS | b[b_before[ends - 1]]
    l_before = np.searchsorted(ends, document_end, "right")
    per_document = lambda upto: np.diff(upto, prepend=0)
    for name, upto in zip(COUNT_FIELDS, (a_before[document_end], b_before[document_end], g_before[document_end], l_before), strict=True):
        out[name][place] = per_document(upto)

    # a token's place in the written groups: behind those of its side, and those of the other side up to its group
    group_end = np.flatnonzero(at_a & at_b)
    group_start = np.concatenate([[0], group_end[:-1]])
    a_place = np.arange(len(a)) + b_before[group_start][g_before[a_end - 1]]
    b_place = np.arange(len(b)) + a_before[group_end][g_before[b_end - 1]]
    written = np.empty(len(a) + len(b), np.int64)
    written[a_place] = 3 * a + at_b[a_end]
    written[b_place] = 3 * b + 2 * at_a[b_end]
    table, starts = _numerals(max(len(a_table[1]), len(b_table[1])))
    where, sizes = gather(starts, written)
    data, stops = table[where].tobytes(), np.cumsum(sizes)
    cuts = [0, *stops[a_before[document_end] + b_before[document_end] - 1].tolist()]
    for k, first, stop in zip(place.tolist(), cuts, cuts[1:], strict=False):
        digests[k] = hashlib.sha256(data[first : stop - 1]).hexdigest()
    return out, digests, np.repeat(place, per_document(l_before)), links


# --- blocks of documents -------------------------------------------------------------------------


def _cells(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column: the values of each run between ``cuts``, as they lie in memory."""
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _postings(block: int, documents: np.ndarray, links: np.ndarray) -> pa.Table:
    """A row for each A id of a block: its B ids, how many documents have each, which, and how often."""
    keys = links << 16 | documents
    keys.sort()
    first = _runs(keys)
    times = np.diff(first).astype(np.int32)
    keys = keys[first[:-1]]
    pair = _runs(keys >> 16)
    pairs = keys[pair[:-1]] >> 16
    a_cut = _runs(pairs >> B_BITS)
    return pa.table({
        "block": pa.array(np.full(len(a_cut) - 1, block), pa.int64()), "a": pa.array((pairs >> B_BITS)[a_cut[:-1]], pa.int32()),
        "b": _cells((pairs & ((1 << B_BITS) - 1)).astype("<i2"), a_cut), "n": _cells(np.diff(pair).astype("<i4"), a_cut),
        "documents": _cells((keys & 0xFFFF).astype("<u2"), pair[a_cut]), "times": _cells(times.astype("<i4"), pair[a_cut]),
    })


def blocks(df: DataFrame, id_col: str, text_col: str, ranks: str, model: str, block_bytes: int) -> DataFrame:
    """The written table of blocks: a row for each document (``a`` null), and for each A id of a block its postings."""
    id_type = df.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    fields = [("block", T.LongType()), ("a", T.IntegerType()), *((n, T.BinaryType()) for n in ("b", "n", "documents", "times")), ("place", T.IntegerType()), ("id", id_type), *((n, T.LongType()) for n in COUNT_FIELDS), ("groups_sha256", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        base, numbers = TaskContext.get().partitionId() << 32, count()
        whole = pa.schema([(n, pa.int64() if n in COUNT_FIELDS else {"block": pa.int64(), "a": pa.int32(), "place": pa.int32(), "id": arrow_id, "groups_sha256": pa.string()}.get(n, pa.binary())) for n, _ in fields])

        def rows(t: pa.Table) -> list[pa.RecordBatch]:
            return pa.table([t[f.name] if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in whole], whole).to_batches(max_chunksize=2000)

        block, done, held, size = base + next(numbers), 0, [], 0
        some: list[tuple[object, str]] = []

        def slice_done() -> list[pa.RecordBatch]:
            nonlocal some, done
            figures, digests, document, links = align([t for _, t in some], ranks, model)
            held.append((document + done, links))
            here = pa.table({
                "block": pa.array([block] * len(some), pa.int64()), "place": pa.array(range(done, done + len(some)), pa.int32()),
                "id": pa.array([k for k, _ in some], arrow_id), **{n: pa.array(v) for n, v in figures.items()}, "groups_sha256": pa.array(digests, pa.string()),
            })
            done, some = done + len(some), []
            return rows(here)

        def block_done() -> list[pa.RecordBatch]:
            nonlocal block, done, size
            document, links = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            out = rows(_postings(block, document, links)) if len(links) else []
            block, done, size = base + next(numbers), 0, 0
            return out

        filled = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                some.append((key, text))
                filled += len(text)
                size += len(text)
                if filled >= SLICE_BYTES or size >= block_bytes or done + len(some) >= BLOCK_DOCS:
                    yield from slice_done()
                    filled = 0
                    if size >= block_bytes or done >= BLOCK_DOCS:
                        yield from block_done()
        if some:
            yield from slice_done()
        if held:
            yield from block_done()

    return materialize(df.select(id_col, text_col).mapInArrow(run, schema), "blocks")


# --- counts of pairs -----------------------------------------------------------------------------


def _column(batch: pa.RecordBatch, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column one after another, and the number of values in each row."""
    cells = batch.column(name)
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    cut = _runs(keys)[:-1]
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


def _pair_counts(batches: Iterable[pa.RecordBatch], key_of: Callable[[pa.RecordBatch], np.ndarray], done: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], in_order: bool) -> Iterator[pa.RecordBatch]:
    """Sums (a, b, n) rows by pair. Rows in the order of ``a`` are passed on as an id ends, others as HELD pairs are known."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        b, sizes = _column(batch, "b", "<i2")
        more, _ = _column(batch, "n", "<i8" if in_order else "<i4")
        keys, n = _summed(np.concatenate([keys, np.repeat(key_of(batch), sizes) << B_BITS | b]), np.concatenate([n, more.astype(np.int64)]))
        stop = int(np.searchsorted(keys, keys[-1] >> B_BITS << B_BITS)) if in_order and len(keys) else len(keys) if len(keys) > HELD else 0
        if stop:
            yield done(keys[:stop], n[:stop])
            keys, n = keys[stop:], n[stop:]
    if len(keys):
        yield done(keys, n)


def _count_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    cut = _runs(keys >> B_BITS)
    a = (keys >> B_BITS)[cut[:-1]]
    total = np.add.reduceat(n, cut[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), _cells((keys & ((1 << B_BITS) - 1)).astype("<i2"), cut), _cells(n.astype("<i8"), cut), pa.array(total, pa.int64())], ["a", "b", "n", "total"])


def pair_counts(written: DataFrame) -> DataFrame:
    """(a, b, n, total) for each A id: its B ids, the number of documents that hold each pair, and their sum.

    A task sums what it reads before anything is shuffled; ids then meet in parts, and the parts' sums as a whole, so an id
    that every document holds is nowhere more than its B ids and a few counts.
    """
    names = "a int, b binary, n binary, total long"

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pair_counts(batches, lambda t: t["a"].to_numpy().astype(np.int64), _count_rows, False)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pair_counts(batches, lambda t: t["a"].to_numpy().astype(np.int64), _count_rows, True)

    read = written.filter("a IS NOT NULL").select("a", "b", "n").mapInArrow(some, names)
    parts = read.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    met = parts.repartition("a", "part").sortWithinPartitions("a").select("a", "b", "n").mapInArrow(ordered, names)
    return met.repartition("a").sortWithinPartitions("a").select("a", "b", "n").mapInArrow(ordered, names)


# --- contributions, and their sums ---------------------------------------------------------------


class _Sums:
    """Sums of documents by block, in the order in which blocks came."""

    def __init__(self):
        self.of: dict[int, np.ndarray] = {}
        self.held = 0

    def add(self, block: int, documents: np.ndarray, best: np.ndarray, counts: np.ndarray) -> None:
        size = int(documents.max()) + 1
        have = self.of.get(block)
        if have is None or have.shape[1] < size:
            more = np.zeros((2, size), np.int64)
            if have is not None:
                more[:, : have.shape[1]] = have
                self.held -= have.shape[1]
            self.of[block] = have = more
            self.held += size
        have[0, :size] += np.bincount(documents, best, size).astype(np.int64)
        for shift in (0, 32):  # sums of 32-bit parts are exact in doubles
            have[1, :size] += np.bincount(documents, (counts >> shift & 0xFFFFFFFF).astype(np.float64), size).astype(np.int64) << shift

    def rows(self) -> Iterator[pa.RecordBatch]:
        for block, sums in self.of.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums[0].astype("<i8").tobytes()], pa.binary()), pa.array([sums[1].astype("<i8").tobytes()], pa.binary())], ["block", "best", "counts"])
        self.of, self.held = {}, 0


def _contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams each id's counts and then its postings; sums what the postings' documents get."""
    keys, counts, best = (np.zeros(0, np.int64) for _ in range(3))
    sums = _Sums()
    for batch in batches:
        is_count = batch["block"].is_null().to_numpy(zero_copy_only=False)
        known = batch.filter(pa.array(is_count))
        if known.num_rows:
            b, sizes = _column(known, "b", "<i2")
            n, _ = _column(known, "n", "<i8")
            a = np.repeat(known["a"].to_numpy().astype(np.int64), sizes)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            most = np.repeat(np.maximum.reduceat(n, first), sizes)
            # only the id at hand can still be needed from before
            last = keys[keys >> B_BITS == keys[-1] >> B_BITS] if len(keys) else keys
            keys, counts, best = np.concatenate([last, a << B_BITS | b]), np.concatenate([counts[len(counts) - len(last) :], n]), np.concatenate([best[len(best) - len(last) :], n == most])
        rows = batch.filter(pa.array(~is_count))
        if not rows.num_rows:
            continue
        b, sizes = _column(rows, "b", "<i2")
        n, _ = _column(rows, "n", "<i4")
        documents, per_row = _column(rows, "documents", "<u2")
        times, _ = _column(rows, "times", "<i4")
        order = np.argsort(keys, kind="stable")
        at = order[np.searchsorted(keys, np.repeat(rows["a"].to_numpy().astype(np.int64), sizes) << B_BITS | b, sorter=order)]
        of_pair = np.repeat(at, n)
        times = times.astype(np.int64)
        block = rows["block"].to_numpy()
        place = np.concatenate([[0], np.cumsum(per_row)])
        by = np.argsort(block, kind="stable")
        cut = _runs(block[by])
        for k in range(len(cut) - 1):
            where = gather(place, by[cut[k] : cut[k + 1]])[0]
            pair = of_pair[where]
            sums.add(int(block[by[cut[k]]]), documents[where], best[pair] * times[where], counts[pair] * times[where])
        if sums.held > HELD:
            yield from sums.rows()
    yield from sums.rows()


def contributions(written: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, best, counts): for the documents of a block in order, what some of their links add to either sum.

    Postings go to their A id once, behind the id's counts, in a sorted stream that spills; an id with more than a thousandth of
    all postings is dealt over parts, with its counts in each (32,768 of them at most).
    """
    total = counts.agg(F.sum("total").alias("n")).first()["n"] or 0
    hot = counts.filter(F.col("total") * SHARE > total).select("a", F.ceil(F.col("total") * SHARE / max(total, 1)).alias("parts"))
    parted = counts.join(F.broadcast(hot), "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1)))
    one = F.lit(None)
    known = parted.select("a", "part", one.cast("long").alias("block"), "b", "n", one.cast("binary").alias("documents"), one.cast("binary").alias("times"))
    rows = written.filter("a IS NOT NULL").join(F.broadcast(hot), "a", "left")
    part = F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1))).cast("int")
    postings = rows.select("a", part.alias("part"), "block", "b", "n", "documents", "times")
    both = known.unionByName(postings).repartition("a", "part").sortWithinPartitions("a", "part", F.col("block").asc_nulls_first())
    return both.select("a", "block", "b", "n", "documents", "times").mapInArrow(_contributed, "block long, best binary, counts binary")


def token_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, model: str = MODEL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each document.

    A are the tokens of a space and the text by the byte-level ``ranks``, B those of the text by ``model``, special strings being
    plain text. Groups end where tokens of both end. Links are pairs of tokens whose bytes overlap; the count of a pair of ids is
    the number of documents in which it is linked. ``n_best`` are the links whose count is their A id's highest (ties included),
    ``count_sum`` is the sum of all links' counts. A text that is null or empty, or that either side's bytes do not give back,
    has zeros and an empty digest. Repeated rows, and null or repeated ids, are documents of their own, counted each. An empty
    table gives none; other columns are not read; texts are never cut.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    written = blocks(df, id_col, text_col, ranks, model, block_bytes)
    counts = materialize(pair_counts(written), "counts")
    added = contributions(written, counts)
    documents = written.filter("a IS NULL").select("block", "place", "id", *COUNT_FIELDS, "groups_sha256")
    both = documents.unionByName(added, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_first())
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n in FIGURES[:-1]), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros((2, 0), np.int64)
        for batch in batches:
            numbers = batch["block"].to_numpy()
            cut = _runs(numbers)
            for first, stop in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                some = batch.slice(first, stop - first)
                if numbers[first] != block:
                    block, sums = numbers[first], np.zeros((2, BLOCK_DOCS), np.int64)
                is_sum = some["place"].is_null()
                for best, counted in zip(some.filter(is_sum)["best"].to_pylist(), some.filter(is_sum)["counts"].to_pylist(), strict=True):
                    for k, data in enumerate((best, counted)):
                        values = np.frombuffer(data, "<i8")
                        sums[k, : len(values)] += values
                own = some.filter(pc.invert(is_sum))
                if own.num_rows:
                    at = own["place"].to_numpy()
                    columns = {id_col: own["id"], **{n: own[n] for n in COUNT_FIELDS}, "n_best": pa.array(sums[0][at]), "count_sum": pa.array(sums[1][at]), "groups_sha256": own["groups_sha256"]}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return both.mapInArrow(run, schema)
