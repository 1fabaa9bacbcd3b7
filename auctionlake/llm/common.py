"""Helpers shared by the training-data operators.

Only three things ever leave the executors: counts, tables whose size a
parameter fixes, and bitmaps of bounded size.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Rows of texts that go to Python at once; the default of 10,000 whole documents would be tens of megabytes.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


_open = threading.local()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes every table that this application has materialized; results not yet read are lost. Done at its end anyway."""
    _delete(spark, _own_dir(spark))


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release(spark)


@lru_cache(1)
def _release_at_exit(spark: SparkSession, application: str) -> None:
    atexit.register(_at_exit, spark)


def _own_dir(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    _release_at_exit(spark, application)
    return f"{shared_dir(spark)}/tables-{application}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end, but for those to be kept, which by then have read the others."""
    folders = _open.__dict__.setdefault("folders", [])
    folders.append(f"{folders[-1] if folders else _own_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, folders.pop())


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and rows are fixed.

    A lost executor then costs a re-read, never a recomputation that could deal rows out differently.
    With ``keep`` it outlives the innermost ``scratch``; outside any it lasts until the application ends.
    """
    folders = [_own_dir(df.sparkSession), *_open.__dict__.get("folders", [])]
    path = f"{folders[max(0, len(folders) - 1 - keep)]}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def return_freed_memory() -> None:
    """Large arrays go back to the system when freed, not to this Python worker's heap, which outlives the task."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of the C library


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting as asked that ``df`` does not have yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array) -> list[str]:
    """Values of a string column, null as the empty string."""
    return pc.fill_null(column, "").to_pylist()


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes.split() splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


def binary(values: Iterable[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flattened values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def gather(offsets: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the segments ``picked`` of a ragged array, and the length of each."""
    lengths = (offsets[1:] - offsets[:-1])[picked]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    flat = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1][picked] - (ends - lengths), lengths)
    return flat, lengths


_SLICE = 1 << 19


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**28 in one to four bytes each, low seven bits first; others raise."""
    if len(values) and (values.min() < 0 or values.max() >= 1 << 28):
        raise OverflowError("a number of words beyond 2**28")
    return b"".join(_packed(values[k : k + _SLICE].astype(np.int64)) for k in range(0, len(values), _SLICE))


def _packed(v: np.ndarray) -> bytes:
    size = 1 + (v >= 1 << 7) + (v >= 1 << 14) + (v >= 1 << 21)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]), np.uint8)
    start = end - size
    for k in range(4):
        has = size > k
        more = (size[has] > k + 1).astype(np.int64) << 7
        out[start[has] + k] = ((v[has] >> (7 * k)) & 127) | more
    return out.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    every = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(every):
        b = every[at : at + _SLICE]
        last = np.flatnonzero(b < 128)
        b = b[: last[-1] + 1].astype(np.int32)
        first = np.concatenate([[0], last[:-1] + 1])
        k = np.arange(len(b), dtype=np.int32) - np.repeat(first, last - first + 1).astype(np.int32)
        parts.append(np.add.reduceat((b & 127) << (7 * k), first, dtype=np.int32))
        at += len(b)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


# --- rows of a key that more than one node has -------------------------------------------------


def shared_keys(postings: DataFrame) -> DataFrame:
    """Of postings (key long, node binary, tag long), the distinct rows whose key has two nodes or more.

    One exchange on ``key``, one sort by that number alone, one streaming pass; of a key only its current
    run is held while it has one node, and once a key is known to be shared its rows are passed on batch by
    batch, however many there are. What is left is made distinct afterwards.
    """
    ordered = postings.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_shared_runs, "key long, node binary, tag long").distinct()


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    open_key: int | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        n = t.num_rows
        if not n:
            continue
        key = t["key"].to_numpy()
        node = t["node"]
        same_node = pc.equal(node.slice(0, n - 1), node.slice(1)).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
        same_key = key[1:] == key[:-1]
        starts = np.flatnonzero(np.concatenate([[True], ~same_key]))
        shared = np.logical_or.reduceat(np.concatenate([[False], same_key & ~same_node]), starts)
        if open_key is not None and key[0] == open_key:
            shared[0] = True
        keep = np.repeat(shared, np.diff(np.append(starts, n)))
        if open_key is not None:
            keep[0] = False  # that row has been passed on already
        if shared[-1]:
            open_key, held = int(key[-1]), t.slice(n - 1)
        else:  # one node so far: its different tags wait
            open_key, held = None, t.slice(int(starts[-1]))
            held = held.take(np.unique(held["tag"].to_numpy(), return_index=True)[1])
        if keep.any():
            yield from t.filter(pa.array(keep)).to_batches()


# --- a fixed-width bitmap to thin rows before a shuffle ----------------------------------------

#: A bitmap has eight bits for each hash, within these bounds: 1 MB to 8 MB. Beyond, it thins less and the join does more.
BITMAP_LEAST, BITMAP_MOST = 1 << 17, 1 << 20


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap, 8 MB at most whatever the input, with the low bits of a long column set.

    Rows whose bit is clear cannot have a partner; the join that follows decides about the others.
    ``hashes`` is read twice: once to be counted.
    """
    size = BITMAP_LEAST
    rows = hashes.count()
    while size < BITMAP_MOST and 64 * size < 8 * rows:
        size *= 2
    bits = size.bit_length() - 1
    words = (
        hashes.select(F.col(column).bitwiseAND(size - 1).alias("word"), F.expr(f"shiftleft(1L, cast((shiftright({column}, {bits}) & 63) as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(size, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.int64)
    return (bits[h & (len(bits) - 1)] >> ((h >> (len(bits).bit_length() - 1)) & 63).astype(np.uint64)) & np.uint64(1) == 1


# --- joins on keys of which one may hold a third of all rows -------------------------------------

#: A key with more than this share of all rows is a hot one. There can be no more than SHARE of them.
SHARE = 1000


def hot_keys(counted: DataFrame, n_col: str, total: int, least: int = 2000) -> DataFrame:
    """The rows of ``counted`` (one for each key) whose ``n_col`` is above ``total / SHARE``: fewer than SHARE, so they may be broadcast."""
    return counted.filter((F.col(n_col) * SHARE > total) & (F.col(n_col) > least))


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has a few rows for each key, all with the key's number of rows in ``n_col``.

    Hot keys meet their rows where these are (fewer than SHARE are broadcast); all others are joined by
    a shuffle in which no key holds more than a thousandth of the rows. ``n_col`` is dropped.
    """
    hot = materialize(hot_keys(counted, n_col, total).drop(n_col), "hot")
    if hot.isEmpty():
        return rows.join(counted.drop(n_col), key)
    cold = counted.join(F.broadcast(hot.select(key)), key, "left_anti").drop(n_col)
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(usual)


# --- pairs within keys, and partners beside their centres -----------------------------------------

#: Postings of one key that are compared with each other in one place.
CELL = 1000


def in_cells(known: DataFrame, cell: int = CELL) -> DataFrame:
    """Postings (key, node, part, ...) of keys with several parts, each in the cells (i, j) where it meets others.

    A key of many postings is cut into blocks, and each pair of blocks meets in a place of its own, so that no
    task holds a whole key. Every pair of postings of a key is in one cell that ``meet`` accepts.
    """
    counts = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).filter("low <> high")
    mixed = known.join(counts.select("key", F.ceil(F.col("n") / cell).cast("int").alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return materialize(mixed.withColumn("cell", F.explode(cells)).select(*known.columns, "block", "cell.i", "cell.j"), "cells")


def meet(x_block: str, y_block: str) -> Column:
    return (F.least(x_block, y_block) == F.col("i")) & (F.greatest(x_block, y_block) == F.col("j"))


def beside_centre(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(partner, centre, own, central) for pairs (a, b, centre) and values (node, value).

    Partners go to their centre, whose value is sent once for each part of its partners, not for each pair;
    a centre of many partners is cut into parts, so that none holds more than a thousandth of all pairs.
    """
    total = pairs.count()
    several = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    parts = materialize(hot_keys(several, "n", total).select("centre", F.ceil(F.col("n") * SHARE / max(total, 1)).alias("parts")), "parts")
    partner = F.when(F.col("centre") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    part = F.pmod(F.xxhash64("partner"), F.coalesce("parts", F.lit(1)))
    dealt = pairs.withColumn("partner", partner).join(F.broadcast(parts), "centre", "left").select("partner", "centre", part.alias("part"))
    centres = values.join(dealt.select(F.col("centre").alias("node"), "part").distinct(), "node")
    both = dealt.join(values.select(F.col("node").alias("partner"), F.col("value").alias("own")), "partner")
    return both.join(centres.select(F.col("node").alias("centre"), "part", F.col("value").alias("central")), ["centre", "part"]).select("partner", "centre", "own", "central")


# --- connected components -----------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b): the smallest node that links lead to.

    Labels go to neighbours and are then replaced by their own label's label, so the number of rounds
    grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    with scratch(edges.sparkSession):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
        both = materialize(both, "edges")
        labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
        while True:
            near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("n")).agg(F.min("component").alias("low"))
            lower = labels.join(near, labels.node == near.n, "left").select("node", "component", F.least("component", "low").alias("low"))
            up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
            moved = lower.join(up, "low", "left").select("node", F.least("low", "up").alias("component"), F.col("component").alias("was"))
            labels = materialize(moved, "labels")
            if labels.filter("component <> was").isEmpty():
                return materialize(labels.select("node", "component"), "components", keep=True)


# --- exact ranks without one task per group ------------------------------------------------------


#: Parts of a bucket whose rows follow a second number: a group of equal first numbers is never one task's alone.
PARTS = 32


def rank_within(df: DataFrame, group: str, order: list[str | Column], spread: Column, rows: int, name: str, per_task: int = 2_000, within: Column | None = None) -> DataFrame:
    """Adds a 0-based gapless rank within ``group`` as ``name``.

    ``spread`` (a long) is cut into buckets that the rank follows first; ``order`` orders rows inside a
    bucket. Each (group, bucket) is one window, so a task holds a whole group only where it is small; only
    bucket counts meet in the running sum. Rows of one ``spread`` stay in one bucket; where these may be many,
    ``within`` (a long) cuts each bucket into PARTS.
    """
    buckets = max(64 if rows > 1000 else 1, min(1 << 20 if within is None else (1 << 20) // PARTS, -(-rows // per_task)))
    bucket, rank = fresh(df, "bucket", "rank_in_bucket")
    place = F.pmod(spread, F.lit(buckets))
    if within is not None and buckets > 1:
        place = place * PARTS + F.pmod(within, F.lit(PARTS))
    d = df.withColumn(bucket, place.cast("int"))
    if buckets == 1:
        return d.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long")).drop(bucket)
    counts = d.groupBy(group, bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("g_"), F.col(bucket).alias("b_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_"))
    ranked = d.withColumn(rank, F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order)) - 1)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("g_")) & (F.col(bucket) == F.col("b_")))
    return joined.withColumn(name, (F.col("start_") + F.col(rank)).cast("long")).drop("g_", "b_", "start_", rank, bucket)
