"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm.common import UPPER_TO_LOWER, fresh, materialize, texts_of

WINDOW = 10
#: Characters of test strings that one pass searches for; a larger benchmark is searched in as many passes as it needs.
PASS_CHARS = 8_000_000
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b if (b := UPPER_TO_LOWER[c]) in _WORD_BYTES else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of digits, letters a-z and anything beyond ASCII, A-Z lower-cased.

    All bytes of a character beyond ASCII are 0x80 or more, so byte classes do for UTF-8.
    """
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Patterns of one length, in words.

    The last two words of the text window are its block. A shift table says how far the window may move
    before the block can line up with any pattern; where the shift is 0 the block picks the bucket of
    patterns that end with it, in which the window's hash picks those of equal hash, and a comparison
    decides. However many patterns end alike, a window is compared with its likes only.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list], length: int):
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict = {}
        self.ending: dict = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.furthest), length - end)
            self.ending[self._key(pattern, length)][hash(pattern)].append((pattern, items))

    def _key(self, text, end: int):
        return text[end - 1] if self.block == 1 else (text[end - 2], text[end - 1])

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list]]:
        """(first word, items) of every occurrence, by position."""
        shift, ending, m, n, furthest = self.shift.get, self.ending, self.length, len(text), self.furthest
        pair = self.block == 2
        end = m
        while end <= n:
            key = (text[end - 2], text[end - 1]) if pair else text[end - 1]
            step = shift(key, furthest)
            if step:
                end += step
                continue
            window = tuple(text[end - m : end])
            for pattern, items in ending[key].get(hash(window), ()):
                if pattern == window:
                    yield end - m, items
            end += 1


def searchers(items: list[tuple[object, str]], window: int) -> list[WuManber]:
    """A searcher for each pattern length: the windows of all items, and items shorter than a window whole."""
    by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words(text)
        length = min(window, len(w))
        if length:
            for pattern in {tuple(w[k : k + length]) for k in range(len(w) - length + 1)}:
                by_length[length][pattern].append(item)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, pass_chars: int) -> tuple[int, Callable[[int], list[tuple[object, str]]]]:
    """The number of blocks of test strings, and a reader of one: no more than a block is ever on the driver."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    n = max(1, -(-total // pass_chars))
    if n > 1:  # dealt to passes once: a pass reads its own rows
        items = materialize(items.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")).repartition("pass").sortWithinPartitions("pass"), "passes")
    return n, lambda k: [(r["item"], r["text"]) for r in (items.filter(F.col("pass") == k) if n > 1 else items).toLocalIterator()]


RESULTS = ("n_words", "hit_spans", "hit_items")


def find_occurrences(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_chars: int = PASS_CHARS, names: tuple[str, str, str] = RESULTS
) -> DataFrame:
    """``docs`` with n_words, hit_spans (disjoint [start, end) word ranges in order) and hit_items, under ``names``.

    Every occurrence of every window of ``window`` consecutive item words counts, as does a whole item of
    fewer words. Null texts and items have no words and hit nothing; repeated rows each get their own
    result; an empty table on either side is allowed; other columns stay as they are. The three names must
    not exist yet. A benchmark beyond ``pass_chars`` is searched block after block: each block's hits are
    written and its tables dropped before the next is read.
    """
    clash = {n.lower() for n in names} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    item_type = benchmark.schema[item_col].dataType
    found = [T.LongType(), T.ArrayType(span), T.ArrayType(item_type)]
    passes, read = _passes(benchmark, item_col, item_text_col, pass_chars)
    spark = docs.sparkSession
    if passes == 1:
        schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, found)])
        return docs.mapInArrow(_search(spark.sparkContext.broadcast(read(0)), window, docs.columns.index(text_col), names, to_arrow_type(item_type)), schema)

    row, other = fresh(docs, "row", "other_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # a number holds once written
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([*texts.schema.fields, *map(T.StructField, RESULTS, found)])
    hits = []
    for k in range(passes):
        items = spark.sparkContext.broadcast(read(k))
        each = texts.mapInArrow(_search(items, window, 1, RESULTS, to_arrow_type(item_type)), schema).drop("text")
        hits.append(materialize(each if not k else each.filter(F.size("hit_spans") > 0), "hits"))
        items.destroy()
    every = functools.reduce(DataFrame.unionByName, hits)
    gathered = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("hit_items"))
    merged = gathered.select(F.col("row").alias(other), "n_words", "hit_spans", "hit_items").mapInArrow(_merge_rows, T.StructType([T.StructField(other, T.LongType()), *map(T.StructField, RESULTS, found)]))
    renamed = merged.toDF(other, *names)
    return numbered.join(renamed, F.col(row) == F.col(other)).select(*docs.columns, *names)


def _merged(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges in order, with those that meet or overlap made one."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merged([(s["start"], s["end"]) for s in x]) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS), batch.column(3)], batch.schema.names)


def _search(found, window: int, place: int, names: tuple[str, ...], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = searchers(found.value, window)
        for batch in batches:
            counts, spans, hits = [], [], []
            for text in texts_of(batch.column(place)):
                w = words(text)
                counts.append(len(w))
                ranges, items = [], {}
                for s in ready:
                    for start, who in s.search(w):
                        ranges.append((start, start + s.length))
                        items.update(dict.fromkeys(who))
                spans.append(_merged(ranges))
                hits.append(list(items))
            columns = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(hits, pa.list_(item_type))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return run


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Word and item counts of each document, the digest of its items, and whether it is contaminated."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("hit_items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no test string occurs, with their own columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; empty tables are allowed on either side.
    """
    names = tuple(fresh(docs, *RESULTS))
    return find_occurrences(docs, materialize(benchmark, "benchmark"), names=names, **options).filter(F.size(names[1]) == 0).select(*docs.columns)
