"""N-gram Jaccard join: rare-first prefix filtering, verified once for each pair, and its components.

Nodes are distinct shingle sets, so exact copies are one node from the start. Each set is put in one
global order, rare shingles first; two sets can only be similar if their short prefixes share a shingle
at positions that leave enough room for the rest. Groups of near copies are not written out as pairs:
first every node meets one central partner for each of its prefix shingles, what these links join is one
component, and only nodes of different components are then compared pair by pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm.common import CELL, UPPER_TO_LOWER, beside_centre, binary, bitmap, connected_components, fresh, in_bitmap, in_cells, join_counted, materialize, meet, return_freed_memory, scratch, shared_keys, texts_of

#: Shingles are ordered by two tables of fixed size (any order is correct; a truer one makes fewer candidates):
#: counts of words by 2**17 buckets, and counts of shingles that stand out in 2**20 buckets.
WORD_BITS, SHINGLE_BITS = 17, 20
#: Above every sum of word weights.
STANDS_OUT = 1 << 50
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Characters of text whose words are hashed at once.
SLICE = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _A)
_PLACE = _mix(np.arange(1, LONG_WORD + 1, dtype=np.uint64) * _B)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data`` and where each starts: sums of byte values weighted by place, mixed."""
    a = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    short = np.where(lengths <= LONG_WORD, lengths, 0)
    longest = int(short.max())
    h = np.zeros(len(starts), np.uint64)
    order = np.argsort(-short, kind="stable")  # longest first: those that have a k-th byte are the first so many
    at, having = starts[order], np.bincount(short)[::-1].cumsum()[::-1]
    with np.errstate(over="ignore"):
        for k in range(longest):
            n = having[k + 1]
            h[:n] += _BYTE[a[at[:n] + k]] * _PLACE[k]
        out = np.empty_like(h)
        out[order] = h
        for k in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lengths[k]])
        return _mix(out + lengths.astype(np.uint64) * _A), starts


def _chain(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` word hashes."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = _mix(out ^ h[k : len(h) - size + 1 + k]) * _B + np.uint64(k + 1)
    return _mix(out)


class Shingles:
    """Distinct shingles of texts as sorted 64-bit hashes, many texts at a time.

    With ``word_weights`` (integers by word bucket) each text also gets its shingles' sums of word weights,
    which depend on the shingle alone; with ``count_words`` words are counted by bucket in ``word_counts``.
    """

    def __init__(self, n: int, word_weights: np.ndarray | None = None, count_words: bool = False):
        self.n, self.weights = n, word_weights
        self.word_counts = np.zeros(1 << WORD_BITS, np.int64) if count_words else None

    def __call__(self, text: str) -> np.ndarray:
        return next(self.each([text]))

    def each(self, texts: list[str]) -> Iterator:
        part, size = [], 0
        for text in texts:
            part.append(text.encode("utf-8", "surrogatepass"))
            size += len(text)
            if size >= SLICE:
                yield from self._slice(part)
                part, size = [], 0
        yield from self._slice(part)

    def _slice(self, texts: list[bytes]) -> Iterator:
        if not texts:
            return
        h, starts = _word_hashes(b" ".join(texts).translate(UPPER_TO_LOWER))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in texts)]))
        shingles = _chain(h, self.n)
        bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        if self.word_counts is not None:
            self.word_counts += np.bincount(bucket, minlength=1 << WORD_BITS)
        total = np.concatenate([[0], np.cumsum(self.weights[bucket])]) if self.weights is not None else None
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            size = min(self.n, high - low)
            part = shingles[low : high - self.n + 1] if high - low >= self.n else _chain(h[low:high], size) if size else np.zeros(0, np.uint64)
            if total is None:
                part = np.sort(part)
                yield part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part
            else:
                part, first = np.unique(part, return_index=True)
                yield part, (total[low + size : high + 1] - total[low : high + 1 - size])[first]


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _text_key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)


def _survey(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Each document's set (size, digest, key of its text), and counts: words by bucket, then shingle buckets that stand out."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("size", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("text_key", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    id_type = to_arrow_type(schema["id"].dataType)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n, count_words=True)
        counts = np.zeros(1 << SHINGLE_BITS, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(1))
            sizes, nodes = [], []
            for s in shingles.each(texts):
                np.add.at(counts, _buckets(s), 1)
                sizes.append(len(s))
                nodes.append(_digest(s) if len(s) else None)
            keys = [_text_key(t) if size else None for t, size in zip(texts, sizes, strict=True)]
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(sizes, pa.int64()), binary(nodes), binary(keys), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names)
        # Of shingles only buckets well above this task's mean are passed on: the common ones, which are to come last.
        mean = counts.mean()
        counts = np.concatenate([shingles.word_counts, np.where(counts > mean + 4 * np.sqrt(mean) + 4, counts, 0)])
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 50_000):
            part = used[at : at + 50_000]
            k = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(part, pa.int32()), pa.array(counts[part], pa.int64())], names)

    both = materialize(docs.select(id_col, text_col).mapInArrow(run, schema), "survey", keep=True)
    return both.filter("bucket IS NULL").select("id", "size", "node", "text_key"), both.filter("bucket IS NOT NULL").select("bucket", "n")


def _order(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word weights and shingle counts, as integers; both tables have a fixed length, whatever the input."""
    out = np.zeros((1 << WORD_BITS) + (1 << SHINGLE_BITS), np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return np.rint(np.log2(out[: 1 << WORD_BITS] + 1.0) * (1 << 20)).astype(np.int64), out[1 << WORD_BITS :]


def _prefixes(docs: DataFrame, text_col: str, n: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, node, tag) of prefix shingles; tag holds position and set size. Copies within a task are posted once.

    Rare first: by the product of the words' frequencies, shingles that stand out last and by their count, equal
    ones by hash. All are integers that a shingle alone decides, so the order is the same in every text.
    """
    tables = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, common = tables.value
        shingles, seen = Shingles(n, weights), set()
        for batch in batches:
            keys, nodes, tags, each = [], [], [], []
            for s, rarity in shingles.each(texts_of(batch.column(0))):
                if not len(s) or (node := _digest(s)) in seen:
                    continue
                seen.add(node)
                length = len(s) - -(-percent * len(s) // 100) + 1
                often = common[_buckets(s)]
                rarity = np.where(often > 0, STANDS_OUT + often, rarity)
                if length < len(s):
                    rare = np.argpartition(rarity, length - 1)
                    cut = rarity[rare[length - 1]]
                    picked = np.flatnonzero(rarity <= cut)
                else:
                    picked = np.arange(len(s))
                first = s[picked[np.lexsort((s[picked], rarity[picked]))][:length]]
                keys.append(first.view(np.int64))
                tags.append(np.arange(len(first), dtype=np.int64) << 32 | len(s))
                nodes.append(node)
                each.append(len(first))
            if nodes:
                repeated = binary(nodes).take(pa.array(np.repeat(np.arange(len(nodes)), each)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), repeated, pa.array(np.concatenate(tags))], ["key", "node", "tag"])

    return docs.select(text_col).mapInArrow(run, "key long, node binary, tag long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional filters on two postings of one key.

    A similar pair passes at the first shingle that it shares, before which nothing is shared: that one and
    what follows it on the shorter rest must be overlap enough.
    """
    sa, sb = F.col(f"{a}_size"), F.col(f"{b}_size")
    rest = F.least(sa - F.col(f"{a}_pos"), sb - F.col(f"{b}_pos"))
    return (100 * F.least(sa, sb) >= percent * F.greatest(sa, sb)) & ((100 + percent) * rest >= percent * (sa + sb))


SKETCH = 1024


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of 1024 parts of the hash range."""
    return zlib.compress(np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=SKETCH).astype("<u4").tobytes(), 1)


def _opened(sketch: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sketch), "<u4")


def suffix_bound(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The suffix filter with 1024 parts at once: shared shingles are shared part by part, so the smaller counts bound them."""
    total = int(a.sum()) + int(b.sum())
    return (100 + percent) * int(np.minimum(a, b).sum()) >= percent * total


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _fetch(docs: DataFrame, text_col: str, n: int, wanted: DataFrame, sketches: bool) -> DataFrame:
    """(node, value) of the nodes asked for (node, text_key): their sketch or text.

    A bitmap of fixed size keeps other rows from shuffling; the join decides.
    """
    low = F.conv(F.hex(F.substring("text_key", 1, 7)), 16, 10).cast("long")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(low.alias("h")), "h"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        table, seen, shingles = bits.value, set(), Shingles(n)
        for batch in batches:
            texts = texts_of(batch.column(0))
            keys = [_text_key(t) for t in texts]
            hit = in_bitmap(table, np.array([int.from_bytes(k[:7]) for k in keys], np.int64)).tolist() if keys else []
            take = []
            for k, key in enumerate(keys):
                if hit[k] and key not in seen:
                    seen.add(key)
                    take.append(k)
            texts = [texts[k] for k in take]
            values = [_sketch(s) for s in shingles.each(texts)] if sketches else [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays([binary([keys[k] for k in take]), binary(values)], ["text_key", "value"])

    every = docs.select(text_col).mapInArrow(pick, "text_key binary, value binary")
    return materialize(every.join(wanted, "text_key").dropDuplicates(["node"]).select("node", "value"), "fetched")


def _verify(docs: DataFrame, text_col: str, n: int, percent: int, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, centre) whose sets are similar: bounded by their sketches first, those left compared once by their texts.
    """

    def compare(asked: DataFrame, sketches: bool, rule) -> DataFrame:
        nodes = asked.select(F.col("a").alias("node")).union(asked.select(F.col("b").alias("node"))).distinct()
        wanted = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
        values = _fetch(docs, text_col, n, materialize(wanted, "nodes"), sketches)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            check = rule()
            for batch in batches:
                rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["partner", "centre"]).filter(pa.array([check(*r) for r in rows], pa.bool_()))

        held = beside_centre(asked, values).mapInArrow(run, "partner binary, centre binary")
        return materialize(held.select(F.least("partner", "centre").alias("a"), F.greatest("partner", "centre").alias("b"), "centre"), "compared")

    def remembering(reader, holds):
        def make():
            read = reader()
            held: dict[bytes, np.ndarray] = {}

            def check(centre: bytes, own: bytes, central: bytes) -> bool:
                if centre not in held:
                    held.clear()
                    held[centre] = read(central)
                return holds(read(own), held[centre], percent)

            return check

        return make

    def reading_texts():
        shingles = Shingles(n)
        return lambda value: shingles(value.decode("utf-8", "surrogatepass"))

    bounded = compare(pairs, True, remembering(lambda: _opened, suffix_bound))
    return (bounded if bounded.isEmpty() else compare(bounded, False, remembering(reading_texts, similar))).select("a", "b")


def _across(known: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of different parts that share a key and may be similar, from postings (key, node, pos, size, part)."""
    mixed = in_cells(known, cell)
    sides = [mixed.select("key", "i", "j", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "pos", "size", "part", "block"))) for side in "xy"]
    met = sides[0].join(sides[1], ["key", "i", "j"]).filter(meet("x_block", "y_block"))
    met = met.filter((F.col("x_node") < F.col("y_node")) & (F.col("x_part") != F.col("y_part")) & _may_link("x", "y", percent))
    return met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(each document's set: id, size, node), and links (a, b) between nodes that join every similar pair.

    A similar pair is linked itself or through others: pairs within a component found already are not
    compared again, so thousands of near copies give links in proportion to their number.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    with scratch(docs.sparkSession):
        sets, counts = _survey(docs, id_col, text_col, n)
        postings = materialize(shared_keys(_prefixes(docs, text_col, n, percent, _order(counts))), "postings")
        p = postings.select("key", "node", F.shiftright("tag", 32).alias("pos"), F.col("tag").bitwiseAND(0xFFFFFFFF).alias("size"))
        q = p.select("key", *(F.col(c).alias(f"x_{c}") for c in ("node", "pos", "size")))

        # Round 1: of each key the node with the fewest rarer shingles before it is the one all others meet.
        centre = p.groupBy("key").agg(F.min(F.struct("pos", "node", "size")).alias("y"))
        star = q.join(centre.select("key", F.col("y.node").alias("y_node"), F.col("y.pos").alias("y_pos"), F.col("y.size").alias("y_size")), "key")
        star = star.filter((F.col("x_node") != F.col("y_node")) & _may_link("x", "y", percent))
        first = materialize(star.groupBy(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).agg(F.min("y_node").alias("centre")), "pairs")
        linked = materialize(_verify(docs, text_col, n, percent, sets, first), "links")
        parts = connected_components(linked)

        # Round 2: whatever is left between different components, pair by pair.
        of = parts.select(F.col("node").alias("n_"), "component")
        known = materialize(p.join(of, p.node == of.n_, "left").select("key", "node", "pos", "size", F.coalesce("component", "node").alias("part")), "parts")
        second = materialize(_across(known, percent).join(first.select("a", "b"), ["a", "b"], "left_anti").withColumn("centre", F.col("b")), "pairs")
        if second.isEmpty():
            return sets, materialize(linked, "links", keep=True)
        more = _verify(docs, text_col, n, percent, sets, second)
        return sets, materialize(linked.unionByName(more), "links", keep=True)


def _placed(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id, size, text_key, component_id) of each row; rows without shingles have no text key."""
    with scratch(docs.sparkSession):
        sets, found = links(docs, id_col, text_col, n, percent)
        alike = materialize(sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n")), "nodes")
        parts = connected_components(found).select(F.col("node").alias("n_"), "component")
        placed = alike.join(parts, alike.node == parts.n_, "left").select("node", "low", "n", F.coalesce("component", "node").alias("component"))
        least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
        by_node = materialize(placed.join(least, "component").select("node", "component_id", "n"), "by_node")
        with_set = join_counted(sets.filter("node IS NOT NULL"), by_node, "node", "n", sets.count())
        none = sets.filter("node IS NULL").withColumn("component_id", F.col("id"))
        both = with_set.select("id", "size", "text_key", "component_id").unionByName(none.select("id", "size", "text_key", "component_id"))
        return materialize(both.withColumn("component_id", F.coalesce("component_id", "id")), "placed", keep=True)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id): documents whose shingle sets have Jaccard similarity ``percent`` or more, directly or through others.

    Texts are lower-cased A-Z and cut at ASCII white space; with fewer than ``n`` words the whole sequence
    is one shingle. Null, empty and wordless texts have no shingles and are their own component. Equal
    texts are one component; repeated rows give a row each with the same component; the component id is
    its smallest id (null ids count last). Empty tables give no rows; other columns are not read.
    """
    placed = _placed(docs, id_col, text_col, n, percent)
    return placed.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest: one document of each group stays.

    Repeated rows with that id all stay, as do rows with a null id, null, empty and wordless texts. Where an id
    repeats with different texts, each row goes or stays by its own text. Ties cannot occur: of equal texts the
    smallest id stays. Empty tables give no rows; all columns stay as they are, whatever their names.
    """
    found = _placed(docs, id_col, text_col, n, percent)
    others = materialize(found.filter("id <> component_id").select("id", "text_key").distinct(), "others")
    # Ids with a row that stays too: only for these do texts decide.
    stay = found.filter("id = component_id").select("id").distinct()
    several = materialize(others.join(stay, "id", "left_semi").select("id").distinct(), "several")
    whole = others.join(several, "id", "left_anti").select(F.col("id").alias(id_col)).distinct()
    left = docs.join(materialize(whole, "whole"), id_col, "left_anti").select(*docs.columns)
    if several.isEmpty():
        return left
    place, (key,) = docs.columns.index(text_col), fresh(docs, "text_key")
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, binary([_text_key(t) for t in texts_of(batch.column(place))])], [*batch.schema.names, key])

    gone = others.join(several, "id", "left_semi").select(F.col("id").alias(id_col), F.col("text_key").alias(key))
    repeated = several.select(F.col("id").alias(id_col))
    mixed = left.join(repeated, id_col, "left_semi").select(*docs.columns).mapInArrow(keyed, schema)
    mixed = mixed.join(materialize(gone, "gone"), [id_col, key], "left_anti").select(*docs.columns)
    return left.join(repeated, id_col, "left_anti").select(*docs.columns).unionByName(mixed)
