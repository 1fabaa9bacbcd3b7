"""A Merkle manifest of a dataset: one tree for each group, one over the groups, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm.common import materialize

#: Children of a node.
ARITY = 3
#: Rows of a range partition, about, and the most partitions; levels that one shuffle of boundary nodes finishes.
PARTITION_ROWS, MOST_PARTITIONS, LEVELS = 20_000, 1 << 18, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = ["g", "n", "level", "place"]  # a node: its group, the group's number of leaves, its level (0: leaves), its place there


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 over digests written as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


@lru_cache(1000)
def sizes(n: int) -> tuple[int, ...]:
    """Nodes of each level, from ``n`` leaves to one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return tuple(out)


def fold(leaf: bytes, place: int, n: int, siblings: bytes) -> bytes:
    """The root that a leaf and its siblings, level by level and left to right, lead to."""
    at, node = 0, leaf
    for size in sizes(n)[:-1]:
        first = place - place % ARITY
        others = min(ARITY, size - first) - 1
        run = [siblings[at + 32 * k : at + 32 * k + 32] for k in range(others)]
        run.insert(place - first, node)
        at += 32 * others
        node, place = digest(run), place // ARITY
    return node


Nodes = dict[int, dict[int, bytes]]


def climb(n: int, nodes: Nodes, top: int) -> None:
    """Adds to the nodes of a tree, by level and place, all parents up to level ``top`` whose children are all there."""
    width = sizes(n)
    for level in range(min(nodes, default=top), min(top, len(width) - 1)):
        have = nodes.get(level, {})
        for parent in {k // ARITY for k in have}:
            run = range(parent * ARITY, min(parent * ARITY + ARITY, width[level]))
            if all(k in have for k in run):
                nodes.setdefault(level + 1, {})[parent] = digest([have[k] for k in run])


def path(n: int, nodes: Nodes, level: int, place: int) -> tuple[bytes, int, int]:
    """Siblings from a node upwards as far as there are parents, and the level and place reached."""
    width, found = sizes(n), []
    while place // ARITY in nodes.get(level + 1, ()):
        first, here = place - place % ARITY, nodes[level]
        found += [here[k] for k in range(first, min(first + ARITY, width[level])) if k != place]
        level, place = level + 1, place // ARITY
    return b"".join(found), level, place


# --- complete subtrees where the rows lie ---------------------------------------------------------


def _groups(rows: Iterator[Row]) -> Iterator[list[Row]]:
    held: list[Row] = []
    for row in rows:
        if held and held[-1].g != row.g:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _ends(partition: int, rows: Iterator[Row]) -> Iterator[tuple]:
    """Of a partition: its first and its last group, and the rows that it has of either."""
    first = last = None
    n_first = n_last = 0
    for row in rows:
        if row.g != last:
            first = row.g if first is None else first
            last, n_last = row.g, 0
        n_last += 1
        n_first += row.g == first
    if first is not None:
        yield partition, first, n_first, last, n_last


def _offsets(ends: list[tuple]) -> dict[int, tuple[int, int, str, int]]:
    """For each partition: the rows of its first group in the partitions before, all rows of that group, its last group and all rows of that.

    Only a partition's first and last group reach into others, so these numbers place every row.
    """
    total: dict[str, int] = {}
    before = {}
    for partition, first, n_first, last, n_last in sorted(ends):
        before[partition] = total.get(first, 0)
        total[first] = before[partition] + n_first
        if last != first:
            total[last] = n_last
    return {p: (before[p], total[first], last, total[last]) for p, first, _, last, _ in ends}


def _subtrees(offsets: dict[int, tuple[int, int, str, int]], names: list[str]) -> Callable[[int, Iterator[Row]], Iterator[tuple]]:
    """Of each row the siblings within the largest subtree that lies whole in its partition; then those subtrees' tops."""

    def run(partition: int, rows: Iterator[Row]) -> Iterator[tuple]:
        for k, held in enumerate(_groups(rows)):
            before, n_first, last, n_last = offsets[partition]
            g, start = held[0].g, 0 if k else before
            n = (n_last if g == last else len(held)) if k else n_first
            nodes: Nodes = {0: {start + i: bytes(row.digest) for i, row in enumerate(held)}}
            climb(n, nodes, len(sizes(n)))
            tops = set()
            for i, row in enumerate(held, start):
                siblings, *top = path(n, nodes, 0, i)
                tops.add(tuple(top))
                yield (g, n, *top, None, i, siblings, *(row[c] for c in names))
            for level, place in tops:
                yield (g, n, level, place, nodes[level][place], None, None, *(None for _ in names))

    return run


def _paths_within(top: int) -> Callable[[pa.Table], pa.Table]:
    """Of boundary nodes under one node of level ``top``: their siblings up to it, and the node itself."""

    def run(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        nodes: Nodes = {}
        known = list(zip(t["level"].to_pylist(), t["place"].to_pylist(), t["digest"].to_pylist(), strict=True))
        for level, place, own in known:
            nodes.setdefault(level, {})[place] = own
        climb(n, nodes, top)
        out = []
        for level, place, own in known:
            siblings, *up = path(n, nodes, level, place)
            out.append((level, place, own, siblings, *up, nodes[up[0]][up[1]]))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
        head = {"g": pa.array([t["g"][0].as_py()] * len(out), pa.string()), "n": pa.array([n] * len(out), pa.int64())}
        return pa.table(head | {c: pa.array(v, k) for c, v, k in zip(["level", "place", "digest", "siblings", "up_level", "up_place", "up_digest"], columns, kinds, strict=True)})

    return run


def _finish(tops: DataFrame) -> DataFrame:
    """(g, level, place, siblings, subroot) of boundary nodes: siblings from each up to its group's root.

    A round takes LEVELS levels: nodes meet under their ancestor there, ARITY ** LEVELS and their parents at most, and the
    ancestors go on. There are a few dozen boundary nodes for each partition, whatever the rows.
    """
    most = tops.agg(F.max("n").alias("n")).first()["n"] or 1
    nodes, bands = tops, []
    for top in range(LEVELS, len(sizes(most)) - 1 + LEVELS, LEVELS):
        low = nodes.filter(F.col("level") < top)
        span = F.lit(ARITY).cast("double") ** (top - F.col("level"))
        coordinate = F.floor(F.col("place") / F.round(span).cast("long"))
        met = low.withColumn("under", coordinate.cast("long")).groupBy("g", "under")
        schema = "g string, n long, level int, place long, digest binary, siblings binary, up_level int, up_place long, up_digest binary"
        band = materialize(met.applyInArrow(_paths_within(top), schema), "band")
        bands.append(band)
        reached = band.select("g", "n", F.col("up_level").alias("level"), F.col("up_place").alias("place"), F.col("up_digest").alias("digest")).distinct()
        nodes = nodes.filter(F.col("level") >= top).unionByName(reached)
    done = nodes.select("g", "level", "place", F.lit(b"").alias("siblings"), F.col("digest").alias("subroot")).distinct()
    for band in reversed(bands):
        above = done.select("g", F.col("level").alias("up_level"), F.col("place").alias("up_place"), F.col("siblings").alias("upper"), "subroot")
        below = band.filter("level <> up_level OR place <> up_place").join(above, ["g", "up_level", "up_place"])
        done = done.unionByName(below.select("g", "level", "place", F.concat("siblings", "upper").alias("siblings"), "subroot"))
    return materialize(done, "upper")


def _grow(leaves: DataFrame, keys: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Trees over leaves (g, digest, ...) in the order of ``keys`` within their groups.

    Leaves come back as (g, n, level, place, position, siblings, names): ``siblings`` up to the node at ``level`` and
    ``place``, the second table's rows lead from there to the group's root.
    """
    spark = leaves.sparkSession
    rows = leaves.count()
    tasks = 1 if rows <= PARTITION_ROWS else min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS)))
    order = ["g", *keys]
    ordered = leaves.repartitionByRange(tasks, *order).sortWithinPartitions(*order).rdd
    offsets = _offsets(ordered.mapPartitionsWithIndex(_ends).collect())
    fields = [("g", T.StringType()), ("n", T.LongType()), ("level", T.IntegerType()), ("place", T.LongType()), ("digest", T.BinaryType()), ("position", T.LongType()), ("siblings", T.BinaryType())]
    schema = T.StructType([*(T.StructField(*f) for f in fields), *(leaves.schema[c] for c in names)])
    for field in schema:
        field.nullable = True
    trees = materialize(spark.createDataFrame(ordered.mapPartitionsWithIndex(_subtrees(offsets, names)), schema, verifySchema=False), "trees")
    tops = trees.filter("digest IS NOT NULL").select(*NODE, "digest")
    return trees.filter("digest IS NULL").drop("digest"), _finish(tops)


# --- the manifest ---------------------------------------------------------------------------------


def leaf_of(fields: dict[str, Column]) -> Column:
    """SHA-256 (binary) of all fields: ``-`` for null, else the bytes of its UTF-8 form, ``:`` and that form."""
    texts = [c.cast("string") for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, presented: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    Rows of a group are the leaves of a tree in the order of their ids; the groups' roots, in the order of their names (null
    first, then by UTF-8 bytes), are those of the tree above. ``presented`` replaces fields of the row that is shown to be
    verified: ``folded_root`` is what that row and the original siblings lead to, ``verified`` says whether it is the root.

    Texts are hashed where they are read; only digests are sorted by range, and each task builds what is whole in its range.
    Nulls are fields of their own (a null id comes first). Rows of one id follow their digests, and equal rows are leaves of
    their own. An empty table gives no rows; other columns, of any name, are not read. The digest of no siblings is that of
    the empty text.
    """
    own = {c: F.col(c) for c in fields}
    shown = own | (presented or {})
    group = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    hashed = df.select(group.alias("g"), F.col(id_col).alias("id"), leaf_of(own).alias("digest"), leaf_of(shown).alias("shown"))
    leaves = materialize(hashed.withColumn("row", F.monotonically_increasing_id()), "leaves").withColumn("leaf", F.col("digest"))
    trees, upper = _grow(leaves, ["id", "digest", "row"], ["id", "leaf", "shown"])

    groups = upper.groupBy("g").agg(F.first("subroot").alias("digest")).select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    over, above = _grow(materialize(groups, "groups"), ["name"], ["name"])
    over = over.join(above.withColumnRenamed("siblings", "upper"), ["g", "level", "place"])
    over = over.select(F.col("name").alias("g"), F.col("n").alias("n_groups"), F.col("position").alias("group_place"), F.concat("siblings", "upper").alias("group_siblings"), F.col("subroot").alias("root"))

    upwards = upper.withColumnRenamed("siblings", "upper").join(over, "g")
    found = trees.join(upwards, ["g", "level", "place"])
    id_type = df.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, T.StringType()) for c in names[1:]), T.StructField("verified", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, leaf, seen, n, position, low, high, subroot, n_groups, group_place, group_siblings, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folded = fold(fold(seen, position, n, low + high), group_place, n_groups, group_siblings)
                proof = hashlib.sha256((low + high + group_siblings).hex().encode()).hexdigest()
                out.append((key, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [arrow_id, *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "verified"])

    return found.select("id", "leaf", "shown", "n", "position", "siblings", "upper", "subroot", "n_groups", "group_place", "group_siblings", "root").mapInArrow(run, schema)


def without_line_ends(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without its line ends, where 2 divides the CRC-32 of the decimal id; else as it is."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
