"""Line dedup: an edit-distance join of lines by segments (Pass-Join), and one kept line of each class."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm.common import beside_centre, binary, bitmap, connected_components, fresh, gather, in_bitmap, in_cells, join_counted, materialize, meet, return_freed_memory, scratch, texts_of

THRESHOLD = 2
#: A line has so many characters for each edit that may tell it from a near one; shorter lines must be equal.
PER_EDIT = 12
_CLASSES = 15
_INDEX, _PROBE_SAME, _PROBE_LONGER = 3, 1, 2


def line_hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def lines_in(text: str, min_chars: int = 0) -> list[str]:
    """The lines of a text that may repeat others: all but blank ones and those under ``min_chars`` characters."""
    return [x for x in text.split("\n") if len(x) >= min_chars and x and not x.isspace()]


def edits_for(length: int, threshold: int) -> int:
    """Edits by which a line of ``length`` characters may differ from a longer or equal one that counts as its repeat."""
    return min(threshold, length // PER_EDIT)


def even(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` even segments."""
    base, longer = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        size = base + (k >= parts - longer)
        out.append((at, size))
        at += size
    return out


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the even segments of a line, one more than the edits it allows."""
    return even(length, edits_for(length, threshold) + 1)


def substrings(length: int, less: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a text that can equal a segment of one ``less`` characters shorter, ``edits`` away at most.

    A segment may be moved only as far as the edits on its left and those on its right both allow.
    """
    out = []
    for k, (at, size) in enumerate(even(length - less, edits + 1)):
        low = max(at - k, at + less - (edits - k), 0)
        high = min(at + k, at + less + (edits - k), length - size)
        out += [(k, start, size) for start in range(low, high + 1)]
    return out


def probes(length: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(shorter by, segment, start, size) of the substrings of a line that can equal a segment of a line up to ``threshold`` shorter."""
    out = []
    for less in range(threshold + 1):
        edits = edits_for(length - less, threshold)
        if edits and edits >= less:
            out += [(less, *found) for found in substrings(length, less, edits)]
    return out


def _code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of lines one after another, and the length of each."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, lines), np.int64, len(lines))


def _letter_counts(lines: list[str]) -> np.ndarray:
    """Counts of 15 classes of code points modulo 16, four bits each: an edit changes two counts by one at most."""
    codes, lengths = _code_points(lines)
    slot = np.repeat(np.arange(len(lines)) * _CLASSES, lengths)
    slot += codes % np.uint32(_CLASSES)
    counts = np.bincount(slot, minlength=len(lines) * _CLASSES).reshape(-1, _CLASSES) & 15
    return (counts << (4 * np.arange(_CLASSES))).sum(axis=1)


#: Keys are numbers of a polynomial in _BASE over code points modulo 2**64. Two substrings that share one by chance are only compared.
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(20_000)
def _plan(length: int, threshold: int) -> np.ndarray:
    """(role, shorter by, segment, start, size) of the segments and substrings that a line of ``length`` is posted by."""
    aligned = {(k, at) for k, (at, _) in enumerate(segments(length, threshold))}
    rows = [(_PROBE_LONGER if less else _INDEX if (k, start) in aligned else _PROBE_SAME, less, k, start, size) for less, k, start, size in probes(length, threshold)]
    return np.array(rows, np.int64).reshape(-1, 5)


class _Keys:
    """The keys of lines, of many at a time: (row, key, role, shorter by, start, size) of each segment and substring.

    A sum over code points times powers is carried along all lines; a substring's own is the difference of two
    sums, brought back to its first place by a power of the inverse.
    """

    def __init__(self, threshold: int):
        self.threshold = threshold
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, lines: list[str]) -> tuple[np.ndarray, ...]:
        codes, lengths = _code_points(lines)
        if len(self.up) <= len(codes):
            self.up, self.down = (_powers(x, len(codes) + 1) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=sums[1:])
        kinds, kind = np.unique(lengths, return_inverse=True)
        plans = [_plan(n, self.threshold) for n in kinds.tolist()]
        picked, each = gather(np.cumsum([0, *map(len, plans)]), kind)
        role, less, k, start, size = np.concatenate(plans)[picked].T
        rows = np.repeat(np.arange(len(lines)), each)
        at = (np.cumsum(lengths) - lengths)[rows] + start
        keys = (sums[at + size] - sums[at]) * self.down[at]
        keys += ((lengths[rows] - less) * 64 + k + 1).astype(np.uint64) * np.uint64(_BASE)
        return rows, _mixed(keys), role, less, start, size


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers one to one, spread over all bits (the last steps of splitmix64); ``x`` is overwritten."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: A posting in a cell, the buckets of keys that cells are for, and the postings of one cell at most.
_POSTING = np.dtype([("key", "<u8"), ("node", "<u8", 2), ("tag", "<i8")])
BUCKET_BITS, CELL_POSTINGS = 13, 512
#: Characters whose keys are found at once, and postings that are dealt to cells at once.
_CHARS, _DEALT = 1 << 17, 1 << 20


def _postings(docs: DataFrame, text_col: str, threshold: int, min_chars: int) -> DataFrame:
    """Cells (bucket, postings) of the segments and substrings of lines; a line is posted once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        seen: set[bytes] = set()
        keys_of = _Keys(threshold)
        lines: list[str] = []
        nodes: list[bytes] = []
        parts: list[np.ndarray] = []
        chars = waiting = 0

        def post() -> int:
            rows, keys, role, *_ = keys_of.of(lines)
            own = np.empty(len(rows), _POSTING)
            own["key"] = keys
            own["node"] = np.frombuffer(b"".join(nodes), "<u8").reshape(-1, 2)[rows]
            own["tag"] = _letter_counts(lines)[rows] << 2 | role
            parts.append(own)
            lines.clear()
            nodes.clear()
            return len(own)

        for batch in batches:
            for text in texts_of(batch.column(0)):
                for line in lines_in(text, max(min_chars, PER_EDIT)):
                    if (node := line_hash(line)) not in seen:
                        seen.add(node)
                        lines.append(line)
                        nodes.append(node)
                        chars += len(line)
                        if chars >= _CHARS:
                            waiting += post()
                            chars = 0
                            if waiting >= _DEALT:
                                yield _cells(np.concatenate(parts))
                                parts.clear()
                                waiting = 0
        if lines:
            post()
        if parts:
            yield _cells(np.concatenate(parts))

    return docs.select(text_col).mapInArrow(run, "bucket int, postings binary")


def _cells(rows: np.ndarray) -> pa.RecordBatch:
    """Postings dealt by the first bits of their keys, CELL_POSTINGS in a cell at most."""
    bucket = (rows["key"] >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], _taken(rows, order)
    place = np.arange(len(rows))
    begin = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    begin |= (place - np.maximum.accumulate(np.where(begin, place, 0))) % CELL_POSTINGS == 0
    starts = np.flatnonzero(begin)
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), _fixed(rows, np.append(starts, len(rows)) * _POSTING.itemsize)], ["bucket", "postings"])


def _taken(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    return rows.view("<u8").reshape(-1, 4).take(order, axis=0).reshape(-1).view(_POSTING)


def _fixed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def shared_postings(cells: DataFrame) -> DataFrame:
    """Of postings in ``cells``, the distinct (key, node, tag) whose key has two nodes or more.

    One exchange of cells on their bucket, one sort by it, one streaming pass. Of the bucket that is open, one posting
    stays for each key known to be shared, and of other keys one node's; the postings of shared keys are passed on at once.
    """
    ordered = cells.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(_shared_in_cells, "key long, node binary, tag long").distinct()


def _shared_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return_freed_memory()
    held, passed = np.empty(0, _POSTING), np.empty(0, bool)
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), _POSTING)
        if not len(rows):
            continue
        last = np.uint64(batch.column(0)[batch.num_rows - 1].as_py())
        rows = np.concatenate([held, rows])
        passed = np.concatenate([passed, np.zeros(len(rows) - len(passed), bool)])
        order = np.argsort(rows["key"], kind="stable")
        key = rows["key"][order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        each = np.diff(np.append(starts, len(key)))
        node = rows["node"][order]
        other = np.zeros(len(key), bool)
        other[1:] = (key[1:] == key[:-1]) & (node[1:] != node[:-1]).any(axis=1)
        shared = np.logical_or.reduceat(other | passed[order], starts)
        is_shared = np.repeat(shared, each)
        out = _taken(rows, order[is_shared & ~passed[order]])
        if len(out):
            places = np.arange(len(out) + 1) * 16
            yield pa.RecordBatch.from_arrays([pa.array(out["key"].view(np.int64)), _fixed(out["node"], places), pa.array(out["tag"])], ["key", "node", "tag"])
        # The bucket of the batch's end may go on.
        is_open = (key >> np.uint64(64 - BUCKET_BITS)) == last
        single = rows[order[is_open & ~is_shared]]
        single = single[np.lexsort((single["tag"], single["key"]))]
        if len(single):
            single = single[np.concatenate([[True], (single["key"][1:] != single["key"][:-1]) | (single["tag"][1:] != single["tag"][:-1])])]
        known = rows[order[starts[shared & is_open[starts]]]]
        held = np.concatenate([known, single])
        passed = np.arange(len(held)) < len(known)


# --- keys that many lines share ------------------------------------------------------------------

#: Postings of a key beyond which its lines are not compared in pairs but by what else they share, and how often that is repeated.
FEW, DEPTH = 1000, 3
_REST = "key long, node binary, tag long, part binary, less int, edits int, rest string"


def _rests(threshold: int):
    """For lines (node, value, part, keys): a row for each of their segments and substrings with one of the keys, and the line without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = _Keys(threshold)
        for batch in batches:
            out = []
            lines, nodes, parts = (batch[c].to_pylist() for c in ("value", "node", "part"))
            if lines:
                wanted = [set(x) for x in batch["keys"].to_pylist()]
                counts = _letter_counts(lines).tolist()
                rows, keys, *plan = keys_of.of(lines)
                for row, key, role, less, start, size in zip(rows.tolist(), keys.view(np.int64).tolist(), *(x.tolist() for x in plan), strict=True):
                    if key in wanted[row]:
                        line = lines[row]
                        out.append((key, nodes[row], counts[row] << 2 | role, parts[row], less, edits_for(len(line) - less, threshold), line[:start] + line[start + size :]))
            yield _rest_rows(out)

    return run


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _rest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "node", "tag", "part", "less", "edits", "rest"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key is the one before and a segment (or substring) of the rest, which goes from the rest.

    Two near lines that share a segment that no edit touches have all their edits in their rests, so these share one as well.
    """
    for batch in batches:
        out = []
        for key, node, tag, part, less, edits, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            wide, role, n = rest.encode("utf-32-le", "surrogatepass"), tag & 3, len(rest)
            aligned = {(k, at) for k, (at, _) in enumerate(even(n, edits + 1))} if role == _INDEX else ()
            for k, start, size in substrings(n, less, edits):
                own = role if role != _INDEX or (k, start) in aligned else _PROBE_SAME
                seed = (key + (k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
                out.append((_signed(xxhash.xxh3_64_intdigest(wide[4 * start : 4 * (start + size)], seed)), node, tag >> 2 << 2 | own, part, less, edits, rest[:start] + rest[start + size :]))
            if len(out) > 20_000:
                yield _rest_rows(out)
                out = []
        yield _rest_rows(out)


def _crowded(known: DataFrame) -> DataFrame:
    """The keys of more than FEW postings in different components."""
    counts = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    return materialize(counts.filter((F.col("low") != F.col("high")) & (F.col("n") > FEW)).select("key", "n"), "crowded")


def _met(known: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components, an indexed line and one that probes it, under one key (key, node, tag, part)."""
    role = F.col("tag").bitwiseAND(3)
    mixed = in_cells(known.select("key", "node", "tag", "part").distinct())
    x = mixed.filter(role == _INDEX).select("key", "i", "j", *(F.col(c).alias(f"x_{c}") for c in ("node", "tag", "part", "block")))
    y = mixed.select("key", "i", "j", *(F.col(c).alias(f"y_{c}") for c in ("node", "tag", "part", "block")))
    one_way = (F.col("y_tag").bitwiseAND(3) == _PROBE_LONGER) | (F.col("x_node") < F.col("y_node"))
    met = x.join(y, ["key", "i", "j"]).filter(meet("x_block", "y_block") & one_way & (F.col("x_part") != F.col("y_part")) & _near("x_tag", "y_tag", threshold))
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def _across(docs: DataFrame, text_col: str, threshold: int, min_chars: int, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a key, and where many lines share it as much more of their text as sets them apart.

    Lines under a crowded key are posted again by that key and a segment of what is left of them, as often as keys are still
    crowded and lines have something left; so a segment that stands in every line costs in proportion to the lines.
    """
    crowded = _crowded(known)
    if crowded.isEmpty():
        return _met(known, threshold).distinct()
    pairs = [_met(known.join(crowded, "key", "left_anti"), threshold)]
    total = known.count()
    held = join_counted(known, crowded, "key", "n", total).groupBy("node").agg(F.first("part").alias("part"), F.collect_set("key").alias("keys"))
    held = materialize(held, "crowded_lines")
    lines = _lines_of(docs, text_col, held.select("node"), min_chars)
    rows = materialize(lines.join(held, "node").select("node", "value", "part", "keys").mapInArrow(_rests(threshold), _REST), "rests")
    for depth in range(DEPTH):
        rows = materialize(rows.mapInArrow(_refined, _REST).distinct(), "refined")
        crowded = _crowded(rows) if depth < DEPTH - 1 else None
        if crowded is None or crowded.isEmpty():
            pairs.append(_met(rows, threshold))
            break
        pairs.append(_met(rows.join(crowded, "key", "left_anti"), threshold))
        rows = join_counted(rows, crowded, "key", "n", rows.count()).select("key", "node", "tag", "part", "less", "edits", "rest")
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.distinct()


# --- links -----------------------------------------------------------------------------------------


def _near(a: str, b: str, threshold: int) -> Column:
    """The letter counts of two tags differ by no more than ``threshold`` edits can make."""
    total = F.lit(0)
    for k in range(_CLASSES):
        x, y = (F.shiftrightunsigned(c, 2 + 4 * k).bitwiseAND(15) for c in (a, b))
        d = (x - y).bitwiseAND(15)
        total = total + F.least(d, 16 - d)
    return total <= 2 * threshold


def within(pairs: list[tuple[str, str]], threshold: int) -> np.ndarray:
    """Which pairs have edit distance ``threshold`` or less: a banded bit-parallel computation, many pairs at a time.

    The band of each pair slides down the diagonal as one 64-bit word of vertical differences; its lowest
    cell gives the distance, along the diagonal first and along the last row afterwards.
    """
    result = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda i: max(map(len, pairs[i])))
    at = 0
    while at < len(order):
        part, widest = [], 1
        while at < len(order):
            widest = max(widest, *map(len, pairs[order[at]]))
            if part and (len(part) + 1) * widest > 3_000_000:
                break
            part.append(order[at])
            at += 1
        result[part] = _banded([pairs[i] for i in part], threshold)
    return result


def _codes(texts: list[str], width: int, filler: int, lead: int) -> np.ndarray:
    out = np.full((len(texts), lead + width), filler, np.uint32)
    for row, text in zip(out, texts, strict=True):
        row[lead : lead + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.ascontiguousarray(out.T)


def _banded(pairs: list[tuple[str, str]], k: int) -> np.ndarray:
    m = np.array([len(a) for a, _ in pairs])
    n = np.array([len(b) for _, b in pairs])
    width = int(max(m.max(), n.max()))
    a = _codes([x for x, _ in pairs], width + k + 1, 0xFFFFFFFF, k)
    b = _codes([x for _, x in pairs], width, 0xFFFFFFFE, 0)
    u, one, top = np.uint64, np.uint64(1), 63
    vp = np.full(len(pairs), (0xFFFFFFFFFFFFFFFF << (top - k)) & 0xFFFFFFFFFFFFFFFF, u)
    vn = np.zeros(len(pairs), u)
    distance = np.full(len(pairs), k, np.int64)
    with np.errstate(over="ignore"):
        for i in range(int(n.max())):
            x = np.zeros(len(pairs), u)
            for o in range(-k, k + 1):  # row i + o of the first text stands at bit 63 - k + o
                x |= (a[i + o + k] == b[i]).astype(u) << u(top - k + o)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            diagonal = i < m - k
            live = i < n
            along = np.clip(top - 1 - (i - (m - k)), 0, top).astype(u)
            step = np.where(diagonal, 1 - (d0 >> u(top)).astype(np.int64), ((hp >> along) & one).astype(np.int64) - ((hn >> along) & one).astype(np.int64))
            distance += np.where(live, step, 0)
            vp = hn | ~((d0 >> one) | hp)
            vn = (d0 >> one) & hp
    return (distance <= k) & (np.abs(m - n) <= k)


def _low_bits(node: str) -> Column:
    return F.conv(F.hex(F.substring(F.col(node), 1, 7)), 16, 10).cast("long")


def _low(nodes: list[bytes]) -> np.ndarray:
    """The first seven bytes of 16-byte hashes, as numbers."""
    return (np.frombuffer(b"".join(nodes), ">u8")[::2] >> np.uint64(8)).astype(np.int64)


def _lines_of(docs: DataFrame, text_col: str, nodes: DataFrame, min_chars: int) -> DataFrame:
    """(node, value) of the lines asked for; a bitmap of bounded size keeps most others from shuffling."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.select(_low_bits("node").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        table, seen = bits.value, set()
        for batch in batches:
            found, lines = [], []
            for text in texts_of(batch.column(0)):
                for line in lines_in(text, max(min_chars, PER_EDIT)):
                    if (node := line_hash(line)) not in seen:
                        seen.add(node)
                        found.append(node)
                        lines.append(line)
            if found:
                hit = in_bitmap(table, _low(found))
                yield pa.RecordBatch.from_arrays([binary(found), pa.array(lines, pa.string())], ["node", "value"]).filter(pa.array(hit))

    every = docs.select(text_col).mapInArrow(run, "node binary, value string")
    return every.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verified(docs: DataFrame, text_col: str, threshold: int, min_chars: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, centre) whose lines are near, each compared once."""
    nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    lines = materialize(_lines_of(docs, text_col, nodes, min_chars), "lines")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, central = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            edits = np.array([edits_for(min(len(a), len(b)), threshold) for a, b in zip(own, central, strict=True)], np.int64)
            ok = np.zeros(len(own), bool)
            for k in np.unique(edits[edits > 0]).tolist():
                rows = np.flatnonzero(edits == k)
                ok[rows] = within([(own[r], central[r]) for r in rows.tolist()], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["partner", "centre"]).filter(pa.array(ok))

    held = beside_centre(pairs, lines).mapInArrow(verify, "partner binary, centre binary")
    return materialize(held.select(F.least("partner", "centre").alias("a"), F.greatest("partner", "centre").alias("b")), "verified")


def near_lines(docs: DataFrame, text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = 0) -> DataFrame:
    """Links (a, b) between hashes of near lines; every near pair is linked, itself or through others.

    Two different lines are near if at most ``threshold`` edits (characters put in, left out or replaced) are
    between them, and no more than one for each PER_EDIT characters of the shorter. Blank lines and those under
    ``min_chars`` characters are left out. First every line meets one central line for each of its segments;
    only what these links leave in different components is then compared pair by pair, under a key that many lines share only
    where they share more of their text.
    """
    if not 1 <= threshold <= 7:
        raise ValueError("threshold is 1 to 7")
    with scratch(docs.sparkSession):
        p = materialize(shared_postings(_postings(docs, text_col, threshold, min_chars)), "postings")
        role = F.col("tag").bitwiseAND(3)
        least = F.min(F.when(role == _INDEX, F.struct("node", "tag"))).alias("c")
        centres = p.groupBy("key").agg(least, F.count("*").alias("n")).filter("c IS NOT NULL")
        centres = materialize(centres.select("key", F.col("c.node").alias("centre"), F.col("c.tag").alias("tag_c"), "n"), "centres")
        star = join_counted(p, centres, "key", "n", p.count())
        star = star.filter((F.col("node") != F.col("centre")) & _near("tag", "tag_c", threshold))
        first = materialize(star.groupBy(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).agg(F.min("centre").alias("centre")), "pairs")
        # Only lines under shared keys are read again, and texts no more.
        docs, text_col = materialize(_lines_of(docs, text_col, p.select("node").distinct(), min_chars), "lines"), "value"
        linked = _verified(docs, text_col, threshold, min_chars, first)

        of = connected_components(linked).select(F.col("node").alias("n_"), "component")
        known = p.join(of, p.node == of.n_, "left").select("key", "node", "tag", F.coalesce("component", "node").alias("part"))
        rest = _across(docs, text_col, threshold, min_chars, materialize(known, "parts"))
        second = materialize(rest.join(first.select("a", "b"), ["a", "b"], "left_anti").withColumn("centre", F.col("b")), "pairs")
        if second.isEmpty():
            return materialize(linked, "links", keep=True)
        return materialize(linked.unionByName(_verified(docs, text_col, threshold, min_chars, second)), "links", keep=True)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = 0) -> DataFrame:
    """(line, class, n, n_lines, keep_id) of each line that recurs, exactly or nearly.

    ``line`` and ``class`` are hashes; n counts the line's occurrences and n_lines those of its class; keep_id
    is the smallest id with one. A class is what links between near lines join.
    """
    id_type = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("line", T.BinaryType()), T.StructField("id", id_type), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        for batch in batches:
            least: dict[bytes, list] = {}
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                for line in lines_in(text, min_chars):
                    known = least.get(node := line_hash(line))
                    if known is None:
                        least[node] = [key, 1]
                    else:
                        known[1] += 1
                        if key is not None and (known[0] is None or key < known[0]):
                            known[0] = key
            ids = pa.array([v[0] for v in least.values()], arrow_id)
            yield pa.RecordBatch.from_arrays([binary(least), ids, pa.array([v[1] for v in least.values()], pa.int64())], ["line", "id", "n"])

    with scratch(docs.sparkSession):
        counted = docs.select(id_col, text_col).mapInArrow(run, schema).groupBy("line").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
        parts = connected_components(near_lines(docs, text_col, threshold, min_chars)).select(F.col("node").alias("n_"), "component")
        placed = counted.join(parts, counted.line == parts.n_, "left").filter("n > 1 OR component IS NOT NULL")
        placed = materialize(placed.select("line", "n", "id", F.coalesce("component", "line").alias("class")), "placed")
        least = placed.groupBy("class").agg(F.sum("n").alias("n_lines"), F.min("id").alias("keep_id"), F.count("*").alias("members"))
        classes = join_counted(placed.select("line", "n", "class"), materialize(least, "least"), "class", "members", placed.count())
        return materialize(classes.select("line", "class", "n", "n_lines", "keep_id"), "classes", keep=True)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = 0, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and how many lines there were and went, named by ``counts``.

    Of each class of lines the first line of the row with the smallest id stays; repeated rows with that id
    each keep theirs. Blank lines and those under ``min_chars`` characters stay always. Null texts stay null
    with no lines; rows with a null id keep nothing that another row has; empty tables give no rows; a document
    that loses all its lines keeps its row with an empty text. The two names must not exist yet.
    """
    clash = {c.lower() for c in counts} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    classes = line_classes(docs, id_col, text_col, threshold, min_chars).select("line", "class", "n", "keep_id")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(classes.select(_low_bits("line").alias("h")), "h"))
    row, found, list_, other = fresh(docs, "row", "found", "lines_", "other_row")
    place, text_at = len(docs.columns), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(list_, T.ArrayType(T.BinaryType()))])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of a text's lines that may recur; null where none can."""
        return_freed_memory()
        table = bits.value
        for batch in batches:
            nodes, each = [], []
            for text in texts_of(batch.column(text_at)):
                own = [line_hash(x) for x in lines_in(text, min_chars)]
                nodes += own
                each.append(len(own))
            hit = in_bitmap(table, _low(nodes)).tolist() if nodes else []
            out, at = [], 0
            for n in each:
                out.append([x for x, h in zip(nodes[at : at + n], hit[at : at + n], strict=True) if h] or None)
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.binary()))], [*batch.schema.names, list_])

    # Written once: a row's own number holds from then on, and texts are hashed no second time.
    marked = materialize(docs.mapInArrow(suspects, schema).withColumn(row, F.monotonically_increasing_id()), "marked")
    touched = marked.filter(F.col(list_).isNotNull())
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).cast("long")
    clean = marked.filter(F.col(list_).isNull()).select(*docs.columns, n_lines.alias(counts[0]), F.lit(0).cast("long").alias(counts[1]))
    exploded = touched.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.explode(F.array_distinct(list_)).alias("line"))
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    hits = join_counted(exploded, classes, "line", "n", total).select("row", F.struct(F.col("line"), F.col("id").eqNullSafe(F.col("keep_id")).alias("stays"), F.col("class")).alias("hit"))
    by_row = hits.groupBy("row").agg(F.collect_list("hit").alias(found)).withColumnRenamed("row", other)
    touched = touched.join(by_row.hint("shuffle_hash"), F.col(row) == F.col(other), "left").select(*docs.columns, found)
    out_schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_freed_memory()
        for batch in batches:
            texts, totals, dropped = [], [], []
            for text, hits in zip(batch.column(text_at).to_pylist(), batch.column(place).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                totals.append(len(lines))
                if not hits:
                    texts.append(text)
                    dropped.append(0)
                    continue
                known, kept, used = {h["line"]: h for h in hits}, [], set()
                for line in lines:
                    h = known.get(line_hash(line)) if line and len(line) >= min_chars else None
                    if h is None:
                        kept.append(line)
                    elif h["stays"] and h["class"] not in used:
                        used.add(h["class"])
                        kept.append(line)
                texts.append("\n".join(kept))
                dropped.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if k == text_at else batch.column(k) for k in range(place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], [*batch.schema.names[:place], *counts])

    return clean.union(touched.mapInArrow(rewrite, out_schema))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """What line dedup left of each document: its text, and how many lines it had and lost."""
    done = drop_repeated_lines(docs.select(id_col, text_col), id_col, text_col, **options)
    return done.select(id_col, "n_lines", "n_dropped", text_col)
