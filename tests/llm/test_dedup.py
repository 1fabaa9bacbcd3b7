from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from auctionlake.llm import jaccard_join, line_dedup
from auctionlake.llm.common import connected_components

RNG = random.Random(11)
VOCABULARY = [f"w{k}" for k in range(400)]


def near_copies(n: int, length: int, edits: int):
    """One text and copies with single words changed, moved or missing."""
    base = [RNG.choice(VOCABULARY) for _ in range(length)]
    out = [" ".join(base)] * 3
    for _ in range(n):
        w = list(base)
        for _ in range(RNG.randint(0, edits)):
            w[RNG.randrange(len(w))] = RNG.choice(VOCABULARY)
        out.append(" ".join(w[: len(w) - RNG.randint(0, 2)]))
    return out


def brute_components(rows, n=3, percent=90):
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    sets = [frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []) for w in words]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in seen[g])
        for g in s:
            seen[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def test_jaccard_components_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = [t for length in (12, 40, 80, 150) for t in near_copies(25, length, 4)]
    rows += [(10_000 + k, t) for k, t in enumerate(texts)]
    rows += [(-1, None), (-2, ""), (-3, "a b"), (-4, "A  b\n"), (None, "a b"), (-5, "one"), (-6, "A b c D"), (-7, "a b c d"), (-7, "a b c d"), (-8, " \t ")]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (1, 60), (3, 100)])
def test_jaccard_other_settings(spark, n, percent):
    rows = list(enumerate(t for length in (15, 60) for t in near_copies(20, length, 5)))
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, n, percent)


def test_jaccard_empty_and_kept(spark):
    assert jaccard_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = spark.createDataFrame([(3, "a b c d", "x", 1), (1, "a b c d", "y", 2), (2, "other text here", "z", 3), (4, None, "n", 4)], "doc_id long, text string, node string, size int")
    assert sorted(r.node for r in jaccard_join.keep_one(d).collect()) == ["n", "y", "z"]


def test_jaccard_order_depends_on_the_shingle_alone():
    """A text and a copy of its end, far along a long slice: equal shingles have equal rarity."""
    rng = np.random.default_rng(4)
    weights = np.rint(np.log2(rng.integers(1, 10**9, 1 << jaccard_join.WORD_BITS)) * (1 << 20)).astype(np.int64)
    words = [f"v{k}" for k in rng.zipf(1.3, 300_000) % 50_000]
    long, end = " ".join(words), " ".join(words[-20_000:])
    found = list(jaccard_join.Shingles(3, weights).each([long, end, "x y", end, long]))
    rarity = dict(zip(found[0][0].tolist(), found[0][1].tolist(), strict=True))
    assert all(rarity[s] == r for f in (found[1], found[3], found[4]) for s, r in zip(f[0].tolist(), f[1].tolist(), strict=True))


def test_jaccard_finds_copies_of_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    words = [f"v{k}" for k in rng.integers(0, 200_000, 3_000_000)]
    copy = list(words)
    for k in range(0, len(copy), 100):
        copy[k] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(words[:1_000_000])), (4, "w" * 1_000_000 + " a b"), (5, "w" * 1_000_000 + " a b"), (6, "w" * 999_999 + " a b")]
    got = {r.doc_id: r.component_id for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_long_words_hash_by_their_bytes():
    words = ["a" * n for n in (1, 63, 64, 65, 66, 200)] + ["a" * 64 + "b", "é" * 50]
    h, _ = jaccard_join._word_hashes(" ".join(words + words[::-1]).encode())
    assert (h[: len(words)] == h[len(words) :][::-1]).all() and len({*h.tolist()}) == len(words)


@pytest.mark.parametrize("cell", [3, 7, 1000])
def test_a_common_key_is_compared_in_places_of_its_own(spark, cell):
    from pyspark.sql import functions as F

    nodes = [(k % 3, bytes([k]), 0, 5, bytes([k % 7])) for k in range(40)]
    known = spark.createDataFrame(nodes, "key long, node binary, pos long, size long, part binary").withColumn("pos", F.lit(0).cast("long"))
    got = {(bytes(r.a), bytes(r.b)) for r in jaccard_join._across(known, 80, cell).collect()}
    assert got == {(x[1], y[1]) for x in nodes for y in nodes if x[0] == y[0] and x[1] < y[1] and x[4] != y[4]}


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_shared_keys(rows):
    import pyarrow as pa

    from auctionlake.llm.common import _shared_runs

    rng = random.Random(rows)
    data = sorted(((rng.randrange(40), bytes([rng.randrange(4)]), rng.randrange(3)) for _ in range(120)), key=lambda r: r[0])
    nodes = defaultdict(set)
    for key, node, _ in data:
        nodes[key].add(node)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in data[at : at + rows]], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["key", "node", "tag"]) for at in range(0, len(data), rows)]
    got = [tuple(r.values()) for b in _shared_runs(iter(batches)) for r in b.to_pylist()]
    assert set(got) == {r for r in data if len(nodes[r[0]]) > 1}


def test_counted_join_with_hot_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from auctionlake.llm import common

    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), "id")
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    for least in (0, 2000):
        monkeypatch.setattr(common, "hot_keys", lambda c, n_col, total, least=least: c.filter((F.col(n_col) * 20 > total) & (F.col(n_col) > least)))
        got = common.join_counted(rows, counted, "k", "n", 9000)
        assert sorted(map(tuple, got.select("id", "k", "low").collect())) == sorted(map(tuple, rows.join(counted, "k").select("id", "k", "low").collect()))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(s: str, edits: int) -> str:
    t = list(s)
    for _ in range(edits):
        k = RNG.randrange(len(t))
        way = RNG.random()
        if way < 0.34:
            t[k] = RNG.choice("abcé😀")
        elif way < 0.67:
            t.insert(k, RNG.choice("abcé😀"))
        else:
            del t[k]
    return "".join(t)


@pytest.mark.parametrize("threshold", [1, 2, 3, 7])
def test_bit_parallel_distance(threshold):
    pairs = [(s, edited(s, RNG.randint(0, threshold + 2))) for s in ("".join(RNG.choice("abcé😀") for _ in range(RNG.randint(10, 70))) for _ in range(800))]
    assert line_dedup.within(pairs, threshold).tolist() == [distance(a, b) <= threshold for a, b in pairs]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_segments_find_every_near_pair(threshold):
    checked = 0
    for _ in range(1500):
        a = "".join(RNG.choice("ab") for _ in range(RNG.randint(8, 50)))
        b = edited(a, RNG.randint(0, threshold)).replace("é", "a").replace("😀", "b").replace("c", "a")
        short, long = sorted((a, b), key=len)
        if short == long or distance(a, b) > line_dedup.edits_for(len(short), threshold):
            continue
        checked += 1
        index = {(k, short[at : at + n]) for k, (at, n) in enumerate(line_dedup.segments(len(short), threshold))}
        assert any((k, long[at : at + n]) in index for less, k, at, n in line_dedup.probes(len(long), threshold) if less == len(long) - len(short))
    assert checked > 200


@pytest.mark.parametrize("threshold", [1, 2, 7])
def test_keys_are_equal_for_equal_segments_alone(threshold):
    """Wherever a line stands among others, its keys depend on the segment, its place and the shorter line's length."""
    lines = ["".join(RNG.choice("abé😀\ud800") for _ in range(RNG.randint(12, 100))) for _ in range(150)]
    lines += [edited(x, 1) for x in lines if len(x) > 12]
    found = {}
    for some in (lines, lines[::-1], lines[7:8]):
        rows, keys, roles, less, start, size = line_dedup._Keys(threshold).of(some)
        at = 0
        for row, line in enumerate(some):
            plan = line_dedup.probes(len(line), threshold)
            here = slice(at, at + len(plan))
            at += len(plan)
            assert (rows[here] == row).all() and list(zip(less[here].tolist(), start[here].tolist(), size[here].tolist(), strict=True)) == [(le, a, n) for le, _, a, n in plan]
            aligned = {(k, a) for k, (a, _) in enumerate(line_dedup.segments(len(line), threshold))}
            assert roles[here].tolist() == [2 if le else 3 if (k, a) in aligned else 1 for le, k, a, _ in plan]
            for key, (le, k, a, n) in zip(keys[here].tolist(), plan, strict=True):
                found.setdefault((len(line) - le, k, line[a : a + n]), set()).add(key)
        assert at == len(keys)
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == len(found)


@pytest.mark.parametrize("rows", [1, 3, 1000])
@pytest.mark.parametrize("cell", [1, 4, 512])
def test_shared_postings_match_brute_force(monkeypatch, rows, cell):
    """Postings of three tasks in cells: each whose key has two lines comes out, wherever a cell or a batch ends; no other does."""
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "CELL_POSTINGS", cell)
    rng = np.random.default_rng(rows)
    keys = rng.integers(0, 1 << 64, 150, np.uint64)
    keys[:60] = keys[0] + np.arange(60, dtype=np.uint64)  # many keys of one bucket
    tasks = []
    for _ in range(3):
        own = np.empty(200, line_dedup._POSTING)
        own["key"] = np.concatenate([keys[rng.integers(0, 150, 170)], np.full(30, keys[0])])
        own["node"] = rng.integers(0, 2, (200, 2))
        own["tag"] = rng.integers(0, 3, 200)
        tasks.append(own)
    nodes = defaultdict(set)
    postings = {(k, tuple(n), t) for own in tasks for k, n, t in zip(own["key"].tolist(), own["node"].tolist(), own["tag"].tolist(), strict=True)}
    for k, n, _ in postings:
        nodes[k].add(n)
    cells = pa.Table.from_batches([line_dedup._cells(own) for own in tasks]).sort_by("bucket")
    assert max(map(len, cells["postings"].to_pylist())) <= 32 * cell
    got = [r for b in line_dedup._shared_in_cells(iter(cells.combine_chunks().to_batches(max_chunksize=rows))) for r in b.to_pylist()]
    got = {(r["key"] % (1 << 64), tuple(np.frombuffer(r["node"], "<u8").tolist()), r["tag"]) for r in got}
    assert got == {p for p in postings if len(nodes[p[0]]) > 1} and got < postings


def test_texts_are_read_once_for_the_lines_that_are_compared(spark, monkeypatch):
    """Both rounds of comparisons, and the lines under crowded keys, take their lines from those kept under shared keys."""
    read, real = [], line_dedup._lines_of

    def noting(docs, text_col, nodes, min_chars):
        read.append(text_col)
        return real(docs, text_col, nodes, min_chars)

    monkeypatch.setattr(line_dedup, "_lines_of", noting)
    monkeypatch.setattr(line_dedup, "FEW", 20)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    lines = ["one beginning of these lines " + word(30) for _ in range(60)]
    lines += [edited(x, 1) for x in lines[:20]]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    found = {bytes(r.node): bytes(r.component) for r in connected_components(line_dedup.near_lines(docs)).collect()}
    by_class = defaultdict(list)
    for line in set(lines):
        by_class[found.get(line_dedup.line_hash(line), line)].append(line)
    assert {x: min(g) for g in by_class.values() for x in g} == line_components(lines)
    assert len(read) > 2 and read.count("text") == 1


def line_components(lines, threshold=2):
    """Each different line with the least line that near ones lead to, pair by pair."""
    present = sorted(set(lines), key=len)
    parent = {x: x for x in present}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    letters = {x: Counter(x) for x in present}
    for i, a in enumerate(present):
        edits = min(threshold, len(a) // 12)
        for b in present[i + 1 :] if edits else []:
            if len(b) - len(a) > edits:
                break
            if sum(abs(letters[a][c] - letters[b][c]) for c in {*letters[a], *letters[b]}) <= 2 * edits and root(a) != root(b) and distance(a, b) <= edits:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in present:
        groups[root(x)].append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("threshold", [1, 2])
def test_near_lines_match_brute_force(spark, threshold):
    bases = ["".join(RNG.choice("abcdefgh é") for _ in range(RNG.randint(4, 60))).strip() or "x" for _ in range(40)]
    lines = bases + [edited(RNG.choice(bases), RNG.randint(0, 4)) for _ in range(400)]
    docs = [(k, "\n".join(RNG.sample(lines, 6))) for k in range(100)]
    present = sorted({x for _, t in docs for x in t.split("\n") if x.strip()})
    by_hash = {line_dedup.line_hash(x): x for x in present}
    got = line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold).collect()
    pairs = [(by_hash[bytes(r.a)], by_hash[bytes(r.b)]) for r in got]
    assert pairs and len({frozenset(p) for p in pairs}) == len(pairs)
    assert all(a != b and distance(a, b) <= min(threshold, min(len(a), len(b)) // 12) for a, b in pairs)
    parent = {x: x for x in present}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in present:
        groups[root(x)].append(x)
    assert {x: min(g) for g in groups.values() for x in g} == line_components(present, threshold)


def test_many_variants_of_a_line_give_links_in_proportion(spark):
    base = "the same words stand in each of these many lines but for one letter"
    lines = sorted({base[:k] + c + base[k + 1 :] for k in range(len(base)) for c in "xyzq"})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.near_lines(docs).count() < 6 * len(lines)
    assert line_dedup.line_classes(docs).select("class").distinct().count() == 1


@pytest.mark.parametrize("few", [0, 40])
def test_crowded_keys_lose_no_link(spark, monkeypatch, few):
    """Lines that share beginnings, ends or middles, some of them near: links join the same classes whatever counts as crowded."""
    rng = random.Random(few)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    lines = []
    for left, right in ((25, 0), (0, 25), (20, 20), (30, 8), (8, 4)):
        a, b = word(left), word(right)
        for _ in range(40):
            line = a + word(rng.choice((12, 13, 26, 40))) + b
            lines += [line, *(edited(line, rng.randint(1, 2)) for _ in range(rng.randrange(3)))]
    lines += [f"{word(3)} 2026-01-{d:02d} connection from host number {k} closed" for d in range(9) for k in range(9)]
    lines = sorted(set(lines))
    monkeypatch.setattr(line_dedup, "FEW", few)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    links = line_dedup.near_lines(docs)
    found = {bytes(r.node): bytes(r.component) for r in connected_components(links).collect()}
    by_class = defaultdict(list)
    for line in lines:
        by_class[found.get(line_dedup.line_hash(line), line)].append(line)
    assert {x: min(g) for g in by_class.values() for x in g} == line_components(lines)


def test_a_common_beginning_costs_in_proportion(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    monkeypatch.setattr(line_dedup, "FEW", 100)
    compared, real = {}, line_dedup._verified

    def counting(docs, text_col, threshold, min_chars, pairs):
        compared.setdefault(n, []).append(pairs.count())
        return real(docs, text_col, threshold, min_chars, pairs)

    monkeypatch.setattr(line_dedup, "_verified", counting)
    head = "2026-03-01T00:00:00 INFO  "
    for n in (1000, 4000):
        lines = [head + word(50) for _ in range(n)]
        lines += [edited(x, 2) for x in lines[:20]]
        docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
        assert line_dedup.near_lines(docs).count() >= 20
    assert sum(compared[4000]) < 5 * sum(compared[1000]) and sum(compared[4000]) < 20_000


def test_dropped_lines(spark):
    line = "this line stands in many of the documents"
    near = "this line stands in many of the document!"
    own = "something that only this document says at all"
    rows = [(2, f"{line}\n{own} 2\nshort\nshort\n \n", "x", 1), (1, f"{near}\n{line}\nshort\n \n", "y", 2), (3, line, "z", 3), (None, f"{line}\n{own} and more\nshirt", "n", 4), (4, None, "null", 5), (5, "", "empty", 6), (2, f"{line}\nagain but otherwise another text", "x2", 7), (6, "y" * 30_000 + "\n" + "y" * 30_000, "long", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, found string, line int")
    for d in (d, d.withColumnsRenamed({"line": "r_"}), d.withColumnsRenamed({"line": "row", "doc_id": "id"}).withColumnRenamed("id", "doc_id")):
        got = {r.found: r for r in line_dedup.drop_repeated_lines(d).collect()}
        assert got["y"].text == f"{near}\nshort\n \n" and got["y"].n_dropped == 1
        assert got["x"].text == f"{own} 2\n \n" and got["x"].n_lines == 6 and got["x"].n_dropped == 3
        assert got["z"].text == "" and got["n"].text == f"{own} and more\nshirt" and got["x2"].text == "again but otherwise another text"
        assert got["null"].text is None and got["null"].n_lines == 0 and got["empty"].text == ""
        assert got["long"].text == "y" * 30_000
        assert line_dedup.drop_repeated_lines(d.limit(0)).count() == 0
    assert {r.found: r.text for r in line_dedup.drop_repeated_lines(d, min_chars=24).collect()}["x"] == f"{own} 2\nshort\nshort\n \n"
    taken = d.withColumnRenamed("row", "N_LINES")
    with pytest.raises(ValueError, match="exist already"):
        line_dedup.drop_repeated_lines(taken)
    assert "gone" in line_dedup.drop_repeated_lines(taken, counts=("all", "gone")).columns


def test_components_of_a_long_path(spark):
    edges = [(bytes([k // 200, k % 200]), bytes([(k + 1) // 200, (k + 1) % 200])) for k in range(300) if k % 50]
    got = {bytes(r.node): bytes(r.component) for r in connected_components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(got[bytes([k // 200, k % 200])] == bytes([(k - (k - 1) % 50) // 200, (k - (k - 1) % 50) % 200]) for k in range(1, 300) if k % 50)
    assert connected_components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_letter_counts_never_rule_out_a_near_pair():
    for _ in range(500):
        a = "".join(RNG.choice("abcdefghé😀") for _ in range(40))
        b = edited(a, 2)
        x, y = line_dedup._letter_counts([a, b]).tolist()
        total = 0
        for k in range(15):
            d = ((x >> 4 * k & 15) - (y >> 4 * k & 15)) % 16
            total += min(d, 16 - d)
        assert total <= 4
    assert (line_dedup._letter_counts(["a"]) < np.int64(1) << 60).all()
