"""The manifest against a plain tree, for rows in one partition and in many."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from auctionlake.llm import merkle


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(leaves):
    """Root, and for each leaf its siblings level by level."""
    level, proofs, where = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(where):
            first = at - at % 3
            proofs[k] += [level[j] for j in range(first, min(first + 3, len(level))) if j != at]
            where[k] = at // 3
        level = [hexed(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], proofs


def plain(rows):
    def leaf(row):
        return hexed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = grown([leaf(r) for r in groups[name]])
    root, upper = grown([trees[n][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for row, proof in zip(groups[name], trees[name][1], strict=True):
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            changed = even and row[4] is not None and "\n" in row[4]
            out.append((row[0], leaf(row), trees[name][0], root, hexed(*proof, *upper[k]), not changed))
    return out


def check(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(partitions)
    got = merkle.manifest(docs, presented={"text": merkle.without_line_ends()}).collect()
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified)) for r in got) == sorted(map(str, plain(rows)))
    assert all((r.folded_root == r.root) == r.verified for r in got)
    return got


def some_rows(n, seed=1, sources=("a", "b", "é", "Z", None, "hot", "hot", "hot", "hot")):
    rng = random.Random(seed)
    return [(rng.randrange(10 * n), rng.choice(sources), rng.choice(["en", None]), rng.choice([None, k]), rng.choice([None, "", "one\ntwo", f"text {k}\n\n", "ü" * 300, "plain"])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28, 82, 700])
def test_as_the_plain_tree(spark, n):
    check(spark, some_rows(n))


@pytest.mark.parametrize("rows,levels,n,sources", [(7, 1, 300, None), (30, 2, 900, None), (1, 5, 60, None), (50, 3, 1500, ("one",)), (40, 5, 400, [f"s{k}" for k in range(300)])])
def test_rows_over_many_partitions(spark, monkeypatch, rows, levels, n, sources):
    monkeypatch.setattr(merkle, "PARTITION_ROWS", rows)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    check(spark, some_rows(n, 2, *([sources] if sources else [])))


def test_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PARTITION_ROWS", 8)
    check(spark, [(5, "s", "en", 3, "same\nrow")] * 40 + [(None, "s", "en", 3, "x\n")] * 5 + [(5, "s", "en", 3, f"other {k}") for k in range(9)])


def test_empty_table_and_clashing_columns(spark):
    names = "doc_id long, source string, lang string, n_chars int, text string, g int, n int, level int, row int, digest int, root int"
    none = spark.createDataFrame([], names)
    assert merkle.manifest(none).count() == 0
    some = spark.createDataFrame([(1, "s", "en", 2, "t", 1, 2, 3, 4, 5, 6), (2, "s", "en", 2, "t", 1, 2, 3, 4, 5, 6)], names)
    assert [r.verified for r in merkle.manifest(some).collect()] == [True, True]


def test_a_changed_digest_does_not_verify(spark):
    got = check(spark, some_rows(60))
    assert {r.verified for r in got} == {True, False}
