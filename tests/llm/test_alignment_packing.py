"""Packing and alignment against plain versions on the test documents and hard texts."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auctionlake.llm import alignment, packing, vocab

CASES = [
    (-1, None), (-2, ""), (-3, "a\x1cb\x85c  d<|endoftext|> x<|endoftext|>"), (None, "  \n\n x"), (-4, " 　  ​foo"), (-4, "😀 é ñ 中文 漢字 1234½Ⅷ"), (-5, "same"), (-5, "same"),
    (-6, "x" * 50_000), (-7, "ab " * 9_000), (-8, "a\x00b"), (-9, "has ▁ in it"), (-10, "<s> </s> <unk> <0x41> [INST]"), (-11, " "), (-12, "\n"), (-13, "ǆ ﬁ ² Å é"), (-14, "tail   "), (-15, "﻿bom    z"),
]


def with_cases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.union(spark.createDataFrame(CASES, "doc_id long, text string"))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def library(special_as_text: bool):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = special_as_text
    return t


# --- packing ---------------------------------------------------------------------------------------


def ids_by_id(docs):
    t = library(False)
    out = defaultdict(list)
    for r in docs.collect():
        out[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 0])
    return out


@pytest.mark.parametrize("length,most_open", [(1024, packing.MOST_OPEN), (64, 5)])
def test_pieces_are_the_documents_and_sequences_have_no_gap(spark, sf_dir, length, most_open):
    docs = with_cases(spark, sf_dir).repartition(3)
    rows = packing.pack(docs, length=length, most_open=most_open).collect()
    expected = ids_by_id(docs)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for key, whole in expected.items():
        assert sorted(i for ids in whole for i in ids) == sorted(i for r in pieces[key] for i in r.ids)
        assert sum(r.start == 0 for r in pieces[key]) == len(whole)
        if len(whole) == 1:
            assert [i for r in sorted(pieces[key], key=lambda r: r.start) for i in r.ids] == whole[0] and {r.doc_tokens for r in pieces[key]} == {len(whole[0])}
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0


def test_each_document_goes_to_the_level_with_the_least_sum_of_squares():
    rng = random.Random(2)
    levels, open_windows = packing.Levels(16), []
    for k in range(400):
        size = rng.randint(1, 15)
        fills = Counter(open_windows)

        def squares(level, fills=fills, size=size):
            after = fills.copy()
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            return sum(n * n for n in after.values())

        choices = [0, *(h for h in fills if fills[h] and h + size <= 16)]
        level = levels.level_for(size)
        assert squares(level) == min(map(squares, choices)) and level == max(h for h in choices if squares(h) == squares(level))
        if level:
            open_windows.remove(level)
        if level + size < 16:
            open_windows.append(level + size)
        full = levels.place((k, 0, np.zeros(size, np.uint32), size))
        assert (full is not None) == (level + size == 16)
    assert Counter(open_windows) == {h: n for h, n in enumerate(levels.counts.tolist()) if n}


def test_documents_within_a_window_are_rarely_cut(spark, sf_dir):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("doc_id", "doc_tokens").count().collect()
    short = [r for r in rows if r.doc_tokens <= 1024]
    assert sum(r["count"] > 1 for r in short) < 0.2 * len(short)


# --- alignment -------------------------------------------------------------------------------------


def plain_links(rows):
    """The contract word by word: tokens by the libraries, links by comparing every pair of ranges nearby."""
    import sentencepiece

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        entries = {v: k for k, v in json.load(f)["model"]["vocab"].items()}
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    a_lib, b_lib = library(True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    found = []
    for key, text in rows:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_raw, b_raw = [bytes(chars[c] for c in entries[i]) for i in a], [b_bytes(i) for i in b]
        if b"".join(a_raw) != (" " + (text or "")).encode() or b"".join(b_raw) != (" " + (text or "")).encode():
            found.append((key, [], [], [], []))
            continue
        a_at, b_at, links, j = spans(a_raw), spans(b_raw), [], 0
        for i, (lo, hi) in enumerate(a_at):
            while b_at[j][1] <= lo:
                j += 1
            k = j
            while k < len(b_at) and b_at[k][0] < hi:
                links.append((a[i], b[k]))
                k += 1
        cuts, groups, x, y = sorted({e for _, e in a_at} & {e for _, e in b_at}), [], 0, 0
        for cut in cuts:
            p, q = x, y
            while x < len(a) and a_at[x][1] <= cut:
                x += 1
            while y < len(b) and b_at[y][1] <= cut:
                y += 1
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
        found.append((key, a, b, groups, links))
    n = Counter(pair for *_, links in found for pair in set(links))
    top = defaultdict(int)
    for (i, _), times in n.items():
        top[i] = max(top[i], times)
    return [
        (key, len(a), len(b), len(groups), len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for key, a, b, groups, links in found
    ]


@pytest.mark.parametrize("block_bytes", [5_000, alignment.BLOCK_BYTES])
def test_links_as_the_plain_version(spark, sf_dir, block_bytes, monkeypatch):
    if block_bytes == 5_000:
        monkeypatch.setattr(alignment, "SHARE", 20_000)  # many ids count as hot
    docs = with_cases(spark, sf_dir)
    got = rows_of(alignment.token_links(docs.repartition(3), block_bytes=block_bytes))
    assert got == sorted(map(str, plain_links([(r.doc_id, r.text) for r in docs.collect()])))


def test_small_bounds_of_memory(spark, sf_dir, monkeypatch):
    docs = with_cases(spark, sf_dir)
    expected = rows_of(alignment.token_links(docs))
    for name, value in (("SLICE_BYTES", 3_000), ("BLOCK_DOCS", 40), ("HELD", 100), ("BATCH_BYTES", 10_000)):
        monkeypatch.setattr(alignment, name, value)
    assert rows_of(alignment.token_links(docs)) == expected
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, block int, a string, place int, sequence_id int")
    assert alignment.token_links(none).count() == 0 and packing.pack(none).count() == 0
    some = spark.createDataFrame([(1, "a b", 3, "x", 5, 6), (1, None, 3, "x", 5, 6)], none.schema)
    assert sorted((r.n_a, r.n_links, r.groups_sha256 == "") for r in alignment.token_links(some).collect()) == [(0, 0, True), (2, 2, False)]
    assert sorted(r.length for r in packing.pack(some).collect()) == [1, 2] or packing.pack(some).agg({"length": "sum"}).first()[0] == 4


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ranks_give_what_the_tokenizer_gives(text):
    text = text.encode("utf-8", "ignore").decode()
    assert vocab.encoding(packing.RANKS).encode_ordinary(" " + text) == library_as_text.encode(" " + text, add_special_tokens=False).ids
    special = vocab.encoding(packing.RANKS, tuple(packing.SPECIAL.items()))
    text = text.replace("0", "<|endoftext|>")
    assert special.encode(text, allowed_special="all") == library_default.encode(text, add_special_tokens=False).ids


library_as_text, library_default = library(True), library(False)
