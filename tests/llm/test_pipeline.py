"""The pipeline against its stages written out plainly."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from test_dedup import brute_components, line_components

from auctionlake.llm import byte_bpe, quality_rules, vocab
from auctionlake.llm.common import table

DATA = "/root/testdata/sf0.001"


def brute_lines(rows):
    """Lines that are not blank: of each class of near equal ones the first of the smallest id stays."""
    low = line_components([x for _, t in rows for x in (t or "").split("\n") if x.strip()])
    least = {}
    for k, t in rows:
        for x in (t or "").split("\n"):
            if x in low:
                least[low[x]] = min(k, least.get(low[x], k))
    out = []
    for k, t in rows:
        used, kept = set(), []
        for x in (t or "").split("\n"):
            if x not in low:
                kept.append(x)
            elif least[low[x]] == k and low[x] not in used:
                used.add(low[x])
                kept.append(x)
        text = "\n".join(kept)
        if text == (t or "") or text.strip():
            out.append((k, text))
    return out


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    kept = {r.doc_id for r in quality_rules.apply_rules(docs).collect() if r.kept}
    rows = brute_lines([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept])
    first = {k for k, _, low in brute_components(rows, 5, 80) if k == low}
    rows = [(k, t) for k, t in rows if k in first]
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())
    windows = {tuple(w[k : k + 10]) for r in table(spark, DATA, "benchmark").collect() for w in [find(r.text)] for k in range(len(w) - 9)}
    rows = [(k, t) for k, t in rows if not any(tuple(w[j : j + 10]) in windows for w in [find(t)] for j in range(len(w) - 9))]
    encode = vocab.encoding(byte_bpe.RANKS).encode_ordinary
    expected = sorted((k, len(t.encode()), encode(t)) for k, t in rows)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == expected and got


def test_stages_keep_columns(spark):
    docs = table(spark, DATA, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    """Each stage on rows with nulls in every column, repeated rows and columns named as its own inner ones; columns and clean rows stay."""
    from pyspark.sql import functions as F

    docs = table(spark, DATA, "documents").limit(60)
    clash = {"row": F.lit(1), "node": F.lit("n"), "key": F.lit(None).cast("string"), "n_words": F.lit(2), "hit_spans": F.lit("h"), "N_LINES": F.lit(3), "part": F.lit(4), "g": F.lit(5), "tag": F.lit(6), "value": F.lit("v"), "block": F.lit(7), "text_key": F.lit(8), "component_id": F.lit(9), "kept": F.lit(True)}
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (-5, None, "en", None, None), (-6, "same line of some length here\nsame line of some length here", None, None, 59)] * 2, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    d = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd).withColumns(clash)
    whole = sorted(map(str, (tuple(r) for r in d.collect())))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, DATA)
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema], name
        rows = sorted(map(str, (tuple(r) for r in out.collect())))
        assert rows, name
        if name != "line_dedup":  # the only stage that changes a row
            assert not Counter(rows) - Counter(whole), name
        if name in ("jaccard_join", "decontamination", "line_dedup"):
            empty = [r for r in out.collect() if not r.text]
            assert len(empty) == 6, name  # null and empty texts stay, repeats too
    tokens = corpus_pipeline.STAGES[-1][1](spark, d, DATA)
    assert tokens.count() == d.count() and sum(len(r.ids) == 0 for r in tokens.collect()) == 6
