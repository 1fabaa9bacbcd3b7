"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
from test_dedup import brute_components

from auctionlake.llm import html_extract, jaccard_join, quality_rules, sharding


def scattered(seed: int, length: int, edits: int, groups: int):
    """Pairs of a text and its copy with single words replaced at even distances."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10_000)}" for _ in range(length)]
        copy = list(base)
        for k in range(edits):
            copy[(2 * k + 1) * length // (2 * edits)] = f"new{g}x{k}"
        out += [" ".join(base), " ".join(copy)]
    return out


def test_pipeline_drops_copies_with_scattered_edits(spark):
    rows = list(enumerate(scattered(1, 200, 4, 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == sorted(k for k, _, low in brute_components(rows, 5, 80) if k == low) == list(range(0, 40, 2))


def test_sharding_where_every_text_has_a_copy(spark):
    rows = [(k, f"text {k // 2}") for k in range(1600)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [200] * 8
    pairs = defaultdict(set)
    for r in got:
        pairs[r.doc_id // 2].add(r.shard)
    assert sum(len(p) > 1 for p in pairs.values()) == 0


def test_sharding_exchanges_nodes_of_several_groups(spark):
    """Every node has two groups, so whole groups can't just be dealt; shards have no room."""
    links = [(k, k // 4) for k in range(64)] + [(k, 100 + (k // 4 if k % 4 else (k // 4 + 8) % 16)) for k in range(64)]
    got = {r.node: r.shard for r in sharding.propagate(spark.createDataFrame(links, "node long, hub long"), [16] * 4).collect()}
    assert sorted(Counter(got.values()).values()) == [16] * 4 and len(got) == 64
    assert sharding._allowed({(0, 1): 5, (1, 0): 3, (2, 1): 4}, [0, 1, 0], True) == [0, 4, 0, 3, 0, 0, 0, 0, 0]


def test_rounds_bring_groups_together(spark):
    """From where hashes put them, groups of two to four come together in the first round; the cut falls to nothing."""
    links = spark.createDataFrame([(k, 7919 * (k // (2 + (k // 600) % 3))) for k in range(1800)], "node long, hub long")
    apart = lambda state: sharding.cut_links(state, links).agg({"outside": "sum"}).first()[0]
    history = []
    quotas = [400] * 8
    before = apart(sharding._start(links, quotas))
    state = sharding.propagate(links, quotas, history)
    assert before > 600 and apart(state) == 0
    assert history[0]["moved"] == 0 and history[1]["moved"] > 600 and len(history) <= 4
    assert [h["together"] for h in history] == sorted({h["together"] for h in history})


def test_copies_of_junk_do_not_set_the_limits(spark):
    rng = random.Random(3)
    words = "the of and to in is that for it was on are with they be at this have from or had by word but what some we can out other were all there when up use your how said an each she".split()
    clean = [" ".join(rng.choice(words) for _ in range(rng.randint(130, 230))) for _ in range(60)]
    alone = " ".join(rng.choice(words) for _ in range(3000))  # the only clean text of its length, beside two copies of junk
    junk, long_junk = (" ".join("".join(rng.choice("#*$%&|qxzjkvw0189") for _ in range(9)) for _ in range(n)) for n in (30, 600))
    rows = [*((k, t) for k, t in enumerate(clean)), *((1000 + k, junk) for k in range(200)), (2000, alone), (3000, long_junk), (3001, long_junk)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    judged = quality_rules.apply_rules(docs).collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert kept == {*range(60), 2000}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept


def test_recurring_block_inside_the_main_element_goes(spark):
    page = '<body><article><h1>Title {0}</h1><div class="x7f3">Buy our <b>gold</b> plan<p>Only today</p></div><p>Story {0} is told.</p></article></body>'
    rows = [(k, "http://a.com/x", page.format(k)) for k in range(6)]
    rows += [(100 + k, f"http://big.com/{k}", page.format(k) if k < 6 else f"<main><p>Other story {k}</p></main>") for k in range(200)]  # 3 % of a host
    rows += [(500 + k, "http://copies.com/", page.format("same")) for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[at + k] == f"Title {k}\nStory {k} is told." for at in (0, 100) for k in range(6))
    assert all(got[100 + k] == f"Other story {k}" for k in range(6, 200))
    assert {got[500 + k] for k in range(8)} == {"Title same\nBuy our gold plan\nOnly today\nStory same is told."}


def test_a_repeated_id_keeps_its_other_text(spark):
    a, b, c = "one two three four five", "other words that stand nowhere else", "some more words in a row"
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c), (11, c), (11, None), (None, a)]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(3, a), (7, b), (9, c), (9, c), (11, None), (None, a)]))
