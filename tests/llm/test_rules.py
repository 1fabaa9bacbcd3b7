from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from auctionlake.llm import chat_format, decontaminate, html_extract, importance, quality_rules, sharding
from auctionlake.llm.common import table
from auctionlake.llm.oracles import ORACLES
from auctionlake.llm.queries import QUERIES

EXTRA = [(-1, None, "en"), (-2, "", None), (-3, "a b", "xx"), (-4, "a b", "xx"), (None, "A  B\n", "xx"), (-5, "one two\n" * 3000, "en"), (-5, "é" * 20_000, "fr")]


def with_extra(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.union(spark.createDataFrame(EXTRA, "doc_id long, text string, lang string"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_quality_counts(spark, sf_dir):
    docs = with_extra(spark, sf_dir)
    expected = []
    for r in docs.collect():
        s = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", s)
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        covered = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(8)}
        seen, again = set(), 0
        for line in s.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        expected.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = quality_rules.apply_rules(docs).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(tuple(r[c] for c in columns)) for r in got)) == sorted(map(str, expected))
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    judged = quality_rules.apply_rules(docs)
    assert judged.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    fair = [r for r in judged.join(labels, "doc_id").collect() if not r.base_failed]
    good, junk = ([r.kept for r in fair if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.1 * len(junk)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == judged.filter("kept").count()


def plain_verdicts(rows):
    """rows: (id, text, lang). The bands written out plainly."""
    import math

    def middle(values):
        return sorted(values)[(len(values) - 1) // 2]

    measured, seen, classes = [], set(), defaultdict(lambda: defaultdict(list))
    for key, text, lang in rows:
        text = text or ""
        w = quality_rules.ascii_words(text)
        n, per, bits, _, share = quality_rules.fertility(text, w)
        failed = len(w) < 20 or 100 * quality_rules.repeated_words(w) > 30 * len(w)
        band = f"language {lang}" if lang is not None else f"script {quality_rules.script_of(text)}"
        cls = math.floor(2 * math.log2(max(n, 1)))
        figures = {"chars_per_token": per, "token_entropy": bits, "byte_share": share}
        measured.append((key, failed, band, cls, figures))
        if not failed and n and (band, text) not in seen:
            seen.add((band, text))
            classes[band][cls].append(figures)
    out = []
    for key, failed, band, cls, figures in measured:
        kept = not failed
        if kept:
            by_distance = defaultdict(list)
            for c, members in classes[band].items():
                by_distance[abs(c - cls)] += members
            pool = []
            for far in sorted(by_distance):
                if len(pool) < quality_rules.MIN_TEXTS:
                    pool += by_distance[far]
            for name, least in quality_rules.LEAST.items():
                steps = [math.floor(f[name] * 250) for f in pool]
                mid = middle(steps)
                away = middle([abs(x - mid) for x in steps])
                dev = 4.5 * max(1.4826 * away / 250, least if name == "byte_share" else least * mid / 250)
                kept = kept and mid / 250 - dev <= figures[name] <= mid / 250 + dev
        out.append((key, failed, kept))
    return sorted(map(str, out))


def test_quality_verdicts_match_plain_ones(spark):
    docs = with_extra(spark, "/root/testdata/sf0.01").withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    expected = plain_verdicts([tuple(r) for r in docs.collect()])
    assert sorted(str(tuple(r)) for r in quality_rules.apply_rules(docs).select("doc_id", "base_failed", "kept").collect()) == expected
    assert any("False, False" in x for x in expected)


def test_quality_takes_any_columns(spark):
    rows = [(k, " ".join(f"word{j * k % 50}" for j in range(200)), None, k, k) for k in range(5)] + [(7, None, None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, class int")
    for names in (("n_words", "class"), ("l_", "c_"), ("band", "byte_share_low"), ("kept", "text_key"), ("c0", "c2")):
        named = d.toDF("doc_id", "text", "lang", *names)
        got = quality_rules.keep_good(named)
        assert got.columns == named.columns and all(r[3] == r[0] for r in got.collect())
        assert quality_rules.apply_rules(named).count() == 6
    assert quality_rules.keep_good(d.limit(0)).count() == 0


def test_quality_fertility_figures():
    import math

    import sentencepiece

    from auctionlake.llm import vocab

    text = "Ceci est un texte, 中文 and more ᚠᛇᚻ text text text."
    n, per, bits, pieces, fallback = quality_rules.fertility(text, quality_rules.ascii_words(text))
    ids = vocab.encoding(quality_rules.VOCABULARY).encode_ordinary(text)
    share = Counter(ids)
    model = sentencepiece.SentencePieceProcessor(model_file=vocab.path(quality_rules.FALLBACK_VOCABULARY))
    found = [p for w in text.split() for p in model.encode(w, out_type=str)]
    assert n == len(ids) and per == pytest.approx(len(text) / len(ids)) and pieces == len(found)
    assert bits == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in share.values()))
    assert fallback == pytest.approx(sum(bool(re.fullmatch("<0x..>", x)) for x in found) / len(found)) and fallback > 0
    assert quality_rules.fertility("", []) == (0, None, None, 0, None)
    assert [quality_rules.script_of(t) for t in ("ab é", "привет a", "中文", "12", "")] == ["LATIN", "CYRILLIC", "CJK", "", ""]


def brute_hits(docs, items, window=10):
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = find(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(item)
    out = []
    for key, text in docs:
        w = find(text)
        hit, who = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    who |= windows[tuple(w[k : k + m])]
        out.append((key, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


@pytest.mark.parametrize("pass_chars", [decontaminate.PASS_CHARS, 500])
def test_contamination(spark, sf_dir, pass_chars):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    items += [(1000, "Zwei Wörter"), (1001, "ein"), (1002, None), (1003, "--"), (1004, "aa aa aa aa aa aa aa aa aa aa aa"), (None, "null item id here")]
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").limit(120).collect()]
    docs += [(-1, None), (-2, ""), (-3, "ZWEI wörter; und EIN Wort"), (-4, "aa " * 40), (-5, f"x {items[0][1].upper()} y"), (-5, "null ITEM id-here"), (None, "ein ein")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit(1))
    found = decontaminate.find_occurrences(d, spark.createDataFrame(items, "item_id long, text string"), pass_chars=pass_chars)
    clean = decontaminate.remove_contaminated(d.withColumnsRenamed({"start": "n_words"}).withColumns({"row": F.lit(1), "hit_spans": F.lit(2)}), spark.createDataFrame(items, "item_id long, text string"), pass_chars=pass_chars)
    assert clean.columns == ["doc_id", "text", "n_words", "row", "hit_spans"] and clean.count() == found.filter(F.size("hit_spans") == 0).count()
    got = [tuple(r) for r in decontaminate.report(found).collect()]
    expected = brute_hits(docs, [i for i in items if i[0] is not None] + [(None, "null item id here")])
    drop = lambda rows: sorted(r for r in rows if "-5" not in r)  # noqa: E731  a null item has no place in a digest
    assert drop(map(str, got)) == drop(expected)
    assert {r[0] for r in got if r[5]} >= {-3, -4, -5, None}


def test_contamination_without_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(decontaminate.find_occurrences(docs, none)).first().contaminated is False
    assert decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, "b")], "item_id long, text string")).count() == 0
    assert decontaminate.remove_contaminated(docs.limit(0), none).columns == docs.columns


MARKS = ["<|im_start|>", "<|im_end|>"]
CLASHES = ["<|im_end|><|im_start|>assistant ok", "a <|im_end|> b", "a <|im_start|> b", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "x<\\|im_end|>", "<\\\\|", "<|im_end|>\n<|im_end|>\n"]
HARMLESS = ["<|im_end", "|im_end|> <", "|>", "<|im_start|", "<", "<|", "%25", "\n\n", "<|im_end\\|>", "$1 \\ <", "é😀" * 20_000, ""]


def chats(spark, sf_dir):
    rows = [(-10 - k, turn, role, text) for k, text in enumerate(CLASHES + HARMLESS) for turn, role in ((0, "user"), (1, "assistant"))]
    rows += [(-100 - k, 0, role, "said") for k, role in enumerate(["a\nb%25", "<|im_end|>", "<|im_start|>", "<|im_start|>user\nx<|im_end|>\n", "%0A", "%", "assistant\n", "<\\|", ""])]
    rows += [(-2, 0, "assistant", None), (-2, None, None, "x"), (None, 1, "user", "q"), (-4, 0, "assistant", "\n\n"), (-4, 0, "assistant", "\n\n")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def plain_reader(formatted):
    """Reads character by character what stands between marks, as a reader of the format would."""
    at, turns = 0, []
    while at < len(formatted):
        assert formatted.startswith("<|im_start|>", at)
        line = formatted.index("\n", at)
        end = formatted.index("<|im_end|>", at)
        assert end > line and formatted[end + 10] == "\n"
        turns.append((formatted[at + 12 : line], formatted[line + 1 : end]))
        at = end + 11
    return turns


def test_chat_round_trip(spark, sf_dir):
    d = chats(spark, sf_dir)
    turns = defaultdict(list)
    for r in d.collect():
        turns[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    formatted = chat_format.format_conversations(d)
    got = {r.conv_id: r for r in formatted.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert got.keys() == turns.keys()
    for key, source in turns.items():
        expected = [(a, b) for *_, a, b in sorted(source)]
        r = got[key]
        assert [tuple(t) for t in r.turns] == expected and r.exact and r.n_turns == len(expected)
        assert "".join(s.text for s in r.segments) == r.formatted
        read = plain_reader(r.formatted)
        assert len(read) == len(expected) and not any(m in x for pair in read for x in pair for m in MARKS)
        assert [t for (a, _), (_, t) in zip(expected, read, strict=True) if a == "assistant"] == [s.text for s in r.segments if s.loss]
        said = "".join(b for a, b in expected if a == "assistant")
        assert (digests[key].loss_chars, digests[key].loss_sha256) == (len(said), sha(said))
        assert digests[key].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in expected)) and digests[key].formatted_chars == len(r.formatted)
    assert [got[-10 - k].escapes for k in range(len(CLASHES))] == [2] * len(CLASHES)
    assert not any(got[-10 - len(CLASHES) - k].escapes for k in range(len(HARMLESS)))
    assert chat_format.format_conversations(d.limit(0)).count() == 0


def test_chat_sql_agrees_on_clashing_texts(spark, sf_dir, tmp_path):
    import shutil

    for f in ("documents", "benchmark"):
        shutil.copy(f"{sf_dir}/{f}.parquet", tmp_path)
    con = duckdb.connect()
    chats(spark, sf_dir).filter("conv_id IS NOT NULL AND turn IS NOT NULL").toPandas().to_parquet(tmp_path / "conversations.parquet")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    expected = {r[0]: r for r in con.execute(ORACLES["op6_chat_format"]).fetchall()}
    got = {r[0]: tuple(r) for r in QUERIES["op6_chat_format"](spark, str(tmp_path)).collect()}
    assert got == expected


def test_chat_parser_takes_only_the_grammar(spark):
    good, bad = ["", "<|im_start|>a\nb<|im_end|>\n"], ["x", "<|im_start|>a\nb<|im_end|>", "<|im_start|>a<|im_end|>\n", "<|im_start|>a\nb<|im_end|>\nc", "x<|im_start|>a\nb<|im_end|>\n", "<|im_start|>a\nb<|im_end|> c<|im_end|>\n"]
    d = spark.createDataFrame([(x,) for x in good + bad], "s string").select("s", chat_format.parse(F.col("s")).alias("t")).collect()
    assert {r.s for r in d if all(t.role is not None for t in r.t)} == set(good)


def test_native_plans_have_no_python(spark, sf_dir):
    for name in ("op4_sharding", "op6_chat_format"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_page_text(spark, data):
    import html

    pages = table(spark, data, "pages")
    expected = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1|br|b)>", body))
        expected[r.page_id] = "\n".join(x for x in blocks if x)
    got = {r.page_id: r for r in html_extract.extract_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == expected
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_page_text_by_counts_alone(spark):
    """Elements and names that say nothing: on hosts with enough pages the counts find the same text, without them much stays."""
    import html

    pages = table(spark, "/root/testdata/sf0.1", "pages")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"<(/?)nav>", r"<$1div>"), r"<footer>", r'<div class="q1">'), r"</footer>", "</div>")
    plain = F.regexp_replace(F.regexp_replace(plain, 'class="ad"', 'id="z9"'), r"<div><ul>", '<div class="k3"><ul>')
    d = pages.withColumn("html", plain).withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    large = {r.host for r in d.groupBy("host").agg(F.count_distinct("html").alias("n")).filter("n >= 60").collect()}
    body = {r.page_id: (r.host, re.search(r"<article>(.*)</article>", r.html, re.S)[1]) for r in d.collect()}
    blocks = lambda x: (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1|br|b)>", x))
    expected = {k: "\n".join(b for b in blocks(x) if b) for k, (host, x) in body.items() if host in large}
    got = {r.page_id: r for r in html_extract.extract_text(d).collect() if r.page_id in expected}
    assert len(expected) > 500 and {k: r.text for k, r in got.items()} == expected
    assert all(r.n_counted > 0 and r.n_named == 0 for r in got.values())
    off = {r.page_id: r.text for r in html_extract.extract_text(d, min_pages=10**9).collect() if r.page_id in expected}
    assert all(len(off[k]) > len(expected[k]) for k in expected)


def test_shapes_find_what_changes_its_words(spark):
    page = '<body><div class="m1"><ul>{1}</ul></div><article><h1>Title {0}</h1><p>Story {0}.</p><div class="lead"><p>Lead {0}</p></div></article><div class="c{0}"><p>Reader {0}</p><p>says {0}</p></div><section><p>Kept {0}</p></section></body>'
    rows = [(k, "http://a.com/x", page.format(k, "".join(f"<li>link {k} {j}</li>" for j in range(1 + k % 4)))) for k in range(25)]
    rows += [(100 + k, "http://b.com/x", page.format(k, "<li>x</li>")) for k in range(6)]  # too few pages: the main element decides
    got = {r.page_id: r for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    article = "Title {0}\nStory {0}.\nLead {0}"
    assert all(got[k].text == f"{article}\nKept {{0}}".format(k) for k in range(25))  # no name, no attribute, other words on each page
    assert all(got[100 + k].text == article.format(k) and got[100 + k].n_counted == 0 for k in range(6))
    assert got[3].n_counted == 6 and got[3].n_named == 0


def test_site_templates_and_furniture(spark):
    story = "<div><p>Story {0} is long &amp; told<p>Part <i>two</i> {0}</div>"
    page = "<body><header><h1>Site</h1></header><div>Welcome to <b>our</b> site</div>" + story + '<div class="reader-comments"><p>first!</p></div><form><p>mail</p></form><div id=cookie-banner>ok?</div></body>'
    rows = [(i, f"http://h.com/{i}", page.format(i)) for i in range(8)]
    rows += [(50 + i, "http://copies.com/", page.format("same")) for i in range(8)]  # copies of one page are no template
    rows += [(100, None, None), (None, "x", "<p>a&nbsp;b<br>c<script>if(a<b){}</script><ul><li>x<li>y</ul>"), (101, "u", "<p>open <b>bold<p>next &lt;tag&gt; &am &amp"), (102, "u", "plain > text"), (102, "u", "")]
    rows += [(103, "u", '<article><header><h1>T</h1></header><p class="lead">in</p><aside>no</aside><nav>no</nav></article><p>after</p>')]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1))
    got = [(r.page_id, r.text) for r in html_extract.extract_text(d).collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] < 50) == [(i, f"Story {i} is long & told\nPart two {i}") for i in range(8)]
    assert {t for k, t in got if k is not None and 50 <= k < 100} == {"Welcome to our site\nStory same is long & told\nPart two same"}
    rest = {k: t for k, t in got if k is None or k in (100, 101, 103)}
    assert rest == {100: "", None: "a b\nc\nx\ny", 101: "open bold\nnext <tag> &am &", 103: "T\nin"}
    assert sorted(t for k, t in got if k == 102) == ["", "plain > text"]
    assert html_extract.extract_text(d.limit(0)).count() == 0


def test_counts_decide_what_names_do_not(spark):
    page = '<head><title>t</title><body><article><h1>Title {0}</h1><div class="k9">Buy our <b>gold</b> plan</div><p>Story {0}.</p><p>Said everywhere.</p><svg><g><svg><text>no</text></svg></g>x</svg></article>'
    rows = [(k, f"http://a.com/{k}", page.format(k)) for k in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = lambda **o: {r.page_id: r.text for r in html_extract.extract_text(d, **o).collect()}
    assert text() == {k: f"Title {k}\nStory {k}.\nSaid everywhere." for k in range(6)}
    assert text(min_pages=1000) == {k: f"Title {k}\nBuy our gold plan\nStory {k}.\nSaid everywhere." for k in range(6)}


@pytest.mark.parametrize("unit", ["<b>x", "<div>x", "<p><i>x", "<li><b>x</p>", "<span class=ad>x", "<blockquote><li>x</i>", "<h1>x</h2><td>", "<div>x</section>"])
def test_a_long_page_of_unclosed_elements(unit):
    import time

    began = time.time()
    blocks, subtrees = html_extract.read_page(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 5 and blocks and len(subtrees) <= 1_000_000


def test_windows_that_end_alike_cost_no_more():
    import time

    rng = random.Random(8)
    text = [b"w%d" % rng.randrange(50) for _ in range(20_000)]
    for k in range(0, 20_000, 9):
        text[k : k + 2] = [b"same", b"end"]
    alike = {(*(b"p%d" % rng.randrange(10_000) for _ in range(8)), b"same", b"end"): [k] for k in range(20_000)}
    apart = {tuple(b"p%d" % rng.randrange(10_000) for _ in range(10)): [k] for k in range(20_000)}
    alike[tuple(text[91:101])] = ["here"]  # ends with the common words
    found, took = {}, {}
    for name, patterns in (("alike", alike), ("apart", apart)):
        searcher = decontaminate.WuManber(patterns, 10)
        began = time.process_time()
        for _ in range(5):
            found[name] = list(searcher.search(text))
        took[name] = time.process_time() - began
    assert found == {"alike": [(91, ["here"])], "apart": []}
    assert took["alike"] < 0.5  # it was 1.6 s for each search when a bucket was compared whole


def test_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hot = [(100_000 + k, "same") for k in range(90)] + [(200_000 + k, f"pair {k // 2}") for k in range(60)] + [(-1, None), (-2, None), (None, ""), (-3, "")]
    for d in (docs, docs.union(spark.createDataFrame(hot, "doc_id long, text string")), docs.limit(3), docs.limit(0)):
        source = d.collect()
        got = sharding.assign(d.withColumn("node", F.lit("x"))).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in source)
        sizes = Counter(r.shard for r in got)
        assert not got or max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        groups = defaultdict(Counter)
        for r in got:
            groups[(r.size, r.text_crc32)][r.shard] += 1
        whole = [g for g in groups.values() if 1 < sum(g.values()) <= len(got) // 16]
        # Whole groups are dealt one after another: only one across the end of a shard may be cut.
        assert sum(len(g) > 1 for g in whole) <= 7


def plain_cut(links, shard):
    members = defaultdict(Counter)
    for node, hub in links:
        members[hub][shard[node]] += 1
    return sum(n * n for m in members.values() for n in m.values())


def test_propagation_brings_as_many_neighbours_together_as_a_plain_one(spark):
    """Against the same rule written out node by node: linked pairs that are together, and even sizes."""
    import random

    rng = random.Random(2)
    links = sorted({(k, k // 6) for k in range(240)} | {(rng.randrange(240), 1000 + rng.randrange(30)) for _ in range(200)})
    quotas = [60] * 4
    got = {r.node: r.shard for r in sharding.propagate(spark.createDataFrame(links, "node long, hub long"), quotas).collect()}
    assert sorted(Counter(got.values()).values()) == quotas
    hubs, of = defaultdict(set), defaultdict(set)
    for node, hub in links:
        hubs[hub].add(node)
        of[node].add(hub)
    shard = {k: k // 60 for k in range(240)}
    while True:  # exchanges of single nodes as long as one of them brings neighbours together
        def gain(a, b):
            moved = shard | {a: shard[b], b: shard[a]}
            near = of[a] | of[b]
            return sum(n * n * s for s, m in ((1, moved), (-1, shard)) for h in near for n in Counter(m[x] for x in hubs[h]).values())

        best = max(((gain(a, b), a, b) for a in range(0, 240, 3) for b in range(1, 240, 7) if shard[a] != shard[b]), default=(0, 0, 0))
        if best[0] <= 0:
            break
        shard[best[1]], shard[best[2]] = shard[best[2]], shard[best[1]]
    by_chance = plain_cut(links, {k: k % 4 for k in range(240)})
    assert plain_cut(links, got) >= 0.9 * plain_cut(links, shard) > by_chance


@pytest.mark.parametrize("within", [False, True])
def test_ranks_have_no_gaps(spark, within):
    from auctionlake.llm.common import rank_within

    d = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("hub"))
    got = rank_within(d, "g", ["hub", "id"], F.xxhash64("hub"), 3000, "rank", per_task=50, within=F.xxhash64("id") if within else None).collect()
    for g in range(3):
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1000))


def test_importance(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = importance.classify(docs, labels)
    held = got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("double")).alias("share")).collect()
    share = {r.quality: r.share for r in held}
    assert share[1] > 0.97 and share[0] < 0.2
    assert got.filter("selected").count() == round(docs.count() * labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0])
    again = importance.classify(docs, labels)
    assert got.filter("selected").select("doc_id").exceptAll(again.filter("selected").select("doc_id")).count() == 0


@pytest.mark.parametrize("passage", [None, 200])
def test_importance_matches_a_plain_computation(spark, sf_dir, passage):
    import math

    import xxhash

    docs = with_extra(spark, sf_dir).select("doc_id", "text").filter("doc_id IS NOT NULL")
    labels = table(spark, sf_dir, "labels")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    share = sum(r.quality == 1 for r in labels.collect()) / labels.count()
    word = lambda w: xxhash.xxh3_64_intdigest(w.encode())

    def grams(text):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        out = [word(x) % importance.BUCKETS for x in w]
        for a, b in zip(w, w[1:], strict=False):
            h = ((word(a) * 0x9E3779B97F4A7C15) % (1 << 64)) ^ ((word(b) + 0x165667B19E3779F9) % (1 << 64))
            out.append((h ^ h >> 31) % importance.BUCKETS)
        return out

    rows = [(r.doc_id, grams(r.text)) for r in docs.collect()]
    raw, target = [1] * importance.BUCKETS, [1] * importance.BUCKETS
    for key, g in rows:
        for b in g:
            raw[b] += 1
            target[b] += key in good
    n, m = sum(raw), sum(target)
    ratio = [math.log(t / m) - math.log(r / n) for t, r in zip(target, raw, strict=True)]
    weights = [(key, len(g), sum(ratio[b] for b in g) * (passage / len(g) if passage and g else 1)) for key, g in rows]
    uniform = {r.doc_id: ((r.h % ((1 << 52) - 1)) + 0.5) / (1 << 52) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("h")).distinct().collect()}
    noisy = sorted((-(w - math.log(-math.log(uniform[key]))), key, size, w) for key, size, w in weights)
    k = round(share * len(rows))
    expected = sorted((key, size, round(w, 6), at < k) for at, (_, key, size, w) in enumerate(noisy))
    got = importance.classify(docs, labels, passage=passage).collect()
    assert sorted((r.doc_id, r.n_features, round(r.log_weight, 6), r.selected) for r in got) == expected


def test_importance_edges_and_top_k(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = [(1, "good words here"), (2, None), (None, ""), (1, "good words here"), (3, "bad " * 5000)]
    got = importance.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=0.4).collect()
    assert len(got) == 5 and sum(r.selected for r in got) == 2 and {r.n_features for r in got} >= {0, 5}
    assert importance.classify(spark.createDataFrame([], "doc_id long, text string"), labels.limit(0)).count() == 0
    d = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("w"))
    for k in (0, 1, 1234, 4999, 5000):
        chosen = importance.gumbel_top_k(d, "w", "doc_id", k)
        assert chosen.filter("selected").count() == k and chosen.count() == 5000
    one = importance.gumbel_top_k(d.withColumn("w", F.lit(0.0)), "w", "doc_id", 100)
    assert one.filter("selected").count() == 100
