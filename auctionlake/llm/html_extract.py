"""Main text of web pages: a site's templates by counts of subtrees for each host; elements and names where a host has too few pages."""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auctionlake.llm.common import join_counted, materialize, texts_of

#: A subtree is part of a site's template if it stands on so many pages of the host with different main texts.
MIN_PAGES = 5
#: A host with so many pages of different main texts shows what its template is: there counts decide about all that is outside the main element.
HOST_PAGES = 20

# Element names of HTML by their part on a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
EMBEDDED = {"svg", "math", "canvas", "object", "audio", "video", "head"}
PARTS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "label", "fieldset", "datalist", "option"}
FURNITURE = {*PARTS, *RAW, *EMBEDDED}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *FURNITURE}
#: A new one ends an open one of the same kind (the end tag may be left out).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "button", "select", "input", "label", "option", "datalist", *RAW, *EMBEDDED}
CONTAINERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "td", "th"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverts?|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|sidebar|side-bar|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar|toolbar|share|sharing|social|related|recommend\w*|comments?|comment-list|"
    r"disqus|replies|respond|widget|skip-link|search|login|signup|pagination|pager)(?=$|[\s_-])",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
#: Inside a main element these alone, without attributes, are prose: an article may say a sentence that others of its site say too.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "li", "blockquote", "pre", "dt", "dd", "td", "th", "tr", "caption", "figcaption"}
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'){0,2000})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


#: What a block is: text, page furniture by a name or by its element, or nothing that a reader sees.
TEXT, NAMED, PART, NEVER = range(4)


def _kind(tag: str, attributes: str, inside_main: bool) -> int:
    if tag in RAW or tag in EMBEDDED:
        return NEVER
    kind = PART if tag in PARTS or tag == "header" and not inside_main else TEXT
    if not attributes or tag in ("html", "body", "article", "main"):
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and NAMES.search(entities.unescape(value)) or name == "role" and value.lower() in ROLES:
            kind = max(kind, NAMED)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return NEVER
    return kind


_DIGITS = re.compile(r"\d+")


def _label(tag: str, attributes: str) -> str:
    """An element's name in a shape: its tag and its class, id and role without digits."""
    if not attributes:
        return tag
    return tag + "".join(f"|{m[1]}={_DIGITS.sub('', m[2] or m[3] or m[4] or '')}" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role"))


class _Open:
    __slots__ = ("tag", "kind", "main", "prose", "first", "label", "own", "shape", "child")

    def __init__(self, tag: str, kind: int, main: bool, prose: bool, first: int, label: str, own: bool):
        self.tag, self.kind, self.main, self.prose = tag, kind, main, prose
        self.first = first  # the first block that may be in it
        self.label, self.own = label, own  # own: a part of a page, or with attributes; only then its shape may be a template
        self.shape, self.child = 0, 0  # hash of its children's shapes, repeats left out, and the last of these


class _Ranges:
    """Hashes of runs of blocks from running sums, so that one costs the same whatever the run's length."""

    MODULUS, BASE = (1 << 89) - 1, 0x1D8AF066C3E5B1D7

    def __init__(self):
        self.sums, self.powers = [0], [1]

    def add(self, text: str) -> None:
        h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        self.sums.append((self.sums[-1] * self.BASE + h + 1) % self.MODULUS)
        self.powers.append(self.powers[-1] * self.BASE % self.MODULUS)

    def digest(self, start: int, stop: int) -> int:
        return (self.sums[stop] - self.sums[start] * self.powers[stop - start]) % self.MODULUS


def read_page(source: str) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int | None, int, int, bool, bool]]]:
    """Blocks (text, kind, in the main element) in page order, and subtrees (hash, shape, first block, stop, inside the main element, prose).

    A shape is the hash of an element's tag, names and children's shapes, whatever their words; a run of equal children counts
    as one, so menus and comments of any length have one shape. It is None where an element has no attributes and is no part
    of a page by its tag. Time and memory grow with the page's length, however its elements are nested: a subtree is a range of
    blocks, and of inline elements only furniture and what stands in it is followed.
    """
    stack = [_Open("", TEXT, False, False, 0, "", False)]
    opened: Counter[str] = Counter()
    blocks: list[tuple[str, int, bool]] = []
    ranges = _Ranges()
    subtrees: list[tuple[int, int | None, int, int, bool, bool]] = []
    pending: list[str] = []

    def end_block() -> None:
        if pending:
            text = _SPACE.sub(" ", entities.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                blocks.append((text, stack[-1].kind, stack[-1].main))
                ranges.add(text)

    def close(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            opened[e.tag] -= 1
            if e.tag in BLOCKS:
                shape = xxhash.xxh3_64_intdigest(f"{e.label} {e.shape}") - (1 << 63)
                parent = stack[-1]
                if shape != parent.child:
                    parent.shape, parent.child = xxhash.xxh3_64_intdigest(f"{parent.shape} {shape}"), shape
                if len(blocks) > e.first:
                    h = xxhash.xxh3_64_intdigest(f"{e.tag} {len(blocks) - e.first} {ranges.digest(e.first, len(blocks))}") - (1 << 63)
                    subtrees.append((h, shape if e.own else None, e.first, len(blocks), parent.main, e.prose))

    def close_to(wanted: set[str], until: set[str]) -> None:
        """Closes the innermost open element of ``wanted``, unless one of ``until`` stands before it."""
        if any(opened[t] for t in wanted):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in wanted:
                    return close(k)
                if stack[k].tag in until:
                    return None
        return None

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            pending.append(source[at:])
            break
        if m.start() > at:
            pending.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag in BLOCKS:
                end_block()
            close_to({tag}, set())
            continue
        if tag in BLOCKS:
            end_block()
        attributes = m[3] or m[6] or ""
        if tag in RAW:  # its content is no markup
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = over.end() if over else len(source)
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and (tag not in BLOCKS or tag in ("svg", "math")):
            continue
        if stack[-1].tag == "head" and tag in BLOCKS:
            close(len(stack) - 1)
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if closes:
            close_to(closes, CONTAINERS)
        parent = stack[-1]
        main = parent.main or tag in ("article", "main") and parent.kind == TEXT
        kind = max(parent.kind, _kind(tag, attributes, parent.main))
        if tag in BLOCKS or kind:
            named = attributes.strip()
            stack.append(_Open(tag, kind, main, tag in PROSE and not named, len(blocks), _label(tag, named), bool(named) or tag in PARTS or tag == "header"))
            opened[tag] += 1
    end_block()
    close(1)
    return blocks, subtrees


#: Characters of the pages' text that travel together, and pages.
BLOCK_CHARS, BLOCK_PAGES = 2_000_000, 2000
_PLACES = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("shape", T.BooleanType())]))


def _hosted(host: str, h: object) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\0{h}") - (1 << 63)


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each page with its subtrees (``page`` is its place in its block), and one for each block of pages with their texts (``page`` null).

    ``payload`` holds a block's pages as a compressed Arrow stream: id, url, blocks, which of them elements and names keep
    (``named``), and which are left to the counts (``open``: 1, or 2 for what its element says is no text if it does not recur either).

    Where a page has an article or main element, that is its main text: the element itself and what it
    stands in are never a template. Outside it every subtree is counted before any name is looked at, by its words and, if it
    is a part of a page or has attributes, by its shape; all hashes hold the host. Inside the main element bare prose
    (paragraphs, headings, list items without attributes) is the article's own, however often its words recur; what is put in
    there by a site stands in an element of its own (div, section, table, or any with a class), and is counted by its words.
    A shape alone can't tell a lead from a comment there, so tags and names decide about the rest, as they do for pages
    without a main element.
    """
    fields = [("block", T.LongType()), ("page", T.IntegerType()), ("host", T.StringType()), ("content", T.LongType()), ("marker", T.LongType()), ("places", _PLACES), ("payload", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in fields])
    held_as = pa.schema([("id", to_arrow_type(pages.schema[id_col].dataType)), ("url", to_arrow_type(pages.schema[url_col].dataType)), ("blocks", pa.list_(pa.string())), ("named", pa.list_(pa.bool_())), ("open", pa.list_(pa.int8()))])
    host_of = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)")

    def read(url: str, source: str) -> tuple[dict, dict]:
        m = host_of.match(url)
        host = m[1].rpartition("@")[2].lower() if m else ""
        blocks, subtrees = read_page(source)
        has_main = any(main and kind == TEXT for _, kind, main in blocks)
        named = [kind == TEXT and (main or not has_main) for _, kind, main in blocks]
        left = [int(kind == TEXT) if main else (1, 1, 2, 0)[kind] for _, kind, main in blocks] if has_main else list(map(int, named))
        seen = [0, *itertools.accumulate(int(a or b > 0) for a, b in zip(named, left, strict=True))]  # blocks before each that may be text
        main_before = [0, *itertools.accumulate(int(main) for *_, main in blocks)]
        places = []
        for words, shape, first, stop, inside, prose in subtrees:
            if seen[first] == seen[stop] or inside and prose or not inside and has_main and main_before[first] < main_before[stop]:
                continue
            places.append({"hash": _hosted(host, words), "first": first, "stop": stop, "shape": False})
            if shape is not None and has_main and not inside:
                places.append({"hash": _hosted(host, f"shape {shape}"), "first": first, "stop": stop, "shape": True})
        text = "\0".join(b[0] for b, k in zip(blocks, named, strict=True) if k)
        counted = {"host": host, "content": xxhash.xxh3_64_intdigest(text) - (1 << 63), "marker": _hosted(host, "pages"), "places": places}
        return counted, {"blocks": [b[0] for b in blocks], "named": named, "open": left}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, numbers = TaskContext.get().partitionId() << 32, itertools.count()
        rows: list[dict] = []
        held: list[dict] = []
        chars = 0

        def block_done() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, chars
            block = base + next(numbers)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held_as, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
                stream.write_batch(pa.RecordBatch.from_pylist(held, held_as))
            yield pa.RecordBatch.from_pylist([*({"block": block, "page": k} | r for k, r in enumerate(rows)), {"block": block, "payload": out.getvalue().to_pybytes()}], arrow)
            rows, held, chars = [], [], 0

        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, url, link, source in zip(ids, urls, texts_of(batch.column(1).cast(pa.string())), texts_of(batch.column(2)), strict=True):
                counted, own = read(link, source)
                rows.append(counted)
                held.append({"id": key, "url": url} | own)
                chars += sum(map(len, own["blocks"]))
                if chars >= block_chars or len(held) >= BLOCK_PAGES:
                    yield from block_done()
        if held:
            yield from block_done()

    return pages.select(id_col, url_col, F.col(html_col).cast("string")).mapInArrow(run, schema)


def templates(read: DataFrame, min_pages: int = MIN_PAGES, host_pages: int = HOST_PAGES) -> DataFrame:
    """(hash, n) of the subtrees that recur on many pages of a host, and of hosts with enough pages (their ``marker``). Copies of one page count once."""
    hashes = F.array_distinct(F.transform("places", lambda p: p["hash"]))
    distinct = read.select("host", "content", "marker", hashes.alias("hashes")).groupBy("host", "content").agg(F.first("hashes").alias("hashes"), F.first("marker").alias("marker"))
    subtrees = distinct.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    hosts = distinct.groupBy(F.col("marker").alias("hash")).agg(F.count("*").alias("n")).filter(F.col("n") >= host_pages)
    return subtrees.unionByName(hosts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each page of a block: by the counts, then by elements where its host has enough pages; else by elements and names, then the counts."""
    for batch in batches:
        for payload, hits in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found: dict[int, list[dict]] = {}
            for f in hits or []:
                found.setdefault(f["page"], []).append(f)
            t = pa.ipc.open_stream(payload.as_buffer()).read_all()
            left, counted, by_name = [], [], []
            for page, (blocks, named, open_) in enumerate(zip(*(t[c].to_pylist() for c in ("blocks", "named", "open")), strict=True)):
                gone = found.get(page, [])
                large = any(f["first"] < 0 for f in gone)
                keep = [o > 0 for o in open_] if large else list(named)
                before = sum(keep)
                for f in gone:
                    if f["first"] >= 0 and (large or not f["shape"]):
                        keep[f["first"] : f["stop"]] = [False] * (f["stop"] - f["first"])
                counted.append(before - sum(keep))
                if large:
                    keep = [k and o == 1 for k, o in zip(keep, open_, strict=True)]
                left.append("\n".join(b for b, k in zip(blocks, keep, strict=True) if k))
                by_name.append(len(blocks) - sum(keep) - counted[-1])
            whole = pa.table({"id": t["id"], "url": t["url"], "text": pa.array(left, pa.string()), "n_counted": pa.array(counted, pa.int64()), "n_named": pa.array(by_name, pa.int64())})
            yield from whole.combine_chunks().to_batches(max_chunksize=1000)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, host_pages: int = HOST_PAGES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, url, text, n_chars, n_counted, n_named) of each page: its main blocks in order, joined by line feeds.

    On a host with ``host_pages`` pages of different main texts, subtrees outside the main element go because they recur, by
    words or shape, on ``min_pages`` of them; no name counts there, and of what does not recur only elements that are no text by
    their tag (``nav``, ``footer``, ``form`` and the like) go too. Names and tags decide inside the main element and on smaller hosts.
    ``n_counted`` are the blocks that the counts took, ``n_named`` those that tags and names did. White space inside
    a block becomes one space and character references are decoded. Null html is empty and gives an empty text, a null url
    belongs to the host without a name; broken markup is read as far as it goes. Repeated rows and null ids give a row each; an
    empty table gives none; other columns are not read.
    """
    read = materialize(read_pages(pages, id_col, url_col, html_col, block_chars), "pages")
    each_page = read.filter("page IS NOT NULL")
    common = materialize(templates(each_page, min_pages, host_pages), "templates")
    marker = F.array(F.struct(F.col("marker").alias("hash"), F.lit(-1).alias("first"), F.lit(-1).alias("stop"), F.lit(False).alias("shape")))
    each = each_page.select("block", "page", F.explode(F.concat("places", marker)).alias("d")).select("block", "page", "d.*")
    total = common.agg(F.sum("n").alias("n")).first()["n"] or 0
    hits = join_counted(each, common, "hash", "n", total)
    found = hits.groupBy("block").agg(F.collect_list(F.struct("page", "first", "stop", "shape")).alias("found"))
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_counted", T.LongType()), T.StructField("n_named", T.LongType())])
    cut = read.filter("page IS NULL").select("block", "payload").join(found, "block", "left").select("payload", "found").mapInArrow(_cut, schema)
    return cut.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_counted", "n_named")
