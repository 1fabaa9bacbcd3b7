"""Listing pages as tables: rows, labels and embedded data, with built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.functions.text import amount, first_rule, found, squeeze
from auctionlake.functions.values import any_date

# Words in a raw status and the status that they mean, first match first.
STATUS_RULES = [
    ("scheduled", "scheduled"), ("bankrupt", "bankruptcy"), ("adjourn", "adjourned"), ("cancel", "cancelled"),
    ("redeem", "redeemed"), ("sold", "sold"), ("stay", "stayed"),
]
# How sale numbers are written, in one county and in the others of its portal.
SALE_NUMBER, COUNTY_SALE_NUMBER = r"(?i)\bFOR-\d+\b", r"(?i)\b[A-Z]{1,4}-\d+\b"
# A listing's columns where it has no headings that name them all.
LISTING_COLUMNS = ["sheriff_number", "sale_date", "plaintiff", "defendant", "address"]


def visible_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles or markup; the common references decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(text))
    return squeeze(bare)


def elements(html: Column, tag: str) -> Column:
    """The inner markup of every element of a kind that does not contain itself."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1)


def elements_of(html: Column, tag: str) -> Column:
    """As ``elements``, where ``tag`` is a pattern of names."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})\s*>"), 1)


def table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page, row number, cells): rows of all tables with their cells' visible text; rows without cells go."""
    rows = pages.select(F.col(id_col), F.posexplode(elements(F.col(html_col), "tr")).alias("row_number", "row_html"))
    cells = F.transform(F.regexp_extract_all("row_html", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), visible_text)
    return rows.select(id_col, "row_number", cells.alias("cells")).filter(F.size("cells") > 0)


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page, position, href, text) of every link."""
    pattern = F.lit(r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""")
    both = F.arrays_zip(F.regexp_extract_all(html_col, pattern, 1).alias("href"), F.regexp_extract_all(html_col, pattern, 2).alias("inner"))
    each = pages.select(F.col(id_col), F.posexplode(both).alias("position", "x"))
    return each.select(id_col, "position", F.col("x.href").alias("href"), visible_text(F.col("x.inner")).alias("text"))


def labelled_values(html: Column) -> Column:
    """A map from lower-case labels to values out of two-cell rows and definition lists; later ones win."""
    two = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>\s*<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
    terms = r"(?is)<dt\b[^>]*>(.*?)</dt\s*>\s*<dd\b[^>]*>(.*?)</dd\s*>"
    rows = F.transform(F.filter(elements(html, "tr"), lambda r: r.rlike(two)), lambda r: F.struct(F.regexp_extract(r, two, 1).alias("k"), F.regexp_extract(r, two, 2).alias("v")))
    defs = F.zip_with(F.regexp_extract_all(html, F.lit(terms), 1), F.regexp_extract_all(html, F.lit(terms), 2), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    clean = F.transform(F.concat(rows, defs), lambda e: F.struct(F.rtrim(F.lower(F.regexp_replace(visible_text(e["k"]), r"[:\s]+$", ""))).alias("k"), visible_text(e["v"]).alias("v")))
    named = F.filter(clean, lambda e: e["k"] != "")
    keys = F.array_distinct(F.transform(named, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(named, lambda e: e["k"] == k), -1)["v"])))


def field_named(fields: Column, names: Sequence[str]) -> Column:
    """The value of the first label, in name order, that contains one of ``names``."""
    entries = F.array_sort(F.map_entries(fields))

    def first(name: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["key"].contains(name)), F.lit(1))["value"]

    return F.coalesce(*map(first, names))


def normalise_status(raw: Column) -> Column:
    """The status that a portal's words mean; other words stay, joined by underscores; blank is unknown."""
    v = squeeze(F.lower(F.coalesce(raw, F.lit(""))))
    return F.when(v == "", "unknown").otherwise(F.coalesce(first_rule(v, STATUS_RULES), F.replace(v, F.lit(" "), F.lit("_"))))


def _heading(cell: Column) -> Column:
    return squeeze(F.replace(F.replace(F.lower(cell), F.lit("#"), F.lit(" number ")), F.lit(":"), F.lit(" ")))


def _heading_kind(h: Column) -> Column:
    dated = h.contains("sales date") | h.contains("sale date")
    kinds = F.when(h.contains("sheriff"), "sheriff_number").when(h == "status", "status").when(dated, "sale_date")
    return kinds.when(h.contains("plaintiff"), "plaintiff").when(h.contains("defendant"), "defendant").when(h.contains("address"), "address").otherwise("")


def sale_listing(pages: DataFrame, id_col: str, html_col: str, number: str = SALE_NUMBER) -> DataFrame:
    """Listing rows keyed by sale number, the last row of a number winning; rows without a number go.

    Columns go by their headings, the last of a kind; a listing whose headings do not name them all has them in
    the usual order. A value that is blank there is looked for at its usual distance from the number's cell.
    """
    lines = F.transform(elements(F.col(html_col), "tr"), lambda r: F.struct(r.alias("html"), F.transform(elements_of(r, "t[dh]"), lambda c: _heading(visible_text(c))).alias("headings")))
    d = pages.select(id_col, lines.alias("lines"))
    joined = F.filter(F.transform("lines", lambda x: F.struct(x["headings"].alias("headings"), F.array_join(x["headings"], " ").alias("text"))), lambda x: F.size(x["headings"]) > 0)
    d = d.withColumn("joined", joined).withColumn("head", F.coalesce(F.get(F.filter("joined", lambda x: x["text"].contains("sheriff") & x["text"].contains("address")), F.lit(0)), F.try_element_at("joined", F.lit(-1))))
    d = d.withColumn("kinds", F.transform("head.headings", _heading_kind)).withColumn("late", F.col("head.text").contains("status").cast("int"))
    named = F.forall(F.array(*map(F.lit, LISTING_COLUMNS)), lambda c: F.array_contains("kinds", c))
    d = d.withColumn("named", F.coalesce(named, F.lit(False)))

    def place(kind: str) -> Column:
        last = F.array_position(F.reverse("kinds"), kind)
        own = F.when(last > 0, F.size("kinds") - last)
        usual = F.lit(1) if kind == "status" else F.lit(LISTING_COLUMNS.index(kind) + 1)
        usual = F.when(F.col("late") == 1, F.lit(2) if kind == "status" else usual + (0 if kind == "sheriff_number" else 1))
        return F.when(F.col("named"), own).otherwise(usual if kind == "status" else F.coalesce(usual, F.lit(LISTING_COLUMNS.index(kind) + 1))).cast("int").alias(f"at_{kind}")

    kinds = [*LISTING_COLUMNS[1:], "status"]
    rows = d.select(id_col, *map(place, kinds), F.posexplode("lines").alias("row_number", "line"))
    rows = rows.select(id_col, "row_number", *(f"at_{k}" for k in kinds), F.col("line.html").alias("row_html"), F.transform(elements_of(F.col("line.html"), "td"), visible_text).alias("cells"))
    rows = rows.withColumn("number_at", F.array_position(F.transform("cells", lambda c: c.rlike(number)), True) - 1).filter("number_at >= 0")

    def value(kind: str, distance: int) -> Column:
        own = F.when(F.col(f"at_{kind}").isNotNull(), F.nullif(F.get("cells", F.col(f"at_{kind}")), F.lit("")))
        beside = F.nullif(F.get("cells", (F.col("number_at") + distance).cast("int")), F.lit(""))
        return F.coalesce(own, F.when(F.col(f"at_{kind}").isNotNull(), beside))

    raw = value("status", 1)
    found_rows = rows.select(
        F.upper(F.regexp_extract(F.get("cells", F.col("number_at").cast("int")), number, 0)).alias("sheriff_number"), id_col, "row_number", any_date(value("sale_date", 2)).alias("sale_date"), value("plaintiff", 3).alias("plaintiff"),
        value("defendant", 4).alias("defendant"), value("address", 5).alias("address"), raw.alias("raw_status"), F.when(raw.isNull(), "scheduled").otherwise(normalise_status(raw)).alias("status"),
        found(F.col("row_html"), r"""(?is)<a\b[^>]*?href\s*=\s*["']\s*([^"']*/Sales/SaleDetails[^"']*?)\s*["']""").alias("detail_href"),
    )
    columns = [c for c in found_rows.columns if c not in ("sheriff_number", id_col, "row_number")]
    last = found_rows.groupBy("sheriff_number").agg(F.max_by(F.struct(*columns), F.struct(id_col, "row_number")).alias("x"))
    return last.select("sheriff_number", "x.*")


# A court list's statuses, compared whole.
PARTY_STATUSES = {"active": "scheduled", "postponed": "adjourned", "cancelled": "cancelled", "stayed": "stayed"}


def party_status(raw: Column) -> Column:
    """The status before any bracket; one that is not known stays as it is; blank is unknown."""
    v = F.lower(F.trim(F.split(F.coalesce(raw, F.lit("")), r"\(", 2)[0]))
    known = F.coalesce(*(F.when(v == k, x) for k, x in PARTY_STATUSES.items()))
    return F.coalesce(known, F.nullif(v, F.lit("")), F.lit("unknown"))


def party_listing(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The six-cell table of class ``body-table``: parties on either side of the first ``vs``, a date inside the status, an amount or 0.

    Its first row is the heading; pages without the table give no rows.
    """
    table = found(F.col(html_col), r"""(?is)<table\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?body-table(?:\s[^"']*)?["'][^>]*>(.*?)</table\s*>""")
    lines = pages.select(F.col(id_col), F.posexplode(elements(table, "tr")).alias("row_number", "row_html")).filter("row_number > 0")
    rows = lines.withColumn("cells", F.transform(elements_of(F.col("row_html"), "td"), visible_text)).filter("size(cells) >= 6 AND cells[0] <> ''")
    parties = F.split(F.col("cells")[1], r"(?i)\s+vs\.?\s+", 2)
    digits = F.regexp_replace(F.col("cells")[4], r"[^0-9.]", "")
    return rows.select(
        id_col, F.col("cells")[0].alias("sheriff_number"), F.nullif(parties[0], F.lit("")).alias("plaintiff"), F.get(parties, F.lit(1)).alias("defendant"),
        F.col("cells")[2].alias("attorney"), F.col("cells")[3].alias("address"), F.when(digits == "", F.lit("0")).otherwise(digits).try_cast("decimal(14,2)").alias("judgment_amount"),
        F.col("cells")[5].alias("raw_status"), party_status(F.col("cells")[5]).alias("status"), any_date(found(F.col("cells")[5], r"(\d{1,2}/\d{1,2}/\d{4})")).alias("sale_date"),
        found(F.col("row_html"), r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["']""").alias("source_href"),
    )


def status_history(pages: DataFrame, id_col: str, html_col: str, table_id: str = "longTable") -> DataFrame:
    """(page, position, status, raw_status, event_date) from the history table, repeats kept; undated or blank rows go."""
    table = found(F.col(html_col), rf"""(?is)<table\b[^>]*id\s*=\s*["']?{table_id}["']?[^>]*>(.*?)</table\s*>""")
    rows = table_rows(pages.select(id_col, table.alias("t_")).filter("t_ IS NOT NULL"), id_col, "t_").filter(F.size("cells") >= 2)
    d = rows.select(id_col, F.col("row_number").alias("position"), F.col("cells")[0].alias("raw_status"), any_date(F.col("cells")[1]).alias("event_date"))
    return d.filter("event_date IS NOT NULL AND trim(raw_status) <> ''").withColumn("status", normalise_status(F.col("raw_status")))


# Fixed value: what stands before the rows of a portal's grid.
GRID_MARKER = r'"data"\s*:\s*\{\s*"Data"\s*:\s*'
_JSON_PARTS = r'("(?:[^"\\]++|\\.)*+"?|[\[\]{}]|[^"\[\]{}]++)'


def json_value(text: Column) -> Column:
    """The array or object with which a text starts, up to its own closing bracket, however deep others lie in it; null if it does not end.

    The text is cut into strings, brackets and the rest, so brackets in strings count for nothing; a fold over the parts keeps the depth.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("over"))

    def step(a: Column, part: Column) -> Column:
        turn = F.when(part.isin("[", "{"), 1).when(part.isin("]", "}"), -1).otherwise(0)
        depth = a["depth"] + turn
        return F.when(a["over"], a).otherwise(F.struct(depth.alias("depth"), (a["length"] + F.length(part)).alias("length"), ((turn != 0) & (depth == 0)).alias("over")))

    def cut(end: Column) -> Column:
        return F.when(end["over"] & F.substring(text, 1, 1).isin("[", "{"), F.substring(text, F.lit(1), end["length"]))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_JSON_PARTS), 1), start, step, cut)


def embedded_grid(pages: DataFrame, id_col: str, html_col: str, schema: T.StructType, key: str, marker: str = GRID_MARKER) -> DataFrame:
    """Rows of a JSON array that a script holds after ``marker``; the last row of each key stays.

    Pages without the marker, and arrays that do not end or are no JSON, give no rows.
    """
    text = json_value(found(F.col(html_col), rf"(?s){marker}(.*)$"))
    each = pages.select(F.col(id_col), F.posexplode(F.from_json(text, T.ArrayType(schema))).alias("position", "x"))
    last = each.groupBy(F.col(f"x.{key}").alias("key_")).agg(F.max_by("x", F.struct(id_col, "position")).alias("x"))
    return last.select("x.*")


def synthetic_id(url: Column, prefix: str) -> Column:
    """A stable number for a listing without one: a prefix and twelve hexadecimal digits of its address."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(url, 256), 1, 12)))


# An auction platform's statuses, some compared whole, some by a word in them, first match first.
AUCTION_OPEN = ["preview", "active", "open"]
AUCTION_RULES = [("postpon", "adjourned"), ("stay", "stayed"), ("cancel", "cancelled"), ("withdraw", "cancelled"), ("sold", "sold"), ("closed", "sold")]
# Labels of detail fields, tried in this order.
DETAIL_UPSET = ["estimated upset", "approximate upset", "upset sheriff", "upset price", "upset amount"]
DETAIL_JUDGMENT = ["judgment amount", "final judgment", "approximate judgment", "judgment"]
DETAIL_CASE = ["court case", "case number", "docket number", "docket"]


def auction_status(raw: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(v == "", "unknown").when(v.isin(AUCTION_OPEN), "scheduled").otherwise(F.coalesce(first_rule(v, AUCTION_RULES), v))


def detail_record(pages: DataFrame, id_col: str, html_col: str, listed_upset: Column | None = None) -> DataFrame:
    """What a detail page says: the highest upset price anywhere, other fields from the notice, then from labels."""
    from auctionlake.domain.notices import parse_notice

    fields, text = labelled_values(F.col(html_col)), visible_text(F.col(html_col))
    d = pages.withColumn("fields_", fields).withColumn("notice_", parse_notice(text))
    label = lambda names: field_named(F.col("fields_"), names)
    n = F.col("notice_")
    listed = listed_upset if listed_upset is not None else F.lit(None).cast("decimal(14,2)")
    return d.select(
        id_col,
        F.greatest(n["estimated_upset_price"], n["alternate_upset_price"], amount(found(label(DETAIL_UPSET), r"([\d,]+(?:\.\d+)?)")), listed).alias("upset_price"),
        F.coalesce(n["judgment_amount"], amount(found(label(DETAIL_JUDGMENT), r"([\d,]+(?:\.\d+)?)"))).alias("judgment_amount"),
        label(["plaintiff attorney", "attorney"]).alias("plaintiff_attorney"), F.coalesce(n["docket_number"], label(DETAIL_CASE)).alias("court_case_number"),
        F.coalesce(n["block"], label(["block"])).alias("block"), F.coalesce(n["lot"], label(["lot"])).alias("lot"), F.coalesce(n["qualifier"], label(["qualifier"])).alias("qualifier"),
    )


# Labels of the shorter reading of a detail page, and the path of such pages.
BRIEF_MONEY = {"upset_price": ["upset price", "upset amount", "opening bid"], "judgment_amount": ["judgment amount", "final judgment", "judgment"]}
BRIEF_TEXT = {"plaintiff_attorney": ["plaintiff attorney", "attorney"], "court_case_number": ["court case", "case number", "docket number"], "block": ["block"], "lot": ["lot"], "qualifier": ["qualifier"]}
DETAIL_PATH = "/Sales/SaleDetails"


def brief_detail(listed: DataFrame, html_col: str, source_url: str, final_url: str) -> DataFrame:
    """Listed sales with the labelled fields of their detail pages, which replace what was listed, missing ones too.

    Of several labels with one of the names the first on the page counts, of amounts the first that has a number.

    A sale without a detail address, one that was sent on to another page and one whose page has no fields stay as they are.
    """
    d = listed.withColumn("fields_", F.filter(F.map_entries(labelled_values(F.col(html_col))), lambda e: e["value"] != ""))
    named = lambda names: F.filter("fields_", lambda e: reduce(or_, [e["key"].contains(n) for n in names]))
    read = F.col(source_url).contains(DETAIL_PATH) & F.col(final_url).contains(DETAIL_PATH) & (F.size("fields_") > 0)
    price = lambda e: F.regexp_extract(F.regexp_replace(e["value"], "[$,]", ""), r"(-?\d+(?:\.\d{1,2})?)", 1)
    new = {c: F.get(F.filter(F.transform(named(names), price), lambda x: x != ""), F.lit(0)).try_cast("decimal(14,2)") for c, names in BRIEF_MONEY.items()}
    new |= {c: F.get(named(names), F.lit(0))["value"] for c, names in BRIEF_TEXT.items()}
    return d.select(*[F.when(read, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in listed.columns])


def dated_links(pages: DataFrame, id_col: str, html_col: str, prefix: str, base: str) -> DataFrame:
    """Listings written as linked lines: a date, ``Sale of``, an address with its code, perhaps a cancellation; the number is made from the link."""
    line = r"(?i)([A-Z][a-z]+\s+\d{1,2},\s+\d{4})\s*-\s*Sale of\s+(.+?\bNY\s+\d{5})(?:\s*-\s*(Cancell?ed))?$"
    each = links(pages, id_col, html_col).filter(F.col("text").rlike(line))
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("href", "^/+", "")))
    status = F.when(F.regexp_extract("text", line, 3) != "", "cancelled").otherwise("scheduled")
    return each.select(id_col, synthetic_id(url, prefix).alias("sheriff_number"), F.regexp_extract("text", line, 2).alias("address"), any_date(F.regexp_extract("text", line, 1)).alias("sale_date"), status.alias("status"), url.alias("source_url"))


def docket_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Pages about one sale: docket, date, address and section, block and lot; pages without the first three go."""
    text = visible_text(F.col(html_col))
    parcel = r"(?i)Section\s+(\S+)\s+Block\s+(\S+)\s+Lot\s+(\S+)"
    d = pages.select(id_col, text.alias("t_")).select(
        id_col, found(F.col("t_"), r"(?i)Civil Docket\s+([A-Za-z0-9-]+)").alias("sheriff_number"), any_date(found(F.col("t_"), r"(?i)Sale to take place\s+([A-Z][a-z]+\s+\d{1,2},\s+\d{4})")).alias("sale_date"),
        F.trim(found(F.col("t_"), r"(?i)Premises:?\s+(.+?\bNY\s+\d{5})")).alias("address"), found(F.col("t_"), parcel, 2).alias("block"), F.regexp_replace(found(F.col("t_"), parcel, 3), "[.,]+$", "").alias("lot"),
    )
    return d.filter("sheriff_number IS NOT NULL AND sale_date IS NOT NULL AND address IS NOT NULL")


def future_sale_dates(pages: DataFrame, id_col: str, html_col: str, as_of: Column) -> DataFrame:
    """(page, sale_day) of the options of the sale-date list that are not over."""
    values = F.regexp_extract_all(html_col, F.lit(r"""(?i)<option[^>]*value\s*=\s*["'](\d{8})["']"""), 1)
    days = pages.select(id_col, F.explode(values).alias("v")).select(id_col, F.try_to_date("v", "yyyyMMdd").alias("sale_day"))
    return days.filter(F.col("sale_day") >= as_of)
