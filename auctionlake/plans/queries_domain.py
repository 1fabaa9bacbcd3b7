"""Merges, text, sources, scoring and the listing on the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auctionlake.domain import addresses, identity, listing, notices, scoring, valuation
from auctionlake.functions import text as X
from auctionlake.functions import values as V
from auctionlake.operators import merge as M
from auctionlake.operators import relational as R
from auctionlake.plans.catalog import query
from auctionlake.plans.common import money, read, spread
from auctionlake.sources import fixed_width, pages


@query("dedupe_keep_max", "SELECT sha256(text) AS text_hash, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_keep_max(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("content_hash_append", """
WITH d AS (SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || ',"source":"' || source || '"}') AS content_hash FROM documents),
known AS (SELECT DISTINCT content_hash FROM d WHERE doc_id % 2 = 0)
SELECT content_hash, min(doc_id) AS doc_id FROM d WHERE doc_id % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM known) GROUP BY content_hash""")
def content_hash_append(spark: SparkSession, sf: str) -> DataFrame:
    d = M.content_addressed(read(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"]), ["source", "lang", "n_chars"]).select("doc_id", "content_hash")
    new = d.filter("doc_id % 2 = 1").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return M.append_new(d.filter("doc_id % 2 = 0").select("content_hash", "doc_id"), new, ["content_hash"])


@query("merge_upsert_rules", """
WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS judgment, o_totalprice AS upset, o_orderdate AS first_seen, CAST(o_orderpriority AS VARCHAR) AS note FROM orders WHERE o_orderkey % 4 <> 1),
new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'N' END AS status, o_totalprice + 1 AS judgment, o_totalprice * (CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0.5 END) AS upset, o_orderdate + INTERVAL 1 DAY AS first_seen, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'new' END AS note FROM orders WHERE o_orderkey % 4 <> 2)
SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NULL THEN old.status ELSE new.status END AS status, coalesce(old.judgment, new.judgment) AS judgment, greatest(old.upset, new.upset) AS upset,
  CASE WHEN old.k IS NULL THEN new.first_seen ELSE old.first_seen END AS first_seen, coalesce(new.note, old.note) AS note FROM old FULL JOIN new ON old.k = new.k""")
def merge_upsert_rules(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    old = o.filter(k % 4 != 1).select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.when(k % 3 != 0, price).alias("judgment"), price.alias("upset"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderpriority").alias("note"))
    new = o.filter(k % 4 != 2).select(
        k.alias("k"), F.when(k % 5 != 0, "N").alias("status"), (price + 1).alias("judgment"), (price * F.when(k % 2 == 0, 2.0).otherwise(0.5)).alias("upset"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("first_seen"), F.when(k % 6 != 0, "new").alias("note"),
    )
    return M.merge_upsert(old, new, ["k"], {"status": "overwrite", "judgment": "keep", "upset": "greatest", "first_seen": "insert_only", "note": "prefer_new"})


@query("frozen_upsert", """
WITH old AS (SELECT doc_id, quality AS v, CASE WHEN toxic = 1 THEN 'APPROVED' ELSE 'PENDING' END AS review_status FROM labels WHERE doc_id % 3 <> 0),
new AS (SELECT doc_id, quality + 10 AS v, 'PENDING' AS review_status FROM labels WHERE doc_id % 3 <> 1)
SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN new.doc_id IS NULL OR old.review_status <> 'PENDING' THEN old.v ELSE new.v END AS v, coalesce(CASE WHEN old.review_status <> 'PENDING' THEN old.review_status END, new.review_status, old.review_status) AS review_status
FROM old FULL JOIN new ON old.doc_id = new.doc_id""")
def frozen_upsert(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "labels")
    old = d.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("v"), F.when(F.col("toxic") == 1, "APPROVED").otherwise("PENDING").alias("review_status"))
    new = d.filter("doc_id % 3 <> 1").select("doc_id", (F.col("quality") + 10).alias("v"), F.lit("PENDING").alias("review_status"))
    return M.merge_upsert(old, new, ["doc_id"], {"v": "overwrite", "review_status": "overwrite"}, F.col("old.review_status") != "PENDING")


@query("first_last_seen", """
SELECT l_suppkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
  first(l_returnflag ORDER BY l_orderkey DESC NULLS LAST, l_linenumber DESC NULLS LAST, l_shipdate DESC NULLS LAST, l_returnflag DESC NULLS LAST) AS latest_flag FROM lineitem GROUP BY l_suppkey""")
def first_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The latest line is that of the highest order and line number; lines that share both go by ship date, then by flag."""
    d = read(spark, sf, "lineitem", ["l_suppkey", "l_shipdate", "l_returnflag", "l_orderkey", "l_linenumber"])
    return d.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.max_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")).alias("latest_flag"))


@query("current_flag", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1 AS is_current FROM lineitem""")
def current_flag(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber", "l_shipdate"])
    return M.flag_current(d, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "is_current")


@query("current_flag_precedence", """
WITH v AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'model' WHEN 'R' THEN 'paid' ELSE 'manual' END AS provider, l_linestatus = 'O' AS is_current FROM lineitem WHERE l_linenumber <= 2),
fresh AS (SELECT p_partkey AS k, -p_partkey AS id, 'model' AS provider FROM part WHERE p_size > 20)
SELECT k, id, provider, is_current AND NOT (provider = 'model' AND k IN (SELECT k FROM fresh)) AS is_current FROM v
UNION ALL SELECT k, id, provider, k NOT IN (SELECT k FROM v WHERE is_current AND provider <> 'model') FROM fresh""")
def current_flag_precedence(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem").filter("l_linenumber <= 2")
    provider = F.when(F.col("l_returnflag") == "A", "model").when(F.col("l_returnflag") == "R", "paid").otherwise("manual")
    old = d.select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), provider.alias("provider"), (F.col("l_linestatus") == "O").alias("is_current"))
    new = read(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("k"), (-F.col("p_partkey")).alias("id"), F.lit("model").alias("provider"))
    return M.flag_unless_stronger(old, new, "k", "provider", "model")


@query("replace_set", """
WITH old AS (SELECT l_orderkey, l_linenumber, l_returnflag AS source, 'old' AS origin FROM lineitem WHERE l_linenumber <= 3), new AS (SELECT o_orderkey AS l_orderkey, 1 AS l_linenumber, 'R' AS source, 'new' AS origin FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.l_orderkey = old.l_orderkey AND new.source = old.source) UNION ALL SELECT * FROM new""")
def replace_set(spark: SparkSession, sf: str) -> DataFrame:
    old = read(spark, sf, "lineitem").filter("l_linenumber <= 3").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("source"), F.lit("old").alias("origin"))
    new = read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("R").alias("source"), F.lit("new").alias("origin"))
    return M.replace_set(old, new, ["l_orderkey", "source"])


@query("review_decision", """
WITH c AS (SELECT doc_id, doc_id % 50 AS grp, CASE WHEN toxic = 1 THEN 'REJECTED' ELSE 'PENDING' END AS s FROM labels), p AS (SELECT grp, min(doc_id) AS chosen FROM c WHERE s = 'PENDING' AND grp % 2 = 0 GROUP BY grp)
SELECT doc_id, c.grp, CASE WHEN chosen IS NULL OR s <> 'PENDING' THEN s WHEN doc_id = chosen THEN 'APPROVED' ELSE 'REJECTED' END AS review_status FROM c LEFT JOIN p ON c.grp = p.grp""")
def review_decision(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "labels").select("doc_id", (F.col("doc_id") % 50).alias("grp"), F.when(F.col("toxic") == 1, "REJECTED").otherwise("PENDING").alias("review_status"))
    chosen = c.filter("review_status = 'PENDING' AND grp % 2 = 0").groupBy("grp").agg(F.min("doc_id").alias("doc_id"))
    return M.decide(c, chosen, "grp", "doc_id")


@query("update_if_null", """
WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal, c_nationkey FROM customer), v AS (SELECT o_custkey AS k, max(o_totalprice) AS x FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(bal, x) AS bal FROM t LEFT JOIN v ON c_custkey = k""")
def update_if_null(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("bal"))
    v = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("bal"))
    return M.fill_nulls(t, v, ["c_custkey"], ["bal"])


@query("rejects_with_reason", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 1000 THEN 'too small' WHEN o_orderstatus = 'P' THEN 'pending' END AS reason FROM orders) GROUP BY reason""")
def rejects_with_reason(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"])
    good, bad = M.split_rejects(o, [(F.col("o_totalprice") < 1000, "too small"), (F.col("o_orderstatus") == "P", "pending")])
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


@query("contract_violations", """
SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT l_discount <= 0.05 THEN 'discount' END, CASE WHEN NOT l_quantity >= 10 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY rule""")
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem", ["l_discount", "l_quantity"])
    return M.violations(d, {"discount": F.col("l_discount") <= 0.05, "quantity": F.col("l_quantity") >= 10}).groupBy("rule").agg(F.count("*").alias("n"))


@query("whitespace_and_case", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), ' ,', ',', 'g'), '^[ ,]+|[ ,]+$', '', 'g')) AS cleaned_hash, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS alias FROM documents""")
def whitespace_and_case(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents", ["doc_id", "text", "source"])
    return d.select("doc_id", F.sha2(X.clean_whitespace(F.col("text")), 256).alias("cleaned_hash"), X.alias_key(F.col("source")).alias("alias"))


@query("street_key", r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(upper(CAST(p_size AS VARCHAR) || ' ' || p_name || ' Avenue'), '[A-Z0-9]+'), lambda x: CASE x WHEN 'AVENUE' THEN 'AVE' ELSE x END), '') AS key FROM part""")
def street_key(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_size", "p_name"])
    return p.select("p_partkey", X.address_key(F.concat_ws(" ", F.col("p_size").cast("string"), "p_name", F.lit("Avenue"))).alias("key"))


@query("parcel_components", r"""
SELECT c_custkey, CASE WHEN ltrim(b, '0') = '' THEN '0' ELSE ltrim(b, '0') END AS dotted, CASE WHEN ltrim(regexp_replace(b, '[^A-Z0-9-]', '', 'g'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(b, '[^A-Z0-9-]', '', 'g'), '0') END AS bare
FROM (SELECT c_custkey, '00' || CAST(c_nationkey AS VARCHAR) || '.0' || CAST(c_custkey % 10 AS VARCHAR) AS b FROM customer)""")
def parcel_components(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" 00 "), F.col("c_nationkey").cast("string"), F.lit(".0"), (F.col("c_custkey") % 10).cast("string"))
    return read(spark, sf, "customer", ["c_custkey", "c_nationkey"]).select("c_custkey", X.dotted_component(raw).alias("dotted"), X.identity_component(raw).alias("bare"))


@query("money_after_label", r"""
WITH t AS (SELECT o_orderkey, 'The estimated upset price is $' || format('{:,.2f}', CAST(o_totalprice AS DOUBLE)) || '. Interest accruing at $' || CAST(o_orderkey % 90 + 1 AS VARCHAR) || '.25 per day.' AS s FROM orders)
SELECT o_orderkey, CAST(replace(regexp_extract(s, 'upset price is \$([0-9,]+\.[0-9]{2})', 1), ',', '') AS DECIMAL(14,2)) AS upset, CAST(regexp_extract(s, 'accruing at \$([0-9]+\.[0-9]{2})', 1) AS DECIMAL(14,2)) AS interest FROM t""")
def money_after_label(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    s = F.concat(F.lit("The estimated upset price is $"), F.format_number("o_totalprice", 2), F.lit(". Interest accruing at $"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(".25 per day."))
    d = o.select("o_orderkey", s.alias("s"))
    return d.select("o_orderkey", X.money_after(F.col("s"), notices.ESTIMATED_UPSET).alias("upset"), X.money_after(F.col("s"), notices.DAILY_INTEREST, 100).alias("interest"))


@query("html_table_rows", r"""
SELECT page_id, CAST(count(*) AS BIGINT) AS n_links, sha256(string_agg(href, ',' ORDER BY k)) AS hrefs FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS k FROM pages) GROUP BY page_id""")
def html_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    each = pages.links(read(spark, sf, "pages", ["page_id", "html"]), "page_id", "html")
    return each.groupBy("page_id").agg(F.count("*").alias("n_links"), F.sha2(F.array_join(R.ordered_list([F.col("position")], F.col("href")), ","), 256).alias("hrefs"))


@query("page_visible_title", r"""
SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def page_visible_title(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages", ["page_id", "html"]).select("page_id", pages.visible_text(X.found(F.col("html"), "(?is)<title>(.*?)</title>")).alias("title"))


#: Wordings of listing statuses and what they mean.
_LISTED = [('Scheduled - Adjourned', 'scheduled'), ('Bankruptcy', 'bankruptcy'), ('Adjourned Plaintiff', 'adjourned'), ('Cancelled', 'cancelled'), ('Redeemed by owner', 'redeemed'), ('Sold to plaintiff', 'sold'), ('Stayed', 'stayed'), ('Sale  Pending', 'sale_pending')]
_AUCTIONED = [('Preview', 'scheduled'), ('Active', 'scheduled'), ('OPEN ', 'scheduled'), ('Postponed to May', 'adjourned'), ('Stayed', 'stayed'), ('Cancelled', 'cancelled'), ('Withdrawn', 'cancelled'), ('Sold', 'sold'), ('Closed early', 'sold'), ('Inactive', 'inactive'), ('Reopening', 'reopening'), (' ', 'unknown')]
_COURT = [('Active', 'scheduled'), ('Postponed', 'adjourned'), ('CANCELLED', 'cancelled'), ('Stayed', 'stayed'), ('Postponed again', 'postponed again'), ('', 'unknown')]


def _wording(k: Column, words: list[tuple[str, str]]) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w, _ in words)), (k % len(words) + 1).cast("int"))


def _meaning_sql(k: str, words: list[tuple[str, str]]) -> str:
    return f"list_extract([{', '.join(repr(m) for _, m in words)}], CAST({k} % {len(words)} + 1 AS INTEGER))"


@query("sale_listing_rows", f"""
SELECT 'FOR-' || CAST(o_orderkey AS VARCHAR) AS sheriff_number, CAST(o_orderdate AS DATE) AS sale_date, 'Bank ' || o_orderstatus AS plaintiff, 'Owner ' || CAST(o_custkey AS VARCHAR) AS defendant, CAST(o_custkey AS VARCHAR) || ' Main St' AS address,
  CASE WHEN o_custkey % 3 = 1 THEN 'scheduled' ELSE {_meaning_sql('o_orderkey', _LISTED)} END AS status, '/Sales/SaleDetails?PropertyId=' || CAST(o_orderkey AS VARCHAR) AS detail_href FROM orders""")
def sale_listing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three layouts: headings in the usual order with a status, without one, and headings in another order."""
    o = read(spark, sf, "orders")
    cell = lambda c: F.concat(F.lit("<td> <b>"), c, F.lit("</b></td>"))
    text = lambda c: F.col(c).cast("string")
    number, day = cell(F.concat(F.lit("for-"), text("o_orderkey"))), cell(F.date_format("o_orderdate", "M/d/yyyy"))
    bank, owner, address = cell(F.concat(F.lit("Bank&nbsp;"), "o_orderstatus")), cell(F.concat(F.lit("Owner "), text("o_custkey"))), cell(F.concat(text("o_custkey"), F.lit(" Main St")))
    status, link = cell(_wording(F.col("o_orderkey"), _LISTED)), F.concat(F.lit("<td><a href='/Sales/SaleDetails?PropertyId="), text("o_orderkey"), F.lit("'>Details</a></td>"))
    head = lambda *names: F.lit("<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr><tr>")
    layout = F.col("o_custkey") % 3
    html = (
        F.when(layout == 0, F.concat(head("", "Sheriff #", "Status", "Sales Date", "Plaintiff", "Defendant", "Address"), link, number, status, day, bank, owner, address))
        .when(layout == 1, F.concat(head("", "Sheriff #", "Sales Date", "Plaintiff", "Defendant", "Address"), link, number, day, bank, owner, address))
        .otherwise(F.concat(head("Address:", "Defendant", "Plaintiff", "Sale Date", "Status", "Sheriff Number", ""), address, owner, bank, day, status, number, link))
    )
    listed = pages.sale_listing(spread(o.select(F.col("o_orderkey").alias("page_id"), F.concat(html, F.lit("</tr></table>")).alias("html"))), "page_id", "html")
    return listed.select("sheriff_number", "sale_date", "plaintiff", "defendant", "address", "status", "detail_href")


@query("auction_statuses", f"""
SELECT o_orderkey, {_meaning_sql('o_orderkey', _AUCTIONED)} AS status FROM orders""")
def auction_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders", ["o_orderkey"]).select("o_orderkey", pages.auction_status(_wording(F.col("o_orderkey"), _AUCTIONED)).alias("status"))


@query("party_listing_rows", f"""
SELECT 'CV-' || CAST(o_orderkey AS VARCHAR) AS sheriff_number, 'Bank ' || o_orderstatus AS plaintiff, CASE WHEN o_custkey % 4 <> 3 THEN 'Owner vs. Others ' || CAST(o_custkey AS VARCHAR) END AS defendant, CAST(o_custkey AS VARCHAR) || ' Main St' AS address,
  CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(14,2)) END AS judgment_amount, {_meaning_sql('o_orderkey', _COURT)} AS status, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS sale_date, '/case/' || CAST(o_orderkey AS VARCHAR) AS source_href FROM orders""")
def party_listing_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    versus = F.element_at(F.array(*map(F.lit, [" vs. ", " VS ", " vs "])), (c % 4 + 1).cast("int"))
    parties = F.concat(F.lit("Bank "), "o_orderstatus", F.when(c % 4 != 3, F.concat(F.coalesce(F.when(c % 4 < 3, versus), F.lit("")), F.lit("Owner vs. Others "), c.cast("string"))).otherwise(""))
    money_text = F.when(c % 5 == 0, "n/a").otherwise(F.concat(F.lit("US $"), F.format_number("o_totalprice", 2)))
    dated = F.concat(_wording(k, _COURT), F.when(k % 2 == 0, F.concat(F.lit(" (P) "), F.date_format("o_orderdate", "M/d/yyyy"))).otherwise(""))
    number = F.concat(F.lit('<a href="/case/'), k.cast("string"), F.lit('">CV-'), k.cast("string"), F.lit("</a>"))
    row = F.concat(*map(cell, [number, parties, F.lit("Smith"), F.concat(c.cast("string"), F.lit(" Main St")), money_text, dated]))
    html = F.concat(F.lit("<table><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td></tr></table><table class='wide body-table'><tr><td>Case</td><td>Parties</td><td>Attorney</td><td>Address</td><td>Amount</td><td>Status</td></tr><tr>"), row, F.lit("</tr><tr><td></td></tr></table>"))
    listed = pages.party_listing(o.select(k.alias("page_id"), html.alias("html")), "page_id", "html")
    return listed.select("sheriff_number", "plaintiff", "defendant", "address", "judgment_amount", "status", "sale_date", "source_href")


@query("json_path_fallback", """
SELECT event_id, coalesce(json_extract_string(props, '$.address'), json_extract_string(props, '$.k'), 'none') AS v FROM events""")
def json_path_fallback(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events", ["event_id", "props"])
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.address"), F.get_json_object("props", "$.k"), F.lit("none")).alias("v"))


@query("equity", """
WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS upset FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) - upset AS gross_equity, CASE WHEN o_totalprice > 0 THEN round((o_totalprice - CAST(upset AS DOUBLE)) / o_totalprice, 4) END AS gross_equity_percent, CAST(o_totalprice AS DECIMAL(14,2)) - upset - 1500 AS net_equity, CAST(o_totalprice AS DECIMAL(14,2)) - 1500 AS maximum_bid FROM orders JOIN l ON o_orderkey = l_orderkey""")
def equity(spark: SparkSession, sf: str) -> DataFrame:
    u = read(spark, sf, "lineitem", ["l_orderkey", "l_extendedprice"]).groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("upset"))
    d = read(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).join(u, F.col("o_orderkey") == u.l_orderkey)
    fee = lambda x: F.lit(x).cast("decimal(14,2)")
    e = scoring.equity(money("o_totalprice"), F.col("upset"), fee(800), fee(400), fee(200), fee(100))
    e["gross_equity_percent"] = F.round(e["gross_equity_percent"].cast("double"), 4)
    return d.select("o_orderkey", *[v.alias(k) for k, v in e.items()])


_LIENS = """SELECT l_orderkey AS property_id, CASE l_linenumber % 6 WHEN 0 THEN 'MORTGAGE' WHEN 1 THEN 'PROPERTY_TAX' WHEN 2 THEN 'JUDGMENT' WHEN 3 THEN 'MUNICIPAL_LIEN' WHEN 4 THEN 'UCC' ELSE 'UNLISTED' END AS lien_type,
  CASE l_returnflag WHEN 'R' THEN 'RELEASED' WHEN 'A' THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status, CASE WHEN l_quantity > 25 THEN 'MAY_SURVIVE' ELSE 'EXTINGUISHED' END AS survival, CAST(l_quantity * 2 AS INTEGER) AS conf, l_linestatus = 'O' AS manual, l_linenumber = 6 AS foreclosing,
  CASE WHEN l_discount > 0.05 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END AS cur, CAST(l_extendedprice AS DECIMAL(14,2)) + 1 AS orig FROM lineitem"""


@query("lien_risk", f"""
WITH l AS ({_LIENS}), w AS (SELECT *, status <> 'RELEASED' AS opened, CASE lien_type WHEN 'MORTGAGE' THEN 15 WHEN 'PROPERTY_TAX' THEN 25 WHEN 'JUDGMENT' THEN 13 WHEN 'MUNICIPAL_LIEN' THEN 24 WHEN 'UCC' THEN 10 ELSE 8 END AS wt FROM l),
a AS (SELECT property_id, least(100, count(*) FILTER (WHERE opened) * 14 + count(*) * 3) AS title, least(100, coalesce(sum(round_even(wt * greatest(conf, 25) / 100.0, 0)) FILTER (WHERE opened AND survival = 'MAY_SURVIVE'), 0)) AS surv,
  least(100, coalesce(sum(wt) FILTER (WHERE opened AND lien_type IN ('PROPERTY_TAX', 'MUNICIPAL_LIEN')), 0)) AS tax, least(100, 20 * count(*) FILTER (WHERE opened AND lien_type = 'JUDGMENT')) AS judg,
  least(100, coalesce(sum(CASE WHEN foreclosing THEN 5 ELSE 18 END) FILTER (WHERE opened AND lien_type = 'MORTGAGE'), 0)) AS mort, count(*) FILTER (WHERE manual) AS man,
  coalesce(sum(CASE WHEN cur <> 0 THEN cur ELSE orig END) FILTER (WHERE opened AND survival = 'MAY_SURVIVE' AND status <> 'UNKNOWN'), 0) AS exposure, avg(conf) AS c FROM w GROUP BY property_id),
b AS (SELECT o_orderkey, coalesce(title, 0) AS title, coalesce(surv, 0) AS surv, coalesce(tax, 0) AS tax, coalesce(judg, 0) AS judg, coalesce(mort, 0) AS mort, coalesce(man, 0) AS man, coalesce(exposure, 0) AS exposure, coalesce(c, 0) AS c,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 75 WHEN o_orderkey % 3 = 1 THEN 50 ELSE 25 END AS cov, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS failed FROM orders LEFT JOIN a ON o_orderkey = property_id),
s AS (SELECT *, surv * 0.25 + tax * 0.18 + mort * 0.12 + judg * 0.1 + title * 0.1 + (100 - cov) * 0.15 + least(100, man * 12 + failed * 10) * 0.1 AS score FROM b),
t AS (SELECT *, CAST(least(100, greatest(0, round_even(round(CAST(score AS DOUBLE), 6), 0))) AS INTEGER) AS risk_score FROM s)
SELECT o_orderkey AS property_id, risk_score, CASE WHEN risk_score >= 75 THEN 'VERY_HIGH' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MODERATE' ELSE 'LOW' END AS risk_level, CAST(cov AS DOUBLE) AS completeness, CAST(surv AS DOUBLE) AS surviving_lien_risk, CAST(title AS DOUBLE) AS title_complexity_risk, CAST(tax AS DOUBLE) AS tax_municipal_risk,
  CAST(judg AS DOUBLE) AS judgment_risk, CAST(mort AS DOUBLE) AS mortgage_priority_risk, CAST(100 - cov AS DOUBLE) AS data_quality_risk, CAST(least(100, man * 12 + failed * 10) AS DOUBLE) AS manual_review_risk,
  CAST(exposure AS DECIMAL(24,2)) AS known_exposure, CAST(least(100, round_even(cov * 0.7 + c * 0.3, 0)) AS INTEGER) AS confidence_score FROM t""")
def lien_risk(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem")
    kinds = F.array(*map(F.lit, ["MORTGAGE", "PROPERTY_TAX", "JUDGMENT", "MUNICIPAL_LIEN", "UCC", "UNLISTED"]))
    liens = d.select(
        F.col("l_orderkey").alias("property_id"), F.element_at(kinds, (F.col("l_linenumber") % 6 + 1).cast("int")).alias("lien_type"),
        F.when(F.col("l_returnflag") == "R", "RELEASED").when(F.col("l_returnflag") == "A", "ACTIVE").otherwise("UNKNOWN").alias("status"),
        F.when(F.col("l_quantity") > 25, "MAY_SURVIVE").otherwise("EXTINGUISHED").alias("survival_classification"), (F.col("l_quantity") * 2).cast("int").alias("match_confidence"),
        (F.col("l_linestatus") == "O").alias("requires_manual_review"), (F.col("l_linenumber") == 6).alias("is_foreclosing_lien"),
        F.when(F.col("l_discount") > 0.05, F.lit(0).cast("decimal(14,2)")).otherwise(money("l_extendedprice")).alias("current_amount"), (money("l_extendedprice") + 1).cast("decimal(14,2)").alias("original_amount"),
    )
    o = read(spark, sf, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "property_id")
    way = F.col("property_id") % 3
    statuses = F.array(F.when(way == 0, "SUCCESS").when(way == 1, "PARTIAL").otherwise("FAILED"), F.lit("PARTIAL"))
    coverage = o.filter("property_id % 5 <> 0").select("property_id", F.explode(statuses).alias("coverage_status"))
    return scoring.lien_risk(o, liens, coverage, "property_id").select("property_id", "risk_score", "risk_level", "completeness", *scoring.COMPONENT_SHARES, "known_exposure", "confidence_score")


@query("risk_level_histogram", """
SELECT CASE WHEN p_size * 2 >= 75 THEN 'VERY_HIGH' WHEN p_size * 2 >= 50 THEN 'HIGH' WHEN p_size * 2 >= 25 THEN 'MODERATE' ELSE 'LOW' END AS level, count(*) AS n FROM part GROUP BY 1""")
def risk_level_histogram(spark: SparkSession, sf: str) -> DataFrame:
    level = scoring.risk_level(F.col("p_size") * 2)
    return read(spark, sf, "part", ["p_size"]).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("category_coverage", """
WITH r AS (SELECT n_regionkey AS region, c_mktsegment AS category, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(14,2))) AS amount FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (c_mktsegment = 'BUILDING' AND n_regionkey < 2) GROUP BY 1, 2)
SELECT r_regionkey AS region, c.category, CASE WHEN n > 0 THEN 'PARTIAL' ELSE 'NOT_CHECKED' END AS coverage_status, coalesce(n, 0) AS records_found, amount AS known_amount
FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS category FROM customer) AS c LEFT JOIN r ON r.region = r_regionkey AND r.category = c.category""")
def category_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    records = c.join(n, c.c_nationkey == n.n_nationkey).filter("NOT (c_mktsegment = 'BUILDING' AND n_regionkey < 2)").select(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("category"), money("c_acctbal").alias("amount"))
    entities = read(spark, sf, "region").select(F.col("r_regionkey").alias("region"))
    return scoring.category_coverage(entities, c.select(F.col("c_mktsegment").alias("category")).distinct(), records, "region", "category", "amount")


@query("sale_probability", """
WITH e AS (SELECT DISTINCT user_id, event_type AS s, CASE WHEN value > 80 THEN 'adjourned by defendant' WHEN value > 60 THEN 'adjourned by plaintiff' WHEN value > 55 THEN 'bankruptcy' ELSE event_type END AS r, CAST(ts AS DATE) AS d FROM events),
c AS (SELECT user_id, count(*) FILTER (WHERE r = 'adjourned by plaintiff') AS p, count(*) FILTER (WHERE r = 'adjourned by defendant') AS df, count(*) FILTER (WHERE r = 'bankruptcy') AS b, count(*) AS n FROM e GROUP BY user_id),
x AS (SELECT *, 0.40 + least(p + df, 4) * 0.07 + CASE WHEN user_id % 2 = 0 AND df >= 2 THEN 0.10 ELSE 0 END + CASE WHEN user_id % 2 = 0 AND p >= 2 THEN 0.10 ELSE 0 END + CASE WHEN user_id % 2 = 0 AND p + df >= 4 THEN 0.06 ELSE 0 END + CASE WHEN b > 0 THEN 0.04 ELSE 0 END
  + CASE WHEN user_id % 40 < 8 THEN 0.10 WHEN user_id % 40 < 15 THEN 0.07 WHEN user_id % 40 < 31 THEN 0.04 ELSE 0 END AS total FROM c)
SELECT user_id, round_even(CAST(greatest(0.10, least(total, 0.94)) AS DOUBLE), 4) AS probability, least(0.85, round_even(CAST(0.30 + least(n, 5) / 5.0 * 0.45 + 0.10 AS DOUBLE), 2)) AS confidence, total >= 0.65 AS predicted_class FROM x""")
def sale_probability(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events", ["user_id", "event_type", "value", "ts"])
    v = F.col("value")
    raw = F.when(v > 80, "adjourned by defendant").when(v > 60, "adjourned by plaintiff").when(v > 55, "bankruptcy").otherwise(F.col("event_type"))
    events = e.select("user_id", F.col("event_type").alias("status"), raw.alias("raw_status"), F.col("ts").alias("sale_date"))
    day = F.lit("2026-01-01").cast("date")
    sales = e.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, "NJ").otherwise("PA").alias("state"), F.date_add(day, (F.col("user_id") % 40).cast("int")).cast("timestamp").alias("sale_date"))
    return scoring.sale_probability(sales, events, "user_id", day).select("user_id", "probability", "confidence", "predicted_class")


@query("avm_eligibility", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS sale_date, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14,2)) END AS price, CAST(CASE WHEN o_custkey % 17 = 0 THEN 0 ELSE o_custkey * 100 END AS DECIMAL(14,2)) AS assessed FROM orders),
f AS (SELECT *, price / nullif(assessed, 0) AS ratio FROM d)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN sale_date IS NULL THEN 'missing_sale_date' END, CASE WHEN sale_date < DATE '1994-01-01' THEN 'outside_five_year_window' END, CASE WHEN sale_date > DATE '1997-12-31' THEN 'sale_after_dataset_as_of' END, CASE WHEN price IS NULL THEN 'missing_sale_price' END,
  CASE WHEN price < 10000 THEN 'nominal_or_low_value_transfer' END, CASE WHEN price > 2000000 THEN 'sale_price_above_baseline_cap' END, CASE WHEN assessed IS NULL OR assessed <= 0 THEN 'missing_or_nonpositive_assessment' END, CASE WHEN price >= 10000 AND assessed > 0 AND ratio NOT BETWEEN 0.1 AND 10 THEN 'sale_to_assessment_ratio_outlier' END], lambda x: x IS NOT NULL), ',') AS reasons,
  coalesce(sale_date BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' AND price BETWEEN 10000 AND 2000000 AND assessed > 0 AND ratio BETWEEN 0.1 AND 10, FALSE) AS eligible FROM f""")
def avm_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    d = o.select(
        "o_orderkey", F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("sale_date"), F.when(k % 13 != 0, money("o_totalprice")).alias("sale_price"), money(F.when(F.col("o_custkey") % 17 == 0, 0).otherwise(F.col("o_custkey") * 100)).alias("assessed_value"),
        F.lit(1.0).alias("acreage"), F.lit("x").alias("property_type"), F.lit("x").alias("land_use_code"), F.lit("x").alias("property_location"),
    )
    flags = valuation.baseline_flags(F.lit("1997-12-31").cast("date"), F.lit("1994-01-01").cast("date"))
    return d.select("o_orderkey", F.array_join(flags["exclusion_reasons"], ",").alias("reasons"), flags["eligible_for_baseline"].alias("eligible"))


@query("centroid", """
SELECT vec_id, round(40 + x * 0.25 + 0.5, 7) AS latitude, round(-74 + y * 0.25 + 0.25, 7) AS longitude FROM (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) AS x, round(CAST(embedding[2] AS DOUBLE), 4) AS y FROM embeddings)""")
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings", ["vec_id", "embedding"])
    lat, lon = 40 + F.round(F.col("embedding")[0].cast("double"), 4) * 0.25, -74 + F.round(F.col("embedding")[1].cast("double"), 4) * 0.25
    corner = lambda a, b: F.array(lon + a, lat + b)
    ring = F.array(corner(0.0, 0.0), corner(0.5, 0.0), corner(0.5, 1.0), corner(0.0, 1.0), corner(0.0, 0.0))
    c = V.centroid(F.array(ring))
    return e.select("vec_id", c["latitude"].alias("latitude"), c["longitude"].alias("longitude"))


@query("valuation_status", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'VALUED' WHEN o_orderkey % 5 = 1 AND o_custkey % 2 = 0 THEN 'MODEL_SCORING_REQUIRED' WHEN o_orderkey % 5 = 1 THEN 'PARCEL_MATCH_REQUIRED' WHEN o_orderkey % 5 = 2 THEN 'COUNTY_MODEL_UNAVAILABLE'
  WHEN o_custkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'PARCEL_MATCH_UNDER_REVIEW' WHEN o_custkey % 3 = 0 THEN 'PARCEL_MATCH_REQUIRED' WHEN o_custkey % 100 < 90 THEN 'MANUAL_REVIEW_REQUIRED' WHEN o_orderstatus <> 'O' THEN 'PROPERTY_TYPE_MODEL_UNAVAILABLE' ELSE 'MODEL_SCORING_REQUIRED' END AS status FROM orders""")
def valuation_status(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    status = valuation.valuation_status(
        k == 0, F.when(k == 1, "PA").otherwise("NJ"), F.when(k == 1, "Monroe").when(k == 2, "Ocean").otherwise("Monmouth"), c % 2 == 0, c % 3 != 0, c % 2 == 0, c % 100, F.when(F.col("o_orderstatus") == "O", " 2 ").otherwise("4A")
    )
    return read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).select("o_orderkey", status.alias("status"))


@query("train_score")  # gradient-boosted trees: no SQL; tests hold their error against a baseline
def train_score(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    lines = read(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice"]).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("extended"))
    d = o.join(c, o.o_custkey == c.c_custkey).join(lines, o.o_orderkey == lines.l_orderkey).select("o_orderkey", F.year("o_orderdate").alias("sale_year"), F.log1p("o_totalprice").alias("label"), "quantity", "extended", "c_mktsegment", F.col("o_totalprice").alias("price"))
    last = d.agg(F.max("sale_year")).first()[0] - 2
    train, _, test = valuation.split_by_year(d, "sale_year", last)
    fitted = valuation.model(["quantity", "extended"], ["c_mktsegment"], "label", trees=10, depth=4).fit(train)
    scored = fitted.transform(test).withColumn("prediction", F.expm1("prediction"))
    mae = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("price")))).first()[0]
    out = valuation.valuations(scored.withColumn("living_area_imputed", F.lit(False)).withColumn("local_comp_count", F.lit(5)), mae)
    return out.select("o_orderkey", "estimated_value", "low_value", "high_value", "confidence_score")


_LISTING_SQL = """
WITH ss AS (SELECT o_orderkey AS sale_id, o_custkey AS property_id, CASE o_orderstatus WHEN 'O' THEN 'scheduled' ELSE 'sold' END AS current_status, o_orderdate AS current_sale_date, CAST(o_totalprice AS DECIMAL(14,2)) - 700 AS est, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14,2)) - 500 END AS alt, CAST(o_totalprice AS DECIMAL(14,2)) - 900 AS upset,
  CASE WHEN o_orderkey % 2 = 0 THEN 'D-' || CAST(o_orderkey AS VARCHAR) ELSE 'C-' || CAST(o_orderkey AS VARCHAR) END AS court_case_number, 'Bank ' || o_orderstatus AS plaintiff, greatest(CAST(o_totalprice AS DECIMAL(14,2)) - 700, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14,2)) - 500 END, CAST(o_totalprice AS DECIMAL(14,2)) - 900) AS up, CAST(o_totalprice AS DECIMAL(14,2)) AS judgment_amount FROM orders),
p AS (SELECT c_custkey AS property_id, c_name AS normalized_address, CASE WHEN c_nationkey % 2 = 0 THEN 'NJ' ELSE 'PA' END AS state, CASE c_mktsegment WHEN 'BUILDING' THEN 'Monmouth' WHEN 'AUTOMOBILE' THEN 'Monmouth' WHEN 'MACHINERY' THEN 'Monroe' ELSE c_mktsegment END AS county, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 900 END AS square_feet FROM customer),
l AS (SELECT o_custkey AS property_id, l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber AS lien_id, CASE WHEN l_discount > 0.08 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END AS amount, l_returnflag <> 'R' AS opened, l_quantity > 40 AS surv, l_linestatus = 'F' AS man,
  CASE WHEN l_linenumber = 1 THEN 'PROPERTY_TAX' ELSE 'MORTGAGE' END AS lien_type, CASE WHEN l_linenumber > 3 THEN 'Holder ' || CAST(l_suppkey AS VARCHAR) WHEN l_linenumber = 1 THEN 'Municipal/utility authority not specified' ELSE 'Claimant not specified' END AS holder,
  CASE WHEN l_linenumber = 2 THEN 'PRIMARY_FORECLOSING' WHEN l_returnflag = 'A' THEN 'POTENTIALLY_SENIOR' WHEN l_returnflag = 'R' THEN 'SECONDARY_JUNIOR' ELSE 'PRIORITY_UNKNOWN' END AS position FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lt AS (SELECT property_id, sum(amount) FILTER (WHERE opened) AS total_lien_amount, count(*) AS n, count(*) FILTER (WHERE opened) AS n_open, count(*) FILTER (WHERE surv) AS n_surv, count(*) FILTER (WHERE man) AS n_man,
  string_agg(CAST(lien_id AS VARCHAR) || '|' || holder || '|' || coalesce(CAST(amount AS VARCHAR), '') || '|' || lien_type || '|' || CASE WHEN opened THEN 'ACTIVE' ELSE 'RELEASED' END || '|' || position, ';' ORDER BY amount DESC NULLS LAST, lien_type, lien_id) AS items FROM l GROUP BY property_id),
pv AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY retrieved_at DESC, valuation_id DESC) AS rn FROM (SELECT o_custkey AS property_id, o_orderkey AS valuation_id, o_orderdate AS retrieved_at, CAST(o_totalprice AS DECIMAL(14,2)) AS v, o_orderkey % 90 AS conf, o_orderstatus AS provider FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 <> 0)),
f AS (SELECT c_custkey AS property_id, 80 + c_custkey % 21 AS conf, CASE WHEN c_custkey % 7 = 0 THEN '4A' WHEN c_custkey % 7 = 1 THEN NULL ELSE ' 2 ' END AS cls, c_custkey AS lot FROM customer WHERE c_custkey % 5 <> 0),
spl AS (SELECT lot, CASE WHEN last_key % 2 = 0 THEN last_key % 3000 END AS living FROM (SELECT o_custkey AS lot, arg_max(o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) * 100000000 + o_orderkey) AS last_key FROM orders GROUP BY o_custkey)),
pr AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber DESC) AS rn FROM lineitem WHERE l_linenumber > 1),
ra AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber DESC) AS rn FROM lineitem WHERE l_quantity < 45),
rp AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT ss.*, p.normalized_address, p.state, p.county, pv.v AS market_value, pv.v - 5 AS market_value_low, pv.v + 5 AS market_value_high, pv.provider AS valuation_provider, pv.conf AS valuation_confidence, pv.retrieved_at AS valuation_retrieved_at, f.conf AS parcel_match_confidence,
  CASE WHEN pv.valuation_id IS NOT NULL THEN 1 WHEN state = 'PA' AND county = 'Monroe' AND sale_id % 2 = 1 THEN 2 WHEN state = 'PA' AND county = 'Monroe' THEN 3 WHEN state <> 'NJ' OR county <> 'Monmouth' THEN 4 WHEN f.property_id IS NULL AND p.property_id % 2 = 0 THEN 5 WHEN f.property_id IS NULL THEN 6 WHEN f.conf < 90 THEN 7 WHEN trim(coalesce(f.cls, '')) <> '2' THEN 8 WHEN coalesce(p.square_feet, spl.living) IS NULL THEN 9 ELSE 10 END AS gap,
  pr.l_discount AS sale_probability, CAST(ra.l_quantity AS INTEGER) AS risk_score, ra.l_linestatus AS risk_level, CAST(rp.o_orderkey % 100 AS INTEGER) AS lien_risk_score, rp.o_orderpriority AS lien_risk_level, rp.o_orderdate AS lien_risk_calculated_at, CAST(rp.o_totalprice AS DECIMAL(14,2)) AS known_lien_exposure,
  lt.total_lien_amount, coalesce(lt.n, 0) AS lien_record_count, coalesce(lt.n_open, 0) AS open_lien_count, coalesce(lt.n_surv, 0) AS surviving_count, coalesce(lt.n_man, 0) AS manual_count, coalesce(lt.items, '') AS lien_items
  FROM ss JOIN p ON ss.property_id = p.property_id LEFT JOIN pv ON pv.property_id = p.property_id AND pv.rn = 1 LEFT JOIN f ON f.property_id = p.property_id LEFT JOIN spl ON spl.lot = f.lot LEFT JOIN pr ON pr.l_orderkey = sale_id AND pr.rn = 1 LEFT JOIN ra ON ra.l_orderkey = sale_id AND ra.rn = 1 LEFT JOIN rp ON rp.o_custkey = p.property_id AND rp.rn = 1 LEFT JOIN lt ON lt.property_id = p.property_id)
SELECT sale_id, property_id, normalized_address, state, county, court_case_number, plaintiff, current_status, current_sale_date, judgment_amount, up AS upset_price, market_value, market_value_low, market_value_high, valuation_provider, valuation_confidence, valuation_retrieved_at, CAST(parcel_match_confidence AS INTEGER) AS parcel_match_confidence,
  list_extract(['VALUED', 'MODEL_SCORING_REQUIRED', 'PARCEL_MATCH_REQUIRED', 'COUNTY_MODEL_UNAVAILABLE', 'PARCEL_MATCH_UNDER_REVIEW', 'PARCEL_MATCH_REQUIRED', 'MANUAL_REVIEW_REQUIRED', 'PROPERTY_TYPE_MODEL_UNAVAILABLE', 'MODEL_SCORING_REQUIRED', 'MODEL_SCORING_REQUIRED'], gap) AS valuation_status,
  list_extract([NULL, 'Property has official KIZ details and is ready for experimental Monroe scoring.', 'The official KIZ crosswalk does not cover this parcel; no AVM estimate was fabricated.', 'A validated valuation model is not available for this county.', 'Parcel candidates require identity review.', 'A reliable parcel match has not been identified.', 'The parcel match requires manual review.', 'The current local model is validated only for residential class-2 property.', 'Ready for lower-confidence model scoring with imputed living area.', 'Property is ready for local model scoring.'], gap) AS valuation_pending_reason,
  market_value - up AS gross_equity, CASE WHEN market_value > 0 THEN round(CAST(market_value - up AS DOUBLE) / CAST(market_value AS DOUBLE), 4) END AS gross_equity_percent, sale_probability, risk_score, risk_level, lien_risk_score, lien_risk_level, lien_risk_calculated_at, known_lien_exposure, total_lien_amount, lien_record_count, open_lien_count, surviving_count, manual_count, lien_items
FROM j"""
_PAGE_SQL = _LISTING_SQL + """
WHERE state = 'NJ' AND current_status = 'scheduled' AND market_value - up >= 1000 ORDER BY current_sale_date ASC NULLS LAST, normalized_address ASC NULLS LAST, sale_id LIMIT 50 OFFSET 50"""


def _listing_tables(spark: SparkSession, sf: str) -> listing.ListingTables:
    o, c, i = read(spark, sf, "orders"), read(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]), read(spark, sf, "lineitem")
    price, k, owner = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    sales = o.select(
        k.alias("sale_id"), owner.alias("property_id"), F.when(F.col("o_orderstatus") == "O", "scheduled").otherwise("sold").alias("current_status"), F.col("o_orderdate").alias("current_sale_date"), F.when(k % 2 == 0, F.concat(F.lit("D-"), text(k))).alias("docket_number"),
        F.concat(F.lit("C-"), text(k)).alias("court_case_number"), F.concat(F.lit("Bank "), "o_orderstatus").alias("plaintiff"), money(price).alias("judgment_amount"), (money(price) - 700).alias("estimated_upset_price"), F.when(k % 3 != 0, money(price) - 500).alias("alternate_upset_price"), (money(price) - 900).alias("upset_price"),
    )
    segment = F.col("c_mktsegment")
    county = F.when(segment.isin("BUILDING", "AUTOMOBILE"), "Monmouth").when(segment == "MACHINERY", "Monroe").otherwise(segment)
    properties = c.select(F.col("c_custkey").alias("property_id"), F.col("c_name").alias("normalized_address"), F.when(F.col("c_nationkey") % 2 == 0, "NJ").otherwise("PA").alias("state"), county.alias("county"), none("string").alias("zip_code"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 900).alias("square_feet"))
    valuations = o.filter("o_custkey % 3 <> 0").select(
        owner.alias("property_id"), k.alias("valuation_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_current"), F.col("o_orderdate").alias("retrieved_at"), money(price).alias("estimated_value"), (money(price) - 5).alias("low_value"), (money(price) + 5).alias("high_value"), F.col("o_orderstatus").alias("provider"), (k % 90).alias("confidence_score"),
    )
    priority = F.when(F.col("l_returnflag") == "A", "SENIOR_LIEN").when(F.col("l_returnflag") == "R", "JUNIOR_LIEN").otherwise("NONE")
    number, line = F.col("l_linenumber"), F.col("l_partkey") * 1000 + F.col("l_suppkey") % 100 * 10 + F.col("l_linenumber")
    liens = i.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == k).select(
        owner.alias("property_id"), line.alias("lien_id"), F.when(F.col("l_discount") <= 0.08, money("l_extendedprice")).alias("current_amount"), none("decimal(14,2)").alias("original_amount"), F.when(F.col("l_returnflag") == "R", "RELEASED").otherwise("ACTIVE").alias("status"),
        F.when(F.col("l_quantity") > 40, "MAY_SURVIVE").otherwise("NONE").alias("survival_classification"), (F.col("l_linestatus") == "F").alias("requires_manual_review"), F.when(number == 1, "PROPERTY_TAX").otherwise("MORTGAGE").alias("lien_type"), none("string").alias("lien_subtype"),
        F.when(number > 3, F.concat(F.lit("Holder "), text(F.col("l_suppkey")))).alias("creditor_name"), (number == 2).alias("is_foreclosing_lien"), priority.alias("priority_classification"), none("double").alias("priority_confidence"),
    )
    place = [F.col("c_custkey").alias("lot"), F.lit("1301").alias("municipality_code"), F.lit("1").alias("block")]
    features = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("property_id"), *place, (F.col("c_custkey") % 21 + 80).cast("int").alias("match_confidence"), F.when(F.col("c_custkey") % 7 == 0, "4A").when(F.col("c_custkey") % 7 != 1, " 2 ").alias("property_class"))
    training = o.select(owner.alias("lot"), *place[1:], F.col("o_orderdate").alias("deed_date"), k.alias("training_id"), F.when(k % 2 == 0, k % 3000).alias("living_space"))
    score = lambda **more: i.select(F.col("l_orderkey").alias("sale_id"), F.col("l_shipdate").alias("at_"), line.alias("line_"), *(x.alias(n) for n, x in more.items()))
    predictions = score(probability=F.col("l_discount"), feature_values=none("string"), prediction_target=F.when(number > 1, "reaches_auction").otherwise("other")).withColumnsRenamed({"at_": "predicted_at", "line_": "prediction_id"})
    assessments = score(risk_score=F.col("l_quantity").cast("int"), risk_level=F.col("l_linestatus"), quantity=F.col("l_quantity")).filter("quantity < 45").withColumnsRenamed({"at_": "calculated_at", "line_": "assessment_id"})
    reports = o.filter("o_orderstatus = 'F'").select(owner.alias("property_id"), k.alias("report_id"), F.col("o_orderdate").alias("calculated_at"), (k % 100).cast("int").alias("risk_score"), F.col("o_orderpriority").alias("risk_level"), none("double").alias("confidence_score"), money(price).alias("known_exposure"))
    candidates = c.select(F.col("c_custkey").alias("property_id"), F.when(F.col("c_custkey") % 2 == 0, "PENDING").otherwise("REJECTED").alias("review_status"))
    return listing.ListingTables(sales, properties, valuations, liens, features, training, o.filter("o_orderkey % 2 = 1").select(k.alias("sale_id")), candidates, predictions, assessments, reports)


def _listing_columns(d: DataFrame) -> DataFrame:
    share = F.round(F.col("gross_equity_percent").cast("double"), 4)
    items = F.transform("lien_items", lambda x: F.concat_ws("|", x["lien_id"].cast("string"), x["holder"], F.coalesce(x["amount"].cast("string"), F.lit("")), x["lien_type"], x["status"], x["position"]))
    plain = ["sale_id", "property_id", "normalized_address", "state", "county", "court_case_number", "plaintiff", "current_status", "current_sale_date", "judgment_amount", "upset_price", "market_value", "market_value_low", "market_value_high", "valuation_provider", "valuation_confidence", "valuation_retrieved_at", "parcel_match_confidence", "valuation_status", "valuation_pending_reason", "gross_equity"]
    more = ["sale_probability", "risk_score", "risk_level", "lien_risk_score", "lien_risk_level", "lien_risk_calculated_at", "known_lien_exposure", "total_lien_amount", "lien_record_count", "open_lien_count"]
    return d.select(*plain, share.alias("gross_equity_percent"), *more, F.col("potentially_surviving_count").alias("surviving_count"), F.col("manual_review_count").alias("manual_count"), F.coalesce(F.array_join(items, ";"), F.lit("")).alias("lien_items"))


@query("flagship_listing", _PAGE_SQL)
def flagship_listing(spark: SparkSession, sf: str) -> DataFrame:
    filters = listing.ListingFilters(states=["nj"], status="scheduled", min_equity=1000)
    return _listing_columns(listing.page_of_listing(_listing_tables(spark, sf), filters, date(2000, 1, 1), 2, 50))


@query("listing_rows", _LISTING_SQL)
def listing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _listing_columns(listing.listing(_listing_tables(spark, sf), listing.ListingFilters(), date(2000, 1, 1)))


@query("lien_item_lists", """
SELECT l_orderkey AS property_id, string_agg(CAST(l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber AS VARCHAR) || ':' || CASE WHEN l_linenumber = 1 THEN 'PRIMARY_FORECLOSING' WHEN l_returnflag = 'A' THEN 'POTENTIALLY_SENIOR' WHEN l_returnflag = 'R' THEN 'SECONDARY_JUNIOR' ELSE 'PRIORITY_UNKNOWN' END, ',' ORDER BY CASE WHEN l_discount > 0.05 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END DESC NULLS LAST, l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber) AS items
FROM lineitem GROUP BY l_orderkey""")
def lien_item_lists(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem")
    priority = F.when(F.col("l_returnflag") == "A", "SENIOR_LIEN").when(F.col("l_returnflag") == "R", "JUNIOR_LIEN").otherwise("NONE")
    liens = d.select(
        F.col("l_orderkey").alias("property_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 100 * 10 + F.col("l_linenumber")).alias("lien_id"), F.lit("X").alias("lien_type"), F.lit(None).cast("string").alias("lien_subtype"), F.lit(None).cast("double").alias("priority_confidence"), F.when(F.col("l_discount") <= 0.05, money("l_extendedprice")).alias("current_amount"), F.lit(None).cast("decimal(14,2)").alias("original_amount"),
        F.lit(None).cast("string").alias("creditor_name"), F.lit("ACTIVE").alias("status"), (F.col("l_linenumber") == 1).alias("is_foreclosing_lien"), priority.alias("priority_classification"),
    )
    text = F.transform("lien_items", lambda x: F.concat_ws(":", x["lien_id"].cast("string"), x["position"]))
    return listing.lien_items(liens).select("property_id", F.array_join(text, ",").alias("items"))


@query("conversation_lists", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id""")
def conversation_lists(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations", ["conv_id", "turn", "role"])
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(R.ordered_list([F.col("turn"), F.col("role")], F.col("role")), ">").alias("roles"))


@query("multi_parcel_sum", """
SELECT l_orderkey, sum(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END, 0)) AS improvement_total, arg_max(l_linenumber, l_extendedprice * 100 - l_linenumber / 100.0) AS primary_line FROM lineitem GROUP BY l_orderkey""")
def multi_parcel_sum(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    value = F.when(F.col("l_linenumber") % 3 != 0, money("l_extendedprice"))
    return d.groupBy("l_orderkey").agg(F.sum(F.coalesce(value, F.lit(0).cast("decimal(14,2)"))).alias("improvement_total"), F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("primary_line"))


@query("session_counts", """
SELECT user_id, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR date_diff('second', prev, ts) > 86400 GROUP BY user_id""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events", ["event_id", "user_id", "ts"])
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.withColumn("gap", gap).filter("gap IS NULL OR gap > 86400").groupBy("user_id").agg(F.count("*").alias("sessions"))
