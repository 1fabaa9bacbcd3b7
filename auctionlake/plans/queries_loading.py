"""Loading, accepting, screening and serving on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.domain import liens, listing, loading, valuation
from auctionlake.plans.catalog import query
from auctionlake.plans.common import money, read
from auctionlake.sources import files, pages, providers


@query("load_sales", """
WITH old AS (SELECT 'NJ' AS state, 'M' AS county, o_orderkey AS sheriff_number, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(14,2)) AS judgment_amount, CAST(o_totalprice AS DECIMAL(14,2)) AS upset_price, CAST(NULL AS DECIMAL(14,2)) AS estimated_upset_price, o_orderstatus AS current_status FROM orders WHERE o_orderkey % 4 <> 1),
new AS (SELECT 'NJ' AS state, 'M' AS county, o_orderkey AS sheriff_number, CAST(o_totalprice AS DECIMAL(14,2)) + 5 AS judgment_amount, CAST(o_totalprice AS DECIMAL(14,2)) - 100 AS upset_price, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) + 100 END AS estimated_upset_price, 'N' AS current_status FROM orders WHERE o_orderkey % 4 <> 2)
SELECT coalesce(old.state, new.state) AS state, coalesce(old.county, new.county) AS county, coalesce(old.sheriff_number, new.sheriff_number) AS sheriff_number, coalesce(old.judgment_amount, new.judgment_amount) AS judgment_amount,
  CASE WHEN old.state IS NULL THEN new.upset_price ELSE greatest(old.upset_price, new.upset_price, new.estimated_upset_price) END AS upset_price, CASE WHEN new.state IS NULL THEN old.estimated_upset_price ELSE new.estimated_upset_price END AS estimated_upset_price, coalesce(new.current_status, old.current_status) AS current_status
FROM old FULL JOIN new ON old.sheriff_number = new.sheriff_number""")
def load_sales(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k, p = F.col("o_orderkey"), money("o_totalprice")
    key = [F.lit("NJ").alias("state"), F.lit("M").alias("county"), k.alias("sheriff_number")]
    cut = lambda c: c.cast("decimal(14,2)")
    old = o.filter(k % 4 != 1).select(*key, F.when(k % 3 != 0, p).alias("judgment_amount"), p.alias("upset_price"), F.lit(None).cast("decimal(14,2)").alias("estimated_upset_price"), F.col("o_orderstatus").alias("current_status"))
    new = o.filter(k % 4 != 2).select(*key, cut(p + 5).alias("judgment_amount"), cut(p - 100).alias("upset_price"), F.when(k % 2 == 0, cut(p + 100)).alias("estimated_upset_price"), F.lit("N").alias("current_status"))
    return loading.load_sales(old, new)


@query("status_history_append", """
WITH sale AS (SELECT o_orderkey AS sale_id, o_orderstatus AS status, o_orderdate AS sale_date FROM orders WHERE o_orderkey % 5 <> 0),
inc AS (SELECT o_orderkey AS sale_id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, 'raw' AS raw_status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS sale_date FROM orders)
SELECT inc.* FROM inc LEFT JOIN sale ON inc.sale_id = sale.sale_id WHERE sale.sale_id IS NULL OR inc.status IS DISTINCT FROM sale.status OR inc.sale_date IS DISTINCT FROM sale.sale_date""")
def status_history_append(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    k = F.col("o_orderkey")
    sales = o.filter(k % 5 != 0).select(k.alias("sale_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("sale_date"))
    incoming = o.select(k.alias("sale_id"), F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.lit("raw").alias("raw_status"), F.when(k % 7 != 0, F.col("o_orderdate")).alias("sale_date"))
    seen = incoming.filter("sale_id % 11 = 0")
    return loading.status_events(sales, incoming, seen, seen)


@query("parcel_seen_range", """
WITH old AS (SELECT c_nationkey AS municipality_code, c_custkey AS lot, 1994 AS first_seen, 1995 AS last_seen, 'old' AS addr FROM customer WHERE c_custkey % 2 = 0),
new AS (SELECT c_nationkey AS municipality_code, c_custkey AS lot, CAST(min(year(o_orderdate)) AS INTEGER) AS first_seen, CAST(max(year(o_orderdate)) AS INTEGER) AS last_seen, CAST(max(year(o_orderdate)) AS VARCHAR) AS addr FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT coalesce(old.municipality_code, new.municipality_code) AS municipality_code, coalesce(old.lot, new.lot) AS lot, least(old.first_seen, new.first_seen) AS first_seen, greatest(old.last_seen, new.last_seen) AS last_seen, coalesce(new.addr, old.addr) AS current_address FROM old FULL JOIN new ON old.lot = new.lot""")
def parcel_seen_range(spark: SparkSession, sf: str) -> DataFrame:
    c, o = read(spark, sf, "customer", ["c_custkey", "c_nationkey"]), read(spark, sf, "orders", ["o_custkey", "o_orderdate"])
    key = [F.lit("NJ").alias("state"), F.col("c_nationkey").alias("municipality_code"), F.lit("1").alias("block"), F.col("c_custkey").alias("lot"), F.lit("").alias("qualifier")]
    old = c.filter("c_custkey % 2 = 0").select(*key, F.lit(1994).alias("first_seen"), F.lit(1995).alias("last_seen"), F.lit("old").alias("current_address"))
    staged = o.join(c, o.o_custkey == c.c_custkey).select(*key, F.year("o_orderdate").alias("source_year"), F.year("o_orderdate").cast("string").alias("current_address"))
    return loading.upsert_parcels(old, staged).select("municipality_code", "lot", "first_seen", "last_seen", "current_address")


_MATCHES = """SELECT l_orderkey AS sale_id, l_suppkey * 100000 + l_partkey * 10 + l_linenumber AS parcel_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS imp, l_linenumber AS pos FROM lineitem"""


@query("accept_fanout", f"""
WITH m AS ({_MATCHES}), r AS (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY imp DESC, pos, parcel_id) AS rk FROM m)
SELECT sale_id, parcel_id, CASE WHEN rk = 1 THEN 'PRIMARY' ELSE 'ADDITIONAL' END AS relationship, 'VERIFIED' AS match_status, CAST(CASE WHEN rk = 1 THEN 100 ELSE 95 END AS INTEGER) AS match_score FROM r""")
def accept_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return loading.accept_matches(_matches(spark, sf), "v1")["links"]


@query("accept_features", f"""
WITH m AS ({_MATCHES}) SELECT sale_id AS property_id, sum(imp) AS improvement_assessed, CAST(CASE WHEN count(*) > 1 THEN 95 ELSE 100 END AS INTEGER) AS match_confidence FROM m GROUP BY sale_id""")
def accept_features(spark: SparkSession, sf: str) -> DataFrame:
    return loading.accept_matches(_matches(spark, sf), "v1")["features"].select("property_id", "improvement_assessed", "match_confidence")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem", ["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice"])
    zero = F.lit(None).cast("decimal(14,2)")
    return d.select(
        F.col("l_orderkey").alias("sale_id"), F.col("l_orderkey").alias("property_id"), (F.col("l_suppkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("parcel_id"), F.col("l_linenumber").alias("position"),
        F.lit("1308").alias("municipality_code"), F.col("l_suppkey").cast("string").alias("block"), F.col("l_partkey").cast("string").alias("lot"), F.lit("").alias("qualifier"), money("l_extendedprice").alias("improvement_assessed"),
        *[zero.alias(c) for c in ("acreage", "land_assessed", "total_assessed", "annual_property_tax")],
    )


@query("reject_pending", """
SELECT doc_id, CASE WHEN toxic = 0 AND doc_id % 4 = 0 THEN 'REJECTED' WHEN toxic = 1 THEN 'APPROVED' ELSE 'PENDING' END AS review_status FROM labels""")
def reject_pending(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "APPROVED").otherwise("PENDING").alias("review_status"))
    return loading.reject_pending(c, c.filter("doc_id % 4 = 0"), "doc_id")


@query("alias_backfill", """
SELECT lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS normalized_alias, min(CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE c_custkey % 2 END) AS jurisdiction_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE c_custkey % 2 END) = 1""")
def alias_backfill(spark: SparkSession, sf: str) -> DataFrame:
    c, n = read(spark, sf, "customer", ["c_custkey", "c_nationkey"]), read(spark, sf, "nation")
    return loading.aliases_from_matches(c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("city"), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).otherwise(F.col("c_custkey") % 2).cast("long").alias("jurisdiction_id")))


@query("confidence_rescale", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 25 BETWEEN 0 AND 1 THEN l_quantity / 25 * 100 ELSE l_quantity / 25 END AS confidence FROM lineitem")
def confidence_rescale(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return loading.rescale_confidence(d.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 25).alias("confidence")), "confidence")


@query("run_log", """
SELECT 'orders' AS job_name, CASE WHEN count(*) FILTER (WHERE o_totalprice < 1000) > 0 THEN 'partially_completed' ELSE 'completed' END AS status, count(*) AS records_found, count(*) FILTER (WHERE o_orderstatus = 'O') AS records_created, count(*) FILTER (WHERE o_orderstatus <> 'O') AS records_updated, count(*) FILTER (WHERE o_totalprice < 1000) AS records_failed FROM orders""")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderstatus", "o_totalprice"])
    return loading.run_log("orders", o, o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus <> 'O'"), o.filter("o_totalprice < 1000"))


@query("lien_refresh", """
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey AS property_id, 'SEWER_CHARGE' AS lien_subtype, CAST(o_orderkey % 500 + 1 AS DECIMAL(14,2)) AS current_amount FROM s WHERE rn = 1 AND o_orderkey % 3 = 0
UNION ALL SELECT o_custkey, 'DISCLOSED_CURRENT_THROUGH_DATE', NULL FROM s WHERE rn = 1 AND o_orderkey % 3 = 1
UNION ALL SELECT c_custkey, 'OLD', 7.00 FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey NOT IN (SELECT o_custkey FROM s) OR c_custkey IN (SELECT o_custkey FROM s WHERE rn = 1 AND o_orderkey % 6 = 5))""")
def lien_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return _refreshed(spark, sf)["liens"].select("property_id", "lien_subtype", "current_amount")


@query("lien_category_table", """
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders), r AS (SELECT * FROM s WHERE rn = 1 AND o_orderkey % 6 <> 5)
SELECT o_custkey AS property_id, 'WATER_SEWER' AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'PARTIAL' ELSE 'NOT_CHECKED' END AS status, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS record_count, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 500 + 1 END AS DECIMAL(24,2)) AS quantified_amount FROM r
UNION ALL SELECT o_custkey, 'UNPAID_PROPERTY_TAX', CASE WHEN o_orderkey % 3 = 1 THEN 'PARTIAL' ELSE 'MANUAL_REVIEW_REQUIRED' END, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT), NULL FROM r
UNION ALL SELECT o_custkey, 'CHILD_SUPPORT', 'SOURCE_UNAVAILABLE', 0, NULL FROM r""")
def lien_category_table(spark: SparkSession, sf: str) -> DataFrame:
    return _refreshed(spark, sf)["coverage"].filter("category IN ('WATER_SEWER', 'UNPAID_PROPERTY_TAX', 'CHILD_SUPPORT')")


def _refreshed(spark: SparkSession, sf: str):
    o, c = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]), read(spark, sf, "customer", ["c_custkey"])
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 5, "").when(k % 3 == 0, F.concat(F.lit("Sewer balance $"), (k % 500 + 1).cast("string"), F.lit(" due."))).when(k % 3 == 1, "Taxes current through June.").otherwise("nothing")
    sales = o.select(F.col("o_custkey").alias("property_id"), k.alias("sale_id"), F.col("o_orderdate").alias("sale_date"), text.alias("description_text"))
    old = c.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("property_id"), F.lit(liens.SOURCE).alias("source_name"), F.lit("OTHER").alias("lien_type"), F.lit("OLD").alias("lien_subtype"), F.lit("ACTIVE").alias("status"), F.lit(7).cast("decimal(14,2)").alias("current_amount"),
        F.lit(False).alias("is_foreclosing_lien"), F.lit(50).alias("match_confidence"), F.lit("UNKNOWN").alias("priority_classification"), F.lit(0).alias("priority_confidence"), F.lit("UNKNOWN").alias("survival_classification"), F.lit(0).alias("survival_confidence"),
        F.lit(None).cast("decimal(14,2)").alias("original_amount"), F.lit(False).alias("requires_manual_review"),
    )
    return liens.refresh(sales, c.withColumnRenamed("c_custkey", "property_id"), old)


@query("provider_responses", """
SELECT c_custkey, CAST(c_acctbal AS DECIMAL(14,2)) AS estimated_value, c_custkey % 2 = 0 AS same_subject FROM customer WHERE c_custkey % 5 <> 0""")
def provider_responses(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    street = F.concat(F.col("c_custkey").cast("string"), F.lit(" Ocean Avenue"))
    subject = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.upper(F.replace(street, F.lit("Avenue"), F.lit("Ave.")))).otherwise("1 Else").alias("addressLine1"), F.lower("c_mktsegment").alias("city"), F.lit("nj").alias("state"), F.lit("07712").alias("zipCode"))
    response = F.to_json(F.struct(F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("price"), subject.alias("subjectProperty")))
    good, _ = providers.SavedResponses().valuations(c.select("c_custkey", street.alias("street"), "c_mktsegment", response.alias("response")))
    same = providers.subject_matches(F.col("street"), F.col("c_mktsegment"), F.lit("NJ"), F.lit("07712"), (F.col("address_line_1"), F.col("found_city"), F.col("found_state"), F.col("found_zip")))
    return good.select("c_custkey", "estimated_value", same.alias("same_subject"))


@query("lookup_gate", """
SELECT CASE WHEN p_size < 20 THEN 'quality too low' WHEN p_partkey % 3 = 0 THEN 'unit needs a manual match' END AS reason, count(*) AS n FROM part GROUP BY 1""")
def lookup_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_size"]).select(F.col("p_partkey").alias("property_id"), (F.col("p_size") + 60).alias("data_quality_score"), F.when(F.col("p_partkey") % 3 == 0, "2B").alias("unit_number"))
    good, bad = providers.lookup_gate(p)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


@query("county_codes", """
SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 1 AND 21 THEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS by_number, '13' AS by_name FROM nation""")
def county_codes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", files.county_code(F.col("n_nationkey").cast("string")).alias("by_number"), files.county_code(F.lit(" monmouth ")).alias("by_name"))


@query("assessment_attributes", """
SELECT CAST(p_partkey AS VARCHAR) AS map_number, CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS DECIMAL(14,2)) END AS assessed_value, DATE '2003-02-06' AS last_sale_date FROM part WHERE p_partkey % 7 <> 0""")
def assessment_attributes(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_size", "p_retailprice"])
    a = p.select(F.col("p_partkey").cast("string").alias("MAPNUMBER"), F.when(F.col("p_partkey") % 7 != 0, "12/3").otherwise(" ").alias("PARID"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("LANDVALUE"), F.lit(None).cast("double").alias("BLDGVALUE"), F.lit(None).cast("double").alias("PREFVALUE"), F.lit("R").alias("CLASS"), F.lit("02/06/2003").alias("SALEDATE"), F.lit(1.0).alias("SALEAMT"))
    return files.assessment_attributes(a)[0].select("map_number", "assessed_value", "last_sale_date")


@query("detail_records", """
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) + 100 AS upset_price, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DECIMAL(14,2)) END AS judgment_amount, 'F-' || CAST(o_orderkey AS VARCHAR) AS court_case_number, 'Attorney ' || o_orderstatus AS plaintiff_attorney FROM orders""")
def detail_records(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    row = lambda k, v: F.concat(F.lit(f"<tr><th>{k}</th><td>"), v, F.lit("</td></tr>"))
    text = lambda c: F.col(c).cast("string")
    judged = F.when(F.col("o_orderkey") % 2 == 0, row("Final Judgment:", F.concat(F.lit("$"), text("o_custkey")))).otherwise("")
    html = F.concat(F.lit("<script>var x = 1 < 2;</script><table>"), row("Upset Price", F.concat(F.lit("$"), F.format_number("o_totalprice", 2))), judged, row("Plaintiff Attorney", F.concat(F.lit("Attorney&nbsp;"), "o_orderstatus")), F.lit("</table><p>Docket No. F-"), text("o_orderkey"), F.lit("</p>"))
    listed = (money("o_totalprice") + 100).cast("decimal(14,2)")
    return pages.detail_record(o.withColumn("html", html), "o_orderkey", "html", listed).select("o_orderkey", "upset_price", "judgment_amount", "court_case_number", "plaintiff_attorney")


@query("dated_link_listing", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ' Elm St, Town NY 14201' AS address, CAST(o_orderdate AS DATE) AS sale_date, CASE WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status, 'ERIE-' || upper(left(sha256('https://x.org/sale/' || CAST(o_orderkey AS VARCHAR)), 12)) AS sheriff_number FROM orders""")
def dated_link_listing(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    html = F.concat(F.lit('<li><a href="/sale/'), F.col("o_orderkey").cast("string"), F.lit('">'), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" - Sale of "), F.col("o_custkey").cast("string"), F.lit(" Elm St, Town NY 14201"), F.when(F.col("o_orderkey") % 2 == 0, " - Cancelled").otherwise(""), F.lit('</a></li><li><a href="/about">About us</a></li>'))
    return pages.dated_links(o.withColumn("html", html), "o_orderkey", "html", "ERIE", "https://x.org").select("o_orderkey", "address", "sale_date", "status", "sheriff_number")


@query("docket_listing", """
SELECT o_orderkey, 'EF-' || CAST(o_orderkey AS VARCHAR) AS sheriff_number, CAST(o_orderdate AS DATE) AS sale_date, CAST(o_custkey AS VARCHAR) AS block, '7' AS lot FROM orders""")
def docket_listing(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    html = F.concat(F.lit("<p>Civil Docket EF-"), F.col("o_orderkey").cast("string"), F.lit("</p><p>Sale to take place "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</p><p>Premises: 5 Elm St, Town NY 10924</p><p>Section 3 Block "), F.col("o_custkey").cast("string"), F.lit(" Lot 7.</p>"))
    return pages.docket_pages(o.withColumn("html", html), "o_orderkey", "html").select("o_orderkey", "sheriff_number", "sale_date", "block", "lot")


@query("training_rows", """
WITH s AS (SELECT o_orderkey, c_nationkey AS town, o_custkey AS lot, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(14,2)) AS v, CAST(o_totalprice AS DECIMAL(14,2)) + 1 AS r FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
f AS (SELECT *, CASE WHEN v <> 0 THEN v ELSE r END AS price FROM s), a AS (SELECT c_custkey, c_nationkey AS town, y.y FROM customer, (SELECT unnest([1993, 1996]) AS y) AS y WHERE c_custkey % 4 <> 0)
SELECT o_orderkey, price AS sale_price, CAST(CASE WHEN f.y <= 1994 THEN 1993 ELSE 1996 END AS INTEGER) AS snapshot_year FROM f JOIN a ON a.c_custkey = f.lot AND a.town = f.town AND a.y = CASE WHEN f.y <= 1994 THEN 1993 ELSE 1996 END WHERE price >= 10000""")
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read(spark, sf, "orders").filter("o_orderstatus <> 'P'"), read(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    place = [F.col("c_nationkey").cast("string").alias("municipality_code"), F.lit("1").alias("block")]
    deeds = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("source_hash"), F.lit("13").alias("county_code"), *place, F.col("o_custkey").cast("string").alias("lot"), F.year("o_orderdate").alias("source_year"), F.lit("2").alias("property_class"), F.lit("").alias("qualification_codes"),
        money(F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice"))).alias("verified_price"), (money("o_totalprice") + 1).alias("reported_price"), F.lit(0).alias("year_built"),
    )
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("acreage", "decimal(14,4)"), ("zoning", "string"), ("building_class", "string"), ("total_assessed", "decimal(14,4)"), ("census_tract", "string"), ("property_use_code", "string"))]
    assessed = c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("lot"), *place, F.explode(F.array(F.lit(1993), F.lit(1996))).alias("source_year"), F.lit("2").alias("property_class"), F.lit("").alias("qualifier"), F.lit(1950).alias("year_built"), *nothing)
    assessed = assessed.withColumn("source_hash", F.concat_ws("-", "lot", F.col("source_year").cast("string")))
    return valuation.training_rows(deeds, assessed).select(F.col("source_hash").cast("long").alias("o_orderkey"), F.col("sale_price").cast("decimal(14,2)").alias("sale_price"), "snapshot_year")


@query("property_detail", """
SELECT c_custkey AS property_id, c_name, o_orderkey AS sale_id, CAST(o_totalprice AS DECIMAL(14,2)) AS upset_price FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 1) ON o_custkey = c_custkey WHERE c_custkey = 7""")
def property_detail(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("decimal(14,2)")
    sales = read(spark, sf, "orders").select(F.col("o_custkey").alias("property_id"), F.col("o_orderkey").alias("sale_id"), F.col("o_orderdate").alias("current_sale_date"), none.alias("estimated_upset_price"), none.alias("alternate_upset_price"), money("o_totalprice").alias("upset_price"))
    properties = read(spark, sf, "customer").select(F.col("c_custkey").alias("property_id"), "c_name")
    return listing.property_detail(properties, sales, 7).select("property_id", "c_name", "sale_id", "upset_price")


@query("import_status", """
SELECT '3' AS county, (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS parcel_count, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) AS assessment_detail_count""")
def import_status(spark: SparkSession, sf: str) -> DataFrame:
    parcels = read(spark, sf, "customer").select(F.col("c_custkey").alias("parcel_id"), F.col("c_nationkey").cast("string").alias("county"))
    details = read(spark, sf, "orders").select(F.col("o_custkey").alias("parcel_id"))
    runs = spark.createDataFrame([], "run_id long, county string, started_at timestamp")
    return listing.import_status(runs, parcels, details, "3")[0]


@query("sale_search", """
SELECT o_orderkey, p_partkey IS NOT NULL AS matched FROM orders LEFT JOIN part ON o_orderkey = p_partkey WHERE o_orderpriority ILIKE '%high%' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND p_partkey IS NULL""")
def sale_search(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import date

    sales = read(spark, sf, "orders").select(F.col("o_orderkey").alias("sale_id"), F.col("o_orderpriority").alias("address"), F.lit("").alias("sheriff_number"), F.lit("Monroe").alias("county"), F.col("o_orderdate").alias("sale_date"))
    matches = read(spark, sf, "part").select(F.col("p_partkey").alias("sale_id"))
    d = listing.sale_search(sales, matches, text="high", county="monroe", start=date(1994, 1, 1), end=date(1996, 12, 31), matched=False)
    return d.select(F.col("sale_id").alias("o_orderkey"), F.col("m_sale_id").isNotNull().alias("matched"))


@query("parcel_by_number", """
SELECT DISTINCT p_partkey AS parcel_id FROM part WHERE p_brand = 'Brand#12' OR p_partkey IN (SELECT p_partkey FROM part WHERE p_size = 12 AND p_partkey % 2 = 0)""")
def parcel_by_number(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_brand", "p_size"])
    parcels = p.select(F.col("p_partkey").alias("parcel_id"), F.upper("p_brand").alias("normalized_map_number"))
    details = p.filter("p_size = 12 AND p_partkey % 2 = 0").select(F.col("p_partkey").alias("parcel_id"), F.lit("brand #12").alias("tax_parcel_id"))
    return listing.parcel_by_number(parcels, details, " brand#12 ").select("parcel_id").distinct()


@query("review_queue", """
SELECT doc_id % 20 AS property_id, bool_or(quality = 1) AS has_exact, count(*) AS n FROM labels WHERE toxic = 0 GROUP BY 1""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "labels").select((F.col("doc_id") % 20).alias("property_id"), F.col("doc_id").alias("candidate_id"), F.col("quality").cast("double").alias("score"), F.when(F.col("toxic") == 0, "PENDING").otherwise("APPROVED").alias("review_status"))
    return listing.review_queue(c).select("property_id", "has_exact", F.size("candidates").cast("long").alias("n"))
