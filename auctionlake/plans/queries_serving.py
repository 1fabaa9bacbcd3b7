"""Addresses of lists, upserts after a match, subjects to score and the dashboard on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.domain import addresses, dashboard, listing, loading, valuation
from auctionlake.operators import relational as R
from auctionlake.plans.catalog import query
from auctionlake.plans.common import money, read
from auctionlake.sources import pages

AS_OF = "1998-07-01"


def _parts_sql(state: str, longest: int, street: str) -> str:
    return f"""
SELECT c_custkey, '{state}' AS state, regexp_replace(trim(raw), '\\s+', ' ', 'g') AS value, {street} AS street, CASE WHEN c_custkey % 4 = 3 THEN 'Unknown' ELSE trim(c_mktsegment || ' Town') END AS city,
  CASE WHEN c_custkey % 4 < 2 THEN lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS zip_code
FROM (SELECT c_custkey, c_mktsegment, CAST(c_custkey AS VARCHAR) || ' ' || c_nationkey || '  Elm #2' || CASE WHEN c_custkey % 4 = 3 THEN '' ELSE ', ' || c_mktsegment || ' Town' END || CASE c_custkey % 4 WHEN 0 THEN ',  {state} ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') WHEN 1 THEN ' {state.lower()} ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || '-1234' ELSE '' END AS raw,
  CAST(c_custkey AS VARCHAR) || ' ' || c_nationkey || ' Elm #2' AS short FROM customer)"""


@query("listed_address_parts", _parts_sql("PA", 30, "short || CASE WHEN c_custkey % 4 = 3 THEN '' ELSE ', ' || c_mktsegment || ' Town' END") + " UNION ALL " + _parts_sql("NY", 40, "short"))
def listed_address_parts(spark: SparkSession, sf: str) -> DataFrame:
    c, key = read(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"]), F.col("c_custkey")
    code, town = F.lpad((key % 100000).cast("string"), 5, "0"), F.concat(F.lit(", "), "c_mktsegment", F.lit(" Town"))

    def one(state: str) -> DataFrame:
        tail = F.when(key % 4 == 0, F.concat(F.lit(f",  {state} "), code)).when(key % 4 == 1, F.concat(F.lit(f" {state.lower()} "), code, F.lit("-1234"))).otherwise("")
        raw = F.concat(key.cast("string"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit("  Elm #2"), F.when(key % 4 == 3, "").otherwise(town), tail)
        return c.select("c_custkey", F.lit(state).alias("state"), *[v.alias(k) for k, v in addresses.address_parts(raw, state).items()])

    return one("PA").unionByName(one("NY"))


@query("dashboard_labels", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Monmouth AVM' WHEN 1 THEN 'Monroe experimental AVM' WHEN 2 THEN 'RentCast' WHEN 3 THEN 'Manual review' WHEN 4 THEN 'Manual review' WHEN 5 THEN 'other' ELSE 'Pending' END AS provider,
  CASE o_orderkey % 9 WHEN 0 THEN 'County model unavailable' WHEN 1 THEN 'Parcel match under review' WHEN 2 THEN 'Parcel match required' WHEN 3 THEN 'Manual review required' WHEN 4 THEN 'Commercial model unavailable' WHEN 5 THEN 'Living area missing' WHEN 6 THEN 'Ready for model scoring' ELSE 'Valuation pending' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'Primary / foreclosing' WHEN 1 THEN 'Potentially senior' WHEN 2 THEN 'Secondary / junior' ELSE 'Priority unknown' END AS position, CASE WHEN o_orderkey % 3 = 0 THEN 'Pending' ELSE CAST(o_orderkey % 101 AS VARCHAR) || '%' END AS confidence FROM orders""")
def dashboard_labels(spark: SparkSession, sf: str) -> DataFrame:
    o, k = read(spark, sf, "orders", ["o_orderkey"]), F.col("o_orderkey")
    pick = lambda n, *codes: F.get(F.array(*[F.lit(x) for x in codes]), (k % n).cast("int"))
    provider = pick(7, "monmouth_xgboost_avm_v2", "monroe_kiz_xgboost_avm_v1", "rentcast", "manual_csv", "manual", "other", None)
    status = pick(9, "COUNTY_MODEL_UNAVAILABLE", "PARCEL_MATCH_UNDER_REVIEW", "PARCEL_MATCH_REQUIRED", "MANUAL_REVIEW_REQUIRED", "PROPERTY_TYPE_MODEL_UNAVAILABLE", "LIVING_AREA_MISSING", "MODEL_SCORING_REQUIRED", "VALUED", None)
    position = pick(4, "PRIMARY_FORECLOSING", "POTENTIALLY_SENIOR", "SECONDARY_JUNIOR", "PRIORITY_UNKNOWN")
    confidence = F.when(k % 3 != 0, (k % 101).cast("double") / 100)
    return o.select("o_orderkey", dashboard.provider_label(provider).alias("provider"), dashboard.status_label(status).alias("status"), dashboard.position_label(position).alias("position"), dashboard.confidence_label(confidence).alias("confidence"))


_SHOWN = """
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) - o_custkey * 100 END AS gross_equity, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 1000 END AS sale_probability FROM orders),
e AS (SELECT gross_equity AS v, row_number() OVER (ORDER BY gross_equity) AS rn, count(*) OVER () AS n FROM r WHERE gross_equity IS NOT NULL), pr AS (SELECT sale_probability AS v, row_number() OVER (ORDER BY sale_probability) AS rn, count(*) OVER () AS n FROM r WHERE sale_probability IS NOT NULL),
t AS (SELECT (SELECT max(v) FROM e WHERE rn = floor((n - 1) * 0.75) + 1) AS equity_threshold, (SELECT max(v) FROM pr WHERE rn = floor((n - 1) * 0.75) + 1) AS probability_threshold)"""


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    o, k = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]), F.col("o_orderkey")
    equity = F.when(k % 6 > 0, (money("o_totalprice") - F.col("o_custkey") * 100).cast("decimal(14,2)"))
    return o.select("o_orderkey", equity.alias("gross_equity"), F.when(k % 5 > 0, (k * 37 % 1000).cast("double") / 1000).alias("sale_probability"))


@query("dashboard_summary", f"WITH {_SHOWN} SELECT round(avg(CAST(gross_equity AS DOUBLE)), 4) AS average_equity, count(*) FILTER (WHERE gross_equity >= 150000) AS high_equity_count, CAST(max(equity_threshold) AS DECIMAL(14,2)) AS equity_threshold, max(probability_threshold) AS probability_threshold FROM r, t")
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.summary(_shown(spark, sf)).withColumn("average_equity", F.round(F.col("average_equity").cast("double"), 4))


@query("high_opportunity", f"WITH {_SHOWN} SELECT o_orderkey, coalesce(sale_probability >= probability_threshold AND gross_equity >= equity_threshold AND gross_equity > 0, FALSE) AS high_opportunity FROM r, t")
def high_opportunity(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.with_opportunities(_shown(spark, sf)).select("o_orderkey", "high_opportunity")


@query("scrape_tallies", """
SELECT count(*) AS records, count(*) FILTER (WHERE o_orderstatus = 'O') AS scheduled, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS judgments, count(*) FILTER (WHERE o_orderkey % 4 > 0) AS upset_prices FROM orders""")
def scrape_tallies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = read(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "O", "scheduled").otherwise("sold").alias("status"), F.when(k % 3 == 0, money("o_totalprice")).alias("judgment_amount"), F.when(k % 4 > 0, money("o_totalprice")).alias("upset_price"))
    return loading.scrape_tallies(d)


_UPSERT = """
WITH old AS (SELECT c_custkey AS map_number, -1 AS object_id, 'old' AS place FROM customer WHERE c_custkey % 3 > 0),
new AS (SELECT map_number, object_id, place FROM (SELECT o_custkey AS map_number, o_orderkey AS object_id, o_orderpriority AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"""


def _upserted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = read(spark, sf, "customer", ["c_custkey"]).filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("map_number"), F.lit(-1).cast("long").alias("object_id"), F.lit("old").alias("place"))
    new = read(spark, sf, "orders").select(F.col("o_custkey").alias("map_number"), F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("place"))
    return loading.counted_upsert(old, new, ["map_number"], "object_id")


@query("upsert_counts", _UPSERT + """
SELECT count(*) FILTER (WHERE old.map_number IS NULL) AS inserted, count(old.map_number) AS updated, (SELECT count(*) FROM orders) - count(*) AS duplicates FROM new LEFT JOIN old ON old.map_number = new.map_number""")
def upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf)[1]


@query("counted_upsert", _UPSERT + """
SELECT coalesce(new.map_number, old.map_number) AS map_number, coalesce(new.object_id, old.object_id) AS object_id, coalesce(new.place, old.place) AS place FROM new FULL JOIN old ON old.map_number = new.map_number""")
def counted_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf)[0]


def _details(spark: SparkSession, sf: str):
    c = read(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    k, number = F.col("c_custkey"), F.concat(F.lit("M"), F.col("c_custkey").cast("string"))
    parcels = c.filter("c_custkey % 4 > 0").select((k + 1000000).alias("parcel_id"), number.alias("map_number"), F.lit("t0").alias("tax_parcel_id"))
    details = c.filter("c_custkey % 4 > 0 AND c_custkey % 3 = 0").select((k + 1000000).alias("parcel_id"), number.alias("map_number"), F.lit("t0").alias("tax_parcel_id"), F.lit(0).cast("decimal(14,2)").alias("assessed_value"))
    incoming = c.filter("c_custkey % 5 > 0").select(number.alias("map_number"), F.when(k % 7 > 0, F.concat(F.lit("T"), k.cast("string"))).alias("tax_parcel_id"), money("c_acctbal").alias("assessed_value"))
    return loading.upsert_known_details(parcels, details, incoming)


@query("known_details", """
SELECT c_custkey + 1000000 AS parcel_id, 'M' || c_custkey AS map_number, CASE WHEN c_custkey % 5 = 0 THEN 't0' WHEN c_custkey % 7 > 0 THEN 'T' || c_custkey END AS tax_parcel_id, CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS DECIMAL(14,2)) AS assessed_value
FROM customer WHERE c_custkey % 4 > 0 AND (c_custkey % 5 > 0 OR c_custkey % 3 = 0)""")
def known_details(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)["details"]


@query("known_tax_numbers", """
SELECT c_custkey + 1000000 AS parcel_id, 'M' || c_custkey AS map_number, CASE WHEN c_custkey % 5 = 0 THEN 't0' WHEN c_custkey % 7 > 0 THEN 'T' || c_custkey END AS tax_parcel_id FROM customer WHERE c_custkey % 4 > 0""")
def known_tax_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)["parcels"]


@query("known_counts", """
SELECT count(*) AS parsed, count(*) FILTER (WHERE c_custkey % 4 > 0) AS matched, count(*) FILTER (WHERE c_custkey % 4 > 0 AND c_custkey % 3 > 0) AS inserted, count(*) FILTER (WHERE c_custkey % 4 > 0 AND c_custkey % 3 = 0) AS updated, count(*) FILTER (WHERE c_custkey % 4 = 0) AS unmatched FROM customer WHERE c_custkey % 5 > 0""")
def known_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)["counts"]


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    old = c.filter("c_custkey % 3 > 0").select(
        k.alias("property_id"), F.lit(2020).alias("snapshot_year"), F.lit("1301").alias("municipality_code"), F.lit("1").alias("block"), F.lit("1").alias("lot"), F.lit(None).cast("string").alias("qualifier"), F.lit("old").alias("property_location"),
        F.lit(1).cast("decimal(14,2)").alias("total_assessed"), F.lit("m0").alias("match_method"), F.lit(50).alias("match_confidence"), F.lit("h0").alias("source_hash"),
    )
    new = c.filter("c_custkey % 4 > 0").select(
        k.alias("property_id"), F.lit(2024).alias("snapshot_year"), F.lit("1308 ").alias("municipality_code"), F.col("c_nationkey").cast("string").alias("block"), k.cast("string").alias("lot"), F.when(k % 2 == 0, "C1").alias("qualifier"), F.col("c_name").alias("property_location"),
        money("c_acctbal").alias("total_assessed"), F.lit("m1").alias("match_method"), F.lit(100).alias("match_confidence"), F.lit("h1").alias("source_hash"),
    )
    return old, new


def _features_sql(year: str, assessed: str) -> str:
    old, new = "c_custkey % 3 > 0", "c_custkey % 4 > 0"
    return f"""
SELECT c_custkey AS property_id, CAST(CASE WHEN {year} THEN 2024 ELSE 2020 END AS INTEGER) AS snapshot_year, CASE WHEN {new} THEN '1308 ' ELSE '1301' END AS municipality_code, CASE WHEN {new} THEN CAST(c_nationkey AS VARCHAR) ELSE '1' END AS block, CASE WHEN {new} THEN CAST(c_custkey AS VARCHAR) ELSE '1' END AS lot,
  CASE WHEN {new} AND c_custkey % 2 = 0 THEN 'C1' END AS qualifier, CASE WHEN {new} THEN c_name ELSE 'old' END AS property_location, CAST(CASE WHEN {assessed} THEN c_acctbal ELSE 1 END AS DECIMAL(14,2)) AS total_assessed,
  CASE WHEN {new} THEN 'm1' ELSE 'm0' END AS match_method, CAST(CASE WHEN {new} THEN 100 ELSE 50 END AS INTEGER) AS match_confidence, CASE WHEN {new} THEN 'h1' ELSE 'h0' END AS source_hash FROM customer WHERE {old} OR {new}"""


@query("matched_features", _features_sql("c_custkey % 4 > 0", "c_custkey % 4 > 0"))
def matched_features(spark: SparkSession, sf: str) -> DataFrame:
    return loading.upsert_features(*_features(spark, sf))


@query("accepted_features", _features_sql("c_custkey % 4 > 0", "c_custkey % 3 = 0"))
def accepted_features(spark: SparkSession, sf: str) -> DataFrame:
    return loading.upsert_features(*_features(spark, sf), identity_only=True)


@query("approved_features", _features_sql("c_custkey % 3 = 0", "c_custkey % 3 = 0"))
def approved_features(spark: SparkSession, sf: str) -> DataFrame:
    return loading.upsert_features(*_features(spark, sf), identity_only=True, keeps_year=True)


@query("identified_properties", """
SELECT c_custkey AS property_id, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'b' END AS block, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'l' END AS lot, CASE WHEN c_custkey % 4 = 2 THEN 'C1' WHEN c_custkey % 4 = 0 THEN 'q' END AS qualifier,
  CASE WHEN c_custkey % 4 > 0 THEN '1308_' || c_nationkey || '_' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '_C1' ELSE '' END END AS pams_pin, CAST(CASE WHEN c_custkey % 4 > 0 THEN 100 ELSE 1 END AS INTEGER) AS identity_confidence, c_name FROM customer""")
def identified_properties(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer", ["c_custkey", "c_name"])
    properties = c.select(F.col("c_custkey").alias("property_id"), F.lit("b").alias("block"), F.lit("l").alias("lot"), F.lit("q").alias("qualifier"), F.lit(None).cast("string").alias("pams_pin"), F.lit(1).alias("identity_confidence"), "c_name")
    return loading.identify_properties(properties, _features(spark, sf)[1])


@query("links_once", """
SELECT l_orderkey AS sale_id, l_partkey AS parcel_id, CASE WHEN bool_or(l_linenumber = 1) THEN 'old' ELSE 'VERIFIED' END AS match_status FROM lineitem GROUP BY 1, 2""")
def links_once(spark: SparkSession, sf: str) -> DataFrame:
    i = read(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    pair = [F.col("l_orderkey").alias("sale_id"), F.col("l_partkey").alias("parcel_id")]
    return loading.add_links(i.filter("l_linenumber = 1").select(*pair, F.lit("old").alias("match_status")).distinct(), i.select(*pair, F.lit("VERIFIED").alias("match_status")))


@query("analysis_versions", """
WITH old AS (SELECT o_orderkey AS s, 'v' || (o_orderkey % 2) AS v, o_orderkey AS a, CAST(1 AS DECIMAL(14,2)) AS m FROM orders WHERE o_orderkey % 3 > 0), new AS (SELECT o_orderkey AS s, 'v0' AS v, -o_orderkey AS a, CAST(o_totalprice AS DECIMAL(14,2)) AS m FROM orders)
SELECT coalesce(old.s, new.s) AS sheriff_sale_id, coalesce(old.v, new.v) AS calculation_version, coalesce(old.a, new.a) AS analysis_id, coalesce(new.m, old.m) AS market_value FROM old FULL JOIN new ON old.s = new.s AND old.v = new.v""")
def analysis_versions(spark: SparkSession, sf: str) -> DataFrame:
    o, k = read(spark, sf, "orders", ["o_orderkey", "o_totalprice"]), F.col("o_orderkey")
    old = o.filter("o_orderkey % 3 > 0").select(k.alias("sheriff_sale_id"), F.concat(F.lit("v"), (k % 2).cast("string")).alias("calculation_version"), k.alias("analysis_id"), F.lit(1).cast("decimal(14,2)").alias("market_value"))
    return loading.upsert_analyses(old, o.select(k.alias("sheriff_sale_id"), F.lit("v0").alias("calculation_version"), (-k).alias("analysis_id"), money("o_totalprice").alias("market_value")))


@query("most_frequent_fill", """
WITH n AS (SELECT o_orderstatus AS v, count(*) AS c FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1), m AS (SELECT v FROM n ORDER BY c DESC, v LIMIT 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE m.v END AS o_orderstatus FROM orders, m""")
def most_frequent_fill(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")))
    return R.fill_with(o, R.most_frequent(o, ["o_orderstatus"]))


@query("trimmed_join", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderkey % 25 = c_nationkey")
def trimmed_join(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_custkey"]).select("o_orderkey", F.col("o_custkey").cast("string").alias("block"), (F.col("o_orderkey") % 25).cast("string").alias("lot"))
    c = read(spark, sf, "customer", ["c_custkey", "c_nationkey"]).select("c_custkey", F.rpad(F.col("c_custkey").cast("string"), 12, " ").alias("padded_block"), F.lpad(F.col("c_nationkey").cast("string"), 5, " ").alias("padded_lot"))
    return R.trimmed_join(o, c, [("block", "padded_block"), ("lot", "padded_lot")]).select("o_orderkey", "c_custkey")


_SUBJECTS = f"""
WITH f AS (SELECT c_custkey AS property_id, c_custkey % 300 AS lot, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 40 + 1960 ELSE 0 END AS built, c_nationkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 * 500 - 500 END AS square_feet FROM customer WHERE 85 + c_custkey % 16 >= 90 AND c_mktsegment <> 'BUILDING'),
s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}'), v AS (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0),
t AS (SELECT o_custkey % 300 AS lot, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3000 ELSE 0 END AS area, row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT f.property_id, CAST(CASE WHEN square_feet > 0 THEN square_feet WHEN t.area > 0 THEN t.area END AS DOUBLE) AS living_space, coalesce(square_feet, 0) <= 0 AND coalesce(t.area, 0) = 0 AS living_area_imputed, CAST(7 AS INTEGER) AS sale_month, CAST(CASE WHEN built > 0 THEN 1998 - built END AS INTEGER) AS property_age
FROM f JOIN s ON s.o_custkey = f.property_id LEFT JOIN t ON t.lot = f.lot AND t.rn = 1 WHERE f.property_id NOT IN (SELECT o_custkey FROM v)"""


@query("scoring_subjects", _SUBJECTS)
def scoring_subjects(spark: SparkSession, sf: str) -> DataFrame:
    c, o, k = read(spark, sf, "customer"), read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]), F.col("c_custkey")
    place = [F.lit("1308").alias("municipality_code"), F.lit("7").alias("block")]
    features = c.select(k.alias("property_id"), *place, (k % 300).alias("lot"), F.when(k % 6 > 0, (k % 40 + 1960).cast("int")).otherwise(0).alias("year_built"), (F.lit(85) + k % 16).alias("match_confidence"), F.when(F.col("c_mktsegment") == "BUILDING", "4A").otherwise("2  ").alias("property_class"))
    properties = c.select(k.alias("property_id"), F.when(k % 4 > 0, k % 4 * 500 - 500).alias("square_feet"))
    sales = o.select(F.col("o_custkey").alias("property_id"), F.col("o_orderdate").alias("current_sale_date"))
    key = F.col("o_orderkey")
    training = o.select(*place, (F.col("o_custkey") % 300).alias("lot"), F.col("o_orderdate").alias("deed_date"), key.alias("training_id"), F.when(key % 3 > 0, key % 3000).otherwise(0).alias("living_space"), F.lit(40.0).alias("latitude"), F.lit(-74.0).alias("longitude"))
    valued = o.select(F.col("o_custkey").alias("property_id"), (key % 11 == 0).alias("is_current"))
    out = valuation.scoring_subjects(features, properties, sales, training, F.lit(AS_OF).cast("timestamp"), valued)
    return out.select("property_id", "living_space", "living_area_imputed", "sale_month", "property_age")


@query("experimental_subjects", f"""
SELECT property_id, sale_id, parcel_id, acreage, CAST(1998 AS INTEGER) AS sale_year, CAST(7 AS INTEGER) AS sale_month FROM (SELECT o_custkey AS property_id, o_orderkey AS sale_id, l_partkey AS parcel_id, s_acctbal AS acreage, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_partkey) AS rn
  FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_partkey WHERE o_orderdate >= TIMESTAMP '{AS_OF}') WHERE rn = 1""")
def experimental_subjects(spark: SparkSession, sf: str) -> DataFrame:
    sales = read(spark, sf, "orders").select(F.col("o_orderkey").alias("sale_id"), F.col("o_custkey").alias("property_id"), F.col("o_orderdate").alias("current_sale_date"))
    matches = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sale_id"), F.col("l_partkey").alias("parcel_id")).distinct()
    details = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("parcel_id"), F.col("s_acctbal").alias("acreage"))
    return valuation.experimental_subjects(sales, matches, details, F.lit(AS_OF).cast("timestamp")).select("property_id", "sale_id", "parcel_id", "acreage", "sale_year", "sale_month")


@query("experimental_valuations", """
SELECT o_orderkey, round(greatest(p, 25000), 2) AS estimated_value, round(greatest(greatest(p, 25000) - 12345.5, 25000), 2) AS low_value, round(greatest(p, 25000) + 12345.5, 2) AS high_value, 0.25::DOUBLE AS confidence_score, o_orderdate + INTERVAL 30 DAY AS expires_at FROM (SELECT *, o_totalprice / 3 AS p FROM orders)""")
def experimental_valuations(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"]).withColumn("prediction", F.col("o_totalprice") / 3)
    out = valuation.experimental_valuations(o, 12345.5).withColumn("expires_at", valuation.expires(F.col("o_orderdate"), "experimental_model"))
    return out.select("o_orderkey", "estimated_value", "low_value", "high_value", F.col("confidence_score").cast("double").alias("confidence_score"), "expires_at")


@query("model_valuations", """
SELECT o_orderkey, round(greatest(p, 25000), 2) AS estimated_value, round(greatest(p - w, 25000), 2) AS low_value, round(p + w, 2) AS high_value, CASE WHEN o_orderkey % 3 = 0 THEN 0.40 WHEN o_custkey % 9 >= 5 THEN 0.62 ELSE 0.50 END::DOUBLE AS confidence_score, o_orderdate + INTERVAL 90 DAY AS expires_at
FROM (SELECT *, o_totalprice / 3 AS p, CASE WHEN o_orderkey % 3 = 0 THEN 1.75 * 10000 ELSE 10000 END AS w FROM orders)""")
def model_valuations(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("prediction", F.col("o_totalprice") / 3).withColumn("living_area_imputed", F.col("o_orderkey") % 3 == 0).withColumn("local_comp_count", F.col("o_custkey") % 9)
    out = valuation.valuations(o, 10000.0).withColumn("expires_at", valuation.expires(F.col("o_orderdate"), "local_model"))
    return out.select("o_orderkey", "estimated_value", "low_value", "high_value", F.col("confidence_score").cast("double").alias("confidence_score"), "expires_at")


_FIT = "sale_price BETWEEN 25000 AND 5000000 AND living_space BETWEEN 300 AND 10000 AND total_assessed > 0 AND (year_built IS NULL OR year_built BETWEEN 1700 AND sale_year + 1) AND (acreage IS NULL OR acreage BETWEEN 0.01 AND 25)"
_SOLD = """
WITH d AS (SELECT o_orderkey, o_orderdate AS deed_date, year(o_orderdate) AS sale_year, CAST(o_totalprice AS DECIMAL(14,2)) AS sale_price, o_orderkey % 3000 AS living_space, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 50 END AS total_assessed, CASE WHEN o_orderkey % 5 > 0 THEN 1680 + o_custkey % 330 END AS year_built, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 28 END AS acreage FROM orders)"""


def _sold(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf, "orders").select(k, F.col("o_orderdate").alias("deed_date"), F.year("o_orderdate").alias("sale_year"), money("o_totalprice").alias("sale_price"), (k % 3000).alias("living_space"), F.when(k % 7 > 0, c % 50).alias("total_assessed"), F.when(k % 5 > 0, 1680 + c % 330).alias("year_built"), F.when(k % 4 > 0, c % 28).alias("acreage"))


@query("training_eligible", f"{_SOLD} SELECT o_orderkey, CAST(month(deed_date) AS INTEGER) AS sale_month, sale_year - year_built AS property_age FROM d WHERE {_FIT}")
def training_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.eligible(_sold(spark, sf))[0].select("o_orderkey", "sale_month", "property_age")


@query("training_audit", f"{_SOLD} SELECT count(*) AS input_rows, count(*) FILTER (WHERE {_FIT}) AS eligible_rows, count(*) FILTER (WHERE coalesce({_FIT}, FALSE) = FALSE) AS excluded_rows FROM d")
def training_audit(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.eligible(_sold(spark, sf))[1]


@query("property_upsert", """
SELECT coalesce(n.h, o.h) AS address_hash, coalesce(n.city, o.city) AS city, CASE WHEN n.h IS NULL THEN o.q WHEN o.h IS NULL THEN n.q ELSE greatest(o.q, n.q) END AS data_quality_score
FROM (SELECT c_custkey AS h, 'old' AS city, c_custkey % 100 AS q FROM customer WHERE c_custkey % 3 > 0) o FULL JOIN (SELECT c_custkey AS h, c_mktsegment AS city, 50 AS q FROM customer WHERE c_custkey % 4 > 0) n ON o.h = n.h""")
def property_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    old = c.filter("c_custkey % 3 > 0").select(k.alias("address_hash"), F.lit("old").alias("city"), (k % 100).alias("data_quality_score"))
    return loading.upsert_properties(old, c.filter("c_custkey % 4 > 0").select(k.alias("address_hash"), F.col("c_mktsegment").alias("city"), F.lit(50).cast("long").alias("data_quality_score")))


@query("address_evidence", """
SELECT c_custkey AS sale_id, 'PROPERTY_ADDRESS' AS evidence_type, CAST(c_custkey AS VARCHAR) || ' Elm Street' AS raw_value, CAST(c_custkey AS VARCHAR) || 'ELMST' AS normalized_value, CAST(90 AS INTEGER) AS confidence FROM customer""")
def address_evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer", ["c_custkey"])
    return loading.address_evidence(c.unionByName(c).select(F.col("c_custkey").alias("sale_id"), F.concat(F.col("c_custkey").cast("string"), F.lit(" Elm Street")).alias("normalized_address")))


@query("property_liens", """
SELECT l_partkey AS lien_id, l_linenumber > 3 AS requires_manual_review, CASE WHEN l_discount < 0.08 THEN CAST(l_extendedprice AS DECIMAL(14,2)) END AS current_amount FROM lineitem WHERE l_orderkey = 201""")
def property_liens(spark: SparkSession, sf: str) -> DataFrame:
    liens = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("property_id"), F.col("l_partkey").alias("lien_id"), (F.col("l_linenumber") > 3).alias("requires_manual_review"), F.when(F.col("l_discount") < 0.08, money("l_extendedprice")).alias("current_amount"))
    return listing.property_liens(liens, 201).drop("property_id")


@query("future_sale_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(d AS INTEGER) AS sale_day FROM orders, (SELECT unnest([0, 7]) AS d) WHERE CAST(o_orderdate AS DATE) + CAST(d AS INTEGER) >= DATE '1998-07-01'""")
def future_sale_dates(spark: SparkSession, sf: str) -> DataFrame:
    option = lambda days: F.concat(F.lit('<option value="'), F.date_format(F.date_add("o_orderdate", days), "yyyyMMdd"), F.lit('">x</option>'))
    o = read(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).withColumn("html", F.concat(F.lit('<select><option value="">All</option>'), option(0), option(7), F.lit("</select>")))
    return pages.future_sale_dates(o.select("o_orderkey", "html"), "o_orderkey", "html", F.lit(AS_OF).cast("date"))


@query("brief_detail", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 2) OR o_orderkey % 5 = 0 THEN 1.00 WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) END::DECIMAL(14,2) AS upset_price, CASE WHEN o_orderkey % 4 IN (1, 2) OR o_orderkey % 5 = 0 THEN 2.00 ELSE o_custkey END::DECIMAL(14,2) AS judgment_amount,
  CASE WHEN o_orderkey % 4 IN (1, 2) OR o_orderkey % 5 = 0 THEN 'listed' ELSE 'F-' || o_orderkey END AS court_case_number, CASE WHEN o_orderkey % 4 IN (1, 2) OR o_orderkey % 5 = 0 THEN 'b' END AS block, 'https://x.org' || CASE WHEN o_orderkey % 4 = 1 THEN '/other' ELSE '/Sales/SaleDetails?id=' || o_orderkey END AS source_url FROM orders""")
def brief_detail(spark: SparkSession, sf: str) -> DataFrame:
    o, k, text = read(spark, sf, "orders"), F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    row = lambda label, v: F.concat(F.lit(f"<tr><th>{label}</th><td>"), v, F.lit("</td></tr>"))
    upset = F.when(k % 3 == 0, row("Upset Amount:", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))).otherwise(row("Upset Price", F.lit("to be announced")))
    html = F.concat(F.lit("<table>"), upset, row("Final Judgment", F.concat(F.lit("$ "), text("o_custkey"))), row("Court Case #", F.concat(F.lit("F-"), text("o_orderkey"))), row("Block", F.lit(" ")), F.lit("</table>"))
    path = lambda hit: F.concat(F.lit("https://x.org"), F.when(hit, "/other").otherwise(F.concat(F.lit("/Sales/SaleDetails?id="), k.cast("string"))))
    none = F.lit(None).cast("string")
    d = o.select(
        k, F.lit(1).cast("decimal(14,2)").alias("upset_price"), F.lit(2).cast("decimal(14,2)").alias("judgment_amount"), none.alias("plaintiff_attorney"), F.lit("listed").alias("court_case_number"), F.lit("b").alias("block"), none.alias("lot"), none.alias("qualifier"),
        F.when(k % 5 == 0, "<p>nothing</p>").otherwise(html).alias("html"), path(k % 4 == 1).alias("source_url"), path(k % 4 == 2).alias("final_url"),
    )
    return pages.brief_detail(d, "html", "source_url", "final_url").select("o_orderkey", "upset_price", "judgment_amount", "court_case_number", "block", "source_url")
