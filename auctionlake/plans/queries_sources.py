"""Sources written out in their own format, read back and held against the tables that they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.domain import addresses
from auctionlake.domain.municipalities import MUNICIPALITIES, municipalities
from auctionlake.operators import relational as R
from auctionlake.plans.catalog import query
from auctionlake.plans.common import money, read, shared_folder, spread
from auctionlake.sources import files, fixed_width, pages, services
from auctionlake.streaming import incremental

text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")


# --- embedded JSON and detail pages ----------------------------------------------------------------

_GRID = T.StructType().add("AuctionID", "long").add("Name", "string").add("Tree", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))).add("Debt", "double")


@query("embedded_grid", """
SELECT AuctionID, Name, CAST(Tree[1][1] AS INTEGER[]) AS first_leaf, CAST(Tree[2][1][1] AS INTEGER) AS deep, Debt FROM (
  SELECT l_partkey AS AuctionID, 'Lot "' || CAST(l_linenumber AS VARCHAR) || '" ]} [' || l_returnflag || '\\' AS Name, [[[l_linenumber, 2], [3]], [[CAST(l_quantity AS INTEGER)], []]] AS Tree, l_extendedprice AS Debt,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1""")
def embedded_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each order, its lines as rows of a grid with brackets in strings and arrays three deep."""
    line = read(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice"])
    n = F.col("l_linenumber").cast("int")
    tree = F.array(F.array(F.array(n, F.lit(2)), F.array(F.lit(3))), F.array(F.array(F.col("l_quantity").cast("int")), F.array().cast("array<int>")))
    row = F.struct(F.col("l_partkey").alias("AuctionID"), F.concat(F.lit('Lot "'), text(n), F.lit('" ]} ['), "l_returnflag", F.lit("\\")).alias("Name"), tree.alias("Tree"), F.col("l_extendedprice").alias("Debt"))
    grid = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), "l_suppkey", "l_quantity", "l_extendedprice", row.alias("row")))).alias("rows"))
    body = F.to_json(F.transform("rows", lambda x: x["row"]))
    html = F.concat(F.lit('<html><script>var a = [[1], "]"];</script><script>Auctions_grid({"x":[{}],"data":{"Data":'), body, F.lit(',"Total":[7]},"z":[[[]]]});</script></html>'))
    return pages.embedded_grid(grid.select("l_orderkey", html.alias("html")), "l_orderkey", "html", _GRID, "AuctionID").select("AuctionID", "Name", F.col("Tree")[0][0].alias("first_leaf"), F.col("Tree")[1][0][0].alias("deep"), "Debt")


@query("page_status_history", """
SELECT l_orderkey, CAST(place AS INTEGER) AS position, raw AS raw_status, CASE WHEN raw LIKE 'Adjourned%' THEN 'adjourned' WHEN raw = 'Sold to bank' THEN 'sold' ELSE 'cancelled' END AS status, day AS event_date FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place, CASE l_returnflag WHEN 'R' THEN 'Sold to bank' WHEN 'A' THEN 'Cancelled by court' ELSE 'Adjourned - ' || l_linestatus END AS raw, CAST(l_shipdate AS DATE) AS day FROM lineitem)
WHERE l_linenumber % 5 <> 0 AND l_linenumber % 4 <> 0""")
def page_status_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history table of a page for each order: repeats stay, lines without status or date go."""
    line = read(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"])
    raw = F.when(F.col("l_returnflag") == "R", "Sold to bank").when(F.col("l_returnflag") == "A", "Cancelled by court").otherwise(F.concat(F.lit("Adjourned - "), "l_linestatus"))
    shown = F.when(F.col("l_linenumber") % 5 == 0, F.lit(" ")).otherwise(raw)
    day = F.when(F.col("l_linenumber") % 4 == 0, F.lit("to be set")).otherwise(F.date_format("l_shipdate", "M/d/yyyy"))
    row = F.concat(F.lit("<tr><td>"), shown, F.lit("</td><td> "), day, F.lit("</td></tr>"))
    each = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row")))).alias("rows"))
    html = F.concat(F.lit('<table id="other"><tr><td>Sold</td><td>1/1/2020</td></tr></table><table class="x" id="longTable"><tr><th>Status</th><th>Date</th></tr>'), F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit("</table>"))
    found = pages.status_history(each.select("l_orderkey", html.alias("html")), "l_orderkey", "html")
    return found.select("l_orderkey", F.col("position").cast("int").alias("position"), "raw_status", "status", "event_date")


# --- paged map services ----------------------------------------------------------------------------

# Parcels of a map layer: every fifth number is written in another way on a later page, some features have no number, id or geometry.
_LAYER_SQL = """
features AS (
  SELECT p_partkey AS id, (p_partkey - 1) // 64 AS page, (p_partkey - 1) % 64 AS position, p_partkey * 7 % (SELECT max(p_partkey) // 2 FROM part) AS n, p_size, p_partkey % 13 = 0 AS bare, p_partkey % 17 = 0 AS flat, p_partkey % 23 = 0 AS lost FROM part),
good AS (SELECT * FROM features WHERE NOT bare AND NOT flat AND NOT lost),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY page, id DESC, position) AS k FROM good) WHERE k = 1)"""


def _layer(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of GeoJSON, saved as a service gave them."""
    p = read(spark, sf, "part", ["p_partkey", "p_size"])
    half = p.agg(F.floor(F.max("p_partkey") / 2).alias("half"))
    k = F.col("p_partkey")
    d = p.crossJoin(F.broadcast(half)).withColumn("n", k * 7 % F.col("half"))
    number = F.when(k % 3 == 0, F.concat(F.lit(" 12 / "), text("n"), F.lit("-A"))).when(k % 3 == 1, F.concat(F.lit("12._"), text("n"), F.lit(".a "))).otherwise(F.concat(F.lit("12-"), text("n"), F.lit("/A")))
    x, y = -75 + F.col("p_size") / 64, 40 + (k % 32) / 32
    corner = lambda a, b: F.array(x + a, y + b)
    ring = F.array(corner(0.0, 0.0), corner(0.5, 0.0), corner(0.5, 0.25), corner(0.0, 0.25), corner(0.0, 0.0))
    shape = F.when(k % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.array(ring)), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(F.array(F.array(ring))), F.lit("}")))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"OBJECTID":'), F.when(k % 23 == 0, "null").otherwise(text(k)), F.lit(',"MAPNUMBER":'), F.when(k % 13 == 0, '" ./ "').otherwise(F.concat(F.lit('"'), number, F.lit('"'))),
        F.lit('},"geometry":'), F.when(k % 17 == 0, "null").otherwise(shape), F.lit("}"),
    )
    each = d.select(F.floor((k - 1) / 64).alias("page"), F.struct(k.alias("k"), feature.alias("f")).alias("x")).groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("xs", lambda x: x["f"]), ","), F.lit("]}"))
    folder = shared_folder(spark, "layer")
    each.select("page", body.alias("value")).write.partitionBy("page").text(folder)
    return services.saved_pages(spark.read.text(folder))


@query("map_service_parcels", f"""
WITH {_LAYER_SQL}
SELECT '12.' || CAST(n AS VARCHAR) || '.A' AS normalized_map_number, id AS source_object_id, page, CAST(round(40 + (id % 32) / 32 + 0.125, 7) AS DECIMAL(10,7)) AS latitude, CAST(round(-75 + p_size / 64 + 0.25, 7) AS DECIMAL(10,7)) AS longitude FROM kept""")
def map_service_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return services.first_seen(services.parcel_features(_layer(spark, sf))).select("normalized_map_number", "source_object_id", "page", "latitude", "longitude")


@query("map_service_counts", f"""
WITH {_LAYER_SQL}
SELECT (SELECT count(*) FROM features) AS downloaded, count(*) FILTER (WHERE n % 4 <> 0) AS inserted, count(*) FILTER (WHERE n % 4 = 0) AS updated, (SELECT count(*) FROM features) - count(*) AS skipped FROM kept""")
def map_service_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What an import of the layer does to a table that has every fourth number."""
    features = _layer(spark, sf)
    known = spark.range(read(spark, sf, "part", ["p_partkey"]).count()).filter("id % 4 = 0").select(F.concat(F.lit("12."), text("id"), F.lit(".A")).alias("normalized_map_number"))
    return services.import_counts(features, services.first_seen(services.parcel_features(features)), known)


@query("parcel_centroids", """
WITH f AS (SELECT o_orderkey AS id, o_custkey // 7 AS parcel, dense_rank() OVER (ORDER BY o_orderkey // 512) AS page, o_orderkey % 11 <> 0 AS placed FROM orders),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel ORDER BY page, id DESC) AS k FROM f WHERE placed) WHERE k = 1),
sales AS (SELECT c_custkey, c_custkey // 7 AS parcel, CASE WHEN c_custkey % 3 = 0 THEN 1.5 END AS lat FROM customer)
SELECT c_custkey, coalesce(lat, 40 + id % 64 / 64) AS latitude, CASE WHEN lat IS NULL THEN -74 - id % 32 / 32 ELSE 2.5 END AS longitude, CASE WHEN lat IS NULL AND id IS NOT NULL THEN 'map layer' WHEN lat IS NOT NULL THEN 'deed' END AS coordinate_source
FROM sales LEFT JOIN best USING (parcel)""")
def parcel_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Sales that get the place of their parcel from keyset pages of a layer: the first page counts, there the last feature."""
    o = read(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    k, parcel = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 7)
    place = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(',"centroid":{"x":'), text(-74 - k % 32 / 32), F.lit(',"y":'), text(40 + k % 64 / 64), F.lit("}")))
    feature = F.concat(F.lit('{"attributes":{"OBJECTID":'), text(k), F.lit(',"PCL_MUN":" 1301 ","PCLBLOCK":"00'), text(parcel), F.lit('","PCLLOT":"0","PCLQCODE":null}'), place, F.lit("}"))
    each = o.select(F.floor(k / 512).alias("page"), F.struct(k.alias("k"), feature.alias("f")).alias("x")).groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    body = F.concat(F.lit('{"exceededTransferLimit":true,"features":['), F.array_join(F.transform("xs", lambda x: x["f"]), ","), F.lit("]}"))
    folder = shared_folder(spark, "keyset")
    each.select("page", body.alias("value")).write.partitionBy("page").text(folder)
    found = services.parcel_centroids(services.saved_pages(spark.read.text(folder)))
    c = read(spark, sf, "customer", ["c_custkey"])
    known = F.col("c_custkey") % 3 == 0
    block = F.floor(F.col("c_custkey") / 7)
    sales = c.select(
        "c_custkey", F.lit("1301").alias("municipality_code"), text(block).alias("block"), F.lit("0").alias("lot"), F.lit("").alias("qualifier"),
        F.when(known, 1.5).alias("latitude"), F.when(known, 2.5).alias("longitude"), F.when(known, "deed").alias("coordinate_source"),
    )
    return services.fill_centroids(sales, found, "map layer").select("c_custkey", "latitude", "longitude", "coordinate_source")


# --- addresses -------------------------------------------------------------------------------------

_NAMES = sorted(name for names in MUNICIPALITIES.values() for name in names)
_TOWN_VALUES = ", ".join(f"({k}, '{name}', '{name.title()}')" for k, name in enumerate(_NAMES))


@query("address_normalise", f"""
WITH town AS (SELECT * FROM (VALUES {_TOWN_VALUES}) AS v(i, name, titled)),
s AS (
  SELECT c_custkey AS k, c_custkey % 9 AS kind, CAST(c_custkey AS VARCHAR) || ' Main Street' AS main, name, titled AS city, CASE WHEN c_custkey % 9 <> 1 THEN '07' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END AS zip
  FROM customer JOIN town ON i = c_custkey % {len(_NAMES)}),
p AS (
  SELECT *, CASE kind WHEN 3 THEN main || ' A/K/A 7 Side Lane' WHEN 4 THEN main || ' NJ' WHEN 5 THEN '1 2 3 ' || main ELSE main END AS street, CASE WHEN kind = 2 THEN '4B' END AS unit,
    array_to_string(list_filter([CASE WHEN kind = 1 THEN 'ZIP code missing' END, CASE WHEN kind = 4 THEN 'Source may contain multiple addresses' END, CASE WHEN kind = 3 THEN 'Source contains an alternate address' END, CASE WHEN kind = 5 THEN 'Street field may contain multiple properties' END], lambda x: x IS NOT NULL), '; ') AS review,
    CASE kind WHEN 6 THEN 'Could not identify municipality: ' || CAST(k AS VARCHAR) || ' main street ' || lower(name) || 'x, NJ ' || zip WHEN 7 THEN 'Could not find NJ in address: ' || CAST(k AS VARCHAR) || ' main street ' || lower(name) || ' ' || zip WHEN 8 THEN 'Address is empty.' END AS reason FROM s)
SELECT k AS c_custkey, street AS street_address, unit AS unit_number, city, zip AS zip_code, concat_ws(', ', street, 'Unit ' || unit, city, 'NJ', zip) AS normalized_address,
  sha256(upper(street) || '|' || coalesce(unit, '') || '|' || upper(city) || '|NJ|' || coalesce(zip, '')) AS address_hash, CAST(100 - CASE WHEN zip IS NULL THEN 15 ELSE 0 END - CASE WHEN review <> '' THEN 20 ELSE 0 END AS INTEGER) AS data_quality_score,
  review <> '' AS needs_manual_review, nullif(review, '') AS review_reason, CAST(NULL AS VARCHAR) AS reason FROM p WHERE reason IS NULL
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM p WHERE reason IS NOT NULL""")
def address_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses in every town known, with units, several properties, aliases and missing parts; those that cannot be read with their reason."""
    c = read(spark, sf, "customer", ["c_custkey"])
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 9
    names = spark.createDataFrame(list(enumerate(_NAMES)), "i long, name string")
    town = F.when(k % 2 == 0, F.upper("name")).otherwise(F.lower("name"))
    code = F.concat(F.lit("07"), F.lpad(text(k % 1000), 3, "0"))
    main = F.concat(text(k), F.lit("  main\tstreet "))
    raw = (
        F.when(kind == 1, F.concat(main, town, F.lit(" , NJ")))
        .when(kind == 2, F.concat(main, F.lit("unit 4b, "), town, F.lit(", nj "), code, F.lit("-1234")))
        .when(kind == 3, F.concat(main, F.lit("a/k/a 7 side lane, "), town, F.lit(" NJ "), code))
        .when(kind == 4, F.concat(main, F.lit("NJ, "), town, F.lit(" NJ "), code))
        .when(kind == 5, F.concat(F.lit("1 2 3 "), main, town, F.lit(" NJ "), code))
        .when(kind == 6, F.concat(main, F.lower("name"), F.lit("x , NJ "), code))
        .when(kind == 7, F.concat(main, F.lower("name"), F.lit(" "), code))
        .when(kind == 8, F.when(k % 2 == 0, " , "))
        .otherwise(F.concat(main, town, F.lit(", NJ "), code))
    )
    d = c.join(F.broadcast(names), k % len(_NAMES) == F.col("i")).select("c_custkey", raw.alias("raw"))
    good, bad = addresses.normalise_addresses(d, "raw", municipalities(spark))
    wanted = ["c_custkey", "street_address", "unit_number", "city", "zip_code", "normalized_address", "address_hash", "data_quality_score", "needs_manual_review", "review_reason"]
    return good.select(*wanted, F.lit(None).cast("string").alias("reason")).unionByName(bad.select("c_custkey", "reason"), allowMissingColumns=True)


_TOWN_SQL = ", ".join(f"('{county}', '{name}')" for county, names in MUNICIPALITIES.items() for name in names)


@query("municipality_table", f"SELECT * FROM (VALUES {_TOWN_SQL}) AS v(county, municipality)")
def municipality_table(spark: SparkSession, sf: str) -> DataFrame:
    return municipalities(spark)


# --- files -----------------------------------------------------------------------------------------


@query("snapshot_round_trip", """
SELECT 'NJ' AS state, 'Monmouth' AS county, 'FOR-' || CAST(o_orderkey AS VARCHAR) AS sheriff_number, CAST(o_orderdate AS TIMESTAMP) AS sale_date, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS upset_price,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Bank "of" \\ trust' || chr(10) || 'two' END AS plaintiff, CAST(o_totalprice AS DECIMAL(14,2)) + 10 AS judgment_amount, o_orderpriority AS plaintiff_attorney FROM orders""")
def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Listings written as a snapshot of JSON lines and read again: amounts go as text, times in ISO form."""
    o = read(spark, sf, "orders")
    plaintiff = F.when(F.col("o_orderkey") % 3 == 0, 'Bank "of" \\ trust\ntwo')
    listed = o.select(
        F.lit("NJ").alias("state"), F.lit("Monmouth").alias("county"), F.concat(F.lit("FOR-"), text("o_orderkey")).alias("sheriff_number"), F.col("o_orderdate").cast("timestamp").alias("sale_date"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, money("o_totalprice")).alias("upset_price"), plaintiff.alias("plaintiff"), (money("o_totalprice") + 10).cast("decimal(14,2)").alias("judgment_amount"), F.col("o_orderpriority").alias("plaintiff_attorney"),
    )
    folder = shared_folder(spark, "snapshot")
    files.write_snapshot(listed, folder)
    return files.read_snapshot(spark, folder, array=False).select(*listed.columns)


@query("csv_round_trip", """
WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey * 1250.5 END AS amount, c_custkey % 11 = 0 AS odd FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS sheriff_number, CASE WHEN name IS NOT NULL AND amount >= 0 AND NOT odd THEN name END AS name, CASE WHEN name IS NOT NULL AND amount >= 0 AND NOT odd THEN CAST(amount AS DECIMAL(14,2)) END AS estimated_value,
  CASE WHEN name IS NULL THEN 'name is blank' WHEN odd OR amount < 0 THEN 'estimated_value is no amount' END AS reason FROM d""")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV files, with a byte-order mark, padded values, blank rows and amounts in several ways."""
    k = F.col("c_custkey")
    amount = F.when(k % 11 == 0, "about 9").when(k % 5 == 0, F.concat(F.lit("-"), text(k))).otherwise(F.concat(F.lit("$"), F.format_number(k * 1250.5, 2)))
    name = F.when(k % 7 != 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise("  ")
    d = read(spark, sf, "customer", ["c_custkey", "c_name"]).select(text(k).alias("﻿sheriff_number"), name.alias("name"), amount.alias("estimated_value"))
    blank = d.limit(3).select(*[F.lit(None).cast("string").alias(c) for c in d.columns])
    folder = shared_folder(spark, "csv")
    d.unionByName(blank).write.csv(folder, header=True)
    good, bad = files.read_table(spark, folder, ["sheriff_number", "name"], ["estimated_value"])
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("sheriff_number", "reason"), allowMissingColumns=True)


_DEED_SQL = """
lines AS (
  SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS deed, CAST(l_shipdate AS DATE) + 7 AS recorded, CAST(floor(l_extendedprice) AS BIGINT) AS reported, CAST(l_quantity AS INTEGER) AS q, l_suppkey, l_partkey, l_returnflag, l_returnflag, l_linenumber % 6 = 0 AS short FROM lineitem)"""


@query("deed_round_trip", f"""
WITH {_DEED_SQL}
SELECT lpad(CAST(l_suppkey % 21 + 1 AS VARCHAR), 2, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS municipality_code, CASE WHEN l_orderkey % 99999 = 0 THEN '' ELSE CAST(l_orderkey % 99999 AS VARCHAR) END || '.' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS block, CAST(CASE WHEN l_partkey % 99999 = 0 THEN 0 ELSE l_partkey % 99999 END AS VARCHAR) AS lot,
  CAST(reported AS DECIMAL(14,4)) AS reported_price, CAST(reported + 5 AS DECIMAL(14,4)) AS verified_price, CAST(100 AS DECIMAL(14,4)) AS land_assessed, CAST(q AS DECIMAL(14,4)) AS improvement_assessed, CAST(100 + q AS DECIMAL(14,4)) AS total_assessed, CAST(q AS VARCHAR) || ' ' || l_returnflag || ' ST' AS property_location,
  deed AS deed_date, recorded AS recorded_date, CASE l_returnflag WHEN 'R' THEN '07' ELSE '' END AS qualification_codes, CAST(25 AS INTEGER) AS assessment_year, '2' AS property_class, CAST(1900 + q AS INTEGER) AS year_built, CAST(q * 100 AS INTEGER) AS living_space, CAST(2026 AS INTEGER) AS source_year, CAST(NULL AS VARCHAR) AS reason
FROM lines WHERE NOT short
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'line has 662 characters, not 663' FROM lines WHERE short""")
def deed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Deed lines written to files and read again, every field; lines that are too short come back with the reason."""
    line = read(spark, sf, "lineitem")
    left = lambda c, n: F.rpad(text(c), n, " ")
    zero = lambda c, n: F.lpad(text(c), n, "0")
    reported, q, n = F.floor("l_extendedprice"), F.col("l_quantity").cast("int"), F.col("l_linenumber")
    parts = [
        (1, zero(F.col("l_suppkey") % 21 + 1, 2)), (3, zero(n, 2)), (38, zero(reported, 9)), (47, zero(reported + 5, 9)), (56, zero(F.lit(100), 9)), (65, zero(q, 9)), (74, zero(100 + q, 9)), (298, left(F.concat(text(q), F.lit(" "), "l_returnflag", F.lit(" ST")), 25)),
        (339, F.date_format("l_shipdate", "yyMMdd")), (345, F.date_format(F.date_add("l_shipdate", 7), "yyMMdd")), (351, zero(F.col("l_orderkey") % 99999, 5)), (356, left(F.concat(F.lit("."), zero(n, 2)), 4)), (360, zero(F.col("l_partkey") % 99999, 5)), (365, F.lit("    ")),
        (620, left(F.when(F.col("l_returnflag") == "R", "07").otherwise(""), 5)), (625, F.lit("25")), (627, F.lit("2  ")), (653, text(1900 + q)), (657, zero(q * 100, 7)),
    ]
    widths = {1: 2, 3: 2, 38: 9, 47: 9, 56: 9, 65: 9, 74: 9, 298: 25, 339: 6, 345: 6, 351: 5, 356: 4, 360: 5, 365: 4, 620: 5, 625: 2, 627: 3, 653: 4, 657: 7}
    at, columns = 1, []
    for first, value in parts:
        columns += ([F.lit(" " * (first - at))] if first > at else []) + [value]
        at = first + widths[first]
    whole = F.concat(*columns)
    value = F.when(n % 6 == 0, F.substring(whole, 1, 662)).otherwise(whole)
    folder = shared_folder(spark, "deeds")
    fixed_width.write_lines(line.select(value.alias("value")), folder)
    good, bad = fixed_width.parse_deeds(fixed_width.read_lines(spark, folder), 2026)
    return good.drop("source_hash", "source_file", "county_code", "district_code").withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("reason"), allowMissingColumns=True)


@query("county_files", """
SELECT r_name AS county, 'file-' || CAST(r_regionkey AS VARCHAR) AS content FROM region""")
def county_files(spark: SparkSession, sf: str) -> DataFrame:
    """The one file of each county, found by name among all, whatever its spaces and case; read as lines."""
    r = read(spark, sf, "region", ["r_regionkey", "r_name"])
    folder = shared_folder(spark, "counties")
    names = [row.r_name for row in r.collect()]
    for name in names:  # five regions stand for the counties
        one = r.filter(F.col("r_name") == name).select(F.concat(F.lit("file-"), text("r_regionkey")).alias("value"))
        one.coalesce(1).write.text(f"{folder}/{name.lower().replace(' ', '_')}26.txt")
    parts = []
    for name in names:
        path = files.one_county_file(spark, f"{folder}/*/part-*", name, folder=True)
        parts.append(spark.read.text(path).select(F.lit(name).alias("county"), F.col("value").alias("content")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- sort keys and streams -------------------------------------------------------------------------


@query("natural_sort_key", """
WITH d AS (
  SELECT p_partkey, p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN '' ELSE repeat('0', CAST(p_partkey % 3 AS INTEGER)) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'X' END || CAST(p_size AS VARCHAR) || repeat('7', CAST(p_partkey % 20 AS INTEGER)) || 'b' || CAST(p_partkey AS VARCHAR) END AS t, p_brand FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(t, '') = '', CASE WHEN t <> '' THEN CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END END, CASE WHEN t <> '' THEN length(p_size || repeat('7', CAST(p_partkey % 20 AS INTEGER))) END, CASE WHEN t <> '' THEN p_size || repeat('7', CAST(p_partkey % 20 AS INTEGER)) END, p_partkey) AS INTEGER) AS place,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST, p_partkey) AS INTEGER) AS by_size FROM d""")
def natural_sort_key(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with numbers of up to 22 digits and leading zeros, nulls and empty texts, in natural order; and numbers by value."""
    from pyspark.sql import Window

    k = F.col("p_partkey")
    word = F.concat(F.repeat(F.lit("0"), (k % 3).cast("int")), F.when(k % 2 == 0, "x").otherwise("X"), text("p_size"), F.repeat(F.lit("7"), (k % 20).cast("int")), F.lit("b"), text(k))
    p = read(spark, sf, "part", ["p_partkey", "p_brand", "p_size"]).withColumn("t", F.when(k % 9 == 1, "").when(k % 9 != 0, word))
    own = Window.partitionBy("p_brand")
    by_text, by_size = own.orderBy(*R.missing_last("t"), "p_partkey"), own.orderBy(*R.missing_last("p_size", True, True), "p_partkey")
    return p.select("p_partkey", F.row_number().over(by_text).alias("place"), F.row_number().over(by_size).alias("by_size"))


@query("stream_contents", """
SELECT user_id, event_type, CAST(round(value) AS BIGINT) AS rounded FROM events GROUP BY ALL""")
def stream_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream: each user's contents once, appended to a table; the stream runs twice and the second run adds nothing."""
    e = read(spark, sf, "events")
    folder = shared_folder(spark, "stream")
    e.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in").select("user_id", "event_type", F.round("value").cast("long").alias("rounded"))
    for _ in range(2):
        incremental.append_available(incremental.first_contents(stream, ["user_id"], ["event_type", "rounded"]), f"{folder}/table", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/table").drop("content_hash")


@query("stream_changes", """
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR before IS DISTINCT FROM event_type""")
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream: the rows in which a user's kind of event changes, from keyed state."""
    e = read(spark, sf, "events", ["event_id", "user_id", "ts", "event_type"])
    folder = shared_folder(spark, "stream")
    e.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in")
    incremental.append_available(incremental.changed_rows(stream, ["user_id"], ["ts", "event_id"], ["event_type"]), f"{folder}/table", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/table").drop("ts")


# --- every field of an assessment line; numbers of one county -------------------------------------------


@query("fixed_width_parse", """
WITH d AS (SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS n, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey % 37 = 5 AS short FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT lpad(CAST(n AS VARCHAR), 4, '0') AS municipality_code, CASE WHEN c = 0 THEN '0' ELSE CAST(c AS VARCHAR) END AS block, CASE WHEN k % 9999 = 0 THEN '' ELSE CAST(k % 9999 AS VARCHAR) END || '.0' || CAST(k % 10 AS VARCHAR) AS lot, CASE WHEN k % 4 = 0 THEN 'C0' || CAST(k % 10 AS VARCHAR) ELSE '' END AS qualifier,
  lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS record_id, CASE WHEN k % 5 = 0 THEN '4A' ELSE '2' END AS property_class, CAST(k % 1000 AS VARCHAR) || ' ÉMILE ST' AS property_location, '2S-F-' || CAST(c % 9 AS VARCHAR) AS building_description, '50X' || CAST(c % 300 AS VARCHAR) AS land_description,
  CAST((k % 100000) / 10000.0 AS DECIMAL(14,4)) AS acreage, 'R' || CAST(k % 10 AS VARCHAR) AS zoning, CASE WHEN k % 29 = 0 THEN NULL ELSE day END AS deed_date, CAST(price AS DECIMAL(14,4)) AS sale_price, lpad(CAST(k % 33 AS VARCHAR), 2, '0') AS sale_nonusable_code, CAST(c % 50 AS VARCHAR) AS building_class,
  CAST(1900 + k % 125 AS INTEGER) AS year_built, CAST(k % 90000 + 1000 AS DECIMAL(14,4)) AS land_assessed, CAST(k % 700000 AS DECIMAL(14,4)) AS improvement_assessed, CASE WHEN k % 31 <> 0 THEN CAST(k % 790000 + 1000 AS DECIMAL(14,4)) END AS total_assessed, lpad(CAST(c % 1000 AS VARCHAR), 5, '0') AS census_tract,
  lpad(CAST(c % 90 AS VARCHAR), 4, '0') AS census_block, lpad(CAST(c % 500 AS VARCHAR), 3, '0') AS property_use_code, CAST(price * 3 / 100.0 AS DECIMAL(14,4)) AS annual_property_tax, CAST(2026 AS INTEGER) AS source_year, CAST(NULL AS VARCHAR) AS reason
FROM d WHERE NOT short
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'line has 640 characters, not 700' FROM d WHERE short""")
def fixed_width_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Assessment lines written to Latin-1 files and read again, every field; lines that are too short come back with the reason."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    k, n, price = F.col("o_orderkey"), F.col("o_custkey"), F.floor("o_totalprice")
    left = lambda c, size: F.rpad(text(c), size, " ")
    zero = lambda c, size: F.lpad(text(c), size, "0")
    parts = [
        (1, 4, zero("c_nationkey", 4)), (5, 9, zero(n, 9)), (14, 9, F.concat(zero(k % 9999, 6), F.lit(".0"), text(k % 10))), (23, 11, left(F.when(k % 4 == 0, F.concat(F.lit("c0 "), text(k % 10))).otherwise(""), 11)), (34, 2, zero(k % 100, 2)), (56, 3, left(F.when(k % 5 == 0, "4A").otherwise("2"), 3)),
        (59, 25, left(F.concat(text(k % 1000), F.lit(" ÉMILE ST")), 25)), (84, 15, left(F.concat(F.lit("2S-F-"), text(n % 9)), 15)), (99, 20, left(F.concat(F.lit("50X"), text(n % 300)), 20)), (119, 9, zero(k % 100000, 9)), (168, 4, left(F.concat(F.lit("R"), text(k % 10)), 4)),
        (307, 6, F.when(k % 29 == 0, "000000").otherwise(F.date_format("o_orderdate", "yyMMdd"))), (313, 9, zero(price, 9)), (331, 2, zero(k % 33, 2)), (411, 5, left(n % 50, 5)), (416, 4, text(1900 + k % 125)), (421, 9, left(F.format_number(k % 90000 + 1000, 0), 9)), (430, 9, zero(k % 700000, 9)),
        (439, 9, F.when(k % 31 == 0, "n/a      ").otherwise(zero(k % 790000 + 1000, 9))), (551, 5, zero(n % 1000, 5)), (556, 4, zero(n % 90, 4)), (560, 3, zero(n % 500, 3)), (601, 12, zero(price * 3, 12)), (700, 1, F.lit(".")),
    ]
    at, columns = 1, []
    for first, size, value in parts:
        columns += ([F.lit(" " * (first - at))] if first > at else []) + [value]
        at = first + size
    whole = F.concat(*columns)
    folder = shared_folder(spark, "assessments")
    line = F.when(k % 37 == 5, F.rpad(F.substring(whole, 1, 612), 640, ".")).otherwise(whole)
    spread(o.join(c, o.o_custkey == c.c_custkey)).select(line.alias("value")).write.option("encoding", "ISO-8859-1").text(folder)
    good, bad = fixed_width.parse_assessments(fixed_width.read_lines(spark, folder), 2026)
    return good.drop("source_hash", "source_file").withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("reason"), allowMissingColumns=True)


@query("county_listing_rows", """
SELECT upper(substr('abcd', 1, CAST(c_custkey % 4 + 1 AS INTEGER))) || '-' || CAST(c_custkey AS VARCHAR) AS sheriff_number, DATE '2026-01-01' + CAST(c_custkey % 300 AS INTEGER) AS sale_date, 'Bank' AS plaintiff, c_name AS defendant, CAST(c_custkey AS VARCHAR) || ' Elm St' AS address,
  CASE WHEN c_custkey % 2 = 0 THEN 'scheduled' ELSE 'stayed' END AS status FROM customer WHERE c_custkey % 10 <> 9""")
def county_listing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A listing whose sale numbers have a county's own letters; rows whose number is written otherwise go."""
    k = F.col("c_custkey")
    number = F.when(k % 10 == 9, F.concat(F.lit("No "), text(k))).otherwise(F.concat(F.substring(F.lit("abcd"), F.lit(1), (k % 4 + 1).cast("int")), F.lit("-"), text(k)))
    cells = [number, F.when(k % 2 == 0, "Scheduled").otherwise("Stay granted"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")), "M/d/yyyy"), F.lit("Bank"), F.col("c_name"), F.concat(text(k), F.lit(" Elm St"))]
    row = F.concat(*[x for cell in cells for x in (F.lit("<td>"), cell, F.lit("</td>"))])
    head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in ("Sheriff #", "Status", "Sales Date", "Plaintiff", "Defendant", "Address")) + "</tr><tr>"
    d = spread(read(spark, sf, "customer", ["c_custkey", "c_name"]).select(k.alias("page_id"), F.concat(F.lit(head), row, F.lit("</tr></table>")).alias("html")))
    listed = pages.sale_listing(d, "page_id", "html", pages.COUNTY_SALE_NUMBER)
    return listed.select("sheriff_number", "sale_date", "plaintiff", "defendant", "address", "status")
