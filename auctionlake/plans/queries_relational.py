"""Joins, aggregates, windows, order and pages on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auctionlake.domain.scoring import event_counts
from auctionlake.domain.valuation import metrics
from auctionlake.functions.text import address_key, alias_key, map_number
from auctionlake.operators import relational as R
from auctionlake.operators import windows as W
from auctionlake.operators.fuzzy import best_matches, conservative_accept
from auctionlake.operators.spatial import knn_within
from auctionlake.plans.catalog import query
from auctionlake.plans.common import big, money, read


@query("inner_join_filter", """
SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_orderdate >= TIMESTAMP '1995-01-01'""")
def inner_join_filter(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    c = read(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    o = R.where_all(o, [F.col("o_orderstatus") == "O", F.col("o_totalprice") >= 1000, F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"), None])
    c = R.where_all(c, [F.col("c_mktsegment").isin("BUILDING", "MACHINERY")])
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@query("left_join_chain", """
SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def left_join_chain(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = read(spark, sf, "customer", ["c_custkey", "c_nationkey"]), read(spark, sf, "nation"), read(spark, sf, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r.filter("r_name <> 'ASIA'"), n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"])
    return R.largest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("lateral_aggregate", """
SELECT c_custkey, coalesce(n, 0) AS n_orders, open_total, last_date FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (WHERE o_orderstatus = 'O') AS open_total, max(o_orderdate) AS last_date FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def lateral_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    a = o.groupBy("o_custkey").agg(F.count("*").alias("n"), R.filtered_sum(money("o_totalprice"), F.col("o_orderstatus") == "O").alias("open_total"), F.max("o_orderdate").alias("last_date"))
    c = read(spark, sf, "customer", ["c_custkey"])
    return c.join(a, c.c_custkey == a.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "open_total", "last_date")


_REASONS_SQL = """CASE WHEN l_discount > 0.08 THEN 'deep_discount' END, CASE WHEN l_tax = 0 THEN 'untaxed' END,
    CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_quantity < 5 THEN 'small_lot' END"""


@query("unnest_reasons", f"""
SELECT reason, count(*) AS records FROM (SELECT unnest(list_filter([{_REASONS_SQL}], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY reason""")
def unnest_reasons(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem", ["l_discount", "l_tax", "l_returnflag", "l_quantity"])
    labels = R.reasons([(F.col("l_discount") > 0.08, "deep_discount"), (F.col("l_tax") == 0, "untaxed"), (F.col("l_returnflag") == "R", "returned"), (F.col("l_quantity") < 5, "small_lot")])
    return R.count_reasons(d.select(labels.alias("why")), "why")


@query("nearest_year_match", """
WITH sale AS (SELECT o_orderkey, o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
snap AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS k, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem WHERE year(l_shipdate) % 2 = 0 AND l_linenumber = 1),
years AS (SELECT DISTINCT y FROM snap), near AS (
  SELECT s.y AS sy, arg_min(years.y, struct_pack(d := abs(years.y - s.y), y := years.y)) AS cy FROM (SELECT DISTINCT y FROM sale) AS s, years GROUP BY s.y),
j AS (SELECT o_orderkey, cy, count(id) AS n, min(id) AS lowest FROM sale JOIN near ON sale.y = sy LEFT JOIN snap ON snap.k = sale.k AND snap.y = cy GROUP BY 1, 2)
SELECT o_orderkey, cy AS chosen_year, n AS candidates, CASE WHEN n = 1 THEN lowest END AS match_id,
  CASE WHEN n = 1 THEN 'EXACT' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS match_status FROM j""")
def nearest_year_match(spark: SparkSession, sf: str) -> DataFrame:
    sales = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    snaps = read(spark, sf, "lineitem").filter("year(l_shipdate) % 2 = 0 AND l_linenumber = 1").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"))
    return R.nearest_year_match(sales, snaps, "o_orderkey", "y", "y", ["k"], "id")


@query("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    urgent = read(spark, sf, "orders", ["o_custkey", "o_orderpriority"]).filter("o_orderpriority = '1-URGENT'")
    c = read(spark, sf, "customer", ["c_custkey", "c_name"])
    return c.join(urgent, c.c_custkey == urgent.o_custkey, "left_semi")


@query("anti_not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    done = read(spark, sf, "orders", ["o_custkey", "o_orderstatus"]).filter("o_orderstatus = 'F'")
    c = read(spark, sf, "customer", ["c_custkey", "c_name"])
    return c.join(done, c.c_custkey == done.o_custkey, "left_anti")


_TIERS = """WITH l AS (SELECT p_partkey, p_name AS k0, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS k1, p_brand || '|' || CAST(p_size AS VARCHAR) AS k2 FROM part),
r AS (SELECT min(p_partkey) AS target, p_name AS n, max(p_brand) AS b, max(p_size) AS s FROM part WHERE p_partkey % 3 = 0 GROUP BY p_name),
rr AS (SELECT target, CASE WHEN target % 2 = 0 THEN n END AS k0, upper(regexp_replace(n, '[^A-Za-z0-9]', '', 'g')) AS k1, b || '|' || CAST(s AS VARCHAR) AS k2 FROM r WHERE target % 6 <> 3 OR s > 25),
h AS (SELECT p_partkey, target, 0 AS t, 'exact' AS method FROM l JOIN rr ON l.k0 = rr.k0 UNION ALL SELECT p_partkey, target, 1, 'normalised' FROM l JOIN rr ON l.k1 = rr.k1 UNION ALL SELECT p_partkey, target, 2, 'crosswalk' FROM l JOIN rr ON l.k2 = rr.k2),
f AS (SELECT p_partkey, min(t) AS t FROM h GROUP BY p_partkey)
SELECT part.p_partkey, b.target, b.method FROM part LEFT JOIN (SELECT DISTINCT h.p_partkey, h.target, h.method FROM h JOIN f ON h.p_partkey = f.p_partkey AND h.t = f.t) AS b ON part.p_partkey = b.p_partkey"""


@query("tiered_match_cascade", _TIERS)
def tiered_match_cascade(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    r = p.filter("p_partkey % 3 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("target"), F.max("p_brand").alias("b"), F.max("p_size").alias("s")).filter("target % 6 <> 3 OR s > 25")
    key = lambda c: F.upper(alias_key(F.col(c)))
    tiers = [
        ("exact", F.col("p_name"), F.when(F.col("target") % 2 == 0, F.col("p_name"))),
        ("normalised", key("p_name"), key("p_name")),
        ("crosswalk", F.concat_ws("|", "p_brand", F.col("p_size").cast("string")), F.concat_ws("|", "b", F.col("s").cast("string"))),
    ]
    return R.tiered_match(p, r, "p_partkey", tiers, "target")


@query("or_key_join", """
WITH k AS (SELECT upper(replace(p_name, ' ', '')) AS a, upper(p_brand) AS b FROM part WHERE p_size = 10)
SELECT p_partkey, p_name FROM part WHERE upper(replace(p_name, ' ', '')) IN (SELECT a FROM k) OR upper(replace(p_name, ' ', '')) IN (SELECT b FROM k)""")
def or_key_join(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    key = lambda c: F.upper(F.replace(F.col(c), F.lit(" ")))
    return R.either_key(p, p.filter("p_size = 10"), key("p_name"), [key("p_name"), F.upper("p_brand")]).select("p_partkey", "p_name")


@query("spatial_knn", """
WITH p AS (SELECT vec_id, 40 + CAST(embedding[1] AS DOUBLE) AS lat, -74 + CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings),
d AS (SELECT t.vec_id, s.vec_id AS near_id, 2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2)))) AS miles
  FROM p AS t JOIN p AS s ON t.vec_id <> s.vec_id WHERE t.vec_id % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY miles, near_id) AS k FROM d)
SELECT vec_id, near_id, round(miles, 4) AS miles, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 20 AND miles <= 5""")
def spatial_knn(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings", ["vec_id", "embedding"])
    p = e.select("vec_id", (40 + F.col("embedding")[0].cast("double")).alias("lat"), (-74 + F.col("embedding")[1].cast("double")).alias("lon"))
    near = knn_within(p.filter("vec_id % 5 = 0"), p.withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", "lat", "lon", 20, 5.0, itself=False)
    return near.withColumn("miles", F.round("miles", 4))


@query("conditional_agg", """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, sum(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (WHERE o_orderstatus = 'F') AS done_total,
  min(o_orderdate) FILTER (WHERE o_totalprice > 1000) AS first_large, CAST(sum(o_custkey) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS key_sum FROM orders GROUP BY o_orderpriority""")
def conditional_agg(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), R.filtered_count(s == "O").alias("n_open"), R.filtered_sum(money("o_totalprice"), s == "F").alias("done_total"),
        F.min(F.when(F.col("o_totalprice") > 1000, F.col("o_orderdate"))).alias("first_large"), R.filtered_sum(F.col("o_custkey"), s == "P").alias("key_sum"),
    )


@query("ordered_struct_json", """
SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag || ':' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ',' ORDER BY l_quantity DESC NULLS LAST, l_linenumber, l_returnflag) AS items, bool_or(l_returnflag = 'R') AS any_returned
FROM lineitem GROUP BY l_orderkey""")
def ordered_struct_json(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"])
    item = F.concat_ws(":", F.col("l_linenumber").cast("string"), "l_returnflag", F.col("l_quantity").cast("int").cast("string"))
    order = [F.col("l_quantity").isNull(), -F.col("l_quantity"), F.col("l_linenumber"), F.col("l_returnflag")]
    return d.groupBy("l_orderkey").agg(F.array_join(R.ordered_list(order, item), ",").alias("items"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


@query("unanimous_dimension", """
SELECT c_nationkey, min(c_mktsegment) AS segment FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN 'ONE' ELSE c_mktsegment END AS c_mktsegment FROM customer) GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) = 1""")
def unanimous_dimension(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer", ["c_nationkey", "c_mktsegment"]).select("c_nationkey", F.when(F.col("c_nationkey") % 3 == 0, "ONE").otherwise(F.col("c_mktsegment")).alias("segment"))
    return R.unanimous(c, "c_nationkey", "segment")


@query("group_median", """
SELECT c_mktsegment, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, round(median(o_totalprice), 4) AS median_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def group_median(spark: SparkSession, sf: str) -> DataFrame:
    d = _segment_orders(spark, sf)
    return W.group_medians(d, ["c_mktsegment"], W.quarter(F.col("o_orderdate")), {"median_price": F.col("o_totalprice")}).withColumn("median_price", F.round("median_price", 4))


def _segment_orders(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"]), read(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    return o.join(c, o.o_custkey == c.c_custkey)


@query("event_bucket_counts", """
WITH e AS (SELECT DISTINCT user_id, CASE WHEN value > 40 THEN 'adjourned' ELSE event_type END AS s, CASE WHEN value > 80 THEN 'adjourned by defendant' WHEN value > 60 THEN 'adjourned, plaintiff' WHEN value > 40 THEN 'adjourned' WHEN value > 35 THEN 'bankruptcy' ELSE event_type END AS r, CAST(ts AS DATE) AS d FROM events)
SELECT user_id, count(*) FILTER (WHERE r = 'adjourned, plaintiff') AS plaintiff_adjournments, count(*) FILTER (WHERE r = 'adjourned by defendant') AS defendant_adjournments, count(*) FILTER (WHERE r = 'adjourned') AS generic_adjournments, count(*) FILTER (WHERE r = 'bankruptcy') AS bankruptcy_events, count(*) AS distinct_status_events FROM e GROUP BY user_id""")
def event_bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    raw = F.when(v > 80, "Adjourned by Defendant").when(v > 60, "adjourned, plaintiff").when(v > 40, "").when(v > 35, "Bankruptcy").otherwise(F.col("event_type"))
    e = read(spark, sf, "events", ["user_id", "event_type", "value", "ts"])
    return event_counts(e.select("user_id", F.when(v > 40, "Adjourned").otherwise(F.col("event_type")).alias("status"), raw.alias("raw_status"), F.col("ts").alias("sale_date")), "user_id")


@query("model_metrics", """
WITH d AS (SELECT o_totalprice AS a, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS p FROM orders),
m AS (SELECT count(*) AS rows, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, median(abs(a - p)) AS median_error, avg(abs(a - p) / nullif(abs(a), 0)) AS mape,
  avg(CASE WHEN a = 0 THEN NULL WHEN abs(a - p) / abs(a) <= 0.1 THEN 1.0 ELSE 0.0 END) AS w10, avg(CASE WHEN a = 0 THEN NULL WHEN abs(a - p) / abs(a) <= 0.2 THEN 1.0 ELSE 0.0 END) AS w20,
  sum((a - p) * (a - p)) AS rss, var_pop(a) * count(*) AS tss FROM d)
SELECT rows, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(median_error, 3) AS median_error, round(mape, 4) AS mape, round(w10, 4) AS within_10, round(w20, 4) AS within_20, round(1 - rss / tss, 4) AS r2 FROM m""")
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_totalprice", "o_orderpriority"])
    d = o.withColumn("p", F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority")))
    digits = {"mae": 3, "rmse": 3, "median_error": 3, "mape": 4, "within_10": 4, "within_20": 4, "r2": 4}
    return metrics(d, "o_totalprice", "p").select("rows", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query("upper_quartile_flag", """
WITH q AS (SELECT list_sort(list(CAST(o_totalprice AS DECIMAL(14,2))))[CAST(floor((count(*) - 1) * 0.75) AS INTEGER) + 1] AS t, avg(CAST(o_totalprice AS DECIMAL(14,2))) AS a FROM orders)
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) AS price, t AS threshold, CAST(o_totalprice AS DECIMAL(14,2)) >= t AND o_totalprice > 0 AS high FROM orders, q""")
def upper_quartile_flag(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", money("o_totalprice").alias("price"))
    t = R.nearest_rank_quartile(o, "price")
    return o.join(F.broadcast(t), how="cross").withColumn("high", (F.col("price") >= F.col("threshold")) & (F.col("price") > 0))


@query("page_with_total", """
SELECT o_orderkey, o_orderdate, count(*) OVER () AS total_rows FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""")
def page_with_total(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus"]).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return R.page_with_total(o, [F.asc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 3, 50)


@query("lag_group_median", """
WITH m AS (SELECT c_mktsegment, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, median(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, period, round(lag(v) OVER (PARTITION BY c_mktsegment ORDER BY period), 4) AS prior_median FROM m""")
def lag_group_median(spark: SparkSession, sf: str) -> DataFrame:
    m = W.group_medians(_segment_orders(spark, sf), ["c_mktsegment"], W.quarter(F.col("o_orderdate")), {"v": F.col("o_totalprice")})
    return W.prior_period(m, ["c_mktsegment"], "v", "prior_median").select("c_mktsegment", "period", F.round("prior_median", 4).alias("prior_median"))


@query("trailing4_median", """
SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) AS trailing FROM events""")
def trailing4_median(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events", ["event_id", "user_id", "ts", "value"])
    return W.trailing_median(e, ["user_id"], ["ts", "event_id"], "value", "trailing").select("event_id", F.round("trailing", 4).alias("trailing"))


@query("prior_event_gap", """
SELECT o_orderkey, lag(o_totalprice) OVER w AS prior_value, round(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) / 30.4375, 4) AS months_since_prior
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def prior_event_gap(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    d = W.prior_event(o, ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice")
    return d.select("o_orderkey", "prior_value", F.round("months_since_prior", 4).alias("months_since_prior"))


@query("range_history", """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, date_trunc('quarter', o_orderdate) AS q FROM orders)
SELECT t.o_orderkey, count(*) AS n_before, round(sum(h.o_totalprice), 2) AS total_before FROM o AS t JOIN o AS h ON h.o_custkey = t.o_custkey AND h.o_orderdate < t.q AND h.o_orderdate >= t.q - INTERVAL 2 YEAR GROUP BY t.o_orderkey""")
def range_history(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    pairs = W.history_before(o, o, "o_orderkey", "o_custkey", "o_orderdate")
    return pairs.groupBy("o_orderkey").agg(F.count("*").alias("n_before"), F.round(F.sum("h_o_totalprice"), 2).alias("total_before"))


@query("status_change_history", """
WITH e AS (SELECT event_id, user_id, ts, event_type, CAST(floor(value / 50) AS INTEGER) AS level FROM events),
l AS (SELECT *, lag(event_type) OVER w AS pt, lag(level) OVER w AS pl, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, level FROM l WHERE rn = 1 OR event_type IS DISTINCT FROM pt OR level IS DISTINCT FROM pl""")
def status_change_history(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.floor(F.col("value") / 50).cast("int").alias("level"))
    return W.changes(e, ["user_id"], ["ts", "event_id"], ["event_type", "level"]).drop("ts")


@query("nulls_sort", """
WITH d AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'O' END AS is_open FROM orders)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC NULLS LAST, o_orderkey) AS INTEGER) AS by_price, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY is_open DESC NULLS FIRST, o_orderkey) AS INTEGER) AS by_flag FROM d""")
def nulls_sort(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "O").alias("is_open"))
    own = Window.partitionBy("o_custkey")
    price, flag = own.orderBy(F.desc_nulls_last("price"), "o_orderkey"), own.orderBy(F.desc_nulls_first("is_open"), "o_orderkey")
    return d.select("o_orderkey", F.row_number().over(price).alias("by_price"), F.row_number().over(flag).alias("by_flag"))


@query("page_arithmetic", """
SELECT o_orderstatus, count(*) AS total_rows, CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS total_pages, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE 101 END AS BIGINT) AS first_row, CAST(least(count(*), 150) AS BIGINT) AS last_row FROM orders GROUP BY o_orderstatus""")
def page_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "orders", ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("total_rows"))
    return n.withColumns(dict(R.page_arithmetic(F.col("total_rows"), 3, 50)))


@query("case_insensitive_filter", """
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ar%' AND lower(p_brand) = lower('BRAND#12') AND p_retailprice BETWEEN 900 AND 1500""")
def case_insensitive_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_retailprice"])
    return R.where_all(p, [F.col("p_name").ilike("%ar%"), F.lower("p_brand") == "brand#12", F.col("p_retailprice").between(900, 1500)]).select("p_partkey", "p_name")


@query("source_counts", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(min(event_id) AS BIGINT) AS first_id FROM events GROUP BY event_type HAVING count(DISTINCT user_id) > 1""")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events", ["event_type", "user_id", "event_id"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), big(F.min("event_id")).alias("first_id")).filter("users > 1")


@query("map_number_normalise", r"""
SELECT c_custkey, nullif(regexp_replace(regexp_replace(upper(regexp_replace(c_name || ' / ' || CAST(c_nationkey AS VARCHAR) || '_', '\s+', '', 'g')), '[._/\\-]+', '.', 'g'), '^\.+|\.+$', '', 'g'), '') AS map_number FROM customer""")
def map_number_normalise(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey"])
    return c.select("c_custkey", map_number(F.concat("c_name", F.lit(" / "), F.col("c_nationkey").cast("string"), F.lit("_"))).alias("map_number"))
