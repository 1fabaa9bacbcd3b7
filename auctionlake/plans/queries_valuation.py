"""Features that never look ahead, and the gate that a model has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.domain import valuation
from auctionlake.plans.catalog import query
from auctionlake.plans.common import money, read, shared_folder

_SALES_SQL = """
d AS (
  SELECT o_orderkey, c_nationkey AS town, c_mktsegment AS tract, c_custkey AS lot, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(o_totalprice AS DECIMAL(14,2)) AS price, 600 + o_orderkey % 1900 AS area,
    CASE WHEN c_custkey % 19 <> 0 THEN 38 + c_nationkey * 0.25 + (c_custkey * 7919 % 997) / 12000 END AS lat, -75 + (c_custkey * 104729 % 991) / 9000 AS lon
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]), read(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    k = F.col("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", F.col("c_nationkey").alias("municipality_code"), F.lit("1").alias("block"), k.alias("lot"), F.col("c_mktsegment").alias("census_tract"), F.to_date("o_orderdate").alias("deed_date"), money("o_totalprice").alias("sale_price"),
        (600 + F.col("o_orderkey") % 1900).alias("living_space"), F.when(k % 19 != 0, 38 + F.col("c_nationkey") * 0.25 + (k * 7919 % 997) / 12000).alias("latitude"), (-75 + (k * 104729 % 991) / 9000).alias("longitude"),
    )


@query("leakage_free_features", f"""
WITH {_SALES_SQL},
m AS (SELECT town, q, median(CAST(price AS DOUBLE)) AS v, median(CAST(price AS DOUBLE) / area) AS w FROM d GROUP BY 1, 2),
f AS (SELECT town, q, lag(v) OVER (PARTITION BY town ORDER BY q) AS prior, lag(w) OVER (PARTITION BY town ORDER BY q) AS prior_ppsf, median(v) OVER four AS before4, median(w) OVER four AS before4_ppsf FROM m WINDOW four AS (PARTITION BY town ORDER BY q ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
t AS (SELECT tract, q, lag(v) OVER (PARTITION BY tract ORDER BY q) AS prior FROM (SELECT tract, q, median(CAST(price AS DOUBLE)) AS v FROM d GROUP BY 1, 2))
SELECT o_orderkey, round(f.prior, 4) AS prior_quarter, round(prior_ppsf, 4) AS prior_quarter_ppsf, round(before4, 4) AS trailing_4q, round(before4_ppsf, 4) AS trailing_4q_ppsf, round(t.prior, 4) AS tract_prior_quarter,
  lag(price) OVER w AS prior_sale, round(date_diff('day', lag(day) OVER w, day) / 30.4375, 6) AS months_since
FROM d JOIN f ON d.town = f.town AND d.q = f.q JOIN t ON d.tract = t.tract AND d.q = t.q WINDOW w AS (PARTITION BY d.town, lot ORDER BY day, price)""")
def leakage_free_features(spark: SparkSession, sf: str) -> DataFrame:
    f = valuation.market_features(_sales(spark, sf))
    rounded = {"municipality_prior_quarter_median_price": "prior_quarter", "municipality_prior_quarter_median_ppsf": "prior_quarter_ppsf", "municipality_trailing_4q_median_price": "trailing_4q", "municipality_trailing_4q_median_ppsf": "trailing_4q_ppsf", "tract_prior_quarter_median_price": "tract_prior_quarter"}
    return f.select("o_orderkey", *[F.round(c, 4).alias(n) for c, n in rounded.items()], F.col("prior_parcel_sale_price").alias("prior_sale"), F.round("months_since_prior_sale", 6).alias("months_since"))


@query("distance_features", f"""
WITH {_SALES_SQL},
pairs AS (
  SELECT t.o_orderkey AS id, p.o_orderkey AS other, p.price, p.area, 2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - t.lon) / 2), 2)))) AS miles
  FROM d AS t JOIN d AS p ON p.day < t.q AND p.day >= t.q - INTERVAL 24 MONTH AND abs(p.lat - t.lat) < 0.08 AND abs(p.lon - t.lon) < 0.2),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(miles, 9), other) AS k FROM pairs WHERE miles <= 5),
comps AS (SELECT id, median(CAST(price AS DOUBLE)) AS mp, median(CAST(price AS DOUBLE) / area) AS mq, median(miles) AS mm, count(*) AS n FROM near WHERE k <= 20 GROUP BY id)
SELECT o_orderkey, round(mp, 4) AS comp_price, round(mq, 4) AS comp_ppsf, round(mm, 6) AS comp_miles, CAST(coalesce(n, 0) AS BIGINT) AS comp_count FROM d LEFT JOIN comps ON id = o_orderkey""")
def distance_features(spark: SparkSession, sf: str) -> DataFrame:
    f = valuation.distance_features(_sales(spark, sf), "o_orderkey")
    return f.select("o_orderkey", F.round("local_comp_median_price", 4).alias("comp_price"), F.round("local_comp_median_ppsf", 4).alias("comp_ppsf"), F.round("local_comp_median_miles", 6).alias("comp_miles"), F.col("local_comp_count").alias("comp_count"))


# Two simple models stand for the candidates: the median price of a customer's segment, and that of a status, scaled by the assessed value's.
_GATE_SQL = """
s AS (SELECT o_orderkey, year(o_orderdate) AS y, CAST(o_totalprice AS DOUBLE) AS price, 1000.0 + o_custkey % 977 * 200 AS assessed, c_mktsegment AS segment, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey),
cut AS (SELECT max(y) - 2 AS last FROM s),
train AS (SELECT s.* FROM s, cut WHERE y <= last), later AS (SELECT s.*, CASE WHEN y = last + 1 THEN 'validation' ELSE 'test' END AS partition FROM s, cut WHERE y > last),
by_segment AS (SELECT segment, median(price) AS p FROM train GROUP BY 1), by_priority AS (SELECT priority, median(price / assessed) AS r FROM train GROUP BY 1), ratio AS (SELECT median(price / assessed) AS r FROM train),
pred AS (SELECT partition, price, by_segment.p AS segment_median, assessed * by_priority.r AS priority_ratio, assessed * ratio.r AS training_median_ratio, assessed AS assessed_value FROM later JOIN by_segment USING (segment) JOIN by_priority USING (priority), ratio),
long AS (UNPIVOT pred ON segment_median, priority_ratio, training_median_ratio, assessed_value INTO NAME candidate VALUE v),
measured AS (
  SELECT partition, candidate, count(*) AS rows, avg(abs(price - v)) AS mae, sqrt(avg(pow(price - v, 2))) AS rmse, median(abs(price - v)) AS median_error, avg(abs(price - v) / price) AS mape,
    avg(CASE WHEN abs(price - v) / price <= 0.1 THEN 1.0 ELSE 0 END) AS within_10, avg(CASE WHEN abs(price - v) / price <= 0.2 THEN 1.0 ELSE 0 END) AS within_20, 1 - sum(pow(price - v, 2)) / (var_pop(price) * count(*)) AS r2
  FROM long GROUP BY ALL)"""


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"]), read(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    s = o.join(c, o.o_custkey == c.c_custkey).select(F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("double").alias("price"), (1000.0 + F.col("o_custkey") % 977 * 200).alias("assessed_value"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))
    last = s.agg(F.max("y")).first()[0] - 2
    train, validation, test = valuation.split_by_year(s, "y", last)
    later = validation.withColumn("partition", F.lit("validation")).unionByName(test.withColumn("partition", F.lit("test")))
    by_segment = train.groupBy("segment").agg(F.median("price").alias("segment_median"))
    by_priority = train.groupBy("priority").agg(F.median(F.col("price") / F.col("assessed_value")).alias("r_"))
    predicted = valuation.with_ratio_baseline(train, later.join(by_segment, "segment").join(by_priority, "priority"), "price", "assessed_value").withColumn("priority_ratio", F.col("assessed_value") * F.col("r_"))
    return valuation.candidate_metrics(predicted, "price", ["segment_median", "priority_ratio", valuation.BASELINE, "assessed_value"])


@query("candidate_metrics", f"""
WITH {_GATE_SQL}
SELECT partition, candidate, rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(median_error, 4) AS median_error, round(mape, 6) AS mape, round(within_10, 6) AS within_10, round(within_20, 6) AS within_20, round(r2, 6) AS r2 FROM measured""")
def candidate_metrics(spark: SparkSession, sf: str) -> DataFrame:
    four, six = ["mae", "rmse", "median_error"], ["mape", "within_10", "within_20", "r2"]
    return _measured(spark, sf).select("partition", "candidate", "rows", *[F.round(c, 4).alias(c) for c in four], *[F.round(c, 6).alias(c) for c in six])


@query("promotion_gate", f"""
WITH {_GATE_SQL},
pools AS (SELECT * FROM (VALUES ('both', 'segment_median', 1), ('both', 'priority_ratio', 2), ('ratio only', 'priority_ratio', 1), ('assessed only', 'assessed_value', 1)) AS v(pool, candidate, place)),
chosen AS (SELECT pool, candidate FROM (SELECT pool, candidate, row_number() OVER (PARTITION BY pool ORDER BY mae, place) AS k FROM pools JOIN measured USING (candidate) WHERE partition = 'validation') WHERE k = 1)
SELECT pool, c.candidate AS selected_candidate, min(CAST(m.mae < b.mae AS INTEGER)) = 1 AS promoted, count(*) AS partitions
FROM chosen AS c JOIN measured AS m ON m.candidate = c.candidate JOIN measured AS b ON b.partition = m.partition AND b.candidate = 'training_median_ratio' GROUP BY 1, 2""")
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate for three pools of candidates, of which the last can't pass."""
    measured = _measured(spark, sf)
    pools = {"both": ["segment_median", "priority_ratio"], "ratio only": ["priority_ratio"], "assessed only": ["assessed_value"]}
    parts = [valuation.promotion_gate(measured, names).select(F.lit(pool).alias("pool"), "*") for pool, names in pools.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("model_artefact", f"""
WITH {_GATE_SQL}
SELECT partition, candidate, rows, round(mae, 4) AS mae, round(r2, 6) AS r2, TRUE AS same_model FROM measured""")
def model_artefact(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted model and its metrics, saved side by side and read again: the same figures, and a model that predicts the same."""
    from pyspark.ml import PipelineModel

    d = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]).select((F.col("o_custkey") % 977).cast("double").alias("n"), F.col("o_orderpriority").alias("c"), F.col("o_totalprice").alias("label"))
    folder = shared_folder(spark, "model")
    fitted = valuation.model(["n"], ["c"], "label", trees=3, depth=3).fit(d)
    valuation.save_model(fitted, _measured(spark, sf), folder)
    again = PipelineModel.load(f"{folder}/model")
    total = lambda m: m.transform(d).agg(F.sum("prediction")).first()[0]
    saved = spark.read.schema("partition string, candidate string, rows long, mae double, r2 double").json(f"{folder}/metrics")
    return saved.select("partition", "candidate", "rows", F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.lit(abs(total(fitted) - total(again)) <= 1e-6 * abs(total(fitted))).alias("same_model"))
