"""Fuzzy names and parcel identity, with SQL for the ratio and for the resolver's fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.domain import identity
from auctionlake.functions.text import ORDINALS, SUFFIXES, address_key, address_supports, street_number
from auctionlake.operators.fuzzy import best_matches, conservative_accept
from auctionlake.plans.catalog import query
from auctionlake.plans.common import read


def key_sql(text: str) -> str:
    """SQL for ``address_key``."""
    short = ", ".join(f"'{k}': '{v}'" for k, v in (SUFFIXES | ORDINALS).items())
    return f"array_to_string(list_transform(regexp_extract_all(upper({text}), '[A-Z0-9]+'), lambda w: coalesce(MAP {{{short}}}[w], w)), '')"


#: SQL steps that turn ``pair`` (a, b: distinct texts) into ``ratio`` (a, b, r). ``run`` are the diagonals of equal characters;
#: a step takes the longest common block of each span, the first of equals, and goes on with what stands left and right of it.
RATIO_SQL = """
hit AS (SELECT a, b, i, j FROM pair, unnest(range(1, length(a) + 1)) AS x(i), unnest(range(1, length(b) + 1)) AS y(j) WHERE substr(a, i, 1) = substr(b, j, 1)),
run AS (
  SELECT a, b, d, min(i) AS lo, max(i) AS hi FROM (SELECT a, b, i, i - j AS d, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM hit) GROUP BY a, b, d, g),
span(a, b, alo, ahi, blo, bhi, size) AS (
  SELECT a, b, CAST(1 AS BIGINT), length(a) + 1, CAST(1 AS BIGINT), length(b) + 1, CAST(0 AS BIGINT) FROM pair
  UNION ALL
  SELECT a, b, part.alo, part.ahi, part.blo, part.bhi, part.size
  FROM (
    SELECT a, b, unnest([
      {'alo': alo, 'ahi': -m[2], 'blo': blo, 'bhi': -m[3], 'size': CAST(0 AS BIGINT)}, {'alo': m[1] - m[2], 'ahi': ahi, 'blo': m[1] - m[3], 'bhi': bhi, 'size': CAST(0 AS BIGINT)},
      {'alo': CAST(0 AS BIGINT), 'ahi': CAST(0 AS BIGINT), 'blo': CAST(0 AS BIGINT), 'bhi': CAST(0 AS BIGINT), 'size': m[1]}]) AS part
    FROM (
      SELECT a, b, alo, ahi, blo, bhi, max([till - from_, -from_, d - from_]) AS m
      FROM (SELECT s.a, s.b, alo, ahi, blo, bhi, d, greatest(lo, alo, blo + d) AS from_, least(hi + 1, ahi, bhi + d) AS till FROM span AS s JOIN run AS r ON s.a = r.a AND s.b = r.b)
      WHERE till > from_ GROUP BY a, b, alo, ahi, blo, bhi))
  WHERE part.size > 0 OR (part.alo < part.ahi AND part.blo < part.bhi)),
ratio AS (SELECT a, b, 2.0 * sum(size) / (length(a) + length(b)) AS r FROM span GROUP BY a, b)"""


@query("fuzzy_topk", f"""
WITH RECURSIVE p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || '|' || p_brand AS block, {key_sql('p_name')} AS k FROM part),
pairs AS (
  SELECT s.p_partkey, c.p_partkey AS candidate, s.k AS a, c.k AS b FROM p AS s JOIN p AS c ON s.block = c.block
  WHERE s.p_partkey % 10 = 0 AND c.p_partkey % 10 <> 0),
pair AS (SELECT DISTINCT a, b FROM pairs), {RATIO_SQL},
ranked AS (
  SELECT p_partkey, candidate, r, row_number() OVER (PARTITION BY p_partkey ORDER BY r DESC, candidate) AS k FROM pairs JOIN ratio USING (a, b) WHERE r >= 0.3),
best AS (SELECT *, coalesce(lead(r) OVER (PARTITION BY p_partkey ORDER BY k), 0) AS next FROM ranked WHERE k <= 5)
SELECT p_partkey, candidate, r AS score, r >= 0.94 AND r - next >= 0.08 AS accepted FROM best WHERE k = 1""")
def fuzzy_topk(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_name", "p_size", "p_brand"])
    subjects = p.filter("p_partkey % 10 = 0")
    block = lambda d: F.concat_ws("|", d["p_size"].cast("string"), d["p_brand"])
    ranked = best_matches(subjects, p.filter("p_partkey % 10 <> 0").withColumnRenamed("p_partkey", "candidate"), "p_partkey", "candidate", (block(p), block(p)), (address_key(F.col("p_name")),) * 2, least=0.3)
    return conservative_accept(ranked, "p_partkey", "candidate")


@query("name_ratios", f"""
WITH RECURSIVE p AS (SELECT p_partkey, p_brand AS block, {key_sql("p_name || ' ' || p_type")} AS k FROM part),
pairs AS (SELECT s.p_partkey AS part_a, c.p_partkey AS part_b, s.k AS a, c.k AS b FROM p AS s JOIN p AS c ON s.block = c.block AND s.p_partkey < c.p_partkey),
pair AS (SELECT DISTINCT a, b FROM pairs), {RATIO_SQL},
ranked AS (SELECT part_a, part_b, r, row_number() OVER (PARTITION BY part_a ORDER BY r DESC, part_b) AS k FROM pairs JOIN ratio USING (a, b) WHERE r >= 0.55)
SELECT part_a, part_b, r AS score, CAST(k AS INTEGER) AS candidate_rank FROM ranked WHERE k <= 5""")
def name_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's five most alike parts with a higher key, of its brand, by name and type."""
    p = read(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    block, name = F.col("p_brand"), address_key(F.concat_ws(" ", "p_name", "p_type"))
    a, b = p.withColumnRenamed("p_partkey", "part_a"), p.withColumnRenamed("p_partkey", "part_b")
    return best_matches(a, b, "part_a", "part_b", (block, block), (name, name), least=0.55, later=True)


@query("identity_score", f"""
WITH RECURSIVE side AS (
  SELECT p_partkey AS id, p_brand AS town, p_size AS block, p_partkey % 3 AS lot, {key_sql("CAST(p_partkey % 50 AS VARCHAR) || ' ' || p_name")} AS k FROM part),
pairs AS (SELECT s.id AS s_id, c.id AS c_id, s.lot AS s_lot, c.lot AS c_lot, s.k AS a, c.k AS b FROM side AS s JOIN side AS c ON s.town = c.town AND s.block = c.block WHERE s.id % 4 = 0 AND c.id % 4 = 1),
pair AS (SELECT DISTINCT a, b FROM pairs), {RATIO_SQL},
scored AS (
  SELECT s_id, c_id, s_lot <> c_lot AS lot_differs, regexp_extract(a, '^([0-9]+[A-Z]?)', 1) <> regexp_extract(b, '^([0-9]+[A-Z]?)', 1) AS number_differs, round_even(20 * r, 2) AS alike FROM pairs JOIN ratio USING (a, b)),
total AS (
  SELECT s_id, c_id, lot_differs, number_differs, round_even(50 + CASE WHEN lot_differs THEN -40 ELSE 25 END + alike - CASE WHEN number_differs THEN 40 ELSE 0 END, 2) AS total FROM scored)
SELECT s_id, c_id, total, CASE WHEN lot_differs OR number_differs THEN 'REVIEW' WHEN total >= 95 THEN 'AUTO_ACCEPT' WHEN total >= 80 THEN 'REVIEW' ELSE 'UNRESOLVED' END AS decision,
  concat_ws(',', CASE WHEN lot_differs THEN 'lot_conflict' END, CASE WHEN number_differs THEN 'house_number_conflict' END) AS conflicts FROM total""")
def identity_score(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    side = lambda d, x: d.select(
        F.col("p_partkey").alias(f"{x}_id"), F.col("p_brand").alias(f"{x}_municipality_code"), F.col("p_size").cast("string").alias(f"{x}_block"), (F.col("p_partkey") % 3).cast("string").alias(f"{x}_lot"),
        F.lit("").alias(f"{x}_qualifier"), F.concat_ws(" ", (F.col("p_partkey") % 50).cast("string"), "p_name").alias(f"{x}_address"), F.lit(None).cast("string").alias(f"{x}_zip_code"),
    )
    # sides are small and their pairs costly: as many tasks as asked for, not as few as the bytes of a side suggest
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sides = {x: identity.scored_parts(side(p.filter(f"p_partkey % 4 = {k}"), x), x).repartition(tasks, f"{x}_municipality_code", f"{x}_block") for k, x in enumerate("sc")}
    pairs = sides["s"].join(sides["c"], (F.col("s_municipality_code") == F.col("c_municipality_code")) & (F.col("s_block") == F.col("c_block")))
    return identity.score_prepared(pairs).select("s_id", "c_id", "total", "decision", F.concat_ws(",", "conflicts").alias("conflicts"))


# --- the resolver ---------------------------------------------------------------------------------

# Parcels of a county repeat their block and lot in other municipalities. A sale's identifiers are parcels that follow each
# other, beginning with the lowest of its lines; some stand with a lot that is unknown as a whole, a wrong qualifier or block.
_PARCELS_SQL = """
parcels AS (
  SELECT p_partkey AS parcel_id, 'C' || CAST(p_partkey % 2 AS VARCHAR) AS county, 'M' || CAST(p_partkey % 3 AS VARCHAR) AS code, CAST((p_partkey // 4) % 60 + 1 AS VARCHAR) AS block, CAST(p_partkey % 4 + 1 AS VARCHAR) AS lot,
    CASE WHEN p_partkey % 8 = 3 THEN 'Q1' ELSE '' END AS qualifier, CAST(p_partkey % 61 + 1 AS VARCHAR) || ' ' || split_part(p_name, ' ', 1) || ' Street' AS address FROM part)"""
_SALES_SQL = """
firsts AS (SELECT l_orderkey, min(l_partkey) AS k, least(count(*), 3) AS n FROM lineitem GROUP BY 1),
sales AS (
  SELECT o_orderkey AS sale_id, k, n, 'C' || CAST(k % 2 AS VARCHAR) AS county, 'Town ' || CAST(o_custkey % 5 AS VARCHAR) AS city, CASE WHEN o_orderkey % 5 = 0 THEN '9999 Elsewhere Road' ELSE p.address END AS address
  FROM orders JOIN firsts ON o_orderkey = l_orderkey JOIN parcels AS p ON p.parcel_id = k),
idents AS (
  SELECT sale_id, county, address, j AS position, CAST(((k + 12 * (j - 1)) // 4) % 60 + 1 + CASE WHEN (sale_id + j) % 17 = 0 THEN 100 ELSE 0 END AS VARCHAR) AS block,
    CAST((k + 12 * (j - 1)) % 4 + 1 AS VARCHAR) AS lot, (sale_id + j) % 6 = 0 AS dotted, CASE WHEN (sale_id + j) % 19 = 0 THEN 'X9' END AS qualifier
  FROM sales, unnest(range(1, n + 1)) AS t(j) WHERE sale_id % 7 <> 0)"""


@query("resolve_parcels", f"""
WITH RECURSIVE {_PARCELS_SQL}, {_SALES_SQL},
found AS (
  SELECT i.sale_id, i.position, i.dotted,
    coalesce(list({{'id': parcel_id, 'code': p.code, 'supported': contains(upper(replace(i.address, ' ', '')), upper(replace(p.address, ' ', '')))}} ORDER BY parcel_id) FILTER (parcel_id IS NOT NULL AND NOT dotted AND (i.qualifier IS NULL OR i.qualifier = p.qualifier)), []) AS direct,
    coalesce(list({{'id': parcel_id, 'code': p.code, 'supported': contains(upper(replace(i.address, ' ', '')), upper(replace(p.address, ' ', '')))}} ORDER BY parcel_id) FILTER (parcel_id IS NOT NULL AND dotted), []) AS bare
  FROM idents AS i LEFT JOIN parcels AS p ON p.county = i.county AND p.block = i.block AND p.lot = i.lot GROUP BY ALL),
fold(sale_id, position, code, n, parcel_id, parcel_code) AS (
  SELECT DISTINCT sale_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM idents
  UNION ALL
  SELECT sale_id, position, CASE WHEN len(left_) = 1 AND left_[1].supported THEN left_[1].code ELSE code END, len(left_), left_[1].id, left_[1].code
  FROM (
    SELECT sale_id, position, code, CASE WHEN len(rows_) > 1 AND len(list_filter(rows_, lambda x: x.supported)) > 0 THEN list_filter(rows_, lambda x: x.supported) ELSE rows_ END AS left_
    FROM (
      SELECT sale_id, position, code, CASE WHEN len(direct) = 0 AND code IS NOT NULL AND len(bare) = 1 THEN bare ELSE direct END AS rows_
      FROM (
        SELECT f.sale_id, i.position, f.code, CASE WHEN f.code IS NULL THEN i.direct ELSE list_filter(i.direct, lambda x: x.code = f.code) END AS direct, list_filter(i.bare, lambda x: x.code = f.code) AS bare
        FROM fold AS f JOIN found AS i ON i.sale_id = f.sale_id AND i.position = f.position + 1)))),
verdict AS (SELECT sale_id, count(*) AS identifiers, min(CAST(n = 1 AS INTEGER)) = 1 AND count(DISTINCT parcel_code) = 1 AS clear FROM fold WHERE position > 0 GROUP BY sale_id),
alias AS (SELECT 'C' || CAST(c AS VARCHAR) AS county, r_regionkey AS town, 'M' || CAST(m AS VARCHAR) AS code FROM region, unnest([0, 1]) AS x(c), unnest([0, 1, 2]) AS y(m) WHERE r_regionkey = m OR (r_regionkey = 3 AND m < 2)),
only_code AS (SELECT county, town, min(code) AS code FROM alias GROUP BY 1, 2 HAVING count(*) = 1),
placed AS (
  SELECT s.sale_id, any_value(c.code) AS code, count(parcel_id) AS n, min(parcel_id) AS parcel_id
  FROM sales AS s LEFT JOIN only_code AS c ON c.county = s.county AND s.city = 'Town ' || CAST(c.town AS VARCHAR)
  LEFT JOIN parcels AS p ON p.county = s.county AND p.code = c.code AND upper(p.address) = upper(s.address) WHERE s.sale_id % 7 = 0 GROUP BY s.sale_id)
SELECT DISTINCT sale_id, parcel_id, CASE WHEN identifiers > 1 THEN 'LEGAL_MULTI' ELSE 'LEGAL_SINGLE' END AS match_kind FROM fold JOIN verdict USING (sale_id) WHERE clear AND position > 0
UNION ALL SELECT sale_id, NULL, 'REVIEW_LEGAL' FROM verdict WHERE NOT clear
UNION ALL SELECT sale_id, CASE WHEN n = 1 THEN parcel_id END, CASE WHEN code IS NULL THEN 'REVIEW_ALIAS' WHEN n = 1 THEN 'EXACT_ADDRESS' WHEN n > 1 THEN 'REVIEW_ADDRESS' ELSE 'UNRESOLVED' END FROM placed""")
def resolve_parcels(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part", ["p_partkey", "p_name"])
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    address = F.concat_ws(" ", text(k % 61 + 1), F.split("p_name", " ")[0], F.lit("Street"))
    parcels = p.select(
        k.alias("parcel_id"), F.concat(F.lit("C"), text(k % 2)).alias("county"), F.concat(F.lit("M"), text(k % 3)).alias("municipality_code"), text(F.floor(k / 4) % 60 + 1).alias("block"), text(k % 4 + 1).alias("lot"),
        F.when(k % 8 == 3, "Q1").otherwise("").alias("qualifier"), address_key(address).alias("normalized_address"), address.alias("current_address"),
    )
    lines = read(spark, sf, "lineitem", ["l_orderkey", "l_partkey"])
    firsts = lines.groupBy(F.col("l_orderkey").alias("sale_id")).agg(F.min("l_partkey").alias("k"), F.least(F.count("*"), F.lit(3)).cast("int").alias("n"))
    orders = read(spark, sf, "orders", ["o_orderkey", "o_custkey"]).withColumnRenamed("o_orderkey", "sale_id")
    of_first = parcels.select(F.col("parcel_id").alias("k"), "county", F.col("current_address").alias("a_"))
    sales = orders.join(firsts, "sale_id").join(of_first, "k").withColumn("street_address", F.when(F.col("sale_id") % 5 == 0, "9999 Elsewhere Road").otherwise(F.col("a_")))
    sales = sales.select("sale_id", "k", "n", "county", F.concat(F.lit("Town "), text(F.col("o_custkey") % 5)).alias("city"), "street_address", F.col("street_address").alias("normalized_address"))
    each = sales.filter("sale_id % 7 <> 0").withColumn("position", F.explode(F.sequence(F.lit(1), "n"))).withColumn("k", F.col("k") + 12 * (F.col("position") - 1))
    odd = F.col("sale_id") + F.col("position")
    identifiers = each.select(
        "sale_id", "position", text(F.floor(F.col("k") / 4) % 60 + 1 + F.when(odd % 17 == 0, 100).otherwise(0)).alias("block"),
        F.concat(text(F.col("k") % 4 + 1), F.when(odd % 6 == 0, ".07").otherwise("")).alias("lot"), F.when(odd % 19 == 0, "X9").alias("qualifier"),
    )
    r = read(spark, sf, "region", ["r_regionkey"]).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    r = r.filter("r_regionkey = m OR (r_regionkey = 3 AND m < 2)")
    aliases = r.select(F.concat(F.lit("C"), text(F.col("c"))).alias("county"), F.concat(F.lit("Town "), text(F.col("r_regionkey"))).alias("alias"), F.concat(F.lit("M"), text(F.col("m"))).alias("municipality_code"))
    return identity.resolve(sales.drop("k", "n"), identifiers, parcels, aliases)


# --- matches by address ----------------------------------------------------------------------------


def _short_sql(short: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in short.items()) + "}"


_NAME_SQL = f"array_to_string(list_transform(regexp_extract_all(regexp_replace(upper(#), '^\\s*[0-9]+[A-Z]?\\b|\\b[AF]KA\\b', '', 'g'), '[A-Z0-9]+'), lambda w: coalesce({_short_sql(SUFFIXES)}[w], w)), '')"
_KEY_SQL = f"array_to_string(list_transform(regexp_extract_all(upper(#), '[A-Z0-9]+'), lambda w: coalesce({_short_sql(SUFFIXES)}[w], w)), '')"


@query("conservative_match", f"""
WITH RECURSIVE homes AS (
  SELECT p_partkey AS parcel_id, 'M' || CAST(p_partkey % 5 AS VARCHAR) AS code, CAST(p_partkey % 83 + 1 AS VARCHAR) || ' ' || p_name || ' ' || p_type || ' Avenue' AS place FROM part WHERE p_partkey % 6 <> 0),
wanted AS (
  SELECT c_custkey AS property_id, 'Town ' || CAST(c_custkey % 7 AS VARCHAR) AS city, CASE WHEN c_custkey % 7 < 4 THEN 'M' || CAST(c_custkey % 7 AS VARCHAR) END AS code,
    CAST(p_partkey % 83 + 1 AS VARCHAR) || CASE WHEN c_custkey % 17 = 0 THEN 'Z' ELSE '' END || ' ' || CASE c_custkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'e', 'ea') WHEN 2 THEN p_name || ' old' ELSE 'aka ' || reverse(p_name) END || ' ' || p_type || ' Ave' AS place
  FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part)),
keyed AS (SELECT {_KEY_SQL.replace('#', 'place')} AS k, count(*) AS n, min(parcel_id) AS only_id FROM homes GROUP BY 1),
unique_ AS (SELECT property_id, only_id AS parcel_id FROM wanted JOIN keyed ON k = {_KEY_SQL.replace('#', 'place')} WHERE n = 1),
rest AS (SELECT property_id, code, regexp_extract(upper(place), '^\\s*([0-9]+[A-Z]?)\\b', 1) AS number, {_NAME_SQL.replace('#', 'place')} AS a FROM wanted WHERE property_id NOT IN (SELECT property_id FROM unique_)),
sides AS (SELECT parcel_id, code, regexp_extract(upper(place), '^\\s*([0-9]+[A-Z]?)\\b', 1) AS number, {_NAME_SQL.replace('#', 'place')} AS b FROM homes),
pairs AS (SELECT property_id, parcel_id, a, b FROM rest JOIN sides ON rest.number = sides.number AND (rest.code IS NULL OR rest.code = sides.code) WHERE a <> '' AND b <> ''),
pair AS (SELECT DISTINCT a, b FROM pairs), {RATIO_SQL},
ranked AS (SELECT property_id, parcel_id, r, row_number() OVER (PARTITION BY property_id ORDER BY r DESC, parcel_id) AS k FROM pairs JOIN ratio USING (a, b) WHERE r > 0),
best AS (SELECT property_id, parcel_id, r, coalesce(lead(r) OVER (PARTITION BY property_id ORDER BY k), 0) AS next, k FROM ranked),
taken AS (SELECT rest.property_id, parcel_id, r, r >= 0.94 AND r - next >= 0.08 AS ok FROM rest LEFT JOIN (SELECT * FROM best WHERE k = 1) AS b ON b.property_id = rest.property_id)
SELECT property_id, parcel_id, CAST(95 AS INTEGER) AS match_confidence, 'unique street address' AS match_method FROM unique_
UNION ALL SELECT property_id, CASE WHEN ok THEN parcel_id END, CASE WHEN ok THEN CAST(90 AS INTEGER) END, CASE WHEN ok THEN 'fuzzy street of the same number' WHEN r IS NOT NULL THEN 'review: ambiguous candidates' ELSE 'review: no candidates' END FROM taken""")
def conservative_match(spark: SparkSession, sf: str) -> DataFrame:
    """Properties whose streets are written like a parcel's, with another letter, a word more, or backwards."""
    p = read(spark, sf, "part", ["p_partkey", "p_name", "p_type"])
    n, k, c = p.count(), F.col("p_partkey"), F.col("c_custkey")
    text = lambda x: x.cast("string")
    homes = p.select(k.alias("parcel_id"), F.concat(F.lit("M"), text(k % 5)).alias("municipality_code"), F.concat_ws(" ", text(k % 83 + 1), "p_name", "p_type", F.lit("Avenue")).alias("property_location"), F.when(k % 6 == 0, "4A").otherwise(" 2 ").alias("property_class"))
    name = F.when(c % 4 == 0, F.col("p_name")).when(c % 4 == 1, F.replace("p_name", F.lit("e"), F.lit("ea"))).when(c % 4 == 2, F.concat("p_name", F.lit(" old"))).otherwise(F.concat(F.lit("aka "), F.reverse("p_name")))
    number = F.concat(text(k % 83 + 1), F.when(c % 17 == 0, "Z").otherwise(""))
    wanted = read(spark, sf, "customer", ["c_custkey"]).join(p, k == c % n).select(c.alias("property_id"), F.concat_ws(" ", number, name, "p_type", F.lit("Ave")).alias("street_address"), F.concat(F.lit("Town "), text(c % 7)).alias("city"))
    codes = wanted.select("city").distinct().filter(F.substring("city", 6, 1).cast("int") < 4).select("city", F.concat(F.lit("M"), F.substring("city", 6, 1)).alias("municipality_code"))
    return identity.conservative_match(wanted, homes, codes)


_SHORT_ALL = _short_sql(SUFFIXES | ORDINALS)


def _parts_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(regexp_replace(upper(coalesce({x}, '')), '([A-Z])([0-9])', '\\1 \\2', 'g'), '[A-Z0-9]+'))"


def _words_sql(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({_parts_sql(x)}, lambda t: NOT regexp_full_match(t, '[0-9]+')), lambda t: coalesce({_SHORT_ALL}[t], t)))"


def _numbers_sql(x: str) -> str:
    return f"list_filter({_parts_sql(x)}, lambda t: regexp_full_match(t, '[0-9]{{1,4}}'))"


@query("address_support", f"""
WITH d AS (
  SELECT o_orderkey, CAST(o_custkey % 40 AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN 'B' ELSE '' END || ' Second Street and ' || CAST(o_custkey % 40 + 2 AS VARCHAR) || ' ' || c_mktsegment || ' Road, Red Bank' AS subject,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_custkey % 40 AS VARCHAR) || ' 2nd St' WHEN 2 THEN CAST(o_custkey % 40 + 2 AS VARCHAR) || ' ' || lower(c_mktsegment) || ' rd unit' WHEN 3 THEN CAST(o_custkey % 40 + 3 AS VARCHAR) || ' ' || c_mktsegment || ' Road' WHEN 4 THEN 'Bank of ' || c_mktsegment || ' ' || CAST(o_custkey % 40 + 2 AS VARCHAR) WHEN 5 THEN '' ELSE CAST(o_custkey % 40 + 2 AS VARCHAR) || ' Other Road' END AS candidate
  FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, {key_sql('subject')} AS s, {key_sql("coalesce(candidate, '')")} AS c, {_words_sql('subject')} AS sw, {_words_sql('candidate')} AS cw, {_numbers_sql('subject')} AS sn, {_numbers_sql('candidate')} AS cn FROM d)
SELECT o_orderkey, s <> '' AND c <> '' AND (contains(s, c) OR (len(cn) > 0 AND list_has_all(sn, cn) AND len(cw) > 0 AND len(list_intersect(cw, sw)) >= 0.6 * len(cw))) AS supported, nullif(regexp_extract(upper(coalesce(candidate, '')), '^\\s*([0-9]+[A-Z]?)\\b', 1), '') AS number, nullif(regexp_extract(upper(subject), '^\\s*([0-9]+[A-Z]?)\\b', 1), '') AS subject_number FROM k""")
def address_support(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an address stands in another that names several, as a key or by its numbers and words; and house numbers."""
    o, c = read(spark, sf, "orders", ["o_orderkey", "o_custkey"]), read(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    text = lambda x: x.cast("string")
    n, kind, name = F.col("o_custkey") % 40, F.col("o_orderkey") % 7, F.col("c_mktsegment")
    subject = F.concat(text(n), F.when(F.col("o_orderkey") % 3 == 0, "B").otherwise(""), F.lit(" Second Street and "), text(n + 2), F.lit(" "), name, F.lit(" Road, Red Bank"))
    candidate = (
        F.when(kind == 1, F.concat(text(n), F.lit(" 2nd St"))).when(kind == 2, F.concat(text(n + 2), F.lit(" "), F.lower(name), F.lit(" rd unit"))).when(kind == 3, F.concat(text(n + 3), F.lit(" "), name, F.lit(" Road")))
        .when(kind == 4, F.concat(F.lit("Bank of "), name, F.lit(" "), text(n + 2))).when(kind == 5, "").when(kind == 6, F.concat(text(n + 2), F.lit(" Other Road")))
    )
    d = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", subject.alias("s"), candidate.alias("c"))
    return d.select("o_orderkey", address_supports(F.col("s"), F.col("c")).alias("supported"), street_number(F.col("c")).alias("number"), street_number(F.col("s")).alias("subject_number"))
