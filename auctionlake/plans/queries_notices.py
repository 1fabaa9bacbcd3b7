"""Notices written in many wordings, parsed field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.domain import notices
from auctionlake.plans.catalog import query
from auctionlake.plans.common import read, spread

# Wordings of each field, chosen by the order's key; # stands for the value.
ESTIMATED = ["Estimated upset price of $#", "An estimated  upset bid amount: #", "estimated upset sheriff's sale bid amount is now $#", "Good faith estimated upset: $#", "The plaintiff's upset bid presently approximates $#", "Estimated amount required to satisfy the writ $#", "estimated amount due as of today is $#", "Anticipated upset amount $#"]
ALTERNATE = ["Approximate upset price: $#", "approximate anticipated upset of $#", "Approximate upset sum $#", "Approximate sheriff upset $#", "Upset sheriff bid amount $#", "the plaintiff's upset bid is $#", "upset bid amount $#", "Upset amount: $#"]
JUDGMENT = ["Approximate judgment amount: $#", "Judgement amount of $#", "amount of judgment entered $#", "Final judgment: $#"]
INTEREST = ["Interest accruing at $#", "interest accrues at the rate of $#", "Per diem interest $#", "daily interest of $#"]
FEES = ["Attorney's fees and costs $#", "attorney fees of $#", "Legal fees and costs: $#"]
DOCKET = ["Docket No. #", "Case Number: #", "DOCKET # #", "case no #"]
DEPOSIT = ["A deposit of # % is required", "Required deposit: #%"]
BALANCE = ["Balance due in # days", "The remaining balance is payable within # calendar days"]
OCCUPIED = ["The premises are vacant", "Not owner-occupied at this time", "It is owner occupied", "Nobody knows who lives here"]


def _wording(forms: list[str], key, value):
    chosen = F.element_at(F.array(*map(F.lit, forms)), (key % len(forms) + 1).cast("int"))
    at = F.length(chosen) - F.locate("#", F.reverse(chosen))  # a form may have a number sign of its own before the value's
    return F.when(chosen.contains("#"), F.concat(F.substring(chosen, F.lit(1), at), value, F.substring(chosen, at + 2, F.length(chosen)))).otherwise(chosen)


_FIELDS_SQL = """
d AS (
  SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(14,2)) AS price, o_custkey AS c, CAST(o_orderkey % 900 + 1 AS VARCHAR) AS b, CAST(o_custkey AS VARCHAR) AS l FROM orders),
f AS (
  SELECT *, CASE WHEN k % 3 <> 0 THEN price END AS est, CASE WHEN k % 4 <> 1 THEN CAST(CASE k % 5 WHEN 0 THEN price WHEN 1 THEN price + 900 WHEN 2 THEN price * 2 ELSE price + 5 END AS DECIMAL(14,2)) END AS alt FROM d)"""


@query("notice_parse", f"""
WITH {_FIELDS_SQL}
SELECT k AS o_orderkey, CASE WHEN k % 5 <> 4 THEN CAST(price + 1000 AS DECIMAL(14,2)) END AS judgment_amount, est AS estimated_upset_price, CASE WHEN est IS NULL OR est <> alt THEN alt END AS alternate_upset_price,
  CASE WHEN k % 7 <> 0 THEN CAST(k % 90 + 0.25 AS DECIMAL(14,2)) END AS daily_interest, CASE WHEN k % 6 <> 0 THEN CAST(c % 5000 + 500 AS DECIMAL(14,2)) END AS attorney_fees_costs, CASE WHEN k % 8 <> 3 THEN 'F-' || CAST(k AS VARCHAR) || '-24' END AS docket_number,
  CASE k % 6 WHEN 0 THEN b WHEN 1 THEN b WHEN 3 THEN b || '.02' WHEN 4 THEN b END AS block, CASE k % 6 WHEN 0 THEN l || '.01' WHEN 1 THEN l WHEN 3 THEN l WHEN 4 THEN l END AS lot, CASE WHEN k % 6 = 4 THEN 'C0' || CAST(k % 10 AS VARCHAR) WHEN k % 9 = 0 THEN 'Q' || CAST(k % 100 AS VARCHAR) END AS qualifier,
  CASE k % 6 WHEN 0 THEN b || '/' || l || '.01/' WHEN 1 THEN b || '/' || l || '/' WHEN 2 THEN b || '/' || l || '/;' || b || '.1/' || l || '/' WHEN 3 THEN b || '.02/' || l || '/' WHEN 4 THEN b || '/' || l || '/C0' || CAST(k % 10 AS VARCHAR) ELSE '' END AS parcel_identifiers,
  CASE WHEN k % 10 <> 0 THEN CAST(k % 25 + 5 AS DECIMAL(14,2)) END AS deposit_percent, CASE WHEN k % 11 <> 0 THEN CAST(k % 60 + 1 AS INTEGER) END AS balance_due_days, CASE k // 2 % 4 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS owner_occupied,
  coalesce(est <> alt AND abs(est - alt) > 1000 AND abs(est - alt) / greatest(est, alt) > 0.01, FALSE) AS upset_price_conflict
FROM f""")
def notice_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Notices with every field in all its wordings, in an order of sentences that changes, with fields missing, and prices that agree or not."""
    o = read(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice").cast("decimal(14,2)")
    text = lambda x: x.cast("string")
    cash = lambda x: F.format_number(x, 2)
    alternate = F.when(k % 5 == 0, price).when(k % 5 == 1, price + 900).when(k % 5 == 2, price * 2).otherwise(price + 5)
    b, x = text(k % 900 + 1), text(c)
    clause = lambda *parts: F.concat(F.lit("Lot Block Number if available: "), *parts, F.lit(" Tax Map of the town"))
    parcel = (
        F.when(k % 6 == 0, F.concat(F.lit("Known as Block: "), b, F.lit(", Lot "), x, F.lit(".01.")))
        .when(k % 6 == 1, clause(F.lit("Lot and Block: Lot "), x, F.lit(", Block "), b))
        .when(k % 6 == 2, clause(F.lit("Lot "), x, F.lit(" in Block "), b, F.lit(" and Lot "), x, F.lit(" in Block "), b, F.lit(".1")))
        .when(k % 6 == 3, F.concat(F.lit("Tax Block "), b, F.lit(" n/k/a Tax Block "), b, F.lit(".02, Tax Lot "), x, F.lit(" on file.")))
        .when(k % 6 == 4, clause(F.lit("Lot(s) "), x, F.lit(" C0"), text(k % 10), F.lit(", Block "), b, F.lit(",")))
    )
    parts = [
        _wording(OCCUPIED, F.floor(k / 2), F.lit("")), F.when(k % 3 != 0, _wording(ESTIMATED, k, cash(price))), F.when(k % 4 != 1, _wording(ALTERNATE, k, cash(alternate))), F.when(k % 5 != 4, _wording(JUDGMENT, k, cash(price + 1000))),
        F.when(k % 7 != 0, _wording(INTEREST, k, cash(k % 90 + 0.25))), F.when(k % 6 != 0, _wording(FEES, k, cash(c % 5000 + 500))), F.when(k % 8 != 3, _wording(DOCKET, k, F.concat(F.lit("F-"), text(k), F.lit("-24")))),
        parcel, F.when(k % 9 == 0, F.concat(F.lit("Qualifier: Q"), text(k % 100))), F.when(k % 10 != 0, _wording(DEPOSIT, k, text(k % 25 + 5))), F.when(k % 11 != 0, _wording(BALANCE, k, text(k % 60 + 1))),
    ]
    n = spread(o.withColumn("notice", F.array_join(F.array_compact(F.when(k % 2 == 0, F.array(*parts)).otherwise(F.reverse(F.array(*parts)))), filler_text())).select("o_orderkey", "notice"))
    d = n.select("o_orderkey", notices.parse_notice(F.col("notice")).alias("n"))
    one = lambda p: F.concat_ws("/", p["block"], p["lot"], F.coalesce(p["qualifier"], F.lit("")))
    return d.select("o_orderkey", "n.*").withColumn("parcel_identifiers", F.array_join(F.transform("parcel_identifiers", one), ";"))


def filler_text() -> str:
    """Words without figures or labels, longer than any label looks ahead: they keep a label from the amount of another field."""
    return ";\n " + "and nothing more is said about it by the officer who holds the sale on that day " * 3 + ".\t "


@query("lien_disclosures", f"""
WITH d AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(14,2)) AS price FROM orders)
SELECT k AS o_orderkey, lien_type, lien_subtype, status, current_amount, foreclosing AS is_foreclosing_lien, match_confidence, priority_classification, priority_confidence, survival_classification, survival_confidence FROM (
  SELECT k, 'MUNICIPAL_LIEN' AS lien_type, 'SEWER_CHARGE' AS lien_subtype, 'POSSIBLY_ACTIVE' AS status, CAST(k % 500 + 0.5 AS DECIMAL(14,2)) AS current_amount, FALSE AS foreclosing, 92 AS match_confidence, 'POTENTIALLY_SURVIVING' AS priority_classification, 45 AS priority_confidence, 'MAY_SURVIVE' AS survival_classification, 45 AS survival_confidence FROM d WHERE k % 4 IN (1, 2)
  UNION ALL SELECT k, 'OTHER', 'PLAINTIFF_ADVANCES', 'POSSIBLY_ACTIVE', price, TRUE, 95, 'FORECLOSING_CLAIM', 70, 'UNKNOWN', 30 FROM d WHERE k % 5 IN (1, 2)
  UNION ALL SELECT k, 'PROPERTY_TAX', 'DISCLOSED_CURRENT_THROUGH_DATE', 'UNKNOWN', NULL, FALSE, 90, 'SUPER_PRIORITY_POSSIBLE', 65, 'MAY_SURVIVE', 70 FROM d WHERE k % 3 <> 0
  UNION ALL SELECT k, 'MUNICIPAL_LIEN', 'WATER_CHARGE_UNKNOWN', 'UNKNOWN', NULL, FALSE, 90, 'UNKNOWN', 0, 'UNKNOWN', 0 FROM d WHERE k % 7 IN (1, 2, 3))""")
def lien_disclosures(spark: SparkSession, sf: str) -> DataFrame:
    """Four kinds of disclosure in several wordings, and amounts that belong to something else."""
    o = read(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    k, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    small = F.format_number(k % 500 + 0.5, 2)
    sewer = F.when(k % 4 == 1, F.concat(F.lit("Sewer account 77 0 is open with $"), small)).when(k % 4 == 2, F.concat(F.lit("Water/Sewer arrears of $"), small)).when(k % 4 == 3, F.concat(F.lit("Sewer is paid. Upset price: $"), price)).otherwise("")
    advances = F.when(k % 5 == 1, F.concat(F.lit("Additional advances of $"), price)).when(k % 5 == 2, F.concat(F.lit("plus ADVANCES since then, some $"), price)).when(k % 5 == 3, F.concat(F.lit("Advances if any. Approx. Judgment $"), price)).otherwise("")
    taxes = F.when(k % 3 == 1, "Taxes  current through spring").when(k % 3 == 2, "tax current\nthrough the summer").otherwise("Taxes are due")
    water = F.when(k % 7 == 1, "Water: unable to confirm").when(k % 7 == 2, "WATER charges, which the plaintiff cannot confirm").when(k % 7 == 3, "water balance unknown").otherwise("Water is paid")
    gap = F.lit("." + filler_text())
    d = spread(o.select("o_orderkey", F.concat(sewer, gap, advances, gap, taxes, gap, water).alias("notice")))
    return d.select("o_orderkey", F.explode(notices.disclosed_liens(F.col("notice"))).alias("x")).select("o_orderkey", "x.*")
