"""Equity, lien risk, coverage and auction probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.functions.values import clamp
from auctionlake.operators.relational import filtered_count, filtered_sum, first_label

# Risk weights of lien types, and the types that are taxes or municipal claims.
RISK_WEIGHTS = {
    "TAX_SALE_CERTIFICATE": 32, "PROPERTY_TAX": 25, "MUNICIPAL_LIEN": 24, "FEDERAL_TAX_LIEN": 28, "STATE_TAX_LIEN": 24, "HOMEOWNER_ASSOCIATION_LIEN": 18,
    "MORTGAGE": 15, "JUDGMENT": 13, "CONSTRUCTION_LIEN": 16, "UCC": 10, "LIS_PENDENS": 8, "OTHER": 8,
}
TAX_TYPES = ["TAX_SALE_CERTIFICATE", "PROPERTY_TAX", "MUNICIPAL_LIEN", "FEDERAL_TAX_LIEN", "STATE_TAX_LIEN"]
OPEN_STATUSES = ["ACTIVE", "POSSIBLY_ACTIVE", "UNKNOWN"]
SURVIVING = ["LIKELY_SURVIVES", "MAY_SURVIVE"]
COMPONENT_SHARES = {"surviving_lien_risk": 0.25, "tax_municipal_risk": 0.18, "mortgage_priority_risk": 0.12, "judgment_risk": 0.10, "title_complexity_risk": 0.10, "data_quality_risk": 0.15, "manual_review_risk": 0.10}
FORECLOSING = ["FORECLOSING_LIEN", "FORECLOSING_CLAIM"]
SENIOR = ["SUPER_PRIORITY_LIEN", "SUPER_PRIORITY_POSSIBLE", "SENIOR_LIEN", "POTENTIALLY_SURVIVING"]
JUNIOR = ["JUNIOR_LIEN", "LIKELY_EXTINGUISHED_LIEN"]


def equity(value: Column, upset: Column, repairs: Column, closing: Column, holding: Column, surviving: Column) -> dict[str, Column]:
    """Gross and net equity, their share of the value, and the largest bid that leaves nothing lost."""
    costs = repairs + closing + holding + surviving
    return {
        "gross_equity": value - upset,
        "gross_equity_percent": F.when(value > 0, F.try_divide(value - upset, value)),
        "net_equity": value - upset - costs,
        "maximum_bid": value - costs,
    }


def upset_price(estimated: Column, alternate: Column, stored: Column) -> Column:
    """The highest upset price that is known."""
    return F.greatest(estimated, alternate, stored)


def lien_position(foreclosing: Column, priority: Column) -> Column:
    return first_label([(F.coalesce(foreclosing, F.lit(False)) | priority.isin(FORECLOSING), "PRIMARY_FORECLOSING"), (priority.isin(SENIOR), "POTENTIALLY_SENIOR"), (priority.isin(JUNIOR), "SECONDARY_JUNIOR")], "PRIORITY_UNKNOWN")


def lien_total_columns() -> list[Column]:
    value = F.coalesce("current_amount", "original_amount")
    return [
        filtered_sum(value, F.col("status").isin(OPEN_STATUSES)).alias("total_lien_amount"),
        F.count("*").alias("lien_record_count"),
        filtered_count(F.col("status").isin(OPEN_STATUSES)).alias("open_lien_count"),
        filtered_count(F.col("survival_classification").isin(SURVIVING)).alias("potentially_surviving_count"),
        filtered_count(F.col("requires_manual_review")).alias("manual_review_count"),
    ]


def lien_totals(liens: DataFrame, key: str) -> DataFrame:
    """Amounts and counts of each property's liens in one aggregation."""
    return liens.groupBy(key).agg(*lien_total_columns())


def risk_level(score: Column) -> Column:
    return first_label([(score >= 75, "VERY_HIGH"), (score >= 50, "HIGH"), (score >= 25, "MODERATE")], "LOW")


def lien_risk(properties: DataFrame, liens: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """Seven risk components of each property, their weighted score, its level, confidence and the known exposure.

    Properties without liens or coverage are scored too: nothing known is a risk of its own. Shares of
    points are rounded for each lien, halves to even.
    """
    weights = F.create_map(*[F.lit(x) for pair in RISK_WEIGHTS.items() for x in pair])
    kind = F.col("lien_type")
    weight = F.coalesce(F.try_element_at(weights, kind), F.lit(RISK_WEIGHTS["OTHER"]))
    opened = F.col("status").isin(OPEN_STATUSES)
    survives = opened & F.col("survival_classification").isin(SURVIVING)
    zero = F.lit(0).cast("decimal(14,2)")
    exposure = F.coalesce(F.nullif(F.col("current_amount"), zero), F.col("original_amount"), zero)
    by_lien = liens.groupBy(key).agg(
        filtered_count(opened).alias("open_"), F.count("*").alias("all_"),
        filtered_sum(F.bround(weight * F.greatest(F.col("match_confidence"), F.lit(25)) / 100.0), survives).alias("surviving_"),
        filtered_sum(F.try_element_at(weights, kind), opened & kind.isin(TAX_TYPES)).alias("tax_"),
        (20 * filtered_count(opened & (kind == "JUDGMENT"))).alias("judgment_"),
        filtered_sum(F.when(F.col("is_foreclosing_lien"), 5).otherwise(18), opened & (kind == "MORTGAGE")).alias("mortgage_"),
        filtered_count(F.col("requires_manual_review")).alias("manual_"),
        filtered_sum(exposure, survives & (F.col("status") != "UNKNOWN")).alias("exposure_"),
        F.avg("match_confidence").alias("confidence_"),
    )
    by_source = coverage.groupBy(key).agg(
        filtered_count(F.col("coverage_status") == "SUCCESS").alias("success_"), filtered_count(F.col("coverage_status") == "PARTIAL").alias("partial_"), F.count("*").alias("sources_")
    )
    d = properties.select(key).join(by_lien, key, "left").join(by_source, key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    complete = F.coalesce(F.bround(F.try_divide(n("success_") + 0.5 * n("partial_"), F.nullif(n("sources_"), F.lit(0))) * 100), F.lit(0.0))
    cap = lambda c: F.least(c.cast("double"), F.lit(100.0))
    d = d.select(
        key, complete.alias("completeness"),
        cap(n("surviving_")).alias("surviving_lien_risk"), cap(n("open_") * 14 + n("all_") * 3).alias("title_complexity_risk"), cap(n("tax_")).alias("tax_municipal_risk"),
        cap(n("judgment_")).alias("judgment_risk"), cap(n("mortgage_")).alias("mortgage_priority_risk"), (100.0 - complete).alias("data_quality_risk"),
        cap(n("manual_") * 12 + (n("sources_") - n("success_") - n("partial_")) * 10).alias("manual_review_risk"),
        F.coalesce("exposure_", zero).cast("decimal(24,2)").alias("known_exposure"),
        F.least(F.bround(complete * 0.7 + F.coalesce("confidence_", F.lit(0.0)) * 0.3), F.lit(100.0)).cast("int").alias("confidence_score"),
    )
    score = sum((F.col(c) * share for c, share in COMPONENT_SHARES.items()), F.lit(0.0))
    d = d.withColumn("risk_score", clamp(F.bround(F.bround(score, 6)), 0.0, 100.0).cast("int"))
    return d.withColumn("risk_level", risk_level(F.col("risk_score")))


def category_coverage(entities: DataFrame, categories: DataFrame, records: DataFrame, key: str, category: str, value: str) -> DataFrame:
    """Every entity with every category: PARTIAL with count and sum where records are, NOT_CHECKED elsewhere.

    The categories are a fixed short list, so pairing them with all entities is one broadcast.
    """
    found = records.groupBy(key, category).agg(F.count("*").alias("records_found"), F.sum(value).alias("known_amount"))
    every = entities.select(key).join(F.broadcast(categories.select(category)), how="cross")
    joined = every.join(found, [key, category], "left")
    return joined.select(key, category, F.when(F.col("records_found") > 0, "PARTIAL").otherwise("NOT_CHECKED").alias("coverage_status"), F.coalesce("records_found", F.lit(0).cast("long")).alias("records_found"), "known_amount")


def event_counts(events: DataFrame, key: str) -> DataFrame:
    """Distinct status events of each sale (status, raw status and day), sorted into kinds of adjournment."""
    status = F.lower(F.coalesce("status", F.lit("")))
    raw = F.lower(F.coalesce(F.nullif(F.col("raw_status"), F.lit("")), F.col("status"), F.lit("")))
    once = events.select(key, status.alias("s"), raw.alias("r"), F.to_date("sale_date").alias("d")).distinct()
    adjourned, plaintiff, defendant = (F.col("r").contains(x) for x in ("adjourn", "plaintiff", "defendant"))
    return once.groupBy(key).agg(
        filtered_count(adjourned & plaintiff).alias("plaintiff_adjournments"),
        filtered_count(adjourned & defendant).alias("defendant_adjournments"),
        filtered_count((F.col("s") == "adjourned") & ~plaintiff & ~defendant).alias("generic_adjournments"),
        filtered_count((F.col("s") == "bankruptcy") | F.col("r").contains("bankrupt")).alias("bankruptcy_events"),
        F.count("*").alias("distinct_status_events"),
    )


def sale_probability(sales: DataFrame, events: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The chance that a sale (key, state, sale_date) reaches auction, by a fixed and explainable scale, on day ``as_of``."""
    counted = sales.join(event_counts(events, key), key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    p, d, g, b = (n(c) for c in ("plaintiff_adjournments", "defendant_adjournments", "generic_adjournments", "bankruptcy_events"))
    local = F.coalesce(F.col("state") == "NJ", F.lit(False))
    days = F.datediff(F.to_date("sale_date"), as_of)
    near = F.when(days < 0, -0.12).when(days <= 7, 0.10).when(days <= 14, 0.07).when(days <= 30, 0.04).otherwise(0.0)
    points = [
        ("prior_distinct_adjournments", F.least(p + d + g, F.lit(4)) * 0.07),
        ("defendant_adjournment_allowance_reached", F.when(local & (d >= 2), 0.10).otherwise(0.0)),
        ("plaintiff_adjournment_allowance_reached", F.when(local & (p >= 2), 0.10).otherwise(0.0)),
        ("combined_adjournment_allowances_reached", F.when(local & (p + d >= 4), 0.06).otherwise(0.0)),
        ("rescheduled_after_bankruptcy", F.when(b > 0, 0.04).otherwise(0.0)),
        ("sale_date_proximity", near),
    ]
    total = F.lit(0.40)
    for _, change in points:
        total = total + change
    named = F.array_compact(F.array(*[F.when(change != 0, F.struct(F.lit(factor).alias("factor"), change.alias("change"))) for factor, change in points]))
    strength = F.least(n("distinct_status_events"), F.lit(5)) / 5
    confidence = F.bround(0.30 + strength * 0.45 + F.when(F.col("sale_date").isNotNull(), 0.10).otherwise(0.0), 2)
    scored = counted.select(
        key, p.alias("plaintiff_adjournments"), d.alias("defendant_adjournments"), g.alias("generic_adjournments"), b.alias("bankruptcy_events"), n("distinct_status_events").alias("distinct_status_events"),
        days.alias("days_until_sale"), F.bround(clamp(total, 0.10, 0.94), 4).alias("probability"), F.least(confidence, F.lit(0.85)).alias("confidence"), named.alias("adjustments"),
    )
    return scored.withColumn("predicted_class", F.col("probability") >= 0.65)
