"""The property listing and the other read paths, as functions from tables to a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.domain.scoring import lien_position, lien_total_columns, upset_price
from auctionlake.domain.valuation import pending_reason, valuation_status
from auctionlake.functions.text import map_number
from auctionlake.operators.relational import largest_per_key, latest_per_key, ordered_list, page, where_all


@dataclass(frozen=True)
class ListingFilters:
    """What a listing may be narrowed by; None means any."""

    states: Sequence[str] | None = None
    counties: Sequence[str] | None = None
    zip_code: str | None = None
    status: str | None = None
    future_only: bool = False
    min_equity: float | None = None
    max_risk: int | None = None


@dataclass(frozen=True)
class ListingTables:
    """The tables that a listing is made of. Only sales and properties are needed; each other adds its columns."""

    sales: DataFrame
    properties: DataFrame
    valuations: DataFrame
    liens: DataFrame
    features: DataFrame
    training_sales: DataFrame
    parcel_matches: DataFrame
    candidates: DataFrame
    predictions: DataFrame
    assessments: DataFrame
    reports: DataFrame


PLACE = ["municipality_code", "block", "lot"]


def _latest(df: DataFrame, wanted: DataFrame, key: list[str], when: str, tie: str, keep: dict[str, str]) -> DataFrame:
    """The newest row of each wanted key, of equal times that of the largest ``tie``; columns under their listing names.

    Rows of other keys go before the aggregate, and the aggregate is one pass with partial results.
    """
    own = df.join(wanted, key, "left_semi").select(*key, when, tie, *(F.col(c).alias(name) for c, name in keep.items() if name not in (when, tie)))
    return largest_per_key(own, key, [when, tie], list(keep.values()))


def _narrowed(t: ListingTables, f: ListingFilters, as_of: date) -> DataFrame:
    """Sales with their property and what the filters and the order need: upset price, valuation, equity and risk."""
    kept = where_all(t.sales.filter("property_id IS NOT NULL"), [
        F.col("current_status") == f.status if f.status else None,
        F.to_date("current_sale_date") >= F.lit(as_of) if f.future_only else None,
    ])
    wanted = where_all(t.properties, [
        F.col("state").isin([s.upper() for s in f.states]) if f.states else None,
        F.col("county").isin(list(f.counties)) if f.counties else None,
        F.col("zip_code") == f.zip_code if f.zip_code else None,
    ])
    upset = upset_price(F.col("estimated_upset_price"), F.col("alternate_upset_price"), F.col("upset_price"))
    d = kept.join(wanted, "property_id").withColumn("upset_price", upset).withColumn("court_case_number", F.coalesce("docket_number", "court_case_number"))
    value = _latest(t.valuations.filter("is_current"), d.select("property_id").distinct(), ["property_id"], "retrieved_at", "valuation_id", {
        "estimated_value": "market_value", "low_value": "market_value_low", "high_value": "market_value_high", "provider": "valuation_provider", "confidence_score": "valuation_confidence", "retrieved_at": "retrieved_at", "valuation_id": "valuation_id",
    }).withColumnRenamed("retrieved_at", "valuation_retrieved_at")
    d = d.join(value, "property_id", "left")
    gross = F.col("market_value") - F.col("upset_price")
    d = d.withColumn("gross_equity", gross).withColumn("gross_equity_percent", F.when(F.col("market_value") > 0, F.try_divide(gross, F.col("market_value"))))
    d = where_all(d, [F.col("gross_equity") >= f.min_equity if f.min_equity is not None else None])
    risk = _latest(t.assessments, d.select("sale_id"), ["sale_id"], "calculated_at", "assessment_id", {"risk_score": "risk_score", "risk_level": "risk_level"})
    return where_all(d.join(risk, "sale_id", "left"), [F.col("risk_score") <= f.max_risk if f.max_risk is not None else None])


def _with_sides(t: ListingTables, d: DataFrame, few: bool = False) -> DataFrame:
    """Predictions, gaps, reports and liens beside the rows. With ``few`` these are one page, so every side table keeps only its keys where it is read."""
    small = F.broadcast if few else lambda x: x
    properties, sales = small(d.select("property_id").distinct()), small(d.select("sale_id"))
    prediction = _latest(t.predictions.filter("prediction_target = 'reaches_auction'"), sales, ["sale_id"], "predicted_at", "prediction_id", {"probability": "sale_probability", "feature_values": "sale_probability_features"})
    report = _latest(t.reports, properties, ["property_id"], "calculated_at", "report_id", {
        "risk_score": "lien_risk_score", "risk_level": "lien_risk_level", "confidence_score": "lien_risk_confidence", "known_exposure": "known_lien_exposure", "calculated_at": "calculated_at",
    }).withColumnRenamed("calculated_at", "lien_risk_calculated_at")
    feature = t.features.join(properties, "property_id", "left_semi").select("property_id", *PLACE, F.col("match_confidence").alias("parcel_match_confidence"), "property_class", F.lit(True).alias("has_feature"))
    space = _latest(t.training_sales, small(feature.select(*PLACE).distinct()), PLACE, "deed_date", "training_id", {"living_space": "living_space"})
    pending = t.candidates.filter("review_status = 'PENDING'").join(properties, "property_id", "left_semi").select("property_id").distinct().withColumn("has_pending", F.lit(True))
    matched = t.parcel_matches.join(sales, "sale_id", "left_semi").select("sale_id").distinct().withColumn("has_match", F.lit(True))
    liens = t.liens.join(properties, "property_id", "left_semi").groupBy("property_id").agg(*lien_total_columns(), _lien_list().alias("lien_items"))

    for side in (prediction, matched):
        d = d.join(side, "sale_id", "left")
    for side in (feature.join(space, PLACE, "left").drop(*PLACE), report, pending, liens):
        d = d.join(side, "property_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    gaps = (F.col("valuation_id").isNotNull(), F.col("state"), F.col("county"), yes("has_match"), yes("has_feature"), yes("has_pending"), F.col("parcel_match_confidence"), F.col("property_class"))
    d = d.withColumn("valuation_status", valuation_status(*gaps)).withColumn("valuation_pending_reason", pending_reason(*gaps, F.coalesce("square_feet", "living_space")))
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("lien_record_count", "open_lien_count", "potentially_surviving_count", "manual_review_count")}
    return d.withColumns(counts).drop("valuation_id", "has_match", "has_feature", "has_pending", "living_space", "property_class")


def listing(t: ListingTables, filters: ListingFilters, as_of: date) -> DataFrame:
    """Every sale with its property, valuation, gaps, equity, predictions, risks and liens, filtered but not paged.

    Sales and properties are narrowed first; every other table then keeps only what these need and is reduced
    to one row for a key before it is joined, so no join multiplies rows.
    """
    return _with_sides(t, _narrowed(t, filters, as_of))


def _order() -> list[Column]:
    return [F.asc_nulls_last("current_sale_date"), F.asc_nulls_last("normalized_address"), F.asc("sale_id")]


def listing_page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    return page(rows, _order(), number, size)


def page_of_listing(t: ListingTables, filters: ListingFilters, as_of: date, number: int = 1, size: int = 50) -> DataFrame:
    """One page of ``listing``, in its order.

    Filters and order need valuations and risks alone, so the page is cut first; of all other tables only its at most 200 rows'
    keys are read on, without a shuffle of any of them.
    """
    return _with_sides(t, listing_page(_narrowed(t, filters, as_of), number, size), few=True).orderBy(*_order())


def _lien_list() -> Column:
    value = F.coalesce("current_amount", "original_amount")
    unnamed = F.when(F.col("lien_type").isin("MUNICIPAL_LIEN", "PROPERTY_TAX"), "Municipal/utility authority not specified").otherwise("Claimant not specified")
    position = lien_position(F.col("is_foreclosing_lien"), F.col("priority_classification")).alias("position")
    item = F.struct("lien_id", F.coalesce("creditor_name", unnamed).alias("holder"), value.alias("amount"), "lien_type", "lien_subtype", "status", position, F.col("priority_confidence").alias("position_confidence"))
    return ordered_list([value.isNull(), -value, F.col("lien_type"), F.col("lien_id")], item)


def lien_items(liens: DataFrame, key: str = "property_id") -> DataFrame:
    """Each property's liens as one ordered list: largest amounts first, missing ones last, then by type."""
    return liens.groupBy(key).agg(_lien_list().alias("lien_items"))


def sale_search(sales: DataFrame, matches: DataFrame, text: str | None = None, county: str | None = None, start: date | None = None, end: date | None = None, matched: bool | None = None) -> DataFrame:
    """Sales with their parcel match, narrowed by text anywhere, county, dates and whether a match exists."""
    d = sales.join(matches.withColumnRenamed("sale_id", "m_sale_id"), F.col("sale_id") == F.col("m_sale_id"), "left")
    like = f"%{text}%" if text else None
    return where_all(d, [
        F.col("address").ilike(like) | F.col("sheriff_number").ilike(like) if like else None,
        F.lower("county") == county.lower() if county else None,
        F.to_date("sale_date") >= F.lit(start) if start else None,
        F.to_date("sale_date") <= F.lit(end) if end else None,
        None if matched is None else F.col("m_sale_id").isNotNull() if matched else F.col("m_sale_id").isNull(),
    ])


def parcel_by_number(parcels: DataFrame, details: DataFrame, number: str) -> DataFrame:
    """The parcel whose map number, or whose detail's tax number, is ``number``; as two equal-key lookups."""
    wanted = map_number(F.lit(number))
    by_detail = details.filter(map_number(F.col("tax_parcel_id")) == wanted).select("parcel_id").distinct()
    by_map = parcels.filter(F.col("normalized_map_number") == wanted).select("parcel_id")
    return parcels.join(by_map.union(by_detail).distinct(), "parcel_id", "left_semi").join(details, "parcel_id", "left")


def review_queue(candidates: DataFrame, key: str = "property_id") -> DataFrame:
    """Pending candidates by property, those with an exact one first."""
    pending = candidates.filter(F.col("review_status") == "PENDING")
    item = F.struct("candidate_id", "score")
    return pending.groupBy(key).agg(F.bool_or(F.col("score") >= 1).alias("has_exact"), ordered_list([-F.col("score"), F.col("candidate_id")], item).alias("candidates"))


def property_detail(properties: DataFrame, sales: DataFrame, property_id) -> DataFrame:
    """A property with its latest sale, those without a date first."""
    latest = latest_per_key(sales.filter(F.col("property_id") == property_id), ["property_id"], [F.desc_nulls_first("current_sale_date"), F.asc("sale_id")])
    upset = upset_price(F.col("estimated_upset_price"), F.col("alternate_upset_price"), F.col("upset_price"))
    return properties.filter(F.col("property_id") == property_id).join(latest.withColumn("upset_price", upset), "property_id", "left")


def property_liens(liens: DataFrame, property_id) -> DataFrame:
    """A property's liens: those that need a manual review first, then by amount, missing ones last."""
    return liens.filter(F.col("property_id") == property_id).orderBy(F.desc_nulls_first("requires_manual_review"), F.desc_nulls_last("current_amount"), F.asc("lien_id"))


def import_status(runs: DataFrame, parcels: DataFrame, details: DataFrame, county: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one row with parcel and detail counts of a county, its latest runs)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    own = parcels.filter(F.col("county") == county).select("parcel_id")
    with_detail = details.select("parcel_id").join(own, "parcel_id", "left_semi")
    both = own.select(F.lit("parcel").alias("kind")).unionByName(with_detail.select(F.lit("detail").alias("kind")))
    counts = both.agg(F.count(F.when(F.col("kind") == "parcel", 1)).alias("parcel_count"), F.count(F.when(F.col("kind") == "detail", 1)).alias("assessment_detail_count"))
    return counts.withColumn("county", F.lit(county)), runs.filter(F.col("county") == county).orderBy(F.desc_nulls_first("started_at"), F.asc("run_id")).limit(limit)
