"""Lien screening of whole tables: disclosures, the set they replace, coverage and risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlake.domain.notices import disclosed_liens
from auctionlake.domain.scoring import lien_risk
from auctionlake.operators.merge import replace_set, split_rejects
from auctionlake.operators.relational import latest_per_key

SOURCE = "CIVILVIEW_DISCLOSURE"
# Sources of lien records and whether each can be checked by machine.
SOURCES = {"SHERIFF_NOTICE": "SUCCESS", "COUNTY_LAND_RECORDS": "MANUAL_REVIEW_REQUIRED", "JUDGMENTS": "NOT_CONFIGURED", "MUNICIPAL": "MANUAL_REVIEW_REQUIRED", "HOA": "MANUAL_REVIEW_REQUIRED"}
# Lien categories and what is known of each before any record is found.
CATEGORIES = {
    "MORTGAGE": "MANUAL_REVIEW_REQUIRED", "LIS_PENDENS": "MANUAL_REVIEW_REQUIRED", "CONSTRUCTION_LIEN": "MANUAL_REVIEW_REQUIRED", "HOA_LIEN": "MANUAL_REVIEW_REQUIRED",
    "CIVIL_JUDGMENT": "SOURCE_UNAVAILABLE", "CHILD_SUPPORT": "SOURCE_UNAVAILABLE", "TAX_LIEN": "MANUAL_REVIEW_REQUIRED", "UNPAID_PROPERTY_TAX": "MANUAL_REVIEW_REQUIRED",
    "WATER_SEWER": "NOT_CHECKED", "TAX_SALE_CERTIFICATE": "MANUAL_REVIEW_REQUIRED", "UCC_1": "MANUAL_REVIEW_REQUIRED",
}


def refresh(sales: DataFrame, properties: DataFrame, liens: DataFrame) -> Mapping[str, DataFrame]:
    """The latest notice of each property parsed into liens, which replace those of the same source; then coverage and risk.

    ``sales``: property_id, sale_id, sale_date, description_text. ``liens``: property_id, source_name, the
    fields of a disclosed lien, original_amount, requires_manual_review. Properties without a sale or without
    a saved notice come back as rejects and keep the liens they have.
    """
    latest = latest_per_key(sales, ["property_id"], [F.desc_nulls_last("sale_date"), F.desc("sale_id")])
    every = properties.select("property_id").join(latest, "property_id", "left")
    rules = [(F.col("sale_id").isNull(), "no sale"), (F.trim(F.coalesce("description_text", F.lit(""))) == "", "no saved notice")]
    ready, rejects = split_rejects(every, rules)
    parsed = ready.select("property_id", disclosed_liens(F.col("description_text")).alias("found"))
    fresh = parsed.select("property_id", F.explode("found").alias("x")).select("property_id", F.lit(SOURCE).alias("source_name"), "x.*", F.lit(None).cast("decimal(14,2)").alias("original_amount"), F.lit(True).alias("requires_manual_review"))
    # A property whose notice discloses nothing any more loses what it disclosed before.
    emptied = liens.filter(F.col("source_name") == SOURCE).join(parsed.filter("size(found) = 0").select("property_id"), "property_id", "left_semi")
    kept = liens.join(emptied.select("property_id", "source_name").distinct(), ["property_id", "source_name"], "left_anti").select(*fresh.columns)
    now = replace_set(kept, fresh, ["property_id", "source_name"])
    spark = properties.sparkSession
    sources = spark.createDataFrame(list(SOURCES.items()), "source_type string, coverage_status string")
    coverage = ready.select("property_id").join(F.broadcast(sources), how="cross")
    return {"liens": now, "rejects": rejects.select("property_id", "reason"), "coverage": categories(ready, fresh), "risk": lien_risk(ready, now, coverage, "property_id")}


def categories(properties: DataFrame, records: DataFrame) -> DataFrame:
    """Every property with all eleven categories: PARTIAL with count and sum where a disclosure belongs there."""
    belongs = F.when(F.col("lien_subtype").isin("SEWER_CHARGE", "WATER_CHARGE_UNKNOWN"), "WATER_SEWER").when(F.col("lien_type") == "PROPERTY_TAX", "UNPAID_PROPERTY_TAX")
    found = records.select("property_id", belongs.alias("category"), F.coalesce("current_amount", "original_amount").alias("amount")).filter("category IS NOT NULL")
    found = found.groupBy("property_id", "category").agg(F.count("*").alias("n"), F.sum("amount").alias("quantified_amount"))
    dim = properties.sparkSession.createDataFrame(list(CATEGORIES.items()), "category string, default_status string")
    every = properties.select("property_id").join(F.broadcast(dim), how="cross").join(found, ["property_id", "category"], "left")
    return every.select("property_id", "category", F.when(F.col("n") > 0, "PARTIAL").otherwise(F.col("default_status")).alias("status"), F.coalesce("n", F.lit(0)).alias("record_count"), "quantified_amount")
