"""Listing addresses as eleven-field records, with reasons for review and for rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.domain.municipalities import with_suffix_municipality
from auctionlake.functions.text import address_hash, clean_whitespace, found, last_zip, squeeze, title_case_address, unit_number, without_unit
from auctionlake.operators.relational import reasons


def normalise_addresses(df: DataFrame, column: str, municipalities: DataFrame, state: str = "NJ") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): addresses cut into street, unit, city, state and code; the rejects carry a reason.

    The part before the last mention of the state must end with a municipality of the table (column ``municipality``). A
    missing code costs 15 points, any reason for review 20.
    """
    original = clean_whitespace(F.coalesce(F.col(column), F.lit("")))
    d = df.withColumn("original_address", original).withColumn("zip_code", last_zip(F.col("original_address")))
    without_zip = F.when(F.col("zip_code").isNotNull(), F.regexp_replace("original_address", F.concat(F.lit(r"\b"), F.col("zip_code"), F.lit(r"(?:-\d{4})?\b")), F.lit(""))).otherwise(F.col("original_address"))
    before = F.when(without_zip.rlike(rf"(?i)\b{state}\b"), F.regexp_extract(without_zip, rf"(?is)^(.*)\b{state}\b", 1))
    d = d.withColumn("before_", clean_whitespace(before))
    d = with_suffix_municipality(d, "before_", municipalities, "city_")
    street = clean_whitespace(F.substring(F.col("before_"), F.lit(1), F.length("before_") - F.length("city_")))
    d = d.withColumn("street_", street).withColumn("unit_number", unit_number(F.col("street_"))).withColumn("street_address", title_case_address(without_unit(F.col("street_"))))
    reason = F.when(F.col("original_address") == "", "Address is empty.").when(F.col("before_").isNull(), F.concat(F.lit(f"Could not find {state} in address: "), "original_address"))
    reason = reason.when(F.col("city_").isNull(), F.concat(F.lit("Could not identify municipality: "), "original_address"))
    d = d.withColumn("reason", reason)
    numbers = F.size(F.regexp_extract_all("street_address", F.lit(r"(?<![A-Za-z])(\d+[A-Za-z]?)(?!\d)"), 1))
    lower = F.lower("original_address")
    review = reasons([
        (F.col("zip_code").isNull(), "ZIP code missing"),
        (F.size(F.regexp_extract_all("original_address", F.lit(rf"(?i)\b({state})\b"), 1)) > 1, "Source may contain multiple addresses"),
        (lower.contains(" a/k/a ") | lower.contains(" f/k/a "), "Source contains an alternate address"),
        (numbers > 3, "Street field may contain multiple properties"),
    ])
    city = title_case_address(F.col("city_"))
    unit = F.when(F.col("unit_number").isNotNull(), F.concat(F.lit("Unit "), "unit_number"))
    good = d.filter("reason IS NULL").withColumn("review_", review)
    good = good.select(
        *df.columns, "original_address", F.concat_ws(", ", "street_address", unit, city, F.lit(state), "zip_code").alias("normalized_address"), "street_address", "unit_number", city.alias("city"),
        F.lit(state).alias("state"), "zip_code", address_hash(F.col("street_address"), F.col("unit_number"), city, F.lit(state), F.col("zip_code")).alias("address_hash"),
        (100 - F.when(F.col("zip_code").isNull(), 15).otherwise(0) - F.when(F.size("review_") > 0, 20).otherwise(0)).alias("data_quality_score"),
        (F.size("review_") > 0).alias("needs_manual_review"), F.nullif(F.concat_ws("; ", "review_"), F.lit("")).alias("review_reason"),
    )
    return good, d.filter("reason IS NOT NULL").select(*df.columns, "reason")


# Letters of a city after its first, and whether the street keeps the city.
LISTED_CITY = {"PA": (30, True), "NY": (40, False)}


def address_parts(raw: Column, state: str) -> dict[str, Column]:
    """Value, street, city and code of an address as sheriffs' lists write it; a city that is not found is ``Unknown``.

    What stands before the first mention of the state with a code is the street, and letters at its end the city.
    """
    longest, keeps_city = LISTED_CITY[state]
    value, code = squeeze(raw), rf"\b{state}\s+(\d{{5}})(?:-\d{{4}})?\b"
    ends, city = r"^[ ,]+|[ ,]+$", rf"([A-Za-z][A-Za-z .'-]{{1,{longest}}}),?$"
    before = F.when(value.rlike(f"(?i){code}"), F.regexp_replace(F.regexp_extract(value, f"(?i)^(.*?){code}", 1), ends, "")).otherwise(value)
    street = before if keeps_city else F.when(before.rlike(city), F.regexp_replace(F.regexp_replace(before, city, ""), ends, "")).otherwise(before)
    named = F.when(value.isNotNull(), F.coalesce(F.trim(found(before, city)), F.lit("Unknown")))
    return {"value": value, "street": street, "city": named, "zip_code": found(value, f"(?i){code}")}
