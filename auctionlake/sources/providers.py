"""Valuation responses: read, checked against the subject, and allowed only where a lookup is worth paying for."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.functions.text import address_key
from auctionlake.operators.merge import split_rejects

RESPONSE = (
    "price double, priceRangeLow double, priceRangeHigh double, comparables array<string>, "
    "subjectProperty struct<id:string,formattedAddress:string,addressLine1:string,city:string,state:string,zipCode:string>"
)


class ValuationProvider(ABC):
    """Turns a table of requests into one of valuations and rejects."""

    name: str

    @abstractmethod
    def valuations(self, responses: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class SavedResponses(ValuationProvider):
    """Responses saved as JSON text: (property_id, response). A response without a price is rejected."""

    name = "saved"

    def valuations(self, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
        d = responses.withColumn("r", F.from_json("response", RESPONSE))
        good, bad = split_rejects(d, [(F.col("r.price").isNull(), "no value estimate")])
        money = lambda c: F.col(c).cast("decimal(14,2)")
        subject = F.col("r.subjectProperty")
        good = good.select(
            *[c for c in responses.columns if c != "response"], F.lit(self.name).alias("provider"), subject["id"].alias("provider_property_id"), money("r.price").alias("estimated_value"), money("r.priceRangeLow").alias("low_value"), money("r.priceRangeHigh").alias("high_value"),
            F.coalesce(subject["formattedAddress"], F.lit("")).alias("formatted_address"), subject["addressLine1"].alias("address_line_1"), subject["city"].alias("found_city"), subject["state"].alias("found_state"), subject["zipCode"].alias("found_zip"),
            F.coalesce(F.size("r.comparables"), F.lit(0)).alias("comparable_count"),
        )
        return good, bad.drop("r")


def _part(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def subject_matches(street: Column, city: Column, state: Column, zip_code: Column, found: tuple[Column, Column, Column, Column]) -> Column:
    """Street, city, state and code are equal once cleaned; missing parts are empty."""
    same = address_key(street, False) == address_key(found[0], False)
    for a, b in zip((city, state, zip_code), found[1:], strict=True):
        same = same & (_part(a) == _part(b))
    return same


def lookup_gate(properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(worth a paid lookup, rejects): linked, of good quality, and no unit of a building."""
    return split_rejects(properties, [(F.col("property_id").isNull(), "no linked property"), (F.coalesce("data_quality_score", F.lit(0)) < 80, "quality too low"), (F.coalesce("unit_number", F.lit("")) != "", "unit needs a manual match")])
