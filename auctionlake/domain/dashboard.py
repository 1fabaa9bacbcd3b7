"""What a dashboard shows of a listing: labels, averages and opportunities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlake.operators.relational import filtered_count, nearest_rank_quartile

# How codes are told to a reader.
PROVIDER_LABELS = {"monmouth_xgboost_avm_v2": "Monmouth AVM", "monroe_kiz_xgboost_avm_v1": "Monroe experimental AVM", "rentcast": "RentCast", "manual_csv": "Manual review", "manual": "Manual review"}
STATUS_LABELS = {
    "COUNTY_MODEL_UNAVAILABLE": "County model unavailable", "PARCEL_MATCH_UNDER_REVIEW": "Parcel match under review", "PARCEL_MATCH_REQUIRED": "Parcel match required",
    "MANUAL_REVIEW_REQUIRED": "Manual review required", "PROPERTY_TYPE_MODEL_UNAVAILABLE": "Commercial model unavailable", "LIVING_AREA_MISSING": "Living area missing", "MODEL_SCORING_REQUIRED": "Ready for model scoring",
}
POSITION_LABELS = {"PRIMARY_FORECLOSING": "Primary / foreclosing", "POTENTIALLY_SENIOR": "Potentially senior", "SECONDARY_JUNIOR": "Secondary / junior"}
HIGH_EQUITY = 150_000


def _label(code: Column, labels: Mapping[str, str]) -> Column:
    return F.coalesce(*[F.when(code == k, v) for k, v in labels.items()])


def provider_label(code: Column) -> Column:
    return F.coalesce(_label(code, PROVIDER_LABELS), code, F.lit("Pending"))


def status_label(code: Column) -> Column:
    return F.coalesce(_label(code, STATUS_LABELS), F.lit("Valuation pending"))


def position_label(code: Column) -> Column:
    return F.coalesce(_label(code, POSITION_LABELS), F.lit("Priority unknown"))


def confidence_label(share: Column) -> Column:
    """A share in whole per cent, halves up."""
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")), F.lit("Pending"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: mean gross equity, how many reach HIGH_EQUITY, and the upper quartiles of equity and probability."""
    means = rows.agg(F.avg("gross_equity").alias("average_equity"), filtered_count(F.col("gross_equity") >= HIGH_EQUITY).alias("high_equity_count"))
    for column, name in (("gross_equity", "equity_threshold"), ("sale_probability", "probability_threshold")):
        means = means.join(F.broadcast(nearest_rank_quartile(rows, column).withColumnRenamed("threshold", name)), how="cross")
    return means


def with_opportunities(rows: DataFrame) -> DataFrame:
    """Adds ``high_opportunity``: probability and equity both reach their upper quartile, and there is equity at all."""
    limits = F.broadcast(summary(rows).select("equity_threshold", "probability_threshold"))
    high = (F.col("sale_probability") >= F.col("probability_threshold")) & (F.col("gross_equity") >= F.col("equity_threshold")) & (F.col("gross_equity") > 0)
    return rows.join(limits, how="cross").withColumn("high_opportunity", F.coalesce(high, F.lit(False))).select(*rows.columns, "high_opportunity")
