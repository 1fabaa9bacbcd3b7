"""Snapshots into the tables of record: sales, history, properties, parcels, matches, and what a run did."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auctionlake.functions.text import address_key, alias_key, identity_component, parcel_pin
from auctionlake.operators.merge import append_new, merge_upsert
from auctionlake.operators.relational import filtered_count, unanimous

# How each column of a known sale takes a new observation. upset_price only rises.
SALE_RULES = (
    dict.fromkeys(["plaintiff", "defendant", "current_sale_date", "current_status", "estimated_upset_price", "alternate_upset_price", "source_url", "last_seen_at", "last_scraped_at", "raw_source_hash"], "overwrite")
    | dict.fromkeys(["judgment_amount", "docket_number", "daily_interest", "attorney_fees_costs", "deposit_percent", "balance_due_days", "owner_occupied"], "keep")
    | dict.fromkeys(["description_text", "description_source_url", "parser_version", "upset_price_conflict", "description_parsed_at"], "prefer_new")
    | dict.fromkeys(["first_seen_at", "source_system", "is_active"], "insert_only")
    | {"upset_price": "greatest"}
)
# What a new match may change of features that are there already; assessed figures stay.
MATCH_COLUMNS = ["municipality_code", "block", "lot", "qualifier", "property_location", "match_method", "match_confidence", "source_hash"]
PROPERTY_RULES = {"data_quality_score": "greatest"}
PARCEL_RULES = {"first_seen": "least", "last_seen": "greatest"}


def load_sales(existing: DataFrame, incoming: DataFrame, keys=("state", "county", "sheriff_number")) -> DataFrame:
    """Sales with a snapshot merged in. Of a sale that is known already the highest upset price of any kind stays."""
    rules = {c: SALE_RULES.get(c, "overwrite") for c in existing.columns if c not in keys}
    prices = [c for c in ("upset_price", "estimated_upset_price", "alternate_upset_price") if c in incoming.columns]
    known = existing.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.lit(True).alias("known_"))
    on = None
    for k in keys:
        same = incoming[k].eqNullSafe(known[f"e_{k}"])
        on = same if on is None else on & same
    highest = F.greatest(*[F.col(c) for c in prices]) if len(prices) > 1 else F.col(prices[0])
    raised = incoming.join(known, on, "left").withColumn("upset_price", F.when(F.col("known_"), highest).otherwise(F.col("upset_price"))).select(*incoming.columns)
    return merge_upsert(existing, raised, list(keys), rules)


def status_events(sales: DataFrame, incoming: DataFrame, history: DataFrame, page_history: DataFrame, key: str = "sale_id") -> DataFrame:
    """New history rows: first observations, changes of status or sale date, and page rows not recorded yet.

    All sides have key, status, raw_status and sale_date; nulls are equal to nulls.
    """
    columns = [key, "status", "raw_status", "sale_date"]
    old = sales.select(F.col(key).alias("k_"), F.col("status").alias("s_"), F.col("sale_date").alias("d_"))
    joined = incoming.join(old, incoming[key] == F.col("k_"), "left")
    changed = joined.filter(F.col("k_").isNull() | ~F.col("status").eqNullSafe(F.col("s_")) | ~F.col("sale_date").eqNullSafe(F.col("d_"))).select(*columns)
    return append_new(history.select(*columns), page_history.select(*columns), columns).unionByName(changed)


def upsert_properties(existing: DataFrame, incoming: DataFrame, key: str = "address_hash") -> DataFrame:
    return merge_upsert(existing, incoming, [key], {c: PROPERTY_RULES.get(c, "overwrite") for c in existing.columns if c != key})


def upsert_parcels(existing: DataFrame, staged: DataFrame, keys=("state", "municipality_code", "block", "lot", "qualifier")) -> DataFrame:
    """Parcels with staged snapshot lines merged in: seen from the earliest to the latest year, the latest address."""
    latest = staged.groupBy(*keys).agg(F.min("source_year").alias("first_seen"), F.max("source_year").alias("last_seen"), F.max_by("current_address", F.struct("source_year", "current_address")).alias("current_address"))
    return merge_upsert(existing, latest, list(keys), {c: PARCEL_RULES.get(c, "overwrite") for c in existing.columns if c not in keys})


def accept_matches(matches: DataFrame, version: str) -> Mapping[str, DataFrame]:
    """What accepted matches (sale_id, property_id, parcel_id, position, municipality_code, block, lot, qualifier, numbers) write.

    The parcel with the largest improvement is the primary one, at 100 points; others of the sale are
    additional ones at 95. A property's features are its parcels' sums.
    """
    w = Window.partitionBy("sale_id").orderBy(F.desc(F.coalesce("improvement_assessed", F.lit(0))), "position", "parcel_id")
    ranked = matches.withColumn("rank", F.row_number().over(w)).withColumn("total_score", F.when(F.col("rank") == 1, 100).otherwise(95))
    candidates = ranked.select("sale_id", "parcel_id", "rank", "total_score", F.lit("ACCEPTED").alias("decision"), F.lit(version).alias("resolver_version"))
    links = ranked.select("sale_id", "parcel_id", F.when(F.col("rank") == 1, "PRIMARY").otherwise("ADDITIONAL").alias("relationship"), F.lit("VERIFIED").alias("match_status"), F.col("total_score").alias("match_score"))
    parts = F.array(*[F.struct(F.lit(f"LEGAL_{c.upper()}").alias("evidence_type"), F.col(c).alias("raw_value")) for c in ("block", "lot", "qualifier")])
    evidence = ranked.select("sale_id", F.explode(parts).alias("e")).select("sale_id", "e.*").filter("coalesce(raw_value, '') <> ''")
    evidence = evidence.withColumn("normalized_value", identity_component(F.col("raw_value"))).dropDuplicates(["sale_id", "evidence_type", "normalized_value"])
    numbers = ["acreage", "land_assessed", "improvement_assessed", "total_assessed", "annual_property_tax"]
    features = ranked.groupBy("property_id").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in numbers], F.min_by("parcel_id", "rank").alias("parcel_id"), F.when(F.count("*") > 1, 95).otherwise(100).alias("match_confidence"))
    return {"candidates": candidates, "links": links, "evidence": evidence, "features": features}


def reject_pending(candidates: DataFrame, verified: DataFrame, key: str = "property_id") -> DataFrame:
    """Pending candidates of properties that are verified by now are rejected."""
    done = verified.select(F.col(key).alias("k_")).distinct()
    joined = candidates.join(done, candidates[key] == F.col("k_"), "left")
    rejected = F.col("k_").isNotNull() & (F.col("review_status") == "PENDING")
    return joined.withColumn("review_status", F.when(rejected, "REJECTED").otherwise(F.col("review_status"))).drop("k_")


def address_evidence(sales: DataFrame) -> DataFrame:
    """Each sale's address as a piece of identity evidence, 90 points."""
    return sales.select("sale_id", F.lit("PROPERTY_ADDRESS").alias("evidence_type"), F.col("normalized_address").alias("raw_value"), address_key(F.col("normalized_address")).alias("normalized_value"), F.lit(90).alias("confidence")).distinct()


def aliases_from_matches(matched: DataFrame) -> DataFrame:
    """(normalized_alias, jurisdiction_id): city names whose verified matches all lie in one jurisdiction."""
    return unanimous(matched.filter(F.col("city").isNotNull()).select(alias_key(F.col("city")).alias("normalized_alias"), "jurisdiction_id"), "normalized_alias", "jurisdiction_id")


def rescale_confidence(df: DataFrame, column: str) -> DataFrame:
    """Shares from 0 to 1 become points from 0 to 100; points stay."""
    return df.withColumn(column, F.when(F.col(column).between(0, 1), F.col(column) * 100).otherwise(F.col(column)))


def run_log(job: str, found: DataFrame, created: DataFrame, updated: DataFrame, failed: DataFrame) -> DataFrame:
    """One row about a run. Counting is one aggregate over tagged rows, so no side is counted on its own."""
    sides = {"records_found": found, "records_created": created, "records_updated": updated, "records_failed": failed}
    tagged = None
    for name, side in sides.items():
        one = side.select(F.lit(name).alias("side"))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.agg(*[F.count(F.when(F.col("side") == n, 1)).alias(n) for n in sides])
    status = F.when(F.col("records_failed") > 0, "partially_completed").otherwise("completed")
    return counts.select(F.lit(job).alias("job_name"), status.alias("status"), *sides)


def scrape_tallies(records: DataFrame) -> DataFrame:
    """One row about a scrape: records, scheduled ones, those with a judgment and those with an upset price."""
    return records.agg(F.count("*").alias("records"), filtered_count(F.col("status") == "scheduled").alias("scheduled"), F.count("judgment_amount").alias("judgments"), F.count("upset_price").alias("upset_prices"))


def counted_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], newest: str) -> tuple[DataFrame, DataFrame]:
    """(the merged table, one row with how many keys are inserted and updated, and how many rows repeat a key).

    Of rows with one key the one with the largest ``newest``, which is unique in a key, counts; it overwrites every column.
    """
    each = incoming.groupBy(*keys).agg(F.max_by(F.struct(*existing.columns), F.col(newest)).alias("row_"), F.count("*").alias("rows_"))
    known = existing.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.lit(True).alias("known_"))
    seen = each.join(known, reduce(and_, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]), "left")
    counts = seen.agg(filtered_count(F.col("known_").isNull()).alias("inserted"), F.count("known_").alias("updated"), F.coalesce(F.sum(F.col("rows_") - 1), F.lit(0)).alias("duplicates"))
    return merge_upsert(existing, each.select("row_.*"), list(keys), {c: "overwrite" for c in existing.columns if c not in keys}), counts


def upsert_known_details(parcels: DataFrame, details: DataFrame, incoming: DataFrame) -> Mapping[str, DataFrame]:
    """Details of parcels whose map number is known; those of others are only counted.

    parcels (parcel_id, map_number, tax_parcel_id) take the tax number, details (parcel_id, ...) every column.
    ``incoming`` has one row for each map number and the columns of details but for parcel_id.
    """
    known = incoming.join(parcels.select("parcel_id", "map_number"), "map_number", "left").join(details.select("parcel_id", F.lit(True).alias("had_")), "parcel_id", "left")
    found = F.col("parcel_id").isNotNull()
    counts = known.agg(F.count("*").alias("parsed"), filtered_count(found).alias("matched"), filtered_count(found & F.col("had_").isNull()).alias("inserted"), F.count("had_").alias("updated"), filtered_count(~found).alias("unmatched"))
    matched = known.filter(found)
    numbers = matched.select("parcel_id", F.col("tax_parcel_id").alias("new_"), F.lit(True).alias("hit_"))
    numbered = parcels.join(numbers, "parcel_id", "left").withColumn("tax_parcel_id", F.when(F.col("hit_"), F.col("new_")).otherwise(F.col("tax_parcel_id"))).select(*parcels.columns)
    merged = merge_upsert(details, matched.select(*details.columns), ["parcel_id"], {c: "overwrite" for c in details.columns if c != "parcel_id"})
    return {"parcels": numbered, "details": merged, "counts": counts}


def upsert_features(features: DataFrame, matched: DataFrame, identity_only: bool = False, keeps_year: bool = False) -> DataFrame:
    """Features of properties with accepted matches, one for each property.

    A match found by the matcher overwrites every column. With ``identity_only`` features that are there keep their
    assessed figures and take where and how the parcel was matched, and its year unless ``keeps_year`` (approved by hand).
    """
    taken = MATCH_COLUMNS + ([] if keeps_year else ["snapshot_year"])
    rules = {c: "insert_only" if identity_only and c not in taken else "overwrite" for c in features.columns if c != "property_id"}
    return merge_upsert(features, matched.select(*features.columns), ["property_id"], rules)


def identify_properties(properties: DataFrame, matched: DataFrame) -> DataFrame:
    """Properties with the block, lot, qualifier, parcel number and confidence of their match; others stay."""
    pin = parcel_pin(F.col("municipality_code"), F.col("block"), F.col("lot"), F.col("qualifier"))
    new = {"block": F.col("block"), "lot": F.col("lot"), "qualifier": F.col("qualifier"), "pams_pin": pin, "identity_confidence": F.col("match_confidence")}
    m = matched.select(F.col("property_id").alias("m_"), *[v.alias(f"m_{c}") for c, v in new.items()])
    joined = properties.join(m, F.col("property_id") == F.col("m_"), "left")
    return joined.select(*[F.when(F.col("m_").isNotNull(), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in properties.columns])


def add_links(links: DataFrame, accepted: DataFrame) -> DataFrame:
    """Links of sales to parcels with those of accepted matches; a link that is there stays as it is."""
    keys = ["sale_id", "parcel_id"]
    return links.unionByName(append_new(links, accepted.select(*links.columns), keys))


def upsert_analyses(analyses: DataFrame, calculated: DataFrame) -> DataFrame:
    """Analyses with calculated ones merged in by sale and version: all is overwritten but the id."""
    keys = ["sheriff_sale_id", "calculation_version"]
    return merge_upsert(analyses, calculated, keys, {c: "insert_only" if c == "analysis_id" else "overwrite" for c in analyses.columns if c not in keys})
