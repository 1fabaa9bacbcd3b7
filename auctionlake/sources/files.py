"""Snapshots, tables and map features from files, with what does not fit set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.functions.text import map_number
from auctionlake.functions.values import centroid

SNAPSHOT = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("state", "county", "sheriff_number", "address")), T.StructField("sale_date", T.TimestampType()),
    *(T.StructField(n, T.StringType()) for n in ("status", "upset_price", "source_url", "raw_payload", "plaintiff", "defendant", "judgment_amount", "plaintiff_attorney", "court_case_number", "block", "lot", "qualifier")),
])
FEATURE = T.StructType([
    T.StructField("properties", T.StructType([T.StructField("OBJECTID", T.LongType()), T.StructField("MAPNUMBER", T.StringType())])),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
])


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = SNAPSHOT, array: bool = True) -> DataFrame:
    """Listings out of JSON arrays, one to a file, or (without ``array``) out of the JSON lines that ``write_snapshot`` writes; the payload stays JSON."""
    raw = spark.read.schema(schema).json(path, multiLine=array)
    money = [F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(14,2)").alias(c) if c in ("upset_price", "judgment_amount") else F.col(c) for c in raw.columns]
    return raw.select(*money)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Listings as JSON lines: decimals as text, dates in ISO form."""
    text = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields]
    df.select(*text).write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, required: Sequence[str], money: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV file with a header: values trimmed, blank rows dropped, a byte-order mark ignored.

    A required column that is missing raises; a row with a blank required value, or an amount that is no
    number or negative, is rejected with its reason.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns]).na.drop("all")
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    value = {c: F.regexp_replace(c, r"[$,\s]", "").try_cast("decimal(14,2)") for c in money}
    rules = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is blank")) for c in required]
    rules += [F.when(F.col(c).isNotNull() & (F.trim(c) != "") & (value[c].isNull() | (value[c] < 0)), F.lit(f"{c} is no amount")) for c in money]
    marked = raw.withColumn("reason", F.coalesce(*rules) if rules else F.lit(None).cast("string"))
    good = marked.filter("reason IS NULL").select(*[value.get(c, F.col(c)).alias(c) for c in raw.columns])
    return good, marked.filter("reason IS NOT NULL")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(map_number, object_id, latitude, longitude) of saved GeoJSON features, the highest object id of a number staying."""
    schema = T.StructType([T.StructField("features", T.ArrayType(FEATURE))])
    return parse_features(spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*"))


def parse_features(features: DataFrame) -> DataFrame:
    point = T.ArrayType(T.DoubleType())
    polygon = F.from_json("geometry.coordinates", T.ArrayType(T.ArrayType(point)))
    many = F.from_json("geometry.coordinates", T.ArrayType(T.ArrayType(T.ArrayType(point))))
    exterior = F.when(F.col("geometry.type") == "Polygon", F.slice(polygon, 1, 1)).when(F.col("geometry.type") == "MultiPolygon", F.transform(many, lambda p: p[0]))
    d = features.select(map_number(F.col("properties.MAPNUMBER")).alias("map_number"), F.col("properties.OBJECTID").alias("object_id"), centroid(exterior).alias("c"))
    best = d.filter("map_number IS NOT NULL").groupBy("map_number").agg(F.max_by(F.struct("object_id", "c"), "object_id").alias("x"))
    return best.select("map_number", "x.object_id", F.col("x.c.latitude").cast("decimal(10,7)").alias("latitude"), F.col("x.c.longitude").cast("decimal(10,7)").alias("longitude"))


# Counties of New Jersey in the order of their codes.
NJ_COUNTIES = [
    "Atlantic", "Bergen", "Burlington", "Camden", "Cape May", "Cumberland", "Essex", "Gloucester", "Hudson", "Hunterdon", "Mercer", "Middlesex", "Monmouth",
    "Morris", "Ocean", "Passaic", "Salem", "Somerset", "Sussex", "Union", "Warren",
]


def county_code(c):
    """The two-digit code of a county given by name or code; null if there is none."""
    codes = {n.lower(): f"{k:02d}" for k, n in enumerate(NJ_COUNTIES, 1)}
    by_name = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    text = F.lower(F.trim(c))
    number = F.lpad(text, 2, "0")
    return F.when(text.rlike(r"^\d{1,2}$") & number.isin(list(codes.values())), number).otherwise(F.try_element_at(by_name, text))


def one_county_file(spark: SparkSession, pattern: str, county: str, folder: bool = False) -> str:
    """The path of the one file (or, with ``folder``, of the one folder of files) whose name starts with the county's letters; more or none raise."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    parts = F.split("path", "/")
    path = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/") if folder else F.col("path")
    name = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), "[^a-z.]", "")
    found = [r["path"] for r in files.select(path.alias("path"), name.alias("name")).filter(F.col("name").startswith("".join(x for x in county.lower() if x.isalpha()))).select("path").distinct().limit(2).collect()]
    if len(found) != 1:
        raise FileNotFoundError(f"expected one file for {county}; found {'several' if found else 'none'}")
    return found[0]


def assessment_attributes(attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of parcel attributes: both numbers are required; the assessed value sums what is there."""
    from auctionlake.functions.values import sum_or_null
    from auctionlake.operators.merge import split_rejects

    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    good, bad = split_rejects(attributes, [(text("MAPNUMBER").isNull(), "no map number"), (text("PARID").isNull(), "no tax parcel number")])
    value = lambda c: F.col(c).cast("decimal(14,2)")
    parts = [value("LANDVALUE"), value("BLDGVALUE"), value("PREFVALUE")]
    good = good.select(
        text("MAPNUMBER").alias("map_number"), text("PARID").alias("tax_parcel_id"), map_number(F.col("PARID")).alias("normalized_tax_parcel_id"), sum_or_null(*parts).alias("assessed_value"),
        parts[0].alias("land_value"), parts[1].alias("improvement_value"), text("CLASS").alias("property_type"), F.try_to_date(text("SALEDATE"), "M/d/yyyy").alias("last_sale_date"), value("SALEAMT").alias("last_sale_price"),
    )
    return good, bad
