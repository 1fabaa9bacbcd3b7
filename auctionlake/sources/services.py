"""Map services that give their features page by page: a data source with one task for each range of pages, and rules across pages."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auctionlake.functions.text import dotted_component, map_number
from auctionlake.functions.values import centroid

# The most features of a page, and the tries for one, the k-th of which waits 2 ** k seconds if it fails.
PAGE_SIZE, TRIES = 2000, 5
KEY = "OBJECTID"
PAGES = "page long, position int, feature string"


def fetch(url: str, params: Mapping[str, object], tries: int = TRIES, wait: float = 1.0) -> dict:
    """The JSON answer of a service; one that cannot be read is asked for again, one that reports an error raises."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=120) as answer:
                payload = json.load(answer)
            break
        except (OSError, ValueError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    if payload.get("error"):
        raise RuntimeError(str(payload["error"]))
    return payload


def page_size(metadata: Mapping, needed: Sequence[str] = (KEY, "MAPNUMBER"), page: int | None = None) -> int:
    """Features that one request may ask for; a layer without the fields, without paging or without GeoJSON raises."""
    fields = {f["name"] for f in metadata.get("fields", [])}
    if not fields.issuperset(needed):
        raise RuntimeError(f"fields {sorted(set(needed) - fields)} are missing; there are {sorted(fields)}")
    if not metadata.get("advancedQueryCapabilities", {}).get("supportsPagination"):
        raise RuntimeError("the layer does not page")
    if "geojson" not in {x.strip().lower() for x in metadata.get("supportedQueryFormats", "").split(",")}:
        raise RuntimeError("the layer has no GeoJSON")
    most = min(int(metadata.get("maxRecordCount") or PAGE_SIZE), PAGE_SIZE)
    return min(page or most, most)


class _Pages(InputPartition):
    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))


class FeatureService(DataSource):
    """``spark.read.format("feature_service").option("url", ...).load()``: (page, position, feature as JSON) of a whole layer.

    Options: ``url`` of the layer; ``paging``: ``offset`` (the default: pages of the layer in the order of its key, GeoJSON) or
    ``keyset`` (key ranges, each read on from the last key seen, with centroids for geometries); ``fields``, ``where``, ``page``
    (features of a page), ``ranges`` (tasks of a keyset), ``pages`` (pages of a task), ``wait`` (seconds before a second try).
    The driver asks for the layer's description and its size only; pages are read by the tasks, each again where one is lost.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (_KeysetReader if self.options.get("paging") == "keyset" else _OffsetReader)(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.where = options["url"].rstrip("/"), options.get("where", "1=1")
        self.fields = options.get("fields", f"{KEY},MAPNUMBER")
        self.wait, self.per_task = float(options.get("wait", 1.0)), int(options.get("pages", 1))
        self.ranges = int(options.get("ranges", 8))
        self.size = page_size(fetch(self.url, {"f": "json"}, wait=self.wait), self.fields.split(","), int(options["page"]) if "page" in options else None)

    def ask(self, **params: object) -> dict:
        return fetch(f"{self.url}/query", {"where": self.where, "outFields": self.fields, "outSR": 4326, "orderByFields": KEY} | params, wait=self.wait)


class _OffsetReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        total = int(self.ask(returnCountOnly="true", f="json")["count"])
        pages = -(-total // self.size)
        return [_Pages(k, min(k + self.per_task, pages)) for k in range(0, pages, self.per_task)] or [_Pages(0, 0)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for page in range(*partition.value):
            payload = self.ask(resultOffset=page * self.size, resultRecordCount=self.size, returnGeometry="true", f="geojson")
            for position, feature in enumerate(payload.get("features", [])):
                yield page, position, json.dumps(feature)


class _KeysetReader(_Reader):
    """A page is known by the key after which it begins."""

    def partitions(self) -> list[InputPartition]:
        ends = json.dumps([{"statisticType": kind, "onStatisticField": KEY, "outStatisticFieldName": kind} for kind in ("min", "max")])
        found = self.ask(outStatistics=ends, f="json").get("features") or [{"attributes": {}}]
        low, high = found[0]["attributes"].get("min"), found[0]["attributes"].get("max")
        if low is None:
            return [_Pages(0, 0)]
        step = max(1, -(-(high - low + 1) // self.ranges))
        return [_Pages(k - 1, min(k - 1 + step, high)) for k in range(low, high + 1, step)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        last, stop = partition.value
        while last < stop:
            rows = self.ask(where=f"({self.where}) AND {KEY} > {last} AND {KEY} <= {stop}", returnGeometry="false", returnCentroid="true", resultRecordCount=self.size, f="json")
            page = last
            for position, feature in enumerate(rows.get("features", [])):
                last = max(last, feature["attributes"][KEY])
                yield page, position, json.dumps(feature)
            if last == page or not rows.get("exceededTransferLimit"):
                return


def read_service(spark: SparkSession, url: str, **options: object) -> DataFrame:
    spark.dataSource.register(FeatureService)
    return spark.read.format(FeatureService.name()).options(url=url, **options).load()


def saved_pages(pages: DataFrame, page: str = "page", body: str = "value") -> DataFrame:
    """(page, position, feature) of answers that were saved, one text for each page; a text that is no answer, or reports an error, raises."""
    d = pages.select(F.col(page).cast("long").alias("page"), F.from_json(body, "error string, features array<string>").alias("x"), F.col(body).alias("body_"))
    wrong = F.col("x").isNull() | F.col("x.error").isNotNull() | (F.col("x.features").isNull() & F.get_json_object("body_", "$.features").isNull())
    fine = F.when(wrong, F.raise_error(F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" is no answer: "), F.coalesce("x.error", F.substring("body_", 1, 200))))).otherwise(F.col("x.features"))
    return d.select("page", F.posexplode(fine).alias("position", "feature"))


# --- parcels: offset pages, GeoJSON ----------------------------------------------------------------

_GEOJSON = T.StructType([
    T.StructField("properties", T.StructType([T.StructField(KEY, T.LongType()), T.StructField("MAPNUMBER", T.StringType())])),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
])


def outer_rings(kind: Column, coordinates: Column) -> Column:
    """The exterior rings of a polygon or of several, from coordinates as JSON."""
    point = T.ArrayType(T.DoubleType())
    one = F.from_json(coordinates, T.ArrayType(T.ArrayType(point)))
    many = F.from_json(coordinates, T.ArrayType(T.ArrayType(T.ArrayType(point))))
    return F.when(kind == "Polygon", F.slice(one, 1, 1)).when(kind == "MultiPolygon", F.transform(many, lambda p: p[0]))


def parcel_features(features: DataFrame) -> DataFrame:
    """(page, position, map_number, normalized_map_number, source_object_id, geometry, latitude, longitude): features with a number, an id and a geometry."""
    x = features.select("page", "position", F.from_json("feature", _GEOJSON).alias("x"), F.get_json_object("feature", "$.geometry").alias("geometry"))
    number = F.trim(F.coalesce("x.properties.MAPNUMBER", F.lit("")))
    place = centroid(outer_rings(F.col("x.geometry.type"), F.col("x.geometry.coordinates")))
    d = x.select("page", "position", number.alias("map_number"), map_number(number).alias("normalized_map_number"), F.col(f"x.properties.{KEY}").alias("source_object_id"), "geometry", place.alias("c"))
    good = d.filter("normalized_map_number IS NOT NULL AND geometry IS NOT NULL AND source_object_id IS NOT NULL")
    return good.select(*good.columns[:-1], F.round("c.latitude", 7).cast("decimal(10,7)").alias("latitude"), F.round("c.longitude", 7).cast("decimal(10,7)").alias("longitude"))


def first_seen(parcels: DataFrame) -> DataFrame:
    """One row for each normalized number: that of the first page which has it, there the highest object id, the first of equals."""
    kept = parcels.groupBy("normalized_map_number").agg(F.min_by(F.struct(*parcels.columns), F.struct("page", -F.col("source_object_id"), "position")).alias("x_"))
    return kept.select("x_.*")


def import_counts(features: DataFrame, kept: DataFrame, known: DataFrame, key: str = "normalized_map_number") -> DataFrame:
    """One row: features read, parcels inserted and updated (``known`` holds the numbers there before), and features skipped."""
    had = kept.join(known.select(key).distinct().withColumn("had_", F.lit(True)), key, "left")
    saved = had.agg(F.count("*").alias("kept_"), F.count("had_").alias("updated"))
    read = features.agg(F.count("*").alias("downloaded"))
    return read.crossJoin(F.broadcast(saved)).select("downloaded", (F.col("kept_") - F.col("updated")).alias("inserted"), "updated", (F.col("downloaded") - F.col("kept_")).alias("skipped"))


# --- centroids: keyset pages -----------------------------------------------------------------------

_ATTRIBUTES = T.StructType([
    T.StructField("attributes", T.StructType([T.StructField(KEY, T.LongType()), *(T.StructField(n, T.StringType()) for n in ("PCL_MUN", "PCLBLOCK", "PCLLOT", "PCLQCODE"))])),
    T.StructField("centroid", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])),
])
PARCEL = ["municipality_code", "block", "lot", "qualifier"]


def parcel_centroids(features: DataFrame) -> DataFrame:
    """(municipality_code, block, lot, qualifier, latitude, longitude): of a parcel's features the last of the first page that has any with a centroid."""
    d = features.select("page", "position", F.from_json("feature", _ATTRIBUTES).alias("x")).filter("x.centroid IS NOT NULL")
    part = lambda c: dotted_component(F.col(f"x.attributes.{c}"))
    d = d.select("page", "position", F.trim("x.attributes.PCL_MUN").alias("municipality_code"), part("PCLBLOCK").alias("block"), part("PCLLOT").alias("lot"), part("PCLQCODE").alias("qualifier"), F.col("x.centroid.y").alias("latitude"), F.col("x.centroid.x").alias("longitude"))
    best = d.groupBy(*PARCEL).agg(F.min_by(F.struct("latitude", "longitude"), F.struct("page", -F.col("position"))).alias("c_"))
    return best.select(*PARCEL, "c_.latitude", "c_.longitude")


def fill_centroids(sales: DataFrame, centroids: DataFrame, source: str) -> DataFrame:
    """``sales`` with the place of their parcel where they have none, and where it comes from."""
    found = centroids.select(*PARCEL, F.col("latitude").alias("lat_"), F.col("longitude").alias("lon_"))
    d = sales.join(found, PARCEL, "left")
    new = F.col("latitude").isNull() & F.col("lat_").isNotNull()
    values = {"latitude": F.col("lat_"), "longitude": F.col("lon_"), "coordinate_source": F.lit(source)}
    return d.select(*[F.when(new, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in sales.columns])
