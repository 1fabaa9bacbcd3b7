"""Paged services over HTTP, nested JSON, towns, sort keys and neighbours, each against a plain version."""

from __future__ import annotations

import json
import random
import re
import threading
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from auctionlake.domain import identity
from auctionlake.domain.municipalities import MUNICIPALITIES, municipalities, with_suffix_municipality
from auctionlake.operators import fuzzy, spatial
from auctionlake.operators import relational as R
from auctionlake.sources import pages, services

# --- a service ---------------------------------------------------------------------------------------


def layer(**changes):
    return {"fields": [{"name": n} for n in ("OBJECTID", "MAPNUMBER", "PCL_MUN", "PCLBLOCK", "PCLLOT", "PCLQCODE")], "advancedQueryCapabilities": {"supportsPagination": True}, "supportedQueryFormats": "JSON, geoJSON", "maxRecordCount": 1000} | changes


class Service(ThreadingHTTPServer):
    """A map layer in memory; every third request fails once."""

    def __init__(self, rows, meta):
        self.rows, self.meta, self.asked, self.lock = rows, meta, Counter(), threading.Lock()
        super().__init__(("127.0.0.1", 0), Handler)


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        s, url = self.server, urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        with s.lock:
            s.asked[self.path] += 1
            s.asked["all"] += 1
            fails = s.asked["all"] % 3 == 0 and s.asked[self.path] == 1
        if fails:
            self.send_error(503)
            return
        body = json.dumps(self.answer(s, url.path, q)).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    @staticmethod
    def answer(s, path, q):
        if not path.endswith("/query"):
            return s.meta
        rows = sorted(s.rows, key=lambda r: r["attributes"]["OBJECTID"])
        for sign, value in re.findall(r"OBJECTID (>|<=) (-?\d+)", q["where"]):
            rows = [r for r in rows if (r["attributes"]["OBJECTID"] > int(value) if sign == ">" else r["attributes"]["OBJECTID"] <= int(value))]
        if "outStatistics" in q:
            ids = [r["attributes"]["OBJECTID"] for r in rows]
            return {"features": [{"attributes": {"min": min(ids, default=None), "max": max(ids, default=None)}}]}
        if "returnCountOnly" in q:
            return {"count": len(rows)}
        first, n = int(q.get("resultOffset", 0)), int(q["resultRecordCount"])
        some = rows[first : first + n]
        if q["f"] == "geojson":
            return {"features": [{"type": "Feature", "properties": r["attributes"], "geometry": r.get("geometry")} for r in some]}
        return {"features": some, "exceededTransferLimit": len(rows) > first + n}


@pytest.fixture
def serve():
    running = []

    def start(rows, **changes):
        s = Service(rows, layer(**changes))
        threading.Thread(target=s.serve_forever, daemon=True).start()
        running.append(s)
        return f"http://127.0.0.1:{s.server_port}/layer/0", s

    yield start
    for s in running:
        s.shutdown()


def test_offset_pages_of_a_service(spark, serve):
    rng = random.Random(4)
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
    rows = [{"attributes": {"OBJECTID": k, "MAPNUMBER": rng.choice([f"{rng.randrange(60)} / 1", f"{rng.randrange(60)}.1", " ", None])}, "geometry": rng.choice([square, square, None])} for k in range(1, 238)]
    url, s = serve(rows)
    features = services.read_service(spark, url, page=25, pages=2, wait=0.01).cache()
    assert features.count() == len(rows) and features.select("page").distinct().count() == 10
    seen = {}
    for first in range(0, len(rows), 25):
        page = {}
        for r in rows[first : first + 25]:
            number = re.sub(r"[ /]+", ".", r["attributes"]["MAPNUMBER"] or "").strip(".")
            if number and r["geometry"] and r["attributes"]["OBJECTID"] > page.get(number, -1):
                page[number] = r["attributes"]["OBJECTID"]
        seen = page | seen
    parcels = services.first_seen(services.parcel_features(features))
    assert {r.normalized_map_number: r.source_object_id for r in parcels.collect()} == seen
    assert parcels.select("latitude", "longitude").distinct().collect()[0] == (1, 1)
    known = parcels.limit(7).select("normalized_map_number")
    assert tuple(services.import_counts(features, parcels, known).first()) == (len(rows), len(seen) - 7, 7, len(rows) - len(seen))
    assert s.asked["all"] > 10


def test_keyset_pages_of_a_service(spark, serve):
    rows = []
    for k in range(1, 160):
        at = {"centroid": {"x": -74.0 - k, "y": 40.0 + k}} if k % 5 else {}
        rows.append({"attributes": {"OBJECTID": 3 * k, "PCL_MUN": "1301 ", "PCLBLOCK": f"0{k % 40}", "PCLLOT": None, "PCLQCODE": " "}} | at)
    url, _ = serve(rows)
    features = services.read_service(spark, url, paging="keyset", fields="OBJECTID,PCL_MUN,PCLBLOCK,PCLLOT,PCLQCODE", page=10, ranges=3, wait=0.01)
    assert sorted(json.loads(r.feature)["attributes"]["OBJECTID"] for r in features.collect()) == [3 * k for k in range(1, 160)]
    first = {}
    for r in features.orderBy("page", F.desc("position")).collect():
        f = json.loads(r.feature)
        if "centroid" in f:
            first.setdefault((r.page, f["attributes"]["PCLBLOCK"].lstrip("0") or "0"), f["centroid"]["y"])
    best = {}
    for (_, block), y in sorted(first.items()):
        best.setdefault(block, y)
    assert {r.block: r.latitude for r in services.parcel_centroids(features).collect()} == best
    url, _ = serve([])
    assert services.read_service(spark, url, paging="keyset", fields="OBJECTID", wait=0.01).count() == 0 == services.read_service(spark, url, wait=0.01).count()


@pytest.mark.parametrize(("changes", "words"), [({"fields": [{"name": "OBJECTID"}]}, "MAPNUMBER"), ({"advancedQueryCapabilities": {}}, "does not page"), ({"supportedQueryFormats": "JSON"}, "GeoJSON"), ({"error": {"code": 500}}, "500")])
def test_layers_that_cannot_be_read(serve, changes, words):
    url, _ = serve([], **changes)
    with pytest.raises(RuntimeError, match=words):
        services.page_size(services.fetch(url, {"f": "json"}, wait=0.01))


def test_saved_pages_that_are_no_answers(spark):
    good = spark.createDataFrame([(0, '{"features":[{"a":[1,{"b":2}]},{}]}'), (1, '{"features":[]}')], "page int, value string")
    assert [tuple(r) for r in services.saved_pages(good).collect()] == [(0, 0, '{"a":[1,{"b":2}]}'), (0, 1, "{}")]
    for text in ('{"error":{"code":1}}', "<html>", "{}"):
        with pytest.raises(Exception, match="is no answer"):
            services.saved_pages(spark.createDataFrame([(3, text)], "page int, value string")).collect()


# --- JSON, towns, sort keys --------------------------------------------------------------------------


def test_json_values_end_at_their_own_bracket(spark):
    values = [[], [[[1], []], {"a]": "}\\\"["}], {"x": [{"y": "\\"}]}, ["é" * 50_000, "\\\\"], [{"k": k, "s": f"[{k}\n"} for k in range(3000)]]
    rows = [(k, json.dumps(v, ensure_ascii=False) + tail) for k, v in enumerate(values) for tail in ("", "]};var x = [", ' "]')]
    got = spark.createDataFrame(rows, "k int, t string").select("k", pages.json_value(F.col("t")).alias("v")).collect()
    assert all(json.loads(r.v) == values[r.k] for r in got)
    none = spark.createDataFrame([("[1, [2]",), ('["]',), ("x[]",), ("",), (None,)], "t string")
    assert [r.v for r in none.select(pages.json_value(F.col("t")).alias("v")).collect()] == [None] * 5


def test_longest_town_at_the_end(spark):
    names = sorted(n for x in MUNICIPALITIES.values() for n in x)
    pattern = re.compile(r"(?:^|\s)(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")$", re.IGNORECASE)
    texts = [f"{street}{name}" for street in ("", "1 Elm St ", "9 West ", "x") for n in names for name in (n, n.upper(), n.lower() + "s")] + ["", None, "Township", "1 Cape May Court House Road"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.town for r in with_suffix_municipality(d, "t", municipalities(spark), "town").collect()}
    spelling = {n.lower(): n for n in names}
    assert found == {t: (m := pattern.search(t)) and spelling[m[1].lower()] for t in texts if t is not None} | {None: None}
    assert len(names) == len(set(names))


def test_natural_order(spark):
    ordered = ["1", "2a", "10", "x2", "X9", "x10", "x0010a", "x99999999999999", "x123456789012345678901234567890", "x123456789012345678901234567891", "xy"]
    rng = random.Random(1)
    rows = [(t,) for t in ordered + [None, ""]]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "t string")
    assert [r.t for r in d.orderBy(*R.missing_last("t")).collect()][:-2] == ordered
    down = [r.t for r in d.orderBy(*R.missing_last("t", True)).collect()]
    assert down[:-2] == ordered[::-1] and set(down[-2:]) == {None, ""}


# --- neighbours --------------------------------------------------------------------------------------


def plain_neighbours(sales, k, miles, quarters):
    from math import asin, cos, radians, sin, sqrt

    def apart(a, b):
        h = sin(radians(b[2] - a[2]) / 2) ** 2 + cos(radians(a[2])) * cos(radians(b[2])) * sin(radians(b[3] - a[3]) / 2) ** 2
        return 2 * 3958.7613 * asin(sqrt(h))

    number = lambda d: d.year * 4 + (d.month - 1) // 3
    out = {}
    for a in sales:
        if a[2] is not None:
            old = [b for b in sales if b[2] is not None and 0 < number(a[1]) - number(b[1]) <= quarters]
            near = sorted((round(apart(a, b), 9), b[0]) for b in old)[:k]
            out[a[0]] = [x for x in near if x[0] <= miles]
    return out


@pytest.mark.parametrize(("seed", "north", "spread"), [(1, 40.0, 0.05), (2, 39.98, 0.3), (3, 74.9, 0.05), (4, -33.0, 0.002), (5, 84.0, 0.4)])
def test_neighbours_in_dense_and_empty_places(spark, seed, north, spread):
    rng = random.Random(seed)
    sales = []
    for k in range(420):
        place = (north + rng.random() * spread, -74 + rng.random() * spread) if k % 3 else (north + 0.01, -74 + 0.01 * (k % 2))  # two places have a third of all sales
        if k % 20 == 0:
            place = (None, None)
        sales.append((k, date(2020 + rng.randrange(4), rng.randrange(1, 13), 15), *place))
    d = spark.createDataFrame(sales, "id long, day date, lat double, lon double")
    got = {k: [] for k, *_, lon in sales if lon is not None}
    near = spatial.knn_before(d, d.withColumnRenamed("id", "other"), "id", "other", "lat", "lon", "day", 6, 5.0, 5)
    for r in near.orderBy("id", "rank").collect():
        got[r.id].append((round(r.miles, 9), r.other))
    assert got == plain_neighbours(sales, 6, 5.0, 5)


def test_dense_cells_are_not_joined_whole(spark):
    """Ten thousand sales in one square mile: pairs compared stay near the neighbours wanted, not the square of the cell."""
    rng = random.Random(9)
    rows = [(k, date(2020 + k % 4, 1 + k % 12, 3), 40 + rng.random() / 69, -74 + rng.random() / 69) for k in range(10_000)]
    d = spark.createDataFrame(rows, "id long, day date, lat double, lon double")
    near = spatial.knn_before(d, d.withColumnRenamed("id", "other"), "id", "other", "lat", "lon", "day", 10, 5.0, 8)
    near.write.format("noop").mode("overwrite").save()
    joined = near._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in joined and "NestedLoop" not in joined
    compared = near.count()
    assert compared == 10 * sum(1 for r in rows if (r[1].year, (r[1].month - 1) // 3) > (2020, 0))


def test_equal_miles_go_by_id_whatever_their_last_digits(spark):
    lons = [-74 + k / 9000 for k in range(60)]
    day = lambda k: date(2020, 1 if k >= 100 else 5, 3)
    rows = [(k, day(k), 40.0, lon) for k, lon in enumerate(lons)] + [(100 + k, day(100 + k), 40.0, lon) for k, lon in enumerate(lons)]
    d = spark.createDataFrame(rows, "id long, day date, lat double, lon double")
    near = spatial.knn_before(d, d.withColumnRenamed("id", "other"), "id", "other", "lat", "lon", "day", 2, 5.0, 8)
    got = {(r.id, r["rank"]): r.other for r in near.collect()}
    assert [got[k, 2] for k in range(1, 60)] == [100 + k - 1 for k in range(1, 60)]  # the one before is as far as the one after


def test_small_tiles_and_parts_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TILE_ROWS", 20)
    monkeypatch.setattr(spatial, "PART_ROWS", 15)
    rng = random.Random(8)
    sales = [(k, date(2020 + rng.randrange(3), rng.randrange(1, 13), 15), 40 + rng.random() * (0.3 if k % 4 else 0.01), -74 + rng.random() * 0.3) for k in range(400)]
    d = spark.createDataFrame(sales, "id long, day date, lat double, lon double")
    got = {k: [] for k, *_ in sales}
    for r in spatial.knn_before(d, d.withColumnRenamed("id", "other"), "id", "other", "lat", "lon", "day", 6, 5.0, 5).orderBy("id", "rank").collect():
        got[r.id].append((round(r.miles, 9), r.other))
    assert got == plain_neighbours(sales, 6, 5.0, 5)


# --- names and parcels -------------------------------------------------------------------------------


def test_bound_is_never_below_the_ratio(spark):
    from difflib import SequenceMatcher

    rng = random.Random(6)
    pairs = [("".join(rng.choice("ABC12é") for _ in range(rng.randint(1, 14))), "".join(rng.choice("ABC12é") for _ in range(rng.randint(1, 14)))) for _ in range(300)]
    d = spark.createDataFrame(pairs, "a string, b string")
    bound = fuzzy.ratio_bound(fuzzy.letter_counts(F.col("a")), fuzzy.letter_counts(F.col("b")), F.length("a"), F.length("b"))
    for r in d.select("a", "b", bound.alias("bound")).collect():
        assert r.bound >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-12
        assert r.bound == pytest.approx(SequenceMatcher(None, r.a, r.b).quick_ratio())


def test_large_blocks_are_cut(spark, monkeypatch):
    rng = random.Random(7)
    words = [(k, "x" if k % 4 else "y", "".join(rng.choice("ABCD") for _ in range(6))) for k in range(120)]
    d = spark.createDataFrame(words, "id long, block string, name string")
    run = lambda: sorted(map(tuple, fuzzy.best_matches(d, d.withColumnRenamed("id", "other"), "id", "other", (F.col("block"),) * 2, (F.col("name"),) * 2, least=0.4).collect()))
    whole = run()
    a, b = fuzzy.in_parts(d, d.withColumnRenamed("id", "other"), "block", "other", 7)
    assert b.groupBy("block", "part_").count().agg(F.max("count")).first()[0] < 30 and a.count() > d.count()
    monkeypatch.setattr(fuzzy.in_parts, "__defaults__", (7,))
    assert run() == whole and len(whole) > 300


def test_resolver_reads_a_lot_without_its_part_only_where_it_is_alone(spark):
    sale = "sale_id long, county string, city string, street_address string, normalized_address string"
    sales = spark.createDataFrame([(k, "C", "T", "1 Elm St", "1 Elm St") for k in (1, 2, 3)], sale)
    ids = spark.createDataFrame([(1, 0, "5", "1", None), (1, 1, "6", "2.01", None), (2, 0, "5", "1", None), (2, 1, "7", "3.01", None), (3, 0, "6", "2.01", None)], "sale_id long, position int, block string, lot string, qualifier string")
    parcels = [(10, "C", "M", "5", "1", "", "1ELMST", "1 Elm St"), (11, "C", "M", "6", "2", "", "Q", "8 Oak Rd"), (12, "C", "M", "7", "3", "A", "Q", "1 Elm St"), (13, "C", "M", "7", "3", "B", "Q", "9 Oak Rd")]
    parcels = spark.createDataFrame(parcels, "parcel_id long, county string, municipality_code string, block string, lot string, qualifier string, normalized_address string, current_address string")
    aliases = spark.createDataFrame([("C", "T", "M")], "county string, alias string, municipality_code string")
    got = sorted(map(tuple, identity.resolve(sales, ids, parcels, aliases).collect()))
    assert got == [(1, 10, "LEGAL_MULTI"), (1, 11, "LEGAL_MULTI"), (2, None, "REVIEW_LEGAL"), (3, None, "REVIEW_LEGAL")]
