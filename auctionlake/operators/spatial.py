"""Nearest neighbours on the globe without an index: adaptive tiles as keys of groups that numpy searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlake.functions.values import EARTH_RADIUS

_MILES_PER_DEGREE = 69.0
#: Halvings of a cell; rows of a tile beyond which it is cut in four; how far around itself a tile sees, in its own heights.
LEVELS, TILE_ROWS, HALO = 8, 4000, 0.25
#: Points of a whole neighbourhood that are searched in one place, and distances that a task holds at once.
PART_ROWS, PAIRS = 50_000, 1 << 18


# --- the search inside a group ---------------------------------------------------------------------


def _on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def _haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _ranked(t: pa.Table, p: pa.Table, k: int, miles: float, quarters: int) -> tuple[np.ndarray, np.ndarray]:
    """For each target the rows of its ``k`` nearest points (-1: none) and their miles; equal miles go by point id.

    Squares of chords give all distances but for the last digits, so whatever may be among the nearest is measured again.
    """
    column = lambda d, c: d[c].to_numpy()
    tlat, tlon, tq, plat, plon, pq = column(t, "lat"), column(t, "lon"), column(t, "q"), column(p, "lat"), column(p, "lon"), column(p, "q")
    found, far = np.full((len(tq), k), -1), np.full((len(tq), k), np.inf)
    if not len(pq) or not len(tq):
        return found, far
    place_of_id = np.empty(len(pq), dtype=np.int64)
    place_of_id[pc.sort_indices(p["p_id"]).to_numpy()] = np.arange(len(pq))
    points, wanted = _on_sphere(plat, plon), _on_sphere(tlat, tlon)
    reach = 2 * np.sin(min(miles / (2 * EARTH_RADIUS), np.pi / 2))
    slack = 1e-12 * reach
    by_quarter, by_target = np.argsort(pq, kind="stable"), np.argsort(tq, kind="stable")
    days, starts = np.unique(tq[by_target], return_index=True)
    for day, rows in zip(days, np.split(by_target, starts[1:]), strict=True):
        lo, hi = np.searchsorted(pq[by_quarter], [day - quarters, day]) if quarters else (0, len(pq))
        if hi <= lo:
            continue
        near = by_quarter[lo:hi]
        _, first, again = np.unique(tlat[rows] + 1j * tlon[rows], return_index=True, return_inverse=True)
        b = points[near]
        own, step = np.full((len(first), k), -1), max(1, PAIRS // len(near))
        miles_of = np.full((len(first), k), np.inf)
        for at in range(0, len(first), step):
            some = rows[first[at : at + step]]
            a = wanted[some]
            square = np.zeros((len(some), len(near)))
            for axis in range(3):
                apart = np.subtract.outer(a[:, axis], b[:, axis])
                square += np.multiply(apart, apart, out=apart)
            limit = np.full(len(some), reach * reach + slack)
            if len(near) > k:
                limit = np.minimum(limit, np.partition(square, k - 1, axis=1)[:, k - 1] + slack)
            i, j = np.nonzero(square <= limit[:, None])
            j = near[j]
            d = _haversine(tlat[some[i]], tlon[some[i]], plat[j], plon[j])
            inside = d <= miles
            i, j, d = i[inside], j[inside], d[inside]
            order = np.lexsort((place_of_id[j], np.round(d, 9), i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            few = rank < k
            own[at + i[few], rank[few]], miles_of[at + i[few], rank[few]] = j[few], d[few]
        again = again.reshape(-1)
        found[rows], far[rows] = own[again], miles_of[again]
    return found, far


def _search(k: int, miles: float, quarters: int, itself: bool, names: list[str], tiled: bool) -> Callable:
    """The search of a tile or, if not ``tiled``, of a part of a whole neighbourhood; a target whose nearest may lie outside its tile's sight is not ``done``."""

    def run(key: tuple, t: pa.Table, p: pa.Table) -> pa.Table:
        seen = min(miles, HALO * miles / 2 ** key[1].as_py()) if tiled else miles
        wanted = k if itself else k + 1
        found, far = _ranked(t, p, wanted, miles, quarters)
        done = np.full(len(found), True) if seen >= miles else far[:, -1] <= seen * (1 - 1e-9)
        keep = (found >= 0) & done[:, None]
        if not itself and len(p):
            keep &= p["p_id"].to_numpy()[found] != t["t_id"].to_numpy()[:, None]
            keep &= np.cumsum(keep, axis=1) <= k
        points = p.select(["p_id", *names]).take(pa.array(found[keep])).combine_chunks()
        fields = [points["p_id"], pa.chunked_array([far[keep]]), *[points[c] for c in names]]
        near = pa.StructArray.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in fields], ["id", "miles", *names])
        offsets = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
        return pa.table({"t_id": t["t_id"], "lat": t["lat"], "lon": t["lon"], "q": t["q"], "done": pa.array(done), "near": pa.ListArray.from_arrays(pa.array(offsets), near)})

    return run


# --- tiles -----------------------------------------------------------------------------------------


def _place(lat: Column, lon: Column, zone: Column, miles: float, level: Column) -> tuple[Column, Column]:
    """Row and column, not yet whole, of a place at ``level``: cells are ``miles`` high, halved so often, and as wide at least; cells of a level lie whole in those above."""
    size = miles / _MILES_PER_DEGREE
    width = size / F.greatest(F.cos(F.radians(F.least(zone * 5 + 5 + 2 * size, F.lit(89.0)))), F.lit(0.01))
    times = F.pow(F.lit(2.0), level)
    return lat / size * times, lon / width * times


def _own_zone(lat: Column) -> Column:
    return F.floor(F.abs(lat) / 5)


def _zoned(points: DataFrame, miles: float) -> DataFrame:
    """Points under their zone of latitude, which fixes the width of cells, and under the next one where that is near."""
    size = miles / _MILES_PER_DEGREE
    return points.withColumn("zone", F.explode(F.array_distinct(F.array(*[_own_zone(F.col("lat") + d) for d in (-2 * size, 0.0, 2 * size)]))))


def _tiles(targets: DataFrame, points: DataFrame, miles: float) -> DataFrame:
    """(zone, level, r, c, parts): cells of all levels that have few rows and whose cell above has many; at the last level targets are dealt to parts."""
    places = targets.select("lat", "lon").unionByName(points.select("lat", "lon")).withColumn("zone", _own_zone(F.col("lat")))
    row, column = _place(F.col("lat"), F.col("lon"), F.col("zone"), miles, F.lit(LEVELS))
    finest = places.groupBy("zone", F.floor(row).alias("r_"), F.floor(column).alias("c_")).agg(F.count("*").alias("n"))
    above = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), LEVELS - F.col("level")))
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).groupBy("zone", "level", above("r_").alias("r"), above("c_").alias("c")).agg(F.sum("n").alias("n"))
    full = (F.col("n") > TILE_ROWS) & (F.col("level") < LEVELS)
    halves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    below = every.filter(full).withColumn("s_", halves).select("zone", (F.col("level") + 1).alias("level"), (2 * F.col("r") + F.col("s_.a")).alias("r"), (2 * F.col("c") + F.col("s_.b")).alias("c"), F.lit(True).alias("cut_"))
    tiles = every.filter(~full).join(below, ["zone", "level", "r", "c"], "left").filter("level = 0 OR cut_")
    return tiles.select("zone", "level", "r", "c", F.ceil(F.col("n") / (5 * TILE_ROWS)).cast("int").alias("parts"))


def _nearest(targets: DataFrame, points: DataFrame, k: int, miles: float, quarters: int, itself: bool, carry: tuple[str, ...], use: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(t_id, ``use`` of the array of nearest points) for all targets (t_id, lat, lon, q) and points (p_id, lat, lon, q, carried columns).

    A tile's targets are searched among the points of the tile and a quarter of its height around. Where the k-th nearest is no
    further than that, it is found. Targets that see fewer look through all of the nine cells around them, in parts.
    Neither makes pairs outside a task, so what is stored grows with the points; and both leave nothing out.
    """
    names = [f"p_{c}" for c in carry]
    points = points.select("p_id", "lat", "lon", "q", *[F.col(c).alias(f"p_{c}") for c in carry])
    near = T.ArrayType(T.StructType([T.StructField("id", points.schema["p_id"].dataType), T.StructField("miles", T.DoubleType()), *[points.schema[c] for c in names]]))
    out = T.StructType([*[T.StructField(c, targets.schema[c].dataType) for c in ("t_id", "lat", "lon", "q")], T.StructField("done", T.BooleanType()), T.StructField("near", near)])
    used = [f(F.col("near")).alias(name) for name, f in use.items()]

    # tiles are fewer than rows by their size, or than the cells of a map: a broadcast, so that no row moves before its tiles are known
    tiles = F.broadcast(_tiles(targets, points, miles))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    cell = ["zone", "level", "r", "c"]
    t = targets.withColumn("zone", _own_zone(F.col("lat"))).withColumn("level", levels)
    row, column = _place(F.col("lat"), F.col("lon"), F.col("zone"), miles, F.col("level"))
    t = t.withColumn("r", F.floor(row)).withColumn("c", F.floor(column)).join(tiles, cell).withColumn("part", F.pmod(F.xxhash64("t_id"), "parts").cast("int")).drop("parts")
    p = _zoned(points, miles).withColumn("level", levels)
    row, column = _place(F.col("lat"), F.col("lon"), F.col("zone"), miles, F.col("level"))
    sides = lambda x: F.array_distinct(F.array(F.floor(x - HALO), F.floor(x + HALO)))
    p = p.withColumn("r", F.explode(sides(row))).withColumn("c", F.explode(sides(column))).join(tiles, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = ["zone", "level", "r", "c", "part"]
    first = t.groupBy(*key).cogroup(p.groupBy(*key)).applyInArrow(_search(k, miles, quarters, itself, names, True), out)
    first = first.select("t_id", "lat", "lon", "q", "done", *used).localCheckpoint()

    # what is left: all points of the nine cells around, of the quarters before
    area = ["zone", "r", "c", "q"]
    whole = lambda d: dict(zip(("r", "c"), [F.floor(x) for x in _place(F.col("lat"), F.col("lon"), F.col("zone"), miles, F.lit(0))], strict=True))  # noqa: E731, ARG005
    left = first.filter("NOT done").select("t_id", "lat", "lon", "q").withColumn("zone", _own_zone(F.col("lat")))
    left = left.withColumns(whole(left))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    back = F.explode(F.sequence(F.lit(1), F.lit(quarters))) if quarters else F.lit(0)
    around = left.select(*area).distinct().withColumn("s_", steps).withColumn("b_", back).select("zone", (F.col("r") + F.col("s_.a")).alias("r"), (F.col("c") + F.col("s_.b")).alias("c"), (F.col("q") - F.col("b_")).alias("q"), F.struct("r", "c", "q").alias("of_"))
    p = _zoned(points, miles)
    p = p.withColumns(whole(p)).join(around, area).select("p_id", "lat", "lon", "q", *names, "zone", F.col("of_.r").alias("r"), F.col("of_.c").alias("c"), F.col("of_.q").alias("tq"))
    t = left.withColumn("tq", F.col("q"))
    key = ["zone", "r", "c", "tq"]
    large = p.groupBy(*key).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).filter("parts > 1")
    one = F.coalesce("parts", F.lit(1))
    t = t.join(large, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    p = p.join(large, key, "left").withColumn("part", F.pmod(F.xxhash64("p_id"), one).cast("int")).drop("parts")
    rest = t.groupBy(*key, "part").cogroup(p.groupBy(*key, "part")).applyInArrow(_search(k, miles, quarters, itself, names, False), out)
    merged = rest.groupBy("t_id").agg(F.flatten(F.collect_list("near")).alias("near"))
    sort_key = lambda x: F.struct(F.round(x["miles"], 9).alias("m"), x["id"].alias("i"), x.alias("x"))
    merged = merged.withColumn("near", F.slice(F.transform(F.array_sort(F.transform("near", sort_key)), lambda s: s["x"]), 1, k))
    return first.filter("done").select("t_id", *use).unionByName(merged.select("t_id", *used))


def _rows(found: DataFrame, target_id: str, point_id: str, carry: tuple[str, ...]) -> DataFrame:
    each = found.select("t_id", F.posexplode("near").alias("at_", "x_"))
    return each.select(F.col("t_id").alias(target_id), F.col("x_.id").alias(point_id if point_id != target_id else f"near_{point_id}"), "x_.miles", (F.col("at_") + 1).alias("rank"), *[F.col(f"x_.p_{c}").alias(c) for c in carry])


def _few(points: DataFrame, point_id: str, by: list[str], k: int) -> DataFrame:
    """Of the points of one place only the ``k`` with the lowest ids can be among the nearest, so others go: a place with many costs no more than one with ``k``."""
    w = Window.partitionBy(*by).orderBy(point_id)
    return points.withColumn("place_", F.row_number().over(w)).filter(F.col("place_") <= k).drop("place_")


def _located(d: DataFrame, id_col: str, name: str, lat: str, lon: str, q: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    d = d.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & q.isNotNull())
    return d.select(F.col(id_col).alias(name), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), q.cast("int").alias("q"), *carry)


def knn_within(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, lat: str, lon: str, k: int = 20, miles: float = 5.0, itself: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(target id, point id, miles, rank, carried columns): of each target's ``k`` nearest points those within ``miles``.

    Taking k and then cutting at the radius is the same as ranking those inside the radius and taking k. Without ``itself`` a
    point with the target's own id does not count. Miles are compared to nine digits; ties go by point id.
    """
    t = _located(targets, target_id, "t_id", lat, lon, F.lit(0))
    p = _few(_located(points, point_id, "p_id", lat, lon, F.lit(0), carry), "p_id", ["lat", "lon"], k if itself else k + 1)
    return _rows(_nearest(t, p, k, miles, 0, itself, carry, {"near": lambda x: x}), target_id, point_id, carry)


# --- nearest of the quarters before ----------------------------------------------------------------


def before_each(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, lat: str, lon: str, day: str, use: dict[str, Callable[[Column], Column]], k: int = 20, miles: float = 5.0, quarters: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """(t_id, ``use`` of the array of neighbours): what the points of the ``quarters`` before a target's own say, the ``k`` nearest within ``miles``.

    Rows without place or day have no neighbours and are none, and such targets have no row.
    """
    q = F.year(day) * 4 + F.quarter(day)
    t = _located(targets, target_id, "t_id", lat, lon, q)
    p = _few(_located(points, point_id, "p_id", lat, lon, q, carry), "p_id", ["lat", "lon", "q"], k)
    return _nearest(t, p, k, miles, quarters, True, carry, use)


def knn_before(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, lat: str, lon: str, day: str, k: int = 20, miles: float = 5.0, quarters: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """(target id, point id, miles, rank, carried columns) of ``before_each``, one row for each neighbour."""
    found = before_each(targets, points, target_id, point_id, lat, lon, day, {"near": lambda x: x}, k, miles, quarters, carry)
    return _rows(found, target_id, point_id, carry)


def _median(values: Column) -> Column:
    known = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.transform(F.array(known), lambda s: F.when(F.size(s) > 0, (s[F.floor((F.size(s) - 1) / 2).cast("int")] + s[F.floor(F.size(s) / 2).cast("int")]) / 2))[0]


def comparables(price: str, area: str) -> dict[str, Callable[[Column], Column]]:
    """Median price, price per area and distance, and the count, of a target's neighbours."""
    price, area = f"p_{price}", f"p_{area}"
    return {
        "local_comp_median_price": lambda near: _median(near[price]),
        "local_comp_median_ppsf": lambda near: _median(F.transform(near, lambda x: x[price] / F.nullif(x[area], F.lit(0.0)))),
        "local_comp_median_miles": lambda near: _median(near["miles"]),
        "local_comp_count": lambda near: F.size(near).cast("long"),
    }
