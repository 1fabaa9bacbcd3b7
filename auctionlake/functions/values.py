"""Dates, numbers and geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Miles.
EARTH_RADIUS = 3958.7613


def two_digit_year_date(c: Column, pivot: int = 69) -> Column:
    """YYMMDD with years up to ``pivot`` in this century; zeros and what is no date are null."""
    century = F.when(F.substring(c, 1, 2).try_cast("int") <= pivot, "20").otherwise("19")
    return F.when(c.rlike(r"^\d{6}$") & (c != "000000"), F.try_to_date(F.concat(century, c), "yyyyMMdd"))


def any_date(c: Column, formats: Sequence[str] = ("M/d/yyyy", "yyyy-MM-dd", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy")) -> Column:
    """The first of ``formats`` that the text has."""
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats])


def implied_decimal(c: Column, scale: int = 0) -> Column:
    """Digits with an implied decimal point; null if there is anything else."""
    digits = F.trim(c)
    return F.when(digits.rlike(r"^[+-]?\d+$"), (digits.cast("decimal(20,0)") / F.lit(10**scale)).cast("decimal(14,4)"))


def training_window_start(day: Column, years: int = 5) -> Column:
    return F.make_date(F.year(day) - years, F.lit(1), F.lit(1))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def nonzero(c: Column, *others: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(x, F.lit(0).cast("decimal(14,2)")) for x in (c, *others)])


def sum_or_null(*columns: Column) -> Column:
    """The sum of what is there; null if nothing is."""
    some = columns[0].isNotNull()
    total = F.coalesce(columns[0], F.lit(0))
    for c in columns[1:]:
        some = some | c.isNotNull()
        total = total + F.coalesce(c, F.lit(0))
    return F.when(some, total)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ring_sums(ring: Column) -> Column:
    """(twice the area, area-weighted x and y) of one ring of [x, y] points, by the shoelace rule."""
    rotated = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, rotated, lambda p, q: F.struct(p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        cross = e["x0"] * e["y1"] - e["x1"] * e["y0"]
        return F.struct((s["a"] + cross).alias("a"), (s["x"] + (e["x0"] + e["x1"]) * cross).alias("x"), (s["y"] + (e["y0"] + e["y1"]) * cross).alias("y"))

    return F.aggregate(edges, zero, add)


def centroid(rings: Column, digits: int = 7) -> Column:
    """(latitude, longitude) of exterior rings, weighted by area; the mean of the points where the area is zero."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(rings, zero, lambda s, r: _plus(s, ring_sums(r)))
    points = F.flatten(rings)
    mean = [F.aggregate(points, F.lit(0.0), total) / F.size(points) for total in (lambda s, p: s + p[0], lambda s, p: s + p[1])]
    flat = F.abs(total["a"]) < 1e-12
    x = F.when(flat, mean[0]).otherwise(total["x"] / (3 * total["a"]))
    y = F.when(flat, mean[1]).otherwise(total["y"] / (3 * total["a"]))
    return F.when(F.size(points) > 0, F.struct(F.round(y, digits).alias("latitude"), F.round(x, digits).alias("longitude")))


def _plus(s: Column, r: Column) -> Column:
    sign = F.signum(r["a"])  # rings may go either way round
    return F.struct((s["a"] + F.abs(r["a"])).alias("a"), (s["x"] + sign * r["x"]).alias("x"), (s["y"] + sign * r["y"]).alias("y"))
