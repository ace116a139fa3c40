"""Nearest points of subjects, by rings of cells that widen only for subjects that still lack some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hexagons import cell_of, disk
from ..functions.numbers import haversine_m
from ..functions.text import fold
from .listings import strong_address

c = F.col


def nearest(subjects: DataFrame, points: DataFrame, key: str, k: int, most_m: float, hold: Callable[[DataFrame, str], DataFrame], first_m: float = 250.0) -> DataFrame:
    """key, point_id, metres, place (from 1): the k points nearest to each subject (key, latitude, longitude), within most_m. points: point_id, latitude, longitude. Ties go to the smaller point_id.

    A round's cells have an edge that is sure to hold, in a cell and those around it, all points within `reach`; a subject with k points within reach is done, others go on with twice the reach. So pairs grow with the subjects, not with the area. Places are paired, not rows: subjects at one place have the same points, and of the points at one place the k with the smallest ids count. Subjects and points without a place take no part; a subject's rows are one.
    """
    placed = subjects.where("latitude is not null and longitude is not null").select(key, "latitude", "longitude").dropDuplicates([key])
    found = _nearest_of_places(placed.select("latitude", "longitude").distinct(), points, k, most_m, hold, first_m)
    return placed.join(found, ["latitude", "longitude"]).select(key, "point_id", "metres", "place")


def _nearest_of_places(places: DataFrame, points: DataFrame, k: int, most_m: float, hold: Callable[[DataFrame, str], DataFrame], first_m: float) -> DataFrame:
    key = ["latitude", "longitude"]
    left = hold(places, "subjects")
    there = points.where("latitude is not null and longitude is not null").select("point_id", c("latitude").alias("p_latitude"), c("longitude").alias("p_longitude"))
    there = there.withColumn("_n", F.row_number().over(Window.partitionBy("p_latitude", "p_longitude").orderBy("point_id"))).where(c("_n") <= k).drop("_n")
    there = hold(there, "points")
    reach, out = min(first_m, most_m), None
    while True:
        size = reach * 1.05  # the plane is true to a few per cent
        own = left.withColumn("cell", F.explode(disk(cell_of(c("latitude"), c("longitude"), size), 1)))
        pairs = own.join(there.withColumn("cell", cell_of(c("p_latitude"), c("p_longitude"), size)), "cell")
        metres = pairs.select(*key, "point_id", haversine_m(c("latitude"), c("longitude"), c("p_latitude"), c("p_longitude")).alias("metres")).where(c("metres") <= reach)
        w = Window.partitionBy(*key).orderBy("metres", "point_id")
        best = hold(metres.withColumn("place", F.row_number().over(w)).where(c("place") <= k), "nearest")
        if reach >= most_m:
            return best if out is None else out.union(best)
        done = best.where(c("place") == k).select(*key)
        found = best.join(done, key, "left_semi")
        out = found if out is None else out.union(found)
        left = hold(left.join(done, key, "left_anti"), "subjects")
        if left.isEmpty():
            return out
        reach = min(most_m, reach * 2)


#: Confidence of a diagnostic that is near a sale, by distance and by what agrees; the most of one at another address.
NEAR, LEAST, MOST, OTHER_ADDRESS = 0.72, 0.35, 0.95, 0.69


def energy_by_point(sales: DataFrame, diagnostics: DataFrame, k: int, most_m: float, hold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """sale_id, diagnostic_id, place, confidence: the k diagnostics of a sale's department nearest to it, within most_m, and how sure each is the sale's own; at another address it is OTHER_ADDRESS at most."""
    keyed = diagnostics.select(c("diagnostic_id").alias("point_id"), "latitude", "longitude")
    near = nearest(sales.select("sale_id", "latitude", "longitude"), keyed, "sale_id", k, most_m, hold)
    own = sales.select("sale_id", "department", "postal_code", "city", "address")
    other = diagnostics.select(c("diagnostic_id").alias("point_id"), *(c(x).alias(f"d_{x}") for x in ("department", "postal_code", "city", "address", "address_score")))
    both = near.join(own, "sale_id").join(other, "point_id")
    add = lambda test, points: F.when(test, points).otherwise(0.0)
    sure = F.lit(NEAR) + add(c("department") == c("d_department"), 0.05) + add(c("postal_code") == c("d_postal_code"), 0.08) + add(fold(c("city")) == fold(c("d_city")), 0.05)
    sure = sure + F.coalesce(F.least(F.lit(0.08), F.greatest(F.lit(0.0), c("d_address_score") - 0.55) / 5), F.lit(0.0))
    sure = sure + F.when(c("metres") <= 35, 0.12).when(c("metres") <= 120, 0.06).otherwise(-0.12)
    same = strong_address(c("city"), c("address"), c("d_city"), c("d_address"))
    sure = F.when(same, sure + 0.08).otherwise(F.least(sure, F.lit(OTHER_ADDRESS)))
    return both.select("sale_id", c("point_id").alias("diagnostic_id"), "place", F.round(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), sure)), 2).alias("confidence"))
