"""Investment score of a sale: nine components, their running total, and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up

c = F.col

#: Points by occupancy and by type, with the points for others; and price bands a square metre by department (low, fair, high).
OCCUPANCY = {"vacant": 12, "unknown": -3, "rented": 3, "occupied": -10, "owner_occupied": -8, "squatted": -18}
TYPES = {"apartment": 5, "house": 4, "building": 6, "mixed": 1, "commercial": -2, "land": -3, "parking": 1}
BANDS = {"33": (1400, 2800, 4800), "64": (1500, 3000, 5200)}
OTHER_BAND = (1000, 2200, 3600)
COMPONENTS = ["occupation", "condition", "type", "location", "surface", "price_m2", "amenities", "risks", "quality"]


def _by(x: Column, points: dict[str, int], other: int) -> Column:
    out = F
    for k, v in points.items():
        out = out.when(x == k, v)
    return out.otherwise(other)


def components(prime: list[str], secondary: list[str]) -> dict[str, Column]:
    """Points of each component, in order. Of a sale's columns: occupancy_status, works_severity, description, property_type, city, tribunal_code, surface_m2, quality_flags, starting_price_eur, department, has_garden, risk_severity, documents_count, rooms_count, bedrooms_count."""
    flag = lambda name: F.coalesce(F.contains(c("quality_flags"), F.lit(name)), F.lit(False))
    surface, price = c("surface_m2"), c("starting_price_eur")
    m2 = price / surface
    band = lambda i: F.coalesce(*(F.when(c("department") == k, v[i]) for k, v in BANDS.items()), F.lit(OTHER_BAND[i]))
    large = ~F.coalesce(c("property_type").isin("building", "commercial", "land", "mixed"), F.lit(False))
    off = lambda cond, points: F.when(cond, points).otherwise(0)
    quality = (
        off(flag("ambiguous_surface"), 5) + off(flag("low_confidence_extraction"), 4) + off(flag("missing_gps"), 3) + off(F.coalesce(c("documents_count"), F.lit(0)) == 0, 6) + off(c("rooms_count").isNull(), 2)
        + off(c("bedrooms_count").isNull() & c("property_type").isin("apartment", "house"), 2) + off(F.coalesce(c("occupancy_status"), F.lit("unknown")).isin("unknown", ""), 3)
    )
    return {
        "occupation": _by(c("occupancy_status"), OCCUPANCY, -3),
        "condition": F.when(c("works_severity") >= 5, -14).when(c("works_severity") > 0, -6).otherwise(0),
        "type": _by(c("property_type"), TYPES, -2),
        "location": F.when(c("city").isin(prime), 8).when(c("city").isin(secondary), 4).when(c("tribunal_code").isNotNull(), 3).otherwise(-2),
        "surface": F.when(surface.isNull(), F.when(flag("ambiguous_surface"), -8).otherwise(-6)).when(surface.between(25, 160), 6).when(surface < 15, -5).when((surface > 300) & large, -2).otherwise(1),
        "price_m2": F.when(F.coalesce(surface, F.lit(0)) == 0, -4).when(F.coalesce(price, F.lit(0)) == 0, -2).when(m2 < band(0), 12).when(m2 < band(1), 6).when(m2 > band(2), -8).otherwise(0),
        "amenities": F.least(F.lit(7), off(F.coalesce(c("has_garden"), F.lit(False)), 3)),
        "risks": -F.least(F.lit(18), F.coalesce(c("risk_severity"), F.lit(0))),
        "quality": -F.least(F.lit(18), quality),
    }


def waterfall(sales: DataFrame, prime: list[str], secondary: list[str], base: int = 50) -> DataFrame:
    """sale_id, factor_order, factor, score_before, delta, score_after: nine rows a sale. The running total is a sum of columns, not a window."""
    rows, before = [], F.lit(base)
    for i, (name, points) in enumerate(components(prime, secondary).items()):
        p = c(f"_p{i}")
        rows.append((i, name, points.cast("bigint").alias(f"_p{i}"), before, p))
        before = before + p
    factors = F.array(*(F.struct(F.lit(i).alias("factor_order"), F.lit(name).alias("factor"), b.cast("bigint").alias("score_before"), p.alias("delta"), (b + p).cast("bigint").alias("score_after")) for i, name, _, b, p in rows))
    return sales.select("sale_id", *(p for _, _, p, _, _ in rows)).select("sale_id", F.inline(factors))


def score(sales: DataFrame, prime: list[str], secondary: list[str], base: int = 50) -> DataFrame:
    """sale_id, the nine components and the score, 0 to 100."""
    parts = components(prime, secondary)
    scored = sales.select("sale_id", *(e.cast("bigint").alias(n) for n, e in parts.items()))
    total = sum((c(n) for n in parts), F.lit(base))
    return scored.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("bigint"))


def confidence(contradictions: Column | None = None) -> Column:
    """Mean confidence of the components, less for what is missing; 0 to 1, two decimals, half up."""
    flag = lambda name: F.coalesce(F.contains(c("quality_flags"), F.lit(name)), F.lit(False))
    known = c("occupancy_status").isNotNull()
    documents = F.coalesce(c("documents_count"), F.lit(0)) > 0
    parts = [F.when(c("occupancy_status") == "unknown", 55).when(known, 85).otherwise(45), F.when(F.coalesce(c("property_type"), F.lit("unknown")).isin("unknown", "other"), 45).otherwise(82), F.when(c("tribunal_code").isNotNull(), 55).otherwise(35), F.when(documents, 50).otherwise(25), F.when(F.coalesce(c("has_garden"), F.lit(False)), 75).otherwise(55)]
    average = sum(parts, F.lit(0)) / len(parts)
    penalty = F.when(flag("ambiguous_surface"), 12).otherwise(0) + F.when(flag("low_confidence_extraction"), 10).otherwise(0) + F.when(documents, 0).otherwise(14) + F.when(c("surface_m2").isNull(), 12).otherwise(0) + F.when(known, 0).otherwise(6)
    if contradictions is not None:
        penalty = penalty + F.least(F.lit(18), contradictions * 6)
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), average - penalty))) / 100
