"""Alerts against sales: the first condition that fails, reasons for a match, and all matches without a product of both tables.

Each alert goes one way, by the narrowest thing that it states: its zone's or its own department, city, a budget, a least surface, or none of these. Sales are dealt along all ways, narrow, so that both sides meet in one equi-join, which Spark splits where a key is hot. A budget meets the buckets of prices below it, so that nearly every pair is within it; what states nothing fits everywhere by its nature, and meets sales in SALTS parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import gross_yield_pct, haversine_m, rent_m2
from ..functions.text import fold
from .search import house_with_land

c = F.col

#: What an alert may state (dpe_classes: letters), and its zone; what of sales it looks at.
ALERT = {"alert_id": "bigint", "city": "string", "department": "string", "property_type": "string", "max_price": "double", "min_surface": "double", "occupancy_status": "string", "min_score": "double", "max_price_m2": "double", "min_yield": "double", "dpe_classes": "string", "house_with_land": "boolean", "min_discount": "double"}
ZONE = {"zone_id": "bigint", "zone_active": "boolean", "zone_department": "string", "zone_city": "string", "zone_postal_prefix": "string", "zone_latitude": "double", "zone_longitude": "double", "zone_radius_km": "double"}
SALE = {"sale_id": "bigint", "department": "string", "city": "string", "postal_code": "string", "property_type": "string", "title": "string", "starting_price_eur": "double", "surface_m2": "double", "land_surface_m2": "double", "has_garden": "boolean", "occupancy_status": "string", "investment_score": "double", "dpe_class": "string", "latitude": "double", "longitude": "double", "market_discount_pct": "double"}
SALTS = 64


def _all(df: DataFrame, kinds: dict[str, str]) -> list[Column]:
    return [(c(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]


def _plain(x: Column) -> Column:
    return fold(F.trim(F.coalesce(x, F.lit(""))))


def _m2(s: str) -> Column:
    return F.when((c(f"{s}surface_m2") > 0) & (c(f"{s}starting_price_eur") > 0), c(f"{s}starting_price_eur") / c(f"{s}surface_m2"))


def _yield(s: str) -> Column:
    return gross_yield_pct(c(f"{s}starting_price_eur"), c(f"{s}surface_m2"), rent_m2(c(f"{s}department")))


def outside_zone(a: str, s: str) -> Column:
    """Whether an alert has a zone that a sale is not in. A zone that is not active, or has a radius and no centre, holds nothing."""
    z = lambda n: c(f"{a}zone_{n}")
    km = haversine_m(z("latitude"), z("longitude"), c(f"{s}latitude"), c(f"{s}longitude")) / 1000
    out = ~F.coalesce(z("active"), F.lit(False))
    out = out | (z("department").isNotNull() & (_plain(c(f"{s}department")) != _plain(z("department"))))
    out = out | (z("city").isNotNull() & (_plain(c(f"{s}city")) != _plain(z("city"))))
    out = out | (z("postal_prefix").isNotNull() & ~F.coalesce(c(f"{s}postal_code").startswith(z("postal_prefix")), F.lit(False)))
    return z("id").isNotNull() & (out | (z("radius_km").isNotNull() & ~F.coalesce(km <= z("radius_km"), F.lit(False))))


def failure(a: str = "a.", s: str = "s.") -> Column:
    """The first condition of an alert that a sale fails, in the order in which they are tried; null if it passes all. A condition that the alert does not state is passed."""
    said = lambda n: c(f"{a}{n}").isNotNull()
    over = lambda x, n: F.coalesce(x > c(f"{a}{n}"), F.lit(True))
    below = lambda x, n: F.coalesce(x < c(f"{a}{n}"), F.lit(True))
    of = lambda n: c(f"{s}{n}")
    conditions = [
        ("zone", outside_zone(a, s)),
        ("city", said("city") & (_plain(of("city")) != _plain(c(f"{a}city")))),
        ("department", said("department") & ~F.coalesce(of("department") == c(f"{a}department"), F.lit(False))),
        ("type", said("property_type") & ~_plain(of("property_type")).contains(_plain(c(f"{a}property_type")))),
        ("budget", said("max_price") & over(of("starting_price_eur"), "max_price")),
        ("surface", said("min_surface") & below(of("surface_m2"), "min_surface")),
        ("occupancy", said("occupancy_status") & (_plain(of("occupancy_status")) != _plain(c(f"{a}occupancy_status")))),
        ("score", said("min_score") & below(of("investment_score"), "min_score")),
        ("price_m2", said("max_price_m2") & over(_m2(s), "max_price_m2")),
        ("yield", said("min_yield") & below(_yield(s), "min_yield")),
        ("dpe", (F.coalesce(c(f"{a}dpe_classes"), F.lit("")) != "") & ~F.coalesce(F.contains(c(f"{a}dpe_classes"), of("dpe_class")), F.lit(False))),
        ("house_with_land", F.coalesce(c(f"{a}house_with_land"), F.lit(False)) & ~house_with_land(s)),
        ("discount", said("min_discount") & below(of("market_discount_pct"), "min_discount")),
    ]
    return F.coalesce(*(F.when(failed, name) for name, failed in conditions))


def reasons(a: str = "a.", s: str = "s.") -> Column:
    """Why a sale that fits does: what its alert states beyond place, type and budget."""
    said = lambda n: c(f"{a}{n}").isNotNull()
    told = [
        (said("max_price_m2") & _m2(s).isNotNull(), F.lit("prix au m²")),
        (said("min_yield") & _yield(s).isNotNull(), F.lit("rendement")),
        ((F.coalesce(c(f"{a}dpe_classes"), F.lit("")) != "") & c(f"{s}dpe_class").isNotNull(), F.concat(F.lit("DPE "), c(f"{s}dpe_class"))),
        (F.coalesce(c(f"{a}house_with_land"), F.lit(False)), F.lit("terrain")),
        (said("min_discount"), F.lit("décote")),
        (said("zone_id"), F.lit("zone surveillée")),
    ]
    return F.array_compact(F.array(*(F.when(test, text) for test, text in told)))


def _bucket(x: Column) -> Column:
    """Which power of two a value of 1 or more reaches; 0 below."""
    return F.floor(F.log2(F.greatest(x, F.lit(1.0)))).cast("int")


def _way(name: str, key: Column) -> Column:
    return F.struct(F.lit(name).alias("way"), key.cast("string").alias("key"))


def _alert_ways() -> Column:
    department = F.coalesce(F.nullif(_plain(c("zone_department")), F.lit("")), F.nullif(_plain(c("department")), F.lit("")))
    city = F.coalesce(F.nullif(_plain(c("zone_city")), F.lit("")), F.nullif(_plain(c("city")), F.lit("")))
    each = lambda name, keys: F.transform(keys, lambda k: _way(name, k))
    budget = F.sequence(F.lit(0), _bucket(c("max_price")))
    surface = F.sequence(F.least(_bucket(c("min_surface")), F.lit(40)), F.lit(40))
    return (
        F.when(city.isNotNull(), F.array(_way("city", city)))
        .when(department.isNotNull(), F.array(_way("department", department)))
        .when(c("max_price").isNotNull(), each("budget", budget))
        .when(c("min_surface").isNotNull(), each("surface", surface))
        .otherwise(each("all", F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )


def _sale_ways() -> Column:
    ways = [
        _way("city", _plain(c("city"))),
        _way("department", _plain(c("department"))),
        F.when(c("starting_price_eur").isNotNull(), _way("budget", _bucket(c("starting_price_eur")))),
        F.when(c("surface_m2").isNotNull(), _way("surface", F.least(_bucket(c("surface_m2")), F.lit(40)))),
        _way("all", F.pmod(F.xxhash64("sale_id"), F.lit(SALTS))),
    ]
    return F.array_compact(F.array(*ways))


def matches(alerts: DataFrame, sales: DataFrame) -> DataFrame:
    """alert_id, sale_id and reasons of all that fit. alerts: ALERT, and ZONE where it has one; sales: SALE. What is not given is null: not stated, or not known."""
    a = alerts.select(*_all(alerts, ALERT | ZONE)).withColumn("w", F.explode(_alert_ways())).select("*", "w.way", "w.key").drop("w")
    s = sales.select(*_all(sales, SALE)).withColumn("w", F.explode(_sale_ways())).select("*", "w.way", "w.key").drop("w")
    met = s.alias("s").join(a.alias("a"), (c("s.way") == c("a.way")) & (c("s.key") == c("a.key")))
    return met.where(failure().isNull()).select("a.alert_id", "s.sale_id", reasons().alias("reasons"))
