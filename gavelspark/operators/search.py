"""Catalogue search: predicates, projections, order, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import haversine_m
from ..functions.text import fold, search_norm

STATUSES = {"upcoming": ["upcoming"], "past": ["past", "adjudicated"], "all": ["upcoming", "past", "adjudicated", "unknown"]}

SORTS = {
    "date_asc": [("sale_date", "asc")],
    "date_desc": [("sale_date", "desc")],
    "price_asc": [("starting_price_eur", "asc")],
    "price_desc": [("starting_price_eur", "desc")],
    "score_desc": [("investment_score", "desc")],
    "surface_desc": [("surface_m2", "desc")],
}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_bbox(south: float, west: float, north: float, east: float) -> Column:
    """A range on both coordinates, which reaches the Parquet scan; null coordinates are outside."""
    return F.col("latitude").between(south, north) & F.col("longitude").between(west, east)


def bbox_around(lat: float, lng: float, radius_m: float) -> tuple[float, float, float, float]:
    """Degrees at 111 km each, the longitude's shrunk by the cosine of the latitude."""
    import math

    dy = radius_m / 111_000
    dx = dy / max(math.cos(math.radians(lat)), 0.01)
    return lat - dy, lng - dx, lat + dy, lng + dx


def ordered(sort: str, tie: str = "sale_id") -> list[Column]:
    return [*(F.col(n).asc_nulls_last() if way == "asc" else F.col(n).desc_nulls_last() for n, way in SORTS[sort]), F.col(tie).asc()]


def page(sales: DataFrame, sort: str = "date_asc", limit: int = 50, offset: int = 0, most: int = 1000) -> DataFrame:
    return sales.orderBy(*ordered(sort)).offset(max(0, offset)).limit(max(1, min(limit, most)))


def page_with_total(sales: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """The page beside the number of all rows. The count is an aggregate of its own (one row), so no window gathers all rows in one task."""
    total = sales.agg(F.count("*").alias("total_count"))
    return page(sales, sort, limit, offset).join(F.broadcast(total), F.lit(True))


def house_with_land(at: str = "") -> Column:
    """A house or building, by type or title, with a garden or land."""
    kind = F.lower(F.concat_ws(" ", F.col(f"{at}property_type"), F.col(f"{at}title")))
    return kind.rlike("house|maison|villa|immeuble|building") & (F.coalesce(F.col(f"{at}has_garden"), F.lit(False)) | (F.coalesce(F.col(f"{at}land_surface_m2"), F.lit(0)) > 0))


def quality_issues(sales: DataFrame) -> DataFrame:
    """Sales with a quality flag, or without surface, rooms, bedrooms or place."""
    return sales.where((F.coalesce(F.col("quality_flags"), F.lit("")) != "") | any_of([F.col(x).isNull() for x in ("surface_m2", "rooms_count", "bedrooms_count", "latitude", "longitude")]))


def candidates(sales: DataFrame) -> DataFrame:
    """Upcoming and scored, best first."""
    return sales.where((F.col("status") == "upcoming") & F.col("investment_score").isNotNull()).orderBy(F.desc_nulls_last("investment_score"), F.asc_nulls_last("sale_date"), "sale_id")


def first_failure(max_price: int, department: str, kind: str) -> Column:
    """Why a sale does not fit, the first reason only; null if it does."""
    c = F.col
    return F.coalesce(
        F.when(~c("department").eqNullSafe(F.lit(department)), "department"),
        F.when(~c("property_type").eqNullSafe(F.lit(kind)), "type"),
        F.when(c("starting_price_eur").isNull() | (c("starting_price_eur") > max_price), "price"),
    )


def raw_validate(raw: DataFrame) -> DataFrame:
    """Rows with what is wrong with them, comma-joined; empty if nothing is. Split on errors = '' for valid rows and quarantine."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    checks = [F.when(blank(c("source_name")), "source_name"), F.when(~F.coalesce(c("source_url").rlike("^https://"), F.lit(False)), "source_url"), F.when(blank(c("title")) & blank(c("address")), "content")]
    return raw.withColumn("errors", F.array_join(F.array_compact(F.array(*checks)), ","))


def source_links(urls: Column) -> Column:
    """label=url of each link, in order, repeated ones once."""
    return F.transform(F.array_distinct(urls), lambda u: F.concat(F.regexp_extract(u, r"^https://([^./]+)", 1), F.lit("="), u))


def valid_training_price(kind: Column, price_m2: Column, surface: Column) -> Column:
    """Price a square metre within the limits of the type; dwellings of 9 square metres at least."""
    return F.when(kind == "land", price_m2.between(1, 100_000)).otherwise(price_m2.between(300, 50_000) & (surface >= 9))


def dpe_matches(dpe: Column, accepted: list[str]) -> Column:
    """No accepted class accepts all."""
    return F.coalesce(dpe.isin(accepted), F.lit(False)) if accepted else F.lit(True)


def accent_tolerant(x: Column, pattern: str) -> Column:
    """Contains the pattern, whatever the accents and case of either side."""
    return F.coalesce(fold(x).contains(fold(F.lit(pattern))), F.lit(False))


def intersect_scopes(a: list[str], b: list[str]) -> list[str]:
    """Departments of both lists, in order; one that no sale has if there is none, so that nothing is found rather than all."""
    return [x for x in a if x in b] or ["none"]


def all_terms(hay: Column, asked: str) -> Column:
    """Every word that is asked for is in the text, whatever accents and case."""
    return all_of([accent_tolerant(hay, w) for w in asked.split()])


def in_zone(department: str | None = None, city: str | None = None, postal_prefix: str | None = None, centre: tuple[float, float] | None = None, radius_km: float | None = None) -> Column:
    """What a watched zone states of department, city, postal code and distance holds; a radius without a centre holds for nothing."""
    c = F.col
    same = lambda x, v: F.coalesce(fold(F.trim(c(x))) == v.strip().lower(), F.lit(False))
    near = F.lit(False) if centre is None else F.coalesce(haversine_m(F.lit(centre[0]), F.lit(centre[1]), c("latitude"), c("longitude")) <= (radius_km or 0) * 1000, F.lit(False))
    return all_of([*([same("department", department)] if department else []), *([same("city", city)] if city else []), *([F.coalesce(c("postal_code").startswith(postal_prefix), F.lit(False))] if postal_prefix else []), *([near] if radius_km is not None else [])])


def resolve_places(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (id, q) with kind: postal for five digits, else the level of the known place (name, level; the first by level) that q names, with or without a leading "ville de", else text."""
    c = F.col
    name = F.regexp_replace(search_norm(c("q")), r"^(ville|region|departement) (de|du|des|d) ", "")
    places = known.groupBy("name").agg(F.min("level").alias("level"))
    found = asked.withColumn("name", name).join(places, "name", "left")
    return found.withColumn("kind", F.when(c("q").rlike(r"^\d{5}$"), "postal").otherwise(F.coalesce("level", F.lit("text"))))
