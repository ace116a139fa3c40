"""Search of the catalogue: what a server is asked, and what a list view filters besides. What is not asked adds nothing to the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import gross_yield_pct, haversine_m, rent_m2
from ..functions.text import fold
from .search import all_of, any_of, all_terms, house_with_land, in_bbox

c = F.col

#: States that the public catalogue shows; the page's size unless asked, and at most.
PUBLIC_STATES, PAGE, LARGEST_PAGE = ["upcoming", "unknown"], 24, 1_000
#: Orders by name; any other one is by score.
ORDERS = {"date_asc": ("sale_date", False), "date_desc": ("sale_date", True), "price_asc": ("starting_price_eur", False), "price_desc": ("starting_price_eur", True), "surface_desc": ("app_surface_m2", True)}
BY_SCORE = ("investment_score", True)
#: States that count as sold.
SOLD = ["sold", "adjudicated", "past"]


@dataclass(frozen=True)
class Asked:
    """What a search asks for; None asks for nothing. Texts are compared without accents and case."""

    departments: list[str] | None = None
    city: str | None = None
    postal_code: str | None = None
    tribunal: str | None = None
    keywords: list[str] | None = None
    property_types: list[str] | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_surface: float | None = None
    max_surface: float | None = None
    min_bedrooms: int | None = None
    min_bathrooms: int | None = None
    occupancy_status: str | None = None
    min_score: float | None = None
    statuses: list[str] | None = None
    north: float | None = None
    south: float | None = None
    east: float | None = None
    west: float | None = None
    sort: str = "score_desc"
    limit: int | None = PAGE
    offset: int | None = 0


#: The court's texts, and all that keywords are looked for in; tribunal_name and tribunal_city are the tribunal's.
COURT = ["tribunal", "tribunal_code", "tribunal_name", "tribunal_city"]
ALL_TEXTS = ["title", "city", "department", "postal_code", "address", *COURT]


def _plain(x: str) -> Column:
    return fold(F.lit(x))


def conditions(a: Asked) -> list[Column]:
    """Of what is asked, each a condition; comparisons of single columns reach the scan."""
    holds = lambda texts, x: fold(F.concat_ws(" ", *texts)).contains(_plain(x))
    either = lambda x, build: [] if x is None else [build(x)]
    return [
        F.coalesce("status", F.lit("unknown")).isin(PUBLIC_STATES) & c("latitude").isNotNull() & c("longitude").isNotNull(),
        *either(a.departments, lambda x: fold(F.coalesce("department", F.lit(""))).isin([_plain(d) for d in x])),
        *either(a.city, lambda x: fold(F.coalesce("city", F.lit(""))).contains(_plain(x))),
        *either(a.postal_code, lambda x: c("postal_code") == x),
        *either(a.tribunal, lambda x: holds(COURT, x)),
        *(holds(ALL_TEXTS, k) for k in a.keywords or []),
        *either(a.property_types, lambda x: c("property_type").isin(x)),
        *either(a.min_price, lambda x: c("starting_price_eur") >= x),
        *either(a.max_price, lambda x: c("starting_price_eur") <= x),
        *either(a.min_surface, lambda x: c("app_surface_m2") >= x),
        *either(a.max_surface, lambda x: c("app_surface_m2") <= x),
        *either(a.min_bedrooms, lambda x: c("bedrooms_count") >= x),
        *either(a.min_bathrooms, lambda x: c("bathrooms_count") >= x),
        *either(a.occupancy_status, lambda x: c("occupancy_status") == x),
        *either(a.min_score, lambda x: c("investment_score") >= x),
        *either(a.statuses, lambda x: c("status").isin(x)),
        *either(a.north, lambda x: c("latitude") <= x),
        *either(a.south, lambda x: c("latitude") >= x),
        *either(a.east, lambda x: c("longitude") <= x),
        *either(a.west, lambda x: c("longitude") >= x),
    ]


def found(sales: DataFrame, tribunals: DataFrame, asked: Asked) -> DataFrame:
    """The sales that fit, all of them. tribunals: code, name, city; joined only if texts of the court are asked for."""
    if asked.tribunal is not None or asked.keywords:
        court = tribunals.select(c("code").alias("tribunal_code"), c("name").alias("tribunal_name"), c("city").alias("tribunal_city"))
        sales = sales.join(court, "tribunal_code", "left")
    return sales.where(all_of(conditions(asked)))


def search(sales: DataFrame, tribunals: DataFrame, asked: Asked) -> DataFrame:
    """The page that is asked for, beside total_count, the number of all that fit: an aggregate of its own, so that no window gathers all rows. Rows without the value they are ordered by come last, ties by sale_id."""
    rows = found(sales, tribunals, asked)
    by, down = ORDERS.get(asked.sort, BY_SCORE)
    total = rows.agg(F.count("*")).scalar()
    limit = min(max(PAGE if asked.limit is None else asked.limit, 1), LARGEST_PAGE)
    order = [c(by).desc_nulls_last() if down else c(by).asc_nulls_last(), c("sale_id").asc()]
    return rows.orderBy(*order).offset(max(asked.offset or 0, 0)).limit(limit).select("*", total.alias("total_count"))


@dataclass(frozen=True)
class Viewed:
    """What a list view filters; None or empty filters nothing."""

    transaction: str | None = None  # for_sale, sold, for_rent
    min_price: float | None = None
    max_price: float | None = None
    min_surface: float | None = None
    max_surface: float | None = None
    min_beds: int | None = None
    min_baths: int | None = None
    home_types: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    dpe_classes: list[str] = field(default_factory=list)
    place: str | None = None
    keywords: str | None = None
    max_price_m2: float | None = None
    min_yield: float | None = None
    house_with_land: bool = False
    centre: tuple[float, float] | None = None
    radius_km: float | None = None
    viewport: tuple[float, float, float, float] | None = None  # south, west, north, east
    open_house: bool = False
    sort: str | None = None  # beds_desc, distance


PLACE_TEXTS, SALE_TEXTS = ["city", "department", "region", "postal_code"], ["title", "city", "department", "postal_code", "address", "description"]


def view(sales: DataFrame, v: Viewed, today: Column) -> DataFrame:
    """The sales that a list view shows. Its own rules of null: a missing price is 0 against a least one and fails a greatest one, missing beds (else rooms) and baths are 0, all else that is missing fails what is asked of it. Nothing is for rent."""
    surface, price = c("surface_m2"), c("starting_price_eur")
    none = F.lit(False)
    m2 = F.when(surface > 0, price / surface)
    sold = F.lower("status").isin(SOLD) | (F.to_date("sale_date") < today)
    far = haversine_m(F.lit(v.centre[0]), F.lit(v.centre[1]), c("latitude"), c("longitude")) / 1000 if v.centre else None
    either = lambda x, build: [F.coalesce(build(x), none)] if x is not None and x != [] and x is not False else []
    tests = [
        *([none] if v.transaction == "for_rent" else [F.coalesce(sold, none)] if v.transaction == "sold" else []),
        *either(v.min_price, lambda x: F.coalesce(price, F.lit(0)) >= x),
        *either(v.max_price, lambda x: price <= x),
        *either(v.min_surface, lambda x: surface >= x),
        *either(v.max_surface, lambda x: surface <= x),
        *either(v.min_beds, lambda x: F.coalesce("bedrooms_count", "rooms_count", F.lit(0)) >= x),
        *either(v.min_baths, lambda x: F.coalesce("bathrooms_count", F.lit(0)) >= x),
        *either(v.home_types, lambda x: any_of([F.lower("property_type").contains(t.lower()) for t in x])),
        *either(v.statuses, lambda x: F.lower("status").isin([s.lower() for s in x])),
        *either(v.dpe_classes, lambda x: c("dpe_class").isin(x)),
        *either(v.place, lambda x: all_terms(F.concat_ws(" ", *PLACE_TEXTS), x)),
        *either(v.keywords, lambda x: all_terms(F.concat_ws(" ", *SALE_TEXTS), x)),
        *either(v.max_price_m2, lambda x: m2 <= x),
        *either(v.min_yield, lambda x: gross_yield_pct(price, surface, rent_m2(c("department"))) >= x),
        *either(v.house_with_land, lambda _: house_with_land()),
        *([] if v.radius_km is None or far is None else [F.coalesce(far <= v.radius_km, none)]),
        *either(v.viewport, lambda x: in_bbox(*x)),
        *either(v.open_house, lambda _: c("sale_date").isNotNull()),
    ]
    out = sales.where(all_of(tests))
    if v.sort == "beds_desc":
        return out.orderBy(F.coalesce("bedrooms_count", "rooms_count", F.lit(0)).desc(), "sale_id")
    if v.sort == "distance" and far is not None:
        return out.orderBy(far.asc_nulls_last(), "sale_id")
    return out
