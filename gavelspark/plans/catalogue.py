"""Queries of the catalogue's search, beside the same in SQL: several searches each, one row a sale and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import catalogue
from ..operators.catalogue import Asked, Viewed
from ..sources.adapters import SALES_CTE, TRIBUNALS_CTE, sales, tribunals
from .queries import FOLDED, HOUSE, NOW, RENT
from .registry import query

c = F.col

#: What sales of the catalogue have besides.
MORE = ["surface_m2 AS app_surface_m2", "CAST(sale_id % 3 AS INT) AS bathrooms_count", "CASE WHEN sale_id % 2 = 0 THEN 'TJ ' || city END AS tribunal"]
ROWS = f"WITH {SALES_CTE}, {TRIBUNALS_CTE}, s AS (SELECT sales.*, {', '.join(MORE)}, t.name AS tribunal_name FROM sales LEFT JOIN tribunals t ON t.code = tribunal_code)"


def listed(spark, d):
    return sales(spark, d).selectExpr("*", *MORE)


def courts(spark, d):
    return tribunals(spark, d).select("code", "name", F.lit(None).cast("string").alias("city"))


COURT = FOLDED.format("concat_ws(' ', tribunal, tribunal_code, tribunal_name)")
TEXTS = FOLDED.format("concat_ws(' ', title, city, department, postal_code, address, tribunal, tribunal_code, tribunal_name)")
#: Searches: what is asked, its condition and order in SQL.
SEARCHES = [
    (Asked(), "TRUE", "investment_score DESC NULLS LAST"),
    (Asked(departments=["01", "07", "19"], min_price=20_000, max_price=300_000, sort="price_asc", limit=5_000), "department IN ('01', '07', '19') AND starting_price_eur >= 20000 AND starting_price_eur <= 300000", "starting_price_eur NULLS LAST"),
    (Asked(city="fränce", sort="date_asc", limit=100, offset=7), "contains(lower(city), 'france')", "sale_date NULLS LAST"),
    (Asked(postal_code="03004", sort="date_desc", limit=1_000), "postal_code = '03004'", "sale_date DESC NULLS LAST"),
    (Asked(tribunal="judiciaire de CH", sort="price_desc", limit=300), f"contains({COURT}, 'judiciaire de ch')", "starting_price_eur DESC NULLS LAST"),
    (Asked(keywords=["République", "maison", "tj"], limit=200), f"contains({TEXTS}, 'republique') AND contains({TEXTS}, 'maison') AND contains({TEXTS}, 'tj')", "investment_score DESC NULLS LAST"),
    (Asked(property_types=["house", "land"], min_surface=30, max_surface=150, min_bedrooms=1, min_bathrooms=1, sort="surface_desc", limit=400), "property_type IN ('house', 'land') AND surface_m2 >= 30 AND surface_m2 <= 150 AND bedrooms_count >= 1 AND bathrooms_count >= 1", "surface_m2 DESC NULLS LAST"),
    (Asked(occupancy_status="vacant", min_score=40, statuses=["upcoming", "past"], limit=0), "occupancy_status = 'vacant' AND investment_score >= 40 AND status IN ('upcoming', 'past')", "investment_score DESC NULLS LAST"),
    (Asked(north=46.5, south=44.5, east=3.0, west=1.0, sort="other", limit=900), "latitude <= 46.5e0 AND latitude >= 44.5e0 AND longitude <= 3e0 AND longitude >= 1e0", "investment_score DESC NULLS LAST"),
]


def _page(i: int, asked: Asked, where: str, order: str) -> str:
    fits = f"s WHERE coalesce(status, 'unknown') IN ('upcoming', 'unknown') AND latitude IS NOT NULL AND longitude IS NOT NULL AND {where}"
    return f"SELECT * FROM (SELECT {i} AS search, sale_id, starting_price_eur, (SELECT count(*) FROM {fits}) AS total_count FROM {fits} ORDER BY {order}, sale_id LIMIT {min(max(asked.limit, 1), 1000)} OFFSET {asked.offset})"


@query("flt_search_sql", f"{ROWS} " + " UNION ALL ".join(_page(i, *x) for i, x in enumerate(SEARCHES)))
def search_sql(spark, d):
    rows, courts_ = listed(spark, d), courts(spark, d)
    pages = [catalogue.search(rows, courts_, asked).select(F.lit(i).alias("search"), "sale_id", "starting_price_eur", "total_count") for i, (asked, _, _) in enumerate(SEARCHES)]
    return reduce(lambda a, b: a.union(b), pages)


PLACE = FOLDED.format("concat_ws(' ', city, department, region, postal_code)")
KM = "2 * 6371e0 * asin(sqrt(pow(sin(radians(latitude - 45e0) / 2), 2) + cos(radians(45e0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 2e0) / 2), 2)))"
WORDS = FOLDED.format("concat_ws(' ', title, city, department, postal_code, address, description)")
#: Filters of a list view, and their condition in SQL.
VIEWS = [
    (Viewed(transaction="sold", min_price=20_000, max_price=300_000), f"(status IN ('sold', 'adjudicated', 'past') OR sale_date < DATE '{NOW}') AND coalesce(starting_price_eur, 0) >= 20000 AND starting_price_eur <= 300000"),
    (Viewed(transaction="for_rent"), "FALSE"),
    (Viewed(min_surface=40, max_surface=120, min_beds=2, min_baths=1), "surface_m2 >= 40 AND surface_m2 <= 120 AND coalesce(bedrooms_count, rooms_count, 0) >= 2 AND coalesce(bathrooms_count, 0) >= 1"),
    (Viewed(home_types=["HOUS", "land"], statuses=["Upcoming"], dpe_classes=["A", "B", "C"]), "(contains(property_type, 'hous') OR contains(property_type, 'land')) AND status = 'upcoming' AND dpe_class IN ('A', 'B', 'C')"),
    (Viewed(place="france 07", keywords="avenue MAISON"), f"contains({PLACE}, 'france') AND contains({PLACE}, '07') AND contains({WORDS}, 'avenue') AND contains({WORDS}, 'maison')"),
    (Viewed(max_price_m2=1_500, house_with_land=True), f"starting_price_eur / CASE WHEN surface_m2 > 0 THEN surface_m2 END <= 1500 AND {HOUSE.format('')}"),
    (Viewed(centre=(45.0, 2.0), radius_km=60.0, viewport=(44.0, 1.5, 45.5, 3.0), open_house=True), f"{KM} <= 60 AND latitude BETWEEN 44e0 AND 45.5e0 AND longitude BETWEEN 1.5e0 AND 3e0 AND sale_date IS NOT NULL"),
    (Viewed(min_yield=6.0, transaction="for_sale"), f"surface_m2 > 0 AND starting_price_eur > 0 AND surface_m2 * {RENT.format('department')} * 12 / (starting_price_eur * 1.1e0) * 100 >= 6"),
    (Viewed(), "TRUE"),
]


@query("flt_client", f"{ROWS} " + " UNION ALL ".join(f"SELECT {i} AS view, sale_id FROM s WHERE {where}" for i, (_, where) in enumerate(VIEWS)))
def client(spark, d):
    rows, today = listed(spark, d), F.lit(NOW).cast("date")
    return reduce(lambda a, b: a.union(b), [catalogue.view(rows, v, today).select(F.lit(i).alias("view"), "sale_id") for i, (v, _) in enumerate(VIEWS)])
