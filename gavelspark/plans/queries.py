"""One named query an operator, over the whole test tables in the shapes of the domain, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import aggregates as agg
from ..operators import alerts as alerting
from ..operators import joins, search
from ..sources.adapters import MUTATIONS_CTE, SALES_CTE, TRIBUNALS_CTE, mutations, read, sales, tribunals
from .registry import query

c = F.col
S = f"WITH {SALES_CTE} "
FOLDED = "lower(strip_accents({}))"
#: What counts as today in these tables.
NOW = "1998-07-01"


def half_up(e, digits=1):
    """The SQL for rounding with halves up."""
    return f"floor(({e}) * {10 ** digits}e0 + 5e-1) / {10 ** digits}e0"


def quantile_sql(x, p):
    return half_up(f"quantile_cont(CASE WHEN {x} > 0 THEN {x} END, {p})")


def mean_sql(x):
    return half_up(f"avg(CASE WHEN {x} > 0 THEN {x} END)")


def items(spark, d):
    return agg.market_items(sales(spark, d), NOW)


ITEMS = S + f", items AS (SELECT *, {half_up('coalesce(CASE WHEN adjudication_price_eur > 0 THEN adjudication_price_eur END, CASE WHEN starting_price_eur > 0 THEN starting_price_eur END) / CASE WHEN surface_m2 > 0 THEN surface_m2 END')} AS price_m2, CASE WHEN sale_date > created_at THEN date_diff('day', CAST(created_at AS DATE), sale_date) END AS days_to_sale, coalesce(sale_date > DATE '{NOW}', FALSE) AS is_upcoming FROM sales) "


@query("agg_source_coverage", S + "SELECT source_name, department, count(*) AS sales, count(*) FILTER (status = 'upcoming') AS upcoming, count(latitude) AS geocoded, count(*) FILTER (starting_price_eur IS NULL) AS without_price FROM sales GROUP BY ALL")
def source_coverage(spark, d):
    return agg.source_coverage(sales(spark, d))


NULLABLE = ["starting_price_eur", "surface_m2", "tribunal_code", "title", "latitude", "rooms_count", "property_type", "dpe_class"]


@query("agg_quality_null_counts", S + f"SELECT count(*) AS rows, {', '.join(f'count(*) - count({x}) AS missing_{x}' for x in NULLABLE)} FROM sales")
def quality_null_counts(spark, d):
    return agg.null_counts(sales(spark, d), NULLABLE)


@query("agg_duplicates_having", S + "SELECT source_url, count(*) AS n FROM sales GROUP BY source_url HAVING count(*) > 1")
def duplicates_having(spark, d):
    return agg.duplicates(sales(spark, d), "source_url")


COUNTED = ["status", "source_name", "department", "property_type"]


@query("agg_value_counts", S + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS value, count(*) AS n FROM sales GROUP BY {x}" for x in COUNTED))
def value_counts(spark, d):
    return agg.value_counts(sales(spark, d), COUNTED)


PCT = "round(avg(CASE WHEN {} THEN 1e0 ELSE 0e0 END) * 100, 1) AS {}"
CHECKS = ", ".join(PCT.format(e, n) for e, n in (("starting_price_eur > 0", "with_price"), ("surface_m2 > 0", "with_surface"), ("tribunal_code IS NOT NULL", "with_tribunal"), ("latitude IS NOT NULL", "geocoded"), ("documents_count > 0", "with_documents"), ("dpe_class IS NOT NULL", "with_dpe"), ("investment_score IS NOT NULL", "scored")))


@query("agg_quality_report", S + f"SELECT count(*) AS total, {CHECKS} FROM sales")
def quality_report(spark, d):
    return agg.quality_report(sales(spark, d), [])


@query("agg_source_quality", S + f"SELECT source_name, count(*) AS total, {CHECKS} FROM sales GROUP BY source_name")
def source_quality(spark, d):
    return agg.quality_report(sales(spark, d), ["source_name"])


REQUIRED = ["starting_price_eur", "surface_m2", "rooms_count", "bedrooms_count", "title"]
HAS_ROOMS = " AND coalesce(property_type, '') NOT IN ('land', 'parking')"


@query("agg_gap_report", S + " UNION ALL ".join(f"SELECT source_name, '{x}' AS field, count(*) AS missing FROM sales WHERE {x} IS NULL{HAS_ROOMS if 'rooms' in x else ''} GROUP BY source_name" for x in REQUIRED))
def gap_report(spark, d):
    return agg.gap_report(sales(spark, d), REQUIRED)


SUMMARY = "count(*) AS n, count(*) FILTER (is_upcoming) AS upcoming, count(*) FILTER (NOT is_upcoming) AS past, " + ", ".join(f"{quantile_sql('starting_price_eur', p)} AS {n}" for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))) + f", {quantile_sql('price_m2', 0.5)} AS median_m2, {mean_sql('investment_score')} AS mean_score, {mean_sql('days_to_sale')} AS mean_delay"


@query("agg_market_summary", ITEMS + f"SELECT {SUMMARY} FROM items")
def market_summary(spark, d):
    return agg.market_summary(items(spark, d), [])


@query("agg_portfolio", ITEMS + f"SELECT city, property_type, {SUMMARY} FROM items GROUP BY city, property_type")
def portfolio(spark, d):
    return agg.market_summary(items(spark, d), ["city", "property_type"])


BUCKETS = list(zip(agg.PRICE_BOUNDS, agg.PRICE_BOUNDS[1:], strict=False))


def bucket_sql(i, lo, hi):
    n = f"count(*) FILTER ({f'starting_price_eur >= {lo}' if lo else 'TRUE'} AND {f'starting_price_eur < {hi}' if hi else 'TRUE'})"
    return f"SELECT CAST({i} AS BIGINT) AS bucket, CAST({lo or 'NULL'} AS BIGINT) AS low, CAST({hi or 'NULL'} AS BIGINT) AS high, {n} AS n, {half_up(n + ' * 100 / count(*)')} AS share_pct FROM sales WHERE starting_price_eur > 0"


@query("agg_price_histogram", S + " UNION ALL ".join(bucket_sql(i, lo, hi) for i, (lo, hi) in enumerate(BUCKETS)))
def price_histogram(spark, d):
    return agg.histogram(sales(spark, d))


@query("agg_monthly", ITEMS + f"SELECT strftime(sale_date, '%Y-%m') AS month, count(*) AS n, {quantile_sql('starting_price_eur', 0.5)} AS median_price, {quantile_sql('price_m2', 0.5)} AS median_m2, {mean_sql('days_to_sale')} AS mean_delay FROM items GROUP BY month")
def monthly(spark, d):
    return agg.monthly(items(spark, d))


@query("agg_segments_topk", ITEMS + f"SELECT CASE WHEN (SELECT count(DISTINCT city) FROM sales) > 1 THEN coalesce(city, 'Ville non renseignée') ELSE coalesce(property_type, 'Type non renseigné') END AS label, count(*) AS n, {quantile_sql('starting_price_eur', 0.5)} AS median_price, {quantile_sql('price_m2', 0.5)} AS median_m2, {mean_sql('investment_score')} AS mean_score FROM items GROUP BY label ORDER BY n DESC, label LIMIT 6")
def segments_topk(spark, d):
    return agg.top_segments(items(spark, d), 6)


@query("agg_rotation", ITEMS + f", g AS (SELECT city, count(*) AS n, count(DISTINCT strftime(sale_date, '%Y-%m')) AS months, count(*) FILTER (is_upcoming) AS upcoming, count(*) FILTER (NOT is_upcoming) AS past, {mean_sql('days_to_sale')} AS mean_delay FROM items GROUP BY city), r AS (SELECT *, {half_up('n / greatest(months, 1)')} AS per_month, CASE WHEN past > 0 THEN {half_up('upcoming / past * 100')} END AS pipeline_pct FROM g) SELECT *, CASE WHEN past = 0 THEN 'unknown' WHEN per_month >= 6 AND (mean_delay IS NULL OR mean_delay <= 45) THEN 'active' WHEN per_month >= 2 OR mean_delay <= 75 THEN 'moderate' ELSE 'low' END AS liquidity, CASE WHEN past = 0 AND upcoming > 0 THEN 'no history' WHEN pipeline_pct IS NULL THEN 'unknown' WHEN pipeline_pct >= 80 THEN 'full' WHEN pipeline_pct >= 35 THEN 'balanced' ELSE 'thin' END AS pipeline FROM r")
def rotation(spark, d):
    return agg.rotation(items(spark, d), "city")


@query("agg_trend", ITEMS + f", p AS (SELECT city, strftime(sale_date, '%Y-%m') AS period, {quantile_sql('price_m2', 0.5)} AS v FROM items GROUP BY ALL HAVING v IS NOT NULL), e AS (SELECT city, count(*) AS k, min(period) AS period_from, max(period) AS period_to, arg_min(v, period) AS v0, arg_max(v, period) AS v1 FROM p GROUP BY city), c AS (SELECT city, period_from, period_to, CASE WHEN k >= 2 THEN {half_up('v0')} END AS start_value, CASE WHEN k >= 2 THEN {half_up('v1')} END AS end_value, CASE WHEN k >= 2 AND v0 > 0 THEN {half_up('(v1 - v0) / v0 * 100')} END AS change_pct FROM e) SELECT *, CASE WHEN change_pct IS NULL THEN 'missing' WHEN abs(change_pct) < 5 THEN 'stable' WHEN change_pct > 0 THEN 'up' ELSE 'down' END AS direction FROM c")
def trend(spark, d):
    return agg.trend(items(spark, d), "city", agg.quantile(c("price_m2"), 0.5))


@query("agg_sales_stats", S + "SELECT count(*) AS n, round(median(starting_price_eur), 2) AS median_price, round(avg(starting_price_eur), 2) AS mean_price, round(median(starting_price_eur / surface_m2), 2) AS median_m2, count(adjudication_price_eur) AS adjudicated, " + ", ".join(f"count(*) FILTER (dpe_class = '{k}') AS dpe_{k.lower()}" for k in "ABCDEFG") + " FROM sales")
def sales_stats(spark, d):
    return agg.sales_stats(sales(spark, d))


SEGMENTS = ["property_type", "city", "dpe_class"]


@query("agg_stats_segments", S + ", v AS (" + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS value, count(*) AS n FROM sales WHERE {x} IS NOT NULL GROUP BY {x}" for x in SEGMENTS) + "), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS rank FROM v) SELECT *, round(n * 100 / (SELECT count(*) FROM sales), 1) AS share_pct FROM r WHERE rank <= 8")
def stats_segments(spark, d):
    return agg.stats_segments(sales(spark, d), SEGMENTS)


@query("agg_history_summary", S + "SELECT region, count(*) AS n, round(avg(starting_price_eur), 2) AS mean_start, round(median(starting_price_eur), 2) AS median_start, round(avg(CASE WHEN starting_price_eur > 0 THEN (adjudication_price_eur - starting_price_eur) * 100 / starting_price_eur END), 2) AS mean_delta_pct, min(sale_date) AS earliest, max(sale_date) AS latest, array_to_string(list_sort(list(DISTINCT city))[1:8], ',') AS cities FROM sales GROUP BY region")
def history_summary(spark, d):
    return agg.history_summary(sales(spark, d), "region")


LOCATED, PRICED, DATED, SOURCED = "(latitude IS NOT NULL AND longitude IS NOT NULL)", "starting_price_eur > 0", "sale_date IS NOT NULL", "(source_url IS NOT NULL OR source_name IS NOT NULL)"
METRICS = {
    "ai_description": ("trim(description) <> ''", 95, 99), "location": (LOCATED, 65, 85), "surface": ("surface_m2 > 0", 65, 85), "documents": ("documents_count > 0", 65, 85), "dpe": ("dpe_class IS NOT NULL", 65, 85), "source_traceability": (SOURCED, 65, 85),
    "opportunity_report": (f"{PRICED} AND {DATED} AND surface_m2 > 0 AND {LOCATED} AND {SOURCED}", 75, 90), "market_estimate": (f"{LOCATED} AND surface_m2 > 0", 70, 88), "dvf_detailed_comparables": (f"{LOCATED} AND surface_m2 > 0 AND (department <> '' OR city <> '') AND property_type <> ''", 70, 88),
    "bid_ceiling": (f"{PRICED} AND surface_m2 > 0", 80, 92), "smart_alerts": (f"{PRICED} AND {DATED} AND (department <> '' OR city <> '') AND property_type <> ''", 80, 94), "investor_api_feed": (f"{SOURCED} AND {PRICED} AND {DATED} AND tribunal_code IS NOT NULL", 80, 94),
}


@query("agg_quality_monitor", S + ", m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({e}) AS covered, count(*) AS total, {w} AS w, {h} AS h FROM sales" for k, (e, w, h) in METRICS.items()) + f"), p AS (SELECT *, {half_up('covered / total * 100')} AS pct FROM m) SELECT metric, covered, total, pct, CASE WHEN pct >= h THEN 'healthy' WHEN pct >= w THEN 'watch' ELSE 'critical' END AS state FROM p")
def quality_monitor(spark, d):
    return agg.metric_monitor(sales(spark, d))


@query("agg_canonical_mutation", f"WITH {MUTATIONS_CTE}, land AS (SELECT mutation_id, CAST(sum(m) AS BIGINT) AS land_m2 FROM (SELECT mutation_id, parcel_id, max(land_m2) AS m FROM mutations GROUP BY ALL) GROUP BY mutation_id), pts AS (SELECT mutation_id, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM (SELECT DISTINCT mutation_id, latitude, longitude FROM mutations) GROUP BY mutation_id), g AS (SELECT mutation_id, min(line_date) AS sale_date, min(price_eur) AS price_eur, max(CASE WHEN built_m2 > 0 THEN built_m2 END) AS built_m2, max(lots_count) AS lots_count, count(*) AS lines, string_agg(DISTINCT parcel_id, ',' ORDER BY parcel_id) AS parcels FROM mutations GROUP BY mutation_id HAVING min(line_date) = max(line_date) AND min(price_eur) = max(price_eur) AND count(DISTINCT CASE WHEN built_m2 > 0 THEN type_code || '|' || built_m2 END) <= 1) SELECT g.*, land_m2, latitude, longitude FROM g JOIN land USING (mutation_id) JOIN pts USING (mutation_id)")
def canonical_mutation(spark, d):
    return agg.canonical_mutations(mutations(spark, d))


def priced(spark, d, *more):
    return sales(spark, d).where("starting_price_eur IS NOT NULL").select("sale_id", "city", "starting_price_eur", *more)


@query("agg_loo_mean", S + ", p AS (SELECT city, sale_id, starting_price_eur, sum(starting_price_eur) OVER (PARTITION BY city) AS s, count(*) OVER (PARTITION BY city) AS n FROM sales WHERE starting_price_eur IS NOT NULL) SELECT city, sale_id, starting_price_eur, round(CASE WHEN n > 1 THEN (s - starting_price_eur) / (n - 1) END, 4) AS loo_mean FROM p")
def loo_mean(spark, d):
    return agg.leave_one_out(priced(spark, d), "city", "starting_price_eur")


@query("agg_weighted_avg", S + "SELECT city, round(sum(starting_price_eur * (investment_score + 1)) / sum(investment_score + 1), 4) AS weighted, round(pow(sum(investment_score + 1), 2) / sum((investment_score + 1) * (investment_score + 1)), 4) AS effective_n FROM sales WHERE starting_price_eur IS NOT NULL AND investment_score IS NOT NULL GROUP BY city")
def weighted_avg(spark, d):
    return agg.weighted_average(priced(spark, d, "investment_score").where("investment_score IS NOT NULL"), "city", c("starting_price_eur"), c("investment_score") + 1)


@query("agg_weighted_quantile", S + ", v AS (SELECT city, starting_price_eur AS v, sum(surface_m2) AS w FROM sales WHERE starting_price_eur IS NOT NULL AND surface_m2 IS NOT NULL GROUP BY ALL), r AS (SELECT city, v, sum(w) OVER (PARTITION BY city ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY city) AS total FROM v) SELECT city, min(v) AS quantile FROM r WHERE upto >= total * 5e-1 GROUP BY city")
def weighted_quantile(spark, d):
    return agg.weighted_quantile(priced(spark, d, "surface_m2").where("surface_m2 IS NOT NULL"), "city", "starting_price_eur", "surface_m2", 0.5)


@query("agg_weighted_regression", S + f", v AS (SELECT city, date_diff('day', sale_date, DATE '2001-09-01') / 30.4375e0 AS m, ln(starting_price_eur) AS y0, exp(-(sale_id % 2000) / 1500e0) AS w FROM sales WHERE starting_price_eur > 0), q AS (SELECT city, count(*) AS n, max(m) AS span, quantile_cont(y0, 0.1) AS lo, quantile_cont(y0, 0.9) AS hi FROM v GROUP BY city), r AS (SELECT v.city, n, span, w, -m / 12 AS x, greatest(lo, least(hi, y0)) AS y FROM v JOIN q USING (city)), g AS (SELECT city, any_value(n) AS n, any_value(span) AS span, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) AS cov, (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) AS var FROM r GROUP BY city) SELECT city, n, round(CASE WHEN n < 6 OR span < 12 OR var <= 1e-9 THEN 0e0 ELSE greatest(-0.12e0, least(0.12e0, (exp(cov / var) - 1) * least(0.8e0, n / (n + 12)))) END, 6) AS trend FROM g")
def weighted_regression(spark, d):
    rows = sales(spark, d).where("starting_price_eur > 0")
    return agg.market_trend(rows, "city", c("starting_price_eur"), numbers.month_distance(F.lit("2001-09-01").cast("date"), c("sale_date")), c("sale_id") % 2000)


@query("agg_iqr_outliers", S + ", f AS (SELECT city, count(*) AS n, quantile_cont(starting_price_eur, 0.25) AS q1, quantile_cont(starting_price_eur, 0.75) AS q3 FROM sales WHERE starting_price_eur IS NOT NULL GROUP BY city), m AS (SELECT sale_id, s.city, starting_price_eur, CASE WHEN n >= 7 AND q3 > q1 THEN starting_price_eur BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) ELSE TRUE END AS inside FROM sales s JOIN f USING (city) WHERE starting_price_eur IS NOT NULL) SELECT sale_id, city, starting_price_eur FROM (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY city) AS stay FROM m) WHERE inside OR stay < 4")
def iqr_outliers(spark, d):
    return agg.iqr_filtered(priced(spark, d), "city", "starting_price_eur")


RATIO = "CASE WHEN starting_price_eur > 0 THEN adjudication_price_eur / starting_price_eur END"


@query("agg_cohort_stats", S + "SELECT city, count(*) AS sample_size, round(avg(CASE WHEN status = 'adjudicated' THEN 1e0 ELSE 0e0 END), 4) AS p_adjudicated, round(avg(CASE WHEN status = 'unknown' THEN 1e0 ELSE 0e0 END), 4) AS p_unknown, " + ", ".join(f"round(quantile_cont({RATIO}, {p / 100}), 4) AS ratio_p{p}" for p in (10, 50, 90)) + ", min(sale_date) AS period_start, max(sale_date) AS period_end FROM sales GROUP BY city")
def cohort_stats(spark, d):
    return agg.cohort_stats(sales(spark, d), ["city"])


@query("agg_jsonb_object", S + ", n AS (SELECT city, status, count(*) AS n FROM sales GROUP BY ALL) SELECT city, string_agg(status || '=' || n, ';' ORDER BY status) AS entries FROM n GROUP BY city")
def jsonb_object(spark, d):
    return agg.json_object(sales(spark, d).groupBy("city", "status").agg(F.count("*").alias("n")), "city", "status", "n")


# filters, sorts, pages

SHOWN = ["sale_id", "city", "status", "starting_price_eur", "sale_date"]
COLUMNS = ", ".join(SHOWN)


@query("flt_viewport", S + f"SELECT {COLUMNS} FROM sales WHERE latitude BETWEEN 44.5e0 AND 46e0 AND longitude BETWEEN 1e0 AND 3e0")
def viewport(spark, d):
    return sales(spark, d).where(search.in_bbox(44.5, 1.0, 46.0, 3.0)).select(*SHOWN)


HOUSE = "(regexp_matches(lower(concat_ws(' ', {0}property_type, {0}title)), 'house|maison|villa|immeuble|building') AND (coalesce({0}has_garden, FALSE) OR coalesce({0}land_surface_m2, 0) > 0))"


@query("flt_house_with_land", S + f"SELECT {COLUMNS} FROM sales WHERE {HOUSE.format('')}")
def house_with_land(spark, d):
    return sales(spark, d).where(search.house_with_land()).select(*SHOWN)


@query("flt_quality_issues", S + f"SELECT {COLUMNS}, quality_flags FROM sales WHERE quality_flags <> '' OR surface_m2 IS NULL OR rooms_count IS NULL OR bedrooms_count IS NULL OR latitude IS NULL OR longitude IS NULL")
def quality_issues(spark, d):
    return search.quality_issues(sales(spark, d)).select(*SHOWN, "quality_flags")


@query("flt_candidates", S + f"SELECT {COLUMNS}, investment_score FROM sales WHERE status = 'upcoming' AND investment_score IS NOT NULL")
def candidates(spark, d):
    return search.candidates(sales(spark, d)).select(*SHOWN, "investment_score")


ALERTS = {
    "alert_id": "n_nationkey",
    "city": "CASE WHEN n_nationkey % 11 = 3 THEN lower(n_name) END",
    "department": "CASE WHEN n_nationkey % 4 > 0 THEN lpad(CAST(n_nationkey + 1 AS STRING), 2, '0') END",
    "property_type": "CASE WHEN n_nationkey % 2 = 0 THEN 'house' END",
    "max_price": "CASE WHEN n_nationkey % 3 > 0 THEN 50000 + n_nationkey * 10000 END",
    "min_surface": "CASE WHEN n_nationkey % 5 = 1 THEN 40 END",
    "occupancy_status": "CASE WHEN n_nationkey % 7 = 2 THEN 'Vacant' END",
    "min_score": "CASE WHEN n_nationkey % 6 = 5 THEN 30 END",
    "max_price_m2": "CASE WHEN n_nationkey % 8 = 4 THEN 4000 END",
    "min_yield": "CASE WHEN n_nationkey % 9 = 1 THEN 5 END",
    "dpe_classes": "CASE WHEN n_nationkey % 3 = 2 THEN 'ABCD' END",
    "house_with_land": "n_nationkey % 10 = 6",
    "min_discount": "CASE WHEN n_nationkey % 12 = 7 THEN 20 END",
    "zone_id": "CASE WHEN n_nationkey % 8 IN (0, 5) THEN n_nationkey END",
    "zone_active": "n_nationkey <> 16",
    "zone_postal_prefix": "CASE WHEN n_nationkey % 8 = 5 THEN substring(lpad(CAST((n_nationkey + 1) * 1000 AS STRING), 5, '0'), 1, 2) END",
    "zone_latitude": "CASE WHEN n_nationkey % 8 = 0 THEN 46e0 END",
    "zone_longitude": "CASE WHEN n_nationkey % 8 = 0 THEN 3e0 END",
    "zone_radius_km": "CASE WHEN n_nationkey % 8 = 0 THEN 100e0 END",
}
ALERTS_CTE = f"alerts AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ALERTS.items())} FROM nation)".replace("STRING", "VARCHAR")
RENT = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in numbers.RENTS.items()) + " ELSE 11e0 END"
M2 = "CASE WHEN s.surface_m2 > 0 AND s.starting_price_eur > 0 THEN s.starting_price_eur / s.surface_m2 END"
YIELD = f"CASE WHEN s.starting_price_eur > 0 AND s.surface_m2 > 0 THEN s.surface_m2 * {RENT.format('s.department')} * 12 / (s.starting_price_eur * 1.1e0) * 100 END"
ZONE_KM = "2 * 6371 * asin(sqrt(pow(sin(radians(s.latitude - a.zone_latitude) / 2), 2) + cos(radians(a.zone_latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - a.zone_longitude) / 2), 2)))"
DISCOUNT = "CASE WHEN sale_id % 3 > 0 THEN (sale_id % 50) * 1e0 END"
FAILS = {
    "zone": f"a.zone_id IS NOT NULL AND (NOT a.zone_active OR (a.zone_postal_prefix IS NOT NULL AND NOT starts_with(s.postal_code, a.zone_postal_prefix)) OR (a.zone_radius_km IS NOT NULL AND NOT coalesce({ZONE_KM} <= a.zone_radius_km, FALSE)))",
    "city": "a.city IS NOT NULL AND coalesce(lower(strip_accents(trim(s.city))), '') <> lower(strip_accents(trim(a.city)))",
    "department": "a.department IS NOT NULL AND s.department IS DISTINCT FROM a.department",
    "type": "a.property_type IS NOT NULL AND NOT coalesce(contains(s.property_type, a.property_type), FALSE)",
    "budget": "a.max_price IS NOT NULL AND coalesce(s.starting_price_eur > a.max_price, TRUE)",
    "surface": "a.min_surface IS NOT NULL AND coalesce(s.surface_m2 < a.min_surface, TRUE)",
    "occupancy": "a.occupancy_status IS NOT NULL AND coalesce(s.occupancy_status, '') <> lower(a.occupancy_status)",
    "score": "a.min_score IS NOT NULL AND coalesce(s.investment_score < a.min_score, TRUE)",
    "price_m2": f"a.max_price_m2 IS NOT NULL AND coalesce({M2} > a.max_price_m2, TRUE)",
    "yield": f"a.min_yield IS NOT NULL AND coalesce({YIELD} < a.min_yield, TRUE)",
    "dpe": "a.dpe_classes IS NOT NULL AND NOT coalesce(contains(a.dpe_classes, s.dpe_class), FALSE)",
    "house_with_land": f"a.house_with_land AND NOT {HOUSE.format('s.')}",
    "discount": f"a.min_discount IS NOT NULL AND coalesce({DISCOUNT.replace('sale_id', 's.sale_id')} < a.min_discount, TRUE)",
}
REASONS = f"concat_ws(',', CASE WHEN a.max_price_m2 IS NOT NULL THEN 'prix au m²' END, CASE WHEN a.min_yield IS NOT NULL THEN 'rendement' END, CASE WHEN a.dpe_classes IS NOT NULL THEN 'DPE ' || s.dpe_class END, CASE WHEN a.house_with_land THEN 'terrain' END, CASE WHEN a.min_discount IS NOT NULL THEN 'décote' END, CASE WHEN a.zone_id IS NOT NULL THEN 'zone surveillée' END)"
FAILURE = "CASE " + " ".join(f"WHEN {e} THEN '{n}'" for n, e in FAILS.items()) + " END"


def alerts(spark, d):
    return read(spark, d, "nation").selectExpr(*(f"{e} AS {n}" for n, e in ALERTS.items()))


@query("flt_alert_match", S + f", {ALERTS_CTE} SELECT alert_id, sale_id, {REASONS} AS reasons FROM alerts a, sales s WHERE {FAILURE} IS NULL")
def alert_match(spark, d):
    told = sales(spark, d).selectExpr("*", f"{DISCOUNT} AS market_discount_pct")
    return alerting.matches(alerts(spark, d), told).withColumn("reasons", F.array_join("reasons", ","))


@query("flt_alert_reason", S + f", {ALERTS_CTE} SELECT sale_id, {FAILURE} AS reason FROM sales s JOIN alerts a ON a.department = s.department")
def alert_reason(spark, d):
    told = sales(spark, d).selectExpr("*", f"{DISCOUNT} AS market_discount_pct")
    stated = alerts(spark, d)
    stated = stated.select("*", *(F.lit(None).cast(kind).alias(n) for n, kind in alerting.ZONE.items() if n not in stated.columns))
    return told.alias("s").join(stated.alias("a"), "department").select("sale_id", alerting.failure().alias("reason"))


@query("flt_raw_validate", S + "SELECT sale_id, concat_ws(',', CASE WHEN sale_id % 9 = 0 THEN 'source_name' END, CASE WHEN sale_id % 5 = 0 THEN 'source_url' END, CASE WHEN trim(coalesce(title, '')) = '' AND sale_id % 2 = 1 THEN 'content' END) AS errors FROM sales")
def raw_validate(spark, d):
    raw = sales(spark, d).selectExpr("sale_id", "CASE WHEN sale_id % 9 = 0 THEN ' ' ELSE source_name END AS source_name", "CASE WHEN sale_id % 5 = 0 THEN 'ftp://x' ELSE source_url END AS source_url", "title", "CASE WHEN sale_id % 2 = 0 THEN address END AS address")
    return search.raw_validate(raw).select("sale_id", "errors")


@query("srt_page", S + f"SELECT {COLUMNS}, (SELECT count(*) FROM sales) AS total_count FROM sales ORDER BY starting_price_eur DESC NULLS LAST, sale_id LIMIT 50 OFFSET 100")
def page(spark, d):
    return search.page_with_total(sales(spark, d).select(*SHOWN), "price_desc", 50, 100)


# joins


@query("join_left_dim", f"WITH {SALES_CTE}, {TRIBUNALS_CTE} SELECT tribunal_code, sale_id, name, region_key FROM sales LEFT JOIN tribunals ON tribunal_code = code")
def left_dim(spark, d):
    return joins.with_tribunal(sales(spark, d).select("tribunal_code", "sale_id"), tribunals(spark, d))


@query("join_lateral_agg", "SELECT o_orderkey AS sale_id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def lateral_agg(spark, d):
    parents = read(spark, d, "orders").select(c("o_orderkey").alias("sale_id"))
    children = read(spark, d, "lineitem").select(c("l_orderkey").alias("sale_id"), c("l_partkey").cast("string").alias("part"))
    return joins.with_children(parents, children, "sale_id", c("part"), "parts").withColumn("parts", F.array_join("parts", ","))


@query("join_comparables_radius", S + ", d AS (SELECT s.sale_id, p.sale_id AS point_id, round(2 * 6371000 * asin(sqrt(least(1e0, pow(sin(radians(p.latitude - s.latitude) / 2), 2) + cos(radians(s.latitude)) * cos(radians(p.latitude)) * pow(sin(radians(p.longitude - s.longitude) / 2), 2)))), 2) AS distance_m FROM sales s JOIN sales p ON p.latitude BETWEEN s.latitude - 0.011e0 AND s.latitude + 0.011e0 AND p.longitude BETWEEN s.longitude - 0.02e0 AND s.longitude + 0.02e0 AND s.sale_id <> p.sale_id) SELECT * FROM d WHERE distance_m <= 1000")
def comparables_radius(spark, d):
    return joins.neighbours(sales(spark, d), 1000.0, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("join_asof_backtest", S + ", r AS (SELECT city, sale_date AS d, max(starting_price_eur) AS v FROM sales WHERE starting_price_eur IS NOT NULL GROUP BY ALL) SELECT s.sale_id, s.city, s.sale_date, r.v AS as_of_value FROM sales s ASOF LEFT JOIN r ON s.city = r.city AND s.sale_date > r.d")
def asof_backtest(spark, d):
    rows = sales(spark, d)
    ref = rows.where("starting_price_eur IS NOT NULL").select("city", c("sale_date").alias("ref_date"), "starting_price_eur")
    return joins.as_of(rows.select("sale_id", "city", "sale_date"), ref, "city", "sale_date", "ref_date", "starting_price_eur")


@query("join_anti_orphans", "SELECT 'orders' AS check, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT c_custkey FROM customer)")
def anti_orphans(spark, d):
    return joins.orphans({"orders": (read(spark, d, "orders"), "o_custkey"), "lineitem": (read(spark, d, "lineitem"), "l_suppkey")}, read(spark, d, "customer"), "c_custkey")


VERSIONS = ["event_id AS version_id", "CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS supersedes_id", "event_type"]


@query("join_anti_latest", f"WITH v AS (SELECT {', '.join(VERSIONS)} FROM events) SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v n WHERE n.supersedes_id = v.version_id)")
def anti_latest(spark, d):
    return joins.current_rows(read(spark, d, "events").selectExpr(*VERSIONS))


# scalar functions

STREET_SQL = f"regexp_replace({FOLDED.format('address')}, '[^\\x00-\\x7f]', '', 'g')"
for _pattern, _by in ((r"\bfrance\b", " "), (r"\bcedex\b\s*\d*", " "), (r"\b(?:n|no|numero)\s+(\d+)\b", r"\1"), ("[^a-z0-9]+", " "), *text.STREET_WORDS, (text.PARTICLES, " "), (r"\s+", " ")):
    STREET_SQL = f"regexp_replace({STREET_SQL}, '{_pattern}', '{_by}', 'g')"
STREET_SQL = f"trim({STREET_SQL})"


@query("sc_street_key", S + f"SELECT sale_id, {STREET_SQL} AS street_key, trim(regexp_replace({FOLDED.format('title')}, '[^a-z0-9]+', ' ', 'g')) AS title_norm, nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS title_clean FROM sales")
def street_key(spark, d):
    return sales(spark, d).select("sale_id", text.street_key(c("address")).alias("street_key"), text.search_norm(c("title")).alias("title_norm"), text.clean_text(c("title")).alias("title_clean"))


@query("sc_hash", S + "SELECT sale_id, sha256(lower(concat_ws('|', coalesce(address, ''), coalesce(city, ''), coalesce(CAST(sale_date AS VARCHAR), ''), coalesce(CAST(starting_price_eur AS VARCHAR), '')))) AS content_hash FROM sales")
def content_hash(spark, d):
    return sales(spark, d).select("sale_id", text.content_hash(c("address"), c("city"), c("sale_date"), c("starting_price_eur")).alias("content_hash"))


FEES = "(least(p, 6500) * 0.07e0 + greatest(least(p, 17000) - 6500, 0) * 0.0385e0 + greatest(least(p, 30000) - 17000, 0) * 0.0275e0 + greatest(p - 30000, 0) * 0.015e0)"


@query("sc_fees", S + f", v AS (SELECT sale_id, starting_price_eur AS p FROM sales WHERE starting_price_eur IS NOT NULL) SELECT sale_id, round({FEES}, 4) AS emoluments, round(p + {FEES} * 1.2e0 + p * 0.058e0 + 3000, 4) AS total FROM v")
def fees(spark, d):
    p = c("starting_price_eur")
    return sales(spark, d).where(p.isNotNull()).select("sale_id", F.round(numbers.emoluments(p), 4).alias("emoluments"), F.round(numbers.acquisition_cost(p), 4).alias("total"))
