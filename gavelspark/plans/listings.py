"""Queries of listings beside a sale, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings, nearby
from ..sources.adapters import SALES_CTE, read, sales
from ..storage import hold
from .queries import NOW
from .registry import query
from .scalars import over_sales

c = F.col
S = f"WITH {SALES_CTE} "

TYPED = "(s.property_type IS NULL OR s.property_type = a.property_type)"
ACTIVE = f""", pairs AS (SELECT s.sale_id, a.sale_id AS comparable_id, a.sale_date, k FROM sales s JOIN (SELECT * FROM sales WHERE sale_date >= DATE '{NOW}') a ON s.sale_id <> a.sale_id CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) v(k)
  WHERE CASE k WHEN 1 THEN s.city = a.city AND s.department = a.department AND {TYPED} WHEN 2 THEN s.tribunal_code = a.tribunal_code AND {TYPED} WHEN 3 THEN s.department = a.department AND {TYPED} WHEN 4 THEN s.department = a.department WHEN 5 THEN s.city = a.city ELSE s.property_type = a.property_type END),
 firsts AS (SELECT sale_id, comparable_id, sale_date, min(k) AS scope FROM (SELECT *, row_number() OVER (PARTITION BY sale_id, k ORDER BY sale_date, comparable_id) AS r FROM pairs) WHERE r <= 8 GROUP BY ALL),
 sums AS (SELECT sale_id, scope, sum(count(*)) OVER (PARTITION BY sale_id ORDER BY scope) - count(*) AS before FROM firsts GROUP BY sale_id, scope),
 act AS (SELECT * FROM (SELECT sale_id, comparable_id, scope, row_number() OVER (PARTITION BY sale_id ORDER BY scope, sale_date, comparable_id) AS place FROM firsts JOIN sums USING (sale_id, scope) WHERE before < 8) WHERE place <= 12)"""


@query("join_active_comparables", S + ACTIVE + " SELECT sale_id, comparable_id, scope, CAST(place AS INTEGER) AS place FROM act")
def active(spark, d):
    return listings.active_comparables(sales(spark, d), NOW)


GAP = "CASE WHEN s.{0} > 0 AND o.{0} > 0 THEN abs(s.{0} - o.{0}) / CAST(greatest(s.{0}, o.{0}) AS DOUBLE) END"
SURFACE_GAP, PRICE_GAP = GAP.format("surface_m2"), GAP.format("starting_price_eur")
POINTS = f"""35 + CASE WHEN s.property_type = o.property_type THEN 18 ELSE 0 END + CASE WHEN s.city = o.city THEN 18 WHEN s.department = o.department THEN 10 ELSE 0 END
 + CASE WHEN {SURFACE_GAP} <= 0.15 THEN 15 WHEN {SURFACE_GAP} <= 0.3 THEN 10 WHEN {SURFACE_GAP} > 0.6 THEN -10 ELSE 0 END + CASE WHEN {PRICE_GAP} <= 0.2 THEN 10 WHEN {PRICE_GAP} > 0.7 THEN -8 ELSE 0 END
 + CASE WHEN o.sale_date >= DATE '{NOW}' THEN 8 ELSE 0 END + CASE WHEN o.investment_score >= 70 THEN 6 WHEN o.investment_score < 45 THEN -4 ELSE 0 END"""


@query("sc_active_comp", S + ACTIVE + f" SELECT act.sale_id, comparable_id, CAST(greatest(0, least(100, {POINTS})) AS INTEGER) AS score FROM act JOIN sales s ON act.sale_id = s.sale_id JOIN sales o ON comparable_id = o.sale_id")
def active_scores(spark, d):
    rows = sales(spark, d)
    seen = rows.select("sale_id", "property_type", "city", "department", "surface_m2", "starting_price_eur", "sale_date", "investment_score")
    side = lambda p: seen.select(*(c(x).alias(p + x) for x in seen.columns))
    pairs = listings.active_comparables(rows, NOW)
    full = pairs.join(side("s_"), c("sale_id") == c("s_sale_id")).join(side("o_"), c("comparable_id") == c("o_sale_id"))
    return full.select("sale_id", "comparable_id", listings.active_score("s_", "o_", NOW).alias("score"))


SCORE = "50 + CASE WHEN disc >= 35 THEN 24 WHEN disc >= 25 THEN 18 WHEN disc >= 15 THEN 11 WHEN disc < 0 THEN -12 ELSE 0 END + CASE WHEN yld >= 9 THEN 12 WHEN yld >= 6.5 THEN 8 WHEN yld < 3 THEN -8 ELSE 0 END + CASE WHEN margin IS NULL THEN -6 WHEN margin > 0 THEN 7 WHEN margin < 0 THEN -10 ELSE 0 END"
over_sales(
    "sc_opportunity",
    {"score": (lambda: listings.opportunity_score(c("disc"), c("yld"), c("margin")), f"CAST(CASE WHEN disc IS NOT NULL OR yld IS NOT NULL OR margin IS NOT NULL THEN greatest(0, least(100, {SCORE})) END AS INTEGER)")},
    disc="CASE WHEN sale_id % 5 > 0 THEN sale_id % 60 - 15 END",
    yld="CASE WHEN sale_id % 3 > 0 THEN (sale_id % 120) / 10e0 END",
    margin="CASE WHEN sale_id % 4 > 0 THEN sale_id % 9 - 4 END",
)

TARGETS = 500


@query("topk_llm_targets", S + f"SELECT sale_id, status, sale_date FROM sales ORDER BY CASE status WHEN 'upcoming' THEN 0 WHEN 'unknown' THEN 1 WHEN 'adjudicated' THEN 2 WHEN 'past' THEN 3 ELSE 2 END, sale_date NULLS LAST, source_url, sale_id LIMIT {TARGETS}")
def llm_targets(spark, d):
    return listings.enrichment_targets(sales(spark, d), TARGETS).select("sale_id", "status", "sale_date")


LAWYERS = ["s_suppkey AS lawyer_id", "s_name AS name", "CASE WHEN s_suppkey % 6 > 0 THEN 'active' ELSE 'closed' END AS status", "CASE s_suppkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'trial' ELSE 'active' END AS placement", "s_suppkey % 7 > 0 AS accepts", "s_suppkey % 5 AS weight", "CASE WHEN s_suppkey % 3 > 0 THEN DATE '1998-01-01' + CAST(s_suppkey % 250 AS INT) END AS starts_at", "CASE WHEN s_suppkey % 5 > 0 THEN DATE '1998-06-01' + CAST(s_suppkey % 90 AS INT) END AS ends_at"]
COVERAGE = ["s_suppkey AS lawyer_id", "CASE s_suppkey % 5 WHEN 0 THEN 'tribunal_code' WHEN 1 THEN 'city' WHEN 2 THEN 'department' ELSE 'postal_code_prefix' END AS basis", "CASE s_suppkey % 5 WHEN 0 THEN 'T' || CAST(s_nationkey AS STRING) WHEN 1 THEN n_name WHEN 2 THEN lpad(CAST(s_nationkey + 1 AS STRING), 2, '0') WHEN 3 THEN lpad(CAST((s_nationkey + 1) * 1000 + s_suppkey % 10 AS STRING), 5, '0') ELSE substring(lpad(CAST((s_nationkey + 1) * 1000 AS STRING), 5, '0'), 1, 3) END AS value"]
sql = lambda xs: ", ".join(xs).replace("AS STRING", "AS VARCHAR")


@query(
    "join_featured_lawyer",
    S + f", able AS (SELECT * FROM (SELECT {sql(LAWYERS)} FROM supplier) WHERE status = 'active' AND placement IN ('trial', 'active') AND accepts AND coalesce(starts_at <= DATE '{NOW}', true) AND coalesce(ends_at >= DATE '{NOW}', true)), cov AS (SELECT {sql(COVERAGE)} FROM supplier JOIN nation ON s_nationkey = n_nationkey) "
    "SELECT sale_id, lawyer_id, basis FROM (SELECT sale_id, able.lawyer_id, basis, row_number() OVER (PARTITION BY sale_id ORDER BY CASE basis WHEN 'tribunal_code' THEN 1 WHEN 'postal_code_prefix' THEN 7 - length(value) WHEN 'city' THEN 5 ELSE 6 END, weight DESC, name, able.lawyer_id) AS r FROM able JOIN cov USING (lawyer_id) JOIN sales ON CASE basis WHEN 'tribunal_code' THEN tribunal_code = value WHEN 'city' THEN lower(city) = lower(value) WHEN 'department' THEN department = value ELSE starts_with(postal_code, value) END) WHERE r = 1",
)
def featured(spark, d):
    supplier, nation = read(spark, d, "supplier"), read(spark, d, "nation")
    coverage = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).selectExpr(*COVERAGE)
    return listings.featured_lawyers(sales(spark, d), supplier.selectExpr(*LAWYERS), coverage, NOW)


#: Diagnostics at the addresses of customers: short forms and accents differ from those of sales.
DIAGNOSTICS = ["c_custkey AS diagnostic_id", "lpad(CAST((n_nationkey + 1) * 1000 + c_custkey % 10 AS STRING), 5, '0') AS postal_code", "lpad(CAST(n_nationkey + 1 AS STRING), 2, '0') AS department", "lower(n_name) AS city", "CASE WHEN c_custkey % 11 > 0 THEN CAST(c_custkey % 40 + 1 AS STRING) || ' ' ELSE '' END || CASE c_custkey % 3 WHEN 0 THEN 'av. de la REPUBLIQUE' WHEN 1 THEN 'boulevard du marche' ELSE 'rue saint etienne' END AS address", "CASE WHEN c_custkey % 17 > 0 THEN 44e0 + (c_custkey % 1000) / 250e0 END AS latitude", "CASE WHEN c_custkey % 17 > 0 THEN 5e-1 + (c_custkey % 1000) / 200e0 END AS longitude", "CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 100) / 100e0 END AS address_score"]
WORDS = "regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[a-z0-9]+')"
TERMS = "list_distinct(list_filter(" + WORDS.format("{0}.address") + ", lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '\\d+') AND x NOT IN ('des', 'les', 'aux', 'france') AND NOT list_contains(" + WORDS.format("{0}.city") + ", x)))"
NUMBER = "coalesce(ltrim(regexp_extract({}.address, '\\d{{1,4}}'), '0'), '')"
DISTANCE = "2 * 6371000 * asin(sqrt(pow(sin(radians(d_lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(d_lat)) * pow(sin(radians(d_lng - longitude) / 2), 2)))"


@query(
    "join_dpe_match",
    S + f", diag AS (SELECT {sql(DIAGNOSTICS)} FROM customer JOIN nation ON c_nationkey = n_nationkey), d AS (SELECT *, {NUMBER.format('diag')} AS num, {TERMS.format('diag')} AS terms FROM diag), o AS (SELECT *, {NUMBER.format('sales')} AS num, {TERMS.format('sales')} AS terms FROM sales), "
    "m AS (SELECT o.*, d.diagnostic_id, d.department AS d_dep, d.city AS d_city, d.latitude AS d_lat, d.longitude AS d_lng, d.address_score FROM o JOIN d ON o.postal_code = d.postal_code WHERE CASE WHEN o.num <> '' THEN o.num = d.num AND len(list_intersect(o.terms, d.terms)) > 0 ELSE len(list_intersect(o.terms, d.terms)) >= greatest(2, ceil(len(o.terms) * 0.6)) END), "
    f"f AS (SELECT *, {DISTANCE} AS dist FROM m), g AS (SELECT sale_id, diagnostic_id, round(least(0.95e0, greatest(0.35e0, 0.62e0 + CASE WHEN department = d_dep THEN 0.05e0 ELSE 0 END + 0.08e0 + CASE WHEN lower(city) = d_city THEN 0.05e0 ELSE 0 END + coalesce(least(0.08e0, greatest(0e0, address_score - 0.55e0) / 5), 0e0) + CASE WHEN dist <= 35 THEN 0.12e0 WHEN dist <= 120 THEN 0.06e0 WHEN dist IS NOT NULL THEN -0.12e0 ELSE 0e0 END + 0.08e0)), 2) AS confidence FROM f) "
    "SELECT sale_id, diagnostic_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY confidence DESC, diagnostic_id) AS r FROM g) WHERE r = 1",
)
def dpe_match(spark, d):
    customer, nation = read(spark, d, "customer"), read(spark, d, "nation")
    return listings.energy_matches(sales(spark, d), customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).selectExpr(*DIAGNOSTICS))


NEAR_SQL = S + f", diag AS (SELECT {sql(DIAGNOSTICS)} FROM customer JOIN nation ON c_nationkey = n_nationkey), d AS (SELECT *, {NUMBER.format('diag')} AS num, {TERMS.format('diag')} AS terms FROM diag), o AS (SELECT *, {NUMBER.format('sales')} AS num, {TERMS.format('sales')} AS terms FROM sales), "
NEAR_SQL += "pre AS (SELECT o.*, d.diagnostic_id, d.department AS d_dep, d.postal_code AS d_postal, d.city AS d_city, d.latitude AS d_lat, d.longitude AS d_lng, d.address_score, d.num AS d_num, d.terms AS d_terms FROM o JOIN d ON d.latitude BETWEEN o.latitude - 0.03 AND o.latitude + 0.03 AND d.longitude BETWEEN o.longitude - 0.05 AND o.longitude + 0.05), "
NEAR_SQL += f"f AS (SELECT *, {DISTANCE} AS dist FROM pre), t AS (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY dist, diagnostic_id) AS place FROM f WHERE dist <= 2000 QUALIFY place <= 3), "
NEAR_SQL += "s AS (SELECT *, CASE WHEN num <> '' THEN num = d_num AND len(list_intersect(terms, d_terms)) > 0 ELSE len(list_intersect(terms, d_terms)) >= greatest(2, ceil(len(terms) * 0.6)) END AS same, 0.72e0 + CASE WHEN department = d_dep THEN 0.05e0 ELSE 0 END + CASE WHEN postal_code = d_postal THEN 0.08e0 ELSE 0 END + CASE WHEN lower(city) = d_city THEN 0.05e0 ELSE 0 END + coalesce(least(0.08e0, greatest(0e0, address_score - 0.55e0) / 5), 0e0) + CASE WHEN dist <= 35 THEN 0.12e0 WHEN dist <= 120 THEN 0.06e0 ELSE -0.12e0 END AS c FROM t) "
NEAR_SQL += "SELECT sale_id, diagnostic_id, CAST(place AS INTEGER) AS place, round(least(0.95e0, greatest(0.35e0, CASE WHEN same THEN c + 0.08e0 ELSE least(c, 0.69e0) END)), 2) AS confidence FROM s"


@query("join_dpe_nearest", NEAR_SQL)
def dpe_nearest(spark, d):
    customer, nation = read(spark, d, "customer"), read(spark, d, "nation")
    there = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).selectExpr(*DIAGNOSTICS)
    return nearby.energy_by_point(sales(spark, d), there, 3, 2_000.0, hold)
