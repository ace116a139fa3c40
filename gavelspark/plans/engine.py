"""Queries of valuation, scoring, top-k and incremental semantics, beside the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text
from ..operators import aggregates as agg
from ..operators import scoring, search, states
from ..operators import valuation as val
from ..sources.adapters import MUTATIONS_CTE, SALES_CTE, mutations, read, sales
from .queries import ITEMS, NOW, RENT, half_up, items
from .registry import query

c = F.col
S = f"WITH {SALES_CTE} "
#: The day on which comparables are looked for.
TODAY = "2001-09-01"

# comparables

METRES = "2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians(p.latitude - s.latitude) / 2), 2) + cos(radians(s.latitude)) * cos(radians(p.latitude)) * pow(sin(radians(p.longitude - s.longitude) / 2), 2))))"
PAIRS = S + f", pt AS (SELECT *, starting_price_eur / surface_m2 AS price_m2, greatest(date_diff('day', sale_date, DATE '{TODAY}') / 30.4375e0, 0e0) AS months FROM sales WHERE surface_m2 >= 9 AND starting_price_eur / surface_m2 BETWEEN 500 AND 25000), pairs AS (SELECT * FROM (SELECT s.sale_id, s.surface_m2, p.sale_id AS point_id, p.surface_m2 AS point_surface, p.price_m2, p.months, {METRES} AS distance_m, CASE WHEN s.surface_m2 > 0 THEN (p.surface_m2 - s.surface_m2) / s.surface_m2 * 100 END AS delta_pct FROM sales s JOIN pt p ON s.property_type = p.property_type AND s.sale_id <> p.sale_id AND p.months <= 36 AND p.latitude BETWEEN s.latitude - 0.02e0 AND s.latitude + 0.02e0 AND p.longitude BETWEEN s.longitude - 0.04e0 AND s.longitude + 0.04e0) WHERE distance_m <= 2000)"
ALIKE = "coalesce(surface_m2 > 0 AND point_surface BETWEEN greatest(9, floor(surface_m2 * 0.7e0 + 5e-1)) AND floor(surface_m2 * 1.3e0 + 5e-1), FALSE)"
SCOPES = PAIRS + ", counts AS (SELECT sale_id, " + ", ".join(f"count(*) FILTER ({ALIKE} AND distance_m <= {r}) AS s{r}, count(*) FILTER (distance_m <= {r}) AS a{r}" for r in val.RINGS) + " FROM pairs GROUP BY sale_id), scopes AS (SELECT sale_id, coalesce(" + ", ".join(f"CASE WHEN s{r} >= 4 THEN {r} END" for r in val.RINGS) + ", " + ", ".join(f"CASE WHEN a{r} >= 4 THEN {r} END" for r in val.RINGS) + ", 2000) AS radius_m, CASE WHEN s2000 >= 4 THEN 'surface_matched' WHEN a2000 >= 4 THEN 'nearby_type_only' ELSE 'expanded_fallback' END AS mode FROM counts)"
SCORED = SCOPES + f", sc AS (SELECT p.*, radius_m, mode FROM pairs p JOIN scopes USING (sale_id) WHERE distance_m <= radius_m AND (mode <> 'surface_matched' OR {ALIKE})), q AS (SELECT sale_id, count(*) AS n, quantile_cont(price_m2, 0.25) AS q1, quantile_cont(price_m2, 0.75) AS q3 FROM sc GROUP BY sale_id), mk AS (SELECT sc.*, n, CASE WHEN n >= 7 AND q3 > q1 THEN price_m2 BETWEEN greatest(500e0, q1 - 1.5e0 * (q3 - q1)) AND least(25000e0, q3 + 1.5e0 * (q3 - q1)) ELSE TRUE END AS ins FROM sc JOIN q USING (sale_id)), st AS (SELECT *, count(*) FILTER (ins) OVER (PARTITION BY sale_id) AS stay FROM mk), scored AS (SELECT *, CASE WHEN stay >= 4 THEN n - stay ELSE 0 END AS removed, floor(least(100e0, greatest(0e0, greatest(0e0, 1 - distance_m / radius_m) * 35 + greatest(0e0, 1 - months / 36) * 25 + CASE WHEN delta_pct IS NULL THEN 0.65e0 ELSE greatest(0e0, 1 - abs(delta_pct) / 60) END * 25 + 15)) + 5e-1) AS score FROM st WHERE ins OR stay < 4), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY score DESC, point_id) AS rank FROM scored) WHERE rank <= 12)"


def subjects(spark, d):
    return sales(spark, d).select("sale_id", "property_type", "surface_m2", "latitude", "longitude")


def points(spark, d):
    return sales(spark, d).select(c("sale_id").alias("point_id"), "property_type", c("surface_m2").alias("point_surface"), c("starting_price_eur").alias("point_price"), c("sale_date").alias("point_date"), c("latitude").alias("point_latitude"), c("longitude").alias("point_longitude"))


def top(spark, d):
    return val.comparables(subjects(spark, d), points(spark, d), TODAY)


@query("topk_radius_ladder", SCOPES + " SELECT sale_id, CAST(radius_m AS INTEGER) AS radius_m, mode FROM scopes")
def radius_ladder(spark, d):
    return val.scope(val.candidates(subjects(spark, d), points(spark, d), TODAY))


@query("topk_comparables", SCORED + " SELECT sale_id, point_id, CAST(rank AS INTEGER) AS rank, score, mode FROM top")
def topk_comparables(spark, d):
    return top(spark, d).select("sale_id", "point_id", "rank", "score", "mode")


@query("sc_comp_score", SCORED + " SELECT sale_id, point_id, score FROM scored")
def comp_score(spark, d):
    return val.best(val.without_outliers(val.scoped(subjects(spark, d), points(spark, d), TODAY)), 1 << 30).select("sale_id", "point_id", "score")


@query("sc_confidence_rules", SCORED + f", g AS (SELECT sale_id, count(*) AS n, any_value(mode) AS mode, any_value(radius_m) AS radius_m, any_value(removed) AS removed, avg(floor(months * 10 + 5e-1) / 10) AS age, floor(quantile_cont(floor(price_m2 + 5e-1), 0.25) + 5e-1) AS p25, floor(quantile_cont(floor(price_m2 + 5e-1), 0.5) + 5e-1) AS median, floor(quantile_cont(floor(price_m2 + 5e-1), 0.75) + 5e-1) AS p75, sum(floor(price_m2 + 5e-1) * score) AS ps, sum(score) AS sm FROM top GROUP BY sale_id), v AS (SELECT *, CAST(greatest(0, least(100, 35 + least(35, n * 5) + CASE mode WHEN 'surface_matched' THEN 15 WHEN 'expanded_fallback' THEN -12 ELSE 0 END - CASE WHEN radius_m > 1000 THEN 8 ELSE 0 END - least(10, removed * 2) + CASE WHEN age <= 12 THEN 6 ELSE 0 END - CASE WHEN (p75 - p25) / median > 0.45e0 THEN 14 WHEN (p75 - p25) / median > 0.3e0 THEN 7 ELSE 0 END)) AS BIGINT) AS confidence FROM g) SELECT sale_id, n, mode, median, CASE WHEN sm > 0 THEN floor(ps / sm + 5e-1) END AS weighted, confidence, CASE WHEN confidence >= 78 THEN 'strong' WHEN confidence >= 58 THEN 'fair' ELSE 'weak' END AS label, CASE WHEN n >= 6 AND confidence >= 78 THEN 'detailed' WHEN n >= 4 AND confidence >= 58 THEN 'usable' ELSE 'weak' END AS status FROM v")
def confidence_rules(spark, d):
    return val.confidence(top(spark, d))


@query("sc_comp_score_exp", PAIRS + ", m AS (SELECT *, max(distance_m) OVER (PARTITION BY sale_id) AS far FROM pairs WHERE surface_m2 > 0), e AS (SELECT sale_id, point_id, price_m2, months, exp(-distance_m / greatest(300e0, far * 0.55e0)) * 0.48e0 + exp(-ln(2e0) * months / 24) * 0.22e0 + exp(-abs(ln(point_surface / surface_m2)) / 0.55e0) * 0.3e0 AS s FROM m) SELECT sale_id, point_id, round(s, 6) AS score, round(greatest(0.05e0, s * s), 6) AS weight, round(price_m2 * pow(1.03e0, months / 12), 3) AS adjusted FROM e")
def comp_score_exp(spark, d):
    pairs = val.pairs_with_farthest(subjects(spark, d).where("surface_m2 > 0"), points(spark, d), TODAY)
    s = val.exponential_score(c("distance_m"), c("far"), c("months"), c("point_surface"), c("surface_m2"), F.lit(None).cast("int"))
    return pairs.select("sale_id", "point_id", F.round(s, 6).alias("score"), F.round(val.weight_of(s), 6).alias("weight"), F.round(val.time_adjusted(c("price_m2"), F.lit(0.03), c("months")), 3).alias("adjusted"))


JK = SCORED + ", o AS (SELECT sale_id, point_id, rank, floor(price_m2 + 5e-1) AS v, score / 100e0 AS w FROM top), cum AS (SELECT a.sale_id, a.point_id AS left_out, b.v, b.point_id, sum(b.w) OVER (PARTITION BY a.sale_id, a.point_id ORDER BY b.v, b.point_id) AS upto, sum(b.w) OVER (PARTITION BY a.sale_id, a.point_id) AS total FROM o a JOIN o b ON a.sale_id = b.sale_id AND a.point_id <> b.point_id), loo AS (SELECT sale_id, left_out, arg_min(v, (v, point_id)) AS p FROM cum WHERE upto >= total * 5e-1 GROUP BY ALL), res AS (SELECT sale_id, abs(ln(o.v / p)) AS r FROM o JOIN loo USING (sale_id) WHERE o.point_id = left_out), n AS (SELECT sale_id, count(*) AS n FROM o GROUP BY sale_id), rq AS (SELECT sale_id, count(*) AS k, quantile_cont(r, 0.8) AS q FROM res JOIN n USING (sale_id) WHERE n >= 4 GROUP BY sale_id), whole AS (SELECT sale_id, v, point_id, sum(w) OVER (PARTITION BY sale_id ORDER BY v, point_id) AS upto, sum(w) OVER (PARTITION BY sale_id) AS total FROM o), med AS (SELECT sale_id, arg_min(v, (v, point_id)) AS median FROM whole WHERE upto >= total * 5e-1 GROUP BY sale_id)"


@query("agg_jackknife", JK + " SELECT sale_id, n, median, round(CASE WHEN k >= 6 THEN greatest(q, ln(1.08e0)) ELSE CASE property_type WHEN 'apartment' THEN ln(1.16e0) WHEN 'house' THEN ln(1.2e0) WHEN 'building' THEN ln(1.25e0) WHEN 'commercial' THEN ln(1.28e0) ELSE ln(1.3e0) END END, 6) AS expansion, CASE WHEN k >= 6 THEN 'local_jackknife' ELSE 'segment_fallback' END AS method FROM n JOIN med USING (sale_id) JOIN sales USING (sale_id) LEFT JOIN rq USING (sale_id)")
def jackknife(spark, d):
    return val.jackknife(top(spark, d), "sale_id", num.round_half_up(c("price_m2")), c("score") / 100.0, c("point_id"), c("property_type"))


@query("agg_backtest_summary", SCORED + f", p AS (SELECT t.sale_id, quantile_cont(price_m2, 0.5) AS predicted, min(price_m2) AS low, max(price_m2) AS high, any_value(s.starting_price_eur / s.surface_m2) AS actual FROM top t JOIN sales s USING (sale_id) WHERE s.surface_m2 > 0 AND s.starting_price_eur > 0 GROUP BY t.sale_id), a AS (SELECT abs(predicted - actual) / actual * 100 AS ape, actual BETWEEN low AND high AS hit FROM p), g AS (SELECT count(*) AS tests, {half_up('quantile_cont(ape, 0.5)')} AS median_ape, {half_up('quantile_cont(ape, 0.75)')} AS p75_ape, {half_up('avg(ape)')} AS mape, {half_up('avg(CASE WHEN ape <= 10 THEN 1e0 ELSE 0e0 END) * 100')} AS within10, {half_up('avg(CASE WHEN ape <= 20 THEN 1e0 ELSE 0e0 END) * 100')} AS within20, {half_up('avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) * 100')} AS coverage FROM a) SELECT *, CASE WHEN tests >= 10 AND median_ape <= 12 AND coverage >= 72 THEN 'strong' WHEN tests >= 6 AND median_ape <= 20 AND coverage >= 65 THEN 'usable' ELSE 'weak' END AS status FROM g")
def backtest_summary(spark, d):
    actual = sales(spark, d).where("surface_m2 > 0 AND starting_price_eur > 0").select("sale_id", (c("starting_price_eur") / c("surface_m2")).alias("actual"))
    predicted = top(spark, d).groupBy("sale_id").agg(F.percentile("price_m2", 0.5).alias("predicted"), F.min("price_m2").alias("low"), F.max("price_m2").alias("high"))
    return val.backtest_summary(predicted.join(actual, "sale_id"))


CELLS = {i: f"floor(latitude / {s!r}) AS y{i}, floor(longitude / {s!r}) AS x{i}" for i, s in enumerate((0.02, 0.1, 0.5))}


@query("join_cell_stats", S + ", p AS (SELECT sale_id, ln(starting_price_eur) AS t, latitude, longitude, " + ", ".join(CELLS.values()) + " FROM sales WHERE starting_price_eur > 0), " + ", ".join(f"c{i} AS (SELECT y{i}, x{i}, count(*) AS n, sum(t) AS s, stddev_samp(t) AS d FROM p WHERE y{i} IS NOT NULL GROUP BY ALL)" for i in CELLS) + ", w AS (SELECT avg(t) AS gm, greatest(0.05e0, stddev_samp(t) * 2.563e0) AS gs FROM p) SELECT sale_id, round(coalesce(" + ", ".join(f"CASE WHEN c{i}.n - 1 >= 5 THEN (c{i}.s - t) / (c{i}.n - 1) END" for i in CELLS) + ", gm), 6) AS local_mean, round(coalesce(" + ", ".join(f"CASE WHEN c{i}.n - 1 >= 5 THEN greatest(0.05e0, c{i}.d * 2.563e0) END" for i in CELLS) + ", gs), 6) AS local_spread, CAST(coalesce(" + ", ".join(f"CASE WHEN c{i}.n - 1 >= 5 THEN c{i}.n - 1 END" for i in CELLS) + ", 0) AS BIGINT) AS local_count FROM p CROSS JOIN w " + " ".join(f"LEFT JOIN c{i} ON p.y{i} = c{i}.y{i} AND p.x{i} = c{i}.x{i}" for i in CELLS))
def cell_stats(spark, d):
    cells = [(F.floor(c("latitude") / s), F.floor(c("longitude") / s)) for s in (0.02, 0.1, 0.5)]
    rows = val.local_features(sales(spark, d).where("starting_price_eur > 0").select("sale_id", "starting_price_eur", "latitude", "longitude"), F.ln("starting_price_eur"), cells)
    return rows.select("sale_id", F.round("local_mean", 6).alias("local_mean"), F.round("local_spread", 6).alias("local_spread"), c("local_count").cast("bigint").alias("local_count"))


@query("agg_mutation_ts", f"WITH {MUTATIONS_CTE}, g AS (SELECT mutation_id, count(*) FILTER (built_m2 > 0) AS units, count(*) FILTER (built_m2 > 0 AND type_code IN (1, 2)) AS homes, count(*) FILTER (built_m2 > 0 AND type_code = 4) AS shops, any_value(price_eur) AS price_eur, CAST(sum(built_m2) AS BIGINT) AS built_m2 FROM mutations GROUP BY mutation_id) SELECT mutation_id, price_eur, built_m2, CASE WHEN units = 1 AND homes = 1 THEN 'home' WHEN homes >= 2 AND shops = 0 THEN 'building' WHEN units = 0 THEN 'land' ELSE 'other' END AS kind FROM g")
def mutation_ts(spark, d):
    return agg.mutation_kinds(mutations(spark, d))


@query("agg_parking_estimate", S + f", p AS (SELECT city, ln(starting_price_eur) AS l FROM sales WHERE property_type = 'parking' AND starting_price_eur > 0), q AS (SELECT city, count(*) AS n, quantile_cont(l, 0.25) AS a, quantile_cont(l, 0.75) AS b FROM p GROUP BY city), k AS (SELECT city, exp(l) AS v FROM p JOIN q USING (city) WHERE n < 8 OR b <= a OR l BETWEEN a - 1.5e0 * (b - a) AND b + 1.5e0 * (b - a)), g AS (SELECT city, count(*) AS n, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.9) AS p90 FROM k GROUP BY city HAVING count(*) >= 8) SELECT city, n, floor(greatest(1000e0, least(p10, 0.5e0 * m)) / 500 + 5e-1) * 500 AS low, floor(m / 500 + 5e-1) * 500 AS mid, floor(greatest(p90, 1.8e0 * m) / 500 + 5e-1) * 500 AS high, greatest(28e0, least(64e0, floor(32 + 18 * log10(n + 1) + 5e-1))) AS quality FROM g")
def parking_estimate(spark, d):
    return agg.parking_estimates(sales(spark, d).where("property_type = 'parking'"), "city", c("starting_price_eur"))


# scores

PRIME, SECOND = ["NATION_1", "NATION_6", "NATION_7"], ["NATION_2", "NATION_3", "NATION_8"]
BAND = lambda i: "CASE department WHEN '33' THEN {} WHEN '64' THEN {} ELSE {} END".format(scoring.BANDS["33"][i], scoring.BANDS["64"][i], scoring.OTHER_BAND[i])
M2 = "starting_price_eur / surface_m2"
POINTS = {
    "occupation": "CASE occupancy_status WHEN 'vacant' THEN 12 WHEN 'rented' THEN 3 WHEN 'occupied' THEN -10 WHEN 'owner_occupied' THEN -8 WHEN 'squatted' THEN -18 ELSE -3 END",
    "condition": "CASE WHEN sale_id % 8 >= 5 THEN -14 WHEN sale_id % 8 > 0 THEN -6 ELSE 0 END",
    "type": "CASE property_type WHEN 'apartment' THEN 5 WHEN 'house' THEN 4 WHEN 'building' THEN 6 WHEN 'commercial' THEN -2 WHEN 'land' THEN -3 WHEN 'parking' THEN 1 ELSE -2 END",
    "location": "CASE WHEN city IN ('NATION_1', 'NATION_6', 'NATION_7') THEN 8 WHEN city IN ('NATION_2', 'NATION_3', 'NATION_8') THEN 4 WHEN tribunal_code IS NOT NULL THEN 3 ELSE -2 END",
    "surface": "CASE WHEN surface_m2 IS NULL THEN CASE WHEN contains(quality_flags, 'ambiguous_surface') THEN -8 ELSE -6 END WHEN surface_m2 BETWEEN 25 AND 160 THEN 6 WHEN surface_m2 < 15 THEN -5 ELSE 1 END",
    "price_m2": f"CASE WHEN coalesce(surface_m2, 0) = 0 THEN -4 WHEN coalesce(starting_price_eur, 0) = 0 THEN -2 WHEN {M2} < {BAND(0)} THEN 12 WHEN {M2} < {BAND(1)} THEN 6 WHEN {M2} > {BAND(2)} THEN -8 ELSE 0 END",
    "amenities": "CASE WHEN has_garden THEN 3 ELSE 0 END",
    "risks": "-least(18, sale_id % 23)",
    "quality": "-least(18, CASE WHEN contains(quality_flags, 'ambiguous_surface') THEN 5 ELSE 0 END + CASE WHEN contains(quality_flags, 'low_confidence_extraction') THEN 4 ELSE 0 END + CASE WHEN contains(quality_flags, 'missing_gps') THEN 3 ELSE 0 END + CASE WHEN documents_count = 0 THEN 6 ELSE 0 END + CASE WHEN rooms_count IS NULL THEN 2 ELSE 0 END + CASE WHEN bedrooms_count IS NULL AND property_type IN ('apartment', 'house') THEN 2 ELSE 0 END + CASE WHEN occupancy_status IS NULL THEN 3 ELSE 0 END)",
}
PARTS = S + f", f AS (SELECT sale_id, {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in POINTS.items())} FROM sales)"


def scorable(spark, d):
    return sales(spark, d).withColumns({"works_severity": c("sale_id") % 8, "risk_severity": c("sale_id") % 23})


@query("sc_score9", PARTS + f" SELECT *, CAST(greatest(0, least(100, 50 + {' + '.join(POINTS)})) AS BIGINT) AS score FROM f")
def score9(spark, d):
    return scoring.score(scorable(spark, d), PRIME, SECOND)


@query("win_score_waterfall", PARTS + " UNION ALL ".join(f" SELECT sale_id, CAST({i} AS INTEGER) AS factor_order, '{n}' AS factor, CAST(50 + {' + '.join(['0', *list(POINTS)[:i]])} AS BIGINT) AS score_before, {n} AS delta, CAST(50 + {' + '.join(list(POINTS)[: i + 1])} AS BIGINT) AS score_after FROM f" for i, n in enumerate(POINTS)))
def waterfall(spark, d):
    return scoring.waterfall(scorable(spark, d), PRIME, SECOND)


@query("sc_score_confidence", S + "SELECT sale_id, floor(greatest(0e0, least(100e0, (CASE WHEN occupancy_status IS NOT NULL THEN 85 ELSE 45 END + CASE WHEN property_type IS NULL THEN 45 ELSE 82 END + CASE WHEN tribunal_code IS NOT NULL THEN 55 ELSE 35 END + CASE WHEN documents_count > 0 THEN 50 ELSE 25 END + CASE WHEN has_garden THEN 75 ELSE 55 END) / 5e0 - (CASE WHEN contains(quality_flags, 'ambiguous_surface') THEN 12 ELSE 0 END + CASE WHEN contains(quality_flags, 'low_confidence_extraction') THEN 10 ELSE 0 END + CASE WHEN documents_count > 0 THEN 0 ELSE 14 END + CASE WHEN surface_m2 IS NULL THEN 12 ELSE 0 END + CASE WHEN occupancy_status IS NULL THEN 6 ELSE 0 END))) + 5e-1) / 100 AS confidence FROM sales")
def score_confidence(spark, d):
    return sales(spark, d).select("sale_id", scoring.confidence().alias("confidence"))


# money

RENTED = S + f", b AS (SELECT sale_id, CAST(starting_price_eur AS DOUBLE) AS p, surface_m2 * {RENT.format('department')} AS rent FROM sales WHERE starting_price_eur > 0 AND surface_m2 > 0), t AS (SELECT *, p + (least(p, 6500) * 0.07e0 + greatest(least(p, 17000) - 6500, 0) * 0.0385e0 + greatest(least(p, 30000) - 17000, 0) * 0.0275e0 + greatest(p - 30000, 0) * 0.015e0) * 1.2e0 + p * 0.058e0 + 3000 AS total FROM b), y AS (SELECT *, rent * 12 AS gross, rent * 12 * (1 - 0.05e0 - 0.165e0) AS net, total * 0.8e0 AS loan FROM t), k AS (SELECT *, (loan * 0.0035e0 / (1 - pow(1.0035e0, -240)) + loan * 0.0025e0 / 12) * 12 AS debt FROM y), r AS (SELECT *, gross / total * 100 AS gy, net / total * 100 AS ny, (net - debt) / 12 AS cash, (gross * 0.165e0 + debt) / gross * 100 AS be FROM k)"
STEP = "CASE WHEN {0} - {1} >= 2 THEN 16 WHEN {0} - {1} >= 0 THEN 10 WHEN {0} - {1} >= -1 THEN 4 ELSE -12 END"


@query("sc_rentability", RENTED + f" SELECT sale_id, {half_up('gy')} AS gross_yield, {half_up('ny')} AS net_yield, floor(cash + 5e-1) AS cashflow, {half_up('be')} AS break_even, CAST(greatest(0, least(100, 50 + {STEP.format('gy', '6.5e0')} + {STEP.format('ny', '4.5e0')} + CASE WHEN cash >= 300 THEN 14 WHEN cash >= 0 THEN 8 WHEN cash >= -150 THEN -6 ELSE -14 END + CASE WHEN be <= 80 THEN 8 WHEN be <= 92 THEN 2 WHEN be <= 100 THEN -4 ELSE -12 END - 4)) AS BIGINT) AS score FROM r")
def rentability(spark, d):
    rows = sales(spark, d).where("starting_price_eur > 0 AND surface_m2 > 0")
    return num.rentability(rows, c("starting_price_eur").cast("double"), c("surface_m2") * num.rent_m2(c("department"))).select("sale_id", "gross_yield", "net_yield", "cashflow", "break_even", "score")


@query("sc_surface_resolve", S + "SELECT sale_id, coalesce(CASE WHEN surface_m2 > 0 THEN surface_m2 END, CASE WHEN rooms_count <= 1 AND property_type = 'apartment' THEN 20 END) AS surface, CAST(CASE WHEN property_type = 'land' THEN NULL WHEN surface_m2 >= 9 THEN surface_m2 WHEN property_type = 'apartment' THEN CASE WHEN coalesce(rooms_count, bedrooms_count + 1) IS NULL THEN 50 ELSE list_extract([20, 42, 62, 82, 105], CAST(least(5, greatest(1, coalesce(rooms_count, bedrooms_count + 1))) AS INTEGER)) + greatest(0, coalesce(rooms_count, bedrooms_count + 1) - 5) * 20 END WHEN property_type = 'house' THEN CASE WHEN coalesce(rooms_count, bedrooms_count + 1) IS NULL THEN 100 ELSE list_extract([45, 60, 80, 100, 120], CAST(least(5, greatest(1, coalesce(rooms_count, bedrooms_count + 1))) AS INTEGER)) + greatest(0, coalesce(rooms_count, bedrooms_count + 1) - 5) * 22 END WHEN property_type IN ('building', 'commercial') THEN CASE WHEN coalesce(rooms_count, bedrooms_count + 1) IS NULL THEN CASE property_type WHEN 'building' THEN 250 ELSE 80 END ELSE greatest(1, coalesce(rooms_count, bedrooms_count + 1)) * 28 END END AS BIGINT) AS built FROM (SELECT * REPLACE (CASE WHEN rooms_count > 0 THEN rooms_count END AS rooms_count, CASE WHEN bedrooms_count > 0 THEN bedrooms_count END AS bedrooms_count) FROM sales)")
def surface_resolve(spark, d):
    rows = sales(spark, d)
    surface, built = num.resolved_surface(c("property_type"), c("surface_m2"), c("rooms_count"), c("bedrooms_count"))
    return rows.select("sale_id", surface.alias("surface"), built.cast("bigint").alias("built"))


CEILINGS = {"prudent": (0.75, 8), "central": (1.0, 6), "offensive": (1.0, 4)}


@query("sc_ceiling")
def ceiling(spark, d):
    """For each scenario the highest bid whose total cost stays below the market value less a safety margin."""
    value = c("surface_m2") * 1800.0
    rows = sales(spark, d).where("surface_m2 > 0")
    scenarios = F.array(*(F.struct(F.lit(k).alias("scenario"), num.max_bid(value * f * (1 - s / 100)).alias("max_bid")) for k, (f, s) in CEILINGS.items()))
    return rows.select("sale_id", F.inline(scenarios))


# top-k


@query("topk_scopes", S + ", s AS (SELECT city, department, region, property_type, count(*) AS n FROM sales GROUP BY ALL), a AS (SELECT city, property_type, sum(n) AS n FROM s GROUP BY ALL), r AS (SELECT region, property_type, sum(n) AS n FROM s GROUP BY ALL) SELECT sale_id, CASE WHEN a.n >= 60 THEN 'city' WHEN r.n >= 5 THEN 'region' ELSE 'all' END AS scope, CAST(CASE WHEN a.n >= 60 THEN a.n WHEN r.n >= 5 THEN r.n ELSE (SELECT count(*) FROM sales) END AS BIGINT) AS n FROM sales LEFT JOIN a USING (city, property_type) LEFT JOIN r USING (region, property_type)")
def scopes(spark, d):
    return agg.first_scope(sales(spark, d), "sale_id", [("city", ["city", "property_type"], 60), ("region", ["region", "property_type"], 5)])


@query("topk_due", f"SELECT event_id, ts FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 100")
def due(spark, d):
    late = read(spark, d, "events").where("event_type = 'error' AND ts <= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return late.orderBy("ts", "event_id").limit(100).select("event_id", "ts")


@query("topk_audience", S + f", p AS (SELECT sale_id, city, sale_date, date_diff('day', DATE '{NOW}', sale_date) AS days FROM sales WHERE status = 'upcoming'), q AS (SELECT *, CASE WHEN days BETWEEN 0 AND 7 THEN 900 ELSE 0 END + CASE WHEN days >= 0 THEN greatest(0, 60 - days) ELSE 0 END + least(120, sale_id % 14 * 12) AS priority FROM p) SELECT sale_id, CAST(priority AS BIGINT) AS priority FROM q ORDER BY priority DESC, sale_date, city, sale_id LIMIT 50")
def audience(spark, d):
    days = F.datediff("sale_date", F.lit(NOW))
    p = F.when(days.between(0, 7), 900).otherwise(0) + F.when(days >= 0, F.greatest(F.lit(0), 60 - days)).otherwise(0) + F.least(F.lit(120), c("sale_id") % 14 * 12)
    rows = sales(spark, d).where("status = 'upcoming'").withColumn("priority", p.cast("bigint"))
    return rows.orderBy(F.desc("priority"), "sale_date", "city", "sale_id").limit(50).select("sale_id", "priority")


@query("topk_pdf_targets", S + "SELECT sale_id FROM sales WHERE documents_count > 0 ORDER BY CASE WHEN starting_price_eur < 1000 THEN 0 ELSE 1 END, 3 - documents_count, CASE status WHEN 'upcoming' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, sale_date, source_url, sale_id LIMIT 200")
def pdf_targets(spark, d):
    key = [F.when(c("starting_price_eur") < 1000, 0).otherwise(1), 3 - c("documents_count"), F.when(c("status") == "upcoming", 0).when(c("status") == "unknown", 1).otherwise(2), c("sale_date"), c("source_url"), c("sale_id")]
    return sales(spark, d).where("documents_count > 0").orderBy(*key).limit(200).select("sale_id")


@query("topk_documents", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def documents(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("k", F.row_number().over(w)).where("k <= 3").select("source", "doc_id")


@query("srt_client", S + "SELECT sale_id FROM sales ORDER BY coalesce(bedrooms_count, rooms_count) DESC NULLS LAST, sale_id LIMIT 300")
def srt_client(spark, d):
    return sales(spark, d).orderBy(F.coalesce("bedrooms_count", "rooms_count").desc_nulls_last(), "sale_id").limit(300).select("sale_id")


# states


@query("st_rate_window", "SELECT user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS calls, count(*) <= 1 AS allowed FROM events GROUP BY ALL")
def rate_window(spark, d):
    return states.rate_windows(read(spark, d, "events"), 3600, 1, ["user_id", "event_type"])


@query("st_month_window", "SELECT *, round(greatest(0e0, 3000 - used), 2) AS left, used >= 3000 AS reached FROM (SELECT user_id, strftime(ts, '%Y-%m') AS month, round(sum(value), 2) AS used FROM events GROUP BY ALL)")
def month_window(spark, d):
    return states.month_usage(read(spark, d, "events"), "user_id", c("value"), 3000.0)


@query("agg_usage_month", "SELECT user_id, round(sum(value), 2) AS used FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY user_id")
def usage_month(spark, d):
    inside = read(spark, d, "events").where("event_type = 'click' AND ts >= TIMESTAMP_NTZ '2024-01-01 00:00:00' AND ts < TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    return inside.groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("used"))


RUNS = "SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'succeeded' END AS status FROM events"


@query("st_stale_runs", f"WITH r AS ({RUNS}) SELECT event_id, CASE WHEN status = 'running' AND date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') > 190 * 60 THEN 'failed' ELSE status END AS status FROM r")
def stale_runs(spark, d):
    status = F.when(c("event_type") == "error", "failed").when(c("event_type") == "view", "running").otherwise("succeeded")
    runs = read(spark, d, "events").select("event_id", "ts", status.alias("status"))
    return states.stale_runs(runs, F.lit("2024-01-20 00:00:00"), 190).select("event_id", "status")


@query("st_staleness", "SELECT event_type, max(ts) AS last, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') > 3600 AS stale FROM events GROUP BY event_type")
def staleness(spark, d):
    seconds = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(c("last").cast("timestamp"))
    return read(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last")).withColumn("stale", seconds > 3600)


@query("st_retention", "SELECT event_type, count(*) FILTER (k) AS purged, count(*) FILTER (NOT k) AS kept FROM (SELECT event_type, coalesce(CASE event_type WHEN 'click' THEN date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') > 10 WHEN 'view' THEN date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') > 20 END, FALSE) AS k FROM events) GROUP BY event_type")
def retention(spark, d):
    return states.retention(read(spark, d, "events"), "event_type", F.to_date("ts"), F.lit("2024-02-01").cast("date"), {"click": 10, "view": 20})


@query("st_alert_state", "WITH e AS (SELECT *, value > 60 AS bad, CASE WHEN value > 60 THEN CASE WHEN value > 120 THEN 'critical' ELSE 'warning' END END AS sev FROM events), f AS (SELECT *, coalesce(lag(bad) OVER w, FALSE) AS was, lag(sev) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN bad AND NOT was THEN 'opened' WHEN bad THEN 'updated' ELSE 'resolved' END AS action, (bad AND NOT was) OR (bad AND sev IS DISTINCT FROM before) AS notify FROM f WHERE bad OR was")
def alert_state(spark, d):
    return states.alert_episodes(read(spark, d, "events"), "user_id", ["ts", "event_id"], c("value") > 60, F.when(c("value") > 120, "critical").otherwise("warning")).select("event_id", "action", "notify")


@query("st_event_watermark", "WITH n AS (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'), t AS (SELECT ts, coalesce(sum(count(*)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n GROUP BY ts) SELECT event_id FROM n JOIN t USING (ts) WHERE b < 500")
def event_watermark(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return states.up_to_watermark(read(spark, d, "events"), at("2024-01-05 00:00:00"), at("2024-01-25 00:00:00"), 500).select("event_id")


@query("st_incremental_skip", S + "SELECT sale_id FROM sales WHERE source_url NOT IN (SELECT source_url FROM sales WHERE status = 'adjudicated')")
def incremental_skip(spark, d):
    rows = sales(spark, d)
    return states.skip_known(rows, rows.where("status = 'adjudicated'"), "source_url").select("sale_id")


@query("st_hydrate_known", S + ", k AS (SELECT source_url, max(rooms_count) AS r, max(dpe_class) AS e FROM sales GROUP BY source_url) SELECT sale_id, coalesce(rooms_count, r) AS rooms_count, coalesce(dpe_class, e) AS dpe_class FROM sales JOIN k USING (source_url)")
def hydrate_known(spark, d):
    rows = sales(spark, d)
    known = rows.groupBy("source_url").agg(F.max("rooms_count").alias("rooms_count"), F.max("dpe_class").alias("dpe_class"))
    return states.hydrate(rows, known, "source_url", ["rooms_count", "dpe_class"]).select("sale_id", "rooms_count", "dpe_class")


@query("st_supersession", "WITH v AS (SELECT event_id AS version_id, CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS supersedes_id, user_id AS record_id, event_type FROM events) SELECT version_id FROM v WHERE version_id NOT IN (SELECT supersedes_id FROM v WHERE supersedes_id IS NOT NULL) AND record_id NOT IN (SELECT record_id FROM v WHERE event_type = 'error' AND version_id % 10 = 0)")
def supersession(spark, d):
    v = read(spark, d, "events").selectExpr("event_id AS version_id", "CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS supersedes_id", "user_id AS record_id", "event_type")
    return states.current_versions(v, v.where("event_type = 'error' AND version_id % 10 = 0")).select("version_id")


@query("st_snapshot_changes", S + ", b AS (SELECT *, sale_id + 0 AS k FROM sales) SELECT sale_id, concat_ws(',', CASE WHEN sale_id % 3 = 0 THEN 'price' END, CASE WHEN sale_id % 5 = 0 THEN 'status' END) AS changed FROM b WHERE (sale_id % 3 = 0 AND starting_price_eur IS NOT NULL) OR sale_id % 5 = 0".replace("CASE WHEN sale_id % 3 = 0 THEN", "CASE WHEN sale_id % 3 = 0 AND starting_price_eur IS NOT NULL THEN"))
def snapshot_changes(spark, d):
    now = sales(spark, d).select("sale_id", c("starting_price_eur").alias("price"), "status")
    before = now.select("sale_id", F.when(c("sale_id") % 3 == 0, c("price") + 1).otherwise(c("price")).alias("price"), F.when(c("sale_id") % 5 == 0, "other").otherwise(c("status")).alias("status"))
    return states.snapshot_changes(before, now, "sale_id", ["price", "status"])


@query("sc_change_rules", S + f"SELECT sale_id, concat_ws(',', CASE WHEN sale_id % 3 = 0 AND starting_price_eur IS NOT NULL THEN 'price_changed:important' END, CASE WHEN sale_id % 4 = 0 THEN 'audience_changed:' || CASE WHEN date_diff('day', DATE '{NOW}', sale_date) <= 14 THEN 'urgent' ELSE 'important' END END, CASE WHEN sale_id % 5 = 0 THEN 'status_changed:' || CASE WHEN contains(status, 'adjud') THEN 'urgent' ELSE 'important' END END, CASE WHEN sale_id % 7 = 0 AND investment_score IS NOT NULL THEN 'score_changed:' || CASE WHEN sale_id % 12 >= 10 THEN 'important' ELSE 'info' END END) AS events FROM sales WHERE (sale_id % 3 = 0 AND starting_price_eur IS NOT NULL) OR sale_id % 4 = 0 OR sale_id % 5 = 0 OR (sale_id % 7 = 0 AND investment_score IS NOT NULL AND sale_id % 12 >= 5)".replace("WHEN sale_id % 7 = 0 AND investment_score IS NOT NULL THEN", "WHEN sale_id % 7 = 0 AND investment_score IS NOT NULL AND sale_id % 12 >= 5 THEN"))
def change_rules(spark, d):
    now = sales(spark, d).select("sale_id", c("starting_price_eur").alias("price"), "sale_date", "status", c("investment_score").alias("score"))
    was = {"price": F.when(c("sale_id") % 3 == 0, c("price") + 1).otherwise(c("price")), "sale_date": F.when(c("sale_id") % 4 == 0, F.date_add("sale_date", 9)).otherwise(c("sale_date")), "status": F.when(c("sale_id") % 5 == 0, "other").otherwise(c("status")), "score": F.when(c("sale_id") % 7 == 0, c("score") + c("sale_id") % 12).otherwise(c("score"))}
    pairs = now.select("*", *(e.alias(f"before_{n}") for n, e in was.items()))
    return pairs.select("sale_id", states.change_events(NOW).alias("events")).where("events <> ''")


@query("st_integrity", S + "SELECT sale_id, 'cutoff_before_hearing' AS rule FROM sales WHERE created_at > sale_date - 5 UNION ALL SELECT sale_id, 'positive_price' FROM sales WHERE starting_price_eur <= 1000")
def integrity(spark, d):
    return states.violations(sales(spark, d), {"cutoff_before_hearing": c("created_at") <= F.date_sub("sale_date", 5), "positive_price": c("starting_price_eur") > 1000}).select("sale_id", "rule")


@query("st_bridge", "SELECT count(*) AS scanned, count(*) FILTER (o_orderkey IS NULL) AS created, count(o_orderkey) AS reused FROM (SELECT DISTINCT event_id FROM events) LEFT JOIN orders ON o_orderkey = event_id")
def bridge(spark, d):
    return states.bridge(read(spark, d, "events").select(c("event_id").alias("k")), read(spark, d, "orders").select(c("o_orderkey").alias("k")), "k")


@query("snk_upsert", S + ", b AS (SELECT * REPLACE ('sold' AS status) FROM sales WHERE sale_id % 3 = 0) SELECT sale_id, CASE WHEN sale_id % 3 = 0 THEN 'sold' ELSE status END AS status FROM sales")
def snk_upsert(spark, d):
    rows = sales(spark, d).select("sale_id", "status", "sale_date")
    batch = rows.where("sale_id % 3 = 0").withColumn("status", F.lit("sold"))
    return states.upsert(rows, batch, "sale_id", "sale_date").select("sale_id", "status")


@query("snk_map_geojson", S + "SELECT sale_id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || CAST(CAST(round(longitude * 1000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(latitude * 1000) AS BIGINT) AS VARCHAR) || ']},\"properties\":{\"id\":' || sale_id || ',\"status\":\"' || status || '\"}}' AS feature FROM sales WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def map_geojson(spark, d):
    milli = lambda x: F.round(c(x) * 1000).cast("bigint")
    rows = sales(spark, d).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    return rows.select("sale_id", text.geojson_point(milli("longitude"), milli("latitude"), F.struct(c("sale_id").alias("id"), "status")).alias("feature"))


@query("src_stats_csv", "WITH s AS (SELECT n_name AS label, CAST(n_nationkey AS VARCHAR) AS code, count(*) FILTER (c_mktsegment = 'BUILDING') AS nb_apt, CAST(median(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS DOUBLE) AS med_apt, count(*) FILTER (c_mktsegment = 'MACHINERY') AS nb_house, CAST(median(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS DOUBLE) AS med_house FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) SELECT code, label, 'apartment' AS segment, nb_apt AS sales_count, round(med_apt, 4) AS median_price_m2 FROM s WHERE nb_apt > 0 AND med_apt > 0 UNION ALL SELECT code, label, 'house', nb_house, round(med_house, 4) FROM s WHERE nb_house > 0 AND med_house > 0")
def stats_csv(spark, d):
    from ..sources import files

    wide = read(spark, d, "nation").join(read(spark, d, "customer"), c("c_nationkey") == c("n_nationkey")).groupBy(c("n_name").alias("label"), c("n_nationkey").cast("string").alias("code"))
    of = lambda seg: F.when(c("c_mktsegment") == seg, c("c_acctbal"))
    wide = wide.agg(F.count(of("BUILDING")).cast("string").alias("nb_apt"), F.median(of("BUILDING")).cast("string").alias("med_apt"), F.count(of("MACHINERY")).cast("string").alias("nb_house"), F.median(of("MACHINERY")).cast("string").alias("med_house"))
    return files.statistics(wide, {"apartment": ("nb_apt", "med_apt"), "house": ("nb_house", "med_house")}).withColumn("median_price_m2", F.round("median_price_m2", 4))
