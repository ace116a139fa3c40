"""Queries of training frames and models, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, training
from ..sources.adapters import MUTATIONS_CTE, SALES_CTE, mutations, sales
from ..storage import hold
from .registry import query

c = F.col

#: Register rows as files have them: text, some of it no number or date.
RAW = ["mutation_id", "line_no", "CASE WHEN mutation_id % 29 = 0 THEN 'inconnue' ELSE CAST(sale_date AS STRING) END AS sale_date", "CASE WHEN mutation_id % 31 = 0 THEN 'n/a' ELSE CAST(price_eur AS STRING) END AS total_price_eur", "CAST(built_m2 AS STRING) AS built_surface_m2", "CAST(land_m2 AS STRING) AS land_surface_m2", "CAST(lots_count AS STRING) AS rooms_count", "latitude", "longitude", "CASE type_code WHEN 1 THEN '111' WHEN 2 THEN '121' WHEN 3 THEN '' ELSE '141' END AS type_code", "CASE WHEN type_code = 3 THEN CASE mutation_id % 3 WHEN 0 THEN 'Terrain a batir' WHEN 1 THEN 'Immeuble entier' END END AS property_type"]
RAW_CTE = f"WITH {MUTATIONS_CTE}, raw AS (SELECT {', '.join(RAW)} FROM mutations)".replace("AS STRING", "AS VARCHAR")
PREPARED = RAW_CTE + """, seg AS (SELECT mutation_id, line_no, TRY_CAST(sale_date AS DATE) AS sale_date, latitude, longitude, TRY_CAST(total_price_eur AS DOUBLE) AS price, TRY_CAST(built_surface_m2 AS DOUBLE) AS built, TRY_CAST(land_surface_m2 AS DOUBLE) AS land,
  CASE type_code WHEN '121' THEN 'apartment' WHEN '111' THEN 'house' WHEN '141' THEN 'commercial' ELSE CASE WHEN property_type LIKE 'Immeuble%' THEN 'building' WHEN property_type LIKE 'Terrain%' THEN 'land' END END AS segment FROM raw),
 sized AS (SELECT *, CASE WHEN segment = 'land' THEN land ELSE built END AS surface_m2 FROM seg), prepared AS (SELECT *, price / surface_m2 AS target FROM sized WHERE sale_date IS NOT NULL AND segment IS NOT NULL AND surface_m2 > 0 AND price > 0 AND CASE WHEN segment = 'land' THEN price / surface_m2 BETWEEN 1 AND 100000 ELSE price / surface_m2 BETWEEN 300 AND 50000 AND surface_m2 >= 9 END)"""


@query("ml_prepare", PREPARED + " SELECT mutation_id, line_no, sale_date, segment, surface_m2, round(target, 4) AS target_price_per_m2 FROM prepared")
def prepared(spark, d):
    rows = training.prepare(mutations(spark, d).selectExpr(*RAW))
    return rows.select("mutation_id", "line_no", "sale_date", "segment", "surface_m2", F.round("target_price_per_m2", 4).alias("target_price_per_m2"))


@query(
    "ml_train_quantile",
    PREPARED + """, y AS (SELECT segment, sale_date, CAST(floor(latitude * 10) AS BIGINT) AS cell, round(ln(target), 3) AS y FROM prepared), days AS (SELECT segment, sale_date, (sum(count(*)) OVER (PARTITION BY segment ORDER BY sale_date) - count(*)) / CAST(sum(count(*)) OVER (PARTITION BY segment) AS DOUBLE) AS share FROM y GROUP BY segment, sale_date),
 r AS (SELECT *, CASE WHEN share < 0.7e0 THEN 'train' WHEN share < 0.7e0 + 0.15e0 THEN 'calibration' ELSE 'test' END AS part FROM y JOIN days USING (segment, sale_date)),
 cq AS (SELECT segment, cell, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.9) AS q90 FROM r WHERE part = 'train' GROUP BY segment, cell), sq AS (SELECT segment, quantile_cont(y, 0.1) AS s10, quantile_cont(y, 0.9) AS s90 FROM r WHERE part = 'train' GROUP BY segment),
 e AS (SELECT segment, part, round(coalesce(q10, s10) - y, 6) AS lo, round(y - coalesce(q90, s90), 6) AS hi FROM r LEFT JOIN cq USING (segment, cell) JOIN sq USING (segment) WHERE part <> 'train'),
 k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY lo) AS a, row_number() OVER (PARTITION BY segment ORDER BY hi) AS b, count(*) OVER (PARTITION BY segment) AS n FROM e WHERE part = 'calibration'),
 fix AS (SELECT segment, greatest(0, min(lo) FILTER (a = least(n, ceil((n + 1) * 0.9e0)))) AS lower, greatest(0, min(hi) FILTER (b = least(n, ceil((n + 1) * 0.9e0)))) AS upper FROM k GROUP BY segment),
 cov AS (SELECT segment, avg(CASE WHEN lo <= lower AND hi <= upper THEN 1e0 ELSE 0e0 END) AS coverage FROM e JOIN fix USING (segment) WHERE part = 'test' GROUP BY segment)
 SELECT segment, n_train, n_calibration, n_test, lower, upper, round(coverage, 6) AS coverage FROM (SELECT segment, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'calibration') AS n_calibration, count(*) FILTER (part = 'test') AS n_test FROM r GROUP BY segment) LEFT JOIN fix USING (segment) LEFT JOIN cov USING (segment)""",
)
def train_quantile(spark, d):
    rows = training.prepare(mutations(spark, d).selectExpr(*RAW))
    return training.train_quantiles(rows, F.floor(c("latitude") * 10), hold).withColumn("coverage", F.round("coverage", 6))


def _leaf(v):
    return {"leaf_value": v}


def _split(feature, threshold, left, right, default_left=True, kind="<="):
    return {"split_feature": feature, "threshold": threshold, "decision_type": kind, "default_left": default_left, "left_child": left, "right_child": right}


#: A small artifact: surface splits first, then latitude; a second tree by rooms, which some rows lack.
BASE = [_split(0, 60.0, _split(1, 46.0, _leaf(7.9), _leaf(8.1)), _leaf(7.6), default_left=False)]
ROOMS = [_split(2, 3.0, _leaf(0.05), _leaf(-0.05), kind="<")]
ARTIFACT = {"feature_names": ["surface_m2", "latitude", "rooms_count"], "lower": 0.02, "upper": -1.0, "models": {"p10": {"trees": [_split(0, 100.0, _leaf(7.3), _leaf(7.7))]}, "p50": {"trees": BASE + ROOMS}, "p90": {"trees": BASE + ROOMS, "average": True}}}
BASE_SQL = "CASE WHEN coalesce(surface_m2 <= 60, false) THEN CASE WHEN coalesce(latitude <= 46, true) THEN 7.9e0 ELSE 8.1e0 END ELSE 7.6e0 END"
ROOMS_SQL = "CASE WHEN coalesce(rooms_count < 3, true) THEN 0.05e0 ELSE -0.05e0 END"
P10_SQL = "exp(CASE WHEN coalesce(surface_m2 <= 100, true) THEN 7.3e0 ELSE 7.7e0 END - 0.02e0)"


@query("ml_infer_tree", f"WITH {SALES_CTE}, p AS (SELECT sale_id, {P10_SQL} AS a, exp({BASE_SQL} + {ROOMS_SQL}) AS b, exp(({BASE_SQL} + {ROOMS_SQL}) / 2) AS c FROM sales) SELECT sale_id, floor(least(a, b) + 5e-1) AS p10, floor(b + 5e-1) AS p50, floor(greatest(c, b) + 5e-1) AS p90 FROM p")
def infer_tree(spark, d):
    rows = sales(spark, d)
    return rows.select("sale_id", training.tree_quantiles(ARTIFACT, {n: c(n) for n in ARTIFACT["feature_names"]}).alias("q")).select("sale_id", "q.*")


TREE_FEATURES = ["surface_m2", "latitude", "longitude", "rooms_count", "kind", "month"]


def frame(spark, d):
    """Prepared rows with what trees learn from, and their part. The prepared rows are written once: days, edges and bins each read them."""
    rows = training.prepare(mutations(spark, d).selectExpr(*RAW))
    kinds = F.array_position(F.array(*(F.lit(x) for x in ("apartment", "house", "building", "commercial", "land"))), c("segment"))
    rows = hold(rows.select("segment", "sale_date", F.log("target_price_per_m2").alias("y"), *TREE_FEATURES[:4], kinds.cast("double").alias("kind"), F.months_between("sale_date", F.lit("1992-01-01")).alias("month")), "prepared")
    return training.split_by_days(rows).select("part", "segment", "y", *TREE_FEATURES)


@query("ml_train_trees")
def train_trees(spark, d):
    return boosting.train(frame(spark, d), TREE_FEATURES, "y", hold, trees=8)[1]
