"""The query of outcome forecasts, beside the same in SQL."""

from __future__ import annotations

from ..operators import forecast
from ..sources.adapters import SALES_CTE, read, sales
from .registry import query

#: Cohorts, one a nation, some of which bear no forecast; and what of sales goes in.
COHORTS = {
    "city": "n_name",
    "sample_size": "CASE n_nationkey % 8 WHEN 0 THEN 9 WHEN 1 THEN 12 WHEN 2 THEN 45 ELSE 60 + n_nationkey * 7 END",
    "training_eligible": "n_nationkey <> 5",
    "has_conflict": "n_nationkey = 6",
    "period_start": "CASE WHEN n_nationkey <> 7 THEN DATE '1992-01-01' END",
    "period_end": "DATE '1998-12-31'",
    "held_p": "CASE WHEN n_nationkey <> 9 THEN 7e-1 END",
    "postponed_p": "2e-1",
    "cancelled_p": "CASE WHEN n_nationkey = 10 THEN 5e-1 ELSE 1e-1 END",
    "adjudicated_if_held_p": "8e-1",
    "no_bid_if_held_p": "2e-1",
    "surenchere_p": "1e-1",
    "initial_ratio_p10": "9e-1",
    "initial_ratio_p50": "11e-1",
    "initial_ratio_p90": "CASE WHEN n_nationkey = 11 THEN 1e0 ELSE 17e-1 END",
    "final_ratio_p10": "1e0",
    "final_ratio_p50": "13e-1 + n_nationkey / 100e0",
    "final_ratio_p90": "25e-1",
    "qualified_demand_score": "CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 4e0 END",
    "history_score": "CASE WHEN n_nationkey = 12 THEN 140e0 ELSE 50e0 + n_nationkey END",
    "liquidity_score": "CASE WHEN n_nationkey % 2 = 0 THEN 30e0 END",
    "attractiveness_score": "CASE WHEN n_nationkey % 4 > 1 THEN 81e0 END",
}
GOES_IN = {"sale_id": "sale_id", "city": "city", "market_value_cents": "CASE WHEN sale_id % 5 > 0 THEN starting_price_eur * 100e0 * (1 + (sale_id % 13) / 10e0) END", "starting_price_cents": "starting_price_eur * 100e0", "effective_price_cents": "CASE sale_id % 9 WHEN 0 THEN starting_price_eur * 80e0 WHEN 1 THEN -1e0 END", "ceiling_cents": "CASE WHEN sale_id % 3 > 0 THEN starting_price_eur * 100e0 * (5e-1 + (sale_id % 40) / 10e0) END"}


def _as(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


R = {k: v.replace("'", "''") for k, v in forecast.REFUSALS.items()}
HALF = "floor({} + 5e-1)"
FOUR = "floor(({}) * 1e4 + 5e-1) / 1e4"
CDF = "CASE WHEN x >= hi THEN 1e0 WHEN x <= lo THEN x / lo * 0.01e0 WHEN x <= f10 THEN 0.01e0 + 0.09e0 * (ln(x) - ln(lo)) / (ln(f10) - ln(lo)) WHEN x <= f50 THEN 0.1e0 + 0.4e0 * (ln(x) - ln(f10)) / (ln(f50) - ln(f10)) WHEN x <= f90 THEN 0.5e0 + 0.4e0 * (ln(x) - ln(f50)) / (ln(f90) - ln(f50)) ELSE 0.9e0 + 0.09e0 * (ln(x) - ln(f90)) / (ln(hi) - ln(f90)) END"
SQL = f"""WITH {SALES_CTE}, k AS (SELECT n_nationkey, {_as(COHORTS)} FROM nation), i AS (SELECT {_as(GOES_IN)} FROM sales), j AS (SELECT i.*, k.* EXCLUDE (city), coalesce(effective_price_cents, starting_price_cents) AS p,
 CASE WHEN starting_price_cents IS NULL THEN '{R['price']}' WHEN sale_id % 9 = 1 THEN '{R['effective']}' WHEN n_nationkey = 5 THEN '{R['eligible']}' WHEN n_nationkey = 6 THEN '{R['conflict']}' WHEN n_nationkey % 8 = 0 THEN '{R['sample']}' WHEN n_nationkey = 7 THEN '{R['period']}' WHEN n_nationkey = 9 THEN '{R['chances']}' WHEN n_nationkey = 10 THEN '{R['sums']}' WHEN n_nationkey = 11 THEN '{R['quantiles']}' END AS refusal FROM i LEFT JOIN k USING (city)),
 q AS (SELECT *, {HALF.format('p * final_ratio_p10')} AS f10, {HALF.format('p * final_ratio_p50')} AS f50, {HALF.format('p * final_ratio_p90')} AS f90 FROM j),
 a AS (SELECT *, {HALF.format('coalesce(ceiling_cents, f50)')} AS x, greatest(1e0, f10 * 5e-1) AS lo, greatest(f90 + 1, f90 * 15e-1) AS hi, CASE WHEN market_value_cents > 0 THEN {HALF.format('greatest(0e0, least(100e0, 25 + greatest(-0.25e0, least(0.75e0, 1 - p / market_value_cents)) * 140))')} END AS s1, CASE WHEN qualified_demand_score <= 100 THEN {HALF.format('qualified_demand_score')} END AS s3, CASE WHEN history_score <= 100 THEN history_score END AS s4, {HALF.format('CASE WHEN liquidity_score IS NULL THEN attractiveness_score WHEN attractiveness_score IS NULL THEN liquidity_score ELSE (liquidity_score + attractiveness_score) / 2 END')} AS s5 FROM q),
 w AS (SELECT *, {CDF} AS cdf, 0.2e0 + CASE WHEN s1 IS NULL THEN 0e0 ELSE 0.3e0 END + CASE WHEN s3 IS NULL THEN 0e0 ELSE 0.2e0 END + CASE WHEN s4 IS NULL THEN 0e0 ELSE 0.15e0 END + CASE WHEN s5 IS NULL THEN 0e0 ELSE 0.15e0 END AS covered FROM a),
 z AS (SELECT *, {HALF.format('(coalesce(s1 * 0.3e0, 0e0) + 16e0 + coalesce(s3 * 0.2e0, 0e0) + coalesce(s4 * 0.15e0, 0e0) + coalesce(s5 * 0.15e0, 0e0)) / covered')} AS pressed, CASE WHEN sample_size >= 100 THEN 'élevé' WHEN sample_size >= 30 THEN 'moyen' ELSE 'faible' END AS label, CASE WHEN sample_size >= 100 THEN least(0.95e0, 0.75e0 + log10(sample_size / 100e0 + 1) * 0.1e0) WHEN sample_size >= 30 THEN 0.58e0 + (sample_size - 30) / 70e0 * 0.16e0 ELSE 0.35e0 + (sample_size - 10) / 20e0 * 0.2e0 END AS sure FROM w)
SELECT sale_id, refusal, {', '.join(f'CASE WHEN refusal IS NULL THEN {e} END AS {n}' for n, e in {'initial_p50_cents': HALF.format('p * initial_ratio_p50'), 'final_p10_cents': 'f10', 'final_p50_cents': 'f50', 'final_p90_cents': 'f90', 'ceiling_cents': 'x', 'below_p': FOUR.format('cdf'), 'adjudicated_below_p': FOUR.format('cdf * 0.7e0 * 0.8e0'), 'pressure_score': 'pressed', 'pressure_label': "CASE WHEN pressed >= 70 THEN 'élevée' WHEN pressed >= 40 THEN 'modérée' ELSE 'faible' END", 'pressure_coverage': FOUR.format('covered'), 'confidence_label': 'label', 'confidence_score': FOUR.format('sure')}.items())} FROM z"""


@query("sc_outcome_forecast", SQL)
def outcome_forecast(spark, d):
    cohorts = read(spark, d, "nation").selectExpr(*(f"{e} AS {n}" for n, e in COHORTS.items()))
    rows = sales(spark, d).selectExpr(*(f"{e} AS {n}" for n, e in GOES_IN.items()))
    out = forecast.outcome_forecasts(rows, cohorts, "city")
    return out.select("sale_id", "refusal", "initial_p50_cents", "final_p10_cents", "final_p50_cents", "final_p90_cents", "ceiling_cents", "below_p", "adjudicated_below_p", "pressure_score", "pressure_label", "pressure_coverage", "confidence_label", "confidence_score")
