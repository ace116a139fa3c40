"""Forecast of a sale's outcome from its cohort: refused where inputs do not bear one, else price quantiles, the chance of staying below a ceiling, competitive pressure and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cumulative_probability, round_half_up
from .reports import pressure

c = F.col

#: The least cohort, from how many results confidence is middling and high, and how far sums of chances may be off.
LEAST, MIDDLING, HIGH, OFF = 10, 30, 100, 0.02
#: Why a forecast is refused, in the order it is looked for.
REFUSALS = {
    "sale": "Vente non identifiable.",
    "price": "Mise à prix indisponible.",
    "effective": "Mise à prix effective invalide.",
    "eligible": "Cohorte non éligible à la prévision.",
    "conflict": "Conflit de données bloquant à résoudre.",
    "sample": "Échantillon vérifié insuffisant : au moins 10 résultats A/B sont requis.",
    "period": "Période de cohorte invalide.",
    "chances": "Probabilités de cohorte absentes ou invalides.",
    "sums": "Probabilités conditionnelles de cohorte incohérentes.",
    "quantiles": "Quantiles de prix absents ou non monotones.",
}
#: Weights of what presses, and from which score it is moderate, and high.
WEIGHTS = {"discount": 0.3, "adjudication": 0.2, "qualified_demand": 0.2, "history": 0.15, "liquidity": 0.15}
MODERATE, STRONG = 40, 70

FLOW = ["held_p", "postponed_p", "cancelled_p"]
IF_HELD = ["adjudicated_if_held_p", "no_bid_if_held_p"]
RATIOS = {side: [f"{side}_ratio_p{q}" for q in (10, 50, 90)] for side in ("initial", "final")}


def _positive(x: Column) -> Column:
    return F.coalesce((x > 0) & ~F.isnan(x.cast("double")), F.lit(False))


def _holds(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def refusal() -> Column:
    """The first reason against a forecast; null if there is none."""
    chances = [c(x) for x in [*FLOW, *IF_HELD, "surenchere_p"]]
    one = lambda names: _holds(F.abs(sum((c(x) for x in names), F.lit(0.0)) - 1) <= OFF)
    rising = [_positive(c(a)) & _positive(c(b)) & _positive(c(d)) & _holds((c(a) <= c(b)) & (c(b) <= c(d))) for a, b, d in RATIOS.values()]
    fails = {
        "sale": c("sale_id").isNull(),
        "price": ~_positive(c("starting_price_cents")),
        "effective": c("effective_price_cents").isNotNull() & ~_positive(c("effective_price_cents")),
        "eligible": ~_holds(c("training_eligible")),
        "conflict": _holds(c("has_conflict")),
        "sample": ~_holds(c("sample_size") >= LEAST),
        "period": c("period_start").isNull() | c("period_end").isNull(),
        "chances": ~_holds(F.forall(F.array(*chances), lambda p: p.between(0, 1))),
        "sums": ~(one(FLOW) & one(IF_HELD)),
        "quantiles": ~(rising[0] & rising[1]),
    }
    out = F
    for key, test in fails.items():
        out = out.when(test, REFUSALS[key])
    return out.otherwise(F.lit(None).cast("string"))


def confidence(n: Column) -> tuple[Column, Column]:
    """Label and score (0 to 1) by the cohort's size."""
    label = F.when(n >= HIGH, "élevé").when(n >= MIDDLING, "moyen").otherwise("faible")
    score = F.when(n >= HIGH, F.least(F.lit(0.95), 0.75 + F.log10(n / HIGH + 1) * 0.1)).when(n >= MIDDLING, 0.58 + (n - MIDDLING) / (HIGH - MIDDLING) * 0.16).otherwise(0.35 + (n - LEAST) / (MIDDLING - LEAST) * 0.2)
    return label, round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def _score(x: Column) -> Column:
    return F.when(x.isNotNull(), round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))))


def _given(x: str) -> Column:
    """A score of 0 to 100; null for any other."""
    return F.when(c(x).between(0, 100), c(x).cast("double"))


def pressures() -> dict[str, Column]:
    """The scores of what presses; null where it is not known."""
    price = F.coalesce("effective_price_cents", "starting_price_cents")
    known = F.array_compact(F.array(_given("liquidity_score"), _given("attractiveness_score")))
    discount = F.greatest(F.lit(-0.25), F.least(F.lit(0.75), 1 - price / c("market_value_cents")))
    return {
        "discount": F.when(_positive(c("market_value_cents")) & _positive(price), _score(25 + discount * 140)),
        "adjudication": _score(c("adjudicated_if_held_p") * 100),
        "qualified_demand": _score(_given("qualified_demand_score")),
        "history": _score(_given("history_score")),
        "liquidity": F.when(F.size(known) > 0, _score(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))),
    }


def outcome_forecasts(sales: DataFrame, cohorts: DataFrame, key: str) -> DataFrame:
    """sale_id, market_value_cents, starting_price_cents, effective_price_cents and ceiling_cents (null: the middle of final prices) of sales; of cohorts, key and what their columns are named here: a row for each sale, with refusal, and, where it is null, quantiles of the initial and the final price in cents, ceiling_cents, below_p (final price at most the ceiling, if adjudicated), adjudicated_below_p, pressure (score, label, coverage) and confidence (label, score). A sale without a cohort is refused."""
    rows = sales.join(cohorts, key, "left").withColumn("refusal", refusal())
    ok = c("refusal").isNull()
    price = F.coalesce("effective_price_cents", "starting_price_cents")
    cents = {f"{side}_p{q}_cents": round_half_up(price * c(name)) for side, names in RATIOS.items() for q, name in zip((10, 50, 90), names, strict=True)}
    rows = rows.withColumns({n: F.when(ok, x) for n, x in cents.items()})
    rows = rows.withColumn("ceiling_cents", F.when(ok, F.greatest(F.lit(0.0), round_half_up(F.coalesce(c("ceiling_cents").cast("double"), c("final_p50_cents"))))))
    below = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cumulative_probability(c("ceiling_cents"), c("final_p10_cents"), c("final_p50_cents"), c("final_p90_cents"))))
    rows = rows.withColumn("_below", below)
    parts = pressures()
    rows = rows.withColumns({f"_{k}": x for k, x in parts.items()})
    known = {k: c(f"_{k}") for k in parts}
    score = _score(pressure({k: (known[k], w) for k, w in WEIGHTS.items()}))
    covered = round_half_up(sum((F.when(known[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0)), 4)
    label, sure = confidence(c("sample_size"))
    out = rows.withColumns({
        "below_p": F.when(ok, round_half_up(c("_below"), 4)),
        "adjudicated_below_p": F.when(ok, round_half_up(c("_below") * c("held_p") * c("adjudicated_if_held_p"), 4)),
        "pressure_score": F.when(ok, score),
        "pressure_coverage": F.when(ok, covered),
        "confidence_label": F.when(ok, label),
        "confidence_score": F.when(ok, sure),
    })
    out = out.withColumn("pressure_label", F.when(c("pressure_score") >= STRONG, "élevée").when(c("pressure_score") >= MODERATE, "modérée").when(c("pressure_score").isNotNull(), "faible"))
    return out.select("sale_id", "refusal", *cents, "ceiling_cents", "below_p", "adjudicated_below_p", "pressure_score", "pressure_label", "pressure_coverage", "confidence_label", "confidence_score")
