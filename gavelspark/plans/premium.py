"""The query of the reading for investors, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import premium
from ..sources.adapters import SALES_CTE, sales
from .registry import query
from .scalars import one_of

c = F.col

#: What texts of sales say, and whether they contradict a vacant home, and a building or other type.
SAID = [
    ("Le logement est actuellement occupé suivant un bail meublé pour un loyer mensuel de 745 euros.", True, False),
    ("Appartement de type studio situé en rez-de-chaussée, libre.", False, True),
    ("Studio en copropriété, occupé par un locataire.", True, True),
    ("Un locataire a quitté les lieux. Immeuble comprenant plusieurs appartements, un studio en copropriété.", False, False),
    ("Maison de ville.", False, False),
    (None, False, False),
]
RISKS = [[], ["travaux"], ["plomb", "servitude"], ["DPE", "travaux"]]
N, M = len(SAID), len(RISKS)
TYPE = "(property_type IS NULL OR property_type IN ('building', 'other', 'unknown')) AND sale_id % 6 IN (1, 2)"
OCCUPIED = "occupancy_status = 'vacant' AND sale_id % 6 IN (0, 2)"
ROOMS = "bedrooms_count > rooms_count"
SURFACE = "contains(quality_flags, 'ambiguous_surface')"
KEYS = f"concat_ws(',', CASE WHEN {TYPE} THEN 'property_type_from_specific_asset' END, CASE WHEN {OCCUPIED} THEN 'occupation_conflict_requires_confirmation' END, CASE WHEN {ROOMS} THEN 'room_count_conflict' END, CASE WHEN {SURFACE} THEN 'ambiguous_surface' END)"
H = {k: v.replace("'", "''") for k, v in premium.HEADLINES.items()}
SQL = f"""WITH {SALES_CTE}, k AS (SELECT *, {KEYS} AS keys, coalesce(occupancy_status = 'unknown', TRUE) OR coalesce({OCCUPIED}, FALSE) AS open, sale_id % {M} IN (1, 3) AS works, sale_id % {M} IN (2, 3) AS diagnosed FROM sales),
w AS (SELECT *, concat_ws(',', CASE WHEN documents_count = 0 THEN 'documents_absents,analyse_source_uniquement' END, CASE WHEN surface_m2 IS NULL THEN 'surface_absente' END, CASE WHEN open THEN 'occupation_inconnue' END, CASE WHEN sale_id % 5 = 0 THEN 'preuves_absentes' END) AS weak FROM k)
SELECT sale_id, keys AS contradictions, weak AS weak_points, CASE WHEN weak = '' THEN 'prêt à analyser' WHEN contains(weak, ',') THEN 'pré-tri uniquement' ELSE 'analyse à confirmer' END AS readiness,
 concat_ws(',', CASE WHEN open THEN 'à lever' ELSE 'répondu' END, CASE WHEN surface_m2 IS NULL THEN 'à lever' ELSE 'répondu' END, CASE WHEN diagnosed THEN 'à vérifier' WHEN documents_count = 0 THEN 'à récupérer' ELSE 'sans alerte' END, CASE WHEN works THEN 'à chiffrer' WHEN documents_count = 0 THEN 'à confirmer' ELSE 'sans alerte' END, CASE WHEN keys <> '' THEN 'à lever' ELSE 'répondu' END) AS questions,
 CASE WHEN investment_score IS NULL THEN '{H['none']}' WHEN documents_count = 0 THEN '{H['undocumented']}' WHEN keys <> '' THEN '{H['contradicted']}' WHEN sale_id % {M} > 0 AND investment_score < 60 THEN '{H['risky']}' WHEN investment_score >= 75 THEN '{H['attractive']}' WHEN investment_score >= 55 THEN '{H['interesting']}' ELSE '{H['fragile']}' END AS headline,
 CAST(2 + CAST(documents_count = 0 AS INTEGER) + CAST(open AS INTEGER) + CAST(works AS INTEGER) + CAST(diagnosed AS INTEGER) + CAST(keys <> '' AS INTEGER) AS INTEGER) AS n_actions FROM w"""


@query("sc_premium", SQL)
def sc_premium(spark, d):
    risks = F.array(*(F.array(*(F.struct(F.lit(x).alias("risk_label"), F.lit("...").alias("excerpt"), F.lit(0.8).alias("confidence")) for x in labels)).cast(premium.RISK) for labels in RISKS))
    rows = sales(spark, d).selectExpr("*", one_of("sale_id", [x for x, _, _ in SAID]) + " AS text", "split(quality_flags, ',') AS flags", "surface_m2 AS app_surface_m2", "CASE WHEN sale_id % 5 > 0 THEN 3 END AS evidence_items")
    out = premium.premium_analysis(rows.withColumn("risks", F.get(risks, (c("sale_id") % M).cast("int"))))
    joined = lambda column, key: F.array_join(F.transform(column, lambda x: x[key]), ",")
    return out.select("sale_id", joined("contradictions", "key").alias("contradictions"), F.array_join("gates.weak_points", ",").alias("weak_points"), c("gates.readiness").alias("readiness"), joined("questions", "status").alias("questions"), "headline", F.size("actions").alias("n_actions"))
