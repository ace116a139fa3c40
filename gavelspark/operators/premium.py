"""The reading of a sale for investors: contradictions between what is stored and what texts say, gates of confidence, open questions, a headline and what to do next.

Each part is a table of rules over the sale's columns; a table becomes one array, its rules in their order, without those that do not hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.occurrences import ANY_CASE, around, occurrences, quick
from ..functions.text import clean_text, let

c = F.col

#: What says that a home is lived in, and what that this has ended; where that is shown.
LIVED_IN = r"\b(?:actuellement\s+)?occup[ée]\b|\bsuivant\s+un\s+bail\b|\bbail\s+(?:meubl[ée]|d['’]habitation|en\s+cours)\b|\blocataire\b|\bloyer\s+mensuel\b"
LEFT = r"\blibre\s+de\s+toute\s+occupation\b|\ba\s+quitt[ée]\s+les\s+lieux\b|\bd[ée]part\s+effectif\b|\bconstat[ée]?\s+libre\b"
LIVED_IN_SHOWN = [r"\b(?:actuellement\s+)?occup[ée]\b.{0,120}\b(?:bail|locataire|loyer)\b", r"\b(?:bail|locataire|loyer\s+mensuel)\b.{0,120}\b(?:occup[ée]|meubl[ée]|charges?\s+comprises)\b"]
#: What says that a single flat is sold, and what that a whole building is; where that is shown.
ONE_FLAT = r"\bappartement\s+de\s+type\s+studio\b|\bappartement\b.{0,80}\bstudio\b|\bstudio\b.{0,80}\b(?:rez-de-chauss[ée]e|copropri[ée]t[ée]|surface\s+habitable|bail)\b|\btype\s+d['’]habitat\s*:?\s*studio\b|\blogement\b.{0,80}\bstudio\b"
WHOLE_BUILDING = r"\bimmeuble\s+(?:entier|comprenant|compos[ée]|[àa]\s+usage)|\bplusieurs\s+appartements?\b|\bensemble\s+immobilier\s+comprenant\b"
ONE_FLAT_SHOWN = [r"\bappartement\s+de\s+type\s+studio\b", r"\btype\s+d['’]habitat\s*:?\s*studio\b", r"\bstudio\b.{0,80}\b(?:rez-de-chauss[ée]e|copropri[ée]t[ée]|surface\s+habitable|bail)\b"]
#: How much of the text shows a rule.
SHOWN = (80, 170)
#: Labels and confidences of contradictions, and what becomes of them.
CONTRADICTIONS = {
    "property_type_from_specific_asset": ("résolu", "Type retenu : appartement/studio, et non immeuble.", 0.78),
    "occupation_conflict_requires_confirmation": ("à lever", "Occupation retenue : à confirmer.", 0.82),
    "room_count_conflict": ("résolu_partiellement", "Pièces/chambres incohérentes", 0.82),
    "ambiguous_surface": ("à lever", "Surface ambiguë", 0.55),
}
#: Headlines, from the first that fits; scores from which a sale is interesting, and attractive; below which risks weigh.
HEADLINES = {
    "none": "Dossier à structurer avant lecture d'investissement.",
    "undocumented": "Pré-tri uniquement : pièces officielles absentes, lecture à confirmer.",
    "contradicted": "Dossier exploitable, mais des incohérences doivent être levées avant décision.",
    "risky": "Dossier risqué : les alertes documentées peuvent absorber la marge.",
    "attractive": "Dossier potentiellement attractif, sous réserve de confirmer les preuves clés.",
    "interesting": "Dossier intéressant mais dépendant de quelques vérifications structurantes.",
    "fragile": "Dossier fragile : conserver une marge de sécurité élevée.",
}
INTERESTING, RISKY, ATTRACTIVE = 55, 60, 75
READY, PARTLY_READY, NOT_READY = "prêt à analyser", "analyse à confirmer", "pré-tri uniquement"
DIAGNOSTICS = ["amiante", "plomb", "termites", "DPE"]
#: What to do before bidding, in order.
ACTIONS = {
    "documents": "Récupérer le PV descriptif, le cahier de vente et les diagnostics.",
    "ceiling": "Définir un prix plafond tout compris avant l'audience.",
    "reread": "Relire les pièces officielles qui justifient les alertes.",
    "occupation": "Confirmer le statut d'occupation et le délai de jouissance.",
    "works": "Chiffrer un budget travaux avant de calculer la marge.",
    "diagnostics": "Lire le diagnostic technique concerné et distinguer obligation, information et coût réel.",
    "contradictions": "Lever les contradictions entre annonce, PV, cahier de vente et diagnostics.",
}
MOST_ACTIONS = 7


def _has(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(ANY_CASE + "(?s)" + quick(pattern)), F.lit(False))


def _shown(text: Column, patterns: list[str]) -> Column:
    """What the first match of the first pattern that has one stands in."""
    first = lambda p: let(F.get(occurrences(text, "(?s)" + p), F.lit(0)), lambda o: F.when(o.isNotNull(), clean_text(around(text, o, *SHOWN))))
    return F.coalesce(*(first(p) for p in patterns))


def _rules(rows: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), value) for test, value in rows)))


def _flagged(flag: str) -> Column:
    return F.coalesce(F.array_contains("flags", flag), F.lit(False))


def _contradiction(key: str, evidence: Column, confidence: Column | None = None) -> Column:
    status, label, sure = CONTRADICTIONS[key]
    return F.struct(F.lit(key).alias("key"), F.lit(status).alias("status"), F.lit(label).alias("label"), evidence.alias("evidence"), (F.lit(sure) if confidence is None else F.coalesce(confidence, F.lit(sure))).alias("confidence"))


def contradictions() -> Column:
    """Pairs of what is stored and said that do not go together, each with its evidence."""
    text, none = c("text"), F.lit(None).cast("string")
    one_flat = (c("property_type").isNull() | c("property_type").isin("building", "other", "unknown")) & _has(text, ONE_FLAT) & ~_has(text, WHOLE_BUILDING)
    lived_in = c("occupancy_status").isin("vacant", "free") & _has(text, LIVED_IN) & ~_has(text, LEFT)
    return _rules([
        (one_flat, _contradiction("property_type_from_specific_asset", _shown(text, ONE_FLAT_SHOWN))),
        (lived_in, _contradiction("occupation_conflict_requires_confirmation", _shown(text, LIVED_IN_SHOWN))),
        (c("bedrooms_count") > c("rooms_count"), _contradiction("room_count_conflict", none)),
        (_flagged("ambiguous_surface"), _contradiction("ambiguous_surface", c("surface_evidence"), c("surface_confidence"))),
    ])


def settled_type() -> Column:
    return F.when(F.exists("contradictions", lambda x: x["key"] == "property_type_from_specific_asset"), "apartment").otherwise(c("property_type"))


def settled_occupancy() -> Column:
    return F.when(F.exists("contradictions", lambda x: x["key"] == "occupation_conflict_requires_confirmation"), "unknown").otherwise(c("occupancy_status"))


def _told(*labels: str) -> Column:
    return F.exists("risks", lambda r: r["risk_label"].isin(*labels))


def gates() -> Column:
    """Readiness by how many weak points there are, and these."""
    undocumented = c("documents_count") == 0
    weak = [("documents_absents", undocumented), ("analyse_source_uniquement", undocumented), ("surface_absente", c("app_surface_m2").isNull()), ("occupation_inconnue", _open_occupancy()), ("preuves_absentes", c("evidence_items") == 0)]
    points = _rules([(test, F.lit(name)) for name, test in weak])
    sourced = F.size(F.filter("risks", lambda r: F.coalesce(r["excerpt"], F.lit("")) != ""))
    return let(points, lambda p: F.struct(F.when(F.size(p) == 0, READY).when(F.size(p) == 1, PARTLY_READY).otherwise(NOT_READY).alias("readiness"), c("documents_count").alias("documents_count"), sourced.alias("sourced_risks"), c("evidence_items").alias("evidence_items"), p.alias("weak_points")))


def _open_occupancy() -> Column:
    return F.coalesce(c("occupancy_status") == "unknown", F.lit(True))


def questions() -> Column:
    """What must be known before bidding, and whether it is."""
    undocumented = c("documents_count") == 0
    status = {
        "occupation": F.when(_open_occupancy(), "à lever").otherwise("répondu"),
        "surface": F.when(c("app_surface_m2").isNotNull(), "répondu").otherwise("à lever"),
        "diagnostics": F.when(_told(*DIAGNOSTICS), "à vérifier").when(undocumented, "à récupérer").otherwise("sans alerte"),
        "travaux": F.when(_told("travaux"), "à chiffrer").when(undocumented, "à confirmer").otherwise("sans alerte"),
        "contradictions": F.when(F.size("contradictions") > 0, "à lever").otherwise("répondu"),
    }
    return F.array(*(F.struct(F.lit(k).alias("key"), s.alias("status")) for k, s in status.items()))


def headline() -> Column:
    score, h = c("investment_score"), HEADLINES
    return (
        F.when(score.isNull(), h["none"])
        .when(c("documents_count") == 0, h["undocumented"])
        .when(F.size("contradictions") > 0, h["contradicted"])
        .when((F.size("risks") > 0) & (score < RISKY), h["risky"])
        .when(score >= ATTRACTIVE, h["attractive"])
        .when(score >= INTERESTING, h["interesting"])
        .otherwise(h["fragile"])
    )


def actions() -> Column:
    yes = F.lit(True)
    tests: dict[str, Column] = {"documents": c("documents_count") == 0, "ceiling": yes, "reread": yes, "occupation": _open_occupancy(), "works": _told("travaux"), "diagnostics": _told(*DIAGNOSTICS), "contradictions": F.size("contradictions") > 0}
    return F.slice(_rules([(tests[k], F.lit(text)) for k, text in ACTIONS.items()]), 1, MOST_ACTIONS)


RISK = "array<struct<risk_label:string,excerpt:string,confidence:double>>"
INPUTS = {"property_type": "string", "occupancy_status": "string", "rooms_count": "int", "bedrooms_count": "int", "flags": "array<string>", "text": "string", "app_surface_m2": "double", "surface_evidence": "string", "surface_confidence": "double", "documents_count": "int", "evidence_items": "int", "investment_score": "double"}


def premium_analysis(sales: DataFrame) -> DataFrame:
    """Sales with INPUTS and risks (structs of risk_label, excerpt, confidence) in; beside their other columns contradictions, gates, questions, headline and actions out, and property_type and occupancy_status as contradictions leave them. What is not given is null; no documents, evidence or risks are none."""
    out = sales.withColumns({n: (c(n) if n in sales.columns else F.lit(None)).cast(kind) for n, kind in INPUTS.items()})
    risks = F.transform("risks", lambda r: F.struct(r["risk_label"].alias("risk_label"), r["excerpt"].alias("excerpt"), r["confidence"].cast("double").alias("confidence"))) if "risks" in sales.columns else F.array()
    out = out.withColumns({"risks": F.coalesce(risks.cast(RISK), F.array().cast(RISK)), "documents_count": F.coalesce("documents_count", F.lit(0)), "evidence_items": F.coalesce("evidence_items", F.lit(0))})
    out = out.withColumn("contradictions", contradictions())
    out = out.withColumns({"property_type": settled_type(), "occupancy_status": settled_occupancy()})
    steps: dict[str, Callable[[], Column]] = {"gates": gates, "questions": questions, "headline": headline, "actions": actions}
    return out.withColumns({name: made() for name, made in steps.items()})
