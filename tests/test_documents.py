"""Facts of documents, surfaces that are settled, and the reading for investors, by worked examples."""

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import catalogue, facts, premium, surfaces
from gavelspark.plans.surfaces import INPUTS, OUTPUTS, SETTLED, SHOWN

c = F.col
PAGES = "sale_id long, document_no int, document_url string, document_label string, document_type string, page_number int, page_confidence double, text string"
DEPOSIT = "Le chèque représente 10% du montant de la mise à prix, avec un minimum de 3.000 euros."
PRICE = "Mise à prix adjudication. L'adjudication aura lieu en un seul lot sur la mise à prix ci-après indiquée : 10.500 € (dix mille cinq cents euros)."


def told(spark, *pages):
    rows = [(1, no, f"u{no}", "x", kind, page, sure, text) for no, kind, page, sure, text in pages]
    return {r.fact: r for r in facts.document_facts(spark.createDataFrame(rows, PAGES)).collect()}


def test_prices_compete_by_document(spark):
    got = told(spark, (0, "annonce_vente", 1, 0.9, "Mise à prix : 12 000,50 €."), (1, "cahier_conditions_vente", 4, 0.99, DEPOSIT), (1, "cahier_conditions_vente", 17, 0.95, PRICE), (2, "pdf", 1, 0.9, "Mise à prix : 12000,50 euros"), (3, "bail", 1, 1.0, "Mise à prix : 1 €."), (4, None, 1, None, None))["starting_price"]
    assert (got.value, got.document_type, got.page_number, got.page_confidence, got.support) == ("10500.00", "cahier_conditions_vente", 17, 0.95, 1)
    assert [tuple(x) for x in got.lost] == [("12000.50", 2)] and "un seul lot" in got.evidence


def test_equal_ranks_go_to_the_surer_page_then_the_first_document(spark):
    pages = [(0, "cahier_conditions_vente", 3, 0.5, "Mise à prix : 1000 €."), (1, "cahier_conditions_vente", 2, 0.8, "Mise à prix : 2000 €."), (2, "cahier_conditions_vente", 2, 0.8, "Mise à prix : 3000 €.")]
    assert told(spark, *pages)["starting_price"].value == "2000.00"


def test_reference_surface_goes_before_parts_of_the_building(spark):
    got = told(spark, (0, "diagnostics_techniques", 114, 0.92, "Maison individuelle. Surface de référence : 116,72 m². N° cadastre : ZI 40, ZI 43."), (0, "diagnostics_techniques", 130, 0.9, "Isolation du mur est, surface : 77 m². Plafond, surface : 60 m²."))
    assert (got["surface"].value, got["surface"].page_number) == ("116.72", 114) and [x.value for x in got["surface"].lost] == []
    got = told(spark, (0, "pdf", 1, 0.9, "Le diagnostic affiche 210 kWhEP/m2/an.\nLa superficie Carrez du lot est de 39,82m2.\nAppartement de 3 pièces 2 chambres."))
    assert got["surface"].value == "39.82" and "energy" not in got


def test_partial_measures_rank_lower(spark):
    got = told(spark, (0, "diagnostics_techniques", 1, 0.9, "Surface habitable : 80 m². Le mesurage est incomplet."), (1, "annonce_vente", 1, 0.9, "Surface habitable : 95 m²."))
    assert got["surface"].value == "95.00"


def test_energy_of_the_fullest_page(spark):
    full = "Diagnostic de performance énergétique. Classe énergie : F. GES : C. Consommation énergétique : 394 kWhEP/m²/an. Émissions de gaz à effet de serre : 12 kg CO2/m²/an."
    got = told(spark, (0, "diagnostics_techniques", 1, 0.9, "DPE : G"), (0, "diagnostics_techniques", 2, 0.9, full), (1, "pdf", 1, 1.0, "DPE G - Gaz à effet de serre classe D - 520 kWh/m2/an - 32 kg CO2/m2/an."))["energy"]
    assert got.value == '{"dpe":"F","ges":"C","consumption":394.0,"emissions":12.0}' and got.page_number == 2
    assert [x.value for x in got.lost] == ['{"dpe":"G","ges":"D","consumption":520.0,"emissions":32.0}', '{"dpe":"G"}']
    assert told(spark, (0, "pdf", 1, 1.0, ""), (1, "pdf", 1, 1.0, None), (2, "pdf", 1, 1.0, "Rien.")) == {}


def test_land_days_visits_and_occupancy_are_told(spark):
    """Before, pages told no more than price, surface and energy."""
    hearing = "Frais de la vente aux enchères : 3 000 €.\nAudience d’adjudication le 3 mars 2025 à 14h30.\nVisites sur place : 12/02/2025 de 10h à 11h.\nDate des visites : 13/02/2025."
    land = "Parcelle section AB 12, contenance totale : 1 ha 2 a 5 ca. Surface habitable : 80 m²."
    got = told(spark, (0, "cahier_conditions_vente", 2, 0.9, hearing), (1, "annonce_vente", 1, 0.9, "Surface du terrain : 1.200 m². Vente aux enchères le 04/03/2025. Libre de toute occupation."), (2, "pv_huissier", 3, 0.9, land), (2, "pv_huissier", 4, 0.9, "Le bien est loué suivant bail en cours."), (3, "pdf", 1, 1.0, "Visite virtuelle. Jouissance du lot 4."))
    assert {n: (r.value, r.document_type, r.page_number, [x.value for x in r.lost]) for n, r in got.items() if n != "surface"} == {
        "land": ("10205.00", "pv_huissier", 3, ["1200.00"]),
        "sale_date": ("2025-03-04T00:00:00", "annonce_vente", 1, ["2025-03-03T14:30:00"]),
        "visit_dates": ("Visites sur place : 12/02/2025 de 10h à 11h | 13/02/2025", "cahier_conditions_vente", 2, []),
        "occupancy": ("rented", "pv_huissier", 4, ["vacant"]),
    }


def test_a_partial_measure_lowers_all_surfaces_of_its_document(spark):
    """Before, it was looked for in the surface's own page."""
    got = told(spark, (0, "diagnostics_techniques", 1, 0.9, "Surface habitable : 80 m²."), (0, "diagnostics_techniques", 2, 0.9, "Le mesurage est incomplet."), (1, "annonce_vente", 1, 0.9, "Surface habitable : 95 m²."))
    assert got["surface"].value == "95.00"


@pytest.mark.parametrize("own, price, status", [(None, 10500.0, "extracted"), (10500.0, 10500.0, "corroborated"), (11.0, 10500.0, "resolved"), (0.0, 10500.0, "resolved"), (9000.0, 9000.0, "conflict_unresolved"), (900.0, 900.0, "conflict_unresolved")])
def test_prices_that_are_stored_and_documented(spark, own, price, status):
    found = facts.document_facts(spark.createDataFrame([(1, 0, "u", "x", "ccv", 1, 0.9, PRICE)], PAGES))
    sales = spark.createDataFrame([(1, own), (2, 5.0)], "sale_id long, starting_price_eur double")
    assert [tuple(r) for r in facts.reconciled_prices(found, sales).collect()] == [(1, price, status)]


def test_settled_surfaces(spark):
    rows = [(i, *(x.get(n) if x.get(n) is None or k != "double" else float(x[n]) for n, k in INPUTS.items())) for i, (x, _, _, _) in enumerate(SETTLED)]
    df = spark.createDataFrame(rows, ", ".join(["i long", *(f"{n} {k}" for n, k in INPUTS.items())]))
    got = surfaces.resolve_surfaces(df).orderBy("i").collect()
    for r, (_, settled, shown, flags) in zip(got, SETTLED, strict=True):
        assert (tuple(r[n] for n in OUTPUTS), tuple(r[n] for n in SHOWN), ",".join(r.flags)) == (settled, shown, flags), r
    assert got[4].rules == ["built_corrected", "habitable_follows", "measured_goes_first"]


def test_reading_for_investors(spark):
    text = "Le bien correspond à un appartement de type studio situé en rez-de-chaussée. Le logement est actuellement occupé suivant un bail meublé en date du 13/07/2025 pour un loyer mensuel de 745 euros charges comprises."
    risk = [("amiante", "Présence d'amiante", 0.94)]
    rows = [(1, "building", "vacant", 1, 2, ["ambiguous_surface"], text, None, 0, 80.0, risk), (2, "house", "rented", 4, 3, [], "Maison.", 90.0, 3, 80.0, []), (3, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i long, property_type string, occupancy_status string, rooms_count int, bedrooms_count int, flags array<string>, text string, app_surface_m2 double, documents_count int, investment_score double, risks array<struct<risk_label:string,excerpt:string,confidence:double>>").withColumn("evidence_items", F.lit(4))
    a, b, none = premium.premium_analysis(df).orderBy("i").collect()
    assert (a.property_type, a.occupancy_status) == ("apartment", "unknown")
    assert [x.key for x in a.contradictions] == list(premium.CONTRADICTIONS)
    assert "loyer mensuel" in a.contradictions[1].evidence and a.contradictions[0].evidence.startswith("Le bien correspond")
    assert (a.gates.readiness, a.gates.sourced_risks, a.gates.weak_points) == (premium.NOT_READY, 1, ["documents_absents", "analyse_source_uniquement", "surface_absente", "occupation_inconnue"])
    assert [x.status for x in a.questions] == ["à lever", "à lever", "à vérifier", "à confirmer", "à lever"]
    assert a.headline == premium.HEADLINES["undocumented"] and a.actions[0] == premium.ACTIONS["documents"] and a.actions[-1] == premium.ACTIONS["contradictions"]
    assert (b.gates.readiness, b.headline, b.contradictions) == (premium.READY, premium.HEADLINES["attractive"], []) and len(b.actions) == 2
    assert (none.headline, none.gates.documents_count, none.contradictions) == (premium.HEADLINES["none"], 0, [])


def test_pages_of_a_search_keep_the_whole_count(spark):
    sales = spark.createDataFrame([(i, "upcoming" if i % 5 else None, 45.0, 2.0, i % 7 or None) for i in range(40)] + [(90, "past", 45.0, 2.0, 1), (91, "upcoming", None, 2.0, 1)], "sale_id long, status string, latitude double, longitude double, investment_score int")
    got = catalogue.search(sales, spark.createDataFrame([], "code string, name string, city string"), catalogue.Asked(limit=10, offset=30)).collect()
    order = sorted(range(40), key=lambda i: (-(i % 7) if i % 7 else 99, i))
    assert [r.sale_id for r in got] == order[30:] and {r.total_count for r in got} == {40}
    plan = catalogue.search(sales, sales, catalogue.Asked())._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
