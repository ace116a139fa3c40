"""Queries of risks that texts tell, of state that changes, and of a registry's history, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, risks, states
from ..sources import registry
from ..sources.adapters import SALES_CTE, parts_for, sales
from ..storage import shared_dir
from ..streaming import monitors
from .queries import read
from .registry import query

c = F.col
S = f"WITH {SALES_CTE} "

def spread(rows, key: str):
    """Rows over all shuffle partitions by key: a file that is one split to read is many tasks to work on, and what is grouped by key stays where it is."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Texts of sales with what they tell: text, kind of source, type of document, and label, severity, confidence and number of the occurrences that count.
TOLD = [
    ("Le procès-verbal descriptif constate des infiltrations d'eau et des dégradations importantes dans le logement. Des travaux de remise en état sont à prévoir.", "pdf", "pv_huissier", [("travaux", 5, 0.86, 2)]),
    ("Constat de risque d'exposition au plomb. Le diagnostic ne constate pas de revêtements dégradés contenant du plomb et la quantité relevée ne dépasse pas le seuil réglementaire.", "pdf", "diagnostics_techniques", []),
    ("Dans le cas où l'immeuble vendu serait grevé de servitudes, l'adjudicataire devra en faire son affaire personnelle sans recours contre le poursuivant.", "pdf", "cahier_conditions_vente", []),
    ("Le bien est actuellement occupé par un locataire suivant bail d'habitation en cours. Le loyer mensuel est indiqué dans le dossier.", "pdf", "pv_huissier", [("occupation", 5, 0.9, 2)]),
    ("Le cahier précise qu'aucune servitude connue n'est mentionnée. Le procès-verbal décrit une toiture en mauvais état avec gros travaux à prévoir.", "pdf", "constat", [("travaux", 5, 0.86, 2)]),
    ("ARTICLE 27 - IMMEUBLES EN COPROPRIETE. Dans le cas où l'immeuble vendu dépend d'un ensemble en copropriété, l'adjudicataire est tenu de notifier au syndic. Le dossier comprend un constat de repérage amiante et un constat de risque d'exposition au plomb annexés au cahier.", "pdf", "cahier_conditions_vente", []),
    ("Diagnostics annexés : DPE, constat amiante, CREP plomb, état termites.", "pdf", "diagnostics_techniques", []),
    ("Diagnostic technique. Présence d'amiante repérée dans les dalles de sol. Le CREP indique des revêtements contenant du plomb.", "pdf", "Diagnostics", [("amiante", 3, 0.94, 1), ("plomb", 3, 0.94, 1)]),
    ("Le lot numéro 12 dépend d'un ensemble immobilier soumis au régime de la copropriété avec 320 tantièmes des parties communes.", "pdf", "CCV", [("copropriété", 1, 0.71, 1)]),
    ("DPE : G, passoire énergétique. Servitude de passage au profit du voisin.", "sale_text", None, [("DPE", 2, 0.84, 1), ("servitude", 2, 0.8, 1)]),
    ("Maison squattée, occupée sans droit ni titre", "sale_text", None, [("occupation", 5, 0.82, 1)]),
    ("", "sale_text", None, []),
    (None, "pdf", None, []),
]
EXPECTED = ", ".join(f"({i}, '{label}', {severity}, {confidence}e0, {n})" for i, (_, _, _, rows) in enumerate(TOLD) for label, severity, confidence, n in rows)


@query("sc_risk_extract", S + f"SELECT sale_id, label AS risk_label, severity, confidence, n FROM sales JOIN (VALUES {EXPECTED}) t(i, label, severity, confidence, n) ON sale_id % {len(TOLD)} = i")
def risk_extract(spark, d):
    of = lambda k: F.get(F.array(*(F.lit(x[k]).cast("string") for x in TOLD)), (c("sale_id") % len(TOLD)).cast("int"))
    texts = spread(sales(spark, d).select("sale_id"), "sale_id").select("sale_id", of(0).alias("text"), of(1).alias("source_kind"), of(2).alias("document_type"))
    return risks.risk_occurrences(texts).groupBy("sale_id", "risk_label", "severity", "confidence").agg(F.count("*").cast("int").alias("n"))


#: Watches of sales, three snapshots each: prices fall, rise again and fall again; hearings, states, documents and scores move.
WATCHED = {
    "user_id": "sale_id % 7",
    "watch_kind": "CASE sale_id % 2 WHEN 0 THEN 'favorite' ELSE 'workspace' END",
    "watch_id": "'w' || CAST(sale_id AS STRING)",
    "checked_at": "CAST(sale_date + k AS TIMESTAMP)",
    "price": "starting_price_eur + CASE WHEN sale_id % 3 = 0 THEN k % 2 ELSE 0 END",
    "day": "CASE WHEN sale_id % 4 = 0 AND k = 2 THEN sale_date + CASE sale_id % 8 WHEN 0 THEN 10 ELSE 90 END ELSE sale_date END",
    "status": "CASE WHEN sale_id % 5 = 0 AND k = 1 THEN 'reporte' ELSE status END",
    "documents": "CASE WHEN sale_id % 6 = 0 AND k > 1 THEN 'b' ELSE 'a' END",
    "score": "investment_score + CASE WHEN sale_id % 7 = 0 THEN k * (sale_id % 12) ELSE 0 END",
    "document_count": "documents_count + CASE WHEN sale_id % 6 = 0 AND k > 1 THEN 1 ELSE 0 END",
}
TIMES = 4
ROWS = f"SELECT sale_id, k, {', '.join(f'{e} AS {n}' for n, e in WATCHED.items())} FROM sales CROSS JOIN range({TIMES}) r(k)".replace("AS STRING", "AS VARCHAR").replace("sale_date + k", "sale_date + CAST(k AS INTEGER)")
PAIR = "lag({0}) OVER w AS before_{0}"
MOVES = " UNION ALL ".join(
    f"SELECT user_id, sale_id, checked_at, '{kind}' AS event_kind, '{field}' AS field, CAST(before_{name} AS VARCHAR) AS previous, CAST({name} AS VARCHAR) AS current, {severity} AS severity FROM p WHERE before_{name} <> {name}{more}"
    for kind, field, name, severity, more in [
        ("price_changed", "price", "price", "CASE WHEN price < before_price THEN 'important' ELSE 'info' END", ""),
        ("audience_changed", "sale_date", "day", "CASE WHEN day <= checked_at + INTERVAL 14 DAY THEN 'urgent' ELSE 'important' END", ""),
        ("status_changed", "status", "status", "CASE WHEN contains(status, 'report') OR contains(status, 'adjud') THEN 'urgent' ELSE 'important' END", ""),
        ("documents_changed", "documents", "documents", "CASE WHEN document_count > before_document_count THEN 'important' ELSE 'info' END", ""),
        ("score_changed", "score", "score", "CASE WHEN abs(score - before_score) >= 10 THEN 'important' ELSE 'info' END", " AND abs(score - before_score) >= 5"),
    ]
)


def watched(spark, d):
    out = sales(spark, d).select("*", F.explode(F.array(*(F.lit(k) for k in range(TIMES)))).alias("k")).selectExpr("sale_id", *(f"{e} AS {n}" for n, e in WATCHED.items()))
    return out.withColumnRenamed("day", "sale_date")


@query("st_change_feed", S + f", r AS ({ROWS}), p AS (SELECT *, {', '.join(PAIR.format(x) for x in ('price', 'day', 'status', 'documents', 'document_count', 'score'))} FROM r WINDOW w AS (PARTITION BY sale_id ORDER BY k)), m AS ({MOVES}) SELECT sale_id, event_kind, event_kind || ':' || field || ':' || previous || ':' || current AS fingerprint, severity, min(checked_at) AS checked_at FROM m GROUP BY ALL")
def change_feed(spark, d):
    return monitors.change_feed(watched(spark, d), parts=parts_for(read(spark, d, "orders"), TIMES)).select("sale_id", "event_kind", "fingerprint", "severity", F.col("checked_at").cast("timestamp_ntz").alias("checked_at"))


LOG = "ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'"
LAST = f"(SELECT max(ts) FROM (SELECT ts FROM events WHERE {LOG} ORDER BY ts LIMIT 500))"
SEGMENT = f"SELECT 'limited' AS scan, count(*) FILTER (ts <= {LAST}) AS selected, max(ts) FILTER (ts <= {LAST}) AS committed_through, min(ts) FILTER (ts > {LAST}) AS resume_at, min(ts) FILTER (ts > {LAST}) IS NULL AS scan_complete FROM events WHERE {LOG} UNION ALL SELECT 'whole', count(*), max(ts), NULL, TRUE FROM events WHERE {LOG}"


@query("st_resume_point", SEGMENT)
def resume_point(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    log = read(spark, d, "events")
    scan = lambda name, limit: states.segment_of(log, at("2024-01-05 00:00:00"), at("2024-01-25 00:00:00"), limit).select(F.lit(name).alias("scan"), "selected", "committed_through", "resume_at", "scan_complete")
    return scan("limited", 500).union(scan("whole", 1 << 30))


def history_pages(spark, d) -> tuple[str, str]:
    """The events as pages of a registry, a day each, in the shared folder: its path and the first page."""
    events = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.struct(c("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), c("event_type").alias("action"), "user_id").alias("e"))
    pages = events.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct(c("e.date").alias("at"), c("e.id").alias("id"), "e"))), lambda x: x["e"]).alias("transactions"))
    days = sorted(r["day"] for r in events.select("day").distinct().collect())  # the days of the log
    after = F.create_map(*(F.lit(x) for a, b in zip(days, [*days[1:], None], strict=True) for x in (a, b)))
    cursor = lambda day: F.struct(F.lit("2024").alias("date"), F.lit(1000).alias("page_size"), day.alias("from_id"))
    whole = pages.select("day", cursor(c("day")).alias("cursor"), "transactions", F.when(after[c("day")].isNotNull(), cursor(after[c("day")])).alias("next"))
    import uuid

    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    name = F.concat(F.lit("2024~1000~"), "day")
    whole.select(name.alias("page"), F.to_json(F.struct("cursor", "transactions", "next")).alias("value")).repartition("page").write.partitionBy("page").text(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path, f"2024~1000~{days[0]}" if days else "none"


@query("src_registry_history", "SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, CAST(event_id AS VARCHAR)) - 1 AS position, CAST(event_id AS VARCHAR) AS id, event_type AS action, '{\"user_id\": ' || user_id || '}' AS payload FROM events")
def registry_history(spark, d):
    path, start = history_pages(spark, d)
    spark.dataSource.register(registry.RegistryHistory)
    rows = spark.read.format("registry_history").option("path", path).option("start", start).load()
    return rows.select(F.right("page", F.lit(10)).alias("day"), F.col("position").cast("bigint").alias("position"), "id", "action", "payload")


#: Four pages a sale: a deposit that is no price, the price and days of the conditions, a notice whose price may differ, with land and occupancy, and a diagnostic.
PAGE_TEXT = (
    "CASE k WHEN 0 THEN 'Le chèque représente 10% du montant de la mise à prix, avec un minimum de 3.000 euros.' "
    "WHEN 1 THEN 'Mise à prix adjudication. L’adjudication aura lieu en un seul lot sur la mise à prix ci-après indiquée : ' || CAST(starting_price_eur AS STRING) || ' € (euros). Audience d’adjudication le ' || date_format(sale_date, 'dd/MM/yyyy') || ' à 14h30. Visites sur place le ' || date_format(sale_date - 7, 'dd/MM/yyyy') || ' à 10h00.' "
    "WHEN 2 THEN 'Mise à prix : ' || CAST(starting_price_eur + CASE WHEN sale_id % 3 = 0 THEN 1000 ELSE 0 END AS STRING) || ',00 €. Surface habitable : ' || CAST(surface_m2 AS STRING) || ' m².' || CASE WHEN land_surface_m2 > 0 THEN ' Contenance cadastrale : ' || CAST(land_surface_m2 AS STRING) || ' m².' ELSE '' END || CASE occupancy_status WHEN 'vacant' THEN ' Bien libre de toute occupation.' WHEN 'rented' THEN ' Bien loué suivant bail en cours.' WHEN 'occupied' THEN ' Bien occupé.' WHEN 'squatted' THEN ' Bien squatté.' ELSE '' END "
    "ELSE 'Diagnostic de performance énergétique. Classe énergie : ' || coalesce(dpe_class, 'N') || '. GES : C. Consommation énergétique : 394 kWhEP/m²/an.' || CASE WHEN sale_id % 2 = 1 THEN ' Surface de référence : ' || CAST(surface_m2 + 1 AS STRING) || ',50 m².' ELSE '' END END"
)
PAGES = ["sale_id", "CASE WHEN k < 2 THEN 0 ELSE k - 1 END AS document_no", "'https://f.example/' || CAST(sale_id AS STRING) AS document_url", "'x' AS document_label", "CASE WHEN k < 2 THEN 'CCV' WHEN k = 2 THEN 'Avis simplifié' ELSE 'diagnostics' END AS document_type", "CASE k WHEN 0 THEN 4 WHEN 1 THEN 17 WHEN 2 THEN 1 ELSE 2 END AS page_number", "9e-1 AS page_confidence"]
WON = "starting_price_eur IS NOT NULL"
FACTS = (
    f"SELECT sale_id, 'starting_price' AS fact, CAST(starting_price_eur AS VARCHAR) || '.00' AS value, CASE WHEN sale_id % 3 = 0 OR surface_m2 IS NULL THEN 1 ELSE 2 END AS support, 'cahier_conditions_vente' AS document_type, 17 AS page_number, CASE WHEN sale_id % 3 = 0 AND surface_m2 IS NOT NULL THEN CAST(starting_price_eur + 1000 AS VARCHAR) || '.00:1' ELSE '' END AS lost FROM sales WHERE {WON} "
    "UNION ALL SELECT sale_id, 'surface', CASE WHEN sale_id % 2 = 1 THEN CAST(surface_m2 + 1 AS VARCHAR) || '.50' ELSE CAST(surface_m2 AS VARCHAR) || '.00' END, 1, CASE WHEN sale_id % 2 = 1 THEN 'diagnostics_techniques' ELSE 'annonce_vente' END, CASE WHEN sale_id % 2 = 1 THEN 2 ELSE 1 END, CASE WHEN sale_id % 2 = 1 AND starting_price_eur IS NOT NULL THEN CAST(surface_m2 AS VARCHAR) || '.00:1' ELSE '' END FROM sales WHERE surface_m2 IS NOT NULL AND (starting_price_eur IS NOT NULL OR sale_id % 2 = 1) "
    "UNION ALL SELECT sale_id, 'energy', '{\"dpe\":\"' || coalesce(dpe_class, 'C') || '\",\"ges\":\"C\",\"consumption\":394.0}', 1, 'diagnostics_techniques', 2, '' FROM sales WHERE sale_id % 2 = 0 OR surface_m2 IS NOT NULL "
    f"UNION ALL SELECT sale_id, 'sale_date', strftime(sale_date, '%Y-%m-%dT14:30:00'), 1, 'cahier_conditions_vente', 17, '' FROM sales WHERE {WON} AND sale_date IS NOT NULL "
    f"UNION ALL SELECT sale_id, 'visit_dates', strftime(sale_date - 7, 'Visites sur place le %d/%m/%Y à 10h00'), 1, 'cahier_conditions_vente', 17, '' FROM sales WHERE {WON} AND sale_date IS NOT NULL "
    f"UNION ALL SELECT sale_id, 'land', CAST(land_surface_m2 AS VARCHAR) || '.00', 1, 'annonce_vente', 1, '' FROM sales WHERE {WON} AND surface_m2 IS NOT NULL AND land_surface_m2 > 0 "
    f"UNION ALL SELECT sale_id, 'occupancy', occupancy_status, 1, 'annonce_vente', 1, '' FROM sales WHERE {WON} AND surface_m2 IS NOT NULL AND occupancy_status IN ('vacant', 'rented', 'occupied', 'squatted')"
)


def pages_of(spark, d):
    return spread(sales(spark, d).select("sale_id", "starting_price_eur", "surface_m2", "dpe_class", "land_surface_m2", "sale_date", "occupancy_status"), "sale_id").select("*", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k")).selectExpr(*PAGES, PAGE_TEXT + " AS text")


@query("sc_pdf_facts", S + FACTS)
def pdf_facts(spark, d):
    lost = F.array_join(F.transform("lost", lambda x: F.concat_ws(":", x["value"], x["support"].cast("string"))), ",")
    return facts.document_facts(pages_of(spark, d)).select("sale_id", "fact", "value", F.col("support").cast("int").alias("support"), "document_type", "page_number", lost.alias("lost"))
