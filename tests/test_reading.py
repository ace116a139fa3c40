"""What is read from French text: places of matches, counts, kinds, planning signals, risks."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from gavelspark.functions import numbers, parsing, text
from gavelspark.functions.occurrences import after, around, before, occurrences
from gavelspark.operators import listings, risks
from gavelspark.plans.monitors import TOLD

c = F.col


def over(spark, values, *columns):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string").orderBy("i").select(*columns).collect()


@pytest.mark.parametrize("pattern", [r"\b(?:de\s+)?(\d+)\s*m", r"(a+)b?", r"é(.)?"])
def test_places_of_matches(spark, pattern):
    """As re.finditer has them, with a group, at both ends and none at all."""
    texts = ["de 12 m, 3m et de 4 m", "aab ab a", "éa été é", "", "rien", "x" * 200 + "aab" + "y" * 300]
    got = over(spark, texts, occurrences(c("t"), pattern, 1).alias("o"), occurrences(c("t"), pattern, 1, at_value=True).alias("v"))
    for t, r in zip(texts, got, strict=True):
        want = list(re.finditer(pattern, t, re.I))
        assert [(x.start, x.end, x.term, x.value) for x in r.o] == [(m.start(), m.end(), m[0], m[1] or "") for m in want]
        assert [(x.start, x.end) for x in r.v if x.value] == [m.span(1) for m in want if m[1]]
    assert over(spark, [None], occurrences(c("t"), pattern).alias("o"))[0].o is None


def test_what_stands_around(spark):
    told = F.transform(occurrences(c("t"), "cd"), lambda o: F.struct(before(c("t"), o, 2).alias("b"), after(c("t"), o, 3).alias("a"), around(c("t"), o, 1, 1).alias("r")))
    got = over(spark, ["abcdef cd", "cd"], told.alias("x"))
    assert [[tuple(y) for y in r.x] for r in got] == [[("ab", "ef ", "bcde"), ("f ", "", " cd")], [("", "", "cd")]]


@pytest.mark.parametrize(
    "written,rooms,bedrooms",
    [
        ("Estimez vos frais d'acquisition 5 pièces 3 chambres À propos du bien Maison.", 5, 3),
        ("VISITE : MARDI 16 JUIN 2026 A 09 H 00 1 pièces 34.52 m² superficie À propos du bien CHENOVE (21300), Un appartement situé au rez-de-chaussée", 1, None),
        ("Appartement de type 4 comprenant séjour, cuisine et 3 chambres.", 4, 3),
        ("Appartement de type trois comprenant séjour, cuisine et deux chambres.", 3, 2),
        ("UN APPARTEMENT DE 4 PIÈCES - Pau", 4, None),
        ("Un appartement de 79,06 m², de trois pièces deux places de parking.", 3, None),
        ("Un appartement de 31,60 m² comprenant entrée, salle d'eau avec wc, pièce principale avec placard.", 1, None),
        ("Maison comprenant séjour, chambre n°1, chambre n°2 et chambre n°3.", None, 3),
        ("Données des valeurs foncières Type de bien Date de vente Surface Nb de pièces Prix de vente Maison 100 m2 4 410000 euros.", None, None),
    ],
)
def test_counts_of_listings(spark, written, rooms, bedrooms):
    assert tuple(over(spark, [written], *parsing.dwelling_counts(c("t")))[0]) == (rooms, bedrooms)


def test_leaves_keep_other_columns_and_depth(spark):
    deep = "1"
    for _ in range(parsing.DEPTH + 2):
        deep = '{"k": ' + deep + "}"
    rows = spark.createDataFrame([(1, "x", '{"b": [true, 2.5, {"c": "d"}], "a": ""}'), (2, "y", deep)], "i long, n string, t string").transform(parsing.key_values, "t").collect()
    assert {tuple(r) for r in rows if r.i == 1} == {(1, "x", "a", ""), (1, "x", "b[0]", "true"), (1, "x", "b[1]", "2.5"), (1, "x", "b[2].c", "d")}
    (last,) = (r for r in rows if r.i == 2)
    assert last.path == ".".join("k" * (parsing.DEPTH)) or last.path.count("k") >= parsing.DEPTH
    assert last.value.startswith('{"k"')


def test_no_distance_without_a_place(spark):
    df = spark.createDataFrame([(48.0, 2.0), (None, 2.0), (48.0, None)], "a double, b double")
    got = [r.d for r in df.select(numbers.haversine_m(c("a"), c("b"), F.lit(48.0), F.lit(2.1)).alias("d")).collect()]
    assert 7_000 < got[0] < 8_000 and got[1:] == [None, None]


def test_kinds_of_documents_and_listings_for_null(spark):
    got = over(spark, [None], text.document_type(c("t")), text.property_type_of(c("t")), text.occupancy_of(c("t")), text.sale_state_of(c("t"), F.lit(None).cast("date"), F.current_date()))
    assert tuple(got[0]) == ("other", "other", None, "unknown")


def test_planning_signals_of_two_files(spark):
    """The text's own confidence goes first; equal excerpts of two files, or of two pages, are two signals."""
    rows = [(1, 0, "sale_text", "Zone inondable, PLU", 0.5, "Titre annonce", None, None), (1, 1, "sale_text", "zone  inondable, plu", 0.55, "Description annonce", None, None)]
    rows += [(1, 2, "pdf", "Zone inondable, PLU", None, None, "u1", 1), (1, 3, "pdf", "Zone inondable, PLU", 0.9, None, "u1", 2), (1, 4, "pdf", "Zone inondable, PLU", 0.0, None, "u2", 1)]
    df = spark.createDataFrame(rows, "sale_id long, ordinal int, source_kind string, text string, confidence double, source_name string, document_url string, page_number int")
    got = sorted(listings.planning_signals(df).collect(), key=lambda r: r.ordinal)
    assert [(r.ordinal, r.kind, round(r.confidence, 2)) for r in got] == [(0, "zoning", 0.5), (2, "zoning", 0.72), (3, "zoning", 0.9), (4, "zoning", 0.72)]
    assert len({r.signal_key for r in got}) == 4
    bare = df.select("sale_id", "ordinal", "source_kind", "text").where("ordinal = 0")
    assert [round(r.confidence, 2) for r in listings.planning_signals(bare).collect()] == [0.62]


@pytest.mark.parametrize("told", TOLD, ids=[str(i) for i in range(len(TOLD))])
def test_risks_of_texts(spark, told):
    written, kind, document, want = told
    df = spark.createDataFrame([(7, written, kind, document)], "page long, text string, source_kind string, document_type string")
    got = risks.risk_occurrences(df).collect()
    by = {(label): list(rows) for label, rows in itertools.groupby(sorted(got, key=lambda r: r.risk_label), key=lambda r: r.risk_label)}
    assert sorted((label, rows[0].severity, rows[0].confidence, len(rows)) for label, rows in by.items()) == sorted(want)
    for r in got:
        assert written[r.start : r.end] == r.term and r.term in r.excerpt and r.page == 7 and r.score_impact == -r.severity


def test_three_occurrences_at_most_and_negated_ones_none(spark):
    far = " Texte sans rapport avec le reste, long comme un jour sans pain et sans fin aucune ; encore un peu plus loin, toujours rien a dire ici." * 2
    many = "".join(f"{n} présence d'amiante dans les dalles.{far}" for n in range(6)) + "Absence de termites. Il n'a pas été repéré de plomb. Pas de travaux."
    df = spark.createDataFrame([(many, "pdf", "pv_huissier")], "text string, source_kind string, document_type string")
    got = risks.risk_occurrences(df).collect()
    assert [r.risk_label for r in got] == ["amiante"] * 3 and [r.start for r in got] == sorted(r.start for r in got)
