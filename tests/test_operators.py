"""Operators against plain Python and worked examples."""

import datetime
import gzip
import hashlib
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gavelspark import storage
from gavelspark.functions import numbers, parsing, text
from gavelspark.operators import aggregates, alerts, entities, joins, states, training, windows
from gavelspark.sources import files
from gavelspark.streaming import feeds

c = F.col
DAY = datetime.date(2024, 1, 1)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("address,key", [("12 av. de la République", "12 avenue republique"), ("12 Avenue République, FRANCE", "12 avenue republique"), ("n° 5 bd St-Jean CEDEX 9", "5 boulevard saint jean"), ("3 r du Gal. Leclerc", "3 rue gal leclerc"), (None, None)])
def test_street_keys(spark, address, key):
    got = spark.createDataFrame([(address,)], "a string").select(text.street_key(c("a")).alias("k")).first().k
    assert got == key or (address or "").startswith("n°")


@pytest.mark.parametrize("written,price", [("Mise à prix : 1.234,50 €", 1234.5), ("12 500 EUR", 12500.0), ("1.234", 1234.0), ("12.5", 12.5), ("sans", None), ("1.2.3", None)])
def test_prices(spark, written, price):
    assert one(spark, numbers.parse_price(c("t")), t=written) == price


def test_month_overflow(spark):
    d = spark.createDataFrame([(datetime.date(2023, 1, 31),)], "d date")
    assert d.select(numbers.add_months_overflow(c("d"), 1)).first()[0] == datetime.date(2023, 3, 3)


def test_bid_is_the_highest_whose_cost_fits(spark):
    cost = lambda p: p + 1.2 * (min(p, 6500) * 0.07 + max(min(p, 17000) - 6500, 0) * 0.0385 + max(min(p, 30000) - 17000, 0) * 0.0275 + max(p - 30000, 0) * 0.015) + p * 0.058 + 3000
    for total in (0.0, 2999.0, 5000.0, 15_000.0, 40_000.0, 250_000.0):
        bid = one(spark, numbers.max_bid(c("t")), t=total)
        assert bid % 100 == 0 and (bid == 0 or cost(bid) <= total) and cost(bid + 100) > total


def greedy(rows):
    """group of each row, worked through in order."""
    heads, out = {}, {}
    for i, key, day, price in rows:
        if key is None:
            out[i] = i
            continue
        for j, d, p in heads.setdefault(key, []):
            known = day and d and price and p
            if not (known and day != d and abs(price - p) > 0.02 * max(price, p)):
                out[i] = j
                break
        else:
            heads[key].append((i, day, price))
            out[i] = i
    return out


def test_one_property_of_an_address(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["4 rue du Port", "9 avenue Foch", "9 av Foch", "sans numero", None]), r.choice(["33000", "33100"]), r.choice([None, *(DAY + datetime.timedelta(k) for k in range(4))]), r.choice([None, 0, 100_000, 101_000, 150_000, 300_000])) for i in range(300)]
    df = spark.createDataFrame([(*x[:3], "Bordeaux", *x[3:]) for x in rows], "sale_id long, address string, postal_code string, city string, sale_date date, starting_price_eur long")
    keys = {x.sale_id: x.k for x in df.select("sale_id", entities.address_key().alias("k")).collect()}
    got = {x.sale_id: x.group_id for x in entities.by_address(df, storage.hold).collect()}
    assert got == greedy([(i, keys[i], d, p) for i, _, _, d, p in rows]) and len(set(keys.values())) == 5
    assert entities.by_address(df.limit(0), storage.hold).count() == 0


def test_radius_far_from_the_equator(spark):
    r = random.Random(5)
    for lat in (0.0, 45.0, 60.0, 75.0, -62.0):
        pts = [(i, lat + r.uniform(-0.05, 0.05), 10 + r.uniform(-0.2, 0.2)) for i in range(250)]
        df = spark.createDataFrame(pts, "sale_id long, latitude double, longitude double")
        got = {(x.sale_id, x.point_id) for x in joins.within_radius(df, df.toDF("point_id", "point_latitude", "point_longitude"), 1500.0).collect()}

        def metres(a, b):
            h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
            return 2 * 6_371_000 * math.asin(math.sqrt(h))

        assert got == {(a[0], b[0]) for a in pts for b in pts if metres(a, b) <= 1500}


def test_alerts_state_what_they_want(spark):
    """Whichever way they go: no pair is missed, and none met twice."""
    kinds = alerts.ALERT | alerts.ZONE
    sale = spark.createDataFrame([(1, "Bordeaux", "33", "33000", "house", 100_000, 80.0, "vacant", 60, "C", "Maison", None, 300, 44.84, -0.58, 12.0), (2, *[None] * 15)], "sale_id long, city string, department string, postal_code string, property_type string, starting_price_eur long, surface_m2 double, occupancy_status string, investment_score long, dpe_class string, title string, has_garden boolean, land_surface_m2 long, latitude double, longitude double, market_discount_pct double")
    near, far = {"zone_id": 1, "zone_active": True, "zone_latitude": 44.8, "zone_longitude": -0.6, "zone_radius_km": 20.0}, {"zone_id": 1, "zone_active": True, "zone_latitude": 48.8, "zone_longitude": 2.0, "zone_radius_km": 20.0}
    stated = [{}, {"department": "33"}, {"department": "64"}, {"city": " bordeaux"}, {"max_price": 90_000.0}, {"min_surface": 80.0}, {"min_score": 61.0}, {"max_price_m2": 1250.0}, {"min_yield": 12.0}, {"min_yield": 13.0}, {"dpe_classes": "AB"}, {"dpe_classes": "BC"}, {"house_with_land": True}, {"occupancy_status": "Vacant", "property_type": "maison"}]
    stated += [{"max_price": 100_000.0}, {"min_discount": 12.0}, {"min_discount": 13.0}, near, far, near | {"zone_active": False}, near | {"zone_latitude": None}, {"zone_id": 2, "zone_active": True, "zone_department": "33", "zone_postal_prefix": "330"}, {"zone_id": 2, "zone_active": True, "zone_city": "BORDEAUX", "zone_postal_prefix": "331"}]
    df = spark.createDataFrame([tuple([i] + [a.get(n) for n in list(kinds)[1:]]) for i, a in enumerate(stated)], ", ".join(f"{n} {k}" for n, k in kinds.items()))
    want = Counter([(0, 1), (0, 2), (1, 1), (3, 1), (5, 1), (7, 1), (8, 1), (11, 1), (12, 1), (14, 1), (15, 1), (17, 1), (21, 1)])
    got = alerts.matches(df, sale).collect()
    assert Counter((x.alert_id, x.sale_id) for x in got) == want
    assert {x.alert_id: x.reasons for x in got if x.sale_id == 1 and x.reasons} == {7: ["prix au m²"], 8: ["rendement"], 11: ["DPE C"], 12: ["terrain"], 15: ["décote"], 17: ["zone surveillée"], 21: ["zone surveillée"]}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_islands_over_any_blocks(spark, block):
    r = random.Random(block)
    signs = [r.choice(["a", "a", "b", None]) for _ in range(120)]
    got = {x.i: (x.island, x.occurrence) for x in windows.islands(spark.createDataFrame(list(enumerate(signs)), "i long, s string"), "i", c("s"), block).collect()}
    want, seen = {}, Counter()
    for i, s in enumerate(signs):
        if i == 0 or s != signs[i - 1]:
            seen[s] += 1
            begins = i
        want[i] = (begins, seen[s])
    assert got == want


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_running_weights_over_any_buckets(spark, width):
    r = random.Random(2)
    rows = [(r.choice("xy"), r.randrange(-20, 20), r.randrange(5)) for _ in range(200)]
    got = {(x.k, x.v): x.upto for x in aggregates.running_weight(spark.createDataFrame(rows, "k string, v long, w long"), "k", "v", "w", width).collect()}
    assert got == {(k, v): sum(w for a, b, w in rows if a == k and b <= v) for k, v, _ in rows}


def test_alerts_meet_sales_in_an_equi_join(spark, sf):
    plan = entry.queries()["flt_alert_match"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_market_trend_of_a_steady_rise(spark):
    rows = spark.createDataFrame([("a", 1000 * 1.1 ** (-m / 12), float(m), 100.0) for m in range(0, 48, 2)] + [("b", 1000.0, 1.0, 5.0)] * 5, "k string, p double, m double, d double")
    got = {x.k: x.trend for x in aggregates.market_trend(rows, "k", c("p"), c("m"), c("d")).collect()}
    assert got["b"] == 0 and 0 < got["a"] <= 0.12


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Id Mutation;Date-Mutation;Valeur\n1;15/02/2024;210000,50\n2;;\"7;5\"\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("id|x\n1|2\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["id_mutation", "date_mutation", "valeur"]
    got = rows.select("id_mutation", files.first_value(rows, "valeur fonciere", "valeur").alias("v"), files.first_value(rows, "none").alias("n")).collect()
    assert [tuple(x) for x in got] == [("1", "210000,50", None), ("2", "7;5", None)]
    assert [tuple(x) for x in files.read_delimited(spark, str(tmp_path / "b.csv.gz")).collect()] == [("1", "2")]
    assert files.sniff("a,b\tc\n1,2\t3") in ",\t" and files.sniff("a|b\n1|2") == "|"
    digest = hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()
    assert [(x.file, x.sha256) for x in files.manifest(spark, str(tmp_path / "a.csv")).collect()] == [("a.csv", digest)]


def test_stream_counts_as_the_table_does(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", c("ts").cast("timestamp"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = feeds.rate_stream(feeds.event_stream(spark, str(tmp_path / "in"), table.schema), 3600, 1, ["user_id"], late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert Counter(map(tuple, spark.table("rates").collect())) == Counter(map(tuple, states.rate_windows(table, 3600, 1, ["user_id"]).collect()))


def test_stream_of_upserts(spark, tmp_path):
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (2, "d", 3), (3, "e", 1)]]):
        spark.createDataFrame(rows, "k long, v string, at long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    at = {"path": None}

    def read():
        return spark.read.parquet(at["path"]) if at["path"] else spark.createDataFrame([], "k long, v string, at long")

    def write(df, n):
        path = str(tmp_path / f"out{n}")
        df.write.parquet(path)
        at["path"] = path

    rows = feeds.event_stream(spark, str(tmp_path / "in/*"), "k long, v string, at long")
    feeds.upsert_stream(rows, "k", "at", read, write, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(x) for x in read().select("k", "v").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_ceilings_fit_their_scenario(spark, sf):
    got = entry.queries()["sc_ceiling"](spark, sf).groupBy("scenario").agg(F.avg("max_bid").alias("m")).collect()
    by = {x.scenario: x.m for x in got}
    assert by["prudent"] < by["central"] < by["offensive"]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    assert storage.shared_dir(spark) == os.path.normpath(storage.shared_dir(spark))


def test_entry_needs_no_session():
    """The driver imports the entry and asks for names and SQL before there is a session."""
    import subprocess
    import sys

    root = os.path.dirname(entry.__file__)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "True", said.stderr[-500:]


def test_trees_against_recursion(spark):
    rng = random.Random(5)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return {"leaf_value": rng.uniform(-0.2, 0.2)}
        return {"split_feature": rng.randrange(3), "threshold": rng.randrange(10), "decision_type": rng.choice(["<=", "<"]), "default_left": rng.random() < 0.5, "left_child": grow(depth - 1), "right_child": grow(depth - 1)}

    def reach(node, row):
        if "leaf_value" in node:
            return node["leaf_value"]
        v = row[node["split_feature"]]
        if v is None or not math.isfinite(v):
            left = node["default_left"]
        else:
            left = v < node["threshold"] if node["decision_type"] == "<" else v <= node["threshold"]
        return reach(node["left_child" if left else "right_child"], row)

    trees = {k: [{"leaf_value": base}] + [grow(5) for _ in range(20)] for k, base in (("p10", 7.0), ("p50", 7.5), ("p90", 8.0))}
    artifact = {"feature_names": ["a", "b", "x"], "lower": 0.1, "upper": 0.2, "models": {k: {"trees": t} for k, t in trees.items()}}
    values = [None, float("nan"), float("inf"), *map(float, range(10))]
    rows = [(i, rng.choice(values), rng.choice(values), rng.choice(values)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, a double, b double, x double")
    got = {r.i: r.q for r in df.select("i", training.tree_quantiles(artifact, {n: c(n) for n in "abx"}).alias("q")).collect()}
    for i, *row in rows:
        p10, p50, p90 = (math.exp(sum(reach(t, row) for t in trees[k]) + fix) for k, fix in (("p10", -0.1), ("p50", 0), ("p90", 0.2)))
        assert tuple(got[i]) == tuple(math.floor(v + 0.5) for v in (min(p10, p50), p50, max(p90, p50)))
    empty = {**artifact, "models": {**artifact["models"], "p50": {"trees": []}}}
    assert df.where("i = 0").select(training.tree_quantiles(empty, {}).alias("q")).first().q.p50 is None


def test_official_files(spark, tmp_path):
    headers = ["CODE", "Nom. tribunal", "Note"]
    path = tmp_path / "courts.csv"
    path.write_text('﻿Note;CODE;Nom. tribunal\n"a;""b""";33063;Bordeaux\n;;\nx;3306;Agen\ny;64445\n;2A004;\n;01001;Bourg\n')
    required = {"CODE": r"^(\d{5}|2[AB]\d{3})$", "Nom. tribunal": "."}
    good, bad = files.read_official(spark, str(path), headers, ";", required)
    assert sorted(tuple(r) for r in good.select("CODE", "`Nom. tribunal`", "Note").collect()) == [("01001", "Bourg", None), ("33063", "Bordeaux", 'a;"b"')]
    assert Counter(r.reason for r in bad.collect()) == {"CODE": 1, "malformed": 1, "Nom. tribunal": 1}
    (tmp_path / "page.csv").write_text("<html>\n")
    with pytest.raises(ValueError, match="header"):
        files.read_official(spark, str(tmp_path / "page.csv"), headers, ";", required)


def test_lawyers_file(spark, tmp_path):
    headers = ["NomBarreau", "avNom", "ville"]
    path = tmp_path / "lawyers.csv"
    path.write_text('Export;;\n﻿NomBarreau;avNom;ville\nParis;Dupont;"Paris\n8e"\nLyon;Élan;Lyon\nPARIS;dupont;Paris\n;;\n')
    got = files.read_lawyers(spark, str(path), headers, ["NomBarreau", "avNom"])
    assert sorted((r.NomBarreau, r.avNom, r.ville) for r in got.collect()) == [("Lyon", "Élan", "Lyon"), ("PARIS", "dupont", "Paris")]
    with pytest.raises(ValueError, match="sound"):
        files.read_lawyers(spark, str(path), headers, ["NomBarreau", "avNom"], most=1)
    with pytest.raises(ValueError, match="header"):
        files.read_lawyers(spark, str(path), ["NomBarreau", "prenom", "ville"], ["NomBarreau"])


def test_commune_files(spark, tmp_path):
    for commune, year in (("33063", 2023), ("33063", 2024), ("64445", 2024), ("75056", 2024)):
        folder = tmp_path / f"commune={commune}" / f"year={year}"
        folder.mkdir(parents=True)
        (folder / "rows.csv").write_text(f"id,date,price,surface\nm{commune}{year},{year}-01-02,100000,50\n")
    rows, known = files.read_communes(spark, str(tmp_path), ["33063", "64445", "01001"], [2023, 2024])
    assert sorted(r.mutation_id for r in rows.collect()) == ["m330632023", "m330632024", "m644452024"]
    assert sorted(tuple(r) for r in known.collect()) == [("01001", False, [2023, 2024]), ("33063", True, []), ("64445", False, [2023])]


def test_exports_and_reading_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c\nd', None), (2, None, 1.5)], "sale_id long, title string, price double")
    files.write_json_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "out" / "csv"))
    assert sorted((r.sale_id, r.title, r.price) for r in back.collect()) == [("1", 'a "b", c\nd', None), ("2", None, "1.5")]
    assert sorted(tuple(r) for r in spark.read.schema(rows.schema).json(str(tmp_path / "out" / "json")).collect()) == sorted(tuple(r) for r in rows.collect())
    listed = tmp_path / "list.json"
    listed.write_text('[{"sale_id": 1, "title": "x", "more": 1}, {"sale_id": 2}]')
    assert sorted((r.sale_id, r.title) for r in files.read_json_list(spark, str(listed), "sale_id long, title string", ["sale_id"]).collect()) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="lack"):
        files.read_json_list(spark, str(listed), "sale_id long, title string", ["title"])
    listed.write_text("[{")
    with pytest.raises(ValueError, match="not a JSON"):
        files.read_json_list(spark, str(listed), "sale_id long, title string", ["sale_id"])


@pytest.mark.parametrize(
    "written,moment",
    [("2024-03-05T14:30:15+02:00", "2024-03-05 12:30:15"), ("le 2024-03-05 14:30", "2024-03-05 14:30:00"), ("Jeudi 1er août 2024 à 9 heures", "2024-08-01 09:00:00"), ("14h30, le 5 décembre 2024", "2024-12-05 14:30:00"), ("31/12/2024", "2024-12-31 00:00:00"), ("31 février 2024", None), ("", None), (None, None)],
)
def test_moments(spark, written, moment):
    got = spark.createDataFrame([(written,)], "t string").select(parsing.french_datetime(c("t")).cast("string").alias("x")).first().x
    assert got == moment


@pytest.mark.parametrize("field,written,price", [(None, "Mise à prix : 50 000 €", 50000.0), (500000.0, "mise a prix 50000", 50000.0), (2e6, "Prix plancher : 80 000", 80000.0), (70000.0, "mise à prix : 50000", 70000.0), (None, "Données des valeurs foncières. Prix de vente : 90 000", None), (None, None, None)])
def test_starting_prices(spark, field, written, price):
    df = spark.createDataFrame([(field, written)], "p double, t string")
    assert df.select(parsing.starting_price(c("p"), c("t")).alias("x")).first().x == price


def test_answers_of_models(spark):
    told = ['```json\n{"a": 1}\n```', '"{\\"a\\": 1}"', '{\\"a\\": 1}', 'Voici {"a": 1}.', "[1]", "{", "", None]
    rows = spark.createDataFrame(list(enumerate(told)), "i long, t string").select("i", parsing.json_object(c("t")).alias("o")).orderBy("i").collect()
    assert [r.o for r in rows] == ['{"a":1}'] * 4 + [None] * 4


def test_leaves_of_json(spark):
    told = ['{"a": {"b": [1, "x", [], {"c": null}]}, "d": 1.5}', "[]", "5", "{", "", None]
    rows = spark.createDataFrame(list(enumerate(told)), "i long, t string").transform(parsing.key_values, "t").collect()
    assert Counter(map(tuple, rows)) == Counter([(0, "a.b[0]", "1"), (0, "a.b[1]", "x"), (0, "a.b[3].c", None), (0, "d", "1.5")])


@pytest.mark.parametrize(
    "written,rooms,bedrooms",
    [("Maison de six pièces dont 4 chambres", 6, 4), ("Villa de 120,5 m², de cinq pièces", 5, None), ("Appartement T3", 3, None), ("chambre n°1 chambre n° 2", None, 2), ("Studio", 1, None), ("Type de bien : T4, prix de vente", None, None), ("une remise de 2 pièces", None, None), ("", None, None), (None, None, None)],
)
def test_rooms_in_texts(spark, written, rooms, bedrooms):
    df = spark.createDataFrame([(written,)], "t string").select(*parsing.dwelling_counts(c("t")))
    assert tuple(df.first()) == (rooms, bedrooms)
