"""Work that grows with the rows, not with their pairs; texts that are only searched where something may be found."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gavelspark.functions.occurrences import quick
from gavelspark.operators import entities, facts, joins, listings, nearby, reports, valuation
from gavelspark.sources import adapters
from gavelspark.storage import hold

c = F.col


def joined_rows(df) -> int:
    """Rows that the joins of a frame that has run gave."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            found = p.metrics().get("numOutputRows")
            total += found.get().value() if "Join" in name and found.isDefined() else 0
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


@pytest.mark.parametrize("pattern", [*facts.PRICES, *facts.SURFACES, *facts.CLASSES, *facts.EMISSIONS, facts.PARTLY, facts.DEPOSIT, facts.OF_ENERGY])
def test_quick_patterns_find_the_same(pattern):
    texts = ["Mise à prix : 12.000 €", "x mise à prix 1 €", "remise à prix : 5 €", "caution, minimum de 3", "10 % du montant de la mise a prix", "environ 35 m²", "d'environ 35 m² total: 3 m2", "DPE : C, GES: A", "les mesurages n’ont pu être réalisés dans leur intégralité; mesurage incomplet", "12 kg CO2/m²/an ges 14 kg co2/m2"]
    for t in texts:
        plain, fast = ([m.span() for m in re.finditer(p, t, re.I | re.S)] for p in (pattern, quick(pattern)))
        assert plain == fast


def test_word_bounds_are_asked_for_last():
    assert quick(r"\bmise\s+a") == r"(?=mis)\bmise\s+a"
    assert quick(r"\b(?:d')?environ|[a|b]\b") == r"(?=d|env)\b(?:d')?environ|[a|b]\b"


def test_pages_are_dealt_to_all_partitions(spark, sf):
    from gavelspark.plans.monitors import pages_of

    assert pages_of(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_diagnostics_of_one_address_make_no_pairs_of_rows(spark):
    where = [F.lit("33000").alias("postal_code"), F.lit("33").alias("department"), F.lit("Bordeaux").alias("city"), F.lit("7 rue du Marché").alias("address")]
    at = [(44 + c("id") % 2).cast("double").alias("latitude"), F.lit(0.5).alias("longitude")]
    sales = spark.range(300).select(c("id").alias("sale_id"), *where, *at)
    diagnostics = spark.range(301).select((c("id") + 1000).alias("diagnostic_id"), *where, *at, (c("id") % 3 / 10 + 0.6).alias("address_score"))
    df = listings.energy_matches(sales, diagnostics)
    got = {r.sale_id: (r.diagnostic_id, r.confidence) for r in df.collect()}
    assert got == {i: (1000 + i % 2, 0.95) for i in range(300)}
    assert joined_rows(df) < 300 * 10


def test_points_of_one_place_make_no_pairs_of_rows(spark):
    subjects = spark.range(200).select(c("id").alias("sale_id"), F.lit(44.0).alias("latitude"), F.lit(0.5).alias("longitude"))
    points = spark.range(500).select(c("id").alias("point_id"), F.lit(44.0).alias("latitude"), F.lit(0.5).alias("longitude"))
    held = []
    df = nearby.nearest(subjects, points, "sale_id", 3, 400.0, lambda d, n: held.append(d) or hold(d, n))
    assert sorted((r.sale_id, r.point_id, r.place) for r in df.collect()) == [(s, p, p + 1) for s in range(200) for p in range(3)]
    assert all(d.count() <= 3 for d in held)


def test_each_context_pair_once_however_often_it_agrees(spark):
    day = lambda n: F.date_add(F.lit("2001-01-01").cast("date"), n)
    made = lambda rows, p: spark.createDataFrame(rows, "id long, parcel_id string, d int, address_key long, postal_code string").select(c("id").alias(f"{p}_id"), "parcel_id", day(c("d")).alias(f"{p}_date"), "address_key", "postal_code")
    candidates = [(1, "p", 0, 7, "x"), (1, "q", 0, 7, "x"), (2, "p", 31, 7, None), (3, "r", 90, None, "x"), (3, "r", 0, 7, "x"), (4, None, 60, 8, "y")]
    lots = [(1, "p", 10, 7, "x"), (2, "q", 61, 7, "x"), (3, "r", 30, 9, "x"), (3, "p", 62, 8, "y")]
    df = joins.match_contexts(made(candidates, "candidate"), made(lots, "lot"))
    want = {(a[0], b[0]) for a in candidates for b in lots if (a[1] and a[1] == b[1]) or (abs(a[2] - b[2]) <= 30 and ((a[3] and a[3] == b[3]) or (a[4] and a[4] == b[4])))}
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    hot = [(i, str(i), i * 40, 7, str(i)) for i in range(300)]
    df = joins.match_contexts(made(hot, "candidate"), made([(i, str(-1 - i), d, k, str(-1 - i)) for i, _, d, k, _ in hot], "lot"))
    assert len(df.collect()) == 300 and joined_rows(df) < 300 * 10


def test_contexts_agree_in_commune_and_city_too(spark):
    """Before, only parcel, address and postal code were compared. Against all pairs; no join's pairs are gathered again."""
    rnd = random.Random(5)
    made = lambda n, ids: [(rnd.randrange(ids), rnd.choice([None, "p", "q", "r"]), rnd.choice([None, *range(0, 400, 7)]), *(rnd.choice([None, *(f"{k}{i}" for i in range(9))]) for k in "aic"), rnd.choice([None, "Pau", "PAU", "pau", "Lens"])) for _ in range(n)]
    frame = lambda rows, p: spark.createDataFrame(rows, "id long, parcel_id string, d int, address_key string, insee_code string, postal_code string, city string").select(c("id").alias(f"{p}_id"), "parcel_id", F.date_add(F.lit("2001-01-01").cast("date"), c("d")).alias(f"{p}_date"), "address_key", "insee_code", "postal_code", "city")
    same = lambda x, y: x is not None and x == y
    low = lambda x: x and x.lower()
    for ids in (40, 5000):
        candidates, lots = made(120, ids), made(120, ids)
        df = joins.match_contexts(frame(candidates, "candidate"), frame(lots, "lot"))
        want = {(a[0], b[0]) for a in candidates for b in lots if same(a[1], b[1]) or (a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 30 and (any(same(a[i], b[i]) for i in (3, 4, 5)) or same(low(a[6]), low(b[6]))))}
        assert sorted(map(tuple, df.collect())) == sorted(want) and want
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Join")]


def test_points_may_go_to_the_cells_instead(spark):
    at = lambda n, m: [(44 + c("id") * n % 97 / 2000.0), (0.5 + c("id") * m % 89 / 2000.0)]
    subjects = spark.range(150).select(c("id").alias("sale_id"), *(x.alias(y) for x, y in zip(at(13, 7), ("latitude", "longitude"), strict=True)))
    points = spark.range(150).select(c("id").alias("point_id"), *(x.alias(y) for x, y in zip(at(11, 17), ("point_latitude", "point_longitude"), strict=True)))
    one, other = (sorted((r.sale_id, r.point_id) for r in joins.within_radius(subjects, points, 900.0, widen_points=w).collect()) for w in (False, True))
    assert one == other and one


def test_radius_pairs_places_not_rows(spark):
    at = [(44 + c("id") % 5 * 0.004).alias("latitude"), (0.5 + c("id") % 3 * 0.005).alias("longitude")]
    rows = spark.range(600).select(c("id").alias("sale_id"), *at).union(spark.createDataFrame([(900, None, 0.5), (901, 60.0, 0.5), (901, 60.0, 0.5)], "sale_id long, latitude double, longitude double"))
    df = joins.neighbours(rows, 1000.0, 4, chunk=15)
    got = sorted(tuple(r) for r in df.collect())
    assert joined_rows(df) < len(got) / 10
    points = rows.toDF("point_id", "point_latitude", "point_longitude")
    by_rows = joins.within_radius(rows, points, 1000.0, c("sale_id") != c("point_id"))
    assert got == sorted((r.sale_id, r.point_id, round(r.distance_m, 2)) for r in by_rows.collect()) and len(got) > 10_000


def test_scored_pairs_join_places_not_rows(spark):
    """Before, all rows were joined, and that twice."""
    at = lambda p: [(44 + c("id") % 5 * 0.004).alias(f"{p}latitude"), F.when(c("id") % 50 > 0, 0.5 + c("id") % 3 * 0.005).alias(f"{p}longitude")]
    kind = F.when(c("id") % 4 > 0, c("id").bitwiseAND(1).cast("string")).alias("property_type")
    subjects = spark.range(400).select(c("id").alias("sale_id"), kind, (c("id") % 40 + 10).alias("surface_m2"), *at(""))
    points = spark.range(400).select(c("id").alias("point_id"), kind, (c("id") % 40 + 10).alias("point_surface"), F.lit(90_000).alias("point_price"), F.lit("2001-01-01").cast("date").alias("point_date"), *at("point_"))
    columns = ["sale_id", "surface_m2", "point_id", "point_surface", "price_m2", "months", "distance_m"]
    pairs = valuation.candidates(subjects, points, "2001-09-01").select(*columns).collect()
    far = {}
    for r in pairs:
        far[r.sale_id] = max(far.get(r.sale_id, 0.0), r.distance_m)
    df = valuation.pairs_with_farthest(subjects, points, "2001-09-01", chunk=15).select(*columns, "far")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted((*r, far[r.sale_id]) for r in pairs) and len(got) > 10_000
    assert joined_rows(df) < len(got) / 10


@pytest.fixture
def small_parts(monkeypatch, spark, sf):
    """Register lines dealt over 20 partitions and one more at most."""
    monkeypatch.setattr(adapters, "ROWS", adapters.read(spark, sf, "lineitem").count() // 20)
    return adapters.line_parts(spark, sf)


def most_partitions(df) -> int:
    """Of the plan's exchanges the one with the most."""
    return max(int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", ["join_parcel_self", "agg_distinct_centroid", "agg_parcel_sum_of_max", "set_match_dvf"])
def test_register_lines_go_over_partitions_by_their_number(spark, sf, small_parts, name, monkeypatch):
    df = entry.queries()[name](spark, sf)
    assert most_partitions(df) == small_parts >= 20
    got = sorted(tuple(r) for r in df.collect())
    monkeypatch.setattr(adapters, "FEW", 1 << 30)
    assert got == sorted(tuple(r) for r in entry.queries()[name](spark, sf).collect()) and got


def test_orders_follow_customers_over_partitions_by_their_number(spark, sf, monkeypatch):
    """Before, Spark joined partitions together by size: seven million orders a task at 360 times sf0.1."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    few = sorted(map(tuple, adapters.sales(spark, sf).select("sale_id", "city", "source_name").collect()))
    monkeypatch.setattr(adapters, "ROWS", len(few) // 20)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        df = adapters.sales(spark, sf, deal=True).select("sale_id", "city", "source_name")
        parts = adapters.parts_for(adapters.read(spark, sf, "orders"))
        exchanges = re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
        assert {("o_custkey", str(parts)), ("c_custkey", str(parts))} <= set(exchanges) and parts >= 20
        assert sorted(map(tuple, df.collect())) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_watches_are_dealt_once_by_their_number(spark, sf, small_parts, monkeypatch):
    df = entry.queries()["st_change_feed"](spark, sf)
    parts = adapters.parts_for(adapters.read(spark, sf, "orders"), 4)
    assert most_partitions(df) == parts and df._jdf.queryExecution().executedPlan().toString().count(f", {parts})") == 1
    got = sorted(tuple(r) for r in df.collect())
    monkeypatch.setattr(adapters, "FEW", 1 << 30)
    assert got == sorted(tuple(r) for r in entry.queries()["st_change_feed"](spark, sf).collect()) and got


def test_properties_of_an_address_take_few_rounds(spark):
    """Against a list worked through in order; before, each property took a round of jobs."""
    made, rnd = [], random.Random(3)
    for i in range(2400):
        day = rnd.choice([None, *(datetime.date(2000, 1, 1) + datetime.timedelta(d) for d in range(900))])
        made.append((i * 7 % 2411, day, rnd.choice([None, 0, -5, rnd.randint(1, 60), rnd.randint(1000, 90_000), rnd.randint(1000, 90_000), rnd.randint(10**14, 10**15)]), f"{i % 3 + 1} rue du Marché", "x", rnd.choice(["33000", "33001"])))
    for i in range(40):  # at the border of two per cent, and addresses without a number
        made.append((5000 + i, datetime.date(2001, 1, 1 + i % 28), (98_000, 100_000, 96_040, 96_039, 102_041)[i % 5], "9 rue Haute", "y", "44000"))
        made.append((6000 + i, None, 5, "rue Haute", "y", "44000"))
    df = spark.createDataFrame(made, "sale_id long, sale_date date, starting_price_eur long, address string, city string, postal_code string")
    keys = {r.sale_id: r.k for r in df.select("sale_id", entities.address_key().alias("k")).collect()}
    firsts, want = {}, {}
    for i, day, price, *_ in sorted(made, key=lambda x: x[0]):
        same = lambda d, p: not (d and day and p and price and d != day and not (p > 0 and price > 0 and abs(p - price) <= 0.02 * max(p, price)))  # noqa: B023, E731
        group = None if keys[i] is None else next((g for g, d, p in firsts.get(keys[i], []) if same(d, p)), None)
        want[i] = i if group is None else group
        if group is None and keys[i] is not None:
            firsts.setdefault(keys[i], []).append((i, day, price))
    assert max(map(len, firsts.values())) > 40
    for prefix, most in ((1000, 7), (60, 17)):
        held = []
        got = entities.by_address(df, lambda d, n: held.append(n) or hold(d, n), prefix).collect()
        assert {r.sale_id: r.group_id for r in got} == want and len(got) == len(made)
        assert len(held) <= most, held


def test_means_at_a_half_go_up_in_any_order(spark):
    values = [0.1, 0.2, 0.3, 0.4] * 25 + [41.75 * 2 - 0.25] * 100
    rows = spark.createDataFrame([(1, v) for v in values] + [(2, v) for v in reversed(values)] + [(3, float("inf")), (3, 1.0)], "u long, v double")
    got = {r.u: r.latency for r in reports.runtime_health(rows.where("u < 3"), "u", c("v"), F.lit(False), 1, 50.0, 20.0).collect()}
    assert got[1] == got[2] == 41.8
    assert [round(r.latency, 1) for r in reports.runtime_health(spark.createDataFrame([(1, x) for x in [0.1] * 5 + [0.2] * 5], "u long, v double"), "u", c("v"), F.lit(False), 1, 50.0, 20.0).collect()] == [0.2]
