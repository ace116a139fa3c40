"""Hexagons, nearest points and boosted trees against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelspark.functions import hexagons
from gavelspark.operators import boosting, nearby, training
from gavelspark.plans import training as frames
from gavelspark.storage import hold

c = F.col


def by_hand(lat, lng, size):
    """The cell whose middle is nearest, of all around."""
    x, y = math.radians(lng) * math.cos(math.radians(hexagons.MIDDLE_LATITUDE)) * hexagons.EARTH, math.radians(lat) * hexagons.EARTH
    r0 = round(y / (1.5 * size))
    near = []
    for r in range(r0 - 2, r0 + 3):
        q0 = round(x / (3**0.5 * size) - r / 2)
        near += [(math.hypot((q + r / 2) * 3**0.5 * size - x, r * 1.5 * size - y), q, r) for q in range(q0 - 2, q0 + 3)]
    return min(near)[1:]


def places(n, seed=1):
    r = random.Random(seed)
    return [(i, r.uniform(44, 49), r.uniform(-1, 6)) for i in range(n)] + [(n, None, 2.0), (n + 1, 45.0, None)]


@pytest.mark.parametrize("size", [174.376, 1220.63, 30_000.0])
def test_cells_are_those_of_the_nearest_middle(spark, size):
    rows = places(400)
    df = spark.createDataFrame(rows, "i long, lat double, lng double")
    got = {r.i: r.x for r in df.select("i", hexagons.cell_of(c("lat"), c("lng"), size).alias("x")).collect()}
    assert all(got[i] == (None if None in (lat, lng) else by_hand(lat, lng, size)) for i, lat, lng in rows)


def test_rings_and_steps(spark):
    """Of the cells within 4 steps there are 1, 6, 12, 18 and 24 a ring; steps are those of a walk from neighbour to neighbour."""
    one = spark.range(1).select(F.struct(F.lit(5).cast("bigint").alias("q"), F.lit(-3).cast("bigint").alias("r")).alias("a"))
    got = one.select("a", F.explode(hexagons.disk(c("a"), 4)).alias("b")).select("b.q", "b.r", hexagons.steps_between(c("a"), c("b")).alias("n")).collect()
    walked, edge = {(5, -3): 0}, [(5, -3)]
    for n in range(1, 5):
        edge = [(q + a, r + b) for q, r in edge for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))]
        for x in edge:
            walked.setdefault(x, n)
    assert {(r.q, r.r): r.n for r in got} == walked
    assert [sum(r.n == k for r in got) for k in range(5)] == [1, 6, 12, 18, 24]


def test_parents(spark):
    """A cell's parent holds its middle."""
    df = spark.createDataFrame(places(200)[:200], "i long, lat double, lng double")
    size = 500.0
    cell = hexagons.cell_of(c("lat"), c("lng"), size)
    x, y = hexagons.centre_of(c("a"), size)
    px, py = hexagons.centre_of(c("p"), size * hexagons.COARSER)
    got = df.select(cell.alias("a")).select("a", hexagons.parent_of(c("a"), size).alias("p")).select(F.hypot(x - px, y - py).alias("d")).collect()
    assert max(r.d for r in got) <= size * hexagons.COARSER * 1.0001


def metres(a, b):
    f, g = math.radians(a[0]), math.radians(b[0])
    h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("k, most", [(1, 900.0), (3, 5_000.0), (8, 40_000.0)])
def test_nearest_points(spark, k, most):
    r = random.Random(k)
    subjects = [(i, 46 + r.gauss(0, 0.05), 2 + r.gauss(0, 0.05)) for i in range(60)] + [(60, 48.9, 2.0), (61, None, 2.0), (0, 46.0, 2.0)]
    subjects[0] = (0, 46.0, 2.0)
    points = [(i, 46 + r.gauss(0, 0.08), 2 + r.gauss(0, 0.08)) for i in range(300)] + [(300, 46.0, 2.0), (301, 46.0, 2.0), (302, None, None)]
    got = nearby.nearest(spark.createDataFrame(subjects, "sale_id long, latitude double, longitude double"), spark.createDataFrame(points, "point_id long, latitude double, longitude double"), "sale_id", k, most, hold, 200.0)
    want = set()
    for i, *at in subjects[:-1]:
        if at[0] is not None:
            near = sorted((metres(at, p[1:]), p[0]) for p in points if p[1] is not None)
            want |= {(i, p, n + 1) for n, (m, p) in enumerate(near[:k]) if m <= most}
    assert {(x.sale_id, x.point_id, x.place) for x in got.collect()} == want


def learnable(n=1500, seed=5):
    r = np.random.default_rng(seed)
    a, b = r.uniform(0, 10, n), r.uniform(0, 10, n)
    y = 7 + np.sin(a) + (b > 5) * 0.8 + r.normal(0, 0.1 + 0.03 * a)
    part = np.where(np.arange(n) % 10 < 6, "train", np.where(np.arange(n) % 10 < 8, "calibration", "test"))
    return [(float(x) if i % 37 else None, float(z), float(v), str(p)) for i, (x, z, v, p) in enumerate(zip(a, b, y, part, strict=True))]


def test_trees_learn_quantiles(spark):
    """The loss on unseen rows is well below that of the rows' quantiles, the corrected interval holds what it should, and the trees read as JSON give the same."""
    rows = learnable()
    df = spark.createDataFrame([*rows, (None, None, None, "train")], "a double, b double, y double, part string").repartition(3)
    artifact, report = boosting.train(df, ["a", "b"], "y", hold, trees=12)
    got = report.first()
    y = {p: np.array([r[2] for r in rows if r[3] == p]) for p in ("train", "calibration", "test")}
    assert (got.n_train, got.n_calibration, got.n_test) == tuple(len(v) for v in y.values())
    for q, alpha in boosting.QUANTILES.items():
        e = y["test"] - np.quantile(y["train"], alpha)
        assert got[f"loss_{q}"] < 0.6 * np.maximum(alpha * e, (alpha - 1) * e).mean()
    assert got.coverage >= 0.8 * 0.9
    told = df.where("part = 'test'").select("y", training.tree_quantiles(artifact, {"a": c("a"), "b": c("b")}).alias("q")).select("y", "q.*").collect()
    e = np.array([r.y - np.log(r.p50) for r in told])
    assert abs(np.abs(e).mean() / 2 - got.loss_p50) < 1e-3
    inside = np.mean([r.p10 - 1 <= np.exp(r.y) <= r.p90 + 1 for r in told])
    assert abs(inside - got.coverage) < 0.02
    again, _ = boosting.train(df.repartition(7), ["a", "b"], "y", hold, trees=12)
    assert again == artifact


def test_splits_are_the_best_of_all(spark):
    """A stump against all splits by brute force."""
    r = np.random.default_rng(2)
    for alpha in (0.1, 0.5, 0.9):
        hists = [np.stack([n := r.integers(0, 50, 9), r.integers(0, n + 1)]) for _ in range(3)]
        for h in hists[1:]:  # all features have the same rows
            h[0] = hists[0][0]
        best = (1e-9, None)
        for f, h in enumerate(hists):
            g = alpha * h[0] - h[1]
            for cut in range(9):
                left, right = h[0][: cut + 1].sum(), h[0][cut + 1 :].sum()
                if min(left, right) >= 20:
                    gain = g[: cut + 1].sum() ** 2 / left + g[cut + 1 :].sum() ** 2 / right - g.sum() ** 2 / (left + right)
                    best = max(best, (gain, (f, cut)), key=lambda x: x[0])
        assert boosting.best_split(hists, alpha, 20) == best[1]


def test_trees_of_the_register_beat_cells(spark, sf):
    """On the same rows and parts, the trees' loss is below that of the cells' quantiles."""
    rows = hold(frames.frame(spark, sf), "frame")
    got = boosting.train(rows, frames.TREE_FEATURES, "y", hold, trees=8)[1].first()
    cell = F.floor(c("latitude") * 10)
    train = rows.where("part = 'train'").groupBy("segment", cell.alias("cell")).agg(F.percentile("y", [0.1, 0.5, 0.9]).alias("q"))
    wide = rows.where("part = 'train'").groupBy("segment").agg(F.percentile("y", [0.1, 0.5, 0.9]).alias("w"))
    test = rows.where("part = 'test'").withColumn("cell", cell).join(train, ["segment", "cell"], "left").join(wide, "segment")
    for i, (q, alpha) in enumerate(boosting.QUANTILES.items()):
        e = c("y") - F.coalesce(F.get("q", F.lit(i)), F.get("w", F.lit(i)))
        assert got[f"loss_{q}"] < test.agg(F.avg(F.greatest(alpha * e, (alpha - 1) * e))).first()[0]
    assert got.coverage > 0.8 * 0.9


def test_trees_hold_blocks_and_count_in_tasks(spark, monkeypatch):
    """A block of rows is one row, and what lacks is added up before it is sent; other blocks, and what is counted by value, change nothing."""
    df = spark.createDataFrame([*learnable(), (1.0, 1.0, float("nan"), "train"), (1.0, 1.0, 1.0, None)], "a double, b double, y double, part string").repartition(3)
    held = {}
    keep = lambda d, name: held.setdefault(name, []).append(hold(d, name)) or held[name][-1]
    one, report = boosting.train(df, ["a", "b"], "y", keep, trees=3)
    assert held["binned"][0].count() <= 3 * 3 and sum(report.first()[:3]) == 1500
    monkeypatch.setattr(boosting, "NEAR", 300)
    assert boosting.train(df.repartition(7), ["a", "b"], "y", keep, trees=3)[0] == one


def test_training_frame_reads_prepared_rows(spark, sf):
    """The register is read and joined once, into a table; days are sent to its rows."""
    plan = frames.frame(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
