"""Training frames, quantile baselines with conformal correction, and inference by trees that were trained elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import valid_training_price

c = F.col

NUMBERS = ("total_price_eur", "built_surface_m2", "land_surface_m2", "rooms_count", "latitude", "longitude")
#: Decimals of a log price: groups keep counts of at most some ten thousand values, however many rows they have.
DECIMALS = 3


def transaction_segment(code: Column, kind: Column) -> Column:
    """Segment of a register row by type code or words; the first rule that fits; null if none does."""
    code, words = F.trim(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    rules = [
        ("apartment", (code == "121") | words.rlike("appartement|studio|apartment")),
        ("house", (code == "111") | words.rlike("maison|villa|pavillon|house")),
        ("building", code.isin("112", "122", "123", "151") | words.rlike("immeuble|building")),
        ("commercial", code.startswith("14") | (code == "152") | words.rlike("commerce|commercial|bureau|local professionnel")),
        ("land", code.startswith("2") | words.rlike("terrain|land|parcelle")),
    ]
    return F.coalesce(*(F.when(test, name) for name, test in rules))


def prepare(rows: DataFrame) -> DataFrame:
    """Register rows as text in, rows fit for training out: numbers and date read (null where they are none), segment, surface_m2, target_price_per_m2. Rows without date, segment, surface or a price within the segment's limits go."""
    rows = rows.withColumns({n: F.col(n).cast("string").try_cast("double") for n in NUMBERS} | {"sale_date": F.col("sale_date").cast("string").try_cast("date")})
    # exploded, so that conditions on the segment are not pushed below it, each with the rules written out: that code would be too long to compile
    rows = rows.withColumn("segment", F.explode(F.array(transaction_segment(c("type_code"), c("property_type")))))
    rows = rows.withColumn("surface_m2", F.when(c("segment") == "land", c("land_surface_m2")).otherwise(c("built_surface_m2")))
    rows = rows.withColumn("target_price_per_m2", F.when(c("surface_m2") > 0, c("total_price_eur") / c("surface_m2")))
    return rows.where("sale_date IS NOT NULL AND segment IS NOT NULL AND surface_m2 > 0 AND target_price_per_m2 > 0").where(valid_training_price(c("segment"), c("target_price_per_m2"), c("surface_m2")))


def split_by_days(rows: DataFrame, train: float = 0.7, calibration: float = 0.15) -> DataFrame:
    """part of each row by its place in time within its segment; all of a day are in one part, so the windows span days, not rows. Days are few, however many rows: they go to the rows, which stay where they are."""
    days = rows.groupBy("segment", "sale_date").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("segment")
    before = F.coalesce(F.sum("_n").over(w.orderBy("sale_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = before / F.sum("_n").over(w)
    days = days.withColumn("part", F.when(share < train, "train").when(share < train + calibration, "calibration").otherwise("test"))
    return rows.join(F.broadcast(days.drop("_n")), ["segment", "sale_date"])


def quantile_cells(counts: DataFrame, by: list[str]) -> DataFrame:
    """q10, q50 and q90 of y for each group, from counts n of its values."""
    summed = counts.groupBy(*by, "y").agg(F.sum("n").alias("n"))
    return summed.groupBy(*by).agg(F.percentile("y", [0.1, 0.5, 0.9], c("n")).alias("q")).select(*by, *(F.get("q", F.lit(i)).alias(x) for i, x in enumerate(("q10", "q50", "q90"))))


def _correction(errors: DataFrame, name: str, level: float) -> DataFrame:
    """By segment the least error that ceil((n + 1) * level) of n errors (n at most) do not exceed."""
    summed = errors.groupBy("segment", name).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("segment")
    summed = summed.withColumns({"_upto": F.sum("n").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(w)})
    enough = c("_upto") >= F.least(c("_all"), F.ceil((c("_all") + 1) * level))
    return summed.where(enough).groupBy("segment").agg(F.min(name).alias(name))


def train_quantiles(prepared: DataFrame, cell: Column, hold, level: float = 0.9) -> DataFrame:
    """One row a segment: rows in each part, the corrections that calibration asks of the lower and the upper quantile, and the share of test rows within the corrected interval.

    The baseline's quantiles are those of the log price in a row's cell, else in its segment; conformal corrections (never negative) come from the errors of the calibration part. A segment without calibration rows has no corrections, and no coverage. Rows are read once, into counts by segment, cell, part and value, which `hold` keeps.
    """
    rows = prepared.withColumns({"y": F.round(F.log("target_price_per_m2"), DECIMALS), "cell": cell}).select("segment", "sale_date", "cell", "y")
    counts = hold(split_by_days(rows).groupBy("segment", "cell", "part", "y").agg(F.count("*").alias("n")), "training")
    train, later = counts.where("part = 'train'"), counts.where("part <> 'train'")
    wide = quantile_cells(train, ["segment"]).select("segment", *(c(q).alias(f"s_{q}") for q in ("q10", "q50", "q90")))
    seen = later.join(quantile_cells(train, ["segment", "cell"]), ["segment", "cell"], "left").join(wide, "segment")
    low, high = F.coalesce("q10", "s_q10"), F.coalesce("q90", "s_q90")
    errors = seen.select("segment", "part", "n", F.round(low - c("y"), 6).alias("lower"), F.round(c("y") - high, 6).alias("upper"))
    calibration = errors.where("part = 'calibration'")
    fixes = _correction(calibration, "lower", level).join(_correction(calibration, "upper", level), "segment")
    fixes = fixes.select("segment", *(F.greatest(F.lit(0.0), c(x)).alias(f"fix_{x}") for x in ("lower", "upper")))
    tested = errors.where("part = 'test'").join(fixes, "segment")
    inside = (c("lower") <= c("fix_lower")) & (c("upper") <= c("fix_upper"))
    covered = tested.groupBy("segment").agg((F.sum(F.when(inside, c("n")).otherwise(0)) / F.sum("n")).alias("coverage"))
    n = counts.groupBy("segment").agg(*(F.sum(F.when(c("part") == p, c("n")).otherwise(0)).alias(f"n_{p}") for p in ("train", "calibration", "test")))
    return n.join(fixes, "segment", "left").join(covered, "segment", "left").withColumnsRenamed({"fix_lower": "lower", "fix_upper": "upper"})


def _flat(tree: dict) -> tuple[np.ndarray, ...]:
    """A tree as arrays: feature (-1 in a leaf), threshold, strict, default_left, left, right, value. Node 0 is the root."""
    nodes, rows, at = [tree], [], 0
    while at < len(nodes):
        node = nodes[at]
        at += 1
        if "leaf_value" in node:
            rows.append((-1, 0.0, False, False, 0, 0, float(node["leaf_value"])))
            continue
        kind = node.get("decision_type", "<=")
        if kind not in ("<=", "<"):
            raise ValueError(f"a split by {kind}")
        left = len(nodes)
        nodes += [node["left_child"], node["right_child"]]
        rows.append((int(node["split_feature"]), float(node["threshold"]), kind == "<", bool(node.get("default_left")), left, left + 1, 0.0))
    return tuple(np.array(x) for x in zip(*rows, strict=True))


def _walk(flat: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf value that each row of x reaches; what is not finite goes the default way."""
    feature, threshold, strict, default_left, left, right, value = flat
    at = np.zeros(len(x), dtype=np.int64)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        node = at[inner]
        v = x[inner, feature[node]]
        goes = np.where(np.isfinite(v), np.where(strict[node], v < threshold[node], v <= threshold[node]), default_left[node])
        at[inner] = np.where(goes, left[node], right[node])
    return value[at]


def tree_quantiles(artifact: dict, features: dict[str, Column]) -> Column:
    """Struct p10, p50, p90 (whole euros a square metre) by the trees of a JSON artifact: feature_names, models p10, p50 and p90 of {trees, average}, lower and upper corrections. Features that are not given or null are missing values. Null if a model has no trees.

    The artifact goes to tasks with the function: it is a model, whose size does not grow with the data.
    """
    models = {k: ([_flat(t) for t in m["trees"]], m.get("average", False)) for k, m in artifact["models"].items()}
    names = artifact["feature_names"]
    low, high = max(0.0, artifact.get("lower") or 0.0), max(0.0, artifact.get("upper") or 0.0)

    @F.pandas_udf("p10 double, p50 double, p90 double")
    def predict(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.to_numpy(dtype=float)
        raw = {}
        for k, (trees, average) in models.items():
            total = sum((_walk(t, x) for t in trees), np.zeros(len(x))) if trees else np.full(len(x), np.nan)
            raw[k] = total / len(trees) if average and trees else total
        p10, p50, p90 = np.exp(raw["p10"] - low), np.exp(raw["p50"]), np.exp(raw["p90"] + high)
        whole = lambda v: np.floor(v + 0.5)
        return pd.DataFrame({"p10": whole(np.minimum(p10, p50)), "p50": whole(p50), "p90": whole(np.maximum(p90, p50))})

    given = F.struct(*(features[n].cast("double").alias(f"f{i}") if n in features else F.lit(None).cast("double").alias(f"f{i}") for i, n in enumerate(names)))
    return predict(given)
