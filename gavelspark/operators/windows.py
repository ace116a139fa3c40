"""Order-dependent operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def latest_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key whose order is greatest: an aggregate that combines before the shuffle, so a hot key does no harm."""
    others = [x for x in rows.columns if x != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("b")).select(key, "b.*")


def islands(rows: DataFrame, ordinal: str, signature: Column, block: int = 100_000) -> DataFrame:
    """Contiguous rows (by a dense ordinal) of equal signature: island, the ordinal of its first row, and occurrence, the how manieth island of this signature it is.

    Whether a row begins an island follows from an equi-join with its predecessor. Ordinals are cut into blocks: windows span a block's rows, and what a block takes over from those before (its last beginning, and the islands of each signature so far) follows from a row a block, or a block and signature. However few signatures there are, no task gets all rows of one.
    """
    r = rows.withColumns({"_s": F.xxhash64(signature), "_sig": signature, "_block": F.floor(c(ordinal) / block)})
    before = r.select((c(ordinal) + 1).alias(ordinal), c("_sig").alias("_before"), F.lit(True).alias("_there"))
    r = r.join(before, ordinal, "left").withColumn("_begins", c("_there").isNull() | ~c("_sig").eqNullSafe(c("_before")))
    begun = F.when(c("_begins"), c(ordinal))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    last = r.groupBy("_block").agg(F.max(begun).alias("_last"))
    last = last.select("_block", F.max("_last").over(earlier(Window.orderBy("_block"))).alias("_taken"))  # a row a block
    n = r.groupBy("_s", "_sig", "_block").agg(F.sum(c("_begins").cast("bigint")).alias("_n"))
    n = n.select(c("_s").alias("_s2"), c("_sig").alias("_sig2"), c("_block").alias("_block2"), F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("_s", "_sig").orderBy("_block"))), F.lit(0)).alias("_so_far"))
    r = r.join(last, "_block").join(n, (c("_s") == c("_s2")) & c("_sig").eqNullSafe(c("_sig2")) & (c("_block") == c("_block2")))
    here, own = Window.partitionBy("_block").orderBy(ordinal), Window.partitionBy("_block", "_s", "_sig").orderBy(ordinal)
    out = r.withColumns({"island": F.coalesce(F.max(begun).over(here), c("_taken")), "occurrence": c("_so_far") + F.sum(c("_begins").cast("bigint")).over(own)})
    return out.select(*rows.columns, "island", "occurrence")


def singletons(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has."""
    others = [x for x in rows.columns if x != key]
    return rows.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("b")).where("_n = 1").select(key, "b.*")


def chronological_split(rows: DataFrame, date: str, tie: str, train: float = 0.7, calibration: float = 0.15) -> DataFrame:
    """part: train, calibration or test by place in time (1 row at least for the first two, as long as one is left for the last).

    Places follow from counts a day, summed over days, and the order within a day: the windows span the days and one day, not the table.
    """
    days = rows.groupBy(date).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumns({"_before": before, "_all": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    place = c("_before") + F.row_number().over(Window.partitionBy(date).orderBy(tie)) - 1
    train_end = F.greatest(F.lit(1), F.floor(c("_all") * train))
    cal_end = F.least(F.greatest(train_end + 1, F.floor(c("_all") * (train + calibration))), c("_all") - 1)
    return rows.join(days, date).withColumn("_p", place).withColumn("part", F.when(c("_p") < train_end, "train").when(c("_p") < cal_end, "calibration").otherwise("test")).drop("_before", "_all", "_p")


def changes(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows beside the values that the one before had; first rows and rows without a change are left out. changed: the fields, comma-joined."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = rows.select("*", *(F.lag(f).over(w).alias(f"before_{f}") for f in fields), F.row_number().over(w).alias("_n")).where("_n > 1")
    changed = F.array_join(F.array_compact(F.array(*(F.when(~c(f).eqNullSafe(c(f"before_{f}")), f) for f in fields))), ",")
    return seen.withColumn("changed", changed).where("changed <> ''").drop("_n")
