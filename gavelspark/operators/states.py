"""Incremental and stateful semantics as pure functions of tables, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def rate_windows(events: DataFrame, seconds: int, limit: int, keys: list[str]) -> DataFrame:
    """Calls in each fixed window of a key, and whether they are within the limit. Works on a stream as on a table."""
    counted = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *keys).agg(F.count("*").alias("calls"))
    return counted.select(*keys, c("w.start").alias("window_start"), "calls", (c("calls") <= limit).alias("allowed"))


def month_usage(events: DataFrame, key: str, quantity: Column, limit: float) -> DataFrame:
    """A key's quantity a calendar month, what is left of the limit (not below 0), and whether it is reached."""
    used = events.groupBy(key, F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.sum(quantity), 2).alias("used"))
    return used.withColumns({"left": F.round(F.greatest(F.lit(0.0), limit - c("used")), 2), "reached": c("used") >= limit})


def stale_runs(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs that have been running for more than some minutes have failed."""
    late = (c("status") == "running") & (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c("ts").cast("timestamp")) > minutes * 60)
    return runs.withColumn("status", F.when(late, "failed").otherwise(c("status")))


def retention(rows: DataFrame, kind: str, date: Column, now: Column, days: dict[str, int]) -> DataFrame:
    """Kind, how many rows are past its days, how many stay; kinds without a limit stay."""
    old = F.coalesce(*(F.when(c(kind) == k, F.datediff(now, date) > n) for k, n in days.items()), F.lit(False))
    return rows.groupBy(kind).agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def alert_episodes(checks: DataFrame, key: str, order: list[str], bad: Column, severity: Column) -> DataFrame:
    """What happens to an alert at each check of its key: opened (first bad one, or after a resolution), updated, resolved; and whether one is to be told: when it opens, or its severity changes. Checks at which nothing happens are left out."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = checks.withColumns({"_bad": bad, "_sev": F.when(bad, severity)})
    seen = seen.withColumns({"_was": F.coalesce(F.lag("_bad").over(w), F.lit(False)), "_before": F.lag("_sev").over(w)})
    action = F.when(c("_bad") & ~c("_was"), "opened").when(c("_bad"), "updated").when(c("_was"), "resolved")
    tell = (c("_bad") & ~c("_was")) | (c("_bad") & ~c("_sev").eqNullSafe(c("_before")))
    return seen.withColumns({"action": action, "notify": tell}).where("action IS NOT NULL").drop("_bad", "_was", "_sev", "_before")


def up_to_watermark(log: DataFrame, after: Column, cutoff: Column, limit: int) -> DataFrame:
    """Of a log: the first `limit` rows after the last watermark, up to a cut-off, and all others of the last one's time, so that rows of one time are never parted. The last time is a top-k of narrow rows, and a filter for the log's own scan."""
    new = log.where((c("ts") > after) & (c("ts") <= cutoff))
    last = new.select("ts").orderBy("ts").limit(limit).agg(F.max("ts"))
    return new.where(c("ts") <= last.scalar())


def segment_of(log: DataFrame, after: Column, cutoff: Column, limit: int) -> DataFrame:
    """One row about up_to_watermark: selected (rows), committed_through (the last time of these; null if there are none), resume_at (the first time that is left; null at the end), scan_complete, and watermark: where the next scan starts. The watermark moves to the cut-off only when the scan is complete; until then, a scan resumes behind committed_through and the watermark stays."""
    new = log.where((c("ts") > after) & (c("ts") <= cutoff))
    last = new.select("ts").orderBy("ts").limit(limit).agg(F.max("ts").alias("t"))
    taken = c("ts") <= last.scalar()
    out = new.agg(F.count_if(taken).alias("selected"), F.max(F.when(taken, c("ts"))).alias("committed_through"), F.min(F.when(~taken, c("ts"))).alias("resume_at"))
    done = c("resume_at").isNull()
    return out.select("selected", "committed_through", "resume_at", done.alias("scan_complete"), F.when(done, cutoff).otherwise(after).alias("watermark"))


def skip_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose content hash is not known yet."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def hydrate(rows: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with empty fields filled from what is known of them."""
    stored = known.select(key, *(c(f).alias(f"_{f}") for f in fields))
    return rows.join(stored, key, "left").withColumns({f: F.coalesce(c(f), c(f"_{f}")) for f in fields}).drop(*(f"_{f}" for f in fields))


def current_versions(versions: DataFrame, deletions: DataFrame) -> DataFrame:
    """Versions that none supersedes and whose record is not deleted at the source."""
    newer = versions.where("supersedes_id IS NOT NULL").select(c("supersedes_id").alias("version_id")).distinct()
    return versions.join(newer, "version_id", "left_anti").join(deletions.select("record_id").distinct(), "record_id", "left_anti")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; a rule that is null is not broken."""
    broken = F.array_compact(F.array(*(F.when(~ok, name) for name, ok in rules.items())))
    return rows.withColumn("rule", F.explode(broken))


def bridge(catalogue: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """One row: rows scanned, created (keys that the registry lacks) and reused."""
    keys = catalogue.select(key).distinct().join(registry.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    return keys.agg(F.count("*").alias("scanned"), F.count_if(c("_there").isNull()).alias("created"), F.count_if(c("_there").isNotNull()).alias("reused"))


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows with those of a batch put over them, the last of a batch's equal keys; all columns are replaced."""
    others = [x for x in stored.columns if x != key]
    both = stored.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("_b", order)).alias("b")).select(key, "b.*")


def snapshot_changes(before: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, changed (fields, comma-joined) of rows that differ from the last snapshot; rows without one are a baseline and no change."""
    old = before.select(key, *(c(f).alias(f"_{f}") for f in fields))
    changed = F.array_join(F.array_compact(F.array(*(F.when(~c(f).eqNullSafe(c(f"_{f}")), f) for f in fields))), ",")
    return now.join(old, key).select(key, changed.alias("changed")).where("changed <> ''")


def change_events(now: str) -> Column:
    """kind:severity of each change between columns and those of the same names after before_ (price, sale_date, status, score), comma-joined: a lower price is important; a hearing within 14 days urgent; a status of adjudication, sale, cancelling or delay urgent; a score is told from 5 points on, important from 10."""
    moved = lambda f: ~c(f).eqNullSafe(c(f"before_{f}"))
    points = F.abs(c("score") - c("before_score"))
    event = lambda cond, kind, severity: F.when(cond, F.concat(F.lit(f"{kind}:"), severity))
    return F.array_join(F.array_compact(F.array(
        event(moved("price"), "price_changed", F.when(c("price") < c("before_price"), "important").otherwise("info")),
        event(moved("sale_date"), "audience_changed", F.when(F.datediff("sale_date", F.lit(now)) <= 14, "urgent").otherwise("important")),
        event(moved("status"), "status_changed", F.when(c("status").rlike("(?i)annul|adjud|vend|report|cancel|sold"), "urgent").otherwise("important")),
        event(points >= 5, "score_changed", F.when(points >= 10, "important").otherwise("info")),
    )), ",")
