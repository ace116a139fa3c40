"""Stateful monitors: a change feed of watched sales and episodes of alerts, as tables and as streams.

On a stream, rows of a key wait in state until the watermark has passed them, and are then taken in the order of their time, by an event timer for each; so files may come in any order within the watermark's delay. State of a key goes when nothing has been seen of it for `forget`. The batch forms say the same of a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

c = F.col

#: Kinds of change, the field of each, and how far it must move to be told.
CHANGES = [("price_changed", "price", 0), ("audience_changed", "sale_date", 0), ("status_changed", "status", 0), ("documents_changed", "documents", 0), ("score_changed", "score", 5)]
FIELDS = [field for _, field, _ in CHANGES] + ["document_count"]
#: Labels of changes; what of a status is urgent, and within how many days a hearing is.
LABELS = {"audience_changed": "Date d'audience modifiée", "status_changed": "Statut de la vente modifié", "score_changed": "Score de rentabilité modifié"}
PRICE_LABELS = ["Mise à prix abaissée", "Mise à prix augmentée"]
DOCUMENT_LABELS = ["Document retiré", "Nouveau document détecté", "Documents modifiés"]
URGENT_STATUS, URGENT_DAYS, IMPORTANT_SCORE = "(?i)annul|adjud|vend|report|cancel|sold", 14, 10

WATCH = ["user_id", "sale_id", "watch_kind", "watch_id"]
SNAPSHOT = f"watch_kind string, watch_id string, at long, {', '.join(f'{f} string' for f in FIELDS)}"
CHANGE = f"user_id long, sale_id long, watch_kind string, watch_id string, checked_at timestamp, event_kind string, previous string, current string, {', '.join(f'{side}_document_count string' for side in ('previous', 'current'))}"


def snapshots(rows: DataFrame) -> DataFrame:
    """WATCH, checked_at and FIELDS, as text; documents is a signature of a sale's documents."""
    return rows.select(*WATCH[:2], *(c(x).cast("string").alias(x) for x in WATCH[2:]), c("checked_at").cast("timestamp").alias("checked_at"), *(c(f).cast("string").alias(f) for f in FIELDS))


def told(changes: DataFrame) -> DataFrame:
    """Changes with fingerprint, severity and label. Works on a stream as on a table."""
    kind, was, now = c("event_kind"), c("previous"), c("current")
    number = lambda x: x.try_cast("double")
    less, more = number(now) < number(was), number(now) > number(was)
    fewer, added = number(c("current_document_count")) < number(c("previous_document_count")), F.coalesce(number(c("current_document_count")), F.lit(0.0)) > F.coalesce(number(c("previous_document_count")), F.lit(0.0))
    severity = (
        F.when((kind == "price_changed") & less, "important")
        .when(kind == "audience_changed", F.when(now.try_cast("timestamp") <= c("checked_at") + F.expr(f"interval {URGENT_DAYS} days"), "urgent").otherwise("important"))
        .when(kind == "status_changed", F.when(now.rlike(URGENT_STATUS), "urgent").otherwise("important"))
        .when((kind == "documents_changed") & added, "important")
        .when((kind == "score_changed") & (F.abs(number(now) - number(was)) >= IMPORTANT_SCORE), "important")
        .otherwise("info")
    )
    label = F.when(kind == "price_changed", F.when(less, PRICE_LABELS[0]).otherwise(PRICE_LABELS[1])).when(kind == "documents_changed", F.when(fewer, DOCUMENT_LABELS[0]).when(added, DOCUMENT_LABELS[1]).otherwise(DOCUMENT_LABELS[2]))
    for name, text in LABELS.items():
        label = label.when(kind == name, text)
    field = F.create_map(*(F.lit(x) for k, f, _ in CHANGES for x in (k, f)))[kind]
    return changes.select(*WATCH, "checked_at", "event_kind", "previous", "current", F.concat_ws(":", kind, field, was, now).alias("fingerprint"), severity.alias("severity"), label.alias("label"))


def _moved(field: str, least: int) -> Column:
    was, now = c(f"_{field}"), c(field)
    far = F.abs(now.try_cast("double") - was.try_cast("double")) >= least if least else F.lit(True)
    return was.isNotNull() & now.isNotNull() & (was != now) & far


def change_feed(rows: DataFrame, forget: str | None = None, parts: int | None = None) -> DataFrame:
    """The changes between consecutive snapshots of each watch; its first one, and one more than `forget` after the last, is a baseline. A change that a user was told of a sale (same kind, from the same value to the same value) is not told again, unless all watches of the sale had been forgotten in between. parts: over how many partitions users and sales are dealt, once for all steps, if not the session's number for each."""
    each = snapshots(rows)
    if parts:
        each = each.repartition(parts, *WATCH[:2])
    if forget:
        seen = Window.partitionBy(*WATCH[:2]).orderBy("checked_at")
        fresh = c("checked_at") > F.lag("checked_at").over(seen) + F.expr(f"interval {forget}")
        each = each.withColumn("_fresh", F.coalesce(fresh, F.lit(False)).cast("int")).withColumn("_session", F.sum("_fresh").over(seen))
    else:
        each = each.withColumn("_session", F.lit(0))
    w = Window.partitionBy(*WATCH, "_session").orderBy("checked_at")
    pairs = each.withColumns({f"_{f}": F.lag(f).over(w) for f in FIELDS})
    kinds = F.array_compact(F.array(*(F.when(_moved(f, least), F.struct(F.lit(kind).alias("event_kind"), c(f"_{f}").alias("previous"), c(f).alias("current"))) for kind, f, least in CHANGES)))
    found = pairs.select(*WATCH, "checked_at", "_session", c("_document_count").alias("previous_document_count"), c("document_count").alias("current_document_count"), F.inline(kinds))
    key = ["user_id", "sale_id", "_session", "event_kind", "previous", "current"]
    others = ["checked_at", "watch_kind", "watch_id", "previous_document_count", "current_document_count"]
    first = found.groupBy(*key).agg(F.min(F.struct(*others)).alias("one"))
    return told(first.select("user_id", "sale_id", "event_kind", "previous", "current", "one.*"))


class InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of their time, each when the watermark has passed it; forgets a key of which nothing came for `forget` milliseconds. Subclasses say what a row does, and what they keep."""

    waiting_schema = ""

    def __init__(self, forget: int | None = None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.latest = handle.getValueState("latest", "at long")

    def row_of(self, row: Row) -> tuple:
        raise NotImplementedError

    def take(self, key: tuple, row: Any) -> Iterator[Row]:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        new = [self.row_of(r) for r in rows]
        self.waiting.appendList(new)
        for at in {r[0] for r in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        all_rows = [tuple(r) for r in self.waiting.get()]
        for row in sorted((r for r in all_rows if r[0] <= until), key=lambda r: tuple((x is not None, x) for x in r)):
            if self.forget is not None and self.latest.exists() and row[0] - self.latest.get()[0] > self.forget:
                self.clear()
            self.latest.update((row[0],))
            yield from self.take(key, row)
        rest = [r for r in all_rows if r[0] > until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
            if self.forget is not None and self.latest.exists():
                if until > self.latest.get()[0] + self.forget:
                    self.clear()
                    self.latest.clear()
                elif until <= self.latest.get()[0]:
                    self.handle.registerTimer(self.latest.get()[0] + self.forget + 1)

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    return int((at if at.tzinfo else at.astimezone(UTC)).timestamp() * 1000)


class Changes(InOrder):
    """Of each user and sale: the last snapshot of each watch, and the changes that were told."""

    waiting_schema = f"at long, watch_kind string, watch_id string, {', '.join(f'{f} string' for f in FIELDS)}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", "watch_kind string, watch_id string", ", ".join(f"{f} string" for f in FIELDS))
        self.known = handle.getMapState("known", "event_kind string, previous string, current string", "at long")

    def clear(self) -> None:
        self.last.clear()
        self.known.clear()

    def row_of(self, row: Row) -> tuple:
        return (_millis(row["checked_at"]), row["watch_kind"], row["watch_id"], *(row[f] for f in FIELDS))

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        at, *watch = row[:3]
        now = dict(zip(FIELDS, row[3:], strict=True))
        if self.last.containsKey(tuple(watch)):
            was = dict(zip(FIELDS, self.last.getValue(tuple(watch)), strict=True))
            for kind, field, least in CHANGES:
                a, b = was[field], now[field]
                change = (kind, a, b)
                if a is None or b is None or a == b or (least and abs(float(b) - float(a)) < least) or self.known.containsKey(change):
                    continue
                self.known.updateValue(change, (at,))
                yield Row(user_id=key[0], sale_id=key[1], watch_kind=watch[0], watch_id=watch[1], checked_at=datetime.fromtimestamp(at / 1000), event_kind=kind, previous=a, current=b, previous_document_count=was["document_count"], current_document_count=now["document_count"])
        self.last.updateValue(tuple(watch), row[3:])


def change_stream(rows: DataFrame, late: str, forget_ms: int | None = None) -> DataFrame:
    """change_feed on a stream of snapshots that come `late` at most; a change is told when the watermark has passed it. Needs the state store of RocksDB."""
    each = snapshots(rows).withWatermark("checked_at", late)
    return told(each.groupBy("user_id", "sale_id").transformWithState(statefulProcessor=Changes(forget_ms), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime"))


def append_new(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Events that are not stored yet, each once: for sinks that may see a batch twice."""
    key = ["user_id", "sale_id", "event_kind", "fingerprint"]
    return events.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*events.columns)


class Episodes(InOrder):
    """Of each key: whether its alert is open, and its severity."""

    waiting_schema = "at long, event_id long, bad boolean, severity string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "severity string")

    def clear(self) -> None:
        self.now.clear()

    def row_of(self, row: Row) -> tuple:
        return _millis(row["ts"]), row["event_id"], row["bad"], row["severity"]

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        at, event_id, bad, severity = row
        was = self.now.exists()
        before = self.now.get()[0] if was else None
        if bad:
            self.now.update((severity,))
        elif was:
            self.now.clear()
        if bad or was:
            yield Row(key=key[0], ts=datetime.fromtimestamp(at / 1000), event_id=event_id, action="resolved" if not bad else "updated" if was else "opened", notify=bool(bad and (not was or severity != before)))


def alert_stream(checks: DataFrame, key: str, bad: Column, severity: Column, late: str, forget_ms: int | None = None) -> DataFrame:
    """alert_episodes on a stream of checks (ts, event_id and a key that is a whole number): key, ts, event_id, action, notify."""
    each = checks.select(c(key).cast("long").alias("key"), c("ts").cast("timestamp").alias("ts"), c("event_id").cast("long").alias("event_id"), F.coalesce(bad, F.lit(False)).alias("bad"), F.when(bad, severity).alias("severity")).withWatermark("ts", late)
    return each.groupBy("key").transformWithState(statefulProcessor=Episodes(forget_ms), outputStructType="key long, ts timestamp, event_id long, action string, notify boolean", outputMode="Append", timeMode="EventTime")
