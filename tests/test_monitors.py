"""State: streams give what tables give, whatever the order of files and through a restart; pages of a registry; resume points."""

import datetime
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import states
from gavelspark.sources import registry
from gavelspark.streaming import monitors
from gavelspark.streaming.feeds import event_stream

c = F.col
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SCHEMA = "user_id long, sale_id long, watch_kind string, watch_id string, checked_at timestamp, price long, sale_date date, status string, documents string, score double, document_count int"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*ROCKS)
    yield spark
    spark.conf.unset(ROCKS[0])


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hour)


def watched(seed=3, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        user, sale = r.randrange(3), r.randrange(4)
        rows.append((user, sale, r.choice(["favorite", "workspace"]), "w", day(i, r.randrange(20)), r.choice([100, 90, 80, None]), datetime.date(2024, r.randrange(1, 9), 1), r.choice(["upcoming", "reportee", None]), r.choice(["a", "b"]), r.choice([50.0, 52.0, 57.0, 70.0, None]), r.randrange(3)))
    return rows


def write(spark, rows, schema, path, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.parquet(f"{path}/{i:03}")


def drained(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


@pytest.mark.parametrize("forget", [None, 20])
def test_change_feed_is_the_same_on_a_stream(rocks, tmp_path, forget):
    spark, rows = rocks, watched()
    rows.append((99, 99, "favorite", "end", day(2000), 1, None, None, None, None, None))  # moves the watermark past all
    n = len(rows) - 1
    # files come out of order, within the watermark's delay
    parts = [list(range(lo, min(lo + 20, n))) for lo in range(0, n, 20)]
    for i in range(0, len(parts) - 1, 2):
        parts[i], parts[i + 1] = parts[i + 1], parts[i]
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    write(spark, rows, SCHEMA, src, parts[:4])
    stream = lambda: monitors.change_stream(event_stream(spark, f"{src}/*", SCHEMA), "45 days", forget and forget * 86_400_000)
    drained(stream(), out, cp)
    write(spark, rows, SCHEMA, f"{src}/later", [])
    for i, part in enumerate([*parts[4:], [n]]):
        spark.createDataFrame([rows[k] for k in part], SCHEMA).coalesce(1).write.parquet(f"{src}/{i + 4:03}")
    drained(stream(), out, cp)  # a restart
    got = spark.read.parquet(out)
    want = monitors.change_feed(spark.createDataFrame(rows, SCHEMA), forget and f"{forget} days")
    assert want.count() > 20
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    stored = got.limit(5)
    assert monitors.append_new(stored, got.union(got)).count() == got.dropDuplicates(["user_id", "sale_id", "event_kind", "fingerprint"]).count() - stored.dropDuplicates(["user_id", "sale_id", "event_kind", "fingerprint"]).count()


def test_kinds_and_severities_of_changes(spark):
    base = [1, 1, "favorite", "w", day(0), 100, datetime.date(2024, 6, 1), "upcoming", "a", 50.0, 1]
    steps = [("checked_at", 4, day(1)), ("price", 5, 90), ("sale_date", 6, datetime.date(2024, 1, 10)), ("status", 7, "Vendue"), ("documents", 8, "b"), ("score", 9, 54.0), ("score", 9, 61.0), ("price", 5, 100), ("price", 5, 90)]
    rows, now = [tuple(base)], list(base)
    for i, (_, at, value) in enumerate(steps):
        now[at] = value
        now[4] = day(i + 1)
        rows.append(tuple(now))
    got = monitors.change_feed(spark.createDataFrame(rows, SCHEMA)).orderBy("checked_at").collect()
    assert [(r.event_kind, r.severity) for r in got] == [("price_changed", "important"), ("audience_changed", "urgent"), ("status_changed", "urgent"), ("documents_changed", "info"), ("score_changed", "info"), ("price_changed", "info")]
    assert got[0].fingerprint == "price_changed:price:100:90" and got[0].label == "Mise à prix abaissée" and got[-1].label == "Mise à prix augmentée"


def test_alert_episodes_are_the_same_on_a_stream(rocks, spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.randrange(3), day(0) + datetime.timedelta(minutes=i * 7), r.uniform(0, 100)) for i in range(200)]
    schema = "event_id long, user_id long, ts timestamp, value double"
    order = [list(range(lo, lo + 25)) for lo in range(0, 200, 25)]
    order[0], order[1] = order[1], order[0]
    write(spark, [*rows, (900, 77, day(60), 0.0)], schema, str(tmp_path / "in"), [*order, [200]])
    bad, severity = c("value") > 60, F.when(c("value") > 85, "critical").otherwise("warning")
    stream = monitors.alert_stream(event_stream(spark, str(tmp_path / "in/*"), schema), "user_id", bad, severity, "12 hours")
    drained(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = states.alert_episodes(spark.createDataFrame(rows, schema), "user_id", ["ts", "event_id"], bad, severity).select("event_id", "action", "notify")
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_scans_with_a_limit_read_what_one_scan_reads(spark):
    """Rows of one time are never parted, each scan begins where the last ended, and the watermark moves at the end alone."""
    r = random.Random(4)
    rows = [(i, day(0) + datetime.timedelta(minutes=r.randrange(40))) for i in range(300)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp")
    start, end = F.lit(day(-1)), F.lit(day(1))
    after, read, scans = day(-1), [], 0
    while True:
        part = states.up_to_watermark(log, F.lit(after), end, 70)
        assert "Window" not in part._jdf.queryExecution().executedPlan().toString()
        s = states.segment_of(log, F.lit(after), end, 70).first()
        found = part.collect()
        read += [x.event_id for x in found]
        scans += 1
        assert s.selected == len(found) and s.committed_through == max(x.ts for x in found)
        assert s.watermark == (day(1) if s.scan_complete else after)
        if s.scan_complete:
            break
        assert s.resume_at > s.committed_through
        after = s.committed_through
    assert scans > 2 and sorted(read) == list(range(300))
    none = states.segment_of(log, end, F.lit(day(2)), 70).first()
    assert (none.selected, none.committed_through, none.scan_complete) == (0, None, True)


def page(folder, n, events, following, boundary="2024", size=2):
    cursor = {"date": boundary, "page_size": size, "from_id": str(n)}
    nxt = None if following is None else {"date": boundary, "page_size": size, "from_id": str(following)}
    d = folder / f"page={registry.page_name(cursor)}"
    d.mkdir(parents=True, exist_ok=True)
    (d / "part-0.txt").write_text(json.dumps({"cursor": cursor, "transactions": events, "next": nxt}))
    return registry.page_name(cursor)


def events(*dates):
    return [{"id": f"{d}-{i}", "date": d, "action": "updated", "n": i} for i, d in enumerate(dates)]


def history(spark, folder, start, stream=False, **options):
    spark.dataSource.register(registry.RegistryHistory)
    reader = (spark.readStream if stream else spark.read).format("registry_history")
    for k, v in {"path": str(folder), "start": start, **options}.items():
        reader = reader.option(k, v)
    return reader.load()


def test_history_of_a_registry(spark, tmp_path):
    start = page(tmp_path, 1, events("2024-01-01", "2024-01-02"), 2)
    page(tmp_path, 2, events("2024-01-02"), 3)
    page(tmp_path, 3, [], None)
    df = history(spark, tmp_path, start)
    assert [(r.id, r.position, json.loads(r.payload)) for r in sorted(df.collect(), key=lambda r: (r.page, r.position))] == [("2024-01-01-0", 0, {"n": 0}), ("2024-01-02-1", 1, {"n": 1}), ("2024-01-02-0", 0, {"n": 0})]
    assert df.rdd.getNumPartitions() == 3
    assert history(spark, tmp_path, "nowhere").count() == 0


@pytest.mark.parametrize(
    "broken,said",
    [
        (lambda d: page(d, 2, events("2024-01-05"), 1), "comes again"),
        (lambda d: page(d, 2, events("2023-12-31"), None), "order of time"),
        (lambda d: page(d, 2, events("2024-02-02", "2024-02-01"), None), "order of time"),
        (lambda d: (d / "page=2024~2~2" / "part-0.txt").write_text(json.dumps({"cursor": {"date": "2024", "page_size": 2, "from_id": "2"}, "transactions": [], "next": {"date": "2025", "page_size": 2, "from_id": "3"}})), "boundary"),
        (lambda d: (d / "page=2024~2~2" / "part-0.txt").write_text(json.dumps({"cursor": {"date": "2024", "page_size": 2, "from_id": "9"}, "transactions": [], "next": None})), "another cursor"),
    ],
)
def test_broken_histories_are_errors(spark, tmp_path, broken, said):
    start = page(tmp_path, 1, events("2024-01-01", "2024-01-02"), 2)
    page(tmp_path, 2, [], None)
    broken(tmp_path)
    with pytest.raises(Exception, match=said):
        history(spark, tmp_path, start).collect()


def test_history_as_a_stream_goes_on_where_it_ended(spark, tmp_path):
    """New pages are read after a restart; nothing is lost or read twice."""
    src, out, cp = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "cp")
    dates = [f"2024-01-{i + 1:02}" for i in range(12)]
    start = page(src, 0, events(*dates[:2]), 1)
    for n in range(1, 3):
        page(src, n, events(*dates[2 * n : 2 * n + 2]), n + 1)

    def drain():
        q = history(spark, src, start, stream=True, pages_a_batch="2").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    drain()
    assert Counter(r.date for r in spark.read.parquet(out).collect()) == Counter(dates[:6])
    for n in range(3, 6):
        page(src, n, events(*dates[2 * n : 2 * n + 2]), n + 1 if n < 5 else None)
    drain()
    drain()
    assert Counter(r.date for r in spark.read.parquet(out).collect()) == Counter(dates)
