"""History of a registry as a Spark data source: pages on disk, each of which names the next by a cursor; read as a table or, page by page, as a stream.

A page lies at <path>/page=<name>/ as lines of JSON in one file; its object has cursor (date, page_size, from_id), transactions (id, date, action, ...) in order of their dates, and next (a cursor, or null). A page's name is that of its cursor (page_name). Reading begins at the page named by the option `start`. Pages are followed from cursor to cursor: a cursor that comes again, a page that another cursor names, a change of boundary date or page size, and events that go back in time are errors. A page that is not there yet ends the walk for now.

Offsets of the stream hold the cursor to read next, how many pages were read and the last event's date, so a restart begins where the last batch ended. The folder must be one that driver and executors see (any file system that pyarrow opens).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page string, position int, id string, date string, action string, payload string"


def page_name(cursor: dict[str, Any]) -> str:
    """The name of the page that a cursor points at, fit for a folder."""
    return "~".join(str(cursor.get(k) or "") for k in ("date", "page_size", "from_id")).replace("/", "_").replace(":", "-")


class RegistryError(ValueError):
    """The history breaks its own order."""


@dataclass
class Page(InputPartition):
    """One page, and the date that its events must not go behind."""

    name: str
    not_before: str | None


class Folder:
    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def load(self, name: str) -> dict[str, Any] | None:
        """A page's object; None if it is not there."""
        from pyarrow import fs

        folder = f"{self.path}/page={name}"
        if self.fs.get_file_info(folder).type != fs.FileType.Directory:
            return None
        files = sorted(f.path for f in self.fs.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(("_", ".")))
        text = b"".join(self.fs.open_input_stream(f).read() for f in files).decode()
        return json.loads(text) if text.strip() else None


def checked(page: dict[str, Any], name: str, not_before: str | None) -> str | None:
    """The date of the page's last event (of those before, if it has none), once its own order holds."""
    if page_name(page["cursor"]) != name:
        raise RegistryError(f"page {name} holds the page of another cursor")
    last = not_before
    for event in page["transactions"]:
        if last is not None and event["date"] < last:
            raise RegistryError(f"events of page {name} are not in order of time")
        last = event["date"]
    return last


def walk(folder: Folder, name: str, last: str | None, most: int | None, seen: Sequence[str] = ()) -> Iterator[tuple[Page, str | None, str | None]]:
    """Pages from `name` on: each, the name of the next (None behind the last), and the date of the last event so far."""
    met = set(seen)
    while name and (most is None or len(met) - len(seen) < most):
        if name in met:
            raise RegistryError(f"cursor of page {name} comes again")
        page = folder.load(name)
        if page is None:
            return
        met.add(name)
        before, last = last, checked(page, name, last)
        following, now = page.get("next"), page["cursor"]
        if following and (following.get("date"), following.get("page_size")) != (now.get("date"), now.get("page_size")):
            raise RegistryError(f"page {name} leads to another boundary or page size")
        yield Page(name, before), page_name(following) if following else None, last
        name = page_name(following) if following else ""


def _rows(path: str, partition: Page) -> Iterator[tuple]:
    page = Folder(path).load(partition.name)
    if page is None:
        raise RegistryError(f"page {partition.name} is gone")
    checked(page, partition.name, partition.not_before)
    for i, event in enumerate(page["transactions"]):
        yield partition.name, i, str(event["id"]), event["date"], event.get("action"), json.dumps({k: v for k, v in event.items() if k not in ("id", "date", "action")}, ensure_ascii=False, sort_keys=True)


class HistoryReader(DataSourceReader):
    def __init__(self, path: str, start: str) -> None:
        self.path, self.start = path, start

    def partitions(self) -> Sequence[InputPartition]:
        return [page for page, _, _ in walk(Folder(self.path), self.start, None, None)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        return _rows(self.path, partition) if partition else iter(())  # Spark reads a history without pages, too


class HistoryStream(DataSourceStreamReader):
    def __init__(self, path: str, start: str, pages_a_batch: int) -> None:
        self.path, self.start, self.most = path, start, pages_a_batch
        self.at: dict[str, Any] | None = None

    def initialOffset(self) -> dict[str, Any]:  # noqa: N802
        return {"next": self.start, "pages": 0, "last": None, "ended": False}

    def latestOffset(self) -> dict[str, Any]:  # noqa: N802
        """One batch further than the last call, or than what was committed."""
        now = self.at or self.initialOffset()
        if not now["ended"]:
            for page, following, last in walk(Folder(self.path), now["next"], now["last"], self.most):
                now = {"next": following or page.name, "pages": now["pages"] + 1, "last": last, "ended": following is None}
        self.at = now
        return now

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> Sequence[InputPartition]:
        """The pages between two offsets, found from cursor to cursor; a restarted stream goes on from `end`."""
        self.at = end
        n = end["pages"] - start["pages"]
        pages = [page for page, _, _ in walk(Folder(self.path), start["next"], start["last"], n)] if n else []
        if len(pages) != n:
            raise RegistryError("pages that were read before are gone")
        return pages

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict[str, Any]) -> None:
        self.at = end if self.at is None or end["pages"] > self.at["pages"] else self.at


class RegistryHistory(DataSource):
    """spark.dataSource.register(RegistryHistory), then format("registry_history") with the options path, start and pages_a_batch."""

    @classmethod
    def name(cls) -> str:
        return "registry_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return HistoryReader(self.options["path"], self.options["start"])

    def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802
        return HistoryStream(self.options["path"], self.options["start"], int(self.options.get("pages_a_batch", "1")))
