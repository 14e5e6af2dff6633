"""Archives of fetched pages as a data source of Spark, in batch and as a stream.

An archive is a folder of files of JSON lines, one fetch result a line, in folders ``day=YYYY-MM-DD`` or
flat; the crawler appends to the last file (in the order of names) and begins new ones behind it.

``spark.read.format("page_archive").load(folder)`` deals the files out in byte ranges of ``slicebytes``; a
line belongs to the range that it begins in. Comparisons of ``fetched_at`` leave out whole days, and
comparisons of ``url`` and ``status_code`` leave out pages, before they are handed to Spark
(``spark.sql.python.filterPushdown.enabled``).

``spark.readStream.format("page_archive")`` goes on from an offset, which is a place: a file and the bytes
of it that are read. All files before that one are read to their end, so an offset doesn't grow with the
archive. A line without its end isn't read yet.

Paths are those of Arrow's file systems (local, ``file://``, ``hdfs://``, ``s3://`` ...). A page's id is a
hash of its place, the same in every read. A line that isn't a JSON object is a row with an error; fields
that it lacks or has of another type are null.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, final_url string, status_code int, html string, headers map<string,string>, elapsed_ms double, fetched_at timestamp, retry_count int, error string"
SLICE_BYTES = 64 << 20
#: Bytes of lines that a batch of rows is made of.
BATCH_BYTES = 8 << 20
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("final_url", pa.string()), ("status_code", pa.int32()), ("html", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("elapsed_ms", pa.float64()), ("fetched_at", pa.timestamp("us", "UTC")), ("retry_count", pa.int32()), ("error", pa.string())]
)
_TESTS = {ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b)}


@dataclass
class Slice(ds.InputPartition):
    """Lines of a file that begin in a range of bytes."""

    path: str
    start: int
    end: int


def _time(value) -> datetime.datetime | None:
    """A fetch time: ISO 8601, UTC where it names no zone."""
    try:
        at = datetime.datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    return _utc(at)


def _utc(at: datetime.datetime) -> datetime.datetime:
    return at.replace(tzinfo=datetime.UTC) if at.tzinfo is None else at.astimezone(datetime.UTC)


def _number(value, kind):
    return kind(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _page(line: bytes, path: str, at: int) -> dict:
    page_id = int.from_bytes(hashlib.blake2b(f"{path}:{at}".encode(), digest_size=8).digest(), "big", signed=True)
    try:
        told = json.loads(line)
    except ValueError:
        told = None
    if not isinstance(told, dict):
        return dict.fromkeys(_ARROW.names) | {"page_id": page_id, "error": "not a JSON object"}
    text = lambda name: told[name] if isinstance(told.get(name), str) else None
    headers = told.get("headers")
    return {
        "page_id": page_id, "url": text("url"), "final_url": text("final_url"), "status_code": _number(told.get("status_code"), int), "html": text("html"), "headers": [(k, str(x)) for k, x in headers.items()] if isinstance(headers, dict) else None,
        "elapsed_ms": _number(told.get("elapsed_ms"), float), "fetched_at": _time(told.get("fetched_at")), "retry_count": _number(told.get("retry_count"), int), "error": text("error"),
    }


class _Files:
    """The files of an archive and their lines."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.slice_bytes = int(options.get("slicebytes", SLICE_BYTES))

    def system(self):
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def listed(self) -> list[tuple[str, int]]:
        """(path, size) in the order of names."""
        system, root = self.system()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")

    def slices(self, path: str, start: int, end: int) -> list[Slice]:
        return [Slice(path, at, min(at + self.slice_bytes, end)) for at in range(start, end, self.slice_bytes)]

    def lines(self, part: Slice) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in a slice."""
        system, _ = self.system()
        with system.open_input_file(part.path) as raw:
            data, at = io.BufferedReader(raw, 1 << 20), part.start
            if at:
                data.seek(at - 1)
                at += len(data.readline()) - 1  # what is left of a line that begins before
            while at < part.end and (line := data.readline()):
                yield at, line
                at += len(line)

    def whole_lines(self, path: str, size: int) -> int:
        """The size of a file up to the end of its last whole line."""
        system, _ = self.system()
        with system.open_input_file(path) as data:
            end = size
            while end > 0:
                start = max(0, end - (1 << 16))
                data.seek(start)
                if (at := data.read(end - start).rfind(b"\n")) >= 0:
                    return start + at + 1
                end = start
        return 0

    def pages(self, part: Slice, tests: list) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for at, line in self.lines(part):
            if not line.strip():
                continue
            page = _page(line, part.path, at)
            if all((value := page[f.attribute[0]]) is not None and _TESTS[type(f)](value, f.value) for f in tests):
                held.append(page)
                size += len(line)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


def _day(path: str) -> datetime.date | None:
    found = re.search(r"/day=(\d{4}-\d{2}-\d{2})/", path)
    return datetime.date.fromisoformat(found[1]) if found else None


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.tests = _Files(options), []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if type(f) in _TESTS and len(f.attribute) == 1 and name in ("url", "status_code", "fetched_at"):
                value = f.value
                if name == "fetched_at":
                    value = tuple(map(_utc, value)) if isinstance(f, ds.In) else _utc(value)
                self.tests.append(type(f)(f.attribute, value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        """Whether pages of a file's day can pass the tests of the time."""
        day = _day(path)
        first = day and datetime.datetime.combine(day, datetime.time.min, datetime.UTC)
        last = day and first + datetime.timedelta(days=1) - datetime.timedelta(microseconds=1)
        for f in self.tests if day else ():
            if f.attribute[0] == "fetched_at":
                low, high = (min(f.value), max(f.value)) if isinstance(f, ds.In) else (f.value, f.value)
                if not isinstance(f, (ds.LessThan, ds.LessThanOrEqual)) and last < low or not isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)) and first > high:
                    return False
        return True

    def partitions(self):
        return [s for path, size in self.files.listed() if self._wanted(path) for s in self.files.slices(path, 0, size)] or [Slice("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from self.files.pages(partition, self.tests)


class StreamReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        found = self.files.listed()
        return {"file": found[-1][0], "byte": self.files.whole_lines(*found[-1])} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        parts = []
        for path, size in self.files.listed():
            if start["file"] <= path <= end["file"]:
                parts += self.files.slices(path, start["byte"] if path == start["file"] else 0, end["byte"] if path == end["file"] else size)
        return parts or [Slice("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from self.files.pages(partition, [])


class PageArchive(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.dataSource.register(PageArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pages: DataFrame, folder: str) -> None:
    """pages (any of the columns of an archive) as an archive, by day (of UTC) where they have a fetch time; ids are those of places."""
    names = [c for c in _ARROW.names if c in pages.columns and c != "page_id"]
    line = F.to_json(F.struct(*(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if c == "fetched_at" else F.col(c) for c in names)))
    if "fetched_at" in names:
        pages.select(line.alias("value"), F.date_from_unix_date(F.floor(F.unix_seconds("fetched_at") / 86400).cast("int")).alias("day")).write.mode("append").partitionBy("day").format("text").option("lineSep", "\n").save(folder)
    else:
        pages.select(line.alias("value")).write.mode("append").text(folder)
