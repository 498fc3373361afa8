"""A data source for separated log records, such as ``git log`` prints.

A record is its fields, joined by U+001F and ended by U+001E. Files are cut into
ranges of bytes, wherever these fall; a task reads the records that begin in its
range, the last one to its end. Comparisons of hash, author and timestamp with a
text are pushed down: a record that cannot pass is dropped before its message is
decoded. Files are opened through Arrow, by path or URI, so any store that Arrow
knows will do; every executor has to reach it.

Defined results: a record of fewer fields than there are columns is passed over;
bytes that are no UTF-8 are replaced; an empty folder has no records.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

FIELD, RECORD = b"\x1f", b"\x1e"
COLUMNS = ("hash", "short_hash", "parents", "author", "email", "timestamp", "message")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
#: What is compared before a record is decoded.
PUSHED = {"hash", "author", "timestamp"}
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Bytes of a range, of a read, and records of a batch.
RANGE, CHUNK, BATCH = 16 << 20, 1 << 20, 4096


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def records(file, start: int, end: int) -> Iterator[bytes]:
    """The records that begin in [start, end): at the file's start, or after the end of another."""
    file.seek(max(0, start - 1))
    at, rest, skipping = max(0, start - 1), b"", start > 0
    while data := file.read(CHUNK):
        rest += data
        while (cut := rest.find(RECORD)) >= 0:
            if not skipping:
                if at >= end:
                    return
                yield rest[:cut]
            skipping = False
            rest, at = rest[cut + 1 :], at + cut + 1
    if rest and not skipping and at < end:
        yield rest


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("bytes", RANGE))
        self.tests: list[tuple[int, type, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in COMPARED and f.attribute[0] in PUSHED and isinstance(f.value, str):
                self.tests.append((COLUMNS.index(f.attribute[0]), type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, a, min(a + self.size, f.size)) for f in files for a in range(0, f.size, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        tests = [(i, COMPARED[kind], value.encode()) for i, kind, value in self.tests]
        held: list[list[bytes]] = []
        with _opened(self.path)[0].open_input_file(partition.path) as file:
            for raw in records(file, partition.start, partition.end):
                part = raw.split(FIELD, len(COLUMNS) - 1)
                # UTF-8 sorts as its code points do, so bytes are compared.
                if len(part) == len(COLUMNS) and all(f(part[i], value) for i, f, value in tests):
                    held.append(part)
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)


def _batch(rows: list[list[bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x.decode("utf-8", "replace") for x in column], pa.string()) for column in zip(*rows, strict=True)], names=list(COLUMNS))


class LogRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def read_log(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The records under ``path``; turns the pushing of filters to Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogRecords)
    return spark.read.format("log_records").option("path", path).option("bytes", str(size)).load()


def write_log(rows: DataFrame, path: str) -> None:
    """Rows with the columns of the source as records."""
    from pyspark.sql import functions as F

    each = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in COLUMNS])
    rows.select(each.alias("value")).write.option("lineSep", "\x1e").text(path)
