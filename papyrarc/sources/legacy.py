"""A legacy archive as a Spark source: its SQLite index, read in ranges of rows, and its snapshot folders, listed in groups."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: The index's tables and their columns. Fixed values.
INDEX = {
    "core_snapshot": ["id", "url", "timestamp", "title", "bookmarked_at", "downloaded_at"],
    "core_archiveresult": ["snapshot_id", "extractor", "status", "output"],
    "core_tag": ["id", "name"],
    "core_snapshot_tags": ["snapshot_id", "tag_id"],
}

#: What can be read: of the index, the table whose rows are dealt, columns in SQL, and what is joined to it; the rest is read off the folders.
TABLES = {
    "snapshots": ("core_snapshot", {c: f"t.{c}" for c in INDEX["core_snapshot"]}, ""),
    "results": ("core_archiveresult", {c: f"t.{c}" for c in INDEX["core_archiveresult"]}, ""),
    "tags": ("core_snapshot_tags", {"snapshot_id": "t.snapshot_id", "tag": "core_tag.name"}, "JOIN core_tag ON core_tag.id = t.tag_id"),
}
FOLDERS = {"folders": "snapshot string", "files": "snapshot string, name string, path string, length long"}

#: A range of rows isn't made smaller than so many bytes of the database on average, however far its row numbers lie apart.
LEAST_BYTES = 1 << 16

#: Values of a list in a filter that are handed to the database; longer lists are left to Spark.
MOST_VALUES = 500


class LegacySourceError(ValueError):
    """A legacy archive that lacks a folder, a database, a table or columns."""


@dataclass
class Rows(InputPartition):
    """Row numbers from `low` to `high` of a database."""

    database: str
    low: int
    high: int


@dataclass
class Folders(InputPartition):
    names: list[str] = field(default_factory=list)


def local_path(path: str) -> str:
    """The path in the file system that all tasks share; a URL of any other store is refused."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise LegacySourceError(f"{path} isn't in a file system that tasks can open; databases are read in place")
    return unquote(parts.path) if parts.scheme else path


def _connect(database: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{quote(database)}?mode=ro", uri=True)
    con.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return con


def _same(expression: str, values: list) -> tuple[str, list]:
    """SQL by which a text equals one of the values, whatever the column's own type and collation."""
    return f"CAST({expression} AS TEXT) COLLATE BINARY IN ({', '.join('?' * len(values))})", values


class LegacyReader(DataSourceReader):
    def __init__(self, table: str, path: str, rows: int, folders: int) -> None:
        self.table, self.path, self.rows, self.folders = table, path, rows, folders
        self.wanted: dict[str, list] = {}

    def partitions(self) -> list[InputPartition]:
        if self.table in FOLDERS:
            root = os.path.join(self.path, "archive")
            if not os.path.isdir(root):
                raise LegacySourceError(f"{root} isn't a folder")
            wanted = set(self.wanted["snapshot"]) if "snapshot" in self.wanted else None
            names = sorted(e.name for e in os.scandir(root) if (wanted is None or e.name in wanted) and e.is_dir())
            return [Folders(names[i : i + self.folders]) for i in range(0, len(names), self.folders)] or [Folders()]
        databases = sorted(map(str, Path(self.path).glob("index*.sqlite3")))
        if not databases:
            raise LegacySourceError(f"no index*.sqlite3 below {self.path}")
        return [r for d in databases for r in self._ranges(d)] or [Folders()]

    def _ranges(self, database: str) -> Iterator[Rows]:
        con = _connect(database)
        try:
            for name, required in INDEX.items():
                lacks = set(required) - {r[1] for r in con.execute(f"PRAGMA table_info({name})")}
                if lacks:
                    raise LegacySourceError(f"{name} of {database} lacks {', '.join(sorted(lacks))}")
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {TABLES[self.table][0]}").fetchone()
        finally:
            con.close()
        if low is not None:
            parts = min(-(-(high - low + 1) // self.rows), 1 + os.path.getsize(database) // LEAST_BYTES)
            ends = [low + (high - low + 1) * i // parts for i in range(parts + 1)]
            for a, b in zip(ends, ends[1:], strict=False):
                yield Rows(database, a, b - 1)

    def read(self, part: Rows | Folders) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Rows):
            yield from self._read_rows(part)
        elif self.table == "folders":
            yield pa.RecordBatch.from_arrays([pa.array(part.names, pa.string())], names=["snapshot"])
        elif self.table == "files":
            yield from map(self._list, part.names)

    def _read_rows(self, part: Rows) -> Iterator[pa.RecordBatch]:
        name, columns, joined = TABLES[self.table]
        listed = ", ".join(f"CAST({e} AS TEXT)" for e in columns.values())
        tests, values = ["t.rowid BETWEEN ? AND ?"], [part.low, part.high]
        for column, allowed in self.wanted.items():
            test, more = _same(columns[column], allowed)
            tests.append(test)
            values += more
        con = _connect(part.database)
        try:
            found = con.execute(f"SELECT {listed} FROM {name} t {joined} WHERE {' AND '.join(tests)} ORDER BY t.rowid", values)
            while rows := found.fetchmany(5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=list(columns))
        finally:
            con.close()

    def _list(self, snapshot: str) -> pa.RecordBatch:
        """Files of a folder with their lengths; none is opened, and links out of the folder aren't followed."""
        folder = os.path.join(self.path, "archive", snapshot)
        found = sorted((e.name, e.path, e.stat(follow_symlinks=False).st_size) for e in os.scandir(folder) if e.is_file(follow_symlinks=False))
        found = [f for f in found if f[0] in self.wanted["name"]] if "name" in self.wanted else found
        names, paths, lengths = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([snapshot] * len(found), pa.string()), pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["snapshot", "name", "path", "length"])


class PushingReader(LegacyReader):
    """Hands equalities and lists of values to the database or to the choice of folders. Spark tests them again, so a pushed filter only saves reading."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        columns = {"folders": ["snapshot"], "files": ["snapshot", "name"]}.get(self.table) or TABLES[self.table][1]
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in columns and f.attribute[0] not in self.wanted:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                if 0 < len(values) <= MOST_VALUES and all(isinstance(v, str) for v in values):
                    self.wanted[f.attribute[0]] = values
            yield f


class LegacyArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "legacy_archive"

    def _table(self) -> str:
        name = self.options.get("table", "snapshots")
        if name not in TABLES and name not in FOLDERS:
            raise LegacySourceError(f"no table {name}; there are {', '.join([*TABLES, *FOLDERS])}")
        return name

    def schema(self) -> str:
        name = self._table()
        return FOLDERS.get(name) or ", ".join(f"`{c}` string" for c in TABLES[name][1])

    def reader(self, schema: object) -> DataSourceReader:
        kind = PushingReader if self.options.get("push") == "true" else LegacyReader
        return kind(self._table(), local_path(self.options["path"]), int(self.options.get("rows", "50000")), int(self.options.get("folders", "1000")))


def legacy_table(spark: SparkSession, path: str, table: str, rows: int = 50_000, folders: int = 1000) -> DataFrame:
    """A table of the legacy archive at `path`, a folder that all tasks can open, which isn't written to.

    `snapshots`, `results` and `tags` come from its index, one or more files index*.sqlite3, a task for each range of about `rows` row numbers;
    `folders` and `files` from the folders below archive/, a task for so many folders, with lengths and no contents. All columns but
    lengths are text. An index without one of the columns is refused when the query is planned. Where
    spark.sql.python.filterPushdown.enabled is set, equalities and lists of values reach the database or the choice of folders.
    """
    spark.dataSource.register(LegacyArchive)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("legacy_archive").options(table=table, rows=rows, folders=folders, push=push).load(path)
