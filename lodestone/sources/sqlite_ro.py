"""A read-only Python data source for SQLite files: format 'sqlite_ro'.

Options: path; mode 'table' (default), 'catalog' or 'probe'; table; columns, comma-separated; rows, how many rows a task
takes (tables with a rowid are split by it). Files are opened immutable, so neither a lock nor a journal is left behind.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType()}


def uri(path: str) -> str:
    return f"file:{quote(path)}?mode=ro&immutable=1"


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(uri(path), uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(con: sqlite3.Connection) -> list[str]:
    return [r[0] for r in con.execute("select name from sqlite_master where type = 'table' order by name")]


def probe(path: str) -> tuple[int | None, list[str]]:
    """The user version and tables of a file, (None, []) for one that is no database."""
    try:
        con = connect(path)
        try:
            return con.execute("pragma user_version").fetchone()[0], tables(con)
        finally:
            con.close()
    except sqlite3.Error:
        return None, []


def columns(con: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    """(name, declared type) in order of declaration."""
    return [(r[1], r[2].upper()) for r in con.execute(f"pragma table_info({quoted(table)})")]


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.o, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        step = int(self.o.get("rows", 100_000))
        if self.o.get("mode", "table") != "table":
            return [_Range(None, None)]
        con = connect(self.o["path"])
        try:
            low, high, n = con.execute(f"select min(rowid), max(rowid), count(*) from {quoted(self.o['table'])}").fetchone()
        except sqlite3.Error:
            return [_Range(None, None)]
        finally:
            con.close()
        if low is None:
            return []
        # as many ranges as the rows ask for: rowids may lie far apart
        parts = -(-n // step)
        width = -(-(high - low + 1) // parts)
        return [_Range(i, i + width) for i in range(low, high + 1, width)]

    def read(self, part: _Range) -> Iterator[tuple]:
        mode, path = self.o.get("mode", "table"), self.o["path"]
        if mode == "probe":
            version, names = probe(path)
            yield path, version, names
            return
        con = connect(path)
        try:
            if mode == "catalog":
                for t in tables(con):
                    for i, (c, kind) in enumerate(columns(con, t)):
                        yield t, i, c, kind
                return
            names = ", ".join(quoted(f.name) for f in self.schema.fields if f.name != "_ordinal")
            where = "" if part.low is None else f" where rowid >= {part.low} and rowid < {part.high}"
            key = "rowid" if part.low is not None else "0"
            cast = [float if isinstance(f.dataType, T.DoubleType) else str if isinstance(f.dataType, T.StringType) else None for f in self.schema.fields[:-1]]
            for row in con.execute(f"select {names}, {key} from {quoted(self.o['table'])}{where}"):
                values = (v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in row[:-1])
                yield (*(v if v is None or c is None else c(v) for v, c in zip(values, cast)), row[-1])
        finally:
            con.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> T.StructType | str:
        mode = self.options.get("mode", "table")
        if mode == "probe":
            return "path string, user_version int, tables array<string>"
        if mode == "catalog":
            return "table string, ordinal int, column string, declared string"
        con = connect(self.options["path"])
        try:
            have = columns(con, self.options["table"])
        finally:
            con.close()
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        kept = [(n, k) for n, k in have if not wanted or n in wanted]
        return T.StructType([*(T.StructField(n, _KINDS.get(k, T.StringType())) for n, k in kept), T.StructField("_ordinal", T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def load(spark: SparkSession, path: str, table: str | None = None, columns: list[str] | None = None, mode: str = "table"):
    """A table with its rows' _ordinal, the catalog, or the probe of a file."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_ro").option("path", path).option("mode", mode)
    if table is not None:
        reader = reader.option("table", table)
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    return reader.load()
