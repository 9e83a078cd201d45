"""Parquet folders: a source over the files' footers, and a sink whose tasks check rules and whose files appear on commit.

Both take paths or URIs of any file system that Arrow knows and that driver and tasks share.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

# the source and the sink go to workers whole, so these need not be able to import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Files whose footers one task reads.
FILES_PER_TASK = 64
FOOTERS = "file string, error string, row_group int, rows long, column string, type string, nulls long, low string, high string, bytes long"
#: What the sink's errors begin with.
BROKEN = "broken rule: "


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Footers(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        names = []
        for path in self.paths:
            system, root = located(path)
            info = system.get_file_info(root)
            if info.type == fs.FileType.File:
                names.append((path, root))
            elif info.type == fs.FileType.Directory:
                below = system.get_file_info(fs.FileSelector(root, recursive=True))
                names += sorted((path, f.path) for f in below if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")))
        return [_Files(names[i : i + FILES_PER_TASK]) for i in range(0, len(names), FILES_PER_TASK)]

    def read(self, part: _Files) -> Iterator[tuple]:
        for path, name in part.names:
            try:
                footer = pq.read_metadata(name, filesystem=located(path)[0])
                rows = list(_columns(name, footer))
            except (OSError, pa.ArrowException, ValueError) as e:
                rows = [(name, f"{type(e).__name__}: {e}"[:300], *[None] * 8)]
            yield from rows


def _leaves(kind: pa.DataType) -> int:
    """How many stored columns a type has."""
    if pa.types.is_struct(kind):
        return sum(_leaves(kind.field(i).type) for i in range(kind.num_fields))
    if pa.types.is_map(kind):
        return _leaves(kind.key_type) + _leaves(kind.item_type)
    return _leaves(kind.value_type) if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind) else 1


def _columns(name: str, footer: pq.FileMetaData) -> Iterator[tuple]:
    """A row for each column of each row group, and one of each column where there is no row group."""
    schema = footer.schema.to_arrow_schema()
    kinds = {f.name: from_arrow_type(f.type).simpleString() for f in schema}
    if not footer.num_row_groups:
        yield from ((name, None, None, 0, c, kind, 0, None, None, 0) for c, kind in kinds.items())
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        leaves, at = {}, 0
        for field in schema:
            leaves[field.name] = [group.column(i) for i in range(at, at + _leaves(field.type))]
            at += len(leaves[field.name])
        for c, own in leaves.items():
            # a list's or struct's statistics are those of its leaves, which say nothing about the column itself
            s = own[0].statistics if len(own) == 1 and own[0].path_in_schema == c else None
            told = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
            yield name, None, g, group.num_rows, c, kinds[c], s.null_count if s is not None and s.has_null_count else None, *told, sum(x.total_compressed_size for x in own)


class FooterSource(DataSource):
    """Format 'parquet_footers'; option paths: a JSON list of files or folders."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return FOOTERS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Footers(json.loads(self.options["paths"]))


def footers(spark: SparkSession, *paths: str) -> DataFrame:
    """What the footers of all Parquet files in paths say, a row for each column of a row group; error for files without a footer."""
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footers").option("paths", json.dumps(paths)).load()


# ---- sink -------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class _CheckedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.required, self.key = json.loads(options.get("required", "[]")), json.loads(options.get("key", "[]"))
        self.stage = f".staging-{uuid.uuid4().hex}"

    def _open(self, system: fs.FileSystem, target: str, schema: pa.Schema) -> pq.ParquetWriter:
        return pq.ParquetWriter(target, schema, filesystem=system, compression="zstd", compression_level=3)

    def _check(self, batch: pa.RecordBatch, last: list | None) -> list | None:
        """Raises if a rule is broken; gives the batch's last key."""
        for c in self.required:
            if batch.column(c).null_count:
                raise ValueError(f"{BROKEN}null in {c}")
        if not self.key or not batch.num_rows:
            return last
        keys = [batch.column(c) for c in self.key]
        first = [k[0].as_py() for k in keys]
        same = None
        for k in keys:
            equal = pc.fill_null(pc.equal(k.slice(1), k.slice(0, len(k) - 1)), False)
            same = equal if same is None else pc.and_(same, equal)
        if first == last and None not in first or pc.any(same).as_py():
            raise ValueError(f"{BROKEN}repeated {', '.join(self.key)}")
        return [k[-1].as_py() for k in keys]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        name, out, rows, last = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", None, 0, None
        try:
            for batch in batches:
                last = self._check(batch, last)
                if out is None:
                    system.create_dir(f"{root}/{self.stage}")
                    out = self._open(system, f"{root}/{self.stage}/{name}", batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root)
        made = [m.name for m in messages if m is not None and m.name]
        for name in made:
            system.move(f"{root}/{self.stage}/{name}", f"{root}/{name}")
        if not made:  # a table without rows has its columns in a file as well
            self._open(system, f"{root}/part-00000-{uuid.uuid4().hex}.parquet", to_arrow_schema(self.schema)).close()
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what tasks have left, files of attempts that were repeated among it."""
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")
        if system.get_file_info(root).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(root)):
            system.delete_dir(root)


class CheckedSink(DataSource):
    """Format 'checked_parquet'; options path, required and key (JSON lists of columns). Rows of equal keys must follow each other in a task."""

    @classmethod
    def name(cls) -> str:
        return "checked_parquet"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _CheckedWriter(dict(self.options), schema)


def write_checked(df: DataFrame, path: str, required: list[str] | None = None, key: list[str] | None = None) -> None:
    """Adds df's rows to the folder path, all or none.

    Tasks write to a hidden folder below path and fail where a required column is null or a key occurs twice (keys with a null
    part never do); the driver moves the files when all tasks are done, and removes them if one failed.
    """
    df.sparkSession.dataSource.register(CheckedSink)
    if key:
        df = df.repartition(*key).sortWithinPartitions(*key)
    df.write.format("checked_parquet").option("path", path).option("required", json.dumps(required or [])).option("key", json.dumps(key or [])).mode("append").save()
