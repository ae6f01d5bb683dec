"""A data source of records by dataset: ``spark.read.format("tessera_records")``.

Below ``path`` each dataset is a folder ``dataset=<name>`` of JSON line files.
The reader plans a partition for every ``_SPLIT`` bytes of a file; a filter on ``dataset`` (equality or a
list) is taken over and leaves whole folders unread. The writer lets every task
write files aside; the commit moves those of the tasks that count into place, and
an abort, or a task that is repeated, leaves nothing behind that a reader sees.
Files are opened through Arrow's file systems, by URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "tessera_records"
#: Rows of a record batch.
_BATCH = 5000
#: Bytes of a file that one task reads.
_SPLIT = 64 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    system, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
    return system, where.rstrip("/")


@dataclass
class File(InputPartition):
    path: str
    dataset: str
    start: int = 0
    end: int = 0


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Records(DataSource):
    """Options: ``path``. Columns: ``dataset`` and whatever the given schema names."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "dataset string, id string, instruction string, input string, output string, metadata map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(schema, self.options, overwrite)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.base, self.wanted = schema, options["path"], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("dataset",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[File]:
        system, base = _at(self.base)
        out = []
        for folder in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            kind, _, name = folder.base_name.partition("=")
            name = unquote(name)
            if kind == "dataset" and (self.wanted is None or name in self.wanted):
                files = [x for x in system.get_file_info(fs.FileSelector(folder.path)) if x.is_file and x.size]
                out += [File(x.path, name, k, min(k + _SPLIT, x.size)) for x in files for k in range(0, x.size, _SPLIT)]
        return out or [File("", "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        schema = to_arrow_schema(self.names)
        system, _ = _at(self.base)
        with system.open_input_file(partition.path) as lines:
            # A line is of the part that it begins in; what is ahead of the first one ends in another part.
            skip, at = partition.start > 0, max(0, partition.start - 1)
            lines.seek(at)
            rest, held = b"", []
            while at < partition.end and (block := lines.read(1 << 20)):
                *whole, rest = (rest + block).split(b"\n")
                for x in whole:
                    if x and not skip and at < partition.end:
                        held.append(json.loads(x))
                    skip, at = False, at + len(x) + 1
                while len(held) >= _BATCH:
                    yield self._batch(held[:_BATCH], partition.dataset, schema)
                    held = held[_BATCH:]
            held += [json.loads(rest)] if rest and not skip and at < partition.end else []
            if held:
                yield self._batch(held, partition.dataset, schema)

    @staticmethod
    def _batch(rows: list[dict], dataset: str, schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([dataset if f.name == "dataset" else r.get(f.name) for r in rows], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.base, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _at(self.base)
        open_files: dict[str, object] = {}
        files: list[tuple[str, str]] = []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    name = row.pop("dataset") or ""
                    if name not in open_files:
                        aside = f"{base}/_run-{self.run}/{uuid.uuid4().hex}.jsonl"
                        system.create_dir(aside.rpartition("/")[0], recursive=True)
                        open_files[name] = system.open_output_stream(aside)
                        files.append((name, aside))
                    open_files[name].write(json.dumps({k: dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else v for k, v in row.items() if v is not None}, ensure_ascii=False).encode() + b"\n")
        finally:
            for out in open_files.values():
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _at(self.base)
        old = [x.path for x in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if x.is_file and "/dataset=" in x.path] if self.overwrite else []
        for name, aside in (f for m in messages if m is not None for f in m.files):
            folder = f"{base}/dataset={quote(name, safe='')}"
            system.create_dir(folder, recursive=True)
            system.move(aside, f"{folder}/{aside.rpartition('/')[2]}")
        for path in old:
            system.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _at(self.base)
        if system.get_file_info(f"{base}/_run-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_run-{self.run}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
