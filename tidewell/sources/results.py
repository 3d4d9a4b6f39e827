"""A table format of its own for results: rows, a manifest and a summary that appear together, read whole or as a stream.

    spark.dataSource.register(Results)
    df.write.format("results").mode("append").save(path)
    spark.read.format("results").load(path)
    spark.readStream.format("results").load(path)

A folder holds rows as Parquet files, ``manifest-<n>.json`` for the n-th write (its files, its rows and columns), and ``_summary.json``: how
many rows there are, and the mean of every numeric column over its values. A file that no manifest names isn't there for readers. A manifest that replaces all before
ends their time for batch readers in one move; streams go on with its rows.
Paths are those that pyarrow's file systems open: local, HDFS, or an object store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def _opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(path: str, after: int = -1, until: int | None = None) -> list[dict]:
    from pyarrow import fs

    system, root = _opened(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("manifest-") and info.base_name.endswith(".json"):
            number = int(info.base_name[9:-5])
            if number > after and (until is None or number <= until):
                found.append((number, info.path))
    out = []
    for number, file in sorted(found):
        with system.open_input_stream(file) as f:
            out.append(json.loads(f.read()) | {"number": number})
    return out


def _live(path: str) -> list[dict]:
    """The manifests that count: from the last one on that replaced all before."""
    found = _manifests(path)
    start = max((i for i, m in enumerate(found) if m["replaces"]), default=0)
    return found[start:]


def _put(system, path: str, value: dict) -> None:
    """Written beside and moved, so that readers see it whole."""
    staged = f"{path}.{uuid4().hex}"
    with system.open_output_stream(staged) as f:
        f.write(json.dumps(value, sort_keys=True).encode())
    system.move(staged, path)


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its file if it had rows, and per numeric column the sum and number of its values."""

    file: str | None
    rows: int
    sums: dict[str, tuple[float, int]]


class _Files:
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, root = _opened(self.path)
        kind = to_arrow_schema(self.schema)
        with system.open_input_file(f"{root}/{partition.path}") as f:
            for batch in pq.ParquetFile(f).iter_batches():
                columns = [batch.column(n).cast(t) if n in batch.schema.names else pa.nulls(batch.num_rows, t) for n, t in zip(kind.names, kind.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)


class ResultsReader(_Files, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(f) for m in _live(self.path) for f in m["files"]]


class ResultsStream(_Files, DataSourceStreamReader):
    """Offsets are numbers of manifests: a batch has what was written since the last one."""

    def initialOffset(self) -> dict:
        return {"manifest": -1}

    def latestOffset(self) -> dict:
        return {"manifest": max((m["number"] for m in _manifests(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(f) for m in _manifests(self.path, start["manifest"], end["manifest"]) for f in m["files"]]


class ResultsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        name, rows, sums, writer = f"part-{self.job}-{uuid4().hex}.parquet", 0, {}, None
        numeric = [f.name for f in self.schema if isinstance(f.dataType, T.NumericType)]
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
            writer.write_batch(batch)
            rows += batch.num_rows
            for c in numeric:
                values = batch.column(batch.schema.names.index(c)).drop_null()
                total, n = sums.get(c, (0.0, 0))
                sums[c] = total + float(sum(map(float, values.to_pylist()))), n + len(values)
        if writer is not None:
            writer.close()
        return Written(name if rows else None, rows, sums)

    def commit(self, messages: list[Written | None]) -> None:
        """The summary of all writes so far first, the manifest last: with it the rows are there."""
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        number = max((m["number"] for m in _manifests(self.path)), default=-1) + 1
        done = [m for m in messages if m is not None]
        sums = {c: [sum(m.sums.get(c, (0.0, 0))[k] for m in done) for k in (0, 1)] for f in self.schema if isinstance(f.dataType, T.NumericType) for c in [f.name]}
        manifest = {"files": sorted(m.file for m in done if m.file), "rows": sum(m.rows for m in done), "columns": self.schema.names, "sums": sums, "replaces": self.overwrite}
        every = [*([] if self.overwrite else _live(self.path)), manifest]
        means = {}
        for c in sorted({c for m in every for c in m["sums"]}):
            total, n = (sum(m["sums"].get(c, [0.0, 0])[k] for m in every) for k in (0, 1))
            means[c] = total / n if n else None
        _put(system, f"{root}/_summary.json", {"rows": sum(m["rows"] for m in every), "means": means})
        _put(system, f"{root}/manifest-{number}.json", manifest)

    def abort(self, messages: list[Written | None]) -> None:
        """No manifest, no rows; what tasks of this write left is removed."""
        from pyarrow import fs

        system, root = _opened(self.path)
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.job}-"):
                system.delete_file(info.path)


class Results(DataSource):
    """The format ``results``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def schema(self) -> T.StructType:
        """The schema of the last write's files."""
        system, root = _opened(self.options["path"])
        for m in reversed(_live(self.options["path"])):
            for f in m["files"]:
                with system.open_input_file(f"{root}/{f}") as opened:
                    return from_arrow_schema(pq.ParquetFile(opened).schema_arrow)
        raise ValueError(f"there are no rows at {self.options['path']}; name a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ResultsReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ResultsStream(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ResultsWriter:
        return ResultsWriter(self.options["path"], schema, overwrite)


def summary(path: str) -> dict:
    """What _summary.json says; no rows where nothing was written."""
    from pyarrow import fs

    system, root = _opened(path)
    if system.get_file_info(f"{root}/_summary.json").type == fs.FileType.NotFound:
        return {"rows": 0, "means": {}}
    with system.open_input_stream(f"{root}/_summary.json") as f:
        return json.loads(f.read())
