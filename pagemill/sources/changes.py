"""A stream of new and changed files.

The built-in file stream takes each path once. This reader's offset is the pair (time of
change, path) of the last file it took, so an edited file comes again. Register and read:

    spark.dataSource.register(ChangedFiles)
    spark.readStream.format("changed_files").schema(schema).option("path", folder).load()

Files are listed by pyarrow, which reads local folders and the object stores it knows. Kinds:
"parquet" (columns of the given schema by name), "text" and "binary" (path, modified, content).
A file written with a time of change before the offset is not seen; files appear whole, that
is, are renamed into place.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

WHOLE = {"text": "path string, modified timestamp, content string", "binary": "path string, modified timestamp, content binary"}


class _File(InputPartition):
    def __init__(self, path: str, time: int):
        self.path, self.time = path, time


class _Reader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        root = options["path"]
        self.schema, self.root = schema, root if "://" in root else root.removeprefix("file:")
        self.glob, self.kind = options.get("glob", "*"), options.get("kind", "parquet")

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda p: any(part[:1] in "._" for part in p[len(root):].split("/") if part)
        return system, sorted((f.mtime_ns, f.path) for f in found if f.is_file and not hidden(f.path) and fnmatch.fnmatch(f.base_name, self.glob))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        _, files = self._files()
        time, path = files[-1] if files else (-1, "")
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        _, files = self._files()
        return [_File(path, time) for time, path in files if (start["time"], start["path"]) < (time, path) <= (end["time"], end["path"])]

    def read(self, partition: _File) -> Iterator:
        import datetime

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = fs.FileSystem.from_uri(self.root)
        if self.kind == "parquet":
            wanted = to_arrow_schema(self.schema)
            with system.open_input_file(partition.path) as source:
                file = pq.ParquetFile(source)
                known = [n for n in wanted.names if n in file.schema_arrow.names]
                for batch in file.iter_batches(columns=known):
                    columns = [batch.column(f.name).cast(f.type) if f.name in known else pa.nulls(batch.num_rows, f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays(columns, schema=wanted)
            return
        with system.open_input_stream(partition.path) as source:
            content = source.read()
        modified = datetime.datetime.fromtimestamp(partition.time / 1e9, datetime.timezone.utc)
        yield partition.path, modified, content.decode("utf-8", "replace") if self.kind == "text" else bytes(content)

    def commit(self, end: dict) -> None:
        pass


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        kind = self.options.get("kind", "parquet")
        if kind not in WHOLE:
            raise ValueError("give the schema of the parquet files")
        return WHOLE[kind]

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))
