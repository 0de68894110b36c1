"""Raw corpora as a data source: spark.dataSource.register(RawCorpus), then spark.read.format("rawcorpus").load(path).

Files are read in ranges, each its own task; of a line that two ranges share the one where it begins has it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
SCHEMA = "kind string, label_id int, totals array<double>, features array<struct<attr_id:int,occ:bigint,field_id:int>>"


def parse(line: str) -> tuple | None:
    """kind, label_id, totals, features (attr_id, occ, field_id); None of a line that is no document."""
    p = line.split("\t")
    try:
        if len(p) < 4 or p[0] not in ("SimpleDocument", "MultiFieldDocument"):
            return None
        multi = p[0] == "MultiFieldDocument"
        n, first = (int(p[2]), 3) if multi else (1, 2)
        if n < 0 or len(p) < first + n:
            return None
        features = [tuple(map(int, x.split(":"))) for x in p[first + n :]]
        if any(len(f) < 2 + multi for f in features):
            return None
        return p[0], int(p[1]), [float(x) for x in p[first : first + n]], [(f[0], f[1], f[2] if len(f) > 2 else None) for f in features]
    except ValueError:
        return None


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class RawReader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int):
        self.uri, self.range_bytes = uri, range_bytes

    def _open(self):
        return FileSystem.from_uri(self.uri) if "://" in self.uri else FileSystem.from_uri("file://" + self.uri)

    def partitions(self) -> list[Range]:
        fs, path = self._open()
        info = fs.get_file_info(path)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.uri)
        files = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(path))
        ranges = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == FileType.File and not f.base_name.startswith(("_", ".")):
                ranges += [Range(f.path, i, min(f.size, i + self.range_bytes)) for i in range(0, f.size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = self._open()
        with io.BufferedReader(fs.open_input_file(partition.path), 1 << 20) as f:
            at = partition.start
            if at:  # the line that holds the byte before belongs to another range
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end and (line := f.readline()):
                at += len(line)
                if (row := parse(line.decode("utf-8", "replace").rstrip("\r\n"))) is not None:
                    yield row


class RawCorpus(DataSource):
    """Options: path (a file or folder), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "rawcorpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return RawReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))
