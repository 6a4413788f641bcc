"""A Python data source that reads path listings, one path per line, split by file for parallel reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ListingPartition(InputPartition):
    """One listing file, by its path in the file system of the root."""

    def __init__(self, path: str) -> None:
        self.path = path


class ListingReader(DataSourceReader):
    """Lists on the driver, reads in the tasks, both through the file system that the root names."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _system(self) -> tuple[fs.FileSystem, str]:
        # A path without scheme is one that all machines see, such as a mounted folder.
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def partitions(self) -> list[InputPartition]:
        system, root = self._system()
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [ListingPartition(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".md")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, root = self._system()
        name = partition.path.removeprefix(root.rstrip("/")).lstrip("/")
        with system.open_input_stream(partition.path) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from self._rows(name, lines)
            yield from self._rows(name, [rest])

    @staticmethod
    def _rows(name: str, lines: list[bytes]) -> Iterator[tuple]:
        for raw in lines:
            if line := raw.decode("utf-8", errors="replace").strip():
                yield name, line


class ListingSource(DataSource):
    """``spark.dataSource.register(ListingSource)``, then ``spark.read.format("listing").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "rel_path string, line string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])
