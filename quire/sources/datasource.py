"""``spark.read.format("pdf")``: the lines of files, as a Python data source.

Paths are listed and opened through Arrow's file systems, on the driver and on the
workers: object stores and HDFS by their URI, local disks and mounts where every
worker has them.  quire.sources.pdf reads through Spark's ``binaryFile``, which is
the faster way for many small files; this source can skip pages when a filter
names them.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "doc_id string, page_no int, line_no int, text string, x double, y double, error_code string"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.paths = _expand(options["path"], options.get("pathGlobFilter", "*.pdf"))
        self.password = options.get("password", "")
        self.per_partition = int(options.get("filesPerPartition", 64))
        self.page = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A page number given by equality is pushed; everything else stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page_no",) and self.page is None:
                self.page = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        n = self.per_partition
        return [Files(self.paths[i : i + n]) for i in range(0, len(self.paths), n)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from quire.kernel import extract, layout
        from quire.kernel.errors import PdfError

        wanted = None if self.page is None else {self.page}
        for path in partition.paths:
            try:
                store, at = _store(path)
                with store.open_input_stream(at) as f:
                    data = f.read()
                rows = []
                for no, _, _, runs, segments, _ in extract.pages(data, self.password, wanted, images=False):
                    rows += [(path, no, k + 1, t, x, y, None) for k, (t, x, y) in enumerate(layout.lines(layout.table(segments, runs)[1]))]
                yield from rows
            except (PdfError, RecursionError) as e:
                if self.page is None:
                    yield (path, None, None, None, None, None, e.code if isinstance(e, PdfError) else "InvalidObject")


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _expand(path: str, pattern: str) -> list[str]:
    """The files that match below a folder, or the one file that ``path`` names, as they were named."""
    from pyarrow import fs

    store, at = _store(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path] if store.get_file_info(at).type == fs.FileType.File else []
    front = path[: len(path) - len(at)] if path.endswith(at) else path.split("://", 1)[0] + "://"
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(front + x.path for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern))


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfDataSource)
