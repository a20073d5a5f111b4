"""PDF files as DataFrames: pages with their runs, segments and images.

The kernel runs in ``mapInArrow`` and emits one row per page, with the page's
primitives as arrays.  Everything after that is row-local column expressions, so
extraction shuffles nothing.  A fault becomes columns of the row, never a failed
job, unless FAILFAST is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "struct<run_no:int,text:string,x:double,y:double,width:double,font_size:double,font:string>"
SEGMENT = "struct<axis:string,pos:double>"
IMAGE = "struct<name:string,format:string,width:long,height:long,bits_per_component:long,color_space:string,data_url:string>"
LINE = "struct<text:string,x:double,y:double>"
TABLE = "struct<rows:int,cols:int,cells:array<array<string>>>"
PAGE = (
    "page_no int, x0 double, y0 double, x1 double, y1 double, rotate int, "
    f"runs array<{RUN}>, segments array<{SEGMENT}>, images array<{IMAGE}>, "
    f"big_lines array<{LINE}>, big_tables array<{TABLE}>, error_code string, error_message string"
)
DOC = (
    "version string, page_count int, encrypted boolean, object_count long, title string, author string, subject string, "
    "creator string, page_sizes array<struct<page_no:int,x0:double,y0:double,x1:double,y1:double,rotate:int>>, "
    "lints array<struct<code:string,message:string>>, "
    "error_code string, error_message string"
)
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
#: Runs up to which a page is laid out by column expressions.
FOLD_RUNS = 300
#: Pages in an output batch, so that a batch stays small whatever a file holds.
BATCH_PAGES = 64
#: Files in an input batch: rows are whole files.
BATCH_FILES = 64


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """``doc_id`` (the path) and ``content`` of the files below ``path``."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(F.col("path").alias("doc_id"), "content")


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", max_files: int = 1000) -> DataFrame:
    """As read_files, for files as they arrive, with their modification time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("path").alias("doc_id"), "modificationTime", "content")


def _list(rows: list[list[tuple]], kinds: list, names: list[str]) -> pa.ListArray:
    """Lists of structs from lists of tuples, built column by column."""
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    flat = [x for r in rows for x in r]
    cols = list(zip(*flat, strict=True)) if flat else [[]] * len(kinds)
    struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


D, S, L, I32 = pa.float64(), pa.string(), pa.int64(), pa.int32()
CELLS = pa.list_(pa.list_(S))


def _page_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """rows: (doc_id, page_no, box, rotate, runs, segments, images, lines, tables, code, message)."""
    cols = list(zip(*rows, strict=True))
    some = pa.array([r[1] is not None for r in rows])
    boxes = [b or (None,) * 4 for b in cols[2]]

    def lists(values, kinds, names, mask=some):
        made = _list([v or [] for v in values], kinds, names)
        absent = pa.array([not m.as_py() for m in mask])
        return pa.ListArray.from_arrays(made.offsets, made.values, mask=absent)

    big = pa.array([x is not None for x in cols[7]])
    arrays = [
        pa.array(cols[0], id_type), pa.array(cols[1], I32), *[pa.array([b[k] for b in boxes], D) for k in range(4)], pa.array(cols[3], I32),
        lists(cols[4], [I32, S, D, D, D, D, S], ["run_no", "text", "x", "y", "width", "font_size", "font"]),
        lists(cols[5], [S, D], ["axis", "pos"]),
        lists(cols[6], [S, S, L, L, L, S, S], ["name", "format", "width", "height", "bits_per_component", "color_space", "data_url"]),
        lists(cols[7], [S, D, D], ["text", "x", "y"], big),
        lists(cols[8], [I32, I32, CELLS], ["rows", "cols", "cells"], big),
        pa.array(cols[9], S), pa.array(cols[10], S),
    ]
    names = ["doc_id", "page_no", "x0", "y0", "x1", "y1", "rotate", "runs", "segments", "images", "big_lines", "big_tables", "error_code", "error_message"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _checked(mode: str) -> str:
    if mode.upper() not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return mode.upper()


def _passwords(batch: pa.RecordBatch, password: str) -> list[str]:
    if "password" in batch.schema.names:
        return [x or password for x in batch.column("password").to_pylist()]
    return [password] * batch.num_rows


def _lean(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "content", *["password"] * ("password" in files.columns))


def read_pages(files: DataFrame, password: str = "", mode: str = "PERMISSIVE", pages=None, images: bool = True, painted_only: bool = False) -> DataFrame:
    """One row per page of ``files(doc_id, content[, password])``, in the PAGE schema.

    pages: numbers to read, None for all; other pages' content is not decoded.  A
    file that cannot be read gives one row with error columns (PERMISSIVE), none
    (DROPMALFORMED), or fails the job (FAILFAST).  A fault in any page is the
    file's.  Null or empty content is an InvalidHeader.
    """
    mode, wanted = _checked(mode), None if pages is None else frozenset(pages)
    lean = _lean(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernel import extract, layout
        from quire.kernel.errors import PdfError

        for batch in batches:
            out, kind = [], batch.schema.field("doc_id").type
            for doc_id, content, word in zip(batch.column("doc_id").to_pylist(), batch.column("content"), _passwords(batch, password), strict=True):
                here = []
                try:
                    data = content.as_buffer().to_pybytes() if content.is_valid else b""
                    for no, box, rotate, runs, segments, found in extract.pages(data, word, wanted, images, painted_only):
                        big_lines = big_tables = None
                        if len(runs) > FOLD_RUNS:
                            cells, outside = layout.table(segments, runs)
                            big_lines = layout.lines(outside)
                            big_tables = [(len(cells), len(cells[0]), cells)] if cells else []
                        numbered = [(k, *r) for k, r in enumerate(runs)]
                        here.append((doc_id, no, box, rotate, numbered, segments, found, big_lines, big_tables, None, None))
                except PdfError as e:
                    if mode == "FAILFAST":
                        raise
                    here = [] if mode == "DROPMALFORMED" else [(doc_id, None, None, None, None, None, None, None, None, e.code, e.message)]
                except RecursionError:
                    here = [(doc_id, None, None, None, None, None, None, None, None, "InvalidObject", "nested too deeply")] if mode == "PERMISSIVE" else []
                out += here
                while len(out) >= BATCH_PAGES:
                    yield _page_batch(out[:BATCH_PAGES], kind)
                    out = out[BATCH_PAGES:]
            if out:
                yield _page_batch(out, kind)

    return lean.mapInArrow(run, f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, {PAGE}")


def read_docs(files: DataFrame, password: str = "", mode: str = "PERMISSIVE") -> DataFrame:
    """One row per file in the DOC schema; page content is not decoded.

    lints: what was wrong with the structure of a file that could be read; the
    ``lints`` table of read_inner looks at every object."""
    mode, lean = _checked(mode), _lean(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernel import extract
        from quire.kernel.errors import PdfError

        names = ["version", "page_count", "encrypted", "object_count", "title", "author", "subject", "creator"]
        kinds = [S, I32, pa.bool_(), L, S, S, S, S]
        for batch in batches:
            rows = []
            for doc_id, content, word in zip(batch.column("doc_id").to_pylist(), batch.column("content"), _passwords(batch, password), strict=True):
                try:
                    d = extract.inspect(content.as_buffer().to_pybytes() if content.is_valid else b"", word)
                    rows.append((doc_id, *[d[n] for n in names], d["pages"], d["lints"], None, None))
                except (PdfError, RecursionError) as e:
                    if mode == "FAILFAST":
                        raise
                    if mode == "PERMISSIVE":
                        code, message = (e.code, e.message) if isinstance(e, PdfError) else ("InvalidObject", "nested too deeply")
                        rows.append((doc_id, *[None] * 8, None, None, code, message))
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            sizes = _list([x or [] for x in cols[9]], [I32, D, D, D, D, I32], ["page_no", "x0", "y0", "x1", "y1", "rotate"])
            arrays = [pa.array(cols[0], batch.schema.field("doc_id").type), *[pa.array(c, k) for c, k in zip(cols[1:9], kinds, strict=True)], sizes, _list([x or [] for x in cols[10]], [S, S], ["code", "message"]), pa.array(cols[11], S), pa.array(cols[12], S)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "page_sizes", "lints", "error_code", "error_message"])

    return lean.mapInArrow(run, f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, {DOC}")


#: Tables of a file's inner structure: kernel function and schema.
INNER = {
    "objects": "obj_num int, storage string, kind string, type string, value string",
    "page_operations": "page_no int, op_no int, operator string, operands array<string>",
    "page_glyphs": "page_no int, font string, code int, text string, width double, n long",
    "lints": "code string, message string",
}


def read_inner(files: DataFrame, table: str, password: str = "", mode: str = "PERMISSIVE") -> DataFrame:
    """``doc_id`` and the columns of one of the INNER tables.

    For looking into files; a file that cannot be read gives no rows (its error
    is in read_docs), or fails the job in mode FAILFAST."""
    mode, lean, rows_at_once = _checked(mode), _lean(files), 4096
    schema = f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, {INNER[table]}"
    kinds = {"int": I32, "long": L, "double": D, "string": S, "array<string>": pa.list_(S)}
    names, types = zip(*[c.split(" ", 1) for c in INNER[table].split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.kernel import extract
        from quire.kernel.errors import PdfError

        def made(doc_id, kind, rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([doc_id] * len(rows), kind), *[pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)]], names=["doc_id", *names])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, content, word in zip(batch.column("doc_id").to_pylist(), batch.column("content"), _passwords(batch, password), strict=True):
                rows = []
                try:
                    for row in getattr(extract, table)(content.as_buffer().to_pybytes() if content.is_valid else b"", word):
                        rows.append(row)
                        if len(rows) == rows_at_once:
                            yield made(doc_id, kind, rows)
                            rows = []
                except (PdfError, RecursionError):
                    if mode == "FAILFAST":
                        raise
                if rows:
                    yield made(doc_id, kind, rows)

    return lean.mapInArrow(run, schema)
