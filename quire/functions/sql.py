"""SQL names for extraction: a table function and scalar functions over content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.kernel import extract, filters, layout, rendering
from quire.kernel.cos import Name
from quire.kernel.errors import PdfError


class PdfLines:
    """SELECT ... FROM files, LATERAL pdf_lines(content): the lines of each file; none if it cannot be read."""

    def eval(self, content: bytes, password: str = "") -> Iterator[tuple]:
        try:
            for no, _, _, runs, segments, _ in extract.pages(content or b"", password or "", images=False):
                for k, (t, x, y) in enumerate(layout.lines(layout.table(segments, runs)[1])):
                    yield no, k + 1, t, x, y
        except (PdfError, RecursionError):
            return


def readable(f, fault=lambda e: None):
    """``f`` of content, or ``fault`` of the error where a file cannot be read."""

    def one(content):
        try:
            return f(content or b"")
        except PdfError as e:
            return fault(e)
        except RecursionError:
            return fault(PdfError("InvalidObject", "nested too deeply"))

    return one


def rendered(kind: str):
    def run(content: pd.Series) -> pd.Series:
        return content.map(readable(lambda b: rendering.document(b, kind)))

    return run


def pdf_page_count(content: pd.Series) -> pd.Series:
    return content.map(readable(lambda b: extract.inspect(b)["page_count"])).astype("Int32")


def pdf_error(content: pd.Series) -> pd.Series:
    """The error code of a file, null if it can be read."""

    def every_page(b: bytes) -> None:
        for _ in extract.pages(b, images=False):
            pass

    return content.map(readable(every_page, lambda e: e.code))


def pdf_inspect(content: pd.Series) -> pd.DataFrame:
    """Version, counts and metadata of a file without decoding its content."""
    none = dict.fromkeys(INSPECTED)
    rows = content.map(readable(extract.inspect, lambda e: none | {"error_code": e.code}))
    return pd.DataFrame([[r.get(c) for c in INSPECTED] for r in rows], columns=list(INSPECTED), dtype=object)


def pdf_lints(content: pd.Series) -> pd.Series:
    """What was wrong with a file that could be read all the same, as code: message."""
    return content.map(readable(lambda b: [f"{code}: {message}" for code, message in extract.lints(b)]))


def pdf_decode_stream(filter: pd.Series, data: pd.Series) -> pd.Series:
    """Decode bytes by one filter name; null where that fails."""

    def one(name, b):
        try:
            return filters.decode({"Filter": Name(name)}, bytes(b))
        except PdfError:
            return None

    return pd.Series([one(n, b) for n, b in zip(filter, data, strict=True)])


#: SQL name -> (function over a column, type).  Made into Pandas UDFs on registration:
#: that needs a session, which workers that import this module do not have.
INSPECTED = {
    "version": "string", "page_count": "int", "encrypted": "boolean", "object_count": "long",
    "title": "string", "author": "string", "subject": "string", "creator": "string", "error_code": "string",
}
SCALARS = {
    "pdf_text": (rendered("text"), "string"),
    "pdf_markdown": (rendered("markdown"), "string"),
    "pdf_html": (rendered("html"), "string"),
    "pdf_json": (rendered("json"), "string"),
    "pdf_inspect": (pdf_inspect, ", ".join(f"{c} {t}" for c, t in INSPECTED.items())),
    "pdf_lints": (pdf_lints, "array<string>"),
    "pdf_page_count": (pdf_page_count, "int"),
    "pdf_error": (pdf_error, "string"),
    "pdf_decode_stream": (pdf_decode_stream, "binary"),
}


def register(spark: SparkSession) -> None:
    spark.udtf.register("pdf_lines", F.udtf(PdfLines, returnType="page_no int, line_no int, text string, x double, y double"))
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
