"""Pages with lines, tables and images, and the tables a user queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import render
from quire.operators.layout import fold_lines
from quire.operators.tables import add_grid, add_table, fill_cells, place_runs
from quire.sources import pdf


def page_texts(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, width, height, lines, needs_ocr, tables, images, error_*``.

    Pages of more runs than a fold suits arrive from the kernel with their lines
    and tables; all others are laid out here.  Runs inside a valid table are not
    lines.  needs_ocr: a page with images and no line."""
    small = F.col("big_lines").isNull()
    # large pages skip the expressions: their runs are not looked at again
    base = pages.withColumn("runs", F.when(small, F.col("runs"))).withColumn("segments", F.when(small, F.col("segments")))
    laid = add_table(fill_cells(place_runs(add_grid(base))))
    tables = F.when(small, F.when(F.col("table").isNotNull(), F.array("table")).otherwise(F.array().cast(f"array<{pdf.TABLE}>"))).otherwise(F.col("big_tables"))
    lines = F.when(small, fold_lines(F.col("outside"))).otherwise(F.col("big_lines"))
    out = laid.select(
        "doc_id", "page_no", F.abs(F.col("x1") - F.col("x0")).alias("width"), F.abs(F.col("y1") - F.col("y0")).alias("height"),
        lines.alias("lines"), tables.alias("tables"), "images", "error_code", "error_message",
    )
    return out.withColumn("needs_ocr", (F.size("lines") == 0) & (F.size("images") > 0))


def _items(pages: DataFrame, column: str, number: str, item: str) -> DataFrame:
    """The elements of a computed array column.

    The outer form keeps the planner from inferring a filter on the array, which
    it would push through the projections and so evaluate the layout once more
    for every mention; empty pages go after the array has been unnested."""
    return pages.select("doc_id", "page_no", F.posexplode_outer(column).alias(number, item)).where(F.col(number).isNotNull())


@dataclass(frozen=True)
class PdfFrames:
    """Lazy tables over files(doc_id, content); each reads only what it needs."""

    files: DataFrame
    password: str = ""
    mode: str = "PERMISSIVE"
    pages_wanted: tuple | None = None
    painted_only: bool = False

    def _read(self, images: bool) -> DataFrame:
        return pdf.read_pages(self.files, self.password, self.mode, self.pages_wanted, images, self.painted_only)

    @cached_property
    def docs(self) -> DataFrame:
        return pdf.read_docs(self.files, self.password, self.mode)

    @cached_property
    def pages(self) -> DataFrame:
        return page_texts(self._read(True))

    @cached_property
    def texts(self) -> DataFrame:
        """As pages, without decoding images."""
        return page_texts(self._read(False))

    @property
    def runs(self) -> DataFrame:
        return self._read(False).select("doc_id", "page_no", F.explode("runs").alias("r")).select("doc_id", "page_no", "r.*")

    @property
    def segments(self) -> DataFrame:
        at = self._read(False).select("doc_id", "page_no", F.posexplode("segments").alias("seg_no", "s"))
        return at.select("doc_id", "page_no", "seg_no", "s.*")

    @property
    def images(self) -> DataFrame:
        at = self._read(True).select("doc_id", "page_no", F.posexplode("images").alias("image_no", "i"))
        return at.select("doc_id", "page_no", "image_no", "i.*")

    @property
    def lines(self) -> DataFrame:
        at = _items(self.texts, "lines", "k", "l")
        return at.select("doc_id", "page_no", (F.col("k") + 1).alias("line_no"), "l.text", "l.x", "l.y")

    @property
    def tables(self) -> DataFrame:
        at = _items(self.texts, "tables", "table_no", "t")
        return at.select("doc_id", "page_no", "table_no", "t.*")

    @property
    def cells(self) -> DataFrame:
        rows = self.tables.select("doc_id", "page_no", "table_no", F.posexplode_outer("cells").alias("row", "line"))
        return rows.select("doc_id", "page_no", "table_no", "row", F.posexplode_outer("line").alias("col", "text")).where("col is not null")

    @property
    def errors(self) -> DataFrame:
        return self._read(False).where("error_code is not null").select("doc_id", "error_code", "error_message")

    @property
    def objects(self) -> DataFrame:
        return pdf.read_inner(self.files, "objects", self.password, self.mode)

    @property
    def operations(self) -> DataFrame:
        return pdf.read_inner(self.files, "page_operations", self.password, self.mode)

    @property
    def glyphs(self) -> DataFrame:
        return pdf.read_inner(self.files, "page_glyphs", self.password, self.mode)

    @property
    def lints(self) -> DataFrame:
        """Faults in spite of which files were read."""
        return pdf.read_inner(self.files, "lints", self.password, self.mode)

    def rendered(self, kind: str) -> DataFrame:
        """``doc_id, <kind>`` for text, paged, markdown, html or json."""
        return render.documents(self.texts if kind in ("text", "paged") else self.pages, self.docs if kind == "json" else None, kind)

    def register(self, spark: SparkSession, prefix: str = "pdf_") -> None:
        """Temporary views of all tables, named prefix + table."""
        for name in ("docs", "pages", "runs", "segments", "images", "lines", "tables", "cells", "errors", "lints"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def read_pdfs(spark: SparkSession, path: str, password: str = "", mode: str = "PERMISSIVE", pages=None, **options) -> PdfFrames:
    """The files below ``path`` as tables."""
    return PdfFrames(pdf.read_files(spark, path, **options), password, mode, None if pages is None else tuple(pages))
