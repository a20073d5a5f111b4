"""Extracted pages as text, Markdown, HTML and JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.kernel.rendering import HTML_FOOT, HTML_HEAD, OCR_NOTE, PAGE_RULE


def text():
    """A page's lines joined by newlines."""
    return F.array_join(F.transform("lines", lambda x: x["text"]), "\n")


def paged():
    """A page's text under a header with its number and size."""
    px = lambda c: F.bround(c, 0).cast("long").cast("string")
    return F.concat(F.lit("--- page "), F.col("page_no").cast("string"), F.lit(" ("), px(F.col("width")), F.lit("x"), px(F.col("height")), F.lit(") ---\n"), text(), F.lit("\n"))


def markdown_table(t):
    rows = F.transform(t["cells"], lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), t["cols"]), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(rows))), "\n")


def markdown():
    """Text, tables and viewable images, or a note for a page that needs OCR."""
    shown = F.filter("images", lambda i: i["data_url"] != "")
    parts = F.concat(F.array(text()), F.transform("tables", markdown_table), F.transform(shown, lambda i: F.concat(F.lit("!["), i["name"], F.lit("]("), i["data_url"], F.lit(")"))))
    return F.when(F.col("needs_ocr"), OCR_NOTE).otherwise(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"))


def escaped(c):
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def html():
    """A page as a section with paragraphs, tables and images."""
    px = lambda c: F.bround(c, 0).cast("long").cast("string")
    head = F.concat(
        F.lit('<section class="page" style="width:'), px(F.col("width")), F.lit("px;height:"), px(F.col("height")), F.lit('px"'),
        F.when(F.col("needs_ocr"), ' data-needs-ocr="true"').otherwise(""), F.lit(">\n"),
    )
    lines = F.transform("lines", lambda x: F.concat(F.lit("<p>"), escaped(x["text"]), F.lit("</p>\n")))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>\n"))
    tables = F.transform("tables", lambda t: F.concat(F.lit("<table>\n"), F.array_join(F.transform(t["cells"], row), ""), F.lit("</table>\n")))
    shown = F.filter("images", lambda i: i["data_url"] != "")
    images = F.transform(shown, lambda i: F.concat(F.lit('<img src="'), i["data_url"], F.lit('" alt="'), escaped(i["name"]), F.lit('" />\n')))
    return F.concat(head, F.array_join(F.concat(lines, tables, images), ""), F.lit("</section>\n"))


def documents(pages: DataFrame, docs: DataFrame | None, kind: str) -> DataFrame:
    """One row per readable document: its pages rendered, then joined in order.

    Only rendered pages are shuffled, keyed by document."""
    good = pages.where("error_code is null")
    if kind == "json":
        return to_json(good, docs)
    made = {"text": text, "paged": paged, "markdown": markdown, "html": html}[kind]()
    grouped = good.select("doc_id", "page_no", made.alias("part")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "part"))).alias("parts"))
    parts = F.transform("parts", lambda p: p["part"])
    if kind == "html":
        body = F.concat(F.lit(HTML_HEAD), F.array_join(parts, ""), F.lit(HTML_FOOT))
    else:
        body = F.array_join(parts, {"text": "\n\n", "paged": "", "markdown": PAGE_RULE}[kind])
    return grouped.select("doc_id", body.alias(kind))


def to_json(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, json``: two-space indent, keys in schema order, characters as they are.

    Spark's own to_json cannot give this spacing, so the last step is an Arrow map."""
    page = F.struct("page_no", "width", "height", "lines", "needs_ocr", "tables", "images")
    grouped = pages.select("doc_id", page.alias("p")).groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    whole = docs.where("error_code is null").select("doc_id", "version").join(grouped, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            out = []
            for version, found in zip(batch.column("version").to_pylist(), batch.column("pages").to_pylist(), strict=True):
                body = [{k: v for k, v in p.items() if k != "page_no"} for p in found or []]
                out.append(json.dumps({"version": version, "pages": body}, indent=2, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "json"])

    return whole.mapInArrow(run, f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, json string")
