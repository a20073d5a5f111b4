"""A file as text, Markdown, HTML or JSON in plain Python, for SQL functions over content.

The rules are those of quire.operators.render, which states them as column
expressions over extracted pages; tests hold the two against each other.
"""

from __future__ import annotations

import json

from quire.kernel import extract, layout
from quire.kernel.document import Document

TITLE = "quire"
#: The note for a page that needs OCR, what separates pages, and the parts of an HTML file.
OCR_NOTE = "_[scanned page — text extraction requires OCR]_"
PAGE_RULE = "\n\n---\n\n"
HTML_HEAD = f'<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"><title>{TITLE}</title></head>\n<body>\n'
HTML_FOOT = "</body>\n</html>\n"
IMAGE = ("name", "format", "width", "height", "bits_per_component", "color_space", "data_url")


def pages(data: bytes, password: str = "", images: bool = True) -> list[dict]:
    """What a page's JSON holds, for every page."""
    out = []
    for _, (x0, y0, x1, y1), _, runs, segments, found in extract.pages(data, password, images=images):
        cells, outside = layout.table(segments, runs)
        lines = [{"text": t, "x": x, "y": y} for t, x, y in layout.lines(outside)]
        tables = [{"rows": len(cells), "cols": len(cells[0]), "cells": cells}] if cells else []
        shown = [dict(zip(IMAGE, i, strict=True)) for i in found]
        out.append({"width": abs(x1 - x0), "height": abs(y1 - y0), "lines": lines, "needs_ocr": not lines and bool(shown), "tables": tables, "images": shown})
    return out


def text(page: dict) -> str:
    return "\n".join(x["text"] for x in page["lines"])


def markdown(page: dict) -> str:
    if page["needs_ocr"]:
        return OCR_NOTE
    parts = [text(page)]
    for t in page["tables"]:
        rows = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in t["cells"]]
        parts.append("\n".join([rows[0], "| " + " | ".join(["---"] * t["cols"]) + " |", *rows[1:]]))
    parts += [f"![{i['name']}]({i['data_url']})" for i in page["images"] if i["data_url"]]
    return "\n\n".join(p for p in parts if p)


def escaped(s: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = s.replace(sign, name)
    return s


def html(page: dict) -> str:
    mark = ' data-needs-ocr="true"' if page["needs_ocr"] else ""
    out = [f'<section class="page" style="width:{round(page["width"])}px;height:{round(page["height"])}px"{mark}>\n']
    out += [f"<p>{escaped(x['text'])}</p>\n" for x in page["lines"]]
    for t in page["tables"]:
        rows = ["<tr>" + "".join(f"<td>{escaped(c)}</td>" for c in r) + "</tr>\n" for r in t["cells"]]
        out.append("<table>\n" + "".join(rows) + "</table>\n")
    out += [f'<img src="{i["data_url"]}" alt="{escaped(i["name"])}" />\n' for i in page["images"] if i["data_url"]]
    return "".join([*out, "</section>\n"])


def document(data: bytes, kind: str, password: str = "") -> str:
    """The file as text, markdown, html or json."""
    found = pages(data, password, kind != "text")
    if kind == "json":
        return json.dumps({"version": Document(data, password).version, "pages": found}, indent=2, ensure_ascii=False)
    if kind == "html":
        return HTML_HEAD + "".join(map(html, found)) + HTML_FOOT
    return "\n\n".join(map(text, found)) if kind == "text" else PAGE_RULE.join(map(markdown, found))
