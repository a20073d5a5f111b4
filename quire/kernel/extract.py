"""Entry points of the kernel: one parsed file, looked at in three ways."""

from __future__ import annotations

from quire.kernel.cos import Name, Ref, Stream, as_dict
from quire.kernel.document import Document
from quire.kernel.errors import PdfError
from quire.kernel.fonts import load_font
from quire.kernel.images import page_images
from quire.kernel.interpret import interpret, operations


def inspect(data: bytes, password: str = "") -> dict:
    """Version, counts, metadata and page geometry; no content is decoded."""
    doc = Document(data, password)
    pages = doc.pages()
    return {
        "version": doc.version,
        "page_count": len(pages),
        "encrypted": doc.encrypted,
        "object_count": len(doc.xref),
        "lints": list(doc.lints),
        **{k.lower(): v for k, v in doc.info().items()},
        "pages": [(i + 1, *p["media_box"], p["rotate"]) for i, p in enumerate(pages)],
    }


def page_fonts(doc: Document, resources: dict, kept: dict) -> dict:
    """Fonts by name; a font object is loaded once per document."""
    out = {}
    for name, x in doc.subdict(resources, "Font").items():
        key = x.num if isinstance(x, Ref) else None
        if key is None or key not in kept:
            try:
                font = load_font(doc, doc.dict_of(x))
            except PdfError:
                continue
            if key is None:
                out[str(name)] = font
                continue
            kept[key] = font
        out[str(name)] = kept[key]
    return out


def pages(data: bytes, password: str = "", wanted=None, images: bool = True, painted_only: bool = False):
    """(page_no, media_box, rotate, runs, segments, images) of each wanted page."""
    doc, kept = Document(data, password), {}
    for i, p in enumerate(doc.pages()):
        if wanted is not None and i + 1 not in wanted:
            continue
        runs, segments = interpret(doc.content(p), page_fonts(doc, p["resources"], kept), painted_only)
        yield i + 1, p["media_box"], p["rotate"], runs, segments, page_images(doc, p["resources"]) if images else []


def shown(x) -> str:
    """An object as one line of text."""
    if isinstance(x, Stream):
        return f"{shown(x.dict)} stream[{len(x.data)}]"
    if isinstance(x, Ref):
        return f"{x.num} {x.gen} R"
    if isinstance(x, Name):
        return f"/{x}"
    if type(x) is bytes:
        return f"({x.decode('latin-1')})"
    if type(x) is list:
        return f"[{' '.join(map(shown, x))}]"
    if type(x) is dict:
        return f"<<{' '.join(f'/{k} {shown(v)}' for k, v in x.items())}>>"
    return {None: "null", True: "true", False: "false"}.get(x, str(x)) if x is None or type(x) is bool else repr(x)


def objects(data: bytes, password: str = ""):
    """(num, storage, kind, type, value) of every object that is in use; num 0 is the trailer."""
    doc = Document(data, password)
    yield 0, "trailer", "dict", None, shown(doc.trailer)
    for num in sorted(doc.xref):
        entry = doc.xref[num]
        if entry[0] == "f":
            continue
        try:
            x = doc.get(num)
        except PdfError as e:
            yield num, "error", e.code, None, e.message
            continue
        kind = "stream" if isinstance(x, Stream) else "name" if isinstance(x, Name) else {dict: "dict", list: "array", bytes: "string"}.get(type(x), "scalar")
        d = as_dict(x)
        name = d.get("Type") if d else None
        yield num, "plain" if entry[0] == "n" else "packed", kind, str(name) if isinstance(name, Name) else None, shown(x)


def lints(data: bytes, password: str = "") -> list[tuple[str, str]]:
    """(code, message) of every fault in spite of which the file was read; all objects are loaded, none is decoded."""
    doc = Document(data, password)
    dropped = []
    for num in sorted(doc.xref):
        try:
            if doc.xref[num][0] != "f":
                doc.get(num)
        except PdfError as e:
            dropped.append(("DroppedObject", f"object {num}: {e.message}"))
    return [*doc.lints, *dropped]


def page_operations(data: bytes, password: str = ""):
    """(page_no, op_no, operator, operands) of every page's content."""
    doc = Document(data, password)
    for i, p in enumerate(doc.pages()):
        for k, (op, operands) in enumerate(operations(doc.content(p))):
            yield i + 1, k, op.decode("latin-1"), [shown(x) for x in operands]


def page_glyphs(data: bytes, password: str = ""):
    """(page_no, font, code, text, width, n) of the distinct codes that each page shows."""
    doc, kept = Document(data, password), {}
    for i, p in enumerate(doc.pages()):
        fonts, font, seen = page_fonts(doc, p["resources"], kept), None, {}
        for op, o in operations(doc.content(p)):
            if op == b"Tf" and o and isinstance(o[0], Name):
                font = str(o[0])
            elif op in (b"Tj", b"'", b'"', b"TJ") and font in fonts:
                parts = o[0] if op == b"TJ" and o and type(o[0]) is list else o[-1:]
                step = 2 if fonts[font].two_byte else 1
                for s in parts:
                    for at in range(0, len(s), step) if type(s) is bytes else ():
                        key = (font, int.from_bytes(s[at : at + step]))
                        seen[key] = seen.get(key, 0) + 1
        for (name, code), n in seen.items():
            text, width = fonts[name].glyph(code)
            yield i + 1, name, code, text, width, n
