"""Fonts: what text and advance each character code stands for."""

from __future__ import annotations

import re

from quire.kernel import filters
from quire.kernel.cos import NOT_HEX, Name, Stream, as_dict, as_int, as_number
from quire.kernel.errors import PdfError
from quire.kernel.glyphs import base_encoding, glyph_text, symbol

CMAP_TOKEN = re.compile(rb"%[^\r\n]*|<([0-9A-Fa-f\x00\t\n\x0c\r ]*)>|(\[)|(\])|([A-Za-z]+)|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")


def utf16(data: bytes) -> str:
    """UTF-16BE; an odd last byte counts as a unit of its own."""
    if len(data) & 1:
        data = data[:-1] + b"\0" + data[-1:]
    return data.decode("utf-16-be", "replace")


class CMap:
    """bfchar and bfrange of a ToUnicode stream."""

    def __init__(self, data: bytes):
        self.singles: dict[int, str] = {}
        self.ranges: list[tuple[int, int, int]] = []
        self.code_bytes = 0
        section, row, depth = None, [], 0
        for m in CMAP_TOKEN.finditer(data):
            word = m[4]
            if word:
                section, row, depth = (word[5:] if word.startswith(b"begin") else None), [], 0
            elif section is None:
                continue
            elif m[2]:
                depth, items = 1, []
                row.append(items)
            elif m[3]:
                depth = 0
                self._row(section, row)
            elif m[1] is not None:
                digits = NOT_HEX.sub(b"", m[1])
                value = bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())
                if depth:
                    row[-1].append(value)
                else:
                    row.append(value)
                    self._row(section, row)

    def _row(self, section: bytes, row: list) -> None:
        want = 3 if section == b"bfrange" else 2
        if len(row) < want:
            return
        low = int.from_bytes(row[0][:4])
        if section == b"bfchar":
            self.singles[low] = utf16(row[1])
        elif section == b"codespacerange":
            self.code_bytes = self.code_bytes or len(row[0])
        elif section == b"bfrange":
            if isinstance(row[2], list):
                for k, x in enumerate(row[2]):
                    self.singles[low + k] = utf16(x)
            else:
                units = utf16(row[2])
                self.ranges.append((low, int.from_bytes(row[1][:4]), ord(units[0]) if units else 0))
        row.clear()

    def lookup(self, code: int) -> str | None:
        if code in self.singles:
            return self.singles[code]
        for low, high, to in self.ranges:
            if low <= code <= high:
                n = to + code - low
                return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None
        return None


def meaningful(s: str) -> bool:
    """Not empty, not all private use, not all control characters."""
    if not s or all("" <= c <= "" for c in s):
        return False
    return not all(c <= "\x1f" or "\x7f" <= c <= "\x9f" for c in s)


class Font:
    """Text and width of codes; both are looked up once per code."""

    def __init__(self, two_byte: bool, cmap: CMap | None, encoding: list[str], widths: dict, default: float, family: str):
        self.two_byte, self.cmap, self.encoding = two_byte, cmap, encoding
        self.widths, self.default, self.family = widths, default, family
        self.known: dict[int, tuple[str, float]] = {}
        if not two_byte:
            every = [self.glyph(i) for i in range(256)]
            self.texts = [t for t, _ in every]
            self.advances = [w for _, w in every]
            # what the printable codes of ASCII stand for, and one width for all, if they are that simple
            self.plain = self.texts[32:127] == [chr(c) for c in range(32, 127)]
            self.width = self.advances[0] if len(set(self.advances)) == 1 else None
            self.width_of = self.advances.__getitem__

    def glyph(self, code: int) -> tuple[str, float]:
        if code not in self.known:
            self.known[code] = (self._text(code), self.widths.get(code, self.default))
        return self.known[code]

    def _simple(self, code: int) -> str:
        return self.encoding[code] if not self.two_byte and code < 256 else ""

    def _text(self, code: int) -> str:
        mapped = self.cmap.lookup(code) if self.cmap else None
        if mapped is None:
            return self._simple(code) or (chr(code) if 32 <= code <= 126 else "")
        if meaningful(mapped):
            return mapped
        return self._reversed(mapped) or self._simple(code)

    def _reversed(self, mapped: str) -> str:
        """The real character behind U+F0xx of a symbol font."""
        at = ord(mapped[0]) - 0xF000 if mapped else -1
        if self.family in ("Symbol", "SymbolMT"):
            return symbol().get(at, "")
        return "∩" if self.family == "MT-Extra" and at == 0x51 else ""

    def show(self, data: bytes, size: float, char: float, word: float, scale: float) -> tuple[str, float]:
        """The text of a shown string and its advance in text space."""
        if not self.two_byte:
            text = data.decode("latin-1")
            if not (self.plain and text.isascii() and text.isprintable()):
                texts = self.texts
                text = "".join([texts[c] for c in data])
            n = len(data)
            advance = (n * self.width if self.width is not None else sum(map(self.width_of, data))) * size
            if char or word or scale != 1.0:
                advance = (advance + n * char + (data.count(b" ") * word if word else 0.0)) * scale
            return text, advance
        parts, advance = [], 0.0
        for i in range(0, len(data), 2):
            t, w = self.glyph(int.from_bytes(data[i : i + 2]))
            parts.append(t)
            advance += (w * size + char) * scale
        return "".join(parts), advance


def load_font(doc, d: dict) -> Font:
    cmap = None
    stream = doc.soft(d.get("ToUnicode"))
    if isinstance(stream, Stream):
        try:
            cmap = CMap(filters.decode(stream.dict, stream.data))
        except PdfError:
            cmap = None
    base = d.get("BaseFont")
    family = base.rsplit("+", 1)[-1] if isinstance(base, Name) else ""
    if d.get("Subtype") == "Type0":
        below = doc.soft(d.get("DescendantFonts"))
        first = as_dict(doc.soft(below[0])) if isinstance(below, list) and below else None
        first = first or {}
        default = as_number(first.get("DW"))
        return Font(True, cmap, [], cid_widths(doc.soft(first.get("W"))), 1.0 if default is None else default / 1000, family)
    widths, at = {}, as_int(d.get("FirstChar")) or 0
    each = doc.soft(d.get("Widths"))
    for i, w in enumerate(each if isinstance(each, list) else []):
        v = as_number(w)
        if v is not None and at + i >= 0:
            widths[at + i] = v / 1000
    return Font(False, cmap, simple_encoding(doc, d), widths, 0.5, family)


def simple_encoding(doc, d: dict) -> list[str]:
    enc = doc.soft(d.get("Encoding"))
    if isinstance(enc, Name):
        return base_encoding(str(enc))
    if not isinstance(enc, dict):
        return base_encoding(None)
    base = enc.get("BaseEncoding")
    table = list(base_encoding(str(base) if isinstance(base, Name) else None))
    code, changes = 0, enc.get("Differences")
    for x in changes if isinstance(changes, list) else []:
        if type(x) is int:
            code = max(0, x)
        elif isinstance(x, Name):
            t = glyph_text(x)
            if t and code < 256:
                table[code] = t
            code += 1
    return table


def cid_widths(w) -> dict[int, float]:
    """``c [w ...]`` and ``first last w`` runs, up to the first that is neither."""
    out, i = {}, 0
    while isinstance(w, list) and i + 1 < len(w) and type(w[i]) is int:
        c, x = w[i], w[i + 1]
        if isinstance(x, list):
            for k, v in enumerate(x):
                n = as_number(v)
                if n is not None and c + k >= 0:
                    out[c + k] = n / 1000
            i += 2
        else:
            n = as_number(w[i + 2]) if i + 2 < len(w) else None
            if type(x) is int and n is not None:
                for k in range(max(0, c), min(x, 0xFFFF) + 1):
                    out[k] = n / 1000
            i += 3
    return out
