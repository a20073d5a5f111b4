"""A deterministic PDF writer: test inputs made from rows.

Equal input gives equal bytes.  Variants cover the file structures, filters,
fonts, text operators and encryption that the reader knows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.kernel import crypt
from quire.kernel.cos import Name, Ref, Stream

PER_PAGE, LEFT, TOP, LEADING, SIZE = 50, 50, 760, 14, 11
BOX = [0, 0, 612, 792]
STRUCTURES = ("classic", "stream", "objstm", "hybrid", "incremental")
FILTERS = ("flate", "lzw", "a85", "ahx", "rl", "chain", "png", "tiff", "none")
FONTS = ("winansi", "macroman", "differences", "tounicode", "type0")
STYLES = ("tj", "td", "words", "quote", "cm")
CIPHERS = ("rc4", "aes128", "aes256")


def number(v) -> bytes:
    return b"%d" % v if v == int(v) else repr(float(v)).encode()


def literal(s: bytes) -> bytes:
    s = s.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"(" + s.replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def cos(x) -> bytes:
    if x is None:
        return b"null"
    if isinstance(x, bool):
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d %d R" % x
    if isinstance(x, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in x.encode())
    if isinstance(x, int | float):
        return number(x)
    if isinstance(x, bytes):
        return literal(x) if all(c >= 32 or c in (10, 13) for c in x) else b"<" + x.hex().encode() + b">"
    if isinstance(x, list | tuple):
        return b"[" + b" ".join(map(cos, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b" ".join(cos(Name(k)) + b" " + cos(v) for k, v in x.items()) + b">>"
    raise TypeError(type(x))


# -- filters


def lzw(data: bytes, early: int = 1) -> bytes:
    table, width, out, bits, held = {bytes([i]): i for i in range(256)}, 9, bytearray(), 0, 0
    size = 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    word = b""
    for c in data:
        longer = word + bytes([c])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        # a reader's table is one entry behind the writer's
        if size - 1 >= (1 << width) - early and width < 12:
            width += 1
        if size >= 4094:
            put(256)
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([c])
    if word:
        put(table[word])
        if size >= (1 << width) - early and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 4):
        part = data[i : i + 4]
        v = int.from_bytes(part + b"\0" * (4 - len(part)))
        if not v and len(part) == 4:
            out += b"z"
            continue
        digits = []
        for _ in range(5):
            v, d = divmod(v, 85)
            digits.append(d + 33)
        out += bytes(digits[::-1])[: len(part) + 1]
    return bytes(out) + b"~>"


def run_length(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = i + 1
        while k < n and k - i < 128 and data[k] == data[i]:
            k += 1
        if k - i >= 3:
            out += bytes([257 - (k - i), data[i]])
            i = k
            continue
        k = i
        while k < n and k - i < 128 and not (k + 2 < n and data[k] == data[k + 1] == data[k + 2]):
            k += 1
        out += bytes([k - i - 1]) + data[i:k]
        i = k
    return bytes(out) + b"\x80"


def png_rows(data: bytes, columns: int) -> bytes:
    """Rows under PNG filters 0 to 4 in turn; samples are single bytes."""
    out, above = bytearray(), bytes(columns)
    for k, at in enumerate(range(0, len(data), columns)):
        row, tag = data[at : at + columns], k % 5
        out.append(tag)
        for i, v in enumerate(row):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            out.append((v - (0, left, up, (left + up) >> 1, near)[tag]) & 255)
        above = row + bytes(columns - len(row))
    return bytes(out)


def tiff_rows(data: bytes, columns: int) -> bytes:
    out = bytearray()
    for at in range(0, len(data), columns):
        row = data[at : at + columns]
        out += bytes((v - (row[i - 1] if i else 0)) & 255 for i, v in enumerate(row))
    return bytes(out)


def filtered(data: bytes, how: str) -> Stream:
    flate = Name("FlateDecode")
    if how == "none":
        return Stream({}, data)
    if how == "lzw":
        return Stream({"Filter": Name("LZWDecode")}, lzw(data))
    if how == "a85":
        return Stream({"Filter": Name("ASCII85Decode")}, ascii85(data))
    if how == "ahx":
        return Stream({"Filter": Name("ASCIIHexDecode")}, data.hex().encode() + b">")
    if how == "rl":
        return Stream({"Filter": [Name("RunLengthDecode")]}, run_length(data))
    if how == "chain":
        return Stream({"Filter": [Name("A85"), Name("Fl")], "DecodeParms": [None]}, ascii85(zlib.compress(data)))
    if how == "png":
        return Stream({"Filter": flate, "DecodeParms": {"Predictor": 15, "Columns": 16}}, zlib.compress(png_rows(data, 16)))
    if how == "tiff":
        return Stream({"Filter": flate, "DecodeParms": {"Predictor": 2, "Columns": 16}}, zlib.compress(tiff_rows(data, 16)))
    return Stream({"Filter": flate}, zlib.compress(data))


# -- encryption

FILE_ID, SALT = b"quire-fixed-id-0", b"fixedsalt-fixed!"


class Encryptor:
    """Fixed salts and vectors: the writer is for tests, equal input gives equal bytes."""

    def __init__(self, cipher: str, user: str, owner: str, revision: int | None = None):
        u, o, p = user.encode(), (owner or user).encode(), -4
        self.cipher = cipher
        if cipher == "aes256":
            r = revision or 6
            h = crypt.hash_r6 if r >= 6 else lambda w, s, e: hashlib.sha256(w + s + e).digest()
            self.key = hashlib.sha256(b"file key" + u).digest()
            s1, s2, s3, s4 = SALT[:8], SALT[8:], SALT[4:12], SALT[2:10]
            ue, oe = h(u, s1, b"") + s1 + s2, None
            wrapped = crypt.cbc_encrypt(h(u, s2, b""), bytes(16), self.key)
            oe = h(o, s3, ue) + s3 + s4
            owned = crypt.cbc_encrypt(h(o, s4, ue), bytes(16), self.key)
            self.dict = {
                "Filter": Name("Standard"), "V": 5, "R": r, "Length": 256, "P": p, "U": ue, "O": oe, "UE": wrapped, "OE": owned,
                "CF": {"StdCF": {"CFM": Name("AESV3"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF"),
            }
            return
        r, length = (revision or 3, 16) if cipher == "rc4" else (4, 16)
        length = 5 if r == 2 else length
        entry = crypt.pad(u)
        for k in crypt.owner_rounds(o, r, length):
            entry = crypt.rc4(k, entry)
        self.key = crypt.user_key(u, entry, p, FILE_ID, r, length, False)
        check = crypt.user_entry(self.key, FILE_ID, r)
        self.dict = {"Filter": Name("Standard"), "V": {2: 1, 3: 2, 4: 4}[r], "R": r, "Length": length * 8, "P": p, "O": entry, "U": (check + bytes(32))[:32]}
        if cipher == "aes128":
            self.dict |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def bytes_of(self, data: bytes, num: int) -> bytes:
        if self.cipher == "aes256":
            key = self.key
        else:
            salt = b"sAlT" if self.cipher == "aes128" else b""
            key = hashlib.md5(self.key + num.to_bytes(3, "little") + b"\0\0" + salt).digest()[: min(16, len(self.key) + 5)]
        if self.cipher == "rc4":
            return crypt.rc4(key, data)
        fill = 16 - len(data) % 16
        iv = hashlib.md5(b"iv%d" % num).digest()
        return iv + crypt.cbc_encrypt(key, iv, data + bytes([fill]) * fill)

    def walk(self, x, num: int):
        if isinstance(x, bytes):
            return self.bytes_of(x, num)
        if isinstance(x, Stream):
            return Stream(self.walk(x.dict, num), self.bytes_of(x.data, num))
        if isinstance(x, dict):
            return {k: self.walk(v, num) for k, v in x.items()}
        return [self.walk(v, num) for v in x] if isinstance(x, list) else x


# -- files


@dataclass
class Writer:
    structure: str = "classic"
    encryptor: Encryptor | None = None
    objects: list = field(default_factory=list)

    def add(self, x=None) -> Ref:
        self.objects.append(x)
        return Ref(len(self.objects), 0)

    def put(self, ref: Ref, x) -> None:
        self.objects[ref.num - 1] = x

    def _body(self, num: int, x) -> bytes:
        if self.encryptor and x is not self.encryptor.dict:
            x = self.encryptor.walk(x, num)
        if isinstance(x, Stream):
            return b"%d 0 obj\n" % num + cos(x.dict | {"Length": len(x.data)}) + b"\nstream\n" + x.data + b"\nendstream\nendobj\n"
        return b"%d 0 obj\n" % num + cos(x) + b"\nendobj\n"

    def save(self, root: Ref, info: Ref | None = None) -> bytes:
        extra = {}
        if self.encryptor:
            extra = {"Encrypt": self.add(self.encryptor.dict), "ID": [FILE_ID, FILE_ID]}
        trailer = {"Size": len(self.objects) + 1, "Root": root} | ({"Info": info} if info else {}) | extra
        how = self.structure
        packed = []
        if how in ("objstm", "hybrid"):
            # everything but streams (and, in a hybrid file, what old readers need) is packed
            keep = {root.num} if how == "hybrid" else set()
            packed = [i + 1 for i, x in enumerate(self.objects) if not isinstance(x, Stream) and i + 1 not in keep and not (self.encryptor and x is self.encryptor.dict)]
        out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        later = self.objects[-1:] and len(self.objects) if how == "incremental" else 0
        for i, x in enumerate(self.objects):
            if i + 1 not in packed and i + 1 != later:
                at[i + 1] = len(out)
                out += self._body(i + 1, x)
        if packed:
            heads, bodies = [], bytearray()
            for n in packed:
                heads.append(b"%d %d" % (n, len(bodies)))
                bodies += cos(self.objects[n - 1]) + b"\n"
            head = b" ".join(heads) + b"\n"
            z = zlib.compress(head + bytes(bodies))
            holder = len(self.objects) + 1
            at[holder] = len(out)
            out += self._body(holder, Stream({"Type": Name("ObjStm"), "N": len(packed), "First": len(head), "Filter": Name("FlateDecode")}, z))
        if how in ("classic", "incremental", "hybrid"):
            # an old section that the newer one overrides
            if how == "incremental":
                at[later] = len(out)
                out += b"%d 0 obj\n(old)\nendobj\n" % later
            first = {} if how != "hybrid" else {"XRefStm": None}
            if first:
                place = len(out)
                rows = {n: (2, len(self.objects) + 1, k) for k, n in enumerate(packed)}
                out += self._xref_stream(len(self.objects) + 2, rows, {"Size": len(self.objects) + 3})
                first = {"XRefStm": place}
            start = len(out)
            out += self._table({n: at[n] for n in sorted(at)}, trailer | {"Size": len(self.objects) + 3} | first)
            out += b"startxref\n%d\n%%%%EOF\n" % start
            if how == "incremental":
                place, prev = len(out), start
                out += self._body(later, self.objects[later - 1])
                start = len(out)
                out += self._table({later: place}, trailer | {"Prev": prev}, free=False)
                out += b"startxref\n%d\n%%%%EOF\n" % start
            return bytes(out)
        own = len(self.objects) + 1 + bool(packed)
        start = len(out)
        rows = {0: (0, 0, 65535)} | {n: (1, o, 0) for n, o in at.items()} | {n: (2, own - 1, k) for k, n in enumerate(packed)} | {own: (1, start, 0)}
        out += self._xref_stream(own, rows, trailer | {"Size": own + 1})
        out += b"startxref\n%d\n%%%%EOF\n" % start
        return bytes(out)

    @staticmethod
    def _runs(numbers: list[int]) -> list[tuple[int, int]]:
        out = []
        for n in numbers:
            if out and out[-1][0] + out[-1][1] == n:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((n, 1))
        return out

    def _table(self, at: dict, trailer: dict, free: bool = True) -> bytes:
        out = bytearray(b"xref\n")
        for first, n in self._runs([0, *sorted(at)] if free else sorted(at)):
            out += b"%d %d\n" % (first, n)
            for k in range(first, first + n):
                out += b"0000000000 65535 f \n" if k == 0 else b"%010d 00000 n \n" % at[k]
        return bytes(out) + b"trailer\n" + cos(trailer) + b"\n"

    def _xref_stream(self, num: int, rows: dict, trailer: dict) -> bytes:
        data = b"".join(struct.pack(">BIH", *rows[n]) for n in sorted(rows))
        index = [v for r in self._runs(sorted(rows)) for v in r]
        z = zlib.compress(data)
        d = trailer | {"Type": Name("XRef"), "W": [1, 4, 2], "Index": index, "Filter": Name("FlateDecode"), "Length": len(z)}
        return b"%d 0 obj\n" % num + cos(d) + b"\nstream\n" + z + b"\nendstream\nendobj\n"


def utf16_hex(c: str) -> bytes:
    return c.encode("utf-16-be").hex().upper().encode()


def cmap(pairs: list[tuple[int, str]], width: int) -> bytes:
    out = [b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap\n1 begincodespacerange\n<%0*X> <%0*X>\nendcodespacerange\n" % (2 * width, 0, 2 * width, (1 << 8 * width) - 1)]
    for at in range(0, len(pairs), 100):
        part = pairs[at : at + 100]
        out.append(b"%d beginbfchar\n" % len(part) + b"".join(b"<%0*X> <%s>\n" % (2 * width, code, utf16_hex(c)) for code, c in part) + b"endbfchar\n")
    return b"".join(out) + b"endcmap end end\n"


class Typeface:
    """How a document's characters become codes; None where they cannot."""

    def __init__(self, writer: Writer, kind: str, text: str):
        used = sorted(set(text) - {"\n"})
        self.kind, self.codes, self.width = kind, {}, 1
        codec = {"winansi": "cp1252", "macroman": "mac_roman"}.get(kind)
        if codec:
            try:
                self.codes = {c: c.encode(codec) for c in used}
            except UnicodeEncodeError:
                kind = "type0"
        if kind in ("differences", "tounicode") and len(used) > 200:
            kind = "type0"
        d = {"Type": Name("Font"), "BaseFont": Name("Helvetica")}
        if kind == "winansi" or kind == "macroman":
            d |= {"Subtype": Name("Type1"), "Encoding": Name("WinAnsiEncoding" if kind == "winansi" else "MacRomanEncoding")}
        elif kind == "differences":
            self.codes = {c: bytes([40 + i]) for i, c in enumerate(used)}
            names = [Name(f"uni{ord(c):04X}" if ord(c) < 65536 else f"u{ord(c):X}") for c in used]
            d |= {"Subtype": Name("Type1"), "Encoding": {"BaseEncoding": Name("StandardEncoding"), "Differences": [40, *names]}}
        elif kind == "tounicode":
            self.codes = {c: bytes([40 + i]) for i, c in enumerate(used)}
            d |= {"Subtype": Name("TrueType"), "FirstChar": 40, "Widths": [500] * len(used), "ToUnicode": writer.add(Stream({}, cmap([(40 + i, c) for i, c in enumerate(used)], 1)))}
        else:
            self.codes = {c: struct.pack(">H", 256 + i) for i, c in enumerate(used)}
            child = writer.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Own"), "DW": 500})
            d |= {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [child], "ToUnicode": writer.add(Stream({}, cmap([(256 + i, c) for i, c in enumerate(used)], 2)))}
        self.ref = writer.add(d)

    def encode(self, s: str) -> bytes:
        return b"".join([self.codes[c] for c in s])


def page_content(lines: list[str], face: Typeface, style: str) -> bytes:
    """One line per row from the top; style chooses the operators."""
    show = lambda s: cos(face.encode(s))
    out = [b"BT /F1 %d Tf" % SIZE]
    y = lambda i: TOP - LEADING * i
    if style == "tj":
        out += [b"1 0 0 1 %d %d Tm %s Tj" % (LEFT, y(i), show(s)) for i, s in enumerate(lines)]
    elif style == "td":
        for i, s in enumerate(lines):
            move = b"%d %d Td" % (LEFT, TOP) if i == 0 else b"0 %d TD" % -LEADING if i == 1 else b"T*"
            out.append(move + b" " + show(s) + b" Tj")
    elif style == "quote":
        out.append(b"%d TL %d %d Td" % (LEADING, LEFT, TOP + LEADING))
        out += [(b"0 0 %s \"" if i % 2 else b"%s '") % show(s) for i, s in enumerate(lines)]
    elif style == "cm":
        out = []
        for i, s in enumerate(lines):
            out.append(b"q 1 0 0 1 %d %d cm BT /F1 %d Tf 0 0 Td %s Tj ET Q" % (LEFT, y(i), SIZE, show(s)))
        return b"\n".join(out)
    else:  # one string per word; a gap of 0.6 em is a space next to any character
        for i, s in enumerate(lines):
            parts = b" -600 ".join(show(w) for w in s.split(" "))
            out.append(b"1 0 0 1 %d %d Tm [%s] TJ" % (LEFT, y(i), parts))
    return b"\n".join([*out, b"ET"])


def finish(w: Writer, pages: list[tuple[Stream, dict]], title: str | None = None) -> bytes:
    """Page tree, catalog and info for (content, resources) pages."""
    tree, kids = w.add(), []
    for content, resources in pages:
        body = w.add(content)
        kids.append(w.add({"Type": Name("Page"), "Parent": tree, "Contents": body, "Resources": resources}))
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": BOX})
    info = w.add({"Title": b"\xfe\xff" + title.encode("utf-16-be"), "Creator": b"quire"}) if title is not None else None
    root = w.add({"Type": Name("Catalog"), "Pages": tree})
    return w.save(root, info)


def text_pdf(text: str, structure: str = "classic", filter: str = "flate", font: str = "winansi", style: str = "tj", cipher: str | None = None, user: str = "", owner: str = "", title: str | None = None, revision: int | None = None) -> bytes:
    """The lines of a text, 50 to a page; characters that the font lacks make it a Type0 font."""
    w = Writer(structure, Encryptor(cipher, user, owner, revision) if cipher else None)
    face, lines = Typeface(w, font, text), text.split("\n")
    pages = []
    for at in range(0, len(lines), PER_PAGE):
        pages.append((filtered(page_content(lines[at : at + PER_PAGE], face, style), filter), {"Font": {"F1": face.ref}}))
    return finish(w, pages, title)


def table_pdf(rows: list[list[str]], caption: str | None = None, width: int = 120, height: int = 20) -> bytes:
    """A ruled grid on one page with a caption above it."""
    w = Writer()
    text = "\n".join([caption or "", *[c for r in rows for c in r]])
    face = Typeface(w, "winansi", text)
    out, top = [], 700
    for i, row in enumerate(rows):
        for j, cell in enumerate(row):
            x, y = LEFT + j * width, top - (i + 1) * height
            out.append(b"%d %d %d %d re S" % (x, y, width, height))
            out.append(b"BT /F1 8 Tf 1 0 0 1 %d %d Tm %s Tj ET" % (x + 4, y + 6, cos(face.encode(cell))))
    if caption is not None:
        out.append(b"BT /F1 8 Tf 1 0 0 1 %d %d Tm %s Tj ET" % (LEFT, top + 30, cos(face.encode(caption))))
    return finish(w, [(filtered(b"\n".join(out), "flate"), {"Font": {"F1": face.ref}})])


def image_pdf(width: int, height: int, samples: bytes, text: str | None = None, space: str = "DeviceGray") -> bytes:
    """One raw image on each page, with the lines of a text, 50 to a page, or one page without text."""
    w = Writer()
    image = filtered(samples, "flate")
    ref = w.add(Stream(image.dict | {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "BitsPerComponent": 8, "ColorSpace": Name(space)}, image.data))
    resources = {"XObject": {"Im0": ref}}
    content = b"q 100 0 0 100 50 600 cm /Im0 Do Q"
    if text is None:
        return finish(w, [(filtered(content, "flate"), resources)])
    face, lines = Typeface(w, "winansi", text), text.split("\n")
    resources["Font"] = {"F1": face.ref}
    pages = [content + b"\n" + page_content(lines[at : at + PER_PAGE], face, "tj") for at in range(0, len(lines), PER_PAGE)]
    return finish(w, [(filtered(page, "flate"), resources) for page in pages])


def as_files(rows: DataFrame, build, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """``doc_id, content``: build(*columns) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                values = [part.column(c).to_pylist() for c in columns]
                made = [build(*v) for v in zip(*values, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(made, pa.binary())], names=["doc_id", "content"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, *[c for c in columns if c != id_col]).mapInArrow(run, f"doc_id {kind}, content binary")


def write_texts(docs: DataFrame, **variant) -> DataFrame:
    """``doc_id, content`` of ``docs(doc_id, text)``; null texts are empty."""
    return as_files(docs, lambda text: text_pdf(text or "", **variant), ["text"])
