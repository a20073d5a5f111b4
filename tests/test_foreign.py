"""Files written out by hand from the public specification (ISO 32000), not by this package's writer."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from quire.kernel import extract, layout
from quire.kernel.errors import PdfError


def table_file(objects: dict[int, bytes], trailer: bytes = b"", head: bytes = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", eol: bytes = b" \n") -> bytes:
    """Objects in ascending order with a cross-reference table of 20-byte rows."""
    out, at = bytearray(head), {}
    for num, body in objects.items():
        at[num] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (num, body)
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f%s" % (size, eol)
    for num in range(1, size):
        out += b"%010d %05d %s%s" % ((at[num], 0, b"n", eol) if num in at else (0, 0, b"f", eol))
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, start))


def stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


def one_page(content: bytes, font: bytes, more: dict | None = None, **how) -> bytes:
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 300 200] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /A 5 0 R >> >> /Contents 4 0 R >>", 4: content, 5: font,
    }
    return table_file(objects | (more or {}), **how)


PLAIN = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def texts(data: bytes, password: str = "") -> list[str]:
    return [t for _, _, _, runs, segments, _ in extract.pages(data, password) for t, _, _ in layout.lines(layout.table(segments, runs)[1])]


@pytest.mark.parametrize("eol", [b" \n", b" \r", b"\r\n"])
def test_table_of_cross_references(eol):
    data = one_page(stream(b"BT /A 12 Tf 20 150 Td (Plain by hand) Tj 0 -20 Td (second) Tj ET"), PLAIN, eol=eol)
    assert texts(data) == ["Plain by hand", "second"]
    assert extract.inspect(data)["pages"] == [(1, 0.0, 0.0, 300.0, 200.0, 0)]


def test_stream_of_cross_references():
    """PDF 1.5: the page tree in an object stream, offsets in a cross-reference stream with /W [1 2 1]."""
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] /Contents 5 0 R >>"]
    heads, body = b"", b""
    for num, p in zip((1, 2, 3), parts, strict=True):
        heads += b"%d %d " % (num, len(body))
        body += p + b"\n"
    packed = zlib.compress(heads + body)
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for num, x in ((4, stream(packed, b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(heads))), (5, stream(b"BT 9 Tf (packed) Tj ET"))):
        at[num] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (num, x)
    rows = [(0, 0, 255), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at[4], 0), (1, at[5], 0), (1, len(out), 0)]
    data = b"".join(bytes([a]) + b.to_bytes(2) + bytes([c]) for a, b, c in rows)
    start = len(out)
    out += b"6 0 obj\n" + stream(data, b"/Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    assert texts(bytes(out)) == ["packed"]


def test_incremental_update():
    """A later section replaces the content; /Prev leads to the first."""
    first = one_page(stream(b"BT /A 9 Tf (old) Tj ET"), PLAIN)
    start = first.rindex(b"xref\n0")
    at = len(first)
    data = first + b"4 0 obj\n" + stream(b"BT /A 9 Tf (new) Tj ET") + b"\nendobj\n"
    new = len(data)
    data += b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, start, new)
    assert texts(first) == ["old"] and texts(data) == ["new"]


def test_differences_by_name():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 1 /Widths [500 500 500 500 500 500] /Encoding << /Type /Encoding /Differences [1 /Omega /alpha /theta1 4 /afii10017 /uni20AC /odieresis] >> >>"
    assert texts(one_page(stream(b"BT /A 10 Tf 20 20 Td <010203040506> Tj ET"), font)) == ["Ωαϑ" + "А" + "€ö"]


def test_composite_font_by_map():
    to = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Own def
1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0003> <0020> <0101> <05D0> endbfchar
1 beginbfrange <0201> <0203> <4E00> endbfrange endcmap"""
    more = {
        6: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW 800 /W [3 [250] 513 515 1000] >>",
        7: stream(zlib.compress(to), b"/Filter /FlateDecode"),
    }
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
    data = one_page(stream(b"BT /A 10 Tf 20 20 Td <0101000302010203> Tj ET"), font, more)
    assert texts(data) == ["\u05d0 \u4e00\u4e02"]
    run = next(extract.pages(data))[3][0]
    assert run[3] == pytest.approx(8.0 + 2.5 + 10.0 + 10.0)


PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j, out = list(range(256)), 0, bytearray()
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) % 256
        s[i], s[j] = s[j], s[i]
    i = j = 0
    for c in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) % 256])
    return bytes(out)


def test_standard_security_handler():
    """Revision 2, 40 bits: algorithms 1 to 4 of the specification, step by step."""
    user, owner, ident, rights = b"open", b"master", b"0123456789abcdef", -4
    pad = lambda w: (w + PAD)[:32]
    o = rc4(hashlib.md5(pad(owner)).digest()[:5], pad(user))
    key = hashlib.md5(pad(user) + o + (rights & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()[:5]
    u = rc4(key, PAD)
    own = lambda num: hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0").digest()[:10]
    body = rc4(own(4), b"BT /A 9 Tf (locked away) Tj ET")
    title = rc4(own(7), b"Hidden title")
    more = {6: b"<< /Filter /Standard /V 1 /R 2 /O <%s> /U <%s> /P %d >>" % (o.hex().encode(), u.hex().encode(), rights), 7: b"<< /Title <%s> >>" % title.hex().encode()}
    data = one_page(stream(body), PLAIN, more, trailer=b"/Encrypt 6 0 R /Info 7 0 R /ID [<%s> <%s>]" % (ident.hex().encode(), ident.hex().encode()))
    for word in ("open", "master"):
        assert texts(data, word) == ["locked away"] and extract.inspect(data, word)["title"] == "Hidden title"
    with pytest.raises(PdfError, match="BadPassword"):
        texts(data, "guess")


def test_lints():
    good = one_page(stream(b"BT /A 9 Tf (x) Tj ET"), PLAIN)
    assert extract.lints(good) == []
    long = good.replace(b"/Length 20", b"/Length 77")
    assert [c for c, _ in extract.lints(long)] == ["LengthMismatch"] and texts(long) == ["x"]
    stray = one_page(stream(b"BT /A 9 Tf (x) Tj ET"), PLAIN, {6: b"<< no object >>"})
    assert extract.lints(stray)[0][0] == "DroppedObject" and texts(stray) == ["x"]
