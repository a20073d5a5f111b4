"""The byte kernel: literal inputs and what they must give."""

from __future__ import annotations

import signal
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.kernel import cos, crypt, extract, filters, layout
from quire.kernel.cos import Name, Ref, Stream
from quire.kernel.document import Document
from quire.kernel.errors import PdfError
from quire.kernel.fonts import CMap, cid_widths
from quire.kernel.glyphs import base_encoding, glyph_text, symbol
from quire.kernel.images import png, url
from quire.kernel.interpret import interpret, operations
from quire.sources import writer


def parse(b):
    return cos.parse_object(b, 0)[0]


@pytest.mark.parametrize(
    ("raw", "value"),
    [(b"42", 42), (b"-17", -17), (b"3.5", 3.5), (b"-.5", -0.5), (b"5.", 5.0), (b"/A#20B", "A B"), (b"(a(b)c)", b"a(b)c"), (b"(\\101)", b"A"), (b"(\\7)", b"\x07"),
     (b"(\\z)", b"z"), (b"(a\\\nb)", b"ab"), (b"<4 8>", b"H"), (b"<41A>", b"A\xa0"), (b"[1 2 R]", None), (b"true", True), (b"null", None), (b"<</A 1/A 2>>", {"A": 2}),
     (b"5 0 R", Ref(5, 0)), (b"99999999999999999999", 1e20)],
)
def test_objects(raw, value):
    if raw == b"[1 2 R]":
        assert parse(raw) == [Ref(1, 2)]
    else:
        assert parse(raw) == value


@pytest.mark.parametrize("raw", [b".", b"1.2.3", b"<< 1 2 >>", b"/A#2", b"(open", b"<4G>", b"[1", b"bogus", b""])
def test_bad_objects(raw):
    with pytest.raises(PdfError):
        parse(raw)


def test_no_reference():
    assert cos.parse_object(b"5 0 X", 0) == (5, 1)
    assert parse(b"-1 0 R") == -1


def test_filters():
    assert filters.ascii85(b"9jqo^~>") == b"Man "
    assert filters.ascii_hex(b"4869>") == b"Hi"
    assert filters.run_length(bytes.fromhex("0261626380")) == b"abc"
    broken = zlib.compress(b"Hi")[:-1] + b"\0"
    assert filters.flate(broken) == b"Hi"
    for bad in (lambda: filters.flate(b"\xff\xff\xff"), lambda: filters.ascii85(b"a~>"), lambda: filters.run_length(b"\x05a"), lambda: filters.ascii_hex(b"4x>")):
        with pytest.raises(PdfError):
            bad()
    with pytest.raises(PdfError, match="Unsupported"):
        filters.decode({"Filter": Name("Bogus")}, b"")
    assert filters.decode({"Filter": Name("DCTDecode")}, b"x") == b"x"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(writer.FILTERS))
def test_filters_round_trip(data, how):
    s = writer.filtered(data, how)
    assert filters.decode(s.dict, s.data) == data


@pytest.mark.parametrize("seed", range(5))
def test_lzw_fills_its_table(seed):
    import random

    data = random.Random(seed).randbytes(20_000) + b"ab" * 5_000 * seed
    assert filters.lzw(writer.lzw(data)) == data


def test_crypto_vectors():
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.cbc_encrypt(key, bytes(16), plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypt.aes_decrypt_blocks(key, bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")).tobytes() == plain
    key = bytes(range(32))
    assert crypt.cbc_encrypt(key, bytes(16), plain).hex() == "8ea2b7ca516745bfeafc49904b496089"


def texts(pdf, password=""):
    return [t for _, _, _, runs, segs, _ in extract.pages(pdf, password) for t, _, _ in layout.lines(layout.table(segs, runs)[1])]


TEXT = "First (line)\nBack\\slash\n" + "\n".join(f"line {i}" for i in range(60))
WIDE = "α β 中文 \U0001f600\nplain"


@pytest.mark.parametrize("how", writer.STRUCTURES)
def test_structures(how):
    pdf = writer.text_pdf(TEXT, structure=how)
    assert texts(pdf) == TEXT.split("\n")
    assert extract.inspect(pdf)["page_count"] == 2


@pytest.mark.parametrize("font", writer.FONTS)
def test_fonts(font):
    assert texts(writer.text_pdf(TEXT, font=font)) == TEXT.split("\n")
    assert texts(writer.text_pdf(WIDE, font=font)) == WIDE.split("\n")


@pytest.mark.parametrize("style", writer.STYLES)
def test_styles(style):
    assert texts(writer.text_pdf(TEXT, style=style)) == TEXT.split("\n")


@pytest.mark.parametrize(("cipher", "revision"), [("rc4", 2), ("rc4", 3), ("aes128", None), ("aes256", 5), ("aes256", 6)])
def test_encryption(cipher, revision):
    pdf = writer.text_pdf(TEXT, cipher=cipher, user="user", owner="owner", revision=revision, title="Secret")
    for word in ("user", "owner"):
        assert texts(pdf, word) == TEXT.split("\n")
    assert extract.inspect(pdf, "user")["title"] == "Secret"
    with pytest.raises(PdfError, match="BadPassword"):
        texts(pdf, "wrong")
    assert texts(writer.text_pdf(TEXT, cipher=cipher, structure="objstm", revision=revision)) == TEXT.split("\n")


@pytest.mark.parametrize(
    ("change", "code"),
    [(lambda b: b"not a pdf at all", "InvalidHeader"), (lambda b: b"", "InvalidHeader"), (lambda b: b.replace(b"startxref", b"x"), "InvalidXref"),
     (lambda b: b.replace(b"/Root", b"/Rxxt"), "MissingTrailer"), (lambda b: b.replace(b"/FlateDecode", b"/FlxteDecode"), "Unsupported"), (lambda b: b[: len(b) // 2], "InvalidXref")],
)
def test_faults(change, code):
    with pytest.raises(PdfError) as e:
        list(extract.pages(change(writer.text_pdf("x"))))
    assert e.value.code == code


def test_wrong_length_is_recovered():
    pdf = writer.text_pdf("hello", filter="none")
    n = pdf.index(b"/Length ")
    assert texts(pdf[:n] + b"/Length 9" + pdf[n + 9 :]) == ["hello"]


def runs(content):
    return interpret(content, {})[0]


def test_text_operators():
    assert runs(b"BT /F1 12 Tf 100 700 Td (Hi) Tj ET") == [("Hi", 100.0, 700.0, 12.0, 12.0, "F1")]
    assert runs(b"1 0 0 1 5 5 cm BT 0 0 Td (A) Tj ET")[0][1:3] == (5.0, 5.0)
    found = runs(b"BT /F 20 Tf [(sp) 15 (li) -40 (t)] TJ ET")
    assert [r[0] for r in found] == ["sp", "li", "t"] and layout.lines(found)[0][0] == "split"
    assert [round(r[1], 6) for r in found] == [0.0, 19.7, 40.5]
    assert runs(b"BT 5 Ts (x) Tj 3 Tj ET")[0][2] == 5.0
    assert [o for o, _ in operations(b"0 g BI /H 3 /BPC 8 ID \x01(\xff EI T* (on) Tj")] == [b"g", b"T*", b"Tj"]
    assert len(list(operations(b"2 w 7 0 Td (never closed Tj ET"))) == 2
    assert runs(b"Q Q BT (a) Tj ET")[0][0] == "a"


def test_paths():
    """Lines along an axis are segments, others are not; a path starts anew at every m."""
    found = interpret(b"10 20 m 110 20 l 110 95 l 10 20 l 5 5 m 5 40 l S 2 0 0 2 1 1 cm 0 30 m 50 30 l", {})[1]
    assert found == [("y", 20.0), ("x", 110.0), ("x", 5.0), ("y", 61.0)]
    assert interpret(b"1 1 m 9 1 l n 1 2 m 9 2 l S 3 3 4 4 re W n", {}, True)[1] == [("y", 2.0)]
    assert len(interpret(b"1 1 m 9 1 l n 3 3 4 4 re W n", {})[1]) == 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([
    b"1 0 0 1 5 700 Tm", b"(a b) Tj", b"1 0 0 1 5 690 Tm (c) Tj", b"3 -14 Td", b"3 -14 Td(d)Tj", b"T*(e) Tj", b"T*", b"(\\(f\\)) Tj", b"[(g) -300 (h)] TJ", b"[(i)<6a>-20.5(k)]TJ", b"<6C> Tj", b"7 1 2 Td",
    b"/F1 9 Tf", b"12 TL", b"1 Tc", b"2 Tw", b"50 Tz", b"3 Ts", b"q 2 0 0 2 9 9 cm", b"Q", b"% note\n", b"BT", b"ET", b"(m) '", b"1 2 (n) \"", b"5 Tj", b"1 Td", b"[] TJ", b"(o)Tjx", b"(p)", b"BI /W 1 ID (z) Tj EI",
]), max_size=12), st.sampled_from([b" ", b"\n", b"\r\n  "]))
def test_whole_operations_are_a_shortcut(parts, gap):
    """Reading operations whole gives what reading them token by token gives."""
    content = gap.join(parts)
    import re

    from quire.kernel import interpret as module

    quick = interpret(content, {})
    kept = module.MOVE_AND_SHOW, module.SHOW_ARRAY
    module.MOVE_AND_SHOW = module.SHOW_ARRAY = re.compile(rb"(?!)")
    try:
        assert interpret(content, {}) == quick
    finally:
        module.MOVE_AND_SHOW, module.SHOW_ARRAY = kept


def test_numbers_are_not_cut_in_many_ways():
    """Many whole numbers in front of what no shortcut takes are read in little time."""

    def late(*_):
        raise TimeoutError

    array = b"BT /F1 10 Tf [" + b"(ab) -27500 " * 200 + b"(c\\)) <64>] TJ " + b"1000000 2000000 3000000 4000000 5000000 6000000 c " * 20 + b"ET"
    kept = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        found = runs(array)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, kept)
    assert [r[0] for r in found] == ["ab"] * 200 + ["c)", "d"] and found[1][1] == 285.0


def run(text, x, y, width, size=10.0):
    return (text, float(x), float(y), float(width), size, "F")


def test_lines():
    assert [t for t, _, _ in layout.lines([run("world", 50, 700, 25), run("Hello", 10, 700, 25), run("second", 10, 680, 30)])] == ["Hello world", "second"]
    assert layout.lines([run("rain", 3, 9, 21), run("bow", 24, 9, 12)])[0][0] == "rainbow"
    assert layout.lines([run("b", 62, 4, 6), run("a", 12, 4, 6), run("<", 40, 4, 6)])[0][0] == "a < b"
    assert layout.lines([run("1", 0, 0, 5), run("≤", 9, 0, 5), run("x", 18, 0, 5)])[0][0] == "1≤x"


def test_tables():
    cells, rest = layout.table([("x", 0.0), ("x", 50.0), ("x", 100.5), ("y", 0.0), ("y", 20.0), ("y", 41.0), ("y", 40.0)], [run("A", 5, 30, 5), run("B", 55, 30, 5), run("C", 5, 10, 5), run("D", 55, 10, 5), run("out", 5, 90, 5)])
    assert cells == [["A", "B"], ["C", "D"]] and [r[0] for r in rest] == ["out"]
    assert layout.table([("x", 0.0), ("x", 50.0), ("y", 0.0), ("y", 20.0)], [run("X", 5, 10, 5)])[0] == [["X"]]
    grid = [("x", 20.0 * i) for i in range(4)] + [("y", 20.0 * i) for i in range(4)]
    assert layout.table(grid, [run("a", 5 + 20 * i, 5 + 20 * j, 5) for i in range(3) for j in range(3)])[0] is None


def test_cmaps_and_glyphs():
    m = CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0007> <03A9> <0009> <D835DC00> endbfchar 2 beginbfrange <0030> <0034> <0410> <0050> <0051> [<0066006C> <00DF>] endbfrange")
    assert [m.lookup(c) for c in (7, 9, 0x30, 0x34, 0x50, 0x51, 0x60)] == ["Ω", "\U0001d400", "А", "Д", "fl", "ß", None]
    assert m.code_bytes == 2
    assert [glyph_text(n) for n in ("a.sc", "uni0041", "u1F600", "uni00", "eacute", "Euro", "nosuch")] == ["a", "A", "\U0001f600", None, "é", "€", None]
    assert cid_widths([1, [500, 600], 10, 12, 700]) == {1: 0.5, 2: 0.6, 10: 0.7, 11: 0.7, 12: 0.7}
    assert base_encoding(None)[0x80] == "€" and base_encoding("MacRomanEncoding")[0x8E] == "é" and base_encoding("StandardEncoding")[0x27] == "’"
    assert symbol()[0xA3] == "≤" and symbol()[0x61] == "α" and symbol()[0xB3] == "≥"


def type0(cmap, base="Own"):
    from quire.kernel.fonts import Font

    return Font(True, CMap(cmap) if cmap else None, [], {}, 1.0, base)


def test_private_use_is_not_text():
    assert type0(None).glyph(0x41)[0] == "A" and type0(None).glyph(1)[0] == ""
    own = b"1 beginbfchar <0012> <E8B3> endbfchar"
    assert type0(own).glyph(0x12)[0] == ""
    assert type0(b"1 beginbfchar <0012> <F0B9> endbfchar", "SymbolMT").glyph(0x12)[0] == "≠"
    assert type0(b"1 beginbfchar <0012> <F051> endbfchar", "MT-Extra").glyph(0x12)[0] == "∩"


def test_images():
    found = list(extract.pages(writer.image_pdf(2, 2, b"\1\2\3\4")))[0][5]
    assert found[0][:6] == ("Im0", "Raw", 2, 2, 8, "DeviceGray") and found[0][6].startswith("data:image/png;base64,")
    raw = png(2, 2, 8, 0, 1, b"\1\2\3\4")
    assert zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16]) == b"\0\1\2\0\3\4"
    assert png(2, 2, 8, 0, 1, b"\1") is None
    assert url("a/b", b"Hi") == "data:a/b;base64,SGk="
    assert zlib.crc32(b"abc") == 0x352441C2


def test_page_tree_limits():
    w = writer.Writer()
    root = w.add()
    w.put(root, {"Kids": [root]})
    cat = w.add({"Pages": root})
    assert Document(w.save(cat)).pages() == []
    w = writer.Writer()
    at = w.add({"Type": Name("Page")})
    for _ in range(70):
        at = w.add({"Kids": [at]})
    with pytest.raises(PdfError, match="deep"):
        Document(w.save(w.add({"Pages": at}))).pages()


def test_inherited_attributes():
    w = writer.Writer()
    a, b = w.add({"Type": Name("Page")}), w.add({"Rotate": 450, "MediaBox": [0, 0, 1, 2]})
    cat = w.add({"Pages": w.add({"Kids": [a, b, a], "MediaBox": [0, 0, 300, 400], "Rotate": 90})})
    found = Document(w.save(cat)).pages()
    assert [(p["media_box"], p["rotate"]) for p in found] == [((0.0, 0.0, 300.0, 400.0), 90), ((0.0, 0.0, 1.0, 2.0), 90)]


def test_content_arrays():
    w = writer.Writer()
    one, two = w.add(Stream({}, b"q")), w.add(Stream({}, b"Q"))
    d = Document(w.save(w.add({"Pages": w.add({"Kids": [w.add({"Contents": [one, two]})]})})))
    assert d.content(d.pages()[0]) == b"q\nQ\n"
