"""Embedded images: geometry, format and a viewable data URL."""

from __future__ import annotations

import base64
import struct
import zlib

from quire.kernel import filters
from quire.kernel.cos import Name, Stream, as_int
from quire.kernel.errors import PdfError

#: Image format by last filter.
FORMATS = {
    "DCTDecode": "Jpeg", "DCT": "Jpeg", "JPXDecode": "Jpeg2000", "CCITTFaxDecode": "Ccitt", "CCF": "Ccitt", "JBIG2Decode": "Jbig2",
}
#: PNG colour type and bit depths by colour space.
PNG_KINDS = {"DeviceGray": (0, 1, (1, 2, 4, 8, 16)), "DeviceRGB": (2, 3, (8, 16))}
BLOCK = 65535


def stored_zlib(data: bytes) -> bytes:
    """A zlib stream of stored blocks of up to 65,535 bytes."""
    out = [b"\x78\x01"]
    for at in range(0, max(1, len(data)), BLOCK):
        part = data[at : at + BLOCK]
        out.append(struct.pack("<BHH", at + BLOCK >= len(data), len(part), len(part) ^ 0xFFFF) + part)
    out.append(struct.pack(">I", zlib.adler32(data)))
    return b"".join(out)


def png(width: int, height: int, depth: int, color: int, channels: int, data: bytes) -> bytes | None:
    """A PNG of raw samples, or None if their number does not fit."""
    row = (width * channels * depth + 7) // 8
    if not width or not height or len(data) != row * height:
        return None
    lines = b"".join(b"\0" + data[i : i + row] for i in range(0, len(data), row))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", stored_zlib(lines)) + chunk(b"IEND", b"")


def url(mime: str, data: bytes) -> str:
    return f"data:{mime};base64,{base64.b64encode(data).decode()}"


def color_space(doc, d: dict) -> str:
    c = doc.soft(d.get("ColorSpace")) if "ColorSpace" in d else Name("DeviceRGB")
    c = doc.soft(c[0]) if isinstance(c, list) and c else c
    return str(c) if isinstance(c, Name) else "Unknown"


def page_images(doc, resources: dict) -> list[tuple]:
    """(name, format, width, height, bits_per_component, color_space, data_url) in dictionary order.

    Every image of the resources counts, drawn or not; one that cannot be
    decoded is left out."""
    out = []
    for name, x in doc.subdict(resources, "XObject").items():
        s = doc.soft(x)
        if not isinstance(s, Stream) or s.dict.get("Subtype") != "Image":
            continue
        d = s.dict
        try:
            data = filters.decode(d, s.data)
        except PdfError:
            continue

        def size(key: str, other: int) -> int:
            v = as_int(doc.soft(d.get(key)))  # noqa: B023
            return other if v is None or v < 0 else v

        chain = filters.filter_names(d)
        kind = FORMATS.get(chain[-1] if chain else "", "Raw")
        w, h, bits, space = size("Width", 0), size("Height", 0), size("BitsPerComponent", 8), color_space(doc, d)
        link = ""
        if kind in ("Jpeg", "Jpeg2000"):
            link = url("image/jpeg" if kind == "Jpeg" else "image/jp2", data)
        elif kind == "Raw" and space in PNG_KINDS and bits in PNG_KINDS[space][2]:
            made = png(w, h, bits, *PNG_KINDS[space][:2], data)
            link = url("image/png", made) if made else ""
        out.append((str(name), kind, w, h, bits, space, link))
    return out
