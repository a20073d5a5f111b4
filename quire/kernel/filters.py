"""Stream filters and predictors."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from quire.kernel.cos import Name, as_dict, as_int
from quire.kernel.errors import PdfError

#: Most bytes that a filter may produce, a guard against decompression bombs.
MAX_OUTPUT = 1 << 30
IMAGE_FILTERS = {"DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode"}


def bad(what: str) -> PdfError:
    return PdfError("BadStream", what)


def flate(data: bytes) -> bytes:
    """zlib or raw DEFLATE; the checksum is not looked at."""
    body = data
    if len(data) >= 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        body = data[2:]
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(body, MAX_OUTPUT)
    except zlib.error as e:
        raise bad(f"DEFLATE: {e}") from None
    if not d.eof:
        raise bad("DEFLATE: larger than allowed" if len(out) >= MAX_OUTPUT else "DEFLATE: truncated")
    return out


def lzw(data: bytes, early: int = 1) -> bytes:
    """MSB-first codes of 9 to 12 bits; 256 clears, 257 ends."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, last, bits, held = [], 9, None, 0, 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last is not None:
            entry = last + last[:1]
        else:
            raise bad("LZW: unknown code")
        out.append(entry)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) >= (1 << width) - early and width < 12:
            width += 1
        last = entry
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    """``z`` stands for four zero bytes at the start of a group; ``~`` ends."""
    body = re.sub(rb"[\x00\t\n\x0c\r ]+", b"", data.split(b"~", 1)[0])
    if body[:2] == b"<~":
        body = body[2:]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                v = 0
                for g in group:
                    v = v * 85 + g
                out += struct.pack(">I", v & 0xFFFFFFFF)
                group.clear()
        else:
            raise bad("ASCII85: unexpected character")
    if len(group) == 1:
        raise bad("ASCII85: one character left over")
    if group:
        v = 0
        for g in group + [84] * (5 - len(group)):
            v = v * 85 + g
        out += struct.pack(">I", v & 0xFFFFFFFF)[: len(group) - 1]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[\x00\t\n\x0c\r ]+", b"", data.split(b">", 1)[0])
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode("latin-1"))
    except ValueError:
        raise bad("ASCIIHex: bad digit") from None


def run_length(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and data[i] != 128:
        k = data[i]
        if k < 128:
            if i + 2 + k > n:
                raise bad("RunLength: truncated")
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if i + 2 > n:
                raise bad("RunLength: truncated")
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
    return bytes(out)


def predict(data: bytes, parms: dict) -> bytes:
    """Undo a TIFF (2) or PNG (above 2) predictor."""
    kind = as_int(parms.get("Predictor")) or 1
    if kind == 1:
        return data

    def read(key: str, other: int) -> int:
        v = as_int(parms.get(key))
        return other if v is None or v < 1 else v

    colors, depth, columns = read("Colors", 1), read("BitsPerComponent", 8), read("Columns", 1)
    step, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        whole = len(data) // row * row
        if depth == 16:
            a = np.frombuffer(data[:whole], ">u2").reshape(whole // row, columns, colors)
            return np.cumsum(a, axis=1, dtype=np.uint64).astype(">u2").tobytes() + data[whole:]
        usable = row // step * step
        a = np.frombuffer(data[:whole], np.uint8).reshape(-1, row).copy()
        lanes = a[:, :usable].reshape(len(a), usable // step, step)
        a[:, :usable] = np.cumsum(lanes, axis=1, dtype=np.uint64).astype(np.uint8).reshape(len(a), usable)
        tail = bytearray(data[whole:])
        for i in range(step, len(tail)):
            tail[i] = (tail[i] + tail[i - step]) & 255
        return a.tobytes() + bytes(tail)
    out, above = [], np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        tag, line = data[at], np.frombuffer(data, np.uint8, min(row, len(data) - at - 1), at + 1)
        n = len(line)
        up = above[:n]
        if tag == 0:
            new = line
        elif tag == 2:
            new = line + up
        elif tag == 1:
            pad = np.zeros(-n % step, np.uint8)
            new = np.cumsum(np.concatenate([line, pad]).reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)[:n]
        elif tag in (3, 4):
            cur, src, ups = bytearray(n), line.tobytes(), up.tobytes()
            for i in range(n):
                left = cur[i - step] if i >= step else 0
                over = ups[i]
                if tag == 3:
                    guess = (left + over) >> 1
                else:
                    corner = ups[i - step] if i >= step else 0
                    p = left + over - corner
                    a, b, c = abs(p - left), abs(p - over), abs(p - corner)
                    guess = left if a <= b and a <= c else over if b <= c else corner
                cur[i] = (src[i] + guess) & 255
            new = np.frombuffer(bytes(cur), np.uint8)
        else:
            raise bad("PNG predictor: unknown row filter")
        out.append(new.tobytes())
        above = np.zeros(row, np.uint8)
        above[:n] = new
    return b"".join(out)


def filter_names(d: dict) -> list[str]:
    f = d.get("Filter", d.get("F"))
    return [f] if isinstance(f, Name) else [x for x in f if isinstance(x, Name)] if isinstance(f, list) else []


def decode(d: dict, data: bytes) -> bytes:
    """Run the filter chain of a stream dictionary; image codecs pass through."""
    names, parms = filter_names(d), d.get("DecodeParms", d.get("DP"))
    each = parms if isinstance(parms, list) else [parms]
    for k, name in enumerate(names):
        p = as_dict(each[k]) if k < len(each) else None
        p = p or {}
        if name in ("FlateDecode", "Fl"):
            data = predict(flate(data), p)
        elif name in ("LZWDecode", "LZW"):
            e = as_int(p.get("EarlyChange"))
            data = predict(lzw(data, 1 if e is None else e), p)
        elif name in ("ASCII85Decode", "A85"):
            data = ascii85(data)
        elif name in ("ASCIIHexDecode", "AHx"):
            data = ascii_hex(data)
        elif name in ("RunLengthDecode", "RL"):
            data = run_length(data)
        elif name not in IMAGE_FILTERS:
            raise PdfError("Unsupported", f"filter {name}")
    return data
