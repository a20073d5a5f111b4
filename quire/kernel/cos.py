"""COS objects: a regex tokenizer over bytes.

null, booleans, int, float, list and dict are Python's own; strings are bytes,
names are ``Name``, references ``Ref``, streams ``Stream``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from quire.kernel.errors import PdfError


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Stream(NamedTuple):
    dict: dict
    data: bytes


WHITE = b"\\x00\\t\\n\\x0c\\r "
REGULAR = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
RUN = re.compile(REGULAR + rb"+")
NAME = re.compile(rb"/(" + REGULAR + rb"*)")
NUMBER = re.compile(rb"[+-]?(?:\d+(\.\d*)?|(\.\d+))(?![\d.])")
REST_OF_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?!" + REGULAR + rb")")
PLAIN_STRING = re.compile(rb"\(([^()\\]*)\)")
STRING_PART = re.compile(rb"[^()\\]+")
HEX_STRING = re.compile(rb"<([0-9A-Fa-f\x00\t\n\x0c\r ]*)>")
NOT_HEX = re.compile(rb"[\x00\t\n\x0c\r ]+")
HEX_PAIR = re.compile(rb"#([0-9A-Fa-f]{2})")
OCTAL = re.compile(rb"[0-7]{1,3}")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
INT_MAX = (1 << 63) - 1


def skip(b: bytes, i: int) -> int:
    return SKIP.match(b, i).end()


def number(text: bytes) -> int | float:
    if b"." in text:
        return float(text)
    n = int(text)
    return n if -INT_MAX - 1 <= n <= INT_MAX else float(text)


def parse_name(b: bytes, i: int) -> tuple[Name, int]:
    m = NAME.match(b, i)
    raw = m[1]
    if b"#" in raw:
        if raw.count(b"#") != len(HEX_PAIR.findall(raw)):
            raise PdfError("UnexpectedToken", "bad escape in name")
        raw = HEX_PAIR.sub(lambda h: bytes([int(h[1], 16)]), raw)
    return Name(raw.decode("utf-8", "replace")), m.end()


def parse_string(b: bytes, i: int) -> tuple[bytes, int]:
    m = PLAIN_STRING.match(b, i)
    if m:
        return m[1], m.end()
    out, depth, i, n = [], 1, i + 1, len(b)
    while i < n:
        m = STRING_PART.match(b, i)
        if m:
            out.append(m[0])
            i = m.end()
            continue
        c = b[i : i + 1]
        if c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return b"".join(out), i + 1
        else:
            e = b[i + 1 : i + 2]
            m = OCTAL.match(b, i + 1)
            if m:
                out.append(bytes([int(m[0], 8) & 255]))
                i = m.end()
            elif e == b"\r":
                i += 3 if b[i + 2 : i + 3] == b"\n" else 2
            else:
                out.append(b"" if e == b"\n" else ESCAPES.get(e, e))
                i += 2
            continue
        out.append(c)
        i += 1
    raise PdfError("UnexpectedEof", "unterminated string")


def parse_hex(b: bytes, i: int) -> tuple[bytes, int]:
    m = HEX_STRING.match(b, i)
    if not m:
        code = "UnexpectedToken" if b.find(b">", i) >= 0 else "UnexpectedEof"
        raise PdfError(code, "bad hex string")
    digits = NOT_HEX.sub(b"", m[1])
    return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode()), m.end()


def parse_object(b: bytes, i: int, refs: bool = True) -> tuple[object, int]:
    """The object at or after ``i`` and the position after it."""
    i = skip(b, i)
    c = b[i : i + 1]
    if not c:
        raise PdfError("UnexpectedEof", "object expected")
    if c == b"/":
        return parse_name(b, i)
    if c == b"(":
        return parse_string(b, i)
    if c == b"<":
        return parse_dict(b, i + 2, refs) if b[i + 1 : i + 2] == b"<" else parse_hex(b, i)
    if c == b"[":
        out, i = [], i + 1
        while True:
            i = skip(b, i)
            if b[i : i + 1] == b"]":
                return out, i + 1
            if i >= len(b):
                raise PdfError("UnexpectedEof", "unterminated array")
            x, i = parse_object(b, i, refs)
            out.append(x)
    if c in b"0123456789+-.":
        m = NUMBER.match(b, i)
        if not m:
            raise PdfError("UnexpectedToken", "bad number")
        x = number(m[0])
        if refs and type(x) is int and 0 <= x < 1 << 32 and m[0].isdigit():
            r = REST_OF_REF.match(b, m.end())
            if r and int(r[1]) < 65536:
                return Ref(x, int(r[1])), r.end()
        return x, m.end()
    m = RUN.match(b, i)
    word = m[0] if m else c
    if word == b"true":
        return True, m.end()
    if word == b"false":
        return False, m.end()
    if word == b"null":
        return None, m.end()
    raise PdfError("UnexpectedToken", f"unexpected {word[:16]!r}")


def parse_dict(b: bytes, i: int, refs: bool = True) -> tuple[dict, int]:
    """The dictionary whose ``<<`` ends at ``i``; a later duplicate key wins."""
    out: dict = {}
    while True:
        i = skip(b, i)
        c = b[i : i + 1]
        if c == b">":
            return out, i + 2
        if not c:
            raise PdfError("UnexpectedEof", "unterminated dictionary")
        if c != b"/":
            raise PdfError("UnexpectedToken", "dictionary key is not a name")
        key, i = parse_name(b, i)
        out[key], i = parse_object(b, i, refs)


def as_int(x) -> int | None:
    return x if type(x) is int else None


def as_number(x) -> float | None:
    return float(x) if type(x) in (int, float) else None


def as_dict(x) -> dict | None:
    return x if isinstance(x, dict) else x.dict if isinstance(x, Stream) else None
