"""Page content as text runs and rule segments."""

from __future__ import annotations

import re

from quire.kernel.cos import Name, as_number, number, parse_object, parse_string
from quire.kernel.errors import PdfError

TOKEN = re.compile(
    rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*"
    rb"(?:([+-]?(?:\d+\.?\d*|\.\d+)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%]))"  # number
    rb"|\(([^()\\]*)\)"  # string without escapes
    rb"|([^\x00\t\n\x0c\r ()<>\[\]{}/%0-9+\-.][^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"  # operator
    rb"|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*)(?!#)"  # name without escapes
    rb"|([(<\[/0-9+\-.])"  # start of any other operand
    rb"|(.))",
    re.S,
)
_SPACE, _END = rb"[\x00\t\n\x0c\r ]", rb"(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)"
# possessive: a number that can be cut in several ways takes exponential time in an array that does not match after all
_NUMBER = rb"[+-]?+(?:\d++\.?+\d*+|\.\d++)"
_STRING = rb"\([^()\\]*\)"
#: A whole operation, or two, of the kinds that most of a page's text consists of: a move
#: (Tm, Td or T*) and a shown string.  Operands of any other form are left to TOKEN.
MOVE_AND_SHOW = re.compile(
    _SPACE + rb"*(?:" + (rb"(" + _NUMBER + rb")" + _SPACE + rb"+") * 6 + rb"Tm" + _END
    + rb"|" + (rb"(" + _NUMBER + rb")" + _SPACE + rb"+") * 2 + rb"Td" + _END
    + rb"|(T\*)" + _END
    + rb"|(?=" + _STRING + _SPACE + rb"*Tj" + _END + rb"))"
    + rb"(?:" + _SPACE + rb"*(" + _STRING + rb")" + _SPACE + rb"*Tj" + _END + rb")?"
)
#: A shown array of plain strings and numbers, and its elements.
SHOW_ARRAY = re.compile(_SPACE + rb"*\[((?:" + _SPACE + rb"*(?:" + _STRING + rb"|" + _NUMBER + rb"(?=[\x00\t\n\x0c\r (\]])))*+)" + _SPACE + rb"*\]" + _SPACE + rb"*TJ" + _END)
ELEMENT = re.compile(rb"\(([^()\\]*)\)|(" + _NUMBER + rb")")
WORDS = {b"true": True, b"false": False, b"null": None}
EPS = 2.0  # how far from an axis a segment may lean


def operations(b: bytes):
    """(operator, operands); a bad operand ends the stream, what came before counts."""
    for op, operands, _ in operations_from(b, 0):
        yield op, operands


def operations_from(b: bytes, i: int):
    """(operator, operands, position after it) of the operations from ``i`` on."""
    n, operands, match = len(b), [], TOKEN.match
    while i < n:
        m = match(b, i)
        if not m:
            return
        kind, i = m.lastindex, m.end()
        if kind == 1:
            operands.append(number(m[1]))
        elif kind == 2:
            operands.append(m[2])
        elif kind == 3:
            op = m[3]
            if op in WORDS:
                operands.append(WORDS[op])
                continue
            if op == b"BI":
                end = b.find(b"EI", i)
                i = n if end < 0 else end + 2
            else:
                yield op[:4], operands, i
            operands = []
        elif kind == 4:
            operands.append(Name(m[4].decode("utf-8", "replace")))
        elif kind == 5:
            try:
                x, i = parse_string(b, m.start(5)) if m[5] == b"(" else parse_object(b, m.start(5), False)
            except PdfError:
                return
            operands.append(x)
        else:
            operands = []


def num(operands: list, i: int, other: float = 0.0) -> float:
    v = as_number(operands[i]) if i < len(operands) else None
    return other if v is None else v


def matrix(o: list) -> tuple:
    return (num(o, 0, 1.0), num(o, 1), num(o, 2), num(o, 3, 1.0), num(o, 4), num(o, 5))


def product(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def interpret(content: bytes, fonts: dict, painted_only: bool = False) -> tuple[list[tuple], list[tuple]]:
    """runs (text, x, y, width, font_size, font) and segments (axis, position), in order.

    Width and size stay in text space while x and y are in device space, and a
    path counts whether it is painted or not unless ``painted_only``."""
    runs, segments, waiting = [], [], []
    ctm, stack, tm, line = IDENTITY, [], IDENTITY, IDENTITY
    font, size, char, word, scale, lead, rise = "", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
    at = (0.0, 0.0)

    def show(data) -> None:
        nonlocal tm
        if type(data) is not bytes:
            return
        a, b, c, d, e, f = tm
        known = fonts.get(font)
        if known:
            text, advance = known.show(data, size, char, word, scale)
        else:
            text, advance = data.decode("latin-1"), (len(data) * (0.5 * size + char) + data.count(b" ") * word) * scale
        if ctm is IDENTITY and not rise:
            runs.append((text, e, f, advance, size, font))
        else:
            trm = product(tm, ctm)
            runs.append((text, rise * trm[2] + trm[4], rise * trm[3] + trm[5], advance, size, font))
        tm = (a, b, c, d, advance * a + e, advance * b + f)

    def move(tx: float, ty: float) -> None:
        nonlocal tm, line
        a, b, c, d, e, f = line
        tm = line = (a, b, c, d, tx * a + ty * c + e, tx * b + ty * d + f)

    def point(x: float, y: float) -> tuple:
        return (x * ctm[0] + y * ctm[2] + ctm[4], x * ctm[1] + y * ctm[3] + ctm[5])

    def segment(p: tuple, q: tuple) -> None:
        to = waiting if painted_only else segments
        if abs(p[1] - q[1]) < EPS:
            to.append(("y", p[1]))
        elif abs(p[0] - q[0]) < EPS:
            to.append(("x", p[0]))

    i, n, fast, array = 0, len(content), MOVE_AND_SHOW.match, SHOW_ARRAY.match
    while i < n:
        m = fast(content, i)
        if m:
            i = m.end()
            a, b, c, d, e, f, x, y, star, data = m.groups()
            if a is not None:
                tm = line = (float(a), float(b), float(c), float(d), float(e), float(f))
            elif x is not None:
                move(float(x), float(y))
            elif star is not None:
                move(0.0, -lead)
            if data is not None:
                show(data[1:-1])
            continue
        m = array(content, i)
        if m:
            i = m.end()
            for text, shift in ELEMENT.findall(m[1]):
                if shift:
                    dx = -float(shift) / 1000.0 * size * scale
                    tm = (*tm[:4], dx * tm[0] + tm[4], dx * tm[1] + tm[5])
                else:
                    show(text)
            continue
        op, o, i = next(operations_from(content, i), (None, None, n))
        if op is None:
            break
        if op == b"Tj":
            show(o[0] if o else None)
        elif op == b"TJ":
            for x in o[0] if o and type(o[0]) is list else ():
                if type(x) is bytes:
                    show(x)
                else:
                    dx = -(as_number(x) or 0.0) / 1000.0 * size * scale
                    tm = (*tm[:4], dx * tm[0] + tm[4], dx * tm[1] + tm[5])
        elif op == b"Td":
            move(num(o, 0), num(o, 1))
        elif op == b"Tm":
            tm = line = matrix(o)
        elif op == b"TD":
            lead = -num(o, 1)
            move(num(o, 0), num(o, 1))
        elif op == b"T*":
            move(0.0, -lead)
        elif op == b"Tf":
            font = str(o[0]) if o and isinstance(o[0], Name) else font
            size = num(o, 1)
        elif op == b"'":
            move(0.0, -lead)
            show(o[0] if o else None)
        elif op == b'"':
            word, char = num(o, 0), num(o, 1)
            move(0.0, -lead)
            show(o[2] if len(o) > 2 else None)
        elif op == b"BT":
            tm = line = IDENTITY
        elif op == b"q":
            stack.append(ctm)
        elif op == b"Q":
            ctm = stack.pop() if stack else ctm
        elif op == b"cm":
            ctm = product(matrix(o), ctm)
        elif op == b"re":
            x, y, w, h = (num(o, i) for i in range(4))
            a, b, c, d = point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)
            segment(a, b), segment(b, c), segment(c, d), segment(d, a)
        elif op == b"m":
            at = point(num(o, 0), num(o, 1))
        elif op == b"l":
            to = point(num(o, 0), num(o, 1))
            segment(at, to)
            at = to
        elif op == b"Tc":
            char = num(o, 0)
        elif op == b"Tw":
            word = num(o, 0)
        elif op == b"Tz":
            scale = num(o, 0) / 100.0
        elif op == b"TL":
            lead = num(o, 0)
        elif op == b"Ts":
            rise = num(o, 0)
        elif painted_only and op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            segments += waiting
            waiting.clear()
        elif painted_only and op == b"n":
            waiting.clear()
    return runs, segments
