"""Cross references, object resolution, the page tree and page content."""

from __future__ import annotations

import re

from quire.kernel import filters
from quire.kernel.cos import RUN, Name, Ref, Stream, as_dict, as_int, as_number, parse_object, skip
from quire.kernel.crypt import Decryptor
from quire.kernel.errors import PdfError

HEADER = re.compile(rb"%PDF-([^ \t\r\n]{0,8})")
OBJ = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
STREAM = re.compile(rb"stream(\r\n|\n|\r)?")
XREF_ROW = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+([nf])")
PAIR = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)")
MAX_DEPTH = 64


class Document:
    """One parsed file.  Objects load on demand and are kept."""

    def __init__(self, data: bytes, password: str = ""):
        self.data = data
        m = HEADER.search(data[:1024])
        if not m:
            raise PdfError("InvalidHeader", "no %PDF- in the first 1024 bytes")
        self.version = m[1].decode("utf-8", "replace")
        self.xref: dict[int, tuple] = {}  # number -> ("n", offset) | ("c", stream, index) | ("f",)
        self.objects: dict[int, object] = {}
        self.packed: dict[int, tuple] = {}
        self.decryptor = None
        self.lints: list[tuple[str, str]] = []  # (code, message) of what was read in spite of a fault
        self.trailer = self._read_chain()
        if "Root" not in self.trailer:
            raise PdfError("MissingTrailer", "the trailer has no /Root")
        self.encrypted = self.trailer.get("Encrypt") is not None
        if self.encrypted:
            self._set_up(password)

    # -- cross references

    def _read_chain(self) -> dict:
        at = self.data.rfind(b"startxref")
        m = RUN.match(self.data, skip(self.data, at + 9)) if at >= 0 else None
        if not m or not m[0].isdigit():
            raise PdfError("InvalidXref", "no startxref")
        offset, seen, trailer = int(m[0]), set(), None
        while offset is not None and offset not in seen:
            seen.add(offset)
            found, entries = self._section(offset)
            trailer = found if trailer is None else trailer
            self._add(entries)
            hybrid = as_int(found.get("XRefStm"))
            if hybrid is not None:
                try:
                    self._add(self._section(hybrid)[1])
                except PdfError as e:
                    self.lints.append(("RecoveredXref", f"hybrid section at {hybrid}: {e.message}"))
            offset = as_int(found.get("Prev"))
        return trailer or {}

    def _add(self, entries: dict) -> None:
        for num, e in entries.items():
            self.xref.setdefault(num, e)

    def _section(self, offset: int) -> tuple[dict, dict]:
        if offset < 0 or offset >= len(self.data):
            raise PdfError("InvalidXref", "offset outside the file")
        at = skip(self.data, offset)
        m = RUN.match(self.data, at)
        if m and m[0] == b"xref":
            return self._table(m.end())
        try:
            s = self._indirect(at)[1]
        except PdfError as e:
            raise PdfError("InvalidXref", e.message) from None
        if not isinstance(s, Stream):
            raise PdfError("InvalidXref", "neither a table nor a stream")
        return s.dict, self._records(s)

    def _table(self, i: int) -> tuple[dict, dict]:
        b, out = self.data, {}
        while True:
            i = skip(b, i)
            if b.startswith(b"trailer", i):
                d, _ = parse_object(b, i + 7)
                if not isinstance(d, dict):
                    raise PdfError("InvalidXref", "the trailer is not a dictionary")
                return d, out
            m = PAIR.match(b, i)
            if not m:
                raise PdfError("InvalidXref", "subsection expected")
            first, n, i = int(m[1]), int(m[2]), m.end()
            for k in range(n):
                r = XREF_ROW.match(b, i)
                if not r:
                    raise PdfError("InvalidXref", "bad entry")
                out.setdefault(first + k, ("n", int(r[1])) if r[3] == b"n" else ("f",))
                i = r.end()

    @staticmethod
    def _records(s: Stream) -> dict:
        w = s.dict.get("W")
        if not (isinstance(w, list) and len(w) == 3 and all(type(x) is int and 0 <= x <= 8 for x in w)):
            raise PdfError("InvalidXref", "bad /W")
        index = s.dict.get("Index", [0, as_int(s.dict.get("Size")) or 0])
        if not isinstance(index, list) or len(index) % 2 or not all(type(x) is int for x in index):
            raise PdfError("InvalidXref", "bad /Index")
        data, at, out = filters.decode(s.dict, s.data), 0, {}
        a, b, c = w[0], w[0] + w[1], sum(w)
        for first, n in zip(index[::2], index[1::2], strict=True):
            for num in range(first, first + n):
                r = data[at : at + c]
                if len(r) < c or not c:
                    return out
                at += c
                kind = int.from_bytes(r[:a]) if w[0] else 1
                x, y = int.from_bytes(r[a:b]), int.from_bytes(r[b:])
                if kind in (0, 1, 2):
                    out.setdefault(num, (("f",), ("n", x), ("c", x, y))[kind])
        return out

    # -- objects

    def _indirect(self, at: int) -> tuple[Ref, object]:
        m = OBJ.match(self.data, skip(self.data, at))
        if not m:
            raise PdfError("InvalidObject", "object header expected")
        x, i = parse_object(self.data, m.end())
        if isinstance(x, dict):
            s = STREAM.match(self.data, skip(self.data, i))
            if s:
                x = Stream(x, self._body(x, s.end()))
        return Ref(int(m[1]), int(m[2])), x

    def _body(self, d: dict, start: int) -> bytes:
        """The declared length if ``endstream`` follows within 24 bytes, else up to ``endstream``."""
        n = d.get("Length")
        if isinstance(n, Ref):
            try:
                n = self.get(n.num) if self.xref else None
            except PdfError:
                n = None
        if type(n) is int and 0 <= n <= len(self.data) - start:
            end = start + n
            if b"endstream" in self.data[end : end + 24 + 9]:
                return self.data[start:end]
        end = self.data.find(b"endstream", start)
        if end < 0:
            raise PdfError("UnexpectedEof", "unterminated stream")
        body = self.data[start:end]
        body = body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body
        if type(n) is int:
            self.lints.append(("LengthMismatch", f"stream at {start}: {n} declared, {len(body)} found"))
        return body

    def get(self, num: int):
        if num in self.objects:
            return self.objects[num]
        e = self.xref.get(num, ("f",))
        if e[0] == "f":
            raise PdfError("ObjectNotFound", f"object {num}")
        if e[0] == "c":
            x = self._from_stream(e[1], e[2])
        else:
            ref, x = self._indirect(e[1])
            if ref.num != num:
                raise PdfError("InvalidObject", f"object {ref.num} where {num} was expected")
            if self.decryptor:
                x = self.decryptor.object(x, ref)
        self.objects[num] = x
        return x

    def _from_stream(self, stream: int, index: int):
        if stream not in self.packed:
            s = self.get(stream)
            n, first = (as_int(s.dict.get(k)) for k in ("N", "First")) if isinstance(s, Stream) else (None, None)
            if n is None or first is None:
                raise PdfError("InvalidObject", "bad object stream")
            data = filters.decode(s.dict, s.data)
            heads, i = [], 0
            for _ in range(n):
                m = PAIR.match(data, i)
                if not m:
                    raise PdfError("InvalidObject", "bad object stream header")
                heads.append(int(m[2]))
                i = m.end()
            self.packed[stream] = (data, first, heads)
        data, first, heads = self.packed[stream]
        if index >= len(heads):
            raise PdfError("ObjectNotFound", f"index {index} of object stream {stream}")
        return parse_object(data, first + heads[index])[0]

    def resolve(self, x):
        """Follow one level of reference."""
        return self.get(x.num) if isinstance(x, Ref) else x

    def dict_of(self, x) -> dict:
        d = as_dict(self.resolve(x))
        if d is None:
            raise PdfError("InvalidObject", "dictionary expected")
        return d

    def soft(self, x):
        """resolve(), or None where that fails."""
        try:
            return self.resolve(x)
        except PdfError:
            return None

    def _set_up(self, password: str) -> None:
        encrypt = self.dict_of(self.trailer["Encrypt"])
        ids = self.soft(self.trailer.get("ID"))
        first = ids[0] if isinstance(ids, list) and ids and type(ids[0]) is bytes else b""
        keep = dict(self.objects)
        # strings in the encryption dictionary are not encrypted themselves
        self.decryptor = Decryptor({k: self.soft(v) for k, v in encrypt.items()}, first, password.encode("utf-8"))
        exempt = self.trailer["Encrypt"].num if isinstance(self.trailer["Encrypt"], Ref) else None
        self.objects = {k: v for k, v in keep.items() if k == exempt}

    # -- pages

    def info(self) -> dict[str, str | None]:
        """Title, Author, Subject and Creator of /Info."""
        d = as_dict(self.soft(self.trailer.get("Info"))) or {}
        out = {}
        for k in ("Title", "Author", "Subject", "Creator"):
            v = self.soft(d.get(k))
            if type(v) is not bytes:
                out[k] = None
            elif v[:2] == b"\xfe\xff":
                out[k] = v[2:].decode("utf-16-be", "replace")
            elif v[:3] == b"\xef\xbb\xbf":
                out[k] = v[3:].decode("utf-8", "replace")
            else:
                out[k] = v.decode("latin-1")
        return out

    def pages(self) -> list[dict]:
        """Leaves in reading order: dict, media_box, resources, rotate."""
        root = self.dict_of(self.trailer["Root"])
        if "Pages" not in root:
            raise PdfError("InvalidObject", "the catalog has no /Pages")
        out: list[dict] = []
        start = {"media_box": (0.0, 0.0, 612.0, 792.0), "resources": {}, "rotate": 0}
        seen = {root["Pages"].num} if isinstance(root["Pages"], Ref) else set()
        stack = [(root["Pages"], start, 0)]
        while stack:
            at, above, depth = stack.pop()
            if depth > MAX_DEPTH:
                raise PdfError("InvalidObject", "the page tree is too deep")
            node = self.dict_of(at)
            here = {"media_box": self._rect(node.get("MediaBox")) or above["media_box"], "resources": above["resources"], "rotate": above["rotate"]}
            own = as_dict(self.soft(node.get("Resources")))
            if own is not None:
                here["resources"] = own
            turn = as_int(self.soft(node.get("Rotate")))
            if turn is not None:
                here["rotate"] = turn % 360
            if "Kids" not in node:
                out.append(here | {"dict": node})
                continue
            kids = self.soft(node["Kids"])
            for kid in reversed(self._unseen(kids if isinstance(kids, list) else [], seen)):
                stack.append((kid, here, depth + 1))
        return out

    @staticmethod
    def _unseen(kids: list, seen: set) -> list:
        out = []
        for kid in kids:
            if isinstance(kid, Ref):
                if kid.num in seen:
                    continue
                seen.add(kid.num)
            out.append(kid)
        return out

    def _rect(self, x) -> tuple | None:
        x = self.soft(x)
        if not isinstance(x, list) or len(x) != 4:
            return None
        v = [as_number(a) for a in x]
        return None if None in v else tuple(v)

    def content(self, page: dict) -> bytes:
        """The page's decoded content; parts of an array end with a newline."""
        c = self.resolve(page["dict"].get("Contents"))
        if isinstance(c, Stream):
            return filters.decode(c.dict, c.data)
        out = []
        for x in c if isinstance(c, list) else []:
            s = self.resolve(x)
            if isinstance(s, Stream):
                out += [filters.decode(s.dict, s.data), b"\n"]
        return b"".join(out)

    def subdict(self, resources: dict, key: str) -> dict:
        return as_dict(self.soft(resources.get(key))) or {}


def name_of(x) -> str | None:
    return str(x) if isinstance(x, Name) else None
