"""Media columns: Netpbm and BMP images as numpy arrays.

Images are decoded, area-resized by integral images, and written as NPY tiles
with a difference hash.  One task handles one image at a time; the integral
images are built over strips of rows, so memory stays within a few times one
stored image however tall it is.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STRIP_ROWS = 8192
ROW = 192  # payload bytes in a row of 64 RGB pixels
TILE = 16


class BadImage(ValueError):
    pass


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers after the magic, comments skipped, and where the samples begin."""
    at, out = 2, []
    token = re.compile(rb"(?:[ \t-\r]|#[^\r\n]*[\r\n])*(\d+)")
    while len(out) < n:
        m = token.match(data, at)
        if not m:
            raise BadImage("Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1  # one white-space byte ends the header


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, colour, plain = kind in (1, 4), kind in (3, 6), kind <= 3
    (w, h, *most), at = _netpbm_header(data, 2 if bitmap else 3)
    top = 1 if bitmap else most[0]
    if not (w and h and 0 < top < 65536):
        raise BadImage("Netpbm size")
    channels = 3 if colour else 1
    if plain:
        body = re.sub(rb"#[^\r\n]*", b"", data[at - 1 :])
        values = np.frombuffer(re.sub(rb"[^01]", b"", body), np.uint8) - 48 if bitmap else np.array(body.split(), dtype=np.int64)
    elif bitmap:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        values = np.unpackbits(rows, axis=1)[:, :w].reshape(-1)
    else:
        kind_of = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        if len(data) - at < w * h * channels * kind_of.itemsize:
            raise BadImage("Netpbm samples")
        values = np.frombuffer(data, kind_of, w * h * channels, at)
    if len(values) < w * h * channels:
        raise BadImage("Netpbm samples")
    out = values[: w * h * channels].reshape(h, w, channels)
    if bitmap:
        out = (1 - out) * 255  # 1 is black
    elif top not in (255, 65535):
        out = (out.astype(np.int64) * 255 + top // 2) // top
    return out.astype(np.uint16 if top > 255 and out.max(initial=0) > 255 else np.uint8, copy=False)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise BadImage("BMP header")
    at, info, w, h, _, bits, method = struct.unpack_from("<IIiiHHI", data, 10)
    flip, h = h > 0, abs(h)
    if method or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise BadImage("BMP kind")
    stride = (w * bits + 31) // 32 * 4
    if len(data) - at < stride * h:
        raise BadImage("BMP samples")
    rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        table = np.frombuffer(data, np.uint8, used * 4, 14 + info).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = rows[:, :w]
        else:
            index = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
            index = (index @ (1 << np.arange(bits)[::-1]))[:, :w]
        out = table[index]
    else:
        out = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    return out[::-1] if flip else out


def decode_image(data: bytes) -> np.ndarray:
    """height x width x channels; raises BadImage for anything else."""
    if len(data) > 2 and data[0] == 80 and 49 <= data[1] <= 54:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise BadImage("neither Netpbm nor BMP")


def area_resize(img: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Exact box means as integers: sums scaled so that mean = value / (h * w).

    Edges between pixels are interpolated in the integral image: at x = j * w /
    out_w it is out_w * S[floor] + remainder * pixel, which is exact."""
    h, w, c = img.shape

    def edges(n: int, out: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(out + 1, dtype=np.int64) * n
        return x // out, x % out

    fx, rx = edges(w, out_w)
    fy, ry = edges(h, out_h)
    at = np.zeros((out_h + 1, out_w, c), np.int64)
    before = np.zeros((out_w, c), np.int64)  # the integral over all rows above the strip
    for y0 in range(0, h, STRIP_ROWS):
        strip = img[y0 : y0 + STRIP_ROWS].astype(np.int64)
        n = len(strip)
        across = np.zeros((n, w + 1, c), np.int64)
        np.cumsum(strip, axis=1, out=across[:, 1:])
        cells = across[:, fx] * out_w
        inner = rx > 0
        cells[:, inner] += strip[:, fx[inner]] * rx[inner][:, None]
        rows = np.diff(cells, axis=1)
        down = np.zeros((n + 1, out_w, c), np.int64)
        np.cumsum(rows, axis=0, out=down[1:])
        here = (fy >= y0) & (fy < y0 + n)
        k = fy[here] - y0
        at[here] = (before + down[k]) * out_h + rows[k] * ry[here][:, None, None]
        before = before + down[-1]
    at[fy >= h] = before * out_h
    return np.diff(at, axis=0)


def difference_hash(img: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 box means of the grey image rises to the right."""
    grey = area_resize(img, 8, 9).sum(axis=2)
    bits = (grey[:, 1:] > grey[:, :-1]).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def npy_tile(img: np.ndarray, side: int = TILE) -> bytes:
    """The image area-resized to side x side, rounded half up, in NPY format."""
    h, w, _ = img.shape
    mean = (2 * area_resize(img, side, side) + h * w) // (2 * h * w)
    out = io.BytesIO()
    np.save(out, mean.astype(img.dtype), allow_pickle=False)
    return out.getvalue()


def as_ppm(payload: bytes) -> bytes:
    """The payload as a P6 image 64 pixels wide; its length is a multiple of 192."""
    return b"P6\n64 %d\n255\n" % (len(payload) // ROW) + payload


SCHEMA = "id {id}, height int, width int, channels int, dhash string, tile binary, error string"


def image_features(images: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``id, height, width, channels, dhash, tile, error`` of every image.

    Null, empty or undecodable content gives nulls and the reason in ``error``.
    Repeated rows are decoded alike; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, content = batch.column(0), batch.column(1)
            rows = []
            for x in content:
                try:
                    img = decode_image(x.as_buffer().to_pybytes() if x.is_valid else b"")
                    rows.append((*img.shape, difference_hash(img), npy_tile(img), None))
                except (BadImage, ValueError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "height", "width", "channels", "dhash", "tile", "error"])

    lean = images.select(images[id_col].alias("id"), images[content_col].alias("content"))
    return lean.mapInArrow(run, SCHEMA.format(id=lean.schema["id"].dataType.simpleString()))


def media_round_trip(text: bytes) -> tuple:
    """Store a text as an image, read the stored bytes back and describe them."""
    fill = -len(text) % ROW if text else ROW
    stored = as_ppm(text + b" " * fill)
    img = decode_image(stored)
    payload = np.ascontiguousarray(img).tobytes()
    tile = npy_tile(img)
    return (
        len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
        len(stored), hashlib.sha256(stored).hexdigest(), f"{difference_hash(img)}-{hashlib.sha256(tile).hexdigest()[:16]}",
    )


def op6_media_columns(spark, sf_dir):
    """Every text of documents through the image codec.

    Null text is empty.  Repeated rows and null ids are returned as they are, ids
    in their own type; equal texts give equal values.  A very long text is one
    image, decoded whole by one task.  Other columns are ignored, whatever their
    names; an empty table gives an empty one."""
    from quire.llm.store import read_table

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        from quire.llm.textops import chunks

        for batch, texts in chunks(batches, "text"):
            raw = texts.cast(pa.large_binary())
            rows = [media_round_trip(x.as_buffer().to_pybytes()) for x in raw]
            cols = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
