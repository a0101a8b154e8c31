"""Small per-row image byte helpers (T12): decode PNG bytes to an HWC uint8 array,
and encode one, with the standard library only.  PIL is used for other formats
when it is installed.  Files on disk are better read with Spark's ``image``
source (``kiln.sources.images``), which decodes in the JVM.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

try:  # optional
    from PIL import Image as _PIL
except ImportError:  # pragma: no cover - not installed here
    _PIL = None

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # PNG colour type -> samples per pixel


class ImageDecodeError(ValueError):
    pass


def _chunks(data: bytes):
    pos = 8
    while pos + 8 <= len(data):
        length, kind = struct.unpack(">I4s", data[pos:pos + 8])
        body = data[pos + 8:pos + 8 + length]
        if len(body) != length:
            raise ImageDecodeError("truncated PNG chunk")
        yield kind, body
        pos += 12 + length


def _unfilter(raw: np.ndarray, h: int, stride: int, bpp: int) -> np.ndarray:
    out = np.zeros((h, stride), dtype=np.uint8)
    rows = raw.reshape(h, stride + 1)
    prev = np.zeros(stride, dtype=np.int32)
    for y in range(h):
        kind = rows[y, 0]
        line = rows[y, 1:].astype(np.int32)
        if kind == 0:
            cur = line
        elif kind == 2:
            cur = (line + prev) & 0xFF
        else:  # 1 sub, 3 average, 4 paeth depend on the pixel to the left: go bytewise
            cur = np.zeros(stride, dtype=np.int32)
            for i in range(stride):
                a = cur[i - bpp] if i >= bpp else 0
                b = prev[i]
                c = prev[i - bpp] if i >= bpp else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) >> 1
                elif kind == 4:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa <= pb and pa <= pc else (b if pb <= pc else c)
                else:
                    raise ImageDecodeError(f"bad PNG filter {kind}")
                cur[i] = (line[i] + p) & 0xFF
        out[y] = cur
        prev = cur
    return out


def decode_png(data: bytes) -> np.ndarray:
    """PNG bytes -> (H, W, C) uint8, C as stored (1, 2, 3 or 4).  8-bit, non-interlaced."""
    if not data or data[:8] != _SIGNATURE:
        raise ImageDecodeError("not a PNG file")
    header, idat, palette = None, [], None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
    if header is None or not idat:
        raise ImageDecodeError("PNG without header or data")
    w, h, depth, ctype, _, _, interlace = header
    if depth != 8 or interlace:
        raise ImageDecodeError("only 8-bit non-interlaced PNG is supported")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(idat)), dtype=np.uint8)
    except zlib.error as e:
        raise ImageDecodeError(f"corrupt PNG data: {e}") from None
    if ctype == 3:
        if palette is None:
            raise ImageDecodeError("palette PNG without PLTE")
        idx = _unfilter(raw, h, w, 1)
        return palette[idx]
    c = _CHANNELS.get(ctype)
    if c is None:
        raise ImageDecodeError(f"PNG colour type {ctype}")
    if raw.size != h * (w * c + 1):
        raise ImageDecodeError("PNG data length does not match its header")
    return _unfilter(raw, h, w * c, c).reshape(h, w, c)


def plain_png(data: bytes) -> np.ndarray | None:
    """The pixels of a PNG that leaves nothing to a decoder's discretion, else None: 8-bit samples, not interlaced, no palette
    and no chunks besides header, data and end, all whole with right checksums, lines as they are or as differences from
    their neighbours to the left or above."""
    if data[:8] != _SIGNATURE:
        return None
    pos, kinds, idat, header = 8, [], [], None
    while pos + 12 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + length
        if end > len(data) or zlib.crc32(data[pos + 4:end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        kinds.append(kind)
        if kind == b"IHDR" and length == 13:
            header = struct.unpack_from(">IIBBBBB", data, pos + 8)
        elif kind == b"IDAT":
            idat.append(data[pos + 8:end - 4])
        elif kind != b"IEND" or length:
            return None
        pos = end
    if pos != len(data) or header is None or not idat or kinds != [b"IHDR", *[b"IDAT"] * len(idat), b"IEND"]:
        return None
    w, h, depth, ctype, compression, filtering, interlace = header
    c = 0 if ctype == 3 else _CHANNELS.get(ctype, 0)
    if depth != 8 or compression or filtering or interlace or not 0 < h * w * c < 1 << 31:
        return None
    size, stream = h * (w * c + 1), zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(idat), size + 1)
    except zlib.error:
        return None
    if len(raw) != size or not stream.eof or stream.unused_data:
        return None
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(h, w * c + 1)
    kind, px = rows[:, 0], rows[:, 1:].reshape(h, w, c)
    if not kind.any():
        return px
    if kind.max() > 2:
        return None
    px = px.copy()
    px[kind == 1] = np.cumsum(px[kind == 1], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kind[1:] == 2) + 1:
        px[y] += px[y - 1]
    return px


def cut_png(data: bytes) -> bool:
    """A PNG that ends before its header does."""
    return data[:8] == _SIGNATURE and len(data) < 33


def decode_image(data: bytes) -> np.ndarray:
    """Image bytes -> (H, W, C) uint8; PNG natively, other formats through PIL if present."""
    if data is not None and data[:8] == _SIGNATURE:
        return decode_png(data)
    if _PIL is None:
        raise ImageDecodeError("not a PNG and PIL is not installed")
    try:
        return np.asarray(_PIL.open(io.BytesIO(data)).convert("RGB"))  # palettes, CMYK and the like
    except Exception as e:  # noqa: BLE001
        raise ImageDecodeError(str(e)) from None


def to_rgb(img: np.ndarray) -> np.ndarray:
    """Force three channels: grey is repeated, alpha is dropped."""
    if img.ndim == 2:
        img = img[:, :, None]
    c = img.shape[2]
    if c == 3:
        return img
    if c in (1, 2):
        return np.repeat(img[:, :, :1], 3, axis=2)
    return img[:, :, :3]


def encode_png(img: np.ndarray) -> bytes:
    """(H, W, C) or (H, W) uint8 -> PNG bytes (filter 0)."""
    if img.ndim == 2:
        img = img[:, :, None]
    h, w, c = img.shape
    ctype = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.astype(np.uint8).reshape(h, w * c)], axis=1)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return (_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, ctype, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))
