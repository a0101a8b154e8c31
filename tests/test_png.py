"""Image byte helpers (T12), including every PNG filter type."""

import struct
import zlib

import numpy as np
import pytest

from kiln.functions.png import ImageDecodeError, decode_image, decode_png, encode_png, to_rgb


def _paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else (b if pb <= pc else c)


def _encode_filtered(img: np.ndarray, kinds) -> bytes:
    """PNG with a chosen filter per row (test-side encoder)."""
    h, w, c = img.shape
    rows = img.reshape(h, w * c).astype(np.int32)
    out = bytearray()
    prev = np.zeros(w * c, np.int32)
    for y in range(h):
        k = kinds[y % len(kinds)]
        cur = rows[y]
        f = np.zeros_like(cur)
        for i in range(w * c):
            a = cur[i - c] if i >= c else 0
            b = prev[i]
            cc = prev[i - c] if i >= c else 0
            pred = [0, a, b, (a + b) >> 1, _paeth(a, b, cc)][k]
            f[i] = (cur[i] - pred) & 0xFF
        out.append(k)
        out += bytes(f.astype(np.uint8))
        prev = cur

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    ctype = {1: 0, 3: 2, 4: 6}[c]
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, ctype, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b""))


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_all_filters(channels):
    rng = np.random.default_rng(channels)
    img = rng.integers(0, 256, size=(7, 5, channels), dtype=np.uint8)
    data = _encode_filtered(img, [0, 1, 2, 3, 4])
    np.testing.assert_array_equal(decode_png(data), img)


def test_roundtrip_and_rgb():
    img = (np.arange(4 * 6 * 3) % 256).astype(np.uint8).reshape(4, 6, 3)
    np.testing.assert_array_equal(decode_image(encode_png(img)), img)
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rgb = to_rgb(decode_png(encode_png(grey)))
    assert rgb.shape == (3, 4, 3) and (rgb[..., 0] == grey).all() and (rgb[..., 2] == grey).all()
    rgba = np.zeros((2, 2, 4), np.uint8)
    assert to_rgb(rgba).shape == (2, 2, 3)


def test_corrupt():
    with pytest.raises(ImageDecodeError):
        decode_png(b"not a png at all")
    good = encode_png(np.zeros((2, 2, 3), np.uint8))
    with pytest.raises(ImageDecodeError):
        decode_png(good[:30] + b"\x00" * 10 + good[40:])
