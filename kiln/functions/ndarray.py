"""Vectorised tensor functions: NumPy over a whole batch (axis 0 = rows).

These run inside Arrow-batched Python workers (pandas/Arrow UDFs, mapInArrow);
Spark partitions and batches the rows, NumPy does the per-batch maths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from kiln.spec import TensorShapeError, TensorSpec


def _row_label(ids, i) -> str:
    if ids is None:
        return f"row {i} of the batch"
    return f"row with id {ids[i]!r}"


def stack(values, spec: TensorSpec, ids=None) -> np.ndarray:
    """Rows of a batch -> one (n, *spec.shape) array (T1, T2, T3 reshape).

    Accepts an Arrow list array (zero-copy when it holds no nulls) or a pandas
    Series of sequences.  A null row, a null element or a wrong length raises
    ``TensorShapeError`` naming the row (or its id when ``ids`` is given).
    """
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, (pa.ListArray, pa.LargeListArray)):
        return _stack_arrow(values, spec, ids)
    if isinstance(values, (pa.BinaryArray, pa.LargeBinaryArray)):
        return _stack_binary(values, spec, ids)
    if isinstance(values, pd.Series):
        values = values.to_numpy(dtype=object)
    n = len(values)
    if n == 0:
        return np.empty((0, *spec.shape), dtype=spec.numpy_dtype)
    for i, v in enumerate(values):
        if v is None or (not hasattr(v, "__len__")):
            raise TensorShapeError(f"null tensor at {_row_label(ids, i)}")
        if len(v) != spec.size:
            raise TensorShapeError(
                f"tensor of {len(v)} values at {_row_label(ids, i)}, expected {spec.size} for {spec.shape}")
    try:
        out = np.stack(values).astype(spec.numpy_dtype, copy=False)
    except (TypeError, ValueError) as e:  # None inside a row
        raise TensorShapeError(f"null element in batch: {e}") from None
    return out.reshape(n, *spec.shape)


def _stack_arrow(arr: pa.ListArray, spec: TensorSpec, ids) -> np.ndarray:
    n = len(arr)
    if arr.null_count:
        i = int(np.flatnonzero(arr.is_null().to_numpy(zero_copy_only=False))[0])
        raise TensorShapeError(f"null tensor at {_row_label(ids, i)}")
    lengths = np.diff(arr.offsets.to_numpy())
    if n and (lengths != spec.size).any():
        i = int(np.flatnonzero(lengths != spec.size)[0])
        raise TensorShapeError(
            f"tensor of {int(lengths[i])} values at {_row_label(ids, i)}, expected {spec.size} for {spec.shape}")
    flat = arr.flatten()  # honours slicing of the parent array
    if flat.null_count:
        pos = int(np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))[0])
        raise TensorShapeError(f"null element at {_row_label(ids, pos // spec.size)}")
    return flat.to_numpy(zero_copy_only=False).astype(spec.numpy_dtype, copy=False).reshape(n, *spec.shape)


def _binary_offsets(arr) -> np.ndarray:
    odt = np.int64 if isinstance(arr, pa.LargeBinaryArray) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=odt)[arr.offset: arr.offset + len(arr) + 1]


def _stack_binary(arr, spec: TensorSpec, ids) -> np.ndarray:
    """Binary rows of ``spec.nbytes`` each -> (n, *shape) view on the Arrow data buffer."""
    spec = spec.with_(encoding="bytes")
    n = len(arr)
    if arr.null_count:
        i = int(np.flatnonzero(arr.is_null().to_numpy(zero_copy_only=False))[0])
        raise TensorShapeError(f"null tensor at {_row_label(ids, i)}")
    if n == 0:
        return np.empty((0, *spec.shape), dtype=spec.numpy_dtype)
    offs = _binary_offsets(arr)
    lengths = np.diff(offs)
    if (lengths != spec.nbytes).any():
        i = int(np.flatnonzero(lengths != spec.nbytes)[0])
        raise TensorShapeError(
            f"tensor of {int(lengths[i])} bytes at {_row_label(ids, i)}, expected {spec.nbytes} for {spec.shape}")
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[offs[0]: offs[-1]]
    return data.view(spec.numpy_dtype).reshape(n, *spec.shape)


#: Values (or bytes) that the offsets of one Arrow column can address in the types Spark takes.
MAX_VALUES = 2**31 - 1


class TooWide(ValueError):
    """More values than one Arrow batch of Spark's list or binary type can hold."""


def row_pieces(n: int, width: int, limit: int = MAX_VALUES):
    """(start, end) of runs of rows of ``width`` values that fit one Arrow batch."""
    if width > limit:
        raise TooWide(f"a row of {width} values does not fit an Arrow batch ({limit})")
    step = max(1, limit // max(1, width))
    return [(i, min(n, i + step)) for i in range(0, n, step)] or [(0, 0)]


def to_binary(batch: np.ndarray, dtype) -> pa.BinaryArray:
    """(n, ...) array -> one binary cell per row holding its little-endian values."""
    n = batch.shape[0]
    flat = np.ascontiguousarray(rows2d(batch).astype(np.dtype(dtype).newbyteorder("<"), copy=False))
    width = flat.shape[1] * flat.itemsize
    if n * width > MAX_VALUES:
        raise TooWide(f"{n} rows of {width} bytes; cut them with row_pieces")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(flat)])


def to_arrow(batch: np.ndarray, dtype=None) -> pa.ListArray:
    """(n, ...) array -> Arrow list array of flat rows (T11 flatten on the way out).

    Spark's Arrow border takes variable-size lists with 32-bit offsets only, so the fixed row width
    is expressed with offsets, and more values than they address raise ``TooWide``.
    """
    n = batch.shape[0]
    flat = np.ascontiguousarray(rows2d(batch))
    if dtype is not None:
        flat = flat.astype(dtype, copy=False)
    if flat.size > MAX_VALUES:
        raise TooWide(f"{n} rows of {flat.shape[1]} values; cut them with row_pieces")
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(flat.shape[1])), pa.array(flat.reshape(-1)))


def to_series(batch: np.ndarray) -> pd.Series:
    """(n, ...) array -> pandas Series of flat rows, for pandas UDF returns."""
    return pd.Series(list(rows2d(batch)))


def permute(batch: np.ndarray, src: str, dst: str) -> np.ndarray:
    """Reorder axes by layout letters, e.g. HWC -> CHW (T6); batch axis stays first."""
    if sorted(src) != sorted(dst):
        raise ValueError(f"cannot permute {src} to {dst}")
    order = [0] + [1 + src.index(a) for a in dst]
    return batch.transpose(order)


def to_uint8(batch: np.ndarray) -> np.ndarray:
    """C-style cast to uint8 (T5): values outside 0..255 wrap modulo 256."""
    return batch.astype(np.int64).astype(np.uint8)


def rescale(batch: np.ndarray, scale: float | None) -> np.ndarray:
    """Cast to float64 (T4) and divide by ``scale`` (T7); ``None`` keeps the values."""
    x = batch.astype(np.float64)
    return x if scale is None else x / float(scale)


def resized_shape(height: int, width: int, size: int | tuple[int, int]) -> tuple[int, int]:
    """Output (H, W) of a resize.  An int sets the shorter side and keeps the aspect
    ratio, truncating the longer side; a pair is the exact output size."""
    if not isinstance(size, int):
        return int(size[0]), int(size[1])
    if height <= width:
        return size, int(size * width / height)
    return int(size * height / width), size


def bilinear_taps(n_in: int, n_out: int):
    """Source indices and weights of half-pixel bilinear sampling along one axis
    (no antialias): src = (dst + 0.5) * n_in / n_out - 0.5, clamped at 0."""
    scale = n_in / n_out
    src = (np.arange(n_out, dtype=np.float64) + 0.5) * scale - 0.5
    src = np.maximum(src, 0.0)
    i0 = np.floor(src).astype(np.int64)
    i0 = np.minimum(i0, n_in - 1)
    i1 = np.minimum(i0 + 1, n_in - 1)
    w1 = src - i0
    w0 = 1.0 - w1
    return i0, i1, w0, w1


def resize(batch: np.ndarray, size, layout: str = "HWC") -> np.ndarray:
    """Bilinear resize (T8) of a float batch; identity when the size already matches.

    Each output value is h0*(w0*a + w1*b) + h1*(w0*c + w1*d), the same order the
    native form and the SQL oracle use.
    """
    hi, wi = 1 + layout.index("H"), 1 + layout.index("W")
    h, w = batch.shape[hi], batch.shape[wi]
    oh, ow = resized_shape(h, w, size)
    if (oh, ow) == (h, w):
        return batch
    x = np.moveaxis(batch, (hi, wi), (1, 2)).astype(np.float64)  # n, H, W, rest...
    hy0, hy1, hw0, hw1 = bilinear_taps(h, oh)
    wx0, wx1, ww0, ww1 = bilinear_taps(w, ow)
    extra = (1,) * (x.ndim - 3)
    ww0 = ww0.reshape(1, 1, ow, *extra)
    ww1 = ww1.reshape(1, 1, ow, *extra)
    top = ww0 * x[:, hy0][:, :, wx0] + ww1 * x[:, hy0][:, :, wx1]
    bot = ww0 * x[:, hy1][:, :, wx0] + ww1 * x[:, hy1][:, :, wx1]
    out = hw0.reshape(1, oh, 1, *extra) * top + hw1.reshape(1, oh, 1, *extra) * bot
    return np.moveaxis(out, (1, 2), (hi, wi))


def crop_offsets(height: int, width: int, crop) -> tuple[int, int, int, int]:
    """(top, left, crop_h, crop_w) of a centre crop; top = round((H - h) / 2)."""
    ch, cw = (crop, crop) if isinstance(crop, int) else (int(crop[0]), int(crop[1]))
    return int(round((height - ch) / 2.0)), int(round((width - cw) / 2.0)), ch, cw


def center_crop(batch: np.ndarray, crop, layout: str = "HWC") -> np.ndarray:
    """Centre crop (T9).  A crop larger than the image pads with zeros first."""
    hi, wi = 1 + layout.index("H"), 1 + layout.index("W")
    h, w = batch.shape[hi], batch.shape[wi]
    ch, cw = (crop, crop) if isinstance(crop, int) else crop
    if ch > h or cw > w:
        pad = [(0, 0)] * batch.ndim
        ph, pw = max(ch - h, 0), max(cw - w, 0)
        pad[hi] = (ph // 2, (ph + 1) // 2)
        pad[wi] = (pw // 2, (pw + 1) // 2)
        batch = np.pad(batch, pad)
        h, w = batch.shape[hi], batch.shape[wi]
    top, left, ch, cw = crop_offsets(h, w, (ch, cw))
    index = [slice(None)] * batch.ndim
    index[hi] = slice(top, top + ch)
    index[wi] = slice(left, left + cw)
    return batch[tuple(index)]


def normalize(batch: np.ndarray, mean, std, layout: str = "HWC", dtype=np.float64) -> np.ndarray:
    """(x - mean[c]) / std[c] along the channel axis (T10).  One value applies to
    every channel."""
    ci = 1 + layout.index("C")
    c = batch.shape[ci]
    mean = np.asarray(mean, dtype=dtype)
    std = np.asarray(std, dtype=dtype)
    if mean.size == 1:
        mean = np.repeat(mean, c)
    if std.size == 1:
        std = np.repeat(std, c)
    if mean.size != c or std.size != c:
        raise ValueError(f"{mean.size} means / {std.size} stds for {c} channels")
    shape = [1] * batch.ndim
    shape[ci] = c
    if batch.dtype == dtype and batch.flags.writeable and batch.flags.owndata:
        batch -= mean.reshape(shape)
        batch /= std.reshape(shape)
        return batch
    return (batch - mean.reshape(shape)) / std.reshape(shape)


def rows2d(batch: np.ndarray) -> np.ndarray:
    """(n, ...) -> (n, d); also for n = 0, where reshape(0, -1) is ambiguous."""
    return batch.reshape(batch.shape[0], int(np.prod(batch.shape[1:], dtype=np.int64)))


def flatten(batch: np.ndarray) -> np.ndarray:
    """(n, ...) -> (n, d)."""
    return rows2d(batch)
