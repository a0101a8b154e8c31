"""Batched scoring of tensor columns.

Three shapes, all narrow (no shuffle, one Python node per plan):

* ``tensor_udf`` / ``predict_udf`` – a column expression (pandas or Arrow UDF,
  scalar or iterator), for ``select`` / ``withColumn``;
* ``map_tensor`` / ``predict_map`` – ``mapInArrow`` over whole record batches,
  carrying the key columns through; exact model batches and prefetch live here;
* ``map_batches`` – user function or class over numpy / pandas / Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import ndarray as nd
from kiln.models import ModelHandle, ModelOutputError
from kiln.spec import TensorShapeError, TensorSpec, spec_of
from kiln.streaming.batches import prefetch as _prefetch
from kiln.streaming.batches import rebatch as _rebatch
from kiln.streaming.batches import rebatch_arrays, rebatch_series

_SQL_FLOAT = {"float32": T.FloatType(), "float64": T.DoubleType()}


def _partition() -> str:
    from pyspark import TaskContext

    tc = TaskContext.get()
    return f"partition {tc.partitionId()}" if tc is not None else "driver"


def checked_predict(model, batch: np.ndarray) -> np.ndarray:
    """Run the model and check it returned one row per input row (I8)."""
    if batch.shape[0] == 0:
        return np.zeros((0, 0))
    out = np.asarray(model.predict(batch))
    if out.ndim == 1:
        out = out.reshape(batch.shape[0], -1) if batch.shape[0] else out.reshape(0, 0)
    if out.shape[0] != batch.shape[0]:
        raise ModelOutputError(
            f"model returned {out.shape[0]} rows for a batch of {batch.shape[0]} in {_partition()}")
    return out


def _chunks(batch: np.ndarray, size: int | None):
    if not size or batch.shape[0] <= size:
        yield batch
        return
    for i in range(0, batch.shape[0], size):
        yield batch[i:i + size]


def _run(fn, batch: np.ndarray, size: int | None) -> np.ndarray:
    parts = [fn(b) for b in _chunks(batch, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _valid_rows(arr: pa.ListArray, spec: TensorSpec) -> np.ndarray:
    ok = ~arr.is_null().to_numpy(zero_copy_only=False)
    if isinstance(arr, (pa.BinaryArray, pa.LargeBinaryArray)):
        return ok & (np.diff(nd._binary_offsets(arr)) == spec.nbytes)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(arr), 0))
    ok &= lengths == spec.size
    flat = arr.flatten()  # without the values of null rows, and of this slice only
    if flat.null_count:
        ok[np.repeat(np.arange(len(arr)), lengths)[np.asarray(flat.is_null())]] = False
    return ok


def _apply_pieces(values: pa.Array, spec: TensorSpec, fn, out_dtype, size, on_invalid, ids=None, to=nd.to_arrow, limit: int = nd.MAX_VALUES):
    """(start, end, Arrow column) of runs of rows: one Arrow tensor column in, the same rows out (lists, or binary cells
    with ``to=nd.to_binary``), in several arrays where one would hold more than ``limit`` values."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    n, cell = len(values), np.dtype(out_dtype).itemsize if to is nd.to_binary else 1
    ok = _valid_rows(values, spec) if on_invalid == "null" else None
    if ok is None or ok.all():
        out = nd.rows2d(_run(fn, nd.stack(values, spec, ids), size))
        for lo, hi in nd.row_pieces(n, out.shape[1] * cell, limit):
            yield lo, hi, to(out[lo:hi], out_dtype)
        return
    if not ok.any():
        yield 0, n, pa.nulls(n, pa.binary() if to is nd.to_binary else pa.list_(pa.from_numpy_dtype(np.dtype(out_dtype))))
        return
    good = nd.rows2d(_run(fn, nd.stack(values.filter(pa.array(ok)), spec), size))
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(ok)])
    for lo, hi in nd.row_pieces(n, good.shape[1] * cell, limit):
        part, on = to(good[before[lo]:before[hi]], out_dtype), ok[lo:hi]
        if not len(part):
            yield lo, hi, pa.nulls(hi - lo, part.type)
            continue
        # rows that failed validation get a null
        taken = part.take(pa.array(np.where(on, np.cumsum(on) - 1, 0)))
        yield lo, hi, pc.if_else(pa.array(on), taken, pa.nulls(hi - lo, taken.type))


def _apply_arrow(values: pa.Array, spec: TensorSpec, fn, out_dtype, size, on_invalid, ids=None, to=nd.to_arrow) -> pa.Array:
    """One Arrow tensor column in, one out, same length."""
    parts = [x for _, _, x in _apply_pieces(values, spec, fn, out_dtype, size, on_invalid, ids, to)]
    if len(parts) > 1:
        raise nd.TooWide("the output does not fit one Arrow batch; use an iterator form or smaller batches")
    return parts[0]


# ---- column expressions (U1, U2, I1, I2) --------------------------------------------------

def tensor_udf(fn: Callable[[np.ndarray], np.ndarray], spec: TensorSpec, out_dtype: str = "float32",
               form: str = "iterator", flavor: str = "pandas", batch_size: int | None = None,
               depth: int = 0, on_invalid: str = "raise", setup: Callable[[], Callable] | None = None):
    """Wrap a batch function ``(n, *spec.shape) -> (n, d)`` as a vectorised UDF.

    ``form``   "scalar" (one call per Arrow batch, U1) or "iterator" (one call per
               partition, U2: ``setup`` runs once and returns the batch function)
    ``flavor`` "pandas" (``pandas_udf``, the reference's form) or "arrow"
               (``arrow_udf``: no pandas conversion)
    ``batch_size`` the iterator form calls the function with exactly this many rows (B2), whatever the Arrow
               batches are: rows are held over their borders, and only a partition's last call sees fewer.
               The scalar form must answer batch by batch, so there it is an upper bound
    ``depth``  prefetch depth for the iterator form (B7)
    ``on_invalid`` "raise" (error naming the partition) or "null" (null output row)
    """
    rtype = T.ArrayType(_SQL_FLOAT.get(out_dtype, TensorSpec((1,), "D", out_dtype).element_type), False)
    np_out = TensorSpec((1,), "D", out_dtype).numpy_dtype

    def get_fn():
        return setup() if setup is not None else fn

    if flavor == "arrow":
        if form == "scalar":
            def scalar_a(v: pa.Array) -> pa.Array:
                return _apply_arrow(v, spec, get_fn(), np_out, batch_size, on_invalid)

            return F.arrow_udf(scalar_a, rtype)

        def iter_a(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = get_fn()
            for v in _prefetch(rebatch_arrays(it, batch_size) if batch_size else it, depth):
                for _, _, out in _apply_pieces(v, spec, f, np_out, None, on_invalid):
                    yield out

        return F.arrow_udf(iter_a, rtype)

    in_type = pa.binary() if spec.encoding == "bytes" else pa.list_(pa.from_numpy_dtype(spec.numpy_dtype))

    def arrow(s: pd.Series) -> pa.Array:
        return pa.array(s, type=in_type, from_pandas=True)

    if form == "scalar":
        def scalar_p(s: pd.Series) -> pd.Series:
            return _apply_arrow(arrow(s), spec, get_fn(), np_out, batch_size, on_invalid).to_pandas()

        return F.pandas_udf(scalar_p, rtype)

    def iter_p(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = get_fn()
        for s in _prefetch(rebatch_series(it, batch_size) if batch_size else it, depth):
            for _, _, out in _apply_pieces(arrow(s), spec, f, np_out, None, on_invalid):
                yield out.to_pandas()

    return F.pandas_udf(iter_p, rtype)


def predict_udf(handle: ModelHandle, spec: TensorSpec, reuse: str = "partition", dtype: str = "float32",
                preprocess=None, **kw):
    """UDF that scores a tensor column with ``handle``'s model.

    ``reuse="batch"`` rebuilds the model for every batch (I1, the slow baseline);
    ``"partition"`` takes it from the worker memo once per call of the iterator
    (I2).  With ``preprocess`` the UDF is fused (I6): the preprocessed tensor
    never leaves the Python worker.
    """
    pre = preprocess.numpy if preprocess is not None else None

    def make(model):
        if pre is None:
            return lambda b: checked_predict(model, b)
        return lambda b: checked_predict(model, pre(b))

    if reuse == "batch":
        form = kw.pop("form", "scalar")
        return tensor_udf(None, spec, dtype, form=form, setup=lambda: make(handle.build()), **kw)
    if reuse != "partition":
        raise ValueError("reuse must be 'batch' or 'partition'")
    form = kw.pop("form", "iterator")
    return tensor_udf(None, spec, dtype, form=form, setup=lambda: make(handle.get()), **kw)


def preprocess_udf(preprocess, form: str = "iterator", flavor: str = "pandas", **kw):
    """UDF form of ``Preprocess.numpy`` (T13 vectorised)."""
    return tensor_udf(preprocess.numpy, preprocess.input, preprocess.output.dtype, form=form, flavor=flavor, **kw)


# ---- mapInArrow (U3, U5, I6) -----------------------------------------------------------

def _out_schema(df: DataFrame, keep: list[str], output: str, out_type: T.DataType) -> T.StructType:
    fields = [df.schema[c] for c in keep]
    return T.StructType(fields + [T.StructField(output, out_type, True)])


def map_tensor(df: DataFrame, column: str, fn: Callable[[np.ndarray], np.ndarray],
               out_dtype: str = "float32", output: str = "tensor", keep: list[str] | None = None,
               spec: TensorSpec | None = None, out_spec: TensorSpec | None = None,
               batch_size: int | None = None, depth: int = 0, on_invalid: str = "raise",
               setup: Callable[[], Callable] | None = None, profile=None, max_values: int = nd.MAX_VALUES) -> DataFrame:
    """Apply a vectorised batch function to ``column`` with ``mapInArrow``.

    ``keep`` columns are carried through unchanged (default: all others).
    ``batch_size`` makes model batches of exactly that many rows (B2), whatever
    the Arrow transport batches are; ``depth`` overlaps reading with compute (B7).
    ``profile`` runs the map under a stage-level ResourceProfile (B6); the input
    must then come out of a shuffle (see ``resources.profiled``).
    """
    spec = spec_of(df, column, spec)
    keep = [c for c in df.columns if c != column] if keep is None else list(keep)
    out_elem = out_spec.element_type if out_spec else TensorSpec((1,), "D", out_dtype).element_type
    np_out = out_spec.numpy_dtype if out_spec else TensorSpec((1,), "D", out_dtype).numpy_dtype
    as_bytes = out_spec is not None and out_spec.encoding == "bytes"
    out_type = T.BinaryType() if as_bytes else T.ArrayType(out_elem, False)
    schema = _out_schema(df, keep, output, out_type)
    names = keep + [output]
    id_col = keep[0] if keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup() if setup is not None else fn
        stream = batches if not batch_size else _rebatch(batches, batch_size)
        for b in _prefetch(stream, depth):
            vals = b.column(column)
            try:
                for lo, hi, out in _apply_pieces(vals, spec, f, np_out, None, on_invalid, None, nd.to_binary if as_bytes else nd.to_arrow, max_values):
                    yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, hi - lo) for c in keep] + [out], names=names)
            except TensorShapeError as e:
                msg = str(e)
                if id_col:  # name the row by its key; ids are only read on the error path
                    try:
                        nd.stack(vals, spec, b.column(id_col).to_pylist())
                    except TensorShapeError as named:
                        msg = str(named)
                raise TensorShapeError(f"{msg} ({_partition()})") from None

    src = df.select(*keep, column)
    out_df = src.mapInArrow(run, schema) if profile is None else src.mapInArrow(run, schema, profile=profile)
    if out_spec is not None:
        out_df = out_df.withColumn(output, out_spec.tag(output, output))
    return out_df


def predict_map(df: DataFrame, handle: ModelHandle, column: str, spec: TensorSpec | None = None,
                preprocess=None, output: str = "prediction", keep: list[str] | None = None,
                dtype: str = "float32", batch_size: int | None = None, depth: int = 0,
                reuse: str = "partition", on_invalid: str = "raise", profile=None) -> DataFrame:
    """Score ``column`` in ``mapInArrow``; with ``preprocess`` this is the fused
    pipeline (I6).  Keys in ``keep`` come out next to the prediction."""
    spec = spec_of(df, column, spec)
    pre = preprocess.numpy if preprocess is not None else None

    def setup():
        model = handle.get() if reuse == "partition" else None

        def f(b):
            m = model if model is not None else handle.build()
            return checked_predict(m, pre(b) if pre is not None else b)

        return f

    return map_tensor(df, column, None, dtype, output, keep, spec, None, batch_size, depth, on_invalid, setup,
                      profile)


def map_batches(df: DataFrame, fn, schema, batch_format: str = "numpy", batch_size: int | None = None,
                fn_constructor_kwargs: dict | None = None, depth: int = 0) -> DataFrame:
    """Run ``fn`` over record batches (U3) as dicts of arrays, DataFrames or Arrow.

    ``fn`` takes and returns a batch in ``batch_format``: "numpy" (dict of column
    name -> ndarray; list columns become 2-d arrays when their rows have one
    length), "pandas" or "arrow".  If ``fn`` is a class it is built once per task
    with ``fn_constructor_kwargs`` and then called per batch (U4).
    ``batch_size`` sets exact batch sizes (B2).
    """
    schema_t = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = [f.name for f in schema_t.fields]

    def to_fmt(b: pa.RecordBatch):
        if batch_format == "arrow":
            return b
        if batch_format == "pandas":
            return b.to_pandas()
        out = {}
        for name, col in zip(b.schema.names, b.columns):
            if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
                lengths = np.diff(col.offsets.to_numpy())
                if len(col) and col.null_count == 0 and (lengths == lengths[0]).all():
                    out[name] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), int(lengths[0]))
                    continue
            out[name] = col.to_numpy(zero_copy_only=False)
        return out

    def from_fmt(x) -> pa.RecordBatch:
        if isinstance(x, pa.RecordBatch):
            return x
        if isinstance(x, pd.DataFrame):
            return pa.RecordBatch.from_pandas(x[names], preserve_index=False)
        arrays = []
        for f in schema_t.fields:
            v = x[f.name]
            if isinstance(v, np.ndarray) and v.ndim >= 2:
                arrays.append(nd.to_arrow(v))
            else:
                arrays.append(pa.array(v))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fn(**(fn_constructor_kwargs or {})) if isinstance(fn, type) else fn
        stream = batches if not batch_size else _rebatch(batches, batch_size)
        for b in _prefetch(stream, depth):
            out = from_fmt(f(to_fmt(b)))
            yield out.cast(pa.schema([out.schema.field(i).with_type(t) for i, t in
                                      enumerate(_arrow_types(schema_t))])) if _needs_cast(out, schema_t) else out

    return df.mapInArrow(run, schema_t)


def _arrow_types(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _needs_cast(b: pa.RecordBatch, schema: T.StructType) -> bool:
    return [f.type for f in b.schema] != _arrow_types(schema)


def encode_bytes(df: DataFrame, column: str, spec: TensorSpec | None = None, dtype: str | None = None,
                 output: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Array-encoded tensor column -> bytes-encoded (optionally narrowing ``dtype``,
    e.g. int16 pixels to uint8; values that do not fit raise rather than wrap)."""
    spec = spec_of(df, column, spec)
    target = spec.with_(encoding="bytes", dtype=dtype or spec.dtype)
    info = np.iinfo(target.numpy_dtype) if target.numpy_dtype.kind in "iu" else None

    def fn(b):
        if info is not None and b.size and (b.min() < info.min or b.max() > info.max):
            raise ValueError(f"values outside {target.dtype} range in {_partition()}")
        return b

    return map_tensor(df, column, fn, output=output or column, keep=keep, spec=spec, out_spec=target)


def decode_bytes(df: DataFrame, column: str, spec: TensorSpec | None = None, dtype: str | None = None,
                 output: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Bytes-encoded tensor column -> ``array<...>`` (for native operators)."""
    spec = spec_of(df, column, spec)
    target = spec.with_(encoding="array", dtype=dtype or ("int16" if spec.dtype == "uint8" else spec.dtype))
    return map_tensor(df, column, lambda b: b, output=output or column, keep=keep, spec=spec, out_spec=target)


def named_prediction(df: DataFrame, handle: ModelHandle, column: str, spec: TensorSpec | None = None,
                     keep: list[str] | None = None, **kw) -> DataFrame:
    """I4: one request's payload scored into a column called ``predictions``."""
    return predict_map(df, handle, column, spec, output="predictions", keep=keep, **kw)


# ---- images of different sizes (S3 -> T8/T9/T10 -> I4) -----------------------------------

def map_images(df: DataFrame, preprocess, column: str = "image", height: str = "height", width: str = "width",
               handle: ModelHandle | None = None, output: str | None = None, keep: list[str] | None = None,
               dtype: str | None = None, on_invalid: str = "raise", channels: str | None = None,
               bgr: bool = False) -> DataFrame:
    """Preprocess (and with ``handle``, score) rows whose images differ in size, as
    decoded files do.  Each Arrow batch is grouped by size; every group runs
    ``preprocess`` with its own input size, so resize + centre crop bring all rows
    to one output shape.  Row order is kept.  Rows with a null image get a null
    output with ``on_invalid="null"``.

    ``column`` is either an RGB HWC array (as ``read_image_files`` returns) or the
    raw pixel bytes of the JVM ``image`` source (``read_image_files(raw=True)``):
    then name the ``channels`` column and set ``bgr=True``; grey is repeated to
    three channels, alpha dropped, and decode → preprocess → model is one Python
    step with no intermediate hand-back to the JVM."""
    from dataclasses import replace

    drop = {column, height, width} | ({channels} if channels else set())
    keep = [c for c in df.columns if c not in drop] if keep is None else list(keep)
    output = output or ("prediction" if handle is not None else "tensor")
    out_dtype = dtype or ("float32" if handle is not None else preprocess.output.dtype)
    np_out = TensorSpec((1,), "D", out_dtype).numpy_dtype
    schema = _out_schema(df, keep, output, T.ArrayType(TensorSpec((1,), "D", out_dtype).element_type, False))
    base = preprocess.input
    names = keep + [output]
    extra = [channels] if channels else []

    def rgb(px: np.ndarray) -> np.ndarray:
        c = px.shape[-1]
        if c >= 3:
            return px[..., [2, 1, 0]] if bgr else px[..., :3]
        return np.repeat(px[..., :1], 3, axis=-1)

    def run(batches):
        model = handle.get() if handle is not None else None
        for b in batches:
            hs = b.column(height).to_numpy(zero_copy_only=False)
            ws = b.column(width).to_numpy(zero_copy_only=False)
            cs = b.column(channels).to_numpy(zero_copy_only=False) if channels else np.full(b.num_rows, 3)
            vals = b.column(column)
            raw = pa.types.is_binary(vals.type) or pa.types.is_large_binary(vals.type)
            n = b.num_rows
            ok = ~(vals.is_null().to_numpy(zero_copy_only=False) | np.isnan(hs.astype(float))
                   | np.isnan(ws.astype(float)) | np.isnan(cs.astype(float)))
            ok &= np.where(ok, hs.astype(float) > 0, False)  # the JVM source marks undecodable files with -1
            if not ok.all() and on_invalid != "null":
                raise TensorShapeError(f"null or undecodable image in {_partition()}")
            parts: list = [None] * n
            dense = None  # one (n, d) matrix when every row is valid and widths agree
            for h, w, c in {(int(h), int(w), int(c)) for h, w, c, k in zip(hs, ws, cs, ok) if k}:
                idx = np.flatnonzero(ok & (hs == h) & (ws == w) & (cs == c))
                sub = vals.take(pa.array(idx))
                if raw:
                    px = rgb(nd.stack(sub, TensorSpec((h, w, c), "HWC", "uint8", encoding="bytes")))
                else:
                    px = nd.stack(sub, TensorSpec((h, w, 3), "HWC", base.dtype))
                spec = base.with_(shape=tuple({"H": h, "W": w}.get(a, base.dim(a)) for a in base.layout),
                                  encoding="array")
                x = replace(preprocess, input=spec).numpy(nd.permute(px, "HWC", spec.layout))
                if model is not None:
                    x = checked_predict(model, x)
                x = nd.rows2d(x).astype(np_out, copy=False)
                if ok.all() and (dense is None or dense.shape[1] == x.shape[1]):
                    if dense is None:
                        dense = np.empty((n, x.shape[1]), dtype=np_out)
                    dense[idx] = x
                    continue
                if dense is not None:  # widths differ: fall back to per-row lists; rows of groups
                    parts = list(dense)  # not seen yet are overwritten when their group comes
                    dense = None
                for j, row in zip(idx, x):
                    parts[j] = row
            if dense is not None:
                col = nd.to_arrow(dense)
            else:
                col = pa.array(parts, pa.list_(pa.from_numpy_dtype(np_out)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [col], names=names)

    return df.select(*keep, height, width, *extra, column).mapInArrow(run, schema)
