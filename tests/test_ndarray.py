"""Vectorised tensor functions and batch streams (no Spark)."""

import threading
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kiln.functions import ndarray as nd
from kiln.functions.preprocess import Preprocess
from kiln.spec import TensorShapeError, TensorSpec
from kiln.streaming.batches import prefetch, rebatch, rebatch_series


def test_spec_basics():
    s = TensorSpec.image(256, 256, 3)
    assert s.size == 196608 and s.nbytes == 393216 and s.layout == "HWC"
    assert TensorSpec.from_metadata(s.metadata()) == s
    with pytest.raises(ValueError):
        TensorSpec((2, 2), "HWC")


def test_stack_arrow_zero_copy_and_errors():
    spec = TensorSpec((2, 2, 1), "HWC", "int16")
    arr = pa.array([[1, 2, 3, 4], [5, 6, 7, 8]], pa.list_(pa.int16()))
    b = nd.stack(arr, spec)
    assert b.shape == (2, 2, 2, 1) and b[1, 1, 1, 0] == 8
    assert nd.stack(arr.slice(1), spec)[0, 0, 0, 0] == 5  # sliced parent honoured
    with pytest.raises(TensorShapeError, match="null tensor"):
        nd.stack(pa.array([[1, 2, 3, 4], None], pa.list_(pa.int16())), spec, ids=[10, 11])
    with pytest.raises(TensorShapeError, match="id 11"):
        nd.stack(pa.array([[1, 2, 3, 4], [1, 2]], pa.list_(pa.int16())), spec, ids=[10, 11])
    with pytest.raises(TensorShapeError, match="null element"):
        nd.stack(pa.array([[1, 2, None, 4]], pa.list_(pa.int16())), spec)
    with pytest.raises(TensorShapeError):
        nd.stack(pd.Series([np.arange(4), np.arange(3)]), spec)
    assert nd.stack(pa.array([], pa.list_(pa.int16())), spec).shape == (0, 2, 2, 1)


def test_to_arrow_roundtrip():
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    a = nd.to_arrow(x)
    assert a.to_pylist()[1] == list(range(12, 24))


def test_permute_is_bijection():
    x = np.arange(2 * 4 * 5 * 3).reshape(2, 4, 5, 3)
    y = nd.permute(x, "HWC", "CHW")
    assert y.shape == (2, 3, 4, 5)
    assert sorted(y.reshape(-1)) == sorted(x.reshape(-1))
    assert y[1, 2, 3, 4] == x[1, 3, 4, 2]
    np.testing.assert_array_equal(nd.permute(y, "CHW", "HWC"), x)


def test_uint8_wraps():
    x = np.array([[-1, 0, 255, 256, -256, 300]], dtype=np.int16)
    assert nd.to_uint8(x).tolist() == [[255, 0, 255, 0, 0, 44]]


def test_crop_offsets_and_pad():
    assert nd.crop_offsets(256, 256, 224) == (16, 16, 224, 224)
    assert nd.crop_offsets(7, 7, 6)[:2] == (0, 0)  # round(0.5) = 0
    x = np.arange(2 * 8 * 8 * 3).reshape(2, 8, 8, 3)
    c = nd.center_crop(x, 6)
    np.testing.assert_array_equal(c, x[:, 1:7, 1:7, :])
    p = nd.center_crop(np.ones((1, 2, 2, 1)), 4)
    assert p.shape == (1, 4, 4, 1) and p.sum() == 4


def test_resize_identity_half_and_shape():
    x = np.random.default_rng(0).random((2, 8, 8, 3))
    assert nd.resize(x, 8) is x
    half = nd.resize(x, 4)
    box = x.reshape(2, 4, 2, 4, 2, 3).mean(axis=(2, 4))
    np.testing.assert_allclose(half, box, rtol=0, atol=1e-12)
    assert nd.resized_shape(256, 512, 128) == (128, 256)
    assert nd.resized_shape(300, 200, 100) == (150, 100)
    assert nd.resize(np.ones((1, 4, 6, 3)), 8).shape == (1, 8, 12, 3)
    np.testing.assert_allclose(nd.resize(np.ones((1, 4, 6, 3)), 8), 1.0)


def test_normalize_channels():
    x = np.ones((1, 2, 2, 3))
    y = nd.normalize(x, (0.5, 0.25, 0.0), (0.5, 0.25, 1.0))
    assert y[0, 0, 0].tolist() == [1.0, 3.0, 1.0]
    with pytest.raises(ValueError):
        nd.normalize(x, (0.1, 0.2), (1.0, 1.0))


def test_preprocess_full_size_shape_and_values():
    spec = TensorSpec.image(256, 256, 3)
    pre = Preprocess(spec)
    x = (np.arange(2 * spec.size) % 256).astype(np.int16).reshape(2, *spec.shape)
    out = pre.numpy(x)
    assert out.shape == (2, 3 * 224 * 224) and out.dtype == np.float32
    chw = out.reshape(2, 3, 224, 224)
    expect = (x[1, 16 + 5, 16 + 7, 2] - 0.406) / 0.225
    assert abs(chw[1, 2, 5, 7] - expect) < 1e-3
    pre64 = Preprocess(spec, dtype="float64")
    np.testing.assert_allclose(pre64.numpy(x), out, rtol=1e-5, atol=1e-3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.integers(1, 17))
def test_rebatch_keeps_rows_and_sizes(sizes, n):
    start, batches = 0, []
    for s in sizes:
        batches.append(pa.RecordBatch.from_pydict({"v": list(range(start, start + s))}))
        start += s
    out = list(rebatch(iter(batches), n))
    flat = [v for b in out for v in b.column("v").to_pylist()]
    assert flat == list(range(start))
    assert all(b.num_rows == n for b in out[:-1])
    assert not out or 0 < out[-1].num_rows <= n


@pytest.mark.parametrize("total", [0, 1, 9, 10, 11, 32])
def test_rebatch_border_sizes(total):
    """0, 1, n-1, n, n+1, 3n+2 rows with n = 10 (the reference lost the tail)."""
    b = pa.RecordBatch.from_pydict({"v": list(range(total))})
    out = list(rebatch(iter([b]), 10))
    assert sum(x.num_rows for x in out) == total
    assert len(out) == -(-total // 10)


def test_rebatch_series():
    s = [pd.Series(range(0, 7)), pd.Series(range(7, 9)), pd.Series(range(9, 25))]
    out = list(rebatch_series(iter(s), 5))
    assert [len(x) for x in out] == [5, 5, 5, 5, 5]
    assert pd.concat(out).tolist() == list(range(25))


def test_prefetch_order_errors_and_early_close():
    assert list(prefetch(iter(range(100)), 3)) == list(range(100))

    def bad():
        yield 1
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError, match="boom"):
        list(prefetch(bad(), 2))

    produced = []

    def slow():
        for i in range(1000):
            produced.append(i)
            yield i

    g = prefetch(slow(), 2)
    assert next(g) == 0
    g.close()
    time.sleep(0.2)
    assert len(produced) < 10
    assert not any(t.name == "kiln-prefetch" and t.is_alive() for t in threading.enumerate())


def test_prefetch_overlaps():
    def fetch():
        for i in range(6):
            time.sleep(0.05)
            yield i

    t0 = time.perf_counter()
    for _ in prefetch(fetch(), 2):
        time.sleep(0.05)
    overlapped = time.perf_counter() - t0
    assert overlapped < 0.55  # serial would be 0.6


def test_bytes_encoding_roundtrip():
    spec = TensorSpec((2, 3, 2), "HWC", "uint8", encoding="bytes")
    assert spec.nbytes == 12 and spec.sql_type == "binary"
    x = (np.arange(24) % 256).astype(np.uint8).reshape(2, 2, 3, 2)
    arr = nd.to_binary(x, spec.numpy_dtype)
    back = nd.stack(arr, spec)
    np.testing.assert_array_equal(back, x)
    np.testing.assert_array_equal(nd.stack(arr.slice(1), spec)[0], x[1])
    with pytest.raises(TensorShapeError, match="bytes"):
        nd.stack(pa.array([b"abc"], pa.binary()), spec)
    f32 = TensorSpec((3,), "D", "float32", encoding="bytes")
    v = np.array([[1.5, -2.0, 3.25]], dtype=np.float32)
    np.testing.assert_array_equal(nd.stack(nd.to_binary(v, f32.numpy_dtype), f32), v)


def test_rebatch_keeps_rows_that_one_batch_cannot_hold(monkeypatch):
    from kiln.streaming import batches

    class Split:  # what Arrow does beyond 2 GiB: several chunks
        def __init__(self, parts):
            self.parts = parts

        def combine_chunks(self):
            return self

        def to_batches(self):
            return self.parts

    parts = [pa.record_batch({"a": [i]}) for i in range(5)]
    monkeypatch.setattr(batches, "pa", type("P", (), {"Table": type("T", (), {"from_batches": staticmethod(Split)}), "RecordBatch": pa.RecordBatch}))
    out = list(batches.rebatch(iter(parts), 3))
    assert [x for b in out for x in b.column("a").to_pylist()] == list(range(5))


def test_valid_rows_of_slices_with_nulls():
    from kiln.operators.score import _valid_rows
    from kiln.spec import TensorSpec

    rows = [[1.0, 2.0], None, [1.0], [None, 1.0], [3.0, 4.0], [], [5.0, None], [6.0, 7.0]]
    whole, spec = pa.array(rows, pa.list_(pa.float64())), TensorSpec.vector(2)
    for lo in range(len(rows)):
        for n in range(1, len(rows) - lo + 1):
            want = [r is not None and len(r) == 2 and None not in r for r in rows[lo:lo + n]]
            assert _valid_rows(whole.slice(lo, n), spec).tolist() == want
