"""Write a one-node ONNX model (Y = X @ W) without the onnx package, for tests.

Protobuf wire format by hand: field key = (number << 3) | wire type; 0 = varint,
2 = length-delimited.  Field numbers are those of the public onnx.proto.
"""

from __future__ import annotations

import numpy as np


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _ld(field: int, data: bytes) -> bytes:
    return _varint((field << 3) | 2) + _varint(len(data)) + data


def _vi(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _tensor(name: str, arr: np.ndarray) -> bytes:  # TensorProto
    dims = b"".join(_vi(1, d) for d in arr.shape)
    return dims + _vi(2, 1) + _ld(8, name.encode()) + _ld(9, arr.astype("<f4").tobytes())


def _value_info(name: str, dims) -> bytes:  # ValueInfoProto with a float tensor type
    shape = b"".join(_ld(1, _ld(2, d.encode()) if isinstance(d, str) else _vi(1, d)) for d in dims)
    tensor_type = _vi(1, 1) + _ld(2, shape)
    return _ld(1, name.encode()) + _ld(2, _ld(1, tensor_type))


def write_matmul_model(path: str, weight: np.ndarray) -> str:
    """ONNX file computing Y[N, k] = X[N, d] @ weight[d, k]."""
    d, k = weight.shape
    node = _ld(1, b"X") + _ld(1, b"W") + _ld(2, b"Y") + _ld(3, b"matmul") + _ld(4, b"MatMul")
    graph = (_ld(1, node) + _ld(2, b"linear") + _ld(5, _tensor("W", weight))
             + _ld(11, _value_info("X", ["N", d])) + _ld(12, _value_info("Y", ["N", k])))
    model = _vi(1, 8) + _ld(8, _ld(1, b"") + _vi(2, 13)) + _ld(7, graph)
    with open(path, "wb") as f:
        f.write(model)
    return path
