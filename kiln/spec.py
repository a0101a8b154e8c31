"""Tensor description carried next to a flat array column.

Spark has no tensor type, so a tensor column is a flat ``array<short|float|double>``
plus a ``TensorSpec`` (shape, axis layout, element dtype).  The spec travels in
the column metadata, so a later job that reads a persisted table still knows the
shape without hardcoding it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META_KEY = "kiln.tensor"

_SPARK_ELEMENT = {
    "uint8": T.ShortType(),  # Spark bytes are signed, so 0..255 lives in a short
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
}
_SQL_ELEMENT = {
    "uint8": "short",
    "int16": "short",
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
}
# numpy dtype used on the Arrow border for each spec dtype (uint8 travels as int16)
_WIRE = {"uint8": np.int16, "int16": np.int16, "int32": np.int32, "int64": np.int64,
         "float32": np.float32, "float64": np.float64}


class TensorShapeError(ValueError):
    """A row does not match its TensorSpec (null, wrong length, null element)."""


ENCODINGS = ("array", "bytes")


@dataclass(frozen=True)
class TensorSpec:
    """``encoding="array"`` stores a row as ``array<...>``; ``"bytes"`` stores the
    row-major little-endian values of ``dtype`` in one ``binary`` cell, which
    crosses the JVM/Python border as one buffer (about 3x faster for images)."""

    shape: tuple[int, ...]
    layout: str = "HWC"
    dtype: str = "int16"
    encoding: str = "array"

    def __post_init__(self):
        object.__setattr__(self, "shape", tuple(int(s) for s in self.shape))
        if len(self.layout) != len(self.shape):
            raise ValueError(f"layout {self.layout!r} does not match shape {self.shape}")
        if len(set(self.layout)) != len(self.layout):
            raise ValueError(f"layout {self.layout!r} repeats an axis")
        if self.dtype not in _SPARK_ELEMENT:
            raise ValueError(f"dtype {self.dtype!r} not one of {sorted(_SPARK_ELEMENT)}")
        if any(s <= 0 for s in self.shape):
            raise ValueError(f"shape {self.shape} has a non-positive axis")
        if self.encoding not in ENCODINGS:
            raise ValueError(f"encoding {self.encoding!r} not one of {ENCODINGS}")

    @classmethod
    def image(cls, height: int, width: int, channels: int = 3, layout: str = "HWC",
              dtype: str = "int16") -> "TensorSpec":
        dims = {"H": height, "W": width, "C": channels}
        return cls(tuple(dims[a] for a in layout), layout, dtype)

    @classmethod
    def vector(cls, n: int, dtype: str = "float32") -> "TensorSpec":
        return cls((n,), "D", dtype)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def itemsize(self) -> int:
        return self.numpy_dtype.itemsize

    @property
    def nbytes(self) -> int:
        """Bytes of one row's values on the Arrow border."""
        return self.size * self.itemsize

    def dim(self, axis: str) -> int:
        return self.shape[self.layout.index(axis)]

    @property
    def height(self) -> int:
        return self.dim("H")

    @property
    def width(self) -> int:
        return self.dim("W")

    @property
    def channels(self) -> int:
        return self.dim("C") if "C" in self.layout else 1

    @property
    def numpy_dtype(self):
        """Element type on the Arrow border (uint8 travels as int16 in arrays)."""
        if self.encoding == "bytes":
            return np.dtype(self.dtype).newbyteorder("<")
        return np.dtype(_WIRE[self.dtype])

    @property
    def element_type(self) -> T.DataType:
        return _SPARK_ELEMENT[self.dtype]

    @property
    def spark_type(self) -> T.DataType:
        if self.encoding == "bytes":
            return T.BinaryType()
        return T.ArrayType(self.element_type, containsNull=False)

    @property
    def sql_type(self) -> str:
        if self.encoding == "bytes":
            return "binary"
        return f"array<{_SQL_ELEMENT[self.dtype]}>"

    def with_(self, **kw) -> "TensorSpec":
        return replace(self, **kw)

    def metadata(self) -> dict:
        return {META_KEY: {"shape": list(self.shape), "layout": self.layout, "dtype": self.dtype,
                           "encoding": self.encoding}}

    def tag(self, col: Column | str, name: str) -> Column:
        """Alias ``col`` as ``name`` and record this spec in the column metadata."""
        c = F.col(col) if isinstance(col, str) else col
        return c.alias(name, metadata=self.metadata())

    @classmethod
    def from_metadata(cls, meta: dict) -> "TensorSpec | None":
        m = (meta or {}).get(META_KEY)
        if not m:
            return None
        return cls(tuple(m["shape"]), m["layout"], m["dtype"], m.get("encoding", "array"))

    @classmethod
    def of(cls, df: DataFrame, column: str) -> "TensorSpec | None":
        """Spec recorded on ``df[column]``, or None."""
        return cls.from_metadata(df.schema[column].metadata)


def spec_of(df: DataFrame, column: str, spec: TensorSpec | None) -> TensorSpec:
    """Explicit spec wins; else the one in the column metadata; else an error."""
    found = spec or TensorSpec.of(df, column)
    if found is None:
        raise ValueError(f"column {column!r} has no tensor spec; pass spec=TensorSpec(...)")
    return found


def valid_tensor(col: Column | str, spec: TensorSpec) -> Column:
    """Native row check: not null, exact length, no null element."""
    c = F.col(col) if isinstance(col, str) else col
    if spec.encoding == "bytes":
        return (c.isNotNull() & (F.length(c) == F.lit(spec.nbytes))).alias("valid")
    return (c.isNotNull() & (F.size(c) == F.lit(spec.size))
            & F.forall(c, lambda x: x.isNotNull())).alias("valid")
