"""Composed image preprocessing (T13): cast -> rescale -> resize -> centre crop ->
channel normalise -> output layout, in a vectorised and a native form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kiln.functions import native as nat
from kiln.functions import ndarray as nd
from kiln.spec import TensorSpec

# The ImageNet channel statistics used by the reference's Normalize step.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)

#: Values of a pixel of one byte: what becomes of them is worked out once, in a table; others are computed.
PIXELS = 256


@dataclass(frozen=True)
class Preprocess:
    """Preprocessing of an image tensor column.

    ``input``  spec of the stored image (e.g. 256x256x3 HWC int16)
    ``resize`` shorter side after bilinear resize, a (H, W) pair, or None
    ``crop``   centre-crop size (int or pair) or None
    ``scale``  None, 256.0 or 255.0 – the three pixel scalings found in the reference
    ``as_uint8`` wrap values to 0..255 before scaling
    ``layout`` output axis order ("CHW" for the model, "HWC" to keep)
    ``dtype``  output element type; float64 keeps results comparable to SQL
    """

    input: TensorSpec
    resize: int | tuple | None = 256
    crop: int | tuple | None = 224
    scale: float | None = None
    as_uint8: bool = False
    mean: tuple = field(default=IMAGENET_MEAN)
    std: tuple = field(default=IMAGENET_STD)
    layout: str = "CHW"
    dtype: str = "float32"

    def _geometry(self):
        s = self.input
        h, w = s.height, s.width
        rh, rw = nd.resized_shape(h, w, self.resize) if self.resize is not None else (h, w)
        if self.crop is not None:
            top, left, ch, cw = nd.crop_offsets(rh, rw, self.crop)
        else:
            top, left, ch, cw = 0, 0, rh, rw
        return h, w, rh, rw, top, left, ch, cw

    @property
    def output(self) -> TensorSpec:
        *_, ch, cw = self._geometry()
        return TensorSpec.image(ch, cw, self.input.channels, self.layout, self.dtype)

    # ---- vectorised -----------------------------------------------------------------
    def numpy(self, batch: np.ndarray) -> np.ndarray:
        """(n, *input.shape) -> (n, output.size) flat rows of ``dtype``.

        Arithmetic runs in the output precision (float64 for ``dtype="float64"``,
        else float32).  When the resize is the identity the crop is taken on the
        stored integers first, so only the kept pixels are converted."""
        work = np.float64 if self.dtype == "float64" else np.float32
        x = nd.permute(batch, self.input.layout, "HWC")
        h, w, rh, rw, *_ = self._geometry()
        crop_first = (rh, rw) == (h, w)
        if crop_first and self.crop is not None:
            x = nd.center_crop(x, self.crop, "HWC")
        if self.as_uint8:
            x = nd.to_uint8(x)
        x = x.astype(work)
        if self.scale is not None:
            x /= work(self.scale)
        if not crop_first:
            x = nd.resize(x, self.resize, "HWC").astype(work, copy=False)
            if self.crop is not None:
                x = nd.center_crop(x, self.crop, "HWC")
        x = nd.normalize(x, self.mean, self.std, "HWC", dtype=work)
        x = nd.permute(x, "HWC", self.layout)
        return nd.flatten(np.ascontiguousarray(x)).astype(self.output.numpy_dtype, copy=False)

    def apply_arrow(self, values, ids=None) -> np.ndarray:
        return self.numpy(nd.stack(values, self.input, ids))

    # ---- native ---------------------------------------------------------------------
    def native(self, col) -> Column:
        """Same result as ``numpy`` as one Catalyst expression (no Python worker), of one shape for all widths."""
        s = self.input
        if s.encoding != "array":
            raise ValueError("native forms need array-encoded tensors; use decode_bytes first")
        h, w, rh, rw, top, left, ch, cw = self._geometry()
        if ch > rh or cw > rw:
            raise ValueError("native preprocess does not pad; crop must fit the resized image")
        out, window = self.output, {"H": (top, ch), "W": (left, cw)}

        def read(v):
            if self.as_uint8:
                v = F.pmod(v.cast("int"), F.lit(256))
            v = v.cast("double")
            return v / F.lit(float(self.scale)) if self.scale is not None else v

        def write(v, mean, std):
            return ((v - mean) / std).cast(out.sql_type[6:-1])

        def read_all(c):
            return nat.cast(c, "float64") if self.scale is None and not self.as_uint8 else F.transform(c, read)

        channels = s.channels if max(len(self.mean), len(self.std)) > 1 else 1
        numbers = [tuple(float(x[k if len(x) > 1 else 0]) for x in (self.mean, self.std)) for k in range(channels)]

        def sql_read(v):
            v = nat.as_double(f"pmod(cast({v} as int), 256)" if self.as_uint8 else v)
            return f"({v} / {float(self.scale)!r}D)" if self.scale is not None else v

        def sql_write(v, k):
            mean, std = (float(x[k if len(x) > 1 else 0]) for x in (self.mean, self.std))
            return f"cast(({v} - {mean!r}D) / {std!r}D as {out.sql_type[6:-1]})"

        if (rh, rw) != (h, w):
            return nat.sampled(col, s, rh, rw, out.layout, window, read_all, sql_read, sql_write, numbers, write)
        if out.layout[-1] == s.layout[-1]:  # runs of elements are cut out whole
            channel = (lambda i: nat.coords(i, out.layout, out.shape)["C"]) if "C" in out.layout else (lambda i: F.lit(0))
            each = lambda v, i: write(read(v), nat.pick(self.mean, channel(i)), nat.pick(self.std, channel(i)))
            return nat.bound(col, lambda c: F.transform(nat.take(c, s, out.layout, window), each))
        element = lambda v, *k: write(read(v), *k)
        if s.dtype in ("int16", "uint8") and s.size > PIXELS:
            numbers = [(mean, std, [(p / (self.scale or 1.0) - mean) / std for p in range(PIXELS)]) for mean, std in numbers]

            def element(v, mean, std, table):
                at = F.pmod(v.cast("int"), F.lit(256)) if self.as_uint8 else v
                return F.coalesce(F.get(table, at).cast(out.sql_type[6:-1]), write(read(v), mean, std))

        return nat.bound(col, lambda c: nat.take_each(c, s, out.layout, window, numbers, element))
