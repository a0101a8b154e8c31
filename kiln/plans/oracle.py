"""DuckDB SQL that computes the same values as the Spark queries – the
correctness oracle.  Builders mirror the native forms expression by expression
(same arithmetic order, literals cast to DOUBLE), so results agree exactly
after rounding.
"""

from __future__ import annotations

from kiln.functions.preprocess import Preprocess
from kiln.spec import TensorSpec

# Fixed values, worked out by hand and not by the engine, so that a wrong shape there cannot pass here.
# (height, width, size) -> shape after a resize: the shorter side becomes size, the longer keeps the ratio, cut down
RESIZED = {
    (8, 8, 8): (8, 8), (8, 8, 4): (4, 4), (8, 8, 6): (6, 6), (8, 8, 10): (10, 10),
    (256, 256, 224): (224, 224), (256, 256, 230): (230, 230), (256, 256, 256): (256, 256),
    (6, 6, 8): (8, 8), (6, 8, 8): (8, 10), (6, 10, 8): (8, 13), (6, 12, 8): (8, 16),
    (8, 6, 8): (10, 8), (8, 10, 8): (8, 10), (8, 12, 8): (8, 12),
    (10, 6, 8): (13, 8), (10, 8, 8): (10, 8), (10, 10, 8): (8, 8), (10, 12, 8): (8, 9),
}
# (height, width, crop) -> top and left of a centre crop; halves go to the even number
CROPPED = {
    (4, 4, 2): (1, 1), (8, 8, 6): (1, 1), (10, 10, 8): (1, 1), (256, 256, 224): (16, 16), (230, 230, 224): (3, 3),
    (8, 8, 8): (0, 0), (8, 10, 8): (0, 1), (8, 13, 8): (0, 2), (8, 16, 8): (0, 4), (8, 12, 8): (0, 2), (8, 9, 8): (0, 0),
    (10, 8, 8): (1, 0), (13, 8, 8): (2, 0),
}


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def rnd(expr: str, digits: int) -> str:
    """round() that never yields -0.0 (Spark's round gives +0.0 there)."""
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"


def over(n: int, body, var: str = "i") -> str:
    return f"list_transform(range({n}), lambda {var}: {body(var)})"


def coords(i: str, layout: str, shape) -> dict[str, str]:
    out, stride, total = {}, 1, 1
    for s in shape:
        total *= s
    for axis, dim in reversed(list(zip(layout, shape))):
        q = i if stride == 1 else f"({i} // {stride})"
        out[axis] = q if stride * dim == total else f"({q} % {dim})"
        stride *= dim
    return out


def flat(at: dict[str, str], layout: str, shape) -> str:
    idx = None
    for axis, dim in zip(layout, shape):
        idx = at[axis] if idx is None else f"({idx} * {dim} + {at[axis]})"
    return idx


def pick(values, idx: str) -> str:
    if len(values) == 1:
        return dbl(values[0])
    return "[" + ", ".join(dbl(v) for v in values) + f"][({idx}) + 1]"


# ---- inputs -----------------------------------------------------------------------------

def gen_pixel(idx: str, key: str = "o_orderkey", mult: int = 31, step: int = 7, mod: int = 256,
              shift: int = 0) -> str:
    s = f"(({key} * {mult} + ({idx}) * {step}) % {mod})"
    return f"({s} - {shift})" if shift else s


def f2(idx: str) -> str:
    return gen_pixel(idx)


def f2_image(mod: int = 256, shift: int = 0, key: str = "o_orderkey", mult: int = 31, step: int = 7) -> str:
    return over(192, lambda i: f"CAST({gen_pixel(i, key, mult, step, mod, shift)} AS SMALLINT)")


def f3(idx: str) -> str:
    return gen_pixel(idx, key="s_suppkey", mult=1)


def digest(vec: str, scale: float = 1.0) -> str:
    """Sum of the elements in whole units of 1 / scale, each times a weight by its place."""
    unit = f"CAST(floor(CAST(v AS DOUBLE) * {dbl(scale)} + {dbl(0.5)}) AS BIGINT)"
    return f"CAST(list_sum(list_transform({vec}, lambda v, j: {unit} * ((j - 1) % 1009 + 1))) AS BIGINT)"


def f1(idx: str) -> str:
    return f"CAST(embedding[({idx}) + 1] AS DOUBLE)"


# ---- tensor functions -------------------------------------------------------------------

def bilinear(sample, h: int, w: int, oh: int, ow: int, y: str, x: str) -> str:
    def taps(pos, n_in, n_out):
        src = f"greatest(({pos} + {dbl(0.5)}) * {dbl(n_in / n_out)} - {dbl(0.5)}, {dbl(0.0)})"
        i0 = f"least(CAST(floor({src}) AS INTEGER), {n_in - 1})"
        i1 = f"least({i0} + 1, {n_in - 1})"
        w1 = f"({src} - {i0})"
        return i0, i1, f"({dbl(1.0)} - {w1})", w1

    y0, y1, hw0, hw1 = taps(y, h, oh)
    x0, x1, ww0, ww1 = taps(x, w, ow)
    top = f"({ww0} * {sample(y0, x0)} + {ww1} * {sample(y0, x1)})"
    bot = f"({ww0} * {sample(y1, x0)} + {ww1} * {sample(y1, x1)})"
    return f"({hw0} * {top} + {hw1} * {bot})"


def permute(raw, spec: TensorSpec, layout: str, cast: str = "SMALLINT") -> str:
    out_shape = tuple(spec.dim(a) for a in layout)
    return over(spec.size, lambda i: f"CAST({raw(flat(coords(i, layout, out_shape), spec.layout, spec.shape))} AS {cast})")


def center_crop(raw, spec: TensorSpec, crop, cast: str = "SMALLINT") -> str:
    top, left = CROPPED[spec.height, spec.width, crop]
    out = spec.with_(shape=tuple({"H": crop, "W": crop}.get(a, spec.dim(a)) for a in spec.layout))

    def at(i):
        p = coords(i, out.layout, out.shape)
        p["H"] = f"({p['H']} + {top})"
        p["W"] = f"({p['W']} + {left})"
        return f"CAST({raw(flat(p, spec.layout, spec.shape))} AS {cast})"

    return over(out.size, at)


def rescale(raw, n: int, scale, digits: int = 6) -> str:
    body = (lambda i: rnd(f"CAST({raw(i)} AS DOUBLE)", digits)) if scale is None else \
        (lambda i: rnd(f"CAST({raw(i)} AS DOUBLE) / {dbl(scale)}", digits))
    return over(n, body)


def resize(raw, spec: TensorSpec, size, digits: int | None = 6) -> str:
    oh, ow = RESIZED[spec.height, spec.width, size]
    if (oh, ow) == (spec.height, spec.width):
        return rescale(raw, spec.size, None, digits)
    out = spec.with_(shape=tuple({"H": oh, "W": ow}.get(a, spec.dim(a)) for a in spec.layout))

    def at(i):
        p = coords(i, out.layout, out.shape)

        def sample(yy, xx):
            return f"CAST({raw(flat(dict(p, H=yy, W=xx), spec.layout, spec.shape))} AS DOUBLE)"

        v = bilinear(sample, spec.height, spec.width, oh, ow, p['H'], p['W'])
        return v if digits is None else rnd(v, digits)

    return over(out.size, at)


def normalize(raw, spec: TensorSpec, mean, std, scale=None, digits: int = 6) -> str:
    def at(i):
        c = coords(i, spec.layout, spec.shape)["C"]
        v = f"CAST({raw(i)} AS DOUBLE)"
        if scale is not None:
            v = f"{v} / {dbl(scale)}"
        return rnd(f"({v} - {pick(mean, c)}) / {pick(std, c)}", digits)

    return over(spec.size, at)


def preprocess(pre: Preprocess, raw, digits: int | None = 6) -> str:
    """SQL list for ``Preprocess.native``; ``raw(idx)`` is the stored value at a
    flat input index."""
    s = pre.input
    h, w = s.height, s.width
    rh, rw = RESIZED[h, w, pre.resize] if pre.resize else (h, w)
    top, left = CROPPED[rh, rw, pre.crop]
    out = TensorSpec.image(pre.crop, pre.crop, s.channels, pre.layout, pre.dtype)

    def sample(y, x, c):
        v = raw(flat({"H": y, "W": x, "C": c}, s.layout, s.shape))
        if pre.as_uint8:
            v = f"((({v}) % 256 + 256) % 256)"
        v = f"CAST({v} AS DOUBLE)"
        if pre.scale is not None:
            v = f"({v} / {dbl(pre.scale)})"
        return v

    def at(i):
        p = coords(i, out.layout, out.shape)
        y, x, c = f"({p['H']} + {top})", f"({p['W']} + {left})", p["C"]
        if (rh, rw) == (h, w):
            v = sample(y, x, c)
        else:
            v = bilinear(lambda yy, xx: sample(yy, xx, c), h, w, rh, rw, y, x)
        v = f"(({v} - {pick(pre.mean, c)}) / {pick(pre.std, c)})"
        return v if digits is None else rnd(v, digits)

    return over(out.size, at)


def weight(k: str, j: str, a: int = 31, b: int = 17) -> str:
    return f"(CAST((({k}) * {a} + ({j}) * {b}) % 101 - 50 AS DOUBLE) / {dbl(100.0)})"


def logits(vec: str, n_out: int, n_in: int, digits: int | None = 4, a: int = 31, b: int = 17,
           relu: bool = False) -> str:
    """Formula linear layer (``LinearModel.formula``) applied to the SQL list ``vec``."""
    body = f"list_sum(list_transform(range({n_in}), lambda j: CAST(({vec})[j + 1] AS DOUBLE) * {weight('k', 'j', a, b)}))"
    if relu:
        body = f"greatest({body}, {dbl(0.0)})"
    if digits is not None:
        body = rnd(body, digits)
    return f"list_transform(range({n_out}), lambda k: {body})"
