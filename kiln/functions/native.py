"""Native tensor functions: Catalyst higher-order expressions, no Python worker.

Every function maps a flat array column to a flat array column.  Elements are moved by nested ``transform`` over the
output's axes: what lies together in the input is taken by one ``slice``, what lies at a constant distance by one
``sequence`` of positions, and the pieces are joined by ``flatten``.  The expression has one size whatever the width of
the tensor, from an 8x8 thumbnail to 150,528 values; where rows are known to be small, scaling, resizing and rounding are
also written out element by element (``written_out``).  They are the form the SQL oracle mirrors; for large
tensors the vectorised NumPy forms (``kiln.functions.ndarray``) are faster, because Spark interprets
higher-order lambdas element by element.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from kiln.functions.ndarray import bilinear_taps, crop_offsets, resized_shape
from kiln.spec import TensorSpec


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def idiv(a: Column, b: int) -> Column:
    """Integer floor division of a non-negative int column by a constant."""
    return F.floor(a / F.lit(b)).cast("int")


def coords(i: Column, layout: str, shape) -> dict[str, Column]:
    """Flat index -> {axis: coordinate} for a row-major tensor."""
    out, stride = {}, 1
    for axis, dim in reversed(list(zip(layout, shape))):
        q = i if stride == 1 else idiv(i, stride)
        out[axis] = q % F.lit(dim) if stride * dim != _total(shape) else q
        stride *= dim
    return out


def _total(shape) -> int:
    n = 1
    for s in shape:
        n *= s
    return n


def over_indices(n: int, fn) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), fn)


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once per row and pass it to ``fn`` as a lambda variable.

    A lambda body that reads an outer array expression element by element would
    otherwise re-evaluate that expression for every element.  ``aggregate`` over nothing hands on its result as it is, where
    ``transform`` copies it element by element."""
    return F.aggregate(F.array().cast("array<int>"), expr, lambda x, _: x, fn)


def lets(exprs: list[Column], fn) -> Column:
    """``let`` of several: a lambda reads a variable faster than the field of a struct."""
    return let(exprs[0], lambda x: lets(exprs[1:], lambda *more: fn(x, *more))) if exprs else fn()


def _is_plain(c: Column) -> bool:
    """True for a bare column reference (cheap to read repeatedly)."""
    return "(" not in str(c)


def bound(col, fn) -> Column:
    c = _c(col)
    return fn(c) if _is_plain(c) else let(c, fn)


def _sql_num(v, integral: bool) -> str:
    return repr(int(v)) if integral else f"{float(v)!r}D"  # D: a double literal, not a decimal


def pick(values, index: Column) -> Column:
    """values[index] for a Python list of constants and a 0-based column index."""
    if len(values) == 1:
        return F.lit(float(values[0]))
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + F.lit(1))


#: Elements of small tensors that are written out one by one.
WRITTEN_OUT = 512


def written_out(col, n_in: int | None, n_out: int, elements, otherwise: Column) -> Column:
    """``otherwise``, and the same by one SQL expression for each element where both rows are known to be small: Spark
    compiles those, while it interprets the lambdas of ``otherwise``.  ``elements(at)`` lists the expressions, ``at(i)`` is the
    element ``i`` of a column whose rows have ``n_in`` values; rows of any other length, nulls among them, and columns that
    are not given by name are left to ``otherwise``."""
    if n_in is None or max(n_in, n_out) > WRITTEN_OUT or not isinstance(col, str):
        return otherwise
    name = f"`{col}`"
    return F.when(F.size(col) == F.lit(n_in), F.expr(f"array({', '.join(elements(lambda i: f'get({name}, {i})'))})")).otherwise(otherwise)


def each(col, fn, sql, n: int | None = None) -> Column:
    """``fn`` of every element; ``sql`` writes the same as text, ``n`` is the length of the rows, if it is known."""
    return written_out(col, n, n or 0, lambda at: [sql(at(i)) for i in range(n)], F.transform(_c(col), fn))


# ---- T2 / T3 / T11: reshape views -----------------------------------------------------

def reshape_nested(col, spec: TensorSpec) -> Column:
    """Flat row -> nested arrays with ``spec.shape`` (T2 HWC, T3 CHW)."""
    c = _c(col)
    shape = spec.shape

    def build(prefix_offset: Column, depth: int) -> Column:
        inner = _total(shape[depth + 1:])
        if depth == len(shape) - 1:
            return F.slice(c, prefix_offset + F.lit(1), F.lit(shape[depth]))
        return over_indices(shape[depth], lambda k: build(prefix_offset + k * F.lit(inner), depth + 1))

    if len(shape) == 1:
        return c

    def nested(arr):
        nonlocal c
        c = arr
        return over_indices(shape[0], lambda k: build(k * F.lit(_total(shape[1:])), 1))

    return bound(col, nested)


def flatten_nested(col, depth: int) -> Column:
    """Nested arrays of ``depth`` levels -> flat row."""
    c = _c(col)
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c


# ---- T4 / T5 / T7: element casts and scaling --------------------------------------------

def cast(col, dtype: str = "float32") -> Column:
    """Element cast (T4)."""
    return _c(col).cast(TensorSpec((1,), "D", dtype).sql_type)


def to_uint8(col) -> Column:
    """Wrap to 0..255 like a C cast to uint8 (T5); kept as short (Spark bytes are signed)."""
    return F.transform(_c(col), lambda x: F.pmod(x.cast("int"), F.lit(256)).cast("short"))


def rescale(col, scale: float | None, n: int | None = None) -> Column:
    """float64 values divided by ``scale`` (T7); None only casts.  ``n``: the length of the rows, if it is known."""
    if scale is None:
        return each(col, lambda x: x.cast("double"), as_double, n)
    return each(col, lambda x: x.cast("double") / F.lit(float(scale)), lambda x: f"{as_double(x)} / {_sql_num(scale, False)}", n)


def as_double(x: str) -> str:
    return f"cast({x} as double)"


# ---- T6 / T8 / T9 / T10: moving elements ---------------------------------------------------

def strides(spec: TensorSpec) -> dict[str, int]:
    """Distance of neighbours along each axis in the flat row."""
    out, step = {}, 1
    for axis, dim in reversed(list(zip(spec.layout, spec.shape))):
        out[axis] = step
        step *= dim
    return out


def take(c: Column, spec: TensorSpec, layout: str, window: dict[str, tuple[int, int]] | None = None) -> Column:
    """The elements of ``window`` ({axis: (start, count)}, default all) of a flat row, in the axis order ``layout``."""
    window = {a: (window or {}).get(a, (0, spec.dim(a))) for a in layout}
    step = strides(spec)

    def together(axes: str) -> bool:
        """Whether these axes lie in the input as they do in the output, only the first of them cut."""
        return spec.layout.endswith(axes) and all(window[a] == (0, spec.dim(a)) for a in axes[1:])

    def build(axes: str, base: Column | None, offset: int) -> Column:
        """The rest of the axes at flat position ``base + offset``."""
        start, count = window[axes[0]]
        offset += start * step[axes[0]]
        if together(axes):
            return F.slice(c, plus(base, offset + 1), F.lit(count * step[axes[0]]))
        places = F.sequence(plus(base, offset), plus(base, offset + (count - 1) * step[axes[0]]), F.lit(step[axes[0]]))
        if len(axes) == 1:
            return F.transform(places, lambda j: F.get(c, j))
        return F.flatten(F.transform(places, lambda o: build(axes[1:], o, 0)))

    return build(layout, None, 0)


def plus(base: Column | None, n: int) -> Column:
    """``base + n``, written as a subtraction: Catalyst orders the operands of additions by hash, and the argument of a
    Python UDF that adds lambda variables may then not be found again when the UDF is taken out of the plan."""
    if base is None:
        return F.lit(n)
    return base - F.lit(-n) if n else base


def permute(col, spec: TensorSpec, layout: str) -> Column:
    """Reorder axes, e.g. HWC -> CHW."""
    return bound(col, lambda c: take(c, spec, layout))


def crop_window(spec: TensorSpec, crop) -> dict[str, tuple[int, int]]:
    top, left, ch, cw = crop_offsets(spec.height, spec.width, crop)
    if ch > spec.height or cw > spec.width:
        raise ValueError("native centre crop does not pad; crop must fit the image")
    return {"H": (top, ch), "W": (left, cw)}


def center_crop(col, spec: TensorSpec, crop) -> Column:
    """Centre crop of an image tensor (T9); layout is kept."""
    return bound(col, lambda c: take(c, spec, spec.layout, crop_window(spec, crop)))


def taps(n_in: int, n_out: int, start: int, count: int, step: int) -> Column:
    """Outputs ``start`` to ``start + count`` of a bilinear resize along one axis: an array of (i, j, v, w), the two source
    positions in the flat row and their weights (``ndarray.bilinear_taps``).  One entry per row or column of the
    image, never one per pixel."""
    i0, i1, w0, w1 = (t[start:start + count] for t in bilinear_taps(n_in, n_out))
    return tap_structs([int(x) * step for x in i0], [int(x) * step for x in i1], w0, w1)


def tap_structs(i, j, v, w) -> Column:
    """Lists of positions and weights as an array of (i, j, v, w)."""
    i, j = (f"array({', '.join(str(x) for x in t)})" for t in (i, j))
    v, w = (f"array({', '.join(_sql_num(x, False) for x in t)})" for t in (v, w))
    return F.expr(f"transform({i}, (x, k) -> named_struct('i', x, 'j', {j}[k], 'v', {v}[k], 'w', {w}[k]))")


def channels_of(numbers: list[tuple], step: int) -> Column:
    """One entry for each channel: ``at``, its distance from the first in the flat row, and ``x0``, ``x1``..., its numbers."""
    return F.array(*(F.struct(F.lit(k * step).alias("at"), *(F.lit(x).alias(f"x{n}") for n, x in enumerate(xs))) for k, xs in enumerate(numbers)))


def with_numbers(entry: Column, n: int, fn) -> Column:
    """``fn(*numbers)`` of an entry of ``channels_of``."""
    return lets([entry[f"x{k}"] for k in range(n)], fn)


def take_each(c: Column, spec: TensorSpec, layout: str, window: dict[str, tuple[int, int]], numbers: list[tuple], fn) -> Column:
    """``fn(element, *numbers of its channel)`` of the elements of ``take``, each got and made by one lambda; one entry of
    ``numbers`` is for all channels.  Rows of another length are read as ``take`` reads them where nothing lies together."""
    step = strides(spec)

    def build(axes: str, base: Column | None, xs) -> Column:
        start, count = window.get(axes[0], (0, spec.dim(axes[0])))
        offset, stride = start * step[axes[0]], step[axes[0]]
        if axes[0] == "C" and len(numbers) > 1:
            at = lambda e: e["at"] if base is None else base - e["at"] * F.lit(-1)
            one = lambda e, *k: build(axes[1:], at(e), k) if axes[1:] else fn(F.get(c, at(e)), *k)
            parts = F.transform(channels_of(numbers, stride), lambda e: with_numbers(e, len(numbers[0]), lambda *k: one(e, *k)))
            return F.flatten(parts) if axes[1:] else parts
        places = F.sequence(plus(base, offset), plus(base, offset + (count - 1) * stride), F.lit(stride))
        return F.flatten(F.transform(places, lambda o: build(axes[1:], o, xs))) if axes[1:] else F.transform(places, lambda j: fn(F.get(c, j), *xs))

    return build(layout, None, [F.lit(x) for x in numbers[0]])


def bilinear(c: Column, spec: TensorSpec, oh: int, ow: int, layout: str, window: dict[str, tuple[int, int]], read, numbers=((),), write=lambda v: v) -> Column:
    """Half-pixel bilinear samples of ``window`` of the resized image, in the axis order ``layout``: each is
    h0*(w0*a + w1*b) + h1*(w0*c + w1*d), as in ``ndarray.resize``.  ``read`` makes an array of doubles of the stored values,
    ``write`` the output element of (sample, *the channel's ``numbers``).

    Spark interprets the lambdas, so each does little: the stored values are read once, the means along the width are taken
    once for each line of the image that any output needs, and lines are joined pairwise."""
    step = strides(spec)
    first, count = window["H"]
    lines = [t[first:first + count] for t in bilinear_taps(spec.height, oh)]
    used = sorted({int(y) for t in lines[:2] for y in t})
    ys = tap_structs([used.index(y) for y in lines[0]], [used.index(y) for y in lines[1]], *lines[2:])
    xs = taps(spec.width, ow, *window["W"], -step["W"])  # positions are taken off a line's base, see ``plus``
    starts = F.expr(f"array({', '.join(str(y * step['H']) for y in used)})")
    per_channel = len(numbers) > 1 and "C" in layout
    planes = layout[0] == "C" or per_channel  # channel by channel
    rest = "W" if planes else layout.replace("H", "")

    def places(axes: str, tap, ch) -> Column:
        """The taps of one line, for the rest of the axes."""
        if not axes:
            return F.struct(*((tap[k] - ch * F.lit(step["C"])).alias(k) for k in "ij"), tap["v"].alias("v"), tap["w"].alias("w"))
        if axes == "W" and ch is None:
            return xs
        parts = over_indices(spec.channels, lambda k: places(axes[1:], tap, k)) if axes[0] == "C" else F.transform(xs, lambda t: places(axes[1:], t, ch))
        return F.flatten(parts) if len(axes) > 1 else parts

    def across(values, base, along) -> Column:
        """Means between neighbours of the line at ``base``."""
        return F.transform(along, lambda t: t["v"] * F.get(values, base - t["i"]) + t["w"] * F.get(values, base - t["j"]))

    def between(rows, t, put) -> Column:
        """Means between two of the lines."""
        return lets([t["v"], t["w"]], lambda v, w: F.zip_with(F.get(rows, t["i"]), F.get(rows, t["j"]), lambda a, b: put(v * a + w * b)))

    def image(values, along, at, put) -> Column:
        """From flat position ``at`` on, the axes ``H`` and ``rest``."""
        made = F.transform(starts, lambda y: lets([y - at * F.lit(-1)], lambda base: across(values, base, along)))
        return F.flatten(let(made, lambda rows: F.transform(ys, lambda t: between(rows, t, put))))

    def whole(values, along) -> Column:
        if not planes:
            return image(values, along, F.lit(0), lambda v: write(v, *(F.lit(x) for x in numbers[0])))
        n = list(numbers) if per_channel else [numbers[0]] * spec.channels
        made = lambda e: with_numbers(e, len(n[0]), lambda *k: image(values, along, e["at"], lambda v: write(v, *k)))
        return F.flatten(F.transform(channels_of(n, step["C"]), made))

    dims = {"H": count, "W": window["W"][1], "C": spec.channels}
    have = ("C" if planes else "") + "H" + rest
    out = let(read(c), lambda values: let(places(rest, None, None), lambda along: whole(values, along)))
    return out if have == layout else let(out, lambda v: take(v, TensorSpec(tuple(dims[x] for x in have), have, "float64"), layout))


def samples(at, spec: TensorSpec, oh: int, ow: int, layout: str, window: dict[str, tuple[int, int]], read, write) -> list[str]:
    """The elements of ``bilinear`` as SQL, one by one: the same products and sums of the same numbers."""
    step = strides(spec)
    ys, xs = (list(zip(*(t.tolist() for t in bilinear_taps(n, out)), strict=True)) for n, out in ((spec.height, oh), (spec.width, ow)))

    def mean(v, a, w, b) -> str:
        return f"({_sql_num(v, False)} * {a} + {_sql_num(w, False)} * {b})"

    def across(y, x, ch) -> str:
        """Between two neighbours of a row."""
        i, j, v, w = xs[x]
        one, other = (read(at(y * step["H"] + k * step["W"] + ch * step.get("C", 0))) for k in (i, j))
        return mean(v, one, w, other)

    out = []
    for place in product(*(range(window[a][0], sum(window[a])) if a in window else range(spec.dim(a)) for a in layout)):
        k = dict(zip(layout, place, strict=True))
        ch = k.get("C", 0)
        i, j, v, w = ys[k["H"]]
        out.append(write(mean(v, across(i, k["W"], ch), w, across(j, k["W"], ch)), ch))
    return out


def sampled(col, spec: TensorSpec, oh: int, ow: int, layout: str, window: dict[str, tuple[int, int]], read, sql_read, sql_write, numbers=((),), write=lambda v: v) -> Column:
    """``bilinear`` of a column, written out if the images are small."""
    n_out = window["H"][1] * window["W"][1] * (spec.channels if "C" in layout else 1)
    lambdas = let(_c(col), lambda c: bilinear(c, spec, oh, ow, layout, window, read, numbers, write))
    return written_out(col, spec.size, n_out, lambda at: samples(at, spec, oh, ow, layout, window, sql_read, sql_write), lambdas)


def resize(col, spec: TensorSpec, size) -> Column:
    """Bilinear resize (T8) to float64; identity (cast only) when the size matches."""
    oh, ow = resized_shape(spec.height, spec.width, size)
    if (oh, ow) == (spec.height, spec.width):
        return rescale(col, None, spec.size)
    whole = {"H": (0, oh), "W": (0, ow)}
    return sampled(col, spec, oh, ow, spec.layout, whole, lambda c: cast(c, "float64"), as_double, lambda v, ch: v)


def normalize(col, spec: TensorSpec, mean, std) -> Column:
    """(x - mean[c]) / std[c] in float64."""
    def at(x, i):
        ch = coords(i, spec.layout, spec.shape)["C"] if "C" in spec.layout else F.lit(0)
        return (x.cast("double") - pick(mean, ch)) / pick(std, ch)

    return F.transform(_c(col), at)


def round_doubles(col, digits: int, n: int | None = None) -> Column:
    """``round_values`` of ``array<double>``, the same values.  Spark rounds by decimal numbers made from each value's
    text; that is left to values near a tie, to large ones and to those that are not finite.  ``n``: the length of the
    rows, if it is known."""
    p = 10.0 ** digits

    def one(x):
        y = x * F.lit(p)
        plain = (F.abs(y - F.rint(y)) < F.lit(0.499999)) & (F.abs(y) < F.lit(1e9))
        return F.when(plain, F.rint(y) / F.lit(p) + F.lit(0.0)).otherwise(F.round(x, digits))  # + 0.0: no negative zero

    def text(x):
        y = f"({x} * {p!r}D)"
        return f"case when abs({y} - rint({y})) < 0.499999D and abs({y}) < 1e9D then rint({y}) / {p!r}D + 0.0D else round({x}, {digits}) end"

    return each(col, one, text, n)


def round_values(col, digits: int) -> Column:
    """Round every element half-up (as SQL engines do) – for stable comparisons."""
    return F.transform(_c(col), lambda x: F.round(x, digits))
