"""Native (Catalyst) tensor functions agree with the vectorised NumPy forms."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from kiln.functions import native as nat
from kiln.functions import ndarray as nd
from kiln.functions.preprocess import IMAGENET_MEAN, IMAGENET_STD, Preprocess
from kiln.spec import TensorSpec

SPEC = TensorSpec((5, 6, 3), "HWC", "int16")


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(7)
    data = rng.integers(-300, 300, size=(40, SPEC.size)).astype(np.int16)
    rows = [(i, [int(v) for v in data[i]]) for i in range(len(data))]
    df = spark.createDataFrame(rows, "id long, image array<short>")
    return df, data.reshape(-1, *SPEC.shape)


def collect(df, col):
    pdf = df.orderBy("id").select(col).toPandas()
    return np.stack(pdf[col].values)


def test_permute(images):
    df, x = images
    got = collect(df.select("id", nat.permute("image", SPEC, "CHW").alias("t")), "t")
    np.testing.assert_array_equal(got, nd.flatten(nd.permute(x, "HWC", "CHW")))


def test_crop(images):
    df, x = images
    got = collect(df.select("id", nat.center_crop("image", SPEC, (3, 4)).alias("t")), "t")
    np.testing.assert_array_equal(got, nd.flatten(nd.center_crop(x, (3, 4))))


@pytest.mark.parametrize("size", [5, 3, 7, (4, 9)])
def test_resize(images, size):
    df, x = images
    got = collect(df.select("id", nat.resize("image", SPEC, size).alias("t")), "t")
    np.testing.assert_array_equal(got, nd.flatten(nd.resize(x.astype(np.float64), size)))


def test_uint8_rescale_normalize(images):
    df, x = images
    got = collect(df.select("id", nat.to_uint8("image").alias("t")), "t")
    np.testing.assert_array_equal(got, nd.flatten(nd.to_uint8(x)).astype(np.int16))
    got = collect(df.select("id", nat.rescale("image", 255.0).alias("t")), "t")
    np.testing.assert_array_equal(got, nd.flatten(nd.rescale(x, 255.0)))
    fspec = SPEC.with_(dtype="float64")
    got = collect(df.select("id", nat.normalize(nat.rescale("image", 256.0), fspec, IMAGENET_MEAN,
                                                 IMAGENET_STD).alias("t")), "t")
    np.testing.assert_array_equal(got, nd.flatten(nd.normalize(nd.rescale(x, 256.0), IMAGENET_MEAN, IMAGENET_STD)))


def test_reshape_nested_and_flatten(images):
    df, x = images
    d = df.select("id", nat.reshape_nested("image", SPEC).alias("n"))
    row = d.orderBy("id").first()
    assert np.array(row["n"]).shape == SPEC.shape
    np.testing.assert_array_equal(np.array(row["n"]), x[0])
    back = collect(d.select("id", nat.flatten_nested("n", 3).alias("t")), "t")
    np.testing.assert_array_equal(back, nd.flatten(x))


@pytest.mark.parametrize("kw", [
    dict(resize=None, crop=4, scale=256.0),
    dict(resize=8, crop=6, scale=255.0, layout="HWC"),
    dict(resize=4, crop=None, scale=None, as_uint8=True),
    dict(resize=(5, 6), crop=(3, 5), scale=256.0, as_uint8=True),
])
def test_preprocess_forms_agree(images, kw):
    df, x = images
    pre = Preprocess(SPEC, dtype="float64", **kw)
    native = collect(df.select("id", pre.native("image").alias("t")), "t")
    np.testing.assert_array_equal(native, pre.numpy(x))
    assert native.shape[1] == pre.output.size


def test_let_evaluates_expression_once(spark):
    df = spark.range(3).select(F.col("id"), F.array(F.col("id"), F.col("id") + 1).alias("a"))
    expr = F.transform("a", lambda v: v * 2)
    got = df.select(nat.let(expr, lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda s, v: s + v)).alias("s"))
    assert [r["s"] for r in got.orderBy("s").collect()] == [2, 6, 10]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(h=st.integers(2, 7), w=st.integers(2, 7), c=st.integers(1, 4), in_layout=st.sampled_from(["HWC", "CHW"]),
       out_layout=st.sampled_from(["HWC", "CHW"]), resize=st.one_of(st.none(), st.integers(2, 9)),
       crop_frac=st.floats(0.3, 1.0), scale=st.sampled_from([None, 255.0, 256.0]), as_uint8=st.booleans())
def test_native_equals_numpy_property(spark, h, w, c, in_layout, out_layout, resize, crop_frac, scale, as_uint8):
    spec = TensorSpec.image(h, w, c, layout=in_layout)
    probe = Preprocess(spec, resize=resize, crop=None)
    rh, rw = probe.output.height, probe.output.width
    crop = (max(1, int(rh * crop_frac)), max(1, int(rw * crop_frac)))
    pre = Preprocess(spec, resize=resize, crop=crop, scale=scale, as_uint8=as_uint8, mean=(0.5,) * c if c != 3
                     else IMAGENET_MEAN, std=(0.25,) * c if c != 3 else IMAGENET_STD, layout=out_layout,
                     dtype="float64")
    rng = np.random.default_rng(h * 100 + w * 10 + c)
    data = rng.integers(-300, 300, size=(6, spec.size)).astype(np.int16)
    df = spark.createDataFrame([(i, [int(v) for v in data[i]]) for i in range(6)], "id long, image array<short>")
    got = collect(df.select("id", pre.native("image").alias("t")), "t")
    np.testing.assert_array_equal(got, pre.numpy(data.reshape(-1, *spec.shape)))


def test_doubles_are_rounded_as_by_spark(spark):
    """The fast rounding gives Spark's values: ties, neighbours of ties, large and tiny values, zeros, no numbers, nulls."""
    import struct

    rng = np.random.default_rng(3)
    ties = (rng.integers(0, 10**9, 3000) + 0.5) / 1e6
    x = np.concatenate([rng.standard_normal(3000), rng.standard_normal(500) * 1e6, np.arange(256) / 256, np.arange(256) / 255, ties, np.nextafter(ties, 0),
                        np.nextafter(ties, 9e9), 10.0 ** np.arange(-12, 18), [0.0, 999.9999995, 1000.0000005, np.inf, np.nan]])
    rows = [(0, [*x.tolist(), *(-x).tolist(), None]), (1, []), (2, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    bits = lambda v: None if v is None else [None if e is None or e != e else struct.pack("<d", e) for e in v]
    for digits in (4, 6):
        for r in df.select(nat.round_doubles("v", digits).alias("a"), nat.round_values("v", digits).alias("b")).collect():
            assert bits(r.a) == bits(r.b)
    plan = df.select(nat.round_doubles("v", 6).alias("a"))
    assert plan.schema["a"].dataType == df.select(nat.round_values("v", 6).alias("a")).schema["a"].dataType


def test_small_tensors_are_written_out(spark):
    """Rows of the known length are computed by one expression for each element, rows of any other length, null rows and
    null elements by lambdas: the same values either way."""
    spec = TensorSpec((4, 3, 3), "HWC", "int16")
    rows = [(0, list(range(36))), (1, list(range(-100, -64))), (2, [None, *range(35)]), (3, list(range(40))), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id long, image array<short>")
    pre = Preprocess(spec, resize=(5, 4), crop=3, scale=255.0, dtype="float64", as_uint8=True)
    for made in (lambda c: nat.rescale(c, 255.0, 36), lambda c: nat.resize(c, spec, (6, 5)), lambda c: nat.resize(c, spec, (2, 2)), pre.native):
        named, other = df.select("id", made("image").alias("t")), df.select("id", made(F.col("image")).alias("t"))
        assert "CASE WHEN" in named._jdf.queryExecution().analyzed().toString()
        assert "CASE WHEN" not in other._jdf.queryExecution().analyzed().toString()
        assert named.schema["t"].dataType == other.schema["t"].dataType
        assert named.orderBy("id").collect() == other.orderBy("id").collect()
        n = len(named.where("id = 0").first().t)
        a, b = (x.select("id", nat.round_doubles("t", 4, k).alias("t")).orderBy("id").collect() for x, k in ((named, n), (other, None)))
        assert a == b


def test_digests_are_summed_by_compiled_rows(spark):
    """Length and weighted sum of every row, rows of equal and null keys apart; no lambda goes through the elements."""
    from kiln.plans import catalog

    rng = np.random.default_rng(5)
    wide = [round(float(v), 7) for v in rng.standard_normal(3000)]
    rows = [(1, wide), (1, wide), (1, wide[:7]), (None, wide), (None, [2.5]), (2, []), (3, None), (4, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "s_suppkey long, t array<double>")
    for scale in (1.0, 1e6):
        out = catalog._digested(df, F.col("t"), scale)
        assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
        units = lambda t: sum(int(np.floor(x * scale + 0.5)) * (i % 1009 + 1) for i, x in enumerate(t))
        want = [(k, None if t is None else len(t), None if t is None or None in t else units(t)) for k, t in rows]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kw", [
    dict(resize=None, crop=9, scale=255.0),
    dict(resize=None, crop=(7, 10), scale=None, as_uint8=True, layout="HWC", dtype="float32"),
    dict(resize=None, crop=None, scale=256.0, mean=(0.5,), std=(0.25,)),
    dict(resize=9, crop=8, scale=255.0),
    dict(resize=(14, 9), crop=None, scale=None, layout="HWC"),
    dict(resize=15, crop=12, scale=256.0, as_uint8=True, mean=(0.5,), std=(0.25,), dtype="float32"),
])
@pytest.mark.parametrize("in_layout", ["HWC", "CHW"])
def test_preprocess_of_wider_images(spark, kw, in_layout):
    """Images too wide to be written out: pixels in and out of the range of a byte and nulls; elements by table, lines of a
    resize joined pairwise, so that each mean along the width is taken once."""
    spec = TensorSpec.image(12, 18, 3, layout=in_layout)
    pre = Preprocess(spec, **{"dtype": "float64", **kw})
    data = np.random.default_rng(11).integers(-300, 600, size=(5, spec.size)).astype(np.int16)
    df = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(data)], "id long, image array<short>")
    made = df.select("id", pre.native("image").alias("t"))
    want = pre.numpy(data.reshape(-1, *spec.shape))
    if pre.dtype == "float64":
        np.testing.assert_array_equal(collect(made, "t"), want)
    else:
        np.testing.assert_allclose(collect(made, "t"), want, rtol=1e-5, atol=1e-5)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "zip_with" in plan if kw["resize"] else ("coalesce" in plan) == (pre.layout[-1] != in_layout[-1])
    rows = [(0, [None, *range(1, spec.size)]), (1, list(range(spec.size)))]
    hole, full = (r.t for r in spark.createDataFrame(rows, "id long, image array<short>").orderBy("id").select(pre.native("image").alias("t")).collect())
    assert [a for a, b in zip(hole, full, strict=True) if a is not None and a != b] == []
    assert full.count(None) == 0 and (pre.crop is not None or hole.count(None) > 0)
