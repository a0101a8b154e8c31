"""Scoring operators, pipelines and their physical plans (U, I, B, P)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions import Preprocess
from kiln.models import LinearModel, ModelHandle
from kiln.operators import resources
from kiln.operators.score import map_batches, map_tensor, predict_map, predict_udf
from kiln.plans import ScoringPlan
from kiln.plans.inspect import exchanges, node_counts, pushed_filters, python_nodes, read_schema
from kiln.sources.derived import F1_SPEC, F2_SPEC, f1_embeddings, f2_orders
from kiln.spec import TensorShapeError, TensorSpec

SF = "/root/testdata/sf0.001"
PRE = Preprocess(F1_SPEC, resize=None, crop=2, scale=None, mean=(0.485,), std=(0.229,), dtype="float64")


@pytest.fixture(scope="module")
def plan(spark):
    return ScoringPlan(PRE, ModelHandle.create(spark, LinearModel.formula(10, 16)), "image", ["vec_id"],
                       dtype="float64")


@pytest.fixture(scope="module")
def expected(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(e.embedding.values).reshape(-1, 4, 4, 4)
    return e.vec_id.values, LinearModel.formula(10, 16).predict(PRE.numpy(x))


def _pred(df, key="vec_id"):
    pdf = df.orderBy(key).toPandas()
    return pdf[key].values, np.stack(pdf.prediction.values)


@pytest.mark.parametrize("shape", ["fused", "fused_udf", "chained", "native"])
def test_pipeline_shapes_agree(spark, plan, expected, shape):
    ids, pred = _pred(getattr(plan, shape)(f1_embeddings(spark, SF)))
    np.testing.assert_array_equal(ids, expected[0])
    np.testing.assert_allclose(pred, expected[1], rtol=1e-12, atol=1e-12)


def test_staged_equals_fused(spark, plan, expected):
    ids, pred = _pred(plan.staged(spark, f1_embeddings(spark, SF)))
    np.testing.assert_allclose(pred, expected[1], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("flavor,form,reuse", [("pandas", "scalar", "batch"), ("pandas", "iterator", "partition"),
                                               ("arrow", "scalar", "partition"), ("arrow", "iterator", "partition")])
def test_udf_forms(spark, plan, expected, flavor, form, reuse):
    u = predict_udf(plan.model, PRE.output, reuse=reuse, dtype="float64", form=form, flavor=flavor, batch_size=7)
    d = f1_embeddings(spark, SF).select("vec_id", PRE.native("image").alias("t"))
    ids, pred = _pred(d.select("vec_id", u("t").alias("prediction")))
    np.testing.assert_allclose(pred, expected[1], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("n", [1, 9, 10, 11, 64])
def test_exact_model_batches(spark, n):
    """B2: every model call gets exactly n rows except the last of a partition."""
    def fn(batch):
        assert batch["rows"].shape[0] <= n
        return {"rows": [len(batch["rows"])]}

    df = spark.range(0, 200, numPartitions=3).select(F.col("id").alias("rows"))
    rep = map_batches(df, fn, "rows long", batch_size=n).toPandas()
    assert rep.rows.sum() == 200
    assert (rep.rows == n).sum() >= 200 // n - 3


def test_map_batches_class_and_pandas(spark):
    class AddOne:
        def __init__(self, k):
            self.k = k

        def __call__(self, pdf):
            return pdf.assign(id=pdf.id + self.k)

    out = map_batches(spark.range(5), AddOne, "id long", batch_format="pandas", fn_constructor_kwargs={"k": 1})
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]


def _faulty(spark):
    rows = [(1, [1.0] * 4), (2, None), (3, [1.0, 2.0]), (4, [1.0, None, 1.0, 1.0]), (5, [2.0] * 4)]
    return spark.createDataFrame(rows, "id long, x array<float>")


def test_invalid_rows_null_or_raise(spark):
    """null array, short array, null element."""
    h = ModelHandle.create(spark, LinearModel.formula(2, 4))
    spec = TensorSpec.vector(4)
    out = {r.id: r.prediction for r in predict_map(_faulty(spark), h, "x", spec, keep=["id"],
                                                    on_invalid="null").collect()}
    assert out[2] is None and out[3] is None and out[4] is None
    assert out[1] is not None and out[5] is not None
    with pytest.raises(Exception, match="TensorShapeError"):
        predict_map(_faulty(spark), h, "x", spec, keep=["id"]).collect()
    u = predict_udf(h, spec, on_invalid="null")
    got = {r.id: r.p for r in _faulty(spark).select("id", u("x").alias("p")).collect()}
    assert got[3] is None and got[1] is not None


def test_plan_shapes(spark, plan):
    d = f1_embeddings(spark, SF)
    chained = plan.chained(d)
    c = node_counts(chained)
    assert c["ArrowEvalPython"] == 1, c  # two UDFs, one Python node
    fused = plan.fused(d)
    assert python_nodes(fused) == 1 and exchanges(fused) == 0
    rep = plan.repartitioned(d, 3)
    assert exchanges(rep) == 1
    assert any("vec_id" in s and "embedding" in s and "label" not in s for s in read_schema(fused))


class _Counting:
    """Model that counts the rows it scores (in an accumulator)."""

    def __init__(self, acc):
        self.acc = acc

    def predict(self, batch):
        self.acc.add(len(batch))
        return batch.reshape(len(batch), -1)[:, :1]


def test_count_prunes_udf_but_observation_does_not(spark):
    """``count()`` never runs the model; the Observation on the executed write does."""
    from kiln.operators.measure import count_rows

    acc = spark.sparkContext.accumulator(0)
    h = ModelHandle.create(spark, _Counting(acc))
    d = predict_map(spark.read.parquet(f"{SF}/embeddings.parquet"), h, "embedding", TensorSpec.vector(64),
                    keep=["vec_id"])
    u = predict_udf(h, TensorSpec.vector(64))
    projected = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", u("embedding").alias("p"))
    assert projected.count() == 500 and acc.value == 0  # the UDF column was pruned
    assert count_rows(d) == 500 and acc.value == 500


def test_filter_pushdown_below_udf(spark, plan):
    d = plan.fused(f1_embeddings(spark, SF).filter(F.col("vec_id") < 10))
    assert any("vec_id" in f for f in pushed_filters(d))
    assert d.count() == 10


def test_map_tensor_tags_spec(spark):
    d = map_tensor(f2_orders(spark, SF), "image", lambda b: b.reshape(len(b), -1), output="t",
                   out_spec=TensorSpec((8, 8, 3), "HWC", "int16"))
    assert TensorSpec.of(d, "t").shape == (8, 8, 3)


def test_batch_limits_take_effect_at_execution(spark):
    from kiln.operators.measure import batch_report

    d = batch_report(spark.range(0, 1000, numPartitions=1))
    with resources.batch_limits(spark, rows=64):
        sizes = [r.rows for r in d.collect()]
    assert max(sizes) == 64 and sum(sizes) == 1000


def test_stack_error_names_partition(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<float>")
    with pytest.raises(Exception, match="partition"):
        map_tensor(df, "x", lambda b: b, spec=TensorSpec.vector(3)).collect()
    with pytest.raises(TensorShapeError):
        from kiln.functions import ndarray as nd
        nd.stack([[1.0]], TensorSpec.vector(3))


def test_bytes_encoded_pipeline_matches_array(spark, plan, expected, tmp_dir):
    from kiln.operators.score import decode_bytes, encode_bytes
    from kiln.sources.parquet import read_tensors, write_parquet

    enc = encode_bytes(f1_embeddings(spark, SF), "image", keep=["vec_id"])
    spec = TensorSpec.of(enc, "image")
    assert spec.encoding == "bytes" and enc.schema["image"].dataType.simpleString() == "binary"
    write_parquet(enc, tmp_dir + "/b")
    back = read_tensors(spark, tmp_dir + "/b", "image", keep=["vec_id"])
    bplan = ScoringPlan(PRE.__class__(**{**PRE.__dict__, "input": spec}), plan.model, "image", ["vec_id"],
                        dtype="float64")
    ids, pred = _pred(bplan.fused(back))
    np.testing.assert_allclose(pred, expected[1], rtol=1e-12, atol=1e-12)
    arr = decode_bytes(back, "image", keep=["vec_id"]).orderBy("vec_id").first()
    assert len(arr.image) == 64
    with pytest.raises(Exception, match="range"):
        encode_bytes(f2_orders(spark, SF, mod=1000, shift=500), "image", dtype="uint8").collect()


def test_shape_error_names_the_key(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0, 3.0]), (42, [1.0])], "id long, x array<float>")
    with pytest.raises(Exception, match="id 42"):
        map_tensor(df, "x", lambda b: b, spec=TensorSpec.vector(3), keep=["id"]).collect()


def test_pandas_udf_on_bytes_input(spark, plan, expected):
    from kiln.operators.score import encode_bytes

    enc = encode_bytes(f1_embeddings(spark, SF), "image", keep=["vec_id"])
    spec = TensorSpec.of(enc, "image")
    bplan = ScoringPlan(PRE.__class__(**{**PRE.__dict__, "input": spec}), plan.model, "image", ["vec_id"],
                        dtype="float64")
    ids, pred = _pred(bplan.fused_udf(enc))
    np.testing.assert_allclose(pred, expected[1], rtol=1e-12, atol=1e-12)


def test_valid_tensor_native_check(spark):
    from kiln.spec import valid_tensor

    got = {r.id: r.valid for r in _faulty(spark).select("id", valid_tensor("x", TensorSpec.vector(4))).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
    b = spark.createDataFrame([(1, bytearray(8)), (2, bytearray(3)), (3, None)], "id long, x binary")
    got = {r.id: r.valid for r in b.select("id", valid_tensor("x", TensorSpec.vector(2, "float32").with_(
        encoding="bytes"))).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_map_images_null_rows(spark):
    from kiln.operators.score import map_images

    rows = [(1, 4, 4, list(range(48))), (2, None, None, None), (3, 2, 6, list(range(36)))]
    df = spark.createDataFrame(rows, "id long, height int, width int, image array<short>")
    pre = Preprocess(TensorSpec.image(4, 4, 3), resize=2, crop=2, scale=255.0, dtype="float64")
    out = {r.id: r.tensor for r in map_images(df, pre, keep=["id"], on_invalid="null").collect()}
    assert out[2] is None and len(out[1]) == 12 and len(out[3]) == 12
    with pytest.raises(Exception, match="null or undecodable image"):
        map_images(df, pre, keep=["id"]).collect()


def test_map_images_output_widths_differ(spark):
    """No crop: outputs keep each image's own size, so the dense path falls back to lists."""
    from kiln.operators.score import map_images

    rows = [(1, 2, 2, list(range(12))), (2, 3, 2, list(range(18))), (3, 2, 2, list(range(12, 24)))]
    df = spark.createDataFrame(rows, "id long, height int, width int, image array<short>").coalesce(1)
    pre = Preprocess(TensorSpec.image(2, 2, 3), resize=None, crop=None, scale=None, mean=(0.0,), std=(1.0,),
                     layout="HWC", dtype="float64")
    out = {r.id: r.tensor for r in map_images(df, pre, keep=["id"]).collect()}
    assert out[1] == [float(v) for v in range(12)] and out[3] == [float(v) for v in range(12, 24)]
    assert out[2] == [float(v) for v in range(18)]


@pytest.mark.parametrize("on_invalid", ["raise", "null"])
@pytest.mark.parametrize("encoding", ["array", "bytes"])
def test_output_beyond_one_arrow_batch(spark, on_invalid, encoding):
    """With the limit lowered: one input batch leaves as several, all rows in order."""
    from kiln.spec import TensorSpec

    d = f2_orders(spark, SF).coalesce(1)
    if on_invalid == "null":
        d = d.withColumn("image", F.when(F.col("o_orderkey") % 3 != 0, F.col("image")))
    out = TensorSpec((192,), "D", "int16", encoding)
    kw = dict(spec=F2_SPEC, out_spec=out, on_invalid=on_invalid)
    run = lambda **more: map_tensor(d, "image", lambda b: b, **kw, **more).collect()
    limit = 192 * 7 * (2 if encoding == "bytes" else 1) + 5
    assert run(max_values=limit) == run() and len(run()) == 1500
    report = map_tensor(d, "image", lambda b: b, max_values=limit, **kw)
    with pytest.raises(Exception, match="does not fit"):
        map_tensor(d, "image", lambda b: b, max_values=100, **kw).collect()
    assert report.count() == 1500


def test_too_wide_arrays_are_refused(monkeypatch):
    import numpy as np

    from kiln.functions import ndarray as nd

    monkeypatch.setattr(nd, "MAX_VALUES", 100)
    assert len(nd.to_arrow(np.zeros((10, 10)))) == 10 and len(nd.to_binary(np.zeros((10, 5)), "int16")) == 10
    for make in (lambda: nd.to_arrow(np.zeros((11, 10))), lambda: nd.to_binary(np.zeros((11, 5)), "int16")):
        with pytest.raises(nd.TooWide):
            make()
    assert nd.row_pieces(7, 30, 100) == [(0, 3), (3, 6), (6, 7)] and nd.row_pieces(0, 5) == [(0, 0)]


@pytest.mark.parametrize("flavor", ["pandas", "arrow"])
def test_exact_batches_over_borders(spark, flavor):
    import numpy as np

    from kiln.operators import resources
    from kiln.operators.score import tensor_udf

    d = f2_orders(spark, SF).repartition(3)
    with resources.batch_limits(spark, rows=37):
        for n in (1, 36, 37, 38, 100, 10_000):
            u = tensor_udf(lambda b: np.full((len(b), 1), len(b), np.int32), F2_SPEC, "int32", flavor=flavor, batch_size=n)
            for (p,), rows in d.select(F.spark_partition_id().alias("p"), F.element_at(u("image"), 1).alias("n")).toPandas().groupby(["p"]):
                full, rest = divmod(len(rows), n)
                assert rows.n.tolist() == [n] * (full * n) + [rest] * rest


def test_batches_for_a_consumer(spark):
    from kiln.streaming import ipc_cells, iter_batches

    d = f2_orders(spark, SF).repartition(4).withColumn("t", F.col("o_orderkey").cast("timestamp")).withColumn("n", F.when(F.col("o_orderkey") % 2 == 0, "x"))
    cells = ipc_cells(d, 100)
    assert cells.schema.simpleString() == "struct<ipc:binary>" and "Exchange RoundRobin" in cells._jdf.queryExecution().toString()
    got = [b for b in iter_batches(d, batch_size=100)]
    assert max(b.num_rows for b in got) == 100 and sum(b.num_rows for b in got) == 1500
    keys = sorted(k for b in got for k in b.column("o_orderkey").to_pylist())
    assert keys == sorted(r.o_orderkey for r in d.select("o_orderkey").collect())
    assert sum(b.column("n").null_count for b in got) == d.where("n is null").count()
    assert list(iter_batches(d.where("false"))) == [] or sum(b.num_rows for b in iter_batches(d.where("false"))) == 0


@pytest.mark.parametrize("layout", ["CHW", "HWC"])
@pytest.mark.parametrize("resize", [None, 6])
def test_native_plan_under_a_udf(spark, layout, resize):
    """The native expression below a Python UDF and a sort, many times over: whatever numbers Spark gives its variables."""
    pre = Preprocess(F1_SPEC, resize=resize, crop=4, scale=2.0, mean=(0.485,), std=(0.229,), layout=layout, dtype="float64")
    plan = ScoringPlan(pre, ModelHandle.create(spark, LinearModel.formula(10, 64)), "image", ["vec_id"], dtype="float64")
    want = _pred(plan.fused(f1_embeddings(spark, SF)))[1]
    for _ in range(4):
        np.testing.assert_allclose(_pred(plan.native(f1_embeddings(spark, SF)))[1], want, rtol=1e-12, atol=1e-12)


def test_wide_images_are_generated_in_small_batches(spark, monkeypatch):
    """A batch of keys is small; the images made from it come in batches of a bounded number of values."""
    import numpy as np

    from kiln.sources import derived
    from kiln.spec import TensorSpec

    monkeypatch.setattr(derived, "GENERATED_VALUES", 1000)
    keys = spark.createDataFrame([(i,) for i in [*range(50), 7, 7]], "k long").coalesce(1)
    for spec, most in ((TensorSpec.image(8, 8, 3), 1000 // 192), (TensorSpec.image(32, 16, 3), 1)):
        made = derived.generated_images(keys, "k", spec)
        sizes = [len(b) for b in derived.image_batches(np.arange(52), spec.size, 31, 7, 256, 0)]
        assert max(sizes) <= most and sum(sizes) == 52
        rows = made.collect()
        want = (np.array([*range(50), 7, 7])[:, None] * 31 + np.arange(spec.size) * 7) % 256
        assert sorted((x.k, x.image) for x in rows) == sorted((k, v) for k, v in zip([*range(50), 7, 7], want.tolist(), strict=True))


def test_iter_batches_consumed_in_the_tasks(spark):
    """With a consumer the driver gets what it makes of each batch, not the rows."""
    import pyarrow as pa

    from kiln.streaming import ipc_cells, iter_batches

    def total(b):
        return pa.RecordBatch.from_pydict({"rows": [b.num_rows], "sum": [sum(b.column("id").to_pylist())]})

    d = spark.range(0, 5000, 1, 3)
    got = [r for b in iter_batches(d, batch_size=100, consume=total) for r in b.to_pylist()]
    assert sum(r["rows"] for r in got) == 5000 and sum(r["sum"] for r in got) == sum(range(5000))
    assert max(r["rows"] for r in got) == 100 and len(got) == sum(-(-n // 100) for n in (1666, 1667, 1667))
    sent = lambda cells: sum(len(c.ipc) for c in cells.collect())
    assert sent(ipc_cells(d, 100, total)) < 0.2 * sent(ipc_cells(d, 100))
    assert list(iter_batches(d.where("false"), consume=total)) == []


def test_full_size_images_travel_in_small_batches(spark, tmp_dir):
    """The step behind the generator sees batches of ``GENERATED_VALUES`` values, whatever the session's batches are."""
    import pyarrow as pa

    from kiln.sources import derived

    before = spark.conf.get(resources.BATCH_ROWS)
    spark.range(30).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_dir}/supplier.parquet")
    made = derived.f3_images(spark, tmp_dir, "supplier", "s_suppkey")
    seen = made.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64())}) for b in it), "rows long")
    rows = [r.rows for r in seen.collect()]
    assert sum(rows) == 30 and max(rows) <= derived.GENERATED_VALUES // derived.F3_SPEC.size
    assert spark.conf.get(resources.BATCH_ROWS) == before


def test_part_images_are_made_by_all_tasks(spark, tmp_dir):
    """One split of keys does not make all images and files in one task."""
    from kiln.sources import derived

    spark.range(400).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(f"{tmp_dir}/part.parquet")
    for images in (derived.f4_part_images(spark, tmp_dir), derived.f5_variable_part_images(spark, tmp_dir)):
        held = images.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(held) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in held) == 400
        assert images.select("p_partkey").distinct().count() == 400
