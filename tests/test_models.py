"""Models, distribution and the per-batch cardinality check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln import models
from kiln.models import MLP, LinearModel, ModelHandle, ModelOutputError, load_model, save_model
from kiln.operators.score import checked_predict, predict_map, predict_udf
from kiln.spec import TensorSpec


def test_formula_weights_fixture():
    w = models.formula_weights(10, 64)
    k, j = 3, 5
    assert w[k, j] == (((k * 31 + j * 17) % 101) - 50) / 100
    assert w.shape == (10, 64)


def test_linear_and_mlp_predict():
    x = np.random.default_rng(1).random((5, 16))
    lin = LinearModel.formula(10, 16)
    np.testing.assert_allclose(lin.predict(x), x @ models.formula_weights(10, 16).T)
    mlp = MLP.formula(4, 8, 16)
    h = np.maximum(x @ mlp.w1.T, 0)
    np.testing.assert_allclose(mlp.predict(x), h @ mlp.w2.T)
    with pytest.raises(ValueError):
        lin.predict(np.ones((2, 3)))


def test_save_load_roundtrip(spark, tmp_dir):
    for m in (LinearModel.formula(3, 4), MLP.formula(2, 3, 4)):
        p = save_model(m, f"{tmp_dir}/{m.kind}")
        back = load_model(p)
        x = np.ones((2, 4))
        np.testing.assert_array_equal(back.predict(x), m.predict(x))
        by_uri = save_model(m, f"file:{tmp_dir}/uri-{m.kind}/", spark)
        np.testing.assert_array_equal(load_model(f"{tmp_dir}/uri-{m.kind}").predict(x), m.predict(x))
        np.testing.assert_array_equal(load_model(by_uri).predict(x), load_model(f"file://{tmp_dir}/{m.kind}").predict(x))
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        load_model(f"{tmp_dir}/nowhere")


def test_handle_memo_and_build(spark):
    h = ModelHandle.from_path(save_model(LinearModel.formula(2, 2), __import__("tempfile").mkdtemp()))
    before = models.BUILD_COUNT["n"]
    a, b = h.get(), h.get()
    assert a is b and models.BUILD_COUNT["n"] == before + 1
    assert h.build() is not a


class _Half(LinearModel):
    """A subclass whose own ``predict`` must survive any way of sending it."""

    def predict(self, batch):
        return super().predict(batch) / 2


def test_a_model_of_any_size_gives_one_answer(spark):
    df = spark.range(4).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("x"))
    for model in (LinearModel.formula(2, 2), _Half(*LinearModel.formula(2, 2).__dict__.values())):
        want = list(model.predict(np.array([[1.0, 2.0]]))[0])
        small, big = ModelHandle.create(spark, model), ModelHandle.create(spark, model, max_broadcast_bytes=10)
        assert small.broadcast and not big.broadcast
        for h in (small, big):
            out = predict_map(df, h, "x", TensorSpec.vector(2), keep=["id"], dtype="float64").collect()
            assert [r["prediction"] for r in out] == [want] * 4


class _Dropper:
    kind = "linear"

    def predict(self, batch):
        return batch[:-1] if len(batch) > 1 else batch


def test_checked_predict_raises():
    with pytest.raises(ModelOutputError, match="returned 2 rows for a batch of 3"):
        checked_predict(_Dropper(), np.ones((3, 2)))


def test_wrong_count_model_fails_the_job(spark):
    h = ModelHandle.create(spark, _Dropper())
    df = spark.range(20).select("id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("x"))
    with pytest.raises(Exception, match="ModelOutputError"):
        predict_map(df, h, "x", TensorSpec.vector(2), keep=["id"]).collect()
    u = predict_udf(h, TensorSpec.vector(2))
    with pytest.raises(Exception, match="ModelOutputError"):
        df.select(u("x")).collect()


def test_onnx_model_in_process_and_in_spark(spark, tmp_dir):
    pytest.importorskip("onnxruntime")
    from kiln.models import OnnxModel
    from tests.onnx_fixture import write_matmul_model

    w = models.formula_weights(10, 16).T.astype(np.float32)  # (16, 10)
    path = write_matmul_model(f"{tmp_dir}/linear.onnx", w)
    m = OnnxModel(path, device="auto")
    x = np.random.default_rng(3).random((7, 16)).astype(np.float32)
    np.testing.assert_allclose(m.predict(x), x @ w, rtol=1e-5, atol=1e-5)
    back = load_model(save_model(m, f"{tmp_dir}/onnx-ckpt"))
    np.testing.assert_allclose(back.predict(x), x @ w, rtol=1e-5, atol=1e-5)

    h = ModelHandle.create(spark, m)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(7)], "id long, x array<float>")
    out = predict_map(df, h, "x", TensorSpec.vector(16), keep=["id"]).orderBy("id").toPandas()
    np.testing.assert_allclose(np.stack(out.prediction.values), x @ w, rtol=1e-5, atol=1e-5)


def test_reliable_cache(spark):
    from kiln.operators.measure import cache

    d = cache(spark.range(10), reliable=True)
    assert d.count() == 10
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Range" not in plan  # lineage cut at the checkpoint


def test_profiled_refused_locally(spark):
    from kiln.functions import Preprocess
    from kiln.operators.resources import StageResourcesUnavailable, stage_profile
    from kiln.plans import ScoringPlan

    plan = ScoringPlan(Preprocess(TensorSpec.image(4, 4, 3), resize=None, crop=2),
                       ModelHandle.create(spark, LinearModel.formula(2, 12)), "image", ["id"])
    with pytest.raises(StageResourcesUnavailable):
        plan.profiled(spark, spark.range(1), stage_profile(gpus=1))


def test_onnx_weights_travel_with_the_model(tmp_dir):
    ort = pytest.importorskip("onnxruntime")
    import pickle

    from kiln.models import OnnxModel
    from tests.onnx_fixture import write_matmul_model

    w = np.arange(12, dtype=np.float32).reshape(4, 3)
    x = np.ones((2, 4), np.float32)
    path = write_matmul_model(f"{tmp_dir}/travels.onnx", w)
    want = OnnxModel(path).predict(x)
    sent, saved = pickle.dumps(OnnxModel(path)), save_model(OnnxModel(path), f"{tmp_dir}/travels-ckpt")
    by_path = pickle.dumps(OnnxModel(path, ship=False))
    with open(path, "wb"):
        pass  # the file is of no use any more
    assert (pickle.loads(sent).predict(x) == want).all() and (load_model(saved).predict(x) == want).all()
    assert (pickle.loads(pickle.dumps(pickle.loads(sent))).predict(x) == want).all()
    with pytest.raises(Exception):
        pickle.loads(by_path).predict(x)
    if "CUDAExecutionProvider" not in ort.get_available_providers():
        moved = pickle.loads(sent)
        moved.device = "cuda:0"
        with pytest.raises(RuntimeError, match="CUDA provider"):
            moved.predict(x)
