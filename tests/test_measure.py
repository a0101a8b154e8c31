"""Measurement and resources."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kiln.operators import measure, resources
from kiln.sources.derived import f2_orders

SF = "/root/testdata/sf0.001"


def test_cache_is_materialised(spark):
    d = measure.cache(f2_orders(spark, SF))
    assert d.storageLevel.useMemory or d.storageLevel.useDisk
    assert spark.sparkContext._jsc.sc().getRDDStorageInfo() is not None
    d.unpersist()


def test_timed_run_and_bench(spark):
    t = measure.timed_run(lambda: f2_orders(spark, SF))
    assert t["rows"] == 1500 and t["seconds"] > 0 and t["plan_seconds"] >= 0
    runs, summary = measure.bench(spark, f2_orders(spark, SF), n=2)
    assert runs.count() == 2 and summary["rows"] == 1500 and summary["min"] <= summary["mean"] <= summary["max"]


def test_overhead_run(spark):
    res = measure.overhead_run(spark, f2_orders(spark, SF), "image", delay=0.01)
    assert res["rows"] == 1500 and res["batches"] >= 1


def test_batch_report(spark):
    rep = measure.batch_report(spark.range(0, 300, numPartitions=2)).toPandas()
    assert rep.rows.sum() == 300 and set(rep.partition) == {0, 1}


def test_stats_and_profile(spark):
    from kiln.operators.score import tensor_udf
    from kiln.sources.derived import F2_SPEC

    d = f2_orders(spark, SF)
    s = measure.stats(d)
    assert "MapInArrow" in s["plan"] or "PythonMapInArrow" in s["plan"]
    u = tensor_udf(lambda b: b.reshape(len(b), -1).astype("float32"), F2_SPEC, "float32", form="scalar")
    text = measure.profile(spark, d.select(u("image")))
    assert isinstance(text, str)


def test_partition_report_and_parallelism(spark):
    d = spark.range(0, 100, numPartitions=4)
    rep = resources.partition_report(d).collect()
    assert sum(r.rows for r in rep) == 100 and len(rep) == 4
    p = resources.parallelism(spark, d)
    assert p["partitions"] == 4 and p["default_parallelism"] >= 1


def test_resource_settings(spark):
    g = resources.gpu_settings(spark)
    assert set(g) == {"task_gpu_amount", "executor_gpu_amount", "task_cpus"}
    rep = resources.run_report(spark)
    assert rep["spark"] == spark.version and "numpy" in rep
    dev = spark.range(1).rdd.map(lambda _: resources.task_device()).collect()
    assert dev == ["cpu"]


def test_stage_profile_refused_in_local_mode(spark):
    prof = resources.stage_profile(cpus=1, gpus=1)
    with pytest.raises(resources.StageResourcesUnavailable, match="cluster manager"):
        resources.with_resources(spark, spark.range(3), lambda it: it, "id long", prof)


def test_split_bytes():
    assert resources.split_bytes_for(128, 393216) == 128 * 393216
    assert resources.batch_bytes_for(1000, 393216) > 1000 * 393216


def test_observe_counts(spark):
    d, obs = measure.observe_counts(spark.range(7))
    d.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 7
    assert d.select(F.col("id")).count() == 7


def _events(stage, millis, description="q", job=0):
    import json

    events = [
        {"Event": "SparkListenerJobStart", "Job ID": job, "Stage IDs": [stage], "Properties": {"spark.job.description": description}},
        *[{"Event": "SparkListenerTaskEnd", "Stage ID": stage,
           "Task Info": {"Launch Time": 1000, "Finish Time": 1000 + ms, "Failed": False}} for ms in millis],
        {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Launch Time": 0, "Finish Time": 5, "Failed": True}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 99, "Task Info": {"Launch Time": 0, "Finish Time": 5}},
        {"Event": "SparkListenerLogStart", "Spark Version": "x" * 70_000},
    ]
    return "\n".join(json.dumps(e) for e in events).encode()


def test_event_log_task_stats(spark, tmp_dir):
    """The same stage number in four applications, each log in another form, and a rolling one in two files."""
    import os

    jvm, conf = spark._jvm, spark.sparkContext._conf._jconf
    for i, (codec, ending) in enumerate((("ZStd", "zstd"), ("LZ4", "lz4"), ("Snappy", "snappy"))):
        out = getattr(jvm.org.apache.spark.io, f"{codec}CompressionCodec")(conf).compressedOutputStream(
            jvm.java.io.FileOutputStream(f"{tmp_dir}/app-{i}.{ending}"))
        out.write(bytearray(_events(3, (100, 200, 400), f"q{i}")))
        out.close()
    with open(f"{tmp_dir}/local-17.inprogress", "wb") as f:
        f.write(_events(3, (100, 300), "plain"))
    os.makedirs(rolling := f"{tmp_dir}/eventlog_v2_app-9")
    first, *rest = _events(3, (50, 60, 70), "rolling").split(b"\n")
    for i, lines in ((1, [first]), (2, rest)):
        with open(f"{rolling}/events_{i}_app-9", "wb") as f:
            f.write(b"\n".join(lines))
    with open(f"{rolling}/appstatus_app-9", "w"):
        pass
    stats = {r.description: (r.tasks, r.median_s, r.max_s, round(r.skew, 3)) for r in measure.event_log_task_stats(spark, tmp_dir).collect()}
    assert stats == {"q0": (3, 0.2, 0.4, 2.0), "q1": (3, 0.2, 0.4, 2.0), "q2": (3, 0.2, 0.4, 2.0), "plain": (2, 0.2, 0.3, 1.5), "rolling": (3, 0.06, 0.07, 1.167)}
    with open(f"{tmp_dir}/other.lzf", "wb") as f:
        f.write(b"ZV")
    with pytest.raises(ValueError, match="compression"):
        measure.event_log_task_stats(spark, tmp_dir)


def test_event_log_of_a_run_with_known_partitions(spark, tmp_dir):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "{tmp_dir}").getOrCreate()
s.sparkContext.setJobDescription("seven")
s.range(0, 70, numPartitions=7).write.format("noop").mode("overwrite").save()
s.stop()"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    assert [(r.description, r.tasks) for r in measure.event_log_task_stats(spark, tmp_dir).collect()] == [("seven", 7)]


def test_profile_rows(spark):
    import pandas as pd

    def one(x):
        return x + 1

    def plus(s: pd.Series) -> pd.Series:
        return s.map(one)

    d = spark.range(0, 90, numPartitions=3)
    rows = measure.profile_rows(spark, d.select(pandas_udf(plus, "long")("id").alias("x"))).collect()
    calls = {r.function: r.calls for r in rows if r.function in ("one", "plus")}
    assert calls == {"one": 90, "plus": 3}
    assert all(r.seconds >= r.own_seconds >= 0 and r.udf is not None for r in rows)


def test_tune_for(spark):
    from kiln.spec import TensorSpec

    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", resources.BATCH_ROWS,
                                                 resources.BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize")}
    try:
        conf = resources.tune_for(spark, TensorSpec.image(256, 256, 3), rows_per_task=1024, batch_rows=64)
        assert conf["spark.sql.files.maxPartitionBytes"] == str(1024 * 393216)
        assert int(conf["spark.sql.parquet.columnarReaderBatchSize"]) <= 170
        assert spark.conf.get(resources.BATCH_ROWS) == "64"
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_overhead_run_arrow(spark):
    res = measure.overhead_run(spark, f2_orders(spark, SF), "image", delay=0.0, flavor="arrow")
    assert res["rows"] == 1500 and res["batches"] >= 1
