"""Batch size, parallelism and resources."""

from __future__ import annotations

import contextlib
import math
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batch_limits(spark: SparkSession, rows: int | None = None, max_bytes: int | None = None):
    """Set the Arrow transport batch caps for the plans *executed* inside the block
    (B1).  The caps are read when the physical plan is made, so set them before
    the action, not before building the DataFrame."""
    old = {k: spark.conf.get(k, None) for k in (BATCH_ROWS, BATCH_BYTES)}
    if rows is not None:
        spark.conf.set(BATCH_ROWS, str(int(rows)))
    if max_bytes is not None:
        spark.conf.set(BATCH_BYTES, str(int(max_bytes)))
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def batch_bytes_for(rows: int, bytes_per_row: int, headroom: float = 1.25) -> int:
    """Byte cap that lets ``rows`` rows of ``bytes_per_row`` through in one batch."""
    return int(math.ceil(rows * bytes_per_row * headroom))


def split_bytes_for(rows_per_task: int, bytes_per_row: int) -> int:
    """``spark.sql.files.maxPartitionBytes`` giving about ``rows_per_task`` rows per
    scan task.  Keeps one task's input bounded whatever the table size, so 100 TB
    turns into many bounded tasks rather than fewer, larger ones."""
    return max(1 << 20, rows_per_task * bytes_per_row)


def repartition(df: DataFrame, n: int) -> DataFrame:
    """Round-robin to ``n`` partitions (B3).  No key, so no skew from hot keys;
    costs one shuffle of every column kept – select the raw tensor and ids only."""
    return df.repartition(int(n))


def partition_report(df: DataFrame) -> DataFrame:
    """Rows per partition (B4), computed on the executors (partial aggregate)."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def parallelism(spark: SparkSession, df: DataFrame | None = None) -> dict:
    """``sc.defaultParallelism`` and the plan's partition count."""
    out = {"default_parallelism": spark.sparkContext.defaultParallelism}
    if df is not None:
        out["partitions"] = df.rdd.getNumPartitions()
    return out


def gpu_settings(spark: SparkSession) -> dict:
    """GPU amounts per task and per executor (B5), as configured."""
    get = spark.sparkContext.getConf().get
    return {"task_gpu_amount": get("spark.task.resource.gpu.amount", None),
            "executor_gpu_amount": get("spark.executor.resource.gpu.amount", None),
            "task_cpus": get("spark.task.cpus", "1")}


def task_device() -> str:
    """Inside a task: "cuda:<addr>" for the GPU Spark assigned, else "cpu" (B5)."""
    from pyspark import TaskContext

    tc = TaskContext.get()
    res = tc.resources() if tc is not None else {}
    gpu = res.get("gpu")
    return f"cuda:{gpu.addresses[0]}" if gpu is not None and gpu.addresses else "cpu"


class StageResourcesUnavailable(RuntimeError):
    pass


def stage_profile(cpus: int = 1, gpus: float = 0.0, executor_cores: int | None = None,
                  executor_gpus: int | None = None):
    """A ResourceProfile for the scoring stage."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    t = TaskResourceRequests().cpus(cpus)
    if gpus:
        t = t.resource("gpu", gpus)
    b = ResourceProfileBuilder().require(t)
    if executor_cores or executor_gpus:
        e = ExecutorResourceRequests()
        if executor_cores:
            e = e.cores(executor_cores)
        if executor_gpus:
            e = e.resource("gpu", executor_gpus)
        b = b.require(e)
    return b.build


def require_profiles(spark: SparkSession) -> None:
    """Fail before any job when the cluster manager cannot honour resource profiles."""
    if spark.sparkContext.master.startswith("local"):
        raise StageResourcesUnavailable(
            "stage-level resource profiles need a standalone, YARN or Kubernetes cluster manager")


def with_resources(spark: SparkSession, df: DataFrame, fn, schema, profile, shuffle_to: int | None = None) -> DataFrame:
    """Run ``fn`` (a mapInArrow function) under ``profile``.

    A profile only takes effect on a stage of its own, so the input is shuffled
    first (``shuffle_to`` partitions, default: current count): shuffle the raw
    tensor, not the preprocessed one.  Local mode has no resource profiles; that
    is reported before any job starts."""
    require_profiles(spark)
    n = shuffle_to or df.rdd.getNumPartitions()
    return df.repartition(n).mapInArrow(fn, schema, profile=profile)


def run_report(spark: SparkSession, keys: tuple[str, ...] = ("spark.executor.memory", "spark.driver.memory",
                                                              BATCH_ROWS, BATCH_BYTES, "spark.task.cpus",
                                                              "spark.task.resource.gpu.amount",
                                                              "spark.sql.shuffle.partitions")) -> dict:
    """Effective settings and versions."""
    import numpy
    import pyarrow
    import pyspark

    conf = spark.sparkContext.getConf()
    out = {k: spark.conf.get(k, None) or conf.get(k, None) for k in keys}
    out.update({"spark": spark.version, "pyspark": pyspark.__version__, "numpy": numpy.__version__,
                "pyarrow": pyarrow.__version__, "python": platform.python_version(),
                "master": spark.sparkContext.master,
                "default_parallelism": spark.sparkContext.defaultParallelism})
    try:
        import onnxruntime

        out["onnxruntime"] = onnxruntime.__version__
        out["onnx_providers"] = ",".join(onnxruntime.get_available_providers())
    except ImportError:
        out["onnxruntime"] = None
    return out


def tune_for(spark: SparkSession, spec, rows_per_task: int = 1024, batch_rows: int = 64,
             reader_batch_bytes: int = 64 << 20) -> dict:
    """Session settings for scoring rows of ``spec`` (the capacity plan in one call).

    * ``spark.sql.files.maxPartitionBytes``: about ``rows_per_task`` rows per scan task;
    * ``spark.sql.parquet.columnarReaderBatchSize``: at most ``reader_batch_bytes`` per
      columnar batch (lowered only);
    * Arrow batches of ``batch_rows`` rows, with a byte cap that lets them through.

    Returns the values set.  Applies to plans executed afterwards."""
    from kiln.sources.parquet import READER_BATCH, reader_rows

    row = spec.nbytes
    conf = {
        "spark.sql.files.maxPartitionBytes": str(split_bytes_for(rows_per_task, row)),
        BATCH_ROWS: str(int(batch_rows)),
        BATCH_BYTES: str(batch_bytes_for(batch_rows, row)),
    }
    conf[READER_BATCH] = str(reader_rows(spark, row, reader_batch_bytes))
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
