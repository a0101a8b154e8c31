"""Counting, timing and profiling.

Counts come from an ``Observation`` on the executed plan: ``df.count()`` prunes
Python UDFs out of the plan, so it only counts the input.
"""

from __future__ import annotations

import contextlib
import io
import re
import statistics
import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kiln.sources.parquet import write_noop, write_parquet


def cache(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, reliable: bool = False) -> DataFrame:
    """Persist and materialise now (C1).  ``cache()`` alone is lazy.  Blocks lost
    with an executor are recomputed from lineage; ``reliable=True`` instead writes
    a checkpoint into ``spark.checkpoint.dir`` (shared storage), which cuts the
    lineage and survives executor loss without recomputing."""
    if reliable:
        from kiln.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    d = df.persist(level)
    d.write.mode("overwrite").format("noop").save()
    return d


def count_rows(df: DataFrame) -> int:
    """Rows produced by the full plan, UDFs included (A1)."""
    return int(write_noop(df)["rows"])


def timed_run(df: DataFrame | Callable[[], DataFrame], sink: str | None = None) -> dict:
    """Run to a sink and time it (A2, A3).

    ``df`` may be a callable that builds the DataFrame; then ``plan_seconds``
    covers building it (file listing, footers) and ``seconds`` the execution,
    the two clocks of the reference.  ``sink`` None = noop, else a parquet path.
    """
    t0 = time.perf_counter()
    d = df() if callable(df) else df
    d._jdf.queryExecution().executedPlan()  # analysis + planning, includes listing
    t1 = time.perf_counter()
    res = write_noop(d) if sink is None else write_parquet(d, sink)
    t2 = time.perf_counter()
    rows = int(res.get("rows", 0))
    run = t2 - t1
    return {"rows": rows, "plan_seconds": t1 - t0, "seconds": run, "total_seconds": t2 - t0,
            "rows_per_second": rows / run if run > 0 else float("inf"),
            "rows_per_second_total": rows / (t2 - t0) if t2 > t0 else float("inf")}


def bench(spark: SparkSession, df: DataFrame | Callable[[], DataFrame], n: int = 6) -> tuple[DataFrame, dict]:
    """Run ``n`` times (A4).  Returns the runs as a DataFrame and mean/min/max."""
    runs = [dict(run=i, **timed_run(df)) for i in range(n)]
    secs = [r["seconds"] for r in runs]
    summary = {"runs": n, "mean": statistics.fmean(secs), "min": min(secs), "max": max(secs),
               "rows": runs[-1]["rows"]}
    out = spark.createDataFrame([(r["run"], r["rows"], float(r["seconds"])) for r in runs],
                                "run int, rows long, seconds double")
    return out, summary


def stats(df: DataFrame) -> dict:
    """Execution statistics (A5): formatted plan and observed row count."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    t = timed_run(df)
    return {"plan": buf.getvalue(), **t}


def profile(spark: SparkSession, df: DataFrame, kind: str = "perf") -> str:
    """Profile the Python UDFs of one run (A6) with Spark's UDF profiler;
    returns the printed report."""
    old = spark.conf.get("spark.sql.pyspark.udf.profiler", None)
    spark.conf.set("spark.sql.pyspark.udf.profiler", kind)
    try:
        spark.profile.clear()
        write_noop(df)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            spark.profile.show(type=kind)
        return buf.getvalue()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.pyspark.udf.profiler")
        else:
            spark.conf.set("spark.sql.pyspark.udf.profiler", old)


_PROFILE_LINE = re.compile(r"^\s*(\d+)(?:/\d+)?\s+([\d.]+)\s+[\d.]+\s+([\d.]+)\s+[\d.]+\s+(\S.*)$")
_PROFILE_PLACE = re.compile(r"^(?:(.*):(\d+)\((.*)\)|\{(.*)\})$")


def profile_rows(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``profile`` as data (A6): udf (its number), function, file, line, calls, own_seconds, seconds (with what it calls),
    one row per function that the Python UDFs of one run called, summed over all tasks by Spark."""
    rows, udf = [], None
    for text in profile(spark, df).splitlines():
        if found := re.search(r"UDF<id=(\d+)>", text):
            udf = int(found[1])
        elif found := _PROFILE_LINE.match(text):
            place = _PROFILE_PLACE.match(found[4])
            file, line, name, built_in = place.groups() if place else (None, None, found[4], None)
            rows.append((udf, name or built_in, file, int(line) if line else None, int(found[1]), float(found[2]), float(found[3])))
    return spark.createDataFrame(rows, "udf int, function string, file string, line int, calls long, own_seconds double, seconds double")


def overhead_run(spark: SparkSession, df: DataFrame, column: str, delay: float = 1.0,
                 flavor: str = "pandas") -> dict:
    """UDF overhead microbenchmark (A7): materialise the input (C1), pass
    ``column`` through an identity UDF that sleeps ``delay`` per batch, time the
    run.  Ideal time = batches x delay / concurrent tasks.  ``flavor="arrow"``
    uses an Arrow UDF, which skips the pandas conversion of every row."""
    src = cache(df.select(column))
    acc = spark.sparkContext.accumulator(0)
    dt = src.schema[column].dataType

    def ident(s: pd.Series) -> pd.Series:
        time.sleep(delay)
        acc.add(1)
        return s

    def ident_arrow(a: pa.Array) -> pa.Array:
        time.sleep(delay)
        acc.add(1)
        return a

    udf = F.arrow_udf(ident_arrow, dt) if flavor == "arrow" else F.pandas_udf(ident, dt)
    out = src.select(udf(F.col(column)).alias(column))
    t = timed_run(out)
    src.unpersist()
    return {"rows": t["rows"], "batches": acc.value, "seconds": t["seconds"], "delay": delay}


def batch_report(df: DataFrame) -> DataFrame:
    """One row per Arrow batch a Python worker receives: (partition, batch, rows)."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        parts, seqs, rows = [], [], []
        for i, b in enumerate(batches):
            parts.append(pid), seqs.append(i), rows.append(b.num_rows)
        yield pa.RecordBatch.from_pydict({"partition": pa.array(parts, pa.int32()),
                                          "batch": pa.array(seqs, pa.int32()),
                                          "rows": pa.array(rows, pa.int64())})

    return df.mapInArrow(run, "partition int, batch int, rows long")


def observe_counts(df: DataFrame, name: str = "kiln") -> tuple[DataFrame, Observation]:
    """Attach a row counter to a plan; read ``obs.get`` after the action."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


_COMPRESSED = (".zstd", ".zst", ".lz4", ".snappy")
_EVENTS = (b'"SparkListenerJobStart"', b'"SparkListenerTaskEnd"')


def _lz4_blocks(raw: bytes):
    """Spark's lz4 streams: blocks of magic, kind, sizes and checksum, then data."""
    codec, at = pa.Codec("lz4_raw"), 0
    while raw[at:at + 8] == b"LZ4Block":
        packed, plain = (int.from_bytes(raw[at + i:at + i + 4], "little") for i in (9, 13))
        data = raw[at + 21:at + 21 + packed]
        yield (data if raw[at + 8] & 0xF0 == 0x10 else codec.decompress(data, plain).to_pybytes()) if plain else b""
        at += 21 + packed


def _snappy_blocks(raw: bytes):
    """Spark's snappy streams: a header of 16 bytes, then blocks behind their length."""
    codec, at = pa.Codec("snappy"), 16
    while at < len(raw):
        end = at + 4 + int.from_bytes(raw[at:at + 4], "big")
        plain = shift = 0
        for i, byte in enumerate(raw[at + 4:end]):  # its own length comes first, seven bits to a byte
            plain |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        yield codec.decompress(raw[at + 4:end], plain).to_pybytes()
        at = end


def _log_lines(batches):
    """The job-start and task-end events of compressed logs, one line each."""
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if path.endswith((".zstd", ".zst")):
                import zstandard

                data = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
            else:
                data = b"".join((_lz4_blocks if path.endswith(".lz4") else _snappy_blocks)(raw))
            lines = [x for x in data.split(b"\n") if any(e in x for e in _EVENTS)]
            for lo in range(0, len(lines), 10_000):
                part = lines[lo:lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([x.decode() for x in part])], ["path", "value"])


def event_log_task_stats(spark: SparkSession, log_dir: str) -> DataFrame:
    """Task times per job description from Spark event logs (A5), as a Spark job: description, tasks, median_s, max_s,
    skew (the slowest task over the median one, the straggler measure).

    Set ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir`` before a session starts, label actions with
    ``sc.setJobDescription(name)`` and stop it (which flushes the log).  Logs may be single files or rolling folders,
    plain or compressed by zstd, lz4 or snappy; another ending raises, no log is skipped.  Events are joined to jobs by stage
    within one application; failed tasks, and stages without a description, do not count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(log_dir)
    files = files.where("not regexp_extract(path, '[^/]*$', 0) like 'appstatus%'")
    ending = F.regexp_extract("path", r"\.([a-z0-9]+)$", 1)
    odd = files.where(ending.isin("lzf", "gz")).select("path").first()
    if odd:
        raise ValueError(f"event log {odd[0]}: its compression is not known here")
    packed = ending.isin(*(x[1:] for x in _COMPRESSED))
    plain = [r.path for r in files.where(~packed).select("path").collect()]  # one name for each log
    lines = files.where(packed).select("path", "content").mapInArrow(_log_lines, "path string, value string")
    if plain:
        lines = lines.union(spark.read.text(plain).select(F.col("_metadata.file_path").alias("path"), "value"))
    schema = ("Event string, `Job ID` long, `Stage IDs` array<long>, Properties map<string,string>, `Stage ID` long, "
              "`Task Info` struct<`Launch Time`:long,`Finish Time`:long,Failed:boolean>")
    app = F.regexp_replace(F.regexp_replace("path", r"/events_[^/]*$", ""), r"(\.inprogress)?(\.[a-z0-9]+)?$", "")
    event = lines.where(F.col("value").rlike("SparkListener(JobStart|TaskEnd)")).select(app.alias("app"), F.from_json("value", schema).alias("e")).select("app", "e.*")
    jobs = event.where("Event = 'SparkListenerJobStart'").select("app", "Job ID", F.col("Properties")["spark.job.description"].alias("description"), F.explode("Stage IDs").alias("stage"))
    jobs = jobs.where("description is not null").groupBy("app", "stage").agg(F.max_by("description", "Job ID").alias("description"))
    tasks = event.where("Event = 'SparkListenerTaskEnd' and `Task Info`.`Finish Time` > 0 and not coalesce(`Task Info`.Failed, false)")
    tasks = tasks.select("app", F.col("Stage ID").alias("stage"), ((F.col("`Task Info`.`Finish Time`") - F.col("`Task Info`.`Launch Time`")) / 1000).alias("s"))
    out = tasks.join(jobs, ["app", "stage"]).groupBy("description").agg(F.count(F.lit(1)).alias("tasks"), F.percentile("s", 0.5).alias("median_s"), F.max("s").alias("max_s"))
    return out.withColumn("skew", F.when(F.col("median_s") > 0, F.col("max_s") / F.col("median_s")))
