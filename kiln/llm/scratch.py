"""Scratch tables in the shared folder, and broadcasts behind a check of their size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import ensure_checkpoint_dir, fresh_path, reader_session, ship_package
from kiln.sources.parquet import READER_BATCH

#: A side of a join is broadcast only if its rows take no more than this; beyond it Spark joins by sort and merge.
BROADCAST_BYTES = 16 << 20

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """The package for the Python workers, and the shared folder named by ``spark.checkpoint.dir``."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "zstd", batch_rows: int | None = None) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back: cuts the lineage and survives lost executors.

    The shuffle files of the write are of no more use once the table stands, so Spark may drop them; the
    session's own setting is put back.  Spark's reader decodes up to 4096 rows at once; ``batch_rows`` is for tables
    whose rows are megabytes wide: their scans hold that many rows, however many a file has.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, f"llm-{name}"), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    reader = spark if batch_rows is None else reader_session(spark, {READER_BATCH: str(batch_rows)})
    return reader.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of ``row_bytes`` each at most, fit into ``most`` bytes.

    ``df`` should be a written table: its rows are counted from the file footers.
    """
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; once a partition is done its worker, which may wait long for the next one, gives
    the memory that it no longer uses back to the machine.

    Arrow's buffers and arrays of 1 MiB or more are taken from the machine one by one, so they go back at once."""

    def tidied(batches):
        if option := getattr(ctypes.CDLL(None), "mallopt", None):
            option(-3, 1 << 20)  # M_MMAP_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied
