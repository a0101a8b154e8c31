"""Parquet scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kiln.session import reader_session
from kiln.sources.listing import list_files, plain, spark_listing
from kiln.spec import TensorSpec


class SchemaMismatch(ValueError):
    pass


READER_BATCH = "spark.sql.parquet.columnarReaderBatchSize"
DEFAULT_READER_BATCH_BYTES = 64 << 20


def reader_rows(spark: SparkSession, row_bytes: int, budget: int = DEFAULT_READER_BATCH_BYTES) -> int:
    """Rows per columnar batch of the parquet reader so that one batch of ``row_bytes``-wide rows stays under
    ``budget`` (the default of 4,096 rows would be 1.6 GB per task for 256x256x3 int16 images); never above the
    session's setting."""
    return min(int(spark.conf.get(READER_BATCH, "4096")), max(1, budget // max(1, row_bytes)))


def split_conf(tasks: int) -> dict:
    """Reader settings that cut a scan into about ``tasks`` splits by bytes, instead of a shuffle behind it.  A row group is
    never cut: its rows go to the split that holds its middle."""
    return {"spark.sql.files.minPartitionNum": str(int(tasks)), "spark.sql.files.openCostInBytes": "1"}


def read_tensors(spark: SparkSession, path: str, column: str = "image", spec: TensorSpec | None = None,
                 keep: list[str] | None = None, alias: str | None = None,
                 reader_batch_bytes: int = DEFAULT_READER_BATCH_BYTES, tasks: int | None = None) -> DataFrame:
    """Scan a parquet table of tensors (S1, and S2 for a persisted intermediate).

    Only ``keep`` + ``column`` are read (column pruning reaches the scan).  The
    column type is checked against ``spec`` before any job runs; the spec is
    recorded in the column metadata for later operators.  A columnar batch holds at most ``reader_batch_bytes`` of
    tensor data, and with ``tasks`` the scan is cut into about that many splits; both belong to this read alone
    (``session.reader_session``): the settings of ``spark`` stay as they are, and changes to them after this call
    reach the DataFrame through ``df.sparkSession``.
    """
    df = spark.read.parquet(path)
    if column not in df.columns:
        raise SchemaMismatch(f"{path}: no column {column!r}; columns are {df.columns}")
    found = TensorSpec.of(df, column)
    spec = spec or found
    if spec is None:
        raise SchemaMismatch(f"{path}: column {column!r} has no tensor spec; pass spec=")
    dt = df.schema[column].dataType.simpleString()
    want = "binary" if spec.encoding == "bytes" else "array"
    if dt.split("<")[0] != want:
        raise SchemaMismatch(f"{path}: column {column!r} is {dt}, expected {want} for {spec.encoding} tensors")
    keep = list(keep) if keep is not None else [c for c in df.columns if c != column]
    rows = reader_rows(spark, spec.nbytes, reader_batch_bytes)
    own = {READER_BATCH: str(rows)} if rows < int(spark.conf.get(READER_BATCH, "4096")) else {}
    own |= split_conf(tasks) if tasks else {}
    if own:
        df = reader_session(spark, own).read.schema(df.schema).parquet(path)
    return df.select(*keep, spec.tag(column, alias or column))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", max_records_per_file: int | None = None,
                  observe: bool = True, compression: str | None = None) -> dict:
    """Parquet sink (S6).  Returns the rows actually written (via an ``Observation``
    on the executed plan, so it counts what the UDFs produced, not the input)."""
    obs = Observation("kiln_write") if observe else None
    d = df.observe(obs, F.count(F.lit(1)).alias("rows")) if observe else df
    w = d.write.mode(mode).format("parquet")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if compression:
        w = w.option("compression", compression)  # e.g. "none" for float hand-offs that barely compress
    w.save(path)
    return dict(obs.get) if observe else {}


def write_noop(df: DataFrame) -> dict:
    """Run the whole plan and discard the rows (S7); returns observed row count."""
    obs = Observation("kiln_noop")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format("noop").save()
    return dict(obs.get)


class TooManyRows(RuntimeError):
    pass


def collect_bounded(df: DataFrame, max_rows: int) -> list:
    """Collect to the driver only when the result has at most ``max_rows`` rows.

    Takes ``max_rows + 1`` rows, so an oversized result fails without being
    pulled whole."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooManyRows(f"result has more than {max_rows} rows; write it instead of collecting")
    return rows


def manifest(spark: SparkSession, path: str, by_executors: bool = True) -> DataFrame:
    """Per-file listing of a parquet folder or file (S10): file_path (without scheme), file_name, rows, bytes.

    ``by_executors``: the executors list the folder level by level (``listing.list_files``); else Spark's index does,
    for file systems that only Spark's readers open.  Either way the listing is a table, joined to the rows counted by
    the hidden ``_metadata`` column (a partial aggregate per task, one row per file reaches the shuffle); no list of
    names passes through the program.  Files without rows are there too, with 0 rows; a folder without files
    gives no rows."""
    if by_executors:
        listed = list_files(spark, path).select(plain("path").alias("file_path"), F.col("size").alias("bytes"))
    else:
        listed = spark_listing(spark, path).select(plain("file_path").alias("file_path"), "bytes")
    read = spark.read.option("recursiveFileLookup", "true").format("parquet")
    if not listed.limit(1).count():
        return listed.select("file_path", F.lit("").alias("file_name"), F.lit(0).cast("long").alias("rows"), "bytes")
    counted = read.load(path).groupBy(plain("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("rows"))
    named = listed.withColumn("file_name", F.regexp_extract("file_path", "[^/]*$", 0))
    return named.join(counted, "file_path", "left").select("file_path", "file_name", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes")


def pack(df: DataFrame, path: str, rows_per_file: int = 1000, partitions: int | None = None) -> dict:
    """Pack many small images into parquet files of at most ``rows_per_file`` rows
    (S12).  Small partitions are first merged, without a shuffle, to as many as the
    rows need at ``rows_per_file`` each; a merged partition above that is cut, so
    there are at most twice as many files as needed.  ``partitions`` rebalances
    instead (round robin, no key skew).  The rows are counted for it once, with all
    columns pruned (from the footers, for parquet)."""
    if partitions:
        df = df.repartition(partitions)
    else:
        df = df.coalesce(max(1, -(-df.count() // rows_per_file)))
    return write_parquet(df, path, max_records_per_file=rows_per_file)
