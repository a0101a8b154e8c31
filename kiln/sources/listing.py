"""Listing files as DataFrames.

Spark's file index keeps the status of every file on the driver; for a billion small images that is more than a
driver holds.  ``list_files`` lists level by level instead: the folders of one level are a DataFrame, spread over all
tasks, each task lists its folders one level deep, and the folders that it finds are the next level's DataFrame.  So
neither a deep nor a wide tree becomes one task, and the driver sees no names but the roots.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import fresh_path

#: Files that are listed in one record batch.
LIST_ROWS = 10_000


def filesystem_of(path: str):
    """(pyarrow filesystem, path in it) of a plain path or a URI."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def hidden_to_spark(name: str) -> bool:
    """The names that Spark's own index leaves out, to the letter."""
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _level(batches, hidden=hidden):
    """One level of each folder: its files and its sub-folders."""
    from pyarrow import fs as pafs

    systems: dict = {}
    for b in batches:
        for folder, deep in zip(b.column("path").to_pylist(), b.column("deep").to_pylist(), strict=True):
            scheme = folder.split("://", 1)[0] if "://" in folder else ""
            if scheme in ("", "file"):  # one file system object for all local folders; stores are opened by URI
                filesystem, top = systems.setdefault("", filesystem_of("/")[0]), folder.removeprefix("file://")
            else:
                filesystem, top = filesystem_of(folder)
            prefix = folder[: len(folder) - len(top)] if folder.endswith(top) else ""
            found = [i for i in filesystem.get_file_info(pafs.FileSelector(top, recursive=False))
                     if not hidden(i.base_name) and (i.type == pafs.FileType.File or deep and i.type == pafs.FileType.Directory)]
            for lo in range(0, len(found), LIST_ROWS):
                part = found[lo:lo + LIST_ROWS]
                is_folder = [i.type == pafs.FileType.Directory for i in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prefix + i.path for i in part], pa.string()), pa.array([i.size if i.size is not None else 0 for i in part], pa.int64()),
                     pa.array(is_folder), pa.array([True] * len(part))], names=["path", "size", "folder", "deep"])


def list_files(spark: SparkSession, folders: str | list[str], suffixes: tuple[str, ...] | None = None,
               partitions: int | None = None, recursive: bool = True, hidden=hidden) -> DataFrame:
    """(path, size) of every file under ``folders``, at any depth, listed by the executors level by level.

    As in Spark's own index, names that begin with "_" or "." are left out, with all below them; ``suffixes`` narrows
    the rest (case ignored).  Each level is a table in the shared folder.  Paths are plain or URIs that ``pyarrow.fs`` knows."""
    roots = [folders] if isinstance(folders, str) else list(folders)
    n = partitions or spark.sparkContext.defaultParallelism * 4
    frontier = spark.createDataFrame([(x, recursive) for x in roots], "path string, deep boolean")
    found = None
    while True:
        path = fresh_path(spark, "kiln-listing")
        schema = "path string, size long, folder boolean, deep boolean"
        frontier.select("path", "deep").repartition(n).mapInArrow(lambda batches: _level(batches, hidden), schema).write.parquet(path)
        level = spark.read.schema(schema).parquet(path)
        files = level.where("not folder").select("path", "size")
        found = files if found is None else found.union(files)
        frontier = level.where("folder")
        if not frontier.limit(1).count():
            break
    if suffixes:
        found = found.where(F.lower("path").rlike("(" + "|".join(x.lower().replace(".", r"\.") for x in suffixes) + ")$"))
    return found


def local_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame | None:
    """(path, size) of the files that Spark's file sources read in ``path`` at any depth, listed by the executors; ``glob``
    is their pathGlobFilter.  None where only Spark lists: other stores than the local one, patterns, single files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.getUri().getScheme() != "file" or any(c in path for c in "{}[]*?\\") or not (store.exists(where) and store.getFileStatus(where).isDirectory()):
        return None
    files, name = list_files(spark, store.makeQualified(where).toUri().getPath(), hidden=hidden_to_spark), F.regexp_extract("path", "[^/]*$", 0)
    files = files.where((F.col("size") > 0) & ~(name.startswith("_") & ~name.contains("=")))  # nor does Spark read others
    return files.where(name.rlike(f"(?s)^(?:{hadoop.GlobPattern(glob).compiled().pattern()})$")) if glob else files


#: Paths that one task deals out: few such tasks deal evenly.
DEALT_ROWS = 1_000_000


def dealt(files: DataFrame, open_cost: int, *columns: str) -> DataFrame:
    """``columns`` (path) in as many tasks as Spark would cut for files that cost ``open_cost`` bytes each to open, and as many files in
    each: a folder with a large share of the files is not one task."""
    spark = files.sparkSession
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    n, total = files.agg(F.count(F.lit(1)), F.sum(F.col("size") + F.lit(open_cost))).first()
    each = min(most, max(open_cost, (total or 0) // spark.sparkContext.defaultParallelism))
    tasks, columns = max(1, -(-(total or 0) // each)), columns or ("path",)
    rows = files.select(*columns).coalesce(max(1, -(-n // DEALT_ROWS))).withColumn("at", F.monotonically_increasing_id())
    return rows.repartitionById(tasks, F.pmod("at", F.lit(tasks)).cast("int")).select(*columns)


def plain(path_col: str) -> F.Column:
    """A file's path without scheme and percent signs, so that listings by different readers can be joined."""
    return F.expr(f"regexp_replace(url_decode(replace({path_col}, '+', '%2B')), '^[A-Za-z][A-Za-z0-9+.-]*:/+', '/')")


def spark_listing(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_name, bytes) by Spark's own index, for file systems that only Spark's readers open; contents are
    not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("length").alias("bytes"))
