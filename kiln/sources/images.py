"""Image files and parquet payloads.

* Image files: Spark's ``image`` source decodes in the JVM; we turn its BGR(A)
  bytes into an RGB HWC row in ``mapInArrow``.  ``binaryFile`` + a Python
  decoder covers formats the JVM reader lacks.
* Parquet payloads: a binary column holding whole parquet files, decoded per row.
"""

from __future__ import annotations

import io
import unicodedata
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import ndarray as nd
from kiln.functions.png import ImageDecodeError, cut_png, decode_image, encode_png, plain_png, to_rgb
from kiln.session import fresh_path, reader_session
from kiln.sources.listing import dealt, filesystem_of, list_files, local_files
from kiln.spec import TensorSpec

IMAGE_FORMATS = ("parquet", "image", "binary", "sharded")
DEFAULT_MAX_PAYLOAD_BYTES = 100 << 20  # per-request ceiling the reference hit

#: Spark reads many small files in one task by what opening a file is said to cost in bytes: of its 4 MiB only 32
#: files fit into a task of 128 MiB, so a million files would be 31,250 tasks; of 128 KiB, 1,024 do, some seconds of the
#: JVM decoder, so that the last tasks do not keep the others waiting.  Block locations are not asked for, one call for
#: each file.
_OPEN_COST = 128 << 10
_SMALL_FILES = {"spark.sql.files.openCostInBytes": str(_OPEN_COST), "spark.sql.sources.ignoreDataLocality": "true"}

#: The same for a look at each file: nothing is decoded by the JVM, and a task takes more of them.
_LOOK_COST = 16 << 10

#: Files that Spark's index holds on the driver at once, where the executors have listed them.
INDEXED_FILES = 50_000

_IMAGE_SCHEMA = "path string, height int, width int, channels int, image array<short>"


def _rgb_rows(datas, heights, widths, nchannels, on_invalid: str):
    out, hs, ws, cs, ok = [], [], [], [], []
    for data, h, w, c in zip(datas, heights, widths, nchannels):
        if data is None or h is None or h <= 0 or w <= 0 or len(data) != h * w * c:
            if on_invalid == "raise":
                raise ImageDecodeError("undecodable image file")
            out.append(None), hs.append(None), ws.append(None), cs.append(None), ok.append(False)
            continue
        px = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
        if c >= 3:  # JVM order is BGR(A)
            px = px[:, :, [2, 1, 0]]
        px = to_rgb(px)
        out.append(px.reshape(-1).astype(np.int16)), hs.append(h), ws.append(w), cs.append(3), ok.append(True)
    return out, hs, ws, cs, ok


def _jvm_images(spark: SparkSession, paths: list[str], on_invalid: str, glob: str | None = None, globs: bool = True) -> DataFrame:
    """(path, height, width, channels, data) by Spark's ``image`` source; ``globs=False``: paths are names, not patterns."""
    own = {} if globs else {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(spark.sparkContext.defaultParallelism * 4)}
    r = reader_session(spark, _SMALL_FILES | own).read.format("image").option("dropInvalid", on_invalid == "drop").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("__globPaths__", str(globs).lower()).load(paths).select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"))


_LEGAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-!.~'()*,;:$&+=/@")


def file_uri(path: str) -> str:
    """A local path as Spark's ``image`` source names it."""
    quoted = (c if c in _LEGAL or ord(c) > 127 and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp") else quote(c, safe="") for c in path)
    return "file://" + "".join(quoted)


def _sort_files(batches):
    """For each file whether it is a plain PNG, one cut off in its header, or left to the JVM, and its size."""
    for b in batches:
        kinds, sizes = [], []
        for path in b.column("path").to_pylist():
            with open(path, "rb") as f:
                data = f.read()
            kinds.append("cut" if cut_png(data) else "jvm" if plain_png(data) is None else "plain"), sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64())], names=["path", "kind", "size"])


def _plain_images(batches):
    """Plain PNGs as the JVM decoder gives them: BGR(A), grey without alpha; cut ones as it marks undecodable files."""
    for b in batches:
        for lo in range(0, b.num_rows, 32):
            part, rows = b.slice(lo, 32), []
            for path, kind in zip(part.column("path").to_pylist(), part.column("kind").to_pylist(), strict=True):
                if kind == "cut":
                    rows.append((file_uri(path), -1, -1, -1, b""))
                    continue
                with open(path, "rb") as f:
                    px = plain_png(f.read())
                if px is None:
                    raise ImageDecodeError(f"{path} changed while it was read")
                px = px[:, :, {1: [0], 2: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[px.shape[2]]]
                rows.append((file_uri(path), *px.shape, px.tobytes()))
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names=["path", "height", "width", "channels", "data"])


def _local_images(spark: SparkSession, files: DataFrame, on_invalid: str) -> DataFrame:
    """``_jvm_images`` of files that the executors have listed."""
    kinds, fields = fresh_path(spark, "kiln-kinds"), "path string, kind string, size long"
    dealt(files, _LOOK_COST).mapInArrow(_sort_files, fields).write.parquet(kinds)
    kinds = spark.read.schema(fields).parquet(kinds)
    here = kinds.where(F.col("kind") == "plain" if on_invalid == "drop" else F.col("kind").isin("plain", "cut"))
    schema = "path string, height int, width int, channels int, data binary"
    out = dealt(here, _OPEN_COST, "path", "kind").mapInArrow(_plain_images, schema)
    left = kinds.where("kind = 'jvm'").select("path")
    n = left.count()
    if n and n <= INDEXED_FILES:
        return out.union(_jvm_images(spark, [x.path for x in left.collect()], on_invalid, globs=False))
    if n:
        made, parts = fresh_path(spark, "kiln-decoded"), -(-n * 5 // (4 * INDEXED_FILES))
        for k in range(parts):
            some = [x.path for x in left.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k).collect()]
            if some:
                _jvm_images(spark, some, on_invalid, globs=False).write.mode("append").parquet(made)
        out = out.union(spark.read.schema(schema).parquet(made))
    return out


def read_image_files(spark: SparkSession, path: str, on_invalid: str = "raise",
                     glob: str | None = None, raw: bool = False) -> DataFrame:
    """Folder of image files -> (path, height, width, channels=3, image HWC RGB) (S3).

    All files under ``path`` are read, at any depth and whatever their suffix.
    ``on_invalid``: "raise" fails the task at an undecodable file, "null" keeps it
    with a null image (so it can be counted), "drop" leaves it out.  Images keep their own size; follow with
    ``score.map_images`` (resize + crop per size group).  ``raw=True`` returns the
    JVM decoder's columns untouched (``data`` = BGR(A) bytes, ``channels`` as
    stored); ``map_images(..., channels="channels", bgr=True)`` then preprocesses
    and scores in one pass.

    Spark's source holds the status of every file on the driver and builds an encoder anew for each, milliseconds a file.
    So the executors list a local folder, and files that any decoder reads alike (``plain_png``) are decoded in Python; the
    JVM decodes all others, ``INDEXED_FILES`` at a time.
    """
    files = local_files(spark, path, glob)
    df = _jvm_images(spark, [path], on_invalid, glob) if files is None else _local_images(spark, files, on_invalid)
    if raw:
        return df

    def run(batches):
        for b in batches:
            d = b.to_pydict()
            imgs, hs, ws, cs, _ = _rgb_rows(d["data"], d["height"], d["width"], d["channels"], on_invalid)
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()), pa.array(cs, pa.int32()),
                 pa.array(imgs, pa.list_(pa.int16()))],
                names=["path", "height", "width", "channels", "image"])

    return df.mapInArrow(run, _IMAGE_SCHEMA)


def read_binary_images(spark: SparkSession, path: str, on_invalid: str = "raise", glob: str | None = None,
                       decoder=decode_image) -> DataFrame:
    """``binaryFile`` + a Python decoder (T12) – for formats the JVM reader lacks.
    Same output as ``read_image_files``.  A local folder is listed and its files are read by the executors, as Spark's
    source holds the status of every file on the driver."""
    files = local_files(spark, path, glob)
    if files is not None:
        return dealt(files, _OPEN_COST).mapInArrow(lambda batches: _decoded_files(batches, on_invalid, decoder), _IMAGE_SCHEMA)
    r = reader_session(spark, _SMALL_FILES).read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path).select("path", "content")

    def run(batches):
        for b in batches:
            yield _decoded(zip(b.column("path").to_pylist(), b.column("content").to_pylist()), on_invalid, decoder)

    return df.mapInArrow(run, _IMAGE_SCHEMA)


def _decoded(contents, on_invalid: str, decoder) -> pa.RecordBatch:
    """Decoded images of (path, bytes)."""
    paths, imgs, hs, ws, cs = [], [], [], [], []
    for p, content in contents:
        try:
            px = to_rgb(decoder(content))
        except ImageDecodeError:
            if on_invalid == "raise":
                raise
            if on_invalid == "drop":
                continue
            paths.append(p), imgs.append(None), hs.append(None), ws.append(None), cs.append(None)
            continue
        paths.append(p), imgs.append(px.reshape(-1).astype(np.int16))
        hs.append(px.shape[0]), ws.append(px.shape[1]), cs.append(3)
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()),
         pa.array(cs, pa.int32()), pa.array(imgs, pa.list_(pa.int16()))],
        names=["path", "height", "width", "channels", "image"])


def _decoded_files(batches, on_invalid: str, decoder):
    """``_decoded`` of listed local files, a few at once, named as by Spark's ``binaryFile`` source."""
    def contents(paths):
        for path in paths:
            with open(path, "rb") as f:
                yield f"file:{path}", f.read()

    for b in batches:
        for lo in range(0, b.num_rows, 32):
            yield _decoded(contents(b.column("path").slice(lo, 32).to_pylist()), on_invalid, decoder)


def decode_png_column(df: DataFrame, column: str, output: str = "image", keep: list[str] | None = None,
                      decoder=decode_image) -> DataFrame:
    """Decode an encoded-image binary column into RGB HWC rows."""
    keep = [c for c in df.columns if c != column] if keep is None else keep
    fields = [df.schema[c] for c in keep] + [
        T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField(output, T.ArrayType(T.ShortType(), False))]

    def run(batches):
        for b in batches:
            imgs, hs, ws = [], [], []
            for content in b.column(column).to_pylist():
                px = to_rgb(decoder(content))
                imgs.append(px.reshape(-1).astype(np.int16)), hs.append(px.shape[0]), ws.append(px.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(hs, pa.int32()), pa.array(ws, pa.int32()),
                                               pa.array(imgs, pa.list_(pa.int16()))],
                names=keep + ["height", "width", output])

    return df.select(*keep, column).mapInArrow(run, T.StructType(fields))


def encode_png_column(df: DataFrame, column: str, spec: TensorSpec | None = None, output: str = "png",
                      keep: list[str] | None = None, height: str | None = None, width: str | None = None) -> DataFrame:
    """Encode an HWC uint8-valued tensor column as PNG bytes.  Fixed-size rows take
    ``spec``; rows of different sizes name their ``height`` / ``width`` columns."""
    drop = {column, height, width}
    keep = [c for c in df.columns if c not in drop] if keep is None else keep
    fields = [df.schema[c] for c in keep] + [T.StructField(output, T.BinaryType())]
    if spec is not None and spec.layout != "HWC":
        raise ValueError("encode_png_column needs an HWC spec")
    if spec is None and (height is None or width is None):
        raise ValueError("pass spec= for fixed-size rows or height=/width= columns")
    extra = [c for c in (height, width) if c]

    def run(batches):
        for b in batches:
            if spec is not None:
                arr = nd.stack(b.column(column), spec).astype(np.uint8)
                pngs = [encode_png(a) for a in arr]
            else:
                pngs = [encode_png(np.asarray(v, dtype=np.int64).astype(np.uint8).reshape(h, w, -1))
                        for v, h, w in zip(b.column(column).to_pylist(), b.column(height).to_pylist(),
                                           b.column(width).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(pngs, pa.binary())],
                                             names=keep + [output])

    return df.select(*keep, *extra, column).mapInArrow(run, T.StructType(fields))


def folder_of(key: str, folders: int = 256) -> F.Column:
    """A shard for ``write_image_files``: no folder holds a large share of the files.  Spark lists a tree of more than 32
    folders in tasks, a single folder file by file on the driver."""
    return F.pmod(F.xxhash64(key), F.lit(folders))


def write_image_files(df: DataFrame, key: str, png_column: str, path: str, shard: str | None = None) -> dict:
    """Write each row's PNG bytes to ``<path>/<key>.png`` (or ``<path>/<shard>/<key>.png``)
    from the executors; a deterministic name, so a retried task rewrites the same
    file.  Uses ``pyarrow.fs`` so any filesystem URI pyarrow knows works."""
    cols = [key, png_column] + ([shard] if shard else [])

    def run(batches):
        filesystem, root = filesystem_of(path)
        made = set()
        n = 0
        for b in batches:
            shards = b.column(shard).to_pylist() if shard else [None] * b.num_rows
            for k, data, sh in zip(b.column(key).to_pylist(), b.column(png_column).to_pylist(), shards):
                folder = root if sh is None else f"{root}/{sh}"
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                with filesystem.open_output_stream(f"{folder}/{k}.png") as f:
                    f.write(data)
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    rows = df.select(*cols).mapInArrow(run, "files long").agg(F.sum("files").alias("files")).collect()
    return {"files": int(rows[0]["files"] or 0)}


# ---- S3 at scale: files listed by the executors ----------------------------------------------

def read_listed_images(files: DataFrame, on_invalid: str = "raise", decoder=decode_image,
                       partitions: int | None = None) -> DataFrame:
    """Read and decode the files named in ``files.path`` on the executors (S3 at
    scale, T12).  Output as ``read_image_files``.  ``partitions`` round-robins
    the paths first – a shuffle of short strings only – so a shard holding a
    large share of the files does not become one long read task."""
    src = files.select("path")
    if partitions:
        src = src.repartition(partitions)

    def run(batches):
        local = filesystem_of("/")[0]
        for b in batches:
            paths, imgs, hs, ws, cs = [], [], [], [], []
            for p in b.column("path").to_pylist():
                filesystem, real = filesystem_of(p) if "://" in p and not p.startswith("file://") else (local, p.removeprefix("file://"))
                try:
                    with filesystem.open_input_stream(real) as f:
                        px = to_rgb(decoder(f.read()))
                except ImageDecodeError:
                    if on_invalid == "raise":
                        raise
                    if on_invalid == "drop":
                        continue
                    paths.append(p), imgs.append(None), hs.append(None), ws.append(None), cs.append(None)
                    continue
                paths.append(p), imgs.append(px.reshape(-1).astype(np.int16))
                hs.append(px.shape[0]), ws.append(px.shape[1]), cs.append(3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()),
                 pa.array(cs, pa.int32()), pa.array(imgs, pa.list_(pa.int16()))],
                names=["path", "height", "width", "channels", "image"])

    return src.mapInArrow(run, _IMAGE_SCHEMA)


# ---- S4: parquet payloads -------------------------------------------------------------------

def to_payloads(df: DataFrame, rows_per_payload: int = 1000, max_payload_bytes: int = DEFAULT_MAX_PAYLOAD_BYTES,
                output: str = "payload") -> DataFrame:
    """Pack rows into parquet-file payloads of at most ``rows_per_payload`` rows
    (one binary cell each); a payload above ``max_payload_bytes`` fails."""
    schema = "partition int, seq int, rows long, " + output + " binary"

    def run(batches):
        from kiln.streaming.batches import rebatch
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for seq, b in enumerate(rebatch(batches, rows_per_payload)):
            sink = io.BytesIO()
            pq.write_table(pa.Table.from_batches([b]), sink)
            data = sink.getvalue()
            if len(data) > max_payload_bytes:
                raise ValueError(f"payload of {len(data)} bytes exceeds {max_payload_bytes}; lower rows_per_payload")
            yield pa.RecordBatch.from_pydict({"partition": pa.array([pid], pa.int32()),
                                              "seq": pa.array([seq], pa.int32()),
                                              "rows": pa.array([b.num_rows], pa.int64()),
                                              output: pa.array([data], pa.binary())})

    return df.mapInArrow(run, schema)


def read_payloads(df: DataFrame, schema, column: str = "payload") -> DataFrame:
    """Decode a column of parquet-file payloads into their rows (S4).  A null payload
    is an error: its rows are lost."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = [f.name for f in st.fields]

    def run(batches):
        for b in batches:
            for data in b.column(column).to_pylist():
                if data is None:
                    raise ValueError("null payload")
                t = pq.read_table(pa.BufferReader(data), columns=names)
                yield from t.to_batches()

    return df.select(column).mapInArrow(run, st)


# ---- S5: dispatch --------------------------------------------------------------------------

def load_images(spark: SparkSession, path: str, format: str = "parquet", **kw) -> DataFrame:
    """Pick the reader by declared format: "parquet" (image tables, S1), "image"
    (files through the JVM decoder, S3) or "binary" (files through a Python
    decoder).  An unknown format fails before any job starts."""
    if format == "parquet":
        from kiln.sources.parquet import read_tensors

        return read_tensors(spark, path, **kw)
    if format == "image":
        return read_image_files(spark, path, **kw)
    if format == "binary":
        return read_binary_images(spark, path, **kw)
    if format == "sharded":
        on_invalid = kw.pop("on_invalid", "raise")
        spread = kw.pop("partitions", None) or spark.sparkContext.defaultParallelism * 4
        return read_listed_images(list_files(spark, path, **kw), on_invalid=on_invalid, partitions=spread)
    raise ValueError(f"unsupported image format {format!r}; accepted: {', '.join(IMAGE_FORMATS)}")


def image_report(spark: SparkSession, path: str, format: str = "image", **kw) -> DataFrame:
    """(files, decoded, invalid) of a folder of image files: what ``on_invalid="drop"`` leaves out, counted."""
    rows = load_images(spark, path, format=format, on_invalid="null", **kw)
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count("image").alias("decoded"), F.count_if(F.col("image").isNull()).alias("invalid"))


def key_from_path(path_col: str = "path") -> F.Column:
    """``.../<key>.png`` -> key as bigint."""
    return F.regexp_extract(F.col(path_col), r"([^/]+)\.[A-Za-z0-9]+$", 1).cast("long")
