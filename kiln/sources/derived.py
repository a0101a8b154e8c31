"""Tensor tables that Spark derives from the driver's tables (FIXTURES.md part B).

All are plain Spark expressions over the whole input table, so their size grows
with the scale factor; nothing is generated on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions import ndarray as nd
from kiln.operators.resources import BATCH_ROWS
from kiln.session import reader_session
from kiln.spec import TensorSpec

F1_SPEC = TensorSpec((4, 4, 4), "HWC", "float32")  # embeddings seen as a 4x4x4 image
F2_SPEC = TensorSpec((8, 8, 3), "HWC", "int16")    # orders -> 8x8 RGB pixels
F3_SPEC = TensorSpec((256, 256, 3), "HWC", "int16")  # full-size image

#: Values that are generated at once: a batch of keys is small whatever the width of the images made from it.
GENERATED_VALUES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def f1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embedding`` (64 floats) as a 4x4x4 HWC tensor, keyed by ``vec_id``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F1_SPEC.tag("embedding", "image"))


def narrow_batches(spark: SparkSession, spec: TensorSpec) -> SparkSession:
    """A session whose Arrow batches hold ``GENERATED_VALUES`` of such images, or one: Spark's 10,000 rows are gigabytes
    of full-size images on their way to the next Python step."""
    rows = max(1, GENERATED_VALUES // spec.size)
    return reader_session(spark, {BATCH_ROWS: str(min(rows, int(spark.conf.get(BATCH_ROWS))))})


def spread(df: DataFrame) -> DataFrame:
    """Keys dealt to all task slots: a few megabytes of keys, one split or row group, become images and files."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)


def pixel_expr(key: F.Column, i: F.Column, mult: int = 31, step: int = 7, mod: int = 256,
               shift: int = 0) -> F.Column:
    """Native form of the pixel formula (for expressions over a key column)."""
    return ((key * F.lit(mult) + i * F.lit(step)) % F.lit(mod) - F.lit(shift)).cast("short")


def image_batches(ids: np.ndarray, n: int, mult: int, step: int, mod: int, shift: int, limit: int | None = None):
    """The images of ``ids``, (rows, n) int16, in arrays of at most ``limit`` values or one row."""
    base = np.arange(n, dtype=np.int64) * step
    for lo, hi in nd.row_pieces(len(ids), n, max(n, limit or GENERATED_VALUES)):
        yield ((ids[lo:hi, None] * mult + base[None, :]) % mod - shift).astype(np.int16)


def generated_images(df: DataFrame, key: str, spec: TensorSpec, mult: int = 31, step: int = 7, mod: int = 256,
                     shift: int = 0) -> DataFrame:
    """One image per row of ``df``: image[i] = (key*mult + i*step) % mod - shift.

    Generated with NumPy inside ``mapInArrow``: fast at any width, and the Python
    node is a plan boundary, so later native operators read the materialised
    array instead of Catalyst inlining the generator into every element access.
    A batch of keys gives several batches of images, of ``GENERATED_VALUES`` or one row each.
    """
    n, limit = spec.size, GENERATED_VALUES
    src = df.select(key)
    ktype = src.schema[key].dataType.simpleString()

    def gen(batches):
        for b in batches:
            ids = b.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            for img in image_batches(ids, n, mult, step, mod, shift, limit):
                yield pa.RecordBatch.from_arrays([b.column(key).slice(at, len(img)), nd.to_arrow(img)], names=[key, "image"])
                at += len(img)

    out = src.mapInArrow(gen, f"{key} {ktype}, image array<short>")
    return out.select(key, spec.tag("image", "image"))


def f2_orders(spark: SparkSession, sf_dir: str, mod: int = 256, shift: int = 0) -> DataFrame:
    """image[i] = (o_orderkey*31 + i*7) % 256, 8x8x3 HWC int16, keyed by ``o_orderkey``.
    ``mod``/``shift`` give the out-of-range variant used for the uint8 wrap."""
    return generated_images(table(spark, sf_dir, "orders"), "o_orderkey", F2_SPEC, mod=mod, shift=shift)


def f3_images(spark: SparkSession, sf_dir: str, table_name: str = "embeddings", key: str = "vec_id",
              spec: TensorSpec = F3_SPEC) -> DataFrame:
    """full-size images, image[i] = (key + i*7) % 256, one per row of ``table_name``."""
    return generated_images(spread(table(narrow_batches(spark, spec), sf_dir, table_name).select(key)), key, spec, mult=1, step=7)


def f4_part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 RGB images keyed by ``p_partkey``: image[i] = (p_partkey*17 + i*5) % 256."""
    return generated_images(spread(table(spark, sf_dir, "part").select("p_partkey")), "p_partkey", F2_SPEC, mult=17, step=5)


def variable_size(key: str, h_base: int = 6, h_mod: int = 3, w_col: str = "p_size", w_mod: int = 4):
    """Per-row image size rule: H = base + (key % h_mod)*2, W = base + (w_col % w_mod)*2."""
    return (lambda k: h_base + (k % h_mod) * 2), (lambda v: h_base + (v % w_mod) * 2)


def f5_variable_part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB images of different sizes keyed by ``p_partkey``: H in {6, 8, 10} from
    p_partkey, W in {6, 8, 10, 12} from p_size, image[i] = (p_partkey*17 + i*5) % 256
    over the row's own H*W*3 values."""
    src = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    fh, fw = variable_size("p_partkey")

    def gen(batches):
        for b in batches:
            keys = b.column("p_partkey").to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = b.column("p_size").to_numpy(zero_copy_only=False).astype(np.int64)
            hs, ws, imgs = [], [], []
            for k, v in zip(keys, sizes):
                h, w = int(fh(k)), int(fw(v))
                hs.append(h), ws.append(w)
                imgs.append(((k * 17 + np.arange(h * w * 3, dtype=np.int64) * 5) % 256).astype(np.int16))
            yield pa.RecordBatch.from_arrays(
                [b.column("p_partkey"), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()),
                 pa.array(imgs, pa.list_(pa.int16()))], names=["p_partkey", "height", "width", "image"])

    return src.mapInArrow(gen, "p_partkey long, height int, width int, image array<short>")
