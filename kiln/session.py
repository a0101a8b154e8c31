"""Session settings and the shared folder for intermediate data."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on; all are public Spark confs.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # transport batches are bounded by rows (B1) and by bytes: 1000 small rows, or
    # 64 MiB of wide ones (162 rows of 256x256x3 int16 images) – whichever comes
    # first, so one Python worker's input stays bounded; resources.tune_for sets
    # both from the row width
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.python.worker.reuse": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "kiln", conf: dict | None = None) -> SparkSession:
    """Session for tests and the bench.  On a cluster, pass master=None and let the
    launcher decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only a local-mode session without one gets a fresh
    private folder.  On a cluster an unset value is an error, because a
    machine-local folder is not visible to the other executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc_dir = spark.sparkContext.getCheckpointDir()
        if sc_dir:
            d = os.path.dirname(sc_dir.rstrip("/"))
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="kiln-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def reader_session(spark: SparkSession, conf: dict) -> SparkSession:
    """A session of its own on the same context: the settings of ``spark`` as they are now, and ``conf`` on top.

    For settings that Spark reads from the session when a scan runs: a DataFrame read by it keeps them, and
    ``spark`` and all its other DataFrames are as before."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in conf.items():
        own.conf.set(key, value)
    return own


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts])


def fresh_path(spark: SparkSession, prefix: str) -> str:
    """A new, unused folder name inside the shared checkpoint folder."""
    return shared_path(spark, f"{prefix}-{uuid.uuid4().hex[:12]}")


def ship_package(spark: SparkSession) -> None:
    """Make ``kiln`` importable in the Python workers: zip the package once per
    SparkContext and ``addPyFile`` it (Spark distributes it to every executor)."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_kiln_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="kiln-pkg-"), "kiln.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    sc._kiln_shipped = True
