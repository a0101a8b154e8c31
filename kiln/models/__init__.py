"""Models and how they reach the executors.

A model is anything with ``predict(batch: ndarray (n, d_in)) -> ndarray (n, d_out)``.
Shipped adapters: ``LinearModel`` and ``MLP`` (NumPy, weights from a closed
formula or from arrays) and ``OnnxModel`` (onnxruntime, if installed).

``ModelHandle`` is what UDFs capture.  It broadcasts the serialised model when
its size is under a checked limit; above the limit it saves the model into the
shared checkpoint folder once and every Python worker loads it from there.  In
both cases a worker builds the model once and memoises it (``get``), so tasks
that reuse the Python worker (``spark.python.worker.reuse``) share one copy.
"""

from __future__ import annotations

import io
import json
import os
import pickle
import threading
import uuid
from collections import OrderedDict

import numpy as np

DEFAULT_BROADCAST_LIMIT = 1 << 30  # 1 GiB of serialised weights


def _rows(batch: np.ndarray) -> np.ndarray:
    return batch.reshape(batch.shape[0], int(np.prod(batch.shape[1:], dtype=np.int64)))


class ModelOutputError(RuntimeError):
    """The model returned a different number of rows than it was given (I8)."""


def formula_weights(n_out: int, n_in: int, a: int = 31, b: int = 17, m: int = 101) -> np.ndarray:
    """Deterministic weights W[k][j] = (((k*a + j*b) % m) - (m//2)) / 100 – the F7/F8 fixture."""
    k = np.arange(n_out, dtype=np.int64)[:, None]
    j = np.arange(n_in, dtype=np.int64)[None, :]
    return (((k * a + j * b) % m) - (m // 2)).astype(np.float64) / 100.0


class LinearModel:
    """logits = x @ W.T + b, accumulated in float64 (or float32 when ``dtype`` says so)."""

    kind = "linear"

    def __init__(self, weight: np.ndarray, bias: np.ndarray | None = None, dtype: str = "float64",
                 name: str = "linear"):
        self.weight = np.asarray(weight, dtype=dtype)
        self.bias = None if bias is None else np.asarray(bias, dtype=dtype)
        self.dtype = dtype
        self.name = name

    @classmethod
    def formula(cls, n_out: int, n_in: int, dtype: str = "float64") -> "LinearModel":
        return cls(formula_weights(n_out, n_in), None, dtype, name=f"linear{n_out}x{n_in}")

    @property
    def input_size(self) -> int:
        return self.weight.shape[1]

    @property
    def output_size(self) -> int:
        return self.weight.shape[0]

    def predict(self, batch: np.ndarray) -> np.ndarray:
        x = _rows(batch).astype(self.dtype, copy=False)
        if x.shape[1] != self.input_size:
            raise ValueError(f"model takes {self.input_size} inputs, got {x.shape[1]}")
        out = x @ self.weight.T
        return out if self.bias is None else out + self.bias

    def arrays(self) -> dict:
        d = {"weight": self.weight}
        if self.bias is not None:
            d["bias"] = self.bias
        return d

    @classmethod
    def from_arrays(cls, arrays: dict, meta: dict) -> "LinearModel":
        return cls(arrays["weight"], arrays.get("bias"), meta.get("dtype", "float64"), meta.get("name", "linear"))


class MLP:
    """Two dense layers with a ReLU between them."""

    kind = "mlp"

    def __init__(self, w1, b1, w2, b2, dtype: str = "float64", name: str = "mlp"):
        self.w1, self.b1 = np.asarray(w1, dtype), np.asarray(b1, dtype)
        self.w2, self.b2 = np.asarray(w2, dtype), np.asarray(b2, dtype)
        self.dtype = dtype
        self.name = name

    @classmethod
    def formula(cls, n_out: int, n_hidden: int, n_in: int, dtype: str = "float64") -> "MLP":
        return cls(formula_weights(n_hidden, n_in), np.zeros(n_hidden),
                   formula_weights(n_out, n_hidden, a=13, b=7), np.zeros(n_out), dtype,
                   name=f"mlp{n_out}x{n_hidden}x{n_in}")

    @property
    def input_size(self) -> int:
        return self.w1.shape[1]

    @property
    def output_size(self) -> int:
        return self.w2.shape[0]

    def predict(self, batch: np.ndarray) -> np.ndarray:
        x = _rows(batch).astype(self.dtype, copy=False)
        h = np.maximum(x @ self.w1.T + self.b1, 0.0)
        return h @ self.w2.T + self.b2

    def arrays(self) -> dict:
        return {"w1": self.w1, "b1": self.b1, "w2": self.w2, "b2": self.b2}

    @classmethod
    def from_arrays(cls, arrays: dict, meta: dict) -> "MLP":
        return cls(arrays["w1"], arrays["b1"], arrays["w2"], arrays["b2"], meta.get("dtype", "float64"),
                   meta.get("name", "mlp"))


class OnnxModel:
    """An ONNX file run by onnxruntime; the session is created lazily in the worker.

    ``device`` "cpu", "cuda[:n]" or "auto" (the GPU Spark assigned to the task,
    else CPU).  A CUDA device without the CUDA provider raises; a worker keeps one
    session per device, as Spark may give its next task another GPU.

    The file's bytes travel with the pickled model and lie in its checkpoint folder,
    so other machines need no copy.  ``ship=False`` sends the path alone, for a file
    with external weights on a mount that all machines share.
    """

    kind = "onnx"

    def __init__(self, path: str, input_name: str | None = None, device: str = "cpu",
                 input_shape: tuple | None = None, name: str = "onnx", ship: bool = True):
        self.path = path
        self.ship = ship
        self.data: bytes | None = None
        self.input_name = input_name
        self.device = device
        self.input_shape = input_shape
        self.name = name
        self._sessions: dict = {}

    def _bytes(self) -> bytes:
        if self.data is not None:
            return self.data
        with open(self.path, "rb") as f:
            return f.read()

    def __getstate__(self):
        return self.__dict__ | {"_sessions": {}, "data": self._bytes() if self.ship else None}

    def _sess(self):
        device = self.device
        if device == "auto":
            from kiln.operators.resources import task_device

            device = task_device()
        if device not in self._sessions:
            import onnxruntime as ort  # optional dependency

            providers = ["CPUExecutionProvider"]
            if device.startswith("cuda"):
                if "CUDAExecutionProvider" not in ort.get_available_providers():
                    raise RuntimeError(f"device {device!r} needs onnxruntime's CUDA provider, which is not installed")
                idx = int(device.split(":")[1]) if ":" in device else 0
                providers.insert(0, ("CUDAExecutionProvider", {"device_id": idx}))
            self._sessions[device] = ort.InferenceSession(self.path if self.data is None else self.data, providers=providers)
            if self.input_name is None:
                self.input_name = self._sessions[device].get_inputs()[0].name
        return self._sessions[device]

    def predict(self, batch: np.ndarray) -> np.ndarray:
        s = self._sess()
        x = batch.astype(np.float32, copy=False)
        if self.input_shape is not None:
            x = x.reshape(x.shape[0], *self.input_shape)
        return _rows(s.run(None, {self.input_name: x})[0])

    def arrays(self) -> dict:
        return {"onnx": np.frombuffer(self._bytes(), np.uint8)} if self.ship else {}

    @classmethod
    def from_arrays(cls, arrays: dict, meta: dict) -> "OnnxModel":
        m = cls(meta["path"], meta.get("input_name"), meta.get("device", "cpu"),
                tuple(meta["input_shape"]) if meta.get("input_shape") else None, ship="onnx" in arrays)
        m.data = arrays["onnx"].tobytes() if m.ship else None
        return m


_KINDS = {"linear": LinearModel, "mlp": MLP, "onnx": OnnxModel}


# ---- C3: checkpoint folder -----------------------------------------------------------------

#: Bytes that go to the file system in one call.
_WRITE_BYTES = 8 << 20


def _write_file(spark, path: str, data: bytes) -> None:
    """Through Hadoop's file API, so any path or URI that Spark can write will do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for lo in range(0, len(data), _WRITE_BYTES):
            out.write(bytearray(data[lo:lo + _WRITE_BYTES]))
    finally:
        out.close()


def _read_file(spark, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
    if len(rows) != 1:
        raise FileNotFoundError(path)
    return bytes(rows[0][0])


def _session(spark=None):
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a checkpoint folder is read and written through Spark: pass spark=")
    return spark


def save_model(model, path: str, spark=None) -> str:
    """Write ``model`` to a checkpoint folder, ``model.json`` + ``weights.npz``; ``path`` is any path or URI that
    Spark can write (``spark``: default the active session)."""
    spark, path = _session(spark), path.rstrip("/")
    meta = {"kind": model.kind, "name": getattr(model, "name", model.kind),
            "dtype": getattr(model, "dtype", "float64")}
    if model.kind == "onnx":
        meta.update(path=model.path, input_name=model.input_name, device=model.device,
                    input_shape=list(model.input_shape) if model.input_shape else None)
    weights = io.BytesIO()
    np.savez(weights, **model.arrays())
    _write_file(spark, f"{path}/weights.npz", weights.getvalue())
    _write_file(spark, f"{path}/model.json", json.dumps(meta).encode())
    return path


def load_model(path: str, spark=None):
    """Build a model from a checkpoint folder written by ``save_model``, on the driver; ``ModelHandle.from_path`` sends
    it to the workers."""
    spark, path = _session(spark), path.rstrip("/")
    meta = json.loads(_read_file(spark, f"{path}/model.json"))
    with np.load(io.BytesIO(_read_file(spark, f"{path}/weights.npz"))) as z:
        arrays = {k: z[k] for k in z.files}
    return _KINDS[meta["kind"]].from_arrays(arrays, meta)


# ---- C2 / C4: distribution and per-worker memo --------------------------------------------

_MEMO: "OrderedDict[str, object]" = OrderedDict()
_MEMO_LOCK = threading.Lock()
_MEMO_SIZE = 4
BUILD_COUNT = {"n": 0}  # how many times this worker process built a model (for tests)


class ModelHandle:
    """Serializable reference to a model for use inside UDFs.

    ``ModelHandle.create(spark, model)`` pickles the model once.  At most
    ``max_broadcast_bytes`` are broadcast; a larger pickle is a file that Spark
    sends to every executor (``SparkContext.addFile``), so the size of a model never
    changes what is run.  ``ModelHandle.from_path(path)`` reads an existing checkpoint
    folder (C3) on the driver, from any file system that Spark reads, and sends it the same way.
    """

    def __init__(self, key: str, broadcast=None, nbytes: int = 0, file: str | None = None):
        self.key = key
        self._bc = broadcast
        self.nbytes = nbytes
        self.file = file  # name among Spark's files

    @classmethod
    def create(cls, spark, model, max_broadcast_bytes: int = DEFAULT_BROADCAST_LIMIT) -> "ModelHandle":
        import tempfile

        from pyspark import cloudpickle  # classes defined in __main__ / notebooks travel by value

        blob = cloudpickle.dumps(model, protocol=pickle.HIGHEST_PROTOCOL)
        key = f"{getattr(model, 'name', 'model')}-{uuid.uuid4().hex}"
        if len(blob) <= max_broadcast_bytes:
            return cls(key, broadcast=spark.sparkContext.broadcast(blob), nbytes=len(blob))
        file = os.path.join(tempfile.mkdtemp(prefix="kiln-model-"), f"{key}.pickle")
        with open(file, "wb") as f:
            f.write(blob)
        spark.sparkContext.addFile(file)
        return cls(key, nbytes=len(blob), file=os.path.basename(file))

    @classmethod
    def from_path(cls, path: str, spark=None, max_broadcast_bytes: int = DEFAULT_BROADCAST_LIMIT) -> "ModelHandle":
        spark = _session(spark)
        return cls.create(spark, load_model(path, spark), max_broadcast_bytes)

    @property
    def broadcast(self) -> bool:
        return self._bc is not None

    def build(self):
        """A fresh model object (no memo) – the per-batch form of I1."""
        BUILD_COUNT["n"] += 1
        if self._bc is not None:
            return pickle.loads(self._bc.value)
        from pyspark import SparkFiles

        with open(SparkFiles.get(self.file), "rb") as f:
            return pickle.load(f)

    def get(self):
        """The model, built at most once per Python worker process (C4)."""
        with _MEMO_LOCK:
            m = _MEMO.get(self.key)
            if m is not None:
                _MEMO.move_to_end(self.key)
                return m
        m = self.build()
        with _MEMO_LOCK:
            _MEMO[self.key] = m
            while len(_MEMO) > _MEMO_SIZE:
                _MEMO.popitem(last=False)
        return m

    def destroy(self):
        """Release the broadcast blocks on the executors and the driver."""
        if self._bc is not None:
            self._bc.destroy()

