from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.ipc  # noqa: F401 - pa.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a consumer's results that share a cell.
RESULT_ROWS = 1000


def _concat(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One batch, or several where a column's offsets would overflow (2 GiB of bytes)."""
    return parts if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()


def rebatch(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Regroup a stream of Arrow batches into batches of exactly ``n`` rows, the last
    one shorter (B2); rows whose bytes exceed what one Arrow batch can address come
    as several.  Row order is kept, the tail is always flushed, and at most one
    partial output batch is held besides the input batch."""
    if n <= 0:
        raise ValueError("batch size must be positive")
    buf: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        while b.num_rows:
            take = min(n - held, b.num_rows)
            buf.append(b.slice(0, take))
            held += take
            b = b.slice(take)
            if held == n:
                yield from _concat(buf)
                buf, held = [], 0
    if held:
        yield from _concat(buf)


def rebatch_series(series: Iterable[pd.Series], n: int) -> Iterator[pd.Series]:
    """``rebatch`` for pandas Series (iterator pandas UDFs)."""
    buf: list[pd.Series] = []
    held = 0
    for s in series:
        while len(s):
            take = min(n - held, len(s))
            buf.append(s.iloc[:take])
            held += take
            s = s.iloc[take:]
            if held == n:
                yield pd.concat(buf, ignore_index=True) if len(buf) > 1 else buf[0].reset_index(drop=True)
                buf, held = [], 0
    if held:
        yield pd.concat(buf, ignore_index=True) if len(buf) > 1 else buf[0].reset_index(drop=True)


def rebatch_arrays(arrays: Iterable[pa.Array], n: int) -> Iterator[pa.Array]:
    """``rebatch`` for Arrow arrays (iterator Arrow UDFs)."""
    for b in rebatch((pa.RecordBatch.from_arrays([a], ["x"]) for a in arrays), n):
        yield b.column(0)


_ITEM, _DONE, _ERROR = 0, 1, 2


def prefetch(items: Iterable, depth: int = 2) -> Iterator:
    """Pull ``items`` on a background thread, at most ``depth`` ahead.

    The consumer computes on batch k while batch k+1 is read and decoded.  Order
    is kept; an exception in the producer is raised in the consumer; closing the
    generator early stops the producer.
    """
    if depth <= 0:
        yield from items
        return
    q: queue.Queue = queue.Queue(maxsize=depth)
    stop = threading.Event()

    def put(msg) -> bool:
        while not stop.is_set():
            try:
                q.put(msg, timeout=0.05)
                return True
            except queue.Full:
                continue
        return False

    def produce():
        try:
            for x in items:
                if not put((_ITEM, x)):
                    return
            put((_DONE, None))
        except BaseException as e:  # noqa: BLE001 - handed to the consumer
            put((_ERROR, e))

    t = threading.Thread(target=produce, name="kiln-prefetch", daemon=True)
    t.start()
    try:
        while True:
            kind, x = q.get()
            if kind == _ITEM:
                yield x
            elif kind == _DONE:
                return
            else:
                raise x
    finally:
        stop.set()
        t.join(timeout=5)


def drain(df: DataFrame) -> DataFrame:
    """Consume every result batch on the executors and report what was seen (S8):
    one row per partition with (partition, batches, rows).  The result is tiny, so
    the totals can be taken with an ordinary aggregate."""

    def consume(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        nb = nr = 0
        for b in batches:
            nb += 1
            nr += b.num_rows
        yield pa.RecordBatch.from_pydict({"partition": pa.array([pid], pa.int32()),
                                          "batches": pa.array([nb], pa.int64()), "rows": pa.array([nr], pa.int64())})

    return df.mapInArrow(consume, "partition int, batches long, rows long")


def ipc_cells(df: DataFrame, batch_size: int | None = None, consume: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """(ipc): each record batch of ``df`` as one binary cell in Arrow's stream format, schema included, made by the
    tasks; with ``batch_size`` each holds exactly that many rows, but the last of a partition.  With ``consume`` the cells
    hold what it makes of these batches, up to ``RESULT_ROWS`` rows together."""

    def run(batches):
        whole = batches if batch_size is None else rebatch(batches, batch_size)
        for b in whole if consume is None else rebatch(map(consume, whole), RESULT_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as stream:
                stream.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ipc"])

    return df.mapInArrow(run, "ipc binary")


def iter_batches(df: DataFrame, batch_size: int | None = 1000, prefetch_partitions: bool = True,
                 consume: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> Iterator[pa.RecordBatch]:
    """Pull a result to a consumer as Arrow batches, one partition in memory at a time, the next being computed
    meanwhile (S8 on the driver).  Rows never become Python objects: a task sends each batch as one cell.
    Use for results the consumer must see; ``drain`` for timing.  No rows give no batches.

    A ``consume`` function sees every batch in the task that made it, and the driver only gets the batches that it
    returns: for consumers that reduce a batch (sums, counts), whose input would else all go through the driver."""
    for cell in ipc_cells(df, batch_size, consume).toLocalIterator(prefetchPartitions=prefetch_partitions):
        yield from pa.ipc.open_stream(pa.py_buffer(cell[0]))
