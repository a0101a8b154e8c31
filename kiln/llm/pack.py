"""Cost-balanced packing of documents into token sequences.

The attention cost of a piece of n tokens is ``linear * n + quadratic * n^2``.  Documents are cut into whole
sequences and a rest; the rests of a block of documents go, longest first, to the sequence with the lowest cost
so far that still has room.  A block has as few sequences as its tokens need, so a rest that fits nowhere whole
is cut to fill the cheapest ones, and less than one sequence of padding is left in a block.

Blocks are made where the documents are read: nothing is shuffled, no task sees more than a block at a time, and
a repeated task makes the same sequences, since they are numbered by partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.tokens import encoder
from kiln.llm.scratch import tidy

SEQUENCE = 2048
BLOCK_DOCS, BLOCK_TOKENS = 4096, 8 << 20


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """For each item (all shorter than ``size``) its parts: (sequence, offset there, start in the item, length)."""
    n = -(-int(lengths.sum()) // size)
    cost, room = np.zeros(n), np.full(n, size)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for i in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[i])
        while left:
            fits = room >= left
            at = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            part = min(left, int(room[at]))
            out[i].append((at, size - int(room[at]), start, part))
            room[at] -= part
            cost[at] += linear * part + quadratic * part * part
            start, left = start + part, left - part
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """One row per piece: doc_id, start and length (in the document's ids, the end id included), ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset, cost.

    Null text counts as empty: one piece with the end id alone.  Null or repeated ids and equal rows are packed
    like any other row; a very long text becomes whole sequences and a rest; an empty table gives no rows; other
    columns are not read.  Of equally cheap sequences the first is taken.
    """

    def block(seq0: int, names: list, ids: list[np.ndarray]):
        rows: list[tuple] = []
        seq, rests = seq0, []
        for d, x in enumerate(ids):
            for s in range(0, len(x) - size + 1, size):
                rows.append((d, s, size, seq, 0))
                seq += 1
            if len(x) % size:
                rests.append((d, len(x) - len(x) % size))
        parts = assign(np.array([len(ids[d]) - s for d, s in rests], np.int64), size, linear, quadratic)
        for (d, s), p in zip(rests, parts, strict=True):
            rows += [(d, s + start, n, seq + at, offset) for at, offset, start, n in p]
        used = max((r[3] for r in rows), default=seq0 - 1) + 1
        for lo in range(0, len(rows), 2048):
            some = rows[lo : lo + 2048]
            doc, start, length, sequence, offset = zip(*some, strict=True)
            n = np.array(length, np.int64)
            yield used, pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in doc], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(n),
                    pa.array([ids[d][s : s + m].astype("<u4").tobytes() for d, s, m, _, _ in some], pa.binary()),
                    pa.array([len(ids[d]) for d in doc], pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                    pa.array(linear * n + quadratic * n * n),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"],
            )

    def run(it):
        enc, seq = encoder(tokenizer), TaskContext.get().partitionId() << 40
        names, ids, tokens = [], [], 0
        for batch in it:
            doc = batch.column(0).to_pylist()
            for lo, hi, flat, at in enc.blocks(batch.column(1), end_id):
                for d in range(lo, hi):
                    names.append(doc[d])
                    ids.append(flat[at[d - lo] : at[d - lo + 1]])
                    tokens += len(ids[-1])
                    if len(ids) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                        for seq_next, out in block(seq, names, ids):
                            yield out
                        seq, names, ids, tokens = seq_next, [], [], 0
        if ids:
            for _, out in block(seq, names, ids):
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double")
