"""Repeated passages: seed and extend.

Seeds are winnowed anchors: of every window of ``length`` words, the run of ``k`` words with the smallest hash.
Equal windows have equal anchors, so documents are joined on anchors and only anchors that occur twice go on.
Each is extended both ways to the windows of ``length`` words it stands for; equal windows (two hashes, 128
bits together, and the document) meet in one ``min`` by document, which is combined before the shuffle, so a
passage that a third of all documents share stays a few rows a task.  What is left of a document are runs of
windows that also start earlier: its maximal repeats.

No pair of documents is ever made: an occurrence is held against the earliest one of its own window, which
decides whether an earlier one exists.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import words as W
from kiln.llm.scratch import tidy, written

LENGTH = 20
K = 8
_LAST = 2**63 - 1  # null ids come after all others


def _lowest(x: np.ndarray, n: int) -> np.ndarray:
    """Index of the leftmost smallest of each run of n values."""
    width, at = 1, np.arange(len(x))
    while width < n:
        step = min(width, n - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[left] <= x[right], left, right)
        width += step
    return at


class _Block:
    """The windows of a block of texts: ``at`` first word, ``pos`` where the anchor starts."""

    def __init__(self, data, offsets, length: int, k: int):
        self.start, self.end, self.row = W.spans(data, offsets)
        self.hash = W.hashes(data, self.start, self.end)
        n = len(self.hash)
        if n < length:
            self.at = self.pos = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        self.gram = np.zeros(n - k + 1, np.uint64)
        at, g = W.grams(self.hash, self.row, k)
        self.gram[at] = W.mix(g, 1)
        self.at = np.flatnonzero(self.row[: n - length + 1] == self.row[length - 1 :])
        self.pos = _lowest(self.gram, length - k + 1)[self.at]

    @property
    def anchor(self) -> np.ndarray:
        return self.gram[self.pos]

    def windows(self, length: int) -> np.ndarray:
        """Two hashes of each window, in one structured key."""
        _, g = W.grams(self.hash, self.row, length)
        _, g2 = W.grams(W.mix(self.hash, 5), self.row, length)
        return W.mix(g, 2), W.mix(g2, 3)


def _groups(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices ordered by (row, key), and whether each begins a new (row, key)."""
    order = np.lexsort((key, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order[1:]] != row[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    return order, new


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column of longs."""
    size = pc.fill_null(pc.list_value_length(column), 0)
    return np.repeat(np.arange(len(column)), np.asarray(size)), np.asarray(column.flatten()).view(np.uint64)


def _within(row, key, in_row, in_key) -> np.ndarray:
    """Whether (row, key) is among (in_row, in_key); the row is mixed into the key."""
    salt = lambda r, k: W.mix(k ^ W.mix(r.astype(np.uint64), 11))
    return np.isin(salt(row, key), salt(in_row, in_key))


def _ids(batch):
    return np.asarray(_column(batch, "_id"))


def anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(h, _id): each anchor of each document, twice if it stands at two places or more."""

    def run(it):
        for batch in it:
            ids = _ids(batch)
            for lo, _, data, offsets in W.blocks(_column(batch, "_text")):
                b = _Block(data, offsets, length, k)
                at = b.pos[np.flatnonzero(np.diff(b.pos, prepend=-1))]
                order, new = _groups(b.row[at], b.gram[at])
                second = np.zeros_like(new)
                second[1:] = new[:-1]
                at = at[order[new | second]]  # a second that begins a group is there anyway
                yield pa.RecordBatch.from_arrays([pa.array(b.gram[at].view(np.int64)), pa.array(ids[lo + b.row[at]])], ["h", "_id"])

    return docs.mapInArrow(tidy(run), "h long, _id long")


def _candidates(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(w, w2, _id): the windows that hold an anchor of ``hs``, each once a document."""

    def run(it):
        for batch in it:
            ids = _ids(batch)
            list_row, list_key = _lists(_column(batch, "hs"))
            for lo, hi, data, offsets in W.blocks(_column(batch, "_text")):
                b = _Block(data, offsets, length, k)
                own = (list_row >= lo) & (list_row < hi)
                on = _within(b.row[b.at], b.anchor, list_row[own] - lo, list_key[own])
                w, w2 = (x[on] for x in b.windows(length))
                row = b.row[b.at][on]
                order, new = _groups(row, w)
                first = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(w2[first].view(np.int64)), pa.array(ids[lo + row[first]])], ["w", "w2", "_id"])

    return docs.mapInArrow(tidy(run), "w long, w2 long, _id long")


def _marked(docs: DataFrame, length: int, k: int, text_out: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,end:long>>" + ", kept string" * text_out
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(it):
        for batch in it:
            ids = _column(batch, "_id")
            list_row, list_key = _lists(_column(batch, "hs"))
            first_row, first_key = _lists(_column(batch, "firsts"))
            for lo, hi, data, offsets in W.blocks(_column(batch, "_text")):
                b, n = _Block(data, offsets, length, k), hi - lo
                own, own_first = (list_row >= lo) & (list_row < hi), (first_row >= lo) & (first_row < hi)
                cover = np.zeros(len(b.hash) + 1, np.int64)
                if own.any():
                    on = _within(b.row[b.at], b.anchor, list_row[own] - lo, list_key[own])
                    at, row, w = b.at[on], b.row[b.at][on], b.windows(length)[0][on]
                    at = at[W.repeated(row, w)[0] | ~_within(row, w, first_row[own_first] - lo, first_key[own_first])]
                    cover[at] += 1
                    cover[at + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                # maximal repeats: runs of covered words within one row
                edge = np.ones(len(gone) + 1, bool)
                if len(gone):
                    edge[1:-1] = (gone[1:] != gone[:-1]) | (b.row[1:] != b.row[:-1])
                cut = np.flatnonzero(edge)
                runs = [(s, e) for s, e in zip(cut[:-1], cut[1:], strict=True) if gone[s]] if gone.any() else []
                word0 = np.concatenate([[0], np.cumsum(W.counts(b.row, n))])
                found: list[list[dict]] = [[] for _ in range(n)]
                for s, e in runs:
                    r = int(b.row[s])
                    found[r].append({"start": int(s - word0[r]), "end": int(e - word0[r])})
                kept, at = W.joined(data, b.end, b.start, b.row, ~gone, n)
                kept = kept.tobytes()
                texts = [kept[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                arrays = [ids.slice(lo, n), pa.array(np.diff(word0)), pa.array(W.counts(b.row[gone], n)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(found, pa.list_(kind))]
                pieces = [*arrays, pa.array([x.decode() for x in texts], pa.string())] if text_out else arrays
                yield pa.RecordBatch.from_arrays(pieces, ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", *["kept"] * text_out])

    return docs.mapInArrow(tidy(run), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, text_out: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, repeats (maximal runs of removed words, at
    least ``length`` long unless the row's end cuts them: never shorter), kept (the words left, unless
    ``text_out`` is off).

    A word goes if a window of ``length`` words covers it whose words also start earlier: in a row with a smaller
    id, or earlier in the same row.  Null text counts as no words; a row with a null id keeps its words and takes
    none from others; rows that share an id are of one rank, so neither loses words to the other; an empty table
    gives no rows; other columns are not read.  Texts are taken whole, however long.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    known = rows.where("_id is not null and _text is not null")
    seeds = written(anchors(known, length, k), "anchors")
    twice = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    hs = written(seeds.join(twice, "h", "left_semi").groupBy("_id").agg(F.collect_set("h").alias("hs")), "seeds")
    windows = _candidates(known.join(hs, "_id"), length, k)
    first = windows.groupBy("w", "w2").agg(F.min("_id").alias("_id")).groupBy("_id").agg(F.collect_list("w").alias("firsts"))
    found = written(hs.join(first, "_id", "left"), "repeats")
    return _marked(rows.join(found, "_id", "left"), length, k, text_out)
