"""Quality by line labels: a linear-chain conditional random field marks content and boilerplate.

A document's lines are a sequence of two labels.  Features of a line (length, symbols, digits, capitals, ends,
repeats) score each label, a matrix scores neighbours, Viterbi decoding finds the best sequence, and the share
of words in content lines decides whether the document stays.

The field is fitted here, by gradient ascent on the likelihood, on at most ``TRAIN`` labelled documents of each
class (those with the smallest hash of their id) and ``TRAIN_LINES`` lines of each; a line's label is its
document's.  Everything else covers all documents, whole.  Texts are looked at in blocks in NumPy; nothing is
shuffled but the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import words as W
from kiln.llm.scratch import tidy

#: Bounds of the sample, and the share of words in content lines that a document needs.
TRAIN, TRAIN_LINES, CONTENT = 500, 64, 0.5
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True
_SIZES = np.array([2, 3, 6, 11, 21, 51])
N_FEATURES = 28


@dataclass(frozen=True)
class Field:
    """Scores of the two labels (0 boilerplate, 1 content): by feature, at the start, from label to label."""

    weights: np.ndarray  # (features, 2)
    start: np.ndarray  # (2,)
    step: np.ndarray  # (2, 2)

    def decode(self, features: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The best label of each line; lines stand document after document, ``count`` of each (Viterbi)."""
        score = features @ self.weights
        first, order = np.cumsum(count) - count, np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        out, back = np.zeros(len(score), np.int8), np.zeros((len(score), 2), np.int8)
        longest = int(count[0]) if len(count) else 0
        live = np.searchsorted(-count, -np.arange(1, longest + 1), "right")  # documents that have a line t
        best, last = np.zeros((len(count), 2)), np.zeros(len(count), np.int8)
        for t in range(longest):
            n = live[t]
            at = first[:n] + t
            if t == 0:
                best[:n] = self.start + score[at]
                continue
            move = best[:n, :, None] + self.step  # from, to
            back[at] = move.argmax(1)
            best[:n] = move.max(1) + score[at]
        last = best.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            n = live[t]
            at = first[:n] + t
            out[at] = last[:n]
            last[:n] = back[at, last[:n]]
        return out


#: Without labels of both classes: every line is content.
NONE = Field(np.tile([0.0, 1e-9], (N_FEATURES, 1)), np.array([0.0, 1e-9]), np.zeros((2, 2)))


def _sum(at: np.ndarray, on: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, on, n)


class Block:
    """Base counts of each row and features of each line that has a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        start, end, row = W.spans(data, offsets)
        word = W.hashes(data, start, end)
        point, symbol = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]), np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        self.n_words = W.counts(row, n)
        chars = point[end] - point[start]
        self.word_chars = W.counts(row, n, chars)
        self.n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]

        again = np.zeros(len(word) + 1, np.int64)
        at, gram = W.grams(word, row, WINDOW)
        twice = at[W.repeated(row[at], W.mix(gram))[1]]
        np.add.at(again, twice, 1)
        np.add.at(again, twice + WINDOW, -1)
        again = np.cumsum(again[:-1]) > 0
        self.n_repeat_words = W.counts(row[again], n)

        breaks = np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1])
        breaks = np.unique(breaks)  # starts of lines
        line = np.searchsorted(breaks, start, "right") - 1
        own, first, which = np.unique(line, return_index=True, return_inverse=True)  # lines with a word
        m = len(own)
        self.line_row = row[first] if m else row
        lo = breaks[own]
        hi = np.minimum(np.append(breaks[1:] - 1, len(data))[own], offsets[self.line_row + 1])
        # a line that a row's end closes has no line feed to leave out
        hi = np.where((hi < len(data)) & (hi + 1 == offsets[self.line_row + 1]) & (data[np.minimum(hi, max(len(data) - 1, 0))] != 10), hi + 1, hi) if m else hi
        later, either = W.repeated(self.line_row, W.hashes(data, lo, hi)) if m else (np.zeros(0, bool), np.zeros(0, bool))
        self.n_dup_lines = W.counts(self.line_row[later], n)
        self.count = W.counts(self.line_row, n)

        size = np.bincount(which, minlength=m)
        self.line_words = size
        byte = (hi - lo).clip(1)
        inside = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[hi] - c[lo]
        upper, lower = inside((data >= 65) & (data <= 90)), inside((data >= 97) & (data <= 122))
        digit, mark = inside((data >= 48) & (data <= 57)), (symbol[hi] - symbol[lo])
        last = data[end[np.append(first[1:] - 1, len(end) - 1)] - 1] if m else data[:0]
        head = data[start[first]] if m else data[:0]
        same = _sum(which, W.repeated(which, word)[0], m) / size if m else np.zeros(0)
        mean = _sum(which, chars, m) / size if m else np.zeros(0)
        place = np.arange(m) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        f = [
            np.ones(m),
            *(np.searchsorted(_SIZES, size, "right") == i for i in range(len(_SIZES) + 1)),
            mark > 0,
            mark > 0.05 * byte,
            mark > 0.15 * byte,
            digit > 0.1 * byte,
            digit > 0.4 * byte,
            upper > 0.3 * byte,
            upper > 2 * lower,
            inside(data == 33) > 0.03 * byte,
            _END[last],
            (head >= 65) & (head <= 90),
            either,
            same > 0.25,
            same > 0.5,
            same > 0.75,
            _sum(which, again, m) > 0.2 * size,
            mean < 2.5,
            mean > 8,
            mean > 14,
            place == 0,
            place == self.count[self.line_row] - 1,
        ]
        self.features = np.stack([np.asarray(x, np.float64) for x in f], 1)

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words)

    def content(self, field: Field) -> np.ndarray:
        """The share of each row's words in content lines; 0 without words."""
        label = field.decode(self.features, self.count)
        return np.bincount(self.line_row, self.line_words * label, len(self.count)) / np.maximum(self.n_words, 1)


def _softplus_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(features: list[np.ndarray], label: np.ndarray, rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """The field under which the documents' labels are most likely (Adam on the mean log-likelihood of a line)."""
    docs, longest = len(features), max(len(x) for x in features)
    x = np.zeros((docs, longest, N_FEATURES))
    on = np.zeros((docs, longest), bool)
    for i, f in enumerate(features):
        x[i, : len(f)], on[i, : len(f)] = f, True
    total, y = on.sum(), np.repeat(label[:, None], longest, 1)
    gold = np.eye(2)[y] * on[..., None]
    pairs = (on[:, 1:] & on[:, :-1])[..., None, None]
    theta = np.zeros(N_FEATURES * 2 + 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    part = lambda t: (t[: 2 * N_FEATURES].reshape(N_FEATURES, 2), t[2 * N_FEATURES : 2 * N_FEATURES + 2], t[-4:].reshape(2, 2))
    flat, gold_pairs = x[on], (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum((0, 1))
    for k in range(1, rounds + 1):
        weights, start, step = part(theta)
        score = x @ weights
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(on[:, t, None], _softplus_sum(ahead[:, t - 1, :, None] + step, 1) + score[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(on[:, t + 1, None], _softplus_sum(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), behind[:, t + 1])
        z = _softplus_sum(ahead[:, -1], 1)
        node = np.exp(ahead + behind - z[:, None, None]) * on[..., None]
        edge = np.exp(ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs
        grad = np.concatenate([(flat.T @ (gold - node)[on]).ravel(), (gold - node)[:, 0].sum(0), (gold_pairs - edge.sum((0, 1))).ravel()]) / total - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(*(a.copy() for a in part(theta)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = TRAIN, lines: int = TRAIN_LINES) -> Field:
    """Fits a field on a bounded sample; ``NONE`` if a class has no document with a line.

    Labels other than 0 and 1, and labels of ids that ``docs`` lacks, are not used; of rows with equal ids one is.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    some = [known.where(f"_label = {c}").groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(some[0].union(some[1]))  # 2 * per_class rows at most

    def run(it):
        for batch in it:
            for lo, hi, data, offsets in W.blocks(batch.column(2)):
                b = Block(data, offsets)
                at = np.cumsum(b.count) - b.count
                rows = [b.features[a : a + min(n, lines)].astype(np.float32).ravel() for a, n in zip(at, b.count, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(rows, pa.list_(pa.float32()))], ["id", "label", "f"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id").select("_id", "_label", "_text")
    rows = texts.mapInArrow(tidy(run), "id long, label int, f array<float>").groupBy("id", "label").agg(F.min("f").alias("f")).collect()  # a bounded sample
    rows = sorted((r for r in rows if r["f"]), key=lambda r: (r["id"], r["label"]))
    label = np.array([r["label"] for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return NONE
    return fit([np.array(r["f"], np.float64).reshape(-1, N_FEATURES) for r in rows], label)


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", content: float = CONTENT) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share, kept.

    Null text has no words, so it fails.  Null or repeated ids and equal rows each give a row; an empty table
    gives none; other columns are not read.  Texts are looked at whole.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]

    def run(it):
        for batch in it:
            for lo, hi, data, offsets in W.blocks(batch.column(1)):
                b = Block(data, offsets)
                share = b.content(field)
                columns = [b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.failed, share, ~b.failed & (share >= content)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, columns)], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def keep(docs: DataFrame, field: Field, text_col: str = "text", content: float = CONTENT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    at = docs.columns.index(text_col)

    def run(it):
        for batch in it:
            for lo, hi, data, offsets in W.blocks(batch.column(at)):
                b = Block(data, offsets)
                yield batch.slice(lo, hi - lo).filter(pa.array(~b.failed & (b.content(field) >= content)))

    return docs.mapInArrow(tidy(run), docs.schema)
