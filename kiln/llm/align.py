"""Alignment of two tokenizers' tokens by byte ranges, on Arrow tables.

Texts are encoded in blocks.  Each side's tokens are one flat list with the index of their document, their ends are
running sums of byte lengths within each document, and an Acero hash join on (document, end) finds the bytes where
both sides end.  These cut the tokens into groups; within a group every token of one side is linked to every token of
the other.  A document's links are kept by id pair with their number, and a block's pairs with the number of its documents that
hold them (``Table.group_by``).

A block is one row of a table: lists of its documents, of their pairs (as places in the block's list of pairs) and of its pairs'
partial counts.  Spark merges the partial counts of all blocks by id pair, marks the highest of each id and sends each
block the counts of its own pairs, so a second pass over the blocks ends without looking at a text again.  What is
shuffled is one row per block and pair.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import words as W
from kiln.llm.scratch import tidy, written
from kiln.llm.tokens import _Memo, encoder, file_of

#: Bytes of text that are encoded and joined together, and that make one row of the blocks' table; a longer text
#: is a piece and a block of its own.
PIECE_BYTES, BLOCK_BYTES = 1 << 19, 4 << 20
#: Blocks that a scan of their table decodes at once: with lists of all their links they are several megabytes each.
SCAN_BLOCKS = 2
#: Units of text, and ids of theirs, that a worker remembers at most.
MEMO, MEMO_IDS = 400_000, 1 << 23


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, all others
    in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class _Table:
    """The bytes of each id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return _ranges(self.data, self.start[ids], self.length[ids])


def _ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = np.cumsum(length)
    return data[np.repeat(start - total + length, length) + np.arange(total[-1] if len(total) else 0)]


class BytePieces:
    """A byte-level tokenizer of the ``tokenizers`` library, asked for space + text."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        place, vocab = _byte_of_char(), self.encoder.lib.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            tokens[i] = bytes(place[c] for c in text) if all(c in place for c in text) else text.encode()
        self.table = _Table(tokens)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has.  An ``x`` before the space is a token of its own, which is taken
        off again: so a text's first word is encoded like any other."""
        ids, n = [], []
        for _, _, block, at in self.encoder.blocks(pc.binary_join_element_wise("x ", texts, ""), 0):
            inner = np.ones(len(block), bool)
            inner[at[:-1]] = inner[at[1:] - 1] = False
            ids.append(block[inner].astype(np.int64))
            n.append(np.diff(at) - 2)
        return np.concatenate(ids), np.concatenate(n)


class SentencePieces:
    """A ``sentencepiece`` model, which itself adds a space.  Where no piece has a space behind another character,
    runs of spaces with the word after them are encoded alone: no merge crosses their border."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=file_of(path))
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.table = _Table([bytes([int(p[1:-1], 16)]) if self.lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.memo = _Memo(np.dtype("<u4"))

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, num_threads=1)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = W.texts(pc.binary_join_element_wise(" ", texts, ""))
        if not self.cut:
            lists = self._lists(texts.to_pylist())
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((x for y in lists for x in y), np.int64, int(n.sum())), n
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        key = W.mix(W.hashes(data, start, end), 13)
        own, where, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.memo) + len(own) > MEMO or self.memo.used > MEMO_IDS:
            self.memo = _Memo(np.dtype("<u4"))
        at, count = self.memo.get(own)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, unit = data.tobytes(), where[new]
            self.memo.add(own[new], self._lists([raw[a + 1 : b].decode() for a, b in zip(start[unit].tolist(), end[unit].tolist(), strict=True)]))
            at, count = self.memo.get(own)
        at, count = at[which], count[which].astype(np.int64)
        # a lone space has no token as a text of its own: sentencepiece encodes nothing for an empty text
        blank = (end - start) == 1
        ids = _ranges(self.memo.ids, at, count).astype(np.int64)
        if blank.any():
            count = count + blank
            mended, on = np.empty(int(count.sum()), np.int64), np.ones(int(count.sum()), bool)
            on[(np.cumsum(count) - count)[blank]] = False
            mended[on], mended[~on] = ids, self.lib.piece_to_id("▁")
            ids = mended
        row = np.searchsorted(offsets, start, "right") - 1
        return ids, np.bincount(row, count, len(texts)).astype(np.int64)


@lru_cache(maxsize=4)
def _side(kind: type, path: str):
    return kind(path)


def _same_bytes(side, ids: np.ndarray, n: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text's joined token bytes are space + text."""
    data, offsets = W.texts(pc.binary_join_element_wise(" ", texts, ""))
    first = np.cumsum(n) - n
    size = np.concatenate([np.zeros(1, np.int64), np.cumsum(side.table.length[ids])])
    good = size[first + n] - size[first] == np.diff(offsets)
    if not good.all():  # compare those of the right length only
        at, keep = np.flatnonzero(good), np.repeat(good, n)
        ids, n, first = ids[keep], n[at], None
        data, offsets = _ranges(data, offsets[at], np.diff(offsets)[at]), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(offsets)[at])])
    else:
        at = np.arange(len(good))
    differs = np.concatenate([np.zeros(1, np.int64), np.cumsum(side.table.joined(ids) != data)])
    good[at] = differs[offsets[1:]] == differs[offsets[:-1]]
    return good


def _ends(side, ids: pa.ListArray) -> pa.Table:
    """doc, key (document and end, in bytes from the document's start) and place of each token of a list column."""
    flat, doc = np.asarray(pc.list_flatten(ids)), pc.list_parent_indices(ids)
    total = np.asarray(pc.cumulative_sum(pa.array(side.table.length[flat])))
    n = np.asarray(pc.list_value_length(ids), dtype=np.int64)
    before = np.concatenate([np.zeros(1, np.int64), total])[np.cumsum(n) - n]
    end = total - np.repeat(before, n)
    return pa.table({"doc": doc, "key": (np.asarray(doc, dtype=np.int64) << 40) + end, "at": np.arange(len(flat), dtype=np.int32)})


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]).astype(np.int32)), pa.array(ids))


def _grouped(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides; groups are numbered through all documents."""
    both = a.select(["key", "at"]).join(b.select(["key", "at"]), keys="key", join_type="inner", right_suffix="_b", use_threads=False)
    out = []
    for side, at in ((a, both["at"]), (b, both["at_b"])):
        last = np.zeros(len(side), np.int64)
        last[np.asarray(at)] = 1
        out.append(np.cumsum(last) - last)
    return tuple(out)


@lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``n`` in decimal, one row of bytes each with a byte to spare, and how many digits they have."""
    width = len(str(n))
    table = np.array([str(i).encode() for i in range(n)], f"S{width + 1}").view(np.uint8).reshape(n, width + 1)
    return table, (table > 0).sum(1)


def _decimal(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimal, each followed by its mark (0: none): bytes, and the length of each."""
    table, width = _decimals(1 << 17) if not len(ids) or ids.max() < 1 << 17 else _decimals(int(ids.max()) + 1)
    rows, width = table[ids], width[ids]
    rows[np.arange(len(ids)), width] = mark
    return rows[rows > 0], width + (mark > 0)


def _digests(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, doc_of_group: np.ndarray, n_docs: int) -> list[str]:
    """The SHA-256 of each document's groups: ``a1,a2|b1;a3|b2,b3``."""
    n_groups = len(doc_of_group)
    count_a, count_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    place_a = np.arange(len(a)) + (np.cumsum(count_b) - count_b)[ga]
    place_b = np.arange(len(b)) + np.cumsum(count_a)[gb]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), 44, np.uint8)
    ids[place_a], ids[place_b] = a, b
    size = count_a + count_b
    mark[np.cumsum(size) - count_b - 1] = 124
    mark[np.cumsum(size) - 1] = 59
    last = np.flatnonzero(np.append(doc_of_group[1:] != doc_of_group[:-1], True)) if n_groups else np.zeros(0, np.int64)
    mark[(np.cumsum(size) - 1)[last]] = 0
    text, length = _decimal(ids, mark)
    end = np.cumsum(length)[np.cumsum(size)[last] - 1]
    out, raw, lo = [""] * n_docs, memoryview(text.tobytes()), 0
    for d, hi in zip(doc_of_group[last].tolist(), end.tolist(), strict=True):
        out[d], lo = hashlib.sha256(raw[lo:hi]).hexdigest(), hi
    return out


def _links(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, doc_of_group: np.ndarray, size_a: int, size_b: int) -> pa.Table:
    """doc, a, b, links: how often each document links each id pair.  Groups of one token a side are pairs as they are;
    the others' ids are counted by group and joined on it."""
    n_groups, once = len(doc_of_group), {"use_threads": False}
    plain = (np.bincount(ga, minlength=n_groups) == 1) & (np.bincount(gb, minlength=n_groups) == 1)
    on_a, on_b = plain[ga], plain[gb]  # in both sides in the order of groups
    left = pa.table({"g": ga[~on_a], "a": a[~on_a]}).group_by(["g", "a"], **once).aggregate([([], "count_all")]).rename_columns(["g", "a", "n"])
    right = pa.table({"g": gb[~on_b], "b": b[~on_b]}).group_by(["g", "b"], **once).aggregate([([], "count_all")]).rename_columns(["g", "b", "m"])
    rest = left.join(right, keys="g", join_type="inner", use_threads=False)
    doc = np.concatenate([doc_of_group[plain], doc_of_group[np.asarray(rest["g"])]])
    key = (doc * size_a + np.concatenate([a[on_a], np.asarray(rest["a"])])) * size_b + np.concatenate([b[on_b], np.asarray(rest["b"])])
    times = np.concatenate([np.ones(int(plain.sum()), np.int64), np.asarray(rest["n"]) * np.asarray(rest["m"])])
    links = pa.table({"key": key, "links": times}).group_by("key", **once).aggregate([("links", "sum")])
    key = np.asarray(links["key"])
    return pa.table({"doc": key // (size_a * size_b), "a": key // size_b % size_a, "b": key % size_b, "links": links["links_sum"]})


def _piece(texts: pa.Array, side_a, side_b) -> tuple[pa.Table, pa.Table]:
    """Of some texts (none null or empty): n_a, n_b, n_groups, n_links and groups_sha256 of each; and doc, a, b, links."""
    (a, n_a), (b, n_b) = side_a.ids(texts), side_b.ids(texts)
    good = _same_bytes(side_a, a, n_a, texts) & _same_bytes(side_b, b, n_b, texts)
    a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
    table_a, table_b = _ends(side_a, _lists(a, n_a)), _ends(side_b, _lists(b, n_b))
    ga, gb = _grouped(table_a, table_b)
    doc_a = np.asarray(table_a["doc"], dtype=np.int64)
    doc_of_group = doc_a[np.flatnonzero(np.diff(ga, prepend=-1))]
    links = _links(a, ga, b, gb, doc_of_group, len(side_a.table.length), len(side_b.table.length))
    n_links = np.bincount(np.asarray(links["doc"]), np.asarray(links["links"]).astype(np.float64), len(texts)).astype(np.int64) if len(links) else np.zeros(len(texts), np.int64)
    docs = pa.table({"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of_group, minlength=len(texts)).astype(np.int64), "n_links": n_links, "groups_sha256": pa.array(_digests(a, ga, b, gb, doc_of_group, len(texts)), pa.string())})
    return docs, links


_DOCS = [("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")]


def _block(rows: list[pa.Table], links: list[pa.Table], number: int) -> pa.RecordBatch:
    """One row: lists of the documents, of their pairs, and of the pairs' partial counts."""
    docs = pa.concat_tables(rows)
    every = pa.concat_tables(links).combine_chunks()
    key = np.asarray(every["a"]) * (1 << 32) + np.asarray(every["b"])
    pairs, place = np.unique(key, return_inverse=True)
    partial = pa.table({"at": place}).group_by("at", use_threads=False).aggregate([([], "count_all")]).sort_by("at")
    order = np.argsort(np.asarray(every["doc"]), kind="stable")
    n_pairs = np.bincount(np.asarray(every["doc"]), minlength=len(docs))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x))
    columns = [pa.array([number], pa.int64()), *(one(docs[name]) for name, _ in _DOCS), one(n_pairs), one(place[order].astype(np.int32)), one(np.asarray(every["links"], dtype=np.int64)[order])]
    columns += [one((pairs >> 32).astype(np.int32)), one((pairs & 0xFFFFFFFF).astype(np.int32)), one(np.asarray(partial["count_all"], dtype=np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["block", *(name for name, _ in _DOCS), "n_pairs", "place", "links", "a", "b", "n"])


def blocks(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents, as ``_block`` makes it."""

    def run(it):
        side_a, side_b = _side(BytePieces, byte_file), _side(SentencePieces, piece_file)
        rows, links, size, n, number = [], [], 0, 0, (TaskContext.get().partitionId() + 1) << 32
        for batch in it:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), dtype=np.int64)
            end, lo = np.cumsum(lengths), 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(end, end[lo] - lengths[lo] + PIECE_BYTES, "right")))
                part, has = batch.slice(lo, hi - lo), np.flatnonzero(lengths[lo:hi])
                zero = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0}
                out = {name: np.zeros(len(part), np.int64) for name in zero}
                digest = [""] * len(part)
                if len(has):
                    found, pairs = _piece(part.column(1).take(pa.array(has)), side_a, side_b)
                    for name in zero:
                        out[name][has] = np.asarray(found[name])
                    for i, x in zip(has.tolist(), found["groups_sha256"].to_pylist(), strict=True):
                        digest[i] = x
                    links.append(pairs.set_column(0, "doc", pa.array(has[np.asarray(pairs["doc"])] + n)))
                rows.append(pa.table({"doc_id": part.column(0), **out, "groups_sha256": pa.array(digest, pa.string())}))
                size, n, lo = size + int(end[hi - 1] - end[lo] + lengths[lo]), n + len(part), hi
                if size >= block_bytes:
                    yield _block(rows, links or [_NO_LINKS], number)
                    rows, links, size, n, number = [], [], 0, 0, number + 1
        if rows:
            yield _block(rows, links or [_NO_LINKS], number)

    lists = ", ".join(f"{name} array<{kind}>" for name, kind in _DOCS)
    schema = f"block long, {lists}, n_pairs array<long>, place array<int>, links array<long>, a array<int>, b array<int>, n array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


_NO_LINKS = pa.table({x: pa.array([], pa.int64()) for x in ("doc", "a", "b", "links")})


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold an id pair linked, and whether no pair of a has more."""
    partial = made.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    total = partial.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = total.groupBy("a").agg(F.max("count").alias("most"))
    return total.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a and n_b (tokens of the two tokenizers), n_groups, n_links, n_best (links
    whose id pair is its first id's most frequent, ties included), count_sum (of the links' pairs' counts),
    groups_sha256 ('' without tokens).

    Null and empty texts, and texts that a tokenizer does not give back byte by byte (a literal U+2581), have no tokens:
    zeros.  Texts are taken whole, whatever their length; rows with equal or null ids each give a row and count as
    documents of their own; an empty table gives no rows; other columns are not read.
    """
    made = written(blocks(docs, byte_file, piece_file, id_col, text_col, block_bytes), "blocks", batch_rows=SCAN_BLOCKS)
    total = written(pair_counts(made), "pairs")
    places = made.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("block", "at", "p.a", "p.b")
    told = places.join(total, ["a", "b"]).select(F.col("block").alias("of"), "at", "count", "best")
    kept = [name for name, _ in _DOCS] + ["n_pairs", "place", "links"]

    def run(block, told):
        """The one row of a block, and the counts of its pairs."""
        col = {name: block[name].combine_chunks().flatten() for name in kept}
        count, best = np.zeros(len(told), np.int64), np.zeros(len(told), bool)
        at = np.asarray(told["at"])
        count[at], best[at] = np.asarray(told["count"]), np.asarray(told["best"])
        n_pairs, place, links = (np.asarray(col[x]) for x in ("n_pairs", "place", "links"))
        first = np.cumsum(n_pairs) - n_pairs
        of_docs = lambda x: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[np.append(first, len(x))])
        return pa.table({**{name: col[name] for name, _ in _DOCS}, "n_best": of_docs(links * best[place]), "count_sum": of_docs(links * count[place])})

    done = made.select("block", *kept).groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _DOCS) + ", n_best long, count_sum long")
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
