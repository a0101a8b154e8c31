"""SimHash near copies with BK-trees.

A fingerprint's 64 bits are cut into ``radius + 1`` bands; fingerprints within ``radius`` bits agree on a band,
so a shard holds the fingerprints with one value of one band.  Each shard has its BK-trees, whose children are
keyed by their Hamming distance to the parent; a query follows the edges within the radius of its own distance
only.  Shards go to tasks by key and their trees are not broadcast, since all trees together grow with the
corpus; a shard beyond ``TREE`` fingerprints is split into several trees, and its queries visit each.

Equal fingerprints are one node, so a group of copies costs one row.  A shard's links leave it as a star (each
fingerprint and the smallest it is linked to), never as pairs; stars are merged into components by alternating
large and small stars over tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import words as W
from kiln.llm.scratch import sized, tidy, written

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints in a tree, and pairs of query and node that may be looked at together.
TREE = 20_000
_STEP = 2_000_000
_ROWS = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    n = len(offsets) - 1
    data = _LOWER[data]
    start, end, row = W.spans(data, offsets)
    text, _ = W.joined(data, end, start, row, np.ones(len(start), bool), n)
    length = end - start
    at = np.cumsum(length + 1) - length - 1  # in the joined texts, which lack the space after a row's last word
    at -= np.cumsum(np.diff(row, prepend=row[:1]) != 0)
    count = np.bincount(row, minlength=n)
    word0 = np.cumsum(count) - count
    pieces = np.maximum(count - shingle + 1, (count > 0).astype(np.int64))
    own = np.repeat(np.arange(n), pieces)
    lo = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + word0[own]
    hi = lo + np.minimum(count, shingle)[own] - 1
    view, digest = memoryview(text.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(at[lo].tolist(), (at[hi] + length[hi]).tolist(), strict=True)), np.uint64, len(own))
    out, has = np.zeros(n, np.uint64), np.flatnonzero(pieces)
    if len(has):
        first = (np.cumsum(pieces) - pieces)[has]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        on = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > pieces[has][:, None]
        out[has] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): one row per input row; null text counts as empty, whose fingerprint is zero."""

    def run(it):
        for batch in it:
            for lo, hi, data, offsets in W.blocks(batch.column(2), 1 << 19):
                fp = pa.array(_fingerprints(data, offsets, shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), fp], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(id_col, text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, fp long")


def _text_hash(id_col: str, text_col: str):
    """With the id it tells rows apart; a null id goes into the hash, since joins drop nulls."""
    return F.xxhash64(F.col(text_col), F.col(text_col).isNull(), F.col(id_col).isNull())


class Forest:
    """BK-trees of many shards at once: a node's children are keyed by their distance to it."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """``shard`` ascending; the first node of a shard is its root."""
        self.fp = fp
        self.shards, root, tree = np.unique(shard, return_index=True, return_inverse=True)
        self.root = root
        at, rest = root[tree], np.ones(len(fp), bool)
        rest[root] = False
        keys, children, rest = [], [], np.flatnonzero(rest)
        while len(rest):  # all that reach a node do so in the same round: the first at each distance stays there
            key = at[rest] * 65 + np.bitwise_count(fp[rest] ^ fp[at[rest]])
            own, first, which = np.unique(key, return_index=True, return_inverse=True)
            child = rest[first]
            keys.append(own)
            children.append(child)
            at[rest] = child[which]
            rest = rest[at[rest] != rest]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], (np.concatenate(children) if keys else key)[order]

    def near(self, fp: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes within ``radius`` bits, in the tree that has the query's ``root``."""
        query, node, found = np.arange(len(fp)), root, []
        while len(query):
            d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            found.append((query[hit], node[hit]))
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - lo
            query = np.repeat(query, n)
            node = self.child[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (query, query)


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index of each one's component."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for x in (a, b):
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, x, low)
        label = label[label]
        if (label == before).all():
            return label


def _stars(group: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smallest fp it is linked to in its group), of rows ordered by group, where they differ."""
    order = np.lexsort((fp, group))
    group, fp, node = group[order], fp[order], node[order]
    trees = np.flatnonzero(node)
    if not len(trees):
        return fp[:0], fp[:0]
    forest = Forest(fp[trees].view(np.uint64), group[trees])
    at = np.minimum(np.searchsorted(forest.shards, group), len(forest.shards) - 1)
    ask = np.flatnonzero(forest.shards[at] == group)
    size = np.diff(np.append(forest.root, len(trees)))[at[ask]]
    ask, size = ask[size > 0], size[size > 0]
    label, lo, total = np.arange(len(fp)), 0, np.cumsum(size)
    while lo < len(ask):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - size[lo] + _STEP, "right")))
        q, n = forest.near(fp[ask[lo:hi]].view(np.uint64), forest.root[at[ask[lo:hi]]], radius)
        a, b = ask[lo:hi][q], trees[n]
        label = _labels(len(fp), a[a != b], b[a != b], label)
        lo = hi
    off = label != np.arange(len(fp))
    return fp[off], fp[label[off]]


def links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b): stars that link the distinct ``fp`` at ``radius`` bits or fewer; b is the smaller."""
    bands = radius + 1
    cut = [64 * i // bands for i in range(bands + 1)]
    band = [f"struct({i} as i, shiftrightunsigned(fp, {cut[i]}) & {2 ** (cut[i + 1] - cut[i]) - 1}L as v)" for i in range(bands)]
    keys = fps.select("fp", F.explode(F.expr(f"array({', '.join(band)})")).alias("k")).select("fp", "k.i", "k.v")
    counts = keys.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = written(counts, "shards")  # most fingerprints are alone in most shards
    many = keys.join(shards, ["i", "v"]).withColumn("own", F.expr(f"cast(pmod(xxhash64(fp, i), ceil(n / {tree}D)) as int)"))
    asked = many.withColumn("t", F.explode(F.expr(f"sequence(own, cast(ceil(n / {tree}D) as int) - 1)"))).withColumn("g", F.xxhash64("i", "v", "t"))

    def run(it):
        left = None
        for batch in it:
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            left = None
            g = np.asarray(table["g"])
            done = 0 if len(g) < _ROWS else int(np.searchsorted(g, g[-1]))  # ordered by g: the last group may go on
            if done:
                yield out(table.slice(0, done))
            left = table.slice(done)
        if left is not None:
            yield out(left)

    def out(table):
        a, b = _stars(np.asarray(table["g"]), np.asarray(table["fp"]), np.asarray(table["node"]), radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = asked.select("g", "fp", (F.col("t") == F.col("own")).alias("node"))
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the smallest of its component, and that smallest, by alternating large and
    small stars; every round is a table in the shared folder."""
    edges, seen = written(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.expr("explode(array(struct(a, m as b), struct(b as a, m as b)))").alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges
        seen = now


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of each row; root is the group's smallest fingerprint."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    star = components(links(fps.select("fp"), radius))
    root = fps.join(star.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "low", F.coalesce("b", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("low").alias("component_id"))
    member = written(root.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "members")
    return rows.join(sized(member, 40), "fp")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id, the smallest id that is reachable over fingerprints
    that differ in ``radius`` bits or fewer.

    Null or empty text has fingerprint zero and is linked like any other.  A null id is in its component, but is
    its smallest only if all are null.  Rows with equal ids or texts each give a row; an empty table gives none;
    other columns are not read.  Texts are taken whole.
    """
    return _grouped(docs, id_col, text_col, shingle, radius).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group (null last; then any one text), one a group; all
    columns are kept, whatever their names.  An empty table gives no rows."""
    last = F.lit(2**63 - 1)
    best = _grouped(docs, id_col, text_col, shingle, radius).groupBy("root", F.coalesce("doc_id", last).alias("id"), F.col("text_hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    best = written(best.groupBy("root").agg(F.min("id").alias("id"), F.min_by(F.struct("hash", "n"), F.struct("id", "hash")).alias("h")).select("id", "h.hash", "h.n"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), last).alias("id"), _text_hash(id_col, text_col).alias("hash"))
    kept = rows.join(sized(best.where("n = 1").select("id", "hash"), 24), ["id", "hash"], "left_semi")
    again = best.where("n > 1").select("id", "hash")
    if again.limit(1).count():  # equal rows: any one of them
        kept = kept.union(rows.join(sized(again, 24), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]))
    return kept.select("row.*")
