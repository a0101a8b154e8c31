"""Near copies of embeddings by cross-polytope hashing.

A vector is padded to a power of two and turned by random signs and fast Hadamard transforms, three times; its hash is
the axis (with its sign) of the largest coordinate.  A code joins ``hashes`` such values; a table has one code for
each vector, and ``TABLES`` tables are kept.  A vector stands in the bucket of its own code and visits (multiprobe) the buckets
of the codes that cost least: those where it nearly fell.  Two vectors meet if one visits the bucket of the other.
There are ``hashes_for(n)`` values to a code, so that buckets outnumber vectors, and four times the probes for each value
more, which keeps the chance to meet; it is 0.98 or more for a cosine of 0.9 (measured in the tests).

Only keys of buckets and numbers of vectors are shuffled first; vectors follow to buckets that more than one of them is
in.  A bucket beyond ``BUCKET`` vectors is cut into parts and every pair of parts becomes a group of its own.  Pairs
are verified in double precision inside the tasks, in the first bucket that they share; what leaves a group is one
row per vector, with its links there and the smallest vector that it is connected to, never pairs.  Equal vectors are
one vector with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.scratch import sized, tidy, written
from kiln.llm.simhash import _labels, components
from kiln.llm.words import mix

COSINE, TABLES, SEED = 0.9, 5, 7
#: Vectors of a bucket, or of a part of a larger one.
BUCKET = 2048
#: Coordinates of a hash that probes look at, and cells of a block of products.
_AXES, _CELLS = 5, 1 << 20
#: Rows of a group that is looked at together with others.
_SMALL = 64

_U = np.uint64


def hashes_for(n: int, dims: int = 64) -> int:
    """Values in a code for ``n`` vectors: as many as make four buckets or more for each vector, two at least."""
    sides, k = 2 * (1 << max(0, dims - 1).bit_length()), 2
    while sides**k < 4 * n:
        k += 1
    return k


def _hadamard(x: np.ndarray) -> np.ndarray:
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Hasher:
    """The codes of unit vectors with ``dims`` components, as bucket keys: vectors x tables x probes, own code first."""

    def __init__(self, dims: int, hashes: int, tables: int = TABLES):
        self.dims, self.hashes, self.tables = dims, hashes, tables
        self.size = 1 << max(0, dims - 1).bit_length()
        self.probes = 4 ** (hashes - 1)
        self.signs = np.random.default_rng([SEED, dims]).choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def keys(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.size))
        padded[:, : self.dims] = x
        axes, out = min(_AXES, self.size), []
        for t in range(self.tables):
            code, cost = np.zeros((len(x), 1), np.uint64), np.zeros((len(x), 1))
            for h in range(self.hashes):
                y = padded
                for s in self.signs[t, h]:
                    y = _hadamard(y * s)
                size = np.abs(y)
                top = np.sort(np.argpartition(-size, axes - 1, 1)[:, :axes], 1)
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), 1, kind="stable"), 1)
                value = np.take_along_axis(y, top, 1)
                loss = (np.abs(value[:, :1]) - np.abs(value)) ** 2
                code = (code[:, :, None] * _U(2 * self.size) + (2 * top + (value < 0)).astype(np.uint64)[:, None, :]).reshape(len(x), -1)
                cost = (cost[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
                best = np.argsort(cost, 1, kind="stable")[:, : self.probes]
                code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
            if code.shape[1] < self.probes:  # few dimensions have few codes
                code = np.concatenate([code, np.repeat(code[:, :1], self.probes - code.shape[1], 1)], 1)
            out.append(mix(mix(code, t), self.dims))
        return np.stack(out, 1)


def _first_met(a: np.ndarray, b: np.ndarray, t: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of pairs of vectors (their keys: pairs x tables x probes) that meet in bucket ``key`` of table ``t``: whether it
    is the first where they do; within a table, the smaller of the two that they may share."""
    first, far = np.ones(len(a), bool), _U(2**64 - 1)
    for u in range(a.shape[1]):
        in_a = (b[:, u] == a[:, u, :1]).any(1)  # b visits a's bucket
        in_b = (a[:, u] == b[:, u, :1]).any(1)
        least = np.minimum(np.where(in_a, a[:, u, 0], far), np.where(in_b, b[:, u, 0], far))
        first &= ~((in_a | in_b) & (u < t)) & ((u != t) | (least == key))
    return first


class _Rows:
    """Rows of whole groups, ordered by group: a vector's number, copies and unit vector, its group's table and key,
    whether it is the vector's own bucket, and which part of a cut bucket it is in (``cross``: only pairs of
    different parts count).  Gathers links and connected rows."""

    def __init__(self, hasher: Hasher, cosine: float, x, t, key, own, part, cross, copies):
        self.hasher, self.cosine = hasher, cosine
        self.x, self.t, self.key, self.own, self.part, self.cross, self.copies = x, t, key, own, part, cross, copies
        self.links, self.label = np.zeros(len(x), np.int64), np.arange(len(x))

    def wanted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.own[a] | self.own[b]) & (~self.cross[a] | (self.part[a] != self.part[b]))

    def small(self, at: np.ndarray, size: np.ndarray) -> None:
        """Groups of few rows (``at``, in runs of ``size``), all of them together."""
        later = np.repeat(np.cumsum(size), size) - np.arange(len(at)) - 1
        total, lo = np.cumsum(later), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - later[lo] + _CELLS // self.x.shape[1], "right")))
            n = later[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = at[a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
            a = at[a]
            on = self.wanted(a, b)
            a, b = a[on], b[on]
            on = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.cosine
            self.add(a[on], b[on])
            lo = hi

    def large(self, start: int, end: int) -> None:
        """One group of many rows, in blocks of products."""
        x, step = self.x[start:end], max(1, _CELLS // (end - start))
        keys = self.hasher.keys(x)
        for lo in range(0, len(x), step):
            a, b = np.nonzero(x[lo : lo + step] @ x.T >= self.cosine)
            a += lo
            a, b = a[a < b] + start, b[a < b] + start
            on = self.wanted(a, b)
            self.add(a[on], b[on], keys, start)

    def add(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray | None = None, start: int = 0) -> None:
        """Near pairs of rows; ``keys`` of the rows from ``start`` on, if they are there already."""
        if not len(a):
            return
        self.label = _labels(len(self.x), a, b, self.label)
        if keys is None:
            rows = np.unique(np.concatenate([a, b]))
            keys = self.hasher.keys(self.x[rows])
            ka, kb = np.searchsorted(rows, a), np.searchsorted(rows, b)
        else:
            ka, kb = a - start, b - start
        for i in range(0, len(a), 1 << 14):
            p, q = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
            first = _first_met(keys[ka[i : i + (1 << 14)]], keys[kb[i : i + (1 << 14)]], self.t[p], self.key[p])
            np.add.at(self.links, p[first], self.copies[q[first]])
            np.add.at(self.links, q[first], self.copies[p[first]])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows found with a cosine of at least ``cosine``),
    component_id (the smallest id reachable by links, itself included), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths.  Rows with equal vectors are linked; rows that share an id count each for itself.  A null id is linked
    like any other but is the smallest only if all are null.  An empty table gives no rows; other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fit = "v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("v", F.expr(f"if({fit}, v, null)")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    ids = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2"))
    same = rows.where("v is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    same = written(same.withColumn("c", F.monotonically_increasing_id()), "classes")
    n, dims = same.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    k = hashes or hashes_for(n, dims or 1)

    def lists(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(column.flatten()), np.asarray(column.value_lengths())

    def coded(it):
        hashers: dict = {}
        for batch in it:
            flat, size = lists(batch.column(1))
            start, c = np.cumsum(size) - size, np.asarray(batch.column(0))
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                hasher = hashers.setdefault(d, Hasher(d, k, tables))
                for lo in range(0, len(own), 2048):
                    at = own[lo : lo + 2048]
                    keys = hasher.keys(unit(flat[start[at][:, None] + np.arange(d)]))
                    main = np.zeros(keys.shape, bool)
                    main[:, :, 0] = True
                    row = np.broadcast_to(c[at][:, None, None], keys.shape)
                    table = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], keys.shape)
                    once = main | (keys != keys[:, :, :1])
                    yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (keys.view(np.int64), table, row, main)], ["key", "t", "c", "own"])

    codes = written(same.select("c", "v").mapInArrow(tidy(coded), "key long, t int, c long, own boolean"), "codes")
    shared = codes.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any").select("key", "t", F.ceil(F.col("n") / bucket).cast("int").alias("parts"))
    met = codes.join(written(shared, "buckets"), ["key", "t"])
    met = met.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.selectExpr("c", "key", "t", "own", "part", "least(part, other) as i", "greatest(part, other) as j").join(same.select("c", "v", "copies"), "c")
    order = ["key", "t", "i", "j"]
    ordered = met.select(*order, "c", "own", "part", "copies", "v").repartition(*order).sortWithinPartitions(*order, "c")

    def out(table, hashers):
        cols = {x: np.asarray(table[x]) for x in (*order, "c", "own", "part", "copies")}
        flat, dims = lists(table["v"])
        start = np.cumsum(dims) - dims
        new = np.flatnonzero(np.any([np.diff(cols[x]) != 0 for x in order], 0)) + 1
        size = np.diff(np.concatenate([[0], new, [len(table)]]))
        dims_of, done = dims[np.cumsum(size) - size], []
        for d in np.unique(dims).tolist():  # keys of vectors of other lengths differ
            chosen = (dims_of == d) & (size > 1)
            of, own_size = np.flatnonzero(np.repeat(chosen, size)), size[chosen]
            if not len(of):
                continue
            x = unit(flat[start[of][:, None] + np.arange(d)])
            c = cols["c"][of]
            rows = _Rows(hashers.setdefault(d, Hasher(d, k, tables)), cosine, x, cols["t"][of], cols["key"][of].view(np.uint64), cols["own"][of], cols["part"][of], cols["i"][of] != cols["j"][of], cols["copies"][of])
            few = own_size <= _SMALL
            rows.small(np.flatnonzero(np.repeat(few, own_size)), own_size[few])
            for end, n in zip(np.cumsum(own_size)[~few].tolist(), own_size[~few].tolist(), strict=True):
                rows.large(end - n, end)
            low = c[rows.label]
            on = (rows.links > 0) | (low != c)
            done.append((c[on], rows.links[on], low[on]))
        done = [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(x) for x in done], ["c", "links", "low"])

    def verified(it):
        left, hashers = None, {}
        for batch in it:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            last = np.ones(len(table), bool)  # ordered: the last group may go on
            for x in order:
                col = np.asarray(table[x])
                last &= col == col[-1]
            done = len(table) - int(last.sum())
            if done:
                yield out(table.slice(0, done), hashers)
            left = table.slice(done)
        if left is not None and len(left):
            yield out(left, hashers)

    found = written(ordered.mapInArrow(tidy(verified), "c long, links long, low long"), "links")
    total = found.groupBy("c").agg(F.sum("links").alias("links"))
    root = components(found.where("low <> c").select(F.col("c").alias("a"), F.col("low").alias("b"))).select(F.col("a").alias("c"), F.col("b").alias("root"))
    member = same.select("c", "h1", "h2", "copies", "low").join(total, "c", "left").join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    member = written(member.join(least, "root").selectExpr("h1", "h2", "copies - 1 + coalesce(links, 0) as n_links", "component_id"), "members")
    joined = ids.join(sized(member, 48), ["h1", "h2"], "left")
    linked = F.col("h1").isNotNull()
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return result.withColumn("kept", F.expr("vec_id <=> component_id"))
