"""Approximate nearest neighbours by inner product: collision counting over single projections.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors, so the largest
inner product is the smallest distance.  A shard of at most ``SHARD`` vectors has ``PROJECTIONS`` arrays, each of the
vectors' cells in one random projection, of which there are 256 of equal width, one byte each.  A query's window in each
array is centred at its own projection, begins at the width that a sample of the shard asks for, and is widened round by
round (virtual rehashing); a vector whose cell falls into ``SHARE`` of the windows has collided often enough and is
verified by its exact inner product.  Rounds end when ``ENOUGH`` vectors and ``ENOUGH_SHARE`` of the shard have collided,
or all of a smaller shard.

Vectors are shuffled to their shard once and its arrays are built once; queries travel: each goes to every shard, behind
its vectors, and is answered there in blocks of at most ``BLOCK``.  The best ``k`` of each shard meet in one ranking
per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.scratch import tidy, written

SHARD, BLOCK = 16_384, 512
PROJECTIONS, SHARE, SEED = 80, 0.85, 20
#: Vectors of a shard by which a window's first width is chosen, and queries whose collisions are counted together.
SAMPLE, AT_ONCE = 256, 64
#: Growth of a window: far from the end, and once ``NEAR_END`` of the vectors that end a query have collided.
GROWTH, FINE, NEAR_END = 1.15, 1.03, 0.3
#: Vectors that must collide before a query ends: so many, and this share of the shard.
ENOUGH, ENOUGH_SHARE = 1000, 0.2


class Shard:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, norm: float):
        self.vectors, self.ids = vectors, ids
        scaled = vectors / norm
        self.small = scaled.astype(np.float32)
        rest = np.sqrt(np.clip(1 - (scaled * scaled).sum(1), 0, None))
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        value = np.concatenate([scaled, rest[:, None]], 1) @ self.axes
        self.sample = value[:: max(1, len(ids) // SAMPLE)].astype(np.float32)
        self.low = value.min(0)
        self.cell = np.maximum((value.max(0) - self.low) / 255, 1e-300)
        self.cells = np.ascontiguousarray(((value - self.low) / self.cell).T.astype(np.uint8))

    def _begin(self, at: np.ndarray, least: int, enough: int) -> np.ndarray:
        """The half width at which about ``enough`` vectors collide with each query, by a sample of the shard."""
        apart = np.partition(np.abs(self.sample[None] - at[:, None].astype(np.float32)), least - 1, axis=2)[:, :, least - 1]
        nth = min(len(self.sample) - 1, int(enough / len(self.ids) * len(self.sample)))
        return np.partition(apart, nth, axis=1)[:, nth].astype(np.float64)

    def _counted(self, at: np.ndarray, half: np.ndarray) -> np.ndarray:
        """(query, vector): in how many projections the vector's cell is in the query's window."""
        lo = np.clip((at - half[:, None] - self.low) / self.cell, 0, 255).astype(np.uint8)
        wide = np.clip((at + half[:, None] - self.low) / self.cell, 0, 255).astype(np.uint8) - lo
        count = np.zeros((len(at), self.cells.shape[1]), np.uint8)
        apart, hit = np.empty_like(count), np.empty(count.shape, bool)
        for j, cells in enumerate(self.cells):
            np.subtract(cells, lo[:, j, None], out=apart)  # cells before the window wrap to beyond its end
            np.less_equal(apart, wide[:, j, None], out=hit)
            count += hit.view(np.uint8)
        return count

    def collided(self, queries: np.ndarray, k: int):
        """The vectors that collide often enough with each query."""
        n, least = len(self.ids), int(np.ceil(SHARE * PROJECTIONS))
        enough = min(n, max(k + 1, ENOUGH) + int(ENOUGH_SHARE * n))
        out: list = [np.arange(n)] * len(queries)
        if enough == n:
            return out
        every = (queries / np.sqrt((queries * queries).sum(1, keepdims=True))) @ self.axes[:-1]
        for first in range(0, len(queries), AT_ONCE):
            at = every[first : first + AT_ONCE]
            live, half = np.arange(len(at)), self._begin(at, least, enough)
            while len(live):
                hit = self._counted(at[live], half) >= least
                size = hit.sum(1)
                for i in np.flatnonzero(size >= enough):
                    out[first + live[i]] = np.flatnonzero(hit[i])
                more = size < enough
                half = (half * np.where(size >= NEAR_END * enough, FINE, GROWTH))[more]
                live = live[more]
        return out

    def nearest(self, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): the best ``k`` of each query's verified vectors, all that tie with the last."""
        found = self.collided(queries, k)
        out = []
        for i, near in enumerate(found):
            near = near[self.ids[near] != ids[i]]
            if not len(near):
                continue
            if len(near) > k:  # in single precision first, with a margin beyond its errors
                rough = self.small.take(near, 0) @ (queries[i] / np.sqrt((queries[i] * queries[i]).sum())).astype(np.float32)
                near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-6 * np.sqrt(queries.shape[1])]
            score = np.zeros(len(near))
            for j in range(queries.shape[1]):  # one order of addition, so that equal vectors tie
                score += self.vectors[near, j] * queries[i, j]
            best = near[np.lexsort((self.ids[near], -score))[:k]], score[np.lexsort((self.ids[near], -score))[:k]]
            out.append((np.full(len(best[0]), i), *best))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row of ``queries`` the ``k`` nearest found in ``vectors``
    by inner product, ties to the smaller id; all of them if there are fewer.

    Rows without an id, and vectors that are null, zero, or hold null or non-finite components, take no part; nor
    does a row with the query's own id, or one of another length.  Queries that share an id count as one if their
    vectors are equal and else answer together.  Empty tables give no rows; other columns are not read.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
        v = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
        return v.withColumn("d", F.size("v"))

    data, asked = written(valid(vectors), "vectors"), written(valid(queries).distinct(), "queries")
    n, norm = data.agg(F.count(F.lit(1)), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).first()
    shards = max(1, -(-n // SHARD))
    data = data.select("d", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), F.lit(False).alias("asks"), "id", "v")
    asked = asked.select("d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.lit(True).alias("asks"), "id", "v")

    def run(it):
        """Rows by shard, its vectors before the queries."""
        place, rows, ids, shard = None, [], [], None
        for batch in it:
            d, s, asks = (np.asarray(batch.column(i)) for i in range(3))
            new = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                vectors, own = _matrix(part.column(4)), np.asarray(part.column(3))
                if place != (d[lo], s[lo]):
                    place, rows, ids, shard = (d[lo], s[lo]), [], [], None
                if not asks[lo]:
                    rows.append(vectors)
                    ids.append(own)
                    continue
                if not rows:
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(rows), np.concatenate(ids), float(norm))
                for at in range(0, len(own), BLOCK):
                    q, i, score = shard.nearest(vectors[at : at + BLOCK], own[at : at + BLOCK], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at : at + BLOCK][q]), pa.array(shard.ids[i]), pa.array(score)], ["query_id", "vec_id", "score"])

    # a number of its own: by their bytes several shards would be merged into one task, but their work is in the queries
    ordered = data.union(asked).repartition(4 * shards, "d", "s").sortWithinPartitions("d", "s", "asks", "id")
    pairs = ordered.mapInArrow(tidy(run), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
