"""Token ids in files: frequency ranks in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank by frequency in the whole corpus, so common ids take one byte.  Four ranks share a
control byte (two bits each: length less one); their 1 to 4 bytes follow in a stream of their own.  A file is a
run of blocks of documents in ascending id order: ``blocks/shard=N`` holds a range of ids, a block's ``first``
orders it among all.  ``ranks`` holds the id of each rank.  Readers look a control byte's four lengths up in a
table of 256 rows and gather all values of a block at once with NumPy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.llm.scratch import sized, tidy, written
from kiln.llm.tokens import binaries, encoder

#: Ids in a block, about.
BLOCK_IDS = 1 << 20

_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    r = ranks.astype("<u4", copy=False)
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    control = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    control[: len(r)] = extra
    control = control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    control = control[:, 0] | control[:, 1] | control[:, 2] | control[:, 3]
    at = np.arange(len(r)) + np.cumsum(extra, dtype=np.int64) - extra
    data = np.empty(len(r) + int(extra.sum(dtype=np.int64)), np.uint8)
    data[at] = r.astype(np.uint8)
    for i in (1, 2, 3):
        on = np.flatnonzero(extra >= i)
        data[at[on] + i] = (r[on] >> np.uint32(8 * i)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    four = np.ndarray(len(data), "<u4", data + b"\0\0\0", strides=(1,))  # the four bytes from each place on
    return four[at] & _MASKS[length]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(doc_id, shard, ids): ids in the encoder's width; shard is the range of ``bounds`` that holds the id."""

    def run(it):
        enc, cuts = encoder(tokenizer), np.array(bounds, np.int64)
        for batch in it:
            for lo, hi, flat, at in enc.blocks(batch.column(1), end_id):
                doc = batch.column(0).slice(lo, hi - lo)
                shard = np.searchsorted(cuts, np.asarray(pa.compute.fill_null(doc, -(2**63))), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc, pa.array(shard), binaries(flat, at).cast(pa.binary())], ["doc_id", "shard", "ids"])

    return docs.mapInArrow(tidy(run), "doc_id long, shard int, ids binary")


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and each row's count."""
    n = np.asarray(pa.compute.binary_length(column)).astype(np.int64) // kind.itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset :]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[len(column)]].view(kind) if data else np.zeros(0, kind), n


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Writes ``docs`` as id files under ``path`` (a folder that all executors share), ascending by id.

    Null text counts as empty: the end id alone.  Null ids come first; rows with equal ids are ordered by their
    token ids' bytes and are all kept; an empty table gives files without rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(map(int, rows.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards)))) if shards > 1 else []
    ordered = tokenized(rows, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "ids")
    ids = written(ordered.withColumn("seq", F.monotonically_increasing_id()), "ids")  # ascending, since shards are
    enc = encoder(tokenizer)
    kind, n_ids = enc.kind, max(enc.n_ids, end_id + 1)

    def count(it):
        total = np.zeros(n_ids, np.int64)
        for batch in it:
            total += np.bincount(_flat(batch.column(0), kind)[0], minlength=n_ids)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    # at most one row per id of the vocabulary, whatever the corpus
    order = ids.select("ids").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    vocabulary = order["id"].to_numpy(np.int64)
    rank = np.zeros(n_ids, np.uint32)
    rank[vocabulary] = np.arange(len(vocabulary))
    spark.createDataFrame([(i, int(v)) for i, v in enumerate(vocabulary)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank)  # bounded by the vocabulary

    def blocks(it):
        for batch in it:
            doc, shard, column, seq = (batch.column(i) for i in range(4))
            flat, n = _flat(column, kind)
            flat, at, s = ranks.value[flat], np.concatenate([[0], np.cumsum(n)]), np.asarray(seq)
            cut = np.flatnonzero(np.diff(s, prepend=s[:1] - 2) != 1)  # other shards, other splits
            starts: list[int] = []
            for lo, hi in zip(cut, [*cut[1:], len(s)], strict=True):
                while lo < hi:
                    starts.append(int(lo))
                    lo = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_IDS, "right")) - 1)
            for lo, hi in zip(starts, [*starts[1:], len(s)], strict=True):
                control, data = encode(flat[at[lo] : at[hi]])
                yield pa.RecordBatch.from_arrays(
                    [shard.slice(lo, 1), seq.slice(lo, 1), pa.array([doc.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), pa.array([n[lo:hi]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                    ["shard", "first", "doc_ids", "lengths", "control", "data"],
                )

    coded = ids.select("doc_id", "shard", "ids", "seq").mapInArrow(tidy(blocks), "shard int, first long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    coded.sortWithinPartitions("shard", "first").write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    schema = "first long, doc_ids array<long>, lengths array<long>, control binary, data binary, shard int"
    files = spark.read.schema(schema).parquet(f"{path}/blocks")
    vocabulary = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").toPandas().sort_values("rank")["id"].to_numpy()
    table = spark.sparkContext.broadcast(vocabulary.astype("<u4"))  # bounded by the vocabulary

    def run(it):
        for batch in it:
            first, docs, lengths, control, data = (batch.column(i) for i in range(5))
            for i in range(len(first)):
                n = np.asarray(lengths[i].values, np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                raw = table.value[decode(control[i].as_py(), data[i].as_py(), int(at[-1]))].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [docs[i].values, pa.array(np.full(len(n), first[i].as_py())), pa.array(at[:-1]), pa.array(n), pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["doc_id", "first", "within", "n_tokens", "ids"],
                )

    # blocks are few and shards fewer: sums of blocks within a shard, and of shards
    block = files.select("shard", "first", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    shard = block.groupBy("shard").agg(F.sum("n").alias("all")).withColumn("base", F.sum("all").over(Window.orderBy("shard")) - F.col("all")).select("shard", "base")
    within = F.sum("n").over(Window.partitionBy("shard").orderBy("first")) - F.col("n")
    offset = written(block.withColumn("before", within).join(shard, "shard").select("first", (F.col("before") + F.col("base")).alias("before")), "offsets")
    docs = files.select("first", "doc_ids", "lengths", "control", "data").mapInArrow(tidy(run), "doc_id long, first long, within long, n_tokens long, ids binary")
    return docs.join(sized(offset, 16), "first").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")
